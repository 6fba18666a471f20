"""Structured Streaming forms: last events, silence alerts with event-time timers, emission once, polled pages."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tacet import config as C
from tacet.sources import commits
from tacet.sources.fetch import PageSource
from tacet.sources.shared import folder, keep


def read_events(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """A stream of (event_id, entity, ts, t) over event files, with a watermark for late ones."""
    schema = spark.read.parquet(path).schema
    glob = f"{path[:-1]}[{path[-1]}]"  # a pattern, so that a single file will do as well as a folder of files
    e = spark.readStream.schema(schema).parquet(glob).withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", F.col("user_id").alias("entity"), "ts", F.unix_millis("ts").alias("t")).withWatermark("ts", late)


def last_seen(stream: DataFrame) -> DataFrame:
    """Running last event and count of each entity (for update or complete mode)."""
    return stream.groupBy("entity").agg(F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"))


class Silence(StatefulProcessor):
    """One entity's state: the time of its last event, its limit, and whether the silence since then has been told; a timer at its limit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t bigint, limit bigint, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's names)
        last, limit, told = self.last.get() if self.last.exists() else (None, 0, False)
        frame = pd.concat(list(rows)).sort_values(["t", "limit_hours"])
        out = []
        for t, hours in zip(frame["t"].tolist(), frame["limit_hours"].tolist(), strict=True):
            limit = int(hours * C.HOUR_MS)
            if last is not None and t - last > limit:
                out.append((key[0], last, (t - last) / C.HOUR_MS))
            if last is None or t > last:
                last, told = t, False
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not told and last + limit > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(last + limit)
        elif not told:  # its limit is past already, so no timer would ever tell it
            out.append((key[0], last, None))
            told = True
        self.last.update((last, limit, told))
        yield _silences(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        last, limit, told = self.last.get()
        self.last.update((last, limit, True))
        yield _silences([] if told else [(key[0], last, None)])

    def close(self) -> None:
        pass


class Silences(StatefulProcessor):
    """The states of ``Silence`` of 2**GROUP_BITS neighbouring entities under one key, so that the calls to the state are shared.

    The timer is that of the earliest limit; when it goes off, all of whom the watermark has passed the limit are told.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "entity array<bigint>, last array<bigint>, due array<bigint>, told array<boolean>, timer bigint")

    def _get(self):
        held = self.held.get()
        entity, last, due, told = ([], [], [], []) if held is None else held[:4]
        return np.array(entity, np.int64), np.array(last, np.int64), np.array(due, np.int64), np.array(told, bool), None if held is None else held[4]

    def _put(self, entity, last, due, told, timer: int | None, fired: bool = False) -> None:
        """Holds the states, and sets the timer on; one that has gone off is deleted by Spark."""
        following = None if told.all() else int(due[~told].min())
        if following != timer or fired:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            if following is not None:
                self.handle.registerTimer(following)
        self.held.update((entity.tolist(), last.tolist(), due.tolist(), told.tolist(), following))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 (Spark's names)
        frames = [x[["entity", "t", "limit_hours"]] for x in rows]
        frame = pd.concat(frames).sort_values(["entity", "t", "limit_hours"])
        of, t, limit = frame["entity"].to_numpy(np.int64), frame["t"].to_numpy(np.int64), (frame["limit_hours"].to_numpy(float) * C.HOUR_MS).astype(np.int64)
        entity, last, due, told, timer = self._get()
        every = np.union1d(entity, of)
        grown = [np.zeros(len(every), x.dtype) for x in (last, due, told)]
        at = np.searchsorted(every, entity)
        for x, old in zip(grown, (last, due, told), strict=True):
            x[at] = old
        last, due, told = grown
        known = np.isin(every, entity)
        place = np.searchsorted(every, of)
        first = np.concatenate([[True], of[1:] != of[:-1]])
        before = np.concatenate([t[:1], t[:-1]])  # the entity's time before each row; of its first row the one that is held
        before = np.where(known[place], np.where(first, last[place], np.maximum(before, last[place])), before)
        ended = (t - before > limit) & (known[place] | ~first)
        out = [pd.DataFrame({"entity": of[ended], "since": before[ended], "gap_hours": (t - before)[ended] / C.HOUR_MS})]
        final = np.concatenate([of[1:] != of[:-1], [True]])
        own, newest = place[final], t[final]
        told[own] &= known[own] & (newest <= last[own])
        last[own] = np.where(known[own], np.maximum(newest, last[own]), newest)
        due[own] = last[own] + limit[final]
        late = np.zeros(len(every), bool)  # their limit is past already, so no timer would ever tell them
        late[own] = ~told[own] & (due[own] <= timerValues.getCurrentWatermarkInMs())
        out.append(pd.DataFrame({"entity": every[late], "since": last[late], "gap_hours": np.full(int(late.sum()), np.nan)}))
        self._put(every, last, due, told | late, timer)
        yield pd.concat(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        entity, last, due, told, timer = self._get()
        now = ~told & (due < timerValues.getCurrentWatermarkInMs())  # as Spark lets timers go off
        self._put(entity, last, due, told | now, timer, fired=True)
        yield pd.DataFrame({"entity": entity[now], "since": last[now], "gap_hours": np.full(int(now.sum()), np.nan)})

    def close(self) -> None:
        pass


def _silences(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["entity", "since", "gap_hours"]).astype({"gap_hours": "float64"})


#: Entities whose numbers differ in the last bits only are held under one key: enough to share its calls, few for a busy one's sake.
GROUP_BITS = 4
#: The store that states with timers need; it is a setting of the session, read when a query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def silence_alerts(stream: DataFrame, hours: float | None = None) -> DataFrame:
    """(entity, since, gap_hours): silences of more than ``hours``, or without it of more than each row's ``limit_hours``.

    A silence gives one row without gap_hours, when the watermark passes its limit, or at once if an event comes so late
    that it has; and a row with gap_hours when it ends. Rows without entity or time are left out. State per entity is four
    values, and a timer per group of entities, kept in the query's checkpoint, so a restarted query tells what it still owes.
    Sets the session's state store to one that has timers, for the query to be started.
    """
    stream.sparkSession.conf.set(*STATE_STORE)
    rows = stream.select("entity", "ts", "t", (F.lit(hours) if hours is not None else F.col("limit_hours")).cast("double").alias("limit_hours"))
    rows = rows.where("entity is not null and t is not null and limit_hours is not null")
    rows = rows.withColumn("many", F.shiftright("entity", GROUP_BITS))
    return rows.groupBy("many").transformWithStateInPandas(Silences(), "entity bigint, since bigint, gap_hours double", "Append", "eventTime")


def with_limits(stream: DataFrame, expected: DataFrame, gaps: float = C.SILENT_GAPS) -> DataFrame:
    """Adds limit_hours, so many expected gaps of the entity (entity, expected_gap_hours); rows of unknown entities go."""
    return stream.join(expected.select("entity", (F.col("expected_gap_hours") * gaps).alias("limit_hours")), "entity")


def first_reports(stream: DataFrame) -> DataFrame:
    """The entities as they first report, each once for ever: the state is one key per entity."""
    return stream.select("entity").dropDuplicates(["entity"])


def drain(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over what there is now, and returns the rows it has put out so far, which lie in the shared folder.

    Each batch has a folder of its own that a replay replaces, so a restart doubles nothing. In complete mode the last
    batch stands for all.
    """
    spark = stream.sparkSession
    at = f"{folder(spark).rstrip('/')}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/rows")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{at}/rows/*")


def poll_seconds(running: bool, retry_seconds: float | None = None) -> float:
    """How long to wait before the next look: what a stale view has to wait, else short during a run."""
    return retry_seconds if retry_seconds is not None else C.POLL_RUNNING_S if running else C.POLL_IDLE_S


def watch(stream: DataFrame, path: str, running: bool = False) -> StreamingQuery:
    """Appends a stream's rows to path again and again, at the poll's interval, until the query is stopped."""
    every = f"{int(poll_seconds(running) * 1000)} milliseconds"
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(processingTime=every).start()


def emit_once(batch: DataFrame, path: str, key: str, number: int, writer: str = "stream") -> bool:
    """For foreachBatch: commits to the table at path the rows whose key it does not have yet, each key once for ever.

    The commit carries the writer's name and the number of the batch, so a replayed batch changes nothing, and what another
    writer commits in between is looked at again before this commit can succeed. False if there was nothing left to do.
    """
    new = batch.where(F.col(key).isNotNull()).dropDuplicates([key])
    return commits.commit(batch.sparkSession, path, f"{writer}-{number}", lambda have: new if have is None else new.join(have.select(key).distinct(), key, "left_anti").select(new.columns))


def watch_pages(spark: SparkSession, targets: list[str], path: str, seconds: float = C.POLL_IDLE_S, once: bool = False, **options: str) -> StreamingQuery:
    """Fetches each target once per interval and commits the pages to the table at path, until the query is stopped.

    With ``once`` the query ends after the visit that is due, if one is. A batch is a commit of its own (``sources.commits``) named
    after its number: a replayed batch that had been committed is not even fetched again. Failed visits are rows with their
    error. The query's state lies beside the table, so a restart goes on with the intervals. Other options are the source's.
    """
    spark.dataSource.register(PageSource)
    stream = spark.readStream.format("tacet_pages").options(targets=json.dumps(targets), interval=str(seconds), **options).load()

    def write(batch: DataFrame, number: int) -> None:
        fetched = functools.cache(lambda: keep(batch))  # every look at a batch would fetch its pages again
        commits.commit(spark, path, f"pages-{number}", lambda _: fetched(), ["url", "fetched_ms"])

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state")
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{max(1, int(seconds * 1000))} milliseconds")).start()
