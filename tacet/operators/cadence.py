"""Reporting cadence: last events, coalesced events, gaps, priors, fitted rates, surprisal."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacet import config as C
from tacet.functions import maths as M
from tacet.sources.shared import keep


def last_seen(entities: DataFrame, reports: DataFrame) -> DataFrame:
    """Per entity: last_t, report_count, cold_start."""
    seen = reports.where("entity is not null").groupBy("entity").agg(F.max("t").alias("last_t"), F.count("t").alias("report_count"))
    x = entities.join(seen, F.col("id") == F.col("entity"), "left").drop("entity")
    return x.withColumn("report_count", F.coalesce("report_count", F.lit(0))).withColumn("cold_start", F.col("last_t").isNull())


def with_silence(seen: DataFrame, reports: DataFrame, now: int) -> DataFrame:
    """Adds silence_hours, from the last event or else from the start of what was observed; never negative."""
    start = reports.agg(F.min("t").alias("start"))  # over unresolved reports too
    since = F.coalesce("last_t", "start", F.lit(now))
    return seen.join(F.broadcast(start)).withColumn("silence_hours", F.greatest(F.lit(0.0), (F.lit(now) - since) / C.HOUR_MS)).drop("start")


def cohort_priors(entities: DataFrame) -> DataFrame:
    """Per cohort: members, geometric mean population, prior rate and gap."""
    e = entities.withColumn("cohort", M.cohort_key())
    x = e.groupBy("cohort").agg(F.count(F.lit(1)).alias("members"), F.first("hazard_tier").alias("tier"), F.exp(F.avg(F.when(F.col("population") > 0, F.ln("population")))).alias("geo_pop"))
    x = x.withColumn("geo_pop", F.coalesce("geo_pop", F.lit(C.REFERENCE_POPULATION)))
    return x.withColumn("prior", M.prior_rate(F.col("geo_pop"), F.col("tier"))).drop("tier")


def _runs(e: np.ndarray) -> list[int]:
    """Where a new entity begins, and the end."""
    return [0, *(np.flatnonzero(e[1:] != e[:-1]) + 1).tolist(), len(e)]


class _Orbits:
    """What a piece of one entity's events makes of the last event kept before it, whichever that was.

    Only events within ``gap`` of the piece's first can be the first one kept. From each of them the kept ones
    follow; those that meet go on as one, so every event is passed once. ``table`` gives, for first kept ones up to a
    time, the last one kept.
    """

    def __init__(self, gap: int):
        self.gap, self.limit = gap, None
        self.entry = np.zeros(0, np.int64)  # times that may be the first kept one
        self.way = np.zeros(0, np.int64)  # the orbit of each
        self.last = np.zeros(0, np.int64)  # the last kept time of each orbit

    def add(self, t: np.ndarray, follow: np.ndarray) -> None:
        """Times in order, and for each the number of the next kept one of ``t`` if it is kept (or their number)."""
        if self.limit is None:
            self.limit, self.closed = int(t[0]) + self.gap, False
        start = np.searchsorted(t, self.last + self.gap)
        if not self.closed:
            stop = int(np.searchsorted(t, self.limit))
            new = np.unique(t[: stop + 1])  # up to the first one that nothing before the piece can hold back
            new = new[~np.isin(new, self.entry[-1:])]
            self.closed = stop < len(t)
            self.way = np.concatenate([self.way, len(self.last) + np.arange(len(new))])
            self.entry, self.last = np.concatenate([self.entry, new]), np.concatenate([self.last, new])
            start = np.concatenate([start, np.searchsorted(t, new)])
        seen, follow, last = {}, follow.tolist(), self.last.tolist()
        for o, i in enumerate(start.tolist()):
            at = None
            while i < len(follow) and i not in seen:
                seen[i], at, i = o, i, follow[i]
            if i < len(follow):
                last[o] = last[seen[i]]  # from here on it is the earlier one's way
            elif at is not None:
                last[o] = int(t[at])
        self.last, back = np.unique(np.array(last, np.int64), return_inverse=True)
        self.way = back[self.way]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """(up to, last): for a first kept time of at most ``up to`` (and over the one before) the last kept time."""
        last = self.last[self.way]
        ends = np.flatnonzero(np.append(last[1:] != last[:-1], True)) if len(last) else np.zeros(0, np.int64)
        return self.entry[ends], last[ends]


def _kept(t: np.ndarray, follow: list[int], last: int | None, gap: int) -> list[int]:
    """Numbers of the kept ones among the times of one entity, after the last kept one before them."""
    i, out = 0 if last is None else int(np.searchsorted(t, last + gap)), []
    while i < len(follow):
        out.append(i)
        i = follow[i]
    return out


def _block(gap: int, fields: list[str]):
    """Of a block of (entity, t) in order: kept events of entities that begin in it; open events of its first one, and what they make of an earlier kept one."""

    def work(batches):
        block = TaskContext.get().partitionId()
        head = orbits = entity = last = None

        def rows(kind, e, t, other):
            n = len(t)
            return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array([block] * n, pa.int32()), e, pa.array(t, pa.int64()), pa.array(other, pa.int64())], names=fields)

        for batch in batches:
            column, t = batch.column(0), batch.column(1).to_numpy()
            if not len(t):
                continue
            e = column.to_numpy(zero_copy_only=False)
            cuts = _runs(e)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = t[a:b]
                follow = np.searchsorted(own, own + gap)
                if head is None:
                    head, orbits = column[a], _Orbits(gap)
                if orbits is not None and column[a] == head:
                    orbits.add(own, follow)
                    yield rows("open", column.slice(a, b - a), own, [None] * (b - a))
                    continue
                if entity is None or column[a] != entity:
                    entity, last = column[a], None
                kept = _kept(own, follow.tolist(), last, gap)
                if kept:
                    times = own[kept]
                    yield rows("kept", column.slice(a, b - a).take(pa.array(kept)), times, [last, *times[:-1].tolist()])
                    last = int(times[-1])
        if head is not None:
            upto, after = orbits.table()
            yield rows("way", pa.array([head.as_py()] * len(upto), head.type), upto, after)
            if entity is not None:  # the block's last entity, which may go on in the next one
                yield rows("end", pa.array([entity.as_py()], entity.type), [last], [None])

    return work


def _compose(gap: int):
    """The last event kept before each block of one entity, by going through what the blocks before make of it."""

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("block", "ascending"), ("t", "ascending")])
        kind, block, t, other = (table.column(c).to_pylist() for c in ("kind", "block", "t", "other"))
        blocks, before, last, i = [], [], None, 0
        while i < len(kind):
            j = i
            while j < len(kind) and block[j] == block[i] and kind[j] == "way":
                j += 1
            if j == i:  # the end of the block in which the entity begins
                last, i = t[i], i + 1
                continue
            blocks.append(block[i])
            before.append(last)
            k = bisect.bisect_left(t, last + gap, i, j) if last is not None else i
            last, i = other[k] if k < j else last, j
        return pa.table({"block": pa.array(blocks, pa.int32()), "last": pa.array(before, pa.int64())})

    return work


def _reopened(gap: int):
    """Kept events of open pieces (block, entity, t, last), each in order behind each other."""

    def work(batches):
        now = last = None
        for batch in batches:
            block, t = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            if not len(t):
                continue
            before = batch.column(3)
            cuts = _runs(block)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if block[a] != now:
                    now, last = block[a], before[a].as_py()
                own = t[a:b]
                kept = _kept(own, np.searchsorted(own, own + gap).tolist(), last, gap)
                if kept:
                    times = own[kept]
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a).take(pa.array(kept)), pa.array(times), pa.array([last, *times[:-1].tolist()], pa.int64())], names=["entity", "t", "previous"])
                    last = int(times[-1])

    return work


def settled_blocks(times: DataFrame, gap: int, parts: int | None = None) -> DataFrame:
    """(kind, block, entity, t, other) of range-partitioned (entity, t), written: the first pass of the segmented greedy scan.

    kept: an event that stays, with the kept one before it. open: an event of the entity that its block begins with.
    way: for first kept times of that entity up to t, the last one kept. end: the last kept event of the block's last entity.
    """
    x = times.select("entity", F.col("t").cast("bigint").alias("t")).where("entity is not null and t is not null")
    n = parts or int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shape = T.StructType([*T.StructType.fromDDL("kind string, block int"), x.schema["entity"], *T.StructType.fromDDL("t bigint, other bigint")])
    return keep(x.repartitionByRange(n, "entity", "t").sortWithinPartitions("entity", "t").mapInArrow(_block(gap, shape.names), shape))


def coalesced(times: DataFrame, hours: float = C.SEPARATION_H, parts: int | None = None) -> DataFrame:
    """Of (entity, t) the greedily kept events (entity, t, previous): each at least ``hours`` after the last kept one.

    A segmented scan, so that a busy entity spreads over tasks. Events are dealt into blocks by entity and time. A
    block settles all its entities but the first, which may have begun before; of that one it finds which last kept event
    follows from each event that may be kept first. A task per entity goes through these functions of its blocks, of at most
    as many rows a block as the entity has events in one gap, and then every block settles its first entity too.
    """
    gap = int(hours * C.HOUR_MS)
    first = settled_blocks(times, gap, parts)
    kept = first.where("kind = 'kept'").select("entity", "t", F.col("other").alias("previous"))
    ways = first.where("kind in ('way', 'end')").select("kind", "block", "entity", "t", "other")
    last = ways.groupBy("entity").applyInArrow(_compose(gap), "block int, last bigint")
    # a row per block at most
    open_ = first.where("kind = 'open'").select("block", "entity", "t").join(F.broadcast(last), "block").where(F.col("last").isNull() | (F.col("t") >= F.col("last") + gap))
    width = parts or int(times.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    late = open_.select("block", "entity", "t", "last").repartitionById(width, "block").sortWithinPartitions("block", "t").mapInArrow(_reopened(gap), kept.schema)
    return kept.unionByName(late)


def gaps(events: DataFrame) -> DataFrame:
    """(entity, t, gap_hours) between consecutive events, only positive ones; coalesced events know their previous one."""
    before = F.col("previous") if "previous" in events.columns else F.lag("t").over(W.partitionBy("entity").orderBy("t"))
    return events.withColumn("gap_hours", (F.col("t") - before) / C.HOUR_MS).where("gap_hours > 0").drop("previous")


def mle_rates(gap_rows: DataFrame) -> DataFrame:
    """Per entity the exponential maximum-likelihood rate; gaps have a floor, negative and missing ones are left out."""
    g = F.when(F.col("gap_hours") >= 0, F.col("gap_hours"))
    return gap_rows.groupBy("entity").agg((F.count(g) / F.sum(F.when(g.isNotNull(), F.greatest(g, F.lit(C.GAP_FLOOR_H))))).alias("rate"), F.count(g).alias("n"))


def event_times(reports: DataFrame) -> DataFrame:
    """(entity, t): the earliest time of each distinct event of an entity; reports with a cluster share its event."""
    key = F.concat(F.lit("report:"), F.col("id").cast("string"))
    if "cluster_id" in reports.columns:
        key = F.coalesce("cluster_id", key)
    return reports.where("entity is not null").groupBy("entity", key.alias("event")).agg(F.min("t").alias("t")).select("entity", "t")


def rates(entities: DataFrame, reports: DataFrame) -> DataFrame:
    """Per cohort: prior, shrunk rate, gap counts and the basis of the fit."""
    prior = cohort_priors(entities)
    g = gaps(coalesced(event_times(reports)))
    cohort = entities.select(F.col("id").alias("entity"), M.cohort_key().alias("cohort"))
    u = g.join(cohort, "entity").join(prior.select("cohort", "prior"), "cohort").withColumn("u", F.col("prior") * F.col("gap_hours"))
    per = u.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("u").alias("u"))
    whole = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.coalesce(F.sum("u"), F.lit(0.0)).alias("all_u"))
    x = prior.join(per, "cohort", "left").join(F.broadcast(whole))  # one row
    a = float(C.PRIOR_STRENGTH)
    n, s = F.coalesce("n", F.lit(0)), F.coalesce("u", F.lit(0.0))
    k_all = (a + F.col("all_n")) / (a + F.col("all_u"))
    x = x.withColumn("k_global", k_all).withColumn("k", (a + n) / (a / F.col("k_global") + s)).withColumn("rate", M.clamp_rate(F.col("k") * F.col("prior")))
    basis = F.when(F.col("all_n") == 0, "prior").when(n >= C.MIN_COHORT_GAPS, "cohort").otherwise("global")
    sample = F.when(F.col("all_n") == 0, 0).when(n >= C.MIN_COHORT_GAPS, n).otherwise(F.col("all_n"))
    return x.select("cohort", "members", "geo_pop", "prior", n.alias("gap_count"), "k_global", "k", "rate", basis.alias("fit_basis"), sample.alias("sample_gaps"))


def surprisal(entities: DataFrame, reports: DataFrame, now: int) -> DataFrame:
    """Per entity: silence, cohort rate and surprisal (rate times hours of silence)."""
    x = with_silence(last_seen(entities, reports), reports, now).withColumn("cohort", M.cohort_key())
    x = x.join(rates(entities, reports).select("cohort", "rate", "fit_basis", "sample_gaps"), "cohort", "left")
    return x.withColumn("surprisal", F.greatest(F.lit(0.0), F.col("rate") * F.col("silence_hours")))
