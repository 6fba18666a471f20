"""A Spark data source of fetched pages: one partition per target, failures as rows.

    spark.dataSource.register(PageSource)
    spark.read.format("tacet_pages").option("targets", json.dumps(urls)).load()
    spark.readStream.format("tacet_pages").option("targets", json.dumps(urls)).option("interval", 60).load()

A stream fetches each target once per interval (in seconds), however often it is triggered. With the options endpoint, zone and token, pages are fetched by POST through an unlocking service.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "url string, html string, status string, error string, attempts int, fetched_ms bigint"
#: Waits before the second and third attempt, seconds to wait for a page, and the least length of a usable one.
WAITS, TIMEOUT, LEAST = (0.5, 1.5), 20.0, 40
#: Seconds between two visits of a target by a stream that names no interval.
INTERVAL = 60.0


def with_retry(call: Callable[[], str], waits: tuple[float, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None, int]:
    """(result, error, attempts): calls again after each wait until there is a result."""
    error = None
    for n, wait in enumerate((*waits, None), 1):
        try:
            return call(), None, n
        except Exception as e:  # any failure of a source is a row, not the end of a run
            error = f"{type(e).__name__}: {e}"[:300]
        if wait is not None:
            sleep(wait)
    return None, error, len(waits) + 1


def get(url: str, timeout: float = TIMEOUT, endpoint: str | None = None, zone: str | None = None, token: str | None = None) -> str:
    """The page at url; through an unlocking service if there is an endpoint, which is posted the target and a zone."""
    request: str | urllib.request.Request = url
    if endpoint:
        body = json.dumps({"zone": zone, "url": url, "format": "raw"}).encode()
        request = urllib.request.Request(endpoint, body, {"Content-Type": "application/json", "Authorization": f"Bearer {token or ''}"}, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as r:
        text = r.read().decode("utf-8", "replace")
    if len(text) < LEAST:
        raise ValueError(f"only {len(text)} characters")
    return text


class Target(InputPartition):
    def __init__(self, url: str):
        self.url = url


class Fetcher:
    """What batches and streams share: targets and how to fetch one of them."""

    def __init__(self, options: dict):
        self.targets = json.loads(options.get("targets", "[]"))
        self.timeout = float(options.get("timeout", TIMEOUT))
        self.service = {k: options.get(k) for k in ("endpoint", "zone", "token")}
        self.waits = tuple(json.loads(options.get("waits", json.dumps(WAITS))))

    def read(self, partition: Target) -> Iterator[tuple]:
        html, error, n = with_retry(lambda: get(partition.url, self.timeout, **self.service), self.waits)
        yield partition.url, html, "live" if error is None else "degraded", error, n, int(time.time() * 1000)


class PageReader(Fetcher, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [Target(u) for u in self.targets]


class PageStream(Fetcher, DataSourceStreamReader):
    """Offsets are numbers of intervals since the epoch, so they do not depend on the process and hold over restarts.

    A batch visits each target once, also when several intervals have gone by since the last one: pages as they were
    then cannot be fetched any more. A clock that goes back gives nothing until it has caught up. A replayed batch
    fetches again; what it writes has to go by the number of the batch (``streaming.cadence.watch_pages`` does).
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.interval = float(options.get("interval", INTERVAL))
        if self.interval <= 0:
            raise ValueError("interval has to be above 0 seconds")
        self.reached = -1

    def initialOffset(self) -> dict:  # noqa: N802 (Spark's names)
        return {"interval": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        self.reached = max(self.reached, int(time.time() // self.interval))
        return {"interval": self.reached}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.reached = max(self.reached, start["interval"], end["interval"])
        return [Target(u) for u in self.targets] if end["interval"] > start["interval"] else []


class PageSource(DataSource):
    """The data source tacet_pages."""

    @classmethod
    def name(cls) -> str:
        return "tacet_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStream:  # noqa: N802
        return PageStream(self.options)
