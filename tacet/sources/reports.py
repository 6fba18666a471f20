"""Sources of reports: pages, search results, listings, seeds, and their health."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacet import config as C
from tacet.functions import web
from tacet.operators.triage import relevant, relevant_link
from tacet.sources.shared import keep

REPORT = "id string, source_type string, source_name string, url string, title string, text string, published_ms bigint, fetched_ms bigint, time_imputed boolean"
SERP_ITEM = "array<struct<title:string,name:string,description:string,snippet:string,summary:string,source:string,date:string,published:string,time:string,link:string,url:string,href:string>>"
SERP_LISTS = ("organic", "news", "organic_results", "top_stories")
SERP = ", ".join(f"{k} {SERP_ITEM}" for k in SERP_LISTS)


@dataclass(frozen=True)
class Connector:
    """A configured source: kind is serp or listing."""

    name: str
    source_type: str
    kind: str
    targets: tuple[str, ...] = ()
    link_pattern: str | None = None


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file (one document), or an empty table of the schema where there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def adjacency(rows: DataFrame, column: str = "json") -> DataFrame:
    """Edges (src, dst) of a JSON object of neighbour lists."""
    m = F.from_json(column, T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    return rows.select(F.explode(m).alias("src", "near")).select("src", F.explode("near").alias("dst")).distinct()


def build(url: Column, title: Column, text: Column, source_type: Column, source_name: Column, published_ms: Column, fetched_ms: Column) -> list[Column]:
    """The columns of a report; a missing time of publication is that of the fetch, and marked."""
    return [
        web.report_id(url).alias("id"), source_type.alias("source_type"), source_name.alias("source_name"), url.alias("url"), F.substring(F.coalesce(title, F.lit("")), 1, C.MAX_TITLE).alias("title"),
        F.substring(F.coalesce(text, F.lit("")), 1, C.MAX_TEXT).alias("text"), F.coalesce(published_ms, fetched_ms).alias("published_ms"), fetched_ms.alias("fetched_ms"), published_ms.isNull().alias("time_imputed"),
    ]


def from_pages(pages: DataFrame, source_type: str, now_ms: int) -> DataFrame:
    """Reports of fetched pages (url, html)."""
    h = F.col("html")
    return pages.select(*build(F.col("url"), web.title(h), web.body(h), F.lit(source_type), web.publisher(F.col("url")), web.published(h, now_ms), F.lit(now_ms)))


def from_serp(payloads: DataFrame, now_ms: int, source_type: str = "news", needles: list[str] | None = None) -> DataFrame:
    """Relevant reports of search results: payloads (target, body). Payloads that do not parse give none.

    needles: lower-case place names; None keeps irrelevant results too.
    """
    x = payloads.select("target", F.from_json("body", SERP).alias("p"))
    every = F.concat(*[F.coalesce(F.col(f"p.{k}"), F.array().cast(SERP_ITEM)) for k in SERP_LISTS])
    x = x.select("target", F.explode(every).alias("i"))
    url = web.absolute(F.coalesce("i.link", "i.url", "i.href"), F.col("target"))
    x = x.select(*build(url, F.coalesce("i.title", "i.name"), F.coalesce("i.description", "i.snippet", "i.summary"), F.lit(source_type), F.coalesce(F.col("i.source"), web.publisher(url)), web.loose_date(F.coalesce("i.date", "i.published", "i.time"), now_ms), F.lit(now_ms)))
    x = x.where("url is not null and title <> ''")
    return x if needles is None else x.where(relevant(F.col("title"), F.col("text"), needles))


def listing_links(pages: DataFrame, most: int = C.MAX_ARTICLES, pattern: str | None = None, needles: list[str] | None = None) -> DataFrame:
    """(target, url, label): the first links of each listing page that fit the pattern and, with needles, are relevant."""
    x = pages.select(F.col("url").alias("target"), F.explode(web.links(F.col("html"), F.col("url"))).alias("l")).select("target", "l.*")
    if pattern:
        x = x.where(F.rlike("url", F.lit(pattern)))
    if needles is not None:
        x = x.where(relevant_link(F.col("label"), F.col("url"), needles))
    x = x.groupBy("target", "url").agg(F.min("pos").alias("pos"), F.min_by("label", "pos").alias("label"))
    return x.withColumn("n", F.row_number().over(W.partitionBy("target").orderBy("pos"))).where(F.col("n") <= most).select("target", "url", "label")


def normalize(raw: DataFrame, now_ms: int) -> DataFrame:
    """Reports of loose rows: rows without url or title go, unknown source types are news."""
    x = raw.withColumns({c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("url", "title")}).where("url <> '' and title <> ''")
    kind = F.when(F.col("source_type").isin("news", "social", "official"), F.col("source_type")).otherwise("news")
    fetched = F.coalesce("fetched_ms", F.lit(now_ms))
    return x.select(F.coalesce(F.nullif(F.col("id"), F.lit("")), web.report_id(F.col("url"))).alias("id"), kind.alias("source_type"), F.coalesce(F.nullif(F.col("source_name"), F.lit("")), web.publisher(F.col("url"))).alias("source_name"), "url", F.substring("title", 1, C.MAX_TITLE).alias("title"), F.substring(F.coalesce("text", F.lit("")), 1, C.MAX_TEXT).alias("text"), F.coalesce("published_ms", fetched).alias("published_ms"), fetched.alias("fetched_ms"))


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def reanchor(reports: DataFrame, now_ms: int, absolute: bool = False) -> DataFrame:
    """Shifts all times so that the latest fetch was five minutes ago; shifts under a minute are not made."""
    if absolute:
        return reports
    shift = reports.agg((F.lit(now_ms - 300_000) - F.max("fetched_ms")).alias("s")).select(F.when(F.abs("s") >= 60_000, F.col("s")).otherwise(0).alias("s"))
    x = reports.join(F.broadcast(shift))  # one row
    return x.withColumns({c: F.col(c) + F.coalesce("s", F.lit(0)) for c in ("published_ms", "fetched_ms")}).drop("s")


def register(reports: DataFrame, at_ms: int) -> DataFrame:
    """A log row (name, source_type, status, at) for each publisher of a seed, so that sources are known without a fetch."""
    return reports.groupBy(F.col("source_name").alias("name")).agg(F.min("source_type").alias("source_type")).select("name", "source_type", F.lit("live").alias("status"), F.lit(at_ms).alias("at"))


def from_listing(links: DataFrame, pages: DataFrame, source_type: str, needles: list[str], now_ms: int) -> DataFrame:
    """The second hop: relevant reports of the fetched pages (url, html, error) of links (url, label); a page without a title takes the label."""
    h = F.col("html")
    x = links.select("url", "label").dropDuplicates(["url"]).join(pages.where("error is null").select("url", "html"), "url")
    name = F.coalesce(F.nullif(web.title(h), F.lit("")), F.col("label"))
    return x.select(*build(F.col("url"), name, web.body(h), F.lit(source_type), web.publisher(F.col("url")), web.published(h, now_ms), F.lit(now_ms))).where(relevant(F.col("title"), F.col("text"), needles))


def run_connector(c: Connector, fetch: Callable[[DataFrame], DataFrame], spark: SparkSession, needles: list[str], now_ms: int) -> tuple[DataFrame, DataFrame]:
    """(reports, errors (url, error)) of a connector. fetch: rows of url -> pages (url, html, error), each retried there.

    A search connector parses what its targets return; a listing connector follows the first relevant links of each.
    """
    first = keep(fetch(spark.createDataFrame([(t,) for t in c.targets], "url string")))
    errors = first.where("error is not null").select("url", "error")
    good = first.where("error is null")
    if c.kind == "serp":
        return from_serp(good.select(F.col("url").alias("target"), F.col("html").alias("body")), now_ms, c.source_type, needles), errors
    links = keep(listing_links(good.select("url", "html"), C.MAX_ARTICLES, c.link_pattern, needles))
    pages = keep(fetch(links.select("url").distinct()))
    return from_listing(links, pages, c.source_type, needles, now_ms), errors.unionByName(pages.where("error is not null").select("url", "error"))


def run_connectors(connectors: list[Connector], fetch: Callable[[DataFrame], DataFrame], spark: SparkSession, needles: list[str], now_ms: int, seed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reports, log (name, source_type, status, at), incidents (at, kind, message)): every connector for itself, then the seed if none gives anything.

    A connector that raises is down, one that gives nothing is degraded; neither ends the run. A
    failed article is an incident and the rest of its listing goes on.
    """
    parts, log, said = {}, [], []
    for c in connectors:
        try:
            found, errors = run_connector(c, fetch, spark, needles, now_ms)
            found = keep(found)
            status = "live" if found.limit(1).count() else "degraded"
            said += [(now_ms, "degraded-source", f"{c.name}: {r['url']} failed: {r['error']}") for r in errors.collect()]  # as many as targets and articles
            if status == "degraded":
                said.append((now_ms, "degraded-source", f"{c.name} returned no usable items"))
            parts[c.name] = found
        except Exception as e:  # a dead source lessens coverage, no more
            status = "down"
            said.append((now_ms, "degraded-source", f"{c.name} failed: {type(e).__name__}: {e}"[:300]))
        log.append((c.name, c.source_type, status, now_ms))
    shape = "name string, source_type string, status string, at bigint"
    if not any(s == "live" for _, _, s, _ in log) and seed is not None:
        said.append((now_ms, "degraded-source", "Every live connector failed - falling back to the offline corpus"))
        return first_of_each(seed, "id", "published_ms"), register(seed, now_ms), spark.createDataFrame(said, "at bigint, kind string, message string")
    none = spark.createDataFrame([], REPORT)
    return ingest(parts or {"none": none}), spark.createDataFrame(log, shape), spark.createDataFrame(said, "at bigint, kind string, message string")


def ingest(parts: dict[str, DataFrame], seed: DataFrame | None = None) -> DataFrame:
    """The union of the connectors' reports without repeats; the seed where they give none."""
    rows = None
    for name, part in parts.items():
        part = part.withColumn("connector", F.lit(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    if rows is None or (seed is not None and rows.limit(1).count() == 0):
        rows = seed
    return first_of_each(rows, "id", "published_ms")


def health(log: DataFrame) -> DataFrame:
    """The latest status of each source of a log (name, source_type, status, at)."""
    last = log.groupBy("name").agg(F.max_by(F.struct("source_type", "status"), F.struct("at", "status")).alias("s"), F.max("at").alias("last_at"))
    return last.select("name", "s.source_type", "s.status", "last_at")


def health_summary(current: DataFrame) -> DataFrame:
    return current.agg(F.count_if(F.col("status").isin("live", "ok")).alias("healthy"), F.count(F.lit(1)).alias("total"))
