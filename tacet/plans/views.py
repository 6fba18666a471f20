"""Logical tables over the test tables, each with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacet import config as C
from tacet.sources.shared import spread

MUTED = (7, 20, 21, 22, 23, 24, 35, 36, 38, 39)
COLD = 45
TEN_DAYS, FOUR_DAYS = 10 * 24 * C.HOUR_MS, 4 * 24 * C.HOUR_MS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; texts and pages, where most work is on single rows, are spread over all cores."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in ("documents", "pages") else scan


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t, the epoch milliseconds of ts."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("t", F.unix_millis(F.col("ts").cast("timestamp")))


def source_type(kind: str = "event_type"):
    k = F.col(kind)
    return F.when(k == "error", "official").when(k.isin("click", "view"), "news").otherwise("social")


def reports(spark: SparkSession, sf_dir: str, now: int = C.NOW_MS) -> DataFrame:
    """(id, entity, t, source_type): ten days, with silence put in by muting fixed keys."""
    m = F.col("user_id") % 50
    e = events(spark, sf_dir).where((F.col("t") >= now - TEN_DAYS) & (m != COLD) & ~((F.col("t") >= now - FOUR_DAYS) & m.isin(*MUTED)))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), "t", source_type().alias("source_type"))


def reports_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity, t, source_type) of all events; the entities beyond the last user are silent."""
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("entity"), "t", source_type().alias("source_type"))


def entities(spark: SparkSession, sf_dir: str, stretch: float = 1.0) -> DataFrame:
    """(id, name, district, hazard_tier, population) up to the last user, or ``stretch`` times that."""
    last = table(spark, sf_dir, "events").agg((F.max("user_id") * stretch).alias("last"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(last), F.col("c_custkey") <= F.col("last"))  # one row
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("district"), (1 + F.col("c_nationkey") % 3).alias("hazard_tier"), F.floor(F.greatest("c_acctbal", F.lit(0.0)) * 4).cast("bigint").alias("population"))


def chain(nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) from each id to the ids next to it, where both exist."""
    ids = nodes.select("id")
    both = ids.select(F.col("id").alias("src"), F.explode(F.array(F.col("id") - 1, F.col("id") + 1)).alias("dst"))
    return both.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def event_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, entity, report_ids): made-up clusters of reports; every third has no entity of its own."""
    r = reports(spark, sf_dir).withColumn("k", F.col("id") % 997)
    c = r.groupBy("k").agg(F.array_sort(F.collect_list("id")).alias("report_ids"), F.max("entity").alias("top"))
    return c.select(F.concat(F.lit("cl-"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("cluster_id"), F.when(F.col("k") % 3 != 0, F.col("top")).alias("entity"), "report_ids")


def doc_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, entity, t, source_type, title, text) over documents, with made-up entities and times."""
    d = table(spark, sf_dir, "documents")
    entity = F.when(F.col("doc_id") % 50 != 7, (F.col("doc_id") * F.col("doc_id") + F.floor(F.col("doc_id") / 3)) % 60)
    return d.select(F.col("doc_id").alias("id"), entity.alias("entity"), (F.lit(1_704_067_200_000) + F.col("doc_id") * 2 * C.HOUR_MS).alias("t"), F.col("lang").alias("source_type"), F.lit("").alias("title"), "text")


def doc_edges(spark: SparkSession) -> DataFrame:
    return chain(spark.range(60))


_MUTED = ", ".join(map(str, MUTED))
SQL_SOURCE = "CASE WHEN event_type = 'error' THEN 'official' WHEN event_type IN ('click', 'view') THEN 'news' ELSE 'social' END"
SQL_REPORTS = f"""reports AS (SELECT event_id AS id, user_id AS entity, (epoch_us(ts) // 1000) AS t, {SQL_SOURCE} AS source_type FROM events
 WHERE (epoch_us(ts) // 1000) >= {C.NOW_MS - TEN_DAYS} AND user_id % 50 <> {COLD} AND NOT ((epoch_us(ts) // 1000) >= {C.NOW_MS - FOUR_DAYS} AND user_id % 50 IN ({_MUTED})))"""
SQL_REPORTS_BLOCK = f"reports AS (SELECT event_id AS id, user_id AS entity, (epoch_us(ts) // 1000) AS t, {SQL_SOURCE} AS source_type FROM events)"


def sql_entities(stretch: float = 1.0) -> str:
    return f"""entities AS (SELECT c_custkey AS id, c_name AS name, n_name AS district, 1 + c_nationkey % 3 AS hazard_tier, CAST(floor(greatest(c_acctbal, 0) * 4) AS BIGINT) AS population
 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey <= (SELECT max(user_id) * {stretch} FROM events))"""


SQL_CLUSTERS = """clusters AS (SELECT 'cl-' || lpad(CAST(id % 997 AS VARCHAR), 3, '0') AS cluster_id, CASE WHEN id % 997 % 3 <> 0 THEN max(entity) END AS entity, list(id ORDER BY id) AS report_ids FROM reports GROUP BY id % 997)"""
SQL_EDGES = "edges AS (SELECT a.id AS src, b.id AS dst FROM entities a JOIN entities b ON b.id = a.id - 1 OR b.id = a.id + 1)"
SQL_DOC_REPORTS = f"doc_reports AS (SELECT doc_id AS id, CASE WHEN doc_id % 50 <> 7 THEN (doc_id * doc_id + doc_id // 3) % 60 END AS entity, 1704067200000 + doc_id * 2 * {C.HOUR_MS} AS t, lang AS source_type, text FROM documents)"
