"""The full ranking of entities, and what is read from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacet import config as C
from tacet.functions import maths as M
from tacet.operators import cadence, ledger, spatial
from tacet.sources.shared import numbered


def qualifies(silence: str = "silence_hours", nats: str = "surprisal", own: str = "own_z") -> Column:
    """The escalation gate, on rounded values; missing or infinite ones never pass."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in (silence, nats, own)]
    return F.coalesce(finite[0] & finite[1] & finite[2] & (F.col(silence) >= C.GATE_HOURS) & (F.col(nats) >= C.GATE_NATS) & (F.col(own) > 0), F.lit(False))


def corroboration(entities: DataFrame, reports: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct clusters of each entity, else its reports. clusters: cluster_id, entity, report_ids.

    A cluster without an entity takes that of its first member that has one.
    """
    member = clusters.select("cluster_id", "entity", F.posexplode("report_ids").alias("pos", "id"))
    found = member.join(reports.select("id", F.col("entity").alias("own")), "id", "left").groupBy("cluster_id").agg(F.first("entity").alias("entity"), F.min_by("own", F.when(F.col("own").isNotNull(), F.col("pos"))).alias("first"))
    per = found.withColumn("entity", F.coalesce("entity", "first")).where("entity is not null").groupBy("entity").agg(F.count_distinct("cluster_id").alias("clusters"))
    raw = reports.where("entity is not null").groupBy("entity").agg(F.count(F.lit(1)).alias("reports"))
    x = entities.select(F.col("id").alias("entity")).join(per, "entity", "left").join(raw, "entity", "left")
    return x.select("entity", F.coalesce("clusters", "reports", F.lit(0)).alias("corroboration_count"))


def rank(entities: DataFrame, reports: DataFrame, edges: DataFrame, now: int = C.NOW_MS, clusters: DataFrame | None = None, confirming_only: bool = False) -> DataFrame:
    """One row per entity: silence, rate, surprisal, spatial scores, anomaly type, gate and rank.

    confirming_only counts just the reports whose category confirms contact as the end of silence
    (needs a column category); by default any resolved report does.
    """
    if clusters is not None:
        owner = clusters.select("cluster_id", F.explode("report_ids").alias("id")).groupBy("id").agg(F.max("cluster_id").alias("cluster_id"))
        reports = reports.drop("cluster_id").join(owner, "id", "left")
    heard = reports.where("category = 'corroboration-candidate'") if confirming_only else reports
    s = cadence.surprisal(entities, heard, now)
    g = spatial.anomalies(spatial.gi_star(s.select("id", F.col("surprisal").alias("x")), edges)).drop("x")
    x = s.join(g, "id")
    if clusters is not None:
        c = corroboration(entities, reports, clusters).withColumnRenamed("entity", "id")
        x = x.join(c, "id", "left")
    else:
        x = x.withColumn("corroboration_count", F.col("report_count"))
    out = x.select(
        "id", "name", "district", "population", "hazard_tier", F.col("last_t").alias("last_report_ms"),
        M.half_up("silence_hours").alias("silence_hours"), M.half_up(1 / F.col("rate")).alias("expected_gap_hours"), M.half_up("surprisal").alias("surprisal"),
        M.half_up("gi").alias("gi_z"), "is_local_anomaly", F.when(F.col("cold_start"), "cohort-cold-start").otherwise("reports").alias("coverage_basis"),
        "corroboration_count", "cohort", M.half_up("rate", 6).alias("rate_per_hour"), "fit_basis", "sample_gaps", "report_count",
        M.half_up("own_z").alias("own_z"), M.half_up("neighbor_z").alias("neighbor_z"), M.half_up("neighbor_mean").alias("neighbor_mean_surprisal"), "neighbor_count",
        "is_regional_outage", "is_solo_anomaly", "anomaly_type",
    )
    out = out.withColumn("is_escalation_candidate", qualifies())
    return numbered(out, F.desc("gi_z"), F.desc("surprisal"), F.desc("population"), "id", name="rank")


def escalations(ranked: DataFrame, top: int = C.TOP_ESCALATIONS) -> DataFrame:
    """The first candidates by rank, with a title for whoever reviews them."""
    x = ranked.where("is_escalation_candidate").orderBy("rank").limit(top)
    hours, gap = ledger.number(F.col("silence_hours")), ledger.number(F.col("expected_gap_hours"))
    return x.withColumn("title", F.concat(F.lit("Anomalous silence: "), "name", F.lit(" ("), "district", F.lit(") - "), hours, F.lit("h with no confirming report, expected roughly every "), gap, F.lit("h")))


def label_tier(rank: Column) -> Column:
    """Which labels a map shows first: 1 up to rank 3, 2 up to rank 10, else 3 (rows without a rank too)."""
    r = F.coalesce(rank, F.lit(99))
    return F.when(r <= 3, 1).when(r <= 10, 2).otherwise(3)


def label_shown(tier: Column, zoom: float) -> Column:
    """Whether the labels of a tier are wanted at a zoom."""
    return (tier == 1) | ((tier == 2) & F.lit(zoom >= 8.0)) | ((tier == 3) & F.lit(zoom >= 9.5))


def map_positions(rows: DataFrame, width: float, height: float) -> DataFrame:
    """rows (id, lat, lon) with x and y on a plot of this size: all places fit, with a tenth around them (0.03 degrees at least) and a pad of 34.

    Rows without finite coordinates are left out.
    """
    fine = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in ("lat", "lon")]
    pts = rows.where(fine[0] & fine[1])
    pad = {c: F.greatest(F.lit(0.03), (F.max(c) - F.min(c)) * 0.1) for c in ("lat", "lon")}
    extent = pts.agg((F.min("lon") - pad["lon"]).alias("west"), (F.max("lon") + pad["lon"]).alias("east"), (F.min("lat") - pad["lat"]).alias("south"), (F.max("lat") + pad["lat"]).alias("north"))
    squeeze = F.cos(F.radians((F.col("south") + F.col("north")) / 2))
    x = pts.join(F.broadcast(extent)).withColumn("k", squeeze)  # one row
    x = x.withColumns({"w": (F.col("east") - F.col("west")) * F.col("k"), "h": F.col("north") - F.col("south")})
    x = x.withColumn("s", F.least((width - 68) / F.col("w"), (height - 68) / F.col("h")))
    return x.select("id", ((width - F.col("w") * F.col("s")) / 2 + (F.col("lon") - F.col("west")) * F.col("k") * F.col("s")).alias("x"), ((height - F.col("h") * F.col("s")) / 2 + (F.col("north") - F.col("lat")) * F.col("s")).alias("y"))


def score_breakdown(ranked: DataFrame) -> DataFrame:
    """How each score came about, with the chance of a silence this long under the fitted rate."""
    rate = 1 / F.col("expected_gap_hours")
    return ranked.select("id", "cohort", "silence_hours", "expected_gap_hours", M.half_up(rate, 5).alias("rate"), "surprisal", M.half_up(F.exp(-rate * F.col("silence_hours")), 6).alias("survival_probability"))


def listing(ranked: DataFrame, mode: str = "all", query: str = "", sort: str = "rank", descending: bool = False) -> DataFrame:
    """The filtered and sorted list: mode is all, anomalous or no-data; query is part of a name or district."""
    x = ranked
    if mode == "anomalous":
        x = x.where("anomaly_type <> 'none'")
    elif mode == "no-data":
        x = x.where("coverage_basis = 'cohort-cold-start'")
    if query:
        x = x.where(F.contains(F.lower("name"), F.lit(query.lower())) | F.contains(F.lower("district"), F.lit(query.lower())))
    key = F.col(sort)
    if dict(ranked.dtypes)[sort] != "string":
        key = F.coalesce(key.cast("double"), F.lit(float("-inf")))
    return x.orderBy(key.desc() if descending else key.asc(), "id")
