"""Local spatial statistics on a graph: Getis-Ord Gi* with row-standardised weights, self included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacet import config as C


def weights(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, w): each known neighbour and the node itself weigh 1 / m."""
    own = ids.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    known = edges.select("src", "dst").join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    both = known.select("src", "dst").unionByName(own).distinct()
    m = both.groupBy("src").agg(F.count(F.lit(1)).alias("m"))
    return both.join(m, "src").select("src", "dst", (1 / F.col("m")).alias("w"))


def gi_star(values: DataFrame, edges: DataFrame) -> DataFrame:
    """values (id, x) with gi, own_z, neighbor_z, neighbor_mean, neighbor_count."""
    ids = values.select("id")
    whole = values.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col("x") * F.col("x")) - F.avg("x") * F.avg("x"))).alias("sd"))
    near = edges.where("src <> dst").select("src", "dst").distinct().join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    near = near.join(values.select(F.col("id").alias("dst"), "x"), "dst").groupBy("src").agg(F.sum("x").alias("near_sum"), F.count(F.lit(1)).alias("k"))
    x = values.join(near, F.col("id") == F.col("src"), "left").join(F.broadcast(whole))  # one row
    k = F.coalesce("k", F.lit(0))
    m = k + 1
    here = (F.col("x") + F.coalesce("near_sum", F.lit(0.0))) / m
    spread = F.when(F.col("n") >= 2, F.col("sd") * F.sqrt(F.greatest(F.lit(0.0), (F.col("n") / m - 1) / (F.col("n") - 1))))
    flat = (F.col("n") < 2) | (F.col("sd") <= C.EPSILON)
    gi = F.when(flat | (spread <= C.EPSILON), 0.0).otherwise((here - F.col("mean")) / spread)
    near_mean = F.coalesce(F.col("near_sum") / F.col("k"), F.col("mean"))
    own = F.when(flat, 0.0).otherwise((F.col("x") - F.col("mean")) / F.col("sd"))
    neighbor = F.when(flat, 0.0).otherwise((near_mean - F.col("mean")) / F.col("sd"))
    return x.select("id", "x", gi.alias("gi"), own.alias("own_z"), neighbor.alias("neighbor_z"), near_mean.alias("neighbor_mean"), k.alias("neighbor_count"))


def anomalies(scored: DataFrame) -> DataFrame:
    """Adds the flags and the type of anomaly, from unrounded scores."""
    z = C.Z_CRITICAL
    local, regional = F.col("gi") > z, (F.col("gi") > z) & (F.col("neighbor_z") > z) & (F.col("own_z") > 0)
    solo = (F.col("own_z") > z) & (F.col("neighbor_z") <= z)
    kind = F.when(solo, "solo-anomaly").when(regional, "regional-outage").when(local & (F.col("own_z") > 0), "silent-cluster").when(local, "cluster-edge").otherwise("none")
    return scored.withColumns({"is_local_anomaly": local, "is_regional_outage": regional, "is_solo_anomaly": solo, "anomaly_type": kind})
