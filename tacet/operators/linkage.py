"""Record linkage: blocked candidate pairs, comparison vectors, Fellegi-Sunter scores, clusters."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacet import config as C
from tacet.functions import maths as M
from tacet.functions import text as T
from tacet.operators import graph
from tacet.operators.sweep import near_pairs, similar_to_few, similar_to_loose
from tacet.sources.shared import keep, numbered

WINDOW_MS = C.TIME_WINDOW_H * C.HOUR_MS


def snippet() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, C.SNIPPET))


def few_unresolved(reports: DataFrame) -> bool:
    """Whether unresolved reports are compared with everything similar: if there are any, and at most MAX_UNRESOLVED."""
    return 0 < reports.where("entity is null").limit(C.MAX_UNRESOLVED + 1).count() <= C.MAX_UNRESOLVED


def candidate_pairs(reports: DataFrame, edges: DataFrame, vectors: DataFrame, parts: int | None = None, held: str | None = None, loose: bool | None = None, whole: bool = False) -> DataFrame:
    """(a, b), a < b: reports within the time window of the same or of adjacent entities, and unresolved ones with anything similar.

    Reports are swept in order of entity and time; those of adjacent entities are moved to one of the two for it. The last
    block is left out altogether when more than MAX_UNRESOLVED reports are unresolved, so its vectors are few; ``loose`` says
    so for reports that are only a part of all. With ``whole`` unresolved reports are compared however many they are. Of two
    reports with the boolean column ``held`` set no pair is made.
    """
    old = F.lit(0) if held is None else F.when(F.col(held), 2).otherwise(0)
    known = reports.where("entity is not null and t is not null").select("id", F.col("entity").alias("key"), "t", old.alias("moved"))
    links = edges.where("src <> dst").select(F.least("src", "dst").alias("key"), F.greatest("src", "dst").alias("dst")).distinct()
    moved = known.join(links, "key").select("id", F.col("dst").alias("key"), "t", (F.col("moved") + 1).alias("moved"))
    pairs = near_pairs(known.unionByName(moved), WINDOW_MS, parts)
    if whole:
        timed = reports.where("t is not null").select("id", "t", F.col("entity").isNull().alias("loose"), (old > 0).alias("old"))
        pairs = pairs.unionByName(similar_to_loose(timed, vectors, C.TEXT_BLOCK, WINDOW_MS))
    elif few_unresolved(reports) if loose is None else loose:
        timed = reports.where("t is not null").select("id", "t", "entity", (old > 0).alias("old")).join(vectors, "id")
        few = timed.where("entity is null")
        pairs = pairs.unionByName(similar_to_few(timed if held is None else timed.where("not old"), few, C.TEXT_BLOCK, WINDOW_MS))
        if held is not None:
            pairs = pairs.unionByName(similar_to_few(timed.where("old"), few.where("not old"), C.TEXT_BLOCK, WINDOW_MS))
    return pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def evidence(levels: dict[str, Column]) -> Column:
    """Sum of log likelihood ratios of the comparison levels."""
    out = F.lit(0.0)
    for field, level in levels.items():
        w = F.lit(0.0)
        for name, (m, u) in C.MATCH_TABLE[field].items():
            w = F.when(level == name, math.log(m / u)).otherwise(w)
        out = out + w
    return out


def probability(log_ratio: Column) -> Column:
    odds = F.lit(C.PRIOR_MATCH / (1 - C.PRIOR_MATCH)) * F.exp(log_ratio)
    return odds / (1 + odds)


def outcome_table() -> list[tuple]:
    """(geo, time, text, source, probability, verdict) of every combination of levels."""
    out = []
    for levels in itertools.product(*(C.MATCH_TABLE[f] for f in C.MATCH_TABLE)):
        odds = C.PRIOR_MATCH / (1 - C.PRIOR_MATCH) * math.exp(sum(math.log(m / u) for f, lv in zip(C.MATCH_TABLE, levels, strict=True) for m, u in [C.MATCH_TABLE[f][lv]]))
        p = math.floor(odds / (1 + odds) * 1e4 + 0.5) / 1e4
        out.append((*levels, p, "admit" if p >= C.ADMIT else "ambiguous" if p >= C.AMBIGUOUS_LOW else "reject"))
    return out


def scored_pairs(reports: DataFrame, edges: DataFrame, held: str | None = None, loose: bool | None = None, whole: bool = False) -> DataFrame:
    """Candidate pairs with their comparison levels, similarity, hours apart and match probability; held, loose and whole as for them."""
    vectors = keep(T.vectors(reports, snippet()))
    pairs = keep(candidate_pairs(reports, edges, vectors, held=held, loose=loose, whole=whole))
    cols = ["id", "entity", "t", "source_type"]
    left = reports.select(*cols).join(vectors, "id", "left")
    for side in ("a", "b"):
        pairs = pairs.join(left.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in [*cols[1:], "vector", "norm"]]), side)
    linked = edges.select(F.col("src").alias("entity_a"), F.col("dst").alias("entity_b"), F.lit(True).alias("next")).distinct()
    x = pairs.join(linked, ["entity_a", "entity_b"], "left")
    hours = F.abs(F.col("t_a") - F.col("t_b")) / C.HOUR_MS
    x = T.with_cosine(x.withColumn("hours", hours).drop("t_a", "t_b"))
    levels = {
        "geo": F.when(F.col("entity_a").isNull() | F.col("entity_b").isNull(), "unknown").when(F.col("entity_a") == F.col("entity_b"), "same").when(F.col("next"), "adjacent").otherwise("far"),
        "time": F.when(F.col("hours") < 6, "lt6h").when(F.col("hours") < 24, "lt24h").when(F.col("hours") < 72, "lt72h").otherwise("beyond"),
        "text": F.when(F.col("sim") >= 0.55, "high").when(F.col("sim") >= 0.3, "med").otherwise("low"),
        "source": F.when(F.col("source_type_a").eqNullSafe(F.col("source_type_b")), "same").otherwise("diff"),
    }
    ratio = evidence(levels)
    return x.select("a", "b", *[c.alias(f) for f, c in levels.items()], M.half_up("sim").alias("text_similarity"), M.half_up("hours", 2).alias("hours_apart"), M.half_up(ratio).alias("log_ratio"), M.half_up(probability(ratio)).alias("p"))


def ambiguous(scored: DataFrame, top: int | None = None) -> DataFrame:
    """Pairs that a person has to decide, most probable first."""
    x = scored.where((F.col("p") >= C.AMBIGUOUS_LOW) & (F.col("p") < C.ADMIT)).orderBy(F.desc("p"), "a", "b")
    return x.limit(top) if top else x


def clusters(reports: DataFrame, scored: DataFrame) -> DataFrame:
    """cluster_id, entity, report_ids, confidence, source_diversity; single reports are clusters too.

    The entity is the one of most members (of equally many the earliest heard, then the least);
    numbers follow the earliest time, then the least member.
    """
    admitted = keep(scored.where(F.col("p") >= C.ADMIT).select("a", "b", "p"))
    labels = graph.components(admitted)
    return assembled(reports, admitted, keep(graph.refined(admitted, labels)))


def assembled(reports: DataFrame, admitted: DataFrame, member: DataFrame) -> DataFrame:
    """The clusters of ``clusters``, from admitted pairs (a, b, p) and the cluster of each report that has one (v, cluster)."""
    x = reports.join(member, F.col("id") == F.col("v"), "left").withColumn("cluster", F.coalesce("cluster", "id"))
    sides = [member.select(F.col("v").alias(s), F.col("cluster").alias(f"c{s}")) for s in ("a", "b")]
    inside = admitted.join(sides[0], "a").join(sides[1], "b").where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.avg("p").alias("mean"))
    votes = x.where("entity is not null").groupBy("cluster", "entity").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"))
    owner = votes.groupBy("cluster").agg(F.max_by("entity", F.struct("n", -F.coalesce("first", F.lit(1 << 62)), -F.col("entity"))).alias("owner"))
    whole = x.groupBy("cluster").agg(F.array_sort(F.collect_list("id")).alias("report_ids"), F.count_distinct("source_type").alias("source_diversity"), F.min("t").alias("first"))
    out = whole.join(owner, "cluster", "left").join(inside, "cluster", "left")
    out = numbered(out.withColumn("late", F.col("first").isNull()), "late", "first", "cluster")
    number = F.col("number")
    return out.select(F.concat(F.lit("cl-"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string"))).alias("cluster_id"), F.col("owner").alias("entity"), "report_ids", M.half_up(F.coalesce("mean", F.lit(0.5))).alias("confidence"), "source_diversity")


def simulate_ambiguous(scored: DataFrame, reports: DataFrame | None = None) -> DataFrame:
    """One pair (a, b, p, original_p, forced) for a demonstration.

    A genuine ambiguous one if there is any; else the one nearest to the middle of the band, moved
    there and marked as forced; without any pair one made of the first two reports.
    """
    genuine = (F.col("p") >= C.AMBIGUOUS_LOW) & (F.col("p") < C.ADMIT)
    middle = (C.AMBIGUOUS_LOW + C.ADMIT) / 2
    x = scored.select("a", "b", "p", (~genuine).alias("forced"), F.lit(False).alias("made_up"))
    if reports is not None:
        two = reports.orderBy("id").limit(2).agg(F.min("id").alias("a"), F.max("id").alias("b"), F.lit(middle).alias("p"), F.lit(True).alias("forced"), F.lit(True).alias("made_up")).where("a < b")
        x = x.unionByName(two)
    x = x.orderBy("made_up", "forced", F.when(genuine, -F.col("p")).otherwise(F.abs(F.col("p") - middle)), "a", "b").limit(1)
    return x.select("a", "b", F.when(F.col("forced"), middle).otherwise(F.col("p")).alias("p"), F.col("p").alias("original_p"), "forced")
