"""Cadence, spatial scores and ranking on constructed fields."""

import math

import pytest
from pyspark.sql import functions as F

from tacet import config as C
from tacet.functions import maths as M
from tacet.operators import cadence, ranking, spatial

NOW, H = C.NOW_MS, C.HOUR_MS


def field(spark, n, silent=(), stripped=(), every=3):
    """n entities in one cohort on a chain; the silent ones were last heard 20 hours ago, the others one hour ago."""
    entities = spark.createDataFrame([(i, f"E{i}", "D", 2, 10_000) for i in range(n)], "id bigint, name string, district string, hazard_tier int, population bigint")
    rows = [(i * 10 + k, i, NOW - ((20 if i in silent else 1) + k * every) * H, "news") for i in range(n) if i not in stripped for k in range(3)]
    reports = spark.createDataFrame(rows, "id bigint, entity bigint, t bigint, source_type string")
    edges = spark.createDataFrame([(i, j) for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n], "src bigint, dst bigint")
    return entities, reports, edges


def ranked(spark, *a, **kw):
    return {r.id: r for r in ranking.rank(*field(spark, *a, **kw)).collect()}


def test_fitted_cohort(spark):
    rows = ranked(spark, 10, silent=(4,))
    assert {r.fit_basis for r in rows.values()} == {"cohort"} and rows[0].sample_gaps == 20
    assert rows[0].expected_gap_hours == pytest.approx(12 / (23 / (3 / 2.875 + 5)), abs=1e-4)
    assert rows[4].surprisal == pytest.approx(20 / 3.1532, abs=1e-3)


def test_no_reports(spark):
    rows = ranked(spark, 3, stripped=(0, 1, 2))
    assert {(r.fit_basis, r.expected_gap_hours, r.coverage_basis, r.silence_hours) for r in rows.values()} == {("prior", 12.0, "cohort-cold-start", 0.0)}


def test_one_stripped(spark):
    rows = ranked(spark, 8, stripped=(3,))
    assert [i for i, r in rows.items() if r.coverage_basis == "cohort-cold-start"] == [3]


def test_a_burst_teaches_nothing(spark):
    entities, _, edges = field(spark, 6)
    reports = spark.createDataFrame([(k, 0, NOW - H, "news") for k in range(13)], "id bigint, entity bigint, t bigint, source_type string")
    row = {r.id: r for r in ranking.rank(entities, reports, edges).collect()}[0]
    assert row.report_count == 13 and row.fit_basis == "prior" and row.expected_gap_hours == 12


@pytest.mark.parametrize("every", [0.6, 336])
def test_rates_stay_in_bounds(spark, every):
    entities, _, edges = field(spark, 4)
    rows = [(i * 100 + k, i, int(NOW - k * every * H), "news") for i in range(4) for k in range(20)]
    reports = spark.createDataFrame(rows, "id bigint, entity bigint, t bigint, source_type string")
    for r in ranking.rank(entities, reports, edges).collect():
        assert C.RATE_MIN - 1e-6 <= r.rate_per_hour <= C.RATE_MAX + 1e-6


def test_coalescing_keeps_from_the_last_kept(spark):
    m = H // 60
    times = spark.createDataFrame([(1, t * m) for t in (0, 0, 1, 90, 95)] + [(2, t * m) for t in (0, 20, 40, 60, 80)] + [(None, 5), (3, None)], "entity bigint, t bigint")
    got = sorted((r.entity, r.t // m) for r in cadence.coalesced(times).collect())
    assert got == [(1, 0), (1, 90), (2, 0), (2, 40), (2, 80)]


def test_mle(spark):
    g = spark.createDataFrame([(1, 2.0), (1, 4.0), (1, 6.0), (1, None), (1, -5.0), (2, 0.0)], "entity bigint, gap_hours double")
    got = {r.entity: r.rate for r in cadence.mle_rates(g).collect()}
    assert got[1] == pytest.approx(0.25) and got[2] == pytest.approx(60)


@pytest.mark.parametrize(("n", "silent", "kinds"), [(12, (), {}), (20, (10,), {10: "solo-anomaly"}), (12, (4, 5, 6, 7), {5: "silent-cluster"}), (20, (8, 9, 11, 12), {10: "cluster-edge"}), (30, (12, 13, 14, 15, 16), {14: "regional-outage"})])
def test_anomaly_types(spark, n, silent, kinds):
    rows = ranked(spark, n, silent=silent)
    for i, kind in kinds.items():
        assert rows[i].anomaly_type == kind
    if not silent:
        assert {(r.gi_z, r.anomaly_type) for r in rows.values()} == {(0.0, "none")}
    if silent == (10,):
        assert rows[10].rank == 1 and rows[10].is_escalation_candidate
    if 10 in kinds and kinds[10] == "cluster-edge":
        assert not rows[10].is_escalation_candidate
    assert sorted(r.rank for r in rows.values()) == list(range(1, n + 1))


def test_gi_star_against_the_full_formula(spark):
    x = [1.0, 5.0, 2.0, 9.0, 4.0, 4.0]
    edges = [(0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (3, 99), (4, 4)]
    got = {r.id: r for r in spatial.gi_star(spark.createDataFrame(list(enumerate(x)), "id bigint, x double"), spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    n, mean = len(x), sum(x) / len(x)
    sd = math.sqrt(sum(v * v for v in x) / n - mean * mean)
    for i in range(n):
        near = {b for a, b in edges if a == i and b < n} | {i}
        w = 1 / len(near)
        top = sum(w * x[j] for j in near) - mean * w * len(near)
        down = sd * math.sqrt((n * w * w * len(near) - (w * len(near)) ** 2) / (n - 1))
        assert got[i].gi == pytest.approx(top / down)
    assert got[5].neighbor_mean == pytest.approx(mean) and got[4].neighbor_count == 0


def test_weights_sum_to_one(spark):
    _, _, edges = field(spark, 7)
    w = spatial.weights(spark.range(7), edges).groupBy("src").agg(F.sum("w").alias("s")).collect()
    assert len(w) == 7 and all(r.s == pytest.approx(1) for r in w)


def test_gate(spark):
    base = {"silence_hours": 96.0, "surprisal": 9.0, "own_z": 1.2}
    cases = [({}, True), ({"silence_hours": 5.9}, False), ({"surprisal": 2.99}, False), ({"own_z": 0.0}, False), ({"own_z": None}, False), ({"surprisal": float("inf")}, False), ({"silence_hours": float("nan")}, False)]
    df = spark.createDataFrame([(k, *{**base, **c}.values()) for k, (c, _) in enumerate(cases)], "k int, silence_hours double, surprisal double, own_z double")
    got = {r.k: r.ok for r in df.select("k", ranking.qualifies().alias("ok")).collect()}
    assert [got[k] for k in range(len(cases))] == [want for _, want in cases]


def test_scalars(spark):
    df = spark.createDataFrame([(2.67449, 4999, None), (-0.00005, 20000, 0), (float("inf"), 20001, 3)], "x double, p int, tier int")
    got = df.select(M.half_up("x").alias("r"), M.population_bucket("p").alias("b"), M.cohort_key("tier", "p").alias("k")).collect()
    assert [tuple(r) for r in got] == [(2.6745, "p<5k", "t1|p<5k"), (0.0, "p5-20k", "t1|p5-20k"), (0.0, "p>20k", "t3|p>20k")]
    one = spark.range(1).select(M.prior_rate(F.lit(10_000), F.lit(2)).alias("a"), M.prior_rate(F.lit(500), F.lit(1)).alias("b"), M.silence_band(F.lit(None).cast("double")).alias("c"), M.silence_band(F.lit(36.0)).alias("d")).first()
    assert one.a == pytest.approx(1 / 12) and one.b < one.a and (one.c, one.d) == (5, 3)


def test_corroboration(spark):
    entities, reports, edges = field(spark, 5)
    clusters = spark.createDataFrame([("a", 0, [0, 1]), ("b", 0, [2]), ("c", None, [10, 11])], "cluster_id string, entity bigint, report_ids array<bigint>")
    got = {r.entity: r.corroboration_count for r in ranking.corroboration(entities, reports, clusters).collect()}
    assert (got[0], got[1], got[2]) == (2, 1, 3)
    rows = {r.id: r for r in ranking.rank(entities, reports, edges, clusters=clusters).collect()}
    assert rows[0].corroboration_count == 2


def test_shifts_do_not_matter(spark):
    entities, reports, edges = field(spark, 12, silent=(4, 5))
    a = ranking.rank(entities, reports, edges).drop("last_report_ms").collect()
    b = ranking.rank(entities, reports.withColumn("t", F.col("t") + 5 * H).repartition(5), edges, NOW + 5 * H).drop("last_report_ms").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
