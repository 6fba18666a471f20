"""Queries over reporting cadence and ranking, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tacet import config as C
from tacet.functions import maths as M
from tacet.operators import cadence, ranking, spatial
from tacet.plans import views as V
from tacet.sources.shared import numbered


def _base(spark, d):
    return V.entities(spark, d), V.reports(spark, d)


def last_seen(spark, d):
    e, r = _base(spark, d)
    return cadence.last_seen(e, r).select("id", "last_t", "report_count", "cold_start")


def silence_hours(spark, d):
    e, r = _base(spark, d)
    return cadence.with_silence(cadence.last_seen(e, r), r, C.NOW_MS).select("id", M.half_up("silence_hours").alias("silence_hours"))


def cohort_prior(spark, d):
    return cadence.cohort_priors(V.entities(spark, d)).select("cohort", "members", M.half_up("geo_pop").alias("geo_pop"), M.half_up("prior", 6).alias("prior_rate"), M.half_up(1 / F.col("prior")).alias("prior_gap"))


def coalesced_events(spark, d):
    return _coalesced(spark, d).select("entity", "t")


def _coalesced(spark, d):
    return cadence.coalesced(cadence.event_times(V.reports(spark, d)))


def inter_event_gaps(spark, d):
    return cadence.gaps(_coalesced(spark, d)).select("entity", "t", M.half_up("gap_hours").alias("gap_hours"))


def mle_rate_by_entity(spark, d):
    raw = cadence.gaps(V.reports(spark, d).where("entity is not null").select("entity", "t").distinct())
    return cadence.mle_rates(raw).select("entity", M.half_up("rate", 6).alias("rate"), "n")


def cohort_posterior(spark, d):
    x = cadence.rates(*_base(spark, d))
    return x.select("cohort", "members", "gap_count", M.half_up("k_global", 6).alias("k_global"), M.half_up("k", 6).alias("k"), M.half_up("rate", 6).alias("rate"), "fit_basis", "sample_gaps")


def surprisal_rank(spark, d):
    e, r = _base(spark, d)
    x = cadence.surprisal(e, r, C.NOW_MS).select("id", "cohort", M.half_up("silence_hours").alias("silence_hours"), M.half_up("surprisal").alias("surprisal"))
    return numbered(x, F.desc("surprisal"), "id", name="position")


def neighbour_weights(spark, d):
    e = V.entities(spark, d)
    return spatial.weights(e, V.chain(e)).select("src", "dst", M.half_up("w", 6).alias("w"))


def gi_star(spark, d):
    x = _scored(spark, d)
    return x.select("id", *[M.half_up(c).alias(c) for c in ("gi", "own_z", "neighbor_z", "neighbor_mean")], "neighbor_count")


def _scored(spark, d, block=False):
    e, r = (V.entities(spark, d, 1.2), V.reports_block(spark, d)) if block else _base(spark, d)
    s = cadence.surprisal(e, r, C.NOW_MS).select("id", F.col("surprisal").alias("x"))
    return spatial.anomalies(spatial.gi_star(s, V.chain(e)))


_TYPES = ("id", "is_local_anomaly", "is_regional_outage", "is_solo_anomaly", "anomaly_type")


def anomaly_types(spark, d):
    return _scored(spark, d).select(*_TYPES)


def anomaly_types_block(spark, d):
    return _scored(spark, d, block=True).select(*_TYPES)


def ranked(spark, d):
    e, r = _base(spark, d)
    return ranking.rank(e, r, V.chain(e))


_RANKED = ("id", "name", "district", "population", "hazard_tier", "last_report_ms", "silence_hours", "expected_gap_hours", "surprisal", "gi_z", "coverage_basis", "cohort", "fit_basis", "sample_gaps", "report_count", "own_z", "neighbor_z", "neighbor_count", "anomaly_type", "is_escalation_candidate", "rank")


def entity_ranking(spark, d):
    return ranked(spark, d).select(*_RANKED)


def escalation_candidates(spark, d):
    return ranking.escalations(ranked(spark, d)).select("id", "name", "rank", "silence_hours", "surprisal", "own_z", "title")


def escalation_gate(spark, d):
    return ranked(spark, d).groupBy("coverage_basis", "is_escalation_candidate").agg(F.count(F.lit(1)).alias("n"))


def score_breakdown(spark, d):
    return ranking.score_breakdown(ranked(spark, d))


def silence_bands(spark, d):
    e, r = _base(spark, d)
    x = cadence.with_silence(cadence.last_seen(e, r), r, C.NOW_MS)
    return x.withColumn("band", M.silence_band(M.half_up("silence_hours"))).groupBy("band").agg(F.count(F.lit(1)).alias("n"), M.half_up(F.avg(M.population_radius(F.col("population"))), 3).alias("mean_radius"))


def facet_counts(spark, d):
    x = ranked(spark, d)
    return x.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("anomaly_type") != "none").alias("anomalous"), F.count_if(F.col("coverage_basis") == "cohort-cold-start").alias("no_data"))


def list_anomalous(spark, d):
    return ranking.listing(ranked(spark, d), "anomalous", "a", "silence_hours", True).select("id", "name", "silence_hours", "anomaly_type")


def cohort_rollup(spark, d):
    e = V.entities(spark, d).withColumn("bucket", M.population_bucket("population"))
    return e.rollup("hazard_tier", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("population").alias("population"))


def corridor_segments(spark, d):
    e = V.entities(spark, d)
    x = V.chain(e).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return x.join(e.select(F.col("id").alias("a"), F.col("population").alias("pa")), "a").join(e.select(F.col("id").alias("b"), F.col("population").alias("pb")), "b").select("a", "b", "pa", "pb")


_UP = lambda x, n=4: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"
_NUM = lambda x: f"regexp_replace(CAST(floor(({x}) * 10 + 0.5) / 10 AS VARCHAR), '\\.0$', '')"
_COHORT = "'t' || CASE WHEN hazard_tier = 0 THEN 1 ELSE hazard_tier END || '|' || CASE WHEN population < 5000 THEN 'p<5k' WHEN population <= 20000 THEN 'p5-20k' ELSE 'p>20k' END"


def _chain(reports: str = V.SQL_REPORTS, stretch: float = 1.0) -> str:
    h, now = C.HOUR_MS, C.NOW_MS
    return f"""WITH RECURSIVE {reports}, {V.sql_entities(stretch)}, {V.SQL_EDGES},
seen AS (SELECT e.*, {_COHORT} AS cohort, r.last_t, coalesce(r.n, 0) AS report_count, r.last_t IS NULL AS cold_start FROM entities e
 LEFT JOIN (SELECT entity, max(t) AS last_t, count(*) AS n FROM reports WHERE entity IS NOT NULL GROUP BY 1) r ON r.entity = e.id),
silence AS (SELECT *, greatest(0.0, ({now} - coalesce(last_t, (SELECT min(t) FROM reports), {now})) / {h}.0) AS silence_hours FROM seen),
geo AS (SELECT cohort, count(*) AS members, min(hazard_tier) AS tier, coalesce(exp(avg(CASE WHEN population > 0 THEN ln(population) END)), 10000.0) AS geo_pop FROM seen GROUP BY 1),
priors AS (SELECT *, least({C.RATE_MAX}, greatest({C.RATE_MIN}, (1.0 / 12) * sqrt(greatest(geo_pop, 1.0) / 10000.0) * CASE tier WHEN 1 THEN 0.7 WHEN 3 THEN 1.4 ELSE 1.0 END)) AS prior FROM geo),
ordered AS (SELECT entity, t, row_number() OVER (PARTITION BY entity ORDER BY t) AS rn FROM (SELECT DISTINCT entity, t FROM reports WHERE entity IS NOT NULL)),
fold AS (SELECT entity, rn, t, t AS kept, TRUE AS keep FROM ordered WHERE rn = 1 UNION ALL
 SELECT o.entity, o.rn, o.t, CASE WHEN o.t - f.kept >= {h // 2} THEN o.t ELSE f.kept END, o.t - f.kept >= {h // 2} FROM fold f JOIN ordered o ON o.entity = f.entity AND o.rn = f.rn + 1),
coalesced AS (SELECT entity, t FROM fold WHERE keep),
gaps AS (SELECT * FROM (SELECT entity, t, (t - lag(t) OVER (PARTITION BY entity ORDER BY t)) / {h}.0 AS gap_hours FROM coalesced) WHERE gap_hours > 0),
fitted AS (SELECT s.cohort, count(*) AS n, sum(p.prior * g.gap_hours) AS u FROM gaps g JOIN seen s ON s.id = g.entity JOIN priors p ON p.cohort = s.cohort GROUP BY 1),
scales AS (SELECT coalesce(sum(n), 0) AS all_n, (3.0 + coalesce(sum(n), 0)) / (3.0 + coalesce(sum(u), 0.0)) AS k_global FROM fitted),
posterior AS (SELECT p.cohort, p.members, p.prior, coalesce(f.n, 0) AS gap_count, s.k_global, s.all_n, (3.0 + coalesce(f.n, 0)) / (3.0 / s.k_global + coalesce(f.u, 0.0)) AS k FROM priors p LEFT JOIN fitted f ON f.cohort = p.cohort CROSS JOIN scales s),
rates AS (SELECT *, least({C.RATE_MAX}, greatest({C.RATE_MIN}, k * prior)) AS rate, CASE WHEN all_n = 0 THEN 'prior' WHEN gap_count >= 3 THEN 'cohort' ELSE 'global' END AS fit_basis,
 CASE WHEN all_n = 0 THEN 0 WHEN gap_count >= 3 THEN gap_count ELSE all_n END AS sample_gaps FROM posterior),
surprisal AS (SELECT s.*, r.rate, r.fit_basis, r.sample_gaps, greatest(0.0, r.rate * s.silence_hours) AS x FROM silence s JOIN rates r ON r.cohort = s.cohort),
whole AS (SELECT count(*) AS n, avg(x) AS mean, sqrt(greatest(0.0, avg(x * x) - avg(x) * avg(x))) AS sd FROM surprisal),
near AS (SELECT e.src, sum(s.x) AS near_sum, count(*) AS k FROM edges e JOIN surprisal s ON s.id = e.dst GROUP BY 1),
local AS (SELECT s.*, coalesce(k, 0) AS neighbor_count, (s.x + coalesce(near_sum, 0)) / (coalesce(k, 0) + 1) AS here, coalesce(near_sum / k, mean) AS neighbor_mean, n, mean, sd,
 sd * sqrt(greatest(0.0, (n / (coalesce(k, 0) + 1.0) - 1) / (n - 1))) AS spread FROM surprisal s LEFT JOIN near ON near.src = s.id CROSS JOIN whole),
gi AS (SELECT *, CASE WHEN n < 2 OR sd <= 1e-12 OR spread <= 1e-12 THEN 0 ELSE (here - mean) / spread END AS gi, CASE WHEN n < 2 OR sd <= 1e-12 THEN 0 ELSE (x - mean) / sd END AS own_z,
 CASE WHEN n < 2 OR sd <= 1e-12 THEN 0 ELSE (neighbor_mean - mean) / sd END AS neighbor_z FROM local),
flagged AS (SELECT *, gi > 1.96 AS is_local_anomaly, gi > 1.96 AND neighbor_z > 1.96 AND own_z > 0 AS is_regional_outage, own_z > 1.96 AND neighbor_z <= 1.96 AS is_solo_anomaly FROM gi),
typed AS (SELECT *, CASE WHEN is_solo_anomaly THEN 'solo-anomaly' WHEN is_regional_outage THEN 'regional-outage' WHEN is_local_anomaly AND own_z > 0 THEN 'silent-cluster' WHEN is_local_anomaly THEN 'cluster-edge' ELSE 'none' END AS anomaly_type FROM flagged),
rounded AS (SELECT {_UP("rate", 6)} AS rate_per_hour, id, name, district, population, hazard_tier, last_t AS last_report_ms, {_UP("silence_hours")} AS silence_hours, {_UP("1 / rate")} AS expected_gap_hours, {_UP("x")} AS surprisal, {_UP("gi")} AS gi_z,
 CASE WHEN cold_start THEN 'cohort-cold-start' ELSE 'reports' END AS coverage_basis, cohort, fit_basis, sample_gaps, report_count, {_UP("own_z")} AS own_z, {_UP("neighbor_z")} AS neighbor_z, neighbor_count, anomaly_type FROM typed),
gated AS (SELECT *, silence_hours >= 6 AND surprisal >= 3 AND own_z > 0 AS is_escalation_candidate FROM rounded),
ranked AS (SELECT *, row_number() OVER (ORDER BY gi_z DESC, surprisal DESC, population DESC, id) AS rank FROM gated)
"""


_ALL = _chain()
QUERIES = {f.__name__: f for f in (last_seen, silence_hours, cohort_prior, coalesced_events, inter_event_gaps, mle_rate_by_entity, cohort_posterior, surprisal_rank, neighbour_weights, gi_star, anomaly_types, anomaly_types_block, entity_ranking, escalation_candidates, escalation_gate, score_breakdown, silence_bands, facet_counts, list_anomalous, cohort_rollup, corridor_segments)}
SQL = {
    "last_seen": _ALL + "SELECT id, last_t, report_count, cold_start FROM seen",
    "silence_hours": _ALL + f"SELECT id, {_UP('silence_hours')} AS silence_hours FROM silence",
    "cohort_prior": _ALL + f"SELECT cohort, members, {_UP('geo_pop')} AS geo_pop, {_UP('prior', 6)} AS prior_rate, {_UP('1 / prior')} AS prior_gap FROM priors",
    "coalesced_events": _ALL + "SELECT entity, t FROM coalesced",
    "inter_event_gaps": _ALL + f"SELECT entity, t, {_UP('gap_hours')} AS gap_hours FROM gaps",
    "mle_rate_by_entity": _ALL + f"SELECT entity, {_UP(f'count(g) / sum(greatest(g, {C.GAP_FLOOR_H}))', 6)} AS rate, count(g) AS n FROM (SELECT entity, (t - lag(t) OVER (PARTITION BY entity ORDER BY t)) / 3600000.0 AS g FROM ordered) WHERE g > 0 GROUP BY 1",
    "cohort_posterior": _ALL + f"SELECT cohort, members, gap_count, {_UP('k_global', 6)} AS k_global, {_UP('k', 6)} AS k, {_UP('rate', 6)} AS rate, fit_basis, sample_gaps FROM rates",
    "surprisal_rank": _ALL + f"SELECT *, row_number() OVER (ORDER BY surprisal DESC, id) AS position FROM (SELECT id, cohort, {_UP('silence_hours')} AS silence_hours, {_UP('x')} AS surprisal FROM surprisal)",
    "neighbour_weights": _ALL + f"SELECT src, dst, {_UP('1.0 / count(*) OVER (PARTITION BY src)', 6)} AS w FROM (SELECT src, dst FROM edges UNION SELECT id, id FROM entities)",
    "gi_star": _ALL + f"SELECT id, {_UP('gi')} AS gi, {_UP('own_z')} AS own_z, {_UP('neighbor_z')} AS neighbor_z, {_UP('neighbor_mean')} AS neighbor_mean, neighbor_count FROM gi",
    "anomaly_types": _ALL + f"SELECT {', '.join(_TYPES)} FROM typed",
    "anomaly_types_block": _chain(V.SQL_REPORTS_BLOCK, 1.2) + f"SELECT {', '.join(_TYPES)} FROM typed",
    "entity_ranking": _ALL + f"SELECT {', '.join(_RANKED)} FROM ranked",
    "escalation_candidates": _ALL + f"SELECT id, name, rank, silence_hours, surprisal, own_z, 'Anomalous silence: ' || name || ' (' || district || ') - ' || {_NUM('silence_hours')} || 'h with no confirming report, expected roughly every ' || {_NUM('expected_gap_hours')} || 'h' AS title FROM ranked WHERE is_escalation_candidate ORDER BY rank LIMIT 8",
    "escalation_gate": _ALL + "SELECT coverage_basis, is_escalation_candidate, count(*) AS n FROM ranked GROUP BY 1, 2",
    "score_breakdown": _ALL + f"SELECT id, cohort, silence_hours, expected_gap_hours, {_UP('1 / expected_gap_hours', 5)} AS rate, surprisal, {_UP('exp(-(1 / expected_gap_hours) * silence_hours)', 6)} AS survival_probability FROM ranked",
    "silence_bands": _ALL + f"SELECT band, count(*) AS n, {_UP('avg(radius)', 3)} AS mean_radius FROM (SELECT CASE WHEN s < 6 THEN 0 WHEN s < 18 THEN 1 WHEN s < 36 THEN 2 WHEN s < 60 THEN 3 WHEN s < 84 THEN 4 ELSE 5 END AS band, least(22.0, greatest(5.0, 5 + 16 * sqrt(population / 25000.0))) AS radius FROM (SELECT {_UP('silence_hours')} AS s, population FROM silence)) GROUP BY 1",
    "facet_counts": _ALL + "SELECT count(*) AS total, count(*) FILTER (anomaly_type <> 'none') AS anomalous, count(*) FILTER (coverage_basis = 'cohort-cold-start') AS no_data FROM ranked",
    "list_anomalous": _ALL + "SELECT id, name, silence_hours, anomaly_type FROM ranked WHERE anomaly_type <> 'none' AND (lower(name) LIKE '%a%' OR lower(district) LIKE '%a%')",
    "cohort_rollup": f"WITH {V.sql_entities()}, b AS (SELECT *, CASE WHEN population < 5000 THEN 'p<5k' WHEN population <= 20000 THEN 'p5-20k' ELSE 'p>20k' END AS bucket FROM entities) SELECT hazard_tier, bucket, count(*) AS n, CAST(sum(population) AS BIGINT) AS population FROM b GROUP BY ROLLUP (hazard_tier, bucket)",
    "corridor_segments": f"WITH {V.sql_entities()}, {V.SQL_EDGES} SELECT src AS a, dst AS b, x.population AS pa, y.population AS pb FROM edges JOIN entities x ON x.id = src JOIN entities y ON y.id = dst WHERE src < dst",
}
