"""Queries over text, linkage, clusters and triage, each with its SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tacet import config as C
from tacet.functions import maths as M
from tacet.functions import text as T
from tacet.operators import graph, increments, lexicons, linkage, triage
from tacet.plans import views as V

#: A made-up gazetteer of words that occur in the test documents, with misspelt aliases: id, name, aliases.
GAZETTEER = [(1, "Thanedble", ["thanedbel"]), (2, "Erndble", ["erndbel east"]), (3, "Hetition", []), (4, "Pathetic", ["pathetik"]), (5, "Inwhorst", ["inworst"]), (6, "Worthless", ["worthles point"]), (7, "Ouqueen", ["ouquen"]), (8, "Ciónción", ["cion cion"])]


def gazetteer(spark):
    return spark.createDataFrame(GAZETTEER, "id bigint, name string, aliases array<string>")


def _reports(spark, d):
    return V.doc_reports(spark, d)


def normalize_text(spark, d):
    return V.table(spark, d, "documents").select("doc_id", F.md5(T.normalize("text")).alias("digest"), F.length(T.normalize("text")).alias("n"))


def trigram_tf(spark, d):
    x = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    v = T.vectors(x, F.col("text"))
    return v.select("id", F.size("vector.grams").alias("distinct_grams"), M.half_up("norm").alias("norm"))


def trigram_rows(spark, d):
    """Counts from the table function of SQL."""
    T.register(spark)
    rows = spark.sql("SELECT d.doc_id AS id, t.gram, t.tf FROM {docs} AS d, LATERAL trigrams(d.text) AS t", docs=V.table(spark, d, "documents"))
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("distinct_grams"), F.sum("tf").alias("grams"), F.max("tf").alias("most"), F.max_by("gram", F.struct("tf", "gram")).alias("top"))


def trigram_cosine_pairs(spark, d):
    x = V.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    v = T.vectors(x, F.col("text"))
    w = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("v2"), F.col("norm").alias("n2"))
    return v.join(w, "id").select("id", M.half_up(T.cosine(F.col("vector"), F.col("v2"), F.col("norm"), F.col("n2"))).alias("cosine"))


def candidate_pairs(spark, d):
    r = _reports(spark, d)
    return linkage.candidate_pairs(r, V.doc_edges(spark), T.vectors(r, linkage.snippet()))


def _scored(spark, d):
    return linkage.scored_pairs(_reports(spark, d), V.doc_edges(spark))


def scored_pairs(spark, d):
    return _scored(spark, d)


def outcome_table(spark, d):
    return spark.createDataFrame(linkage.outcome_table(), "geo string, time string, text string, source string, p double, verdict string")


def ambiguous_pairs(spark, d):
    return linkage.ambiguous(_scored(spark, d)).select("a", "b", "p")


def ambiguous_top(spark, d):
    return linkage.ambiguous(_scored(spark, d), C.TOP_AMBIGUOUS).select("a", "b", "p")


def _whole(spark, d):
    """The scored pairs of components and clusters: unresolved reports are compared however many they are."""
    return linkage.scored_pairs(_reports(spark, d), V.doc_edges(spark), whole=True)


def components(spark, d):
    c = graph.components(_whole(spark, d).where(F.col("p") >= C.ADMIT).select("a", "b"))
    ids = _reports(spark, d).select("id")
    return ids.join(c, F.col("id") == F.col("v"), "left").select("id", F.coalesce("c", "id").alias("component"))


def clusters(spark, d):
    return linkage.clusters(_reports(spark, d), _whole(spark, d)).withColumn("report_ids", F.array_join("report_ids", ","))


def clusters_in_batches(spark, d):
    """The clusters of all reports, which come in three batches by time, the second of them last."""
    r = _reports(spark, d)
    low, high = r.agg(F.min("t"), F.max("t")).first()
    third = F.least(F.lit(2), F.floor((F.col("t") - low) * 3 / max(1, (high or 0) - (low or 0))))
    held = increments.begin(r.where(third == 0), V.doc_edges(spark), whole=True)
    for k in (2, 1):
        held = increments.extend(held, r.where(third == k), V.doc_edges(spark))
    return held.clusters().withColumn("report_ids", F.array_join("report_ids", ","))


def simulated_ambiguous(spark, d):
    return linkage.simulate_ambiguous(_scored(spark, d), _reports(spark, d))


def lexicon_hits(spark, d):
    return triage.counted(V.table(spark, d, "documents").select("doc_id", T.normalize("text").alias("norm")), "doc_id")


def triage_category(spark, d):
    x = lexicon_hits(spark, d)
    n = {k: F.col(k) for k in x.columns[1:]}
    entity = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))
    category, strength = triage.classify(entity, F.lit(None).cast("string"), F.when(F.col("doc_id") % 2 == 0, "official").otherwise("news"), n)
    return x.select("doc_id", category.alias("category"), strength.alias("strength"))


def tier1_matches(spark, d):
    return triage.exact_matches(_reports(spark, d), triage.variants(gazetteer(spark))).select("id", "entity", "n")


def tier2_best(spark, d):
    x = triage.fuzzy_scores(_reports(spark, d), triage.variants(gazetteer(spark))).where(F.col("score") >= C.FUZZY_MIN)
    return x.select("id", "entity", M.half_up("score").alias("score"))


def triage_reports(spark, d):
    x = triage.triage(_reports(spark, d), gazetteer(spark))
    return x.select("id", "entity", "category", "confidence", "tier", "matched_on", *[F.array_join(c, ",").alias(c) for c in ("hazard_hits", "warning_hits", "negative_hits", "noise_hits", "status_hits")], "unknown_place")


def relevant_documents(spark, d):
    return V.table(spark, d, "documents").select("doc_id", triage.relevant(F.lit(""), F.coalesce("text", F.lit("")), ["thanedble", "inwhorst"]).alias("relevant"))


#: Made-up names and a gazetteer for them.
NAMES = ["Algeria", "Brasil", "Iran", "Saudi Arabia", "Germanny"]
PLACES = [(1, "China", []), (2, "Germany", ["Brazil"]), (3, "Irann", [])]


def unknown_places(spark, d):
    name = F.element_at(F.array(*map(F.lit, NAMES)), F.col("n_nationkey").cast("int") % 5 + 1)
    text = F.concat(F.lit("News: "), name, F.when(F.col("n_nationkey") % 3 == 0, F.lit(" town had rain. Village of Xanadu is dry")).otherwise(F.lit(" village had rain")))
    r = V.table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.lit("").alias("title"), text.alias("text"))
    return triage.unknown_places(r, triage.variants(spark.createDataFrame(PLACES, "id bigint, name string, aliases array<string>")))


_N = r"trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', ' ', 'g'))"
_NORM = _N.format("text")


def _vectors(source: str) -> str:
    """CTEs v (id, gram, tf) and norms (id, norm) of source (id, text)."""
    return f"""n AS (SELECT id, '  ' || {_NORM} || '  ' AS p FROM {source} WHERE {_NORM} <> ''), v AS (SELECT id, substr(p, i, 3) AS gram, count(*) AS tf FROM (SELECT id, p, unnest(generate_series(1, length(p) - 2)) AS i FROM n) GROUP BY 1, 2),
norms AS (SELECT id, sqrt(sum(tf * tf)) AS norm, count(*) AS distinct_grams FROM v GROUP BY 1)"""


_SNIP = "snip AS (SELECT doc_id AS id, text FROM documents)"
_UP = lambda x, n=4: f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"
_RATIO = " + ".join("CASE " + " ".join(f"WHEN {f} = '{lv}' THEN {math.log(m / u)!r}" for lv, (m, u) in t.items()) + " ELSE 0 END" for f, t in C.MATCH_TABLE.items())
_PAIRS = f"""WITH RECURSIVE {V.SQL_DOC_REPORTS}, snip AS (SELECT id, substr(text, 1, {C.SNIPPET}) AS text FROM doc_reports), {_vectors("snip")},
timed AS (SELECT *, t // {linkage.WINDOW_MS} AS bin FROM doc_reports), spread AS (SELECT *, unnest([bin - 1, bin, bin + 1]) AS near FROM timed),
close AS (SELECT x.id AS a, y.id AS b, x.entity AS ea, y.entity AS eb, x.t AS ta, y.t AS tb, x.source_type AS sa, y.source_type AS sb FROM timed x JOIN spread y ON y.near = x.bin WHERE x.id < y.id AND abs(y.t - x.t) <= {linkage.WINDOW_MS}),
maybe AS (SELECT * FROM close WHERE ea = eb OR abs(ea - eb) = 1 OR ((ea IS NULL OR eb IS NULL) AND (SELECT count(*) FROM doc_reports WHERE entity IS NULL) BETWEEN 1 AND {C.MAX_UNRESOLVED})),
dots AS (SELECT m.a, m.b, sum(x.tf * y.tf) AS dot FROM maybe m JOIN v x ON x.id = m.a JOIN v y ON y.id = m.b AND y.gram = x.gram GROUP BY 1, 2),
sims AS (SELECT m.*, coalesce(dot / (p.norm * q.norm), 0) AS sim FROM maybe m LEFT JOIN dots d ON d.a = m.a AND d.b = m.b LEFT JOIN norms p ON p.id = m.a LEFT JOIN norms q ON q.id = m.b),
pairs AS (SELECT * FROM sims WHERE ea IS NOT NULL AND eb IS NOT NULL OR sim >= {C.TEXT_BLOCK}),
levels AS (SELECT a, b, CASE WHEN ea IS NULL OR eb IS NULL THEN 'unknown' WHEN ea = eb THEN 'same' ELSE 'adjacent' END AS geo,
 CASE WHEN abs(ta - tb) / 3600000.0 < 6 THEN 'lt6h' WHEN abs(ta - tb) / 3600000.0 < 24 THEN 'lt24h' WHEN abs(ta - tb) / 3600000.0 < 72 THEN 'lt72h' ELSE 'beyond' END AS time,
 CASE WHEN sim >= 0.55 THEN 'high' WHEN sim >= 0.3 THEN 'med' ELSE 'low' END AS text, CASE WHEN sa = sb THEN 'same' ELSE 'diff' END AS source, sim, abs(ta - tb) / 3600000.0 AS hours FROM pairs),
ratios AS (SELECT *, {_RATIO} AS ratio FROM levels),
scored AS (SELECT a, b, geo, time, text, source, {_UP("sim")} AS text_similarity, {_UP("hours", 2)} AS hours_apart, {_UP("ratio")} AS log_ratio, {_UP(f"{C.PRIOR_MATCH / (1 - C.PRIOR_MATCH)!r} * exp(ratio) / (1 + {C.PRIOR_MATCH / (1 - C.PRIOR_MATCH)!r} * exp(ratio))")} AS p FROM ratios)
"""
#: The same for the queries that compare unresolved reports however many they are.
_WHOLE = _PAIRS.replace(f" AND (SELECT count(*) FROM doc_reports WHERE entity IS NULL) BETWEEN 1 AND {C.MAX_UNRESOLVED}", "")


def _refined() -> str:
    """CTEs: components of the admitted pairs (comp0), then level by level each without its weakest bridge, if that is weak and has two members on either side."""
    out = f"edges0 AS (SELECT a, b, p FROM scored WHERE p >= {C.ADMIT})"
    for k in range(C.MAX_DEPTH + 2):
        out += f""", links{k} AS (SELECT a, b FROM edges{k} UNION ALL SELECT b, a FROM edges{k}), reach{k} AS (SELECT a AS v, a AS u FROM links{k} UNION SELECT r.v, l.b FROM reach{k} r JOIN links{k} l ON l.a = r.u), comp{k} AS (SELECT v, min(u) AS c, count(*) AS size FROM reach{k} GROUP BY 1)"""
        if k <= C.MAX_DEPTH:
            out += f""", side{k} AS (SELECT a AS ea, b AS eb, a AS u FROM edges{k} WHERE p <= {C.WEAK_BRIDGE} UNION SELECT s.ea, s.eb, l.b FROM side{k} s JOIN links{k} l ON l.a = s.u WHERE NOT ((l.a = s.ea AND l.b = s.eb) OR (l.a = s.eb AND l.b = s.ea))),
whole{k} AS (SELECT ea, eb, count(*) AS n, max(CASE WHEN u = eb THEN 1 ELSE 0 END) AS back FROM side{k} GROUP BY 1, 2),
bridge{k} AS (SELECT e.a, e.b, w.n, c.size, row_number() OVER (PARTITION BY c.c ORDER BY e.p, e.a, e.b) AS k FROM whole{k} w JOIN edges{k} e ON e.a = w.ea AND e.b = w.eb JOIN comp{k} c ON c.v = e.a WHERE w.back = 0 AND c.size >= 3),
edges{k + 1} AS (SELECT e.* FROM edges{k} e LEFT JOIN (SELECT a, b FROM bridge{k} WHERE k = 1 AND n >= 2 AND size - n >= 2) x ON x.a = e.a AND x.b = e.b WHERE x.a IS NULL)"""
    return out


_LAST = f"comp{C.MAX_DEPTH + 1}"
_CLUSTERS = f""", {_refined()}, member AS (SELECT d.id, coalesce(m.c, d.id) AS cluster, d.entity, d.t, d.source_type FROM doc_reports d LEFT JOIN {_LAST} m ON m.v = d.id),
inside AS (SELECT x.c AS cluster, avg(e.p) AS mean FROM edges0 e JOIN {_LAST} x ON x.v = e.a JOIN {_LAST} y ON y.v = e.b AND y.c = x.c GROUP BY 1),
votes AS (SELECT cluster, entity, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, min(t), entity) AS k FROM member WHERE entity IS NOT NULL GROUP BY 1, 2),
per AS (SELECT cluster, array_to_string(list(id ORDER BY id), ',') AS report_ids, count(DISTINCT source_type) AS source_diversity, min(t) AS first FROM member GROUP BY 1),
numbered AS (SELECT p.*, row_number() OVER (ORDER BY first NULLS LAST, cluster) AS n FROM per p)
SELECT 'cl-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS cluster_id, v.entity, report_ids, {_UP('coalesce(mean, 0.5)')} AS confidence, source_diversity FROM numbered u LEFT JOIN inside i ON i.cluster = u.cluster LEFT JOIN votes v ON v.cluster = u.cluster AND v.k = 1"""
_LEX = {"hazard": lexicons.HAZARD, "strong": lexicons.STRONG, "weak": lexicons.WEAK, "warning": lexicons.WARNING, "negative": lexicons.NEGATIVE, "noise": lexicons.NOISE}
_COUNTS = f"counts AS (SELECT doc_id, {', '.join('(' + ' + '.join(f"CASE WHEN contains(s, '{w}') THEN 1 ELSE 0 END" for w in ws) + f') AS {k}' for k, ws in _LEX.items())} FROM (SELECT doc_id, {_NORM} AS s FROM documents))"
_VARIANTS = "variants AS (SELECT DISTINCT entity, " + _N.format("raw") + " AS norm FROM (VALUES " + ", ".join(f"({i}, '{r}')" for i, name, al in GAZETTEER for r in [name, *al]) + ") AS g(entity, raw))"
_FEATURE = "(" + ", ".join(f"'{w}'" for w in lexicons.FEATURES) + ")"
_WINDOWS = f"""tokens AS (SELECT id, string_split(s, ' ') AS w FROM (SELECT doc_id AS id, {_N.format(f"' ' || substr(text, 1, {C.MAX_TEXT})")} AS s FROM documents) WHERE s <> ''),
windows AS (SELECT id, pos, k, array_to_string(w[pos:pos + k - 1], ' ') AS win, w[pos + k] AS after, w[pos:pos + k - 1] AS own FROM (SELECT id, w, unnest(generate_series(1, len(w))) AS pos FROM tokens), (SELECT unnest([1, 2, 3, 4]) AS k) WHERE pos + k - 1 <= len(w))"""
_NAME = "([A-Z][a-zA-Z]+(?:\\s+[A-Z][a-zA-Z]+)?)"


def _unknown(raw: str, known: str) -> str:
    """CTEs ending in unknown (id, unknown_place), of raw (id, raw) and the gazetteer's variants in known (norm)."""
    return f"""names AS (SELECT id, list_distinct_ordered AS ns FROM (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT id, list_concat(regexp_extract_all(raw, '\\b{_NAME}\\s+(?:{'|'.join(lexicons.PLACE_AFTER)})\\b', 1), regexp_extract_all(raw, '\\b(?:{'|'.join(lexicons.PLACE_BEFORE)})\\s+of\\s+{_NAME}\\b', 1)) AS l FROM {raw}))),
named AS (SELECT id, i, ns[i] AS name, {_N.format("ns[i]")} AS norm FROM (SELECT id, ns, unnest(generate_series(1, len(ns))) AS i FROM names) WHERE length(ns[i]) >= 3),
ug AS (SELECT norm, substr(p, i, 3) AS gram, count(*) AS tf FROM (SELECT norm, p, unnest(generate_series(1, length(p) - 2)) AS i FROM (SELECT DISTINCT norm, '  ' || norm || '  ' AS p FROM named WHERE norm <> '')) GROUP BY 1, 2),
kg AS (SELECT norm AS variant, substr(p, i, 3) AS gram, count(*) AS tf FROM (SELECT norm, p, unnest(generate_series(1, length(p) - 2)) AS i FROM (SELECT DISTINCT norm, '  ' || norm || '  ' AS p FROM {known})) GROUP BY 1, 2),
ubest AS (SELECT norm, max(cos) AS best FROM (SELECT ug.norm, variant, sum(ug.tf * kg.tf) / (any_value(un.n) * any_value(kn.n)) AS cos FROM ug JOIN kg ON kg.gram = ug.gram JOIN (SELECT norm, sqrt(sum(tf * tf)) AS n FROM ug GROUP BY 1) un ON un.norm = ug.norm JOIN (SELECT variant AS v, sqrt(sum(tf * tf)) AS n FROM kg GROUP BY 1) kn ON kn.v = kg.variant GROUP BY 1, 2) GROUP BY 1),
unknown AS (SELECT id, arg_min(name, i) AS unknown_place FROM named LEFT JOIN ubest USING (norm) WHERE norm <> '' AND coalesce(best, 0) < {C.UNKNOWN_BAR} GROUP BY 1)"""


_PLACES = f"""WITH known AS (SELECT {_N.format("raw")} AS norm FROM (VALUES {', '.join(f"('{r}')" for _, n, al in PLACES for r in [n, *al])}) AS g(raw)),
raws AS (SELECT CAST(n_nationkey AS BIGINT) AS id, '. News: ' || {NAMES!r}[n_nationkey % 5 + 1] || CASE WHEN n_nationkey % 3 = 0 THEN ' town had rain. Village of Xanadu is dry' ELSE ' village had rain' END AS raw FROM nation), {_unknown("raws", "known")} SELECT id, unknown_place FROM unknown"""
_HITS = ", ".join(f"array_to_string(list_filter({ws!r}, lambda w: contains(s, w))[1:{m}], ',') AS {k}_hits" for k, ws, m in (("hazard", lexicons.HAZARD, 6), ("warning", lexicons.WARNING, 4), ("negative", lexicons.NEGATIVE, 4), ("noise", lexicons.NOISE, 4), ("status", lexicons.STRONG + lexicons.WEAK, 6)))
_SIZES = ", ".join(f"len(list_filter({ws!r}, lambda w: contains(s, w))) AS {k}" for k, ws in _LEX.items())


def _class(named: str) -> str:
    """The category and strength of a row of sizes; named: whether it has an entity."""
    veto, real = "(negative > 0 OR (warning > 0 AND strong = 0))", "(strong > 0 OR (weak >= 2 AND warning = 0))"
    rules = [("noise > 0 AND hazard = 0", "noise", "0.95"), ("hazard = 0 AND strong + weak = 0", "noise", "0.85"), (f"NOT ({named}) AND unknown_place IS NOT NULL AND hazard > 0", "new-settlement", "0.8"), (f"({named}) AND {real} AND NOT {veto}", "corroboration-candidate", "CASE source_type WHEN 'official' THEN 0.95 WHEN 'social' THEN 0.78 ELSE 0.88 END"), ("negative > 0", "hazard-signal", f"CASE WHEN {named} THEN 0.9 ELSE 0.7 END"), ("hazard > 0", "hazard-signal", f"CASE WHEN {named} THEN 0.85 ELSE 0.7 END")]
    pick = lambda i, last: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i] if i == 2 else repr(r[i])}" for r in rules) + f" ELSE {last} END"
    return pick(1, "'noise'"), f"CAST({pick(2, '0.6')} AS DOUBLE)"


_BARE, _FULL = _class("FALSE"), _class("entity IS NOT NULL")
_TRIAGE = f"""WITH {_WINDOWS.replace("unnest([1, 2, 3, 4])", "unnest([1, 2, 3])")}, {_VARIANTS}, raws AS (SELECT doc_id AS id, '. ' || substr(coalesce(text, ''), 1, {C.MAX_TEXT}) AS raw FROM documents), {_unknown("raws", "variants")},
raw_variants AS (SELECT DISTINCT ON (entity, norm) entity, raw, norm FROM (SELECT entity, raw, {_N.format("raw")} AS norm FROM (VALUES {', '.join(f"({i}, '{r}')" for i, name, al in GAZETTEER for r in [name, *al])}) AS g(entity, raw))),
hits AS (SELECT w.id, v.entity, arg_max(v.raw, (length(win), win)) AS matched FROM windows w JOIN raw_variants v ON v.norm = win WHERE coalesce(after NOT IN {_FEATURE}, TRUE) GROUP BY 1, 2),
per AS (SELECT id, count(*) AS exact, any_value(entity) AS only_entity, any_value(matched) AS only_matched FROM hits GROUP BY 1),
texts AS (SELECT doc_id AS id, lang AS source_type, {_N.format(f"' ' || substr(coalesce(text, ''), 1, {C.MAX_TEXT})")} AS s FROM documents),
x AS (SELECT t.id, source_type, {_SIZES}, {_HITS}, coalesce(exact, 0) AS exact, only_entity, only_matched, unknown_place FROM texts t LEFT JOIN per ON per.id = t.id LEFT JOIN unknown u ON u.id = t.id),
y AS (SELECT *, exact = 0 AND ((bare = 'noise' AND bare_s >= 0.85) OR bare = 'new-settlement') AS settled FROM (SELECT *, {_BARE[0]} AS bare, {_BARE[1]} AS bare_s FROM x)),
fw AS (SELECT id, win, min(pos) AS pos FROM windows WHERE length(win) >= 4 AND coalesce(after NOT IN {_FEATURE}, TRUE) AND NOT list_has_any(own, {_FEATURE.replace("(", "[").replace(")", "]")}) GROUP BY 1, 2),
wg AS (SELECT win, substr(p, i, 3) AS gram, count(*) AS tf FROM (SELECT win, p, unnest(generate_series(1, length(p) - 2)) AS i FROM (SELECT DISTINCT win, '  ' || win || '  ' AS p FROM fw)) GROUP BY 1, 2), wn AS (SELECT win, sqrt(sum(tf * tf)) AS norm FROM wg GROUP BY 1),
vg AS (SELECT entity, norm AS variant, substr(p, i, 3) AS gram, count(*) AS tf FROM (SELECT entity, norm, p, unnest(generate_series(1, length(p) - 2)) AS i FROM (SELECT entity, norm, '  ' || norm || '  ' AS p FROM variants)) GROUP BY 1, 2, 3), vn AS (SELECT entity, variant, sqrt(sum(tf * tf)) AS norm FROM vg GROUP BY 1, 2),
dots AS (SELECT wg.win, vg.entity, vg.variant, sum(wg.tf * vg.tf) AS dot FROM wg JOIN vg ON vg.gram = wg.gram GROUP BY 1, 2, 3), sims AS (SELECT d.win, d.entity, max(dot / (wn.norm * vn.norm)) AS score FROM dots d JOIN wn ON wn.win = d.win JOIN vn ON vn.entity = d.entity AND vn.variant = d.variant GROUP BY 1, 2),
fuzzy AS (SELECT fw.id, s.entity, max(score) AS score, arg_max(fw.win, (score, -pos, -length(fw.win))) AS win FROM fw JOIN sims s ON s.win = fw.win AND score >= {C.FUZZY_MIN} GROUP BY 1, 2),
best AS (SELECT f.id, arg_max(f.entity, (f.score, -f.entity)) AS near, max(f.score) AS score, arg_max(f.win, (f.score, -f.entity)) AS win FROM fuzzy f JOIN y ON y.id = f.id AND y.exact <> 1 AND NOT y.settled LEFT JOIN hits h ON h.id = f.id AND h.entity = f.entity WHERE y.exact = 0 OR h.id IS NOT NULL GROUP BY 1),
z AS (SELECT *, CASE WHEN exact = 1 THEN only_entity WHEN two THEN near END AS entity FROM (SELECT y.*, near, score, win, exact <> 1 AND NOT settled AND coalesce(score, 0) >= {C.FUZZY_MIN} AS two FROM y LEFT JOIN best ON best.id = y.id)),
c AS (SELECT *, {_FULL[0]} AS category, {_FULL[1]} AS strength FROM z),
r AS (SELECT *, exact <> 1 AND NOT settled AND NOT two AND category <> 'noise' AS residual FROM c)
SELECT id, entity, category, {_UP(f"CASE WHEN exact = 1 THEN least(0.96, greatest(0.6, 0.9 * strength + 0.1)) WHEN settled THEN 0.9 * strength WHEN two THEN least(0.8, greatest(0.5, (0.5 + 0.3 * (score - {C.FUZZY_MIN}) / (1 - {C.FUZZY_MIN})) * (0.6 + 0.4 * strength))) WHEN residual THEN 0.3 ELSE least(0.75, greatest(0.35, 0.5 + 0.3 * (strength - 0.5) / 0.5)) END", 3)} AS confidence, CASE WHEN exact = 1 OR settled THEN 1 WHEN residual THEN 3 ELSE 2 END AS tier,
CASE WHEN exact = 1 THEN only_matched WHEN settled AND category = 'new-settlement' THEN unknown_place WHEN two THEN win END AS matched_on, hazard_hits, warning_hits, negative_hits, noise_hits, status_hits, unknown_place FROM r"""
SQL = {
    "normalize_text": f"SELECT doc_id, md5({_NORM}) AS digest, length({_NORM}) AS n FROM documents",
    "trigram_tf": f"WITH {_SNIP}, {_vectors('snip')} SELECT id, distinct_grams, {_UP('norm')} AS norm FROM norms",
    "trigram_rows": f"WITH snip AS (SELECT doc_id AS id, text FROM documents), {_vectors('snip')} SELECT id, count(*) AS distinct_grams, CAST(sum(tf) AS BIGINT) AS grams, CAST(max(tf) AS INTEGER) AS most, arg_max(gram, (tf, gram)) AS top FROM v GROUP BY id",
    "trigram_cosine_pairs": f"WITH {_SNIP}, {_vectors('snip')} SELECT p.id, {_UP('coalesce(dot, 0) / (p.norm * q.norm)')} AS cosine FROM norms p JOIN norms q ON q.id = p.id + 1 LEFT JOIN (SELECT x.id, sum(x.tf * y.tf) AS dot FROM v x JOIN v y ON y.id = x.id + 1 AND y.gram = x.gram GROUP BY 1) d ON d.id = p.id",
    "candidate_pairs": _PAIRS + "SELECT a, b FROM pairs",
    "scored_pairs": _PAIRS + "SELECT * FROM scored",
    "ambiguous_pairs": _PAIRS + f"SELECT a, b, p FROM scored WHERE p >= {C.AMBIGUOUS_LOW} AND p < {C.ADMIT}",
    "ambiguous_top": _PAIRS + f"SELECT a, b, p FROM scored WHERE p >= {C.AMBIGUOUS_LOW} AND p < {C.ADMIT} ORDER BY p DESC, a, b LIMIT {C.TOP_AMBIGUOUS}",
    "components": _WHOLE + f", links AS (SELECT a, b FROM scored WHERE p >= {C.ADMIT} UNION ALL SELECT b, a FROM scored WHERE p >= {C.ADMIT}), reach AS (SELECT id, id AS other FROM doc_reports UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other) SELECT id, min(other) AS component FROM reach GROUP BY 1",
    "clusters": _WHOLE + _CLUSTERS,
    "clusters_in_batches": _WHOLE + _CLUSTERS,
    "simulated_ambiguous": _PAIRS + f""", every AS (SELECT a, b, p, NOT (p >= {C.AMBIGUOUS_LOW} AND p < {C.ADMIT}) AS forced, FALSE AS made_up FROM scored UNION ALL SELECT min(id), max(id), {(C.AMBIGUOUS_LOW + C.ADMIT) / 2}, TRUE, TRUE FROM (SELECT id FROM doc_reports ORDER BY id LIMIT 2) HAVING count(*) = 2)
SELECT a, b, CASE WHEN forced THEN {(C.AMBIGUOUS_LOW + C.ADMIT) / 2} ELSE p END AS p, p AS original_p, forced FROM every ORDER BY made_up, forced, CASE WHEN forced THEN abs(p - {(C.AMBIGUOUS_LOW + C.ADMIT) / 2}) ELSE -p END, a, b LIMIT 1""",
    "outcome_table": f"""WITH levels AS (SELECT g.l AS geo, t.l AS time, x.l AS text, s.l AS source FROM {', '.join(f"(SELECT unnest({list(t)}) AS l) AS {n}" for n, t in zip('gtxs', C.MATCH_TABLE.values(), strict=True))}), r AS (SELECT *, {_RATIO} AS ratio FROM levels),
q AS (SELECT geo, time, text, source, {_UP(f"{C.PRIOR_MATCH / (1 - C.PRIOR_MATCH)!r} * exp(ratio) / (1 + {C.PRIOR_MATCH / (1 - C.PRIOR_MATCH)!r} * exp(ratio))")} AS p FROM r) SELECT *, CASE WHEN p >= {C.ADMIT} THEN 'admit' WHEN p >= {C.AMBIGUOUS_LOW} THEN 'ambiguous' ELSE 'reject' END AS verdict FROM q""",
    "relevant_documents": f"SELECT doc_id, length(h) >= 60 AND ({' OR '.join(f"contains(h, '{w}')" for w in [*lexicons.EVENTS, 'thanedble', 'inwhorst'])}) AS relevant FROM (SELECT doc_id, lower(' ' || coalesce(text, '')) AS h FROM documents)",
    "unknown_places": _PLACES,
    "triage_reports": _TRIAGE,
    "lexicon_hits": f"WITH {_COUNTS} SELECT * FROM counts",
    "triage_category": f"""WITH {_COUNTS}, x AS (SELECT *, doc_id % 3 <> 0 AS named, doc_id % 2 = 0 AS official, negative > 0 OR (warning > 0 AND strong = 0) AS veto, strong > 0 OR (weak >= 2 AND warning = 0) AS real FROM counts)
SELECT doc_id, CASE WHEN noise > 0 AND hazard = 0 OR hazard = 0 AND strong + weak = 0 THEN 'noise' WHEN named AND real AND NOT veto THEN 'corroboration-candidate' WHEN negative > 0 OR hazard > 0 THEN 'hazard-signal' ELSE 'noise' END AS category,
CAST(CASE WHEN noise > 0 AND hazard = 0 THEN 0.95 WHEN hazard = 0 AND strong + weak = 0 THEN 0.85 WHEN named AND real AND NOT veto THEN CASE WHEN official THEN 0.95 ELSE 0.88 END WHEN negative > 0 THEN CASE WHEN named THEN 0.9 ELSE 0.7 END WHEN hazard > 0 THEN CASE WHEN named THEN 0.85 ELSE 0.7 END ELSE 0.6 END AS DOUBLE) AS strength FROM x""",
    "tier1_matches": f"WITH {_WINDOWS}, {_VARIANTS} SELECT id, entity, count(*) AS n FROM windows JOIN variants ON norm = win WHERE coalesce(after NOT IN {_FEATURE}, TRUE) GROUP BY 1, 2",
    "tier2_best": f"""WITH {_WINDOWS}, {_VARIANTS}, w AS (SELECT DISTINCT id, win FROM windows WHERE k <= 3 AND length(win) >= 4 AND coalesce(after NOT IN {_FEATURE}, TRUE) AND NOT list_has_any(own, {_FEATURE.replace("(", "[").replace(")", "]")})),
wg AS (SELECT win, substr(p, i, 3) AS gram, count(*) AS tf FROM (SELECT win, p, unnest(generate_series(1, length(p) - 2)) AS i FROM (SELECT DISTINCT win, '  ' || win || '  ' AS p FROM w)) GROUP BY 1, 2), wn AS (SELECT win, sqrt(sum(tf * tf)) AS norm FROM wg GROUP BY 1),
vg AS (SELECT entity, norm AS variant, substr(p, i, 3) AS gram, count(*) AS tf FROM (SELECT entity, norm, p, unnest(generate_series(1, length(p) - 2)) AS i FROM (SELECT entity, norm, '  ' || norm || '  ' AS p FROM variants)) GROUP BY 1, 2, 3), vn AS (SELECT entity, variant, sqrt(sum(tf * tf)) AS norm FROM vg GROUP BY 1, 2),
s AS (SELECT wg.win, vg.entity, vg.variant, sum(wg.tf * vg.tf) AS dot FROM wg JOIN vg ON vg.gram = wg.gram GROUP BY 1, 2, 3), best AS (SELECT s.win, s.entity, max(dot / (wn.norm * vn.norm)) AS score FROM s JOIN wn ON wn.win = s.win JOIN vn ON vn.entity = s.entity AND vn.variant = s.variant GROUP BY 1, 2)
SELECT id, entity, {_UP("max(score)")} AS score FROM w JOIN best ON best.win = w.win GROUP BY 1, 2 HAVING max(score) >= {C.FUZZY_MIN}""",
}
QUERIES = {f.__name__: f for f in (normalize_text, trigram_tf, trigram_rows, trigram_cosine_pairs, candidate_pairs, scored_pairs, outcome_table, ambiguous_pairs, ambiguous_top, components, clusters, clusters_in_batches, simulated_ambiguous, lexicon_hits, triage_category, tier1_matches, tier2_best, triage_reports, relevant_documents, unknown_places)}
