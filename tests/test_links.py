"""Linkage, refinement of components, and triage."""

import collections
import itertools
import random
import time
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tacet import config as C
from tacet.functions import text as T
from tacet.operators import graph, linkage, triage
from tacet.plans import text_queries

H = C.HOUR_MS


def test_outcome_table():
    t = {r[:4]: r[4:] for r in linkage.outcome_table()}
    assert len(t) == 96 and [sum(v == k for _, v in t.values()) for k in ("admit", "ambiguous", "reject")] == [10, 4, 82]
    assert t["same", "lt6h", "high", "same"] == (0.9861, "admit") and t["adjacent", "lt6h", "high", "diff"] == (0.5023, "ambiguous")
    for f, levels in C.MATCH_TABLE.items():
        assert sum(m for m, _ in levels.values()) == pytest.approx(1), f


def _bridges(nodes, edges):
    def parts(es):
        root = {v: v for v in nodes}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b, *_ in es:
            root[find(a)] = find(b)
        return len({find(v) for v in nodes})

    return sorted(n for n in range(len(edges)) if parts(edges[:n] + edges[n + 1 :]) > parts(edges))


def test_bridges_and_refinement():
    rng = random.Random(5)
    for _ in range(60):
        nodes = list(range(rng.randint(2, 12)))
        edges = [(a, b, rng.random()) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.25]
        assert sorted(graph.bridges(nodes, edges)) == _bridges(nodes, edges)
    two = [(0, 1, 0.9), (1, 2, 0.9), (0, 2, 0.9), (3, 4, 0.9), (4, 5, 0.9), (3, 5, 0.9)]
    assert graph.refine(list(range(6)), [*two, (2, 3, 0.62)]) == [[0, 1, 2], [3, 4, 5]]
    assert graph.refine(list(range(6)), [*two, (2, 3, 0.93)]) == [[0, 1, 2, 3, 4, 5]]
    assert graph.refine([0, 1, 2], [(0, 1, 0.9), (1, 2, 0.61)]) == [[0, 1, 2]]


@pytest.mark.parametrize("few", [0, 1000])
def test_components(spark, few):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250)]
    got = {r.v: r.c for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint"), few=few).collect()}
    assert {got[i] for i in range(41)} == {0} and got[101] == 100 and got[300] == got[250] == 200
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint"), few=few).count() == 0


def test_text(spark):
    df = spark.createDataFrame([(1, "  Éàñ—The  RIVER!"), (2, None), (3, "éx")], "id bigint, text string")
    assert [r[0] for r in df.orderBy("id").select(T.normalize("text")).collect()] == ["ean the river", "", "ex"]
    v = {r.id: r for r in T.vectors(df, F.col("text")).collect()}
    assert set(v) == {1, 3} and len(v[3].vector.grams) == 4 and v[3].vector.tf == [1] * 4 and v[3].norm == 2
    a, b = (v[i] for i in (1, 3))
    grams = lambda s: {s[i : i + 3]: s.count(s[i : i + 3]) for i in range(len(s) - 2)}
    one, two = grams("  ean the river  "), grams("  ex  ")
    want = sum(n * two.get(g, 0) for g, n in one.items()) / (sum(n * n for n in one.values()) ** 0.5 * 2)
    pair = spark.createDataFrame([(a.vector, b.vector), (a.vector, None)], f"a {T.VECTOR}, b {T.VECTOR}")
    got = [r[0] for r in pair.select(T.cosine(F.col("a"), F.col("b"), F.lit(a.norm), F.when(F.col("b").isNotNull(), b.norm))).collect()]
    assert got == [pytest.approx(want), 0.0] and want > 0


def test_trigrams_as_a_table_function(spark):
    T.register(spark)
    texts = ["  Éàñ—The  RIVER! the the", None, "", "éx", "it's ---", "?!"]
    spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").createOrReplaceTempView("some_texts")
    x = spark.sql("SELECT id, t.gram, t.tf FROM some_texts, LATERAL trigrams(text) AS t")
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hashpartitioning" not in plan
    want = set()
    for i, norm in ((0, "ean the river the the"), (3, "ex"), (4, "it s")):
        p = f"  {norm}  "
        all_ = [p[k : k + 3] for k in range(len(p) - 2)]
        want |= {(i, g, all_.count(g)) for g in all_}
    assert {tuple(r) for r in x.collect()} == want and x.count() == len(want)


def test_trigrams_of_a_long_text_take_one_pass(spark):
    T.register(spark)
    text = "".join(random.Random(2).choices("abcdefgh ", k=600_000))
    frame = spark.createDataFrame([(text,)], "text string").cache()
    frame.count()
    begin = time.monotonic()
    got = {r.gram: r.tf for r in spark.sql("SELECT t.gram, t.tf FROM {docs}, LATERAL trigrams(text) AS t", docs=frame).collect()}
    assert time.monotonic() - begin < 20  # a position that is counted from the start each time takes minutes
    p = "  " + " ".join(text.split()) + "  "
    assert got == collections.Counter(p[k : k + 3] for k in range(len(p) - 2))


def test_trigrams_of_a_batch_are_counted_in_slices():
    rng = random.Random(3)
    texts = [f"  {''.join(rng.choices('abcdefgh ', k=rng.choice([0, 3, 4000, 9000])))}  " for _ in range(1500)] + [None, ""]
    batch = pa.array(texts)
    tracemalloc.start()
    got = T.count_grams(batch)
    dots = T.dot_products(got.slice(1), got.slice(0, len(got) - 1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6  # all at once take five times that
    for k in [*range(0, 1500, 100), 1500, 1501]:
        n = collections.Counter((texts[k] or "")[i : i + 3] for i in range(len(texts[k] or "") - 2))
        assert sorted(got[k].as_py()["tf"]) == sorted(n.values()) and got[k].as_py()["grams"] == sorted(got[k].as_py()["grams"])
        before = dict(zip(*got[k - 1].as_py().values(), strict=True)) if k else {}
        assert not k or dots[k - 1].as_py() == sum(t * before.get(g, 0) for g, t in zip(*got[k].as_py().values(), strict=True))
    assert len(T.count_grams(pa.array([], pa.string()))) == 0 and len(T.dot_products(got.slice(0, 0), got.slice(0, 0))) == 0


@pytest.mark.parametrize("query", [text_queries.lexicon_hits, text_queries.triage_category])
def test_a_text_is_normalised_once_for_all_lexicons(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1


def test_similar_names_by_kernel_and_by_join(spark):
    """The kernel for small gazetteers and the joins for large ones give the same scores."""
    rng = random.Random(9)
    names = ["Thanedble", "Erndble east", "Inwhorst", "a ba", "Lower Long Name Of Five"]
    words = [w for n in names for w in n.lower().split()] + ["river", "valley", "xy", "q", "inworst", "thanedbel"]
    rows = [(i, None, 0, "news", "", " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(60)]
    reports = spark.createDataFrame(rows, REPORTS).repartition(3)
    v = triage.variants(spark.createDataFrame([(i, n, ["alias"]) for i, n in enumerate(names)], "id bigint, name string, aliases array<string>"))
    for least in (0.55, 0.01):
        one, two = ({(r.id, r.entity): (round(r.score, 9), r.window) for r in triage.fuzzy_scores(reports, v, least, few).collect()} for few in (100, 0))
        assert one == two and len(one) > 20
    exact = {(r.id, r.entity) for r in triage.exact_matches(spark.createDataFrame([(1, None, 0, "news", "", "in lower long name of five people")], REPORTS), v).collect()}
    assert exact == {(1, 4)}


REPORTS = "id bigint, entity bigint, t bigint, source_type string, title string, text string"


def test_linkage(spark):
    same = "Rescue team reached the upper village with relief supplies after the flood"
    rows = [(1, 5, 0, "news", "", same), (2, 5, int(1.5 * H), "official", "", same + " today"), (3, 5, 300 * H, "news", "", same), (4, 6, 2 * H, "news", "", "something else altogether about cricket"), (5, None, H, "news", "", same), (6, 9, None, "news", "", same), (7, 5, 72 * H, "news", "", "zzz")]
    reports = spark.createDataFrame(rows, REPORTS)
    edges = spark.createDataFrame([(5, 6), (6, 5)], "src bigint, dst bigint")
    s = {(r.a, r.b): r for r in linkage.scored_pairs(reports, edges).collect()}
    assert set(s) == {(1, 2), (1, 4), (2, 4), (1, 5), (2, 5), (1, 7), (2, 7), (4, 7)}
    assert s[1, 2].geo == "same" and s[1, 2].p == 0.9816 and s[1, 4].geo == "adjacent" and s[1, 5].geo == "unknown" and s[1, 7].time == "beyond"
    c = linkage.clusters(reports, linkage.scored_pairs(reports, edges)).collect()
    by = {tuple(r.report_ids): r for r in c}
    assert by[1, 2, 5].cluster_id == "cl-001" and by[1, 2, 5].entity == 5 and by[1, 2, 5].source_diversity == 2 and by[3,].confidence == 0.5
    forced = linkage.simulate_ambiguous(linkage.scored_pairs(reports, edges)).first()
    assert forced.p == pytest.approx(0.525) or not forced.forced


def test_too_many_unresolved(spark):
    reports = spark.createDataFrame([(k, None, 0, "news", "", "same text here") for k in range(C.MAX_UNRESOLVED + 1)], REPORTS)
    edges = spark.createDataFrame([], "src bigint, dst bigint")
    assert linkage.scored_pairs(reports, edges).count() == 0


GAZETTEER = [(1, "Trishuli Bazar", ["Trishuli"]), (2, "Betrawati", []), (3, "Dhunche", ["Dhunchey"])]


def test_triage(spark):
    g = spark.createDataFrame(GAZETTEER, "id bigint, name string, aliases array<string>")
    rows = [
        (1, None, 0, "official", "Rescue reached Betrawati", "Flood: 12 households displaced, relief distributed."),
        (2, None, 0, "news", "Trishuli river rose", "Water level of the Trishuli river is rising, warning issued."),
        (3, None, 0, "news", "Cricket final", "The cricket match fixture was announced."),
        (4, None, 0, "news", "No contact with Dhunche", "Flood: Dhunche has not been reached, no word from residents."),
        (5, None, 0, "social", "Flood", "Debris flow hit Kalikasthan village last night."),
        (6, None, 0, "news", "Flood near Betrawatti", "Landslide and debris near Betrawatti, two missing."),
        (7, None, 0, "news", "Betrawati and Dhunche", "Flood damaged houses in both."),
        (8, None, 0, "news", None, None),
    ]
    got = {r.id: r for r in triage.triage(spark.createDataFrame(rows, REPORTS), g).collect()}
    assert (got[1].entity, got[1].category, got[1].tier, got[1].confidence) == (2, "corroboration-candidate", 1, 0.955)
    assert got[2].category == "hazard-signal" and got[2].entity is None and got[2].tier == 3 and got[2].confidence == 0.3
    assert (got[3].category, got[3].confidence) == ("noise", 0.855)
    assert (got[4].entity, got[4].category) == (3, "hazard-signal") and "no contact" in got[4].negative_hits
    assert (got[5].category, got[5].matched_on, got[5].unknown_place) == ("new-settlement", "Kalikasthan", "Kalikasthan")
    assert (got[6].entity, got[6].tier) == (2, 2) and 0.5 <= got[6].confidence <= 0.8
    assert got[7].entity in (2, 3) and got[7].tier == 2
    assert got[8].category == "noise" and len(got) == 8


def test_outside_classifier(spark):
    """At most so many calls, only offered entities, bounded confidence, failures and reports beyond the limit as incidents."""
    text = "Flood waters rose near thanedbla yesterday and residents fled"
    rows = [(i, None, 0, "news", "", text) for i in range(5)]
    reports = spark.createDataFrame(rows, REPORTS)
    v = triage.variants(spark.createDataFrame([(1, "Thanedble", []), (2, "Erndble", [])], "id bigint, name string, aliases array<string>"))
    found = spark.createDataFrame([(i, None, "hazard-signal", 0.3, 3, None) for i in range(5)], "id bigint, entity bigint, category string, confidence double, tier int, matched_on string")
    seen = []

    def ask(report, offered):
        seen.append((report["id"], offered))
        if report["id"] == 2:
            raise ValueError("no answer")
        return {"entity": offered[0] if report["id"] == 0 else 77, "category": "hazard-signal" if report["id"] == 0 else "odd", "confidence": 5, "why": "w"}

    out, said = triage.ask_outside(found, reports, v, ask, 3)
    got = {r.id: (r.entity, r.category, r.confidence, r.matched_on) for r in out.collect()}
    assert sorted(i for i, _ in seen) == [0, 1, 2] and all(o[0] == 1 for _, o in seen)
    assert got[0] == (1, "hazard-signal", 0.7, "llm:1") and got[1] == (None, "noise", 0.7, "llm:unresolved")
    assert all(got[i] == (None, "hazard-signal", 0.3, None) for i in (2, 3, 4))
    assert {r.id: r.reason.split(":")[0] for r in said.collect()} == {0: "classified", 1: "classified", 2: "error", 3: "budget", 4: "budget"}
