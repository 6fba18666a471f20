"""Operators that must spread one hot entity or one large component over tasks, held against plain folds and loops."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tacet import config as C
from tacet.functions import text as T
from tacet.operators import cadence, graph, increments, linkage, prefixes, sweep, triage
from tacet.sources import shared

H = C.HOUR_MS


def _fold(times, gap):
    out, last = [], None
    for t in sorted(times):
        if last is None or t >= last + gap:
            out.append((t, last))
            last = t
    return out


@pytest.fixture(scope="module")
def hot(spark):
    """Times of four entities, of which one has most, with ties; and of some whose events are rare."""
    rng = np.random.default_rng(3)
    rows = [("hot", int(t)) for t in rng.integers(0, 4000 * H // 10, 6000)] + [("hot", 5)] * 50
    rows += [(f"e{k}", int(t)) for k in range(3) for t in rng.integers(0, 900 * H, 400)] + [(f"r{k}", k * H) for k in range(40)] + [(None, 3), ("none", None)]
    return rows, spark.createDataFrame(rows, "entity string, t bigint").repartition(3)


@pytest.mark.parametrize("parts", [1, 3, 16])
@pytest.mark.parametrize("hours", [0.5, 30.0])  # with the longer one a block is shorter than a gap
def test_coalescing_spreads_a_hot_entity(hot, parts, hours):
    rows, times = hot
    expect = []
    for e in {e for e, t in rows if e is not None and t is not None}:
        expect += [(e, *x) for x in _fold([t for o, t in rows if o == e and t is not None], int(hours * H))]
    got = [(r.entity, r.t, r.previous) for r in cadence.coalesced(times, hours, parts).collect()]
    assert sorted(got, key=str) == sorted(expect, key=str)
    with_gaps = cadence.gaps(cadence.coalesced(times, hours, parts)).collect()
    assert sorted((r.entity, r.t, r.gap_hours) for r in with_gaps) == sorted((e, t, (t - b) / H) for e, t, b in expect if b is not None)


def test_a_hot_entity_lies_in_many_blocks(hot):
    _, times = hot
    first = cadence.settled_blocks(times, H // 2, 16)
    per = {r.block: r["count"] for r in first.where("kind = 'open' and entity = 'hot'").groupBy("block").count().collect()}
    assert len(per) >= 8 and max(per.values()) < 6050 / 4
    assert first.where("kind = 'way'").count() < 100  # what is composed is a small part of the events


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_sweep_splits_a_hot_key(spark, parts):
    rng = np.random.default_rng(7)
    rows = [("hot", int(t), i, bool(i % 5 == 0)) for i, t in enumerate(rng.integers(0, 3000, 900))]
    rows += [(f"k{i % 9}", int(t), 1000 + i, bool(i % 4 == 0)) for i, t in enumerate(rng.integers(0, 3000, 400))] + [("tie", 5, 2000 + i, False) for i in range(30)]
    rows += [("k1", int(t), 1000 + i, True) for i, t in enumerate(rng.integers(0, 3000, 50))]  # ids that are there twice
    frame = spark.createDataFrame(rows, "key string, t bigint, id bigint, moved boolean").repartition(4)
    got = sorted((min(r), max(r)) for r in sweep.near_pairs(frame, 100, parts).collect())
    expect = sorted((min(a[2], b[2]), max(a[2], b[2])) for k, a in enumerate(rows) for b in rows[:k] if a[0] == b[0] and abs(a[1] - b[1]) <= 100 and not (a[3] and b[3]) and a[2] != b[2])
    assert got == expect
    if parts == 40:
        own = {r.to: r["count"] for r in sweep.sent_rows(frame, 100, parts).where("own and key = 'hot'").groupBy("to").count().collect()}
        assert len(own) >= 15 and max(own.values()) < 150
    assert not sweep.near_pairs(frame.limit(0), 100, parts).collect()


def _some_vectors(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8))) for _ in range(120)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 14))) for _ in range(n)]
    return [t if k % 3 else texts[k - k % 2] + " " + words[k % 120] for k, t in enumerate(texts)]


@pytest.mark.parametrize("least", [0.35, 0.8])
def test_prefix_filter_loses_no_pair(least):
    texts = _some_vectors(300, 4)
    columns = T.count_grams(pa.array([f"  {t}  " for t in texts]))
    grams, tf = columns.field("grams").to_pylist(), columns.field("tf").to_pylist()
    norm = [float(np.sqrt(sum(x * x for x in v))) for v in tf]
    few = sweep.Few([(k, 0, grams[k], tf[k], norm[k]) for k in range(0, 300, 10)], least)
    of = np.repeat(np.arange(300), [len(g) for g in grams])
    flat = [np.array([x for v in y for x in v], np.int64) for y in (grams, tf)]
    row, other, cosine = few.similar(of, *flat, np.array(norm), np.zeros(300, np.int64), np.arange(300), 0)
    got = {(int(r), int(o) * 10) for r, o, c in zip(row, other, cosine, strict=True) if c >= least}
    vectors = [dict(zip(g, t, strict=True)) for g, t in zip(grams, tf, strict=True)]
    expect = {(a, b) for a in range(300) for b in range(0, 300, 10) if a != b and sum(n * vectors[b].get(g, 0) for g, n in vectors[a].items()) / (norm[a] * norm[b]) >= least}
    assert got == expect and expect
    tried = len(few.candidates(of, *flat, np.array(norm))[0])
    assert tried < 300 * 30 * (0.9 if least < 0.5 else 0.35)  # of all pairs


def test_a_gazetteer_of_100000_names(spark):
    """Scores of windows against all names, and how few pairs are met on the way."""
    rng = np.random.default_rng(12)
    parts = ["".join(rng.choice(list("abcdefghiklmnoprstuvwxyz"), rng.integers(2, 5))) for _ in range(900)]
    names = sorted({" ".join("".join(rng.choice(parts, 2)) for _ in range(int(rng.integers(1, 3)))) for _ in range(112_000)})[:100_000]
    assert len(names) == 100_000
    gazetteer = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "id bigint, name string").withColumn("aliases", F.array().cast("array<string>"))
    known = shared.keep(triage.variants(gazetteer))
    texts = [f"{names[int(rng.integers(0, 100_000))]} {parts[k]}{'x' * (k % 3)}" for k in range(12)] + ["", "river"]
    reports = spark.createDataFrame([(k, "", t) for k, t in enumerate(texts)], "id bigint, title string, text string")
    got = {(r.id, r.entity): round(r.score, 9) for r in triage.fuzzy_scores(reports, known).collect()}

    columns = T.count_grams(pa.array([f"  {n}  " for n in names]))
    grams, counts = columns.field("grams"), columns.field("tf")
    of = np.repeat(np.arange(len(names)), np.diff(grams.offsets.to_numpy()))
    gram, tf = grams.flatten().to_numpy(), counts.flatten().to_numpy().astype(float)
    norm = np.sqrt(np.bincount(of, tf**2))
    expect = {}
    windows = {(w.id, w.window) for w in triage.windows(reports, 3).collect() if len(w.window) >= 4 and "river" not in (*w.tokens, w.after)}
    for i, window in windows:
        one = T.count_grams(pa.array([f"  {window}  "]))
        weight = np.zeros(T.GRAMS)
        weight[one.field("grams").flatten().to_numpy()] = one.field("tf").flatten().to_numpy()
        score = np.bincount(of, tf * weight[gram]) / (norm * np.sqrt((weight**2).sum()))
        for e in np.flatnonzero(score >= C.FUZZY_MIN).tolist():
            expect[i, e] = max(expect.get((i, e), 0), round(float(score[e]), 9))
    assert got == expect and len(got) > 100
    often = prefixes.frequencies(known)
    assert (often == np.bincount(gram, minlength=T.GRAMS)).all()
    lead = prefixes.prefix(of, gram, tf, norm, often, C.FUZZY_MIN)
    assert (often[gram[lead]]).sum() < 0.5 * often[gram].sum()  # the pairs of all names with each other that a join meets


def test_candidate_pairs_against_all_pairs(spark):
    texts = _some_vectors(240, 9)
    rng = np.random.default_rng(1)
    rows = [(i, None if i % 20 == 3 else 7 if i % 3 else int(rng.integers(0, 12)), int(rng.integers(0, 400)) * H if i % 31 else None, "x", "", t) for i, t in enumerate(texts)]
    edges = [(i, i + 1) for i in range(12)] + [(i + 1, i) for i in range(12)] + [(3, 3)]
    reports = spark.createDataFrame(rows, "id bigint, entity bigint, t bigint, source_type string, title string, text string")
    links = spark.createDataFrame(edges, "src bigint, dst bigint")
    vectors = T.vectors(reports, linkage.snippet())
    columns = T.count_grams(pa.array([f"  {t}  " for t in texts]))
    v = [dict(zip(g, n, strict=True)) for g, n in zip(columns.field("grams").to_pylist(), columns.field("tf").to_pylist(), strict=True)]
    norm = [sum(n * n for n in x.values()) ** 0.5 for x in v]
    expect = set()
    for a in range(240):
        for b in range(a + 1, 240):
            (_, ea, ta, *_), (_, eb, tb, *_) = rows[a], rows[b]
            if ta is None or tb is None or abs(ta - tb) > 72 * H:
                continue
            similar = sum(n * v[b].get(g, 0) for g, n in v[a].items()) / (norm[a] * norm[b]) >= C.TEXT_BLOCK
            if similar if ea is None or eb is None else ea == eb or (ea, eb) in edges:
                expect.add((a, b))
    for parts in (2, 9):
        assert {tuple(r) for r in linkage.candidate_pairs(reports, links, vectors, parts).collect()} == expect


def _many_graphs():
    """Random graphs beside each other: sparse and dense ones, trees, circles, long paths and stars, with parallel edges."""
    rng = np.random.default_rng(6)
    edges, base = [], 0
    for k in range(70):
        n = int(rng.integers(2, 14))
        kind = k % 5
        if kind == 0:
            pairs = [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.3]
        elif kind == 1:
            pairs = [(a, int(rng.integers(0, a))) for a in range(1, n)]
        elif kind == 2:
            pairs = [(a, (a + 1) % n) for a in range(n) if n > 2] + [(0, n), (n, n + 1), (n + 1, n + 2)]
        elif kind == 3:
            pairs = [(a, a + 1) for a in range(60)]
        else:
            pairs = [(0, a) for a in range(1, 40)] + [(1, 2), (5, 50), (50, 51)]
        names = rng.permutation(64) + base  # any order of names
        edges += [(int(min(names[a], names[b])), int(max(names[a], names[b])), round(float(rng.choice([0.61, 0.65, 0.7, 0.75, 0.76, 0.9])), 4)) for a, b in pairs]
        base += 64
    return sorted({(a, b): (a, b, p) for a, b, p in edges}.values())


def test_bridges_by_joins(spark):
    edges = _many_graphs()
    twice = edges + [e for k, e in enumerate(edges) if k % 11 == 0]  # parallel edges
    nodes = sorted({v for a, b, _ in edges for v in (a, b)})
    expect = set(graph.bridges(nodes, twice))
    frame = spark.createDataFrame([(e, a, b) for e, (a, b, _) in enumerate(twice)] + [(10**6, 5, 5)], "e bigint, a bigint, b bigint")
    assert {r.e for r in graph.bridge_edges(frame).collect()} == expect and len(expect) > 100
    forest = {r.e for r in graph.spanning_forest(frame).collect()}
    parts = {r.c for r in graph.components(frame.select("a", "b")).collect()}
    assert len(forest) == len(nodes) - len(parts) and expect <= forest
    assert not graph.bridge_edges(frame.limit(0)).collect()


def test_refinement_by_joins(spark):
    edges = _many_graphs()
    frame = spark.createDataFrame(edges, "a bigint, b bigint, p double")
    labels = graph.components(frame.select("a", "b"))
    by_part = {}
    part = {r.v: r.c for r in labels.collect()}
    for e in edges:
        by_part.setdefault(part[e[0]], []).append(e)
    expect = {}
    for links in by_part.values():
        for side in graph.refine(sorted({v for a, b, _ in links for v in (a, b)}), links):
            expect |= dict.fromkeys(side, side[0])
    for few in (0, 10**6):  # by joins, and by one task
        assert {r.v: r.cluster for r in graph.refined(frame, labels, few=few).collect()} == expect
    assert len(set(expect.values())) > len(by_part) + 20
    assert not graph.refined(frame.limit(0), labels.limit(0), few=0).collect()


def test_small_components_take_few_steps(spark):
    """A large graph of small components is joined up and refined where its edges lie, whatever the sizes of the batches."""
    edges = _many_graphs()
    frame = shared.keep(spark.createDataFrame(edges, "a bigint, b bigint, p double"))
    labels = shared.keep(graph.components(frame.select("a", "b"), few=10**6))
    expect = {r.v: r.c for r in labels.collect()}
    clusters = {r.v: r.cluster for r in graph.refined(frame, labels).collect()}
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    for rows in ("7", "1000"):
        spark.conf.set(size, rows)
        try:
            have = len(shared.kept_tables())
            assert {r.v: r.c for r in graph.components(frame.select("a", "b"), few=300).collect()} == expect
            assert rows == "7" or len(shared.kept_tables()) - have <= 6  # rounds wrote a table each
            have = len(shared.kept_tables())
            assert {r.v: r.cluster for r in graph.refined(frame, labels, few=300).collect()} == clusters
            assert len(edges) > 600 and len(shared.kept_tables()) - have <= 3  # by joins there are dozens
        finally:
            spark.conf.set(size, before)
    rng = np.random.default_rng(2)
    mixed = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 700, (500, 2))], "a bigint, b bigint")  # linked vertices lie anywhere
    whole = {r.v: r.c for r in graph.components(mixed).collect()}
    assert {r.v: r.c for r in graph.components(mixed, few=0).collect()} == whole
    assert {r.v: r.c for r in graph._rounds(shared.keep(mixed.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()), 40).collect()} == whole


def test_texts_are_normalised_and_compared_once(spark):
    reports = spark.createDataFrame([(k, 1, k, "x", "", t) for k, t in enumerate(_some_vectors(20, 3))], "id bigint, entity bigint, t bigint, source_type string, title string, text string")
    plan = T.vectors(reports, linkage.snippet())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9]+") == 1
    scored = linkage.scored_pairs(reports, spark.createDataFrame([], "src bigint, dst bigint"))
    plan = scored.where("p >= 0.6").select("a", "b", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    text = {r.id: r.text for r in reports.collect()}
    grams: dict[int, dict[str, int]] = {k: {} for k in text}
    for k, t in text.items():
        padded = f"  {t.strip()}  "
        for i in range(len(padded) - 2):
            grams[k][padded[i : i + 3]] = grams[k].get(padded[i : i + 3], 0) + 1
    for r in scored.collect():
        x, y = grams[r.a], grams[r.b]
        cosine = sum(n * y.get(g, 0) for g, n in x.items()) / (sum(n * n for n in x.values()) ** 0.5 * sum(n * n for n in y.values()) ** 0.5)
        assert abs(r.text_similarity - cosine) < 1e-4
    assert scored.count() == 190


def test_components_in_batches(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 900, (600, 2))] + [(5, 5), (905, 905)]
    frame = spark.createDataFrame([(*e, int(rng.integers(0, 3))) for e in edges], "a bigint, b bigint, batch int")
    expect = {r.v: r.c for r in graph.components(frame.select("a", "b")).collect()}
    for few in (10**6, 0):
        labels = graph.components(frame.where("batch = 0").select("a", "b"))
        for k in (1, 2, 1):  # a batch that comes again changes nothing
            labels = shared.keep(graph.updated(labels, frame.where(f"batch = {k}").select("a", "b"), few))
        assert {r.v: r.c for r in labels.collect()} == expect and labels.count() == len(expect)
    assert graph.updated(labels, frame.limit(0)).count() == len(expect)


def test_fresh_reports_move_only_if_ids_ask_for_it(spark):
    """Of each id one report and none that is held; reports are written once, and again only where an id comes twice."""
    frame = spark.createDataFrame([(k, 1, k, "x", "", f"text {k}") for k in range(20)], "id bigint, entity bigint, t bigint, source_type string, title string, text string")
    held = frame.where("id < 5")
    for batch, before, written, ids in ((frame, None, 1, range(20)), (frame.where("id >= 5"), held, 1, range(5, 20)), (frame, held, 2, range(5, 20)), (frame.unionByName(held), None, 2, range(20)), (frame.unionByName(frame), held, 3, range(5, 20)), (held, held, 2, [])):
        have = len(shared.kept_tables())
        got = increments._fresh(batch, before)
        assert len(shared.kept_tables()) - have == written
        assert sorted((r.id, r.text) for r in got.collect()) == [(k, f"text {k}") for k in ids]


@pytest.mark.parametrize("most", [200, 8])  # with 8 there are too many unresolved reports from the second batch on
def test_linkage_in_batches(spark, monkeypatch, most):
    monkeypatch.setattr(C, "MAX_UNRESOLVED", most)
    texts = _some_vectors(150, 9)
    texts = [texts[k // 8] if k % 4 else t for k, t in enumerate(texts)]
    rng = np.random.default_rng(2)
    rows = [(i, None if i % 14 == 3 else i // 8 % 5, (i // 8 * 20 + int(rng.integers(0, 30))) * H if i % 31 else None, "xy"[i % 2], "", t) for i, t in enumerate(texts)]
    reports = spark.createDataFrame(rows, "id bigint, entity bigint, t bigint, source_type string, title string, text string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(i + 1, i) for i in range(5)], "src bigint, dst bigint")
    scored = shared.keep(linkage.scored_pairs(reports, edges))
    expect = sorted(map(str, linkage.clusters(reports, scored).collect()))
    held = increments.begin(reports.where("id % 5 = 0"), edges)
    assert held.loose
    for batch in ("id % 5 in (1, 4)", "id % 5 in (1, 4)", "id % 5 in (0, 2, 3)"):  # the second has come before, the last in part
        held = increments.extend(held, reports.where(batch), edges)
    assert sorted(map(str, held.scored.collect())) == sorted(map(str, scored.collect()))
    assert sorted(map(str, held.clusters().collect())) == expect and len(expect) < 130
    assert held.loose == (most == 200) and increments.extend(held, reports.limit(0), edges) is held


def test_batches_leave_no_tables_but_their_linkage(spark):
    texts = _some_vectors(60, 4)
    rows = [(i, i // 8 % 5, i * 10 * H, "x", "", t) for i, t in enumerate(texts)]
    reports = spark.createDataFrame(rows, "id bigint, entity bigint, t bigint, source_type string, title string, text string")
    edges = spark.createDataFrame([(0, 1), (1, 0)], "src bigint, dst bigint")
    before = set(shared.kept_tables())
    held = increments.begin(reports.where("id < 30"), edges)
    first = sorted(map(str, held.clusters().collect()))
    held_tables = set(shared.kept_tables()) - before
    with shared.scratch() as made:
        now = increments.extend(held, reports.where("id >= 30"), edges)
    left = [path for path, _ in made if path in set(shared.kept_tables())]
    assert len(left) == len(now.report_parts) + len(now.scored_parts) + 1 - 2 and len(made) > 2 * len(left)  # parts of before stay where they are
    assert held_tables <= set(shared.kept_tables()) and sorted(map(str, held.clusters().collect())) == first
    scored = shared.keep(linkage.scored_pairs(reports, edges))
    assert sorted(map(str, now.clusters().collect())) == sorted(map(str, linkage.clusters(reports, scored).collect()))


def test_only_held_reports_near_in_time_are_read(spark):
    held = shared.keep(spark.createDataFrame([(i, 1, i * 100 * H, "x", "", "t") for i in range(20)] + [(99, 1, None, "x", "", "t")], "id bigint, entity bigint, t bigint, source_type string, title string, text string"))
    new = held.where("id in (3, 15)")
    low, high = 300 * H, 1500 * H
    near = increments._reached(held, new, low, high)
    got, bins = {r.id for r in near.collect()}, lambda i: i * 100 * H // linkage.WINDOW_MS
    assert got == {i for i in range(20) if any(abs(bins(i) - bins(j)) <= 1 for j in (3, 15))}
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t," in plan and "LessThanOrEqual(t," in plan  # they reach the scan
    assert increments._reached(held, new, None, None).count() == 0
