"""Clusters of whole jobs: unresolved reports are compared however many they are."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tacet import config as C
from tacet.functions import text as T
from tacet.operators import increments, linkage, sweep
from tacet.plans import text_queries

H = C.HOUR_MS
DATA = "/root/testdata/sf0.001"  # four of its 200 reports are unresolved


def _frames(spark, n, seed):
    """Reports, of which a third are unresolved, edges, and the (a, b) to be compared, found by trying all."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 8))) for _ in range(60)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 14))) if k % 23 else "" for k in range(n)]
    hours = [int(h) for h in np.where(rng.random(n) < 0.3, 200, rng.integers(0, 900, n))]  # many at the same time
    rows = [(k, None if k % 3 == 1 else k % 7, hours[k] * H if k % 31 else None, "xy"[k % 2], "", t) for k, t in enumerate(texts)]
    reports = spark.createDataFrame(rows, "id bigint, entity bigint, t bigint, source_type string, title string, text string").repartition(3)
    columns = T.count_grams(pa.array([f"  {t}  " for t in texts]))
    v = [dict(zip(g, m, strict=True)) if t else {} for t, g, m in zip(texts, columns.field("grams").to_pylist(), columns.field("tf").to_pylist(), strict=True)]
    expect = set()
    for a in range(n):
        for b in range(a + 1, n):
            (_, ea, ta, *_), (_, eb, tb, *_) = rows[a], rows[b]
            if ta is None or tb is None or abs(ta - tb) > C.TIME_WINDOW_H * H:
                continue
            if ea is None or eb is None:
                norms = (sum(x * x for x in v[a].values()) * sum(x * x for x in v[b].values())) ** 0.5
                if not norms or sum(x * v[b].get(g, 0) for g, x in v[a].items()) / norms < C.TEXT_BLOCK:
                    continue
            elif abs(ea - eb) > 1:
                continue
            expect.add((a, b))
    return reports, spark.createDataFrame([(i, i + 1) for i in range(6)] + [(i + 1, i) for i in range(6)], "src bigint, dst bigint"), expect


@pytest.mark.parametrize(("chunk", "unit"), [(256, 1 << 12), (5, 8), (1, 1)])  # one chunk, and chunks of which many reach a row
def test_unresolved_reports_are_compared_however_many(spark, monkeypatch, chunk, unit):
    monkeypatch.setattr(sweep, "CHUNK", chunk)
    monkeypatch.setattr(sweep, "UNIT", unit)
    monkeypatch.setattr(C, "MAX_UNRESOLVED", 3)
    reports, edges, expect = _frames(spark, 120, 5)
    got = [(r.a, r.b) for r in linkage.scored_pairs(reports, edges, whole=True).collect()]
    assert len(got) == len(set(got)) and set(got) == expect
    assert not linkage.scored_pairs(reports.where("entity is not null").limit(0), edges, whole=True).count()


def test_pairs_of_new_reports_alone(spark, monkeypatch):
    monkeypatch.setattr(sweep, "CHUNK", 7)
    reports, edges, expect = _frames(spark, 90, 6)
    got = {(r.a, r.b) for r in linkage.scored_pairs(reports.selectExpr("*", "id % 4 < 2 AS held"), edges, held="held", whole=True).collect()}
    assert got == {(a, b) for a, b in expect if a % 4 > 1 or b % 4 > 1}


def test_batches_keep_the_pairs_of_unresolved_reports(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_UNRESOLVED", 12)  # the first batch has fewer
    monkeypatch.setattr(sweep, "CHUNK", 7)
    reports, edges, expect = _frames(spark, 120, 7)
    scored = linkage.scored_pairs(reports, edges, whole=True).collect()
    held = increments.begin(reports.where("id % 5 = 0"), edges, whole=True)
    for batch in ("id % 5 in (1, 4)", "id % 5 in (1, 4)", "id % 5 in (0, 2, 3)"):  # the second has come before, the last in part
        held = increments.extend(held, reports.where(batch), edges)
    assert held.loose and held.whole and sorted(map(str, held.scored.collect())) == sorted(map(str, scored))
    assert {(r.a, r.b) for r in scored} == expect
    one = linkage.clusters(reports, spark.createDataFrame(scored))
    assert sorted(map(str, held.clusters().collect())) == sorted(map(str, one.collect()))


def test_a_task_holds_one_chunk(spark, monkeypatch):
    """Rows that reach a chunk are dealt to units of some UNIT rows; loose rows at one time to chunks of CHUNK."""
    monkeypatch.setattr(sweep, "UNIT", 50)
    chunks = sweep.Chunks([(0, 0), (0, 8), (500, 16)], [0, 0, 700], 100)
    t = np.array([0] * 400 + [300] * 10 + [650] * 30)
    n = np.zeros(3, np.int64)
    for batch in chunks.counted([pa.record_batch([pa.array(t)], ["t"])]):
        n[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    assert n.tolist() == [400, 400, 30]
    chunks.deal(n)
    assert chunks.units.tolist() == [8, 8, 1]
    ids = np.arange(len(t))
    places = chunks.places(pa.array(ids), pa.array(t), pa.array(ids == 9)).to_pylist()
    assert [p["to"] for p in places[9] if p["few"]] == list(range(8, 16))  # all units of its chunk
    assert not places[405] and [p["to"] for p in places[420]] == [16]
    met = np.bincount([p["to"] for one in places for p in one if not p["few"]])
    assert met[:8].sum() == met[8:16].sum() == 400 and met.max() < 100


def _against_sql(spark, query):
    got = sorted(str(tuple(r)) for r in text_queries.QUERIES[query](spark, DATA).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    return got, sorted(str(tuple(r)) for r in con.execute(text_queries.SQL[query]).fetchall())


@pytest.mark.parametrize("query", ["clusters", "clusters_in_batches", "components"])
def test_results_do_not_depend_on_how_many_are_unresolved(spark, monkeypatch, query):
    expect = _against_sql(spark, query)
    monkeypatch.setattr(C, "MAX_UNRESOLVED", 3)
    assert _against_sql(spark, query) == expect and expect[0] == expect[1]
    assert "entity IS NULL) BETWEEN" not in text_queries.SQL[query]
