"""The pipeline's stages one after the other, on an awkward table, against plain expectations."""

import collections

import pytest

import corpus_pipeline as P
from test_operators import _passage



@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = [_passage(200 + k, 120) for k in range(12)]
    shared = _passage(400, 40)
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(base)]
    rows += [(20, base[0], "en", "s0", None), (21, base[1].replace(" ", "  ", 1), None, None, 1), (22, f"{_passage(500, 80)} {shared}", "en", "s1", 1), (23, f"{_passage(501, 80)}\n{shared} tail", "en", None, 1)]
    rows += [(24, "", "en", "s0", 0), (25, None, "en", "s0", None), (26, "to " * 300, "en", "s0", 900), (None, _passage(502, 50), "en", "s2", 1)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(2).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for i, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["quality rules"]) == {*range(12), 20, 21, 22, 23, None}
    assert set(kept["MinHash near-dedup"]) == {*range(12), 22, 23, None}
    cut = kept["substring dedup"]
    assert set(cut) == set(kept["MinHash near-dedup"]) and cut[22] == kept["quality rules"][22]
    assert cut[23] == f"{_passage(501, 80)} tail"
    assert kept["mixing sources"] == cut
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(cut)
    total = collections.Counter()
    for r in pieces:
        total[r.sequence_id] += r.length
    assert max(total.values()) <= 2048


def test_near_stage_takes_copies_from_eight_tenths(spark):
    w = _passage(710, 304).split()
    other = ["changed" if k in (20, 60, 100, 140, 180, 220) else x for k, x in enumerate(w)]
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(other))], "doc_id bigint, text string")
    assert [r.doc_id for r in P.near_stage(spark, docs, "").collect()] == [1]


def test_sequences_follow_the_schedule(spark, tmp_path):
    """Shares of the sources in each prefix of the final sequences are those of the schedule, whatever the order of the files."""
    rows = [(k, _passage(2000 + k, 20 + k * 7 % 60), "a" if k % 10 else "b", 0) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_chars bigint")
    mixed = P.mixing_stage(spark, docs, "").collect()
    source = {r.doc_id: r.source for r in mixed}
    spark.createDataFrame(mixed[::-1], docs.schema).repartition(5).write.parquet(str(tmp_path / "mixed"))
    got = P.packing_stage(spark, spark.read.parquet(str(tmp_path / "mixed")), "").collect()
    size = {r.doc_id: r.doc_tokens for r in got}
    number = {r.doc_id: r.sequence_id for r in got}
    last, total = max(number.values()), sum(size.values())
    assert sorted(set(number.values())) == list(range(last + 1))
    for part in (0.1, 0.2, 0.3, 0.5):
        prefix = [i for i, n in number.items() if n < part * (last + 1)]
        run, want = 0, []
        for r in mixed:
            if run >= part * total:
                break
            run += size[r.doc_id]
            want.append(r.doc_id)
        share = lambda ids: sum(size[i] for i in ids if source[i] == "b") / sum(size[i] for i in ids)
        assert abs(share(prefix) - share(want)) < 0.06


def test_ordered_packing_cuts_segments_in_order(spark):
    from tacet.llm import packing

    rows = [(k, _passage(4000 + k, 15 + k * 11 % 40), k, 0) for k in range(300)][::-1]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _slot bigint, _h bigint").repartition(3)
    got = packing.pack_in_order(docs, packing.tokenizer_path(), limit=512, segment=50).collect()
    assert len(got) == 300 and {r.doc_id for r in got} == set(range(300))
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    assert sorted(by) == list(range(len(by)))
    assert all(sum(r.length for r in s) <= 512 and len({r.doc_id // 50 for r in s}) == 1 for s in by.values())
    least = [min(r.doc_id for r in by[s]) for s in sorted(by)]
    assert least == sorted(least)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length


def test_run_and_empty(spark, folder, tmp_path):
    assert P.run(spark, folder).select("doc_id").distinct().count() == 15
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names}
    assert len(P.STAGES) == 5
