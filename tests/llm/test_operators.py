"""Each operator on small and awkward tables, held against brute force."""

import collections
import hashlib
import math
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tacet.llm import classifier, embeddings, licences, lm, mixing, near, packing, quality, substring, urls

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHAPE = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, doc int, kept boolean, v string, rank double"


def _passage(seed, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    a, b, shared = _passage(1), _passage(2, 90), _passage(3, 30)
    words = a.split()
    words[7] = "other"
    texts = [
        (5, a), (2, a), (9, " ".join(words)), (1, f"{b}\n{shared}"), (7, f"{shared} {_passage(4)}"), (8, ""), (3, None), (None, a), (None, None),
        (4, "one two"), (6, "one  two"), (10, "x " * 200), (11, _passage(5, 4000)), (12, "Licensed under CC BY-NC 4.0. MIT License! The apache\tlicense"), (13, "été naïve <|endoftext|> \U0001f600"),
        (5, a), (14, "\n".join(["same line here"] * 9)), (15, " \t\n "), (16, "y" * 3000),
    ]
    return [(i, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"s{k % 3}", None, "clash", k, True, "x", 1.0) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def _words(t):
    return re.findall(WORD, t or "")


def _key(x):
    return tuple((v is None, str(v)) for v in x)


def test_substring(docs, rows, none):
    owner = {}
    rank = lambda i: math.inf if i is None else i
    for i, t, *_ in rows:
        w = _words(t)
        for j in range(len(w) - 12):
            k = tuple(w[j : j + 13])
            owner[k] = min(owner.get(k, math.inf), rank(i))
    want = []
    for i, t, *_ in rows:
        w = _words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if owner[tuple(w[j : j + 13])] < rank(i):
                gone[j : j + 13] = [True] * 13
        left = " ".join(x for x, g in zip(w, gone) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest()))
    out = substring.remove_repeats(docs, chunk_bytes=600, range_windows=50)
    got = out.collect()
    assert sorted(((r.doc.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=_key) == sorted(want, key=_key)
    assert any(r.n_removed for r in got)
    for r in got:
        assert sum(s.last - s.first for s in r.spans) == r.n_removed
        assert hashlib.sha256(" ".join(_words(r.text)).encode()).hexdigest() == r.kept_sha256
        assert r.doc.n_words == "clash"
    assert substring.remove_repeats(none).count() == 0


@pytest.mark.parametrize("block", [256, 2])
def test_near(docs, rows, none, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    sets = []
    for i, t, *_ in rows:
        w = (t or "").translate(LOWER)
        w = _words(w)
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    n = len(sets)
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(n):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(x)] = find(y)
    want = []
    for x, (i, s) in enumerate(sets):
        ids = [sets[y][0] for y in range(n) if find(y) == find(x) and sets[y][0] is not None]
        c = (min(ids) if ids else None) if s else i
        want.append((i, len(s), c, c == i))
    got = [tuple(r) for r in near.near_duplicates(docs, percent=85).collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)
    assert near.near_duplicates(none).count() == 0


def test_one_row_of_each_group_stays(spark):
    """Copies without an id, ids with several texts, and rows that occur twice."""
    a, b, c = _passage(30, 80), _passage(31, 80), _passage(32, 80)
    table = [(5, a), (3, a), (None, a), (None, b), (None, b), (None, b + " "), (7, c), (7, c), (7, a), (8, ""), (8, ""), (9, None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(table)], "doc_id bigint, text string, `k.v` int").repartition(3)
    got = near.one_of_each(df)
    assert got.columns == df.columns
    left = collections.Counter((r.doc_id, (r.text or "").strip()) for r in got.collect())
    assert left == {(3, a): 1, (None, b): 1, (7, c): 1, (8, ""): 2, (9, ""): 1}


def test_lone_star_and_pairs(spark):
    """Chains whose ends are not alike still come together, also in families cut into blocks."""
    base = _passage(20, 300).split()
    texts = []
    for k in range(40):
        w = list(base)
        w[: k * 2] = [f"new{k}x{j}" if j >= (k - 1) * 2 else f"new{j // 2 + 1}x{j}" for j in range(k * 2)]
        texts.append((k, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    old = near.BLOCK
    try:
        near.BLOCK = 8
        got = {r.doc_id: r.component_id for r in near.near_duplicates(df).collect()}
    finally:
        near.BLOCK = old
    assert set(got.values()) == {0}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_pairs_compare_a_left_row_with_every_right_row(order):
    """A left-only row meets the block's own left rows wherever the rows of the group lie."""
    import pyarrow as pa

    a = np.unique(np.random.default_rng(6).integers(0, 2**63, 400).astype(np.uint64) * np.uint64(2))
    rows = [(1, 0, a[:380]), (2, 0, a[20:]), (2, 1, a[20:])]  # v, kind, set: 2 is left and also in the block
    rows = [rows[k] for k in order]
    table = pa.table({"v": pa.array([r[0] for r in rows], pa.int64()), "kind": pa.array([r[1] for r in rows], pa.int32()), "shingles": pa.array([r[2].tobytes() for r in rows], pa.binary())})
    got = near._pairs(85)(table).to_pylist()
    assert [{r["a"], r["b"]} for r in got] == [{1, 2}]


def test_crowded_families(spark, monkeypatch):
    """Several clusters that boilerplate glues into one family, in blocks of a few rows, against brute force."""
    monkeypatch.setattr(near, "BLOCK", 4)
    rng = np.random.default_rng(12)
    glue = _passage(800, 400).split()
    rows = []
    for c in range(6):
        own = _passage(810 + c, 90).split()
        for k in range(7):
            w = glue[: 330 + 10 * (c % 3)] + own
            for at in rng.integers(0, len(w), 2):
                w[int(at)] = f"x{c}{k}"
            rows.append((c * 10 + k, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in rows}
    want = {}
    for i in sorted(sets):
        todo, seen = [i], {i}
        while todo:
            x = todo.pop()
            for y in sets:
                if y not in seen and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y]):
                    seen.add(y)
                    todo.append(y)
        want[i] = min(seen)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in near.near_duplicates(df, percent=85).collect()} == want
    assert 1 < len(set(want.values())) < 42


def test_near_limits_follow_the_percentage(spark):
    """At 80 percent 4 shingles against 5 are linked, and so are pairs between 0.80 and 0.85; at 85 neither is."""
    assert (near.tiny(85), near.rows_per_band(85)) == (5, 7)
    assert near.tiny(80) == 3 and (1 - 0.8 ** near.rows_per_band(80)) ** (256 // near.rows_per_band(80)) <= 1e-6
    short, rows = "one two three four five six seven eight".split(), []
    rows += [(1, " ".join(short)), (2, " ".join([*short, "nine"]))]
    for k in range(40):
        w = _passage(700 + k, 304).split()
        other = list(w)
        for at in (20, 60, 100, 140, 180, 220):  # 270 of 330 shingles: 0.818
            other[at] = "changed"
        rows += [(100 + 2 * k, " ".join(w)), (101 + 2 * k, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id for r in near.near_duplicates(df, percent=80).collect() if r.kept} == {1, *range(100, 180, 2)}
    assert all(r.kept for r in near.near_duplicates(df, percent=85).collect())


def test_estimates():
    rng = np.random.default_rng(0)
    whole = np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64) * np.uint64(2))
    for share in (0.5, 0.8, 0.95):
        n = int(1000 * (1 + share) / 2 / share) if share else 0
        both = int(n * 2 * share / (1 + share))
        a, b = np.sort(whole[:n]), np.sort(np.concatenate([whole[:both], whole[n : 2 * n - both]]))
        j, _ = near.estimates(near.registers(a), len(a), near.registers(b)[None, :], np.array([len(b)]))
        assert abs(j[0] - both / (2 * n - both)) < 0.16


def test_quality(docs, rows, none):
    got = quality.quality(docs).collect()
    want = []
    for i, t, *_ in rows:
        t = t or ""
        w, seen, dup = _words(t), set(), 0
        for line in t.split("\n"):
            if _words(line):
                dup += line in seen
                seen.add(line)
        count = collections.Counter(tuple(w[j : j + 8]) for j in range(len(w) - 7))
        hit = [False] * len(w)
        for j in range(len(w) - 7):
            if count[tuple(w[j : j + 8])] > 1:
                hit[j : j + 8] = [True] * 8
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(hit), len(w) < 20 or 100 * sum(hit) > 30 * len(w)))
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=_key) == sorted(want, key=_key)
    assert not any(r.kept and r.base_failed for r in got)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == sorted(str(r.doc_id) for r in got if r.kept)
    assert quality.quality(none).count() == 0 and quality.filter_documents(none).count() == 0


def _plain_limit(values):
    """A threshold from exact quantiles, as the docstring words it."""
    v = sorted(values)
    q = [v[math.ceil(i / 100 * len(v)) - 1] for i in range(1, 100)]
    best, gap = -1.0, 0.0
    for k in range(1, 99):
        low, high = sum(q[:k]) / k, sum(q[k:]) / (99 - k)
        if k * (99 - k) * (high - low) ** 2 > best + 1e-15:
            best, gap = k * (99 - k) * (high - low) ** 2, (q[k - 1] + q[k]) / 2
    return max(gap, q[49] + quality.SPREADS * (q[74] - q[49]) / 0.6745)


def test_quality_thresholds_and_verdicts(spark):
    """Thresholds follow the spread of their group, and all verdicts equal those from exact quantiles."""
    rng = np.random.default_rng(8)
    table = []
    for k in range(390):
        source, loud = ("calm", 0.02) if k % 3 else ("loud", 0.2)
        words = [w + "!" if rng.random() < loud else w.upper() if rng.random() < loud / 2 else w for w in _passage(100 + k, int(rng.integers(30, 120))).split()]
        table.append((k, " ".join(words), "en" if k % 5 else None, source))
    table += [(1000, "*** ".join(_passage(900, 80).split()), "en", "calm"), (1001, _passage(901, 80).upper(), "en", "calm"), (1002, "!! ".join(_passage(902, 80).split()), "en", "rare")]
    df = spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r.asDict() for r in quality.quality(df).collect()}
    rate = lambda r, c: max(r[quality.RATES[c][0]] - 2 * math.sqrt(r[quality.RATES[c][0]]), 0) / max(r[quality.RATES[c][1]], 1)
    groups = collections.defaultdict(list)
    for r in got.values():
        for key in ((), (r["lang"],), (r["lang"], r["source"])):
            groups[key].append(r)
    for c in quality.RATES:
        top = {k: _plain_limit([rate(r, c) for r in g]) for k, g in groups.items()}
        for k in sorted(groups, key=len):
            if k:
                n = len(groups[k])
                top[k] = (n * top[k] + quality.SHRINK * top[k[:-1]]) / (n + quality.SHRINK)
        for r in got.values():
            assert abs(r[f"top_{c}"] - top[r["lang"], r["source"]]) < 1e-9
            assert (c in r["failed"]) == (rate(r, c) > r[f"top_{c}"])
    assert all(r["kept"] == (not r["failed"] and not r["base_failed"]) for r in got.values())
    assert got[0]["top_marks_per_char"] > 1.5 * got[1]["top_marks_per_char"]
    assert not any(got[i]["kept"] for i in (1000, 1001, 1002)) and sum(r["kept"] for r in got.values()) > 370
    assert all(quality.quality(df.drop("lang", "source")).select("top_marks_per_char").distinct().count() == 1 for _ in "1")


def test_quality_limits_of_sketches_stay_within_their_error(spark):
    """A sketch of many rows gives a quantile whose rank is off by less than a hundredth."""
    from pyspark.sql import functions as F

    x = spark.range(60_000).select((F.xxhash64("id") % 1_000_000).cast("double").alias("v"))
    q = x.repartition(7).agg(F.kll_sketch_agg_double("v", F.lit(quality.SKETCH_K)).alias("s")).select(F.kll_sketch_get_quantile_double("s", F.array(*map(F.lit, quality.LEVELS))).alias("q")).first().q
    v = np.sort(np.array([r.v for r in x.collect()]))
    assert np.abs(np.searchsorted(v, q) / len(v) - quality.LEVELS).max() < 0.01


def test_columns_with_odd_names(spark):
    """Names with dots and names of keywords pass through the stages that carry whole rows."""
    df = spark.createDataFrame([(1, _passage(1), "en", "s", 5, "x"), (2, None, None, None, 6, None)], "doc_id bigint, text string, lang string, source string, `a.b` int, `select` string")
    assert quality.filter_documents(df).columns == df.columns
    assert {r.doc["a.b"] for r in substring.remove_repeats(df).collect()} == {5, 6}
    assert mixing.mix(df).columns == df.columns and mixing.mix(df).count() == 2


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, limit=256).collect()
    seqs, tokens = collections.defaultdict(list), collections.Counter()
    for r in pieces:
        seqs[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id] += r.length
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    want, crcs = collections.Counter(), collections.Counter()
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] += len(ids)
        for s in range(0, len(ids), 256):
            crcs[i, s, zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes()), len(ids)] += 1
    assert tokens == want
    assert collections.Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in pieces) == crcs
    assert packing.pack(none, path).count() == 0


def test_packing_encodes_rare_words_by_the_slice(monkeypatch):
    """A word that no other text has costs no call of its own."""
    import tiktoken
    from tokenizers import Tokenizer

    calls, real = [], tiktoken.Encoding

    class Counted:
        def __init__(self, *args, **named):
            encode = real(*args, **named)._core_bpe.encode_ordinary
            self._core_bpe = SimpleNamespace(encode_ordinary=lambda s: calls.append(s) or encode(s))

    monkeypatch.setattr(tiktoken, "Encoding", Counted)
    path = packing.tokenizer_path()
    tok = Tokenizer.from_file(path)
    texts = [" ".join(f"w{i * 1000 + j:x}en," for j in range(1000)) for i in range(40)]
    flat, total = packing.Encoder(path).encode(pa.array(texts), 1)
    assert flat.tolist() == [x for t in texts for x in [*tok.encode(t, add_special_tokens=False).ids, 1]]
    assert len(total) == 40 and len(calls) <= 80


def test_packing_encodes_odd_texts_as_the_tokenizer():
    """White space of all lengths and kinds, other letters, special tokens, slices and their ends."""
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tok, rng = Tokenizer.from_file(path), np.random.default_rng(3)
    parts = ["a", "the", "Ünï", "²³½", "12", "'s", "don't", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x00", "\x1c", "\x85", "\xa0", "\u3000", "\u024f", "\u0250", "слово", "中文", "“", "—", "😀", "<|endoftext|>", "%%%", ","]
    texts = ["".join(rng.choice(parts, rng.integers(0, 40))) for _ in range(2000)]
    texts += [None, "", " ", "  ", "ab " * 50_000, "a  b" * 40_000, "word " * 20_000 + "Ж" + " word" * 20_000, "x" * 100_000, " " * 1_200_000 + "x"]
    flat, total = packing.Encoder.of(path).encode(pa.array(texts), 1)
    ends = np.cumsum(total)
    for t, a, b in zip(texts, ends - total, ends, strict=True):
        assert flat[a:b].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 1]
    assert ends[-1] == len(flat)


def test_patterns():
    rng = np.random.default_rng(1)
    histogram = {int(k): int(rng.integers(1, 400)) for k in range(1, 513)}
    found = packing.patterns(histogram, 512)
    used = collections.Counter()
    for n, pattern in found:
        assert sum(length * copies for length, copies in pattern) <= 512
        for length, copies in pattern:
            used[length] += n * copies
    assert used == histogram
    assert sum(k * v for k, v in histogram.items()) / (512 * sum(n for n, _ in found)) > 0.97


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), base[:3]]).astype(np.float32)
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    table = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(200 + i, v, None) for i, v in enumerate(odd)] + [(None, x[0].tolist(), 1), (5, x[5].tolist(), 1)]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>, label int")
    vectors = [None if v is None or not v or any(c is None for c in v) else np.array(v, float) for _, v, _ in table]
    vectors = [None if v is None or not np.isfinite(v).all() or not v.any() else v / np.linalg.norm(v) for v in vectors]
    n = len(table)
    link = [[vectors[i] is not None and vectors[j] is not None and i != j and len(vectors[i]) == len(vectors[j]) and vectors[i] @ vectors[j] >= 0.9 for j in range(n)] for i in range(n)]
    want = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = [j for j in range(n) if link[k][j] and j not in seen]
            seen.update(new)
            todo += new
        ids = [table[j][0] for j in seen if table[j][0] is not None]
        c = min(ids) if ids else None
        want.append((table[i][0], sum(link[i]), c, c == table[i][0]))
    for block in (1024, 5):
        old, embeddings.BLOCK = embeddings.BLOCK, block
        try:
            got = [tuple(r) for r in embeddings.near_embeddings(df).collect()]
        finally:
            embeddings.BLOCK = old
        assert sorted(got, key=_key) == sorted(want, key=_key)
    assert embeddings.near_embeddings(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [10, 5_000, 1_000_000])
def test_embeddings_design_reaches_its_recall(n):
    """Pairs with a cosine of exactly 0.9 meet in a window of some group and pass the count."""
    lines, groups, least = embeddings.design(n)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((2000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    e = rng.standard_normal((2000, 32))
    e -= (e * x).sum(1)[:, None] * x
    e /= np.linalg.norm(e, axis=1)[:, None]
    y = 0.9 * x + math.sqrt(1 - 0.81) * e
    (a, p, la), (b, q, lb) = (embeddings.projections(z, lines, groups) for z in (x, y))
    found = ((a == b) & (np.abs(p - q) <= embeddings.HALF)).any(1) & ((np.abs(la.astype(int) - lb) <= embeddings.COUNT_HALF).sum(1) >= least)
    assert found.mean() > 0.95


def test_embedding_windows_and_counts():
    rng = np.random.default_rng(7)
    place, count = rng.integers(-300, 300, 90).astype(np.int32), rng.integers(-50, 50, (90, embeddings.LINES)).astype(np.int8)
    count[40:] = count[:50] + rng.integers(-28, 28, (50, embeddings.LINES)).astype(np.int8)
    side = rng.integers(0, 3, 90)
    for same in (True, False):
        want = {(i, j) for i in range(90) for j in range(90) if side[i] == 0 and (side[j] > 0 or (same and i < j)) and abs(int(place[i]) - int(place[j])) <= embeddings.HALF and sum(abs(int(x) - int(y)) <= embeddings.COUNT_HALF for x, y in zip(count[i], count[j])) >= 20}
        got = embeddings.passing(place, count, side, same, 20)
        assert sorted(map(tuple, got.T.tolist())) == sorted(want) and want


def test_classifier(spark, docs, none):
    good = [(k, _passage(k, 40)) for k in range(120)]
    bad = [(1000 + k, "$$$ ".join(_passage(500 + k, 40).split())) for k in range(120)]
    df = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad] + [(None, 1, 0), (3, None, 0), (5, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = classifier.fit(df, labels)
    got = classifier.classify(df, model).collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert sum(r.predicted == int(r.doc_id < 1000) for r in held) / len(held) > 0.95
    odd = classifier.classify(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    blank = classifier.fit(none, labels.limit(0))
    assert classifier.classify(none, blank).count() == 0


def test_classifier_does_not_depend_on_the_order(spark):
    """Ids with two texts, in either order of rows and in batches of any size; a sample bound in bytes."""
    rows = [(k, _passage(k, 30)) for k in range(60)] + [(k, "$$$ " + _passage(500 + k, 30)) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id bigint, quality int, toxic int")
    shape = "doc_id bigint, text string"
    models = [classifier.fit(spark.createDataFrame(r, shape).repartition(n), labels) for r, n in ((rows, 1), (rows[::-1], 5))]
    assert np.array_equal(models[0][0], models[1][0]) and models[0][1] == models[1][1]
    texts = [(k, rows[k % 7][1]) for k in range(300)]
    scores = collections.defaultdict(set)
    for n in (1, 7):
        for r in classifier.classify(spark.createDataFrame(texts, shape).repartition(n), models[0]).collect():
            scores[r.doc_id % 7].add(r.score)
    assert all(len(s) == 1 for s in scores.values())
    small = classifier.fit(spark.createDataFrame(rows, shape), labels, sample_bytes=4000)
    assert not np.array_equal(small[0], models[0][0])


def test_licences(docs, rows, none):
    got = licences.scan_licences(docs).collect()
    want = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in licences.PHRASES.items():
            p = phrase.split()
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    at.append(j)
                    labels.add(label)
        want.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=_key) == sorted(want, key=_key)
    row = next(r for r in got if r.doc_id == 12)
    assert row.labels == "apache,cc-by-nc,mit" and row.score == 1
    assert licences.scan_licences(none).count() == 0


def test_licence_with_an_inserted_word(spark):
    text = licences.TEMPLATES[0][1].split()
    changed = _passage(30) + " " + " ".join([*text[:20], "indeed", *text[20:]]) + " " + _passage(31)
    df = spark.createDataFrame([(1, changed), (2, " ".join(text[:6]))], "doc_id bigint, text string")
    got = {r.doc_id: r for r in licences.scan_licences(df).collect()}
    assert got[1].labels == "mit" and 0.75 <= got[1].score < 1 and got[1].spans[0].first == 60
    assert got[2].labels == "" and 0 < got[2].score < 0.75


def _plain_lm(toks, held, seeds, classes):
    """The model of lm.score_texts with dictionaries; only the exchange of the seeds is shared."""
    import pyarrow as pa

    h = {w: int(lm.tokens(pa.array([w]))[0][0]) for _, t in toks for w in t if w is not None}
    c = collections.Counter(w for i, t in toks if not held(i) for w in t if w is not None)
    seed = sorted(c, key=lambda w: (-c[w], h[w]))[:seeds]
    n = np.zeros((len(seed) + 2,) * 2, np.int64)
    number = {w: k for k, w in enumerate(seed)}
    sym = lambda w: len(seed) + 1 if w is None else number.get(w, len(seed))
    pairs = lambda t: zip([None, *t[:-1]], t, strict=True)
    for i, t in toks:
        if not held(i):
            for x, y in pairs(t):
                n[sym(x), sym(y)] += 1
    cls = lm.exchange(n, len(seed), classes)
    own = int(cls.max()) - 1
    g = np.zeros((own + 2, own + 2))
    np.add.at(g, (cls[:, None], cls[None, :]), n)
    g += 0.1
    before, behind = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for i, t in toks:
        if not held(i):
            for x, y in pairs(t):
                before[y][cls[sym(x)]] += 1
                behind[x][cls[sym(y)]] += 1
    of = {}
    for w in c:
        like = [sum(m * (math.log(g[s, k] / g[s].sum()) - math.log(g[:, k].sum())) for s, m in before[w].items()) + sum(m * math.log(g[k, s] / g[k].sum()) for s, m in behind[w].items()) for k in range(own)]
        of[w] = int(cls[number[w]]) if w in number else max(range(own), key=lambda k: (round(like[k], 9), -k))
    mass, size = collections.Counter(), collections.Counter()
    for w in c:
        mass[of[w]] += c[w]
        size[of[w]] += 1
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d = (once + 1) / (once + 2 * twice + 2)
    state = lambda w: own if w is None else of.get(w, own + 1)
    step = collections.Counter((state(x), state(y)) for i, t in toks if not held(i) for x, y in pairs(t))
    total = sum(step.values())
    into = [(sum(m for (_, y), m in step.items() if y == k) + 1) / (total + own + 1) for k in range(own + 1)]
    vocab = len(c) + any(not held(i) for i, _ in toks)
    out = []
    for _, t in toks:
        s = 0.0
        for x, y in pairs(t):
            a, leaving = state(x), sum(m for (p, _), m in step.items() if p == state(x))
            p = lambda k: into[k] if a == own + 1 else (step[a, k] + lm.SMOOTH * into[k]) / (leaving + lm.SMOOTH)  # noqa: B023, E731
            if y is None:
                s += math.log10(p(own))
            elif y in c:
                s += math.log10(p(of[y]) * (c[y] - d) / (mass[of[y]] + 1))
            else:
                s += math.log10(sum(p(k) * (d * size[k] + 1) / (mass[k] + 1) for k in range(own)) / (vocab + 1))
        out.append(s)
    return out


def test_lm(docs, rows, none):
    got = lm.score_texts(docs, seeds=12, classes=4, chunk_bytes=3000).collect()
    toks = [(i, [*_words((t or "").translate(LOWER)), None]) for i, t, *_ in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    model = _plain_lm(toks, held, 12, 4)
    want = [(i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6), round(s, 5)) for (i, t), s in zip(toks, model, strict=True)]
    assert any(held(i) for i, _ in toks)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 5)) for r in got), key=_key) == sorted(want, key=_key)
    assert all(abs(r.perplexity / 10 ** min(-r.score / r.n_tokens, 300) - 1) < 1e-9 for r in got)
    assert lm.score_texts(none).count() == 0


def test_lm_model_is_a_distribution():
    """Probabilities of all states sum to 1 when every spare share is spent on as many unseen words as there are known ones and one."""
    rng = np.random.default_rng(5)
    g, spare = rng.integers(0, 50, (7, 7)).astype(float), rng.random(5)
    p = 10 ** lm.transition_model(g, spare, 99)
    assert np.allclose(p[:, :6].sum(1), 1) and np.allclose(p[:, 6] * 100, p[:, :5] @ spare)


def test_exchange_finds_classes():
    rng = np.random.default_rng(4)
    words, n = 40, np.zeros((41, 41), np.int64)
    state, prev = 0, 40
    for _ in range(20_000):
        w = int(rng.integers(0, 20)) * 2 + state
        n[prev, w] += 1
        prev, state = w, 1 - state
    c = lm.exchange(n, words, 2)
    assert len(set(c[0:40:2])) == 1 and len(set(c[1:40:2])) == 1 and c[0] != c[1]


def test_urls(spark):
    rows = [(1, "http://Example.ORG/es/1?x"), (2, "https://a.example.org/en/12"), (3, "http://x.com/fr/1"), (4, "ftp://x.com"), (5, None), (6, "no scheme"), (7, "http://badexample.org/es/2"), (8, "http://x.com/de/9#f"), (8, "http://x.com/de/9#f"), (None, "http://q.net?a/b"), (9, "http://h.net/u/" + "v/" * 30)]
    rows += [(100 + k, f"http://big.com/{'fr' if k % 2 else 'de'}/{k}") for k in range(200)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id bigint, url string, host string, verdict string")
    got = urls.judge_urls(df).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.host): r for r in got}
    assert by[1, "example.org"].rule == "example.org/es/" and by[1, "example.org"].verdict == "block"
    assert by[2, "a.example.org"].rule == "example.org/en/1" and by[3, "x.com"].rule == "com/fr/" and by[8, "x.com"].path == "/de/9"
    assert by[7, "badexample.org"].rule == "org/" and by[4, "x.com"].rule is None and by[4, "x.com"].path == ""
    assert by[5, ""].path == "" and by[6, ""].rule is None and by[None, "q.net"].path == ""
    assert {r.template for r in got if r.host == "big.com"} == {"/fr/*", "/de/*"}
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_urls_learn_bad_templates(spark):
    rows = [(k, f"http://shop.com/{'ads' if k % 3 else 'news'}/{k}") for k in range(300)]
    rules = [("shop.com", f"/ads/{d}", "block") for d in range(1, 8)] + [("shop.com", f"/news/{d}", "allow") for d in range(1, 8)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), rules).where("rule is null").collect()
    assert got and all((r.verdict == "block") == ("/ads/" in r.path) for r in got)


def test_urls_split_deep_and_small_branches(spark):
    """Labels that depend on the sixth segment, and a blocked branch of far under a hundredth of its host."""
    rows = [(k, f"http://deep.com/a/b/c/d/e/{'ads' if k % 2 else 'news'}/{k}") for k in range(60)]
    rows += [(1000 + k, f"http://wide.com/{'bad' if k < 20 else 'ok'}/{k}") for k in range(3000)]
    rules = [("deep.com", f"/a/b/c/d/e/ads/{d}", "block") for d in range(1, 6)] + [("deep.com", "/a/b/c/d/e/news/", "allow")]
    rules += [("wide.com", "/bad/1", "block"), ("wide.com", "/ok/", "allow")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), rules, purity=0.75).where("rule is null").collect()
    assert {r.host for r in got} == {"deep.com", "wide.com"} and all(r.verdict == "block" for r in got)


def test_url_cutoff_is_calibrated(spark):
    """Labels decide the cutoff: where a fifth is held out, bad branches of few labels are rejected and good ones are not."""
    assert urls.best_cutoff({10: (0, 5), 30: (4, 0)}, 0.75) == 0.21 and urls.best_cutoff({5: (0, 3)}, 0.75) == 0.75
    rows = [(k, f"http://h{k % 8}.com/{'ads' if k % 2 else 'news'}/{k}") for k in range(2000)]
    rules = [(f"h{h}.com", f"/{part}/{d}", v) for h in range(8) for part, v in (("ads", "block"), ("news", "allow")) for d in (1, 2)]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), rules).where("rule is null").collect()
    assert len(got) > 400 and all((r.verdict == "block") == ("/ads/" in r.path) for r in got)


def test_url_parts_against_sql(spark):
    """Host, path and rule of all test pages equal those of plain SQL."""
    import os

    import duckdb

    at = "/root/testdata/sf0.001/pages.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables here")
    rules = "(VALUES ('org', '/'), ('example.org', '/es/'), ('example.org', '/en/1'), ('com', '/fr/'), ('com', '/de/')) AS r(h, p)"
    want = duckdb.execute(f"""WITH x AS (SELECT page_id, coalesce(lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)), '') AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM '{at}')
SELECT page_id, host, path, (SELECT arg_max(h || p, length(h || p)) FROM {rules} WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p)) AS rule FROM x""").fetchall()
    got = [tuple(r) for r in urls.judge_urls(spark.read.parquet(at)).select("page_id", "host", "path", "rule").collect()]
    assert sorted(got, key=_key) == sorted(want, key=_key)


def test_interleave():
    blocks, weights = [50, 20, 7, 1], [0.5, 0.3, 0.15, 0.05]
    slots = mixing.interleave(blocks, weights)
    assert sorted(slots) == [(s, b) for s, n in enumerate(blocks) for b in range(n)]
    count, total = [0] * 4, sum(weights)
    for t, (s, _) in enumerate(slots, 1):
        count[s] += 1
        if count[s] == blocks[s]:
            break
        assert all(abs(count[k] - weights[k] / total * t) < 1 for k in range(4))


def test_interleave_goes_on_in_proportion():
    """When a source has ended the others keep their proportions; thousands of sources are no trouble."""
    blocks, weights = [5, 400, 100, 100], [0.5, 0.3, 0.1, 0.1]
    slots = mixing.interleave(blocks, weights)
    assert sorted(slots) == [(s, b) for s, n in enumerate(blocks) for b in range(n)]
    count, first = [0] * 4, None
    for s, _ in slots:
        count[s] += 1
        if first is None and count[0] == 5:
            first = list(count)
        if first and max(count[1] - 390, count[2] - 95, count[3] - 95) < 0:
            since = [c - f for c, f in zip(count, first, strict=True)]
            assert abs(since[1] / 3 - since[2]) <= 2 and abs(since[2] - since[3]) <= 2
    many = mixing.interleave([1] * 20_000, [1 + k % 7 for k in range(20_000)])
    assert len(set(many)) == 20_000
    assert sorted(mixing.interleave([3, 2], [1.0, 1e-9])[:3]) == [(0, 0), (0, 1), (0, 2)]


def test_positions_against_brute_force(spark, docs):
    from pyspark.sql import functions as F

    plan = mixing.Schedule(docs, most_blocks=6)
    got = collections.Counter(map(tuple, plan.positions().select("doc_id", "source", "block", "slot", "position").collect()))
    by = collections.defaultdict(list)
    for r in docs.select("doc_id", "source", F.xxhash64("doc_id").alias("h")).collect():
        by[r.source].append((r.h, r.doc_id is not None, r.doc_id))
    start, at = 0, {}
    for slot, (s, b) in enumerate(plan.slots):
        name = plan.sources[s]
        for k, (_, _, i) in enumerate(sorted(by[name])[b * plan.rows_per_block : (b + 1) * plan.rows_per_block]):
            at[name, b, k] = (i, name, b, slot, start + k)
        start += len(sorted(by[name])[b * plan.rows_per_block : (b + 1) * plan.rows_per_block])
    assert got == collections.Counter(at.values()) and len(plan.slots) > 3


@pytest.mark.parametrize("most", [5, 1000])
def test_mixing(docs, none, most):
    out = mixing.mix(docs, most_blocks=most)
    assert out.columns == docs.columns and sorted(map(_key, out.collect())) == sorted(map(_key, docs.collect()))
    at = mixing.Schedule(docs, most_blocks=most).positions().collect()
    assert sorted(r.position for r in at) == list(range(docs.count()))
    assert mixing.mix(none).count() == 0 and mixing.Schedule(none).positions().count() == 0
