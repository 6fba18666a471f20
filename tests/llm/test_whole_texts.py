"""Exact dedup, fill-in-middle, periodic runs and url trees, held against brute force and exact round trips."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest

from tacet.llm import exact, infill, kernel, near, runs, urls

WORD = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHAPE = "doc_id bigint, text string, chunk string, entry double, key int, n string, top int, doc string, kept int, output string, start string, made int"
CLASH = ("c", 1.0, 3, "n", 4, "d", 0, "o", "s", 1)


def _sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    texts = [
        (5, "Same Text\nÄ"), (2, "same text\nÄ"), (9, "same text\nä"), (3, None), (4, ""), (None, "same TEXT\nÄ"), (None, None), (5, "Same Text\nÄ"), (None, "only without id"), (None, "ONLY without id"),
        (12, "a\nb\nc"), (13, "a\n\n\nb\n"), (14, "one line"), (15, "\n"), (16, "has <S> in it\nx"), (17, "<P>\n"), (18, "<S\n>\n<M\n"), (19, "\U0001f600\né\n" * 5), (20, " \t\n "), (21, "y" * 3000),
        (30, "x " * 400), (31, "a b " * 9 + "c"), (32, "a b c d e f g h " * 2), (33, "one two three"), (34, " ".join(f"w{k % 7}" for k in range(60)) + " tail " + "z " * 12),
    ]
    for i in range(40, 130):  # a tenth of these have planted runs
        words = [f"v{k}" for k in rng.integers(0, 5 if i % 3 else 60, int(rng.integers(0, 90)))]
        texts.append((i, "".join(w + ("\n" if k % 9 == 8 else " ") for k, w in enumerate(words))))
    texts += [(1000 + i, "Copied Text " * (1 + i % 2)) for i in range(60)]
    return [(i, t, *CLASH) for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SHAPE).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


def _order(x):
    return sorted(x, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("bucket_bytes", [64 << 20, 2000, 100])  # one page; split buckets; chains of pages
def test_exact(docs, rows, none, bucket_bytes):
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(i)
    got = exact.exact_groups(docs, bucket_bytes=bucket_bytes, most_bits=6).collect()
    expect = []
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        expect += [(i, best, len(ids), _sha(t)) for i in ids]
    assert _order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == _order(expect)
    kept = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    assert sorted(s for s, _ in kept) == sorted(map(_sha, groups))  # one row of each group, whatever its ids
    assert all(i == r.keep_id for r in got for i in [r.doc_id] if r.kept)
    assert not exact.exact_groups(none, bucket_bytes=bucket_bytes).collect()


def test_exact_keeps_columns(docs, rows):
    got = exact.remove_copies(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert len(got) == len({(t or "").translate(LOWER) for _, t, *_ in rows})
    assert all(tuple(r)[2:] == CLASH for r in got) and {(r.doc_id, r.text) for r in got} <= {(i, t) for i, t, *_ in rows}


def test_equal_keys_are_told_apart_by_bytes(spark):
    """Entries whose digests begin alike, which no test text does, in one page and over several."""
    entries = [(c, e, 77 if t < "c" else 1 << 62, 2, 10 * c + e, t.encode()) for c in range(40) for e, t in enumerate(("a", "b", "cc", "dd"))]
    frame = spark.createDataFrame(entries, exact.ENTRY)
    for size in (1 << 20, 200):
        got = {(r.chunk, r.entry): (r.keep_id, r.win, r["size"]) for r in exact.settle(frame, size, 6).collect()}
        assert got == {(c, e): (390 + e, 39, 80) for c in range(40) for e in range(4)}


def test_directory_doubles():
    cells = np.array([0, 0, 5, 1, 0, 0, 0, 40])
    bucket, sizes, depth = exact.split_buckets(cells, 3, 8)
    assert depth == 3 and bucket.tolist() == [0, 0, 0, 0, 1, 1, 2, 3] and sizes == [6, 0, 0, 40]
    bucket, sizes, depth = exact.split_buckets(cells, 3, 100)
    assert depth == 0 and set(bucket.tolist()) == {0} and sizes == [46]
    rng = np.random.default_rng(1)
    for _ in range(50):
        cells = rng.integers(0, 9, 64) ** 2
        bucket, sizes, depth = exact.split_buckets(cells, 6, 40)
        assert (np.diff(bucket) >= 0).all() and np.bincount(bucket, cells).tolist() == sizes
        assert all(s <= 40 or (bucket == b).sum() == 1 for b, s in enumerate(sizes))


@pytest.mark.parametrize(("rate", "unit"), [(100, infill.LINES), (60, infill.LINES), (100, r"(?s:.)")])
def test_infill(docs, rows, none, rate, unit):
    got = _order((r.doc.doc_id, r.doc.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256, r.restored_sha256) for r in infill.fill_in_middle(docs, rate=rate, unit=unit).collect())
    expect = []
    for i, t, *_ in rows:
        t0, t = t, t or ""
        units = re.findall(unit, t)
        h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        assert p + m + s == t
        if t == "" or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
            form, out, sizes = "plain", t, (None, None)
        else:
            form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
            sizes = len(p), len(m)
        expect.append((i, t0, n, form, *sizes, out, _sha(out), _sha(t)))
    assert got == _order(expect)
    assert {"plain", "psm", "spm"} == {x[3] for x in got}
    assert not infill.fill_in_middle(none).collect()


def test_infill_long_text(spark):
    text = ("line of a long text\n" * 150_000) + "end"
    r = infill.fill_in_middle(spark.createDataFrame([(7, text)], "doc_id bigint, text string")).first()
    assert r.n == 150_001 and r.restored_sha256 == _sha(text) and len(r.output) == len(text) + 9


def _plain_runs(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)  # a smaller period came first
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def _expected_runs(i, t, plant):
    w = re.findall(WORD, t or "")
    h = zlib.crc32(("" if i is None else str(i)).encode())
    if plant and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(len(w))]
    found = _plain_runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    kept = " ".join(x for k, x in enumerate(w) if k not in gone)
    return (len(w), len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], _sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), _sha(kept), found, kept)


@pytest.mark.parametrize("plant", [False, True])
def test_runs(docs, rows, none, plant):
    got = runs.periodic_runs(docs, rearrange=runs.planted if plant else None).collect()
    mine = _order((r.doc.doc_id, r.doc.text, r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256, [tuple(x) for x in r.runs], r.collapsed) for r in got)
    assert mine == _order((i, t, *_expected_runs(i, t, plant)) for i, t, *_ in rows)
    assert sum(r.n_runs > 0 for r in got) > (7 if plant else 3) and any(r.n_runs > 1 for r in got)
    assert not runs.periodic_runs(none).collect()


def test_runs_on_random_words():
    rng = np.random.default_rng(11)
    for _ in range(150):
        texts = []
        for _ in range(int(rng.integers(1, 6))):
            n = int(rng.integers(0, 90))
            w = rng.integers(0, rng.integers(1, 5), n)
            if n > 4:
                a, p = int(rng.integers(0, n)), int(rng.integers(1, max(2, n // 3)))
                i = np.arange(a, n)
                w[a:] = w[a + (i - a) % p]
            texts.append(w)
        first = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        ids = np.concatenate(texts).astype(np.int64)
        for heavy in (None, 0, 3, 1e9):  # all words by transforms, some, none
            assert runs.find_runs(ids, first, heavy=heavy) == [_plain_runs(list(x)) for x in texts]


def test_lag_counts_are_exact():
    w = np.minimum(np.random.default_rng(2).zipf(1.3, 3000), 40)
    first = np.array([0, 1000, 1001, 3000])
    plain = np.concatenate([[int((x[:-q] == x[q:]).sum()) for q in range(1, len(x) // 2 + 1)] for x in np.split(w, first[1:-1])])
    for heavy in (None, 0, 50, 1e9):
        assert runs.lag_matches(w, first, heavy)[0].tolist() == plain.tolist()


def test_runs_of_extreme_texts():
    """One word over and over, and a word of Fibonacci type, which has more runs than any natural text."""
    same = np.zeros(300_000, np.int64)
    assert runs.find_runs(same, np.array([0, len(same)])) == [[(0, 300_000, 1)]]
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    w = np.frombuffer(b[:1500].encode(), np.uint8).astype(np.int64)
    assert runs.find_runs(w, np.array([0, len(w)])) == [_plain_runs(w.tolist())]


def _grow(rows, template, out):
    """The path tree, node by node, of rows (key, rest, blocked, labelled)."""
    if len(rows) < urls.LEAST or not any(r[1] for r in rows):
        out.update({r[0]: template + ("/**" if r[1] else "") for r in rows})
        return
    pieces, fork = [], None
    for pos in range(max(len(r[1]) for r in rows)):
        here = collections.Counter(r[1][pos] for r in rows if len(r[1]) > pos)
        if len(here) > 1 and max(here.values()) >= urls.LEAST:
            fork = pos
            break
        pieces.append(next(iter(here)) if len(here) == 1 and max(here.values()) >= urls.LEAST else "*")
    kids = collections.defaultdict(list)
    at = [r for r in rows if fork is not None and len(r[1]) > fork]
    b, n = sum(r[2] for r in at), sum(r[3] for r in at)
    for key, rest, *label in rows:
        name = template + "".join(f"/{p}" for p in pieces[: len(rest)])
        if fork is None or len(rest) <= fork:
            out[key] = name
            continue
        same = [r for r in at if r[1][fork] == rest[fork]]
        own_b, own_l = sum(r[2] for r in same), sum(r[3] for r in same)
        mid, left = (b + 1) / (n + 2), n - own_l
        similar = own_l > 0 and left > 0 and abs(own_b / own_l - (b - own_b) / left) / (mid * (1 - mid) * (1 / own_l + 1 / left)) ** 0.5 < urls.Z
        name += "/" + (rest[fork] if len(same) >= urls.LEAST and not similar else "*")
        if rest[fork + 1 :]:
            kids[name].append((key, rest[fork + 1 :], *label))
        else:
            out[key] = name
    for name, own in kids.items():
        _grow(own, name, out)


def test_url_trees_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(900):
        host = ["a.com", "b.com", "c.com", "d.org", "e.net"][min(4, int(rng.integers(0, 9)))]
        first = ["ads", "news", "shop", "x"][int(rng.integers(0, 4))]
        path = [first, str(int(rng.integers(0, 300)))] + ["p", ["q", "r"][k % 2], str(k)][: int(rng.integers(0, 4))]
        rows.append((k, f"http://{host}/" + "/".join(path) + ["", "/", "?x=1", "#y"][k % 4]))
    rows += [(2000 + k, f"http://long.com/{'/'.join(['s'] * 300)}/{k}") for k in range(5)] + [(3000, "http://a.com"), (3001, "http://a.com/"), (3002, None), (3003, "http://e.net/ads/7")]
    rules = [("a.com", "/ads/1", "block"), ("b.com", "/ads/", "block"), ("b.com", "/news/2", "allow"), ("c.com", "/shop/", "allow"), ("d.org", "/x/", "block"), ("d.org", "/news/", "allow"), ("a.com", "/news/", "allow")]
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(rows, "page_id bigint, url string"), rules, purity=0.5).collect()}
    assert len(got) == len(rows)
    paths = {(r.host, r.path): (int(r.verdict == "block"), 1) if r.rule else (0, 0) for r in got.values()}
    trees = collections.defaultdict(list)
    for (host, path), label in paths.items():
        for tree in (host, None):
            trees[tree].append(((host, path), path[1:].split("/") if path else [], *label))
    of, shape = {}, {}
    for tree, own in trees.items():
        _grow(own, "", shape if tree is None else of)
    for r in got.values():
        key = (r.host, r.path)
        assert (r.template, r.shape) == (of[key], shape[key])
        mine = [paths[k] for k in paths if k[0] == r.host and of[k] == of[key]]
        other = [paths[k] for k in paths if k[0] != r.host and shape[k] == shape[key]]
        b, n, ob, on = (sum(x[i] for x in y) for y in (mine, other) for i in (0, 1))
        share = (ob + 1) / (on + 2)
        purity = (b + urls.WEIGHT * share) / (n + urls.WEIGHT) if n + on >= urls.LABELS else None
        assert r.purity == purity or abs(r.purity - purity) < 1e-12
        assert r.rule or r.verdict == ("block" if purity is not None and purity > 0.5 else "allow")
    free = collections.defaultdict(set)
    for r in got.values():
        if not r.rule:
            free[r.host].add(r.verdict)
    assert len(free["e.net"]) == 2  # verdicts differ within a host that has no label of its own


def test_one_of_each_takes_columns_of_any_name(spark):
    shape = "doc_id bigint, text string, _id int, _content string, content int, component double, n int, doc string, `a.b` int"
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(i, t, i, "c", 1, 2.0, 3, "d", 4) for i, t in enumerate([text, text, text + " end", "other words stand here and more", None])]
    rows += [rows[1], rows[3]]  # repeated rows
    got = near.one_of_each(spark.createDataFrame(rows, shape))
    assert got.columns == [f.split()[0].strip("`") for f in shape.split(", ")]
    assert sorted(tuple(r) for r in got.collect()) == sorted([rows[0], rows[3], rows[4]], key=lambda r: r[0])


def test_running_sums(spark):
    values = [(k, (k * 7) % 11) for k in range(200)]
    got = {r.k: r.before for r in kernel.running(spark.createDataFrame(values, "k bigint, v bigint").repartition(5), "v", "k", "before").collect()}
    assert got == {k: sum(v for j, v in values if j < k) for k, _ in values}
