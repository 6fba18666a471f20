"""Operator 10: language-model scores from Brown classes.

1. Seeds: the training texts' words are counted by hash range; the most frequent are the seeds.
   Exchange clustering on their bigram counts, in which all other words are one symbol, gives each
   seed its class.
2. Classes of all other training words: texts are dealt into chunks, and a chunk sends each of its
   distinct words with its count and the counts of the classes next to it. A hash range adds these up
   and exchanges each word into the class where the likelihood of its bigrams is highest. It
   answers every chunk with counts and classes of the words it sent.
3. Scores: each chunk writes for each text the emissions of its words and its counts of class
   transitions. Those of the training texts, added up, are the transition model that scores all.

A known word w of class k has the probability P(k | class before) (count(w) - D) / (size(k) + 1); D is
estimated from the words that occur once and twice. What the discount frees is shared by the unseen
words, as if there were as many of them as known ones. Everything counted grows with the corpus;
what reaches the driver is bounded by the numbers of seeds and classes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacet.llm import kernel as K

#: Words whose classes are found by exchange against each other; every other word is exchanged against their classes.
SEEDS = 500
CLASSES = 48
SMOOTH = 10.0
RANGE_WORDS = 1 << 18
#: Words of one dense block in a hash range.
BLOCK = 1 << 14
TRAIN_MOD, HELD_OUT = 7, 2
UNSEEN = 255


def tokens(column):
    """Hashes of the lower-cased words, and the number of each text's first word."""
    buf, offs = K.buffer_of(column)
    buf = K.LOWER[buf]
    starts, ends, first = K.words_of(buf, offs)
    return K.word_hashes(buf, starts, ends), first


def _by_range(key: np.ndarray, ranges: int):
    """The distinct keys by range, then by value; the place of each key among them; where each range begins."""
    distinct, which = np.unique(key, return_inverse=True)
    part = ((K.mix(distinct + K.U64(99)) >> K.U64(32)) % K.U64(ranges)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return distinct[order], place[which], np.searchsorted(part[order], np.arange(ranges + 1))


def _words(ranges: int):
    """Distinct words with counts, packed by hash range."""

    def words(batches):
        for batch in batches:
            for a, b in K.pieces(batch.column(0), 4 << 20):
                key, _ = tokens(batch.column(0).slice(a, b - a))
                distinct, which, cuts = _by_range(key, ranges)
                count = np.bincount(which, minlength=len(distinct))
                live = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays([pa.array(live.astype(np.int32)), *(pa.array([K.planar(x[cuts[r] : cuts[r + 1]], n) for r in live], pa.binary()) for x, n in ((distinct, 8), (count, 4)))], ["rng", "keys", "counts"])
        K.trim()

    return words


def _summed(table: pa.Table):
    """Distinct keys of a range, the place of each key sent, and totals."""
    keys = [K.unplanar(b.as_buffer(), 8) for b in table.column("keys")]
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([K.unplanar(b.as_buffer(), 4) for b in table.column("counts")])
    return distinct, which, np.cumsum([0, *map(len, keys)]), np.bincount(which, counts, len(distinct)).astype(np.int64)


def _frequent(seeds: int):
    def frequent(table: pa.Table) -> pa.Table:
        """The range's most frequent words, and one row (key null) of its numbers of tokens, words, and words that occur once and twice."""
        distinct, _, _, total = _summed(table)
        top = np.lexsort((distinct, -total))[:seeds]
        more = np.zeros(len(top), np.int64)
        own = [int(total.sum()), len(distinct), int((total == 1).sum()), int((total == 2).sum())]
        K.trim()
        return pa.table([pa.array([*distinct[top].astype(np.int64).tolist(), None], pa.int64()), *(pa.array(np.append(x, y)) for x, y in zip((total[top], more, more, more), own, strict=True))], names=["key", "total", "words", "once", "twice"])

    return frequent


def symbols(key: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The symbol of each key: its place among the sorted seeds, else the one behind them."""
    if not len(top):
        return np.zeros(len(key), np.int64)
    at = np.searchsorted(top, key)
    at[at == len(top)] = 0
    return np.where(top[at] == key, at, len(top))


def _steps(sym: np.ndarray, first: np.ndarray, edge: int):
    """Sequences with the boundary symbol before and behind each text: previous and current ones, and each text's first."""
    n = np.diff(first)
    cur = np.insert(sym, first[1:], edge) if len(n) else sym
    begin = first[:-1] + np.arange(len(n))
    prev = np.empty_like(cur)
    prev[1:], prev[begin] = cur[:-1], edge
    return prev, cur, begin


def _bigrams(top: np.ndarray):
    size = len(top) + 2

    def count(batches):
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            for a, b in K.pieces(batch.column(0), 4 << 20):
                key, first = tokens(batch.column(0).slice(a, b - a))
                prev, cur, _ = _steps(symbols(key, top), first, len(top) + 1)
                total += np.bincount(prev * size + cur, minlength=size * size)
        K.trim()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    return count


def exchange(n: np.ndarray, free: int, classes: int = CLASSES, rounds: int = 8) -> np.ndarray:
    """Exchange clustering: the class of each symbol, maximising class-bigram likelihood.

    The first ``free`` symbols (frequent words, by falling count) move between ``classes`` classes;
    each other symbol keeps a class of its own. A word moves to the class that gains most, until a
    round moves none.
    """
    size, own = len(n), min(classes, max(free, 1))
    c = np.concatenate([np.arange(free) % own, own + np.arange(size - free)]).astype(np.int64)
    k = own + size - free
    hot = np.zeros((size, k))
    hot[np.arange(size), c] = 1
    m = n.astype(np.float64)
    out, into = m @ hot, hot.T @ m  # word -> class, class -> word
    g = hot.T @ out

    def xlx(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    for _ in range(rounds):
        moved = 0
        for w in range(free):
            a, self_ = c[w], m[w, w]
            row, col = out[w].copy(), into[:, w].copy()
            row[a] -= self_
            col[a] -= self_
            g[a] -= row
            g[:, a] -= col
            g[a, a] -= self_
            sums_out, sums_in, tw_out, tw_in = g.sum(1), g.sum(0), row.sum() + self_, col.sum() + self_
            base = xlx(g)
            j = np.arange(own)
            gain = (xlx(g[:own] + row) - base[:own]).sum(1) + (xlx(g[:, :own] + col[:, None]) - base[:, :own]).sum(0)
            d, r, q = g[j, j], row[j], col[j]
            gain += -(xlx(d + r) - xlx(d)) - (xlx(d + q) - xlx(d)) + xlx(d + r + q + self_) - xlx(d)
            gain -= xlx(sums_out[:own] + tw_out) - xlx(sums_out[:own]) + xlx(sums_in[:own] + tw_in) - xlx(sums_in[:own])
            b = int(gain.argmax())
            b = b if gain[b] > gain[a] + 1e-9 else int(a)
            g[b] += row
            g[:, b] += col
            g[b, b] += self_
            if b != a:
                moved += 1
                c[w] = b
                out[:, a] -= m[:, w]
                out[:, b] += m[:, w]
                into[a] -= m[w]
                into[b] += m[w]
        if not moved:
            break
    return c


def preferences(g: np.ndarray, own: int) -> np.ndarray:
    """What one bigram says for each class of a word: rows are the symbol before it, then the symbol behind it.

    Of class counts g (own classes, other words, edge): log p(k | before) - log size(k), and log p(behind | k);
    summed over a word's bigrams that is the likelihood, up to a constant, of the word in class k.
    """
    g = g + 0.1
    before = np.log(g[:, :own] / g.sum(1, keepdims=True)) - np.log(g[:, :own].sum(0))
    behind = np.log(g[:own] / g[:own].sum(1, keepdims=True))
    return np.concatenate([before, behind.T])


def _send(ranges: int, top: np.ndarray, cls: np.ndarray, sides: int):
    """Each distinct word of the chunk with its count and its counts of neighbouring classes."""

    def send(table: pa.Table) -> pa.Table:
        doc = K.struct_of(table)
        key, first = tokens(doc.field("text"))
        distinct, which, cuts = _by_range(key, ranges)
        train = np.repeat(~doc.field("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
        count = np.bincount(which[train], minlength=len(distinct))
        c = cls[symbols(key, top)]
        before, _, begin = _steps(c, first, sides - 1)
        before = np.delete(before, begin + np.diff(first)) if len(begin) else before
        behind = np.append(c[1:], sides - 1)
        behind[first[1:][first[1:] > 0] - 1] = sides - 1
        side = which[train] * (2 * sides)
        code, n = np.unique(np.concatenate([side + before[train], side + sides + behind[train]]), return_counts=True)
        word, dim = np.divmod(code, 2 * sides)
        many = np.bincount(word, minlength=len(distinct))
        edges = np.concatenate([[0], np.cumsum(many)])[cuts]
        live = np.flatnonzero(np.diff(cuts))
        parts = [(distinct, 8, cuts), (count, 4, cuts), (many, 2, cuts), (dim, 1, edges), (n, 4, edges)]
        blobs = [pa.array([K.planar(x[at[r] : at[r + 1]], size) for r in live], pa.binary()) for x, size, at in parts]
        K.trim()
        return pa.table([pa.array(live.astype(np.int32)), pa.array(np.full(len(live), table.column("_chunk")[0].as_py(), np.int32)), *blobs], names=["rng", "chunk", "keys", "counts", "many", "dims", "n"])

    return send


SENT = "rng int, chunk int, keys binary, counts binary, many binary, dims binary, n binary"
ANSWER = "chunk int, rng int, totals binary, classes binary, class int, mass bigint, words bigint"


def _classify(top: np.ndarray, cls: np.ndarray, prefer: np.ndarray):
    """Exchanges each word of a range into its best class; answers the chunks, and adds up the classes."""
    own = prefer.shape[1]

    def classify(table: pa.Table) -> pa.Table:
        distinct, which, cuts, total = _summed(table)
        of = np.empty(len(distinct), np.uint8)
        word = np.repeat(which, np.concatenate([K.unplanar(b.as_buffer(), 2) for b in table.column("many")]))
        dim = np.concatenate([K.unplanar(b.as_buffer(), 1) for b in table.column("dims")])
        n = np.concatenate([K.unplanar(b.as_buffer(), 4) for b in table.column("n")])
        order = np.argsort(word, kind="stable")
        word, dim, n = word[order], dim[order], n[order]
        for a in range(0, len(distinct), BLOCK):
            b = min(a + BLOCK, len(distinct))
            x, y = np.searchsorted(word, [a, b])
            dense = np.bincount((word[x:y] - a) * len(prefer) + dim[x:y], n[x:y], (b - a) * len(prefer)).reshape(b - a, -1)
            of[a:b] = np.round(dense @ prefer, 9).argmax(1)
        sym = symbols(distinct, top)
        seed = sym < len(top)
        of[seed] = cls[sym[seed]]
        of[total == 0] = UNSEEN
        spots = range(len(cuts) - 1)
        totals = [K.planar(total[which[cuts[i] : cuts[i + 1]]], 8) for i in spots]
        classes = [of[which[cuts[i] : cuts[i + 1]]].tobytes() for i in spots]
        mass = np.bincount(of[total > 0], total[total > 0], own).astype(np.int64)
        words = np.bincount(of[total > 0], minlength=own)
        none = [None] * own
        K.trim()
        return pa.table({"chunk": pa.array(table.column("chunk").to_pylist() + none, pa.int32()), "rng": pa.array(table.column("rng").to_pylist() + none, pa.int32()), "totals": pa.array(totals + none, pa.binary()), "classes": pa.array(classes + none, pa.binary()), "class": pa.array([None] * len(totals) + list(range(own)), pa.int32()), "mass": pa.array([None] * len(totals) + mass.tolist(), pa.int64()), "words": pa.array([None] * len(totals) + words.tolist(), pa.int64())})

    return classify


COUNTED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, emission double, cells binary, n binary"


def _emit(ranges: int, norm: np.ndarray, discount: float, tokens_n: int, vocab: int):
    """norm: log10 of each class's emission denominator. Cells are state before * states + state; the states are classes, edge, unseen."""
    own = len(norm)
    edge, unseen, states = own, own + 1, own + 2

    def emit(table: pa.Table, answers: pa.Table) -> pa.Table:
        doc = K.struct_of(table)
        key, first = tokens(doc.field("text"))
        distinct, which, cuts = _by_range(key, ranges)
        total, of = np.zeros(len(distinct), np.int64), np.full(len(distinct), unseen, np.int64)
        for r, totals, classes in zip(answers.column("rng").to_pylist(), answers.column("totals"), answers.column("classes"), strict=True):
            total[cuts[r] : cuts[r + 1]] = K.unplanar(totals.as_buffer(), 8)
            got = np.frombuffer(classes.as_buffer(), np.uint8).astype(np.int64)
            of[cuts[r] : cuts[r + 1]] = np.where(got == UNSEEN, unseen, got)
        known = total > 0
        weight = np.zeros(len(distinct))
        weight[known] = np.log10(total[known] - discount) - norm[of[known]]
        ends = doc.field("train_docs").to_numpy(zero_copy_only=False).astype(np.int64)
        prev, cur, begin = _steps(of[which], first, edge)
        last = begin + np.diff(first)
        word = np.ones(len(cur), bool)
        word[last] = False
        seen, emission = np.empty(len(cur), np.int64), np.zeros(len(cur))
        seen[word], seen[last], emission[word] = total[which], ends, weight[which]
        base = np.log10((seen + 1) / (tokens_n + vocab + 1))

        def per(x):
            return np.add.reduceat(x, begin) if len(begin) else x[:0]

        at = np.repeat(np.arange(len(begin)), np.diff(first) + 1)
        code, n = np.unique(at * (states * states) + prev * states + cur, return_counts=True)
        text, cell = np.divmod(code, states * states)
        cut = np.searchsorted(text, np.arange(len(begin) + 1))
        blobs = [pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in range(len(begin))], pa.binary()) for x in (cell.astype("<u2"), n.astype("<u4"))]
        K.trim()
        return pa.table([doc.field("doc_id"), doc.field("held_out"), pa.array(np.diff(first) + 1), pa.array(per((seen > 0).astype(np.int64))), pa.array(per(base)), pa.array(per(emission)), *blobs], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emission", "cells", "n"])

    return emit


def _transitions(batches):
    """Counts of all cells of the given texts."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for c, n in zip(batch.column(0), batch.column(1), strict=True):
            total[np.frombuffer(c.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), "<u4")
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])


def transition_model(g: np.ndarray, spare: np.ndarray, vocab: int) -> np.ndarray:
    """log10 probabilities of states (classes, edge, unseen), row: state before; of counts g; spare: each class's share for unseen words."""
    own = len(spare)
    live = g[:, : own + 1]
    uni = (live.sum(0) + 1) / (live.sum() + own + 1)
    p = (live + SMOOTH * uni) / (live.sum(1, keepdims=True) + SMOOTH)
    p[own + 1] = uni  # nothing is known of what follows an unseen word
    return np.log10(np.concatenate([p, (p[:, :own] @ spare)[:, None] / (vocab + 1)], 1))


def _score(model: np.ndarray, tokens_n: int):
    flat = model.reshape(-1)

    def score(batches):
        for batch in batches:
            cells, n = batch.column("cells"), batch.column("n")
            step = [float(flat[np.frombuffer(c.as_buffer(), "<u2")] @ np.frombuffer(m.as_buffer(), "<u4")) for c, m in zip(cells, n, strict=True)]
            s = np.array(step, np.float64) + batch.column("emission").to_numpy()
            size = batch.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.full(len(s), tokens_n, np.int64)), batch.column("base_score"), pa.array(s), pa.array(10.0 ** np.minimum(-s / np.maximum(size, 1), 300))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return score


def _matrix(cells: DataFrame, size: int) -> np.ndarray:
    """Counts of at most size * size cells on the driver, whatever the input."""
    got = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return out.reshape(size, size)


def score_texts(docs: DataFrame, *, seeds: int = SEEDS, classes: int = CLASSES, chunk_bytes: int = K.CHUNK_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    All rows with crc32(doc_id as text) mod 7 other than 2 are learned from. Null and empty texts
    have the end token alone. A null doc_id counts as training (its crc32 is null). Repeated rows
    count as often as they occur. Extra columns are ignored. Of corpora without training rows every
    count is 0. At most 120 classes.
    """
    spark = docs.sparkSession
    held = F.coalesce(F.pmod(K.crc32_column(F.col("doc_id")), F.lit(TRAIN_MOD)) == HELD_OUT, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b"), F.sum(F.when(~F.col("held_out"), 1)).alias("train")).first()
    size, ends = row["b"] or 0, row["train"] or 0
    n = max(1, min(row["n"], K.chunks_for(size, chunk_bytes)))
    ranges = max(16, math.ceil(size / 36 / RANGE_WORDS))
    wide = K.parts(spark, math.ceil(ranges / 8))
    train = docs.where(~F.col("held_out")).select("text")
    counted = K.keep(train.mapInArrow(_words(ranges), "rng int, keys binary, counts binary").repartition(wide, "rng").groupBy("rng").applyInArrow(_frequent(seeds), "key bigint, total bigint, words bigint, once bigint, twice bigint"))
    sums = counted.where("key is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "words", "once", "twice")]).first()
    best = counted.where("key is not null").select(F.col("key").alias("k"), "total").orderBy(F.desc("total"), F.expr("k < 0"), "k").limit(seeds).collect()
    fall = np.array([np.int64(r["k"]).astype(np.uint64) for r in best], np.uint64)  # by falling count; equal counts by unsigned hash
    top = np.sort(fall)
    tokens_n, vocab = sums["total"] + ends, sums["words"] + (ends > 0)
    discount = (sums["once"] + 1) / (sums["once"] + 2 * sums["twice"] + 2)
    side = len(top) + 2
    grid = _matrix(train.mapInArrow(_bigrams(top), "cell int, n bigint"), side)
    order = np.append(np.searchsorted(top, fall), [side - 2, side - 1]).astype(np.int64)
    cls = np.empty(side, np.int64)
    cls[order] = exchange(grid[np.ix_(order, order)], len(top), min(classes, 120))
    own = int(cls.max()) - 1  # behind the classes: all other words, the edge
    hot = np.zeros((side, own + 2))
    hot[np.arange(side), cls] = 1
    prefer = preferences(hot.T @ grid @ hot, own)
    doc = F.struct("doc_id", "text", "held_out", F.lit(ends).cast("bigint").alias("train_docs")).alias("doc")
    packed, width = K.dealt(docs.select(doc), ["doc.doc_id", "doc.text"], n, size)
    packed = packed.repartition(width, "_chunk")
    sent = packed.groupBy("_chunk").applyInArrow(_send(ranges, top, cls, own + 2), SENT)
    answers = K.keep(sent.repartition(wide, "rng").groupBy("rng").applyInArrow(_classify(top, cls, prefer), ANSWER))
    mass, words = np.zeros(own), np.zeros(own)
    for r in answers.where("class is not null").groupBy("class").agg(F.sum("mass").alias("m"), F.sum("words").alias("w")).collect():  # a row per class
        mass[r["class"]], words[r["class"]] = r["m"], r["w"]
    reply = answers.where("class is null").select(F.col("chunk").alias("_chunk"), "rng", "totals", "classes").repartition(width, "_chunk")
    emitted = K.keep(packed.groupBy("_chunk").cogroup(reply.groupBy("_chunk")).applyInArrow(_emit(ranges, np.log10(mass + 1), discount, tokens_n, vocab), COUNTED))
    g = _matrix(emitted.where(~F.col("held_out")).select("cells", "n").mapInArrow(_transitions, "cell int, n bigint"), own + 2)
    model = transition_model(g, (discount * words + 1) / (mass + 1), vocab)
    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    return emitted.mapInArrow(_score(model, tokens_n), out)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document under the contract's columns."""
    return score_texts(K.read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_lm_scoring": op10_lm_scoring}
SQL: dict[str, str] = {}
