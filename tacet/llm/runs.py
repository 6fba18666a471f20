"""Operator 13: periodic runs of words, by heavy/light lag counting.

A run of period q has q (and at least 12 - q) consecutive places whose word stands again q words later, so
a lag can only be the period of a run if so many places match at it. Matches per lag are counted exactly and
without comparing the text with itself at every lag: words that are frequent in a text by the
autocorrelation of their places (FFT, rounded to whole numbers), rare ones by the differences of all pairs of
their places. Lags with enough matches, and no others, are scanned for islands of matches.

A scan of lag q looks at places half an island apart, at a block of half an island each: any island that is long
enough holds one of these blocks whole. Blocks are compared by rolling hashes, islands found that way by the words
themselves. Lags go in ascending order. A block within a run whose period divides the lag is passed over: by the
theorem of Fine and Wilf a run of the larger period shares less than that with it, unless it is the same run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacet.llm import kernel as K

LEAST = 12
DIFFERENCES = 1 << 20  # so many are counted at a time
BLOCK_WORDS = 1 << 17  # words that are joined at a time


def word_numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number per word, equal for equal bytes only."""
    if not len(starts):
        return np.zeros(0, np.int64)
    letters = ~K.SPACE[buf]
    offs = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(buf[letters])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _even(n: int) -> int:
    """The least length of at least n with small factors, for the FFT."""
    return min(x << max(0, (-(-n // x) - 1).bit_length()) for x in (1, 3, 5, 9, 15))


def lag_matches(ids: np.ndarray, first: np.ndarray, heavy: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(matches, begin): how often words of a text stand a lag apart, at begin[text] + lag - 1, for lags up to half the text.

    Frequent are words with more places than the square root of n log n (or ``heavy``, for tests).
    """
    size = np.diff(first)
    begin = np.concatenate([[0], np.cumsum(size // 2)])
    count = np.zeros(int(begin[-1]), np.int64)
    if not len(count):
        return count, begin
    text = np.repeat(np.arange(len(size)), size)
    by = np.lexsort((ids, text))  # equal words of a text stand together, in the order of their places
    new = np.ones(len(by), bool)
    new[1:] = (ids[by[1:]] != ids[by[:-1]]) | (text[by[1:]] != text[by[:-1]])
    lead = np.flatnonzero(new)
    often = np.diff(np.append(lead, len(by)))
    limit = np.full(len(size), float(heavy)) if heavy is not None else np.sqrt(size * np.log2(np.maximum(size, 2)))
    is_heavy = often > limit[text[by[lead]]]
    groups = np.flatnonzero(is_heavy)
    owner = text[by[lead[groups]]]
    for t in np.unique(owner):
        n, half = int(size[t]), int(size[t] // 2)
        width = _even(n + half + 1)  # wide enough that no lag up to half wraps around
        power = np.zeros(width // 2 + 1)
        for g in groups[np.searchsorted(owner, t) : np.searchsorted(owner, t, "right")]:
            here = np.zeros(width)
            here[by[lead[g] : lead[g] + often[g]] - first[t]] = 1
            wave = np.fft.rfft(here)
            power += wave.real**2 + wave.imag**2
        count[begin[t] : begin[t + 1]] += np.rint(np.fft.irfft(power, width)[1 : half + 1]).astype(np.int64)
    behind = np.repeat(lead + often, often)
    live = np.flatnonzero(~np.repeat(is_heavy, often))
    waiting, held, apart = [], 0, 0
    while True:
        apart += 1
        live = live[live + apart < behind[live]]
        at = by[live]
        lag, t = by[np.minimum(live + apart, len(by) - 1)] - at, text[at]
        near = lag <= size[t] // 2  # pairs farther apart are over half the text too
        live = live[near]
        waiting.append(begin[t[near]] + lag[near] - 1)
        held += len(live)
        if held > DIFFERENCES or not len(live):
            count += np.bincount(np.concatenate(waiting), minlength=len(count))
            waiting, held = [], 0
        if not len(live):
            return count, begin


def _onward(ids: np.ndarray, at: int, stop: int, q: int) -> int:
    """The first place from ``at`` on, up to ``stop``, whose word does not stand again q words later."""
    width = 64
    while at < stop:
        to = min(at + width, stop)
        differ = ids[at:to] != ids[at + q : to + q]
        if differ.any():
            return at + int(differ.argmax())
        at, width = to, 2 * width
    return stop


def _back(ids: np.ndarray, at: int, stop: int, q: int) -> int:
    """The least place, down to ``stop``, from which on to ``at`` every word stands again q words later."""
    width = 64
    while at > stop:
        to = max(at - width, stop)
        differ = ids[to:at] != ids[to + q : at + q]
        if differ.any():
            return at - int(differ[::-1].argmax())
        at, width = to, 2 * width
    return stop


def _inside(hits: np.ndarray, reach: int, found: list[tuple[int, int, int]], q: int) -> np.ndarray:
    """Which of the places lie, with ``reach`` words from there on, in a found run whose period divides q."""
    known = np.array([(s, s + n) for s, n, p in found if q % p == 0], np.int64).reshape(-1, 2)
    known = known[np.argsort(known[:, 0], kind="stable")]
    until = np.maximum.accumulate(np.concatenate([[-1], known[:, 1]]))
    return until[np.searchsorted(known[:, 0], hits, "right")] >= hits + reach


def find_runs(ids: np.ndarray, first: np.ndarray, least: int = LEAST, heavy: float | None = None) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period), by start and then period; ids number the words of all texts."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(first) - 1)]
    count, begin = lag_matches(ids, first, heavy)
    if not len(count):
        return out
    owner = np.repeat(np.arange(len(out)), np.diff(begin))
    lag = np.arange(len(count)) - begin[owner] + 1
    enough = np.flatnonzero(count >= np.maximum(least - lag, lag))
    if not len(enough):
        return out
    enough = enough[np.argsort(lag[enough], kind="stable")]
    lags, cuts = np.unique(lag[enough], return_index=True)
    owner = owner[enough]
    del lag
    up, _ = K.powers(len(ids))
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(K.mix(ids.astype(np.uint64) + K.U64(1)) * up, out=total[1:])
    for q, a, b in zip(lags.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(enough)], strict=True):
        need = max(least - q, q)
        t = owner[a:b][count[enough[a:b]] >= need]  # matches within runs of periods that divide q are taken off
        block = (need + 1) // 2
        looks = (first[t + 1] - first[t] - q) // block
        t, looks = t[looks > 0], looks[looks > 0]
        if not len(t):
            continue
        which = np.arange(int(looks.sum())) - np.repeat(np.cumsum(looks) - looks, looks)
        at = np.repeat(first[t], looks) + which * block
        same = (total[at + block] - total[at]) * up[q] == total[at + q + block] - total[at + q]
        at = at[same]
        hit = np.repeat(t, looks)[same]
        for x in np.unique(hit).tolist():
            base, end = int(first[x]), int(first[x + 1])
            own, found, done = ids[base:end], out[x], 0
            places = at[np.searchsorted(hit, x) : np.searchsorted(hit, x, "right")] - base
            if found:
                places = places[~_inside(places, q + block, found, q)]
            for i in places.tolist():
                if i < done:
                    continue
                done = max(_onward(own, i, end - base - q, q), i + 1)
                low = _back(own, i, 0, q)
                if done - low >= need:
                    found.append((low, done - low + q, q))
                    k = np.arange(2 * q, min(done - low + q, (end - base) // 2 + 1), q)
                    count[begin[x] + k - 1] -= done - low + q - k
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def _spaced(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """The words, joined by one space, block by block; the last block ends with a space."""
    for a in range(0, len(starts), BLOCK_WORDS):
        s, e = starts[a : a + BLOCK_WORDS], ends[a : a + BLOCK_WORDS]
        behind = np.cumsum(e - s + 1)
        place = np.arange(int(behind[-1])) + np.repeat(s - np.concatenate([[0], behind[:-1]]), e - s + 1)
        text = buf[np.minimum(place, len(buf) - 1)]
        text[behind - 1] = 0x20
        yield text


def _kernel(least: int, rearrange: Callable | None, texts: bool, shape: pa.Schema):
    def one(buf, starts, ends, runs):
        gone = np.zeros(len(starts) + 1, np.int64)
        for s, n, q in runs:
            gone[s + q] += 1
            gone[s + n] -= 1
        stay = np.cumsum(gone)[:-1] == 0
        digest, parts, late = hashlib.sha256(), [], b""
        for block in _spaced(buf, starts[stay], ends[stay]):
            raw = late + block.tobytes()
            raw, late = raw[:-1], b" "  # a space stands between words only
            digest.update(raw)
            if texts:
                parts.append(raw)
        listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        return listed, digest.hexdigest(), b"".join(parts).decode() if texts else None

    @K.tidy
    def work(batches):
        for batch in batches:
            doc = batch.column("doc")
            doc = pa.StructArray.from_arrays(doc.flatten(), fields=list(doc.type))
            for a, b in K.pieces(doc.field("text")):
                part = doc.slice(a, b - a)
                buf, offs = K.buffer_of(part.field("text"))
                starts, ends, first = K.words_of(buf, offs)
                ids = word_numbers(buf, starts, ends)
                if rearrange is not None:
                    order = np.arange(len(starts))
                    for k, doc_id in enumerate(part.field("doc_id").to_pylist()):
                        n = int(first[k + 1] - first[k])
                        new = rearrange(doc_id, n)
                        if new is not None:
                            order[first[k] : first[k + 1]] = first[k] + new
                    starts, ends, ids = starts[order], ends[order], ids[order]
                found = find_runs(ids, first, least)
                cols: dict[str, list] = {c: [] for c in shape.names if c not in ("doc", "n_words")}
                for k, runs in enumerate(found):
                    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                    listed, kept, text = one(buf, starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], runs)
                    row = {"n_runs": len(runs), "start": s, "length": n, "period": q, "exponent_milli": None if q is None else 1000 * n // q, "runs_sha256": listed, "collapsed_sha256": kept, "runs": [{"start": s, "length": n, "period": q} for s, n, q in runs], "collapsed": text}
                    for c, values in cols.items():
                        values.append(row[c])
                arrays = [part, pa.array(np.diff(first)), *[pa.array(v, shape.field(c).type) for c, v in cols.items()]]
                yield pa.RecordBatch.from_arrays(arrays, names=shape.names)

    return work


def periodic_runs(docs: DataFrame, *, least: int = LEAST, rearrange: Callable | None = None, texts: bool = True) -> DataFrame:
    """Per row of docs: doc (struct of its columns), n_words, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256, runs, collapsed.

    A run is a stretch of words with smallest period q, of ``least`` and of 2 q words at least, that no
    neighbouring word extends. Of equally long runs the first is the longest, then that of the least period;
    without a run the four are null. ``collapsed`` is the text without the words that a run holds after its
    first q, joined by one space. Null and empty texts have no words and no runs; equal rows give equal
    results; other columns pass through in doc. ``rearrange`` (doc_id, n) may give new places of a text's
    words, for planted runs. With ``texts`` off, runs and collapsed are left out. Nothing is shuffled: a
    text is handled whole by one task, which needs some 150 bytes a word and, for the frequent words of a text of n
    words, in turn one transform of 1.5 n places. Words are compared by their bytes.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    ddl = "n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    ddl += ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" * texts
    shape = T.StructType([whole.schema["doc"], *T.StructType.fromDDL(ddl)])
    return whole.mapInArrow(_kernel(least, rearrange, texts, arrow_schema(shape)), shape)


def arrow_schema(shape: T.StructType) -> pa.Schema:
    """The Arrow types of the added columns (doc passes through as it comes)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(shape)


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The query's planted runs: in a tenth of the texts, by a hash of the id, words from one place on repeat. No id counts as an empty one."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i >= a, a + (i - a) % p, i)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every document."""
    docs = K.read(spark, sf_dir, "documents").select("doc_id", "text")
    out = periodic_runs(docs, rearrange=planted, texts=False)
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
SQL: dict[str, str] = {}
