"""Operator 2: removal of repeated passages (exact substring dedup on word windows).

Every window of ``k`` consecutive words gets a Rabin-Karp hash. Texts are dealt into chunks of a
megabyte, many to a partition. A chunk sends each distinct window once, with the least doc_id that
has it there (copies inside the chunk are settled at once), packed by hash range; a range finds the
least doc_id of each window and answers every chunk with one bit per window it sent. Chunks then
merge the windows to remove into maximal intervals. The texts' one shuffle serves both passes,
and a window that a third of all documents hold costs one entry per chunk.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacet.llm import kernel as K

WINDOW = 13
RANGE_WINDOWS = 1 << 20
NO_ID = np.iinfo(np.int64).max


def _windows(table: pa.Table, k: int, ranges: int):
    """The chunk in order of doc_id, its words, the places of its windows, and the distinct windows it sends.

    Sent are hashes and least ids, by range and then by hash; ``which`` numbers the sent window of each
    place, ``inner`` marks places whose window a smaller id of the same chunk has too.
    """
    doc = K.struct_of(table)
    ids = pc.fill_null(doc.field("doc_id").cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    doc, ids = doc.take(pa.array(order)), ids[order]
    buf, offs = K.buffer_of(doc.field("text"))
    starts, ends, first = K.words_of(buf, offs)
    starts, ends = starts.astype(np.int32), ends.astype(np.int32)
    wh = K.word_hashes(buf, starts, ends)
    at = np.flatnonzero(K.whole(first, k)).astype(np.int32)
    if not len(at):
        none = np.zeros(0, np.int64)
        return doc, buf, offs, starts, ends, first, at, none, none.astype(np.uint64), none, none.astype(bool), np.zeros(ranges + 1, np.int64)
    part = ((K.rolling(K.mix(wh + K.U64(77)), k)[at] >> K.U64(33)) % K.U64(ranges)).astype(np.uint32)
    h = K.rolling(wh, k)[at]
    del wh
    by = np.argsort(h, kind="stable")  # equal hashes stay in the order of ids
    h = h[by]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    lead = by[new]
    own = np.repeat(ids, np.diff(first))[at]
    hashes, least, part = h[new], own[lead], part[lead]
    del h
    to = np.argsort(part, kind="stable")
    place = np.empty(len(to), np.int32)
    place[to] = np.arange(len(to), dtype=np.int32)
    which = np.empty(len(by), np.int32)
    which[by] = place[np.cumsum(new, dtype=np.int32) - 1]
    hashes, least = hashes[to], least[to]
    return doc, buf, offs, starts, ends, first, at, which, hashes, least, own > least[which], np.searchsorted(part[to], np.arange(ranges + 1))


def _send(k: int, ranges: int):
    def send(table: pa.Table) -> pa.Table:
        *_, hashes, least, _, cuts = _windows(table, k, ranges)
        live = np.flatnonzero(np.diff(cuts))
        chunk = pa.array(np.full(len(live), table.column("_chunk")[0].as_py(), np.int32))
        blobs, ids = ([K.planar(x[cuts[r] : cuts[r + 1]], 8) for r in live] for x in (hashes, least))
        del hashes, least
        K.trim()
        return pa.table({"rng": pa.array(live.astype(np.int32)), "chunk": chunk, "blob": pa.array(blobs, pa.binary()), "ids": pa.array(ids, pa.binary())})

    return send


def _count(table: pa.Table) -> pa.Table:
    """One bit per window sent: whether another chunk has it with a smaller id."""
    blobs = [K.unplanar(b.as_buffer(), 8) for b in table.column("blob")]
    cuts = np.cumsum([0, *map(len, blobs)])
    h = np.concatenate(blobs)
    del blobs
    ids = np.concatenate([K.unplanar(i.as_buffer(), 8).view(np.int64) for i in table.column("ids")])
    by = np.argsort(h, kind="stable")
    h = h[by]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    del h
    least = np.minimum.reduceat(ids[by], begin)
    later = np.empty(len(by), bool)
    later[by] = ids[by] > np.repeat(least, np.diff(np.append(begin, len(by))))
    got = [i for i in range(len(cuts) - 1) if later[cuts[i] : cuts[i + 1]].any()]
    out = pa.table({"_chunk": pa.array([table.column("chunk")[i].as_py() for i in got], pa.int32()), "rng": pa.array([table.column("rng")[i].as_py() for i in got], pa.int32()), "bits": pa.array([np.packbits(later[cuts[i] : cuts[i + 1]]).tobytes() for i in got], pa.binary())})
    del ids, by, begin, least, later
    K.trim()
    return out


def kept_bytes(buf, offs, starts, ends, first, gone):
    """For each text its kept words, joined by one space."""
    stay = ~gone
    step = np.zeros(len(buf) + 2, np.int8)
    step[starts[stay]] = 1
    cover = np.zeros(len(buf) + 2, np.int8)
    cover[ends[stay]] = 1
    inside = np.cumsum(step[:-1] - cover[:-1], dtype=np.int32)[: len(buf) + 1] > 0
    last = np.zeros(len(buf) + 1, bool)
    last[offs[1:]] = True
    behind = ends[stay]
    behind = behind[~last[behind]]  # no separator stands behind a text's last byte
    take = inside.copy()
    take[behind] = True
    text = np.where(K.SPACE[buf], np.uint8(0x20), buf)[take[:-1]]
    at = np.concatenate([[0], np.cumsum(take[:-1])])[offs]
    raw = text.tobytes()
    return [raw[at[i] : at[i + 1]].rstrip(b" ") for i in range(len(offs) - 1)]


def _merge(k: int, ranges: int, texts: bool):
    def merge(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("doc", pa.null()),)})
        doc, buf, offs, starts, ends, first, at, which, hashes, least, inner, cuts = _windows(table, k, ranges)
        foreign = np.zeros(len(hashes), bool)
        del hashes, least
        for r, bits in zip(answers.column("rng").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            foreign[cuts[r] : cuts[r + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cuts[r + 1] - cuts[r]).astype(bool)
        hit = at[foreign[which] | inner] if len(at) else at
        del which, foreign, inner
        step = np.zeros(len(starts) + 1, np.int32)  # a place is the start of one window, so no index repeats
        step[hit] += 1
        step[hit + k] -= 1
        gone = np.cumsum(step)[:-1] > 0
        del step, at, hit
        total = np.concatenate([[0], np.cumsum(gone)])
        edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
        edge_at = np.zeros(len(starts) + 1, bool)
        edge_at[first[:-1][first[:-1] < len(starts)]] = True
        begin = np.flatnonzero(gone & ((edge[:-1] == 1) | edge_at[:-1]))
        stop_here = np.zeros(len(starts), bool)
        stop_here[first[1:][first[1:] > 0] - 1] = True
        stop = np.flatnonzero(gone & ((edge[1:] == -1) | stop_here)) + 1
        owner = np.searchsorted(first, begin, "right") - 1
        spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(len(offs))).astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin - first[owner]), pa.array(stop - first[owner])], ["first", "last"]))
        kept = kept_bytes(buf, offs, starts, ends, first, gone)
        out = {"doc": doc, "n_words": pa.array(np.diff(first)), "n_removed": pa.array(np.diff(total[first])), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept]), "spans": spans}
        if texts:
            cut = np.zeros(len(buf) + 1, np.int8)
            lead = np.concatenate([[0], ends[:-1]]) if len(starts) else starts
            lead = np.maximum(lead, np.repeat(offs[:-1], np.diff(first)))  # a removed word takes the gap before it along
            cut[lead[gone]] += 1
            done = np.zeros(len(buf) + 1, np.int8)
            done[ends[gone]] += 1
            stay = ~(np.cumsum(cut - done, dtype=np.int32)[:-1] > 0)
            raw, place = buf[stay].tobytes(), np.concatenate([[0], np.cumsum(stay)])[offs]
            out["text"] = pa.array([raw[place[i] : place[i + 1]].decode() for i in range(len(offs) - 1)], pa.string())
        del kept, buf
        K.trim()
        return pa.table(out)

    return merge


def remove_repeats(docs: DataFrame, k: int = WINDOW, *, texts: bool = True, chunk_bytes: int = K.CHUNK_BYTES, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """Per row of docs: doc (struct of its columns), n_words, n_removed, kept_sha256, spans, and text (what is left).

    A word goes if it lies in a window of k words that also starts in a document with a smaller
    doc_id; windows are judged on the input. Rows that share a doc_id are copies of one document:
    they never remove from each other, and are spread over the chunks like any other. Null ids count
    as larger than any; null and empty texts have no words and stay as they are (text then is empty).
    Other columns pass through in doc. In ``text`` a removed word takes along the white space before
    it. One text is handled whole: a worker needs some 40 bytes per byte of the longest text. Windows are
    equal if their 64-bit hashes and, by another hash, their ranges are: among 10**12 windows in 10**6
    ranges some two differ and still count as equal with a probability of 3 %.
    """
    spark = docs.sparkSession
    rows, size = K.text_bytes(docs)
    n = max(1, min(rows, K.chunks_for(size, chunk_bytes)))
    ranges = max(16, math.ceil(size / 6 / range_windows))
    packed, width = K.dealt(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), ["doc.doc_id", "doc.text"], n, size)
    packed = packed.repartition(width, "_chunk")
    sent = packed.groupBy("_chunk").applyInArrow(_send(k, ranges), "rng int, chunk int, blob binary, ids binary")
    sent = sent.repartition(K.parts(spark, math.ceil(ranges / 8)), "rng")  # several ranges each, to even them out
    bits = sent.groupBy("rng").applyInArrow(_count, "_chunk int, rng int, bits binary").repartition(width, "_chunk")
    shape = T.StructType([packed.schema["doc"], *T.StructType.fromDDL("n_words bigint, n_removed bigint, kept_sha256 string, spans array<struct<first:bigint,last:bigint>>" + ", text string" * texts)])
    return packed.groupBy("_chunk").cogroup(bits.groupBy("_chunk")).applyInArrow(_merge(k, ranges, texts), shape)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    docs = K.read(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, texts=False).select(F.col("doc.doc_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
SQL: dict[str, str] = {}
