"""Operator 5: packing documents into training sequences by shortest-pack-first on the length histogram.

Documents are tokenised and cut into pieces of at most ``limit`` tokens. The histogram of piece
lengths (at most ``limit`` entries, whatever the input) is packed on the driver: longest lengths
first, each into the shortest pack that still exists, updating counts of packing patterns. Each
piece then finds its pattern by its rank among the pieces of its length: ranks come from counts
per input partition, so no length is gathered in one task.

Token ids come from the tokenizer file. A text may be cut where white space follows other characters;
no token of a byte-level BPE of this kind reaches over such a place. Latin texts go in long slices to a
rank encoder built from the same file (equal ids, several times faster); it keeps no cache, as most
distinct stretches of a large corpus are rare and a cache of them costs more than their encoding.
Stretches with other letters go to the tokenizer itself, each distinct one once while a bounded cache
holds it. Texts with other white space than ASCII's, or with a special token's string, are encoded
whole by the tokenizer.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tacet.llm import kernel as K

LIMIT = 2048
END_ID = 1
#: Stretches that the cache holds, and the most characters of one that is kept.
CACHE = 150_000
KEPT_CHARS = 256
#: Bytes of text, as a power of two, that the rank encoder gets at once (one stretch at least).
SLICE_BITS = 16
#: Pieces of one segment where the order of the documents counts.
SEGMENT = 4096
#: Stretches with letters from here on, beyond Latin, go to the tokenizer itself, whose Unicode tables are its own.
PLAIN = "\u0250".encode()
#: White space that is not ASCII's, and controls that some tables count as such (an RE2 pattern).
ODD = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]"
#: The split pattern of byte-level BPE vocabularies of this kind (a fixed value of that public format).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same where no two white spaces meet: without look-ahead, which a third of the time goes into.
SINGLE = SPLIT.replace(r"\s+(?!\S)|", "")


def _bytes_of_symbols() -> dict[str, int]:
    """The printable symbols that stand for bytes in such vocabulary files."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_encoders(path: str):
    """Faster encoders with the same ids: of texts where no two white spaces meet, and of any; None where the file's merges are not in the order of their ids."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not file.get("normalizer") and not model.get("ignore_merges") and not model.get("dropout")
    if not plain:
        return None
    vocab, special = model["vocab"], {t["content"] for t in file["added_tokens"]}
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    if made != sorted(made):
        return None
    symbol = _bytes_of_symbols()
    ranks = {bytes(symbol[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tuple(tiktoken.Encoding("ranks", pat_str=p, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary for p in (SINGLE, SPLIT))


class Encoder:
    """Token ids of whole texts, by way of slices and stretches of them."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fast = rank_encoders(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def reset(self) -> None:
        self.known: dict[str, bytes] = {}

    def _slow(self, stretches: pa.StringArray) -> np.ndarray:
        """The ids of each stretch by the tokenizer, as bytes."""
        if len(self.known) > CACHE:
            self.reset()
        coded = stretches.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [s for s in distinct if s not in self.known]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            ends = [0, *itertools.accumulate(4 * len(x) for x in ids)]
            raw = np.fromiter(itertools.chain.from_iterable(ids), "<u4", ends[-1] // 4).tobytes()
            self.known.update((s, raw[a:b]) for s, (a, b) in zip(part, itertools.pairwise(ends), strict=True))
        ids = np.empty(len(distinct), object)
        ids[:] = [self.known[s] for s in distinct]
        for s in new:
            if len(s) > KEPT_CHARS:
                del self.known[s]
        return ids[coded.indices.to_numpy()]

    def encode(self, column, end: int):
        """The ids of all texts behind each other, each closed by ``end``, and their lengths."""
        if column.null_count:
            column = pc.fill_null(column, "")
        buf, offs = K.buffer_of(column)
        odd = pc.match_substring_regex(column, ODD)
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(column, s))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        gap = K.SPACE[buf]
        start = gap.copy()
        start[1:] &= ~gap[:-1]
        start[offs[:-1][offs[:-1] < len(buf)]] = True
        for d in np.flatnonzero(odd):  # one stretch each
            start[offs[d] + 1 : offs[d + 1]] = False
        starts = np.flatnonzero(start)
        doc = np.searchsorted(offs, starts, "right") - 1
        # who encodes a stretch: the rank encoders (0, and 1 if white spaces meet in it) or the tokenizer (2)
        by = np.full(len(starts), 0 if self.fast else 2, np.int8)
        if self.fast:
            by[np.searchsorted(starts, np.flatnonzero(gap[1:] & gap[:-1]), "right") - 1] = 1
            beyond = buf > PLAIN[0]
            beyond[:-1] |= (buf[:-1] == PLAIN[0]) & (buf[1:] >= PLAIN[1])
            by[np.searchsorted(starts, np.flatnonzero(beyond), "right") - 1] = 2
            by[odd[doc]] = 2
            by[(by == 1) & (np.diff(starts, append=len(buf)) >> SLICE_BITS > 0)] = 2  # a run of white space there may exceed the look-ahead's stack
        # neighbouring stretches of one text that a rank encoder gets are one slice
        cut = np.ones(len(starts), bool)
        cut[1:] = (by[1:] == 2) | (by[1:] != by[:-1]) | (doc[1:] != doc[:-1]) | (starts[1:] >> SLICE_BITS != starts[:-1] >> SLICE_BITS)
        starts, by = starts[cut], by[cut]
        slices = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(buf)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf)))
        ids = np.empty(len(starts), object)
        for k, fast in enumerate(self.fast or ()):
            ids[by == k] = [np.array(fast(s), "<u4").tobytes() for s in slices.filter(pa.array(by == k)).to_pylist()]
        ids[by == 2] = self._slow(slices.filter(pa.array(by == 2)))
        first = np.searchsorted(starts, offs)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        closed = np.insert(ids, first[1:], np.uint32(end).astype("<u4").tobytes())
        return np.frombuffer(b"".join(closed), "<u4"), K.per_text(size, first) + 1


def _cut(path: str, limit: int, end: int):
    """Pieces of the texts; columns behind doc_id and text go along."""

    @K.tidy
    def cut(batches):
        from pyspark import TaskContext

        pid, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        encoder = Encoder.of(path)
        for batch in batches:
            for a, b in K.pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                flat, total = encoder.encode(part.column(1), end)
                count = -(-total // limit)
                doc = np.repeat(np.arange(len(total)), count)
                begin = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * limit
                size = np.minimum(limit, total[doc] - begin)
                at = (np.cumsum(total) - total)[doc] + begin
                raw = memoryview(flat.tobytes())
                crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), size.tolist(), strict=True)]
                order = np.argsort(size, kind="stable")
                counts = np.bincount(size, minlength=limit + 1)
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - (np.cumsum(counts) - counts)[size[order]]
                rank += seen[size]
                seen += counts
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(begin), pa.array(size), pa.array(crc, pa.int64()), pa.array(total[doc]), pa.array(np.full(len(doc), pid)), pa.array(rank), *[c.take(pa.array(doc)) for c in part.columns[2:]]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pid", "local", *part.schema.names[2:]])
        encoder.reset()  # a worker lives on, its cache need not

    return cut


def patterns(histogram: dict[int, int], limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first: [(how many packs, [(length, copies)])], longest lengths placed first."""
    room: dict[int, list[list]] = defaultdict(list)  # by free space
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            free = max((s for s in room if s >= length and room[s]), default=None)
            if free is None:
                fit = limit // length
                full, rest = divmod(left, fit)
                if full:
                    room[limit - fit * length].append([full, [(length, fit)]])
                if rest:
                    room[limit - rest * length].append([1, [(length, rest)]])
                break
            packs, pattern = room[free].pop()
            used = min(packs, left)
            grown = [*pattern[:-1], (length, pattern[-1][1] + 1)] if pattern[-1][0] == length else [*pattern, (length, 1)]
            if packs > used:
                room[free].append([packs - used, pattern])
            room[free - length].append([used, grown])
            left -= used
            if not room[free]:
                del room[free]
    return [(n, p) for s in sorted(room) for n, p in room[s]]


def _assign(found: list, limit: int):
    """Arrays by (length, first rank): which pattern, where in it."""
    rows, taken, base = [], defaultdict(int), 0
    for n, pattern in found:
        offset = 0
        for length, copies in pattern:
            rows.append((length, taken[length], copies, base, offset))
            taken[length] += n * copies
            offset += length * copies
        base += n
    rows.sort()
    length, first, copies, start, offset = np.array(rows, np.int64).reshape(-1, 5).T
    key = length * (1 << 44) + first

    @K.tidy
    def assign(batches):
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(key, size * (1 << 44) + rank, "right") - 1
            pack, copy = np.divmod(rank - first[i], copies[i])
            out = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(start[i] + pack), pa.array(offset[i] + copy * size)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return assign


def pack(docs: DataFrame, path: str, *, limit: int = LIMIT, end: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are their end id alone. Each row is a document of its own, so repeated
    rows are packed as often as they occur; null ids stay null. Extra columns are ignored. The
    order of sequences means nothing; pack_in_order keeps an order.
    """
    whole = docs.select("doc_id", "text").mapInArrow(_cut(path, limit, end), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, pid bigint, local bigint")
    cut = K.keep(whole)
    per = cut.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    per = K.keep(per.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("pid")) - F.col("n")))
    histogram = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most limit rows
    # a row per input partition and length: grows with the input, so it is never broadcast
    ranked = cut.join(per.drop("n").hint("merge"), ["pid", "length"]).withColumn("rank", F.col("before") + F.col("local"))
    shape = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(_assign(patterns(histogram, limit), limit), shape)


@K.tidy
def _number(batches):
    """Numbers the rows of the partition."""
    from pyspark import TaskContext

    pid, seen = TaskContext.get().partitionId(), 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, pid, np.int64)), pa.array(seen + np.arange(batch.num_rows))], [*batch.schema.names, "pid", "local"])
        seen += batch.num_rows


def _pack_segment(limit: int):
    """Packs one stretch of the order; its sequences are numbered from 0 by their first piece in it."""

    def segment(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        size = table.column("length").to_numpy()
        order = np.argsort(size, kind="stable")
        counts = np.bincount(size, minlength=limit + 1)
        rank = np.empty(len(size), np.int64)
        rank[order] = np.arange(len(size)) - (np.cumsum(counts) - counts)[size[order]]
        found = patterns({int(x): int(counts[x]) for x in np.flatnonzero(counts)}, limit)
        batch = pa.RecordBatch.from_arrays([*[table.column(c).combine_chunks() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")], pa.array(rank)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank"])
        out = next(_assign(found, limit)(iter([batch])))
        _, first, which = np.unique(out.column("sequence_id").to_numpy(), return_index=True, return_inverse=True)
        place = np.empty(len(first), np.int64)
        place[np.argsort(first)] = np.arange(len(first))
        return pa.table({**{c: out.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}, "segment": table.column("segment"), "number": pa.array(place[which]), "offset": out.column("offset")})

    return segment


def pack_in_order(docs: DataFrame, path: str, *, limit: int = LIMIT, end: int = END_ID, segment: int = SEGMENT) -> DataFrame:
    """As pack, of docs (doc_id, text, _slot, _h): sequence_id follows the order of _slot, then _h.

    The pieces in this order are cut into segments of ``segment`` pieces. Each is packed for itself,
    and sequences are numbered by segment and in it by their first piece, so every prefix of the
    sequences holds the same prefix of the order but for one segment at most.
    """
    spark = docs.sparkSession
    shape = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    keys = ["_slot", "_h", "doc_id", "start", "ids_crc32"]
    cut = K.keep(docs.select("doc_id", "text", "_slot", "_h").mapInArrow(_cut(path, limit, end), f"{shape}, pid bigint, local bigint, _slot bigint, _h bigint").drop("pid", "local"))
    dealt = cut.repartitionByRange(K.parts(spark, -(-cut.count() // K.PARTITION_ROWS)), *keys).sortWithinPartitions(*keys)
    numbered = K.keep(dealt.mapInArrow(_number, f"{shape}, _slot bigint, _h bigint, pid bigint, local bigint"))
    per = {r["pid"]: r["n"] for r in numbered.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per shuffle partition
    rows, before = [], 0
    for pid in sorted(per):
        rows.append((pid, before))
        before += per[pid]
    starts = F.broadcast(spark.createDataFrame(rows, "pid bigint, before bigint"))
    at = numbered.join(starts, "pid").withColumn("at", F.col("before") + F.col("local")).withColumn("segment", F.floor(F.col("at") / segment))
    packed = K.keep(at.drop("_slot", "_h", "pid", "local", "before").repartition(K.parts(spark, -(-before // (64 * segment))), "segment").groupBy("segment").applyInArrow(_pack_segment(limit), f"{shape}, segment bigint, number bigint, offset bigint"))
    sizes = packed.groupBy("segment").agg((F.max("number") + 1).alias("n"))
    # a row per segment: grows with the input, so it is never broadcast
    base = K.running(sizes, "n", "segment", "base").select("segment", "base")
    return packed.join(base.hint("merge"), "segment").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("number")).alias("sequence_id"), "offset")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return pack(K.read(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op5_packing": op5_packing}
SQL: dict[str, str] = {}
