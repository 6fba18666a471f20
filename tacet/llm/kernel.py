"""Vectorised text kernels that run inside Arrow-batched workers, and shared helpers.

Texts are handled as one byte buffer with offsets: words are found by a 256-entry
separator table, hashed eight bytes at a time, and windows of words are hashed by a
rolling polynomial (Rabin-Karp) modulo 2**64. No step walks a text in Python.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tacet.operators.graph import components  # noqa: F401 (used as kernel.components)
from tacet.sources.shared import keep, spread  # noqa: F401

U64 = np.uint64
#: Bytes of text of one chunk (a group in a worker) and of one shuffle partition (many chunks).
CHUNK_BYTES = 1 << 20
PARTITION_BYTES = 64 << 20
#: Narrow rows (ids, hashes, places) of one shuffle partition.
PARTITION_ROWS = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of the licence scan are runs of digits, letters and bytes over 0x7F.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def buffer_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    offs = np.frombuffer(off, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def pieces(column, limit: int = 1 << 20):
    """Row ranges of a string column with about ``limit`` bytes each (one row at least)."""
    _, offs = buffer_of(column)
    n, at = len(offs) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to
        at = to


def words_of(buf: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE):
    """Starts and ends of the words, and for each text the number of its first word (n + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    gap = sep[buf]
    before = np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    before[offs[:-1][offs[:-1] < len(buf)]] = True
    after = np.empty_like(gap)
    after[-1], after[:-1] = True, gap[1:]
    after[offs[1:][offs[1:] > 0] - 1] = True
    starts = np.flatnonzero(~gap & before)
    ends = np.flatnonzero(~gap & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    size = (ends - starts).astype(np.uint64)
    h = (size + U64(seed)) * U64(BASE)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero(size <= 64)
    at, left = starts[live], size[live]
    while len(live):
        take = np.minimum(left, U64(8))
        block = eight[at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - take * U64(8)))
        x = (h[live] ^ block) * U64(0xD6E8FEB86659FD93)
        h[live] = x ^ (x >> U64(32))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - U64(8)
    for i in np.flatnonzero(size > 64):
        digest = hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little"))
        h[i] = U64(int.from_bytes(digest.digest(), "little"))
    return mix(h)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, U64(base)), np.full(size, U64(pow(base, -1, 1 << 64)))
        up[0] = down[0] = 1
        have = np.cumprod(up), np.cumprod(down)
        if size <= 1 << 18:  # longer ones belong to a single long text and are not kept
            _powers[base] = have
    return have[0][:n], have[1][:n]


def rolling(wh: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp: hash of the k words from each word on (len - k + 1 values), by prefix sums modulo 2**64."""
    n = len(wh) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(wh))
    total = np.zeros(len(wh) + 1, np.uint64)
    np.cumsum(wh * up, out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def per_text(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a value per word (or other place) over each text, which depend on nothing but the text."""
    out = np.zeros(len(first) - 1, x.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(x, first[full])
    return out


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """Which of the windows of k words lie within one text."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + k <= end


def planar(x: np.ndarray, size: int) -> bytes:
    """Little-endian values byte plane by byte plane: sorted or small values then compress in the shuffle."""
    return np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes()


def unplanar(b, size: int) -> np.ndarray:
    x = np.frombuffer(b, np.uint8)
    return np.ascontiguousarray(x.reshape(size, -1).T).reshape(-1).view(f"<u{size}")


def trim() -> None:
    """Gives freed memory back to the system: a worker lives on between tasks, and what it keeps counts against its executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def tidy(work):
    """A kernel over batches that trims its worker when its partition ends."""

    @functools.wraps(work)
    def run(batches):
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def struct_of(table: pa.Table, name: str = "doc") -> pa.StructArray:
    """A struct column of a group as one array."""
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.StructArray) else pa.concat_arrays(column.chunks)


def dealt(docs: DataFrame, by, chunks: int, size: int) -> tuple[DataFrame, int]:
    """Adds _chunk, by the values ``by`` and the input partition, so that repeated rows are spread too; and the partitions for ``size`` bytes."""
    at = F.pmod(F.xxhash64(F.spark_partition_id(), *by), F.lit(chunks)).cast("int")
    return docs.withColumn("_chunk", at), parts(docs.sparkSession, min(chunks, math.ceil(size / PARTITION_BYTES)))


def crc32_column(c):
    """crc32 of an id as text."""
    return F.crc32(F.encode(c.cast("string"), "UTF-8"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, spread over all cores if it has fewer parts."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def lookup(rows: DataFrame, table: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """rows left-joined with table (one row per key; ``count``: how many rows have it) by key, without gathering a common key's rows.

    Keys with more than one in ``share`` of the counted rows are fewer than ``share`` and are
    broadcast; their rows stay where they are. All others are joined by a shuffle.
    """
    table = table.withColumnRenamed(key, "_key")
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(table.where(F.col(count) * share > total))
    on = F.col(key) == F.col("_key")
    near = rows.join(hot, on)
    far = rows.join(hot.select("_key"), on, "left_anti").join(table, on, "left")
    return near.unionByName(far).drop("_key", count)


def running(rows: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """rows with the sum of ``value`` over all rows before each in the order (of distinct values): sums per range, then within the range."""
    spark = rows.sparkSession
    dealt = keep(rows.repartitionByRange(parts(spark, 1), order).withColumn("_pid", F.spark_partition_id()))
    before, at = [], 0
    for pid, held in sorted(dealt.groupBy("_pid").agg(F.sum(value)).collect()):  # a row per partition
        before.append((pid, at))
        at += held
    starts = F.broadcast(spark.createDataFrame(before, "_pid int, _before bigint"))
    own = F.sum(value).over(W.partitionBy("_pid").orderBy(order)) - F.col(value)
    return dealt.join(starts, "_pid").withColumn(name, F.col("_before") + own).drop("_pid", "_before")


def block_tasks(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Members of tasks: ``columns``, i, j, side, of rows that have also left, block and blocks.

    Rows of a group are compared left with left (each pair once) and left with others. Task (i, j) holds
    the left rows of block i (side 0), and of block j the left rows if j > i (side 1) and the others (side 2).
    """
    every = F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)

    def task(i, j, side):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))

    lefts = F.transform(every, lambda j: task(F.col("block"), j, 0))
    later = F.transform(F.filter(every, lambda i: i < F.col("block")), lambda i: task(i, F.col("block"), 1))
    others = F.transform(every, lambda i: task(i, F.col("block"), 2))
    return rows.select(*columns, F.explode(F.when(F.col("left"), F.concat(lefts, later)).otherwise(others)).alias("t")).select(*columns, "t.*")


def in_order(table: pa.Table, keys: list[str], then: list[str]):
    """The tasks of a bin: (table in order, where each task of two rows or more begins and ends)."""
    table = table.sort_by([(c, "ascending") for c in [*keys, *then]])
    new = np.zeros(max(0, table.num_rows - 1), bool)
    for c in keys:
        k = table.column(c).to_numpy()
        new |= k[1:] != k[:-1]
    cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [table.num_rows]])
    return table, [(a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a > 1]


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text of a table."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    return row["n"], row["b"] or 0


def parts(spark: SparkSession, wanted: int) -> int:
    """Shuffle partitions for ``wanted`` chunks: at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)


def chunks_for(size: int, per: int, least: int = 48) -> int:
    return max(least, math.ceil(size / per))
