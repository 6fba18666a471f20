"""Operator 8: mixing sources to target weights by Pfair scheduling.

Documents of a source are cut into blocks by their rank in a hashed order. Block j of a source of
weight w is released at slot floor(j / w) and due at ceil((j + 1) / w); earliest deadline first then
fills the slots, and every source's share of every prefix stays less than one block from its target.
When a source runs out, time runs faster for the others, so their shares grow in proportion and every
document is placed exactly once.

The schedule has at most ``most_blocks`` blocks and one for each source, whatever the input; the
driver makes it. Ranks come from counts per range partition, and only the hash values at block
borders reach the driver, so a source with a third of all rows is spread like any other.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacet.llm import kernel as K

MOST_BLOCKS = 20_000
#: Without given weights a source weighs its size to this power: large ones give way a little.
POWER = 0.7


def interleave(blocks: list[int], weights: list[float]) -> list[tuple[int, int]]:
    """(source, block) of every slot, by earliest deadline first among released blocks.

    Times are kept in units in which a source of weight w serves a block per 1 / w, whatever other
    sources there are: a slot takes 1 over the weights still alive. Release and deadline of a block then
    never change when a source ends, and the whole schedule costs a logarithm per block.
    """
    out: list[tuple[int, int]] = []
    live, least = sum(w for n, w in zip(blocks, weights, strict=True) if n), min(weights, default=1.0)
    waiting = [(0.0, s, 0) for s, n in enumerate(blocks) if n]
    heapq.heapify(waiting)
    ready: list[tuple[float, int, int]] = []
    now, left = 0.0, sum(1 for n in blocks if n)
    while left:
        if not ready and waiting[0][0] > now:  # the sources that ended had been served ahead of their time
            now = waiting[0][0]
        after = now + 1 / live
        while waiting and (waiting[0][0] <= now or waiting[0][0] < after * (1 - 1e-12)):  # released within this slot
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, ((j + 1) / weights[s], s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j))
        now = after
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) / weights[s], s, j + 1))
        else:
            left -= 1
            live = max(live - weights[s], least)  # rounding must not end it
    return out


@K.tidy
def _local(batches):
    """Numbers the rows of each source within the partition."""
    from pyspark import TaskContext

    pid, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        source = batch.column("source").dictionary_encode()
        names = source.dictionary.to_pylist()
        codes = source.indices.fill_null(len(names)).to_numpy()
        names.append(None)
        rank = np.empty(len(codes), np.int64)
        for c in np.unique(codes):
            at = np.flatnonzero(codes == c)
            start = seen.get(names[c], 0)
            rank[at] = start + np.arange(len(at))
            seen[names[c]] = start + len(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), pid)), pa.array(rank)], [*batch.schema.names, "pid", "local"])


class Schedule:
    """Ranks of all rows (doc_id, source, h, rank), rows per block, and the slot of each block."""

    def __init__(self, docs: DataFrame, weights: dict | None = None, most_blocks: int = MOST_BLOCKS):
        spark = docs.sparkSession
        keyed = docs.select("doc_id", "source", F.xxhash64("doc_id").alias("h"))
        width = K.parts(spark, math.ceil(keyed.count() / K.PARTITION_ROWS))
        dealt = keyed.repartitionByRange(width, "source", "h", "doc_id").sortWithinPartitions("source", "h", "doc_id")
        local = K.keep(dealt.mapInArrow(_local, "doc_id bigint, source string, h bigint, pid bigint, local bigint"))
        per = local.groupBy("source", "pid").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        per = K.keep(per.select(F.col("source").alias("s"), F.col("pid").alias("p"), "n", before.alias("before")))
        sizes = {r["s"]: r["n"] for r in per.groupBy("s").agg(F.sum("n").alias("n")).collect()}
        self.sources = sorted(sizes, key=lambda s: (s is None, s or ""))
        total = sum(sizes.values())
        self.rows_per_block = max(1, math.ceil(total / most_blocks))
        given = [float((weights or {}).get(s, 0.0)) if weights else sizes[s] ** POWER for s in self.sources]
        floor = min((w for w in given if w > 0), default=1.0) * 1e-6
        self.blocks = [math.ceil(sizes[s] / self.rows_per_block) for s in self.sources]
        self.slots = interleave(self.blocks, [max(w, floor) for w in given])
        self.sizes = [sizes[s] for s in self.sources]
        self.ranks = local.join(per, F.col("source").eqNullSafe(F.col("s")) & (F.col("pid") == F.col("p"))).select("doc_id", "source", "h", (F.col("local") + F.col("before")).alias("rank"))

    def slot_table(self) -> DataFrame:
        """(s, block, slot, start): start is the number of rows in earlier slots."""
        rows, start = [], 0
        for slot, (s, b) in enumerate(self.slots):
            n = min(self.rows_per_block, self.sizes[s] - b * self.rows_per_block)
            rows.append((self.sources[s], b, slot, start))
            start += n
        spark = self.ranks.sparkSession
        return F.broadcast(spark.createDataFrame(rows, "s string, block bigint, slot bigint, start bigint"))  # most_blocks rows and one per source

    def positions(self) -> DataFrame:
        """doc_id, source, block, slot, position of every row."""
        x = self.ranks.withColumn("block", F.floor(F.col("rank") / self.rows_per_block))
        x = x.withColumnRenamed("block", "b").join(self.slot_table(), F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("block")))
        return x.select("doc_id", "source", "block", "slot", (F.col("start") + F.col("rank") % self.rows_per_block).alias("position"))

    def borders(self) -> dict:
        """Of each source the hash at which each block after the first begins."""
        at = self.ranks.where((F.col("rank") > 0) & (F.col("rank") % self.rows_per_block == 0)).select("source", "h").collect()  # a row per block
        out: dict = {s: [] for s in self.sources}
        for r in at:
            out[r["source"]].append(r["h"])
        return {s: np.sort(np.array(h, np.int64)) for s, h in out.items()}


def _place(borders, name: str):
    """borders: of each source the hashes at which its blocks after the first begin, and its blocks' slots."""

    @K.tidy
    def place(batches):
        for batch in batches:
            coded = batch.column("_source").dictionary_encode()
            names = [*coded.dictionary.to_pylist(), None]
            code = coded.indices.fill_null(len(names) - 1).to_numpy()
            h = batch.column("_h").to_numpy()
            slot = np.empty(len(h), np.int64)
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(len(names) + 1))
            for c in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[c] : cuts[c + 1]]
                begins, slots = borders.value[names[c]]
                slot[at] = slots[np.searchsorted(begins, h[at], "right")]
            yield pa.RecordBatch.from_arrays([batch.column(name), batch.column("_h"), pa.array(slot)], [name, "_h", "_slot"])

    return place


def placed(docs: DataFrame, *, weights: dict | None = None, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """(doc, _h, _slot) of every row: the schedule is the order of _slot, then _h.

    Depends on the rows alone and not on their order, so the same rows always get the same slots.
    """
    return _placed(docs, weights, most_blocks)[0]


def _placed(docs: DataFrame, weights: dict | None, most_blocks: int) -> tuple[DataFrame, int]:
    """placed, and the number of slots."""
    spark = docs.sparkSession
    plan = Schedule(docs, weights, most_blocks)
    slots = {s: np.zeros(n, np.int64) for s, n in zip(plan.sources, plan.blocks, strict=True)}
    for slot, (s, b) in enumerate(plan.slots):
        slots[plan.sources[s]][b] = slot
    begins = plan.borders()
    borders = spark.sparkContext.broadcast({s: (begins[s], slots[s]) for s in plan.sources})  # most_blocks numbers and one per source
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("source").alias("_source"), F.xxhash64("doc_id").alias("_h"))
    shape = T.StructType([packed.schema["doc"], *T.StructType.fromDDL("_h bigint, _slot bigint")])
    return packed.mapInArrow(_place(borders, "doc"), shape), max(1, len(plan.slots))


def mix(docs: DataFrame, *, weights: dict | None = None, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """The rows of docs in the order of the schedule, with all their columns.

    weights: by source; sources without one come last in effect (a millionth of the least). Rows
    without a source are a source of their own; rows of equal doc_id, repeated ones too, stay
    together in one block, which may then be larger. No row is dropped or repeated.
    """
    out, total = _placed(docs, weights, most_blocks)
    width = K.parts(docs.sparkSession, math.ceil(K.text_bytes(docs)[1] / K.PARTITION_BYTES))
    # the number of slots is known, so they are dealt without sampling
    out = out.repartitionById(width, F.least(F.lit(width - 1), F.floor(F.col("_slot") * width / total)).cast("int")).sortWithinPartitions("_slot", "_h")
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the schedule puts every document."""
    return Schedule(K.read(spark, sf_dir, "documents")).positions()


QUERIES = {"op8_source_mixing": op8_source_mixing}
SQL: dict[str, str] = {}
