"""Pairs of rows near each other in time, by a sorted sweep over ranges; and similarity with a few vectors by prefix filtering, or with many in chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacet.functions.text import GRAMS, slices
from tacet.operators.prefixes import prefix
from tacet.sources.shared import keep, numbered

PAIRS = 1 << 18  # pairs in one batch of output
CHUNK = 256  # loose rows that other rows are compared with at a time
UNIT = 1 << 12  # rows that meet a chunk in one place


def _sweep(window: int):
    """Rows (key, t, id, moved, own) in order; the rows of the last key within the window are carried from batch to batch."""

    def work(batches):
        before, key = None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k, columns = batch.column(0), [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)]
            e = k.to_numpy(zero_copy_only=False)
            new = np.concatenate([[key is None or k[0].as_py() != key], e[1:] != e[:-1]])
            if before is not None and not new[0]:
                columns = [np.concatenate(x) for x in zip(before, columns, strict=True)]
            held = len(columns[0]) - n
            run = np.concatenate([np.zeros(held, np.int64), np.cumsum(new)]) if held else np.cumsum(new)
            t, ids, moved, own = columns
            line = run * (int(t.max() - t.min()) + window + 1) + (t - t.min())  # keys behind each other
            first = np.searchsorted(line, line - window)
            partners = np.where(own, np.arange(len(t)) - first, 0)
            partners[:held] = 0  # these met their partners before
            behind = np.cumsum(partners)
            a = 0
            while a < len(t):
                b = max(a + 1, int(np.searchsorted(behind, (behind[a - 1] if a else 0) + PAIRS, "right")))
                m = partners[a:b]
                right = np.repeat(np.arange(a, b), m)
                left = np.arange(len(right)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(first[a:b], m)
                fit = ((moved[left] & moved[right]) == 0) & (ids[left] != ids[right])
                if fit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[left[fit]]), pa.array(ids[right[fit]])], names=["id", "other"])
                a = b
            key = k[n - 1].as_py()
            stay = (run == run[-1]) & (line >= line[-1] - window)
            before = [x[stay] for x in columns]

    return work


def sent_rows(rows: DataFrame, window: int, parts: int) -> DataFrame:
    """Rows (key, t, id, moved) with the block ``to`` that sweeps them, and whether they are its own.

    Blocks are ranges of key, time and id. A block that begins within a key also gets the rows of that key before it
    that its first row can reach.
    """
    dealt = keep(rows.repartitionByRange(parts, "key", "t", "id").sortWithinPartitions("key", "t", "id").withColumn("block", F.spark_partition_id()))
    starts = dealt.groupBy("block").agg(F.min(F.struct("key", "t")).alias("first"))
    starts = starts.groupBy(F.col("first.key").alias("key")).agg(F.collect_list(F.struct("block", F.col("first.t").alias("t"))).alias("later"))
    x = dealt.join(F.broadcast(starts), "key", "left")  # a block has one start
    reach = F.filter("later", lambda s: (s["block"] > F.col("block")) & (s["t"] - window <= F.col("t")))
    to = F.concat(F.array(F.struct(F.col("block").alias("to"), F.lit(True).alias("own"))), F.coalesce(F.transform(reach, lambda s: F.struct(s["block"].alias("to"), F.lit(False).alias("own"))), F.array().cast("array<struct<to:int,own:boolean>>")))
    return x.select("key", "t", "id", "moved", F.explode(to).alias("x")).select("key", "t", "id", "moved", "x.own", "x.to")


def near_pairs(rows: DataFrame, window: int, parts: int | None = None) -> DataFrame:
    """(id, other) of rows (key, t, id, moved) of the same key whose times differ by at most ``window``; of two moved rows none.

    ``moved`` may also be a number: two rows that have a bit of it in common are no pair. A key with a third of all rows is split by time; a task carries the rows of the window alone.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent_rows(rows, window, n).repartitionById(n, "to").sortWithinPartitions("to", "key", "t", "id")
    return sent.select("key", "t", "id", "moved", "own").mapInArrow(_sweep(window), "id bigint, other bigint")


class Few:
    """Trigram vectors of a bounded number of rows, indexed by the prefixes that a cosine of ``least`` asks for.

    In an order that both vectors of a pair share, the grams after a vector's prefix are too light for a cosine of
    ``least``, so two such vectors have a gram of both prefixes in common. Grams that few of these vectors have
    come first, and those that none has before all.
    """

    def __init__(self, rows: list[tuple[int, int, list[int], list[int], float]], least: float):
        self.least = least * (1 - 1e-12)  # beyond doubt by rounding
        self.ids, self.t = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        self.norm = np.array([r[4] for r in rows], float)
        of = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        gram, tf = (np.concatenate([np.asarray(r[i], np.int64) for r in rows]) if rows else np.zeros(0, np.int64) for i in (2, 3))
        self.often = np.bincount(gram, minlength=GRAMS)
        self.column = np.cumsum(self.often > 0) - 1
        self.table = np.zeros((len(rows), int((self.often > 0).sum())), np.int32)
        self.table[of, self.column[gram]] = tf
        lead = self.prefix(of, gram, tf, self.norm)
        order = np.argsort(gram[lead], kind="stable")
        self.gram, self.of = gram[lead][order], of[lead][order]

    def prefix(self, of: np.ndarray, gram: np.ndarray, tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Numbers of the entries of vectors (row, gram, count) that belong to their row's prefix."""
        return prefix(of, gram, tf, norm, self.often, self.least)

    def candidates(self, of: np.ndarray, gram: np.ndarray, tf: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number of a vector of these) that share a gram of both prefixes."""
        lead = self.prefix(of, gram, tf, norm)
        lead = lead[self.often[gram[lead]] > 0]
        a, b = np.searchsorted(self.gram, gram[lead]), np.searchsorted(self.gram, gram[lead], "right")
        at = np.arange(int((b - a).sum())) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        key = np.unique(np.repeat(of[lead], b - a) * len(self.ids) + self.of[at])
        return key // max(1, len(self.ids)), key % max(1, len(self.ids))

    def similar(self, of, gram, tf, norm, t, ids, window: int):
        """(row, number) of pairs within the window with a cosine of ``least``; every candidate is verified on whole vectors."""
        row, other = self.candidates(of, gram, tf, norm)
        near = (np.abs(t[row] - self.t[other]) <= window) & (ids[row] != self.ids[other])
        row, other = row[near], other[near]
        return row, other, self.cosines(row, other, of, gram, tf, norm)

    def near(self, t: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of all pairs within the window, for vectors that were given in order of time."""
        first = np.searchsorted(self.t, t - window)
        n = np.searchsorted(self.t, t + window, "right") - first
        row = np.repeat(np.arange(len(t)), n)
        other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n - first, n)
        fit = ids[row] != self.ids[other]
        return row[fit], other[fit]

    def cosines(self, row, other, of, gram, tf, norm) -> np.ndarray:
        """The cosine of each pair (row, number), over whole vectors; as many pairs at a time as have SLICE grams."""
        first = np.searchsorted(of, np.arange(len(norm) + 1))
        sizes, dots = np.diff(first)[row], [np.zeros(0)]
        for a, b in slices(np.concatenate([[0], np.cumsum(sizes)])):
            size = sizes[a:b]
            at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first[row[a:b]], size)
            known = self.often[gram[at]] > 0
            pair = np.repeat(np.arange(b - a), size)[known]
            at = at[known]
            dots.append(np.bincount(pair, tf[at] * self.table[other[a:b][pair], self.column[gram[at]]], b - a))
        return np.concatenate(dots) / (norm[row] * self.norm[other])


def similar_to_few(rows: DataFrame, few: DataFrame, least: float, window: int) -> DataFrame:
    """(id, other) of rows (id, t, vector, norm) and of ``few``, rows of the same kind whose number the caller bounds.

    The few go to every task with the index of their prefixes; the rows stay where they are.
    """
    have = [(r.id, r.t, r.vector.grams, r.vector.tf, r.norm) for r in few.select("id", "t", "vector", "norm").collect()]
    index = Few(have, least)

    def work(batches):
        for batch in batches:
            vector = batch.column(2)
            grams, tf = vector.field("grams"), vector.field("tf")
            of = np.repeat(np.arange(batch.num_rows), np.diff(grams.offsets.to_numpy()))
            t, ids, norm = (batch.column(i).to_numpy() for i in (1, 0, 3))
            row, other, cosine = index.similar(of, grams.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64), norm, t, ids, window)
            fit = cosine >= least
            yield pa.RecordBatch.from_arrays([pa.array(ids[row[fit]]), pa.array(index.ids[other[fit]])], names=["id", "other"])

    return rows.select("id", "t", "vector", "norm").mapInArrow(work, "id bigint, other bigint")


class Chunks:
    """Loose rows in order of time and id, ``CHUNK`` after ``CHUNK``: the first of each chunk, its last time, and the units that it is met in."""

    def __init__(self, first: list[tuple[int, int]], last: list[int], window: int):
        self.first = np.array(first, [("t", np.int64), ("id", np.int64)])
        self.last, self.window = np.array(last, np.int64), window
        self.deal(np.zeros(len(first), np.int64))

    def deal(self, rows: np.ndarray) -> None:
        """A chunk is met in as many units as its number of rows asks for."""
        self.units = np.maximum(1, -(-rows // UNIT))
        self.before = np.cumsum(self.units) - self.units

    def reached(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each time the first chunk with a time in its window, and the one behind the last."""
        return np.searchsorted(self.last, t - self.window), np.searchsorted(self.first["t"], t + self.window, "right")

    def counted(self, batches):
        """(chunk, n): how many of the rows (t) of a partition reach it."""
        n = np.zeros(len(self.first) + 1, np.int64)
        for batch in batches:
            a, b = self.reached(batch.column(0).to_numpy())
            some = a < b
            np.add.at(n, a[some], 1)
            np.add.at(n, b[some], -1)
        n = np.cumsum(n)
        chunk = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(n[chunk])], names=["chunk", "n"])

    def places(self, ids: pa.Array, t: pa.Array, loose: pa.Array) -> pa.Array:
        """Of each row the units that it goes to: one of each chunk that it reaches, and as a loose row (``few``) all of its own."""
        ids, t, loose = (x.to_numpy(zero_copy_only=False) for x in (ids, t, loose))
        a, b = self.reached(t)
        row, chunk = _ranges(a, np.maximum(b - a, 0))
        unit = self.before[chunk] + ((ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % self.units[chunk]
        at = np.flatnonzero(loose)
        probe = np.empty(len(at), self.first.dtype)
        probe["t"], probe["id"] = t[at], ids[at]
        own = np.searchsorted(self.first, probe, "right") - 1
        few, unit_of_few = _ranges(self.before[own], self.units[own])
        row, to = np.concatenate([row, at[few]]), np.concatenate([unit, unit_of_few])
        is_few = np.arange(len(row)) >= len(unit)
        order = np.argsort(row, kind="stable")
        offsets = np.searchsorted(row[order], np.arange(len(t) + 1))
        places = pa.StructArray.from_arrays([pa.array(to[order].astype(np.int64)), pa.array(is_few[order])], ["to", "few"])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), places)


def _ranges(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of the n values from start on of each row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n - start, n)


def _flat(rows: pa.RecordBatch):
    """id, t, old, and the vectors as (row, gram, count) with their norms, of rows (id, t, old, vector, norm)."""
    vector = rows.column(3)
    grams, tf = vector.field("grams"), vector.field("tf")
    of = np.repeat(np.arange(rows.num_rows), np.diff(grams.offsets.to_numpy()))
    ids, t, old, norm = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
    return ids, t, old, of, grams.flatten().to_numpy().astype(np.int64), tf.flatten().to_numpy().astype(np.int64), norm


def _meet(least: float, window: int):
    """Rows (to, few, id, t, old, vector, norm) by unit, in each the loose ones (``few``) first: pairs of one of these and another row."""

    def index(held: list[pa.RecordBatch]) -> tuple[Few, np.ndarray]:
        rows = pa.Table.from_batches(held).sort_by("t").combine_chunks().to_batches()[0]
        ids, t, old, of, gram, tf, norm = _flat(rows)
        at = np.searchsorted(of, np.arange(len(t) + 1))
        return Few([(ids[k], t[k], gram[at[k] : at[k + 1]], tf[at[k] : at[k + 1]], norm[k]) for k in range(len(t))], least), old

    def work(batches):
        unit, held, few = None, [], None
        for batch in batches:
            to, is_few = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((to[1:] != to[:-1]) | (is_few[1:] != is_few[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(to)], strict=True) if len(to) else []:
                rows = batch.slice(a, b - a).select(range(2, 7))
                if is_few[a]:
                    unit, held, few = to[a], [*(held if to[a] == unit else []), rows], None
                    continue
                if to[a] != unit:  # no text of this chunk has a vector
                    continue
                few, held = few or index(held), []
                sizes = np.diff(rows.column(3).field("grams").offsets.to_numpy()).astype(np.int64)
                for x, y in slices(np.concatenate([[0], np.cumsum(sizes)])):
                    ids, t, old, *vectors = _flat(rows.slice(x, y - x))
                    row, other = few[0].near(t, ids, window)
                    new = ~(old[row] & few[1][other])
                    row, other = row[new], other[new]
                    fit = few[0].cosines(row, other, *vectors) >= least
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row[fit]]), pa.array(few[0].ids[other[fit]])], names=["id", "other"])

    return work


def similar_to_loose(rows: DataFrame, vectors: DataFrame, least: float, window: int) -> DataFrame:
    """(id, other) of rows (id, t, loose, old) within the window of loose ones, however many these are, with a cosine of ``least``; of two old rows none.

    Loose rows are dealt to chunks in order of time and id. Any row goes to the chunks that its window reaches; a chunk that
    many rows reach is met in as many units, each with the chunk's vectors, so that a task holds one chunk and streams the
    rest. The driver gets three numbers a chunk. vectors: (id, vector, norm); without one a row has no pair.
    """
    placed = numbered(rows.where("loose").select("id", "t"), "t", "id").withColumn("chunk", F.floor((F.col("number") - 1) / CHUNK))
    found = sorted(tuple(r) for r in placed.groupBy("chunk").agg(F.min(F.struct("t", "id")).alias("first"), F.max("t").alias("last")).collect())
    if not found:
        return rows.select("id", F.col("id").alias("other")).limit(0)
    chunks = Chunks([tuple(r[1]) for r in found], [r[2] for r in found], window)
    n = np.zeros(len(found), np.int64)
    for r in rows.select("t").mapInArrow(chunks.counted, "chunk bigint, n bigint").groupBy("chunk").agg(F.sum("n").alias("n")).collect():
        n[r.chunk] = r.n
    chunks.deal(n)
    places = F.arrow_udf(chunks.places, "array<struct<to:bigint,few:boolean>>")(F.col("id"), F.col("t"), F.col("loose"))
    sent = rows.select("id", "t", "old", F.explode(places).alias("place")).join(vectors, "id")
    sent = sent.select("place.to", "place.few", "id", "t", "old", "vector", "norm")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sent.repartitionById(parts, (F.col("to") % parts).cast("int")).sortWithinPartitions("to", F.desc("few"))
    return dealt.mapInArrow(_meet(least, window), "id bigint, other bigint")
