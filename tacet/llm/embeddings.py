"""Operator 6: near-duplicate embeddings by collision-counting projections.

Vectors are projected on many random lines. A group of lines gives a sorted list: the last line of the
group orders the vectors, and the others cut the space into cells (with random offsets), because on a
line alone a window of useful width holds a third of all pairs. Within its cell every vector looks at
the window centred on it along the sorted line; the list is cut into stretches as long as half a window,
and each stretch is given the next one too, so that no window ends at a border. For the pairs in a
window, collisions are counted on further lines: one where the two lie within a window of each other.
Pairs with at least as many collisions as a true link has with near certainty are verified by cosine in
double precision. Lines per group follow the number of vectors, so that windows stay small, and the
number of groups follows the recall wanted.

Equal vectors form one class first. Counting needs places on lines only, as small integers; vectors go
just to where a pair has passed the count. Tasks return link counts and spanning links, not pairs: a
pair is counted only in the first group in which it meets. Crowded stretches are compared block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacet.llm import kernel as K

COSINE = 0.9
RECALL = 0.98
LINES = 32
WINDOW = 1.5
SIGMAS = 4.0
MEETING = 300
BLOCK = 1024
CELL = 2.0
SEED = 3
#: Half a window, in the integer units of places on a sorted line, and on a counting line (where a place is one byte).
HALF, COUNT_HALF = 64, 20
#: Pairs of one step of counting.
STEP = 1 << 18


def design(n: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int, int]:
    """Lines per group, groups, and the least number of collisions, for n vectors."""
    near = 1 - math.sqrt(2 * (1 - cosine)) * math.sqrt(2 / math.pi) / CELL  # a linked pair shares a cell of a line
    p = math.erf(WINDOW / math.sqrt(2))  # it lies within a window
    lines = max(4, math.ceil(math.log(max(n, 1) / MEETING) / math.log(2.4))) if n > MEETING else 4
    groups = math.ceil(math.log(1 - recall) / math.log(1 - p * near ** (lines - 1)))
    return lines, groups, math.floor(LINES * p - SIGMAS * math.sqrt(LINES * p * (1 - p)))


def projections(x: np.ndarray, lines: int, groups: int, cosine: float = COSINE):
    """Of unit vectors: their cell and their place on the sorted line in each group, and their places on the counting lines."""
    d = x.shape[1]
    rng = np.random.default_rng([SEED, d])
    scale = HALF / (WINDOW * math.sqrt(2 * (1 - cosine)))  # over unit vectors a line's values spread by 1
    count = np.clip(np.rint(x @ rng.standard_normal((d, LINES)) * (scale * COUNT_HALF / HALF)), -127, 127).astype(np.int8)
    cells, places = np.empty((len(x), groups), np.int64), np.empty((len(x), groups), np.int32)
    for g in range(groups):
        p = x @ rng.standard_normal((d, lines))
        w = np.floor(p[:, :-1] / CELL + rng.random(lines - 1)).astype(np.int64).astype(np.uint64)
        h = np.full(len(x), K.U64(d * 1000 + g))
        for j in range(lines - 1):
            h = K.mix(h * K.U64(31) + w[:, j])
        cells[:, g] = h.astype(np.int64)
        places[:, g] = np.rint(p[:, -1] * scale)
    return cells, places, count


def _unit(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and unit vectors by length, of those vectors that can be linked."""
    out = {}
    values = column.flatten()
    size = np.diff(column.offsets.to_numpy())
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate([[0], np.cumsum(size)])
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        x = flat[at[rows][:, None] + np.arange(d)]
        with np.errstate(over="ignore"):
            norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(norm) & (norm > 0)
        out[int(d)] = rows[good], x[good] / norm[good, None]
    return out


def _place(lines: int, groups: int, cosine: float):
    @K.tidy
    def place(batches):
        for batch in batches:
            for rows, x in _unit(batch.column(1)).values():
                if len(rows):
                    cells, places, count = projections(x, lines, groups, cosine)
                    lists = [pa.FixedSizeListArray.from_arrays(pa.array(a.reshape(-1)), groups).cast(pa.list_(a_type)) for a, a_type in ((cells, pa.int64()), (places, pa.int32()))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *lists, pa.array([c.tobytes() for c in count], pa.binary())], ["v", "cells", "places", "lines"])

    return place


def in_windows(place: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Pairs of left and right rows that lie in each other's window along the sorted line, in steps."""
    right = right[np.argsort(place[right], kind="stable")]
    along = place[right]
    low, high = np.searchsorted(along, place[left] - HALF), np.searchsorted(along, place[left] + HALF, "right")
    size = high - low
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(np.cumsum(size[a:]), STEP, "right")) + a)
        n = size[a:b]
        j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:b], n)
        yield np.repeat(left[a:b], n), right[j]
        a = b


def collided(count: np.ndarray, i: np.ndarray, j: np.ndarray, least: int):
    """Those of the pairs that collide on at least ``least`` counting lines; pairs leave as soon as they cannot."""
    hits = np.zeros(len(i), np.int16)
    for line in range(LINES):
        at = count[:, line].astype(np.int16)
        hits += np.abs(at[i] - at[j]) <= COUNT_HALF
        if line % 8 == 7:
            stay = hits >= least - (LINES - 1 - line)
            i, j, hits = i[stay], j[stay], hits[stay]
    return i, j


def passing(place, count, side, same: bool, least: int):
    """Pairs of a task that pass the count. side: 0 the stretch's own rows (left), 1 its other block, 2 the next stretch."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
    found = []
    for i, j in in_windows(place, left, right):
        found.append(np.stack(collided(count, i, j, least)))
    if same:  # within the block: each pair once
        for i, j in in_windows(place, left, left):
            once = i < j
            found.append(np.stack(collided(count, i[once], j[once], least)))
    return np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)


TASK = ["group", "cell", "stretch", "i", "j"]


def _lines(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("lines").to_pylist()), np.int8).reshape(-1, LINES)


def _scan(least: int):
    """Counting: the members of each task that have a pair which passes."""

    def scan(table: pa.Table) -> pa.Table:
        table, tasks = K.in_order(table, TASK, ["side", "v"])
        place, side, i, j, count = table.column("place").to_numpy(), table.column("side").to_numpy(), table.column("i").to_numpy(), table.column("j").to_numpy(), _lines(table)
        keep = []
        for a, b in tasks:
            pairs = passing(place[a:b], count[a:b], side[a:b], i[a] == j[a], least)
            if pairs.shape[1]:
                keep.append(a + np.unique(pairs))
        K.trim()
        return table.select([*TASK, "side", "v", "place"]).take(pa.array(np.concatenate(keep) if keep else np.zeros(0, np.int64)))

    return scan


def _verify(least: int, cosine: float):
    """Verification of the pairs that pass: link counts (kind 0) and spanning links (kind 1)."""

    def verify(table: pa.Table) -> pa.Table:
        table, tasks = K.in_order(table, TASK, ["side", "v"])
        g, bi, bj, side, v, copies = (table.column(c).to_numpy() for c in ("group", "i", "j", "side", "v", "copies"))
        place, count = table.column("place").to_numpy(), _lines(table)
        cells, places, vectors = (table.column(c).combine_chunks() for c in ("cells", "places", "embedding"))
        cells, places, vectors = (x if isinstance(x, pa.ListArray) else pa.concat_arrays(x.chunks) for x in (cells, places, vectors))
        at, links, edges = [], [], []
        for a, b in tasks:
            i, j = passing(place[a:b], count[a:b], side[a:b], bi[a] == bj[a], least)
            if not len(i):
                continue
            ((_, x),) = _unit(vectors.slice(a, b - a)).values()
            early = np.zeros(len(i), bool)
            if g[a]:
                c = cells.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                p = places.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                for h in range(g[a]):
                    early |= (c[i, h] == c[j, h]) & (np.abs(p[i, h] - p[j, h]) <= HALF)
            i, j = i[~early], j[~early]
            ok = np.empty(len(i), bool)
            for s in range(0, len(i), 1 << 16):
                ok[s : s + (1 << 16)] = (x[i[s : s + (1 << 16)]] * x[j[s : s + (1 << 16)]]).sum(1) >= cosine
            i, j = i[ok], j[ok]
            if len(i):
                n = np.zeros(b - a, np.int64)
                np.add.at(n, i, copies[a:b][j])
                np.add.at(n, j, copies[a:b][i])
                hit = np.flatnonzero(n)
                at.append(v[a:b][hit])
                links.append(n[hit])
                root = list(range(b - a))

                def find(p, root=root):
                    while root[p] != p:
                        root[p] = root[root[p]]
                        p = root[p]
                    return p

                for p, q in zip(i.tolist(), j.tolist(), strict=True):
                    p, q = find(p), find(q)
                    root[max(p, q)] = min(p, q)
                edges += [(int(v[a + p]), int(v[a + find(p)])) for p in hit.tolist() if find(p) != p]
        one = np.concatenate(at) if at else np.zeros(0, np.int64)
        two = np.array(edges, np.int64).reshape(-1, 2)
        K.trim()
        return pa.table({"kind": pa.array([0] * len(one) + [1] * len(two), pa.int32()), "a": pa.array(np.concatenate([one, two[:, 0]])), "b": pa.array(np.concatenate([*(links or [one]), two[:, 1]]))})

    return verify


def _dealt(spots: DataFrame) -> DataFrame:
    """Rows of (v, group, cell, place) as members of tasks: group, cell, stretch, i, j, side.

    A row belongs to its own stretch, and follows the one before it. Stretches with more than BLOCK
    rows are cut into blocks: task (i, j) holds block i on the left, and on the right block j if that
    comes later, and block j of the next stretch.
    """
    home = F.floor(F.col("place") / HALF).cast("bigint")
    both = spots.select("v", "group", "cell", "place", F.explode(F.array(F.struct(home.alias("stretch"), F.lit(0).alias("side")), F.struct((home - 1).alias("stretch"), F.lit(2).alias("side")))).alias("r")).select("v", "group", "cell", "place", "r.*")
    crowds = both.groupBy("group", "cell", "stretch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == 0).alias("own")).where("n > 1 and own > 0").select("group", "cell", "stretch", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    x = both.join(crowds, ["group", "cell", "stretch"]).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")))
    return K.block_tasks(x.withColumn("left", F.col("side") == 0).drop("side"), ["v", "group", "cell", "stretch", "place"])


def near_embeddings(table: DataFrame, *, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.
    Vectors of different lengths are never linked. Rows with equal vectors are linked with each
    other; repeated rows too. A null vec_id is a component_id only where no other is there; kept is
    vec_id <=> component_id. Extra columns, labels among them, are ignored. Equal vectors are
    recognised by 64-bit hashes: among 10**9 different ones some pair shares a hash with a
    probability of 3 %.
    """
    e = F.col("embedding")
    good = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = table.select("vec_id", "embedding").withColumn("v", F.when(good, F.xxhash64("embedding")))
    classes = K.keep(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")))
    n = classes.count()
    lines, groups, least = design(n, cosine, recall)
    placed = K.keep(classes.select("v", "embedding").mapInArrow(_place(lines, groups, cosine), "v bigint, cells array<bigint>, places array<int>, lines binary"))
    spots = placed.select("v", F.posexplode(F.arrays_zip("cells", "places")).alias("group", "s")).select("v", "group", F.col("s.cells").alias("cell"), F.col("s.places").alias("place"))
    dealt = _dealt(spots)
    bins = K.parts(table.sparkSession, max(16, math.ceil(n * groups / 20_000)))
    of = F.pmod(F.xxhash64(*TASK), F.lit(bins))
    member = "group int, cell bigint, stretch bigint, i bigint, j bigint, side int, v bigint, place int"
    asked = dealt.join(placed.select("v", "lines"), "v").withColumn("bin", of).repartition(bins, "bin")
    passed = K.keep(asked.groupBy("bin").applyInArrow(_scan(least), member))
    full = passed.join(placed, "v").join(classes.select("v", "copies", "embedding"), "v").withColumn("bin", of).repartition(bins, "bin")
    found = K.keep(full.groupBy("bin").applyInArrow(_verify(least, cosine), "kind int, a bigint, b bigint"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("v")).agg(F.sum("b").alias("links"))
    label = classes.select("v", "least", "copies").join(links, "v", "left")
    comps = K.components(found.where("kind = 1").select("a", "b")).withColumnRenamed("c", "root")
    low = comps.join(classes.select("v", "least"), "v")
    low = low.join(low.groupBy("root").agg(F.min("least").alias("low")), "root").select("v", "low")
    label = label.join(low, "v", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("low", "least").alias("low"), "copies")
    out = K.lookup(rows.select("vec_id", "v"), K.keep(label), "v", "copies")
    component = F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("low"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    return near_embeddings(K.read(spark, sf_dir, "embeddings"))


QUERIES = {"op6_embedding_dedup": op6_embedding_dedup}
SQL: dict[str, str] = {}
