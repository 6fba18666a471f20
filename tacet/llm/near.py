"""Operator 4: near-duplicate documents by HyperMinHash.

A document's set of word shingles becomes 256 compressed registers: each bucket of the hash space
keeps its least hash as a leading-zero count and mantissa bits. Bands of registers propose
candidates (an empty register borrows from a filled one, so that a band of a short text rests on as
many hashes as one of a long text); register matches, corrected for chance collisions, estimate the Jaccard similarity;
whatever the estimate cannot rule out is verified on the full sets.

Documents with equal sets form one class and only classes are compared. Classes that share a band
gather in families. A small family is solved in one task. In a large one every member is first
verified against the family's most connected member, block by block; only members that this leaves
unlinked are then compared with the blocks of the family. Tasks return spanning links, never all
pairs, and no link between different components is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacet.llm import kernel as K

SHINGLE = 5
#: The similarity of operators and stages in general, and that of the query's contract.
PERCENT, CONTRACT_PERCENT = 80, 85
REGISTERS = 256
MANTISSA = 10
#: How often at most a pair right at the limit may share no band.
MISSED = 1e-6
BLOCK = 256
BLOCK_SHINGLES = 1 << 20
SIGMAS = 5
#: Most partitions for comparisons inside large families (a number of tasks, not a limit on work).
WIDEST = 20_000


def tiny(percent: int) -> int:
    """Sets of so few shingles can only be linked when equal (n against n + 1 is below the limit), and equal sets are one class anyway."""
    return (percent - 1) // max(1, 100 - percent)


def rows_per_band(percent: int) -> int:
    """The most registers per band with which a pair at the limit shares a band but for MISSED."""
    t = percent / 100
    return max((r for r in range(1, 33) if (1 - t**r) ** (REGISTERS // r) <= MISSED), default=1)


def sets_of(column, k: int = SHINGLE):
    """Sorted distinct shingle hashes of each text (lower-cased A-Z); with fewer than k words the whole sequence is one."""
    buf, offs = K.buffer_of(column)
    buf = K.LOWER[buf]
    starts, ends, first = K.words_of(buf, offs)
    wh = K.word_hashes(buf, starts, ends)
    win = K.rolling(wh, k)
    for d in range(len(offs) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= k:
            yield np.unique(win[a : b - k + 1])
        elif b > a:
            yield K.rolling(wh[a:b], int(b - a)) ^ K.mix(np.array([b - a], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def _key(u: np.ndarray) -> int:
    """A 64-bit key of a set, the same for equal sets."""
    return int((K.mix(u + K.U64(5)).sum() ^ K.mix(np.array([len(u)], np.uint64))[0]).astype(np.int64))


def registers(u: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """HyperMinHash of a sorted set: per bucket (leading zeros + 1) << MANTISSA | mantissa; 0 where empty."""
    bits = m.bit_length() - 1
    at = np.searchsorted(u, np.arange(m, dtype=np.uint64) << K.U64(64 - bits))
    full = np.diff(np.append(at, len(u))) > 0
    x = u[at[full]] << K.U64(bits)
    zeros = 53 - np.frexp((x >> K.U64(11)).astype(np.float64))[1].astype(np.int64)
    out = np.zeros(m, np.uint16)
    mantissa = (x << (zeros + 1).astype(np.uint64)) >> K.U64(64 - MANTISSA)
    out[full] = ((zeros + 1).astype(np.uint64) << K.U64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def chance(na, nb, m: int = REGISTERS):
    """Expected rate at which registers of disjoint sets of these sizes agree: same leading zeros times 2**-MANTISSA."""
    i = np.arange(1, 55, dtype=np.float64)

    def shares(n):
        per = np.maximum(np.asarray(n, np.float64) / m, 1.0)[..., None]
        over = 1.0 - np.exp(-per * 0.5**i)  # a minimum with at least i leading zeros
        return np.concatenate([1.0 - over[..., :1], over[..., :-1] - over[..., 1:]], -1)

    return (shares(na) * shares(nb)).sum(-1) * 0.5**MANTISSA


def estimates(one: np.ndarray, size: int, many: np.ndarray, sizes: np.ndarray):
    """Collision-corrected Jaccard estimates of one set against many, and the registers each rests on."""
    live = one != 0
    used = ((many != 0) | live).sum(1)
    same = (one[live] == many[:, live]).sum(1)
    c = chance(size, sizes)
    return (same / np.maximum(used, 1) - c) / (1 - c), used


def lenders(m: int = REGISTERS, tries: int = 4096) -> np.ndarray:
    """For each register the others it tries to borrow from, in a fixed random order."""
    return np.random.default_rng(11).integers(0, m, (tries, m), np.int16)


_lenders = lenders()


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with each empty one replaced by the first filled one that it tries (optimal densification)."""
    out = regs.copy()
    row, col = np.nonzero(regs == 0)
    for tries in _lenders:
        if not len(row):
            break
        got = regs[row, tries[col]]
        out[row, col] = got
        row, col = row[got == 0], col[got == 0]
    return out


def band_keys(regs: np.ndarray, r: int):
    """(row, key) of every band of r registers."""
    n, m = regs.shape
    bands = filled(regs)[:, : m // r * r].reshape(n, m // r, r).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, m // r + 1, dtype=np.uint64) * K.U64(K.BASE), bands.shape[:2]).copy()
    for j in range(r):
        h = K.mix(h * K.U64(3) + bands[:, :, j])
    return np.repeat(np.arange(n), m // r), h.reshape(-1)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if 100 * len(b) < percent * len(a):
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def spanning(sets: list, left: np.ndarray, right: np.ndarray, joined: np.ndarray, percent: int):
    """Links that connect what the pairs left x right connect; joined members are one component from the start."""
    n = len(sets)
    regs = np.array([registers(u) for u in sets]).reshape(n, REGISTERS)
    sizes = np.array([len(u) for u in sets])
    root = np.arange(n)
    if len(joined):
        root[joined] = joined[0]

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    pairs: list = []
    inside, both = np.zeros(n, bool), np.zeros(n, bool)
    inside[left] = True
    both[np.intersect1d(left, right)] = True
    for i in left:
        # two members of both sides meet twice, so once is enough; a left-only one meets every right one only here
        other = right[(right > i) | ~inside[right]] if both[i] else right
        other = other[(100 * np.minimum(sizes[other], sizes[i]) >= percent * np.maximum(sizes[other], sizes[i]))]
        if len(other):
            j, used = estimates(regs[i], sizes[i], regs[other], sizes[other])
            t = percent / 100
            ok = j >= t - SIGMAS * np.sqrt(t * (1 - t) / np.maximum(used, 1))
            pairs.append(np.stack([np.full(ok.sum(), i, np.float64), other[ok], j[ok]]))
    out = []
    if pairs:
        a, b, j = np.concatenate(pairs, 1)
        for k in np.argsort(-j, kind="stable"):
            x, y = int(a[k]), int(b[k])
            p, q = find(x), find(y)
            if p != q and linked(sets[x], sets[y], percent):
                root[p] = q
                out.append((x, y))
    return out


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(v: np.ndarray, pairs) -> pa.Table:
    K.trim()
    pairs = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.table([pa.array(v[pairs[:, 0]]), pa.array(v[pairs[:, 1]])], schema=EDGE)


def _ids(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _sets(table: pa.Table) -> list:
    return [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("shingles")]


def _signatures(k: int):
    @K.tidy
    def sign(batches):
        for batch in batches:
            for at, to in K.pieces(batch.column(1)):
                part = batch.slice(at, to - at)
                size, key, regs = [], [], []
                for u in sets_of(part.column(1), k):
                    size.append(len(u))
                    key.append(_key(u) if len(u) else None)
                    regs.append(registers(u).tobytes() if len(u) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(size, pa.int64()), pa.array(key, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "content", "n_shingles", "v", "regs"])

    return sign


def _bands(r: int):
    @K.tidy
    def bands(batches):
        for batch in batches:
            if batch.num_rows:
                regs = np.array([np.frombuffer(b.as_buffer(), np.uint16) for b in batch.column(1)])
                row, key = band_keys(regs, r)
                yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(batch.column(0).to_numpy()[row])], ["key", "v"])

    return bands


def _full_sets(k: int):
    @K.tidy
    def full(batches):
        for batch in batches:
            for at, to in K.pieces(batch.column("text")):
                part = batch.slice(at, to - at)
                sets = list(sets_of(part.column("text"), k))
                want = part.column("v").to_numpy()
                right = [i for i, u in enumerate(sets) if len(u) and _key(u) == want[i]]
                part = part.take(pa.array(right, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("v"), part.column("family"), part.column("blocks"), part.column("hub"), pa.array([sets[i].tobytes() for i in right], pa.binary())], ["v", "family", "blocks", "hub", "shingles"])

    return full


def _own_sets(k: int):
    """Key and full set of every text."""

    @K.tidy
    def own(batches):
        for batch in batches:
            for at, to in K.pieces(batch.column(0)):
                sets = [u for u in sets_of(batch.column(0).slice(at, to - at), k) if len(u)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(u) for u in sets], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())], ["v", "shingles"])

    return own


def _small(percent: int):
    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by("family")
        v, fam, sets, out = _ids(table, "v"), _ids(table, "family"), _sets(table), []
        cuts = np.flatnonzero(np.diff(fam)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(fam)], strict=True):
            every = np.arange(b - a)
            out += [(a + x, a + y) for x, y in spanning(sets[a:b], every, every, every[:0], percent)]
        return _edges(v, out)

    return solve


def _star(percent: int):
    def star(table: pa.Table) -> pa.Table:
        v, hub, sets = _ids(table, "v"), _ids(table, "hub"), _sets(table)
        at = int(np.flatnonzero(v == hub)[0])
        return _edges(v, [(i, at) for i in range(len(v)) if v[i] != v[at] and linked(sets[i], sets[at], percent)])

    return star


def _pairs(percent: int):
    def pairs(table: pa.Table) -> pa.Table:
        v, kind, sets = _ids(table, "v"), _ids(table, "kind"), _sets(table)
        right = np.flatnonzero(kind > 0)
        own = set(v[right].tolist())
        left = np.flatnonzero(kind == 0)
        twice = np.array([i for i in left if v[i] in own], np.int64)  # also in the block itself
        if len(twice):
            spot = {int(x): i for i, x in zip(right, v[right], strict=True)}
            left = np.array(sorted({*left.tolist()} - {*twice.tolist()} | {spot[int(v[i])] for i in twice}), np.int64)
        return _edges(v, spanning(sets, left, right, np.flatnonzero(kind == 2), percent))

    return pairs


def _links(sets: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    edges, shape = [], "a bigint, b bigint"
    total = sizes.agg(F.sum(F.when(F.col("blocks") == 1, F.col("shingles"))).alias("small"), F.max("blocks").alias("most")).first()
    if total["small"]:
        bins = max(48, math.ceil(total["small"] / BLOCK_SHINGLES))
        edges.append(sets.where("blocks = 1").withColumn("bin", F.pmod(F.xxhash64("family"), F.lit(bins))).repartition(K.parts(sets.sparkSession, bins), "bin").groupBy("bin").applyInArrow(_small(percent), shape))
    if (total["most"] or 0) > 1:
        big = sets.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")))
        with_hub = big.where("v <> hub").unionByName(big.where("v = hub").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
        star = K.keep(with_hub.groupBy("family", "block").applyInArrow(_star(percent), shape))
        edges.append(star)
        done = star.select(F.col("a").alias("v")).distinct()
        left = K.keep(big.where("v <> hub").join(done, "v", "left_anti"))
        rest = left.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("shingles").cast("long") / 8) / BLOCK_SHINGLES)).alias("lefts"))
        one = left.join(rest, "family").select("family", F.pmod(F.xxhash64("v", F.lit(1)), F.col("lefts")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), "v", F.lit(0).alias("kind"), "shingles")
        held = done.withColumn("yes", F.lit(True))
        two = big.join(rest, "family").join(held, "v", "left").select("family", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - 1)).alias("i"), F.col("block").alias("j"), "v", F.when(F.col("yes") | (F.col("v") == F.col("hub")), 2).otherwise(1).alias("kind"), "shingles")
        tasks = rest.join(sizes, "family").agg(F.sum(F.col("lefts") * F.col("blocks")).alias("n")).first()["n"] or 0
        width = K.parts(sets.sparkSession, min(WIDEST, math.ceil(tasks / 4)))
        edges.append(one.unionByName(two).repartition(width, "family", "i", "j").groupBy("family", "i", "j").applyInArrow(_pairs(percent), shape))
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


def grouped(docs: DataFrame, percent: int, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, v, component, least) of every row: its class of equal sets, its component's least class and least doc_id."""
    docs = docs.select("doc_id", "text")
    sig = K.keep(docs.select("doc_id", "text", F.xxhash64("text").alias("content")).mapInArrow(_signatures(k), "doc_id bigint, content bigint, n_shingles bigint, v bigint, regs binary"))
    classes = K.keep(sig.where("v is not null").groupBy("v").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")))
    large = sig.where(F.col("n_shingles") > tiny(percent))
    reps = large.join(classes.withColumnRenamed("least", "doc_id").select("v", "doc_id"), ["v", "doc_id"]).dropDuplicates(["v"]).select("v", "regs")
    nameless = large.where("doc_id is null").join(classes.where("least is null").select("v"), "v", "left_semi").dropDuplicates(["v"]).select("v", "regs")
    bands = reps.unionByName(nameless).select("v", "regs").mapInArrow(_bands(rows_per_band(percent)), "key bigint, v bigint")
    buckets = bands.groupBy("key").agg(F.min("v").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hits = K.keep(bands.join(buckets, "key").select("v", "low", "n"))
    families = K.components(hits.select(F.col("v").alias("a"), F.col("low").alias("b")))
    degree = hits.groupBy("v").agg(F.sum("n").alias("degree"))
    member = K.keep(families.select("v", F.col("c").alias("family")).join(degree, "v").join(classes, "v"))
    sizes = K.keep(member.groupBy("family").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"), F.max_by("v", F.struct("degree", "v")).alias("hub")).withColumn("blocks", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES))))
    wanted = member.join(sizes.select("family", "blocks", "hub"), "family").select(F.col("least").alias("doc_id"), "v", "family", "blocks", "hub")
    found = docs.join(wanted.where("doc_id is not null"), "doc_id").select("text", "v", "family", "blocks", "hub")
    sets = found.mapInArrow(_full_sets(k), "v bigint, family bigint, blocks bigint, hub bigint, shingles binary")
    unnamed = wanted.where("doc_id is null").select("v", "family", "blocks", "hub")
    if unnamed.limit(1).count():  # texts without an id are found by their sets
        own = docs.where("doc_id is null").select("text").mapInArrow(_own_sets(k), "v bigint, shingles binary")
        sets = sets.unionByName(own.join(unnamed, "v").select("v", "family", "blocks", "hub", "shingles"))
    sets = K.keep(sets.dropDuplicates(["v"]))
    label = classes.select("v", F.col("v").alias("component"), "least", "copies")
    if sizes.limit(1).count():
        root = K.components(_links(sets, sizes, percent)).join(classes.select("v", "least"), "v")
        lows = root.groupBy("c").agg(F.min("least").alias("low"))
        merged = root.join(lows, "c").select("v", "c", "low")
        label = label.join(merged, "v", "left").select("v", F.coalesce("c", "v").alias("component"), F.coalesce("low", "least").alias("least"), "copies")
    return K.lookup(sig.select("doc_id", "content", "n_shingles", "v"), K.keep(label), "v", "copies")


def near_duplicates(docs: DataFrame, *, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Linked are sets with 100 * intersection >= percent * union. Empty and null texts have no
    shingles and are components of their own. Repeated rows, and rows that share a doc_id, belong
    to the classes of their texts. A null doc_id is never a component_id where the component has
    another; kept is component_id <=> doc_id, so rows without an id are kept only among themselves.
    Extra columns are ignored. Equal sets are recognised by 64-bit keys: among 10**9 different sets
    some pair shares a key with a probability of 3 %.
    """
    out = grouped(docs, percent, k)
    component = F.when(F.col("v").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, *, percent: int = PERCENT, k: int = SHINGLE) -> DataFrame:
    """The rows of docs without those that are near-duplicates of a row that stays; all columns go along.

    Of each group exactly one row stays: that of the least doc_id, of the least hash of the text
    among rows that share it. Rows without an id come last and are dropped like others where a copy
    with an id exists; of rows that are equal in id and text one stays. Null and empty texts are
    linked with nothing, so all of them stay.
    """
    rows = grouped(docs, percent, k).where("component is not null").groupBy("component", "doc_id", "content").agg(F.count(F.lit(1)).alias("n"))
    rows = K.keep(rows.withColumn("order", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content")))
    first = rows.groupBy("component").agg(F.min("order").alias("best"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    gone = K.lookup(rows, K.keep(first), "component", "rows").where(F.col("order") != F.col("best")).select("doc_id", "content")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))  # columns of any name go along
    match = F.col("doc.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("doc.text") == F.col("content"))
    left = whole.join(gone, match, "left_anti")
    again = rows.where("n > 1").select("doc_id", "content")
    if again.limit(1).count():
        equal = left.join(again, match, "left_semi").groupBy(F.col("doc.doc_id").alias("doc_id"), F.xxhash64("doc.text").alias("content")).agg(F.first("doc").alias("doc"))
        left = left.join(again, match, "left_anti").unionByName(equal.select("doc"))
    return left.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return near_duplicates(K.read(spark, sf_dir, "documents"), percent=CONTRACT_PERCENT)


QUERIES = {"op4_near_dedup": op4_near_dedup}
SQL: dict[str, str] = {}
