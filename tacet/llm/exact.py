"""Operator 11: exact dedup by an extendible-hash index on shared files.

Scan: texts are normalised and digested in chunks of one Arrow batch at most. Equal texts of a chunk become
one entry (key, number of rows, greatest id, bytes of the text), so that a text which a third of all
rows hold costs an entry per chunk. Entries and rows are written to the shared folder.

Directory: it has a cell for every value of the key's leading bits. One bucket holds all cells at first;
a bucket with too many bytes is split by its next bit, and the directory doubles when the bucket is as deep
as the directory. A bucket that is still overfull at the greatest depth gets a chain of pages, to which
its entries are dealt by chunk. Buckets in order are joined to key ranges of one size, each with an owner.

Owners: a task reads the entries of its ranges in order of bucket, page and key; entries of one key are chained, and
their bytes are compared. Only the chain of one key is held. What chained pages found is settled once more by bucket.
Every chunk's entry then learns its group, and rows find it by chunk and entry.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacet.llm import kernel as K

BUCKET_BYTES = 16 << 20
#: The directory has at most 2 ** MOST_BITS cells: that many rows of some 16 bytes go to the driver and to every task.
#: A corpus of more than BUCKET_BYTES * 2 ** (MOST_BITS - 1) bytes gets larger buckets; owners stream through them.
MOST_BITS = 20
ENTRY_BYTES = 64  # an entry's own bytes, beside those of its text
NO_ID = np.iinfo(np.int64).min
ENTRY = "chunk bigint, entry int, key bigint, n bigint, top bigint, text binary"


def normalised(column) -> tuple[bytes, np.ndarray]:
    """All texts behind each other with A-Z in lower case, and their offsets; null counts as empty."""
    buf, offs = K.buffer_of(column)
    return K.LOWER[buf].tobytes(), offs


def _scan(carry: bool, names: list[str]):
    """Rows with chunk, place and entry; the first row of each entry has its key, rows, greatest id and text."""

    @K.tidy
    def scan(batches):
        part, serial = TaskContext.get().partitionId(), itertools.count()
        for batch in batches:
            doc = batch.column("doc")
            doc = pa.StructArray.from_arrays(doc.flatten(), fields=list(doc.type))
            for a, b in K.pieces(doc.field("text"), 8 << 20):
                piece = doc.slice(a, b - a)
                raw, offs = normalised(piece.field("text"))
                ids = pc.fill_null(piece.field("doc_id").cast(pa.int64()), NO_ID).to_numpy(zero_copy_only=False)
                size = len(ids)
                texts = [raw[offs[i] : offs[i + 1]] for i in range(size)]
                del raw
                number: dict[bytes, int] = {}
                entry = np.fromiter((number.setdefault(t, len(number)) for t in texts), np.int64, size)
                lead = np.zeros(len(number), np.int64)
                lead[entry[::-1]] = np.arange(size)[::-1]  # the first row of each entry
                top = np.full(len(number), NO_ID)
                np.maximum.at(top, entry, ids)
                digests = [hashlib.sha256(texts[i]).digest() for i in lead]
                keys = np.frombuffer(b"".join(d[:8] for d in digests), ">i8").astype(np.int64)
                first = np.zeros(size, bool)
                first[lead] = True
                best = np.flatnonzero(ids == top[entry])
                winner = np.zeros(size, bool)
                winner[best[np.unique(entry[best], return_index=True)[1]]] = True  # of rows with the greatest id the first
                rows = np.bincount(entry, minlength=len(number))
                hexes = [d.hex() for d in digests]
                where = pa.array(entry)
                columns = {
                    "chunk": pa.array(np.full(size, (part << 33) | next(serial))),
                    "entry": pa.array(entry.astype(np.int32)),
                    "doc_id": piece.field("doc_id").cast(pa.int64()),
                    "winner": pa.array(winner),
                    "sha": pa.array(hexes).take(where) if size else pa.array([], pa.string()),
                    "key": pa.array(keys).take(where),
                    "n": pa.array(rows).take(where),
                    "top": pa.array(top).take(where),
                    "text": pa.array([t if f else None for t, f in zip(texts, first.tolist(), strict=True)], pa.binary()),
                }
                if carry:
                    columns["doc"] = piece
                del texts, number
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return scan


def split_buckets(cells: np.ndarray, bits: int, capacity: int) -> tuple[np.ndarray, list[int], int]:
    """(bucket of each cell, bytes of each bucket, depth of the directory) for the bytes of the cells of 2 ** bits leading-bit values.

    The directory starts with one cell; an overfull bucket is split by the next bit, for which the directory doubles
    if the bucket is as deep as it is. At the depth of ``bits`` a bucket stays as it is.
    """
    total = np.concatenate([[0], np.cumsum(cells)])
    directory, depth, buckets = [0], 0, [(0, 0)]  # a bucket: its prefix and its depth
    todo = [0]
    while todo:
        b = todo.pop()
        prefix, own = buckets[b]
        span = 1 << (bits - own)
        if own == bits or total[(prefix + 1) * span] - total[prefix * span] <= capacity:
            continue
        if own == depth:
            directory = [x for x in directory for _ in (0, 1)]
            depth += 1
        buckets[b] = (2 * prefix, own + 1)
        buckets.append((2 * prefix + 1, own + 1))
        half = 1 << (depth - own - 1)
        at = (2 * prefix + 1) * half
        directory[at : at + half] = [len(buckets) - 1] * half
        todo += [b, len(buckets) - 1]
    order = sorted(range(len(buckets)), key=lambda b: buckets[b][0] << (bits - buckets[b][1]))  # by key range
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    sizes = [int(total[(p + 1) << (bits - d)] - total[p << (bits - d)]) for p, d in (buckets[b] for b in order)]
    return np.repeat(rank[directory], 1 << (bits - depth)), sizes, depth


def make_directory(entries: DataFrame, bucket_bytes: int, most_bits: int) -> tuple[DataFrame, int, int]:
    """(cell, bucket, owner, pages) of every cell, the bits of a cell, and the number of owners."""
    spark = entries.sparkSession
    weight = F.octet_length("text") + ENTRY_BYTES
    size = entries.agg(F.sum(weight.cast("long"))).first()[0] or 0
    bits = min(most_bits, max(4, math.ceil(math.log2(size / bucket_bytes + 1)) + 3))
    capacity = max(bucket_bytes, size >> (bits - 1))
    cell = F.shiftrightunsigned("key", 64 - bits).alias("cell")
    cells = np.zeros(1 << bits, np.int64)
    for c, held in entries.groupBy(cell).agg(F.sum(weight.cast("long"))).collect():  # a row per cell
        cells[c] = held
    bucket, sizes, _ = split_buckets(cells, bits, capacity)
    pages = [max(1, math.ceil(s / capacity)) for s in sizes]
    before = np.cumsum([0, *sizes])
    starts = [int(before[b] // capacity) for b in range(len(sizes))]
    number = {o: i for i, o in enumerate(sorted({s + p for s, n in zip(starts, pages, strict=True) for p in range(n)}))}
    rows = [(c, int(b), number[starts[b]], pages[b]) for c, b in enumerate(bucket.tolist())]
    return spark.createDataFrame(rows, "cell bigint, bucket bigint, owner bigint, pages bigint"), bits, len(number)


MEMBER = "chunk bigint, entry int, bucket bigint, key bigint, page bigint, class int, keep_id bigint, win bigint, size bigint, lead boolean, more boolean, text binary"


def _settle(batches):
    """Chains of entries with one key (in order of bucket, page, key): a row per entry with its class, and the totals of the class.

    Where the bucket has more pages, the first entry of each class brings the text along, for the pages to be joined.
    """
    names = [c.split()[0] for c in MEMBER.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    chain: list[tuple] = []  # the entries of one key: (chunk, entry, class)
    classes: list[list] = []  # text, rows, greatest id, and the chunk that has it
    now: tuple | None = None
    out: list[list] = [[] for _ in names]

    def close():
        bucket, page, key, pages = now
        several, led = pages > 1, set()
        for chunk, entry, c in chain:
            text, rows, top, win = classes[c]
            lead = c not in led
            led.add(c)
            for column, value in zip(out, (chunk, entry, bucket, key, page, c, top, win, rows, lead, several, text if several and lead else None), strict=True):
                column.append(value)

    def flush():
        batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=names)
        for column in out:
            column.clear()
        return batch

    for batch in batches:
        places = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "page", "key", "pages")), strict=True))
        chunks, entries, ns, tops, wins = (batch.column(c).to_pylist() for c in ("chunk", "entry", "n", "top", "win"))
        texts = batch.column("text")
        for i, place in enumerate(places):
            if place != now:
                if now is not None:
                    close()
                now, chain, classes = place, [], []
            text = texts[i].as_py()
            for c, held in enumerate(classes):
                if held[0] == text:
                    held[1] += ns[i]
                    if (tops[i], -wins[i]) > (held[2], -held[3]):
                        held[2:] = tops[i], wins[i]
                    break
            else:
                c = len(classes)
                classes.append([text, ns[i], tops[i], wins[i]])
            chain.append((chunks[i], entries[i], c))
        yield flush()
    if now is not None:
        close()
    yield flush()


def _own(entries: DataFrame, owners: int) -> DataFrame:
    """Entries with bucket, page, pages and owner, settled by the owners' tasks."""
    x = entries.repartitionById(owners, F.pmod("owner", F.lit(owners)).cast("int")).sortWithinPartitions("bucket", "page", "key")
    return x.select("bucket", "page", "key", "pages", "chunk", "entry", "n", "top", "win", "text").mapInArrow(K.tidy(_settle), MEMBER)


def settle(entries: DataFrame, bucket_bytes: int, most_bits: int) -> DataFrame:
    """(chunk, entry, keep_id, win, size) of entries whose text other entries have too."""
    directory, bits, owners = make_directory(entries, bucket_bytes, most_bits)
    directory = K.keep(directory)
    placed = entries.withColumn("cell", F.shiftrightunsigned("key", 64 - bits)).join(F.broadcast(directory), "cell")  # 2 ** bits rows
    page = F.pmod(F.xxhash64("chunk"), F.col("pages"))
    placed = placed.withColumns({"page": page, "owner": F.col("owner") + page, "win": F.col("chunk")})
    member = K.keep(_own(placed, owners))
    own = ["chunk", "entry", "keep_id", "win", "size"]
    alone = member.where(~F.col("more")).select(*own)
    paged = member.where("more")
    leads = paged.where("lead").select("bucket", F.lit(0).cast("bigint").alias("page"), "key", F.lit(1).cast("bigint").alias("pages"), F.col("bucket").alias("owner"), F.col("page").alias("chunk"), F.col("class").alias("entry"), F.col("size").alias("n"), F.col("keep_id").alias("top"), "win", "text")
    # a page is a chunk of the second round, and a class of a page an entry of it
    whole = _own(leads, owners).select("bucket", "key", F.col("chunk").alias("page"), F.col("entry").alias("class"), "keep_id", "win", "size")
    joined = paged.select("chunk", "entry", "bucket", "key", "page", "class").join(whole, ["bucket", "key", "page", "class"])
    return alone.unionByName(joined.select(*own))


def _groups(docs: DataFrame, carry: bool, bucket_bytes: int, most_bits: int) -> DataFrame:
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    ddl = "chunk bigint, entry int, doc_id bigint, winner boolean, sha string, key bigint, n bigint, top bigint, text binary"
    shape = T.StructType([*T.StructType.fromDDL(ddl), *([whole.schema["doc"]] if carry else [])])
    rows = K.keep(whole.mapInArrow(_scan(carry, shape.names), shape))
    entries = rows.where("text is not null").select("chunk", "entry", "key", "n", "top", "text")
    group = settle(entries, bucket_bytes, most_bits)
    x = rows.drop("key", "n", "top", "text").join(group, ["chunk", "entry"])
    kept = F.col("winner") & (F.col("chunk") == F.col("win"))
    keep_id = F.when(F.col("keep_id") != NO_ID, F.col("keep_id"))
    return x.select(*(["doc"] if carry else []), "doc_id", keep_id.alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def exact_groups(docs: DataFrame, *, bucket_bytes: int = BUCKET_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """Per row of docs: doc_id, keep_id (doc_id of the row that stays), group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when they are identical after A-Z is lower-cased; null counts as empty. Of equal texts the row
    with the greatest doc_id stays; a missing id is less than any, and of rows with the same id one stays. If no row
    of a group has an id, one stays and keep_id is null. Other columns are not looked at. An owner's task holds
    one text of each chain (two if digests of different texts begin with the same 64 bits) and 24 bytes for each of its
    entries; a scan's task holds a chunk of some 8 MB, or one text.
    """
    return _groups(docs.select("doc_id", "text"), False, bucket_bytes, most_bits)


def remove_copies(docs: DataFrame, *, bucket_bytes: int = BUCKET_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    kept = _groups(docs, True, bucket_bytes, most_bits).where("kept")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    return exact_groups(K.read(spark, sf_dir, "documents"))


#: The same rows by grouping on the whole normalised text.
_ORACLE = """WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""
QUERIES = {"op11_exact_dedup": op11_exact_dedup}
SQL = {"op11_exact_dedup": _ORACLE}
