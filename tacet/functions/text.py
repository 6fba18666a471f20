"""Text normalisation, trigrams and cosine similarity as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _accents() -> tuple[str, str]:
    """Latin letters with marks and the plain letters that their decomposition begins with."""
    marked, plain = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        split = unicodedata.normalize("NFD", chr(code))
        if len(split) > 1 and split[0].isascii():
            marked.append(chr(code))
            plain.append(split[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _accents()


def normalize(x) -> Column:
    """Without accents, lower case, anything but a-z and 0-9 as single blanks, trimmed."""
    x = F.col(x) if isinstance(x, str) else x
    x = F.regexp_replace(F.translate(F.coalesce(x, F.lit("")), MARKED, PLAIN), "[\\u0300-\\u036F]", "")
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, not again for every element of a nested lambda."""
    return F.transform(F.array(value), use)[0]


#: Trigrams of normalised text are numbers: three of 37 symbols (blank, a-z, 0-9).
SYMBOLS = 37
GRAMS = SYMBOLS**3
CODE = np.zeros(256, np.int32)
CODE[[*range(0x61, 0x7B), *range(0x30, 0x3A)]] = np.arange(1, SYMBOLS)
VECTOR = "struct<grams:array<int>,tf:array<int>>"
ARROW_VECTOR = pa.struct([("grams", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])


def text_codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of normalised texts behind each other, and their offsets; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return CODE[raw], offs - offs[0]


def _lists(of: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int32)))


#: Symbols or grams that are counted or compared at a time, so that the arrays made for it stay small whatever the batch.
SLICE = 1 << 20


def slices(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have at most SLICE elements together, or are a single row."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE, "right")) - 1)
        yield at, to
        at = to


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def count_grams(padded: pa.Array) -> pa.Array:
    """The distinct trigrams of each text, in order, and their counts."""
    lengths = pc.fill_null(pc.binary_length(padded), 0).to_numpy(zero_copy_only=False)
    offs = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return _joined([_count(padded.slice(at, to - at)) for at, to in slices(offs)], ARROW_VECTOR)


def _count(padded: pa.Array) -> pa.Array:
    code, offs = text_codes(padded)
    n, size = len(offs) - 1, max(0, len(code) - 2)
    gram = (code[:size] * SYMBOLS + code[1 : size + 1]) * SYMBOLS + code[2 : size + 2]
    of = np.repeat(np.arange(n), np.diff(offs))[:size]
    whole = np.arange(size) + 2 < offs[of + 1] if size else np.zeros(0, bool)
    key, tf = np.unique(of[whole] * GRAMS + gram[whole], return_counts=True)
    of, gram = np.divmod(key, GRAMS)
    return pa.StructArray.from_arrays([_lists(of, gram, n), _lists(of, tf, n)], ["grams", "tf"])


def dot_products(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of each row the dot product of two vectors."""
    offs = a.field("grams").offsets.to_numpy().astype(np.int64) + b.field("grams").offsets.to_numpy()
    return _joined([_dot(a.slice(at, to - at), b.slice(at, to - at)) for at, to in slices(offs)], pa.int64())


def _dot(a: pa.Array, b: pa.Array) -> pa.Array:
    def flat(v):
        grams, tf = v.field("grams"), v.field("tf")
        size = np.diff(grams.offsets.to_numpy())
        return np.repeat(np.arange(len(v)), size) * GRAMS + grams.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)

    (ka, ta), (kb, tb) = flat(a), flat(b)
    if not len(ka):
        return pa.array(np.zeros(len(a), np.int64))
    at = np.searchsorted(ka, kb)
    at[at == len(ka)] = 0
    both = ka[at] == kb
    return pa.array(np.bincount(kb[both] // GRAMS, ta[at[both]] * tb[both], len(a)).astype(np.int64))


def _vectors(batches):
    """(id, vector, norm) of rows (id, normalised text between two blanks on either side); empty texts go."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        batch, lengths = batch.filter(pa.array(lengths > 4)), lengths[lengths > 4]
        for at, to in slices(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])):
            vector = _count(batch.column(1).slice(at, to - at))
            tf = vector.field("tf")
            squares = np.concatenate([[0], np.cumsum(tf.values.to_numpy().astype(np.int64) ** 2)])[tf.offsets.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), vector, pa.array(np.sqrt(np.diff(squares).astype(float)))], names=["id", "vector", "norm"])


def vectors(rows: DataFrame, text: Column) -> DataFrame:
    """(id, vector, norm) of rows with an id: trigram counts as sorted arrays. Empty texts have none; nothing is shuffled."""
    x = rows.select("id", F.concat(F.lit("  "), normalize(text), F.lit("  ")).alias("padded"))
    return x.mapInArrow(_vectors, f"id {x.schema['id'].dataType.simpleString()}, vector {VECTOR}, norm double")


def cosine(a: Column, b: Column, na: Column, nb: Column) -> Column:
    """Cosine of two trigram vectors; 0 where one is missing."""
    dot = F.arrow_udf(dot_products, "bigint")
    none = F.struct(F.array().cast("array<int>").alias("grams"), F.array().cast("array<int>").alias("tf"))
    product = dot(F.coalesce(a, none), F.coalesce(b, none))
    return F.when((na > 0) & (nb > 0), product / (na * nb)).otherwise(F.lit(0.0))


def with_cosine(rows: DataFrame) -> DataFrame:
    """rows with their cosine ``sim`` in place of vector_a, norm_a, vector_b and norm_b; 0 where one is missing.

    It is computed once a row, whatever is asked of it later: a condition on a column is moved below and computed twice.
    """
    none = F.struct(F.array().cast("array<int>").alias("grams"), F.array().cast("array<int>").alias("tf"))
    own = [c for c in rows.columns if c not in ("vector_a", "norm_a", "vector_b", "norm_b")]
    at = len(own)

    def work(batches):
        for batch in batches:
            product = dot_products(batch.column(at), batch.column(at + 1)).to_numpy()
            norms = batch.column(at + 2).to_numpy() * batch.column(at + 3).to_numpy()
            sim = np.divide(product, norms, out=np.zeros(len(norms)), where=norms > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(sim)], names=[*own, "sim"])

    x = rows.select(*own, *[F.coalesce(v, none).alias(v) for v in ("vector_a", "vector_b")], *[F.coalesce(n, F.lit(0.0)).alias(n) for n in ("norm_a", "norm_b")])
    return x.mapInArrow(work, rows.select(*own, F.lit(0.0).alias("sim")).schema)


def hits(norm: Column, words: list[str]) -> Column:
    """The entries of a lexicon that occur in a normalised text, in the lexicon's order."""
    return let(norm, lambda s: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(s, w)))


def register(spark: SparkSession) -> None:
    """Makes the table function trigrams(text) known to the session's SQL: (gram, tf) of a text, normalised as ``normalize`` does.

    SELECT id, t.* FROM reports, LATERAL trigrams(text) AS t. It is a function in SQL that counts sorted trigrams where the
    text is: no Python worker and no shuffle. Null and empty texts have no rows.
    """
    norm = "trim(regexp_replace(lower(regexp_replace(translate(text, '{0}', '{1}'), '[\\u0300-\\u036F]', '')), '[^a-z0-9]+', ' '))".format(MARKED, PLAIN)
    padded = f"transform(filter(array({norm}), n -> n <> ''), n -> '  ' || n || '  ')"
    grams = f"transform({padded}, p -> sort_array(regexp_extract_all(p, '(?=(...))', 1)))"  # one pass, where substr would count from the start each time
    starts = "filter(sequence(1, size(g)), i -> NOT (get(g, i - 1) <=> get(g, i - 2)))"  # of each run of equal ones
    runs = f"transform({grams}, g -> transform(array({starts}), s -> transform(sequence(1, size(s)), k -> struct(get(g, get(s, k - 1) - 1) AS gram, coalesce(get(s, k), size(g) + 1) - get(s, k - 1) AS tf))))"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION trigrams(text STRING) RETURNS TABLE (gram STRING, tf INT) RETURN SELECT p.gram, p.tf FROM (SELECT explode(flatten(flatten({runs}))) AS p)")
