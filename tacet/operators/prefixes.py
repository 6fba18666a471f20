"""Texts similar by trigram cosine: equi-joins of rare trigrams, verified where two texts meet."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacet.functions import text as T

#: Bounds are a little wider than exact, so that rounding loses no pair; every pair is verified.
SLACK = 1e-9


def prefix(of: np.ndarray, gram: np.ndarray, tf: np.ndarray, norm: np.ndarray, often: np.ndarray, least: float) -> np.ndarray:
    """Numbers of the entries of vectors (row, gram, count) that belong to their row's prefix.

    Entries stand in an order that all vectors share, by ``often`` of the gram and then the gram. What comes after a
    prefix is too light for a cosine of ``least``, so two vectors as similar as that have a gram of both prefixes in common.
    """
    order = np.lexsort((gram, often[gram], of))
    weight = (tf.astype(float) ** 2)[order]
    row = of[order]
    total = np.bincount(row, weight, len(norm))
    first = np.searchsorted(row, np.arange(len(norm)))
    before = np.concatenate([[0.0], np.cumsum(weight)])
    left = total[row] - (before[:-1] - before[first[row]])  # weight from this entry on
    return order[left >= (least * norm[row]) ** 2 * (1 - SLACK)]


def frequencies(vectors: DataFrame) -> np.ndarray:
    """How many vectors have each trigram: one number for each possible trigram, however many vectors there are."""
    found = vectors.select(F.explode("vector.grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = np.zeros(T.GRAMS, np.int64)
    out[found["gram"].to_numpy()] = found["n"].to_numpy()
    return out


def leading(often: np.ndarray, least: float) -> Callable:
    """A function from (vector, norm) to the grams of the prefix, without those that no indexed vector has."""

    def lead(vector: pa.Array, norm: pa.Array) -> pa.Array:
        grams, tf = vector.field("grams"), vector.field("tf")
        n = len(vector)
        of = np.repeat(np.arange(n), np.diff(grams.offsets.to_numpy()))
        gram = grams.flatten().to_numpy().astype(np.int64)
        at = np.sort(prefix(of, gram, tf.flatten().to_numpy(), norm.to_numpy(), often, least))
        at = at[often[gram[at]] > 0]
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(of[at], np.arange(n + 1)).astype(np.int32)), pa.array(gram[at].astype(np.int32)))

    return lead


def text_dots(a: pa.Array, b: pa.Array) -> pa.Array:
    """Of each row the dot product of the trigram counts of two padded texts; a text that recurs in a batch is counted once."""
    sides = [x.dictionary_encode() for x in (a, b)]
    return T.dot_products(*[T.count_grams(s.dictionary).take(s.indices) for s in sides])


def _probes(rows: DataFrame, lead: Callable, side: str, *columns: str) -> DataFrame:
    """A row per gram of the prefix of rows (vector, size), with what bounds the dot product: sum and maximum of the counts."""
    total = F.aggregate("vector.tf", F.lit(0), lambda s, t: s + t)
    grams = F.arrow_udf(lead, "array<int>")(F.col("vector"), F.col("size"))
    return rows.select(*columns, F.col("size").alias(f"size_{side}"), total.alias(f"sum_{side}"), F.array_max("vector.tf").alias(f"most_{side}"), F.explode(grams).alias("gram"))


def similar_texts(texts: DataFrame, indexed: DataFrame, least: float) -> DataFrame:
    """(text, entity, score): the best cosine, of at least ``least`` and above 0, of each distinct normalised text with a variant of an entity.

    indexed: (entity, norm, vector, gram_norm). Both sides are joined on the grams of their prefixes, those rare among
    the indexed texts first; pairs whose lengths rule a cosine of ``least`` out are left out in the join, the rest is verified
    where it meets, and only what passes is shuffled again. The order of grams is counted over all indexed texts. A gram
    that many texts share is a hot key of a join of equal keys, which adaptive execution splits. Empty texts match nothing.
    """
    lead = leading(frequencies(indexed), least)
    a = T.vectors(texts.select(F.col("text").alias("id"), "text").where("text <> ''").distinct(), F.col("text")).select(F.col("id").alias("text"), "vector", F.col("norm").alias("size"))
    b = indexed.select("entity", F.col("norm").alias("variant"), "vector", F.col("gram_norm").alias("size"))
    met = _probes(a, lead, "a", "text").join(_probes(b, lead, "b", "entity", "variant"), "gram")
    sizes = F.col("size_a") * F.col("size_b")
    reach = F.least(F.col("sum_a") * F.col("most_b"), F.col("sum_b") * F.col("most_a")).cast("double")
    met = met.where(reach * (1 + SLACK) >= least * sizes)
    padded = [F.concat(F.lit("  "), F.col(c), F.lit("  ")) for c in ("text", "variant")]
    scored = met.select("text", "entity", (F.arrow_udf(text_dots, "bigint")(*padded) / sizes).alias("score"))
    return scored.where((F.col("score") >= least) & (F.col("score") > 0)).groupBy("text", "entity").agg(F.max("score").alias("score"))
