"""Operator 7: a supervised subword-embedding classifier of document quality.

Features of a text are its words, its byte 3-grams and 4-grams, and marks for a word that repeats
the one before it; each is hashed to a learned vector. A text is the average of its vectors, and a
softmax layer gives its label's probability. Vectors and layer are trained by stochastic gradient
descent in numpy on a bounded sample of labelled texts. As the layer is linear in the average, a
trained model scores with one number per feature.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacet.llm import kernel as K

WORD_BITS, GRAM_BITS = 15, 15
SIZE = (1 << WORD_BITS) + 2 * (1 << GRAM_BITS) + 2
DIM, EPOCHS, RATE = 8, 6, 2.0
#: At most so many labelled texts train the model, those of the least hashed ids, as long as their features fit into so many bytes.
SAMPLE, SAMPLE_BYTES = 4_000, 256 << 20
CUT = 0.7
SEED = 7


def features(column):
    """Hashed features of all texts in groups: (feature ids, number of the first id of each text)."""
    buf, offs = K.buffer_of(column)
    starts, ends, first = K.words_of(buf, offs)
    wh = K.word_hashes(buf, starts, ends)
    yield (wh >> K.U64(64 - WORD_BITS)).astype(np.int64), first
    again = np.zeros(len(wh), np.int64)
    again[1:] = wh[1:] == wh[:-1]
    again[first[:-1][first[:-1] < len(wh)]] = 0
    yield SIZE - 2 + again, first
    flat = np.where(K.SPACE[buf], np.uint8(0x20), buf).astype(np.uint32)
    for k, shift in ((3, 0), (4, 1)):
        n = max(0, len(flat) - k + 1)
        code = np.zeros(n, np.uint32)
        for j in range(k):
            code |= flat[j : j + n] << np.uint32(8 * j)
        ids = ((code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)).astype(np.int64) + (1 << WORD_BITS) + shift * (1 << GRAM_BITS)
        within = np.ones(n, bool)
        for j in range(1, k):  # grams do not reach into the next text
            edge = offs[1:-1] - j
            within[edge[(edge >= 0) & (edge < n)]] = False
        if (np.diff(offs) < k).any():
            doc = np.searchsorted(offs, np.arange(n), "right")
            within &= np.arange(n) + k <= offs[doc]
        count = np.concatenate([[0], np.cumsum(within)])
        yield ids[within], count[np.minimum(offs, n)]


@K.tidy
def _bags(batches):
    """Of each text its distinct features and their shares."""
    for batch in batches:
        for a, b in K.pieces(batch.column("text"), 1 << 20):
            part = batch.slice(a, b - a)
            groups = list(features(part.column("text")))
            ids, share = [], []
            for d in range(part.num_rows):
                own = np.concatenate([x[f[d] : f[d + 1]] for x, f in groups])
                i, n = np.unique(own, return_counts=True)
                ids.append(i.astype(np.int32).tobytes())
                share.append((n / max(len(own), 1)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(share, pa.binary())], ["doc_id", "ids", "share"])


def train(bags: list, labels: list, epochs: int = EPOCHS):
    """One number per feature and a bias: the log-odds of label 1, from stochastic gradient descent."""
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (SIZE, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    total, step = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, share = bags[i]
            x = share @ table[ids]
            z = layer @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            rate = np.float32(RATE * (1 - step / total))
            back = p @ layer
            layer -= rate * np.outer(p, x).astype(np.float32)
            bias -= rate * np.float32(0.1) * p.astype(np.float32)
            table[ids] -= (rate * DIM) * share[:, None] * back[None, :].astype(np.float32)
            step += 1
    return (table @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0])


def _scorer(model):
    @K.tidy
    def score(batches):
        weights, bias = model.value
        for batch in batches:
            for a, b in K.pieces(batch.column("text")):
                part = batch.slice(a, b - a)
                total, n = np.zeros(part.num_rows), np.zeros(part.num_rows)
                for ids, first in features(part.column("text")):
                    total += K.per_text(weights[ids], first)
                    n += np.diff(first)
                z = total / np.maximum(n, 1) + bias
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i, c in enumerate(part.schema.names) if c != "text"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*(c for c in part.schema.names if c != "text"), "score"])

    return score


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES):
    """A model of quality from at most ``sample`` labelled rows that are not held out, and ``sample_bytes`` of features.

    Of rows that share a doc_id the text of the least hash counts, of labels that do the largest. Ids
    are taken in the order of their hashes, so the sample does not depend on the order of the rows.
    """
    held = F.pmod(K.crc32_column(F.col("doc_id")), F.lit(4)) == 2
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = {r["doc_id"]: int(r["quality"]) for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    if not chosen:
        return train([], [])
    texts = docs.select("doc_id", "text").where(F.col("doc_id").isin(list(chosen))).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    bags = K.keep(texts.mapInArrow(_bags, "doc_id bigint, ids binary, share binary"))
    sizes = {r["doc_id"]: r["n"] for r in bags.select("doc_id", (F.octet_length("ids") + F.octet_length("share")).alias("n")).collect()}  # at most ``sample`` rows
    fits, total = [], 0
    for i in chosen:
        if i in sizes and total + sizes[i] <= sample_bytes:
            fits.append(i)
            total += sizes[i]
    rows = bags.where(F.col("doc_id").isin(fits)).toLocalIterator(prefetchPartitions=False)
    got = {r["doc_id"]: (np.frombuffer(r["ids"], np.int32), np.frombuffer(r["share"], np.float32)) for r in rows}
    order = sorted(got)
    return train([got[i] for i in order], [chosen[i] for i in order])


def classify(docs: DataFrame, model) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Null and empty texts get the bias alone. A null doc_id is not held out. Equal texts get equal
    scores, wherever they stand. Extra columns are ignored; without labelled rows every score is 0.5.
    """
    held = F.coalesce(F.pmod(K.crc32_column(F.col("doc_id")), F.lit(4)) == 2, F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE numbers, whatever the input
    out = docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(_scorer(shared), "doc_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document."""
    docs, labels = (K.read(spark, sf_dir, t) for t in ("documents", "labels"))
    return classify(docs, fit(docs, labels))


QUERIES = {"op7_quality_classifier": op7_quality_classifier}
SQL: dict[str, str] = {}
