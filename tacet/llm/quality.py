"""Operator 3: quality rules with adaptive thresholds.

Each document gets counts, and rates that are lower bounds given its size: a short text's rate says
little. Per language and source, a mergeable KLL quantile sketch of each rate is read at every
hundredth, and the highest rate that passes is the larger of two values. One is the median plus a
multiple of the upper quartile's distance. The other is the middle of the gap that best splits the
quantiles in two (the split with the largest variance between its sides), which is where a separate
group of bad documents begins. Thresholds are shrunk by the number of documents: a group's towards
its language's, a language's towards that of all. Documents are then joined to the thresholds and
filtered. No cutoff is a constant.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacet.llm import kernel as K

MIN_WORDS = 20
WINDOW = 8
#: Upper quartile distances over the median, in units of a normal distribution's deviation.
SPREADS = 6.0
#: Deviations of a count by which a rate's lower bound stays below it.
BOUND = 2.0
#: Documents that the parent's threshold counts for.
SHRINK = 200
SKETCH_K = 400
LEVELS = [i / 100 for i in range(1, 100)]
BROADCAST_GROUPS = 10_000
#: The rates: what is counted, over what.
RATES = {"symbols_per_char": ("n_symbols", "n_chars_all"), "marks_per_char": ("n_marks", "n_chars_all"), "upper_per_char": ("n_upper", "n_chars_all"), "dup_lines_per_line": ("n_dup_lines", "n_lines"), "repeats_per_word": ("n_repeat_words", "n_words"), "chars_per_word": ("word_chars", "n_words")}
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"!?")] = True
UPPER = np.zeros(256, bool)
UPPER[0x41:0x5B] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars_all", "n_marks", "n_upper"]


def _lines(buf: np.ndarray, offs: np.ndarray):
    """Of each text the lines with a word, and those of them equal to an earlier line of the text."""
    n = len(offs) - 1
    if not len(buf):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    newline = np.zeros(256, bool)
    newline[0x0A] = True
    starts, ends, first = K.words_of(buf, offs, newline)
    of = np.repeat(np.arange(n), np.diff(first))
    word = np.concatenate([[0], np.cumsum(~K.SPACE[buf])])
    full = word[ends] > word[starts]
    starts, ends, of = starts[full], ends[full], of[full]
    _, lead = np.unique(K.mix(K.word_hashes(buf, starts, ends) + K.mix(of.astype(np.uint64) + K.U64(1))), return_index=True)
    total = np.bincount(of, minlength=n)
    return total, total - np.bincount(of[lead], minlength=n)


def counts_of(column) -> list[np.ndarray]:
    """The COUNTS of each text."""
    buf, offs = K.buffer_of(column)
    starts, ends, first = K.words_of(buf, offs)
    n = len(offs) - 1

    def per(mask):
        return np.concatenate([[0], np.cumsum(mask)])[offs]

    lead = (buf & 0xC0) != 0x80
    words = np.diff(first)
    inside = per(lead & ~K.SPACE[buf])
    win = K.rolling(K.word_hashes(buf, starts, ends), WINDOW)
    at = np.flatnonzero(K.whole(first, WINDOW))
    repeat = np.zeros(n, np.int64)
    if len(at):
        of = np.repeat(np.arange(n, dtype=np.uint64), words)[at]
        _, which, count = np.unique(K.mix(win[at] + K.mix(of + K.U64(1))), return_inverse=True, return_counts=True)
        hit = at[count[which] > 1]
        step = np.zeros(len(starts) + 1, np.int64)
        step[hit] += 1  # a place is the start of one window, so no index repeats
        step[hit + WINDOW] -= 1
        repeat = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(step)[:-1] > 0)])[first])
    lines, dup = _lines(buf, offs)
    return [words, np.diff(inside), np.diff(per(SYMBOLS[buf])), dup, repeat, lines, np.diff(per(lead)), np.diff(per(MARKS[buf])), np.diff(per(UPPER[buf]))]


@K.tidy
def _measure(batches):
    for batch in batches:
        text = batch.column(0).field("text")
        for a, b in K.pieces(text):
            got = counts_of(text.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *(pa.array(x.astype(np.int64)) for x in got)], [*batch.schema.names, *COUNTS])


SHAPE = ", ".join(f"{c} bigint" for c in COUNTS)


def _rates() -> dict:
    return {r: F.greatest(F.col(a) - BOUND * F.sqrt(a), F.lit(0.0)) / F.greatest(F.col(b), F.lit(1)) for r, (a, b) in RATES.items()}


def limits(q: np.ndarray) -> np.ndarray:
    """The highest rate that passes, of each row of quantiles at LEVELS."""
    n = q.shape[1]
    left = np.arange(1, n)
    run = np.cumsum(q, 1)
    low, high = run[:, :-1] / left, (run[:, -1:] - run[:, :-1]) / (n - left)
    at = (left * (n - left) * (high - low) ** 2).argmax(1)
    rows = np.arange(len(q))
    gap = (q[rows, at] + q[rows, at + 1]) / 2
    half, upper = q[:, LEVELS.index(0.5)], q[:, LEVELS.index(0.75)]
    return np.maximum(gap, half + SPREADS * (upper - half) / 0.6745)


def _tops(batches):
    for batch in batches:
        g = batch.num_rows
        n, lang_n = (batch.column(c).to_numpy() for c in ("n", "lang_n"))
        out = [batch.column("lang"), batch.column("source")]
        for c in RATES:
            own, lang, every = (limits(batch.column(f"{p}{c}").flatten().to_numpy().reshape(g, -1)) for p in ("", "lang_", "all_"))
            lang = (lang_n * lang + SHRINK * every) / (lang_n + SHRINK)
            out.append(pa.array((n * own + SHRINK * lang) / (n + SHRINK)))
        yield pa.RecordBatch.from_arrays(out, ["lang", "source", *(f"top_{c}" for c in RATES)])


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, one column top_<rate> each): the highest rates that pass; of columns lang, source and COUNTS."""
    rates = _rates()
    usable = measured.where(F.col("n_words") > 0)
    sketches = K.keep(usable.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), *[F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(c) for c, r in rates.items()]))
    by_lang = K.keep(sketches.groupBy("lang").agg(F.sum("n").alias("lang_n"), *[F.kll_merge_agg_double(c).alias(c) for c in rates]))
    overall = by_lang.groupBy(F.lit(1)).agg(*[F.kll_merge_agg_double(c).alias(c) for c in rates])
    levels = F.array(*map(F.lit, LEVELS))

    def read(prefix):
        return [F.kll_sketch_get_quantile_double(c, levels).alias(prefix + c) for c in rates]

    by_lang = by_lang.select(F.col("lang").alias("_lang"), "lang_n", *read("lang_"))
    x = sketches.select("lang", "source", "n", *read("")).join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).join(F.broadcast(overall.select(*read("all_"))))  # one row
    return x.drop("_lang").mapInArrow(_tops, "lang string, source string, " + ", ".join(f"top_{c} double" for c in rates))


def judged(measured: DataFrame, tops: DataFrame) -> DataFrame:
    """measured with base_failed, failed (names of the rates that are too high) and kept."""
    tops = K.keep(tops.withColumnsRenamed({"lang": "_lang", "source": "_source"}))
    if tops.count() <= BROADCAST_GROUPS:
        tops = F.broadcast(tops)
    x = measured.join(tops, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = F.array_compact(F.array(*[F.when(r > F.col(f"top_{c}"), F.lit(c)) for c, r in _rates().items()]))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return x.withColumn("base_failed", base).withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop("_lang", "_source")


def _with(docs: DataFrame, column: str) -> Column:
    """A column as text; a missing one counts as null everywhere."""
    return (F.col(f"`{column}`").cast("string") if column in docs.columns else F.lit(None).cast("string")).alias(column)


def measure(docs: DataFrame, columns: list[str]) -> DataFrame:
    """doc (struct of ``columns``), lang, source and the COUNTS of each row; every text is measured once."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in dict.fromkeys([*columns, "text"])]).alias("doc"), _with(docs, "lang"), _with(docs, "source"))
    shape = T.StructType([*packed.schema, *T.StructType.fromDDL(SHAPE)])
    if "text" in columns:
        return packed.mapInArrow(_measure, shape)
    slim = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in columns])
    return packed.mapInArrow(_measure_only, T.StructType([T.StructField("doc", slim), *shape[1:]]))


def _measure_only(batches):
    for batch in _measure(batches):
        doc = batch.column(0)
        names = [doc.type.field(i).name for i in range(doc.type.num_fields)]
        slim = pa.StructArray.from_arrays([doc.field(c) for c in names if c != "text"], [c for c in names if c != "text"])
        yield pa.RecordBatch.from_arrays([slim, *batch.columns[1:]], batch.schema.names)


def quality(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, source, COUNTS, thresholds, base_failed, failed, kept.

    Null and empty texts have no words and fail the base rule; they set no threshold. Null languages
    and sources are groups like any other, and so is everything where docs lack the column. Each row
    counts by itself, so repeated rows get equal verdicts. Extra columns are ignored.
    """
    measured = measure(docs, ["doc_id"])
    measured = K.keep(measured.select("doc.doc_id", *measured.columns[1:]))
    return judged(measured, thresholds(measured))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns. Texts are measured once and not shuffled."""
    measured = K.keep(measure(docs, docs.columns))
    return judged(measured, thresholds(measured)).where("kept").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document."""
    out = quality(K.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op3_quality_rules": op3_quality_rules}
SQL: dict[str, str] = {}
