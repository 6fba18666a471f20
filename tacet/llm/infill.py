"""Operator 12: fill-in-middle transformation.

An Arrow-batched pandas UDF cuts each text into units (lines by default) with ``finditer`` of the regex
library, which gives the end of each unit in code points; the ends lie in a compact array. Two numbers
out of a digest of seed and id choose how many units are prefix and middle, so two lookups in that array
slice the text, and two more choose the form. A row depends on its own id and text alone: nothing is
shuffled, and a lost executor's rows come out the same when they are made again.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tacet.llm import kernel as K

#: A unit is a line with its end, and the marks of prefix, suffix and middle.
LINES = r"[^\n]*\n|[^\n]+"
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50
SHAPE = "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str, unit) -> array:
    """Places (code points) where the units of a text end."""
    return array("q", (m.end() for m in unit.finditer(text)))


def numbers(seed: int, doc_id: int | None) -> list[int]:
    """The first four groups of eight digits of the digest of seed and id; no id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def infill(text: str, ends: array, draw: list[int], marks=MARKS, rate: int = RATE, spm: int = SPM) -> tuple[str, str, int | None, int | None]:
    """(output, form, characters of the prefix, of the middle) of one text."""
    one, two, chance, order = draw
    n = len(ends)
    if not text or any(m in text for m in marks) or chance % 100 >= rate:
        return text, "plain", None, None
    low, high = sorted((one % (n + 1), two % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    p, s, m = marks
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm:
        return f"{s}{suffix}{p}{prefix}{m}{middle}", "spm", a, b - a
    return f"{p}{prefix}{s}{suffix}{m}{middle}", "psm", a, b - a


def restored(output: str, form: str, marks=MARKS) -> str:
    """The text, rebuilt from output and form alone: no text with a mark in it is transformed, so each mark stands once."""
    if form == "plain":
        return output
    p, s, m = marks
    head, middle = output.split(m)
    if form == "spm":
        suffix, prefix = head[len(s) :].split(p)
    else:
        prefix, suffix = head[len(p) :].split(s)
    return prefix + middle + suffix


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _transform(unit: str, seed: int, marks, rate: int, spm: int, texts: bool):
    def work(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        cut = regex.compile(unit)
        try:
            for ids, column in batches:
                out = []
                for doc_id, text in zip(ids, column, strict=True):
                    text = text or ""
                    ends = unit_ends(text, cut)
                    output, form, before, middle = infill(text, ends, numbers(seed, None if pd.isna(doc_id) else int(doc_id)), marks, rate, spm)
                    out.append((len(ends), form, before, middle, output if texts else None, _sha(output), _sha(restored(output, form, marks))))
                frame = pd.DataFrame(out, columns=[c.split()[0] for c in SHAPE.split(", ")])
                yield frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
        finally:
            K.trim()

    return F.pandas_udf(work, SHAPE)


def fill_in_middle(docs: DataFrame, *, unit: str = LINES, seed: int = SEED, rate: int = RATE, spm: int = SPM, marks=MARKS, texts: bool = True) -> DataFrame:
    """Per row of docs: doc (struct of its columns), n (units), form, prefix_chars, middle_chars, output, output_sha256, restored_sha256.

    Of 100 texts ``rate`` are transformed, and of 100 of those ``spm`` have the suffix first; the choice
    depends on seed and doc_id alone, so equal rows give equal outputs. ``unit`` must match
    every character; matches run from left to right. Empty and null texts, texts that hold a mark, and
    those not chosen stay as they are: form plain, null counts. A null id counts as an empty one. With
    ``texts`` off the output itself is left out. Other columns pass through in doc. The marks must not be
    parts of each other and differ in more than an overlap, as the given ones do. A worker needs some
    ten bytes per character of the longest text, and eight per unit.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    # the id goes as text: a column with nulls would turn into floating point in pandas
    made = _transform(unit, seed, tuple(marks), rate, spm, texts)(F.col("doc.doc_id").cast("string"), F.col("doc.text"))
    return whole.withColumn("made", made).select("doc", "made.*")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    docs = K.read(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle(docs, texts=False).select(F.col("doc.doc_id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES = {"op12_fill_in_middle": op12_fill_in_middle}
SQL: dict[str, str] = {}
