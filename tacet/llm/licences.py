"""Operator 9: licence scan by diagonal voting.

All rolling k-gram hashes of a text's words that occur in a template are joined to the template's
positions. Each match votes for a diagonal (place in the text minus place in the template). Votes
are counted per text, template and diagonal, neighbouring diagonals are merged (small insertions
shift the diagonal), and a span is verified by the share of the template that its matches cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tacet.llm import kernel as K

GRAM = 3
NEAR = 2
COVER = 0.75
#: Phrases that give a label wherever they stand.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Opening passages and notices of public licences, with their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


def scan_words(column):
    """Hashes of the words of each lower-cased text, and the number of each text's first word."""
    buf, offs = K.buffer_of(column)
    buf = K.LOWER[buf]
    starts, ends, first = K.words_of(buf, offs, K.NON_ALNUM)
    return K.word_hashes(buf, starts, ends), first


def _grams(text: str, k: int) -> np.ndarray:
    return K.rolling(scan_words(pa.array([text]))[0], k).astype(np.int64)


def template_table(templates, k: int = GRAM) -> list[tuple[int, int, int]]:
    """(gram, template number, position): one row per position of the given templates."""
    return [(int(g), t, i) for t, (_, text) in enumerate(templates) for i, g in enumerate(_grams(text, k))]


def _scan(phrases: list[tuple[str, str]], known: np.ndarray, k: int):
    @K.tidy
    def scan(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 40
        wanted = [(len(p.split()), _grams(p, len(p.split())).astype(np.uint64)[0], label) for p, label in phrases]
        for batch in batches:
            for a, b in K.pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                wh, first = scan_words(part.column(1))
                n = len(first) - 1
                rows = [[] for _ in range(n)]
                count, low, high = np.zeros(n, np.int64), np.full(n, 1 << 60), np.full(n, -1)
                for size, h, label in wanted:
                    at = np.flatnonzero((K.rolling(wh, size) == h) & K.whole(first, size)) if len(wh) >= size else np.zeros(0, np.int64)
                    doc = np.searchsorted(first, at, "right") - 1
                    np.add.at(count, doc, 1)
                    np.minimum.at(low, doc, at - first[doc])
                    np.maximum.at(high, doc, at - first[doc])
                    for d in np.unique(doc):
                        rows[d].append(label)
                win = K.rolling(wh, k)
                near = np.searchsorted(known, win)
                near[near == len(known)] = 0
                at = np.flatnonzero((known[near] == win) & K.whole(first, k)) if len(win) else np.zeros(0, np.int64)
                cuts = np.searchsorted(at, first).astype(np.int32)
                doc = np.searchsorted(first, at, "right") - 1
                hits = pa.ListArray.from_arrays(pa.array(cuts), pa.StructArray.from_arrays([pa.array(win[at].astype(np.int64)), pa.array(at - first[doc])], ["gram", "pos"]))
                none = count == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(uid + np.arange(n)), part.column(0), pa.array(np.diff(first)), pa.array(count), pa.array(low, mask=none), pa.array(high, mask=none), pa.array([sorted(set(r)) for r in rows], pa.list_(pa.string())), hits],
                    ["uid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "hits"],
                )
                uid += n

    return scan


def scan_licences(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, k: int = GRAM, cover: float = COVER) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Phrases that stand anywhere give base labels. Templates whose verified spans cover at least
    ``cover`` of their grams add labels. score is 1 where a phrase stands, else the best cover.
    Null and empty texts have no words, labels or spans. Each row is scanned by itself, repeated
    rows too. Extra columns are ignored.
    """
    spark = docs.sparkSession
    grams = template_table(templates, k)
    known = np.unique(np.array([g for g, _, _ in grams], np.int64).astype(np.uint64))
    shape = "uid bigint, doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, hits array<struct<gram:bigint,pos:bigint>>"
    scanned = K.keep(docs.select("doc_id", "text").mapInArrow(_scan(list(phrases.items()), known, k), shape))
    places = F.broadcast(spark.createDataFrame(grams, "gram bigint, template int, place int"))  # as large as the given templates
    sizes = [len(_grams(t, k)) for _, t in templates]
    size = F.array(*[F.lit(n) for n in sizes])
    votes = scanned.select("uid", F.explode("hits").alias("h")).select("uid", "h.*").join(places, "gram")
    diagonals = votes.groupBy("uid", "template", (F.col("pos") - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    along = W.partitionBy("uid", "template").orderBy("diagonal")
    new = (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR).cast("int")
    merged = diagonals.withColumn("new", F.coalesce(new, F.lit(1))).withColumn("run", F.sum("new").over(along))
    spans = merged.groupBy("uid", "template", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("hit"), F.min("low").alias("low"), F.max("high").alias("high"))
    total = F.element_at(size, F.col("template") + 1)
    spans = spans.withColumn("cover", F.col("hit") / total)
    label = F.element_at(F.array(*[F.lit(x) for x, _ in templates]), F.col("template") + 1)
    fits = (F.col("cover") >= cover) & (F.col("high") - F.col("low") < 2 * total + k)
    per = spans.groupBy("uid").agg(
        F.max("cover").alias("best"),
        F.collect_set(F.when(fits, label)).alias("found"),
        F.array_sort(F.collect_list(F.when(fits, F.struct(F.col("low").alias("first"), (F.col("high") + k).alias("end"), label.alias("label"), "cover")))).alias("spans"),
    )
    x = scanned.join(per, "uid", "left")
    labels = F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",")
    return x.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), labels.alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"), "spans")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document."""
    return scan_licences(K.read(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op9_license_scan": op9_license_scan}
SQL: dict[str, str] = {}
