"""Triage: which entity a report names, and what kind of report it is.

gazetteer: id, name, aliases. reports: id, title, text, source_type. Exact names are found by
equi-joins of token windows with the gazetteer's variants, never by a pattern per variant. Similar
names are found where the texts are, against the trigrams of all variants, if these are few enough
to be sent everywhere; a larger gazetteer is joined by its rare trigrams.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tacet import config as C
from tacet.functions import maths as M
from tacet.functions import text as T
from tacet.operators import lexicons as L
from tacet.operators.prefixes import similar_texts
from tacet.sources.shared import keep


#: Most variants of a gazetteer that is sent to every task (some kilobytes each there).
FEW_VARIANTS = 2_000
CATEGORIES = ("corroboration-candidate", "hazard-signal", "new-settlement", "noise")
#: Calls of an outside classifier in a pass, candidates offered to it, and the range of its confidence.
MOST_CALLS, SHORTLIST, LEAST_TRUST, MOST_TRUST = 6, 8, 0.3, 0.7


def variants(gazetteer: DataFrame) -> DataFrame:
    """(entity, raw, norm, words, vector, gram_norm): every name and alias."""
    x = gazetteer.select(F.col("id").alias("entity"), F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("raw"))
    x = x.withColumn("norm", T.normalize("raw")).where("norm <> ''").dropDuplicates(["entity", "norm"])
    keyed = x.withColumn("id", F.struct("entity", "norm"))
    v = T.vectors(keyed, F.col("norm")).withColumnRenamed("norm", "gram_norm")
    return keyed.join(v, "id").select("entity", "raw", "norm", F.size(F.split("norm", " ")).alias("words"), "vector", "gram_norm")


def whole_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(F.coalesce("text", F.lit("")), 1, C.MAX_TEXT))


def windows(reports: DataFrame, longest: int) -> DataFrame:
    """(id, at, words, window, after): token windows of 1 to ``longest`` words of normalised title and text."""
    x = reports.select("id", T.normalize(whole_text()).alias("norm")).where("norm <> ''").select("id", F.split("norm", " ").alias("w"))
    x = x.select("id", "w", F.posexplode("w").alias("at", "first"))
    x = x.select("id", "w", "at", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("words")).where(F.col("at") + F.col("words") <= F.size("w"))
    return x.select("id", "at", "words", F.array_join(F.slice("w", F.col("at") + 1, F.col("words")), " ").alias("window"), F.try_element_at("w", F.col("at") + F.col("words") + 1).alias("after"), F.slice("w", F.col("at") + 1, F.col("words")).alias("tokens"))


def exact_matches(reports: DataFrame, gazetteer_variants: DataFrame) -> DataFrame:
    """(id, entity, n, matched): names that stand in the text and do not go on with a word for a river, valley or the like."""
    longest = gazetteer_variants.agg(F.max("words")).first()[0] or 1
    v = gazetteer_variants.select("entity", "raw", F.col("norm").alias("window"), "words")
    found = windows(reports, longest).drop("words").join(v, "window")
    found = found.where(~F.coalesce(F.col("after").isin(L.FEATURES), F.lit(False)))
    return found.groupBy("id", "entity").agg(F.count(F.lit(1)).alias("n"), F.max_by("raw", F.struct(F.length("window"), "window")).alias("matched"))


def _similar(entities: np.ndarray, grams: np.ndarray, norms: np.ndarray, least: float):
    """Of each text the short windows that are at least ``least`` like a variant. grams: variant, gram, count."""
    per = [grams[grams[:, 0] == v] for v in range(len(entities))]
    feature = {w.encode() for w in L.FEATURES}

    def look(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                norm = part.column(1)
                code, offs = T.text_codes(norm)
                raw = np.frombuffer("".join(norm.to_pylist()).encode(), np.uint8)
                blank = code == 0
                head = ~blank
                head[1:] &= blank[:-1]
                head[offs[:-1][offs[:-1] < len(code)]] = True
                starts = np.flatnonzero(head)
                tail = ~blank
                tail[:-1] &= blank[1:]
                tail[offs[1:] - 1] = True
                ends = np.flatnonzero(tail) + 1
                first = np.searchsorted(starts, offs)
                doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
                words = len(starts)
                marked = np.fromiter((raw[x:y].tobytes() in feature for x, y in zip(starts.tolist(), ends.tolist(), strict=True)), bool, words)
                # trigrams inside the padded text: a blank stands before each word and behind it
                wide = np.concatenate([[0], code, [0]]).astype(np.int64)
                inner = (wide[:-2] * T.SYMBOLS + wide[1:-1]) * T.SYMBOLS + wide[2:]  # the one centred on each byte
                gap = np.flatnonzero(np.isin(np.arange(len(code)), offs[1:-1]))
                for g in gap:  # neighbouring texts stand next to each other; between them belongs a blank
                    inner[g] = (wide[g + 1]) * T.SYMBOLS + wide[g + 2]
                    inner[g - 1] = (wide[g - 1] * T.SYMBOLS + wide[g]) * T.SYMBOLS
                lead, close = code[starts].astype(np.int64), code[ends - 1].astype(np.int64) * T.SYMBOLS * T.SYMBOLS
                spots = [np.arange(max(0, words - k + 1)) for k in (1, 2, 3)]
                i = np.concatenate(spots)
                j = np.concatenate([s + k for k, s in enumerate(spots)])
                ok = doc[i] == doc[j]
                i, j = i[ok], j[ok]
                follows = np.zeros(len(j), bool)
                more = (j + 1 < first[doc[j] + 1])
                follows[more] = marked[j[more] + 1]
                bad = np.concatenate([[0], np.cumsum(marked)])
                ok = ~follows & (bad[j + 1] == bad[i]) & (ends[j] - starts[i] >= 4)
                i, j = i[ok], j[ok]
                size = ends[j] - starts[i] + 2  # trigrams of the window
                out = []
                for v, g in enumerate(per):
                    weight = np.zeros(T.GRAMS, np.int64)
                    weight[g[:, 1]] = g[:, 2]
                    run = np.concatenate([[0], np.cumsum(weight[inner])])
                    dot = run[ends[j]] - run[starts[i]] + weight[lead[i]] + weight[close[j]]
                    # a window of n trigrams has a norm of at least the root of n
                    maybe = np.flatnonzero(dot >= least * np.sqrt(size) * norms[v] - 1e-9)
                    out += [(v, w, int(dot[w])) for w in maybe.tolist()]
                rows, known = [], {}
                for v, w, dot in out:
                    if w not in known:
                        own = np.concatenate([inner[starts[i[w]] : ends[j[w]]], [lead[i[w]], close[j[w]]]])
                        known[w] = float(np.sqrt((np.unique(own, return_counts=True)[1].astype(np.int64) ** 2).sum()))
                    score = dot / (known[w] * norms[v])
                    if score >= least:
                        rows.append((int(doc[i[w]]), int(entities[v]), score, int(i[w] - first[doc[i[w]]]), raw[starts[i[w]] : ends[j[w]]].tobytes().decode()))
                d, e, s, at, win = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d, pa.int64())), pa.array(e, pa.int64()), pa.array(s, pa.float64()), pa.array(at, pa.int64()), pa.array(win, pa.string())], ["id", "entity", "score", "at", "window"])

    return look


def _joined_scores(reports: DataFrame, gazetteer_variants: DataFrame, least: float) -> DataFrame:
    """(id, entity, score, at, window) by equi-joins of rare trigrams, for gazetteers of any size."""
    feature = F.array(*[F.lit(w) for w in L.FEATURES])
    w = windows(reports, 3).where((F.length("window") >= 4) & ~F.coalesce(F.col("after").isin(L.FEATURES), F.lit(False)) & ~F.arrays_overlap("tokens", feature))
    w = w.groupBy("id", "window").agg(F.min("at").alias("at"))
    best = similar_texts(w.select(F.col("window").alias("text")), gazetteer_variants, least).withColumnRenamed("text", "window")
    return w.join(best, "window").select("id", "entity", "score", "at", "window")


def fuzzy_scores(reports: DataFrame, gazetteer_variants: DataFrame, least: float = C.FUZZY_MIN, few: int = FEW_VARIANTS) -> DataFrame:
    """(id, entity, score, window): the best trigram cosine, of at least ``least``, of any window of one to three words with any variant of an entity."""
    if gazetteer_variants.limit(few + 1).count() <= few:
        known = gazetteer_variants.select("entity", "gram_norm", "vector").toPandas()  # at most ``few`` rows
        grams = np.array([(v, g, n) for v, x in enumerate(known["vector"]) for g, n in zip(x["grams"], x["tf"], strict=True)], np.int64).reshape(-1, 3)
        texts = reports.select("id", T.normalize(whole_text()).alias("norm")).where("norm <> ''")
        hit = texts.mapInArrow(_similar(known["entity"].to_numpy(), grams, known["gram_norm"].to_numpy(), least), "id bigint, entity bigint, score double, at bigint, window string")
    else:
        hit = _joined_scores(reports, gazetteer_variants, least)
    return hit.groupBy("id", "entity").agg(F.max("score").alias("score"), F.max_by("window", F.struct("score", -F.col("at"), -F.length("window"))).alias("window"))


def unknown_places(reports: DataFrame, gazetteer_variants: DataFrame) -> DataFrame:
    """(id, unknown_place): the first capitalised name marked as a place that is like no variant."""
    raw = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.substring(F.coalesce("text", F.lit("")), 1, C.MAX_TEXT))
    name = r"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)"
    one = F.regexp_extract_all(raw, F.lit(rf"\b{name}\s+(?:{'|'.join(L.PLACE_AFTER)})\b"), F.lit(1))
    two = F.regexp_extract_all(raw, F.lit(rf"\b(?:{'|'.join(L.PLACE_BEFORE)})\s+of\s+{name}\b"), F.lit(1))
    x = reports.select("id", F.posexplode(F.array_distinct(F.concat(one, two))).alias("pos", "name")).where(F.length("name") >= 3).withColumn("norm", T.normalize("name")).where("norm <> ''")
    known = similar_texts(x.select(F.col("norm").alias("text")), gazetteer_variants, C.UNKNOWN_BAR).select(F.col("text").alias("norm")).distinct()
    free = x.join(known, "norm", "left_anti")
    return free.groupBy("id").agg(F.min_by("name", "pos").alias("unknown_place"))


def lexicon_columns(norm: Column) -> dict[str, Column]:
    return {name: T.hits(norm, words) for name, words in (("hazard", L.HAZARD), ("strong", L.STRONG), ("weak", L.WEAK), ("warning", L.WARNING), ("negative", L.NEGATIVE), ("noise", L.NOISE))}


def counted(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, hazard, strong, ...): how many entries of each lexicon occur in normalised texts (norm).

    A text is normalised once and each lexicon counted once, as what is read from here is a column and not its expression.
    """
    hits = F.struct(*[F.size(c).alias(k) for k, c in lexicon_columns(F.col("norm")).items()])
    return texts.select(*keys, F.explode(F.array(hits)).alias("n")).select(*keys, "n.*")


def classify(entity: Column, unknown: Column, source: Column, n: dict[str, Column]) -> tuple[Column, Column]:
    """(category, strength) by the first rule that fits; n: hits per lexicon."""
    named = entity.isNotNull()
    status = n["strong"] + n["weak"]
    veto = (n["negative"] > 0) | ((n["warning"] > 0) & (n["strong"] == 0))
    real = (n["strong"] > 0) | ((n["weak"] >= 2) & (n["warning"] == 0))
    rules = [
        ((n["noise"] > 0) & (n["hazard"] == 0), "noise", F.lit(0.95)),
        ((n["hazard"] == 0) & (status == 0), "noise", F.lit(0.85)),
        (~named & unknown.isNotNull() & (n["hazard"] > 0), "new-settlement", F.lit(0.8)),
        (named & real & ~veto, "corroboration-candidate", F.when(source == "official", 0.95).when(source == "social", 0.78).otherwise(0.88)),
        (n["negative"] > 0, "hazard-signal", F.when(named, 0.9).otherwise(0.7)),
        (n["hazard"] > 0, "hazard-signal", F.when(named, 0.85).otherwise(0.7)),
    ]
    category, strength = F.lit("noise"), F.lit(0.6)
    for fits, name, value in reversed(rules):
        category, strength = F.when(fits, name).otherwise(category), F.when(fits, value).otherwise(strength)
    return category, strength


def triage(reports: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """id, entity, category, confidence, tier, matched_on and the signals of each report.

    Exact names first; if none or several stand there, fuzzy ones (of several only those); what then
    has no entity and is not noise is residual: tier 3 without an outside classifier, confidence 0.3.
    """
    v = keep(variants(gazetteer))
    exact = keep(exact_matches(reports, v))
    per = exact.groupBy("id").agg(F.count(F.lit(1)).alias("exact"), F.first("entity").alias("only"), F.first("matched").alias("only_matched"))
    x = keep(reports.select("id", "source_type", T.normalize(whole_text()).alias("norm")))
    n = lexicon_columns(F.col("norm"))
    x = x.select("id", "source_type", *[c.alias(f"{k}_hits") for k, c in n.items()])
    x = x.join(per, "id", "left").join(unknown_places(reports, v), "id", "left").withColumn("exact", F.coalesce("exact", F.lit(0)))
    size = {k: F.size(f"{k}_hits") for k in n}
    none = F.lit(None).cast("bigint")
    bare, bare_s = classify(none, F.col("unknown_place"), F.col("source_type"), size)
    x = keep(x.withColumns({"bare": bare, "bare_s": bare_s}))
    settled = (F.col("exact") == 0) & (((F.col("bare") == "noise") & (F.col("bare_s") >= 0.85)) | (F.col("bare") == "new-settlement"))
    open_ = x.where((F.col("exact") != 1) & ~settled).select("id", "exact")
    fuzzy = fuzzy_scores(reports.join(open_.select("id"), "id", "left_semi"), v).join(open_, "id").join(exact.select("id", "entity", F.lit(True).alias("named")), ["id", "entity"], "left").where((F.col("exact") == 0) | F.col("named"))
    best = fuzzy.groupBy("id").agg(F.max_by(F.struct("entity", "score", "window"), F.struct("score", -F.col("entity"))).alias("b")).select("id", F.col("b.entity").alias("near"), F.col("b.score").alias("score"), F.col("b.window").alias("window"))
    x = x.join(best, "id", "left")
    one = F.col("exact") == 1
    two = ~one & ~settled & (F.col("score") >= C.FUZZY_MIN)
    entity = F.when(one, F.col("only")).when(two, F.col("near"))
    x = x.withColumn("entity", entity)
    category, strength = classify(F.col("entity"), F.col("unknown_place"), F.col("source_type"), size)
    geo = 0.5 + 0.3 * (F.col("score") - C.FUZZY_MIN) / (1 - C.FUZZY_MIN)
    plain = M.clamp(0.5 + 0.3 * (strength - 0.5) / 0.5, 0.35, 0.75)
    residual = ~one & ~settled & ~F.coalesce(two, F.lit(False)) & (category != "noise")
    confidence = F.when(one, M.clamp(0.9 * strength + 0.1, 0.6, 0.96)).when(settled, 0.9 * strength).when(two, M.clamp(geo * (0.6 + 0.4 * strength), 0.5, 0.8)).when(residual, 0.3).otherwise(plain)
    tier = F.when(one | settled, 1).when(residual, 3).otherwise(2)
    matched = F.when(one, F.col("only_matched")).when(settled & (category == "new-settlement"), F.col("unknown_place")).when(two, F.col("window"))
    return x.select("id", "entity", category.alias("category"), M.half_up(confidence, 3).alias("confidence"), tier.alias("tier"), matched.alias("matched_on"), *[F.slice(f"{k}_hits", 1, m).alias(f"{k}_hits") for k, m in (("hazard", 6), ("warning", 4), ("negative", 4), ("noise", 4))], F.slice(F.concat("strong_hits", "weak_hits"), 1, 6).alias("status_hits"), "unknown_place")


def shortlisted(reports: DataFrame, gazetteer_variants: DataFrame, most: int = SHORTLIST) -> DataFrame:
    """(id, candidates): the entities most like a report's windows, best first, equally good ones by id; structs of entity and score."""
    scores = fuzzy_scores(reports, gazetteer_variants, 0.0).where("score > 0")
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "entity", "score")))
    return scores.groupBy("id").agg(F.transform(F.slice(best, 1, most), lambda c: F.struct(c["entity"].alias("entity"), c["score"].alias("score"))).alias("candidates"))


def ask_outside(found: DataFrame, reports: DataFrame, gazetteer_variants: DataFrame, classifier: Callable[[dict, list], dict], calls: int = MOST_CALLS) -> tuple[DataFrame, DataFrame]:
    """(triage with the answers of an outside classifier, incidents (id, reason)) for the residual reports of ``found``.

    classifier: (report, candidates) -> category, entity, confidence, why; it is called for at most ``calls``
    reports, those of the least ids, on the driver. Unknown categories count as noise, entities that were
    not offered as none, and the confidence stays within its range. Reports beyond the limit, and those of
    a call that fails, stay residual with an incident each.
    """
    spark = found.sparkSession
    residual = found.where("tier = 3").select("id")
    asked = reports.join(residual, "id", "left_semi").orderBy("id").limit(calls)
    rows = asked.join(shortlisted(asked, gazetteer_variants), "id", "left").collect()  # at most ``calls`` rows
    answers, failed = [], []
    for r in rows:
        offered = [c["entity"] for c in r["candidates"] or []]
        try:
            out = classifier(r.asDict(), offered)
            entity = out.get("entity") if out.get("entity") in offered else None
            category = out.get("category") if out.get("category") in CATEGORIES else "noise"
            trust = min(MOST_TRUST, max(LEAST_TRUST, float(out.get("confidence") or 0.4)))
            answers.append((r["id"], entity, category, trust, f"llm:{'unresolved' if entity is None else entity}", str(out.get("why") or "")[:200]))
        except Exception as e:  # one failing call leaves its report as it is
            failed.append((r["id"], f"error: {e}"[:200]))
    a = F.broadcast(spark.createDataFrame(answers, "id bigint, a_entity bigint, a_category string, a_confidence double, a_matched string, why string"))
    x = found.join(a, "id", "left")
    new = F.col("a_category").isNotNull()
    x = x.withColumns({"entity": F.when(new, F.col("a_entity")).otherwise(F.col("entity")), "category": F.coalesce("a_category", "category"), "confidence": F.coalesce("a_confidence", "confidence"), "matched_on": F.coalesce("a_matched", "matched_on")}).select(*found.columns, "why")
    done = [r["id"] for r in rows]
    beyond = residual.where(~F.col("id").isin(done)).select("id", F.lit("budget").alias("reason"))
    said = spark.createDataFrame([(i, "classified") for i, *_ in answers] + failed, "id bigint, reason string")
    return x, said.unionByName(beyond)


def relevant_link(label: Column, url: Column, needles: list[str]) -> Column:
    """An event word or a place name occurs in a link's label or address; no least length, as headlines are short."""
    words = F.array(*[F.lit(w) for w in [*L.EVENTS, *needles]])
    return T.let(F.lower(F.concat(label, F.lit(" "), url)), lambda hay: F.exists(words, lambda w: F.contains(hay, w)))


def relevant(title: Column, text: Column, needles: list[str], least: int = 60) -> Column:
    """Long enough, and an event word or a place name occurs."""
    words = F.array(*[F.lit(w) for w in [*L.EVENTS, *needles]])
    return T.let(F.lower(F.concat(title, F.lit(" "), text)), lambda hay: (F.length(hay) >= least) & F.exists(words, lambda w: F.contains(hay, w)))

