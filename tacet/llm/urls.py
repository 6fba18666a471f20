"""Operator 1: URL filters from a path-template tree (built-in functions only).

Given rules judge the urls that they fit, and thereby label them. The paths of every host form a tree. Where a
node branches, a segment that a few urls share stays literal; rare, variable segments become a wildcard, and so do branches
whose labels do not differ statistically from those of their siblings. A second tree of the same kind, over all hosts
together, says which templates of other hosts are of like shape. The share of blocked urls among a template's labels is
smoothed towards that of like-shaped templates on other hosts, and never towards other parts of its own host; urls that
no rule fits are blocked where it exceeds a cutoff, and allowed where too few labels speak at all. The cutoff is the one that
best separates labelled urls in branches whose labels were left out of the count for it; then all labels count again.

The trees are built on distinct urls. A round goes on to the next place where a node really branches, however
many segments that skips, and every grouping is a partial sum first, so a host with a third of all pages
costs no more than its distinct segments.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tacet.llm import kernel as K

#: Fixed values: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Urls that make a segment frequent, and labels without which a template is not judged.
LEAST, LABELS = 3, 3
Z = 1.96
WEIGHT = 2.0
#: The cutoff where left-out urls of both kinds are missing.
PURITY = 0.75
HELD_OUT, BINS = 5, 100


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones that of the longer host) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):  # later ones win
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def templates(paths: DataFrame, levels: int | None = None) -> DataFrame:
    """(tree, host, path, template) of distinct (tree, host, path, blocked, labelled); levels limits the rounds.

    A node is a template of a tree. At each place after it (pos) its urls have one segment, only rare ones, or it branches
    there (the fork): a round takes every node to its first fork and through it. Nodes of fewer than LEAST urls
    end, with ``/**`` for what is left of their paths.
    """
    segments = F.filter(F.split(F.expr("substring(path, 2)"), "/"), lambda s: F.col("path") != "")
    state = K.keep(paths.select("tree", "host", "path", "blocked", "labelled", segments.alias("rest"), F.struct("tree", F.lit("").alias("template")).alias("node")))
    none = F.array().cast("array<string>")
    sums = [F.sum(c).alias(c) for c in ("blocked", "labelled")]
    done, rounds = None, 0
    while levels is None or rounds < levels:
        rounds += 1
        kids = K.keep(state.select("node", "blocked", "labelled", F.posexplode("rest").alias("pos", "seg")).groupBy("node", "pos", "seg").agg(F.count(F.lit(1)).alias("n"), *sums))
        places = kids.groupBy("node", "pos").agg(F.count(F.lit(1)).alias("kinds"), F.max("n").alias("most"), F.min("seg").alias("seg"), *[F.sum(c).alias(f"all_{c}") for c in ("blocked", "labelled")])
        piece = F.when((F.col("kinds") == 1) & (F.col("most") >= LEAST), F.col("seg")).when(F.col("most") < LEAST, "*")  # null: it branches
        line = F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece"), "all_blocked", "all_labelled")))  # one entry for each place of a path
        nodes = places.groupBy("node").agg(line.alias("line")).withColumn("fork", F.get(F.filter("line", lambda x: x["piece"].isNull()), F.lit(0)))
        nodes = state.groupBy("node").agg(F.count(F.lit(1)).alias("urls")).join(nodes, "node", "left")
        nodes = nodes.select("node", "urls", (F.col("urls") >= LEAST).alias("grown"), F.col("fork.pos").alias("fork"), F.col("fork.all_blocked").alias("all_blocked"), F.col("fork.all_labelled").alias("all_labelled"), F.coalesce(F.transform("line", lambda x: x["piece"]), none).alias("pieces"))
        nodes = K.keep(nodes)
        at = kids.join(nodes.where("grown and fork is not null").select("node", F.col("fork").alias("pos"), "all_blocked", "all_labelled"), ["node", "pos"])
        left = F.col("all_labelled") - F.col("labelled")
        own, other = F.col("blocked") / F.greatest("labelled", F.lit(1)), (F.col("all_blocked") - F.col("blocked")) / F.greatest(left, F.lit(1))
        mid = (F.col("all_blocked") + 1) / (F.col("all_labelled") + 2)
        score = F.abs(own - other) / F.sqrt(mid * (1 - mid) * (1 / F.greatest("labelled", F.lit(1)) + 1 / F.greatest(left, F.lit(1))))
        similar = (F.col("labelled") > 0) & (left > 0) & (score < Z)
        literal = K.keep(at.where((F.col("n") >= LEAST) & ~similar).select(F.struct("node", "seg").alias("key"), "n", F.lit(True).alias("literal")))
        x = K.lookup(state, nodes.drop("all_blocked", "all_labelled"), "node", "urls")
        skipped = F.when(~F.col("grown"), 0).otherwise(F.least(F.size("rest"), F.coalesce("fork", F.size("rest"))))
        x = x.withColumn("name", F.concat("node.template", F.array_join(F.transform(F.slice("pieces", F.lit(1), skipped), lambda p: F.concat(F.lit("/"), p)), "")))
        x = x.withColumn("seg", F.when(F.col("grown") & (F.size("rest") > F.col("fork")), F.get("rest", F.col("fork"))))
        x = K.lookup(x.withColumn("key", F.struct("node", "seg")), literal, "key", "n")
        name = F.when(F.col("seg").isNull(), F.col("name")).otherwise(F.concat("name", F.lit("/"), F.when(F.col("literal"), F.col("seg")).otherwise("*")))
        tail = F.when(~F.col("grown") & (F.size("rest") > 0), "/**").otherwise("")
        rest = F.when(F.col("seg").isNull(), none).otherwise(F.slice("rest", F.col("fork") + 2, F.size("rest")))
        x = K.keep(x.select("tree", "host", "path", "blocked", "labelled", rest.alias("rest"), F.struct("tree", F.concat(name, tail).alias("template")).alias("node")))
        ended = x.where(F.size("rest") == 0).select("tree", "host", "path", "node.template")
        done = ended if done is None else done.unionByName(ended)
        state = x.where(F.size("rest") > 0)
        if not state.limit(1).count():
            return done
    cut = state.select("tree", "host", "path", F.concat("node.template", F.when(F.size("rest") > 0, "/**").otherwise("")).alias("template"))
    return cut if done is None else done.unionByName(cut)


def purities(groups: DataFrame, blocked: str, labelled: str, name: str) -> DataFrame:
    """groups (host, template, shape, ...) with the purity by the labels counted in the named columns; null where too few speak.

    A template has its own labels, and those of its shape on other hosts: the share of the latter weighs as WEIGHT labels.
    """
    sums = [F.sum(blocked).alias("b"), F.sum(labelled).alias("l")]
    mine = groups.groupBy("host", "template").agg(*sums)
    here = groups.groupBy("host", "shape").agg(*[F.sum(c).alias(f"here_{k}") for c, k in ((blocked, "b"), (labelled, "l"))])
    everywhere = groups.groupBy("shape").agg(*[F.sum(c).alias(f"all_{k}") for c, k in ((blocked, "b"), (labelled, "l"))])
    x = groups.join(mine, ["host", "template"]).join(here, ["host", "shape"]).join(everywhere, "shape")
    other = F.col("all_l") - F.col("here_l")
    share = (F.col("all_b") - F.col("here_b") + 1) / (other + 2)
    purity = F.when(F.col("l") + other >= LABELS, (F.col("b") + WEIGHT * share) / (F.col("l") + WEIGHT))
    return x.select(*groups.columns, purity.alias(name))


def best_cutoff(counts: dict[int, tuple[int, int]], default: float) -> float:
    """Of held-out urls per bin of purity (blocked, allowed) the cutoff with the highest mean of both hit rates.

    Of equally good ones the middle of the longest run of bins.
    """
    bad, good = (sum(c[k] for c in counts.values()) for k in (0, 1))
    if not bad or not good:
        return default
    above, below, scores = bad, 0, []
    for i in range(BINS + 1):  # blocked above bin i
        b, g = counts.get(i, (0, 0))
        above, below = above - b, below + g
        scores.append(above * good + below * bad)
    best, run, longest = max(scores), [], []
    for i, x in enumerate([*scores, -1]):
        if x == best:
            run.append(i)
        else:
            longest = run if len(run) > len(longest) else longest
            run = []
    return (longest[len(longest) // 2] + 1) / BINS


def judge_urls(pages: DataFrame, rules=RULES, *, levels: int | None = None, purity: float | None = None) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, template, shape, purity.

    Urls that are null or without ``://`` have an empty host and path. Repeated rows and urls that differ
    behind the path count once. ``levels`` limits the branching places of a path, and what is below is one tail.
    ``purity`` is the cutoff; without it, it is calibrated. Templates with fewer than LABELS labels, like-shaped
    ones on other hosts included, have no purity and are allowed. Extra columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    x = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    x = x.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("given"))
    # a branch is left out whole, as the urls that no rule fits lie in branches without labels
    out = F.pmod(F.xxhash64("host", F.get(F.split("path", "/"), F.lit(1))), F.lit(HELD_OUT)) == 0
    urls = x.groupBy("host", "path").agg(F.count(F.lit(1)).alias("rows"), F.max((F.col("given") == "block").cast("int")).alias("bad")).withColumn("out", out)
    urls = urls.withColumns({"labelled": F.when(F.col("bad").isNotNull(), 1).otherwise(0), "blocked": F.coalesce("bad", F.lit(0))})
    urls = K.keep(urls.withColumns({f"seen_{c}": F.when(F.col("out"), 0).otherwise(F.col(c)) for c in ("labelled", "blocked")}))
    trees = F.explode(F.array(F.concat(F.lit("of "), F.col("host")), F.lit("all"))).alias("tree")
    named = K.keep(templates(urls.select(trees, "host", "path", "blocked", "labelled"), levels))
    both = named.groupBy("host", "path").agg(*[F.max(F.when((F.col("tree") == "all") == whole, F.col("template"))).alias(c) for c, whole in (("template", False), ("shape", True))])
    urls = K.keep(urls.join(both, ["host", "path"]))
    counted = ("blocked", "labelled", "seen_blocked", "seen_labelled")
    held = [F.count_if(F.col("out") & (F.col("labelled") > 0) & (F.col("blocked") == k)).alias(c) for k, c in ((1, "bad"), (0, "good"))]
    groups = K.keep(urls.groupBy("host", "template", "shape").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in counted], *held))
    if purity is None:
        seen = purities(groups, "seen_blocked", "seen_labelled", "purity").where("purity is not null and bad + good > 0")
        bins = seen.groupBy(F.floor(F.col("purity") * BINS).cast("int").alias("bin")).agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        purity = best_cutoff({r["bin"]: (r["bad"], r["good"]) for r in bins.collect()}, PURITY)  # at most BINS + 1 rows
    judged = purities(groups, "blocked", "labelled", "purity").select(F.struct("host", "template", "shape").alias("group"), "n", "purity")
    known = K.lookup(urls.withColumn("group", F.struct("host", "template", "shape")), K.keep(judged), "group", "n")
    known = K.keep(known.select(F.struct("host", "path").alias("url"), "template", "shape", "purity", "rows"))
    verdict = F.coalesce("given", F.when(F.col("purity") > purity, "block").otherwise("allow"))
    x = K.lookup(x.withColumn("url", F.struct("host", "path")), known, "url", "rows")
    return x.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "shape", "purity")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return judge_urls(K.read(spark, sf_dir, "pages"))


QUERIES = {"op1_url_filters": op1_url_filters}
SQL: dict[str, str] = {}
