"""Append-only records: the decision ledger, the incident log, shortlists, drill-downs, run statistics.

Nothing is updated in place. A decision's state is a fold over the log of attempts; the first valid
attempt of a named person stands for ever.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacet import config as C
from tacet.functions import maths as M
from tacet.functions import web
from tacet.sources import commits

#: Keys that evidence must not carry, lower-cased.
FORBIDDEN = ["dispatch", "dispatchto", "dispatchedto", "assignto", "assignedto", "assignment", "sendteam", "deployto", "deployment", "responderassignment", "orders", "tasking"]
DEEPEST = 6


def forbidden_fields(schema: T.DataType, path: str = "evidence", depth: int = 0) -> list[str]:
    """Paths of forbidden keys of typed evidence, down to DEEPEST levels."""
    if depth > DEEPEST:
        return []
    if isinstance(schema, T.ArrayType):
        return forbidden_fields(schema.elementType, f"{path}[]", depth + 1)
    if isinstance(schema, T.MapType):
        return forbidden_fields(schema.valueType, f"{path}.*", depth + 1)
    out = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            out += [f"{path}.{f.name}"] * (f.name.lower() in FORBIDDEN) + forbidden_fields(f.dataType, f"{path}.{f.name}", depth + 1)
    return out


def _walked(variant: Column, found: Callable[[Column], Column], kind: str) -> Column:
    """What ``found`` makes of the objects (array of map<string,variant>) at each level of a variant, down to DEEPEST, level by level.

    All inside the JVM: the state of the fold is what was found and the values of the next level.
    """
    none = F.array().cast("array<variant>")

    def step(state: Column, _: Column) -> Column:
        objects = F.transform(state["nodes"], lambda v: F.try_variant_get(v, "$", "map<string,variant>"))
        below = F.transform(state["nodes"], lambda v: F.coalesce(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), F.try_variant_get(v, "$", "array<variant>"), none))
        return F.struct(F.concat(state["found"], found(F.filter(objects, lambda m: m.isNotNull()))).alias("found"), F.flatten(below).alias("nodes"))

    start = F.struct(F.array().cast(kind).alias("found"), F.filter(F.array(variant), lambda v: v.isNotNull()).alias("nodes"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(DEEPEST)), start, step, lambda state: state["found"])


def carries_forbidden(evidence: Column) -> Column:
    """Whether JSON evidence has a forbidden key within DEEPEST levels.

    Texts that are no JSON have no keys; what begins like an object or a list and cannot be read (also because a key
    is there twice) is taken to carry one.
    """
    variant = F.try_parse_json(evidence)
    keys = _walked(variant, lambda objects: F.flatten(F.transform(objects, lambda m: F.transform(F.map_keys(m), F.lower))), "array<string>")
    unread = variant.isNull() & F.coalesce(F.rlike(evidence, F.lit(r"^\s*[{\[]")), F.lit(False))
    return unread | F.arrays_overlap(keys, F.array(*map(F.lit, FORBIDDEN)))


def named_entities(evidence: Column) -> Column:
    """Every text under a key that ends in entityid or settlementid, in JSON evidence, within DEEPEST levels; once each, upper levels first."""

    def named(m: Column) -> Column:
        fits = F.filter(F.map_entries(m), lambda e: F.rlike(e["key"], F.lit("(?i)(entityid|settlementid)$")) & (F.schema_of_variant(e["value"]) == "STRING"))
        return F.transform(fits, lambda e: F.try_variant_get(e["value"], "$", "string"))

    texts = _walked(F.try_parse_json(evidence), lambda objects: F.flatten(F.transform(objects, named)), "array<string>")
    return F.array_distinct(F.filter(texts, lambda t: t != ""))


def approver(x: Column) -> Column:
    """The name without blanks around it; null if there is none."""
    return F.nullif(F.trim(x), F.lit(""))


def new_escalations(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Candidates (entity, title, evidence) that were never raised before, decided or not."""
    ok = candidates.where(~carries_forbidden(F.col("evidence")))
    return ok.dropDuplicates(["entity"]).join(ledger.where("kind = 'escalation'").select("entity"), "entity", "left_anti")


def fingerprint(a: Column, b: Column) -> Column:
    return F.concat_ws("::", F.array_sort(F.array(a.cast("string"), b.cast("string"))))


def new_ambiguous(pairs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Pairs (a, b) that were never raised before in either direction."""
    x = pairs.withColumn("fingerprint", fingerprint(F.col("a"), F.col("b"))).dropDuplicates(["fingerprint"])
    return x.join(ledger.where("kind = 'ambiguous-match'").select("fingerprint"), "fingerprint", "left_anti")


def decide(items: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with status, approved_by, decided_seq; attempts with code).

    attempts: seq, item, verdict (approved or rejected), by. Codes: 400 without a name, 404 without
    such an item, 409 once decided, else 200.
    """
    a = attempts.withColumn("name", approver(F.col("by"))).join(items.select(F.col("item").alias("known")).distinct(), F.col("item") == F.col("known"), "left")
    valid = F.col("name").isNotNull() & F.col("known").isNotNull()
    first = a.where(valid).groupBy("item").agg(F.min(F.struct("seq", "verdict", "name")).alias("d"))
    a = a.join(first.select("item", F.col("d.seq").alias("won")), "item", "left")
    code = F.when(F.col("name").isNull(), 400).when(F.col("known").isNull(), 404).when(F.col("seq") > F.col("won"), 409).otherwise(200)
    state = items.join(first, "item", "left").select(*items.columns, F.coalesce("d.verdict", F.lit("pending")).alias("status"), F.col("d.name").alias("approved_by"), F.col("d.seq").alias("decided_seq"))
    return state, a.select("seq", "item", "verdict", "by", code.alias("code"))


def heals(items: DataFrame, decided: DataFrame) -> DataFrame:
    """An incident (seq, item, kind, message) for each decision: items (item, title), decided (item, status, approved_by, decided_seq)."""
    done = decided.where("status <> 'pending'").select("item", "status", "approved_by", F.col("decided_seq").alias("seq"))
    verb = F.when(F.col("status") == "approved", "Approved").otherwise("Rejected")
    return done.join(items.select("item", "title"), "item").select("seq", "item", F.lit("heal").alias("kind"), F.concat(verb, F.lit(" by "), "approved_by", F.lit(": "), "title").alias("message"))


def listed(decided: DataFrame, status: str | None = None) -> DataFrame:
    """Items of a status, or all of them."""
    return decided if status is None else decided.where(F.col("status") == status)


def pending_first(decided: DataFrame) -> DataFrame:
    """What waits for a person, newest first (created), ties by item."""
    return listed(decided, "pending").orderBy(F.desc("created"), "item")


def last_decided(decided: DataFrame, first: int = 5) -> DataFrame:
    """The latest decisions."""
    return decided.where("status <> 'pending'").orderBy(F.desc("decided_seq"), "item").limit(first)


def waiting_rows(ranked: DataFrame, decided: DataFrame) -> DataFrame:
    """The ranked rows of the entities that a pending item is about, once each."""
    ids = listed(decided, "pending").where("entity is not null").select(F.col("entity").alias("id")).distinct()
    return ranked.join(ids, "id", "left_semi")


def shortlist(scope: DataFrame, entities: DataFrame) -> DataFrame:
    """Whom to inform: a row per district in scope (all of them if none is), in alphabetical order and no other.

    scope: item, entity (null if unresolved). entities: id, district, population.
    """
    x = scope.join(entities.select(F.col("id").alias("entity"), "district"), "entity", "left")
    per = x.groupBy("item").agg(F.collect_set("district").alias("found"), F.collect_set("entity").alias("ids"))
    d = entities.groupBy("district").agg(F.count(F.lit(1)).alias("entities_in_district"), F.sum("population").alias("population_in_district"), F.collect_list("id").alias("members"))
    some = per.where(F.size("found") > 0).select("item", "ids", F.explode("found").alias("district")).join(d, "district")
    none = per.where(F.size("found") == 0).select("item", "ids").join(d)
    y = some.select("item", "ids", *d.columns).unionByName(none.select("item", "ids", *d.columns))
    return y.select("item", F.concat(F.lit("district-"), web.slug(F.col("district"))).alias("jurisdiction"), "district", "entities_in_district", F.array_sort(F.array_intersect("members", "ids")).alias("in_scope"), "population_in_district").orderBy("item", "district")


def append_incidents(path: str, new: DataFrame, batch: str) -> bool:
    """Appends incidents (at, kind, message) to the log at path as one commit, with running numbers (seq) that go on from its last one.

    Rows are numbered by time, then kind and message. A batch that is there already changes nothing, and a second writer
    neither doubles nor renumbers; False tells that it was there.
    """
    return commits.commit(new.sparkSession, path, batch, lambda _: new.select("at", "kind", "message"), ["at", "kind", "message"])


def incident_log(spark: SparkSession, path: str) -> DataFrame:
    """The incidents (at, kind, message, seq) appended to the log at path."""
    have = commits.table(spark, path)
    return spark.createDataFrame([], "at bigint, kind string, message string, seq bigint") if have is None else have


def incident_feed(incidents: DataFrame, cap: int = C.INCIDENT_CAP) -> DataFrame:
    """Newest first, the last ``cap`` of them; ties by the running number."""
    return incidents.orderBy(F.desc("at"), F.desc("seq")).limit(cap)


def feed(server: DataFrame, client: DataFrame, mode: str = "all", cap: int = 80) -> DataFrame:
    """Both logs with their provenance, filtered and cut. mode: all, incidents, decisions or pipeline."""
    x = server.withColumn("provenance", F.lit("server")).unionByName(client.withColumn("provenance", F.lit("local")), allowMissingColumns=True)
    keep = {"all": F.lit(True), "incidents": (F.col("provenance") == "server") & (F.col("kind") != "heal"), "decisions": F.rlike(F.coalesce("message", F.lit("")), F.lit("(?i)approved by|rejected by")), "pipeline": (F.col("provenance") == "local") | (F.col("kind") == "degraded-source")}[mode]
    return x.where(keep).orderBy(F.desc("at"), F.desc("seq")).limit(cap)


def cold_start_incidents(ranked: DataFrame, first: int = 3) -> DataFrame:
    """An incident for each of the first entities that no report ever named."""
    x = ranked.where("coverage_basis = 'cohort-cold-start'").orderBy("id").limit(first)
    return x.select(F.lit("cold-start").alias("kind"), "id", F.concat(F.lit("No report has ever named "), "name", F.lit(". Its baseline is that of cohort "), "cohort").alias("message"))


def failed_stages(incidents: DataFrame, runs: DataFrame, slack_ms: int = 2000) -> DataFrame:
    """(run, stage): stages that an incident of a degraded source names within a run. runs: run, last_at, duration_ms.

    No run meets its incidents one by one. A run's time is cut at a multiple of a power of two so that it is the end of one bin
    and the beginning of the next one, both of that power's length. It has an incident of a stage if the last one of the first bin
    is not before the run, or the first one of the second bin not after it. So each run looks at two bins, and an
    incident is counted once for every length that occurs, at most some sixty and in practice a dozen.
    """
    r = runs.select("run", (F.col("last_at") - F.col("duration_ms") - slack_ms).alias("low"), (F.col("last_at") + slack_ms).alias("high")).where("low <= high")
    differ = F.length(F.bin(F.col("low").bitwiseXOR(F.col("high")))) - 1  # the highest bit in which both ends differ
    r = r.withColumn("level", F.least(differ, F.length(F.bin(F.col("high") - F.col("low"))))).withColumn("bin", F.expr("shiftright(high, level)"))
    levels = F.broadcast(r.select("level").distinct())  # at most 64 rows
    x = incidents.where("kind = 'degraded-source' and stage is not null and at is not null").select("stage", "at").crossJoin(levels)
    x = x.groupBy("level", F.expr("shiftright(at, level)").alias("bin"), "stage").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    sides = F.explode(F.array(F.struct((F.col("bin") - 1).alias("bin"), F.lit(True).alias("early")), F.struct("bin", F.lit(False).alias("early"))))
    looks = r.select("run", "level", "low", "high", sides.alias("s")).select("run", "level", "low", "high", "s.*")
    hit = F.when(F.col("early"), (F.col("last") >= F.col("low")) & (F.col("last") <= F.col("high"))).otherwise((F.col("first") <= F.col("high")) & (F.col("first") >= F.col("low")))
    return looks.join(x, ["level", "bin"]).where(hit).select("run", "stage").distinct()


def source_failure(current: DataFrame, reports: DataFrame) -> DataFrame:
    """A demonstration: the first live source, else the first one, counts as degraded: one row (name, source_type, previous_status, status, contributed)."""
    target = current.orderBy(F.when(F.col("status") == "live", 0).otherwise(1), "name").limit(1)
    per = reports.groupBy(F.col("source_name").alias("name")).agg(F.count(F.lit(1)).alias("contributed"))
    return target.join(per, "name", "left").select("name", "source_type", F.col("status").alias("previous_status"), F.lit("degraded").alias("status"), F.coalesce("contributed", F.lit(0)).alias("contributed"))


def self_heals(failures: DataFrame, now_ms: int, after_ms: int = 20_000) -> DataFrame:
    """Simulated failures (name, at, previous_status) whose time is up by ``now_ms``: the incident of their recovery and the status restored."""
    due = failures.where(F.col("at") + after_ms <= now_ms)
    return due.select("name", (F.col("at") + after_ms).alias("at"), F.lit("heal").alias("kind"), F.coalesce("previous_status", F.lit("ok")).alias("status"), F.concat(F.lit('Connector "'), "name", F.lit('" recovered - coverage restored')).alias("message"))


def cold_start_shown(ranked: DataFrame) -> DataFrame:
    """A demonstration: the first ranked entity with reports, else the first, is shown as one without: one row (id, message)."""
    x = ranked.orderBy(F.when(F.col("coverage_basis") != "cohort-cold-start", 0).otherwise(1), "rank").limit(1)
    return x.select("id", F.lit("cohort-cold-start").alias("coverage_basis"), F.concat("name", F.lit(" has no report history - scored from its hazard-tier cohort baseline, not its own data")).alias("message"))


def changes(states: DataFrame, key: str) -> DataFrame:
    """Polled states (key, at, value) that differ from the one before of the same key."""
    last = F.lag("value").over(W.partitionBy(key).orderBy("at"))
    return states.withColumn("before", last).where(F.col("before").isNull() | (F.col("before") != F.col("value"))).drop("before")


def entity_detail(entity, ranked: DataFrame, reports: DataFrame, clusters: DataFrame, edges: DataFrame, ledger: DataFrame) -> dict[str, DataFrame]:
    """What is known about one entity; an empty row table means that there is no such entity."""
    own = reports.where(F.col("entity") == entity)
    part = clusters.where((F.col("entity") == entity)).select("cluster_id").unionByName(clusters.select("cluster_id", F.explode("report_ids").alias("id")).join(own.select("id"), "id", "left_semi").select("cluster_id")).distinct()
    row = ranked.where(F.col("id") == entity)
    near = edges.where(F.col("src") == entity).select(F.col("dst").alias("id"))
    return {"row": row, "reports": own, "clusters": clusters.join(part, "cluster_id", "left_semi"), "neighbours": ranked.join(near, "id", "left_semi"), "ledger": ledger.where(F.col("entity") == entity)}


def entity_overview(ranked: DataFrame, reports: DataFrame, clusters: DataFrame, edges: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per entity what its page shows, as counts: reports, clusters (own ones and those of its reports), neighbours, items of the ledger."""
    def per(x, key, name):
        return x.where(f"{key} is not null").groupBy(F.col(key).alias("id")).agg(F.count(F.lit(1)).alias(name))

    member = clusters.select("cluster_id", F.explode("report_ids").alias("r")).join(reports.select(F.col("id").alias("r"), "entity"), "r").select("entity", "cluster_id")
    part = clusters.select("entity", "cluster_id").unionByName(member).distinct()
    out = ranked.select("id", "name")
    for x in (per(reports, "entity", "reports"), per(part, "entity", "clusters"), per(edges, "src", "neighbours"), per(ledger, "entity", "items")):
        out = out.join(x, "id", "left")
    return out.fillna(0, ["reports", "clusters", "neighbours", "items"])


def run_stats(reports: DataFrame, ranked: DataFrame, clusters: DataFrame, decided: DataFrame) -> DataFrame:
    """One row of counts: reports, ranked entities, clusters, and items that wait for a person."""
    def count(x, name):
        return x.agg(F.count(F.lit(1)).alias(name))

    rows = [count(reports, "report_count"), count(ranked, "ranked_count"), count(clusters, "cluster_count"), count(listed(decided, "pending"), "pending_count")]
    out = rows[0]
    for r in rows[1:]:
        out = out.join(F.broadcast(r))  # one row each
    return out


def reports_of_sources(reports: DataFrame) -> DataFrame:
    """(name, source_type, contributed): what each publisher has contributed."""
    return reports.groupBy(F.col("source_name").alias("name")).agg(F.min("source_type").alias("source_type"), F.count(F.lit(1)).alias("contributed"))


def pair_label(label: Column, title: Column, name: Column, fallback: str) -> Column:
    """A given label, else a title cut to 70 characters, else an id, else a fallback."""
    t = F.nullif(F.trim(title), F.lit(""))
    short = F.when(F.length(t) > 70, F.concat(F.substring(t, 1, 69), F.lit("\u2026"))).otherwise(t)
    return F.coalesce(F.nullif(F.trim(label), F.lit("")), short, F.nullif(F.trim(name), F.lit("")), F.lit(fallback))


def describe_pair(a: Column, b: Column, p: Column) -> Column:
    """The title of an ambiguous match, of two labels and a probability."""
    share = F.when(p.isNotNull() & ~F.isnan(p), F.concat(F.lit(" (match p="), number(p, 2), F.lit(")"))).otherwise("")
    return F.concat(F.lit("Ambiguous match: "), a, F.lit(" vs "), b, share)


def number(x: Column, digits: int = 1) -> Column:
    """Rounded, without trailing zeros; what is not finite counts as 0."""
    return F.regexp_replace(M.half_up(F.coalesce(x, F.lit(0.0)), digits).cast("string"), r"\.0$", "")


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))


def fixed(x: Column, digits: int) -> Column:
    """With so many decimals, rounded half up."""
    return F.format_string(f"%.{digits}f", M.half_up(x.cast("double"), digits))


def number_text(x: Column, digits: int = 2) -> Column:
    return F.when(_missing(x), "\u2014").otherwise(fixed(x, digits))


def integer_text(x: Column) -> Column:
    """In groups of three digits."""
    return F.when(_missing(x), "\u2014").otherwise(F.format_number(x.cast("bigint"), 0))


def count_text(x: Column) -> Column:
    """Plain digits; 0 stays 0."""
    return F.when(_missing(x), "\u2014").otherwise(x.cast("bigint").cast("string"))


def rate_text(x: Column) -> Column:
    """Events per hour: five decimals, or a power of ten below a thousandth."""
    small = F.regexp_replace(F.format_string("%.3e", x.cast("double")), r"e([+-])0*(\d)", "e$1$2")
    return F.when(_missing(x), "\u2014").otherwise(F.concat(F.when(x < 0.001, small).otherwise(fixed(x, 5)), F.lit(" /h")))


def hours_text(x: Column) -> Column:
    """96.0h, or 120h from a hundred hours on."""
    return F.when(_missing(x), "\u2014").when(x >= 100, F.concat(F.floor(x + 0.5).cast("string"), F.lit("h"))).otherwise(F.concat(fixed(x, 1), F.lit("h")))


def signed_text(x: Column, digits: int = 2) -> Column:
    return F.when(_missing(x), "\u2014").otherwise(F.concat(F.when(x < 0, "\u2212").otherwise("+"), fixed(F.abs(x), digits)))


def relative_text(then_ms: Column, now_ms: Column) -> Column:
    s = F.floor((now_ms - then_ms) / 1000 + 0.5)
    unit = lambda n, u: F.concat(n.cast("string"), F.lit(u))
    m = F.floor(s / 60 + 0.5)
    return F.when(s < 0, "just now").when(s < 45, unit(s, "s ago")).when(m < 60, unit(m, " min ago")).when(s < 48 * 3600, unit(F.floor(s / 3600), "h ago")).otherwise(unit(F.floor(s / 86400), "d ago"))


def state_rows(ranked: DataFrame, decided: DataFrame, incidents: DataFrame, sources: DataFrame) -> DataFrame:
    """(part, id, json): the whole state for an API, a row per entity, ledger item, incident and source."""
    parts = [("entities", ranked, "id"), ("ledger", decided, "item"), ("incidents", incidents, "seq"), ("sources", sources, "name")]
    out = None
    for name, x, key in parts:
        one = x.select(F.lit(name).alias("part"), F.col(key).cast("string").alias("id"), F.to_json(F.struct(*x.columns)).alias("json"))
        out = one if out is None else out.unionByName(one)
    return out
