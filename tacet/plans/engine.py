"""One batch pass over reports, and what an application reads from it.

Stages are isolated: one that fails leaves an incident and its input, and the pass goes on. A pass over new reports alone takes
the linkage of the pass before.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacet import config as C
from tacet.operators import increments, ledger, linkage, ranking, triage
from tacet.sources.shared import keep

ITEMS = "item string, kind string, entity bigint, fingerprint string, title string, evidence string"


@dataclass
class Pass:
    """Results of a pass; tables are DataFrames, incidents plain rows (kind, stage, message)."""

    reports: DataFrame
    scored: DataFrame | None = None
    clusters: DataFrame | None = None
    ranked: DataFrame | None = None
    new_items: DataFrame | None = None
    linked: increments.Linked | None = None
    incidents: list[tuple[str, str, str]] = field(default_factory=list)
    duration_ms: int = 0


def run(reports: DataFrame, entities: DataFrame, edges: DataFrame, held: DataFrame | None = None, gazetteer: DataFrame | None = None, now: int = C.NOW_MS, classifier: Callable[[dict, list], dict] | None = None, before: increments.Linked | None = None) -> Pass:
    """Triage (with a gazetteer), linkage, ranking and new items for the ledger ``held``.

    reports: id, entity, t, source_type, title, text. With a gazetteer its triage sets the entity.
    classifier: asked about residual reports, within the limits of ``triage.ask_outside``; those that it leaves are incidents.
    before: the linkage of the pass before, to which ``reports`` come; ranking is over all, and ``linked`` is for the next pass.
    If linkage fails, ranking sees the new reports and ``linked`` stays as it was.
    """
    began, out = time.monotonic(), Pass(reports, linked=before)

    def stage(name: str, work: Callable[[], None]) -> None:
        try:
            work()
        except Exception as e:  # the pass goes on with what it has
            out.incidents.append(("degraded-source", name, f"{type(e).__name__}: {e}"[:300]))

    def do_triage() -> None:
        found = keep(triage.triage(out.reports, gazetteer).select("id", "entity", "category", "confidence", "tier", "matched_on"))
        if classifier is not None:
            found, said = triage.ask_outside(found, out.reports.drop("entity"), keep(triage.variants(gazetteer)), classifier)
            by = said.where("reason <> 'classified'").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason")
            left = by.limit(triage.MOST_CALLS + 1).collect()  # a reason for each call, and one for those beyond
            out.incidents += [("llm-fallback", "triage", f"{r['n']} reports were not classified: {r['reason']}") for r in left]
            found = keep(found)
        out.reports = keep(out.reports.drop("entity").join(found, "id", "left"))
        n = 0 if classifier is not None else out.reports.where("tier = 3").count()
        if n:
            out.incidents.append(("llm-fallback", "triage", f"{n} reports need an outside classifier"))

    def do_linkage() -> None:
        if before is not None:
            linked = increments.extend(before, out.reports, edges)
            scored, clusters = linked.scored, keep(linked.clusters())
            out.linked, out.scored, out.clusters, out.reports = linked, scored, clusters, linked.reports
            return
        out.scored = keep(linkage.scored_pairs(out.reports, edges))
        out.clusters = keep(linkage.clusters(out.reports, out.scored))

    def do_rank() -> None:
        out.ranked = keep(ranking.rank(entities, out.reports, edges, now, out.clusters))
        out.incidents += [(r["kind"], "rank", r["message"]) for r in ledger.cold_start_incidents(out.ranked).collect()]

    def do_items() -> None:
        have = held if held is not None else out.reports.sparkSession.createDataFrame([], ITEMS)
        top = ranking.escalations(out.ranked).select(F.col("id").alias("entity"), "title", F.to_json(F.struct("silence_hours", "surprisal", "own_z")).alias("evidence"))
        one = ledger.new_escalations(top, have).select(F.concat(F.lit("e-"), F.col("entity").cast("string")).alias("item"), F.lit("escalation").alias("kind"), "entity", F.lit(None).cast("string").alias("fingerprint"), "title", "evidence")
        items = one
        if out.scored is not None:
            two = ledger.new_ambiguous(linkage.ambiguous(out.scored, C.TOP_AMBIGUOUS), have)
            items = one.unionByName(two.select(F.concat(F.lit("m-"), "fingerprint").alias("item"), F.lit("ambiguous-match").alias("kind"), F.lit(None).cast("bigint").alias("entity"), "fingerprint", ledger.describe_pair(F.col("a").cast("string"), F.col("b").cast("string"), F.col("p")).alias("title"), F.to_json(F.struct("a", "b", "p")).alias("evidence")))
        out.new_items = keep(items)

    if gazetteer is not None:
        stage("triage", do_triage)
    stage("linkage", do_linkage)
    stage("rank", do_rank)
    if out.ranked is not None:
        stage("ledger", do_items)
    out.duration_ms = int((time.monotonic() - began) * 1000)
    return out


def stats(done: Pass, decided: DataFrame) -> DataFrame:
    """Counts of a pass; decided: items of the ledger with their status."""
    none = done.reports.limit(0)
    return ledger.run_stats(done.reports, none if done.ranked is None else done.ranked, none if done.clusters is None else done.clusters, decided)
