"""Linkage kept up to date batch by batch: only new reports are compared, and only components that they touch are refined again."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tacet import config as C
from tacet.operators import graph, linkage
from tacet.sources.shared import keep, release, scratch

COLUMNS = ("id", "entity", "t", "source_type", "title", "text")
#: Tables that grow by a part a batch are written as one again when they have more parts than this.
MOST_PARTS = 16


def _whole(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _grown(parts: list[DataFrame], new: DataFrame) -> list[DataFrame]:
    """Parts and one more, which has been written."""
    parts = [*parts, new]
    return [keep(_whole(parts))] if len(parts) > MOST_PARTS else parts


@dataclass
class Linked:
    """What a linkage has to hold: reports and scored pairs in parts, and of each linked report its component and cluster."""

    report_parts: list[DataFrame]
    scored_parts: list[DataFrame]
    member: DataFrame  # v, c, cluster
    loose: bool  # whether unresolved reports have been compared with everything similar
    whole: bool = False  # whether they are, however many they become

    @property
    def reports(self) -> DataFrame:
        return _whole(self.report_parts)

    @property
    def scored(self) -> DataFrame:
        return _whole(self.scored_parts)

    @property
    def admitted(self) -> DataFrame:
        return self.scored.where(F.col("p") >= C.ADMIT).select("a", "b", "p")

    def clusters(self) -> DataFrame:
        """The same clusters as ``linkage.clusters`` of all reports; their numbers are places among all, so they move as clusters come."""
        return linkage.assembled(self.reports, keep(self.admitted), self.member.select("v", "cluster"))


def _tidy(work: Callable[..., Linked]) -> Callable[..., Linked]:
    """work, which deletes at its end what it has written besides the linkage that it returns."""

    @functools.wraps(work)
    def run(*args, **kw) -> Linked:
        with scratch() as made:
            out = work(*args, **kw)
        needed = [*out.report_parts, *out.scored_parts, out.member]
        release(out.member.sparkSession, [path for path, table in made if not any(table is x for x in needed)])
        return out

    return run


@_tidy
def begin(reports: DataFrame, edges: DataFrame, whole: bool = False) -> Linked:
    """The linkage of a first batch (id, entity, t, source_type, title, text). An id that stands there twice counts once.

    With ``whole``, here and in all batches after it, unresolved reports are compared however many they are.
    """
    new = _fresh(reports)
    loose = whole or linkage.few_unresolved(new)
    scored = keep(linkage.scored_pairs(new, edges, loose=loose, whole=whole))
    return _relinked([new], [scored], loose, whole)


def _fresh(batch: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The reports of a batch, each id once and none that is held, written. Whole reports are only moved if an id asks for it."""
    new = keep(batch.select(*COLUMNS))
    if held is not None and new.select("id").join(held.select("id"), "id", "left_semi").limit(1).count():
        new = keep(new.join(held.select("id"), "id", "left_anti"))
    if new.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        new = keep(new.dropDuplicates(["id"]))
    return new


def _relinked(reports: list[DataFrame], scored: list[DataFrame], loose: bool, whole: bool = False) -> Linked:
    admitted = keep(_whole(scored).where(F.col("p") >= C.ADMIT).select("a", "b", "p"))
    labels = keep(graph.components(admitted))
    return Linked(reports, scored, keep(labels.join(graph.refined(admitted, labels), "v").select("v", "c", "cluster")), loose, whole)


def _reached(held: DataFrame, new: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """Held reports of the time bins next to those of new ones, whose times are from low to high.

    These two bounds reach the scan, so that files and row groups of other times are passed over; texts are read of the rest.
    """
    place = F.floor(F.col("t") / linkage.WINDOW_MS)
    if low is None:
        return held.limit(0)
    bins = new.where("t is not null").select(F.explode(F.array(place - 1, place, place + 1)).alias("bin")).distinct()
    near = held.where(F.col("t").between(low - linkage.WINDOW_MS, high + linkage.WINDOW_MS))
    return near.withColumn("bin", place).join(bins, "bin", "left_semi").select(*COLUMNS)


@_tidy
def extend(held: Linked, batch: DataFrame, edges: DataFrame) -> Linked:
    """The linkage of what is held and a batch of reports together, in whichever batches they came; ``edges`` must be the same.

    Reports whose id is held already are left out, so a replayed batch changes nothing. New reports are compared with each
    other and with the held ones of the time bins next to theirs; labels are joined up over the new pairs; components that a new
    pair touches are refined again from their pairs. Of the rest only ids and probabilities are read. When unresolved
    reports become more than MAX_UNRESOLVED, the pairs that were found through them go, once, and all is labelled anew;
    in a linkage that was begun as a whole they stay.
    What is held before stays as it is; tables that only this batch's work needed are deleted.
    """
    new = _fresh(batch, held.reports)
    n, low, high = new.agg(F.count(F.lit(1)), F.min("t"), F.max("t")).first()
    if not n:
        return held
    reports = _grown(held.report_parts, new)
    loose = held.whole or linkage.few_unresolved(_whole(reports))
    near = keep(_reached(held.reports, new, low, high))
    both = near.withColumn("held", F.lit(True)).unionByName(new.withColumn("held", F.lit(False)))
    found = keep(linkage.scored_pairs(both, edges, held="held", loose=loose, whole=held.whole))
    if held.loose and not loose:
        return _relinked(reports, [keep(_whole([*held.scored_parts, found]).where("geo <> 'unknown'"))], loose)
    scored = _grown(held.scored_parts, found)
    links = keep(found.where(F.col("p") >= C.ADMIT).select("a", "b", "p"))
    if not links.limit(1).count():
        return Linked(reports, scored, held.member, loose, held.whole)
    labels = keep(graph.updated(held.member.select("v", "c"), links))
    touched = keep(labels.join(links.select(F.col("a").alias("v")).distinct(), "v", "left_semi").select("c").distinct())
    again = keep(labels.join(touched, "c", "left_semi").select("v", "c"))
    admitted = _whole(scored).where(F.col("p") >= C.ADMIT).select("a", "b", "p")
    refined = graph.refined(admitted.join(again.select(F.col("v").alias("a")), "a", "left_semi"), again)
    rest = labels.join(touched, "c", "left_anti").join(held.member.select("v", "cluster"), "v").select("v", "c", "cluster")
    return Linked(reports, scored, keep(rest.unionByName(again.join(refined, "v").select("v", "c", "cluster"))), loose, held.whole)
