"""Queries over a ledger with undecided items, and over listing pages with long labels, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tacet.functions import web
from tacet.operators import ledger
from tacet.plans import rank_queries as R
from tacet.plans import record_queries as Q
from tacet.plans import views as V


def _open(spark, d):
    """Every error event is an item; purchases and signups decide the item of the event before them, if that is one."""
    e = V.events(spark, d)
    items = e.where("event_type = 'error'").select(F.col("event_id").alias("item"), F.col("t").alias("created"), F.col("user_id").alias("entity"), F.concat(F.lit("Item "), F.col("event_id").cast("string")).alias("title"))
    by = F.when(F.col("value") < 10, F.lit(" ")).otherwise(F.concat(F.lit("person"), (F.col("user_id") % 7).cast("string")))
    tries = e.where("event_type in ('purchase', 'signup')").select(F.col("event_id").alias("seq"), (F.col("event_id") - 1).alias("item"), F.when(F.col("event_type") == "purchase", "approved").otherwise("rejected").alias("verdict"), by.alias("by"))
    return ledger.decide(items, tries)[0]


def open_items(spark, d):
    return ledger.pending_first(_open(spark, d)).select("item", "created", "title")


def open_entities(spark, d):
    return ledger.waiting_rows(R.ranked(spark, d), _open(spark, d)).select("id", "name", "rank")


def open_by_status(spark, d):
    """All three listings at once, so the ledger is folded once."""
    x = _open(spark, d).where(F.col("status").isin("pending", "approved", "rejected"))
    return x.select("status", "item", "approved_by")


def open_stats(spark, d):
    return ledger.run_stats(V.reports(spark, d), V.entities(spark, d), V.event_clusters(spark, d), _open(spark, d))


def index_links(spark, d):
    """Listing pages of fifty pages each, with their titles as labels; some pages are linked twice. Labels of 18 characters or more count."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)

    def anchor(label):
        return F.concat(F.lit('<li><a class="x" href="/page/'), F.col("page_id").cast("string"), F.lit('">'), label, F.lit("</a></li>"))

    entry = F.concat(anchor(title), F.when(F.col("page_id") % 7 == 0, anchor(F.lit("A second label for the page"))).otherwise(""))
    at = F.floor(F.col("page_id") / 50).alias("at")
    x = V.table(spark, d, "pages").groupBy(at).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))), lambda s: s["e"]), "").alias("html"))
    x = x.select("at", F.explode(web.links(F.col("html"), F.concat(F.lit("https://index"), F.col("at").cast("string"), F.lit(".example/list")))).alias("l")).select("at", "l.*")
    return x.groupBy("at", "url").agg(F.min_by("label", "pos").alias("label"))


_STATE = f"""items AS (SELECT event_id AS item, {Q._MS} AS created, user_id AS entity, 'Item ' || event_id AS title FROM events WHERE event_type = 'error'),
tries AS (SELECT event_id AS seq, event_id - 1 AS item, CASE event_type WHEN 'purchase' THEN 'approved' ELSE 'rejected' END AS verdict, CASE WHEN value < 10 THEN NULL ELSE 'person' || user_id % 7 END AS name FROM events WHERE event_type IN ('purchase', 'signup')),
won AS (SELECT item, arg_min(verdict, seq) AS verdict, arg_min(name, seq) AS name FROM tries SEMI JOIN items USING (item) WHERE name IS NOT NULL GROUP BY 1),
state AS (SELECT items.*, coalesce(verdict, 'pending') AS status, name AS approved_by FROM items LEFT JOIN won USING (item))"""
_ANCHOR = """'<li><a class="x" href="/page/' || page_id || '">' || {} || '</a></li>'"""
_LISTING = f"""WITH listing AS (SELECT page_id // 50 AS page_id, 'https://index' || page_id // 50 || '.example/list' AS url,
string_agg({_ANCHOR.format("regexp_extract(html, '(?is)<title>(.*?)</title>', 1)")} || CASE WHEN page_id % 7 = 0 THEN {_ANCHOR.format("'A second label for the page'")} ELSE '' END, '' ORDER BY page_id) AS html FROM pages GROUP BY page_id // 50), """
SQL = {
    "open_items": f"WITH {_STATE} SELECT item, created, title FROM state WHERE status = 'pending'",
    "open_entities": R._ALL + f", {_STATE} SELECT id, name, rank FROM ranked WHERE id IN (SELECT entity FROM state WHERE status = 'pending')",
    "open_by_status": f"WITH {_STATE} SELECT status, item, approved_by FROM state",
    "open_stats": f"WITH {V.SQL_REPORTS}, {V.sql_entities()}, {V.SQL_CLUSTERS}, {_STATE} SELECT (SELECT count(*) FROM reports) AS report_count, (SELECT count(*) FROM entities) AS ranked_count, (SELECT count(*) FROM clusters) AS cluster_count, (SELECT count(*) FROM state WHERE status = 'pending') AS pending_count",
    "index_links": Q._LINKS.replace("WITH ", _LISTING, 1).replace("FROM pages)", "FROM listing)") + ' SELECT page_id AS "at", url, arg_min(label, i) AS label FROM b WHERE length(label) >= 18 GROUP BY 1, 2',
}
QUERIES = {f.__name__: f for f in (open_items, open_entities, open_by_status, open_stats, index_links)}
