"""Queries over pages, ledgers, feeds and streams, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tacet import config as C
from tacet.functions import maths as M
from tacet.functions import web
from tacet.operators import ledger
from tacet.plans import rank_queries as R
from tacet.plans import views as V
from tacet.sources import reports as S
from tacet.streaming import cadence as stream


def _pages(spark, d):
    return V.table(spark, d, "pages")


def page_title(spark, d):
    return _pages(spark, d).select("page_id", web.title(F.col("html")).alias("title"))


def page_body(spark, d):
    return _pages(spark, d).select("page_id", F.md5(web.body(F.col("html"))).alias("digest"), F.length(web.body(F.col("html"))).alias("n"))


def page_links(spark, d):
    x = _pages(spark, d).select("page_id", F.explode(web.links(F.col("html"), F.col("url"), 4)).alias("l")).select("page_id", "l.*")
    return x.groupBy("page_id", "url").agg(F.min_by("label", "pos").alias("label"))


def listing_articles(spark, d):
    """Of pages with the same address the first with an anchor counts, by page_id."""
    x = _pages(spark, d).where(F.rlike("html", F.lit(web.ANCHOR)))
    x = x.select(F.col("url").alias("target"), "page_id", F.array_distinct(F.transform(web.links(F.col("html"), F.col("url"), 2), lambda r: r["url"])).alias("urls"))
    y = x.groupBy("target").agg(F.min_by("urls", "page_id").alias("urls"))
    return y.select("target", F.size("urls").cast("bigint").alias("links")).where("links > 0")


def page_reports(spark, d):
    return S.from_pages(_pages(spark, d), "news", C.NOW_MS).select("id", "source_name", "title", "time_imputed")


def report_ids(spark, d):
    return _pages(spark, d).select("page_id", web.report_id(F.col("url")).alias("id"), web.slug(F.col("url")).alias("slug"), web.citable(F.col("url")).alias("citable"))


def publisher(spark, d):
    return _pages(spark, d).groupBy(web.publisher(F.col("url")).alias("publisher")).agg(F.count(F.lit(1)).alias("n"))


def _log(spark, d):
    status = F.when(F.col("value") < 5, "degraded").when(F.col("value") < 10, "ok").otherwise("live")
    return V.events(spark, d).select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("name"), V.source_type().alias("source_type"), status.alias("status"), (F.col("t") * 1000 + F.col("event_id") % 1000).alias("at"))


def source_health(spark, d):
    return S.health(_log(spark, d)).select("name", "status", "last_at").orderBy("name")


def source_summary(spark, d):
    return S.health_summary(S.health(_log(spark, d)))


def reanchored(spark, d):
    x = V.events(spark, d).select("event_id", F.col("t").alias("published_ms"), (F.col("t") + 60_000).alias("fetched_ms"))
    return S.reanchor(x, C.NOW_MS + 7 * 24 * C.HOUR_MS)


def distinct_reports(spark, d):
    x = V.events(spark, d).select(F.col("user_id").alias("id"), F.struct("t", "event_id").alias("order"), "event_id", "t")
    return S.first_of_each(x, "id", "order").select("id", "event_id", "t")


def incident_feed(spark, d):
    e = V.events(spark, d).where("event_type = 'error'").select(F.col("t").alias("at"), F.col("event_id").alias("seq"), F.lit("degraded-source").alias("kind"), F.get_json_object("props", "$.k").alias("detail"))
    return ledger.incident_feed(e)


def activity_feed(spark, d):
    e = V.events(spark, d)
    server = e.where("event_type = 'error'").select(F.col("t").alias("at"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "heal").otherwise("degraded-source").alias("kind"), F.when(F.col("user_id") % 3 == 0, "Approved by Ann: x").otherwise("x").alias("message"))
    local = e.where("event_type = 'signup'").select(F.col("t").alias("at"), F.col("event_id").alias("seq"), F.lit("log").alias("kind"), F.lit("y").alias("message"))
    out = None
    for mode in ("all", "incidents", "decisions", "pipeline"):
        one = ledger.feed(server, local, mode).select(F.lit(mode).alias("mode"), "at", "seq", "kind", "provenance")
        out = one if out is None else out.unionByName(one)
    return out


def _decisions(spark, d):
    e = V.events(spark, d)
    items = e.select((F.col("user_id") % 400).alias("item")).distinct()
    by = F.when(F.col("value") < 2, F.lit("  ")).otherwise(F.concat(F.lit(" person"), (F.col("user_id") % 7).cast("string"), F.lit(" ")))
    tries = e.where("value < 40").select(F.col("event_id").alias("seq"), (F.col("event_id") % 450).alias("item"), F.when(F.col("event_type").isin("purchase", "view"), "approved").otherwise("rejected").alias("verdict"), by.alias("by"))
    return ledger.decide(items, tries)


def decision_ledger(spark, d):
    return _decisions(spark, d)[0]


def decision_codes(spark, d):
    return _decisions(spark, d)[1].groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def district_shortlist(spark, d):
    e = V.entities(spark, d)
    scope = e.select((F.col("id") % 40).alias("item"), F.col("id").alias("entity")).unionByName(e.limit(1).select(F.lit(99).cast("bigint").alias("item"), F.lit(None).cast("bigint").alias("entity")))
    return ledger.shortlist(scope, e).select("item", "jurisdiction", "entities_in_district", F.size("in_scope").alias("in_scope"), "population_in_district")


def cold_starts(spark, d):
    return ledger.cold_start_incidents(R.ranked(spark, d)).select("id", "kind", "message")


def entity_texts(spark, d):
    x = R.ranked(spark, d)
    return x.select("id", ledger.number_text(F.col("surprisal")).alias("surprisal"), ledger.integer_text(F.col("population")).alias("population"), ledger.count_text(F.col("report_count")).alias("reports"), ledger.rate_text(F.col("rate_per_hour") / (1 + F.col("id") % 3 * 100)).alias("rate"), ledger.hours_text(F.col("silence_hours")).alias("silence"), ledger.signed_text(F.col("own_z"), 1).alias("own"), ledger.relative_text(F.col("last_report_ms"), F.lit(C.NOW_MS)).alias("heard"), M.half_up(M.population_radius(F.col("population")), 3).alias("radius"))


def run_stats(spark, d):
    clusters = V.event_clusters(spark, d)
    return ledger.run_stats(V.reports(spark, d), R.ranked(spark, d), clusters, _decisions(spark, d)[0])


def poll_changes(spark, d):
    return ledger.changes(V.events(spark, d).select("user_id", F.struct("t", "event_id").alias("at"), F.col("event_type").alias("value")), "user_id").select(F.col("at.event_id").alias("event_id"), "value")


def stream_last_seen(spark, d):
    s = stream.read_events(spark, f"{d}/events.parquet")
    return stream.drain(stream.last_seen(s), f"last_seen_{uuid.uuid4().hex}", "complete")


def stream_silences(spark, d):
    """Silences of more than three expected gaps: ended ones with their length, and those still open when the watermark passed their limit."""
    s = stream.with_limits(stream.read_events(spark, f"{d}/events.parquet"), _expected(spark, d))
    x = stream.drain(stream.silence_alerts(s), f"silences_{uuid.uuid4().hex}", "append")
    return x.select("entity", "since", M.half_up("gap_hours").alias("gap_hours"))


def _expected(spark, d):
    """Made-up expected gaps of 10 to 16 hours for every entity."""
    return V.events(spark, d).select(F.col("user_id").alias("entity")).distinct().withColumn("expected_gap_hours", (10 + F.col("entity") % 7).cast("double"))


def stream_first_reports(spark, d):
    s = stream.read_events(spark, f"{d}/events.parquet")
    return stream.drain(stream.first_reports(s), f"first_{uuid.uuid4().hex}", "append")


_MS = "(epoch_us(ts) // 1000)"
_FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_ROOT = "lower(regexp_extract(url, '^(https?)://', 1)) || '://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"
_HOST = "regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '')"
_PUB = f"upper(substr(split_part({_HOST}, '.', 1), 1, 1)) || substr(split_part({_HOST}, '.', 1), 2)"
_TITLE = "trim(regexp_replace(" + _FLAT.format("replace(regexp_extract(html, '(?is)<h1[^>]*>(.{3,220}?)</h1>', 1), '&amp;', '&')") + ", '\\s*[|–-]\\s*[^|–-]{0,40}$', ''))"
_TAGS = "trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"
_LINKS = f"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*href=["'']([^"''#]+)["''][^>]*>(.{{0,200}}?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\\b[^>]*href=["'']([^"''#]+)["''][^>]*>(.{{0,200}}?)</a>', 2) AS l FROM pages),
b AS (SELECT page_id, url AS target, i, {_ROOT} || h[i] AS url, {_TAGS.format('l[i]')} AS label FROM (SELECT *, unnest(generate_series(1, len(h))) AS i FROM a))"""
_LOG = f"log AS (SELECT 'src' || user_id % 20 AS name, CASE WHEN value < 5 THEN 'degraded' WHEN value < 10 THEN 'ok' ELSE 'live' END AS status, {_MS} * 1000 + event_id % 1000 AS \"at\" FROM events)"
_DECIDE = """items AS (SELECT DISTINCT user_id % 400 AS item FROM events),
tries AS (SELECT event_id AS seq, event_id % 450 AS item, CASE WHEN event_type IN ('purchase', 'view') THEN 'approved' ELSE 'rejected' END AS verdict, CASE WHEN value < 2 THEN NULL ELSE 'person' || user_id % 7 END AS name FROM events WHERE value < 40),
won AS (SELECT item, min(seq) AS seq, arg_min(verdict, seq) AS verdict, arg_min(name, seq) AS name FROM tries JOIN items USING (item) WHERE name IS NOT NULL GROUP BY 1)"""
SQL = {
    "page_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "page_body": f"""WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<article.*?</article>') AS region FROM pages), q AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(region, '(?is)<p[^>]*>(.*?)</p>', 1), lambda s: {_TAGS.format('s')}), lambda s: length(s) >= 45) AS ps, region FROM p),
r AS (SELECT page_id, region, array_to_string(ps[1:12], ' ') AS t FROM q), s AS (SELECT page_id, trim(substr(CASE WHEN length(t) < 120 THEN substr({_TAGS.format('region')}, 1, {C.MAX_TEXT}) ELSE t END, 1, {C.MAX_TEXT})) AS b FROM r) SELECT page_id, md5(b) AS digest, length(b) AS n FROM s""",
    "page_links": _LINKS + " SELECT page_id, url, arg_min(label, i) AS label FROM b WHERE length(label) >= 4 GROUP BY 1, 2",
    "listing_articles": _LINKS + ", f AS (SELECT target, min(page_id) AS page_id FROM b GROUP BY 1) SELECT b.target, count(DISTINCT url) AS links FROM b JOIN f ON f.page_id = b.page_id WHERE length(label) >= 2 GROUP BY 1",
    "page_reports": f"SELECT 'rpt-' || substr(sha1(url), 1, 12) AS id, {_PUB} AS source_name, substr({_TITLE}, 1, 300) AS title, TRUE AS time_imputed FROM pages",
    "report_ids": "SELECT page_id, 'rpt-' || substr(sha1(url), 1, 12) AS id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_matches(url, '(?i)^https?://[^/]+') AS citable FROM pages",
    "publisher": f"SELECT {_PUB} AS publisher, count(*) AS n FROM pages GROUP BY 1",
    "source_health": f"WITH {_LOG} SELECT name, arg_max(status, \"at\") AS status, max(\"at\") AS last_at FROM log GROUP BY 1",
    "source_summary": f"WITH {_LOG}, l AS (SELECT name, arg_max(status, \"at\") AS status FROM log GROUP BY 1) SELECT count(*) FILTER (status IN ('live', 'ok')) AS healthy, count(*) AS total FROM l",
    "reanchored": f"WITH e AS (SELECT event_id, {_MS} AS t FROM events), s AS (SELECT {C.NOW_MS + 7 * 24 * C.HOUR_MS} - 300000 - max(t + 60000) AS d FROM e) SELECT event_id, t + CASE WHEN abs(d) >= 60000 THEN d ELSE 0 END AS published_ms, t + 60000 + CASE WHEN abs(d) >= 60000 THEN d ELSE 0 END AS fetched_ms FROM e, s",
    "distinct_reports": f"SELECT user_id AS id, event_id, {_MS} AS t FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) = 1",
    "incident_feed": f"SELECT {_MS} AS at, event_id AS seq, 'degraded-source' AS kind, json_extract_string(props, '$.k') AS detail FROM events WHERE event_type = 'error' ORDER BY 1 DESC, 2 DESC LIMIT {C.INCIDENT_CAP}",
    "activity_feed": f"""WITH f AS (SELECT {_MS} AS "at", event_id AS seq, CASE WHEN event_type <> 'error' THEN 'log' WHEN event_id % 2 = 0 THEN 'heal' ELSE 'degraded-source' END AS kind, CASE event_type WHEN 'error' THEN 'server' ELSE 'local' END AS provenance, event_type = 'error' AND user_id % 3 = 0 AS decision FROM events WHERE event_type IN ('signup', 'error')),
m AS (SELECT k AS "mode", f.* FROM f, (SELECT unnest(['all', 'incidents', 'decisions', 'pipeline']) AS k) WHERE k = 'all' OR (k = 'incidents' AND provenance = 'server' AND kind <> 'heal') OR (k = 'decisions' AND decision) OR (k = 'pipeline' AND (provenance = 'local' OR kind = 'degraded-source')))
SELECT m."mode", m."at", seq, kind, provenance FROM m QUALIFY row_number() OVER (PARTITION BY m."mode" ORDER BY m."at" DESC, seq DESC) <= 80""",
    "decision_ledger": f"WITH {_DECIDE} SELECT item, coalesce(verdict, 'pending') AS status, name AS approved_by, seq AS decided_seq FROM items LEFT JOIN won USING (item)",
    "decision_codes": f"WITH {_DECIDE} SELECT code, count(*) AS n FROM (SELECT CASE WHEN t.name IS NULL THEN 400 WHEN i.item IS NULL THEN 404 WHEN t.seq > w.seq THEN 409 ELSE 200 END AS code FROM tries t LEFT JOIN items i USING (item) LEFT JOIN won w USING (item)) GROUP BY 1",
    "district_shortlist": f"WITH {V.sql_entities()}, scope AS (SELECT id % 40 AS item, id, district FROM entities), d AS (SELECT district, count(*) AS n, CAST(sum(population) AS BIGINT) AS p FROM entities GROUP BY 1) SELECT item, 'district-' || regexp_replace(lower(district), '[^a-z0-9]+', '-', 'g') AS jurisdiction, n AS entities_in_district, count(DISTINCT id) AS in_scope, p AS population_in_district FROM scope JOIN d USING (district) GROUP BY 1, 2, 3, 5 UNION ALL SELECT 99, 'district-' || regexp_replace(lower(district), '[^a-z0-9]+', '-', 'g'), n, 0, p FROM d",
    "cold_starts": R._ALL + "SELECT id, 'cold-start' AS kind, 'No report has ever named ' || name || '. Its baseline is that of cohort ' || cohort AS message FROM ranked WHERE coverage_basis = 'cohort-cold-start' ORDER BY id LIMIT 3",
    "run_stats": f"WITH {V.SQL_REPORTS}, {V.sql_entities()}, {V.SQL_CLUSTERS}, {_DECIDE} SELECT (SELECT count(*) FROM reports) AS report_count, (SELECT count(*) FROM entities) AS ranked_count, (SELECT count(*) FROM clusters) AS cluster_count, (SELECT count(*) FROM items WHERE item NOT IN (SELECT item FROM won)) AS pending_count",
    "poll_changes": f"SELECT event_id, value FROM (SELECT event_id, event_type AS value, lag(event_type) OVER (PARTITION BY user_id ORDER BY {_MS}, event_id) AS last FROM events) WHERE last IS NULL OR last <> value",
    "stream_last_seen": f"SELECT user_id AS entity, max({_MS}) AS last_t, count(*) AS n FROM events GROUP BY 1",
    "stream_silences": f"""SELECT entity, since, floor(g * 1e4 + 0.5) / 1e4 AS gap_hours FROM (SELECT user_id AS entity, lag({_MS}) OVER w AS since, ({_MS} - lag({_MS}) OVER w) / 3600000.0 AS g FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {_MS})) WHERE g > 3 * (10 + entity % 7)
UNION ALL SELECT user_id, max({_MS}), NULL FROM events GROUP BY 1 HAVING max({_MS}) + 3 * (10 + user_id % 7) * 3600000 < (SELECT max({_MS}) - 3600000 FROM events)""",
    "entity_texts": R._ALL + f"""SELECT id, printf('%.2f', floor(surprisal * 100 + 0.5) / 100) AS surprisal, format('{{:,}}', population) AS population, CAST(report_count AS VARCHAR) AS reports,
CASE WHEN rate_per_hour / (1 + id % 3 * 100) < 0.001 THEN regexp_replace(printf('%.3e', rate_per_hour / (1 + id % 3 * 100)), 'e([+-])0*([0-9])', 'e\\1\\2') ELSE printf('%.5f', floor(rate_per_hour / (1 + id % 3 * 100) * 1e5 + 0.5) / 1e5) END || ' /h' AS rate,
CASE WHEN silence_hours >= 100 THEN CAST(CAST(floor(silence_hours + 0.5) AS BIGINT) AS VARCHAR) || 'h' ELSE printf('%.1f', floor(silence_hours * 10 + 0.5) / 10) || 'h' END AS silence,
CASE WHEN own_z < 0 THEN '\u2212' ELSE '+' END || printf('%.1f', floor(abs(own_z) * 10 + 0.5) / 10) AS own,
CASE WHEN s < 0 THEN 'just now' WHEN s < 45 THEN s || 's ago' WHEN floor(s / 60.0 + 0.5) < 60 THEN CAST(floor(s / 60.0 + 0.5) AS BIGINT) || ' min ago' WHEN s < 172800 THEN s // 3600 || 'h ago' ELSE s // 86400 || 'd ago' END AS heard,
floor(least(22.0, greatest(5.0, 5 + 16 * sqrt(population / 25000.0))) * 1e3 + 0.5) / 1e3 AS radius
FROM (SELECT *, CAST(floor(({C.NOW_MS} - last_report_ms) / 1000.0 + 0.5) AS BIGINT) AS s FROM ranked)""",
    "stream_first_reports": "SELECT DISTINCT user_id AS entity FROM events",
}
QUERIES = {f.__name__: f for f in (page_title, page_body, page_links, listing_articles, page_reports, report_ids, publisher, source_health, source_summary, reanchored, distinct_reports, incident_feed, activity_feed, decision_ledger, decision_codes, district_shortlist, cold_starts, entity_texts, run_stats, poll_changes, stream_last_seen, stream_silences, stream_first_reports)}
