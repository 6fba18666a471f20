"""Queries over what an application reads and records, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tacet import config as C
from tacet.functions import maths as M
from tacet.functions import web
from tacet.operators import cadence, ledger, ranking, triage
from tacet.plans import rank_queries as R
from tacet.plans import record_queries as Q
from tacet.plans import views as V
from tacet.sources import reports as S

NEEDLES = ["news", "article"]


def _clustered(spark, d):
    owner = V.event_clusters(spark, d).select("cluster_id", F.explode("report_ids").alias("id"))
    return V.reports(spark, d).join(owner, "id", "left")


def clustered_events(spark, d):
    return cadence.event_times(_clustered(spark, d))


def corroboration(spark, d):
    return ranking.corroboration(V.entities(spark, d), V.reports(spark, d), V.event_clusters(spark, d))


def entity_overview(spark, d):
    e = V.entities(spark, d)
    items = V.events(spark, d).where("event_type = 'signup'").select(F.col("user_id").alias("entity"))
    return ledger.entity_overview(e, V.reports(spark, d), V.event_clusters(spark, d), V.chain(e), items)


def _incidents(spark, d):
    kind = F.when(F.col("event_type") == "error", "degraded-source").otherwise("heal")
    return V.events(spark, d).select("event_id", F.col("t").alias("at"), kind.alias("kind"), F.when(F.col("event_id") % 5 < 4, F.try_element_at(F.array(*map(F.lit, ("ingest", "triage", "dedup", "rank"))), (F.col("event_id") % 5).cast("int") + 1)).alias("stage"))


def failed_stages(spark, d):
    runs = V.events(spark, d).where("event_type = 'signup'").select(F.col("event_id").alias("run"), F.col("t").alias("last_at"), (F.col("event_id") % 400 * 60_000).alias("duration_ms"))
    return ledger.failed_stages(_incidents(spark, d), runs)


def new_escalations(spark, d):
    x = R.ranked(spark, d).where("silence_hours >= 6")
    evidence = F.when(F.col("id") % 11 == 0, F.to_json(F.struct(F.struct(F.col("id").alias("AssignTo")).alias("inner")))).otherwise(F.to_json(F.struct("silence_hours", F.lit("orders: none").alias("note"))))
    held = V.entities(spark, d).where("id % 2 = 0").select(F.lit("escalation").alias("kind"), F.col("id").alias("entity"))
    return ledger.new_escalations(x.select(F.col("id").alias("entity"), F.col("name").alias("title"), evidence.alias("evidence")), held).select("entity")


def new_ambiguous(spark, d):
    e = V.events(spark, d)
    pairs = e.select(F.when(F.col("event_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") % 7).alias("a"), F.when(F.col("event_id") % 2 == 0, F.col("user_id") % 7).otherwise(F.col("user_id")).alias("b")).where("a <> b")
    held = V.entities(spark, d).where("id % 3 = 0").select(F.lit("ambiguous-match").alias("kind"), ledger.fingerprint(F.col("id") % 7, F.col("id")).alias("fingerprint"))
    return ledger.new_ambiguous(pairs, held).select("fingerprint")


def named_entities(spark, d):
    e = V.events(spark, d)
    evidence = F.concat(F.lit('{"leftSettlementId": "u'), F.col("user_id").cast("string"), F.lit('", "note": "entityId: x", "deep": [{"entityId": "e'), (F.col("event_id") % 9).cast("string"), F.lit('"}], "id": "z"}'))
    return e.select("event_id", F.array_join(ledger.named_entities(evidence), ",").alias("named"))


def pair_titles(spark, d):
    e = V.events(spark, d)
    title = F.when(F.col("event_id") % 3 == 0, F.repeat(F.col("event_type"), 20)).when(F.col("event_id") % 3 == 1, F.col("event_type"))
    a = ledger.pair_label(F.lit(""), title, F.concat(F.lit("r"), F.col("event_id").cast("string")), "candidate A")
    b = ledger.pair_label(F.when(F.col("event_id") % 2 == 0, F.lit(" given ")), F.lit(None).cast("string"), F.lit(None).cast("string"), "candidate B")
    return e.select("event_id", ledger.describe_pair(a, b, F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 100) / 128)).alias("title"))


def _items(spark, d):
    e = V.events(spark, d).groupBy((F.col("user_id") % 400).alias("item")).agg(F.min("t").alias("created"), F.min("user_id").alias("entity"))
    return e.withColumn("title", F.concat(F.lit("Item "), F.col("item").cast("string")))


def _decided(spark, d):
    return Q._decisions(spark, d)[0].join(_items(spark, d), "item")


def pending_items(spark, d):
    return ledger.pending_first(_decided(spark, d)).select("item", "created", "title")


def decided_recently(spark, d):
    return ledger.last_decided(_decided(spark, d)).select("item", "status", "approved_by", "decided_seq")


def items_by_status(spark, d):
    x = _decided(spark, d)
    out = None
    for status in ("pending", "approved", "rejected"):
        one = ledger.listed(x, status).select(F.lit(status).alias("status"), "item")
        out = one if out is None else out.unionByName(one)
    return out


def pending_entities(spark, d):
    return ledger.waiting_rows(V.entities(spark, d), _decided(spark, d)).select("id", "name")


def heal_incidents(spark, d):
    return ledger.heals(_items(spark, d), Q._decisions(spark, d)[0])


def _named_reports(spark, d):
    return V.events(spark, d).select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_name"), V.source_type().alias("source_type"), "t")


def reports_of_sources(spark, d):
    return ledger.reports_of_sources(_named_reports(spark, d))


def registered_sources(spark, d):
    return S.register(_named_reports(spark, d), C.NOW_MS)


def source_failure(spark, d):
    return ledger.source_failure(S.health(Q._log(spark, d)), _named_reports(spark, d))


def self_heals(spark, d):
    e = V.events(spark, d).where("event_type = 'error'")
    failures = e.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("name"), F.col("t").alias("at"), F.when(F.col("event_id") % 3 > 0, "live").alias("previous_status"))
    return ledger.self_heals(failures, C.NOW_MS - 15 * 24 * C.HOUR_MS)


def cold_start_shown(spark, d):
    return ledger.cold_start_shown(R.ranked(spark, d))


def map_positions(spark, d):
    e = V.entities(spark, d).select("id", (27.9 + F.col("id") * 0.01).alias("lat"), F.when(F.col("id") % 17 != 0, 85.1 + (F.col("id") % 13) * 0.02).alias("lon"))
    return ranking.map_positions(e, 800.0, 600.0).select("id", M.half_up("x", 3).alias("x"), M.half_up("y", 3).alias("y"))


def map_labels(spark, d):
    tier = ranking.label_tier(F.col("rank"))
    return R.ranked(spark, d).select("id", tier.alias("tier"), ranking.label_shown(tier, 8.5).alias("shown"))


def link_relevance(spark, d):
    x = V.table(spark, d, "pages").select("page_id", F.explode(web.links(F.col("html"), F.col("url"), 2)).alias("l")).select("page_id", "l.url", "l.label")
    return x.groupBy("page_id").agg(F.count_if(triage.relevant_link(F.col("label"), F.col("url"), NEEDLES)).alias("relevant"), F.count(F.lit(1)).alias("links"))


def page_links_18(spark, d):
    x = V.table(spark, d, "pages").select("page_id", F.explode(web.links(F.col("html"), F.col("url"))).alias("l")).select("page_id", "l.*")
    return x.groupBy("page_id", "url").agg(F.min_by("label", "pos").alias("label"))


def serp_reports(spark, d):
    """Search results made of the events, one payload per target, parsed and related to the target."""
    item = F.struct(F.concat(F.lit("Report "), F.col("event_id").cast("string")).alias("title"), F.concat(F.lit("/e/"), F.col("event_id").cast("string")).alias("link"), F.concat((F.col("event_id") % 5).cast("string"), F.lit(" hours ago")).alias("date"), F.when(F.col("event_id") % 2 == 0, "Daily").alias("source"))
    e = V.events(spark, d).groupBy((F.col("user_id") % 50).alias("k")).agg(F.collect_list(item).alias("organic"))
    payloads = e.select(F.concat(F.lit("https://s"), F.col("k").cast("string"), F.lit(".example/search")).alias("target"), F.to_json(F.struct("organic")).alias("body"))
    payloads = payloads.unionByName(spark.createDataFrame([("https://bad.example/", "<html>")], "target string, body string"))
    return S.from_serp(payloads, C.NOW_MS).select("id", "url", "title", "source_name", "published_ms", "time_imputed")


def search_reports(spark, d):
    """Search results made of whole documents, a payload per document, each also once cut off, which gives nothing.

    All four lists occur, with other field names in each; results without an address, a web address or a title are left out.
    """
    text, n = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    title = [F.substring(text, 40 * k + 1, 40) for k in range(4)]
    organic = F.struct(title[0].alias("title"), text.alias("description"), F.concat(F.lit("/o/"), n).alias("link"), F.concat((F.col("doc_id") % 9).cast("string"), F.lit(" hours ago")).alias("date"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("source"))
    news = F.struct(title[1].alias("name"), F.substring(text, 1, 300).alias("snippet"), F.concat(F.lit("https://news.example/"), n).alias("url"), F.lit("yesterday").alias("published"))
    results = [F.struct(title[2].alias("title"), text.alias("summary"), href.alias("href"), F.lit("2023-11-05T10:00:00Z").alias("time")) for href in (F.concat(F.lit("?page="), n), F.lit(None).cast("string"))]
    stories = [F.struct(title[3].alias("name"), F.concat(F.lit(place), n).alias("link")) for place in ("s/", "mailto:a")]
    lists = F.struct(F.array(organic).alias("organic"), F.array(news).alias("news"), F.array(*results).alias("organic_results"), F.array(*stories).alias("top_stories"))
    x = V.table(spark, d, "documents").select(F.concat(F.lit("https://s"), (F.col("doc_id") % 50).cast("string"), F.lit(".example/search/q")).alias("target"), F.to_json(lists).alias("body"))
    payloads = x.select("target", F.explode(F.array("body", F.expr("left(body, length(body) - 2)"))).alias("body"))
    return S.from_serp(payloads, C.NOW_MS).select("id", "url", "title", F.md5("text").alias("text_digest"), "source_name", "published_ms", "time_imputed")


def normalized_reports(spark, d):
    e = V.events(spark, d)
    raw = e.select(F.lit("").alias("id"), F.when(F.col("event_id") % 7 != 0, F.concat(F.lit(" http://x"), (F.col("user_id") % 30).cast("string"), F.lit(".example/"), F.col("event_id").cast("string"))).alias("url"), F.concat(F.lit("T "), F.col("event_type")).alias("title"), F.lit("t").alias("text"), F.when(F.col("event_id") % 2 == 0, "official").otherwise("odd").alias("source_type"), F.lit(None).cast("string").alias("source_name"), F.when(F.col("event_id") % 3 == 0, F.col("t")).alias("published_ms"), (F.col("t") + 1).alias("fetched_ms"))
    return S.normalize(raw, C.NOW_MS)


def loose_dates(spark, d):
    e = V.events(spark, d)
    unit = F.element_at(F.array(*map(F.lit, ("minute", "hours", "day", "weeks", "months"))), (F.col("event_id") % 5).cast("int") + 1)
    text = F.when(F.col("event_id") % 11 == 0, "yesterday").when(F.col("event_id") % 11 == 1, "Just now").when(F.col("event_id") % 11 == 2, "soon").when(F.col("event_id") % 11 == 3, F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(F.lit("about "), (F.col("event_id") % 40).cast("string"), F.lit(" "), unit, F.lit(" ago")))
    return e.select("event_id", web.loose_date(text, C.NOW_MS).alias("at"))


def published_dates(spark, d):
    """The date of publication out of made-up pages, by each of the four places where it may stand."""
    e = V.events(spark, d)
    when = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    k = F.col("event_id") % 5
    html = F.when(k == 0, F.concat(F.lit('<meta property="article:published_time" content="'), when, F.lit('">'))).when(k == 1, F.concat(F.lit('{"datePublished" : "'), when, F.lit('"}'))).when(k == 2, F.concat(F.lit('<meta name="pubdate" content="'), when, F.lit('">'))).when(k == 3, F.concat(F.lit("<time class='x' datetime='"), when, F.lit("'>"))).otherwise(F.lit("<p>none</p>"))
    return e.select("event_id", web.published(html, C.NOW_MS).alias("at"))


def decoded_entities(spark, d):
    e = V.events(spark, d)
    text = F.concat(F.lit("&#"), (65 + F.col("event_id") % 26).cast("string"), F.lit(";&#x"), F.lower(F.hex(8364 + F.col("event_id") % 5)), F.lit(";&lt;&AMP;&nbsp;&copy;"))
    return e.select("event_id", web.decode_entities(text).alias("decoded"))


def api_state(spark, d):
    incidents = V.events(spark, d).where("event_type = 'error'").select(F.col("event_id").alias("seq"), F.col("t").alias("at"), F.lit("degraded-source").alias("kind"))
    x = ledger.state_rows(V.entities(spark, d), Q._decisions(spark, d)[0], incidents, S.health(Q._log(spark, d)))
    label = F.coalesce(F.get_json_object("json", "$.name"), F.get_json_object("json", "$.status"), F.get_json_object("json", "$.kind"))
    return x.select("part", "id", label.alias("label"))


_MS = "(epoch_us(ts) // 1000)"
_CL = f"{V.SQL_REPORTS}, {V.SQL_CLUSTERS}, owner AS (SELECT unnest(report_ids) AS id, cluster_id FROM clusters)"
_STATE = f"{Q._DECIDE}, facts AS (SELECT user_id % 400 AS item, min({_MS}) AS created, min(user_id) AS entity FROM events GROUP BY 1), state AS (SELECT facts.*, 'Item ' || item AS title, coalesce(verdict, 'pending') AS status, name AS approved_by, seq AS decided_seq FROM facts LEFT JOIN won USING (item))"
_STAGE = "['ingest', 'triage', 'dedup', 'rank'][event_id % 5 + 1]"
_UP3 = lambda x: f"floor(({x}) * 1e3 + 0.5) / 1e3"
_WHEN = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"
SQL = {
    "api_state": f"""WITH {V.sql_entities()}, {Q._DECIDE}, log AS (SELECT DISTINCT 'src' || user_id % 20 AS name FROM events)
SELECT 'entities' AS part, CAST(id AS VARCHAR) AS id, name AS label FROM entities UNION ALL SELECT 'ledger', CAST(item AS VARCHAR), coalesce(verdict, 'pending') FROM items LEFT JOIN won USING (item) UNION ALL SELECT 'incidents', CAST(event_id AS VARCHAR), 'degraded-source' FROM events WHERE event_type = 'error' UNION ALL SELECT 'sources', name, name FROM log""",
    "clustered_events": f"WITH {_CL} SELECT entity, min(t) AS t FROM reports JOIN owner USING (id) WHERE entity IS NOT NULL GROUP BY entity, cluster_id",
    "corroboration": f"""WITH {_CL}, {V.sql_entities()}, own AS (SELECT c.cluster_id, coalesce(any_value(c.entity), arg_min(r.entity, r.id)) AS entity FROM clusters c JOIN owner o ON o.cluster_id = c.cluster_id JOIN reports r ON r.id = o.id GROUP BY 1),
a AS (SELECT entity, count(*) AS n FROM own GROUP BY 1), b AS (SELECT entity, count(*) AS n FROM reports GROUP BY 1) SELECT e.id AS entity, coalesce(a.n, b.n, 0) AS corroboration_count FROM entities e LEFT JOIN a ON a.entity = e.id LEFT JOIN b ON b.entity = e.id""",
    "entity_overview": f"""WITH {_CL}, {V.sql_entities()}, {V.SQL_EDGES}, part AS (SELECT entity, cluster_id FROM clusters UNION SELECT entity, cluster_id FROM reports JOIN owner USING (id))
SELECT id, name, (SELECT count(*) FROM reports r WHERE r.entity = e.id) AS reports, (SELECT count(*) FROM part p WHERE p.entity = e.id) AS clusters, (SELECT count(*) FROM edges x WHERE x.src = e.id) AS neighbours, (SELECT count(*) FROM events v WHERE v.user_id = e.id AND event_type = 'signup') AS items FROM entities e""",
    "failed_stages": f"""WITH runs AS (SELECT event_id AS run, {_MS} - event_id % 400 * 60000 - 2000 AS low, {_MS} + 2000 AS high FROM events WHERE event_type = 'signup'), i AS (SELECT {_MS} AS m, {_STAGE} AS stage FROM events WHERE event_type = 'error' AND event_id % 5 < 4)
SELECT DISTINCT run, stage FROM runs JOIN i ON m BETWEEN low AND high""",
    "new_escalations": R._ALL + "SELECT id AS entity FROM ranked WHERE silence_hours >= 6 AND id % 2 = 1 AND id % 11 <> 0",
    "new_ambiguous": f"WITH {V.sql_entities()}, f AS (SELECT DISTINCT array_to_string(list_sort([CAST(user_id AS VARCHAR), CAST(user_id % 7 AS VARCHAR)]), '::') AS fingerprint FROM events WHERE user_id <> user_id % 7) SELECT fingerprint FROM f WHERE fingerprint NOT IN (SELECT array_to_string(list_sort([CAST(id AS VARCHAR), CAST(id % 7 AS VARCHAR)]), '::') FROM entities WHERE id % 3 = 0)",
    "named_entities": "SELECT event_id, 'u' || user_id || ',e' || event_id % 9 AS named FROM events",
    "pair_titles": """SELECT event_id, 'Ambiguous match: ' || CASE event_id % 3 WHEN 0 THEN CASE WHEN length(repeat(event_type, 20)) > 70 THEN substr(repeat(event_type, 20), 1, 69) || '…' ELSE repeat(event_type, 20) END WHEN 1 THEN event_type ELSE 'r' || event_id END || ' vs ' || CASE WHEN event_id % 2 = 0 THEN 'given' ELSE 'candidate B' END
|| CASE WHEN event_id % 5 <> 0 THEN ' (match p=' || regexp_replace(CAST(floor(event_id % 100 / 128.0 * 100 + 0.5) / 100 AS VARCHAR), '\\.0$', '') || ')' ELSE '' END AS title FROM events""",
    "pending_items": f"WITH {_STATE} SELECT item, created, title FROM state WHERE status = 'pending'",
    "decided_recently": f"WITH {_STATE} SELECT item, status, approved_by, decided_seq FROM state WHERE status <> 'pending' ORDER BY decided_seq DESC LIMIT 5",
    "items_by_status": f"WITH {_STATE} SELECT status, item FROM state",
    "pending_entities": f"WITH {_STATE}, {V.sql_entities()} SELECT id, name FROM entities WHERE id IN (SELECT entity FROM state WHERE status = 'pending')",
    "heal_incidents": f"WITH {_STATE} SELECT decided_seq AS seq, item, 'heal' AS kind, CASE status WHEN 'approved' THEN 'Approved' ELSE 'Rejected' END || ' by ' || approved_by || ': ' || title AS message FROM state WHERE status <> 'pending'",
    "reports_of_sources": f"SELECT 'src' || user_id % 20 AS name, min({V.SQL_SOURCE}) AS source_type, count(*) AS contributed FROM events GROUP BY 1",
    "registered_sources": f"SELECT 'src' || user_id % 20 AS name, min({V.SQL_SOURCE}) AS source_type, 'live' AS status, {C.NOW_MS} AS at FROM events GROUP BY 1",
    "source_failure": f"""WITH log AS (SELECT 'src' || user_id % 20 AS name, {V.SQL_SOURCE} AS source_type, CASE WHEN value < 5 THEN 'degraded' WHEN value < 10 THEN 'ok' ELSE 'live' END AS status, {_MS} * 1000 + event_id % 1000 AS "at" FROM events), h AS (SELECT name, arg_max(source_type, "at") AS source_type, arg_max(status, "at") AS status, count(*) AS n FROM log GROUP BY 1)
SELECT name, source_type, status AS previous_status, 'degraded' AS status, n AS contributed FROM h ORDER BY CASE h.status WHEN 'live' THEN 0 ELSE 1 END, name LIMIT 1""",
    "self_heals": f"SELECT 'src' || user_id % 20 AS name, {_MS} + 20000 AS at, 'heal' AS kind, CASE WHEN event_id % 3 > 0 THEN 'live' ELSE 'ok' END AS status, 'Connector \"src' || user_id % 20 || '\" recovered - coverage restored' AS message FROM events WHERE event_type = 'error' AND {_MS} + 20000 <= {C.NOW_MS - 15 * 24 * C.HOUR_MS}",
    "cold_start_shown": R._ALL + "SELECT id, 'cohort-cold-start' AS coverage_basis, name || ' has no report history - scored from its hazard-tier cohort baseline, not its own data' AS message FROM ranked ORDER BY CASE WHEN ranked.coverage_basis <> 'cohort-cold-start' THEN 0 ELSE 1 END, rank LIMIT 1",
    "map_positions": f"""WITH {V.sql_entities()}, p AS (SELECT id, 27.9::DOUBLE + id * 0.01::DOUBLE AS lat, 85.1::DOUBLE + (id % 13) * 0.02::DOUBLE AS lon FROM entities WHERE id % 17 <> 0),
e AS (SELECT min(lon) - greatest(0.03, (max(lon) - min(lon)) * 0.1) AS west, max(lon) + greatest(0.03, (max(lon) - min(lon)) * 0.1) AS east, min(lat) - greatest(0.03, (max(lat) - min(lat)) * 0.1) AS south, max(lat) + greatest(0.03, (max(lat) - min(lat)) * 0.1) AS north FROM p),
k AS (SELECT *, cos(radians((south + north) / 2)) AS k FROM e), s AS (SELECT *, (east - west) * k AS w, north - south AS h, least((800 - 68) / ((east - west) * k), (600 - 68) / (north - south)) AS s FROM k)
SELECT id, {_UP3("(800 - w * s) / 2 + (lon - west) * k * s")} AS x, {_UP3("(600 - h * s) / 2 + (north - lat) * s")} AS y FROM p, s""",
    "map_labels": R._ALL + "SELECT id, CASE WHEN rank <= 3 THEN 1 WHEN rank <= 10 THEN 2 ELSE 3 END AS tier, rank <= 10 AS shown FROM ranked",
    "link_relevance": Q._LINKS + f" SELECT page_id, count(*) FILTER ({' OR '.join(f"contains(lower(label || ' ' || url), '{w}')" for w in [*triage.L.EVENTS, *NEEDLES])}) AS relevant, count(*) AS links FROM b WHERE length(label) >= 2 GROUP BY 1",
    "page_links_18": Q._LINKS + " SELECT page_id, url, arg_min(label, i) AS label FROM b WHERE length(label) >= 18 GROUP BY 1, 2",
    "search_reports": f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, 'S' || doc_id % 50 AS host, 'https://s' || doc_id % 50 || '.example' AS root FROM documents),
 items AS (SELECT substr(text, 1, 40) AS title, text, root || '/o/' || doc_id AS url, coalesce(CASE WHEN doc_id % 2 = 0 THEN lang END, host) AS source_name, {C.NOW_MS} - doc_id % 9 * 3600000 AS published FROM d
 UNION ALL SELECT substr(text, 41, 40), substr(text, 1, 300), 'https://news.example/' || doc_id, 'News', {C.NOW_MS - 24 * C.HOUR_MS} FROM d
 UNION ALL SELECT substr(text, 81, 40), text, root || '/search/q?page=' || doc_id, host, 1699178400000 FROM d
 UNION ALL SELECT substr(text, 121, 40), '', root || '/search/s/' || doc_id, host, NULL FROM d)
SELECT 'rpt-' || substr(sha1(url), 1, 12) AS id, url, substr(title, 1, {C.MAX_TITLE}) AS title, md5(substr(text, 1, {C.MAX_TEXT})) AS text_digest, source_name, coalesce(published, {C.NOW_MS}) AS published_ms, published IS NULL AS time_imputed FROM items WHERE title <> ''""",
    "serp_reports": f"SELECT 'rpt-' || substr(sha1(url), 1, 12) AS id, url, title, CASE WHEN event_id % 2 = 0 THEN 'Daily' ELSE 'S' || user_id % 50 END AS source_name, {C.NOW_MS} - event_id % 5 * 3600000 AS published_ms, FALSE AS time_imputed FROM (SELECT *, 'https://s' || user_id % 50 || '.example/e/' || event_id AS url, 'Report ' || event_id AS title FROM events)",
    "normalized_reports": f"SELECT 'rpt-' || substr(sha1(url), 1, 12) AS id, CASE WHEN event_id % 2 = 0 THEN 'official' ELSE 'news' END AS source_type, 'X' || user_id % 30 AS source_name, url, 'T ' || event_type AS title, 't' AS text, CASE WHEN event_id % 3 = 0 THEN {_MS} ELSE {_MS} + 1 END AS published_ms, {_MS} + 1 AS fetched_ms FROM (SELECT *, 'http://x' || user_id % 30 || '.example/' || event_id AS url FROM events WHERE event_id % 7 <> 0)",
    "loose_dates": f"SELECT event_id, CASE event_id % 11 WHEN 0 THEN {C.NOW_MS - 24 * C.HOUR_MS} WHEN 1 THEN {C.NOW_MS} WHEN 2 THEN NULL WHEN 3 THEN {_MS} // 1000 * 1000 ELSE {C.NOW_MS} - event_id % 40 * [60000, 3600000, 86400000, 604800000, 2592000000][event_id % 5 + 1] END AS at FROM events",
    "published_dates": f"SELECT event_id, CASE WHEN event_id % 5 < 4 THEN {_MS} // 1000 * 1000 END AS at FROM events",
    "decoded_entities": "SELECT event_id, chr(CAST(65 + event_id % 26 AS INT)) || chr(CAST(8364 + event_id % 5 AS INT)) || '<& &copy;' AS decoded FROM events",
}
QUERIES = {f.__name__: f for f in (api_state, clustered_events, corroboration, entity_overview, failed_stages, new_escalations, new_ambiguous, named_entities, pair_titles, pending_items, decided_recently, items_by_status, pending_entities, heal_incidents, reports_of_sources, registered_sources, source_failure, self_heals, cold_start_shown, map_positions, map_labels, link_relevance, page_links_18, serp_reports, search_reports, normalized_reports, loose_dates, published_dates, decoded_entities)}
