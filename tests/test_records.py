"""Web extraction, sources, ledgers and streams."""

import json
import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tacet import config as C
from tacet.functions import web
from tacet.operators import ledger
from tacet.plans import open_queries, record_queries
from tacet.sources import commits
from tacet.sources import reports as S
from tacet.streaming import cadence as stream

NOW = C.NOW_MS
PAGE = """<html><head><title>Site title - Paper</title><meta property="og:title" content="River &amp; town &#8211; News">
<meta name="description" content="About it."><script>var a = "<p>no</p>";</script><meta property="article:published_time" content="2024-01-02T03:04:05Z"></head>
<body><!-- <p>hidden</p> --><article><p>short</p><p>First paragraph with <b>enough</b> characters in it to be kept &#x1F600; here.</p>
<p>Second paragraph, which is also long enough to be kept by the rule of forty-five.</p></article>
<a href="/a/one">A label that is long enough</a><a href="b">A label that is long enough too</a><a href="mailto:x@y.z">A label that is long enough as well</a><a href='/a/one'>Another label for the same url</a><a href="/c">short</a></body></html>"""


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_page(spark):
    h, url = F.lit(PAGE), F.lit("https://www.Daily.example/news/x.html?q")
    t, b, p, name = one(spark, web.title(h), web.body(h), web.published(h, NOW), web.publisher(url))
    assert t == "River & town" and name == "Daily" and p == 1_704_164_645_000
    assert b.startswith("About it. First paragraph") is False and "\U0001f600 here. Second paragraph" in b and "short" not in b
    links = spark.range(1).select(F.explode(web.links(h, url)).alias("l")).select("l.*").collect()
    assert [r.url for r in links] == ["https://www.daily.example/a/one", "https://www.daily.example/news/b", "https://www.daily.example/a/one"]
    listed = S.listing_links(spark.createDataFrame([("https://www.daily.example/", PAGE)], "url string, html string"), 1).collect()
    assert [(r.url, r.label) for r in listed] == [("https://www.daily.example/a/one", "A label that is long enough")]


def test_of_pages_with_one_address_the_first_with_an_anchor_counts(spark, tmp_path):
    def page(n):
        return "".join(f'<a href="/p/{k}">label {k}</a>' for k in range(n)) or "<p>none</p>"

    rows = [(i, f"https://h{u}.example/list", page((i - 2) % 9 if i > 8 else 0)) for i in range(40, 0, -1) for u in (i % 3,)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(7, "html").write.parquet(str(tmp_path / "pages.parquet"))
    expect = {}
    for i, u, h in sorted(rows):
        if "<a" in h:
            expect.setdefault(u, h.count("<a"))
    assert {r.target: r.links for r in record_queries.listing_articles(spark, str(tmp_path)).collect()} == expect


def test_entities_and_tags(spark):
    got = one(spark, web.decode_entities(F.lit("&#65;&#x42;&lt;&nbsp;&copy;&AMP;")), web.strip_tags(F.lit("<style>x</style>a<br>b <!-- c -->&amp;lt;")))
    assert got == ("AB< &copy;&", "a b &lt;") or got == ("AB< &copy;&", "a b <")


def test_dates(spark):
    h = C.HOUR_MS
    cases = {"3 hours ago": NOW - 3 * h, "about 2 days ago": NOW - 48 * h, "1 month ago": NOW - 720 * h, "yesterday": NOW - 24 * h, "just now": NOW, "2024-01-01T00:00:00Z": 1_704_067_200_000, "soon": None, "": None, "5 mins ago": NOW - 300_000}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.d for r in df.select("s", web.loose_date(F.col("s"), NOW).alias("d")).collect()} == cases


def test_addresses(spark):
    base = F.lit("https://Host.example/a/b.html?x=1")
    got = one(spark, *[web.absolute(F.lit(x), base) for x in ("c", "/c", "//o.example/c", "http://o.example", "../c", "javascript:x", "?y")])
    assert got == ("https://host.example/a/c", "https://host.example/c", "https://o.example/c", "http://o.example", "https://host.example/c", None, "https://host.example/a/b.html?y")
    assert one(spark, web.slug(F.lit(" A b--C! ")), web.citable(F.lit("ftp://x")), web.report_id(F.lit("u")))[:2] == ("a-b-c", False)


def test_serp_and_ingest(spark):
    item = {"title": "Flood in Nuwakot displaces families along the river", "description": "Rescue teams reached the ward with relief.", "link": "/r/1", "date": "2 days ago", "source": "Daily"}
    body = json.dumps({"organic": [item, {"title": "no link"}], "news": [{**item, "link": "http://x.example/2", "title": "Cricket", "description": ""}]})
    payloads = spark.createDataFrame([("https://s.example/search", body), ("https://s.example/search", "<html>")], "target string, body string")
    every = S.from_serp(payloads, NOW)
    assert {r.url for r in every.collect()} == {"https://s.example/r/1", "http://x.example/2"}
    near = S.from_serp(payloads, NOW, needles=["nuwakot"]).collect()
    assert [(r.url, r.source_name, r.time_imputed) for r in near] == [("https://s.example/r/1", "Daily", False)]
    both = S.ingest({"a": every, "b": every})
    assert both.count() == 2
    assert S.ingest({"a": every.limit(0)}, seed=every).count() == 2
    moved = S.reanchor(every, NOW + 10 * C.HOUR_MS).agg(F.max("fetched_ms")).first()[0]
    assert moved == NOW + 10 * C.HOUR_MS - 300_000


def test_normalize(spark, tmp_path):
    rows = [("", " http://x.example/a ", " T ", None, "weird", None, None, None), ("i", "http://x.example/b", "", "x", "news", "n", 1, 2), ("k", "http://x.example/c", "U" * 400, "t" * 2000, "official", "n", None, 5)]
    raw = spark.createDataFrame(rows, "id string, url string, title string, text string, source_type string, source_name string, published_ms bigint, fetched_ms bigint")
    got = {r.url: r for r in S.normalize(raw, NOW).collect()}
    assert set(got) == {"http://x.example/a", "http://x.example/c"}
    a, c = got["http://x.example/a"], got["http://x.example/c"]
    assert a.id.startswith("rpt-") and a.source_type == "news" and a.source_name == "X" and a.published_ms == NOW
    assert len(c.title) == 300 and len(c.text) == 1800 and c.published_ms == 5
    assert S.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "m.json").write_text('{"x": ["y", "z"], "y": ["x"]}')
    edges = S.adjacency(spark.createDataFrame([((tmp_path / "m.json").read_text(),)], "json string"))
    assert sorted(map(tuple, edges.collect())) == [("x", "y"), ("x", "z"), ("y", "x")]


def test_decisions(spark):
    items = spark.createDataFrame([(1,), (2,), (3,)], "item bigint")
    tries = spark.createDataFrame([(1, 1, "approved", "  "), (2, 1, "rejected", " Ann "), (3, 1, "approved", "Bo"), (4, 9, "approved", "Bo"), (5, 2, "approved", None)], "seq bigint, item bigint, verdict string, by string")
    state, codes = ledger.decide(items, tries)
    assert sorted(map(tuple, state.collect())) == [(1, "rejected", "Ann", 2), (2, "pending", None, None), (3, "pending", None, None)]
    assert {r.seq: r.code for r in codes.collect()} == {1: 400, 2: 200, 3: 409, 4: 404, 5: 400}


def test_once_and_forbidden(spark):
    have = spark.createDataFrame([("escalation", 1, None), ("ambiguous-match", None, "1::2")], "kind string, entity bigint, fingerprint string")
    new = spark.createDataFrame([(1, "t", "{}"), (2, "t", "{}"), (3, "t", '{"a": {"DispatchTo": 1}}'), (2, "u", "{}")], "entity bigint, title string, evidence string")
    assert [r.entity for r in ledger.new_escalations(new, have).collect()] == [2]
    pairs = spark.createDataFrame([(2, 1), (3, 1), (1, 3)], "a bigint, b bigint")
    assert [r.fingerprint for r in ledger.new_ambiguous(pairs, have).collect()] == ["1::3"]
    schema = T.StructType().add("a", T.ArrayType(T.StructType().add("Orders", "string"))).add("b", "string")
    assert ledger.forbidden_fields(schema) == ["evidence.a[].Orders"]
    assert one(spark, ledger.named_entities(F.lit('{"leftSettlementId": "x", "b": {"entityId": "y"}, "id": "z"}'))) == (["x", "y"],)


def test_shortlist(spark):
    entities = spark.createDataFrame([(1, "B Town", 10), (2, "A", 5), (3, "B Town", 1)], "id bigint, district string, population bigint")
    scope = spark.createDataFrame([(7, 1), (8, None)], "item bigint, entity bigint")
    got = [(r.item, r.jurisdiction, r.entities_in_district, r.in_scope, r.population_in_district) for r in ledger.shortlist(scope, entities).orderBy("item", "district").collect()]
    assert got == [(7, "district-b-town", 2, [1], 11), (8, "district-a", 1, [], 5), (8, "district-b-town", 2, [], 11)]


def test_changes_of_every_key(spark):
    rows = [(1, 1, "a"), (2, 2, "b"), (1, 3, "a"), (2, 4, "b"), (1, 5, "c"), (2, 6, "a")]
    got = ledger.changes(spark.createDataFrame(rows, "who bigint, at bigint, value string"), "who").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "a"), (1, 5, "c"), (2, 2, "b"), (2, 6, "a")]


def test_texts(spark):
    got = one(spark, ledger.hours_text(F.lit(13.44)), ledger.hours_text(F.lit(120.5)), ledger.signed_text(F.lit(-1.0)), ledger.relative_text(F.lit(0), F.lit(30 * 60_000)), ledger.pair_label(F.lit(" "), F.lit("t" * 80), F.lit("n"), "f"))
    assert got == ("13.4h", "121h", "−1.00", "30 min ago", "t" * 69 + "…")


def test_nested_keys(spark):
    """Keys are keys, not words inside values; depth is limited; what is not JSON has none."""
    deep = '{"a":' * 7 + '{"orders": 1}' + "}" * 7
    cases = ['{"note": "\\"orders\\": 1"}', '{"a": [{"Orders": null}]}', deep, "no json", None, '[{"tasking": {}}]']
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "k int, e string")
    assert [r[0] for r in df.orderBy("k").select(ledger.carries_forbidden(F.col("e"))).collect()] == [False, True, False, False, False, True]


def test_keys_against_a_plain_walk(spark):
    """Random nested evidence: the same answers as a recursive walk, and no Python worker in the plan."""
    rng = random.Random(4)

    def make(depth):
        kind = rng.random()
        if depth > 8 or kind < 0.3:
            return rng.choice([1, "x", None, "orders", 2.5, True, "e7", ""])
        if kind < 0.5:
            return [make(depth + 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["a", "b", "c", "OrDers", "leftSettlementId", "entityID", "entityIdx", "é"]) + rng.choice(["", "", "1"]): make(depth + 1) for _ in range(rng.randint(0, 3))}

    def walk(v, depth=0):
        if depth <= ledger.DEEPEST and isinstance(v, list):
            return [x for y in v for x in walk(y, depth + 1)]
        return [x for k, y in v.items() for x in [(k, y), *walk(y, depth + 1)]] if depth <= ledger.DEEPEST and isinstance(v, dict) else []

    cases = [make(0) for _ in range(400)]
    df = spark.createDataFrame([(k, json.dumps(c)) for k, c in enumerate(cases)] + [(1000, "{broken"), (1001, "broken"), (1002, '{"a": 1, "a": 2}')], "k int, e string")
    out = df.select("k", ledger.carries_forbidden(F.col("e")).alias("bad"), ledger.named_entities(F.col("e")).alias("named"))
    got = {r.k: (r.bad, sorted(r.named)) for r in out.collect()}
    assert got.pop(1000) == (True, []) and got.pop(1001) == (False, []) and got.pop(1002) == (True, [])
    for k, c in enumerate(cases):
        seen = walk(c)
        assert got[k] == (any(x.lower() in ledger.FORBIDDEN for x, _ in seen), sorted({v for x, v in seen if isinstance(v, str) and v and x.lower().endswith(("entityid", "settlementid"))}))
    assert sum(b for b, _ in got.values()) > 20 and sum(bool(n) for _, n in got.values()) > 20
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_entity_detail(spark):
    ranked = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "id bigint, name string")
    reports = spark.createDataFrame([(10, 1), (11, 2), (12, 1)], "id bigint, entity bigint")
    clusters = spark.createDataFrame([("c1", None, [10, 11]), ("c2", 1, [12]), ("c3", 2, [11])], "cluster_id string, entity bigint, report_ids array<bigint>")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint")
    items = spark.createDataFrame([("i", 1), ("j", 2)], "item string, entity bigint")
    got = {k: sorted(r[0] for r in v.collect()) for k, v in ledger.entity_detail(1, ranked, reports, clusters, edges, items).items()}
    assert got == {"row": [1], "reports": [10, 12], "clusters": ["c1", "c2"], "neighbours": [2], "ledger": ["i"]}
    assert ledger.entity_detail(9, ranked, reports, clusters, edges, items)["row"].count() == 0


def test_incidents_are_numbered_on(spark, tmp_path):
    path = str(tmp_path / "log")
    assert ledger.incident_log(spark, path).count() == 0
    for base in (0, 10, 0, 10):  # each twice: a replay changes nothing
        ledger.append_incidents(path, spark.createDataFrame([(base + k, "heal", f"m{k}") for k in range(4)], "at bigint, kind string, message string").repartition(3), f"run-{base}")
    assert ledger.incident_log(spark, path).count() == 8
    got = ledger.incident_feed(ledger.incident_log(spark, path), 5).collect()
    assert [(r.at, r.seq) for r in got] == [(13, 8), (12, 7), (11, 6), (10, 5), (3, 4)]


def test_number_texts(spark):
    got = one(spark, ledger.number_text(F.lit(2.345)), ledger.number_text(F.lit(None).cast("double")), ledger.integer_text(F.lit(1234567)), ledger.count_text(F.lit(0)), ledger.rate_text(F.lit(0.000123456)), ledger.rate_text(F.lit(0.0833333)), ledger.number(F.lit(96.0)), ledger.number(F.lit(12.25)))
    assert got == ("2.35", "\u2014", "1,234,567", "0", "1.235e-4 /h", "0.08333 /h", "96", "12.3")


def test_connectors(spark):
    """A search, a listing with a bad article, one without results and one that raises; then the seed."""
    serp = json.dumps({"organic": [{"title": "Flood near Nuwakot displaces many families along the river", "description": "Relief has come.", "link": "http://n.example/1"}]})
    article = f"<h1>Flood reaches Nuwakot</h1><p>{'The river rose over its banks at night. ' * 4}</p>"
    listing = '<a href="/a">Flood in the upper valley goes on</a><a href="/b">Flood warning for tomorrow morning</a><a href="/c">Cricket results of the whole week</a>'
    pages = {"http://s.example/q": serp, "http://l.example/": listing, "http://l.example/a": article, "http://e.example/": "<p>nothing</p>"}

    def fetch(urls):
        rows = [(r.url, pages.get(r.url), None if r.url in pages else "HTTP 500") for r in urls.collect()]
        if any("boom" in u for u, _, _ in rows):
            raise OSError("boom")
        return spark.createDataFrame(rows, "url string, html string, error string")

    every = [S.Connector("search", "news", "serp", ("http://s.example/q",)), S.Connector("list", "official", "listing", ("http://l.example/",)), S.Connector("empty", "news", "listing", ("http://e.example/",)), S.Connector("dead", "news", "serp", ("http://boom.example/",))]
    found, log, said = S.run_connectors(every, fetch, spark, ["nuwakot"], NOW)
    assert {(r.url, r.source_type) for r in found.collect()} == {("http://n.example/1", "news"), ("http://l.example/a", "official")}
    assert {r.name: r.status for r in log.collect()} == {"search": "live", "list": "live", "empty": "degraded", "dead": "down"}
    assert sorted(r.message.split(":")[0] for r in said.collect()) == ["dead failed", "empty returned no usable items", "list"]
    seed = found.drop("connector").limit(1)
    back, log, said = S.run_connectors(every[2:], fetch, spark, ["nuwakot"], NOW, seed)
    assert back.count() == 1 and [r.status for r in log.collect()] == ["live"] and any("offline corpus" in r.message for r in said.collect())


def test_watch(spark, tmp_path):
    assert (stream.poll_seconds(False), stream.poll_seconds(True), stream.poll_seconds(True, 8.0)) == (5.0, 1.2, 8.0)
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(path)
    query = stream.watch(spark.readStream.schema("id bigint").parquet(path), str(tmp_path / "out"), running=True)
    query.processAllAvailable()
    query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 0{k}:00:00", 1) for k in range(3)] + [(9, "2024-01-03 00:00:00", 1), (10, "2024-01-01 05:00:00", 2)]
    df = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint").withColumn("ts", F.to_timestamp("ts"))
    path = str(tmp_path / "events")
    df.coalesce(1).write.parquet(path)
    seen = stream.drain(stream.last_seen(stream.read_events(spark, path)), "seen", "complete").collect()
    assert {r.entity: r.n for r in seen} == {1: 4, 2: 1}
    gone = stream.drain(stream.silence_alerts(stream.read_events(spark, path, "40 days"), 24), "gone", "append").where("gap_hours is not null").collect()
    assert [(r.entity, r.gap_hours) for r in gone] == [(1, 46.0)]
    limits = spark.createDataFrame([(1, 10.0), (3, 1.0)], "entity bigint, expected_gap_hours double")
    own = stream.drain(stream.silence_alerts(stream.with_limits(stream.read_events(spark, path), limits)), "own", "append").collect()
    assert [(r.entity, r.gap_hours) for r in own] == [(1, 46.0)]


def _events(spark, path, rows):
    df = spark.createDataFrame([(k, e, t) for k, (e, t) in enumerate(rows)], "event_id bigint, user_id bigint, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.mode("append").parquet(path)


def test_late_silences_and_restart(spark, tmp_path):
    """A silence whose limit is past when its event comes is told at once, and a restarted query keeps its timers."""
    path = str(tmp_path / "events")

    def run():
        x = stream.drain(stream.silence_alerts(stream.read_events(spark, path, "10 hours"), 2), "late", "append").collect()
        return sorted((r.entity, r.gap_hours is None, r.since // 3_600_000 % 24) for r in x)

    _events(spark, path, [(1, "2024-01-01 00:00:00"), (9, "2024-01-01 11:00:00")])  # watermark: 1 o'clock
    assert run() == []  # entity 1 is silent since 0 and due at 2 o'clock
    _events(spark, path, [(9, "2024-01-01 20:00:00")])  # watermark: 10 o'clock
    assert run() == [(1, True, 0), (9, False, 11)]  # the timer of the first run goes off in the second
    _events(spark, path, [(2, "2024-01-01 11:00:00")])  # in time
    _events(spark, path, [(9, "2024-01-02 04:00:00")])  # watermark: 18 o'clock
    third = run()
    assert (2, True, 11) in third and (9, False, 20) in third
    _events(spark, path, [(3, "2024-01-01 15:30:00"), (9, "2024-01-02 04:10:00")])  # too late for the watermark, as its limit is
    fourth = run()
    assert len([x for x in fourth if x[0] == 1]) == 1 and len([x for x in fourth if x[0] == 2]) == 1  # each silence is told once


def test_late_event_is_told_at_once():
    """The processor on its own: an event that is not behind the watermark, with a limit that is."""

    class Handle:
        timers: list[int] = []
        value = None

        def getValueState(self, *_):  # noqa: N802
            return self

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def listTimers(self):  # noqa: N802
            return iter(list(self.timers))

        def deleteTimer(self, t):  # noqa: N802
            self.timers.remove(t)

        def registerTimer(self, t):  # noqa: N802
            self.timers.append(t)

    class Now:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

    h, p, hour = Handle(), stream.Silence(), 3_600_000
    p.init(h)

    def feed(at, *times):
        frame = pd.DataFrame({"t": [t * hour for t in times], "limit_hours": [2.0] * len(times)})
        return [tuple(r) for f in p.handleInputRows((7,), iter([frame]), Now(at * hour)) for r in f.itertuples(index=False)]

    first = feed(10, 5)
    assert len(first) == 1 and first[0][:2] == (7, 5 * hour) and first[0][2] != first[0][2] and not h.timers  # no gap yet
    assert feed(10, 4) == []  # told already; an earlier event changes nothing
    assert [x[2] for x in feed(10, 9)] == [4.0] and h.timers == [11 * hour]
    assert [x[1] for f in p.handleExpiredTimer((7,), Now(12 * hour), None) for x in f.itertuples(index=False)] == [9 * hour]
    assert feed(12, 9) == [] and [x[2] for x in feed(12, 20)] == [11.0]


class _Store:
    """A state of one key and its timers, which go off as Spark's do: those before the watermark, in order."""

    def __init__(self, processor):
        self.value, self.timers, self.calls, self.processor = None, set(), 0, processor
        processor.init(self)

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.calls = value, self.calls + 1

    def listTimers(self):  # noqa: N802
        return iter(sorted(self.timers))

    def deleteTimer(self, t):  # noqa: N802
        self.timers.remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.timers.add(t)

    def batch(self, key, frame, mark):
        class Now:
            getCurrentWatermarkInMs = staticmethod(lambda: mark)  # noqa: N815

        out = list(self.processor.handleInputRows((key,), iter([frame[:2], frame[2:]]), Now)) if len(frame) else []
        for t in sorted(x for x in self.timers if x < mark):
            out += self.processor.handleExpiredTimer((key,), Now, None)
            self.timers.remove(t)
        return [(r.entity, r.since, None if r.gap_hours != r.gap_hours else r.gap_hours) for f in out for r in f.itertuples(index=False)]


def test_silences_of_a_group_are_those_of_each():
    """Entities that share a key are told the same as each on its own, for one call to the state instead of one each."""
    rng = np.random.default_rng(5)
    alone, group, n = {e: _Store(stream.Silence()) for e in range(-8, 8)}, _Store(stream.Silences()), 0
    for k in range(60):
        mark = max(0, k * 20 - 25) * 3_600_000
        some = rng.permutation(16)[: rng.integers(0, 9)] - 8
        rows = [(int(e), int(t) * 1_800_000, 2.0 + int(e) % 5 * 9.25) for e in some for t in rng.integers(max(0, k * 40 - 100), k * 40 + 40, rng.integers(1, 5))]
        frame = pd.DataFrame(rows, columns=["entity", "t", "limit_hours"]).astype({"entity": "int64", "t": "int64", "limit_hours": "float64"})
        expect = [x for e, s in alone.items() for x in s.batch(e, frame[frame["entity"] == e][["t", "limit_hours"]], mark)]
        got = group.batch(0, frame, mark)
        assert sorted(got, key=str) == sorted(expect, key=str)
        assert len(group.timers) <= 1
        n += len(got)
    assert n > 200 and group.calls * 4 < sum(s.calls for s in alone.values()) * 3


def test_emission_once(spark, tmp_path):
    path = str(tmp_path / "once")
    one_, two = (spark.createDataFrame([(k, s) for k in ks], "user_id bigint, tag string") for ks, s in (((1, 2, 2, None), "a"), ((2, 3), "b")))
    assert stream.emit_once(one_, path, "user_id", 0) and not stream.emit_once(one_, path, "user_id", 0)
    assert stream.emit_once(two, path, "user_id", 0, writer="other") and stream.emit_once(two, path, "user_id", 1)
    got = commits.table(spark, path).collect()
    assert sorted((r.user_id, r.tag, r.seq) for r in got) == [(1, "a", 1), (2, "a", 2), (3, "b", 3)]
    spark.createDataFrame([(9, "z", 1)], "user_id bigint, tag string, place bigint").write.parquet(f"{path}/rows/attempt=crashed")
    assert commits.table(spark, path).count() == 3  # what no commit names is not there


def test_a_faster_writer_is_seen(spark, tmp_path):
    """A commit that another writer overtakes is made again from the table as it is then."""
    path, calls = str(tmp_path / "race"), []
    mine = spark.createDataFrame([(1,), (2,)], "k bigint")

    def rows(have):
        calls.append(have is not None)
        if len(calls) == 1:  # the other writer commits between reading and claiming
            assert commits.commit(spark, path, "theirs", lambda _: spark.createDataFrame([(2,)], "k bigint"))
        return mine if have is None else mine.join(have.select("k"), "k", "left_anti")

    assert commits.commit(spark, path, "mine", rows) and calls == [False, True]
    assert sorted((r.k, r.seq) for r in commits.table(spark, path).collect()) == [(1, 2), (2, 1)]
    assert [(r.version, r.batch, r.rows) for r in commits.log(spark, path).orderBy("version").collect()] == [(1, "theirs", 1), (2, "mine", 1)]


def test_a_page_is_looked_through_once_for_its_date(spark):
    frame = spark.range(1).select(F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("h"))
    plan = frame.select(web.published(F.col("h"), NOW).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("datePublished") == 1 and plan.count("(?:pubdate|") == 1
    texts = ["3 hours ago\n", "ago", " Yesterday ", "an age ago", "7 days ago x", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", web.loose_date(F.col("t"), NOW).alias("d")).orderBy("i").collect()
    assert [r.d for r in got] == [NOW - 3 * C.HOUR_MS, None, NOW - 24 * C.HOUR_MS, None, None, None]


def test_listings_by_status_fold_the_ledger_once(spark):
    plan = open_queries.open_by_status(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 3


def test_stages_of_runs_among_many_incidents(spark):
    rng = random.Random(5)
    incidents = [("degraded-source" if rng.random() < 0.8 else "heal", rng.choice(["a", "b", None]), rng.randrange(0, 1 << rng.randrange(1, 24))) for _ in range(400)]
    runs = [(k, rng.randrange(-5, 1 << rng.randrange(1, 24)), rng.choice([0, 1, 1000, 3_600_000, rng.randrange(1 << 22)])) for k in range(400)]
    some, more = spark.createDataFrame(incidents, "kind string, stage string, at bigint"), spark.createDataFrame(runs, "run bigint, last_at bigint, duration_ms bigint")
    for slack in (0, 3, 2000):
        expect = {(r, s) for r, t, d in runs for k, s, at in incidents if k == "degraded-source" and s and t - d - slack <= at <= t + slack}
        got = [tuple(r) for r in ledger.failed_stages(some, more, slack).collect()]
        assert set(got) == expect and len(got) == len(expect)
    assert not ledger.failed_stages(some.limit(0), more).collect() and not ledger.failed_stages(some, more.limit(0)).collect()
    many = spark.range(60_000).select(F.lit("degraded-source").alias("kind"), F.lit("a").alias("stage"), (F.col("id") * 50).alias("at"))
    long = spark.range(60_000).select(F.col("id").alias("run"), (F.lit(2_900_000) + F.col("id")).alias("last_at"), F.lit(2_800_000).alias("duration_ms"))
    begin = time.monotonic()
    assert ledger.failed_stages(many, long).count() == 60_000
    assert time.monotonic() - begin < 30  # every run meets nearly every incident: 3.4 billion pairs
