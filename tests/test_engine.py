"""A whole pass, the isolation of its stages, and fetching with retries."""

import hashlib
import http.server
import json
import threading

import pytest

from tacet import config as C
from tacet.operators import increments
from tacet.plans import engine
from tacet.sources import commits, fetch
from tacet.streaming import cadence

H = C.HOUR_MS


def _tables(spark):
    entities = spark.createDataFrame([(i, f"E{i}", "D", 2, 10_000) for i in range(20)], "id bigint, name string, district string, hazard_tier int, population bigint")
    rows = [(i * 10 + k, i, C.NOW_MS - ((30 if i == 10 else 1) + 3 * k) * H, "news", "", hashlib.sha256(str(i * 10 + k).encode()).hexdigest()) for i in range(19) for k in range(3)]
    reports = spark.createDataFrame(rows, "id bigint, entity bigint, t bigint, source_type string, title string, text string")
    edges = spark.createDataFrame([(i, j) for i in range(20) for j in (i - 1, i + 1) if 0 <= j < 20], "src bigint, dst bigint")
    return reports, entities, edges


def test_pass(spark):
    done = engine.run(*_tables(spark))
    assert {k for k, _, _ in done.incidents} == {"cold-start"}
    items = done.new_items.collect()
    assert "e-10" in {r.item for r in items}
    assert done.ranked.where("id = 10").first().anomaly_type == "solo-anomaly"
    assert engine.stats(done, spark.createDataFrame([("a", "pending"), ("b", "approved"), ("c", "pending"), ("d", "pending")], "item string, status string")).first().asDict() == {"report_count": 57, "ranked_count": 20, "cluster_count": done.clusters.count(), "pending_count": 3}
    again = engine.run(*_tables(spark), held=done.new_items)
    assert again.new_items.count() == 0


def test_passes_over_batches(spark):
    """Passes that each take some new reports end with the linkage and ranking of one pass over all."""
    reports, entities, edges = _tables(spark)
    near = spark.createDataFrame([(900 + k, k % 4, C.NOW_MS - (1 + k % 3) * H, "news", "", "the same words of the same report") for k in range(9)], reports.schema)
    reports = reports.unionByName(near)
    whole = engine.run(reports, entities, edges)
    done = engine.run(reports.where("id % 2 = 0"), entities, edges, before=increments.begin(reports.limit(0), edges))
    done = engine.run(reports.where("id % 2 = 1"), entities, edges, before=done.linked)
    assert not [i for i in done.incidents if i[0] == "degraded-source"] and done.reports.count() == reports.count()
    for name in ("clusters", "ranked", "new_items"):
        assert sorted(map(str, getattr(done, name).collect())) == sorted(map(str, getattr(whole, name).collect()))
    assert whole.clusters.count() < reports.count()


def test_a_pass_with_an_outside_classifier(spark):
    reports, entities, edges = _tables(spark)
    flood = spark.createDataFrame([(900 + k, None, C.NOW_MS - H, "news", "", f"the flood took the road {k}") for k in range(8)], reports.schema)
    gazetteer = spark.createDataFrame([(1, "Thanedble", [])], "id bigint, name string, aliases array<string>")
    seen = []

    def ask(report, offered):
        seen.append(report["id"])
        if report["id"] == 901:
            raise ValueError("no answer")
        return {"category": "hazard-signal", "confidence": 0.6, "why": "a flood"}

    done = engine.run(reports.unionByName(flood), entities, edges, gazetteer=gazetteer, classifier=ask)
    assert sorted(seen) == [900, 901, 902, 903, 904, 905]
    assert {m for k, s, m in done.incidents if k == "llm-fallback"} == {"1 reports were not classified: error: no answer", "2 reports were not classified: budget"}
    got = {r.id: (r.confidence, r.matched_on) for r in done.reports.where("id >= 900").collect()}
    assert got[900] == (0.6, "llm:unresolved") and got[901] == got[907] == (0.3, None)
    plain = engine.run(flood, entities, edges, gazetteer=gazetteer)
    assert ("llm-fallback", "triage", "8 reports need an outside classifier") in plain.incidents


def test_a_failing_stage(spark):
    reports, entities, edges = _tables(spark)
    done = engine.run(reports.drop("text"), entities, edges)
    assert ("degraded-source", "linkage") in {(k, s) for k, s, _ in done.incidents} and done.ranked.count() == 20


def test_retry():
    calls, slept = [], []

    def fail():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return "page"

    assert fetch.with_retry(fail, sleep=slept.append) == ("page", None, 3) and slept == [0.5, 1.5]
    text, error, n = fetch.with_retry(lambda: 1 / 0, sleep=lambda _: None)
    assert (text, n) == (None, 3) and error.startswith("ZeroDivisionError")


def test_page_source(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 500)
            self.end_headers()
            self.wfile.write(b"x" * 50)

        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({**asked, "as": self.headers["Authorization"], "pad": "x" * 40}).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(fetch.PageSource)
    got = {r.url: r for r in spark.read.format("tacet_pages").option("targets", json.dumps([f"{base}/ok", f"{base}/bad"])).option("waits", "[0.01]").load().collect()}
    posted = spark.read.format("tacet_pages").option("targets", '["http://far.example/"]').option("endpoint", base).option("zone", "z1").option("token", "t").load().first()
    server.shutdown()
    assert {k: v for k, v in json.loads(posted.html).items() if k != "pad"} == {"zone": "z1", "url": "http://far.example/", "format": "raw", "as": "Bearer t"}
    assert got[f"{base}/ok"].status == "live" and got[f"{base}/ok"].attempts == 1
    assert got[f"{base}/bad"].status == "degraded" and got[f"{base}/bad"].html is None and got[f"{base}/bad"].attempts == 2


def test_pages_are_polled_once_per_interval(spark, tmp_path):
    visits = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            visits.append(self.path)
            self.send_response(200 if self.path != "/bad" else 500)
            self.end_headers()
            self.wfile.write(b"x" * 50)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    targets = [f"http://127.0.0.1:{server.server_port}{p}" for p in ("/a", "/b", "/bad")]
    path = f"{tmp_path}/pages"

    def visit(seconds):
        query = cadence.watch_pages(spark, targets, path, seconds, once=True, waits="[]")
        query.awaitTermination(90)
        assert query.exception() is None

    forever = 10.0**9  # one interval for two triggers
    visit(forever)
    assert sorted(visits) == ["/a", "/b", "/bad"]
    visit(forever)
    assert len(visits) == 3
    rows = commits.table(spark, path).collect()
    assert sorted((r.url, r.status, r.html is None, r.seq) for r in rows) == [(u, "degraded" if k == 2 else "live", k == 2, k + 1) for k, u in enumerate(targets)]
    visit(1.0)  # a later interval of the same stream
    assert sorted(visits) == sorted(["/a", "/b", "/bad"] * 2) and commits.table(spark, path).count() == 6
    assert commits.log(spark, path).count() == 2
    server.shutdown()

    stream = fetch.PageStream({"targets": json.dumps(targets), "interval": "60"})
    assert stream.partitions(stream.initialOffset(), stream.latestOffset()) and not stream.partitions({"interval": 7}, {"interval": 7})
    stream.partitions({"interval": 10**12}, {"interval": 10**12})  # a restart with a clock that has gone back
    assert stream.latestOffset() == {"interval": 10**12}
    with pytest.raises(ValueError):
        fetch.PageStream({"interval": "0"})


def test_release(spark):
    from tacet.sources import shared

    one = shared.keep(spark.range(3))
    two = shared.keep(spark.range(4))
    a, b = shared.kept_tables()[-2:]
    shared.release(spark, [a, b], two.where("id > 1"))
    assert a not in shared.kept_tables() and b in shared.kept_tables() and two.count() == 4
    shared.release(spark, [b])
    assert b not in shared.kept_tables() and one is not two
