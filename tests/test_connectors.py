import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

from corvane.operators import serving
from corvane.sources import connectors


def test_paged_source_reads_all_pages(spark):
    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            page, size = int(q["page"][0]), int(q["size"][0])
            body = json.dumps([{"id": (page - 1) * size + i, "name": f"n{i}"} for i in range(size)]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        got = connectors.paged(spark, f"http://127.0.0.1:{server.server_port}/rows", 3, "id long, name string", size="4").collect()
    finally:
        server.shutdown()
    assert sorted(r.id for r in got) == list(range(12)) and {r.page for r in got} == {1, 2, 3}


def test_exports_and_result_object(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ('q"x', None)], "name string, n int")
    connectors.write_single(df, f"file://{tmp_path}/csv", "CONFIDENTIAL")
    lines = next(tmp_path.glob("csv/part-*")).read_text().split("\n")
    assert lines[:3] == ["CONFIDENTIAL", "", "name,n"] and set(lines[3:5]) == {'"a","1"', '"q""x",""'}
    connectors.write_object({"rows": df, "none": df.limit(0)}, f"file://{tmp_path}/json")
    assert json.loads(next(tmp_path.glob("json/part-*")).read_text()) == {"rows": [{"name": "a", "n": 1}, {"name": 'q"x'}], "none": []}


def test_demo_fallback_and_quota(spark, tmp_path):
    assert connectors.demo_records(spark, f"file://{tmp_path}/missing.json").count() == 3
    log = spark.createDataFrame([("c", "export_clusters"), ("c", "export_activity"), ("c", "look"), ("d", "export_x")], "client string, action string")
    assert [serving.quota_left(log, x) for x in "cde"] == [1, 2, 3]


def test_summary_names_the_strongest(spark):
    from pyspark.sql import functions as F

    rows = [("auto_link", 0.954, [(0.5, "pan"), (0.01, "weak"), (-0.2, "legal"), (0.3, "name")])]
    df = spark.createDataFrame(rows, "decision string, confidence double, c array<struct<impact: double, sentence: string>>")
    got = df.select(serving.summary(F.col("decision"), F.col("confidence"), F.col("c")).alias("s")).first().s
    assert got.split("\n") == ["✅ AUTO-LINKED with 95.4% confidence.", "These records likely represent the same business because:", "  • pan", "  • name", "Minor factors against match:", "  • legal"]
