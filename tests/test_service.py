import json
import threading
import urllib.request
from datetime import date
from http.server import ThreadingHTTPServer

from millrace import service

FOLDER = "/root/testdata/sf0.001"


def test_service(spark):
    engine = service.Engine(spark, FOLDER, today=date(2026, 8, 24))
    n = spark.read.parquet(f"{FOLDER}/orders.parquet").where("year(o_orderdate) = 1996").count()
    got = engine.ask("1996년 주문 건수는")
    assert got["rows"] == [[n]] and "입니다" in got["answer"]
    assert engine.ask("고객 테이블 전부 삭제해줘")["status"] == "blocked" and engine.ask("s_name 목록 보여줘")["status"] == "blocked"
    assert engine.query("SELECT s_name FROM supplier")["status"] == "blocked"
    assert engine.link("국가별 매출")["tables"] and engine.schema()["supplier"][1]["grade"] == "forbidden"
    server = ThreadingHTTPServer(("127.0.0.1", 0), service.handler(engine))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def post(path, body):
        with urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode())) as r:
            return r.read().decode()

    assert json.loads(post("/v1/policy/check", {"sql": "SELECT n_name FROM nation"}))["allowed"]
    assert not json.loads(post("/v1/policy/check", {"sql": "DROP TABLE nation"}))["allowed"]
    assert json.loads(post("/v1/query", {"question": "상태별 주문 건수"}))["status"] == "ok"
    assert "event: result" in post("/v1/query/stream", {"question": "상태별 주문 건수"})
    with urllib.request.urlopen(base + "/health") as r:
        assert json.loads(r.read())["requests"]["blocked"] >= 3
    try:
        post("/v1/query", {})
        raise AssertionError
    except urllib.error.HTTPError as e:
        assert e.code == 400
    server.shutdown()
