"""The HTTP surface: routes, tiers, limits, imports, metrics."""

import http.client
import io
import json
import threading

import pyarrow as pa
import pytest

from skylode.plans.access import Keys, Limiter, Refused
from skylode.plans.cache import ExactCache
from skylode.plans.http import ARROW_STREAM, ASK_SOURCE, TELL_SOURCE, Gateway, Request, serve
from skylode.plans.metrics import Metrics
from skylode.plans.service import Service
from skylode.sources.table import Store


def axis(i, n=8):
    return [1.0 if j == i % n else 0.0 for j in range(n)]


@pytest.fixture
def service(spark, tmp_path):
    s = Service(Store.open(spark, f"file://{tmp_path}/store"))
    yield s
    s.close()


def call(gateway, method, path, body=None, key=None, **more):
    headers = {k.replace("_", "-"): v for k, v in more.items()}
    if key:
        headers["authorization"] = f"Bearer {key}"
    raw = body if isinstance(body, bytes) else json.dumps(body).encode() if body is not None else b""
    path, _, query = path.partition("?")
    answer = gateway.handle(Request(method, path, headers, io.BytesIO(raw), dict(p.split("=") for p in query.split("&") if p), "1.2.3.4"))
    return answer.status, json.loads(answer.body) if answer.headers.get("content-type") == "application/json" else answer.body.decode(), answer.headers


def done(gateway, accepted):
    """The end of a background operation."""
    for future in list(gateway.futures):
        future.exception()
    return call(gateway, "GET", f"/operations/{accepted['operation_id']}")[1]


@pytest.fixture
def gateway(service):
    g = Gateway(service)
    g.futures = []
    submit = service.submit

    def kept(*args, **options):
        key, future = submit(*args, **options)
        g.futures.append(future)
        return key, future

    service.submit = kept
    return g


def test_rows_and_queries(gateway):
    rows = [{"id": i, "vector": axis(i), "text": f"word{i} all"} for i in range(5)]
    assert call(gateway, "POST", "/ns/a/upsert", {"rows": rows})[:2] == (200, {"upserted": 5})
    ask = {"vector": axis(2), "k": 2}
    status, found, headers = call(gateway, "POST", "/ns/a/query", ask, **{ASK_SOURCE: "1"})
    assert status == 200 and found["results"][0]["id"] == 2 and headers[TELL_SOURCE] == "backend"
    assert call(gateway, "POST", "/ns/a/query", ask, **{ASK_SOURCE: "yes"})[2][TELL_SOURCE] == "exact_cache"
    assert TELL_SOURCE not in call(gateway, "POST", "/ns/a/query", ask)[2]
    assert call(gateway, "POST", "/ns/a/query", {"text": "all"})[0] == 501
    status, accepted, _ = call(gateway, "POST", "/ns/a/fts-index")
    assert status == 202 and accepted["status"] == "running"
    assert done(gateway, accepted)["status"] == "succeeded"
    assert len(call(gateway, "POST", "/ns/a/query", {"text": "all", "k": 10})[1]["results"]) == 5
    page = call(gateway, "GET", "/ns/a/list?limit=2")[1]
    assert [r["id"] for r in page["rows"]] == [4, 3]
    rest = call(gateway, "GET", f"/ns/a/list?limit=9&cursor={page['next_cursor']}")[1]
    assert [r["id"] for r in rest["rows"]] == [2, 1, 0] and rest["next_cursor"] is None
    assert call(gateway, "GET", "/ns/a")[1]["row_count"] == 5 and call(gateway, "GET", "/ns/none")[0] == 404
    status, accepted, _ = call(gateway, "POST", "/ns/a/warmup", {"queries": [{"vector": axis(0)}]})
    assert status == 202 and accepted["queued"] == 1 and done(gateway, accepted)["status"] == "succeeded"
    for path, body in (("index", {"num_partitions": 2}), ("scalar-index", {}), ("compact", None)):
        assert done(gateway, call(gateway, "POST", f"/ns/a/{path}", body)[1])["status"] == "succeeded"
    assert call(gateway, "POST", "/ns/a/index", {"kind": "hnsw"})[0] == 400
    assert done(gateway, call(gateway, "POST", "/ns/none/index", {"kind": "ivf_pq"})[1])["status"] == "failed"
    assert call(gateway, "DELETE", "/ns/a")[1]["objects_deleted"] > 0
    assert call(gateway, "GET", "/operations/none")[0] == 404


def test_what_is_wrong_is_told(gateway):
    for path, body in (
        ("upsert", b"{"),
        ("upsert", {"rows": 5}),
        ("upsert", {"rows": [{"id": 1}]}),
        ("upsert", {"lines": []}),
        ("query", {"vector": "x"}),
        ("query", {"k": True, "vector": axis(0)}),
        ("query", {"colour": 1}),
        ("warmup", {"queries": [5]}),
    ):
        assert call(gateway, "POST", f"/ns/a/{path}", body)[0] == 400, (path, body)
    assert call(gateway, "POST", "/ns/A_b/upsert", {"rows": []})[0] == 400
    assert call(gateway, "GET", "/ns/a/list?limit=x")[0] == 400
    assert call(gateway, "GET", "/ns/a/upsert")[0] == 405 and call(gateway, "GET", "/elsewhere")[0] == 404
    gateway.max_body = 10
    assert call(gateway, "POST", "/ns/a/upsert", {"rows": [{"id": 1, "vector": axis(0)}]})[0] == 413


def test_imports(gateway):
    schema = pa.schema([("id", pa.uint64()), ("vector", pa.list_(pa.float32(), 8))])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_batch(pa.record_batch([pa.array([1, 1], pa.uint64()), pa.array([axis(0), axis(1)], schema.field(1).type)], schema=schema))
    raw = sink.getvalue()
    post = lambda body, kind=ARROW_STREAM: call(gateway, "POST", "/ns/i/import", body, content_type=kind)
    assert post(raw, "application/json")[0] == 415
    assert post(b"nonsense")[0] == 400
    status, accepted, _ = post(raw)
    assert status == 202 and done(gateway, accepted)["status"] == "succeeded"
    assert call(gateway, "GET", "/ns/i")[1]["row_count"] == 2
    assert done(gateway, post(raw[:-30], "application/octet-stream; x=1")[1])["status"] == "failed"
    gateway.max_import = 10
    assert post(raw)[0] == 413


def test_tiers_and_limits(service):
    clock = [0.0]
    g = Gateway(service, Keys(write="w", admin="a", metrics="m"), Limiter(1, 2, lambda: clock[0]))
    assert call(g, "GET", "/health")[1] == "ok"
    assert call(g, "GET", "/ns/x")[0] == 401 and call(g, "GET", "/ns/x", key="b")[0] == 401
    assert call(g, "DELETE", "/ns/x", key="w")[0] == 403 and call(g, "DELETE", "/ns/x", key="a")[0] == 200
    assert call(g, "GET", "/metrics", key="w")[0] == 401 and call(g, "GET", "/metrics")[0] == 401
    assert [call(g, "GET", "/ns/x", key="w")[0] for _ in range(4)] == [404, 404, 429, 429]
    assert call(g, "GET", "/ns/x", key="w")[2]["retry-after"] == "1"
    clock[0] += 1
    assert call(g, "GET", "/ns/x", key="w")[0] == 404
    text = call(g, "GET", "/metrics", key="m")[1]
    for reason, n in (("missing", 2), ("invalid", 2), ("forbidden", 1), ("rate_limited", 3)):
        assert f'skylode_auth_rejections_total{{reason="{reason}"}} {n}' in text
    one = Gateway(service, Keys(write="w"))
    assert call(one, "DELETE", "/ns/x", key="w")[0] == 200 and call(one, "GET", "/metrics")[0] == 200
    by_address = Gateway(service, per_address=Limiter(1, 1, lambda: 0.0))
    assert [call(by_address, "GET", "/ns/x")[0] for _ in range(2)] == [404, 429]
    with pytest.raises(Refused):
        Keys(admin="").caller("write", "Bearer ", "")


def test_metrics_text():
    m = Metrics("p")
    m.count("cache_hits_total", 'a"b')
    m.observe("query_duration_seconds", 0.002, "n", "fts")
    m.observe("query_duration_seconds", 1e9, "n", "fts")
    m.set("cached_handles", 3)
    text = m.exposition()
    assert 'p_cache_hits_total{namespace="a\\"b"} 1' in text and "p_cached_handles 3" in text
    assert 'p_query_duration_seconds_bucket{namespace="n",query_type="fts",le="0.005"} 1' in text
    assert 'p_query_duration_seconds_bucket{namespace="n",query_type="fts",le="+Inf"} 2' in text
    assert 'p_query_duration_seconds_count{namespace="n",query_type="fts"} 2' in text
    assert m.value("query_duration_seconds", "n", "fts") == 2


def test_results_go_to_disk_and_come_back(tmp_path):
    (tmp_path / "old.result").write_bytes(b"x")
    cache = ExactCache(capacity=100, spill=str(tmp_path), disk=1000)
    assert not (tmp_path / "old.result").exists()
    for i in range(20):
        cache.put("n", 1, str(i), "x" * 40)
    assert cache.size <= 100 and cache.disk_size <= 1000 and len(list(tmp_path.iterdir())) == len(cache._files)
    assert cache.get("n", 1, "17") == "x" * 40 == cache.get("n", 1, "19") and cache.get("n", 1, "0") is None
    cache.put("n", 1, "17", "new")
    assert cache.get("n", 1, "17") == "new"


def test_over_a_socket(service):
    server = serve(Gateway(service), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        link = http.client.HTTPConnection(*server.server_address)
        link.request("POST", "/ns/s/upsert", json.dumps({"rows": [{"id": 7, "vector": axis(3)}]}))
        assert json.loads(link.getresponse().read()) == {"upserted": 1}
        link.request("POST", "/ns/s/query", json.dumps({"vector": axis(3), "k": 1}))
        assert json.loads(link.getresponse().read())["results"][0]["id"] == 7
        link.request("GET", "/ns/s/list?limit=5&order=asc")
        assert [r["id"] for r in json.loads(link.getresponse().read())["rows"]] == [7]
    finally:
        server.shutdown()
        server.server_close()
