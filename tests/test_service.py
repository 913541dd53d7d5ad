"""Caches, the service, the client and the streaming sink."""

import math

import numpy as np
import pytest

from skylode.errors import EngineError, UnsupportedError, ValidationError
from skylode.plans.cache import ExactCache, SemanticCache
from skylode.plans.client import connect
from skylode.plans.query import QueryRequest, SemanticOptions
from skylode.plans.service import Operations, Service
from skylode.sources.table import Store
from skylode.streaming.sink import latest_per_id, upsert_stream


def axis(i, n=8):
    return [1.0 if j == i % n else 0.0 for j in range(n)]


TEXTS = ["the quick brown fox jumps over the lazy dog", "a fast red car drives through the city streets", "the lazy cat sleeps on the warm windowsill", "quick brown bread bakes in the old stone oven"]


@pytest.fixture
def service(spark, tmp_path):
    s = Service(Store.open(spark, f"file://{tmp_path}"))
    yield s
    s.close()


def seed(service, ns="a"):
    service.upsert(ns, [{"id": i + 1, "vector": axis(i), "text": t} for i, t in enumerate(TEXTS)])


def test_modes_before_and_after_indexing(service):
    seed(service)
    near = QueryRequest(vector=axis(0), k=3)
    hit = service.query("a", near).hits[0]
    assert hit.id == 1 and hit.score < 0.01 and hit.vector == axis(0) and hit.ingested_at_micros
    with pytest.raises(UnsupportedError):
        service.query("a", QueryRequest(text="lazy"))
    service.create_fts_index("a")
    service.create_index("a", num_partitions=2)
    text = service.query("a", QueryRequest(text="lazy", k=10)).hits
    assert {h.id for h in text} == {1, 3}
    for include in (True, False):
        both = service.query("a", QueryRequest(vector=axis(0), text="lazy", k=4, include_vector=include)).hits
        assert both[0].id == 1 and (both[0].vector is None) == (not include)
    assert [h.id for h in service.query("a", near).hits] == [1, 2, 3]
    # Rows newer than the indexes are found, replaced ones no more.
    service.upsert("a", [{"id": 9, "vector": axis(5), "text": "a lazy newcomer"}])
    assert service.query("a", QueryRequest(vector=axis(5), k=1)).hits[0].id == 9
    service.upsert("a", [{"id": 1, "vector": axis(6), "text": "busy"}])
    assert {h.id for h in service.query("a", QueryRequest(text="lazy", k=10)).hits} == {3, 9}
    assert service.query("a", QueryRequest(vector=axis(6), k=1)).hits[0].id == 1
    service.compact("a")
    assert {h.id for h in service.query("a", QueryRequest(text="lazy", k=10)).hits} == {3, 9}


def test_multivector_queries(service):
    service.upsert("m", [{"id": 1, "vectors": [axis(0), axis(1)], "text": "x"}, {"id": 2, "vectors": [axis(2), axis(3)], "text": "y"}])
    request = QueryRequest(vectors=[axis(0), axis(1)], k=2)
    hits = service.query("m", request).hits
    assert hits[0].id == 1 and hits[0].score == 2.0 and hits[0].vector is None
    service.create_index("m", num_partitions=2)
    service.create_fts_index("m")
    assert service.query("m", request).hits[0].id == 1
    assert service.query("m", QueryRequest(vectors=[axis(2)], text="y", k=2)).hits[0].id == 2


def test_validation(service):
    # An unknown namespace is empty whatever is asked, but for the semantic cache's rules.
    assert service.query("none", QueryRequest(vector=[1.0], vectors=[[1.0]])).hits == []
    for bad in (SemanticOptions(True, 0.0), SemanticOptions(True, 1.5), SemanticOptions(True, math.nan)):
        with pytest.raises(ValidationError):
            service.query("none", QueryRequest(vector=axis(0), semantic_cache=bad))
    with pytest.raises(ValidationError):
        service.query("none", QueryRequest(text="x", semantic_cache=SemanticOptions()))
    seed(service)
    for bad in (
        QueryRequest(),
        QueryRequest(vector=axis(0), vectors=[]),
        QueryRequest(vector=[1.0]),
        QueryRequest(vectors=[axis(0)]),
        QueryRequest(vector=axis(0), k=0),
        QueryRequest(vector=axis(0), nprobes=0),
        QueryRequest(vector=[math.nan] * 8),
    ):
        with pytest.raises(ValidationError):
            service.query("a", bad)
    with pytest.raises(ValidationError):
        service.create_index("a", kind="hnsw")


def test_results_are_cached_until_a_write(service):
    seed(service)
    request = QueryRequest(vector=axis(0), k=2)
    assert service.query("a", request).source == "backend"
    assert service.query("a", request).source == "exact_cache"
    assert service.query("a", QueryRequest(vector=axis(0), k=2, nprobes=20)).source == "backend"
    service.store.table("a").upsert([{"id": 50, "vector": axis(0), "text": None}])  # past the service
    after = service.query("a", request)
    assert after.source == "backend" and [h.id for h in after.hits] == [1, 50]
    service.delete("a")
    assert service.query("a", request).hits == []


def test_near_duplicate_queries(service):
    service.upsert("s", [{"id": i, "vector": axis(i)} for i in range(8)])
    on = SemanticOptions(True, 0.95)
    first = service.query("s", QueryRequest(vector=axis(0), k=3, semantic_cache=on))
    d = 0.05
    probe = [math.sqrt(1 - d * d), d, *[0.0] * 6]
    again = service.query("s", QueryRequest(vector=probe, k=3, semantic_cache=on))
    assert (first.source, again.source) == ("backend", "semantic_cache") and again.hits == first.hits
    assert service.query("s", QueryRequest(vector=probe, k=3)).source == "backend"
    assert service.query("s", QueryRequest(vector=probe, k=4, semantic_cache=on)).source == "backend"
    service.upsert("s", [{"id": 99, "vector": axis(0)}])
    assert service.query("s", QueryRequest(vector=probe, k=3, semantic_cache=on)).source == "backend"


def test_semantic_cache_rules():
    cache = SemanticCache(entries=2)
    assert cache.lookup("n", 1, [1, 0], (), 0.5) == ("empty", None)
    cache.insert("n", 1, 1, [0, 0], (), "zero")
    cache.insert("n", 1, 2, [1, 0], (), "moved")
    assert cache.lookup("n", 1, [1, 0], (), 0.5) == ("empty", None)
    cache.insert("n", 1, 1, [1, 0], (), "a")
    cache.insert("n", 1, 1, [2, 0], (), "b")
    assert cache.lookup("n", 1, [3, 0], (), 1.0) == ("hit", "a")
    assert cache.lookup("n", 1, [0, 0], (), 0.1) == ("miss", None)
    cache.insert("n", 1, 1, [0, 1], (), "c")
    assert cache.lookup("n", 1, [3, 0], (), 1.0) == ("hit", "b")
    assert cache.lookup("n", 2, [3, 0], (), 0.1) == ("empty", None)


def test_exact_cache_bounds_and_heals():
    cache = ExactCache(capacity=200)
    cache.put("n", 1, "big", np.zeros(1000))
    assert cache.get("n", 1, "big") is None
    for i in range(50):
        cache.put("n", 1, str(i), "x" * 20)
    assert cache.size <= 200 and cache.get("n", 1, "49") == "x" * 20 and cache.get("n", 1, "0") is None
    cache._held[("n", 1, "bad")] = b"broken"
    assert cache.get("n", 1, "bad") is None
    cache.put("n", 1, "bad", 5)
    assert cache.get("n", 1, "bad") == 5


def test_background_operations(service):
    seed(service)
    key, done = service.submit("create_fts_index", "a")
    done.result()
    assert service.operations.get(key).status == "succeeded"
    key, done = service.submit("create_index", "none")
    with pytest.raises(ValidationError):
        done.result()
    assert "no data" in service.operations.get(key).error
    ops = Operations(kept=3)
    running = ops.start("x", "n")
    keys = [ops.start("x", "n") for _ in range(5)]
    for k in keys:
        ops.finish(k, RuntimeError("secret"))
    assert ops.get(running).status == "running" and ops.get(keys[0]) is None and ops.get(keys[-1]).error == "operation failed"
    assert keys[0].startswith("op_") and keys[0][17] == "7"


def test_warmup(service):
    seed(service)
    assert service.warmup("a", [QueryRequest(vector=axis(0))]) == 1
    assert service.query("a", QueryRequest(vector=axis(0))).source == "exact_cache"
    with pytest.raises(ValidationError, match="1 of 2"):
        service.warmup("a", [QueryRequest(vector=[1.0]), QueryRequest(vector=axis(1))])
    assert service.query("a", QueryRequest(vector=axis(1))).source == "exact_cache"


def test_client(spark, tmp_path):
    client = connect(str(tmp_path), spark=spark)
    docs = client.collection("docs")
    docs.upsert([{"id": 10, "vector": axis(0), "text": "red fox"}], tenant="acme")
    docs.upsert([{"id": 20, "vector": axis(0), "text": "red car"}], tenant="globex")
    assert [h.id for h in docs.search(vector=axis(0), tenant="acme")] == [10]
    assert [h.id for h in docs.search(text="red", tenant="globex")] == [20]
    docs.add([{"id": 21, "vector": axis(1), "text": "red dog"}], tenant="globex")
    assert {h.id for h in docs.search(text="red", tenant="globex")} == {20, 21}
    assert docs.search(vector=axis(0)) == [] and docs.search(text="x") == []
    assert docs.info(tenant="acme").row_count == 1
    with pytest.raises(ValidationError):
        docs.upsert([{"id": 1, "vector": axis(0), "colour": "red"}])
    with pytest.raises(UnsupportedError):
        docs.delete(ids=[10], tenant="acme")
    assert docs.delete(tenant="acme") > 0 and docs.info(tenant="acme") is None
    client.close()
    client.close()
    with pytest.raises(EngineError, match="closed"):
        docs.search(vector=["nonsense"])


def test_stream_upserts(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "id long, vector array<float>, text string, n int"
    spark.createDataFrame([(1, axis(0), "old", 1), (1, axis(1), "new", 2), (2, axis(2), None, 1)], schema).write.parquet(source)
    table = Store.open(spark, f"file://{tmp_path}/store").table("s")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(schema).parquet(source)
        upsert_stream(stream, table, str(tmp_path / "checkpoint"), "n").awaitTermination(60)
    assert sorted((r["id"], r["text"]) for r in table.read().collect()) == [(1, "new"), (2, None)]
    assert latest_per_id(table.read().select("id", "text")).count() == 2
