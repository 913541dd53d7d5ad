"""What a write touches, what a search reads, and that indexes outlive both."""

import io
import threading

import numpy as np
import pytest

from skylode.errors import ValidationError
from skylode.operators import search
from skylode.plans.client import connect
from skylode.plans.query import Planner, QueryRequest
from skylode.plans.service import Service
from skylode.sources import manifest
from skylode.sources import table as table_module
from skylode.sources.scan import spread
from skylode.sources.table import Store


@pytest.fixture
def service(spark, tmp_path):
    s = Service(Store.open(spark, f"file://{tmp_path}"))
    yield s
    s.close()


def axis(i, n=8):
    return [1.0 if j == i % n else 0.0 for j in range(n)]


def many(spark, n, start=0, text="'word ' || id"):
    return spark.range(start, start + n).selectExpr("id", "array(float(id % 7), float(id % 11), float(id), float(1)) AS vector", f"{text} AS text")


def test_an_upsert_rewrites_only_the_files_it_meets(service, spark, monkeypatch):
    monkeypatch.setattr(table_module, "TARGET_ROWS", 2000)
    t = service.store.table("files")
    t.append(many(spark, 20_000))
    t.compact()
    before = {f.path: f for f in t.data_files(t.manifest())}
    assert len(before) >= 10 and sum(f.rows for f in before.values()) == 20_000
    t.upsert([{"id": 77, "vector": [0.0] * 4, "text": "new"}])
    after = {f.path: f for f in t.data_files(t.manifest())}
    gone, added = set(before) - set(after), set(after) - set(before)
    assert len(gone) == 1 and sorted(after[p].rows for p in added) == [1, before[gone.pop()].rows - 1]
    assert t.info().row_count == 20_000 == t.read().select("id").distinct().count()
    # Wide batches are joined, not listed; rows of several commits keep their versions.
    monkeypatch.setattr(table_module, "LISTED_IDS", 10)
    t.upsert(many(spark, 3000, 18_500, "'again'"))
    assert t.info().row_count == 21_500 == t.read().count() and t.read().filter("text = 'again'").count() == 3000
    t.upsert(many(spark, 200, 18_400, "'third'"))
    assert t.read().filter("text = 'third'").count() == 200 and t.read().filter("text = 'again'").count() == 2900
    assert len({f.version for f in t.data_files(t.manifest())}) == 4


def test_a_commit_writes_what_it_changes(service, spark, monkeypatch):
    monkeypatch.setattr(manifest, "MAX_SEGMENTS", 6)
    monkeypatch.setattr(manifest, "SEGMENT_FILES", 4)
    t = service.store.table("segments")
    for i in range(12):
        t.append(many(spark, 10, 10 * i).coalesce(1))
    m = t.manifest()
    assert m.fragments == 12 and len(m.segments) <= 7 and max(s.files for s in m.segments) <= 4
    assert t.read().select("id").distinct().count() == 120 == m.rows


def test_concurrent_upserts(service, spark):
    failures = []

    def write(w):
        try:
            service.store.table("w").upsert([{"id": 100 * w + i, "vector": axis(i), "text": str(w)} for i in range(100)])
            service.store.table("w").upsert([{"id": 5000, "vector": axis(w), "text": str(w)}])
        except Exception as e:
            failures.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(8)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    t = service.store.table("w")
    assert not failures and t.info().row_count == 801 == t.read().select("id").distinct().count() == t.read().count()


def scores(hits):
    return sorted((h.id, h.text, round(h.score, 9)) for h in hits)


def test_index_and_scan_agree_on_repeated_ids_and_after_upserts(service, spark):
    rows = [(1, "fox dog"), (1, "fox cat"), (2, "fox ox"), (3, "hen"), (1, "fox dog"), (5, None)]
    t = service.store.table("x")
    t.append(spark.createDataFrame([(i, axis(i), s) for i, s in rows], "id long, vector array<float>, text string"))
    ask = QueryRequest(text="fox", k=10)

    def scan():
        return sorted((r["id"], r["text"], round(r["score"], 9)) for r in search.bm25(t.read(), "fox hen", 10).collect())

    def index():
        return scores(service.query("x", QueryRequest(text="fox hen", k=10)).hits)

    t.create_fts_index()
    assert len(service.query("x", ask).hits) == 4
    assert index() == scan()
    t.upsert([{"id": 2, "vector": axis(2), "text": "hen hen"}, {"id": 9, "vector": axis(1), "text": "fox"}])
    assert index() == scan()
    t.upsert([{"id": 1, "vector": axis(1), "text": "no more of it"}])
    assert index() == scan()
    assert len(t.manifest().indexes["fts"]["parts"]) == 1
    t.compact()
    assert t.fresh_files(t.manifest(), t.manifest().indexes["fts"]) == [] and index() == scan()
    t.upsert([{"id": 9, "vector": axis(1), "text": "hen"}])
    assert index() == scan()


def test_vector_index_outlives_upserts(service, spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(600, 8)).astype(np.float32)
    t = service.store.table("v")
    t.append(spark.createDataFrame([(i, v.tolist(), None) for i, v in enumerate(x)], "id long, vector array<float>, text string"))
    service.create_index("v", num_partitions=5)
    moved = {i: (x[i] + 3).tolist() for i in range(0, 600, 50)}

    def check():
        for q in (x[0], x[0] + 3, x[77]):
            exact = [(h["id"], round(h["score"], 6)) for h in search.knn(t.read(), q.tolist(), 5).collect()]
            plan = Planner(t, t.manifest()).near(QueryRequest(vector=q.tolist(), nprobes=5), 5)
            assert [(h["id"], round(h["score"], 6)) for h in plan.collect()] == exact
            assert "PartitionFilters" in plan._jdf.queryExecution().executedPlan().toString()

    check()
    t.upsert([{"id": i, "vector": v} for i, v in moved.items()])
    check()
    t.compact()
    assert len(t.manifest().indexes["vector"]["parts"]) == 2
    check()
    t.upsert([{"id": 0, "vector": x[1].tolist()}])
    check()


def test_probing_every_partition_is_exact(service, spark):
    """Coarse codes, so that many rows are as close by them as the nearest ones."""
    r = np.random.default_rng(1)
    x = r.normal(size=(4000, 8)).astype(np.float32)
    t = service.store.table("w")
    t.append(spark.createDataFrame([(i, v.tolist(), "fox") for i, v in enumerate(x)], "id long, vector array<float>, text string"))
    t.create_index(num_partitions=3, num_sub_vectors=2, num_bits=4)
    t.upsert([{"id": 9, "vector": x[0].tolist(), "text": "fox"}])
    x[9] = x[0]
    for q in x[:5]:
        order = np.lexsort((np.arange(len(x)), ((x.astype(float) - q) ** 2).sum(axis=1)))
        for nprobes in (3, None):
            assert [h.id for h in service.query("w", QueryRequest(vector=q.tolist(), k=30, nprobes=nprobes)).hits] == order[:30].tolist()


def test_copies_of_an_id_are_ranked_as_they_were_stored(service, spark):
    t = service.store.table("c")
    for text in ("fox", "fox hen hen"):
        t.append(spark.createDataFrame([(i, [float(i), 1.0], text) for i in range(8)], "id long, vector array<float>, text string"))
    t.create_fts_index()
    hits = service.query("c", QueryRequest(vector=[0.0, 1.0], text="fox", k=16)).hits
    # By vector: 0, its copy, 1, its copy; by text: the eight short ones, then the copies.
    expected = sorted((i, ["fox", "fox hen hen"][c], round(1 / (61 + 2 * i + c) + 1 / (61 + i + 8 * c), 9)) for i in range(8) for c in (0, 1))
    assert sorted((h.id, h.text, round(h.score, 9)) for h in hits) == expected


def test_many_replaced_rows_build_the_index_anew(service, spark):
    t = service.store.table("r")
    t.append(many(spark, 100))
    service.create_index("r", num_partitions=2)
    t.upsert(many(spark, 60, 0, "'again'"))
    t.compact()
    assert len(t.manifest().indexes["vector"]["parts"]) == 1 and not t.manifest().replaced or t.manifest().indexes["vector"]["parts"][0]["upto"] >= 3
    assert t.fresh_files(t.manifest(), t.manifest().indexes["vector"]) == []


def test_multivector_index_reads_the_best_rows_alone(service, spark):
    rows = [{"id": 1, "vectors": [axis(0), axis(1)]}, {"id": 2, "vectors": [axis(2), axis(3)]}] + [{"id": 100 + i, "vectors": [axis(i)]} for i in range(300)]
    service.upsert("m", rows)
    request = QueryRequest(vectors=[axis(0), axis(1)], k=3)
    service.create_index("m", num_partitions=4)
    assert service.query("m", request).hits[0].id == 1
    service.upsert("m", [{"id": 2, "vectors": [axis(0), axis(1), axis(4)]}, {"id": 1, "vectors": [axis(6)]}])
    assert service.query("m", request).hits[0].id == 2


def test_hits_are_fetched_from_the_files_of_their_ids(service, spark, monkeypatch):
    monkeypatch.setattr(table_module, "TARGET_ROWS", 1000)
    t = service.store.table("f")
    t.append(many(spark, 8000))
    t.compact()
    read = t.fetch(t.manifest(), [5, 7])
    assert len(read.inputFiles()) == 1 and sorted(r["id"] for r in read.collect()) == [5, 7]
    assert "In(id" in read._jdf.queryExecution().executedPlan().toString()


def test_pages_read_the_files_they_can_come_from(service, spark):
    t = service.store.table("p")
    for i in range(6):
        t.append(many(spark, 20, 20 * i).coalesce(1))
    m = t.manifest()
    assert len(t.page_files(m, 11, "desc", None)) == 1 and len(t.page_files(m, 11, "asc", None)) == 1
    page = t.list(30)
    assert [r.id for r in page.rows] == list(range(119, 89, -1))
    assert [r.id for r in t.list(30, cursor=page.next_cursor).rows] == list(range(89, 59, -1))


def test_texts_are_split_once(spark):
    rows = spark.createDataFrame([(1, "the fox and the ox")], "id long, text string")
    for found in (search.bm25(rows, "the fox and", 5), search.bm25(rows, "fox", None), search.postings(rows)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("split(") == 1, plan


def test_postings_need_no_shuffle(spark):
    rows = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None), (4, "a")], "id long, text string")
    found = search.postings(rows)
    assert sorted((r["term"], r["id"], r["tf"], r["dl"]) for r in found.collect()) == [("a", 1, 1, 3), ("a", 4, 1, 1), ("b", 1, 2, 3)]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_imports_are_bounded_by_bytes(service, spark, tmp_path):
    import pyarrow as pa

    schema = pa.schema([("id", pa.uint64()), ("vector", pa.list_(pa.float32(), 8))])
    path = str(tmp_path / "rows.arrow")
    with pa.OSFile(path, "wb") as sink, pa.ipc.new_stream(sink, schema) as out:
        for i in range(6):
            out.write_batch(pa.record_batch([pa.array([2 * i, 2 * i + 1], pa.uint64()), pa.array([axis(i), axis(i)], schema.field(1).type)], schema=schema))
    with connect(str(tmp_path / "store"), spark=spark) as client:
        docs = client.collection("docs")
        assert docs.import_arrow(path) == 12
        with open(path, "rb") as file:
            assert docs.import_arrow(file) == 12
        with pytest.raises(ValidationError):
            docs.import_arrow(path, max_bytes=100)
        assert docs.info().row_count == 24 and docs.info().table_version == 2
    t = service.store.table("b")
    with open(path, "rb") as file:
        assert t.import_arrow(io.BytesIO(file.read()), batch_bytes=1) == 12
    assert t.info().table_version == 1 and t.info().fragment_count >= 6


def test_wide_vectors_and_ties(spark):
    r = np.random.default_rng(3)
    x = np.repeat(r.normal(size=(50, 200)).astype(np.float32), 4, axis=0)
    df = spark.createDataFrame([(199 - i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "id long, vector array<float>")
    for metric in ("l2", "cosine"):
        y, q = x.astype(float), x[8].astype(float)
        d = ((y - q) ** 2).sum(axis=1) if metric == "l2" else 1 - y @ q / np.linalg.norm(y, axis=1) / np.linalg.norm(q)
        expected = sorted(zip(np.round(d, 6).tolist(), range(199, -1, -1)))[:6]
        found = search.knn(df, x[8].tolist(), 6, metric=metric, digits=6).collect()
        assert [h["id"] for h in found] == [i for _, i in expected]


def test_small_scans_are_dealt_out(spark, tmp_path):
    spark.range(5000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    dealt = spread(one)
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) == 2 * spark.sparkContext.defaultParallelism and min(sizes) > 0 and sum(sizes) == 5000
    assert spread(dealt.limit(10)).count() == 10
