"""Search operators on small fixtures and against SQL."""

import math

import numpy as np
import pytest

from skylode.errors import ValidationError
from skylode.functions.text import query_terms
from skylode.operators import ivf, metrics, search


def axis(i, n=8):
    return [1.0 if j == i else 0.0 for j in range(n)]


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["the quick brown fox jumps over the lazy dog", "a fast red car drives through the city streets", "the lazy cat sleeps on the warm windowsill", "quick brown bread bakes in the old stone oven", None]
    return spark.createDataFrame([(i + 1, axis(i), t) for i, t in enumerate(texts)], "id long, vector array<float>, text string").cache()


def ids(df):
    return [r["id"] for r in df.collect()]


def test_knn(rows, spark):
    assert ids(search.knn(rows, axis(0), 3)) == [1, 2, 3]
    assert search.knn(rows, axis(0), 1).first()["score"] == 0
    assert ids(search.knn(rows, axis(2), 2, metric="cosine")) == [3, 1]
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, vector array<float>")
    assert ids(search.knn(zero, [1.0, 0.0], 5, metric="cosine")) == [2]
    with pytest.raises(ValidationError):
        search.knn(rows, axis(0), 1, metric="dot")


def test_wide_vectors_use_the_fold(spark):
    r = np.random.default_rng(0).normal(size=(20, 300)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r)], "id long, vector array<float>")
    exact = ((r.astype(float) - r[3].astype(float)) ** 2).sum(axis=1)
    found = search.knn(df, r[3].tolist(), 20).collect()
    assert [x["id"] for x in found] == np.argsort(exact, kind="stable").tolist()
    assert np.allclose([x["score"] for x in found], np.sort(exact))


def test_batch(rows, spark, monkeypatch):
    queries = spark.createDataFrame([(7, axis(0)), (8, axis(3))], "query_id long, query array<float>")
    found = {(r["query_id"], r["rank"]): r["id"] for r in search.knn_batch(rows, queries, 2).collect()}
    assert found == {(7, 1): 1, (7, 2): 2, (8, 1): 4, (8, 2): 1}
    monkeypatch.setattr(search, "MAX_BATCH", 1)
    with pytest.raises(ValidationError):
        search.knn_batch(rows, queries, 2)


def test_maxsim(spark):
    bags = spark.createDataFrame([(1, [axis(0), axis(1)]), (2, [axis(2), axis(3)]), (3, [axis(0)])], "id long, vector array<array<float>>")
    found = search.maxsim(bags, [axis(0), axis(1)], 3).collect()
    assert [(r["id"], r["score"]) for r in found] == [(1, 2.0), (3, 1.0), (2, 0.0)]


def test_bm25(rows):
    assert set(ids(search.bm25(rows, "lazy", 10))) == {1, 3}
    assert ids(search.bm25(rows, "nothing here", 10)) == []
    assert ids(search.bm25(rows, " ... ", 10)) == []
    assert ids(search.bm25(rows, "FOX fox", 10)) == [1]
    stats = search.corpus_stats(rows).first()
    assert stats["n"] == 4
    score = search.bm25(rows, "fox", 1).first()["score"]
    idf = math.log(1 + (4 - 1 + 0.5) / 1.5)
    assert abs(score - idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 9 / stats["avgdl"]))) < 1e-12


def test_rrf(rows):
    legs = [(search.knn(rows, axis(0), 10), False), (search.bm25(rows, "lazy", None), True)]
    found = search.rrf(legs, 3).collect()
    assert found[0]["id"] == 1 and abs(found[0]["score"] - (1 / 61 + 1 / 62)) < 0.001


def test_query_terms():
    assert query_terms("The the, AND! 42") == ["the", "and", "42"]


def test_ivf_recall(spark):
    r = np.random.default_rng(1)
    x = (r.normal(size=(12, 32))[r.integers(0, 12, 800)] + 0.2 * r.normal(size=(800, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    model = ivf.train(df, 12, 4)
    index = ivf.index(df, model).cache()
    recalls = []
    for probes in (1, 4, 12):
        hits = 0
        for q in range(5):
            exact = set(np.argsort(((x.astype(float) - x[q]) ** 2).sum(axis=1), kind="stable")[:10].tolist())
            hits += len(exact & set(ids(ivf.search(index, model, x[q].tolist(), 10, probes, refine=80))))
        recalls.append(hits)
    assert recalls == sorted(recalls) and recalls[-1] == 50
    assert len(ids(ivf.search(index, model, x[0].tolist(), 10, 12, refine=0))) == 10


def test_ivf_options():
    assert ivf.default_partitions(100_000) == 316 and ivf.default_partitions(0) == 1
    assert ivf.default_sub_vectors(1536) == 96 and ivf.default_sub_vectors(8) == 1
    for bits, subs in [(5, None), (4, None), (4, 3)]:
        with pytest.raises(ValidationError):
            ivf.validate_options(bits, subs)
    ivf.validate_options(4, 2)


def test_metrics(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 5.0)], "g string, v double")
    assert {r["g"]: tuple(r)[1:] for r in metrics.bench_percentiles(df, "g", "v").collect()} == {"a": (5.0, 9.0, 9.0), "b": (5.0, 5.0, 5.0)}
    a = spark.createDataFrame([(1,), (2,)], "id long")
    assert metrics.overlap(a, a.filter("id = 2")).first()[0] == 1
    ranked = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    gains = spark.createDataFrame([(2, 1.0), (9, 0.0)], "id long, gain double")
    assert abs(metrics.ndcg(ranked, gains, 10).first()[0] - 1 / math.log2(3)) < 1e-12
    assert metrics.ndcg(ranked, gains.filter("id = 9"), 10).first()[0] == 0
