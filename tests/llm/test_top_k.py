"""op4 against brute force."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from skylode.llm import pivot_topk


def brute(rows, k):
    seen, out = {}, []
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for i, v in ok:
        if i % 100 == 0:
            seen.setdefault(i, v)
    for q, x in seen.items():
        scores = sorted((-sum(a * b for a, b in zip(x, v)), i) for i, v in ok if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(df, k=10):
    return sorted(map(tuple, pivot_topk.top_k(df, F.col("vec_id") % 100 == 0, k).collect()))


def test_messy_vectors(spark):
    r = random.Random(5)
    vector = lambda n=8: [float(np.float32(r.uniform(-1, 1))) for _ in range(n)]
    rows = [(i, vector()) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]  # ties
    rows += [(400, None), (401, []), (402, [1.0, None] * 4), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (None, vector()), (405, vector(3)), (500, vector())]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, rank string")
    assert run(df) == brute(rows, 10)
    assert run(df.filter("vec_id in (0, 1, 2)")) == brute([x for x in rows if x[0] in (0, 1, 2)], 10)
    assert run(df.filter("false")) == []


def test_many_query_blocks(spark, monkeypatch):
    r = random.Random(6)
    rows = [(i, [float(np.float32(r.gauss(0, 1))) for _ in range(6)]) for i in range(0, 1000, 10)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(pivot_topk, "QUERY_BYTES", 6 * 8 * 3)
    assert run(df, 4) == brute(rows, 4)


def share(x, queries, k=10):
    """Share of the pairs whose product is taken; the results are checked."""
    sample = np.arange(0, len(x), max(1, len(x) // pivot_topk.PIVOT_SAMPLE))
    floors = pivot_topk.first_floors(queries, x[queries], sample, x[sample], k)
    state = pivot_topk.QueryBlock(queries, x[queries], pivot_topk.choose_pivots(x[sample]), k, floors)
    for at in range(0, len(x), 2500):
        state.add(np.arange(at, min(at + 2500, len(x))), x[at : at + 2500])
    for n, i in enumerate(queries):
        scores = x @ x[i]
        expected = sorted((-int(s), j) for j, s in enumerate(scores) if j != i)[:k]
        assert state.best[n] == expected
    assert state.seen == len(queries) * len(x)
    return state.evaluated / state.seen


def test_elimination():
    r = np.random.default_rng(1)
    centres = r.normal(size=(20, 16)) * 1000
    clustered = np.floor(centres[r.integers(0, 20, 6000)] + r.normal(size=(6000, 16)) * 10)
    assert share(clustered, np.arange(5)) < 0.1
    flat = r.normal(size=(6000, 64)) @ np.diag(np.r_[np.full(24, 1000.0), np.full(40, 30.0)])
    assert share(np.floor(flat), np.arange(5)) < 0.1
    # Directions without any structure, the hardest case.
    sphere = r.normal(size=(6000, 64))
    assert share(np.floor(1024 * sphere / np.linalg.norm(sphere, axis=1, keepdims=True)), np.arange(0, 6000, 1000)) < 0.35


def test_documents_share(spark):
    x = np.array([[math.floor(1024 * c) for c in r["embedding"]] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("embedding").collect()], float)
    assert share(x, np.arange(0, len(x), 100)) < 0.4


def test_sums_beyond_doubles(spark):
    r = random.Random(7)
    rows = [(i, [float(np.float32(r.uniform(-1, 1) * 10 ** r.randint(2, 5))) for _ in range(5)]) for i in range(120)]
    rows += [(500, rows[0][1][:4] + [rows[0][1][4] + 1.0]), (600, [3e5] * 5)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    expected = brute(rows, 10)
    assert 2**53 < max(abs(s) for *_, s in expected) < 2**63
    assert run(df) == expected


def test_one_query_of_a_repeated_id(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, -2.0]), (0, [2.0, 0.0])] + [(i, [float(i), 1.0]) for i in range(1, 40)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "vec_id long, embedding array<float>")
        assert run(df) == brute([rows[1], *[x for x in rows if x[0] or x is rows[1]]], 10)[:10]
