"""Whole jobs against brute force: no row, query or term is left out."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from skylode.operators import ivf, search
from skylode.plans import oracle, registry


def embeddings(folder):
    table = pq.read_table(f"{folder}/embeddings.parquet").sort_by("vec_id")
    return table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), np.float64)


def nearest(ids, x, q, k):
    return ids[np.lexsort((ids, ((x - q) ** 2).sum(axis=1)))[:k]].tolist()


def same_as_sql(spark, folder, name, given):
    """``name`` gives what the SQL of ``given`` gives."""
    sql = oracle.oracle_sql()[given]
    con = duckdb.connect()
    for table in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    expected = con.execute(sql).df()
    got = registry.queries()[name](spark, folder).toPandas()[list(expected.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, expected.values.tolist()))
    return got


@pytest.mark.parametrize("size", ["sf0.001", "sf0.1"])
def test_trained_index_reaches_its_recall(spark, size):
    folder = f"/root/testdata/{size}"
    ids, x = embeddings(folder)
    _, index, model, (nprobes, refine) = registry._trained(spark, folder)
    index = index.cache()
    got = {r["query_id"]: r["recall"] for r in registry.ivf_trained_recall(spark, folder).collect()}
    assert sorted(got) == [i for i in ids.tolist() if i % 20 == 0]
    assert np.mean(list(got.values())) >= 0.9
    # The search itself finds the same.
    for i in (0, 20, 40, 60):
        q = x[ids == i][0]
        found = [r["id"] for r in ivf.search(index, model, q.tolist(), 10, nprobes, refine).collect()]
        assert abs(len(set(found) & set(nearest(ids, x, q, 10))) / 10 - got[i]) < 1e-9


def test_every_row_but_the_stored_is_looked_up(spark, sf_dir):
    got = same_as_sql(spark, sf_dir, "semantic_cache_lookup", "semantic_cache_lookup")
    assert len(got) == len(embeddings(sf_dir)[0]) - 50


@pytest.mark.parametrize("name", ["knn_batch_topk", "recall_at_k"])
def test_every_twentieth_row_is_a_query(spark, sf_dir, name):
    got = same_as_sql(spark, sf_dir, name, name)
    assert set(got["query_id"]) == {i for i in embeddings(sf_dir)[0].tolist() if i % 20 == 0}


def test_more_queries_than_a_block(spark):
    """With ties, and rows without a whole vector."""
    rows = [(i, [float(i // 4), 1.0]) for i in range(40)] + [(90, None), (91, [1.0]), (92, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    queries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "query_id long, query array<float>")
    found = search.knn_blocks(df, queries, 3, block=3).collect()
    assert {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in found} == {(i, j + 1): (4 * i + j, 0.0) for i in range(10) for j in range(3)}


def test_terms_of_one_document_are_counted(spark, sf_dir):
    got = same_as_sql(spark, sf_dir, "postings_stats", "postings_stats")
    assert (got["df"] == 1).any()
