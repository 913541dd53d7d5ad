"""Registered queries of the search engine, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylode.functions import vector as V
from skylode.operators import ivf, metrics, search
from skylode.sources import rows as row_ops
from skylode.sources.scan import spread

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hybrid corpus: rows with a vector and a text."""
    return vectors(spark, sf_dir).join(texts(spark, sf_dir), "id")


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multivector rows of five vectors each."""
    five = F.sort_array(F.collect_list(F.struct("id", "vector")))
    return vectors(spark, sf_dir).groupBy(F.expr("id div 5").alias("id")).agg(F.transform(five, lambda x: x["vector"]).alias("vector"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    return list(vectors(spark, sf_dir).filter(F.col("id") == vec_id).first()["vector"])


def query_vectors(spark: SparkSession, sf_dir: str, n: int) -> list[list[float]]:
    return [list(r["vector"]) for r in vectors(spark, sf_dir).filter(F.col("id") < n).orderBy("id").collect()]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("_ingested_at"), F.col("event_type").alias("text"))


# Search


def knn_l2_exact(spark, sf_dir):
    return search.knn(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10, digits=6).select("id", "score")


def knn_cosine_exact(spark, sf_dir):
    return search.knn(vectors(spark, sf_dir), query_vector(spark, sf_dir), 10, metric="cosine", digits=6).select("id", "score")


def _twentieths(rows):
    """The queries of a whole batch: every row whose id is divisible by 20."""
    return rows.filter(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


def knn_batch_topk(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return search.knn_blocks(rows, _twentieths(rows), 10, digits=6).select("query_id", "rank", "id", "score")


def maxsim_topk(spark, sf_dir):
    return search.maxsim(bags(spark, sf_dir), query_vectors(spark, sf_dir, 4), 10, digits=6).select("id", "score")


def bm25_topk(spark, sf_dir):
    return search.bm25(texts(spark, sf_dir), "the", 20, digits=6).select("id", "score")


def bm25_multi_term(spark, sf_dir):
    return search.bm25(texts(spark, sf_dir), "the and que", 20, digits=6).select("id", "score")


def hybrid_rrf(spark, sf_dir):
    rows = both(spark, sf_dir)
    near = search.knn(rows, query_vector(spark, sf_dir), 100, digits=6)
    return search.rrf([(near, False), (search.bm25(rows, "the and", None, digits=6), True)], 10, digits=6)


def hybrid_multivector_rrf(spark, sf_dir):
    bag = search.maxsim(bags(spark, sf_dir), query_vectors(spark, sf_dir, 4), 100, digits=6)
    held = texts(spark, sf_dir).join(bags(spark, sf_dir).select("id"), "id", "left_semi")
    return search.rrf([(bag, True), (search.bm25(held, "the and", None, digits=6), True)], 10, digits=6)


def query_without_vector(spark, sf_dir):
    hits = search.knn(both(spark, sf_dir), query_vector(spark, sf_dir, 3), 10, digits=6)
    return hits.select("id", "score", "text")


# Listing


def list_desc_page1(spark, sf_dir):
    return row_ops.page(events(spark, sf_dir), 50, "desc").select("id", F.unix_micros(F.col("_ingested_at").cast("timestamp")).alias("ingested_at_micros"))


def _page_after(spark, sf_dir, order, offset):
    rows = events(spark, sf_dir)
    last = row_ops.page(rows, offset, order).select(F.unix_micros(F.col("_ingested_at").cast("timestamp")).alias("t"), "id").collect()[-1]
    return row_ops.page(rows, 50, order, (last["t"], last["id"])).select("id", F.unix_micros(F.col("_ingested_at").cast("timestamp")).alias("ingested_at_micros"))


def list_desc_cursor_page(spark, sf_dir):
    return _page_after(spark, sf_dir, "desc", 50)


def list_asc_cursor_page(spark, sf_dir):
    return _page_after(spark, sf_dir, "asc", 50)


# Writing


def _second_batch(spark, sf_dir):
    """Every tenth event again, changed, and as many new ones."""
    again = events(spark, sf_dir).filter(F.col("id") % 10 == 0).select("id", F.concat(F.col("text"), F.lit("-v2")).alias("text"))
    return again.unionByName(again.select((F.col("id") + 10_000_000).alias("id"), F.lit("new").alias("text")))


def upsert_latest_wins(spark, sf_dir):
    return row_ops.upserted(events(spark, sf_dir).select("id", "text"), _second_batch(spark, sf_dir))


def import_append_keeps_duplicates(spark, sf_dir):
    return events(spark, sf_dir).select("id", "text").unionByName(_second_batch(spark, sf_dir)).groupBy("id").agg(F.count("*").alias("copies"))


def duplicate_id_detection(spark, sf_dir):
    batch = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).unionByName(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id")))
    return row_ops.duplicate_ids(batch)


def invalid_rows_filter(spark, sf_dir):
    rows = vectors(spark, sf_dir).withColumn("vector", F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 5 == 0, F.slice("vector", 1, 63)).when(F.col("id") % 3 == 0, F.transform("vector", lambda x, i: F.when(i != 0, x))).otherwise(F.col("vector")))
    return rows.select("id", row_ops.fault(F.col("id"), F.col("vector"), "single", 64).alias("fault")).filter(F.col("fault").isNotNull())


def namespace_info(spark, sf_dir):
    return vectors(spark, sf_dir).agg(F.count("*").alias("row_count"), F.max(F.size("vector")).cast("long").alias("vector_dim"), F.min("id").alias("id_min"), F.max("id").alias("id_max"))


# Indexes


def postings_stats(spark, sf_dir):
    rows = texts(spark, sf_dir)
    df = search.postings(rows).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))
    return df.crossJoin(F.broadcast(search.corpus_stats(rows))).select("term", "df", "cf", "n", F.round("avgdl", 6).alias("avgdl"))


def _coarse(spark, sf_dir):
    """The first 16 vectors as centroids."""
    return ivf.IvfPq(np.array(query_vectors(spark, sf_dir, 16)), np.zeros((1, 1, 64)))


def ivf_assign(spark, sf_dir):
    return ivf.index(vectors(spark, sf_dir), _coarse(spark, sf_dir), codes=False).select("id", "part")


def ivf_probe_topk(spark, sf_dir):
    model, query = _coarse(spark, sf_dir), query_vector(spark, sf_dir, 20)
    rows = ivf.index(vectors(spark, sf_dir), model, codes=False).filter(F.col("part").isin(model.probes(query, 4)))
    return search.knn(rows, query, 10, digits=6).select("id", "part", "score")


def _fixed_model(spark, sf_dir):
    """Codebooks of four sub-spaces made of the first 16 vectors, without residuals."""
    x = np.array(query_vectors(spark, sf_dir, 16))
    return ivf.IvfPq(x, x.reshape(16, 4, 16).transpose(1, 0, 2).copy(), residual=False)


def pq_encode(spark, sf_dir):
    coded = ivf.index(vectors(spark, sf_dir), _fixed_model(spark, sf_dir))
    return coded.select("id", *(F.col("code")[j].alias(f"code{j}") for j in range(4)))


def adc_topk(spark, sf_dir):
    model = _fixed_model(spark, sf_dir)
    query = query_vector(spark, sf_dir, 20)
    coded = ivf.index(vectors(spark, sf_dir), model)
    return search.top(coded.withColumn("score", F.round(ivf.adc_score(model, query, []), 6)), 10).select("id", "score")


# Caching and measures


def semantic_cache_lookup(spark, sf_dir):
    """The stored query (first 50 vectors) closest to each other row; -1 if not close enough."""
    rows = vectors(spark, sf_dir)
    stored = rows.filter(F.col("id") < 50).select(F.col("id").alias("entry_id"), F.col("vector").alias("stored"))
    scored = rows.filter(F.col("id") >= 50).crossJoin(F.broadcast(stored)).select("id", "entry_id", F.round(V.cosine(F.col("vector"), F.col("stored")), 6).alias("similarity"))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "entry_id"))).filter("n = 1")
    return best.select("id", F.when(F.col("similarity") >= 0.3, F.col("entry_id")).otherwise(-1).alias("entry_id"), "similarity")


def semantic_cache_answers(spark, sf_dir):
    """The cache itself: the first 50 vectors are stored, the next rows, as many as a cache
    holds, are looked up; -1 for a miss."""
    from skylode.plans.cache import SEMANTIC_ENTRIES, SemanticCache

    cache, gate = SemanticCache(), (10, 20, True)
    rows = vectors(spark, sf_dir).filter(F.col("id") < 50 + SEMANTIC_ENTRIES).orderBy("id").collect()
    for r in rows[:50]:
        cache.insert("ns", 1, 1, r["vector"], gate, r["id"])
    found = [(r["id"], cache.lookup("ns", 1, r["vector"], gate, 0.3)) for r in rows[50:]]
    return spark.createDataFrame([(i, value if state == "hit" else -1) for i, (state, value) in found], "id long, entry_id long")


def recall_at_k(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    exact = search.knn_blocks(rows, _twentieths(rows), 10, digits=6)
    half = search.knn_blocks(rows.filter(F.col("id") % 2 == 0), _twentieths(rows), 10, digits=6)
    return metrics.recall(half, exact)


def map_at_k(spark, sf_dir):
    """Mean average precision over three queries, with the labels of good quality as relevant."""
    ranked = None
    for query in ("the", "and", "que"):
        order = Window.orderBy(F.desc("score"), "id")
        own = search.bm25(texts(spark, sf_dir), query, 100, digits=6).select(F.lit(query).alias("query_id"), "id", F.row_number().over(order).alias("rank"))
        ranked = own if ranked is None else ranked.unionByName(own)
    good = _table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("id"))
    relevant = good.crossJoin(F.broadcast(ranked.select("query_id").distinct()))
    return metrics.mean_average_precision(ranked, relevant, 100).select(F.round("map", 6).alias("map"))


def ndcg_at_k(spark, sf_dir):
    ranked = search.bm25(texts(spark, sf_dir), "the and", 10, digits=6).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
    gains = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("gain"))
    return metrics.ndcg(ranked, gains, 10).select(F.round("ndcg", 6).alias("ndcg"))


def bench_percentiles(spark, sf_dir):
    return metrics.bench_percentiles(_table(spark, sf_dir, "events"), "event_type", "value")


def topk_overlap(spark, sf_dir):
    rows = vectors(spark, sf_dir)
    return metrics.overlap(search.knn(rows, query_vector(spark, sf_dir), 50, digits=6), search.knn(rows, query_vector(spark, sf_dir, 1), 50, digits=6))


# Beyond SQL: trained indexes and the table layer


def _trained(spark, sf_dir):
    """Rows, index, model, and the settings measured to reach the recall asked for."""
    rows = vectors(spark, sf_dir)
    model = ivf.train(rows, ivf.default_partitions(rows.count()), ivf.default_sub_vectors(64))
    index = ivf.index(rows, model)
    return rows, index, model, ivf.tune(rows, index, model, 10)


def ivf_trained_kmeans(spark, sf_dir):
    _, index, model, (nprobes, refine) = _trained(spark, sf_dir)
    return ivf.search(index, model, query_vector(spark, sf_dir), 10, nprobes, refine).select("id", "score")


def ivf_trained_recall(spark, sf_dir):
    """Recall of ``ivf_trained_kmeans`` for each query whose id is divisible by 20."""
    rows, index, model, (nprobes, refine) = _trained(spark, sf_dir)
    queries = _twentieths(rows)
    exact = search.knn_blocks(rows, queries, 10)
    ranks = ivf.short_list_ranks(index, model, queries, exact, nprobes)
    return metrics.recall(ranks.filter(F.col("rank") < refine * 10), exact)


def _scratch(spark):
    from skylode.sources.table import Store

    return Store.scratch(spark)


def _arrow_stream(rows: DataFrame, batch: int = 4096):
    """``id, vector, text`` as an Arrow stream, as clients send it."""
    import io

    import pyarrow as pa

    found = rows.orderBy("id").toArrow()
    dim = len(found["vector"][0])
    vector = pa.FixedSizeListArray.from_arrays(found["vector"].combine_chunks().flatten(), dim)
    table = pa.table({"id": found["id"].cast(pa.uint64()), "vector": vector, "text": found["text"].cast(pa.string())})
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table, max_chunksize=batch)
    return io.BytesIO(sink.getvalue())


def _changed(rows: DataFrame) -> DataFrame:
    """Every tenth row again with another text, and as many new ones."""
    again = rows.filter(F.col("id") % 10 == 0)
    again = again.withColumn("text", F.concat(F.lit("the second "), F.coalesce("text", F.lit(""))))
    return again.unionByName(again.withColumn("id", F.col("id") + 10_000_000).withColumn("text", F.lit("the new one")))


def table_import(spark, sf_dir):
    """Two Arrow streams through ``Table.import_arrow``; every tenth id comes twice."""
    table = _scratch(spark).table("import")
    rows = both(spark, sf_dir)
    table.import_arrow(_arrow_stream(rows), batch_rows=200)
    table.import_arrow(_arrow_stream(_changed(rows)))
    return table.read().groupBy("id").agg(F.count("*").alias("copies"), F.max(F.size("vector")).alias("dim"))


def table_upsert(spark, sf_dir):
    """Rows through ``Table.upsert``, some of them replaced by a second one."""
    table = _scratch(spark).table("upsert")
    rows = both(spark, sf_dir)
    table.upsert(rows)
    table.upsert(_changed(rows))
    return table.read().select("id", "text")


def table_info(spark, sf_dir):
    """``Table.info`` after an upsert, a second one and both indexes."""
    table = _scratch(spark).table("info")
    rows = both(spark, sf_dir)
    table.upsert(rows)
    table.upsert(_changed(rows))
    table.create_fts_index()
    table.create_index(num_partitions=4)
    i = table.info()
    return spark.createDataFrame([(i.row_count, i.vector_dim, i.kind, i.table_version, i.has_scalar_index, i.has_fts_index, i.has_vector_index)], "row_count long, vector_dim long, kind string, table_version long, has_scalar_index boolean, has_fts_index boolean, has_vector_index boolean")


def table_list(spark, sf_dir):
    """All pages of 500 rows, newest first: two commits, ids within."""
    table = _scratch(spark).table("list")
    table.append(both(spark, sf_dir))
    table.append(_changed(both(spark, sf_dir)))
    seen, cursor = [], None
    while True:
        page = table.list(500, cursor=cursor)
        seen += [r.id for r in page.rows]
        cursor = page.next_cursor
        if cursor is None:
            return spark.createDataFrame(list(enumerate(seen, 1)), "place long, id long")


def _searched(spark, sf_dir, name, vector_index):
    """A table with repeated ids and replaced rows, changed again after its indexes were built."""
    from skylode.plans.service import Service

    service = Service(_scratch(spark))
    rows = both(spark, sf_dir)
    table = service.store.table(name)
    table.append(rows)
    table.append(rows.filter(F.col("id") % 7 == 0).withColumn("text", F.lit("the copy and the other")))
    service.create_fts_index(name)
    if vector_index:
        service.create_index(name)
    table.upsert(_changed(rows))
    return service


def table_text_search(spark, sf_dir):
    """BM25 through the service, from postings that are older than an upsert, over repeated ids."""
    from skylode.plans.query import QueryRequest

    hits = _searched(spark, sf_dir, "texts", False).query("texts", QueryRequest(text="the and", k=50)).hits
    return spark.createDataFrame([(h.id, h.text, round(h.score, 6)) for h in hits], "id long, text string, score double")


def table_query_modes(spark, sf_dir):
    """Hits of three query modes through the service, as the index probes every partition."""
    from skylode.plans.query import QueryRequest

    service = _searched(spark, sf_dir, "modes", True)
    vector = query_vector(spark, sf_dir)
    every = len(service.store.table("modes").index_model(service.store.table("modes").manifest().indexes["vector"]).centroids)
    found = []
    for mode, request in {"vector": QueryRequest(vector=vector, k=5, nprobes=every), "fts": QueryRequest(text="the and", k=5), "hybrid": QueryRequest(vector=vector, text="the and", k=5, nprobes=every)}.items():
        found += [(mode, hit.id, round(float(hit.score), 6)) for hit in service.query("modes", request).hits]
    return spark.createDataFrame(found, "mode string, id long, score double")


def compact_roundtrip(spark, sf_dir):
    """Rows written in four batches, compacted: unchanged, in fewer files."""
    table = _scratch(spark).table("compact")
    rows = both(spark, sf_dir)
    for part in range(4):
        table.append(rows.filter(F.col("id") % 4 == part))
    before = table.info().fragment_count
    table.compact()
    return table.read().select("id", "text", F.size("vector").alias("dim"), F.lit(table.info().fragment_count < before).alias("fewer"))


def generation_changes(spark, sf_dir):
    """The version after each of three writes, and whether its generation is a new one."""
    table = _scratch(spark).table("generations")
    seen, out = {0}, []
    for part in range(3):
        table.upsert(vectors(spark, sf_dir).filter(F.col("id") % 3 == part).withColumn("text", F.lit(None).cast("string")))
        out.append((part, table.manifest().version, table.generation() not in seen))
        seen.add(table.generation())
    return spark.createDataFrame(out, "write int, version long, changed boolean")


def queries() -> dict[str, Query]:
    own = (
        knn_l2_exact, knn_cosine_exact, knn_batch_topk, maxsim_topk, bm25_topk, bm25_multi_term, hybrid_rrf, hybrid_multivector_rrf,
        query_without_vector, list_desc_page1, list_desc_cursor_page, list_asc_cursor_page, upsert_latest_wins,
        import_append_keeps_duplicates, duplicate_id_detection, invalid_rows_filter, namespace_info, postings_stats, ivf_assign,
        ivf_probe_topk, pq_encode, adc_topk, semantic_cache_lookup, semantic_cache_answers, recall_at_k, ndcg_at_k, map_at_k, bench_percentiles, topk_overlap,
        ivf_trained_kmeans, ivf_trained_recall, table_import, table_upsert, table_info, table_list, table_text_search, table_query_modes,
        compact_roundtrip, generation_changes,
    )
    return {f.__name__: f for f in own}
