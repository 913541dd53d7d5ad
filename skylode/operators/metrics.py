"""Measures of results: percentiles, overlap, recall, nDCG."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bench_percentiles(df: DataFrame, group: str, value: str) -> DataFrame:
    """``p50, p95, p99`` of each group: the sorted sample's element at n/2, 95n/100
    and 99n/100, without interpolation. Sorting spills; no group is gathered."""
    own = Window.partitionBy(group)
    ranked = df.select(group, value).withColumns({"_i": F.row_number().over(own.orderBy(value)) - 1, "_n": F.count("*").over(own)})
    at = lambda p: F.max(F.when(F.col("_i") == F.expr(f"_n * {p} div 100"), F.col(value)))
    return ranked.groupBy(group).agg(at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """``overlap``: how many ids of ``a`` are also in ``b``."""
    return a.select("id").join(b.select("id").distinct(), "id", "left_semi").agg(F.count("*").alias("overlap"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``query_id, recall``: the share of each query's exact hits that were found."""
    hit = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))


def ndcg(ranked: DataFrame, gains: DataFrame, k: int) -> DataFrame:
    """``ndcg`` at k of one ranking (``id, rank``), with ``gains`` (``id, gain``)."""
    worth = F.col("gain") / F.log2(F.col("rank") + 1)
    got = ranked.filter(F.col("rank") <= k).join(gains, "id").agg(F.coalesce(F.sum(worth), F.lit(0.0)).alias("dcg"))
    best = gains.orderBy(F.desc("gain"), "id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gain"), "id")))
    ideal = best.agg(F.coalesce(F.sum(worth), F.lit(0.0)).alias("idcg"))
    return got.crossJoin(ideal).select(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def mean_average_precision(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``map`` at k of rankings (``query_id, id, rank``), with the relevant rows
    (``query_id, id``) of each. A query's precisions at its relevant hits are summed and
    divided by its relevant rows, by k if these are more; a query without any counts 0."""
    hits = ranked.filter(F.col("rank") <= k).join(relevant.select("query_id", "id").distinct(), ["query_id", "id"])
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    got = hits.select("query_id", (nth / F.col("rank")).alias("precision")).groupBy("query_id").agg(F.sum("precision").alias("total"))
    wanted = relevant.select("query_id", "id").distinct().groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).alias("wanted"))
    each = ranked.select("query_id").distinct().join(got, "query_id", "left").join(wanted, "query_id", "left")
    return each.agg(F.coalesce(F.avg(F.coalesce(F.col("total") / F.col("wanted"), F.lit(0.0))), F.lit(0.0)).alias("map"))
