"""Search operators: nearest neighbours, late interaction, BM25, rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skylode.errors import ValidationError
from skylode.functions import vector as V
from skylode.functions.text import query_terms, tokens

K1, B = 1.2, 0.75
RRF_K, DEPTH = 60, 10
#: Queries of one batch; the table of them is broadcast, so it has a bound.
MAX_BATCH = 4096


def top(df: DataFrame, k: int, descending: bool = False) -> DataFrame:
    """The k best rows by ``score``, ties to the smaller id, of an id's rows to the one
    stored first; rows without score are no hits.

    Each task keeps k rows, so only k rows a task are moved.
    """
    return df.filter(F.col("score").isNotNull()).orderBy(F.desc("score") if descending else F.asc("score"), "id", *_stored(df)).limit(k)


def _stored(df: DataFrame) -> list[str]:
    """The column that orders rows of the same id, if there is one."""
    return ["_ingested_at"] if "_ingested_at" in df.columns else []


def _digits(score: Column, digits: int | None) -> Column:
    # Adding zero turns a negative zero into a plain one.
    return score if digits is None else F.round(score, digits) + F.lit(0.0)


def knn(df: DataFrame, query: Sequence[float], k: int, metric: str = "l2", vector_col: str = "vector", digits: int | None = None) -> DataFrame:
    """Exact nearest neighbours by squared Euclidean or cosine distance, nearest first.

    ``digits`` rounds the score, and ties are then those of the rounded score. Up to
    ``V.FLAT_DIM`` dimensions the score is compiled with the scan; wider vectors are
    scored in batches, of which each hands on its nearest rows alone.
    """
    if metric not in ("l2", "cosine"):
        raise ValidationError(f"unknown metric {metric!r}")
    if len(query) > V.FLAT_DIM:
        return top(_nearest(df, _distances(query, metric), k, vector_col, digits), k)
    if metric == "l2":
        score = V.l2_squared_to(vector_col, query)
    else:
        norm = F.sqrt(V.dot(F.col(vector_col), F.col(vector_col))) * F.lit(sum(float(x) * float(x) for x in query) ** 0.5)
        score = F.when((norm > 0) & (norm < float("inf")), 1 - V.dot_to(vector_col, query) / norm)
    return top(df.withColumn("score", _digits(score, digits)), k)


def knn_batch(df: DataFrame, queries: DataFrame, k: int, vector_col: str = "vector", digits: int | None = None) -> DataFrame:
    """``query_id, rank, id, score``: the k nearest rows of each query (``query_id, query``).

    The stated queries, a checked number, are broadcast against all rows; tasks
    keep k rows for each query before anything is moved.
    """
    n = queries.count()
    if n > MAX_BATCH:
        raise ValidationError(f"{n} queries in one batch; at most {MAX_BATCH}")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    found = _knn_block(df, queries, k, vector_col, digits)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _distances(query: Sequence[float], metric: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Places and distances of the vectors of an Arrow array that have one."""
    q = np.asarray(query, np.float64)

    def run(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at, x = matrix(vectors, len(q), np.float32)
        out = np.empty(len(x))
        for i in range(0, len(x), 512):  # blocks that stay in the cache
            own = x[i : i + 512].astype(np.float64)
            if metric == "l2":
                own -= q
                out[i : i + 512] = np.einsum("ij,ij->i", own, own)
            else:
                norm = np.sqrt(np.einsum("ij,ij->i", own, own)) * np.sqrt(q @ q)
                with np.errstate(divide="ignore", invalid="ignore"):
                    out[i : i + 512] = np.where((norm > 0) & (norm < np.inf), 1 - own @ q / norm, np.nan)
        return (at, out) if metric == "l2" else (at[~np.isnan(out)], out[~np.isnan(out)])

    return run


def _nearest(df: DataFrame, score: Callable, k: int, vector_col: str, digits: int | None, descending: bool = False) -> DataFrame:
    """``df`` with ``score``, without rows that a batch of them shows not to be among
    the k best. ``score`` gives places and scores of an Arrow array of vectors."""
    near = 0.0 if digits is None else 1.1 * 10.0**-digits
    place = df.columns.index(vector_col)
    rid = df.columns.index("id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = score(batch.column(place))
            by = -found if descending else found
            if len(by) > k:
                keep = np.flatnonzero(~(by > np.partition(by, k - 1)[k - 1] + near))
                at, found, by = at[keep], found[keep], by[keep]
                # Of rows of the very same score the k smallest ids are enough.
                ids = batch.column(rid).take(pa.array(at)).to_numpy(zero_copy_only=False)
                order = np.lexsort((ids, by))
                at, found, by = at[order], found[order], by[order]
                fresh = np.concatenate(([True], by[1:] != by[:-1]))
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0))
                keep = np.arange(len(by)) - start < k
                at, found = at[keep], found[keep]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(found)], names=[*batch.schema.names, "score"])

    rows = df.drop("score")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])).withColumn("score", _digits(F.col("score"), digits))


def matrix(column: pa.Array, dim: int, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """The positions of the vectors of ``dim`` components, and these as rows."""
    held = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    own = column if pc.all(held).as_py() else column.filter(held)
    values = own.flatten().to_numpy(zero_copy_only=False)
    return np.flatnonzero(held.to_numpy(zero_copy_only=False)), values.astype(kind, copy=False).reshape(-1, dim)


def query_blocks(queries: DataFrame, block: int) -> list[DataFrame]:
    """``queries`` (``query_id, query``) dealt by a hash into parts of about ``block`` rows."""
    n = -(-queries.count() // block)
    return [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [queries]


def collected(queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one block of queries, those without a vector left out."""
    held = queries.filter(F.size("query") > 0).select("query_id", "query").toArrow().combine_chunks()
    dim = max((len(v) for v in held["query"].slice(0, 1).to_pylist()), default=0)
    if not dim:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    at, x = matrix(held["query"].combine_chunks(), dim)
    return held["query_id"].to_numpy()[at], x


def knn_blocks(df: DataFrame, queries: DataFrame, k: int, vector_col: str = "vector", digits: int | None = None, block: int = MAX_BATCH) -> DataFrame:
    """``knn_batch`` for any number of queries, a broadcast block of them at a time.

    A matrix product finds the rows that can be among the k nearest of their Arrow
    batch; their distances are then summed from the left, as expressions do. Rows of
    another dimension are no hits.
    """
    found = [_knn_block(df, part, k, vector_col, digits) for part in query_blocks(queries, block)]
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _knn_block(df: DataFrame, queries: DataFrame, k: int, vector_col: str, digits: int | None) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(collected(queries))
    near = 1e-9 if digits is None else 1.1 * 10.0**-digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, q = shared.value
        for batch in batches:
            at, x = matrix(batch.column(1), q.shape[1])
            ids, square = batch.column(0).to_numpy(zero_copy_only=False)[at], (x**2).sum(axis=1)
            for i in range(0, len(q) if len(x) else 0, 128):
                own = q[i : i + 128]
                norms = (own**2).sum(axis=1)
                d = norms[:, None] + square - 2 * own @ x.T
                last = np.partition(d, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                # Rounding errors grow with the norms; the margin is far above them.
                margin = near + 1e-12 * (norms + square.max(initial=0, where=np.isfinite(square)))
                a, b = np.nonzero(d <= (last + margin)[:, None])
                score = np.zeros(len(a))
                for j in range(q.shape[1]):
                    score += (x[b, j] - own[a, j]) ** 2
                # Of rows at the very same distance the k smallest ids are enough.
                sort = np.lexsort((ids[b], score, a))
                a, b, score = a[sort], b[sort], score[sort]
                fresh = np.ones(len(a), bool)
                fresh[1:] = (a[1:] != a[:-1]) | (score[1:] != score[:-1])
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(a)), 0))
                keep = np.arange(len(a)) - start < k
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[i + a[keep]]), pa.array(ids[b[keep]]), pa.array(score[keep])], names=["query_id", "id", "score"])

    scored = df.select(F.col("id").cast("long"), vector_col).mapInArrow(run, "query_id long, id long, score double")
    return scored.withColumn("score", _digits(F.col("score"), digits))


def bag_maxima(bags: pa.Array, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the bags with a direction, their best cosine with each query vector)."""
    inner = bags.flatten()
    row = np.repeat(np.arange(len(bags)), pc.fill_null(pc.list_value_length(bags), 0).to_numpy(zero_copy_only=False))
    at, x = matrix(inner, unit.shape[1])
    norm = np.sqrt((x**2).sum(axis=1))
    ok = (norm > 0) & np.isfinite(norm)
    row, x = row[at[ok]], x[ok] / norm[ok, None]
    if not len(row):
        return np.zeros(0, np.int64), np.zeros((0, len(unit)))
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    return row[starts], np.maximum.reduceat(x @ unit.T, starts, axis=0)


def bag_scores(vectors: DataFrame, unit: np.ndarray) -> DataFrame:
    """``id, _row, score`` of the rows that some of a table's vectors (``id, _row,
    vector``) belong to: MaxSim over these alone, a query vector that none is near to
    counting as 0. Batches send one line a row."""
    names = [f"m{i}" for i in range(len(unit))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = matrix(batch.column(2), unit.shape[1])
            norm = np.sqrt((x**2).sum(axis=1))
            ok = (norm > 0) & np.isfinite(norm)
            if not ok.any():
                continue
            ids, row = (batch.column(i).to_numpy(zero_copy_only=False)[at[ok]] for i in (0, 1))
            order = np.lexsort((row, ids))
            ids, row = ids[order], row[order]
            starts = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (row[1:] != row[:-1]))))
            best = np.maximum.reduceat((x[ok] @ unit.T / norm[ok, None])[order], starts, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[starts]), pa.array(row[starts]), *map(pa.array, best.T.copy())], names=["id", "_row", *names])

    each = vectors.select("id", "_row", "vector").mapInArrow(run, "id long, _row long, " + ", ".join(f"{n} double" for n in names))
    total = reduce(lambda a, b: a + b, (F.greatest(F.max(n), F.lit(0.0)) for n in names))
    return each.groupBy("id", "_row").agg(total.alias("score"))


def unit_rows(vectors: Sequence[Sequence[float]]) -> np.ndarray | None:
    """Vectors of length one; None if one of them has no direction."""
    x = np.asarray(vectors, np.float64)
    norm = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return x / norm if np.isfinite(norm).all() and (norm > 0).all() else None


def maxsim(df: DataFrame, query: Sequence[Sequence[float]], k: int, vectors_col: str = "vector", digits: int | None = None) -> DataFrame:
    """Late interaction over multivector rows, best first: the best cosine of each query
    vector with any of a row's, summed over the query vectors. Rows without a vector
    that has a direction are no hits, nor is any row if a query vector has none."""
    unit = unit_rows(query)
    if unit is None:
        return df.withColumn("score", F.lit(0.0)).limit(0)

    def score(bags: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at, best = bag_maxima(bags, unit)
        return at, best.sum(axis=1)

    return top(_nearest(df, score, k, vectors_col, digits, descending=True), k, descending=True)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once: what is made of them can't be merged
    with them, nor filters on them moved before them."""
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return df.withColumn("_settled", made).select(*df.columns, *(F.col(f"_settled.{n}").alias(n) for n in columns))


def term_counts(df: DataFrame, terms: Sequence[str], text_col: str = "text") -> DataFrame:
    """Rows with a text, their length ``_dl`` in tokens and ``_tf``, how often each of the
    terms occurs. Texts are split once."""
    held = settled(df.filter(F.col(text_col).isNotNull()), _t=tokens(F.col(text_col)))
    count = lambda t: F.size(F.filter("_t", lambda x: x == F.lit(t)))
    return settled(held, _dl=F.size("_t"), _tf=F.array(*(count(t) for t in terms))).drop("_t")


def document_frequencies(counted: DataFrame, terms: int) -> list[Column]:
    return [F.count(F.when(F.col("_tf")[i] > 0, 1)).alias(f"df{i}") for i in range(terms)]


def bm25_scores(counted: DataFrame, dfs: Sequence[int], n: int, avgdl: float, k1: float = K1, b: float = B, digits: int | None = None) -> DataFrame:
    """The rows of ``counted`` (``_dl``, ``_tf``) that hold any term, with their ``score``."""
    score = F.lit(0.0)
    for i, df in enumerate(dfs):
        score = score + bm25_term(F.col("_tf")[i], F.lit(df), F.lit(n), F.col("_dl"), F.lit(avgdl or 1.0), k1, b)
    found = counted.filter(F.exists("_tf", lambda x: x > 0))
    return found.withColumn("score", _digits(score, digits)).drop("_dl", "_tf")


def bm25(df: DataFrame, text: str, k: int | None, text_col: str = "text", k1: float = K1, b: float = B, digits: int | None = None) -> DataFrame:
    """BM25 over the live rows: rows with any query term, best first.

    Nothing is exploded to tokens or shuffled: one pass aggregates the statistics, one
    row, and one scores the rows. ``k=None`` gives all matching rows in no order.
    """
    terms = query_terms(text)
    if not terms:
        return df.withColumn("score", F.lit(None).cast("double")).limit(0)
    counted = term_counts(df, terms, text_col)
    stats = term_counts(df.select(text_col), terms, text_col).agg(F.count("*").alias("n"), F.avg("_dl").alias("avgdl"), *document_frequencies(counted, len(terms))).first()
    found = bm25_scores(counted, list(stats[2:]), stats["n"], stats["avgdl"], k1, b, digits)
    return found if k is None else top(found, k, descending=True)


def bm25_term(tf: Column, df: Column, n: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def numbered_tokens(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with a text: its tokens ``_t``, their number ``dl``, and a number ``_n`` of the
    row, which differs between copies. Write it before use: numbers are those of one run."""
    held = settled(df.filter(F.col(text_col).isNotNull()), _t=tokens(F.col(text_col)))
    return held.drop(text_col).withColumns({"dl": F.size("_t"), "_n": F.monotonically_increasing_id()})


def postings(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, tf, dl`` and the other columns of ``df``: the inverted index. A row's tokens
    are sorted and counted within the row, so nothing is shuffled."""
    if "_t" not in df.columns:
        df = settled(df.filter(F.col(text_col).isNotNull()), _t=tokens(F.col(text_col))).drop(text_col)
        df = df.withColumn("dl", F.size("_t"))
    rows = settled(df.filter("dl > 0"), _s=F.sort_array("_t")).drop("_t")
    first = lambda i: (i == 1) | (F.get("_s", i - 1) != F.get("_s", i - 2))
    rows = settled(rows, _at=F.filter(F.sequence(F.lit(1), F.col("dl")), first))
    end = lambda j: F.coalesce(F.get("_at", j + 1), F.col("dl") + 1)
    each = F.transform("_at", lambda i, j: F.struct(F.get("_s", i - 1).alias("term"), (end(j) - i).alias("tf")))
    kept = [c for c in rows.columns if c not in ("_s", "_at")]
    return rows.select(*kept, F.explode(each).alias("x")).select("x.term", *kept, "x.tf")


def corpus_stats(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: ``n`` texts and their mean length ``avgdl`` in tokens."""
    return df.filter(F.col(text_col).isNotNull()).agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col(text_col)))).alias("avgdl"))


def rrf(legs: Sequence[tuple[DataFrame, bool]], k: int, depth: int | None = None, rrf_k: int = RRF_K, digits: int | None = None, key: Sequence[str] = ("id",)) -> DataFrame:
    """Reciprocal rank fusion: ``key, score``, best first.

    ``legs``: (rows with key and score, descending). Each leg brings its ``depth``
    best rows (10 k unless given), so ranks are taken over that many rows only. Rows
    that agree in ``key`` are the same row in all legs; where a leg holds several of
    a key, the first of each leg are one row, the second ones another, and so on.
    """
    depth = depth or DEPTH * k
    ranked = []
    for leg, descending in legs:
        stored = _stored(leg)
        best_first = [F.desc("score") if descending else F.asc("score"), *(F.col(c) for c in (key[0], *stored, *key[1:]))]
        best = top(leg.select(*key, *stored, "score"), depth, descending)
        part = (1.0 / (rrf_k + F.row_number().over(Window.orderBy(*best_first)))).alias("part")
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score") if descending else F.asc("score"))).alias("_nth")
        ranked.append(best.select(*key, part, nth))
    fused = reduce(DataFrame.unionByName, ranked)
    summed = fused.groupBy(*key, "_nth").agg(_digits(F.sum("part"), digits).alias("score"))
    return top(summed, k, descending=True).drop("_nth")
