"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to many pivots are tabled. Together they fix its place in
the span of the pivots (coordinates) and its distance from that span, and these give
the largest lower bound of the distance of a query q and a vector v that follows from
the table: d(q, v)^2 >= |c(q) - c(v)|^2 + (r(q) - r(v))^2, never less than what any
one pivot's |d(q, p) - d(v, p)| tells. The inner product is (|q|^2 + |v|^2 -
d(q, v)^2) / 2, so that bound bounds the score from above. Blocks of vectors near
one pivot have intervals of the table, which bound all their scores at once. A query
begins with the k-th best score over a sample, evaluates vectors in the order of their
bounds and stops where the bound falls below its k-th best score: nothing that could
enter the result is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylode.llm.common import column, runs, written

#: Pivots, and vectors that these and the first k-th best scores are taken from.
PIVOTS, PIVOT_SAMPLE = 48, 2048
#: Bytes of query vectors that are broadcast at a time; more queries take more passes.
QUERY_BYTES = 16 << 20
#: Vectors of a block with intervals of its own, blocks that are tabled at a time, and
#: vectors that are evaluated between two stop checks.
BLOCK, TABLED, STRIDE = 128, 32, 256
#: Sums up to here are exact in doubles, and scores up to there are reported as they are.
EXACT, MOST = 2.0**53, (1 << 63) - 1


def scaled(vectors: pa.Array, scale: float = 1024.0) -> tuple[np.ndarray, np.ndarray]:
    """(floor(scale * x) as a matrix of the valid rows, their row numbers).

    Rows that are null, empty or hold a null or non-finite component are left
    out; shorter rows are filled up with zeros.
    """
    lists = vectors.cast(pa.large_list(pa.float64()))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    ok = lists.is_valid().to_numpy(zero_copy_only=False) & (lengths > 0) & (bad[offsets[1:]] == bad[offsets[:-1]])
    rows = np.flatnonzero(ok)
    out = np.zeros((len(rows), int(lengths[rows].max(initial=0))))
    inside = np.arange(out.shape[1])[None, :] < lengths[rows][:, None]
    out[inside] = np.floor(scale * flat[runs(offsets[:-1][rows], lengths[rows])])
    return out, rows


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Farthest first: each pivot is the vector farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    near = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(count, len(sample)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, np.linalg.norm(sample - sample[chosen[-1]], axis=1))
    return sample[chosen]


class PivotTable:
    """Coordinates of vectors in the span of the pivots, and distances from it."""

    def __init__(self, pivots: np.ndarray, width: int):
        pivots = _widened(pivots, width)
        self.origin = pivots[0] if len(pivots) else np.zeros(width)
        q, r = np.linalg.qr((pivots[1:] - self.origin).T) if len(pivots) > 1 else (np.zeros((width, 0)), np.zeros((0, 0)))
        size = np.abs(np.diagonal(r))
        self.basis = q[:, : len(size)][:, size > 1e-9 * size.max(initial=0)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """A row for each vector: its coordinates, and last its distance from the span."""
        own = x - self.origin
        inner = own @ self.basis
        rest = np.sqrt(np.maximum((own**2).sum(axis=1) - (inner**2).sum(axis=1), 0))
        return np.concatenate((inner, rest[:, None]), axis=1)


def products(vectors: np.ndarray, query: np.ndarray, exact: bool) -> list[int]:
    """Inner products of whole numbers: in doubles where those are exact, else in integers."""
    if exact:
        return (vectors @ query).astype(np.int64).tolist()
    q = [int(x) for x in query]
    return [sum(int(a) * b for a, b in zip(row, q)) for row in vectors.tolist()]


def first_floors(ids: np.ndarray, queries: np.ndarray, sample_ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that its k-th best is no less than: the k-th best of the sample."""
    out = np.full(len(ids), -np.inf)
    width = max(queries.shape[1], sample.shape[1])
    queries, sample = _widened(queries, width), _widened(sample, width)
    margin = 1e-9 * np.sqrt((sample**2).sum(axis=1).max(initial=0))
    for i, query in enumerate(queries):
        scores = (sample @ query)[sample_ids != ids[i]]
        if len(scores) >= k:
            out[i] = np.partition(scores, len(scores) - k)[len(scores) - k] - margin * np.sqrt(query @ query)
    return np.where(np.abs(out) < EXACT, np.floor(out), out)


class QueryBlock:
    """Queries with their best k so far, over the vectors of one task."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.k, self.given = ids, k, pivots
        self.queries = _widened(queries, max(queries.shape[1], pivots.shape[1]))
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, id), sorted
        self.floors = np.full(len(ids), -np.inf) if floors is None else floors.astype(float)
        #: Pairs seen, and those of them whose product was taken.
        self.seen = self.evaluated = 0
        self._prepare()

    def _prepare(self) -> None:
        self.norms = (self.queries**2).sum(axis=1)
        self.pivots = PivotTable(self.given, self.queries.shape[1])
        self.table = self.pivots(self.queries)

    def _most(self, norms: np.ndarray, squares: np.ndarray, i: int) -> np.ndarray:
        """The highest possible scores from lower bounds of squared distances. Scores are
        whole; the margin covers rounding."""
        both = self.norms[i] + norms
        return np.floor((both - squares) / 2 + 1e-3 + 1e-9 * both)

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        width = max(vectors.shape[1], self.queries.shape[1])
        if width > self.queries.shape[1]:
            self.queries = _widened(self.queries, width)
            self._prepare()
        vectors = _widened(vectors, width)
        table = self.pivots(vectors)
        # Vectors near one pivot side by side, so that blocks have narrow intervals.
        places = self.pivots(_widened(self.given, width)) if len(self.given) else table[:0]
        if len(places):
            near = ((places**2).sum(axis=1) - 2 * table @ places.T).argmin(axis=1)
            order = np.lexsort((table[:, -1], near))
            ids, vectors, table = ids[order], vectors[order], table[order]
        norms = (vectors**2).sum(axis=1)
        largest = np.sqrt(norms.max(initial=0))
        starts = np.arange(0, len(ids), BLOCK)
        low, high = np.minimum.reduceat(table, starts), np.maximum.reduceat(table, starts)
        tops = np.maximum.reduceat(norms, starts)
        block = np.arange(len(ids)) // BLOCK
        for i, query in enumerate(self.queries):
            exact = largest * np.sqrt(self.norms[i]) < EXACT
            outside = np.maximum(np.maximum(low - self.table[i], self.table[i] - high), 0)
            # A block's highest score is at its greatest norm, or where the distance is least.
            open_ = self._most(tops, (outside**2).sum(axis=1), i) >= self.floors[i]
            self.seen += len(ids)
            if not open_.any():
                continue
            at = np.arange(len(ids)) if open_.all() else np.flatnonzero(open_[block])
            gap = table[at] - self.table[i]
            most = self._most(norms[at], np.einsum("ij,ij->i", gap, gap), i)
            live = np.flatnonzero((most >= self.floors[i]) & (ids[at] != self.ids[i]))
            live = live[np.argsort(-most[live], kind="stable")]
            best, done = self.best[i], 0
            while done < len(live) and most[live[done]] >= self.floors[i]:
                # No further than the floor reaches now; it may rise after each stride.
                some = live[done : done + STRIDE]
                done += STRIDE
                some = at[some[most[some] >= self.floors[i]]]
                self.evaluated += len(some)
                scores = products(vectors[some], query, exact)
                best += [(-s, j) for s, j in zip(scores, ids[some].tolist()) if s >= self.floors[i]]
                best.sort()
                del best[self.k :]
                if len(best) == self.k:
                    self.floors[i] = max(self.floors[i], float(-best[-1][0]) if exact else np.nextafter(float(-best[-1][0]), -np.inf))


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest inner products.

    Queries are the rows of ``df`` that ``is_query`` selects; candidates all rows
    but the query's own. Components are floor(scale * x) as integers, ties go to
    the smaller id. Vectors that are null, empty or hold a null or non-finite
    component take no part, nor do rows without id; a shorter vector counts as
    filled up with zeros. Rows that repeat an id are candidates each, but one
    query only, the least by its components. Sums are exact whatever their size;
    scores beyond the range of long are given as its ends. No rows and no queries
    give no rows.

    Queries are taken in blocks of bounded size, each against one pass over all
    rows; a task keeps k rows for each query of the block.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query")).filter("id is not null")
    spark = df.sparkSession
    stats = rows.agg(F.count(F.when(F.col("query"), 1)), F.max(F.size("vector"))).first()
    per_block = max(1, QUERY_BYTES // (8 * max(1, stats[1] or 1)))
    blocks = max(1, -(-stats[0] // per_block))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).select("id", "vector").toArrow()
    first, valid = scaled(sample.column(1).combine_chunks(), scale) if sample.num_rows else (np.zeros((0, 1)), np.zeros(0, np.int64))
    first_ids = sample.column(0).to_numpy()[valid]
    pivots = choose_pivots(first)

    def against(block: int) -> DataFrame:
        own = rows.filter(F.col("query") & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)).select("id", "vector").toArrow()
        vectors, valid = scaled(own.column(1).combine_chunks(), scale) if own.num_rows else (np.zeros((0, 1)), np.zeros(0, np.int64))
        ids = own.column(0).to_numpy()[valid]
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, at = np.unique(ids[order], return_index=True)
        vectors = vectors[order][at]
        shared = spark.sparkContext.broadcast((ids, vectors, pivots, first_floors(ids, vectors, first_ids, first, k)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, pivots, floors = shared.value
            state = QueryBlock(ids, vectors, pivots, k, floors)
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK * TABLED):
                    part = batch.slice(at, BLOCK * TABLED)
                    x, valid = scaled(column(part, "vector"), scale)
                    if len(valid) and len(ids):
                        state.add(column(part, "id").to_numpy()[valid], x)
            found = [(q, i, max(-MOST - 1, min(MOST, -s))) for q, best in zip(ids.tolist(), state.best) for s, i in best]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

        return rows.select("id", "vector").mapInArrow(run, "query_id long, vec_id long, score long")

    parts = [against(0)] if blocks == 1 else [written(against(b), "top-k") for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
