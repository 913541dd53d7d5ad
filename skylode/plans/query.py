"""Requests, their validation, and the plan of a search."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from skylode.errors import UnsupportedError, ValidationError
from skylode.functions.text import query_terms
from skylode.operators import ivf, search
from skylode.sources import rows as row_ops
from skylode.sources.manifest import DataFile, Manifest
from skylode.sources.table import Table, schema_for

MIN_SIMILARITY = 0.995
#: Rows that a vector index names for each hit wanted; these are scored exactly.
REFINE = 10


@dataclass(frozen=True)
class SemanticOptions:
    enabled: bool = True
    min_similarity: float = MIN_SIMILARITY


@dataclass(frozen=True)
class QueryRequest:
    vector: Sequence[float] | None = None
    vectors: Sequence[Sequence[float]] | None = None
    text: str | None = None
    k: int = 10
    nprobes: int | None = None
    include_vector: bool = True
    semantic_cache: SemanticOptions | None = None

    @property
    def query_type(self) -> str:
        if self.text is not None and (self.vector is not None or self.vectors):
            return "hybrid"
        if self.vectors:
            return "multivector"
        return "vector" if self.vector is not None else "fts"

    def hash(self) -> str:
        """Key of the exact cache: all that shapes the result; floats as 32-bit."""
        h = hashlib.blake2b(repr((self.k, self.nprobes, self.text, self.include_vector, self.vector is None, self.vectors is None)).encode(), digest_size=16)
        for v in [self.vector] if self.vector is not None else []:
            h.update(np.asarray(v, np.float32).tobytes())
        for v in self.vectors or []:
            h.update(b"%d:" % len(v) + np.asarray(v, np.float32).tobytes())
        return h.hexdigest()


@dataclass(frozen=True)
class Hit:
    id: int
    score: float
    vector: list[float] | None = None
    text: str | None = None
    ingested_at_micros: int | None = None


@dataclass(frozen=True)
class ResultSet:
    hits: list[Hit] = field(default_factory=list)
    query_id: str = ""


def validate_semantic(request: QueryRequest) -> None:
    """Rules of the near-duplicate cache; these hold even for an unknown namespace."""
    options = request.semantic_cache
    if options is None:
        return
    if not (math.isfinite(options.min_similarity) and 0 < options.min_similarity <= 1):
        raise ValidationError("min_similarity must be over 0 and at most 1")
    if options.enabled and (request.vector is None or request.vectors or request.text is not None):
        raise ValidationError("the semantic cache serves single-vector queries only")


def validate(request: QueryRequest, m: Manifest) -> None:
    if request.vector is not None and request.vectors is not None:
        raise ValidationError("give vector or vectors, not both")
    if request.k < 1:
        raise ValidationError("k must be at least 1")
    if request.nprobes is not None and request.nprobes < 1:
        raise ValidationError("nprobes must be at least 1")
    has_vectors = bool(request.vectors)
    if request.vector is None and not has_vectors and request.text is None:
        raise ValidationError("a query needs vector, vectors or text")
    if request.vector is not None and m.kind != "single":
        raise ValidationError("this namespace holds multivectors: query with vectors")
    if has_vectors and m.kind != "multivector":
        raise ValidationError("this namespace holds single vectors: query with vector")
    for v in [request.vector] if request.vector is not None else request.vectors or []:
        if len(v) != m.dim:
            raise ValidationError(f"query vectors must have dimension {m.dim}, not {len(v)}")
        if not all(math.isfinite(x) for x in v):
            raise ValidationError("query vectors must be finite")


class Planner:
    """Builds one DataFrame for a request: index probes where an index covers the
    rows, scans of the files that no index covers yet. Rows that an upsert has replaced
    since an index was built are taken off its answers.

    Rows are known by ``id`` and ``_row``, a digest: imports may repeat an id.
    """

    def __init__(self, table: Table, m: Manifest):
        self.table, self.m = table, m
        self.columns = schema_for(m.kind, m.has_ingested_at).names

    def _scan(self, files: list[DataFile] | None = None) -> DataFrame:
        return self.table.scan(self.m, files).withColumn("_row", row_ops.digest())

    def _parts(self, entry: dict) -> list[DataFrame]:
        return [self.table.unreplaced(self.m, self.table.frame(part["path"]), part["upto"]) for part in entry["parts"]]

    def _fetched(self, best: list[Row], files: list[DataFile] | None = None) -> DataFrame:
        """The rows of hits (``id, _row, score``), each with its score."""
        known = {(r["id"], r["_row"]): r["score"] for r in best}
        scores = self.table.spark.createDataFrame([(*k, v) for k, v in known.items()], "id long, _row long, score double")
        rows = self.table.fetch(self.m, [i for i, _ in known], files)
        return rows.withColumn("_row", row_ops.digest()).join(F.broadcast(scores), ["id", "_row"])

    def near(self, request: QueryRequest, k: int) -> DataFrame:
        entry = self.m.indexes.get("vector")
        if not entry:
            return search.knn(self._scan(), request.vector, k)
        model = self.table.index_model(entry)
        nprobes = request.nprobes or ivf.NPROBES
        probed = F.col("part").isin(model.probes(request.vector, nprobes))
        index = reduce(DataFrame.unionByName, (p.filter(probed) for p in self._parts(entry)))
        # Where no partition is left out, codes don't leave out rows either.
        refine = None if nprobes >= len(model.centroids) else REFINE
        found = ivf.search(index, model, request.vector, k, nprobes, refine).select(*self.columns, "_row", "score")
        if fresh := self.table.fresh_files(self.m, entry):
            found = search.top(found.unionByName(search.knn(self._scan(fresh), request.vector, k)), k)
        return found

    def bag(self, request: QueryRequest, k: int) -> DataFrame:
        entry = self.m.indexes.get("vector")
        unit = search.unit_rows(request.vectors)
        if not entry or unit is None:
            return search.maxsim(self._scan(), request.vectors, k)
        # The vectors in the probed partitions rank the rows; the best ones are read whole.
        model = self.table.index_model(entry)
        parts = sorted({p for v in unit for p in model.probes(v, request.nprobes or ivf.NPROBES)})
        probed = reduce(DataFrame.unionByName, (p.filter(F.col("part").isin(parts)) for p in self._parts(entry)))
        best = search.top(search.bag_scores(probed, unit), REFINE * k, descending=True).collect()
        fresh = self.table.fresh_files(self.m, entry)
        new = {f.path for f in fresh}
        found = self._fetched(best, [f for f in self.table.data_files(self.m) if f.path not in new]).drop("score")
        rows = found.select(*self.columns, "_row")
        return search.maxsim(rows.unionByName(self._scan(fresh)) if fresh else rows, request.vectors, k)

    def _counted(self, entry: dict, terms: list[str]) -> tuple[DataFrame, int, int]:
        """(``id, _row, _dl, _tf`` of rows that may match, live texts, their tokens)."""
        legs, n, total = [], 0, 0
        spark = self.table.spark
        for part, postings in zip(entry["parts"], self._parts(entry)):
            n, total = n + part["n"], total + part["total"]
            ids, stale = self.table.stale(self.m, part["upto"])
            if stale:
                hint = F.broadcast(ids) if stale <= row_ops.BROADCAST_IDS else ids
                lost = spark.read.schema("id long, dl int").parquet(self.table.files.at(f"{part['path']}-lengths")).join(hint, "id", "left_semi")
                counts = lost.agg(F.count("*"), F.sum("dl")).first()
                n, total = n - counts[0], total - (counts[1] or 0)
            buckets = sorted({term_bucket(t, part["buckets"]) for t in terms})
            hits = postings.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
            tf = F.array(*(F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)) for t in terms))
            legs.append(hits.groupBy("_n", "id", "_row", F.col("dl").alias("_dl")).agg(tf.alias("_tf")).drop("_n"))
        if fresh := self.table.fresh_files(self.m, entry):
            counted = search.term_counts(self._scan(fresh).select("id", "_row", "text"), terms).drop("text")
            more = counted.agg(F.count("*"), F.sum("_dl")).first()
            n, total = n + more[0], total + (more[1] or 0)
            legs.append(counted)
        return reduce(DataFrame.unionByName, legs), n, total

    def matching(self, text: str, k: int | None) -> DataFrame:
        """The k best rows for a text, or ``id, _row, score`` of all matches (k=None)."""
        entry = self.m.indexes.get("fts")
        if entry is None:
            raise UnsupportedError("text search needs a full-text index")
        terms = query_terms(text)
        if not terms:
            return search.bm25(self._scan(), text, k)
        counted, n, total = self._counted(entry, terms)
        dfs = counted.agg(*search.document_frequencies(counted, len(terms))).first()
        scores = search.bm25_scores(counted, list(dfs), n, total / n if n else 1.0)
        if k is None:
            return scores
        # Rows are fetched for the k best alone.
        return self._fetched(search.top(scores, k, descending=True).collect())

    def plan(self, request: QueryRequest) -> DataFrame:
        kind = request.query_type
        if kind == "vector":
            return self.near(request, request.k)
        if kind == "multivector":
            return self.bag(request, request.k)
        if kind == "fts":
            return self.matching(request.text, request.k)
        depth = search.DEPTH * request.k
        leg = (self.near(request, depth), False) if request.vector is not None else (self.bag(request, depth), True)
        fused = search.rrf([leg, (self.matching(request.text, None), True)], request.k, depth, key=("id", "_row"))
        return self._fetched(fused.collect())

    def hits(self, request: QueryRequest) -> list[Hit]:
        single = request.include_vector and self.m.kind == "single"
        micros = F.unix_micros(F.col("_ingested_at").cast("timestamp")) if self.m.has_ingested_at else F.lit(None).cast("long")
        rows = self.plan(request).select("id", F.col("score").cast("double"), "text", micros.alias("t"), *(["vector"] if single else [])).collect()
        best_first = request.query_type != "vector"
        rows.sort(key=lambda r: (-r["score"] if best_first else r["score"], r["id"]))
        return [Hit(r["id"], r["score"], list(r["vector"]) if single else None, r["text"], r["t"]) for r in rows[: request.k]]


def term_bucket(term: str, buckets: int) -> int:
    """The folder of a term's postings: Spark's xxhash64, modulo."""
    h = xxhash.xxh64_intdigest(term.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % buckets
