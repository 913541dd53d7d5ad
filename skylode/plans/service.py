"""The service: reads through the caches, writes that clear them, background work."""

from __future__ import annotations

import secrets
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace
from threading import Lock

from skylode.errors import EngineError, StorageError, ValidationError
from skylode.operators import ivf
from skylode.plans.cache import ExactCache, SemanticCache
from skylode.plans.metrics import Metrics
from skylode.plans.query import Planner, QueryRequest, ResultSet, validate, validate_semantic
from skylode.sources.table import Info, ListPage, Store, Table

COMPLETED_KEPT = 256


@dataclass(frozen=True)
class Outcome:
    hits: list
    source: str  # backend, exact_cache or semantic_cache
    query_id: str = ""


@dataclass(frozen=True)
class Operation:
    operation_id: str
    kind: str
    namespace: str
    status: str
    started_at_ms: int
    finished_at_ms: int | None = None
    error: str | None = None


class Operations:
    """Background operations; the last completed ones are kept, running ones always."""

    def __init__(self, kept: int = COMPLETED_KEPT):
        self.kept = kept
        self._held: OrderedDict[str, Operation] = OrderedDict()
        self._lock = Lock()

    def start(self, kind: str, namespace: str) -> str:
        now = time.time_ns() // 1_000_000
        # A version 7 UUID: time first, so that ids sort by their start.
        n = (now & (1 << 48) - 1) << 80 | 7 << 76 | secrets.randbits(12) << 64 | 2 << 62 | secrets.randbits(62)
        h = f"{n:032x}"
        key = f"op_{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"
        with self._lock:
            self._held[key] = Operation(key, kind, namespace, "running", now)
        return key

    def finish(self, key: str, error: BaseException | None = None) -> None:
        with self._lock:
            shown = None if error is None else str(error) if isinstance(error, EngineError) and not isinstance(error, StorageError) else "operation failed"
            self._held[key] = replace(self._held[key], status="failed" if error else "succeeded", finished_at_ms=time.time_ns() // 1_000_000, error=shown)
            self._held.move_to_end(key)
            done = [k for k, o in self._held.items() if o.status != "running"]
            for k in done[: max(0, len(done) - self.kept)]:
                del self._held[k]

    def get(self, key: str) -> Operation | None:
        return self._held.get(key)


class Service:
    def __init__(self, store: Store, cache_dir: str | None = None):
        """``cache_dir``: a folder of this machine where results go that memory can't hold."""
        self.store = store
        self.exact, self.semantic = ExactCache(spill=cache_dir), SemanticCache()
        self.operations = Operations()
        self.metrics = Metrics()
        self._seen: set[str] = set()
        self._pool = ThreadPoolExecutor(4, thread_name_prefix="skylode")

    # Reading

    def query(self, namespace: str, request: QueryRequest) -> Outcome:
        began = time.perf_counter()
        outcome = self._queried(namespace, request)
        self.metrics.observe("query_duration_seconds", time.perf_counter() - began, namespace, request.query_type)
        return outcome

    def _table(self, namespace: str) -> Table:
        table = self.store.table(namespace)
        if namespace not in self._seen:
            self._seen.add(namespace)
            self.metrics.set("active_namespaces", len(self._seen))
            self.metrics.set("cached_handles", len(self.store._tables))
        return table

    def _queried(self, namespace: str, request: QueryRequest) -> Outcome:
        table = self._table(namespace)
        try:
            validate_semantic(request)
        except ValidationError:
            self.metrics.count("semantic_cache_rejections_total", namespace, "invalid")
            raise
        generation = table.generation()
        key = request.hash()
        if (held := self.exact.get(namespace, generation, key)) is not None:
            self.metrics.count("cache_hits_total", namespace)
            return Outcome(held.hits, "exact_cache")
        self.metrics.count("cache_misses_total", namespace)
        options = request.semantic_cache
        gate = (request.k, request.nprobes or ivf.NPROBES, request.include_vector)
        semantic = options is not None and options.enabled
        if semantic:
            state, value = self.semantic.lookup(namespace, generation, request.vector, gate, options.min_similarity)
            self.metrics.count("semantic_cache_hits_total" if state == "hit" else "semantic_cache_misses_total", namespace)
            if state == "hit":
                return Outcome(value.hits, "semantic_cache")
        m = table.existing()
        self.metrics.count("storage_requests_total", namespace, "query")
        # An unknown namespace is empty, whatever is asked of it.
        if m is None:
            return Outcome([], "backend")
        validate(request, m)
        result = ResultSet(Planner(table, m).hits(request))
        now = table.generation()
        if now == generation:
            self.exact.put(namespace, generation, key, result)
        if semantic:
            if now == generation:
                self.semantic.insert(namespace, generation, now, request.vector, gate, result)
            else:
                self.metrics.count("semantic_cache_rejections_total", namespace, "generation")
        return Outcome(result.hits, "backend")

    def list(self, namespace: str, **options) -> ListPage:
        self.metrics.count("storage_requests_total", namespace, "list")
        return self._table(namespace).list(**options)

    def info(self, namespace: str) -> Info | None:
        self.metrics.count("storage_requests_total", namespace, "info")
        return self._table(namespace).info()

    def warmup(self, namespace: str, requests: Sequence[QueryRequest]) -> int:
        """Runs all queries through the read path; raises if any failed, after all ran."""
        failed: list[Exception] = []
        for request in requests:
            try:
                self.query(namespace, request)
            except Exception as e:
                failed.append(e)
        if failed:
            raise ValidationError(f"{len(failed)} of {len(requests)} queries failed: {failed[0]}")
        return len(requests)

    # Writing: what succeeds clears the near-duplicate cache; exact entries age by generation.

    def _write(self, kind: str, namespace: str, work: Callable, index: str | None = None):
        began = time.perf_counter()
        out = work(self._table(namespace))
        self.semantic.clear(namespace)
        took = time.perf_counter() - began
        self.metrics.count("storage_requests_total", namespace, kind)
        if index is not None:
            self.metrics.observe("index_build_duration_seconds", took, namespace, index)
        else:
            self.metrics.observe("compaction_duration_seconds" if kind == "compact" else "write_duration_seconds", took, namespace)
        return out

    def upsert(self, namespace: str, rows) -> int:
        return self._write("upsert", namespace, lambda t: t.upsert(rows))

    def import_arrow(self, namespace: str, source) -> int:
        return self._write("import", namespace, lambda t: t.import_arrow(source))

    def delete(self, namespace: str) -> int:
        return self._write("delete", namespace, lambda t: t.delete())

    def compact(self, namespace: str) -> tuple[int, int]:
        return self._write("compact", namespace, lambda t: t.compact())

    def create_index(self, namespace: str, kind: str = "ivf_pq", **options) -> None:
        if kind != "ivf_pq":
            raise ValidationError("kind must be ivf_pq")
        self._write("index", namespace, lambda t: t.create_index(**options), "ivf_pq")

    def create_fts_index(self, namespace: str) -> None:
        self._write("index", namespace, lambda t: t.create_fts_index(), "fts")

    def create_scalar_index(self, namespace: str, column: str) -> None:
        self._write("index", namespace, lambda t: t.create_scalar_index(column), "scalar")

    # Background work

    def submit(self, kind: str, namespace: str, /, *args, **options) -> tuple[str, Future]:
        """Starts ``compact``, ``create_index``, ``import_arrow``, ``warmup`` ... and returns its id."""
        self.store.table(namespace)
        key = self.operations.start(kind, namespace)

        def run():
            try:
                out = getattr(self, kind)(namespace, *args, **options)
            except BaseException as e:
                self.operations.finish(key, e)
                raise
            self.operations.finish(key)
            return out

        return key, self._pool.submit(run)

    def close(self) -> None:
        self._pool.shutdown(wait=True)
