"""The embedded client: connect(), collections and tenants."""

from __future__ import annotations

import contextlib
import io
from collections.abc import Sequence
from threading import Condition
from typing import BinaryIO

from pyspark.sql import SparkSession

from skylode.errors import EngineError, StorageError, UnsupportedError, ValidationError
from skylode.plans.query import Hit, QueryRequest, SemanticOptions
from skylode.plans.service import Service
from skylode.sources import names
from skylode.sources.arrow_import import MAX_BYTES, Limited
from skylode.sources.table import Info, ListPage, Store


class Client:
    """One connection. Calls may run at the same time; close() waits for them."""

    def __init__(self, spark: SparkSession, url: str):
        self.service = Service(Store.open(spark, url))
        self._open, self._running, self._changed = True, 0, Condition()

    def __enter__(self) -> Client:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        with self._changed:
            self._open = False
            self._changed.wait_for(lambda: not self._running)
        self.service.close()

    def run(self, work):
        """Runs ``work`` unless closed; anything but the package's errors becomes a StorageError."""
        with self._changed:
            if not self._open:
                raise EngineError("the client is closed")
            self._running += 1
        try:
            return work()
        except EngineError:
            raise
        except Exception as e:
            raise StorageError("internal error") from e
        finally:
            with self._changed:
                self._running -= 1
                self._changed.notify_all()

    def collection(self, name: str = names.DEFAULT_COLLECTION) -> Collection:
        return self.run(lambda: Collection(self, names.component(name, "collection")))


class Collection:
    def __init__(self, client: Client, name: str):
        self.client, self.name = client, name

    def _do(self, tenant: str | None, work):
        return self.client.run(lambda: work(self.client.service, names.joined(self.name, tenant)))

    def upsert(self, documents: Sequence[dict], tenant: str | None = None) -> int:
        """Inserts or replaces documents: ``id``, ``vector`` or ``vectors``, ``text``."""

        def work(service: Service, ns: str) -> int:
            for d in documents:
                if not isinstance(d, dict):
                    raise ValidationError("documents must be dicts")
                if unknown := set(d) - {"id", "vector", "vectors", "text"}:
                    raise ValidationError(f"unknown fields {sorted(unknown)}")
            return service.upsert(ns, list(documents))

        return self._do(tenant, work)

    add = upsert

    def search(
        self,
        vector: Sequence[float] | None = None,
        vectors: Sequence[Sequence[float]] | None = None,
        text: str | None = None,
        limit: int = 10,
        tenant: str | None = None,
        nprobes: int | None = None,
        include_vector: bool = False,
        min_similarity: float | None = None,
    ) -> list[Hit]:
        """Hits, best first. A text search builds the full-text index if it must."""

        def work(service: Service, ns: str) -> list[Hit]:
            semantic = None if min_similarity is None else SemanticOptions(True, min_similarity)
            table = service.store.table(ns)
            # Rows that come later are scanned beside the index, until compact() takes them in.
            if text is not None and (m := table.existing()) is not None and m.segments and "fts" not in m.indexes:
                service.create_fts_index(ns)
            return service.query(ns, QueryRequest(vector, vectors, text, limit, nprobes, include_vector, semantic)).hits

        return self._do(tenant, work)

    def import_arrow(self, data: bytes | str | BinaryIO, tenant: str | None = None, max_bytes: int = MAX_BYTES) -> int:
        """Imports an Arrow stream: bytes, a path, or an open file, read as it is needed."""

        def work(service: Service, ns: str) -> int:
            if isinstance(data, bytes) and max_bytes and len(data) > max_bytes:
                raise ValidationError(f"the stream has over {max_bytes} bytes")
            with io.BytesIO(data) if isinstance(data, bytes) else open(data, "rb") if isinstance(data, str) else contextlib.nullcontext(data) as source:
                return service.import_arrow(ns, Limited(source, max_bytes) if max_bytes else source)

        return self._do(tenant, work)

    def list(self, tenant: str | None = None, **options) -> ListPage:
        return self._do(tenant, lambda s, ns: s.list(ns, **options))

    def info(self, tenant: str | None = None) -> Info | None:
        return self._do(tenant, lambda s, ns: s.info(ns))

    def create_index(self, tenant: str | None = None, **options) -> None:
        self._do(tenant, lambda s, ns: s.create_index(ns, **options))

    def create_fts_index(self, tenant: str | None = None) -> None:
        self._do(tenant, lambda s, ns: s.create_fts_index(ns))

    def create_scalar_index(self, column: str, tenant: str | None = None) -> None:
        self._do(tenant, lambda s, ns: s.create_scalar_index(ns, column))

    def compact(self, tenant: str | None = None) -> tuple[int, int]:
        return self._do(tenant, lambda s, ns: s.compact(ns))

    def warmup(self, requests: Sequence[QueryRequest], tenant: str | None = None) -> int:
        return self._do(tenant, lambda s, ns: s.warmup(ns, requests))

    def delete(self, ids: Sequence[int] | None = None, tenant: str | None = None) -> int:
        """Deletes the whole namespace; single rows can't be deleted."""
        if ids is not None:
            raise UnsupportedError("rows can't be deleted one by one")
        return self._do(tenant, lambda s, ns: s.delete(ns))


def connect(path: str | None = None, *, storage_url: str | None = None, spark: SparkSession | None = None) -> Client:
    """Opens a store: an explicit URL, a local path, the environment, or ./skylode_data."""
    spark = spark or SparkSession.builder.appName("skylode").getOrCreate()
    return Client(spark, names.storage_url(path, storage_url))
