"""The service over HTTP: JSON in and out, Arrow streams for imports.

``Gateway`` maps requests to the service and knows nothing of sockets; ``serve``
puts it behind a threading server. Routes have tiers: health is public, metrics have
a key of their own, reading and writing rows need the write key, what changes a whole
namespace the admin key.
"""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field, fields
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import BinaryIO

from skylode.errors import EngineError, StorageError, TenantError, UnsupportedError, ValidationError
from skylode.plans.access import ADMIN, METRICS, PUBLIC, WRITE, Keys, Limiter, Refused
from skylode.plans.query import QueryRequest, SemanticOptions
from skylode.plans.service import Service
from skylode.sources import arrow_import
from skylode.sources import names as name_rules

#: Fixed values of the interface: content types, headers.
ARROW_STREAM, OCTETS = "application/vnd.apache.arrow.stream", "application/octet-stream"
ASK_SOURCE, TELL_SOURCE = "x-skylode-include-cache-source", "x-skylode-cache-source"
MAX_BODY = 32 << 20


@dataclass(frozen=True)
class Request:
    method: str
    path: str
    headers: dict[str, str] = field(default_factory=dict)  # names in lower case
    body: BinaryIO | None = None
    query: dict[str, str] = field(default_factory=dict)
    address: str = "?"


@dataclass(frozen=True)
class Response:
    status: int
    body: bytes
    headers: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def json(status: int, value: object, **headers: str) -> Response:
        return Response(status, json.dumps(value).encode(), {"content-type": "application/json", **headers})


class _Status(Exception):
    def __init__(self, status: int, message: str):
        super().__init__(message)
        self.status = status


class Gateway:
    def __init__(self, service: Service, keys: Keys = Keys(), per_caller: Limiter | None = None, per_address: Limiter | None = None, max_body: int = MAX_BODY, max_import: int = arrow_import.MAX_BYTES):
        self.service, self.keys, self.max_body, self.max_import = service, keys, max_body, max_import
        self.per_caller, self.per_address = per_caller or Limiter(None), per_address or Limiter(None)
        ns = r"/ns/(?P<ns>[^/]+)"
        self.routes: list[tuple[str, re.Pattern, str, Callable[[Request, str], Response]]] = [
            (m, re.compile(p), tier, work)
            for m, p, tier, work in (
                ("GET", "/health", PUBLIC, lambda *_: Response(200, b"ok", {"content-type": "text/plain"})),
                ("GET", "/metrics", METRICS, self._metrics),
                ("POST", f"{ns}/upsert", WRITE, self._upsert),
                ("POST", f"{ns}/query", WRITE, self._query),
                ("GET", f"{ns}/list", WRITE, self._list),
                ("POST", f"{ns}/warmup", WRITE, self._warmup),
                ("POST", f"{ns}/import", WRITE, self._import),
                ("GET", ns, WRITE, self._info),
                ("GET", "/operations/(?P<ns>[^/]+)", WRITE, self._operation),
                ("DELETE", ns, ADMIN, self._delete),
                ("POST", f"{ns}/index", ADMIN, self._index),
                ("POST", f"{ns}/fts-index", ADMIN, lambda r, n: self._started("create_fts_index", n)),
                ("POST", f"{ns}/scalar-index", ADMIN, self._scalar_index),
                ("POST", f"{ns}/compact", ADMIN, lambda r, n: self._started("compact", n)),
            )
        ]

    def handle(self, request: Request) -> Response:
        try:
            matches = [(m, tier, work, found) for m, p, tier, work in self.routes if (found := p.fullmatch(request.path))]
            for method, tier, work, found in matches:
                if method == request.method:
                    if tier not in (PUBLIC, METRICS):
                        self.per_address.take(request.address)
                    if tier != PUBLIC:
                        caller = self.keys.caller(tier, request.headers.get("authorization"), request.address)
                        if tier != METRICS:
                            self.per_caller.take(caller)
                    return work(request, found.groupdict().get("ns", ""))
            return Response.json(405 if matches else 404, {"error": "method not allowed" if matches else "not found"})
        except Refused as e:
            self.service.metrics.count("auth_rejections_total", e.reason)
            headers = {"retry-after": str(e.wait)} if e.wait else {"www-authenticate": "Bearer"} if e.status == 401 else {}
            return Response.json(e.status, {"error": {401: "unauthorized", 403: "forbidden"}.get(e.status, "rate limited")}, **headers)
        except _Status as e:
            return Response.json(e.status, {"error": str(e)})
        except UnsupportedError as e:
            return Response.json(501, {"error": f"not supported: {e}"})
        except (ValidationError, TenantError) as e:
            return Response.json(400, {"error": f"invalid request: {e}"})
        except StorageError:
            return Response.json(500, {"error": "internal error"})
        except EngineError as e:
            return Response.json(400, {"error": str(e)})
        except Exception:
            # What went wrong inside is nobody's business outside.
            return Response.json(500, {"error": "internal error"})

    # Bodies

    def _json(self, request: Request, known: Iterable[str]) -> dict:
        raw = request.body.read(self.max_body + 1) if request.body else b""
        if len(raw) > self.max_body:
            raise _Status(413, f"the body has over {self.max_body} bytes")
        try:
            value = json.loads(raw or b"{}")
        except ValueError:
            raise ValidationError("the body is not JSON") from None
        if not isinstance(value, dict):
            raise ValidationError("the body must be an object")
        if unknown := set(value) - set(known):
            raise ValidationError(f"unknown fields {sorted(unknown)}")
        return value

    @staticmethod
    def _request(raw: object) -> QueryRequest:
        own = {f.name for f in fields(QueryRequest)}
        if not isinstance(raw, dict) or set(raw) - own:
            raise ValidationError(f"a query is an object of {sorted(own)}")
        given = dict(raw)
        if given.get("semantic_cache") is not None:
            try:
                given["semantic_cache"] = SemanticOptions(**given["semantic_cache"])
            except TypeError:
                raise ValidationError("semantic_cache holds enabled and min_similarity") from None
        for name, kind in (("k", int), ("nprobes", int), ("text", str), ("vector", list), ("vectors", list), ("include_vector", bool)):
            if given.get(name) is not None and (not isinstance(given[name], kind) or (kind is int and isinstance(given[name], bool))):
                raise ValidationError(f"{name} has the wrong type")
        return QueryRequest(**given)

    # Rows

    def _upsert(self, request: Request, ns: str) -> Response:
        rows = self._json(request, ["rows"]).get("rows")
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise ValidationError("rows must be a list of objects")
        name_rules.namespace(ns)
        return Response.json(200, {"upserted": self.service.upsert(ns, rows)})

    def _query(self, request: Request, ns: str) -> Response:
        outcome = self.service.query(ns, self._request(self._json(request, [f.name for f in fields(QueryRequest)])))
        hits = [asdict(h) for h in outcome.hits]
        headers = {TELL_SOURCE: outcome.source} if request.headers.get(ASK_SOURCE) in ("1", "true", "yes") else {}
        return Response.json(200, {"results": hits, "query_id": outcome.query_id}, **headers)

    def _list(self, request: Request, ns: str) -> Response:
        given = dict(request.query)
        if unknown := set(given) - {"limit", "order", "cursor", "order_by"}:
            raise ValidationError(f"unknown parameters {sorted(unknown)}")
        if "limit" in given:
            if not given["limit"].isdecimal():
                raise ValidationError("limit must be a number")
            given["limit"] = int(given["limit"])
        page = self.service.list(ns, **given)
        return Response.json(200, {"rows": [asdict(r) for r in page.rows], "next_cursor": page.next_cursor})

    def _info(self, request: Request, ns: str) -> Response:
        found = self.service.info(ns)
        return Response.json(200, asdict(found)) if found else Response.json(404, {"error": f"no namespace {ns}"})

    def _import(self, request: Request, ns: str) -> Response:
        name_rules.namespace(ns)
        kind = request.headers.get("content-type", "").split(";")[0].strip()
        if kind not in (ARROW_STREAM, OCTETS):
            raise _Status(415, f"imports are of type {ARROW_STREAM}")
        # Kept on the driver's disk until the import is done; the reply does not wait for that.
        spool = tempfile.TemporaryFile(prefix="skylode-import-")
        size = 0
        while request.body and (chunk := request.body.read(1 << 20)):
            size += len(chunk)
            if self.max_import and size > self.max_import:
                spool.close()
                raise _Status(413, f"the import has over {self.max_import} bytes")
            spool.write(chunk)
        spool.seek(0)
        arrow_import.read_stream(spool)
        spool.seek(0)
        return self._started("import_arrow", ns, spool)

    # Background work

    def _started(self, kind: str, ns: str, /, *args: object, more: dict | None = None, **options: object) -> Response:
        key, _ = self.service.submit(kind, ns, *args, **options)
        return Response.json(202, {"operation_id": key, "kind": kind, "namespace": ns, "status": "running", **(more or {})})

    def _warmup(self, request: Request, ns: str) -> Response:
        queries = self._json(request, ["queries"]).get("queries")
        if not isinstance(queries, list):
            raise ValidationError("queries must be a list")
        return self._started("warmup", ns, [self._request(q) for q in queries], more={"queued": len(queries)})

    def _index(self, request: Request, ns: str) -> Response:
        given = self._json(request, ["kind", "num_partitions", "num_sub_vectors", "num_bits"])
        if given.get("kind") not in (None, "ivf_pq"):
            raise ValidationError("kind must be ivf_pq")
        return self._started("create_index", ns, **{k: v for k, v in given.items() if v is not None})

    def _scalar_index(self, request: Request, ns: str) -> Response:
        return self._started("create_scalar_index", ns, self._json(request, ["column"]).get("column") or "_ingested_at")

    def _operation(self, request: Request, key: str) -> Response:
        found = self.service.operations.get(key)
        return Response.json(200, asdict(found)) if found else Response.json(404, {"error": "no such operation"})

    # Administration

    def _delete(self, request: Request, ns: str) -> Response:
        return Response.json(200, {"objects_deleted": self.service.delete(ns)})

    def _metrics(self, request: Request, _: str) -> Response:
        return Response(200, self.service.metrics.exposition().encode(), {"content-type": "text/plain; version=0.0.4"})


class _Body:
    """A request's body, which ends after so many bytes."""

    def __init__(self, source: BinaryIO, left: int):
        self.source, self.left = source, left

    def read(self, size: int = -1) -> bytes:
        data = self.source.read(self.left if size < 0 else min(size, self.left))
        self.left -= len(data)
        return data


def serve(gateway: Gateway, host: str = "127.0.0.1", port: int = 8080, trust_proxy: bool = False) -> ThreadingHTTPServer:
    """A server that is ready to ``serve_forever``; port 0 takes a free one."""
    from urllib.parse import parse_qsl, urlsplit

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _reply(self) -> None:
            url = urlsplit(self.path)
            headers = {k.lower(): v for k, v in self.headers.items()}
            address = headers.get("x-forwarded-for", "").split(",")[0].strip() if trust_proxy else ""
            length = headers.get("content-length", "0")
            body = _Body(self.rfile, int(length) if length.isdecimal() else 0)
            answer = gateway.handle(Request(self.command, url.path, headers, body, dict(parse_qsl(url.query)), address or self.client_address[0]))
            self.close_connection |= body.left > 0  # nothing may be left of an unread body
            self.send_response(answer.status)
            for name, value in {**answer.headers, "content-length": str(len(answer.body))}.items():
                self.send_header(name, value)
            self.end_headers()
            self.wfile.write(answer.body)

        do_GET = do_POST = do_DELETE = do_PUT = _reply

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
