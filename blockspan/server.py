"""A small HTTP face: ``POST /query``, ``GET /height``, ``GET /metrics``, and a forwarder
of JSON-RPC requests with a rate limit. Queries run as Spark jobs of one session."""

from __future__ import annotations

import json
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .plans.paging import Admission, Limits, answer, to_json
from .plans.query import parse_query
from .sources.rpc import RateLimit, Retry, RpcError, Transport, http, in_chunks, results_of
from .sources.storage import Archive
from .streaming.metrics import Metrics

#: The header by which a client picks the node.
TARGET_HEADER = "rpc_proxy_target"


class Service:
    """The answers, without HTTP."""

    def __init__(self, archive: Archive, limits: Limits = Limits(), metrics: Metrics | None = None):
        self.archive, self.limits, self.metrics = archive, limits, metrics or Metrics()
        self.admission = Admission(limits.max_queries)

    def query(self, body: bytes | str | dict) -> str:
        with self.admission():
            query, height = parse_query(body), self.archive.height()
            end = height if query.end is None else min(height, query.end)
            tables = self.archive.tables(query.first, max(end, query.first))
            return to_json(answer(tables, query, height, self.limits))

    def height(self) -> str:
        n = self.archive.height()
        return json.dumps({"height": n - 1 if n else None})


class Forwarder:
    """JSON-RPC requests, one or a batch, passed on to a node."""

    def __init__(self, default: str | None, transport: Transport = http, per_second: int | None = None, retry: Retry = Retry(), max_batch: int | None = None, metrics: Metrics | None = None):
        self.default, self.transport, self.retry, self.max_batch = default, transport, retry, max_batch
        self.rates, self.metrics = RateLimit(per_second), metrics or Metrics()

    def _send(self, target: str, body):
        n = len(body) if isinstance(body, list) else 1
        self.rates.count(target, n)
        self.metrics.count_request(target, n)
        return self.retry(lambda: self.transport(target, body))

    def __call__(self, body: dict | list, target: str | None = None) -> dict | list:
        target = target or self.default
        if not target:
            raise RpcError("no target")
        if isinstance(body, dict):
            return self._send(target, body)
        out = []
        for chunk in in_chunks(body, self.max_batch):
            replies = self._send(target, chunk)
            results_of(replies, chunk)
            out += replies
        return out


def serve(routes: dict[tuple[str, str], Callable[[bytes, dict], str]], host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    """A server for ``(method, path) -> function(body, headers)``; errors are 500 with
    their text, unknown routes 404."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            f = routes.get((self.command, self.path.split("?")[0]))
            status, text = 404, "not found"
            if f:
                try:
                    body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                    status, text = 200, f(body, dict(self.headers))
                except Exception as e:  # noqa: BLE001 - the client gets to know
                    status, text = 500, str(e)
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json" if status == 200 and text[:1] in "{[" else "text/plain")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def archive_routes(service: Service) -> dict:
    return {
        ("POST", "/query"): lambda body, _: service.query(body),
        ("GET", "/height"): lambda *_: service.height(),
        ("GET", "/metrics"): lambda *_: service.metrics.encode(),
        ("GET", "/ingest-metrics"): lambda *_: service.metrics.encode(),
    }


def forwarder_routes(forwarder: Forwarder, target_header: str = TARGET_HEADER) -> dict:
    return {
        ("POST", "/"): lambda body, headers: json.dumps(forwarder(json.loads(body), headers.get(target_header))),
        ("GET", "/metrics"): lambda *_: forwarder.metrics.encode(),
    }
