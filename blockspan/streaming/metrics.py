"""Speeds and heights of ingest, in the text format that Prometheus reads."""

from __future__ import annotations

import threading

from pyspark.sql.streaming import StreamingQueryListener

#: The gauges and their meaning.
GAUGES = {
    "download_speed": "blocks read per second",
    "write_speed": "blocks written per second",
    "download_height": "last block read",
    "write_height": "last block written",
    "chain_height": "last block of the chain",
}


class Metrics:
    def __init__(self) -> None:
        self._values: dict[str, float] = {}
        self._requests: dict[str, int] = {}
        self._lock = threading.Lock()

    def set(self, gauge: str, value: float) -> None:
        if gauge not in GAUGES:
            raise KeyError(gauge)
        with self._lock:
            self._values[gauge] = value

    def count_request(self, endpoint: str, n: int = 1) -> None:
        with self._lock:
            self._requests[endpoint] = self._requests.get(endpoint, 0) + n

    def encode(self) -> str:
        with self._lock:
            values, requests = dict(self._values), dict(self._requests)
        lines = []
        for name, value in sorted(values.items()):
            lines += [f"# HELP {name} {GAUGES[name]}", f"# TYPE {name} gauge", f"{name} {value:g}"]
        if requests:
            lines += ["# HELP requests requests by endpoint", "# TYPE requests counter"]
            for endpoint, n in sorted(requests.items()):
                label = endpoint.replace("\\", "\\\\").replace('"', '\\"')
                lines.append(f'requests_total{{endpoint="{label}"}} {n}')
        return "\n".join([*lines, "# EOF", ""])


class IngestListener(StreamingQueryListener):
    """Keeps ``Metrics`` up to date from the progress of ingest streams."""

    def __init__(self, metrics: Metrics):
        self.metrics = metrics

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.metrics.set("download_speed", p.inputRowsPerSecond or 0.0)
        self.metrics.set("write_speed", p.processedRowsPerSecond or 0.0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
