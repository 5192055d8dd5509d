"""Progress of streams as metrics, in Prometheus text where that is wanted."""

from __future__ import annotations

import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql.streaming import StreamingQueryListener


class Metrics(StreamingQueryListener):
    """Rows, batches and failures of all streams of a session. add it by spark.streams.addListener."""

    def __init__(self) -> None:
        self.counters: Counter[str] = Counter()
        self.gauges: dict[str, float] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.gauges["streams_running"] = self.gauges.get("streams_running", 0) + 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self._lock:
            self.counters["rows_total"] += p.numInputRows
            self.counters["batches_total"] += 1
            self.gauges["rows_per_second"] = p.processedRowsPerSecond or 0.0
            self.gauges["batch_seconds"] = (p.batchDuration or 0) / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._lock:
            self.gauges["streams_running"] = self.gauges.get("streams_running", 1) - 1
            if event.exception:
                self.counters["failures_total"] += 1

    def text(self) -> str:
        with self._lock:
            lines = [f"# TYPE changelog_{k} counter\nchangelog_{k} {v}" for k, v in sorted(self.counters.items())]
            return "\n".join([*lines, *[f"# TYPE changelog_{k} gauge\nchangelog_{k} {v}" for k, v in sorted(self.gauges.items())], ""])


class NoMetrics(StreamingQueryListener):
    """The same interface where nothing is to be counted."""

    counters: Counter[str] = Counter()
    gauges: dict[str, float] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def text(self) -> str:
        return ""


def serve(metrics: Metrics | NoMetrics, port: int = 0) -> ThreadingHTTPServer:
    """GET /metrics and /health; all else is 404. Runs in a thread until shutdown()."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            found = {"/metrics": ("text/plain; version=0.0.4", metrics.text()), "/health": ("application/json", '{"status":"ok"}')}.get(self.path)
            kind, body = found or ("text/plain", "not found\n")
            self.send_response(200 if found else 404)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_: object) -> None:
            pass

    server = ThreadingHTTPServer(("127.0.0.1", port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
