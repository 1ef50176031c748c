"""A small HTTP endpoint of the driver: /metrics for scrapers, /status, and /slot as JSON."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame

from tidelog.operators.monitor import exposition


class Endpoint:
    """Serves what the callables return at the time of a request; DataFrames of one row a metric or slot."""

    def __init__(self, metrics: Callable[[], DataFrame], slots: Callable[[], DataFrame], port: int = 8080, host: str = "127.0.0.1"):
        def answers(path: str) -> tuple[int, str, str]:
            if path == "/status":
                return 200, "text/plain", "OK"
            if path == "/metrics":
                return 200, "text/plain; version=0.0.4", "".join(f"{r['line']}\n" for r in exposition(metrics()).orderBy("line").collect())
            if path == "/slot":
                return 200, "application/json", json.dumps([r.asDict() for r in slots().collect()], default=str)
            return 404, "text/plain", "not found"

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:  # noqa: N802
                try:
                    code, kind, body = answers(self.path.split("?")[0])
                except Exception as e:
                    code, kind, body = 500, "text/plain", type(e).__name__
                self.send_response(code)
                self.send_header("Content-Type", kind)
                self.end_headers()
                self.wfile.write(body.encode())

            def log_message(self, *_) -> None:
                pass

        self.server = ThreadingHTTPServer((host, port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()
