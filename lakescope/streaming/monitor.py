"""Continuous audits: a micro-batch per interval scans the tables and publishes their metrics over HTTP."""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import metrics

log = logging.getLogger(__name__)


class State:
    """The latest page, or what went wrong with the latest scan."""

    def __init__(self):
        self.lock, self.page, self.at, self.error = threading.Lock(), "", None, "no scan yet"

    def set(self, page: str, error: str | None = None) -> None:
        with self.lock:
            self.page, self.error, self.at = page, error, datetime.now(UTC)

    def get(self) -> tuple[str, datetime | None, str | None]:
        with self.lock:
            return self.page, self.at, self.error


def scan_once(scan: Callable[[], DataFrame], state: State) -> None:
    """One pass; a table that fails fails it, and the error is shown until a pass succeeds."""
    try:
        state.set(metrics.exposition(scan()))
    except Exception as e:
        log.exception("scan failed")
        state.set("", str(e))


def watch(spark: SparkSession, scan: Callable[[], DataFrame], state: State, interval_ms: int, once: bool = False) -> StreamingQuery:
    """Scan now and then every interval, as micro-batches of a ticking stream; its first batch is the scan just made."""
    scan_once(scan, state)
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda _, n: scan_once(scan, state) if n else None)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{interval_ms} milliseconds")
    return writer.start()


def serve(state: State, host: str = "", port: int = 9400) -> ThreadingHTTPServer:
    """/metrics and /healthz, 503 after a scan that failed; returns the running server."""
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page, at, error = state.get()
            if self.path == "/metrics":
                self.answer(503 if error else 200, f"# scan error: {error}\n" if error else f"# scanned_at {at:%Y-%m-%dT%H:%M:%SZ}\n{page}", metrics.CONTENT_TYPE)
            elif self.path == "/healthz":
                self.answer(503 if error else 200, "scan-error" if error else "ok", "text/plain")
            else:
                self.answer(404, "not found", "text/plain")

        def answer(self, status: int, text: str, kind: str) -> None:
            body = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def commit_rates(commits: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extension: commits(table_id, ts, added_bytes) as a stream -> commits and bytes per table and window of event time.

    Late commits are taken up to the watermark; state is dropped behind it.
    """
    windowed = commits.withWatermark("ts", late).groupBy(F.window("ts", window), "table_id")
    return windowed.agg(F.count(F.lit(1)).alias("commits"), F.sum("added_bytes").cast("long").alias("added_bytes")).select("table_id", F.col("window.start").alias("start"), "commits", "added_bytes")
