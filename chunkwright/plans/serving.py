"""Serves a store's folder over HTTP from the driver, so that queries have a remote store to read."""

from __future__ import annotations

import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

_SERVERS: dict[tuple[str, str, int], str] = {}


def serve(spark: SparkSession, folder: str, failing: int = 0) -> str:
    """The URL of a folder; of each key's requests the first ``failing`` get a 503. One server for each folder and application."""
    at = (spark.sparkContext.applicationId, folder, failing)
    if at in _SERVERS:
        return _SERVERS[at]
    filesystem, base = pafs.FileSystem.from_uri(folder)
    asked: dict[str, int] = {}
    guard = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def answer(self, status: int, body: bytes = b"", size: int | None = None) -> None:
            self.send_response(status)
            self.send_header("Content-Length", str(len(body) if size is None else size))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:  # noqa: N802
            with guard:
                asked[self.path] = asked.get(self.path, 0) + 1
                refused = asked[self.path] <= failing
            if refused:
                return self.answer(503)
            try:
                with filesystem.open_input_file(f"{base}{self.path}") as source:
                    if self.command == "HEAD":
                        return self.answer(200, size=source.size())
                    if wanted := self.headers.get("Range"):
                        low, high = map(int, wanted.removeprefix("bytes=").split("-"))
                        return self.answer(206, source.read_at(high - low + 1, low))
                    return self.answer(200, source.read())
            except FileNotFoundError:
                return self.answer(404)

        do_HEAD = do_GET  # noqa: N815

        def log_message(self, *args: object) -> None:
            return

    server = ThreadingHTTPServer(("", 0), Handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    one_process = spark.sparkContext.master.startswith("local[")
    host = "127.0.0.1" if one_process else spark.sparkContext.getConf().get("spark.driver.host", "127.0.0.1")
    _SERVERS[at] = f"http://{host}:{server.server_port}"
    return _SERVERS[at]
