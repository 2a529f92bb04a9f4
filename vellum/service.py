"""HTTP front end: GET /health, POST /convert with an image as the body; format=zip or json."""

from __future__ import annotations

import io
import json
import os
import tempfile
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from vellum import pipeline
from vellum.config import Config
from vellum.model import IMAGE_SUFFIXES, MAX_UPLOAD
from vellum.sources import documents as D
from vellum.sources import docx


def server(spark: SparkSession, host: str, port: int, cfg: Config = Config(), results=None) -> ThreadingHTTPServer:
    """A server; one conversion at a time. The upload goes to a folder of the driver, so this is for a local session."""
    lock = threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: bytes, kind: str = "application/json", **more) -> None:
            self.send_response(code)
            for k, v in {"Content-Type": kind, "Content-Length": str(len(body)), **more}.items():
                self.send_header(k.replace("_", "-"), v)
            self.end_headers()
            self.wfile.write(body)

        def _error(self, code: int, what: str) -> None:
            self._send(code, json.dumps({"detail": what}).encode())

        def log_message(self, *args):
            return None

        def do_GET(self):
            self._send(200, b'{"status": "ok"}') if urlparse(self.path).path == "/health" else self._error(404, "not found")

        def do_POST(self):
            url = urlparse(self.path)
            q = parse_qs(url.query)
            form = q.get("format", ["zip"])[0]
            n = int(self.headers.get("Content-Length") or 0)
            if url.path != "/convert":
                return self._error(404, "not found")
            if n > MAX_UPLOAD:
                return self._error(413, "file too large")
            if form not in ("zip", "json"):
                return self._error(422, "format must be zip or json")
            data = self.rfile.read(n)
            if not data:
                return self._error(400, "empty file")
            suffix = os.path.splitext(q.get("name", ["page.jpg"])[0])[1].lower().lstrip(".")
            with lock, tempfile.TemporaryDirectory() as d:
                with open(os.path.join(d, f"result.{suffix if suffix in IMAGE_SUFFIXES else 'jpg'}"), "wb") as f:
                    f.write(data)
                found = pipeline.convert(spark, d, cfg, results)
                docs = found.documents
                row = docs.select(D.as_json(docs).alias("j"), "review").first()
                images = {r["name"]: bytes(r["content"]) for r in pipeline.assets(found.regions).collect()} if row and form == "zip" else {}  # of one page
            if row is None:
                return self._error(422, "cannot decode image")
            head = {"X_Needs_Review": str(row["review"]["needs_review"]).lower(), "X_Page_Score": str(row["review"]["page_score"])}
            if form == "json":
                return self._send(200, row["j"].encode(), **head)
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w") as z:
                z.writestr("result.json", row["j"])
                z.writestr("result.docx", docx.build(json.loads(row["j"]), images))
                for name, content in images.items():
                    z.writestr(name, content)
            self._send(200, buf.getvalue(), "application/zip", **head)

    return ThreadingHTTPServer((host, port), Handler)
