"""The engine over HTTP on the local host: query, status, reindex, shutdown and JSON-RPC, and a loop that refreshes."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from codelode.frontend.rpc import Dispatcher

MAX_BODY = 64 << 10


def make_server(dispatcher: Dispatcher, port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is not yet running; port 0 takes a free one."""

    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def reply(self, text: str = "", status: int = 200, kind: str = "text/plain; charset=utf-8") -> None:
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def body(self) -> bytes:
            return self.rfile.read(int(self.headers.get("Content-Length") or 0))

        def engine(self, cwd: str | None):
            return dispatcher.engine_of(cwd)

        def do_GET(self) -> None:
            at = urlsplit(self.path)
            if at.path != "/status":
                return self.reply("Not found", 404)
            with dispatcher.lock:
                e = self.engine(parse_qs(at.query).get("cwd", [None])[0])
                s = e.status().first()
            self.reply(f"OK watching {e.root}: {s['units']} units, {s['files']} files, {s['vector_bytes']} bytes memory\n")

        def do_POST(self) -> None:
            if int(self.headers.get("Content-Length") or 0) > MAX_BODY:
                return self.reply("Request body too large", 413)
            path, body = urlsplit(self.path).path, self.body()
            if path == "/shutdown":
                self.reply("OK shutting down\n")
                threading.Thread(target=self.server.shutdown, daemon=True).start()
            elif path == "/mcp":
                if not body:
                    return self.reply("Missing request body", 400)
                out = dispatcher.answer(body)
                self.reply(out or "", 200 if out is not None else 204, "application/json")
            elif path in ("/query", "/reindex"):
                try:
                    asked = json.loads(body or b"{}")
                except ValueError:
                    return self.reply("Invalid JSON", 400)
                asked = asked if isinstance(asked, dict) else {}
                cwd = asked.get("cwd") if isinstance(asked.get("cwd"), str) else None
                if path == "/reindex":
                    with dispatcher.lock:
                        s = self.engine(cwd).reindex().first()
                    return self.reply(f"OK reindexed: {s['units']} units, {s['files']} files\n")
                if not body:
                    return self.reply("Missing request body", 400)
                if not isinstance(asked.get("query"), str):
                    return self.reply("Missing 'query' field", 400)
                with dispatcher.lock:
                    found = self.engine(cwd).search(asked["query"], mode=asked.get("mode", "vector"), text=True)
                self.reply(found or "# no matching code units found\n")
            else:
                self.reply("Not found", 404)

    return ThreadingHTTPServer((host, port), Handler)


def watch(dispatcher: Dispatcher, engines, seconds: float, stop: threading.Event) -> threading.Thread:
    """Refresh each of ``engines()`` again and again until ``stop`` is set."""

    def loop() -> None:
        while not stop.wait(seconds):
            for e in list(engines()):
                with dispatcher.lock:
                    e.refresh()

    thread = threading.Thread(target=loop, daemon=True)
    thread.start()
    return thread
