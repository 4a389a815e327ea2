"""JSON-RPC over an engine: the nine calls as tools, and messages framed by their length on a pair of streams."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from typing import BinaryIO

from codelode.plans import engine as defaults
from codelode.plans.engine import Engine

# Protocol version, and codes of errors.
PROTOCOL = "2024-11-05"
PARSE, INVALID, NO_METHOD, BAD_PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603
NAME = "codelode"


def _text(a: dict, key: str) -> str:
    return a[key] if isinstance(a.get(key), str) else ""


def _query(e: Engine, a: dict) -> str:
    return e.search(_text(a, "query"), a.get("top_k", defaults.TOP_K), text=True) or "No matching code units found."


def _status(e: Engine, a: dict) -> str:
    s = e.status().first()
    return f"{NAME} index: {s['units']} code units, {s['files']} files in {e.root}\nmemory: {s['vector_bytes']} bytes"


def _reindex(e: Engine, a: dict) -> str:
    s = e.reindex().first()
    return f"reindexed: {s['units']} units, {s['files']} files"


def _ast(e: Engine, a: dict) -> str:
    return e.ast(a.get("file") or None, _text(a, "pattern") or None, text=True)


#: tool: (what it does, its arguments and their types, those it needs, the call)
TOOLS: dict[str, tuple[str, dict, tuple[str, ...], Callable[[Engine, dict], str]]] = {
    "query": ("Find functions, types and imports for a question in words.", {"query": "string", "top_k": "number"}, ("query",), _query),
    "status": ("Size of the index.", {}, (), _status),
    "reindex": ("Scan the project again and rebuild its index.", {}, (), _reindex),
    "ast": ("Outline of a file, of several files or of the project.", {"file": ["string", "array"], "pattern": "string"}, (), _ast),
    "refs": ("Where a symbol is defined, and what imports it.", {"symbol": "string"}, ("symbol",), lambda e, a: e.refs(a["symbol"], text=True)),
    "impact": ("What a change of a symbol touches.", {"symbol": "string", "max_depth": "number"}, ("symbol",), lambda e, a: e.impact(a["symbol"], a.get("max_depth", defaults.MAX_DEPTH), text=True)),
    "context": ("A symbol's definition, users, imports and neighbours.", {"symbol": "string"}, ("symbol",), lambda e, a: e.context(a["symbol"], text=True)),
    "changes": ("Symbols that a git diff touches.", {"diff_target": "string"}, (), lambda e, a: e.changes(a["diff_target"] if isinstance(a.get("diff_target"), str) else defaults.TARGET, text=True)),
    "clusters": ("Groups of similar symbols.", {"threshold": "number", "min_size": "number"}, (), lambda e, a: e.clusters(a.get("threshold"), a.get("min_size"), text=True)),
}


def _tool(name: str) -> dict:
    about, properties, needed, _ = TOOLS[name]
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in {**properties, "cwd": "string"}.items()}, "required": list(needed)}}


def _call(engine_of: Callable[[str | None], Engine], params) -> dict:
    """The result of a tool, or of a failure that is the caller's to see."""
    a = params.get("arguments")
    a = a if isinstance(a, dict) else {}
    said = lambda text, wrong=False: {"content": [{"type": "text", "text": text}], **({"isError": True} if wrong else {})}
    if params["name"] not in TOOLS:
        return said("Unknown tool", True)
    _, _, needed, call = TOOLS[params["name"]]
    for k in needed:
        if not _text(a, k):
            return said(f"Missing required argument: {k}", True)
    return said(call(engine_of(_text(a, "cwd") or None), a))


class Dispatcher:
    """Answers messages one at a time. ``engine_of`` gives the engine for a working directory."""

    def __init__(self, engine_of: Callable[[str | None], Engine]):
        self.engine_of, self.lock = engine_of, threading.Lock()

    def answer(self, body: bytes | str) -> str | None:
        """The response, or None for a notification."""
        done = lambda i, **x: json.dumps({"jsonrpc": "2.0", "id": i, **x}, ensure_ascii=False, separators=(",", ":"))
        fail = lambda i, code, text: done(i, error={"code": code, "message": text})
        try:
            m = json.loads(body)
        except ValueError:
            return fail(None, PARSE, "Parse error")
        if not isinstance(m, dict):
            return fail(None, INVALID, "Invalid request")
        i, method = m.get("id"), m.get("method")
        if not isinstance(method, str):
            return fail(i, INVALID, "Missing method")
        if method in ("initialized", "notifications/initialized", "notifications/cancelled"):
            return None
        simple = {
            "initialize": {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": NAME, "version": "1"}},
            "ping": {}, "tools/list": {"tools": [_tool(k) for k in TOOLS]}, "resources/list": {"resources": []}, "prompts/list": {"prompts": []},
        }
        if method in simple:
            return done(i, result=simple[method])
        if method != "tools/call":
            return fail(i, NO_METHOD, "Method not found")
        params = m.get("params")
        if not isinstance(params, dict):
            return fail(i, BAD_PARAMS, "Missing params")
        if not isinstance(params.get("name"), str):
            return fail(i, BAD_PARAMS, "Missing tool name")
        try:
            with self.lock:
                return done(i, result=_call(self.engine_of, params))
        except Exception as e:  # told to the caller, as the process goes on
            return fail(i, INTERNAL, f"Internal error: {type(e).__name__}")


def read_message(stream: BinaryIO) -> bytes | None:
    """The body of the next message, or None at the end."""
    size = None
    while (line := stream.readline()) not in (b"\r\n", b"\n"):
        if not line:
            return None
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            size = int(value)
    if size is None:
        raise ValueError("a message without Content-Length")
    body = stream.read(size)
    return body if len(body) == size else None


def write_message(stream: BinaryIO, body: str) -> None:
    data = body.encode()
    stream.write(b"Content-Length: %d\r\n\r\n" % len(data) + data)
    stream.flush()


def serve(dispatcher: Dispatcher, source: BinaryIO, sink: BinaryIO) -> None:
    """Answer messages until the source ends."""
    while (body := read_message(source)) is not None:
        if (out := dispatcher.answer(body)) is not None:
            write_message(sink, out)
