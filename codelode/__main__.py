"""Command line: ``python -m codelode oneshot|serve|mcp|query|status|reindex|stop``."""

from __future__ import annotations

import argparse
import json
import sys
import threading
import urllib.request

SECONDS = {"daemon": 0.5, "global": 2.0}


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("codelode").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def asked(port: int, path: str, body: dict | None) -> str:
    data = None if body is None else json.dumps(body).encode()
    with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", data=data)) as r:
        return r.read().decode()


def run(argv: list[str] | None = None, out=None) -> int:
    out = out or sys.stdout
    p = argparse.ArgumentParser(prog="codelode")
    p.add_argument("command", choices=["oneshot", "daemon", "global", "mcp", "query", "status", "reindex", "stop", "version"])
    p.add_argument("words", nargs="*")
    p.add_argument("--dir", default=".")
    p.add_argument("--port", type=int, default=7390)
    p.add_argument("--mode", default="vector", choices=["vector", "hybrid", "bm25"])
    a = p.parse_args(argv)
    text = " ".join(a.words)
    if a.command == "version":
        print("codelode 1", file=out)
    elif a.command in ("query", "reindex", "stop"):
        path, body = {"query": ("/query", {"cwd": a.dir, "query": text}), "reindex": ("/reindex", {"cwd": a.dir}), "stop": ("/shutdown", {})}[a.command]
        print(asked(a.port, path, body), end="", file=out)
    elif a.command == "status":
        print(asked(a.port, f"/status?cwd={a.dir}", None), end="", file=out)
    else:
        from codelode.frontend import rpc, server
        from codelode.plans.catalog import Catalog

        catalog = Catalog(session())
        dispatcher = rpc.Dispatcher(lambda cwd: catalog.project(cwd if cwd and a.command == "global" else a.dir))
        if a.command == "oneshot":
            print(catalog.project(a.dir).search(text, mode=a.mode, text=True) or "# no matching code units found", end="", file=out)
        elif a.command == "mcp":
            rpc.serve(dispatcher, sys.stdin.buffer, sys.stdout.buffer)
        else:
            stop = threading.Event()
            server.watch(dispatcher, catalog.engines.values, SECONDS[a.command], stop)
            with server.make_server(dispatcher, a.port) as s:
                s.serve_forever()
            stop.set()
    return 0


if __name__ == "__main__":
    sys.exit(run())
