import numpy as np
from pyspark.sql import functions as F

from codelode.functions import hypervectors as hv
from codelode.functions.text import search_tokens, split_identifier
from codelode.operators import changes, clusters, extract, graph, outline, ranking
from codelode.plans.engine import Engine
from codelode.sources.files import glob_regex, parse_ignore, scan_tree
from codelode.streaming.refresh import read_units, start_refresh

UNITS = "kind string, name string, signature string, file_path string, line_number int, module_name string"


def test_split_and_tokens(spark):
    df = spark.createDataFrame([("handleAuthError",), ("HTTPServer",), ("parseJSON",), ("src/auth.zig",)], "s string")
    got = [r[0] for r in df.select(split_identifier(F.col("s"))).collect()]
    assert got == [["handle", "Auth", "Error"], ["HTTPServer"], ["parse", "JSON"], ["src/auth", "zig"]]
    words = spark.range(1).select(search_tokens(F.lit("plain fooBar"))).first()[0]
    assert sorted(words) == ["bar", "foo", "foobar", "plain", "plain"]


def test_vector_algebra(spark):
    v = hv.expand(np.arange(5, dtype=np.uint64) + np.uint64(42))
    assert (v[0] ^ v[1] ^ v[1] == v[0]).all()
    bits = np.bitwise_count(v[0] ^ v[1]).sum()
    assert abs(1 - 2 * bits / hv.DIMENSION) < 0.1
    m = hv.majority(v[:3])
    assert all(1 - 2 * np.bitwise_count(m ^ x).sum() / hv.DIMENSION > 0 for x in v[:3])
    assert (hv.majority(v[:1]) == v[0]).all() and not hv.majority(v[:0]).any()
    many = hv.expand(np.arange(500, dtype=np.uint64))
    rows = [("a", x) for x in v] + [("b", v[0])] + [("c", x) for x in many] + [("d", x) for x in many[:40]]
    df = spark.createDataFrame([(k, x.view(np.int64).tolist()) for k, x in rows], "k string, vector array<bigint>").repartition(5)
    turned = df.where("k = 'b'").select(hv.permute(hv.permute("vector", 7), 64 * hv.WORDS - 7).alias("back"), hv.permute("vector", 64).alias("word")).first()
    assert turned["back"] == v[0].view(np.int64).tolist() and turned["word"][1:] == turned["back"][:-1] and turned["word"][0] == turned["back"][-1]
    got = {r["k"]: r["vector"] for r in hv.bundle(df, "k").collect()}
    assert got["b"] == v[0].view(np.int64).tolist()
    for k, own in (("a", v), ("c", many), ("d", many[:40])):
        assert got[k] == hv.majority(own).view(np.int64).tolist(), k
    assert hv.widest_distance(0.1) == 4499 and 1 - 2 * hv.widest_distance(0.15) / 1e4 >= 0.15


def test_bm25_orders(spark):
    docs = spark.createDataFrame([(0, "database"), (1, "database database"), (2, "other words")], "doc_id long, text string")
    assert [r[0] for r in ranking.top(ranking.bm25(docs, "database"), 5).collect()] == [1, 0]
    assert ranking.bm25(docs, "").count() == 0


def test_fusion(spark):
    lists = [spark.createDataFrame([(d, i + 1) for i, d in enumerate(x)], "doc_id long, rank int") for x in ([0, 1, 2], [1, 2, 3])]
    first = ranking.fuse(*lists, 10).collect()
    assert len(first) == 4 and (first[0]["doc_id"], first[0]["bm25_rank"], first[0]["hdc_rank"]) == (1, 2, 1)


def test_extract(spark):
    files = [
        ("a.go", "go", "func (s *T) Start() {"), ("b.py", "python", "from . import x\nasync def go():"), ("c.rs", "rust", "use crate::a::B;"), ("d.ts", "typescript", "import { foo } from 'x'"),
        ("e.java", "java", "a.b(x)\nif (x) y();"), ("f.c", "c", "foo(x);\nif (x)\nint *bar(void)\n#define X(y)"), ("g.zig", "zig", "pub const A = struct {\nconst s = @import(\"std\");\npub fn run() void {"),
    ]
    got = {(r["file_path"], r["kind"], r["name"], r["line_number"]) for r in extract.extract_units(spark.createDataFrame(files, "file_path string, lang string, source string")).collect()}
    assert got == {
        ("a.go", "fn", "s", 1), ("b.py", "import", "import", 1), ("b.py", "fn", "go", 2), ("c.rs", "import", "crate", 1), ("d.ts", "import", "foo", 1), ("e.java", "fn", "b", 1), ("f.c", "fn", "foo", 1),
        ("f.c", "fn", "bar", 3), ("g.zig", "type", "A", 1), ("g.zig", "import", "std", 2), ("g.zig", "fn", "run", 3),
    }


def test_outline():
    source = 'const std = @import("std");\n\npub const Color = enum {\n    red,\n    green,\n};\n\npub const Box = struct {\n    width: u32,\n    fn area() u32 {\n        const n = 1;\n        return "}{";\n    }\n};\n'
    got = [(n["depth"], n["kind"], n["name"]) for n in outline.parse(source, "zig")]
    assert got == [(0, "import", "std"), (0, "type", "Color"), (1, "field", "red"), (1, "field", "green"), (0, "type", "Box"), (1, "field", "width"), (1, "fn", "area"), (2, "var", "n")]
    got = [(n["depth"], n["kind"], n["name"]) for n in outline.parse("class A:\n    x: int\n    def f(self):\n        self.y = 1\n", "python")]
    assert got == [(0, "type", "A"), (1, "field", "x"), (1, "fn", "f"), (2, "field", "y")]


def units(spark, rows):
    return spark.createDataFrame([(k, n, f"{k} {n}", f, i, "m") for k, n, f, i in rows], UNITS)


def test_impact_cycle_and_depth(spark):
    u = units(spark, [("fn", "A", "a", 1), ("import", "B", "a", 2), ("fn", "B", "b", 1), ("import", "A", "b", 2), ("fn", "C", "c", 1), ("import", "B", "c", 2)])
    run = lambda d: {(r["name"], r["depth"]) for r in graph.impact(graph.definitions(u), graph.references(u), "A", d).collect()}
    assert run(10) == {("A", 0), ("B", 1), ("C", 2)} and run(1) == {("A", 0), ("B", 1)}
    assert graph.impact(graph.definitions(u), graph.references(u), "none", 2).count() == 0


def test_path_imports_resolve(spark):
    u = units(spark, [("fn", "helpers", "u", 1), ("import", "./utils/helpers", "m", 1), ("type", "auth", "x", 1), ("import", "auth.zig", "m", 2), ("import", "nope", "m", 3)])
    assert {(r["def_name"], r["import_name"]) for r in graph.references(u).collect()} == {("helpers", "./utils/helpers"), ("auth", "auth.zig")}


def test_first_hunk_counts(spark):
    u = units(spark, [("fn", "x", "f", 15), ("fn", "y", "f", 16)])
    diff = "+++ b/f\n@@ -1,0 +11,5 @@\n@@ -15,1 +15,1 @@\n"
    got = changes.touched(changes.parse_hunks(spark.createDataFrame([(0, diff)], "diff_id long, diff string")), u).collect()
    assert [(r["name"], r["change"]) for r in got] == [("x", "added")]


def test_globs():
    import re

    for pattern, path, hit in [("*.js", "a.js", 1), ("src/*.ts", "src/a/b.ts", 1), ("**/x", "a/x", 1), ("a?c", "abc", 1), ("a?c", "ac", 0), ("*.js", "a.ts", 0)]:
        assert bool(re.search(glob_regex(pattern), path)) == bool(hit), pattern
    assert parse_ignore("# c\n!keep\n/out/\n\n*.log\n") == [("keep", True), ("out", False), ("*.log", False)]


def test_engine_over_a_tree(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "build").mkdir()
    (tmp_path / ".gitignore").write_text("skip.py\n")
    (tmp_path / "src/auth.py").write_text("def handle_auth(request):\n    pass\n\ndef process_payment(amount):\n    pass\n")
    (tmp_path / "src/login.py").write_text("from handle_auth import x\nclass Login:\n    def enter(self):\n        pass\n")
    for name in ("build/gone.py", "skip.py", "readme.md"):
        (tmp_path / name).write_text("def nothing():\n    pass\n")
    assert scan_tree(spark, str(tmp_path)).count() == 2
    e = Engine(spark, scan_tree(spark, str(tmp_path)), str(tmp_path))
    status = e.status().first()
    assert (status["units"], status["files"]) == (5, 2)
    for mode in ("hybrid", "vector", "bm25"):
        assert e.search("auth handle", 3, mode).first()["name"] == "handle_auth"
    assert "functions[" in e.search("auth", text=True)
    assert "handle_auth" in e.refs("handle_auth", text=True) and "references[1]" in e.refs("handle_auth", text=True)
    assert 'impact{source:"handle_auth",affected:3,max_depth:1}' in e.impact("handle_auth", text=True)
    assert "siblings[1]" in e.context("handle_auth", text=True)
    assert "nodes:" in e.ast(pattern="*.py", text=True)
    assert e.clusters(0.0, 2, text=True).startswith("clusters[")
    (tmp_path / "src/auth.py").unlink()
    assert e.reindex().first()["files"] == 1


def test_clusters_label(spark):
    m = spark.createDataFrame([(0, "userAuth"), (0, "loginAuth"), (0, "tokenAuth"), (1, "___")], "cluster_id int, name string")
    got = {r["cluster_id"]: r["label"] for r in clusters.labels(m).collect()}
    assert got == {0: "auth-login-token", 1: "unnamed"}


def test_similar_and_near_pairs(spark):
    """Blocks of any size give all pairs; samples of bits find what lies near, copies once each."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2, (12, 64 * 4), dtype=np.uint8)
    rows = []
    for i in range(90):
        x = base[i % 12].copy()
        x[rng.choice(256, i % 20, replace=False)] ^= 1
        rows.append(np.packbits(x, bitorder="little").view(np.int64))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "unit_id long, vector array<bigint>")
    apart = lambda a, b: int(np.bitwise_count((rows[a] ^ rows[b]).view(np.uint64)).sum())
    want = {(a, b, apart(a, b)) for a in range(90) for b in range(a + 1, 90) if apart(a, b) <= 40}
    for block in (7, 4096):
        assert {tuple(r) for r in clusters.similar_pairs(df, 40, block=block).collect()} == want
    near = {tuple(r) for r in clusters.near_pairs(df, 40, bits=12, miss=1e-4).collect()}
    first = [i for i in range(90) if not any(apart(i, j) == 0 for j in range(i))]
    firsts = {(a, b, d) for a, b, d in want if a in first and b in first}
    assert near <= want and len(near & firsts) >= 0.99 * len(firsts)
    twice = df.unionByName(df.selectExpr("unit_id + 100 unit_id", "vector"))
    assert {(a, b) for a, b, d in (tuple(r) for r in clusters.near_pairs(twice, 40, bits=12, miss=1e-4).collect()) if b >= 100 and d == 0} >= {(i, i + 100) for i in range(90) if not any(apart(i, j) == 0 for j in range(i))}
    labels = [{(r["unit_id"], r["root"]) for r in clusters.connected(twice.select("unit_id"), pairs).collect()} for pairs in (clusters.similar_pairs(twice, 40), clusters.near_pairs(twice, 40, bits=12, miss=1e-4))]
    assert labels[0] == labels[1]
    assert clusters.tables_needed(0, 256, 12, 1e-3) == 1
    try:
        clusters.near_pairs(df, 120)
        raise AssertionError
    except ValueError as e:
        assert "compare exactly" in str(e)


def test_numbering_and_prefix_sums(spark):
    from codelode.functions.tables import numbered, prefix_sums

    rows = [(f"f{i % 17:02d}", i) for i in range(300)]
    got = numbered(spark.createDataFrame(rows, "a string, b int"), ["a", "b"], "n").collect()
    assert [r["n"] for r in sorted(got, key=lambda r: (r["a"], r["b"]))] == list(range(300))
    assert numbered(spark.createDataFrame([], "a string, b int"), ["a", "b"], "n").count() == 0
    sums = prefix_sums(spark.createDataFrame([(0, b, o, 2) for b in range(3) for o in range(4)], "p int, b int, o int, v long"), ["p"], ["b"], ["o"], F.col("v"), "s").orderBy("b", "o").collect()
    assert [r["s"] for r in sums] == list(range(0, 24, 2))


def test_refresh_stays(spark, tmp_path):
    (tmp_path / "a.py").write_text("def one():\n    pass\n")
    (tmp_path / "b.py").write_text("def two():\n    pass\n")
    (tmp_path / "pyproject.toml").write_text("")
    e = Engine.open(spark, str(tmp_path))
    assert {r["name"] for r in e.units.collect()} == {"one", "two"} and e.search("one", 1, "bm25").first()["name"] == "one"
    import os

    (tmp_path / "a.py").write_text("def three():\n    pass\n")
    os.utime(tmp_path / "a.py", (2e9, 2e9))
    (tmp_path / "b.py").unlink()
    (tmp_path / "c.py").write_text("def four():\n    pass\n")
    assert e.refresh().first()["units"] == 2 and {r["name"] for r in e.units.collect()} == {"three", "four"}
    assert e.search("three", 1, "bm25").first()["name"] == "three" and e.search("one", 5, "bm25").count() == 0


def test_git_changes(spark, tmp_path):
    import subprocess

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("def one():\n    pass\n\ndef two():\n    pass\n")
    run("add", ".")
    run("commit", "-qm", "x")
    (tmp_path / "a.py").write_text("def one():\n    pass\n\ndef two(x):\n    pass\n")
    found = Engine.open(spark, str(tmp_path)).changes()
    assert [(r["name"], r["change"]) for r in found.collect()] == [("two", "modified")]


def test_front_ends(spark, tmp_path):
    import io
    import json
    import threading
    import urllib.error
    import urllib.request

    from codelode import __main__ as main
    from codelode.frontend import rpc, server
    from codelode.plans.catalog import Catalog

    (tmp_path / "Makefile").write_text("")
    (tmp_path / "a.py").write_text("def handle_auth():\n    pass\n")
    catalog = Catalog(spark)
    d = rpc.Dispatcher(lambda cwd: catalog.project(cwd or str(tmp_path)))
    asked = [{"id": 1, "method": "initialize"}, {"method": "initialized"}, {"id": 2, "method": "tools/call", "params": {"name": "query", "arguments": {"query": "handle auth", "top_k": 1}}}]
    sink = io.BytesIO()
    rpc.serve(d, io.BytesIO(b"".join(b"Content-Length: %d\r\n\r\n%s" % (len(json.dumps(m)), json.dumps(m).encode()) for m in asked)), sink)
    sink.seek(0)
    said = [json.loads(rpc.read_message(sink)) for _ in range(2)]
    assert said[0]["result"]["protocolVersion"] == rpc.PROTOCOL and "handle_auth" in said[1]["result"]["content"][0]["text"] and rpc.read_message(sink) is None
    assert len(json.loads(d.answer('{"id":1,"method":"tools/list"}'))["result"]["tools"]) == 9
    for name, args in (("status", {}), ("ast", {"file": "a.py"}), ("clusters", {}), ("changes", {}), ("reindex", {}), ("context", {"symbol": "handle_auth"})):
        got = json.loads(d.answer(json.dumps({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}})))
        assert "result" in got and "isError" not in got["result"], (name, got)
    web = server.make_server(d)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    port = str(web.server_port)
    for words, part in ((["query", "handle", "auth", "--dir", str(tmp_path)], "handle_auth"), (["status", "--dir", str(tmp_path)], "1 units"), (["reindex", "--dir", str(tmp_path)], "OK reindexed"), (["version"], "codelode")):
        out = io.StringIO()
        assert main.run([*words, "--port", port], out) == 0 and part in out.getvalue()
    post = lambda path, body: urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{port}{path}", data=body))
    assert json.loads(post("/mcp", b'{"id":1,"method":"ping"}').read())["result"] == {} and post("/mcp", b'{"method":"initialized"}').status == 204
    for path, body, code in (("/query", b"{", 400), ("/query", b"{}", 400), ("/nope", b"{}", 404), ("/query", b"x" * (server.MAX_BODY + 1), 413)):
        try:
            post(path, body)
            raise AssertionError
        except urllib.error.HTTPError as e:
            assert e.code == code
    out = io.StringIO()
    main.run(["stop", "--port", port], out)
    assert "shutting down" in out.getvalue()


def test_size_cap_and_unreadable_files(spark, tmp_path):
    (tmp_path / "small.py").write_text("def a():\n    pass\n")
    (tmp_path / "large.py").write_text("#" * 300)
    (tmp_path / "gone.py").symlink_to(tmp_path / "nowhere.py")
    assert [r["file_path"] for r in scan_tree(spark, str(tmp_path), [], max_bytes=200).collect()] == ["small.py"]


def test_stream_refresh(spark, tmp_path):
    src, out, ck = tmp_path / "in", tmp_path / "units", tmp_path / "ck"
    src.mkdir()
    (src / "a.py").write_text("def one():\n    pass\n")
    start_refresh(spark, str(src), str(out), str(ck)).awaitTermination(60)
    assert read_units(spark, str(out)).count() == 1
    (src / "b.py").write_text("def two():\n    pass\nimport os\n")
    start_refresh(spark, str(src), str(out), str(ck)).awaitTermination(60)
    assert {r["name"] for r in read_units(spark, str(out)).collect()} == {"one", "two", "os"}
