"""Registered queries over the test tables and inline code, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import hypervectors as hv
from codelode.functions.text import search_tokens, split_identifier, vector_tokens
from codelode.operators import changes, clusters, graph, ranking, refresh
from codelode.sources.files import glob_match, is_ignored
from codelode.streaming.refresh import windowed_counts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TERMS = "thereat ering thention Ores"
TERMS_2 = "ineati whthe onand"

# the two tokenisers in SQL
CLASS = r" \t,(){}\[\]<>:;=&*|!?@#$%\^~`''\"\\/"
BREAK = CLASS + r"\n\r"
SEARCH = rf"""list_filter(list_concat(regexp_split_to_array(text, '[{BREAK}._\-]+'), regexp_split_to_array(regexp_replace(text, '([^A-Z._\-{BREAK}])([A-Z])', '\1_\2', 'g'), '[{BREAK}._\-]+')), lambda t: t <> '')"""
LOWERED = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TOKENS = f"tok as (select doc_id, unnest(list_transform({SEARCH}, lambda t: {LOWERED})) term from documents)"
SIGNS = "sg as (select vec_id, label, list_reduce(list_transform(range(1, 65), lambda i: case when embedding[i] > 0 then (case when i = 64 then (-9223372036854775808)::bigint else (1::bigint << (i - 1)::int) end) else 0::bigint end), lambda a, b: a | b) w from embeddings)"
DIST = "bit_count(xor(a.w, b.w))::bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, columns)


def sql_values(columns: list[str], rows: list[tuple]) -> str:
    shown = lambda v: "null" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"(values {', '.join('(' + ', '.join(map(shown, r)) + ')' for r in rows)}) t({', '.join(columns)})"


def signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as one word of 64 sign bits."""
    e = table(spark, sf_dir, "embeddings")
    bits = F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return e.select("vec_id", "label", F.array(F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))).alias("w"))


# ---- tokens and BM25


IDENTIFIERS = [("handleAuthError",), ("parseJSON",), ("snake_case-name.py",), ("HTTPServer",), ("src/auth.zig",), ("__init__",), ("x",)]


@query(f"""select ident, array_to_string(list_filter(regexp_split_to_array(regexp_replace(ident, '([^A-Z])([A-Z])', '\\1_\\2', 'g'), '[_.-]'), lambda p: p <> ''), '|') parts
from (select ident from {sql_values(['ident'], IDENTIFIERS)} union all select p_brand from part union all select c_name from customer)""")
def ident_split(spark, sf_dir):
    own = values(spark, "ident string", IDENTIFIERS).union(table(spark, sf_dir, "part").select("p_brand")).union(table(spark, sf_dir, "customer").select("c_name"))
    return own.select("ident", F.array_join(split_identifier(F.col("ident")), "|").alias("parts"))


@query(f"""select doc_id, len(t)::bigint n, md5(array_to_string(t, ' ')) digest from (select doc_id, list_transform(list_filter(regexp_split_to_array(text, '[{CLASS}]+'), lambda t: strlen(t) >= 2), lambda t: {LOWERED}) t from documents)""")
def hv_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", vector_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"select doc_id, len(t)::bigint n, md5(array_to_string(t, ' ')) digest from (select doc_id, list_transform({SEARCH}, lambda t: {LOWERED}) t from documents)")
def bm25_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", search_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


_indexes: dict[tuple[str, str], ranking.Postings] = {}


def indexed(spark: SparkSession, sf_dir: str) -> ranking.Postings:
    """The written postings of the documents, built by the first query that asks in an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = ranking.Postings.build(table(spark, sf_dir, "documents"))
    return _indexes[key]


@query(f"with {TOKENS} select doc_id, term, count(*)::bigint tf from tok group by all")
def bm25_tf(spark, sf_dir):
    return indexed(spark, sf_dir).terms.drop("dl")


@query(f"with {TOKENS} select term, count(distinct doc_id)::bigint df_n from tok group by all")
def bm25_df(spark, sf_dir):
    return ranking.document_frequency(indexed(spark, sf_dir).terms)


@query(f"with {TOKENS} select (select count(*) from documents)::bigint n_docs, count(*)::bigint total_dl, round(count(*) / (select count(*) from documents), 6) avgdl from tok")
def bm25_stats(spark, sf_dir):
    return ranking.corpus_stats(table(spark, sf_dir, "documents")).select("n_docs", F.col("total_dl").cast("long"), F.round("avgdl", 6).alias("avgdl"))


def bm25_sql(terms: str, k: int) -> str:
    return f"""st as (select (select count(*) from documents) n_docs, count(*) / (select count(*) from documents) avgdl from tok), dl as (select doc_id, count(*) dl from tok group by 1),
q as (select {LOWERED} term, count(*) * 2 w from unnest(string_split('{terms}', ' ')) x(t) group by 1), tf as (select doc_id, term, count(*) tf from tok where term in (select term from q) group by all), df as (select term, count(*) df_n from tf group by 1),
sc as (select doc_id, sum(w * ln((n_docs - df_n + 0.5) / (df_n + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) score from tf join df using (term) join q using (term) join dl using (doc_id), st group by 1 order by 2 desc, 1 limit {k})"""


@query(f"with {TOKENS}, {bm25_sql('thereat ering thention ores', 10)} select doc_id, round(score, 6) score from sc")
def bm25_topk(spark, sf_dir):
    return ranking.top(indexed(spark, sf_dir).scores(TERMS), 10).select("doc_id", F.round("score", 6).alias("score"))


def two_rankings_sql(k: int) -> str:
    """Two BM25 rankings, each in a subquery of its own, and their fusion."""
    ranked = lambda n, terms: f"r{n} as (with {bm25_sql(terms, 40)} select doc_id, row_number() over (order by score desc, doc_id) rk from sc)"
    share = "coalesce(1.0::double / (60 + r1.rk), 0) + coalesce(1.0::double / (60 + r2.rk), 0)"
    return f"""with {TOKENS}, {ranked(1, TERMS.lower())}, {ranked(2, TERMS_2)}
select coalesce(r1.doc_id, r2.doc_id) doc_id, coalesce(r1.rk, 0)::int first_rank, coalesce(r2.rk, 0)::int second_rank, round({share}, 9) score
from r1 full join r2 using (doc_id) order by {share} desc, doc_id limit {k}"""


@query(two_rankings_sql(20))
def rrf_two_queries(spark, sf_dir):
    """Fusion of the rankings of two queries."""
    lists = [ranking.ranked(ranking.top(indexed(spark, sf_dir).scores(t), 40)) for t in (TERMS, TERMS_2)]
    fused = ranking.fuse(*lists, 20, names=("first_rank", "second_rank"))
    return fused.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("first_rank", "second_rank")), F.round("score", 9).alias("score"))


# ---- vectors


@query(f"with {SIGNS} select b.vec_id, {DIST} dist from sg a, sg b where a.vec_id = 0 order by 2, 1 limit 20")
def hv_knn(spark, sf_dir):
    v = signs(spark, sf_dir)
    probe = v.where("vec_id = 0").first()["w"]
    return ranking.nearest(v, probe, 20, key="vec_id", vector="w", positive=False).select("vec_id", F.col("dist").cast("long"))


@query(f"with {SIGNS} select b.vec_id, xor(a.w, b.w) bound from sg a, sg b where a.vec_id = 1")
def hv_bind(spark, sf_dir):
    v = signs(spark, sf_dir)
    key = F.array(*map(F.lit, v.where("vec_id = 1").first()["w"]))
    return v.select("vec_id", hv.bind("w", key)[0].alias("bound"))



WIDEST = 18


@query(f"with {SIGNS} select a.vec_id a, b.vec_id b, {DIST} dist from sg a join sg b on a.vec_id < b.vec_id and {DIST} <= {WIDEST}")
def sim_pairs(spark, sf_dir):
    return clusters.similar_pairs(signs(spark, sf_dir), WIDEST, "vec_id", "w").select("a", "b", F.col("dist").cast("long"))


CLUSTERED = f"""with recursive {SIGNS}, e as (select a.vec_id u, b.vec_id v from sg a join sg b on a.vec_id <> b.vec_id and {DIST} <= {WIDEST}),
r(id, reach) as (select vec_id, vec_id from sg union select r.id, e.v from r join e on r.reach = e.u), c as (select id vec_id, min(reach) root from r group by 1),
s as (select root, count(*) size, row_number() over (order by root) - 1 cluster_id from c group by 1 having count(*) >= 2)"""


def _clustered(spark, sf_dir):
    v = signs(spark, sf_dir)
    labelled = clusters.connected(v.select("vec_id"), clusters.similar_pairs(v, WIDEST, "vec_id", "w"), "vec_id")
    return clusters.number_clusters(labelled, 2, "vec_id")


@query(f"{CLUSTERED} select cluster_id::int cluster_id, vec_id, size::bigint size from c join s using (root)")
def cluster_members(spark, sf_dir):
    return _clustered(spark, sf_dir).select("cluster_id", "vec_id", "size")


@query(f"""{CLUSTERED}, p as (select cluster_id, unnest(string_split(lower(p_name), ' ')) part from c join s using (root) join part on p_partkey = vec_id + 1),
n as (select cluster_id, part, row_number() over (partition by cluster_id order by count(*) desc, part) rk from p group by 1, 2)
select cluster_id::int cluster_id, string_agg(part, '-' order by rk) as label from n where rk <= 3 group by 1""")
def cluster_labels(spark, sf_dir):
    names = table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("vec_id"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"))
    return clusters.labels(_clustered(spark, sf_dir).join(names, "vec_id"))



# ---- code


FILES = [
    ("src/auth.py", "python", "import os\nfrom models import User\n\nclass Auth:\n    limit: int = 3\n    def handle_auth(self):\n        self.count = 1\n        return 1\n\nasync def fetch_data():\n    pass\n"),
    ("src/main.go", "go", "package main\nimport \"fmt\"\n\ntype Server struct {\n}\n\nfunc main() {\n\tx := 1\n}\nfunc (s *Server) Start() {\n}\n"),
    ("src/lib.rs", "rust", "use crate::auth::B;\npub struct Point {\n    x: i32,\n}\npub(crate) fn area() -> i32 {\n    let mut y = 2;\n    y\n}\nenum Shape {\n    Round,\n    Flat,\n}\n"),
    ("web/app.ts", "typescript", "import { foo } from './foo';\nexport default class App {\n  title: string = 'x';\n}\nexport async function run() {\n  let n = 1;\n}\ninterface Props {\n}\n"),
    ("app/thing.rb", "ruby", "require 'set'\nmodule Things\n  class Thing\n    attr_reader :size\n    def grow\n      @size = 1\n    end\n  end\nend\n"),
    ("src/main.zig", "zig", "const std = @import(\"std\");\npub const Kind = enum {\n    small,\n    large,\n};\npub fn run() void {\n    var n: u32 = 1;\n}\n"),
    ("src/Box.java", "java", "import java.util.List;\npublic class Box {\n    private int size;\n    public int grow(int by) {\n        return size;\n    }\n}\n"),
    ("web/util.js", "javascript", "import fs from 'fs';\nexport class Cache {\n  size: number = 1;\n}\nasync function load(key) {\n  let n = 1;\n}\n"),
    ("src/Store.cs", "csharp", "using System;\npublic class Store {\n    private int count;\n    public override void Add(int n) {\n        if (n) Count(n);\n    }\n}\n"),
    ("src/math.fs", "fsharp", "open System\ntype Point = { X: int }\nlet area w h =\n    w * h\n"),
    ("src/tree.cpp", "cpp", "#include <vector>\nclass Tree {\n    int depth;\n};\nint walk(Tree *t) {\n    int n = size(t);\n    return 0;\n}\n"),
    ("src/list.c", "c", "#include <stdio.h>\nstruct node {\n    int value;\n};\nstatic int push(int v) {\n    if (v) return 1;\n    return 0;\n}\n"),
]
MTIME = "2024-01-01 00:00:00"


def files(spark: SparkSession, rows=None) -> DataFrame:
    """(file_path, lang, source, mtime) of the fixture project."""
    return values(spark, "file_path string, lang string, source string", FILES if rows is None else rows).withColumn("mtime", F.lit(MTIME).cast("timestamp"))


UNITS = [
    ("fn", "handleAuth", "fn handleAuth()", "src/auth.zig", 10, "auth"), ("type", "User", "const User = struct", "src/models.zig", 5, "models"), ("fn", "loginUser", "fn loginUser()", "src/login.zig", 20, "login"),
    ("import", "handleAuth", "import handleAuth", "src/login.zig", 1, "login"), ("import", "User", "import User", "src/auth.zig", 1, "auth"), ("import", "./utils/helpers", "import helpers", "src/login.zig", 2, "login"),
    ("fn", "helpers", "fn helpers()", "src/utils.zig", 3, "utils"), ("fn", "start", "fn start()", "src/main.zig", 9, "main"), ("import", "loginUser", "import loginUser", "src/main.zig", 1, "main"),
    ("fn", "checkToken", "fn checkToken()", "src/auth.zig", 30, "auth"), ("import", "start", "import start", "src/models.zig", 1, "models"), ("import", "missing.zig", "import missing", "src/main.zig", 2, "main"),
]
UNIT_COLUMNS = "kind string, name string, signature string, file_path string, line_number int, module_name string"
UNIT_SQL = f"u as (select * from {sql_values(['kind', 'name', 'signature', 'file_path', 'line_number', 'module_name'], UNITS)})"
REF_SQL = f"""{UNIT_SQL}, d as (select name, kind, file_path, line_number, signature from u where kind in ('fn', 'type')), i as (select *, regexp_replace(regexp_extract(name, '([^/]*)/*$', 1), '^(.+)\\.[^.]*$', '\\1') base from u where kind = 'import'),
rf as (select case when name in (select name from d) then name else base end def_name, name import_name, file_path, line_number from i where name in (select name from d) or base in (select name from d))"""


def fixture_units(spark: SparkSession) -> DataFrame:
    return values(spark, UNIT_COLUMNS, UNITS)





@query(f"""with recursive e as (select distinct l_orderkey f, l_partkey n from lineitem where l_orderkey <> l_partkey), bfs(n, depth) as (select 1::bigint, 0 union select e.f, depth + 1 from bfs join e on e.n = bfs.n where depth < 3)
select n as name, min(depth)::int depth from bfs group by 1""")
def impact_orders(spark, sf_dir):
    """Reach over a large edge table: each order is a file that imports its parts by number and defines its own number."""
    edges = table(spark, sf_dir, "lineitem").where("l_orderkey <> l_partkey").select(F.col("l_partkey").alias("def_name"), F.col("l_orderkey").alias("file_path"))
    names = edges.select(F.col("file_path").alias("name")).union(edges.select("def_name")).distinct()
    defs = names.select("name", F.col("name").alias("file_path"), F.lit(1).alias("line_number"), F.lit("fn").alias("kind"))
    return graph.impact(defs, edges, 1, 3).select("name", "depth")




DIFF = """diff --git a/src/auth.zig b/src/auth.zig
--- a/src/auth.zig
+++ b/src/auth.zig
@@ -10,3 +10,5 @@ fn x
+new
@@ -28,0 +30,2 @@
diff --git a/src/login.zig b/src/login.zig
--- a/src/login.zig
+++ b/src/login.zig
@@ -20,2 +19,0 @@
@@ -5 +5 @@
--- a/src/gone.zig
+++ /dev/null
@@ -1,4 +0,0 @@
"""
HUNKS = [(0, "src/auth.zig", 10, 3, 10, 5), (1, "src/auth.zig", 28, 0, 30, 2), (2, "src/login.zig", 20, 2, 19, 0), (3, "src/login.zig", 5, 1, 5, 1)]


@query("with h as (select * from " + sql_values(["k", "file_path", "old_start", "old_count", "new_start", "new_count"], HUNKS) + ") select file_path, old_start::int old_start, old_count::int old_count, new_start::int new_start, new_count::int new_count from h")
def diff_hunks(spark, sf_dir):
    return changes.parse_hunks(values(spark, "diff_id long, diff string", [(0, DIFF)])).drop("diff_id", "hunk_seq")



@query("""with ln as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) line_number from documents), h as (select doc_id f, 1 + doc_id % 7 ns, 1 + doc_id % 3 nc, doc_id % 2 oc from documents)
select doc_id::varchar file_path, line_number::int line_number, case when oc = 0 then 'added' else 'modified' end as change from ln join h on f = doc_id and line_number between ns and ns + nc - 1 group by all""")
def changes_documents(spark, sf_dir):
    """The interval join on many rows: lines of documents against one hunk of each."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").cast("string").alias("file_path"), F.posexplode(F.split("text", "\n")).alias("p", "l")).select("file_path", (F.col("p") + 1).alias("line_number"))
    n = F.col("doc_id")
    hunks = docs.select(n.cast("string").alias("file_path"), F.lit(0).alias("hunk_seq"), F.lit(-1).alias("old_start"), (n % 2).alias("old_count"), (1 + n % 7).alias("new_start"), (1 + n % 3).alias("new_count"))
    return changes.touched(hunks, lines, ["file_path", "line_number"])


PATHS = [("src/main.zig",), ("node_modules/a/b.js",), ("README.md",), (".git/config",), ("src/a_test.py",), ("docs/x/y.md",), ("app/index.ts",), ("logs/today.txt",), ("keep.log",), ("a.log",), ("lib/.hidden",)]
RULES = [("*.log", False), ("keep.log", True), ("docs/**", False), ("src/*_test.py", False)]


@query(f"""select path, len(list_intersect(string_split(path, '/'), ['node_modules', '.git', 'build', 'dist'])) > 0 or case when regexp_matches(path, '^src/.*_test\\.py$') then true when regexp_matches(path, '^docs/.*$') then true
when regexp_matches(path, '(^|/)keep\\.log$') then false when regexp_matches(path, '\\.log$') then true else false end ignored from {sql_values(['path'], PATHS)}""")
def ignore_filter(spark, sf_dir):
    return values(spark, "path string", PATHS).select("path", is_ignored(F.col("path"), RULES).alias("ignored"))


@query("select page_id from pages where regexp_matches(url, '^https://.*/en/.*$')")
def glob_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(glob_match(F.col("url"), "https://*/en/*")).select("page_id")




# ---- refresh


@query("""with o as (select user_id, max(event_id) k from events where event_id % 3 <> 0 group by 1), n as (select user_id, max(event_id) k from events where event_id % 3 = 0 group by 1)
select e.user_id, e.event_id, e.event_type from events e join (select coalesce(n.user_id, o.user_id) user_id, coalesce(n.k, o.k) k from o full join n using (user_id)) x on x.k = e.event_id""")
def cdc_refresh(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    old, new = (refresh.latest(e.where(c), "user_id", "event_id") for c in ("event_id % 3 <> 0", "event_id % 3 = 0"))
    return refresh.replace_by_file(old, new, new, path="user_id").select("user_id", "event_id", "event_type")


@query("select n.event_id from (select event_id, ts from events where event_id % 5 < 3) n anti join (select event_id, case when event_id % 2 = 0 then ts else ts + interval 1 second end ts from events where event_id % 5 > 0) k on n.event_id = k.event_id and n.ts = k.ts")
def cdc_changed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.where("event_id % 5 < 3").select("event_id", "ts")
    known = e.where("event_id % 5 > 0").selectExpr("event_id", "if(event_id % 2 = 0, ts, ts + interval 1 second) ts")
    return refresh.changed_files(now, known, "event_id", "ts").select("event_id")


@query("select time_bucket(interval 1 day, ts) window_start, event_type, count(*)::bigint n, round(sum(value), 4) total from events group by all")
def stream_windows(spark, sf_dir):
    """The event-time aggregate of the streaming module on the whole table; tests run it as a stream."""
    return windowed_counts(table(spark, sf_dir, "events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))

