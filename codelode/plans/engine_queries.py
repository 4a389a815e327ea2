"""Registered queries over the engine, the hypervectors and the front ends, each with SQL that computes the same on its own."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.frontend import rpc
from codelode.functions import hypervectors as hv
from codelode.functions.languages import display_name, language_of
from codelode.functions.tables import fresh_path
from codelode.functions.text import module_name, search_term, token_estimate, vector_tokens
from codelode.operators import clusters, encode, extract, graph, ranking
from codelode.plans import engine as defaults
from codelode.plans import render
from codelode.plans.catalog import Catalog
from codelode.plans.engine import Engine
from codelode.plans.queries import DIFF, FILES, HUNKS, LOWERED, PATHS, UNITS, files, fixture_units, query, sql_values, table, values
from codelode.sources.files import parse_ignore, scan_tree
from codelode.streaming.refresh import read_units, start_refresh

# ---- units in SQL: the keywords of each language, and the four matchers that are more than a keyword


def _keyword(words: tuple[str, ...]) -> str:
    return f"nullif(regexp_extract(bare, '^(?:{'|'.join(words)})[^A-Za-z0-9_]*([A-Za-z0-9_]+)', 1), '')"


_BEFORE = "split_part({}, '(', 1)"
_METHOD = f"""case when contains(bare, '(') and not regexp_matches(bare, '^(?:{'|'.join(extract.CONTROL)}) ') then nullif(regexp_extract({_BEFORE.format('bare')}, '[^A-Za-z0-9_]([A-Za-z0-9_]+) *$', 1), '') end"""
_C = f"""case when contains(signature, '(') and signature not like '#%' and not regexp_matches({_BEFORE.format('signature')}, '[=;]') and regexp_extract({_BEFORE.format('signature')}, '([A-Za-z0-9_]+) *$', 1) not in ({', '.join(f"'{w}'" for w in (*extract.NOT_CALLED, ''))}) then regexp_extract({_BEFORE.format('signature')}, '([A-Za-z0-9_]+) *$', 1) end"""
_ZIG = "regexp_replace(signature, '^(?:pub )?const ', '')"
_SPECIAL = {
    "fn": {"java": _METHOD, "csharp": _METHOD, "c": _C, "cpp": _C},
    "type": {"zig": f"case when regexp_matches(signature, '^(?:pub )?const ') and regexp_matches(substr({_ZIG}, length(split_part({_ZIG}, ' = ', 1)) + 1), '^ = (?:struct|enum|union|opaque)') then split_part({_ZIG}, ' = ', 1) end"},
    "import": {"zig": "nullif(regexp_extract(signature, '@import\\(.*?\"(.*?)\"', 1), '')"},
}


def units_sql(rows: list[tuple], name: str = "units") -> str:
    """CTEs up to ``name`` (kind, name, signature, file_path, line_number, module_name) of inline files."""
    words = {"fn": extract.FUNCTIONS, "type": extract.TYPES, "import": extract.IMPORTS}
    case = lambda kind: "case lang " + " ".join(f"when '{g}' then {x}" for g, x in ({g: _keyword(w) for g, w in words[kind].items()} | _SPECIAL[kind]).items()) + " else null end"
    literal = sql_values(["file_path", "lang", "source"], [r[:3] for r in rows]).replace("\n", "' || chr(10) || '")
    return f"""src as (select file_path, lang, string_split(source, chr(10)) ls from {literal}),
ln as (select file_path, lang, i::int line_number, trim(ls[i], ' ' || chr(9) || chr(13)) signature from src, unnest(range(1, len(ls) + 1)) r(i)), bl as (select *, regexp_replace(signature, '{extract.STRIP}', '') bare from ln where signature <> ''),
mt as (select *, {case('fn')} f, {case('type')} ty, {case('import')} im from bl),
{name} as (select case when f is not null then 'fn' when ty is not null then 'type' else 'import' end kind, coalesce(f, ty, im) as name, signature, file_path, line_number, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]*$', '') module_name from mt where coalesce(f, ty, im) is not null)"""


UNIT_SELECT = "select kind, name, signature, file_path, line_number, module_name from units"


# ---- hypervectors in SQL: splitmix64 in 128-bit integers, majority by counts of each bit

WHOLE = "18446744073709551616::uhugeint"
SEED = "('0x' || substr(md5({}), 1, 15))::bigint"


def vectors_sql(name: str, source: str) -> str:
    """CTEs up to ``name`` (token, i, w): the words of the vector of each distinct ``token`` of ``source``."""
    step = lambda old, new, shift, factor: f"{name}_{new} as (select token, i, (xor(z, z >> {shift}) * {factor}::uhugeint) % {WHOLE} z from {name}_{old})"
    return f"""{name}_0 as (select token, i, ({SEED.format('token')}::uhugeint + (i + 1)::uhugeint * {hv.GAMMA}::uhugeint) % {WHOLE} z from (select distinct token from {source}) s, range(0, {hv.WORDS}) r(i)),
{step(0, 1, 30, hv.MIX_A)}, {step(1, 2, 27, hv.MIX_B)},
{name} as (select token, i, case when z < 9223372036854775808::uhugeint then z::bigint else (z::hugeint - 18446744073709551616::hugeint)::bigint end w from (select token, i, xor(z, z >> 31) z from {name}_2))"""


def bound_sql(name: str, source: str) -> str:
    """CTEs up to ``name`` (role, token, i, w): vectors of the distinct (role, token) of ``source``, bound where there is a role."""
    roles = sql_values(["role", "token"], list(hv.ROLES.items()))
    return f"""{name}_r as (select * from {roles}), {name}_t as (select token from {source} union select token from {name}_r), {vectors_sql(name + '_v', name + '_t')},
{name}_p as (select distinct role, token from {source}),
{name} as (select p.role, p.token, t.i, case when r.token is null then t.w else xor(t.w, b.w) end w from {name}_p p join {name}_v t on t.token = p.token left join {name}_r r on r.role = p.role left join {name}_v b on b.token = r.token and b.i = t.i)"""


def majority_sql(name: str, source: str, key: str) -> str:
    """CTE ``name`` (key, i, w): per bit majority of the vectors (key, i, w), ties to 0, of one vector itself, else the bits that count only."""
    bits = " | ".join(f"(case when 2 * sum((w >> {b}) & 1) > count(*) then {'(-9223372036854775808)::bigint' if b == 63 else f'{1 << b}::bigint'} else 0::bigint end)" for b in range(64))
    last = hv.DIMENSION // 64
    return f"{name} as (select {key}, i, case when n = 1 then one when i < {last} then m when i = {last} then m & {(1 << hv.DIMENSION % 64) - 1} else 0 end w from (select {key}, i, count(*) n, any_value(w) one, {bits} m from {source} group by {key}, i))"


DIGEST = "md5(string_agg(w::varchar, ',' order by i))"
SPLIT = "list_filter(regexp_split_to_array(regexp_replace({}, '([^A-Z])([A-Z])', '\\1_\\2', 'g'), '[_.-]'), lambda p: p <> '')"
CLASS = r" \t,(){}\[\]<>:;=&*|!?@#$%\^~`''\"\\/"


def parts_sql(name: str, source: str, key: str) -> str:
    """CTE ``name`` (key, role, token): the components of units, a multiset."""
    low = f"lambda t: {LOWERED}"
    tokens = f"list_filter(regexp_split_to_array(signature, '[{CLASS}]+'), lambda t: strlen(t) >= 2)"
    each = lambda role, tokens: f"select {key}, {role} as role, unnest({tokens}) as token from {source}"
    rows = [each("'kind'", "[kind]"), each("'name'", "[name]"), each("'module'", "[module_name]"), each("'name'", f"list_transform({SPLIT.format('name')}, {low})"), each("'file'", SPLIT.format("file_path")), each("null::varchar", f"list_transform({tokens}, {low})")]
    return f"{name} as ({' union all '.join(rows)})"


def encoded_sql(name: str, source: str, key: str) -> str:
    """CTEs up to ``name`` (key, i, w): the vectors of units."""
    return f"""{parts_sql(name + '_c', source, key)}, {bound_sql(name + '_b', name + '_c')},
{name}_x as (select c.{key}, b.i, b.w from {name}_c c join {name}_b b on b.token = c.token and b.role is not distinct from c.role), {majority_sql(name, name + '_x', key)}"""


def query_sql(name: str, parts: list[tuple]) -> str:
    """CTEs up to ``name`` (i, w): the vector of a query by its components."""
    return f"{name}_c as (select 0 q, * from {sql_values(['role', 'token'], parts)}), {bound_sql(name + '_b', name + '_c')}, {name}_x as (select q, b.i, b.w from {name}_c c join {name}_b b on b.token = c.token and b.role is not distinct from c.role), {majority_sql(name, name + '_x', 'q')}"


TOKEN_SQL = "tokens as (select distinct role, token from (select p_name as token from part union select p_brand from part) p, (values ('name'), ('params'), ('returns'), ('calls'), ('module'), ('fields'), ('kind'), ('imports'), ('file'), (null)) r(role))"


@query(f"with {TOKEN_SQL}, {bound_sql('b', 'tokens')} select coalesce(role, '') as role, token, {DIGEST} digest from b group by b.role, token")
def hv_atoms(spark, sf_dir):
    """The vectors of names, bare and bound to each of the roles."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("token")).union(part.select("p_brand")).distinct()
    tokens = names.select("token", F.explode(F.array(*map(F.lit, [*hv.ROLES, None]))).alias("role"))
    return encode.atoms(tokens).select(F.coalesce("role", F.lit("")).alias("role"), "token", F.md5(F.array_join("vector", ",")).alias("digest"))


SHIFTS = (0, 1, 64, 100, 640, 10047)


def permute_sql(source: str, n: int) -> str:
    """Rows (token, n, i, w) of the vectors (token, i, w, unsigned) shifted upwards by n bits."""
    words, bits = divmod(n, 64)
    low = f"((b.w & {(1 << (64 - bits)) - 1}::ubigint) << {bits}::ubigint) | (c.w >> {64 - bits}::ubigint)" if bits else "b.w"
    at = lambda k: f"(b.i + {k}) % {hv.WORDS}"
    return f"select b.token, {n} n, {at(words)} i, {low} w from {source} b join {source} c on c.token = b.token and b.i = (c.i + 1) % {hv.WORDS}"


@query(f"""with tokens as (select vec_id::varchar as token from embeddings), {vectors_sql('v', 'tokens')},
u as (select token, i, case when w >= 0 then w::ubigint else (w::hugeint + 18446744073709551616::hugeint)::ubigint end w from v),
p as ({' union all '.join(permute_sql('u', n) for n in SHIFTS)}),
s as (select token, n, i, case when w < 9223372036854775808::ubigint then w::bigint else (w::hugeint - 18446744073709551616::hugeint)::bigint end w from p)
select token, n::int n, {DIGEST} digest from s group by token, n""")
def hv_permute(spark, sf_dir):
    """Circular shifts of whole vectors."""
    v = seeded(spark, sf_dir).select(F.col("vec_id").cast("string").alias("token"), "vector")
    shifted = F.array(*(F.struct(F.lit(n).alias("n"), hv.permute("vector", n).alias("w")) for n in SHIFTS))
    return v.select("token", F.explode(shifted).alias("x")).select("token", "x.n", F.md5(F.array_join("x.w", ",")).alias("digest"))


def seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, vector): a vector of full width for each embedding, from its id as a name."""
    hv.ship(spark)
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", hv.from_seed(hv.atom_seed(F.col("vec_id").cast("string"))).alias("vector"))


SEEDED_SQL = f"tokens as (select vec_id::varchar as token from embeddings), {vectors_sql('v', 'tokens')}, own as (select vec_id, label, i, w from v join embeddings on vec_id::varchar = token), {majority_sql('mj', 'own', 'label')}"


@query(f"with {SEEDED_SQL} select label, {DIGEST} digest from mj group by label")
def hv_bundle(spark, sf_dir):
    """Majority of the vectors of each label, at full width."""
    return hv.bundle(seeded(spark, sf_dir), "label").select("label", F.md5(F.array_join("vector", ",")).alias("digest"))


@query(f"with {SEEDED_SQL} select vec_id, label::int cluster_id, round(2.0 * sum(bit_count(xor(own.w, mj.w))) / 10000, 6)::double distance from own join mj using (label, i) group by vec_id, label")
def hv_centroid(spark, sf_dir):
    """Distance of each vector from the majority of its label."""
    v = seeded(spark, sf_dir)
    members = v.select(F.col("label").cast("int").alias("cluster_id"), "vec_id", F.lit(1).alias("size"))
    return clusters.to_centroid(members, v, "vec_id").select("vec_id", "cluster_id", F.round("distance", 6).alias("distance"))


@query(f"with {SEEDED_SQL} select b.vec_id, round(1.0 - 2.0 * sum(bit_count(xor(a.w, b.w))) / 10000, 6)::double similarity, sum(bit_count(xor(a.w, b.w))) = 0 same from own a, own b where a.vec_id = 0 and a.i = b.i group by b.vec_id")
def hv_similarity(spark, sf_dir):
    """Similarity to one vector, and whether what binding with it leaves is zero."""
    v = seeded(spark, sf_dir)
    first = F.array(*map(F.lit, v.where("vec_id = 0").first()["vector"]))
    return v.select("vec_id", F.round(hv.similarity(hv.distance("vector", first)), 6).alias("similarity"), hv.is_zero(hv.bind("vector", first)).alias("same"))


# ---- units, outlines, names


@query(f"with {units_sql(FILES)} {UNIT_SELECT}")
def units_extract(spark, sf_dir):
    """Units of all twelve languages."""
    return extract.extract_units(files(spark))


def _by_language(lang: str):
    rows = [f for f in FILES if f[1] == lang]

    def run(spark, sf_dir):
        return extract.extract_units(files(spark, rows))

    run.__name__, run.__doc__ = f"units_{lang}", f"Units of {lang}."
    query(f"with {units_sql(rows)} {UNIT_SELECT}")(run)


for _lang in sorted({f[1] for f in FILES}):
    _by_language(_lang)

PYTHON = [
    ("a.py", "python", "import os.path as p, sys\nfrom . import x\nfrom ..pkg.mod import y\n@wrap\nclass A:\n    import inner\n    def method(self):\n        pass\nif p:\n    def late(): pass\n@one\n@two(3)\nasync def go(): pass\ntry:\n    import z; import w\nexcept E:\n    pass\n"),
    ("broken.py", "python", "def ok():\n    pass\ndef bad(:\n"),
    ("c.go", "go", "func main() {\n}\n"),
]
#: By hand: what stands inside of classes and functions is left out, a file that doesn't parse goes by its lines.
PYTHON_UNITS = [
    ("a.py", 1, "import", "os.path", "import os.path as p, sys"), ("a.py", 2, "import", ".", "from . import x"), ("a.py", 3, "import", "..pkg.mod", "from ..pkg.mod import y"), ("a.py", 5, "type", "A", "class A:"),
    ("a.py", 10, "fn", "late", "def late(): pass"), ("a.py", 13, "fn", "go", "async def go(): pass"), ("a.py", 15, "import", "z", "import z; import w"), ("a.py", 15, "import", "w", "import w"),
    ("broken.py", 1, "fn", "ok", "def ok():"), ("broken.py", 3, "fn", "bad", "def bad(:"), ("c.go", 1, "fn", "main", "func main() {"),
]


@query(f"select file_path, line_number, kind, name, signature from {sql_values(['file_path', 'line_number', 'kind', 'name', 'signature'], PYTHON_UNITS)}")
def units_syntax(spark, sf_dir):
    """Units of Python files by their syntax trees."""
    return Engine(spark, files(spark, PYTHON), backend="syntax").units.select("file_path", "line_number", "kind", "name", "signature")


LONG_TOKENS = [("a" * 300,), ("B" * 600,), ("x" * 255 + "é",), ("short",), ("é" * 300,)]


@query(f"select strlen(t)::bigint n, least(strlen(t), 256)::bigint vector_bytes, least(strlen(t), 512)::bigint search_bytes from {sql_values(['t'], [r for r in LONG_TOKENS if 'é' not in r[0] or len(r[0]) > 256])}")
def token_cut(spark, sf_dir):
    """Tokens keep 256 bytes for hypervectors and 512 for ranking."""
    t = values(spark, "t string", [r for r in LONG_TOKENS if "é" not in r[0] or len(r[0]) > 256])
    size = lambda c: F.octet_length(c).cast("long")
    return t.select(size(F.col("t")).alias("n"), size(vector_tokens(F.col("t"))[0]).alias("vector_bytes"), size(search_term(F.col("t"))).alias("search_bytes"))


@query(f"""select path, case when path like '%.zig' then 'zig' when path like '%.ts' then 'typescript' when path like '%.js' then 'javascript' when path like '%.py' then 'python' else 'unknown' end lang,
case when path like '%.zig' then 'zig' when path like '%.ts' then 'typescript' when path like '%.js' then 'javascript' when path like '%.py' then 'python' else 'unknown' end display,
regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') module_name from {sql_values(['path'], PATHS)}""")
def lang_detect(spark, sf_dir):
    return values(spark, "path string", PATHS).select("path", language_of("path").alias("lang"), display_name(language_of("path")).alias("display"), module_name(F.col("path")).alias("module_name"))


@query("select source, count(*)::bigint units, count(distinct lang)::bigint langs, sum(floor((strlen(text) + 3) / 4))::bigint tokens from documents group by all")
def token_counts(spark, sf_dir):
    """Estimated tokens of the documents by source."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("lang").alias("langs"), F.sum(token_estimate("text")).alias("tokens"))


# ---- the engine on the fixture project

_engines: dict[tuple, Engine] = {}


def _engine(spark: SparkSession, name: str, make) -> Engine:
    key = (spark.sparkContext.applicationId, name)
    if key not in _engines:
        _engines[key] = make()
    return _engines[key]


def on_files(spark: SparkSession) -> Engine:
    return _engine(spark, "files", lambda: Engine(spark, files(spark), "project"))


def on_units(spark: SparkSession) -> Engine:
    return _engine(spark, "units", lambda: Engine.of_units(fixture_units(spark), "project"))


UNIT_ROWS = f"u as (select * from {sql_values(['kind', 'name', 'signature', 'file_path', 'line_number', 'module_name'], UNITS)})"
NUMBERED = "select *, row_number() over (order by file_path, line_number) - 1 unit_id from {}"
REFS = f"""{UNIT_ROWS}, d as (select name, kind, file_path, line_number, signature from u where kind in ('fn', 'type')), i as (select *, regexp_replace(regexp_extract(name, '([^/]*)/*$', 1), '^(.+)\\.[^.]*$', '\\1') base from u where kind = 'import'),
rf as (select case when name in (select name from d) then name else base end def_name, name import_name, file_path, line_number from i where name in (select name from d) or base in (select name from d))"""


@query(f"with {REFS} select def_name, import_name, file_path, line_number from rf")
def refs_resolve(spark, sf_dir):
    return on_units(spark).references


@query(f"with {UNIT_ROWS} select name, kind, file_path, line_number, signature from u where kind in ('fn', 'type')")
def refs_defs(spark, sf_dir):
    return graph.definitions(on_units(spark).units)


@query(f"with {REFS} select distinct def_name from rf where file_path = 'src/login.zig'")
def refs_dependencies(spark, sf_dir):
    return graph.dependencies_of(on_units(spark).references, "src/login.zig")


@query(f"with {REFS} select 'definition' part, name, file_path, line_number from d where name = 'handleAuth' union all select 'reference', import_name, file_path, line_number from rf where def_name = 'handleAuth'")
def engine_refs(spark, sf_dir):
    defs, refs = on_units(spark).refs("handleAuth")
    columns = ["part", "name", "file_path", "line_number"]
    return defs.withColumn("part", F.lit("definition")).select(*columns).unionByName(refs.withColumn("part", F.lit("reference")).withColumnRenamed("import_name", "name").select(*columns))


def impact_sql(symbol: str, depth: int) -> str:
    return f"""with recursive {REFS}, bfs(name, file_path, line_number, kind, depth) as (select name, file_path, line_number, kind, 0 from d where name = '{symbol}'
union select d.name, d.file_path, d.line_number, d.kind, b.depth + 1 from bfs b join rf on rf.def_name = b.name join d on d.file_path = rf.file_path where b.depth < {depth})
select name, file_path, any_value(line_number)::int line_number, any_value(kind) kind, min(depth)::int depth, round(1.0::double / (1 + min(depth)), 6) confidence from bfs group by 1, 2"""


@query(impact_sql("User", 10))
def engine_impact(spark, sf_dir):
    return on_units(spark).impact("User", 10).withColumn("confidence", F.round("confidence", 6))


@query(f"select depth, count(*)::bigint n, max(depth) over ()::int max_depth, (sum(count(*)) over ())::bigint affected from ({impact_sql('User', 2)}) x group by depth")
def impact_counts(spark, sf_dir):
    """Counts by depth, the greatest depth and the total; a depth that is out of range counts as the default."""
    found = on_units(spark).impact("User", 99)
    total = found.agg(F.max("depth").alias("max_depth"), F.count(F.lit(1)).alias("affected"))
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))


@query(f"""with {REFS}, o as (select * from d where name = 'handleAuth' order by file_path, line_number limit 1)
select 'definition' section, name, kind, file_path, line_number, signature from o union all select 'referenced_by', import_name, 'import', file_path, line_number, null from rf where def_name = 'handleAuth'
union all select 'references', rf.def_name, x.kind, x.file_path, x.line_number, x.signature from rf join o on rf.file_path = o.file_path left join (select *, row_number() over (partition by name order by file_path, line_number) k from d) x on x.name = rf.def_name and x.k = 1
union all select 'siblings', d.name, d.kind, d.file_path, d.line_number, d.signature from d join o on d.file_path = o.file_path where d.name <> 'handleAuth'""")
def engine_context(spark, sf_dir):
    return on_units(spark).context("handleAuth")


@query(f"with {UNIT_ROWS}, h as (select * from {sql_values(['k', 'f', 'os', 'oc', 'ns', 'nc'], HUNKS)}), " + """j as (select u.*, k, case when nc > 0 and line_number between ns and ns + nc - 1 then case when oc = 0 then 'added' else 'modified' end when nc = 0 then 'deleted' else 'modified' end c
from u join h on f = file_path and ((nc > 0 and line_number between ns and ns + nc - 1) or (oc > 0 and line_number between os and os + oc - 1)))
select name, kind, file_path, line_number, arg_min(c, k) as change from j group by all""")
def engine_changes(spark, sf_dir):
    return on_units(spark).changes(diff=values(spark, "diff_id long, diff string", [(0, DIFF)]))


UNITS_HERE = f"{UNIT_ROWS}, un as ({NUMBERED.format('u')}), {encoded_sql('ev', 'un', 'unit_id')}"
TEST_THRESHOLD = 0.2


def clusters_sql(threshold: float, least: int) -> str:
    """CTEs of the clusters of the fixture's units: pairs by similarity, components, centroids."""
    return f"""with recursive {UNITS_HERE}, pr as (select a.unit_id x, b.unit_id y from ev a join ev b on a.i = b.i and a.unit_id <> b.unit_id group by all having 1.0::double - 2.0::double * sum(bit_count(xor(a.w, b.w))) / 10000 >= {threshold}),
rc(id, reach) as (select unit_id, unit_id from un union select rc.id, y from rc join pr on reach = x), cp as (select id unit_id, min(reach) root from rc group by 1),
sz as (select root, count(*) size from cp group by 1), kp as (select root, size, row_number() over (order by root) - 1 cluster_id from sz where size >= {least}),
cm as (select cluster_id, i, w from cp join kp using (root) join ev using (unit_id)), {majority_sql('ct', 'cm', 'cluster_id')}"""


@query(f"{clusters_sql(TEST_THRESHOLD, 2)}, ds as (select unit_id, cluster_id, any_value(size) size, round(2.0 * sum(bit_count(xor(ev.w, ct.w))) / 10000, 6)::double distance from cp join kp using (root) join ev using (unit_id) join ct using (cluster_id, i) group by unit_id, cluster_id) select cluster_id::int cluster_id, unit_id, size, distance, row_number() over (partition by cluster_id order by distance, unit_id)::int place from ds")
def engine_clusters(spark, sf_dir):
    """Members in the order of their distance from the centroid."""
    members = on_units(spark).clusters(TEST_THRESHOLD, 2).members
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("distance", "unit_id"))
    return members.select("cluster_id", "unit_id", "size", F.round("distance", 6).alias("distance"), place.alias("place"))


@query(f"{clusters_sql(TEST_THRESHOLD, 3)} select (select coalesce(sum(size), 0) from sz where size < 3)::bigint unclustered_count, (select count(*) from kp)::bigint clusters")
def engine_unclustered(spark, sf_dir):
    """Units in no cluster of three or more."""
    found = on_units(spark).clusters(TEST_THRESHOLD, 3)
    return found.unclustered.crossJoin(F.broadcast(found.heads.agg(F.count(F.lit(1)).alias("clusters"))))


@query(f"with {units_sql(FILES)} select count(*)::bigint units, count(distinct file_path)::bigint files, (count(*) * 1256)::bigint vector_bytes from units")
def engine_status(spark, sf_dir):
    return on_files(spark).status()


@query(f"with {units_sql(FILES)}, un as ({NUMBERED.format('units')}), {encoded_sql('ev', 'un', 'unit_id')} select unit_id, {DIGEST} digest from ev group by unit_id")
def encode_units(spark, sf_dir):
    return on_files(spark).vectors.select("unit_id", F.md5(F.array_join("vector", ",")).alias("digest"))


QUESTION = "auth handle function"
QUESTION_PARTS = [(None, "auth"), (None, "handle"), (None, "function"), ("name", "auth"), ("module", "auth"), ("name", "handle"), ("module", "handle"), ("kind", "fn")]


@query(f"with {units_sql(FILES)}, un as ({NUMBERED.format('units')}), {encoded_sql('ev', 'un', 'unit_id')}, {query_sql('qv', QUESTION_PARTS)}, ds as (select unit_id, sum(bit_count(xor(ev.w, qv.w))) dist from ev join qv using (i) group by unit_id) select unit_id, name, dist::int dist, round(1.0 - 2.0 * dist / 10000, 6)::double similarity from ds join un using (unit_id) where 1.0 - 2.0 * dist / 10000 > 0 order by dist, unit_id limit 5")
def encode_query(spark, sf_dir):
    """The nearest units to a question in words."""
    e = on_files(spark)
    near = ranking.nearest(e.vectors, encode.encode_query(spark, QUESTION), 5)
    return near.join(e.units.select("unit_id", "name"), "unit_id").select("unit_id", "name", "dist", F.round("similarity", 6).alias("similarity"))


PART_UNITS = "select 'type' kind, replace(p_name, ' ', '_') as name, p_name || ' ' || p_brand || ' ' || lower(p_type) signature, 'parts/' || lower(p_type) || '.py' file_path, p_partkey::int line_number, p_brand module_name from part"
PART_QUESTION, PART_PARTS = "ring struct blue", [(None, "ring"), (None, "struct"), (None, "blue"), ("name", "ring"), ("module", "ring"), ("kind", "type"), ("name", "blue"), ("module", "blue")]
#: The units of ``part`` as texts, and their BM25 scores for the terms of the question, each of which counts twice.
PART_BM25 = r"""tx as (select unit_id, name || ' ' || module_name || ' ' || signature t from un),
tk as (select unit_id, unnest(list_filter(list_concat(regexp_split_to_array(lower(t), '[ #_.-]+'), regexp_split_to_array(lower(regexp_replace(t, '([^A-Z #_.-])([A-Z])', '\1_\2', 'g')), '[ #_.-]+')), lambda x: x <> '')) term from tx),
dl as (select unit_id, count(*) dl from tk group by 1), st as (select count(*) nd, sum(dl) / count(*) av from dl), tf as (select unit_id, term, count(*) tf from tk where term in ('ring', 'struct', 'blue') group by all), df as (select term, count(*) dn from tf group by 1),
sc as (select unit_id, sum(2 * ln((nd - dn + 0.5) / (dn + 0.5) + 1) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / av))) score from tf join df using (term) join dl using (unit_id), st group by 1)"""
PART_HERE = f"u as ({PART_UNITS}), un as ({NUMBERED.format('u')})"
PART_NEAR = f"{encoded_sql('ev', 'un', 'unit_id')}, {query_sql('qv', PART_PARTS)}, ds as (select unit_id, sum(bit_count(xor(ev.w, qv.w))) dist from ev join qv using (i) group by unit_id)"


def on_parts(spark: SparkSession, sf_dir: str) -> Engine:
    def make() -> Engine:
        p = table(spark, sf_dir, "part")
        low = F.lower("p_type")
        return Engine.of_units(
            p.select(F.lit("type").alias("kind"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("name"), F.concat_ws(" ", "p_name", "p_brand", low).alias("signature"), F.concat(F.lit("parts/"), low, F.lit(".py")).alias("file_path"), F.col("p_partkey").cast("int").alias("line_number"), F.col("p_brand").alias("module_name")),
            "parts",
        )

    return _engine(spark, f"parts {sf_dir}", make)


@query(f"""with {PART_HERE}, {PART_BM25}, {PART_NEAR},
b as (select unit_id, row_number() over (order by round(score, 9) desc, unit_id) rk from sc order by round(score, 9) desc, unit_id limit 40), h as (select unit_id, row_number() over (order by dist, unit_id) rk from ds where 1.0 - 2.0 * dist / 10000 > 0 order by dist, unit_id limit 40),
f as (select coalesce(b.unit_id, h.unit_id) unit_id, b.rk br, h.rk hr, coalesce(1.0::double / (60 + b.rk), 0) + coalesce(1.0::double / (60 + h.rk), 0) score from b full join h using (unit_id) order by 4 desc, 1 limit 20)
select unit_id, name, coalesce(br, 0)::int bm25_rank, coalesce(hr, 0)::int hdc_rank, round(score, 9) score from f join un using (unit_id)""")
def rrf_hybrid(spark, sf_dir):
    """Hybrid search over the parts: the first 40 by words and the first 40 by vectors, fused to 20."""
    found = on_parts(spark, sf_dir).search(PART_QUESTION, 20)
    return found.select("unit_id", "name", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("bm25_rank", "hdc_rank")), F.round("score", 9).alias("score"))


@query(f"with {PART_HERE}, {PART_BM25} select unit_id, name, round(score, 6) score from sc join un using (unit_id) order by round(sc.score, 9) desc, unit_id limit 20")
def engine_bm25(spark, sf_dir):
    """Search by words alone; a k that is out of range counts as 20."""
    return on_parts(spark, sf_dir).search(PART_QUESTION, 0, "bm25").select("unit_id", "name", F.round("score", 6).alias("score"))


@query(f"with {PART_HERE}, {PART_NEAR} select unit_id, name, round(1.0 - 2.0 * dist / 10000, 6)::double score from ds join un using (unit_id) where 1.0 - 2.0 * dist / 10000 > 0 order by dist, unit_id limit 7")
def engine_vector(spark, sf_dir):
    """Search by vectors alone."""
    return on_parts(spark, sf_dir).search(PART_QUESTION, 7, "vector").select("unit_id", "name", F.round("score", 6).alias("score"))


# ---- refresh: the project with a file changed, one gone and one new

CHANGED = [(p, g, s.replace("handle_auth", "check_auth")) for p, g, s in FILES if p != "src/lib.rs"] + [("src/new.py", "python", "def fresh():\n    pass\n")]


def _changed(spark: SparkSession) -> DataFrame:
    return files(spark, CHANGED).withColumn("mtime", F.when(F.col("file_path").isin("src/auth.py", "src/new.py"), F.lit("2024-02-02 00:00:00").cast("timestamp")).otherwise(F.col("mtime")))


@query(f"with {units_sql(CHANGED)}, un as ({NUMBERED.format('units')}) select unit_id, kind, name, file_path, line_number, 2 as version from un")
def engine_refresh(spark, sf_dir):
    """The index after an incremental refresh, which stays."""
    e = Engine(spark, files(spark), "project")
    e.refresh(_changed(spark))
    return e.units.select("unit_id", "kind", "name", "file_path", "line_number", F.lit(e.version).alias("version"))


@query(f"with {units_sql(CHANGED)} select count(*)::bigint units, count(distinct file_path)::bigint files, (count(*) * 1256)::bigint vector_bytes from units")
def engine_reindex(spark, sf_dir):
    """Status after a full scan of the changed project."""
    return Engine(spark, files(spark), "project").reindex(_changed(spark))


@query(f"with a as (with {units_sql(FILES)} select * from units), b as (with {units_sql(CHANGED)} select * from units) select 'one' project, count(*)::bigint units, count(distinct file_path)::bigint files, (count(*) * 1256)::bigint vector_bytes from a union all select 'two', count(*), count(distinct file_path), count(*) * 1256 from b")
def catalog_status(spark, sf_dir):
    """Two projects side by side."""
    c = Catalog(spark)
    c.add("one", files(spark))
    c.add("two", _changed(spark))
    return c.status()


TREE = [
    ("src/a.py", "def one():\n    pass\n"), ("src/deep/b.go", "func two() {\n}\n"), ("build/c.py", "def no():\n    pass\n"), ("skip.py", "def no():\n    pass\n"), ("keep.py", "import os\n"), ("notes.md", "# no\n"),
    ("big.py", "# " + "x" * 500 + "\n"), ("src/with space+plus.rs", "fn three() {}\n"),
]
TREE_RULES = "# rules\n*.py\n!keep.py\n!src/*.py\n!big.py\n"
TREE_KEPT = [("keep.py", "python"), ("src/a.py", "python"), ("src/deep/b.go", "go"), ("src/with space+plus.rs", "rust")]


def _put(spark: SparkSession, path: str, text: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def _tree(spark: SparkSession) -> str:
    root = fresh_path(spark, "tree")
    for path, text in TREE:
        _put(spark, f"{root}/{path}", text)
    return root


@query(f"select k.file_path, k.lang, t.source, strlen(t.source)::bigint size from {sql_values(['file_path', 'lang'], TREE_KEPT).replace(' t(', ' k(')} join (select * from {sql_values(['file_path', 'source'], TREE)}) t using (file_path)".replace("\n", "' || chr(10) || '"))
def scan_files(spark, sf_dir):
    """A tree with built-in folders, rules of which the last counts, a file that is too large, and unsupported ones."""
    root = _tree(spark).removeprefix("file://").removeprefix("file:")
    return scan_tree(spark, root, parse_ignore(TREE_RULES), max_bytes=400).select("file_path", "lang", "source", "size")


STREAMED = [("a.py", "python", TREE[0][1]), ("b.go", "go", TREE[1][1]), ("c.rs", "rust", TREE[7][1])]


@query(f"with {units_sql(STREAMED)} select kind, name, line_number, module_name from units")
def stream_units(spark, sf_dir):
    """Units that a stream of files keeps up to date, in two runs from one checkpoint."""
    base = fresh_path(spark, "stream")
    for part in (STREAMED[:2], STREAMED[2:]):
        for path, _, text in part:
            _put(spark, f"{base}/in/{path}", text)
        start_refresh(spark, f"{base}/in", f"{base}/units", f"{base}/checkpoint").awaitTermination()
    return read_units(spark, f"{base}/units").select("kind", "name", "line_number", "module_name")


# ---- outlines and texts, against what the rules give by hand

OUTLINES = [
    ("src/auth.py", [(0, "import", "os", 1), (0, "import", "models", 2), (0, "type", "Auth", 4), (1, "field", "limit", 5), (1, "fn", "handle_auth", 6), (2, "field", "count", 7), (0, "fn", "fetch_data", 10)]),
    ("src/main.go", [(0, "import", "fmt", 2), (0, "type", "Server", 4), (0, "fn", "main", 7), (1, "var", "x", 8), (0, "fn", "s", 10)]),
    ("src/lib.rs", [(0, "import", "crate", 1), (0, "type", "Point", 2), (1, "field", "x", 3), (0, "fn", "area", 5), (1, "var", "y", 6), (0, "type", "Shape", 9), (1, "field", "Round", 10), (1, "field", "Flat", 11)]),
    ("web/app.ts", [(0, "import", "foo", 1), (0, "type", "App", 2), (1, "field", "title", 3), (0, "fn", "run", 5), (1, "var", "n", 6), (0, "type", "Props", 8)]),
    ("app/thing.rb", [(0, "import", "set", 1), (0, "type", "Things", 2), (1, "type", "Thing", 3), (2, "field", "size", 4), (2, "fn", "grow", 5), (3, "field", "size", 6)]),
    ("src/main.zig", [(0, "import", "std", 1), (0, "type", "Kind", 2), (1, "field", "small", 3), (1, "field", "large", 4), (0, "fn", "run", 6), (1, "var", "n", 7)]),
    ("src/Box.java", [(0, "import", "java", 1), (0, "type", "Box", 2), (1, "field", "size", 3), (1, "fn", "grow", 4), (2, "var", "size", 5)]),
    ("web/util.js", [(0, "import", "fs", 1), (0, "type", "Cache", 2), (1, "field", "size", 3), (0, "fn", "load", 5), (1, "var", "n", 6)]),
    ("src/Store.cs", [(0, "import", "System", 1), (0, "type", "Store", 2), (1, "field", "count", 3), (1, "fn", "Add", 4)]),
    ("src/math.fs", [(0, "import", "System", 1), (0, "type", "Point", 2), (0, "fn", "area", 3)]),
    ("src/tree.cpp", [(0, "import", "vector", 1), (0, "type", "Tree", 2), (1, "field", "depth", 3), (0, "fn", "walk", 5), (1, "var", "0", 7)]),
    ("src/list.c", [(0, "import", "stdio", 1), (0, "type", "node", 2), (1, "field", "value", 3), (0, "fn", "push", 5), (1, "var", "0", 7)]),
]
OUTLINE_ROWS = [(p, *n) for p, own in OUTLINES for n in own]


@query(f"select file_path, depth, kind, name, line_number from {sql_values(['file_path', 'depth', 'kind', 'name', 'line_number'], OUTLINE_ROWS)}")
def engine_ast(spark, sf_dir):
    """Outlines of the whole project, in all twelve languages."""
    return on_files(spark).ast().select("file_path", "depth", "kind", "name", "line_number")


@query(f"select file_path, count(*)::bigint n from {sql_values(['file_path', 'depth', 'kind', 'name', 'line_number'], [r for r in OUTLINE_ROWS if r[0] in ('app/thing.rb', 'web/app.ts', 'web/util.js')])} group by 1")
def ast_chosen(spark, sf_dir):
    """Files by an explicit list or by a pattern."""
    return on_files(spark).ast(["app/thing.rb"], "web/*").groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


def _shown(name: str, columns: list[str], rows: list[tuple]) -> str:
    return f"{name}[{len(rows)}]{{{','.join(columns)}}}:\n" + "".join(",".join(map(str, r)) + "\n" for r in rows)


#: What the calls print for the fixture's units and the outline of one file, by hand.
TEXTS = {
    "refs": _shown("definitions", ["name", "kind", "file", "line"], [("handleAuth", "fn", "src/auth.zig", 10)]) + _shown("references", ["import_name", "file", "line"], [("handleAuth", "src/login.zig", 1)]),
    "impact": 'impact{source:"handleAuth",affected:3,max_depth:2}\n'
    + _shown("depth_0", ["name", "kind", "file", "line", "confidence"], [("handleAuth", "fn", "src/auth.zig", 10, "1.000")])
    + _shown("depth_1", ["name", "kind", "file", "line", "confidence"], [("loginUser", "fn", "src/login.zig", 20, "0.500")])
    + _shown("depth_2", ["name", "kind", "file", "line", "confidence"], [("start", "fn", "src/main.zig", 9, "0.333")]),
    "context": 'symbol{name:"handleAuth",kind:fn,file:"src/auth.zig",line:10}\nsignature: fn handleAuth()\n'
    + _shown("referenced_by", ["name", "kind", "file", "line"], [("handleAuth", "import", "src/login.zig", 1)])
    + _shown("references", ["name", "kind", "file", "line"], [("User", "type", "src/models.zig", 5)])
    + _shown("siblings", ["name", "kind", "line"], [("checkToken", "fn", 30)]),
    "changes": _shown("changes", ["name", "kind", "file", "line", "change"], [("handleAuth", "fn", "src/auth.zig", 10, "modified"), ("checkToken", "fn", "src/auth.zig", 30, "added"), ("loginUser", "fn", "src/login.zig", 20, "deleted")]),
    "ast": 'file{path:"src/math.fs",lang:"fsharp",nodes:3}:\n0,import,System,open System,1\n0,type,Point,type Point = { X: int },2\n0,fn,area,let area w h =,3\n',
    "clusters": "clusters[0]{id,label,size}:\n",
    "results": _shown("functions", ["name", "signature", "file", "line"], [("area", "let area w h =", "src/math.fs", 3)]) + _shown("types", ["name", "signature", "file", "line"], [("Point", "type Point = { X: int }", "src/math.fs", 2)]) + _shown("imports", ["name", "signature", "file", "line"], [("System", "open System", "src/math.fs", 1)]),
    "flat": _shown("results", ["kind", "name", "signature", "file", "line", "similarity"], [("import", "System", "open System", "src/math.fs", 1, "0.500"), ("type", "Point", "type Point = { X: int }", "src/math.fs", 2, "0.500"), ("fn", "area", "let area w h =", "src/math.fs", 3, "0.500")]),
}


def text_rows(rows: list[tuple]) -> str:
    return sql_values(["call", "text"], rows).replace("\n", "' || chr(10) || '")


@query(f"select call, text from {text_rows(list(TEXTS.items()))}")
def engine_texts(spark, sf_dir):
    """What the calls print."""
    e, f = on_units(spark), on_files(spark)
    some = f.units.where("file_path = 'src/math.fs'").withColumn("score", F.lit(0.5)).orderBy("line_number").collect()
    shown = {
        "refs": e.refs("handleAuth", text=True), "impact": e.impact("handleAuth", text=True), "context": e.context("handleAuth", text=True),
        "changes": e.changes(diff=values(spark, "diff_id long, diff string", [(0, DIFF)]), text=True), "ast": f.ast("src/math.fs", text=True), "clusters": e.clusters(1.0, 2, text=True),
        "results": render.results(some), "flat": render.flat(some),
    }
    return values(spark, "call string, text string", list(shown.items()))


@query(f"with {units_sql(FILES)}, k as (select kind, file_path, line_number, name || ',' || signature || ',' || file_path || ',' || line_number l, case kind when 'fn' then 'functions' when 'type' then 'types' else 'imports' end t from units) select kind, count(*)::bigint n, t || '[' || count(*) || ']{{name,signature,file,line}}:' || chr(10) || string_agg(l, chr(10) order by file_path || ':' || lpad(line_number::varchar, 5, '0'), l) as text from k group by kind, t".replace("{{", "{").replace("}}", "}"))
def render_results(spark, sf_dir):
    """Result groups as text, by plan."""
    return render.results_table(on_files(spark).units.withColumn("rank", F.concat_ws(":", "file_path", F.format_string("%05d", "line_number"))), "rank")


ARGUMENTS = [("top_k", 0, 20), ("top_k", 7, 7), ("max_depth", 11, 2), ("max_depth", 10, 10), ("max_depth", 0, 2), ("min_size", 0, 2), ("min_size", 5, 5), ("threshold", None, 15)]


@query(f"select argument, coalesce(given::varchar, '') given, used from {sql_values(['argument', 'given', 'used'], ARGUMENTS)}")
def engine_arguments(spark, sf_dir):
    """What counts for arguments that are missing or out of range; the threshold in hundredths."""
    rules = {"top_k": lambda x: defaults.whole(x, defaults.TOP_K), "max_depth": lambda x: defaults.whole(x, defaults.MAX_DEPTH, 10), "min_size": lambda x: defaults.whole(x, defaults.MIN_SIZE), "threshold": lambda x: round(100 * defaults.number(x, defaults.THRESHOLD))}
    return values(spark, "argument string, given string, used int", [(a, "" if g is None else str(g), rules[a](g)) for a, g, _ in ARGUMENTS])


def _said(text: str, wrong: bool = False) -> str:
    return json.dumps({"content": [{"type": "text", "text": text}], **({"isError": True} if wrong else {})}, separators=(",", ":"))


#: Messages and their answers, the latter by hand.
MESSAGES = [
    ("nonsense", '{"jsonrpc":"2.0","id":null,"error":{"code":-32700,"message":"Parse error"}}'),
    ("[1]", '{"jsonrpc":"2.0","id":null,"error":{"code":-32600,"message":"Invalid request"}}'),
    ('{"id":1}', '{"jsonrpc":"2.0","id":1,"error":{"code":-32600,"message":"Missing method"}}'),
    ('{"id":2,"method":"ping"}', '{"jsonrpc":"2.0","id":2,"result":{}}'),
    ('{"method":"notifications/initialized"}', None),
    ('{"id":"x","method":"resources/list"}', '{"jsonrpc":"2.0","id":"x","result":{"resources":[]}}'),
    ('{"id":3,"method":"nope"}', '{"jsonrpc":"2.0","id":3,"error":{"code":-32601,"message":"Method not found"}}'),
    ('{"id":4,"method":"tools/call"}', '{"jsonrpc":"2.0","id":4,"error":{"code":-32602,"message":"Missing params"}}'),
    ('{"id":5,"method":"tools/call","params":{}}', '{"jsonrpc":"2.0","id":5,"error":{"code":-32602,"message":"Missing tool name"}}'),
    ('{"id":6,"method":"tools/call","params":{"name":"refs"}}', '{"jsonrpc":"2.0","id":6,"result":' + _said("Missing required argument: symbol", True) + "}"),
    ('{"id":7,"method":"tools/call","params":{"name":"dance"}}', '{"jsonrpc":"2.0","id":7,"result":' + _said("Unknown tool", True) + "}"),
    ('{"id":8,"method":"tools/call","params":{"name":"refs","arguments":{"symbol":"handleAuth"}}}', '{"jsonrpc":"2.0","id":8,"result":' + _said(TEXTS["refs"]) + "}"),
    ('{"id":9,"method":"tools/call","params":{"name":"impact","arguments":{"symbol":"handleAuth","max_depth":99}}}', '{"jsonrpc":"2.0","id":9,"result":' + _said(TEXTS["impact"]) + "}"),
]


@query(f"select asked, coalesce(answer, '') answer from {sql_values(['asked', 'answer'], MESSAGES)}")
def rpc_answers(spark, sf_dir):
    """The JSON-RPC front end."""
    d = rpc.Dispatcher(lambda cwd: on_units(spark))
    return values(spark, "asked string, answer string", [(m, d.answer(m) or "") for m, _ in MESSAGES])
