"""Secret scans with corpus-wide ownership counts, with DataFrame operations only.

Row by row, fixed patterns give the base spans. The hash of each candidate value is then
counted over distinct repositories and distinct owners: a value of many owners or of many
repositories is a widely copied example, one that few of both have looks live. High-entropy
strings of no known kind are added as spans of kind ``opaque`` only if they look live.

Odd cases: a null text is empty; a null owner is an owner of its own, a null repository too; rows
that share doc_id and text, repeated rows among them, share one result; a row without matches has
empty spans; texts of any length are scanned whole; an empty table gives no rows; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import in_chunks, materialize

KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind: (cheap test, pattern, group that holds the value, its least length)
PATTERNS = {
    "assign": (r"(?i:passw|secret|token|api_?key)", ASSIGN, 2, 12),
    "access": (r"AKIA", r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16}", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so that this equals [0-9a-f]+ of 16 or more
    "opaque": (
        r"[A-Za-z0-9_-]{24}",
        r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]*[0-9])(?=[A-Za-z0-9_-]*[A-Z])(?=[A-Za-z0-9_-]*[a-z])[A-Za-z0-9_-]{24,}",
        0,
        24,
    ),
}
SPAN = "array<struct<start:bigint,end:bigint,kind:int,value:string>>"


def spans_of(kind: str) -> Column:
    """All spans of one kind in column ``t``, as code points: gaps and matches, laid end to end."""
    test, pattern, group, least = PATTERNS[kind]
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    items = f"arrays_zip(split(t, '{quoted}', -1), regexp_extract_all(t, '{quoted}', 0))"
    # the pattern looks at nothing around a match, so that the match alone gives its group
    value = f"regexp_extract(x.`1`, '{quoted}', {group})" if group else "x.`1`"
    step = (
        "(a, x) -> named_struct('at', a.at + length(x.`0`) + coalesce(length(x.`1`), 0), 'spans',"
        f" if(length({value}) >= {least}, concat(a.spans, array(named_struct('start', a.at + length(x.`0`), 'end', a.at + length(x.`0`) + length(x.`1`),"
        f" 'kind', {KINDS.index(kind)}, 'value', md5({value})))), a.spans))"
    )
    walk = F.expr(in_chunks(items, "coalesce(length(x.`0`), 0) + coalesce(length(x.`1`), 0)", step, SPAN))
    return F.when(F.col("t").rlike(test), walk).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, doc_id="doc_id", text="text", owner="source", repo: str | None = "doc_id", max_owners: int = 1, example_owners: int = 2, max_repos: int = 10, example_repos: int = 11) -> DataFrame:
    """Per row: doc_id, ``base`` and ``spans`` arrays sorted by start and kind, n_live, n_example, and the most owners and repositories that one of its values has.

    Documents are their own repositories unless another column says which they come from.
    Without ``repo`` owners decide alone. A null repository is one of its own.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    own = F.coalesce(F.concat(F.lit("="), F.col(owner).cast("string")), F.lit("?"))
    place = F.coalesce(F.concat(F.lit("="), F.col(repo).cast("string")), F.lit("?")) if repo else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("t"), own.alias("owner"), place.alias("repo"))
    rows = rows.withColumn("rk", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "t")))
    rows = rows.select("doc_id", "rk", "owner", "repo", *(spans_of(k).alias(k) for k in KINDS))
    rows = rows.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    free = F.filter("opaque", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"])))
    rows = materialize(rows.select("doc_id", "rk", "owner", "repo", "base", free.alias("opaque")), "secrets")
    found = rows.select("rk", "owner", "repo", F.explode(F.concat("base", "opaque")).alias("s"))
    value = F.unhex(F.col("s")["value"])
    owners = found.select(value.alias("v"), "owner").distinct().groupBy("v").agg(F.count(F.lit(1)).alias("owners"))
    live, example = F.col("owners") <= max_owners, F.col("owners") >= example_owners
    owners = owners.withColumn("repos", F.lit(0).cast("long")) if not repo else owners
    if repo:
        repos = found.select(value.alias("v"), "repo").distinct().groupBy("v").agg(F.count(F.lit(1)).alias("repos"))
        owners = owners.join(repos, "v")
        live, example = live & (F.col("repos") <= max_repos), example | (F.col("repos") >= example_repos)
    counts = owners.select(F.lower(F.hex("v")).alias("value"), live.alias("live"), example.alias("example"), "owners", "repos")
    # the join key differs from the grouping key, so that both sides are dealt anew and a hot value can be split
    judged = found.select("rk", "s", F.col("s")["value"].alias("value")).distinct().join(counts, "value")
    per_row = judged.groupBy("rk").agg(
        F.collect_list(F.when(F.col("live") & (F.col("s")["kind"] == KINDS.index("opaque")), F.col("s"))).alias("added"),
        F.sum(F.col("live").cast("long")).alias("n_live"),
        F.sum(F.col("example").cast("long")).alias("n_example"),
        F.max("owners").alias("max_owners"),
        F.max("repos").alias("max_repos"),
    )
    out = rows.join(per_row, "rk", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(SPAN))))
    return out.select("doc_id", "base", spans.alias("spans"), *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "max_owners", "max_repos")))


def joined(spans: str) -> Column:
    """kind:start:end of each span in order of start, then kind."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    ordered = f"array_sort({spans}, (a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 when a.kind < b.kind then -1 when a.kind > b.kind then 1 else 0 end)"
    return F.expr(f"array_join(transform({ordered}, s -> concat_ws(':', {names}[s.kind], s.start, s.end)), ',')")
