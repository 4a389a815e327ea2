"""Result tables as compact text: a header with a count and the column names, then one line per row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

SECTIONS = (("fn", "functions"), ("type", "types"), ("import", "imports"))


def section(name: str, columns: list[str], rows: list[Row]) -> str:
    head = f"{name}[{len(rows)}]{{{','.join(columns)}}}:\n"
    return head + "".join(",".join(_shown(v) for v in r) + "\n" for r in rows)


def _shown(v) -> str:
    return "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)


def results(ranked_units: list[Row]) -> str:
    """Functions, types and imports in rank order; empty groups are left out."""
    out = ""
    for kind, name in SECTIONS:
        rows = [(r["name"], r["signature"], r["file_path"], r["line_number"]) for r in ranked_units if r["kind"] == kind]
        if rows:
            out += section(name, ["name", "signature", "file", "line"], rows)
    return out


def results_table(units: DataFrame, order: str) -> DataFrame:
    """The same text by plan, one row per kind: for short result lists."""
    line = F.concat_ws(",", "name", "signature", "file_path", F.col("line_number").cast("string"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    label = F.element_at(F.create_map(*(F.lit(x) for pair in SECTIONS for x in pair)), F.col("kind"))
    grouped = units.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.array_join(lines, "\n").alias("body"))
    return grouped.select("kind", "n", F.concat(label, F.lit("["), F.col("n").cast("string"), F.lit("]{name,signature,file,line}:\n"), "body").alias("text"))


def flat(ranked_units: list[Row]) -> str:
    """One group in rank order, with the score to three places."""
    return section("results", ["kind", "name", "signature", "file", "line", "similarity"], [(r["kind"], r["name"], r["signature"], r["file_path"], r["line_number"], float(r["score"])) for r in ranked_units])


def outline_table(nodes: DataFrame) -> DataFrame:
    """(file_path, lang, n, text): the nodes of each file in order under a header with path, language and count."""
    line = F.concat_ws(",", F.col("depth").cast("string"), "kind", "name", "signature", F.col("line_number").cast("string"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("line_number", line.alias("l")))), lambda x: F.concat(x["l"], F.lit("\n")))
    grouped = nodes.groupBy("file_path", "lang").agg(F.count(F.lit(1)).alias("n"), F.array_join(lines, "").alias("body"))
    return grouped.select("file_path", "lang", "n", F.format_string('file{path:"%s",lang:"%s",nodes:%d}:\n%s', "file_path", "lang", "n", "body").alias("text"))


def project_head(root: str, files: int, nodes: int) -> str:
    return f'ast{{root:"{root}",files:{files},nodes:{nodes}}}\n'


def refs(definitions: list[Row], references: list[Row]) -> str:
    text = section("definitions", ["name", "kind", "file", "line"], [(r["name"], r["kind"], r["file_path"], r["line_number"]) for r in definitions])
    return text + section("references", ["import_name", "file", "line"], [(r["import_name"], r["file_path"], r["line_number"]) for r in references])


def impact(symbol: str, rows: list[Row]) -> str:
    deepest = max((r["depth"] for r in rows), default=0)
    text = f'impact{{source:"{symbol}",affected:{len(rows)},max_depth:{deepest}}}\n'
    for d in range(deepest + 1):
        if own := [(r["name"], r["kind"], r["file_path"], r["line_number"], float(r["confidence"])) for r in rows if r["depth"] == d]:
            text += section(f"depth_{d}", ["name", "kind", "file", "line", "confidence"], own)
    return text


def context(rows: list[Row]) -> str:
    part = lambda s: [r for r in rows if r["section"] == s]
    text = "symbol{not_found}\n"
    for r in part("definition"):
        text = f'symbol{{name:"{r["name"]}",kind:{r["kind"]},file:"{r["file_path"]}",line:{r["line_number"]}}}\nsignature: {r["signature"]}\n'
    for s in ("referenced_by", "references"):
        text += section(s, ["name", "kind", "file", "line"], [(r["name"], r["kind"], r["file_path"], r["line_number"]) for r in part(s)])
    return text + section("siblings", ["name", "kind", "line"], [(r["name"], r["kind"], r["line_number"]) for r in part("siblings")])


def changes(rows: list[Row]) -> str:
    return section("changes", ["name", "kind", "file", "line", "change"], [(r["name"], r["kind"], r["file_path"], r["line_number"], r["change"]) for r in rows])


def clusters(heads: list[Row], members: list[Row]) -> str:
    text, by = section("clusters", ["id", "label", "size"], [(h["cluster_id"], h["label"], h["size"]) for h in heads]), {}
    for m in members:
        by.setdefault(m["cluster_id"], []).append((m["name"], m["kind"], m["file_path"], m["line_number"]))
    for h in heads:
        text += "\n" + section(f"cluster_{h['cluster_id']}", ["name", "kind", "file", "line"], by.get(h["cluster_id"], []))
    return text
