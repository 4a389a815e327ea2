"""Units of Python files by their syntax tree, for those who prefer it to the line patterns."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions.shipping import ship
from codelode.functions.text import module_name
from codelode.operators import extract

UNITS = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("signature", pa.string()), ("line_number", pa.int32())]))


def python_units(source: str | None) -> list[dict] | None:
    """Functions, classes and imports outside of functions and classes, also inside of conditions and loops; None where the source doesn't parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines, out = (source or "").encode().split(b"\n"), []

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            kind = "fn" if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)) else "type" if isinstance(child, ast.ClassDef) else "import" if isinstance(child, (ast.Import, ast.ImportFrom)) else None
            if kind is None:
                if not isinstance(child, ast.expr):
                    walk(child)
                continue
            # the rest of the line that the declaration starts on; a decorated one starts below its decorators
            text = lines[child.lineno - 1][child.col_offset :].decode("utf-8", "replace").strip(" \t\r")
            if kind != "import":
                name = child.name
            elif isinstance(child, ast.ImportFrom):
                name = "." * child.level + (child.module or "")
            else:
                name = child.names[0].name
            out.append({"kind": kind, "name": name, "signature": text, "line_number": child.lineno})

    walk(tree)
    return out


def extract_units(files: DataFrame, path="file_path", lang="lang", source="source") -> DataFrame:
    """As ``extract.extract_units``; Python files that parse go by their tree, so that methods are no units."""
    ship(files.sparkSession)
    parse = F.arrow_udf(lambda texts: pa.array([python_units(t) for t in texts.to_pylist()], UNITS), "array<struct<kind:string,name:string,signature:string,line_number:int>>")
    rows = files.select(F.col(path).alias("file_path"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    rows = rows.withColumn("parsed", F.when(F.col("lang") == "python", parse("source")))
    by_tree = rows.where("parsed is not null").select("file_path", F.explode("parsed").alias("u"))
    by_tree = by_tree.select("u.kind", "u.name", "u.signature", "file_path", "u.line_number", module_name(F.col("file_path")).alias("module_name"))
    return extract.extract_units(rows.where("parsed is null")).unionByName(by_tree)
