"""Definitions, references, impact and context as joins over a table of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codelode.functions.tables import materialize


def definitions(units: DataFrame) -> DataFrame:
    return units.where("kind in ('fn', 'type')").select("name", "kind", "file_path", "line_number", "signature")


def derived_module(name: Column) -> Column:
    """Module name of a file-like import: leading ./ and ../ go, then folders and the last extension; null if that changes nothing."""
    base = F.regexp_extract(F.regexp_replace(name, r"^(?:\./(?=.)|\.\./(?=.))*", ""), r"([^/]*)/*$", 1)
    stem = F.regexp_replace(base, r"^(.+)\.[^.]*$", "$1")
    return F.when((base != "") & (stem != name), stem)


def references(units: DataFrame, resolve_paths: bool = False) -> DataFrame:
    """(def_name, import_name, file_path, line_number): imports that name a definition, exactly, by module, or (on demand) by the last :: part."""
    imports = units.where("kind = 'import'").select(F.monotonically_increasing_id().alias("_i"), F.col("name").alias("import_name"), "file_path", "line_number")
    keys = [F.col("import_name"), derived_module(F.col("import_name"))] + ([F.element_at(F.split("import_name", "::"), -1)] if resolve_paths else [])
    tried = imports.select("*", F.posexplode(F.array(*keys)).alias("_rank", "def_name")).where("def_name is not null")
    found = tried.join(definitions(units).select(F.col("name").alias("def_name")).distinct(), "def_name")
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("_i").orderBy("_rank"))).where("_n = 1")
    return best.select("def_name", "import_name", "file_path", "line_number")


def references_to(refs: DataFrame, symbol: str) -> DataFrame:
    return refs.where(F.col("def_name") == symbol)


def dependencies_of(refs: DataFrame, file_path: str) -> DataFrame:
    return refs.where(F.col("file_path") == file_path).select("def_name").distinct()


def impact(defs: DataFrame, refs: DataFrame, symbol: str, max_depth: int = 2) -> DataFrame:
    """(name, file_path, line_number, kind, depth, confidence) of what depends on a symbol, breadth first.

    Each level joins the frontier's names with the references and the definitions of the
    referring files and leaves out what was seen, until a level is empty. Levels are written.
    """
    depth = max_depth if 1 <= max_depth <= 10 else 2
    own = defs.select("name", "file_path", "line_number", "kind")
    nodes = own.withColumn("_n", F.row_number().over(Window.partitionBy("name", "file_path").orderBy("line_number"))).where("_n = 1").drop("_n")
    nodes = materialize(nodes, "impact-nodes")
    seen = materialize(nodes.where(F.col("name") == symbol).withColumn("depth", F.lit(0)), "impact-level")
    frontier = seen
    edges = materialize(refs.select("def_name", F.col("file_path").alias("_f")).distinct(), "impact-edges")
    for d in range(1, depth + 1):
        reached = frontier.select(F.col("name").alias("def_name")).distinct().join(edges, "def_name").select(F.col("_f").alias("file_path")).distinct()
        level = nodes.join(reached, "file_path").join(seen, ["name", "file_path"], "left_anti").select("name", "file_path", "line_number", "kind", F.lit(d).alias("depth"))
        level = materialize(level, "impact-level")
        if not level.limit(1).count():
            break
        seen, frontier = seen.unionByName(level), level
    return seen.withColumn("confidence", 1.0 / (1 + F.col("depth")))


def context(units: DataFrame, symbol: str, resolve_paths: bool = False) -> DataFrame:
    """(section, name, kind, file_path, line_number, signature): definition, referenced_by, references and siblings of a symbol."""
    defs, refs = definitions(units), references(units, resolve_paths)
    columns = ["name", "kind", "file_path", "line_number", "signature"]
    none = F.lit(None).cast("string")
    own = defs.where(F.col("name") == symbol).orderBy("file_path", "line_number").limit(1)
    part = lambda df, name: df.select(F.lit(name).alias("section"), *columns)
    by = references_to(refs, symbol).select(F.col("import_name").alias("name"), F.lit("import").alias("kind"), "file_path", "line_number", none.alias("signature"))
    here = F.broadcast(own.select(F.col("file_path").alias("_f")))  # one row at most
    used = refs.join(here, F.col("file_path") == F.col("_f")).select("def_name", F.col("import_name"), F.col("file_path").alias("_file"), F.col("line_number").alias("_line"))
    first = defs.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("file_path", "line_number"))).where("_n = 1").withColumnRenamed("name", "def_name")
    uses = used.join(first, "def_name", "left").select(F.col("def_name").alias("name"), "kind", "file_path", "line_number", "signature")
    siblings = defs.join(here, F.col("file_path") == F.col("_f")).where(F.col("name") != symbol)
    return part(own, "definition").unionByName(part(by, "referenced_by")).unionByName(part(uses, "references")).unionByName(part(siblings, "siblings"))
