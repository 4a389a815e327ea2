"""Code units (functions, types, imports) from source lines, by one pattern per language and kind.

The patterns serve both the Catalyst plan here and the outline parser, which needs state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import module_name

# Modifiers in the order they are tried, and keywords by language.
MODIFIERS = (
    "export default ", "export ", "pub(crate) ", "pub ", "public static ", "public ", "private ", "protected ", "static ", "abstract ", "override ", "virtual ", "inline ", "const ",
)
FUNCTIONS = {
    "zig": ("fn ",), "python": ("def ", "async def "), "go": ("func ",), "rust": ("fn ",), "typescript": ("function ", "async function "), "javascript": ("function ", "async function "),
    "ruby": ("def ",), "fsharp": ("let ",),
}
TYPES = {
    "python": ("class ",), "go": ("type ",), "rust": ("struct ", "enum ", "trait "), "typescript": ("class ", "interface ", "type "), "javascript": ("class ", "interface ", "type "),
    "java": ("class ", "interface ", "enum "), "csharp": ("class ", "interface ", "enum "), "ruby": ("class ", "module "), "fsharp": ("type ",), "c": ("struct ", "enum ", "class "),
    "cpp": ("struct ", "enum ", "class "),
}
IMPORTS = {
    "python": ("import ", "from "), "go": ("import ",), "rust": ("use ",), "typescript": ("import ",), "javascript": ("import ",), "java": ("using ", "import "),
    "csharp": ("using ", "import "), "ruby": ("require ",), "fsharp": ("open ",), "c": ("#include ",), "cpp": ("#include ",),
}
CONTROL = ("if", "else", "for", "while", "switch", "return", "throw", "new", "try", "catch")
NOT_CALLED = ("if", "for", "while", "switch", "return", "sizeof", "typeof")

STRIP = "^(?:" + "|".join(m.replace("(", "[(]").replace(")", "[)]") for m in MODIFIERS) + ")*"
WORD = "[^A-Za-z0-9_]*([A-Za-z0-9_]+)"
METHOD = "^(?!(?:" + "|".join(CONTROL) + ") )[^(]*[^A-Za-z0-9_(]([A-Za-z0-9_]+) *[(]"
C_FUNCTION = "^(?!#)(?:[^(=;]*[^A-Za-z0-9_(=;])?(?:(?<=[*])|(?!(?:" + "|".join(NOT_CALLED) + ") *[(]))([A-Za-z0-9_]+) *[(]"


def _keywords(words: tuple[str, ...]) -> str:
    return "^(?:" + "|".join(words) + ")" + WORD


def matchers(language: str) -> list[tuple[str, str, bool]]:
    """(kind, pattern, whether modifiers go first) in the order they are tried."""
    out = []
    if language in FUNCTIONS:
        out.append(("fn", _keywords(FUNCTIONS[language]), True))
    elif language in ("java", "csharp"):
        out.append(("fn", METHOD, True))
    elif language in ("c", "cpp"):
        out.append(("fn", C_FUNCTION, False))
    if language == "zig":
        out.append(("type", "^(?:pub )?const ((?:(?! = ).)*) = (?:struct|enum|union|opaque)", False))
        out.append(("import", '@import[(][^"]*"([^"]*)"', False))
    elif language in TYPES:
        out += [("type", _keywords(TYPES[language]), True), ("import", _keywords(IMPORTS[language]), True)]
    return out


LANGUAGES = sorted({*FUNCTIONS, *TYPES})


def _first(kind: str, lang: Column, line: Column, bare: Column) -> Column:
    out = F.lit(None).cast("string")
    for language in LANGUAGES:
        for k, pattern, strip in matchers(language):
            if k == kind:
                found = F.nullif(F.regexp_extract(bare if strip else line, pattern, 1), F.lit(""))
                out = F.when(lang == language, found).otherwise(out)
    return out


def extract_units(files: DataFrame, path="file_path", lang="lang", source="source") -> DataFrame:
    """One row per unit: kind, name, signature, file_path, line_number, module_name; a line gives one unit at most."""
    lines = files.select(F.col(path).alias("file_path"), F.col(lang).alias("_lang"), F.posexplode(F.split(F.col(source), "\n")).alias("_at", "_raw"))
    lines = lines.withColumn("signature", F.btrim("_raw", F.lit(" \t\r"))).where("signature <> ''").withColumn("_bare", F.regexp_replace("signature", STRIP, ""))
    kinds = {k: _first(k, F.col("_lang"), F.col("signature"), F.col("_bare")) for k in ("fn", "type", "import")}
    found = lines.select("*", *(c.alias(f"_{k}") for k, c in kinds.items())).where("coalesce(_fn, _type, _import) is not null")
    kind = F.when(F.col("_fn").isNotNull(), "fn").when(F.col("_type").isNotNull(), "type").otherwise("import")
    return found.select(kind.alias("kind"), F.coalesce("_fn", "_type", "_import").alias("name"), "signature", "file_path", (F.col("_at") + 1).alias("line_number"), module_name(F.col("file_path")).alias("module_name"))
