"""Languages by file name, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix and language.
SUFFIXES = (
    (".zig", "zig"), (".ts", "typescript"), (".tsx", "typescript"), (".js", "javascript"), (".jsx", "javascript"), (".py", "python"), (".go", "go"), (".rs", "rust"), (".c", "c"),
    (".h", "c"), (".cpp", "cpp"), (".hpp", "cpp"), (".cc", "cpp"), (".java", "java"), (".rb", "ruby"), (".fs", "fsharp"), (".fsx", "fsharp"), (".cs", "csharp"),
)


def language_of(path) -> Column:
    """The language of a path by its suffix, ``unknown`` without one; case counts."""
    name = F.col(path) if isinstance(path, str) else path
    out = F.lit("unknown")
    for suffix, language in reversed(SUFFIXES):
        out = F.when(name.endswith(suffix), language).otherwise(out)
    return out


def is_supported(path) -> Column:
    return language_of(path) != "unknown"


LANGUAGES = tuple(dict.fromkeys(language for _, language in SUFFIXES))


def display_name(language) -> Column:
    """The name to show for a language: its own if it is supported, else ``unknown``."""
    name = F.col(language) if isinstance(language, str) else language
    return F.when(name.isin(*LANGUAGES), name).otherwise("unknown")
