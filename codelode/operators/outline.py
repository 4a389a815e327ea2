"""Depth-aware outlines of source files: one Arrow call per batch of files, as the parse keeps state."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.functions.shipping import ship
from codelode.operators.extract import STRIP, matchers

# Names that are never members.
NOT_FIELDS = frozenset(("if", "else", "elif", "for", "while", "switch", "return", "break", "continue", "case", "default", "except", "finally", "try", "with", "match"))
NOT_NAMES = frozenset((
    "if", "else", "for", "while", "switch", "return", "break", "continue", "case", "default", "throw", "new", "delete", "sizeof", "typeof", "goto", "class", "struct", "enum", "interface", "extends",
    "implements", "import", "using", "namespace", "package",
))
NOT_VARIANTS = frozenset(("if", "else", "for", "while", "switch", "return", "break", "continue", "pub", "const", "var", "fn"))
MEMBERS = {
    "zig": (r"^(?:pub )?(?:const |var )\W*(\w+)", False),
    "rust": (r"^let (?:mut )?\W*(\w+)", True),
    "javascript": (r"^(?:let |var )\W*(\w+)", True),
    "typescript": (r"^(?:let |var )\W*(\w+)", True),
    "go": (r"^var \W*(\w+)|^\W*(\w+).* := ", True),
    "python": (r"^self\.\W*(\w+)", True),
    "ruby": (r"^@@?\W*(\w+)|^attr_(?:accessor|reader|writer) :\W*(\w+)", True),
}
COLON = frozenset(("zig", "rust", "typescript", "javascript", "python", "fsharp"))
TYPED = frozenset(("java", "csharp", "c", "cpp"))
NODES = "array<struct<depth:int,kind:string,name:string,signature:string,line_number:int>>"
_BARE = re.compile(STRIP)
_QUOTED = re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?$)|//.*|#.*', re.S)


def _group(m: re.Match) -> str:
    return next(g for g in m.groups() if g)


class Matcher:
    """What a line declares, in one language."""

    def __init__(self, lang: str):
        self.lang = lang
        self.units = [(k, re.compile(p, re.A), strip) for k, p, strip in matchers(lang)]
        self.own = MEMBERS.get(lang) and (re.compile(MEMBERS[lang][0], re.A), MEMBERS[lang][1])

    def unit(self, line: str, bare: str):
        for kind, pattern, strip in self.units:
            if (m := pattern.search(bare if strip else line)) and m[1]:
                return kind, m[1]
        return None

    def member(self, line: str, bare: str) -> str | None:
        if self.own and (m := self.own[0].search(bare if self.own[1] else line)):
            return _group(m)
        if self.lang in COLON and (m := re.match(r"(\w+): ", bare, re.A)) and m[1] not in NOT_FIELDS:
            return m[1]
        if self.lang in TYPED and bare and bare[0] not in "#/" and not re.search(r"[({]", bare):
            m = re.search(r"\W(\w+)\W*$", re.split("[;=]", bare, maxsplit=1)[0].rstrip(" "), re.A)
            if m and m[1] not in NOT_NAMES:
                return m[1]
        return None

    def is_enum(self, line: str) -> bool:
        return "= enum" in line if self.lang == "zig" else "enum " in line or "enum{" in line


def variant(line: str) -> str | None:
    line = line.rstrip(", ;")
    name = re.split(r" =", line, maxsplit=1)[0] if " =" in line else line.split("(")[0]
    name = name.rstrip(" ")
    return name if re.fullmatch(r"\w+", name, re.A) and name not in NOT_VARIANTS else None


def net_braces(line: str) -> int:
    plain = _QUOTED.sub("", line)
    return plain.count("{") - plain.count("}")


def by_braces(source: str, lang: str) -> list[dict]:
    match, depth, inside, nodes = Matcher(lang), 0, {0: "top"}, []
    for at, raw in enumerate(source.split("\n"), 1):
        line = raw.strip(" \t\r")
        if not line:
            continue
        bare = _BARE.sub("", line)
        where = inside.get(depth, "top") if depth < 128 else "top"
        unit = match.unit(line, bare)
        if unit is None:
            if name := match.member(line, bare):
                unit = ("field" if where in ("struct", "enum") else "var", name)
            elif where == "enum" and (name := variant(line)):
                unit = ("field", name)
        if unit:
            nodes.append({"depth": depth, "kind": unit[0], "name": unit[1], "signature": line, "line_number": at})
        net = net_braces(line)
        if net > 0 and depth + net < 128:
            kind = unit[0] if unit else None
            inside[depth + net] = ("enum" if match.is_enum(line) else "struct") if kind == "type" else "fn" if kind == "fn" else where
        depth = max(0, depth + net)
    return nodes


def by_indent(source: str, lang: str) -> list[dict]:
    match, step, nodes = Matcher(lang), 0, []
    for at, raw in enumerate(source.split("\n"), 1):
        right = raw.rstrip(" \t\r")
        line = right.lstrip(" \t")
        if not line:
            continue
        indent = len(right) - len(line)
        step = step or indent
        bare = _BARE.sub("", line)
        unit = match.unit(line, bare) or ((name := match.member(line, bare)) and ("field", name))
        if unit:
            nodes.append({"depth": indent // step if step else 0, "kind": unit[0], "name": unit[1], "signature": line, "line_number": at})
    return nodes


def parse(source: str | None, lang: str) -> list[dict]:
    return (by_indent if lang in ("python", "ruby") else by_braces)(source or "", lang)


def _parsed(source: pa.Array, lang: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("depth", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("signature", pa.string()), ("line_number", pa.int32())]))
    return pa.array([parse(s, g) for s, g in zip(source.to_pylist(), lang.to_pylist(), strict=True)], kind)


def outline(files: DataFrame, path="file_path", lang="lang", source="source") -> DataFrame:
    """(file_path, lang, depth, kind, name, signature, line_number) of each node."""
    ship(files.sparkSession)
    return files.select(F.col(path).alias("file_path"), F.col(lang).alias("lang"), F.explode(F.arrow_udf(_parsed, NODES)(F.col(source), F.col(lang))).alias("n")).select("file_path", "lang", "n.*")
