"""Files read by a parser of their language: one row a file with its symbols, imports and re-exports."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from canopyql.functions.text import SCRIPT
from canopyql.sources import braces, python_ast

#: Characters of a text up to which it is parsed; longer ones are read line by line.
MOST_CHARS = 1 << 20
SYMBOL = "n string, t string, l int, el int, sig string, cx int, local boolean, q string, tr string, exp boolean, refs array<string>, trefs array<string>, qrefs array<struct<path:string,name:string>>"
_NAMES = "array<struct<name:string,local:string>>"
FILE = f"path string, lang string, symbols array<struct<{SYMBOL.replace(', ', ',').replace(' ', ':')}>>, imports {_NAMES}, handed {_NAMES}"


def parse(lang: str, text: str) -> tuple[list[dict], list, list] | None:
    """Symbols, imports and re-exports of one text, or None where it can't be parsed."""
    if len(text) > MOST_CHARS:
        return None
    try:
        if lang == "py":
            return python_ast.read(text)
        return braces.read(lang, text)
    except (SyntaxError, ValueError, RecursionError, IndexError):
        return None


def parsed(files: DataFrame) -> DataFrame:
    """A row (see ``FILE``) for each file of (path, lang, text) that has a parser and goes through it."""
    schema = files.sparkSession.createDataFrame([], FILE).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lang, text in zip(*(batch.column(c).to_pylist() for c in ("path", "lang", "text")), strict=True):
                found = parse(lang, text or "")
                if found is not None:
                    names = lambda pairs: [{"name": n, "local": a} for n, a in pairs]
                    symbols = [s | {"qrefs": [{"path": p, "name": n} for p, n in s["qrefs"]]} for s in found[0]]
                    rows.append({"path": path, "lang": lang, "symbols": symbols, "imports": names(found[1]), "handed": names(found[2])})
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.where(F.col("lang").isin("rust", "py", *SCRIPT)).select("path", "lang", "text").mapInArrow(run, schema)


#: What each parser makes symbols of, and their kinds.
DECLARATIONS = {
    "rust": {"fn": "fn", "struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "mod": "mod", "const": "const", "static": "const", "macro_rules": "macro", "type": "type", "impl": "impl", "field": "field", "variant": "variant"},
    "script": {"function": "fn", "class": "class", "interface": "iface", "type": "type", "enum": "type", "method": "method", "variable": "var", "field": "field", "property": "prop"},
    "py": {ast.FunctionDef.__name__: "fn", ast.AsyncFunctionDef.__name__: "fn", ast.ClassDef.__name__: "class", ast.Assign.__name__: "var", ast.AnnAssign.__name__: "var"},
}


def declaration_table(spark) -> DataFrame:
    """(lang, node, kind) of all forms that are made symbols."""
    return spark.createDataFrame([(lang, node, kind) for lang, forms in DECLARATIONS.items() for node, kind in forms.items()], "lang string, node string, kind string")


#: A word that begins a statement of a brace language, after what may stand before it.
_OPENER = re.compile(r"^[ \t]*(?:(?:export|default|pub(?:\([^)\n]*\))?|async|unsafe|declare|abstract|static)[ \t]+)*([A-Za-z_]\w*)[ \t]*(?=[\w({<$:!;=,.]|$)", re.M)


def nodes(lang: str, text: str) -> Iterator[tuple[str, int]]:
    """(node, line) of the node types in a text: all nodes of a Python tree that have a place, the words that begin a line's
    statement in the other languages. Nothing for languages without a parser and for what does not parse."""
    if len(text) > MOST_CHARS or lang not in ("rust", "py", *SCRIPT):
        return
    if lang == "py":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return
        for x in ast.walk(tree):
            if (line := getattr(x, "lineno", None)) is not None:
                yield type(x).__name__, line
        return
    line, at = 1, 0
    for m in _OPENER.finditer(text):
        line, at = line + text.count("\n", at, m.start(1)), m.start(1)
        yield m[1], line


class ParsedSymbols:
    """``SELECT f.path, s.* FROM files f, LATERAL parsed_symbols(f.lang, f.text) s``: the symbols of a text."""

    def eval(self, lang: str, text: str) -> Iterator[tuple]:
        found = parse(lang, text or "") if lang in ("rust", "py", *SCRIPT) else None
        for s in found[0] if found else ():
            yield tuple(s[k] for k in ("n", "t", "l", "el", "q", "tr", "local", "exp", "cx", "sig", "refs"))


class ParsedNodes:
    """``SELECT f.path, x.* FROM files f, LATERAL parsed_nodes(f.lang, f.text) x``: the node types of a text with their lines."""

    def eval(self, lang: str, text: str) -> Iterator[tuple]:
        yield from nodes(lang or "", text or "")


def register(spark: SparkSession) -> None:
    """Makes ``parsed_symbols`` and ``parsed_nodes`` known to SQL."""
    spark.udtf.register("parsed_symbols", udtf(ParsedSymbols, returnType="n string, t string, l int, el int, q string, tr string, local boolean, exp boolean, cx int, sig string, refs array<string>"))
    spark.udtf.register("parsed_nodes", udtf(ParsedNodes, returnType="node string, l int"))


def table_function(files: DataFrame, name: str) -> DataFrame:
    """files (path, lang, text) with what a table function gives for each, without the text."""
    register(files.sparkSession)
    return files.sparkSession.sql(f"SELECT f.path, f.lang, x.* FROM {{files}} f, LATERAL {name}(f.lang, f.text) x", files=files.select("path", "lang", "text"))
