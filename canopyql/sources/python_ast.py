"""Declarations of Python texts, by the standard library's parser."""

from __future__ import annotations

import ast

_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.match_case, ast.comprehension)


def _names(node: ast.AST) -> set[str]:
    return {x.id for x in ast.walk(node) if isinstance(x, ast.Name)} | {x.attr for x in ast.walk(node) if isinstance(x, ast.Attribute)}


def _annotations(node: ast.AST) -> set[str]:
    found: set[str] = set()
    for x in ast.walk(node):
        for part in (getattr(x, "annotation", None), getattr(x, "returns", None)):
            if isinstance(part, ast.AST):
                found |= _names(part)
    return found


def _bound(node: ast.AST) -> set[str]:
    args = {a.arg for x in ast.walk(node) if isinstance(x, ast.arguments) for a in [*x.posonlyargs, *x.args, *x.kwonlyargs, x.vararg, x.kwarg] if a}
    return args | {x.id for x in ast.walk(node) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}


def _complexity(node: ast.AST) -> int:
    return 1 + sum(isinstance(x, _BRANCHES) + (len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0) for x in ast.walk(node))


def read(text: str) -> tuple[list[dict], list[tuple[str, str]], list[tuple[str, str]]]:
    """(symbols, imports (name, local), nothing handed on) of one text; SyntaxError where it does not parse."""
    module, lines = ast.parse(text), text.split("\n")
    imports = []
    for x in ast.walk(module):
        if isinstance(x, (ast.Import, ast.ImportFrom)):
            imports += [(a.name.split(".")[-1], (a.asname or a.name).split(".")[0]) for a in x.names if a.name != "*"]
    out: list[dict] = []

    def add(node: ast.AST, name: str, kind: str, chain: list[str], local: bool, refs: set[str], trefs: set[str]) -> None:
        row = {"n": name, "t": kind, "l": node.lineno, "el": node.end_lineno, "sig": lines[node.lineno - 1].strip()[:200], "cx": _complexity(node), "local": local}
        row |= {"q": "::".join([*chain, name]) if chain else None, "tr": None, "exp": not name.startswith("_")}
        out.append(row | {"refs": sorted(r for r in refs if len(r) >= 3), "trefs": sorted(t for t in trefs if len(t) >= 2), "qrefs": []})

    def visit(node: ast.AST, chain: list[str], in_function: bool) -> None:
        for x in getattr(node, "body", []):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if chain and isinstance(node, ast.ClassDef) else "fn"
                bound, types = (_bound(x) if kind != "class" else set()), _annotations(x)
                if len(x.name) > 1:
                    add(x, x.name, kind, chain, False, _names(x) - bound - types - {x.name}, types - {x.name})
                visit(x, [*chain, x.name], in_function or kind != "class")
            elif isinstance(x, (ast.Assign, ast.AnnAssign)):
                for target in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    if isinstance(target, ast.Name) and len(target.id) > 1 and not in_function:
                        types = _annotations(x)
                        add(x, target.id, "field" if isinstance(node, ast.ClassDef) else "var", chain, False, _names(x) - types - {target.id}, types)
            elif isinstance(x, (ast.If, ast.Try, ast.With)):
                visit(x, chain, in_function)

    visit(module, [], False)
    return sorted(out, key=lambda r: (r["l"], r["n"])), list(dict.fromkeys(imports)), []
