"""Python source files as functions, calls and loops, by the standard library's parser (src.parse).

Other languages need grammars that are not at hand; their files go through the line rules only.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

from pyspark.sql import DataFrame

SCHEMA = "kind string, id string, file string, qualname string, name string, line int, end_line int, is_async boolean, path string, awaited boolean, loop_depth int, loop_kind string, bound bigint, error string"
_COLUMNS = [p.split()[0] for p in SCHEMA.split(", ")]


def _path(node: ast.expr) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    parts.append(node.id if isinstance(node, ast.Name) else "()")
    return ".".join(reversed(parts))


def _loop(node: ast.stmt) -> tuple[str, int | None]:
    if isinstance(node, ast.While):
        return ("forever" if isinstance(node.test, ast.Constant) and node.test.value else "conditional"), None
    it = node.iter
    if isinstance(it, ast.Call) and isinstance(it.func, ast.Name) and it.func.id == "range":
        values = [a.value for a in it.args if isinstance(a, ast.Constant) and isinstance(a.value, int)]
        if len(values) == len(it.args) and values:
            lo, hi = (0, values[0]) if len(values) == 1 else values[:2]
            return "counted", max(0, hi - lo)
        return "counted", None
    return "collection", None


def extract(file: str, source: str) -> Iterator[dict]:
    """Rows of the functions, calls and loops of one file. A call in a loop's own iterable is not inside the loop."""

    def walk(node, owner, depth, awaited, scope):
        for child in ast.iter_child_nodes(node):
            yield from visit(child, owner, depth, awaited, scope)

    def visit(node, owner, depth, awaited, scope):
        if isinstance(node, ast.ClassDef):
            yield from walk(node, owner, depth, False, [*scope, node.name])
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            me = f"{file}:{node.lineno}:{node.col_offset}"
            yield {"kind": "function", "id": me, "qualname": ".".join([*scope, node.name]), "name": node.name, "line": node.lineno, "end_line": node.end_lineno, "is_async": isinstance(node, ast.AsyncFunctionDef)}
            for part in node.body:
                yield from visit(part, me, 0, False, [*scope, node.name])
        elif isinstance(node, (ast.For, ast.AsyncFor, ast.While)):
            kind, bound = _loop(node)
            yield {"kind": "loop", "id": owner, "line": node.lineno, "end_line": node.end_lineno, "loop_depth": depth + 1, "loop_kind": kind, "bound": bound}
            if not isinstance(node, ast.While):
                yield from visit(node.iter, owner, depth, False, scope)
            else:
                yield from visit(node.test, owner, depth + 1, False, scope)
            for part in [*node.body, *node.orelse]:
                yield from visit(part, owner, depth + 1, False, scope)
        elif isinstance(node, ast.Await):
            yield from visit(node.value, owner, depth, True, scope)
        elif isinstance(node, ast.Call):
            path = _path(node.func)
            yield {"kind": "call", "id": owner, "name": path.split(".")[-1], "path": path, "line": node.lineno, "awaited": awaited, "loop_depth": depth}
            combinator = awaited and path.split(".")[-1] in ("gather", "wait", "wait_for", "shield", "timeout")
            for part in ast.iter_child_nodes(node):
                yield from visit(part, owner, depth, combinator, scope)
        else:
            yield from walk(node, owner, depth, False, scope)

    for row in walk(ast.parse(source), None, 0, False, []):
        yield row | {"file": file}


def parse(files: DataFrame) -> DataFrame:
    """Tagged rows of (path, content) files; a file that cannot be parsed gives one row of kind error."""

    def run(batches):
        import pandas as pd

        for df in batches:
            rows = []
            for path, body in zip(df["path"], df["content"]):
                try:
                    rows += list(extract(path, bytes(body).decode("utf-8", "replace")))
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({"kind": "error", "file": path, "error": f"{type(e).__name__}: {e}"})
            out = pd.DataFrame(rows, columns=_COLUMNS)
            whole = ("line", "end_line", "loop_depth", "bound")
            yield pd.DataFrame({c: out[c].astype("Int64") if c in whole else out[c].astype(object) for c in _COLUMNS})

    return files.select("path", "content").mapInPandas(run, SCHEMA)
