"""Loops of Python source files with what tells a retry from an iteration, read from the syntax tree (fn.loop_info)."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .python_ast import _loop, _path

SCHEMA = "file string, line int, end_line int, kind string, bound bigint, handles_errors boolean, sleep_s double, exponential boolean, exits boolean, retryish boolean, policy_bound boolean, hot_error_path boolean, fixed boolean, wall_bound boolean, error string"
_COLUMNS = [p.split()[0] for p in SCHEMA.split(", ")]
_SLEEPS = re.compile(r"(sleep|delay|backoff)$", re.IGNORECASE)
_RETRY = re.compile(r"attempt|retr(y|ies)|tries|backoff", re.IGNORECASE)
_CLOCK = re.compile(r"^(deadline|timeout|elapsed\w*|max_wait|time_limit|expir\w*)$", re.IGNORECASE)
_CLOCKS = {"monotonic", "perf_counter", "time"}
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)


def _inside(nodes) -> Iterator[ast.AST]:
    """The nodes and all below them, but not what nested functions hold."""
    stack = list(nodes)
    while stack:
        node = stack.pop()
        if isinstance(node, _FUNCTIONS):
            continue
        yield node
        stack.extend(ast.iter_child_nodes(node))


def _names(nodes) -> Iterator[str]:
    for n in nodes:
        if isinstance(n, ast.Name):
            yield n.id
        elif isinstance(n, ast.Attribute):
            yield n.attr


def _number(node: ast.AST | None, constants: dict[str, float]) -> float | None:
    """A literal number, or a constant of the module by its last segment."""
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
        return node.value
    name = node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None
    return constants.get(name)


def _sleeps(nodes) -> list[ast.Call]:
    return [n for n in nodes if isinstance(n, ast.Call) and _SLEEPS.search(_path(n.func).split(".")[-1])]


def _doubles(n: ast.AST) -> bool:
    if isinstance(n, ast.AugAssign):
        return isinstance(n.op, (ast.Pow, ast.LShift)) or (isinstance(n.op, ast.Mult) and isinstance(n.value, ast.Constant) and n.value.value == 2)
    if isinstance(n, ast.BinOp):
        return isinstance(n.op, (ast.Pow, ast.LShift)) or (isinstance(n.op, ast.Mult) and any(isinstance(x, ast.Constant) and x.value == 2 for x in (n.left, n.right)))
    return isinstance(n, ast.Call) and _path(n.func).split(".")[-1] == "pow"


def _count(loop: ast.stmt, constants: dict[str, float]) -> tuple[str, int | None]:
    """fn.count with the module's constants: `range` and `while i < n` have a bound where n is known."""
    kind, bound = _loop(loop)
    if kind == "counted" and bound is None:
        values = [_number(a, constants) for a in loop.iter.args[:2]]
        if values and None not in values:
            bound = max(0, int(values[-1] - (values[0] if len(values) > 1 else 0)))
    elif kind == "conditional" and isinstance(loop.test, ast.Compare) and isinstance(loop.test.ops[0], (ast.Lt, ast.LtE)):
        limit = _number(loop.test.comparators[0], constants)
        bound = None if limit is None else int(limit) + isinstance(loop.test.ops[0], ast.LtE)
    return kind, bound


def loops(source: str) -> Iterator[dict]:
    """A row per for and while loop of a module; comprehensions are none."""
    tree = ast.parse(source)
    constants = {t.id: n.value.value for n in tree.body if isinstance(n, ast.Assign) for t in n.targets if isinstance(t, ast.Name) and t.id.isupper() and _number(n.value, {}) is not None}
    for loop in ast.walk(tree):
        if not isinstance(loop, (ast.For, ast.AsyncFor, ast.While)):
            continue
        head = list(_inside([loop.test] if isinstance(loop, ast.While) else [loop.target, loop.iter]))
        body = list(_inside(loop.body))
        kind, bound = _count(loop, constants)
        sleeps = _sleeps(body)
        handlers = [h for n in body if isinstance(n, (ast.Try, ast.TryStar)) for h in n.handlers]
        compared = [list(_inside([n])) for n in [*head, *body] if isinstance(n, ast.Compare)]
        hot = any(any(isinstance(n, ast.Continue) for n in of) and not _sleeps(of) for of in (list(_inside(h.body)) for h in handlers))
        clock = any(any(map(_CLOCK.search, _names(c))) or any(isinstance(n, ast.Call) and _path(n.func).split(".")[-1] in _CLOCKS for n in c) for c in compared)
        over = None if isinstance(loop, ast.While) else loop.iter
        yield {
            "line": loop.lineno,
            "end_line": loop.end_lineno,
            "kind": kind,
            "bound": bound,
            "handles_errors": bool(handlers),
            "sleep_s": max((float(_number(c.args[0] if c.args else None, constants) or 0) for c in sleeps), default=None),
            "exponential": bool(sleeps) and any(map(_doubles, body)),
            "exits": any(isinstance(n, (ast.Break, ast.Return)) for n in body),
            "retryish": any(map(_RETRY.search, _names([*head, *body]))),
            "policy_bound": any(any(map(_RETRY.search, _names(_inside([n])))) for n in body if isinstance(n, ast.Compare)),
            "hot_error_path": bool(sleeps) and hot,
            "fixed": (kind == "counted" and bound is not None) or (kind == "collection" and (isinstance(over, (ast.Tuple, ast.List, ast.Set)) or (isinstance(over, ast.Name) and over.id.isupper()))),
            "wall_bound": clock,
        }


def loop_info(files: DataFrame) -> DataFrame:
    """fn.loop_info: the loops of (path, content) files; a file that cannot be parsed gives one row with its error.

    `sleep_s` is null without a sleep and 0 where its length is not known; `hot_error_path` is a handler that goes on past the loop's sleep.
    """

    def run(batches):
        import pandas as pd

        for df in batches:
            rows = []
            for path, body in zip(df["path"], df["content"]):
                try:
                    rows += [r | {"file": path} for r in loops(bytes(body).decode("utf-8", "replace"))]
                except (SyntaxError, ValueError, RecursionError) as e:
                    rows.append({"file": path, "error": f"{type(e).__name__}: {e}"})
            out = pd.DataFrame(rows, columns=_COLUMNS)
            whole = ("line", "end_line", "bound")
            yield pd.DataFrame({c: out[c].astype("Int64") if c in whole else out[c].astype("float64") if c == "sleep_s" else out[c].astype(object) for c in _COLUMNS})

    return files.select("path", "content").mapInPandas(run, SCHEMA)
