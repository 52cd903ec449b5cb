"""Complexity of code: from Python's syntax tree where it parses, from keywords and depth where not. Nothing is run."""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.lexicons import BRANCHES, LOOPS

_DECISIONS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.BoolOp, ast.IfExp)
_LOOPS = (ast.For, ast.AsyncFor, ast.While)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parsed_complexity(code: str, recursion_weight: int = 2) -> tuple[int, int]:
    """(decisions + 1, depths of all loops + calls of the own function times the weight) of Python code."""
    decisions = depths = calls = 0
    todo = [(ast.parse(code), 0, None)]  # node, loops around it, innermost function
    while todo:
        node, depth, function = todo.pop()
        decisions += isinstance(node, _DECISIONS) or isinstance(node, ast.comprehension) and bool(node.ifs)
        if isinstance(node, _LOOPS):
            depth += 1
            depths += depth
        elif isinstance(node, _FUNCTIONS):
            function = node.name
        elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id == function:
            calls += 1
        todo += [(child, depth, function) for child in ast.iter_child_nodes(node)]
    return 1 + decisions, depths + calls * recursion_weight


def lexical_complexity(code: str, branches: list[str] = BRANCHES, loops: list[str] = LOOPS, indent: int = 4) -> tuple[int, int]:
    """(keywords + 1, depths at loop keywords): depth by braces before those opened on the line, or by indents."""
    decisions = sum(len(re.findall(rf"(?<!\w){re.escape(k)}(?!\w)", code, re.IGNORECASE)) for k in branches)
    looping = [re.compile(rf"\b{re.escape(k)}\b", re.IGNORECASE) for k in loops]
    braces, level, depths = "{" in code or "}" in code, 0, 0
    for line in code.splitlines():
        if braces:
            for c in re.findall("[{}]", line):
                level = level + 1 if c == "{" else max(0, level - 1)
            depth = max(0, level - line.count("{"))
        else:
            wide = line.expandtabs(indent)
            depth = (len(wide) - len(wide.lstrip(" "))) // indent
        depths += depth * sum(bool(p.search(line)) for p in looping)
    return 1 + decisions, depths


def complexity(code: str, recursion_weight: int = 2, branches: list[str] = BRANCHES, loops: list[str] = LOOPS, indent: int = 4) -> tuple[int, int, bool]:
    """(decisions, nesting, whether the syntax tree was read). Code that Python cannot parse for any reason, or
    that is nested too deeply for it, is counted by keywords."""
    try:
        return *parsed_complexity(code, recursion_weight), True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return *lexical_complexity(code, branches, loops, indent), False


def complexity_column(code: Column, recursion_weight: int = 2, branches: list[str] = BRANCHES, loops: list[str] = LOOPS, indent: int = 4) -> Column:
    """Struct (decisions, nesting, exact) of a code string; null for null."""

    @F.pandas_udf("decisions int, nesting int, exact boolean")
    def run(codes):
        import warnings

        import pandas as pd

        warnings.simplefilter("ignore", SyntaxWarning)
        rows = [(None, None, None) if c is None else complexity(c, recursion_weight, branches, loops, indent) for c in codes]
        return pd.DataFrame(rows, columns=["decisions", "nesting", "exact"]).astype({"decisions": "Int32", "nesting": "Int32", "exact": "boolean"})

    return run(code)
