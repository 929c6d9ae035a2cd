"""Scalars over code that need Python's own parser or sequence matcher, as Arrow-batched functions."""

from __future__ import annotations

import ast
import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tamis.functions.text import AUGMENTED, CALL, COMPARED, NOT_SIGNAL, SIGNAL_STARTS

_SIGNAL = (re.compile(CALL), re.compile(AUGMENTED), re.compile(COMPARED))
_NOT_SIGNAL = re.compile(NOT_SIGNAL)


def is_code(line: str) -> bool:
    """The Python twin of text.has_signal."""
    s = line.strip()
    if not s or _NOT_SIGNAL.match(s):
        return False
    return s.startswith(SIGNAL_STARTS) or any(p.search(s) for p in _SIGNAL) or ("=" in s and not s.startswith("="))


def _line_edits(a: str | None, b: str | None) -> tuple[list[str], int, int]:
    """Lines that only one side has, in an alignment of the right-stripped lines, and both lengths."""
    x, y = ([line.rstrip() for line in (t or "").splitlines()] for t in (a, b))
    edits: list[str] = []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, x, y).get_opcodes():
        if kind != "equal":
            edits += x[i:j] + y[k:m]
    return edits, len(x), len(y)


def line_change(a: str | None, b: str | None) -> tuple[float, bool]:
    """Share of lines that change (1.0 if a side is empty), and whether the change is trivial: none of its lines is code."""
    edits, n, m = _line_edits(a, b)
    same = bool(a) and bool(b) and [x.strip() for x in a.splitlines() if x.strip()] == [x.strip() for x in b.splitlines() if x.strip()]
    ratio = len(edits) / (n + m) if n and m else 1.0
    return ratio, same or not any(map(is_code, edits))


def change(a: Column, b: Column) -> Column:
    """struct<ratio double, trivial boolean>."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in batches:
            yield pd.DataFrame([line_change(p, q) for p, q in zip(x, y, strict=True)], columns=["ratio", "trivial"])

    return F.pandas_udf(run, "ratio double, trivial boolean")(a, b)


def token_ratio(candidate: list[str], reference: list[str], floor: float) -> float:
    """Matching-block ratio, 0.0 where the bounds by length or by shared tokens do not pass `floor`."""
    n, m = len(candidate), len(reference)
    if not n or not m or 2 * min(n, m) / (n + m) <= floor or 2 * (Counter(candidate) & Counter(reference)).total() / (n + m) <= floor:
        return 0.0
    return difflib.SequenceMatcher(None, candidate, reference).ratio()


def token_similarity(candidate: Column, reference: Column, floor: float = 0.0) -> Column:
    """Over token arrays."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([token_ratio(list(p), list(q), floor) for p, q in zip(x, y, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")(candidate, reference)


def _parsed(source: str | None) -> ast.Module | None:
    try:
        return ast.parse(source or "")
    except (SyntaxError, ValueError):
        return None


def functions_in(source: str | None) -> list[dict]:
    """Functions in breadth-first order; none where the source does not parse."""
    tree, rows = _parsed(source), (source or "").splitlines()
    nodes = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)] if tree else []
    return [{"walk": k, "name": n.name, "start_line": n.lineno, "end_line": n.end_lineno, "source": "\n".join(rows[n.lineno - 1 : n.end_lineno])} for k, n in enumerate(nodes)]


def called_names(source: str | None) -> list[str]:
    tree = _parsed(source)
    names = {n.func.id if isinstance(n.func, ast.Name) else n.func.attr for n in ast.walk(tree) if isinstance(n, ast.Call) and isinstance(n.func, ast.Name | ast.Attribute)} if tree else set()
    return sorted(names)


def import_lines(source: str | None) -> str:
    """Top-level import statements, joined by line feeds."""
    tree = _parsed(source)
    return "\n".join(ast.get_source_segment(source, n) or "" for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)) if tree else ""


def imported_paths(source: str | None) -> list[str]:
    """Files that the `from` imports may name, in order, once each."""
    tree = _parsed(source)
    found = [n.module.replace(".", "/") + ".py" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module] if tree else []
    return list(dict.fromkeys(found))


def _scalar(fn, kind: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([fn(x) for x in batch], dtype=object)

    return F.pandas_udf(run, kind)


def functions_of(source: Column) -> Column:
    return _scalar(functions_in, "array<struct<walk:int,name:string,start_line:int,end_line:int,source:string>>")(source)


def calls_of(source: Column) -> Column:
    return _scalar(called_names, "array<string>")(source)


def imports_of(source: Column) -> Column:
    return _scalar(import_lines, "string")(source)


def import_paths_of(source: Column) -> Column:
    return _scalar(imported_paths, "array<string>")(source)
