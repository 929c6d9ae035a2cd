"""Text and code scalars as Column expressions, in step with Python's string rules."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line ends and white space as Python knows them, token and signal patterns, noise lists.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\s\w]"
NOISE_PARTS = (
    "/docs/", "/doc/", "/documentation/", "/tests/", "/test/", "/spec/", "/specs/", "/examples/", "/example/", "/migrations/", "conftest.py", "setup.py", "setup.cfg", "pyproject.toml", "poetry.lock",
    "package_data", "_version", "versioneer", "pkg_resources", "conf.py", "changelog", "changes", "history", "news", "readme", "authors", "license", "requirements", "tox.ini", "noxfile",
)
NOISE_SUFFIXES = (".md", ".rst", ".txt", ".cfg", ".ini", ".toml", ".json", ".yaml", ".yml", ".lock", ".csv", ".html", ".svg", ".png", ".pdf")
SIGNAL_STARTS = (
    "def ", "class ", "if ", "elif ", "else", "for ", "while ", "try", "except", "finally", "with ", "return", "yield", "await", "raise", "assert", "import ", "from ", "del ", "global ", "nonlocal ",
    "lambda", "pass", "break", "continue", "async ",
)
NOT_SIGNAL = r"""^(#|"|'|(__version__|version|release|build|tag)\s*=)"""
CALL = r"[A-Za-z_]\w*\s*\("
AUGMENTED = r"\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|>>=|:="
COMPARED = r"==|!=|<=|>=|<<|>>|\b(and|or|in|not|is)\b"
# End of fixed values.


_NO_CODE, _KEYWORD = rf"(?U){NOT_SIGNAL}", rf"^(?:{'|'.join(map(re.escape, SIGNAL_STARTS))})"
_WORD_OR_SHIFT = r"(?U)<<|>>|\b(?:and|or|in|not|is)\b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once: lambdas share no common subexpressions with what is around them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text, without an empty last one; null counts as empty."""
    drop_last = lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x)
    return let(F.split(F.coalesce(text, F.lit("")), LINE_END, -1), drop_last)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def normalise(text: Column) -> Column:
    """Stripped lines without the blank ones, joined by line feeds."""
    return F.array_join(F.filter(F.transform(lines(text), lambda x: strip(x)), lambda x: x != ""), "\n")


def equivalent(a: Column, b: Column) -> Column:
    """Neither side empty, and the same once normalised."""
    return (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "") & (normalise(a) == normalise(b))


def tokens(text: Column) -> Column:
    """Identifiers, numbers and single marks of the lines that are neither blank nor comments."""
    code = F.filter(F.transform(lines(text), lambda x: strip(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("#")))
    return F.flatten(F.transform(code, lambda x: F.regexp_extract_all(x, F.lit("(?U)" + TOKEN), F.lit(0))))


def has_signal(line: Column) -> Column:
    """Whether a line is code: not blank, comment, quoted or a version line, and it has a keyword, call or operator."""


    def code(s: Column) -> Column:  # an equals sign not in front is an assignment or an operator, so most patterns need no run
        equals = F.when(s.contains("="), ~F.startswith(s, F.lit("=")) | s.rlike(AUGMENTED) | s.rlike("(?U)" + COMPARED))
        found = equals.otherwise(s.rlike(_WORD_OR_SHIFT)) | s.rlike(_KEYWORD) | (s.contains("(") & s.rlike("(?U)" + CALL))
        return (s != "") & found & ~s.rlike(_NO_CODE)

    return let(strip(line), code)


def signal_lines(text: Column) -> Column:
    return F.size(F.filter(lines(text), lambda x: has_signal(x)))


def is_noise_path(path: Column) -> Column:
    """Paths of documentation, tests, packaging and data."""
    p = F.lower(F.coalesce(path, F.lit("")))
    out = F.lit(False)
    for suffix in NOISE_SUFFIXES:
        out |= p.endswith(suffix)
    for part in NOISE_PARTS:
        out |= p.contains(part)
    return out


def first_def_name(text: Column) -> Column:
    """The name in the first line that starts a function, else unknown_function."""
    heads = F.filter(F.transform(lines(text), lambda x: strip(x)), lambda x: F.startswith(x, F.lit("def ")) | F.startswith(x, F.lit("async def ")))
    name = F.regexp_extract(F.get(heads, F.lit(0)), r"^(?:async )?def\s+([^\s(]*)", 1)
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown_function").otherwise(name)


def chunks(text: Column, size: int = 64, overlap: int = 8, least_signal: int = 2) -> Column:
    """array<struct<chunk_index,start_line,end_line,text>>, lines from 1: the whole text if it fits, else windows with enough signal."""
    stride = max(1, size - overlap)

    def cut(every: Column, signal: Column) -> Column:
        n = F.size(every)
        last = F.ceil(F.greatest(F.lit(0), n - size) / stride).cast("int") * stride
        starts = F.filter(F.sequence(F.lit(0), last, F.lit(stride)), lambda s: F.size(F.filter(F.slice(signal, s + 1, size), lambda x: x)) >= least_signal)
        chosen = F.when(n == 0, F.slice(starts, 1, 0)).when(n <= size, F.array(F.lit(0))).otherwise(starts)
        piece = lambda s: F.array_join(F.slice(every, s + 1, size), "\n")
        return F.transform(chosen, lambda s, i: F.struct(i.alias("chunk_index"), (s + 1).alias("start_line"), F.least(s + size, n).alias("end_line"), piece(s).alias("text")))

    return let(lines(text), lambda every: let(F.transform(every, has_signal), lambda signal: cut(every, signal)))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end, from 1."""
    return F.array_join(F.slice(lines(text), start, F.greatest(F.lit(0), end - start + 1)), "\n")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity over the shorter length; 0 where a norm is 0."""
    d = lambda x: x.cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.filter(F.zip_with(a, b, lambda x, y: d(x) * d(y)), lambda v: v.isNotNull()))
    norm = lambda x: F.sqrt(total(F.transform(x, lambda v: d(v) * d(v))))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))
