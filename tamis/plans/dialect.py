"""The text scalars once more, as DuckDB SQL for the oracles."""

from __future__ import annotations

from tamis.functions.text import NOISE_PARTS, NOISE_SUFFIXES, SIGNAL_STARTS

_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def lines(text: str) -> str:
    parts = f"string_split_regex(coalesce({text}, ''), '{_END}')"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)"


def strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A[\s\x0b\p{{Z}}]+|[\s\x0b\p{{Z}}]+\z', '', 'g')"


def normalise(text: str) -> str:
    return f"array_to_string(list_filter(list_transform({lines(text)}, lambda x: {strip('x')}), lambda x: x <> ''), chr(10))"


def tokens(text: str) -> str:
    code = f"list_filter(list_transform({lines(text)}, lambda x: {strip('x')}), lambda x: x <> '' AND NOT starts_with(x, '#'))"
    return rf"flatten(list_transform({code}, lambda x: regexp_extract_all(x, '[A-Za-z_][A-Za-z0-9_]*|\p{{Nd}}+|[^\s\p{{L}}\p{{N}}_\p{{M}}]')))"


def has_signal(line: str) -> str:
    s = strip(line)
    starts = " OR ".join(f"starts_with({s}, '{k}')" for k in SIGNAL_STARTS)
    word = r"[\p{L}\p{N}_\p{M}]"
    return rf"""({s} <> '' AND NOT regexp_matches({s}, '^(#|"|''|(__version__|version|release|build|tag)\s*=)') AND ({starts}
  OR regexp_matches({s}, '[A-Za-z_]{word}*\s*\(') OR regexp_matches({s}, '\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|>>=|:=')
  OR regexp_matches({s}, '==|!=|<=|>=|<<|>>|(^|[^\p{{L}}\p{{N}}_\p{{M}}])(and|or|in|not|is)([^\p{{L}}\p{{N}}_\p{{M}}]|$)') OR (contains({s}, '=') AND NOT starts_with({s}, '='))))"""


def signal_lines(text: str) -> str:
    return f"len(list_filter({lines(text)}, lambda l: {has_signal('l')}))"


def noise_path(path: str) -> str:
    p = f"lower(coalesce({path}, ''))"
    return "(" + " OR ".join([*(f"ends_with({p}, '{x}')" for x in NOISE_SUFFIXES), *(f"contains({p}, '{x}')" for x in NOISE_PARTS)]) + ")"


def values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
