"""Code rows at the size of the tables, which hold no code: each relation is one list of SQL expressions over a table,
in words that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamis.plans.samples import table

_PATH = "concat(CASE c_custkey % 5 WHEN 0 THEN 'tests/t' WHEN 1 THEN 'doc' ELSE 'pkg/m' END, c_custkey, CASE c_custkey % 4 WHEN 0 THEN '.md' ELSE '.py' END)"
_HUNK = "concat('@@ -', c_custkey % 50 + 1, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(',', c_custkey % 3 + 1) END, ' +', c_custkey % 60 + 1, ',', c_custkey % 4 + 2, ' @@', CASE c_custkey % 2 WHEN 0 THEN ' def f():' ELSE '' END, chr(10))"
_SOURCE = (
    "concat(CASE WHEN c_custkey % 4 = 0 THEN concat('from pkg.m', c_custkey + 1, ' import f', c_custkey + 1, chr(10)) ELSE '' END, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE concat(CASE WHEN c_custkey % 3 = 0 THEN 'async ' ELSE '' END, 'def f', c_custkey, '(x):', chr(10),"
    " '    return f', c_custkey + 1, '(x)', chr(10)) END, CASE WHEN c_custkey % 11 = 0 THEN concat('def broken(:', chr(10)) ELSE '' END)"
)
_BLANK = "CASE WHEN {0} THEN '  ' ELSE {1} END"

#: Relation -> (table, column -> expression).
RELATIONS: dict[str, tuple[str, dict[str, str]]] = {
    "sources": ("customer", {"file": "concat('pkg/m', c_custkey, '.py')", "source": _SOURCE}),
    "points": ("customer", {"file": "concat('pkg/m', c_custkey, '.py')", "at": "CAST(c_custkey % 5 + 1 AS INT)"}),
    "diffs": (
        "customer",
        {"id": "CAST(c_custkey AS INT)", "diff": f"concat('diff --git a/', {_PATH}, ' b/', {_PATH}, chr(10), '--- a/', {_PATH}, chr(10), '+++ b/', {_PATH}, chr(10), {_HUNK}, ' a', chr(10), '+b', c_custkey, chr(10), '-c', chr(10), ' d', chr(10), '+e')"},
    ),
    "spans": (
        "customer",
        {
            "id": "CAST(c_custkey AS INT)", "start_line": "CAST(c_custkey % 40 + 1 AS INT)", "end_line": "CAST(c_custkey % 40 + 1 + c_custkey % 13 AS INT)", "header_lines": "CAST(c_custkey % 4 AS INT)",
            "hunk_start": "CAST(CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 50 + 1 END AS INT)", "hunk_end": "CAST(CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey % 50 + 1 + c_custkey % 7 END AS INT)",
        },
    ),
    "paths": (
        "part",
        {"id": "p_partkey", "path": "concat(CASE p_partkey % 8 WHEN 0 THEN 'a/docs/' WHEN 1 THEN 'A/Tests/' WHEN 2 THEN 'pkg/news' ELSE 'pkg/core/' END, 'm', p_partkey, CASE p_partkey % 5 WHEN 0 THEN '.MD' WHEN 1 THEN '_version.py' WHEN 2 THEN '.json' ELSE '.py' END)"},
    ),
    "pairs": (
        "customer",
        {"id": "CAST(c_custkey AS INT)", "vuln": "concat('x = f(', c_custkey, ')', chr(10), 'y = 2', chr(10))", "fixed": "concat('x = ', CASE c_custkey % 3 WHEN 0 THEN 'f' ELSE 'g' END, '(', c_custkey, ')', chr(10), CASE c_custkey % 2 WHEN 0 THEN '# note' ELSE 'y = 2' END, chr(10))"},
    ),
    "manifest": (
        "orders",
        {
            "project": "concat('p', o_custkey % 50)", "git_url": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'u' END", "root_path": "CASE WHEN o_orderkey % 4 = 0 THEN 'r' ELSE NULL END", "sample_id": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('s', o_custkey) END",
            "file_path": "CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE concat('f', o_orderkey, '.py') END", "start_line": "CAST(o_orderkey % 30 AS INT)", "end_line": "CAST(o_custkey % 40 AS INT)", "label": "CAST(o_orderkey % 5 % 3 AS INT)",
        },
    ),
    "fixes": (
        "orders",
        {
            "id": "o_orderkey", "vulnerable_code": _BLANK.format("o_orderkey % 7 = 0", "concat(' x = f(', o_orderkey, ') ')"), "fixed_code": _BLANK.format("o_orderkey % 5 = 0", "CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE concat('x = g(', o_orderkey, ')') END"),
            "repo_url": _BLANK.format("o_orderkey % 11 = 0", "concat('https://host/org/app', o_custkey % 50, '.git/')"), "hash": _BLANK.format("o_orderkey % 2 = 0", "concat(' h', o_orderkey, ' ')"),
            "commit_id": "CASE WHEN o_custkey % 2 = 0 THEN concat('c', o_orderkey) ELSE NULL END", "commit_hash": "CASE WHEN o_custkey % 3 = 0 THEN concat('ch', o_orderkey) ELSE '' END", "commit_sha": "CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE concat('cs', o_orderkey) END",
            "cve_id": _BLANK.format("o_custkey % 4 = 0", "concat('CVE-', o_custkey)"), "cwe_id": "CASE o_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' CWE-95 ' ELSE '' END",
            "cvss3_base_score": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 10 END", "cvss2_base_score": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS DOUBLE) / 10 END",
            "language": "CASE o_orderkey % 6 WHEN 0 THEN 'Python' WHEN 1 THEN 'java' WHEN 2 THEN '' ELSE NULL END", "lang": "CASE o_orderkey % 4 WHEN 0 THEN ' py ' WHEN 1 THEN 'C' ELSE NULL END", "diff_with_context": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE concat(' @@ ', o_orderkey, ' ') END",
        },
    ),
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = RELATIONS[name]
    return table(spark, sf_dir, source).selectExpr(*(f"{e} AS `{c}`" for c, e in columns.items()))


def sql(name: str) -> str:
    source, columns = RELATIONS[name]
    return "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in columns.items()) + f" FROM {source}"
