"""Code queries over generated sources and diffs: the tables hold no code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import text as T
from tamis.functions.code import calls_of, imports_of
from tamis.operators import code_context, diffs
from tamis.plans import dialect as D
from tamis.plans import generated

def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.frame(spark, sf_dir, "sources")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.frame(spark, sf_dir, "points")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.frame(spark, sf_dir, "diffs")


def functions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_context.function_rows(_files(spark, sf_dir)).select("file", "walk", "name", "start_line", "end_line")


def touched_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_context.touched_functions(_files(spark, sf_dir), _points(spark, sf_dir)).select("file", "name")


def enclosing_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_context.enclosing_span(_files(spark, sf_dir), _points(spark, sf_dir))


def imports_and_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file", imports_of(F.col("source")).alias("imports"), F.array_join(calls_of(F.col("source")), ",").alias("calls"))


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_context.call_edges(_files(spark, sf_dir))


def cross_file_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_context.cross_file_context(_files(spark, sf_dir))


def context_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_context.context_snippets(_files(spark, sf_dir), _points(spark, sf_dir))


def first_def_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("file", T.first_def_name(F.col("source")).alias("name"))


def diff_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.anchors(_diffs(spark, sf_dir))


def modified_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.modified_lines(_diffs(spark, sf_dir))


def hunk_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = generated.frame(spark, sf_dir, "spans")
    return code_context.hunk_offsets(rows).select("id", "text_start", "text_end")


QUERIES = {f.__name__: f for f in (functions_of, touched_functions, enclosing_function, imports_and_calls, call_edges, cross_file_context, context_snippets, first_def_name, diff_anchors, modified_lines, hunk_offsets)}

_HEAD = f"list_filter(list_transform({D.lines('source')}, lambda x: {D.strip('x')}), lambda x: starts_with(x, 'def ') OR starts_with(x, 'async def '))[1]"
_DIFF_LINES = f"l AS (SELECT id, unnest({D.lines('diff')}) AS line, generate_subscripts({D.lines('diff')}, 1) AS pos FROM d)"
_HUNK = r"'^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$'"

ORACLES = {
    "first_def_name": rf"WITH f AS ({generated.sql('sources')}) SELECT file, coalesce(nullif(regexp_extract({_HEAD}, '^(?:async )?def\s+([^\s(]*)', 1), ''), 'unknown_function') AS name FROM f",
    "hunk_offsets": f"""WITH s(id, a, b, h, x, y) AS ({generated.sql('spans')}) SELECT id, CASE WHEN greatest(x, a) <= least(y, b) AND x IS NOT NULL THEN greatest(x, a) - a + 1 + h ELSE 0 END AS text_start,
CASE WHEN greatest(x, a) <= least(y, b) AND x IS NOT NULL THEN least(y, b) - a + 1 + h ELSE 0 END AS text_end FROM s""",
    "diff_anchors": rf"""WITH d AS ({generated.sql('diffs')}), {_DIFF_LINES},
p AS (SELECT *, last_value(nullif(regexp_extract(line, '^diff --git a/.+ b/(.+)$', 1), '') IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos) AS path FROM l),
h AS (SELECT *, contains(regexp_extract(line, {_HUNK}, 5), 'def ') AS has_def, regexp_extract(line, {_HUNK}, 1)::INT AS a, coalesce(nullif(regexp_extract(line, {_HUNK}, 2), ''), '1')::INT AS an,
  regexp_extract(line, {_HUNK}, 3)::INT AS b, coalesce(nullif(regexp_extract(line, {_HUNK}, 4), ''), '1')::INT AS bn FROM p WHERE path IS NOT NULL AND regexp_matches(line, {_HUNK}))
SELECT id, path, a AS pre_start, a + greatest(1, an) - 1 AS pre_end, b AS post_start, b + greatest(1, bn) - 1 AS post_end, has_def FROM h QUALIFY row_number() OVER (PARTITION BY id, path ORDER BY has_def DESC, pos) = 1""",
    "modified_lines": rf"""WITH d AS ({generated.sql('diffs')}), {_DIFF_LINES},
p AS (SELECT *, last_value(nullif(regexp_extract(line, '^\+\+\+ [ab]/(.+)$', 1), '') IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos) AS path, regexp_matches(line, {_HUNK}) AS ish FROM l),
h AS (SELECT *, sum(CASE WHEN ish THEN 1 ELSE 0 END) OVER (PARTITION BY id, path ORDER BY pos) AS hunk FROM p WHERE path IS NOT NULL),
a AS (SELECT *, NOT ish AND NOT starts_with(line, '-') AND NOT starts_with(line, '\') AS aft FROM h WHERE hunk > 0),
n AS (SELECT *, CAST(first_value(regexp_extract(line, {_HUNK}, 3)) OVER w AS INTEGER) + sum(CASE WHEN aft THEN 1 ELSE 0 END) OVER w - 1 AS num FROM a WINDOW w AS (PARTITION BY id, path, hunk ORDER BY pos))
SELECT id, path, CAST(num AS INTEGER) AS "at" FROM n WHERE ends_with(path, '.py') AND NOT starts_with(path, 'tests/') AND aft AND starts_with(line, '+') AND NOT starts_with(line, '+++')""",
}
