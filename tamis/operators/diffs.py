"""Unified diffs as windows over their lines: current file, then current hunk, then a running line count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions.text import lines

HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"


def _number(line: Column, group: int, default: int) -> Column:
    text = F.regexp_extract(line, HUNK, group)
    return F.when(text == "", F.lit(default)).otherwise(text.cast("int"))


def _rows(diffs: DataFrame, id_col: str, diff_col: str, header: str) -> DataFrame:
    rows = diffs.select(F.col(id_col), F.posexplode(lines(F.col(diff_col))).alias("pos", "line"))
    upto = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    path = F.regexp_extract("line", header, 1)
    return rows.withColumn("path", F.last(F.when(path != "", F.translate(path, "\\", "/")), ignorenulls=True).over(upto)).withColumn("is_hunk", F.col("line").rlike(HUNK))


def anchors(diffs: DataFrame, id_col: str = "id", diff_col: str = "diff") -> DataFrame:
    """Per file of each diff, the first hunk whose header names a function, else the first: ranges before and after."""
    hunks = _rows(diffs, id_col, diff_col, r"^diff --git a/.+ b/(.+)$").filter("is_hunk AND path IS NOT NULL").withColumn("has_def", F.regexp_extract("line", HUNK, 5).contains("def "))
    first = Window.partitionBy(id_col, "path").orderBy(F.col("has_def").desc(), "pos")
    end = lambda start, n: F.col(start) + F.greatest(F.lit(1), n) - 1
    out = hunks.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").withColumns({"pre_start": _number(F.col("line"), 1, 0), "post_start": _number(F.col("line"), 3, 0)})
    return out.select(id_col, "path", "pre_start", end("pre_start", _number(F.col("line"), 2, 1)).alias("pre_end"), "post_start", end("post_start", _number(F.col("line"), 4, 1)).alias("post_end"), "has_def")


def modified_lines(diffs: DataFrame, id_col: str = "id", diff_col: str = "diff", excluded: tuple[str, ...] = ("tests/",)) -> DataFrame:
    """(id, path, at): added lines by their number after the change, of Python files outside the excluded folders."""
    rows = _rows(diffs, id_col, diff_col, r"^\+\+\+ [ab]/(.+)$").filter("path IS NOT NULL")
    upto = Window.partitionBy(id_col, "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("hunk", F.sum(F.col("is_hunk").cast("int")).over(upto)).filter("hunk > 0")
    within = Window.partitionBy(id_col, "path", "hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.first(F.when(F.col("is_hunk"), _number(F.col("line"), 3, 0)), ignorenulls=True).over(within)
    after = ~F.col("is_hunk") & ~F.startswith("line", F.lit("-")) & ~F.startswith("line", F.lit("\\"))
    rows = rows.withColumn("at", start + F.sum(after.cast("int")).over(within) - 1)
    kept = F.col("path").endswith(".py")
    for prefix in excluded:
        kept &= ~F.startswith("path", F.lit(prefix))
    return rows.filter(kept & after & F.startswith("line", F.lit("+")) & ~F.startswith("line", F.lit("+++"))).select(id_col, "path", F.col("at").cast("int").alias("at"))
