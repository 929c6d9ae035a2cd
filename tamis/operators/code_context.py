"""Functions, imports and callers of source rows, joined to changed lines and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamis.functions import code
from tamis.functions.text import lines, strip
from tamis.operators.intervals import BIN, bins


def function_rows(files: DataFrame) -> DataFrame:
    """(file, walk, name, start_line, end_line, source) of every function of (file, source)."""
    return files.select("file", F.explode(code.functions_of(F.col("source"))).alias("f")).select("file", "f.*")


def _binned(functions: DataFrame) -> DataFrame:
    """Functions under each bin of lines that they reach, so that a file with many functions is many join keys."""
    return functions.select("*", bins(F.col("start_line"), F.col("end_line")).alias("_bin"))


def touched_functions(files: DataFrame, modified: DataFrame) -> DataFrame:
    """Functions, nested ones too, that hold a modified line (file, at)."""
    f, m = _binned(function_rows(files)), modified.select("file", "at", F.floor(F.col("at") / BIN).alias("_bin")).distinct()
    hit = (f["file"] == m["file"]) & (f["_bin"] == m["_bin"]) & m["at"].between(f["start_line"], f["end_line"])
    return f.join(m, hit, "left_semi").drop("_bin").dropDuplicates(["file", "walk"])


def enclosing_span(files: DataFrame, points: DataFrame, before: int = 3, after: int = 8) -> DataFrame:
    """(file, at, start_line, end_line, name): the smallest function around each point, else a window of lines clamped
    to the file, else (source that does not parse has no functions) the same window."""
    f, p = _binned(function_rows(files)), points.withColumn("_bin", F.floor(F.col("at") / BIN))
    j = p.join(f, (p["file"] == f["file"]) & (p["_bin"] == f["_bin"]) & p["at"].between(f["start_line"], f["end_line"]), "left").drop(f["file"], f["_bin"])
    best = j.groupBy("file", "at").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "walk", "start_line", "end_line", "name")).alias("b"))
    n = files.select("file", F.size(lines(F.col("source"))).alias("n"))
    out = best.join(n, "file")
    start = F.coalesce("b.start_line", F.greatest(F.lit(1), F.least(F.col("at") - before, F.col("n"))))
    end = F.coalesce("b.end_line", F.least(F.col("n"), F.col("at") + after))
    return out.select("file", "at", start.alias("start_line"), end.alias("end_line"), F.col("b.name").alias("name"))


def call_edges(files: DataFrame) -> DataFrame:
    """(name, calls): each function's called names that are functions of the files."""
    f = function_rows(files).select("name", F.explode(code.calls_of(F.col("source"))).alias("calls"))
    return f.join(function_rows(files).select(F.col("name").alias("calls")).distinct(), "calls", "left_semi").select("name", "calls").distinct()


def cross_file_context(files: DataFrame, modules: int = 3, most_lines: int = 200) -> DataFrame:
    """(file, module, text): the first lines of up to `modules` imported files that exist, in import order."""
    asked = files.select("file", F.posexplode(code.import_paths_of(F.col("source"))).alias("pos", "module")).filter("module <> file")
    known = files.select(F.col("file").alias("module"), F.array_join(F.slice(lines(F.col("source")), 1, most_lines), "\n").alias("text"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("pos"))
    return asked.join(known, "module").withColumn("_r", rank).filter(F.col("_r") <= modules).select("file", "module", "text")


def context_snippets(files: DataFrame, points: DataFrame) -> DataFrame:
    """(file, at, snippet): imports, the enclosing function, and the imported files, one blank line apart."""
    spans = enclosing_span(files, points).join(files, "file")
    other = cross_file_context(files).groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n\n").alias("other"))
    body = F.array_join(F.slice(lines(F.col("source")), F.col("start_line"), F.greatest(F.lit(0), F.col("end_line") - F.col("start_line") + 1)), "\n")
    parts = F.filter(F.array(code.imports_of(F.col("source")), body, F.coalesce("other", F.lit(""))), lambda x: x != "")
    return spans.join(other, "file", "left").select("file", "at", F.concat(strip(F.array_join(parts, "\n\n")), F.lit("\n")).alias("snippet"))


def hunk_offsets(spans: DataFrame) -> DataFrame:
    """Rows (start_line, end_line, header_lines, hunk_start, hunk_end) with the hunk's lines in the snippet; 0, 0 without a hunk."""
    lo, hi = F.greatest("hunk_start", "start_line"), F.least("hunk_end", "end_line")
    some = F.col("hunk_start").isNotNull() & F.col("hunk_end").isNotNull() & (lo <= hi)
    place = lambda x: x - F.col("start_line") + 1 + F.col("header_lines")
    return spans.withColumns({"text_start": F.when(some, place(lo)).otherwise(0), "text_end": F.when(some, place(hi)).otherwise(0)})
