"""Train, validation and test splits that leak nothing, and caps. Shuffles are orders by MD5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def block_sizes(n: int, val: float, test: float) -> tuple[int, int]:
    """How many of n >= 3 keys go to test and to validation, at least one each and one left for train."""
    n_test = min(max(1, round(n * test)), n - 2)
    return n_test, min(max(1, round(n * val)), n - n_test - 1)


def split_by_project(df: DataFrame, project: str = "project", val: float = 0.2, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole projects go to one split; needs three of them."""
    keys = df.select(project).distinct()
    n = keys.count()
    if n < 3:
        raise ValueError(f"a split by project needs 3 projects, not {n}")
    n_test, n_val = block_sizes(n, val, test)
    rank = F.row_number().over(Window.orderBy(order_key(F.col(project), seed), project))
    named = keys.withColumn("_r", rank).select(project, F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "validation").otherwise("train").alias("split"))
    return df.join(named, project)


def split_stratified(df: DataFrame, id_col: str, strata: list[str], val: float = 0.2, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Each stratum gives its rounded shares to test and validation."""
    w = Window.partitionBy(*strata)
    rank, n = F.row_number().over(w.orderBy(order_key(F.col(id_col), seed), id_col)), F.count(F.lit(1)).over(w)
    n_test, n_val = F.bround(n * test), F.bround(n * val)
    return df.withColumns({"_r": rank, "_t": n_test, "_v": n_val}).withColumn("split", F.when(F.col("_r") <= F.col("_t"), "test").when(F.col("_r") <= F.col("_t") + F.col("_v"), "validation").otherwise("train")).drop("_r", "_t", "_v")


def cap(df: DataFrame, id_col: str, total: int | None = None, per: dict[str, int] | None = None, seed: int = 42) -> DataFrame:
    """The first `total` rows in shuffled order, then the first so many per value of each column of `per`, in turn."""
    if total is not None:
        df = df.orderBy(order_key(F.col(id_col), seed), id_col).limit(total)
    for column, most in (per or {}).items():
        w = Window.partitionBy(column).orderBy(order_key(F.col(id_col), seed), id_col)
        df = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")
    return df


def single_class_splits(df: DataFrame, label: str = "label", split: str = "split") -> DataFrame:
    """Splits with fewer than two labels."""
    return df.groupBy(split).agg(F.countDistinct(label).alias("labels")).filter("labels < 2")


def _deal(keys: list[str], targets: dict[str, int]) -> dict[str, str]:
    """One key to each split, then each to the split that lacks most of its share."""
    out, have = {}, dict.fromkeys(targets, 0)
    head, rest = keys[: len(targets)], keys[len(targets) :]
    for key, split in zip(head, targets, strict=False):
        out[key], have[split] = split, 1
    want = {s: n * len(rest) / sum(targets.values()) for s, n in targets.items()}
    for key in rest:
        split = max(targets, key=lambda s: want[s] - have[s])
        out[key] = split
        have[split] += 1
    return out


def assign_repositories(df: DataFrame, project: str = "project", label: str = "label", val: float = 0.2, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Repositories (projects without a benign:: prefix) go whole to a split; those with a label 1 and the others are
    dealt apart, so that every split sees both. The keys are collected: there is one per repository."""
    repo = F.regexp_replace(project, "^benign::", "")
    keys = df.groupBy(repo.alias("_repo")).agg(F.max(label).alias("any")).orderBy(order_key(F.col("_repo"), seed), "_repo").collect()
    n_test, n_val = block_sizes(len(keys), val, test)
    targets = {"train": len(keys) - n_test - n_val, "validation": n_val, "test": n_test}
    dealt = _deal([k._repo for k in keys if k.any == 1], targets) | _deal([k._repo for k in keys if k.any != 1], targets)
    named = df.sparkSession.createDataFrame(list(dealt.items()), "_repo string, split string")
    return df.withColumn("_repo", repo).join(named, "_repo").drop("_repo")
