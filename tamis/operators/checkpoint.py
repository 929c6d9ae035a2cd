"""Tables that cut the lineage of loops, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def checkpointed(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """Writes a DataFrame below spark.checkpoint.dir and reads it again. Where that is unset, a local session gets our
    own folder; on a cluster that is an error, since each executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = (base or "/tmp/checkpoints").rstrip("/")

    def run(df: DataFrame) -> DataFrame:
        path = f"{base}/loop-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    return run


def discarded(*frames: DataFrame) -> None:
    """Delete tables of `checkpointed` that nothing will read again."""
    for df in frames:
        place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
