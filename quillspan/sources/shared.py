"""Tables in the folder that the cluster shares, for operators that work in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local master gets a folder of its own and a cluster an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Tables:
    """Writes tables once and reads them back, so that a round's plan does not hold the rounds before."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quillspan-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
        """(the table, its rows and the given aggregates, observed while it was written)."""
        path, seen = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}", Observation()
        schema = df.schema
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()]).write.parquet(path)
        return self.spark.read.schema(schema).parquet(path), seen.get


ROWS, TEXTS = 8192, 1024  # rows of a task; where each is a whole text


def dealt(df: DataFrame, *keys: str, rows: int = ROWS) -> DataFrame:
    """The rows dealt out by key, about ``rows`` to a task: a table of few splits is not worked on by few tasks, and a task's work and memory do not grow with the table.

    The rows are counted first, which for a table read as it is takes only the footers of its files.
    """
    n = -(-df.count() // rows)
    return df.repartition(n, *keys) if n > 1 else df
