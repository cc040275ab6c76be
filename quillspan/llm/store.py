"""Shared scratch storage, Arrow plumbing and graph components for the operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark whatever store the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, ``spark.checkpoint.dir``; where that is unset, a local master gets one of its own and a cluster an error."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage: an executor's loss costs a re-read, not a re-run.

    A table that was cut knows its rows (``_rows``) and its metrics (``_seen``), observed while it
    was written. By them ``small`` chooses a broadcast (at most ``BROADCAST_BYTES``, else the plain
    join) and ``fit`` the number of tasks; results don't depend on either.
    """

    BROADCAST_BYTES = 32 << 20
    TASK_ROWS = 50_000

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/quillspan-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def cut(self, df: DataFrame, name: str = "t", **metrics: Column) -> DataFrame:
        path, seen = self.path(name), Observation()
        schema = df.schema
        df.observe(seen, F.count(F.lit(1)).alias("_rows"), *[c.alias(k) for k, c in metrics.items()]).write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch, out._seen = path, seen.get
        out._rows = out._seen["_rows"]
        return out

    def small(self, df: DataFrame, row_bytes: int = 32, rows: int | None = None) -> DataFrame:
        """Broadcast if its rows, known or at most ``rows``, fit the bound."""
        n = df._rows if rows is None else rows
        return F.broadcast(df) if n * row_bytes <= self.BROADCAST_BYTES else df

    def fit(self, df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
        """No more tasks for the last stage than at most ``rows`` rows need."""
        n = 2 + max(rows // self.TASK_ROWS, rows * row_bytes // (16 << 20))
        return df.coalesce(n) if n < partitions(self.spark) else df

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """mapInArrow with a function from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Hand freed memory back to the system: a worker that has done its part stays alive beside the next stage's work."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # another allocator
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives its memory back at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def components(spark: SparkSession, scratch: Scratch, edges: DataFrame, limit: int = 40) -> DataFrame:
    """Smallest reachable vertex of every vertex that has an edge, by alternating stars.

    ``edges``: columns a, b (long, not null). Returns (v, root), cut. Each round is four grouped
    aggregations over the edge table (with map-side combine, so a hub's rows are pre-aggregated)
    and the rounds stop when no edge changes. Stars converge in a few rounds and a chain of length
    n in O(log n).
    """
    mark = {"sum": F.bit_xor(F.xxhash64("a", "b"))}
    e = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", **mark)
    for _ in range(limit):
        n = e._rows
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.fit(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), 2 * n)
        # large star: every larger neighbour hangs on the smallest of the neighbourhood
        large = both.where("b > a").join(scratch.small(low, rows=2 * n), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.fit(large.where("a <> b").distinct(), n)
        # small star: every smaller neighbour, and the vertex itself, hang on the smallest one
        small = scratch.fit(large.groupBy("a").agg(F.min("b").alias("m")), n)
        joined = large.join(scratch.small(small, rows=n), "a")
        nxt = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        nxt = scratch.cut(scratch.fit(nxt, 2 * n), "edges", **mark)
        same = nxt._seen == e._seen
        scratch.drop(e)
        e = nxt
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("a").alias("v"), F.col("b").alias("root")).union(e.select(F.col("b").alias("v"), F.col("b").alias("root"))).distinct()
    return scratch.cut(scratch.fit(roots, 2 * e._rows), "labels")
