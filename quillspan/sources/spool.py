"""A table in the order of its row numbers, with a map of which rows each row group holds, so that a batch of numbers reads those alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ZONES = "file string, row_group int, first long, last long"
MOST_ZONES = 4 << 20  # of which the first numbers are broadcast, 32 MB


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_spool(df: DataFrame, path: str, order: list[str], files: int, rows: int = 1_000_000) -> DataFrame:
    """Write ``df`` sorted by ``order``, which is unique, in at least ``files`` files of at most ``rows`` rows; returns the zone map.

    Row numbers count from 0 in that order. The map is kept beside the table, under ``.zones``.
    """
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows).mode("errorifexists").parquet(path)
    footers(df.sparkSession, path).write.mode("errorifexists").parquet(path.rstrip("/") + ".zones")
    return zones(df.sparkSession, path)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """The zone map from the footers of the files, read by tasks; names of files are in the order of their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            for name in b.column(0).to_pylist():
                store, where = filesystem(name)
                with store.open_input_file(where) as f:
                    meta = pq.ParquetFile(f).metadata
                    n = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], ["file", "row_group", "n"])

    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")  # listing only, no content
    found = names.mapInArrow(run, "file string, row_group int, n long").where("n > 0")
    upto = F.sum("n").over(Window.orderBy(F.substring_index("file", "/", -1), "row_group"))  # a row for each row group
    return found.select("file", "row_group", (upto - F.col("n")).alias("first"), (upto - 1).alias("last"))


def zones(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ZONES).parquet(path.rstrip("/") + ".zones")


def plan_rows(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(file, row_group, first, wanted): the row groups that hold the row numbers ``ids`` (column idx), and which of them each holds. Null and absent numbers are in none."""
    z = zones(spark, path)
    if z.count() > MOST_ZONES:
        raise ValueError("the zone map is too large to broadcast: write fewer, larger row groups")
    t = z.select("first", "last").orderBy("first").toArrow()
    shared = spark.sparkContext.broadcast([t.column(k).to_numpy() for k in (0, 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last = shared.value
        for b in batches:
            idx = b.column(0).to_numpy()
            at = np.searchsorted(first, idx, "right") - 1
            here = (at >= 0) & (idx <= last[np.maximum(at, 0)]) if len(first) else np.zeros(len(idx), bool)
            yield pa.RecordBatch.from_arrays([pa.array(first[at[here]] if len(first) else idx[here]), pa.array(idx[here])], ["first", "idx"])

    found = ids.select(F.col("idx").cast("long").alias("idx")).where("idx is not null").mapInArrow(run, "first long, idx long")
    return z.join(found.groupBy("first").agg(F.sort_array(F.collect_list("idx")).alias("wanted")), "first").select("file", "row_group", "first", "wanted")


def read_rows(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The rows of the given numbers with idx and the row group they came from (file, row_group); a number that is asked twice comes twice.

    A task reads only the row groups of ``plan_rows``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = spark.read.parquet(path).schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for b in batches:
            for name, group, first, wanted in zip(*(b.column(k).to_pylist() for k in range(4))):
                store, where = filesystem(name)
                with store.open_input_file(where) as f:
                    t = pq.ParquetFile(f).read_row_group(group).select(arrow.names)
                t = t.take(pa.array(np.array(wanted) - first)).cast(arrow).combine_chunks()
                for r in t.to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array([name] * len(wanted)), pa.array([group] * len(wanted), pa.int32()), *r.columns], ["idx", "file", "row_group", *arrow.names])

    plan = plan_rows(spark, path, ids)
    return plan.mapInArrow(run, type(schema)([*spark.createDataFrame([], "idx long, file string, row_group int").schema, *schema]))
