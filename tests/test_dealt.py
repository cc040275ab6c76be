"""Tables of few splits are dealt out, so that no single task works on a whole table."""

from pyspark.sql import functions as F

from quillspan.plans import catalogue
from quillspan.sources.shared import ROWS, TEXTS, dealt


def test_records_of_one_split_are_many_tasks(spark, sf, tmp_path):
    n = 5 * ROWS
    few = spark.range(n).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    few.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert spark.read.parquet(f"{tmp_path}/customer.parquet").rdd.getNumPartitions() == 1
    parts = catalogue.records(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(parts) == 5 and sum(r["count"] for r in parts) == n and max(r["count"] for r in parts) < 2 * ROWS


def test_dealt_keeps_every_row(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), "id").coalesce(1)
    got = dealt(df, "k", rows=30)
    assert got.rdd.getNumPartitions() == 4 and sorted(r.id for r in got.collect()) == list(range(100))
    assert dealt(df, "k", rows=100).rdd.getNumPartitions() == 1 and dealt(df.where("false"), "k").count() == 0


def test_variants_of_one_split_are_many_tasks(spark, sf, tmp_path):
    """structural_variants and parse work on records row by row, so they have as many tasks as the records."""
    few = spark.range(3 * ROWS).select(F.col("id").alias("c_custkey"), (F.col("id") % 25).cast("int").alias("c_nationkey"), F.lit("BUILDING").alias("c_mktsegment"))
    few.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("nation", "region"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for q in ("structural_variants", "parse"):
        assert catalogue.QUERIES[q](spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_texts_of_one_split_are_many_tasks(spark, tmp_path):
    """compacted_spans and strict_keys work on texts row by row."""
    spark.range(3 * TEXTS).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for q in ("compacted_spans", "strict_keys"):
        assert catalogue.QUERIES[q](spark, str(tmp_path)).rdd.getNumPartitions() == 3
