"""Protection of evaluation sets and conflicts: semi and anti joins on keys and key sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def without(df: DataFrame, other: DataFrame, *keys: list[str]) -> DataFrame:
    """Rows that match no row of other on any of the key lists: one hash anti join for each, never one OR join."""
    return reduce(lambda d, k: d.join(other.select(*k).distinct(), k, "left_anti"), keys, df)


def matching(df: DataFrame, other: DataFrame, id: str, *keys: list[str]) -> DataFrame:
    """Ids of rows that match on any of the key lists."""
    hits = [df.join(other.select(*k).distinct(), k, "left_semi").select(id) for k in keys]
    return reduce(DataFrame.union, hits).distinct()


def overlapping(df: DataFrame, other: DataFrame, id: str, keys: str) -> DataFrame:
    """Ids of rows whose key set shares an element with any of other's."""
    theirs = other.select(F.explode(keys).alias("k")).distinct()
    return df.select(id, F.explode(keys).alias("k")).join(theirs, "k", "left_semi").select(id).distinct()


def conflicting(df: DataFrame, key: str, signature: str | Column) -> DataFrame:
    """Keys with more than one signature."""
    return df.groupBy(key).agg(F.countDistinct(signature).alias("signatures"), F.count("*").alias("rows")).where("signatures > 1")


def propagate(df: DataFrame, key: str, flag: str) -> DataFrame:
    """The flag of any row of a key, on all its rows; a row without a key keeps its own. Aggregated before the join, so a hot key is one row."""
    hot = df.where(F.col(flag)).select(key).where(F.col(key).isNotNull()).distinct().withColumn("_p", F.lit(True))
    return df.join(hot, key, "left").withColumn(flag, F.coalesce("_p", flag, F.lit(False))).drop("_p")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def alias_splits(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id, splits): the splits that a row's aliases already belong to; more than one is a bridge."""
    a = rows.select("id", F.explode("aliases").alias("alias")).join(known, "alias")
    return a.groupBy("id").agg(F.array_sort(F.collect_set("split")).alias("splits"))


def enrich(admitted: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    """Admitted rows with their source columns; ids must agree, and texts and, where both sides have them, spans be equal."""
    both = raw.withColumnsRenamed({"text": "raw_text", "components": "raw_components"})
    j = admitted.join(both, [key, "id"]).where("text = raw_text")
    if "components" in admitted.columns and "components" in raw.columns:
        j = j.where("components <=> raw_components")
    return j.drop("raw_text", "raw_components")


def upsert(old: DataFrame, new: DataFrame, key: list[str], priority: Column) -> DataFrame:
    """One row of each key: that of the highest priority, a new one before an old one of the same."""
    rest = [c for c in old.columns if c not in key]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(priority.alias("p"), F.col("_new").alias("n"))).alias("best"))
    return best.select(*key, "best.*").select(*old.columns)
