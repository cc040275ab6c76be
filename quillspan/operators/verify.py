"""Comparison of two results as multisets of rows: digests by key range, cut finer only where they differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Tables

BITS = 8  # of the key's hash that each round looks at more
BROADCAST_RANGES = 1 << 18  # ranges of 24 bytes that are sent to every task; more are joined


def fingerprints(df: DataFrame, key: list[str]) -> DataFrame:
    """(k, h, low, high): the key, the hash that orders keys into ranges, and two hashes of the whole row. Nulls differ from texts, and equal rows are alike."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return df.select(F.struct(*key).alias("k"), F.xxhash64(*key).alias("h"), F.xxhash64(F.lit(1), row).alias("low"), F.xxhash64(F.lit(2), row).alias("high"))


def digests(rows: DataFrame, bits: int) -> DataFrame:
    """(range, n, low, high) of each range of the first ``bits`` bits: counts and sums of the rows' hashes, which no order of rows changes."""
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    return rows.groupBy(F.shiftrightunsigned("h", 64 - bits).alias("range")).agg(F.count("*").alias("n"), total("low").alias("low"), total("high").alias("high"))


def differences(a: DataFrame, b: DataFrame, key: list[str], few: int = 64, rounds: int = 6) -> DataFrame:
    """(key columns, kind, n_a, n_b) of every key whose rows are not the same multiset on both sides.

    ``kind``: lost (only in a), added (only in b), doubled or dropped (the same distinct rows, more or
    fewer times in b), changed. Each round compares digests by key range and goes on with ranges that
    differ; once these hold about ``few`` rows each, or after ``rounds``, their rows are compared, so
    that of equal ranges nothing but digests is moved. Columns are compared by name.
    """
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    tables = Tables(a.sparkSession)
    a, b = fingerprints(a, key), fingerprints(b, key)
    ranges = None
    for n in range(1, rounds + 1):
        bits = BITS * n
        within = lambda x, bits=bits: x if ranges is None else x.join(ranges, F.shiftrightunsigned("h", 64 - bits + BITS) == F.col("range"), "left_semi")
        x, y = digests(within(a), bits), digests(within(b), bits)
        same = lambda c: F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))
        j = x.alias("x").join(y.alias("y"), F.col("x.range") == F.col("y.range"), "full_outer").where(~(same("n") & same("low") & same("high")))
        rows = F.coalesce("x.n", F.lit(0)) + F.coalesce("y.n", F.lit(0))
        found, seen = tables.cut(j.select(F.coalesce("x.range", "y.range").alias("range"), rows.alias("n")), "ranges", most=F.max("n"))
        ranges = F.broadcast(found.select("range")) if seen["rows"] <= BROADCAST_RANGES else found.select("range")
        if not seen["rows"] or seen["most"] <= 2 * few:
            break
    left = lambda x: x.join(ranges, F.shiftrightunsigned("h", 64 - bits) == F.col("range"), "left_semi")
    side = lambda x, i: left(x).groupBy("k", "low", "high").agg(F.count("*").alias(f"n{i}"))
    both = reduce(lambda p, q: p.join(q, ["k", "low", "high"], "full_outer"), [side(a, 1), side(b, 2)]).na.fill(0, ["n1", "n2"])
    g = both.groupBy("k").agg(F.sum("n1").alias("n_a"), F.sum("n2").alias("n_b"), F.max(F.col("n1") != F.col("n2")).alias("differs"), F.max((F.col("n1") == 0) | (F.col("n2") == 0)).alias("other"))
    kind = F.when(F.col("n_b") == 0, "lost").when(F.col("n_a") == 0, "added").when(F.col("other"), "changed").when(F.col("n_b") >= F.col("n_a"), "doubled").otherwise("dropped")
    return g.where("differs").select(*[F.col(f"k.{c}") for c in key], kind.alias("kind"), "n_a", "n_b")
