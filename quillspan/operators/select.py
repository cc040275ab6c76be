"""Deterministic selection: hash orders, stratified ranks, caps, samples."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from .admit import joint_caps  # noqa: F401  (selection in rank order under two caps)


def hash_rank(*cols: Column | str, seed: str = "") -> Column:
    return X.digest(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of each group; the row_number filter lets the optimiser limit groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def require(df: DataFrame, by: Sequence[str], n: int) -> None:
    """Fail if a group has fewer than n rows."""
    short = df.groupBy(*by).count().where(F.col("count") < n).limit(5).collect()
    if short:
        raise ValueError(f"too few rows in {short}")


def round_robin(df: DataFrame, split: str, state: str, kind: str, grp: str, rank: str, novel: str | None = None, limit: int | None = None) -> DataFrame:
    """Group first, then kinds in turn, then states in turn: three chained ranks.

    With a limit, only the first ``limit`` rows of each window can be among the result, as each rank
    orders a window's rows; filtering by them lets the optimiser limit groups before the shuffle.
    """
    w = lambda by, *order: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    more = [F.col(novel).desc()] if novel else []
    keep = lambda d, c: d if limit is None else d.where(F.col(c) <= limit)
    out = keep(df.withColumn("gr", w([split, state, kind, grp], rank)), "gr")
    out = keep(out.withColumn("tr", w([split, state, kind], "gr", *more, rank)), "tr")
    out = keep(out.withColumn("sr", w([split, state], "tr", kind, rank)), "sr").orderBy(split, "sr", state)
    return out if limit is None else out.limit(limit)


def review_queue(df: DataFrame, strata: Sequence[str], complete: str, id: str, limit: int) -> DataFrame:
    """Strata in turn, complete rows before partial ones."""
    rn = F.row_number().over(Window.partitionBy(complete, *strata).orderBy(X.digest(F.col(id).cast("string")), id))
    return df.withColumn("rn", rn).where(F.col("rn") <= limit).orderBy(F.col(complete).desc(), "rn", *strata).limit(limit)


def arg_min(df: DataFrame, by: Sequence[str], order: Column, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.min_by(F.struct(*cols), order).alias("best")).select(*by, "best.*")


def exact_sample(df: DataFrame, index: str, n: int, total: int, seed: int) -> DataFrame:
    """The rows at the positions that random.Random(seed).sample(range(total), n) names; n is small."""
    import random

    rows = [(i,) for i in random.Random(seed).sample(range(total), min(n, total))]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, f"{index} long")), index, "left_semi")


def sample_rows(df: DataFrame, key: str, k: int, seed: int, bucket_rows: int = 200_000) -> DataFrame:
    """Exactly k rows (all, if fewer), every set of k equally likely, the same for any partitioning; ``key`` is unique.

    Rows fall into buckets by a keyed hash. Of the buckets' counts, one number each, a keyed
    generator draws how many rows come from each (multivariate hypergeometric), and each bucket
    draws its own by a second hash. Only rows whose second hash can be among those are shuffled; a
    bucket in which too few are is drawn from whole.
    """
    own = F.col(key).cast("string")
    n = df.count()
    buckets = max(1, -(-n // bucket_rows))
    d = df.withColumn("_b", F.pmod(F.xxhash64(F.lit(f"bucket {seed}"), own), F.lit(buckets))).withColumn("_h", F.xxhash64(F.lit(f"draw {seed}"), own))
    counts = sorted((r["_b"], r["n"]) for r in d.groupBy("_b").agg(F.count("*").alias("n")).collect())  # a number for each bucket
    if not counts:
        return df
    size = np.array([c for _, c in counts], np.int64)
    take = np.random.Generator(np.random.Philox(seed)).multivariate_hypergeometric(size, min(k, n), method="marginals")
    most = np.where(take == size, 1.0, np.minimum(1.0, (take + 8 * np.sqrt(take) + 20) / size))
    draw = lambda most: F.broadcast(df.sparkSession.createDataFrame([(b, int(t), float(m)) for (b, _), t, m in zip(counts, take, most) if t], "_b long, _take long, _most double"))  # noqa: E731  24 bytes a bucket
    few = lambda most: d.join(draw(most), "_b").where((F.col("_h") / 2.0**64 + 0.5) <= F.col("_most"))
    got = {r["_b"]: r["n"] for r in few(most).groupBy("_b").agg(F.count("*").alias("n")).collect()}
    most = np.where([got.get(b, 0) < t for (b, _), t in zip(counts, take)], 1.0, most)
    nth = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return few(most).withColumn("_n", nth).where("_n <= _take").select(*df.columns)
