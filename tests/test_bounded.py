"""Operators whose state is bounded: exact samples, nearest ranks, spools with a zone map, sinks that resume."""

import gzip
import json
import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import score, select
from quillspan.sources import resumable, spool


def test_sample_is_exact_and_follows_the_keys(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").withColumn("_n", F.lit("own"))
    got = {r.k for r in select.sample_rows(df, "k", 700, 3, bucket_rows=400).collect()}
    assert len(got) == 700 and got <= set(range(5000))
    for other in (df.repartition(7), df.orderBy(F.desc("k")), df.coalesce(1)):
        again = select.sample_rows(other, "k", 700, 3, bucket_rows=400)
        assert again.columns == ["k", "_n"] and {r.k for r in again.collect()} == got
    assert {r.k for r in select.sample_rows(df, "k", 700, 4, bucket_rows=400).collect()} != got
    assert [select.sample_rows(df, "k", k, 3).count() for k in (0, 5000, 6000)] == [0, 5000, 5000]
    assert select.sample_rows(df.where("false"), "k", 5, 3).count() == 0


def test_sample_inclusion(spark):
    """Over seeds, each row is drawn as often as any other: chi-square with 199 degrees of freedom, at four deviations."""
    df, n, k, runs = spark.range(200).withColumnRenamed("id", "k").coalesce(1), 200, 60, 24
    count = np.zeros(n)
    for seed in range(runs):
        for r in select.sample_rows(df, "k", k, seed, bucket_rows=50).collect():
            count[r.k] += 1
    p = k / n
    chi = ((count - runs * p) ** 2).sum() / (runs * p * (1 - p))
    assert abs(chi - n) < 4 * math.sqrt(2 * n) and count.sum() == runs * k


def test_nearest_rank(spark):
    g = random.Random(2)
    inf, nan = float("inf"), float("nan")
    groups = {
        "even": [g.random() for _ in range(999)], "ties": [1.0] * 900 + [2.0] * 50 + [-3.0] * 50, "wide": [(-1) ** i * 10.0 ** (i % 600 - 300) for i in range(1200)],
        "skew": [math.exp(g.gauss(0, 8)) for _ in range(2000)], "one": [5.0], "ends": [inf, -inf, nan, 0.0, nan], "close": [1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)] * 3, None: [3.0, 4.0],
        "huge": [1.7e308, -1.7e308, 0.0, 1.0],
    }
    rows = [(k, v) for k, x in groups.items() for v in x] + [("one", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    ps = {"least": 0.0, "low": 0.1, "median": 0.5, "high": 0.95, "most": 1.0}
    got = {r.g: r for r in score.nearest_rank(df, "v", ps, ["g"], buckets=16).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        x = sorted(x, key=lambda v: (v != v, v))
        for name, p in ps.items():
            want = x[max(1, math.ceil(round(p * len(x), 9))) - 1]
            assert got[k][name] == want or (want != want and got[k][name] != got[k][name]), (k, name)
    assert [tuple(r) for r in score.nearest_rank(df.where("g = 'one'"), "v", {"m": 0.5}).collect()] == [(5.0,)]
    assert score.nearest_rank(df.where("v is null"), "v", {"m": 0.5}, ["g"]).count() == 0


def test_spool_reads_only_what_holds_the_rows(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("k"), F.concat(F.lit("row "), "id").alias("text"), F.array("id").alias("a"), F.current_timestamp().alias("ts")).repartition(6)
    z = spool.write_spool(df, f"{tmp_path}/s", ["k"], files=5, rows=250).orderBy("first").collect()
    assert z[0]["first"] == 0 and z[-1]["last"] == 2999 and all(a["last"] + 1 == b["first"] for a, b in zip(z, z[1:])) and len({r.file for r in z}) >= 12
    order = [r.text for r in df.orderBy("k").collect()]
    ids = [0, 1, 1, 1499, 2999, 260, -1, 3000, None]
    asked = spark.createDataFrame([(i,) for i in ids], "idx long")
    got = spool.read_rows(spark, f"{tmp_path}/s", asked).collect()
    assert sorted((r.idx, r.text) for r in got) == sorted((i, order[i]) for i in ids if i is not None and 0 <= i < 3000)
    held = {(r.file, r.row_group) for r in z for i in ids if i is not None and r["first"] <= i <= r["last"]}
    plan = spool.plan_rows(spark, f"{tmp_path}/s", asked).collect()
    assert {(r.file, r.row_group) for r in plan} == held == {(r.file, r.row_group) for r in got} and len(held) <= 5
    with pytest.raises(ValueError):
        spool.MOST_ZONES, keep = 1, spool.MOST_ZONES
        try:
            spool.plan_rows(spark, f"{tmp_path}/s", asked)
        finally:
            spool.MOST_ZONES = keep
    assert spool.read_rows(spark, f"{tmp_path}/s", asked.where("idx is null")).count() == 0


def files(path):
    return {p.name: p.read_bytes() for p in Path(path).glob("unit-*")}


def test_interrupted_sink_resumes(spark, tmp_path):
    units = ["a", "b/ü%", "c d+e", None, "z", ""]
    rows = [(i, units[i % 6], f"text {i} é") for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, unit string, text string").repartition(3)
    resumable.write_units(df, "unit", ["id"], f"{tmp_path}/clean", parts=2)
    clean = files(f"{tmp_path}/clean")
    assert len(clean) == 12 and sum(len(gzip.decompress(b).splitlines()) for b in clean.values()) == 1200
    # a row of unit z stops the first run, after other units of the same and other tasks were written
    bad = df.withColumn("text", F.when(F.col("id") == 1198, F.raise_error(F.lit("stopped")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stopped"):
        resumable.write_units(bad.coalesce(1), "unit", ["id"], f"{tmp_path}/broken", parts=2)
    half = files(f"{tmp_path}/broken")
    resumable.write_units(df.where("unit is null or unit in ('a', 'c d+e')"), "unit", ["id"], f"{tmp_path}/broken", parts=2)
    stamp = {p.name: (p.stat().st_ino, p.stat().st_mtime_ns) for p in Path(f"{tmp_path}/broken").glob("unit-*")}
    done = resumable.write_units(df.repartition(5), "unit", ["id"], f"{tmp_path}/broken", parts=2)
    assert files(f"{tmp_path}/broken") == clean and 6 <= len(stamp) < 12 and set(half.items()) <= set(clean.items())
    assert all((p.stat().st_ino, p.stat().st_mtime_ns) == stamp[p.name] for p in Path(f"{tmp_path}/broken").glob("unit-*") if p.name in stamp)
    assert sorted(((r.unit, r.part) for r in done.collect()), key=str) == sorted(((u, p) for u in units for p in (0, 1)), key=str)
    said = [u for m in Path(f"{tmp_path}/broken").glob("manifest-*") for u in json.loads(m.read_text())]
    assert len(said) == len({(u["unit"], u["part"]) for u in said}) == 12 - len(half)
    back = resumable.read_units(spark, f"{tmp_path}/broken", "id long, unit string, text string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert not list(Path(f"{tmp_path}/broken").glob(".tmp-*"))
