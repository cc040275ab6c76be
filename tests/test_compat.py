"""Normalisation and folding in the JVM against Python's own."""

import random
import re
import time
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from quillspan.functions import compat
from quillspan.functions import text as X


def texts():
    """Every assigned code point but private ones, alone; each that may combine behind four bases; random mixtures; long runs of marks."""
    t = compat.tables()
    alone = [chr(i) for i in compat.CODES if unicodedata.category(chr(i)) not in ("Cn", "Co")]
    joins = [chr(i) for i in sorted(t["joins"])]
    behind = [a + b + "̣́" for a in ("a", "Υ", "ᄒ", "가") for b in joins]
    r = random.Random(5)
    pool = [*joins * 3, *map(chr, sorted(t["wide"])), *t["one"], *"abcXYZ 09_ßΣİſ" * 50, *map(chr, range(0x1100, 0x1200)), *[chr(compat.S + 28 * r.randrange(399)) for _ in range(400)]]
    mixed = ["".join(r.choices(pool, k=r.randrange(1, 40))) for _ in range(4000)]
    return [*alone, *behind, *mixed, "e" + "̣́" * 2000, "", "a\nb́\r\nc" * 3, "x" * 100_000 + "́", None]


def test_strict_forms(spark):
    rows = texts()
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(rows)), "t": pd.Series(rows, dtype="object")})).repartition(8)
    t = F.col("t")
    got = df.select("i", compat.folded(t).alias("f"), X.identity_strict(t).alias("a"), X.key_strict(t).alias("b"), X.canonical_strict(t).alias("c")).collect()
    assert len(got) == len(rows)
    for i, *values in got:
        if rows[i] is None:
            assert values == [None] * 4
            continue
        f = unicodedata.normalize("NFKC", rows[i]).casefold()
        assert values == [f, "".join(filter(str.isalnum, f)), re.sub(r"\W", "", f), " ".join(f.split())], ascii(rows[i])


def test_arrow_forms_agree(spark):
    df = spark.createDataFrame([("Ａ́ ﬁ İ_",), ("① Straße",), ("",), (None,)], "t string")
    t = F.col("t")
    for jvm, arrow in ((X.identity_strict, X.identity_arrow), (X.key_strict, X.key_arrow), (X.canonical_strict, X.canonical_arrow)):
        assert df.select(jvm(t)).collect() == [tuple(r) for r in df.select(arrow(t)).collect()]


def test_no_python_in_the_plan(spark):
    df = spark.range(3).select(X.identity_strict(F.col("id").cast("string")).alias("x"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_equal_segments_are_formed_once(spark):
    """A text of few different segments takes little longer than its pieces, one of many is formed piece by piece; both are right."""
    rows = ["ẹ́a" * 20_000, "".join(chr(0x1EA0 + i % 90) + "́b" for i in range(300))]
    got = [r.f for r in spark.createDataFrame([(r,) for r in rows], "t string").coalesce(1).select(compat.folded(F.col("t")).alias("f")).collect()]
    assert got == [unicodedata.normalize("NFKC", r).casefold() for r in rows]
    few = spark.createDataFrame([(rows[0] * 5,)], "t string").coalesce(1).select(F.length(compat.folded(F.col("t"))).alias("n"))
    t0 = time.time()
    assert few.first().n > 0 and time.time() - t0 < 12
