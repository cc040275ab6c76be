"""Mixing sources to target weights by entropy balancing; DataFrame functions only.

Of all document rates r between 0 and the cap whose words add up to a source's target T, those
nearest to 1 in relative entropy (least sum of r ln r - r) are exponential tilts
r = min(cap, exp(lambda * size)); lambda is the multiplier of the source's token constraint. The
convex dual has one lambda a source and is solved by Newton steps within a bracket, each one grouped
aggregation over the distinct (source, size) classes, which are all that rates depend on.

Rates become whole copies by class: the floor, one copy more in the classes of the largest
fractions, and then, from the largest documents down, copies that still fit, until the words missing
are fewer than any document left would add; one of the smallest left follows if that comes nearer. Within a class copies are dealt by a hash. Sums that
steer a choice are decimal or whole numbers, so the order of rows never shows in the result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .store import Scratch

WEIGHTS = (3, 1, 2)
WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"
SAME = ["key", "size"]


def words(text: str) -> Column:
    """Number of runs of other characters than space, tab, LF, VT, FF and CR; a text is never cut into an array."""
    return F.length(F.regexp_replace(F.concat(F.coalesce(text, F.lit("")), F.lit(" x")), WORD, "x")).cast("long") - 1


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """key, source_size, n, target of each source (key, source_size, n).

    Sources in order of their keys, the null source's empty key last, weigh ``weights`` in turn and
    share ``share`` times all words. A target stops at ``cap`` times its source; what it cannot take
    is shared by weight until none is above. That level is the largest of (total - words of the
    sources before, at their cap) / (weights from here on), in order of cap by weight.
    """
    turn = F.row_number().over(Window.orderBy(F.col("key") == "", "key"))
    t = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int")))
    t = t.withColumn("most", F.col("source_size") * cap)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    full, used = F.coalesce(F.sum("most").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    t = t.withColumn("here", (F.sum("source_size").over(every) * share - full) / (F.sum("weight").over(every) - used))
    t = t.withColumn("level", F.max("here").over(every))
    return t.select("key", "source_size", "n", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def tilts(scratch: Scratch, classes: DataFrame, goals: DataFrame, cap: int, limit: int = 100) -> DataFrame:
    """goals (key, source_size, n, target) with the multiplier ``tilt`` and the mean size ``mean`` that rates refer to.

    ``tilt`` times size by mean is the exponent. It starts at 0, in the bracket that the smallest
    size allows. A step that leaves the bracket, or a flat dual, is replaced by bisection.
    """
    least = classes.groupBy("key").agg(F.min("size").alias("least"))
    s = goals.where("source_size > 0").join(least, "key").withColumn("mean", F.col("source_size") / F.col("n"))
    by = F.col("mean") / F.col("least")
    full = F.col("target") >= F.col("source_size") * cap
    top = by * math.log(cap) * 1.000001  # there even the smallest document is at its cap
    s = s.withColumn("lo", F.when(F.col("target") < F.col("source_size"), F.log(F.col("target") / F.col("source_size")) * by * 1.000001).otherwise(0.0))
    s = s.withColumn("hi", F.when(F.col("target") < F.col("source_size"), F.lit(0.0)).otherwise(top))
    s = s.withColumn("tilt", F.when(full, F.col("hi")).otherwise(0.0)).withColumn("done", full)
    s = scratch.cut(s.drop("least"), "tilts", open=F.sum(F.when(~F.col("done"), 1)))
    exact = lambda c: F.sum(c.cast("decimal(28,6)")).cast("double")  # noqa: E731  alike in any order of rows
    for _ in range(limit):
        if not s._seen["open"]:
            return s.select("key", "source_size", "n", "target", "mean", "tilt")
        x = F.col("size") / F.col("mean")
        rate = F.least(F.lit(float(cap)), F.exp(F.col("tilt") * x))
        moved = classes.join(scratch.small(s.where("not done").select("key", "mean", "tilt"), 64, s._rows), "key")
        moved = moved.groupBy("key").agg(exact(F.col("times") * F.col("size") * rate).alias("words"), exact(F.when(rate < cap, F.col("times") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"))
        nxt = s.join(moved, "key", "left")
        over = F.col("words") - F.col("target")
        lo, hi = F.when(over < 0, F.col("tilt")).otherwise(F.col("lo")), F.when(over < 0, F.col("hi")).otherwise(F.col("tilt"))
        step = F.col("tilt") - over / F.nullif(F.col("slope"), F.lit(0.0))
        inside = step.isNotNull() & (step > F.col("lo1")) & (step < F.col("hi1"))
        nxt = nxt.withColumns({"lo1": lo, "hi1": hi})
        near = (F.abs(over) <= 0.25) | (F.abs(over) <= 1e-10 * F.col("target")) | (F.col("hi1") - F.col("lo1") <= 1e-14)
        done = F.col("done") | near
        nxt = nxt.select(
            "key", "source_size", "n", "target", "mean", F.when(done, F.col("lo")).otherwise(F.col("lo1")).alias("lo"), F.when(done, F.col("hi")).otherwise(F.col("hi1")).alias("hi"),
            F.when(done, F.col("tilt")).when(inside, step).otherwise((F.col("lo1") + F.col("hi1")) / 2).alias("tilt"), done.alias("done"),
        )
        nxt = scratch.cut(scratch.fit(nxt, s._rows), "tilts", open=F.sum(F.when(~F.col("done"), 1)))
        scratch.drop(s)
        s = nxt
    raise RuntimeError("the dual did not settle")


def class_copies(scratch: Scratch, classes: DataFrame, solved: DataFrame, cap: int, limit: int = 64) -> DataFrame:
    """key, size, times, rate, copies: whole copies of all documents of a class together."""
    c = classes.join(scratch.small(solved, 64), "key")
    rate = F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.col("size") / F.col("mean")))
    c = c.select(*SAME, "times", "target", rate.alias("rate")).withColumn("part", F.col("times") * F.col("rate"))
    c = c.withColumn("copies", F.least(F.floor("part"), F.col("times") * cap))
    own = Window.partitionBy("key")
    gap = F.floor(F.col("target") - F.sum(F.col("copies") * F.col("size")).over(own))
    c = c.withColumn("gap", gap).withColumn("room", F.col("times") * cap - F.col("copies"))
    # one copy more where the largest fractions are, as far as the words go
    first = own.orderBy((F.col("part") - F.col("copies")).desc(), F.xxhash64(*SAME), "size").rowsBetween(Window.unboundedPreceding, 0)
    one = F.when(F.col("room") > 0, F.col("size")).otherwise(0)
    c = c.withColumn("one", one).withColumn("upto", F.sum("one").over(first))
    c = c.withColumn("copies", F.col("copies") + F.when((F.col("one") > 0) & (F.col("upto") <= F.col("gap")), 1).otherwise(0))
    for _ in range(limit):
        c = c.select(*SAME, "times", "target", "rate", "copies").withColumn("gap", F.floor(F.col("target") - F.sum(F.col("copies") * F.col("size")).over(own)))
        room = F.when(F.col("gap") > 0, F.least(F.col("times") * cap - F.col("copies"), F.expr("gap div size"))).otherwise(0)
        nxt = scratch.cut(c.withColumn("room", room), "copies", room=F.sum("room"))
        if not nxt._seen["room"]:
            # a copy of the smallest document left, if the sum then comes nearer to the target
            least = F.min(F.when(F.col("copies") < F.col("times") * cap, F.col("size"))).over(own)
            last = (F.col("size") == least) & (F.col("size") < 2 * F.col("gap"))
            return nxt.select(*SAME, "times", "rate", (F.col("copies") + F.when(F.coalesce(last, F.lit(False)), 1).otherwise(0)).alias("copies"))
        # each round takes more than half of what is missing, or all that there is
        down = own.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
        c = nxt.withColumn("before", F.coalesce(F.sum(F.col("room") * F.col("size")).over(down), F.lit(0)))
        c = c.withColumn("copies", F.col("copies") + F.greatest(F.lit(0), F.least(F.col("room"), F.expr("(gap - before) div size"))))
    raise RuntimeError("the copies did not settle")


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, rate, source of every row.

    ``taken`` is copies times size: 0 to ``cap`` whole copies. A source's taken words
    differ from its target by less than the smallest document that has a copy left; a source at its
    cap gets exactly that.
    Null texts have no words, as empty and blank ones; those rows stay with nothing taken. A null
    source is a source; null and repeated doc_ids are told apart by their texts, and rows alike in
    all of these are interchangeable; long texts count whole; equal sizes are dealt by hash; other
    columns are ignored; no rows give no rows. Reruns and other partitionings give the same rows.
    """
    scratch = Scratch(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words("text").alias("size"), F.xxhash64("doc_id", "text").alias("hash"))
    d = scratch.cut(d.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))), "sizes")
    classes = scratch.cut(d.groupBy(*SAME).agg(F.count(F.lit(1)).alias("times")), "classes")
    sizes = scratch.fit(classes.groupBy("key").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n")), classes._rows)
    goals = scratch.cut(targets(sizes, weights, share, cap), "targets")
    some = classes.where("size > 0")
    solved = tilts(scratch, some, goals, cap)
    solved._rows = goals._rows
    found = scratch.cut(class_copies(scratch, some, solved, cap), "found")
    # every document of a class has its whole share of the copies; a hash deals out the rest. A hot
    # class is split by the hash into about as many buckets as each has rows, and its rest over them
    c = found.select(*SAME, "rate", "times", F.expr("copies div times").alias("base"), (F.col("copies") % F.col("times")).alias("rest"))
    d = d.join(scratch.small(c, 64, found._rows), SAME, "left").join(scratch.small(goals.select("key", "source_size", "target"), 64, goals._rows), "key")
    plain = d.where("coalesce(rest, 0) = 0").withColumn("copies", F.coalesce("base", F.lit(0)))
    dealt = scratch.cut(d.where("rest > 0").withColumn("bucket", F.pmod("hash", F.ceil(F.sqrt("times")))), "dealt")
    buckets = dealt.groupBy(*SAME, "bucket", "rest", "times").agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*SAME).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(18,0)")
    part = "({}) * cast(rest as decimal(18,0)) div times"
    buckets = buckets.withColumn("upto", upto).select(*SAME, "bucket", F.expr(f"{part.format('upto')} - {part.format('upto - rows')}").alias("quota"))
    nth = F.row_number().over(Window.partitionBy(*SAME, "bucket").orderBy("hash", "doc_id"))
    dealt = dealt.join(buckets, [*SAME, "bucket"]).withColumn("copies", F.col("base") + F.when(nth <= F.col("quota"), 1).otherwise(0))
    out = ["doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), F.col("copies").cast("long").alias("copies"), "rate", "source"]
    return plain.select(*out).unionByName(dealt.select(*out))
