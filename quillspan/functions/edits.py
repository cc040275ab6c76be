"""Offsets carried over edits of a text: sorted break points, cumulative shifts, binary search; array expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IDEOGRAPH_GAPS = r"(?<=[\x{3400}-\x{9fff}])\s+(?=[\x{3400}-\x{9fff}])"
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column) -> Column:
    """Cumulative sums of an array. They are built in blocks, as an array that grows one by one is copied each time."""
    none = F.array().cast("array<int>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))
    add = lambda a: F.aggregate(a, none, lambda acc, x: F.concat(acc, F.array((last(acc) + x).cast("int"))))

    def blocks(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK))).otherwise(none)
        return F.transform(starts, lambda i: add(F.slice(v, i + 1, F.lit(BLOCK))))

    def joined(bl: Column) -> Column:
        whole = lambda upto: F.flatten(F.transform(bl, lambda b, i: let(F.when(i > 0, F.get(upto, i - 1)).otherwise(0), lambda base: F.transform(b, lambda x: x + base))))
        return let(add(F.transform(bl, last)), whole)

    return let(values, lambda v: let(blocks(v), joined))


def at_most(breaks: Column, x: Column) -> Column:
    """How many of the sorted ``breaks`` are at most x, by binary search."""
    start = F.struct(F.lit(0).alias("lo"), F.size(breaks).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        low = (s["lo"] < s["hi"]) & (F.get(breaks, mid) <= x)
        return F.struct(F.when(low, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(low | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, step, lambda s: s["lo"])


def without(text: Column, spans: Column, pattern: str) -> Column:
    """(text, spans): the text without what matches ``pattern``, and its spans where they then lie.

    An end inside a removed run lies where the run was; a span of which nothing is left goes. A
    mask has one letter for each character, kept or gone; an end lies behind the kept ones before
    it, counted from the start of its block on, so work follows the text and the ends.
    """
    gone, kept = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(0)), F.split(text, pattern)
    both = F.zip_with(kept, gone, lambda k, g: F.concat(F.repeat(F.lit("k"), F.length(k)), F.repeat(F.lit("-"), F.coalesce(F.length(g), F.lit(0)))))
    mask = F.array_join(both, "").cast("binary")
    left = lambda m, at, n: F.length(F.replace(F.substring(m, at + 1, n).cast("string"), F.lit("-"), F.lit("")))

    def counted(m: Column) -> Column:
        starts = F.when(F.length(m) > 0, F.sequence(F.lit(0), F.length(m) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.struct(m.alias("mask"), F.length(m).alias("n"), running(F.transform(starts, lambda i: left(m, i, F.lit(BLOCK)))).alias("upto"), F.regexp_replace(text, pattern, "").alias("text"))

    def move(m: Column, x: Column) -> Column:
        x = F.least(x, m["n"])
        block = F.floor(x / BLOCK).cast("int")
        return F.when(x <= 0, x).otherwise(F.when(block > 0, F.get(m["upto"], block - 1)).otherwise(0) + left(m["mask"], block * BLOCK, x - block * BLOCK))

    def moved(m: Column) -> Column:
        new = F.transform(spans, lambda s: F.struct(s["label"].alias("label"), move(m, s["start"]).alias("start"), move(m, s["end"]).alias("end")))
        new = F.transform(new, lambda s: F.struct(s["label"].alias("label"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), m["text"].substr(s["start"] + 1, s["end"] - s["start"]).alias("raw")))
        return F.struct(m["text"].alias("text"), F.filter(new, lambda s: s["end"] > s["start"]).alias("spans"))

    return F.when(text.isNotNull() & spans.isNotNull(), let(mask, lambda m: let(counted(m), moved)))


def compact_ideographs(text: Column, spans: Column) -> Column:
    """(text, spans) without the white space between ideographs."""
    return without(text, spans, IDEOGRAPH_GAPS)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading characters that two texts share, by binary search over prefixes."""
    start = F.struct(F.lit(0).alias("lo"), F.least(F.length(a), F.length(b)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"] + 1, 1)
        same = a.substr(F.lit(1), mid) == b.substr(F.lit(1), mid)
        return F.struct(F.when(same, mid).otherwise(s["lo"]).alias("lo"), F.when(same, s["hi"]).otherwise(mid - 1).alias("hi"))

    more = lambda s, i: F.when(s["lo"] < s["hi"], step(s, i)).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, more, lambda s: s["lo"])


def rebase(spans: Column, before: Column, after: Column) -> Column:
    """Spans carried over one edit: those before it stay, those after it move, those it touches go; null without spans or text."""
    n, m = F.length(before), F.length(after)
    head = common_prefix(before, after)
    tail = F.least(common_prefix(F.reverse(before), F.reverse(after)), F.least(n, m) - head)

    def moved(e: Column) -> Column:
        stay = lambda s: s["end"] <= e["head"]
        keep = F.filter(spans, lambda s: stay(s) | (s["start"] >= n - e["tail"]))
        shift = lambda s: F.when(stay(s), 0).otherwise(m - n)
        new = F.transform(keep, lambda s: F.struct(s["label"].alias("label"), (s["start"] + shift(s)).cast("int").alias("start"), (s["end"] + shift(s)).cast("int").alias("end")))
        return F.transform(new, lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end"), after.substr(s["start"] + 1, s["end"] - s["start"]).alias("raw")))

    made = let(F.struct(head.alias("head"), tail.alias("tail")), moved)
    return F.when(spans.isNotNull() & after.rlike(r"[^\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]"), made)
