"""Admission in order, where a row's fate depends on the rows admitted before it: settled in rounds, in parallel.

A sequential loop takes rows by rank and keeps what the admitted ones have claimed. Its result needs
no sequence: a row can be decided as soon as no earlier undecided row could still change what it
finds. Each round decides all such rows at once, so rounds follow the longest chain of rows that wait
for each other, not the number of rows. Keys are aggregated before they are joined, so a key that
very many rows share is one row.

Rows are numbered by rank and settled in stages: the first of them decide without the others, and most
of the others then want a key that is gone and never enter a round.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import Tables

KEY = ["sole", "key"]
AT = "_at"
STAGES = (64, 8, 1)  # the first 64th of the rows is settled first, then the first eighth, then all
STAGED = 4096  # rows from which on stages are worth their jobs
BROADCAST_BYTES = 32 << 20
HEAD = 900  # below the limit under which windows keep the first rows of a group without gathering it


def in_order(rows: DataFrame, rank: str, sole: str | None, shared: str | None = None, own: str | None = None, fixed: str | None = None, barred: str | None = None, limit: int = 10_000) -> DataFrame:
    """Adds split, outcome and round to rows, as one loop in the order of ``rank`` (unique, not null) would set them.

    ``sole``: array of keys of which each belongs to one admitted row; ``shared``: array of keys of
    which each takes the split of the first row admitted with it. A row finds the splits of its
    shared keys; with more than one, ``fixed`` counted among them, it is a ``bridge``; else, if
    ``barred``, it goes without an outcome; else with a sole key taken it is a ``duplicate``; else it
    is ``admitted``, with the split ``fixed``, or found, or ``own``. Null keys are no keys. A row
    without keys is admitted in round 0.
    """
    tables = Tables(rows.sparkSession)
    none = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string") if c else none
    keys = lambda c, one: F.transform(F.array_compact(F.col(c)), lambda k: F.struct(F.lit(one).alias("sole"), k.cast("string").alias("key")))
    every = F.array_distinct(F.concat(*[keys(c, one) for c, one in ((sole, True), (shared, False)) if c]))
    stop = F.coalesce(F.col(barred), F.lit(False)) if barred else F.lit(False)
    table, total, place = _numbered(tables, rows, rank)
    edges = table.select(F.col(AT).alias("rank"), text(own).alias("own"), text(fixed).alias("fixed"), stop.alias("barred"), F.explode(every).alias("k")).select("rank", "own", "fixed", "barred", "k.*")
    claims, made, size, n = [], None, 0, 0
    bounds = [total // part for part in STAGES] if total >= STAGED else [total]
    for low, high in zip([0, *bounds], bounds):
        now = edges.where(~F.col("barred") & (F.col("rank") >= place(low)) & (F.col("rank") < place(high))).select("rank", "own", "fixed", *KEY)
        if made is not None:
            # rows that want a sole key of an earlier stage are out of the running at once
            taken = F.broadcast(made) if size <= BROADCAST_BYTES else made
            given = taken.where("key is not null").select(*KEY, F.lit(True).alias("taken"), F.col("split").alias("got"))
            gone = now.select("rank", *KEY).join(given.select(*KEY, "taken"), KEY, "left").groupBy("rank").agg(F.max(F.col("sole") & F.coalesce("taken", F.lit(False))).alias("gone"))
            open_, seen = tables.cut(gone.where("not gone").select("rank"), "open")
            now = now.join(F.broadcast(open_) if seen["rows"] * 16 <= BROADCAST_BYTES else open_, "rank", "left_semi").join(given, KEY, "left")
            now = now.select("rank", "own", "fixed", *KEY, F.coalesce("taken", F.lit(False)).alias("taken"), "got")
        else:
            now = now.select("*", F.lit(False).alias("taken"), none.alias("got"))
        now, seen = tables.cut(now, "stage")
        left = None
        while seen["rows"]:
            n += 1
            if n > limit:
                raise RuntimeError("more rounds than the limit")
            first = now.groupBy(*KEY).agg(F.min("rank").alias("first"))
            e = now.join(first, KEY)
            found = F.array_compact(F.collect_set(F.when(~F.col("sole"), F.col("got"))))
            each = e.groupBy("rank").agg(
                F.max(F.col("sole") & F.col("taken")).alias("doomed"), F.min(F.col("taken") | (F.col("first") == F.col("rank"))).alias("ready"),
                F.array_union(found, F.array_compact(F.array(F.first("fixed")))).alias("found"), F.first("own").alias("mine"),
            )
            ok = F.col("ready") & ~F.col("doomed") & (F.size("found") <= 1)
            each = each.select("rank", (F.col("doomed") | F.col("ready")).alias("done"), ok.alias("ok"), F.coalesce(F.get("found", 0), "mine").alias("split"))
            e, seen = tables.cut(now.join(each, "rank"), "round", left=F.count_if(~F.col("done")))
            new = e.where("ok and not taken").select(*KEY, "split", F.col("rank").alias("setter"), F.lit(n).alias("round"))
            claims.append(new.unionByName(e.where("ok and taken").select("rank", "split").distinct().select(F.lit(True).alias("sole"), none.alias("key"), "split", F.col("rank").alias("setter"), F.lit(n).alias("round"))))
            if not seen["left"]:
                break
            if left is not None and seen["left"] >= left:
                raise RuntimeError("a round decided no row")
            left = seen["left"]
            given = new.select(*KEY, F.lit(True).alias("taken_now"), F.col("split").alias("got_now"))
            now = e.where("not done").select("rank", "own", "fixed", *KEY, "taken", "got").join(given, KEY, "left")
            now = now.select("rank", "own", "fixed", *KEY, F.coalesce("taken_now", "taken").alias("taken"), F.coalesce("got_now", "got").alias("got"))
            now, seen = tables.cut(now, "left")
        if claims:
            made, seen = tables.cut(reduce(DataFrame.unionByName, claims), "claims", bytes=F.sum(F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("split"), F.lit(0)) + 40))
            claims, size = [made], seen["bytes"] or 0
    out = table.withColumn("_keyed", F.coalesce(F.size(every) > 0, F.lit(False)))
    if made is None:
        out = out.select("*", none.alias("_split"), F.lit(None).cast("int").alias("_round"), F.lit(None).cast("boolean").alias("_sole"), F.array().cast("array<string>").alias("_found"))
    else:
        admitted = made.groupBy(F.col("setter").alias(AT)).agg(F.first("split").alias("_split"), F.min("round").alias("_round"))
        taken = made.where("key is not null").select(*KEY, "split", "setter")
        seen = edges.select("rank", *KEY).join(F.broadcast(taken) if size <= BROADCAST_BYTES else taken, KEY).where("setter < rank").groupBy(F.col("rank").alias(AT))
        splits = F.array_compact(F.collect_set(F.when(~F.col("sole"), F.col("split"))))
        seen = seen.agg(F.max("sole").alias("_sole"), *([splits.alias("_found")] if shared else []))
        out = out.join(admitted, AT, "left").join(seen if shared else seen.withColumn("_found", F.array().cast("array<string>")), AT, "left")
    bridge = F.size(F.array_union(F.coalesce("_found", F.array().cast("array<string>")), F.array_compact(F.array(text(fixed))))) > 1
    free = ~F.col("_keyed")
    outcome = F.when(free, F.when(~stop, "admitted")).when(F.col("_round").isNotNull(), "admitted").when(bridge, "bridge").when(stop, none).when(F.col("_sole"), "duplicate")
    split = F.when(free & ~stop, F.coalesce(text(fixed), text(own))).otherwise(F.col("_split"))
    return out.select(*rows.columns, split.alias("split"), outcome.alias("outcome"), F.when(free & ~stop, 0).otherwise(F.col("_round")).alias("round"))


def _numbered(tables: Tables, rows: DataFrame, rank: str) -> tuple[DataFrame, int, Callable[[int], int]]:
    """(the rows with a number that rises with their rank, how many, the number of the row at a position)."""
    d = rows.repartitionByRange(rank).sortWithinPartitions(rank).withColumn(AT, F.monotonically_increasing_id())
    table, seen = tables.cut(d, "rows", nulls=F.count_if(F.col(rank).isNull()))
    if seen["nulls"]:
        raise RuntimeError("ranks must be unique and not null")
    sizes = sorted(map(tuple, table.groupBy(F.shiftright(AT, 33).alias("p")).agg(F.count("*")).collect()))  # one row for each range

    def place(position: int) -> int:
        for p, n in sizes:
            if position < n:
                return (p << 33) + position
            position -= n
        return (sizes[-1][0] + 1) << 33 if sizes else 0

    return table, seen["rows"], place


def joint_caps(df: DataFrame, rank: str, quota: str, group: str, full: str, caps: tuple[int, int] = (5000, 1000), per_group: int = 8, limit: int = 10_000) -> DataFrame:
    """Rows kept in rank order while both their quota and their group have room; a skipped row uses neither. Settled in rounds.

    A quota is ``quota`` and whether the row is ``full``; caps hold for full and other rows, and
    ``per_group`` for all rows of a group. Ranks are unique; nulls are a quota or a group like others.

    A round looks at the first ``HEAD`` undecided rows of each quota and the first ``per_group`` of
    each group, which windows with a limit give without gathering a quota. A row is kept if its quota
    and its group had room even if all undecided rows before it were kept; the rows of a full quota
    or group are skipped. What a later row has been given was left over by all before it, so it takes
    nothing from them. The first undecided row of all is always decided, and every quota moves on by
    itself, so rounds are far fewer than rows.
    """
    tables = Tables(df.sparkSession)
    now = df.select(F.col(rank).alias("rank"), F.struct(F.col(quota).alias("q"), F.coalesce(F.col(full), F.lit(False)).alias("f")).alias("q"), F.struct(F.col(group).alias("g")).alias("g"))
    # of rows that share quota and group the first per_group at most are kept
    pair = F.row_number().over(Window.partitionBy("q", "g").orderBy("rank"))
    now, seen = tables.cut(now.withColumn("n", pair).where(F.col("n") <= per_group).select("rank", "q", "g", F.lit(0).cast("long").alias("uq"), F.lit(0).cast("long").alias("ug")), "rows")
    kept = []
    for _ in range(limit):
        if not seen["rows"]:
            break
        room_q, room_g = F.when(F.col("q.f"), caps[0]).otherwise(caps[1]) - F.col("uq"), per_group - F.col("ug")
        some, count = tables.cut(now.where((room_q > 0) & (room_g > 0)), "open")
        first = lambda k, n: F.row_number().over(Window.partitionBy(k).orderBy("rank")).alias(n)
        of_q = some.select("*", first("q", "nq")).where(F.col("nq") <= HEAD).where(F.col("nq") <= room_q)
        of_g = some.select("rank", "ug", first("g", "ng")).where(F.col("ng") <= per_group).where(F.col("ng") <= room_g).select("rank")
        new, count = tables.cut(of_q.join(of_g, "rank").select("rank", "q", "g"), "kept")
        if not count["rows"]:
            break
        kept.append(new.select("rank"))
        more = lambda k, u: new.groupBy(k).agg(F.count("*").alias(u))
        rest = some.join(new.select("rank"), "rank", "left_anti").join(more("q", "mq"), "q", "left").join(more("g", "mg"), "g", "left")
        rest = rest.select("rank", "q", "g", (F.col("uq") + F.coalesce("mq", F.lit(0))).alias("uq"), (F.col("ug") + F.coalesce("mg", F.lit(0))).alias("ug"))
        now, seen = tables.cut(rest, "left")
    else:
        raise RuntimeError("more rounds than the limit")
    found = reduce(DataFrame.union, kept) if kept else now.select("rank")
    return df.join(found, df[rank] == found["rank"], "left_semi")
