"""Offset maps against a definition character by character; comparisons of results; label scopes; admission of candidates."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspan.functions import edits
from quillspan.functions import labels as L
from quillspan.functions import spans as S
from quillspan.functions import text as X
from quillspan.operators import verify
from quillspan.plans import catalogue, corpora


def removed(text, spans, pattern):
    """Text and spans after every character of a match is struck out."""
    gone = set()
    for m in re.finditer(pattern, text):
        gone |= set(range(*m.span()))
    at = [0]
    for i in range(len(text)):
        at.append(at[-1] + (i not in gone))
    new = "".join(c for i, c in enumerate(text) if i not in gone)
    return new, [(label, at[a], at[b], new[at[a] : at[b]]) for label, a, b in spans if at[b] > at[a]]


def test_spans_survive_compaction(spark):
    r = random.Random(4)
    gaps = "(?<=[㐀-鿿])\\s+(?=[㐀-鿿])"
    texts = ["", "東 京", "東京", " 東  京 ", "a b", "東 a 京\n\n都", "x" * 50, "東 " * 700 + "🏠 end", *("".join(r.choice("東京都a 🏠\n  ") for _ in range(r.randint(1, 400))) for _ in range(60))]
    rows = []
    for i, t in enumerate(texts):
        cuts = [sorted(r.randint(0, len(t)) for _ in range(2)) for _ in range(12)]
        rows.append((i, t, [(str(k), a, b) for k, (a, b) in enumerate(cuts)]))
    rows += [(998, None, []), (999, "東 京", None)]
    df = spark.createDataFrame([(i, t, None if s is None else [(*x, "") for x in s]) for i, t, s in rows], f"id int, text string, spans {S.SPANS}")
    got = {x.id: x for x in df.select("id", edits.compact_ideographs(F.col("text"), F.col("spans")).alias("m"), edits.without(F.col("text"), F.col("spans"), "[ \n]").alias("n")).collect()}
    assert got[998].m is None and got[999].m is None
    for i, t, s in rows[:-2]:
        for m, pattern in ((got[i].m, gaps), (got[i].n, "[ \n]")):
            text, moved = removed(t, s, pattern)
            assert m.text == text and [tuple(x) for x in m.spans] == moved, (i, pattern)
    assert [x.c for x in spark.createDataFrame([([1] * 700,), ([],)], "v array<int>").select(edits.running(F.col("v")).alias("c")).collect()] == [list(range(1, 701)), []]


def test_rebase_equals_its_definition(spark):
    r = random.Random(6)
    rows = []
    for _ in range(200):
        a = "".join(r.choice("ab ") for _ in range(r.randint(0, 40)))
        i = r.randint(0, len(a))
        b = r.choice([a[:i] + "x" * r.randint(0, 3) + a[min(len(a), i + r.randint(0, 5)) :], a, "", " \n", None, a[::-1]])
        spans = [("l", *sorted(r.randint(0, len(a)) for _ in range(2))) for _ in range(4)]
        rows.append((a, b, [(n, s, e, a[s:e]) for n, s, e in spans]))
    df = spark.createDataFrame(rows, f"a string, b string, spans {S.SPANS}")
    for x in df.select("a", "b", "spans", S.rebase(F.col("spans"), F.col("a"), F.col("b")).alias("got")).collect():
        want = S.rebased([s.asDict() for s in x.spans], x.a, x.b)
        assert (x.got and [s.asDict() for s in x.got]) == want if want else not x.got, x


def test_planted_differences_are_named(spark):
    r = random.Random(1)
    a = [(i % 4000, f"v{i % 7}", None if i % 11 == 0 else i % 5) for i in range(4100)]  # 100 keys twice
    b = list(a)
    for i in (10, 20):
        b.remove(a[i + 1000])
    b += [a[2000], a[2000], (9001, "new", 1), (None, "no key", 1)]
    b[b.index(a[500])] = (500, a[500][1], None)
    r.shuffle(b)
    want = Counter(a), Counter(b)
    keys = {k for k in {x[0] for x in a + b} if {x: n for x, n in want[0].items() if x[0] == k} != {x: n for x, n in want[1].items() if x[0] == k}}
    schema = "k long, v string, n long"
    x, y = spark.createDataFrame(a, schema).repartition(3), spark.createDataFrame(b, schema).select("n", "v", "k")
    got = {g.k: (g.kind, g.n_a, g.n_b) for g in verify.differences(x, y, ["k"]).collect()}
    assert set(got) == keys == {1010, 1020, 2000, 9001, None, 500}
    assert got == {1010: ("lost", 1, 0), 1020: ("lost", 1, 0), 2000: ("doubled", 1, 3), 9001: ("added", 0, 1), None: ("added", 0, 1), 500: ("changed", 1, 1)}
    assert verify.differences(x, x.orderBy("v"), ["k"]).count() == 0
    assert verify.differences(x, x.where("false"), ["k"]).count() == 4000
    with pytest.raises(ValueError):
        verify.differences(x, y.drop("n"), ["k"])


def test_label_scopes(spark):
    names = ["a", "b", "c", "d"]
    rows = [(1, ["a", "b"]), (2, ["b", "b"]), (3, ["a", "c"]), (4, ["z", "a"]), (5, []), (6, ["a"])]
    df = spark.createDataFrame(rows, "id int, labels array<string>").select("id", L.label_mask(F.col("labels"), names).alias("mask"))
    got = {r.id: r.s for r in df.select("id", L.scopes(F.col("mask"), F.lit(0b0011).cast("long")).alias("s")).collect()}
    assert got == {1: ["all", "shared", "complete"], 2: ["all", "shared", "partial"], 3: ["all"], 4: ["all"], 5: ["all"], 6: ["all", "shared", "partial"]}


def test_candidates_admitted_in_order_of_arrival(spark, sf):
    """The whole flow against a loop over the same keys."""
    r = catalogue.records(spark, sf).where("c_custkey <= 120")
    m = F.col("c_custkey") % 6
    # a fifth of the rows again, with another label; every eleventh too long; arrivals in another order than ids
    again = r.where(m == 4).withColumn("components", F.transform("components", lambda s: S.span(F.when(s["label"] == "country", "state").otherwise(s["label"]), s["start"], s["end"], s["raw"]))).withColumn("id", F.concat("id", F.lit("-again")))
    rows = r.unionByName(again).unionByName(r.where(m == 5).withColumn("id", F.concat("id", F.lit("-twice"))))
    rows = rows.withColumn("text", F.when(F.col("c_custkey") % 11 == 0, F.concat("text", F.lit("y" * 65))).otherwise(F.col("text")))
    rows = rows.withColumn("arrival", F.xxhash64("id")).select("arrival", "id", "text", "country", "components")
    c = F.col("components")
    known = r.where("c_custkey in (7, 8, 9)").select(S.group_key(F.col("country"), F.col("text"), c).alias("alias"), F.when(F.col("c_custkey") == 7, "test").otherwise("train").alias("split")).dropDuplicates(["alias"])
    guarded = r.where("c_custkey = 13").select("text")
    out = {x.id: x for x in corpora.admission(rows, known, guarded, "seed").collect()}
    fields = corpora.representable(rows)
    parts = F.transform("fields", lambda s: F.struct(s["label"].alias("label"), X.identity(s["raw"]).alias("raw")))
    f = fields.select("arrival", "id", "fits", X.identity(F.col("text")).alias("loose"), X.text_key(F.col("text")).alias("key"), F.to_json(parts).alias("sign"), F.to_json(F.array_sort(parts)).alias("entity"), S.group_key(F.col("country"), F.col("text"), c).alias("grp"),
        F.array_union(L.alias_keys(F.col("country"), c), L.alias_keys(F.col("country"), F.col("fields"))).alias("aliases"), L.is_unsafe_partial(L.kind(c), F.col("fields")).alias("unsafe"), X.hash_split(F.concat_ws("|", F.lit("seed"), S.group_key(F.col("country"), F.col("text"), c))).alias("own")).collect()
    old, held = {x.alias: x.split for x in known.collect()}, {x[0] for x in guarded.select(X.identity(F.col("text"))).collect()}
    splits, texts, entities, want, conflicts = {}, {}, set(), {}, set()
    for x in sorted(f, key=lambda x: x.arrival):
        aliases = {*x.aliases, x.grp}
        before = {old[a] for a in aliases if a in old}
        found = {splits[a] for a in aliases if a in splits}
        if not x.fits:
            want[x.id] = "unrepresentable"
        elif x.loose in held:
            want[x.id] = "existing-or-protected"
        elif before - {"train"}:
            want[x.id] = "heldout-group"
        elif len(found) > 1 or (before and found - {"train"}):
            want[x.id] = "split-bridge"
        elif x.unsafe:
            want[x.id] = "unsafe-partial"
        elif x.key in texts or x.entity in entities:
            want[x.id] = "duplicate"
            if x.key in texts and texts[x.key][0] != x.sign:
                conflicts.add(texts[x.key][1])
        else:
            split = "train" if before else next(iter(found), x.own)
            want[x.id], texts[x.key] = split, (x.sign, x.id)
            entities.add(x.entity)
            for a in aliases:
                splits.setdefault(a, split)
    want |= {i: "label-conflict" for i in conflicts}
    assert {i: x.reason or x.split for i, x in out.items()} == want
    assert {"unrepresentable", "existing-or-protected", "heldout-group", "duplicate", "label-conflict", "train"} <= set(want.values())
