"""Admission in order against the sequential loops that it must equal."""

import random

import pytest
from pyspark.sql import functions as F

from quillspan.operators import admit


def loop(rows):
    """rows: (rank, sole, shared, own, fixed, barred) by rank -> {rank: (outcome, split)}"""
    claimed, split_of, out = set(), {}, {}
    for rank, sole, shared, own, fixed, barred in sorted(rows):
        sole, shared = {k for k in sole if k is not None}, {k for k in shared if k is not None}
        found = {split_of[k] for k in shared if k in split_of} | ({fixed} if fixed else set())
        if len(found) > 1:
            out[rank] = ("bridge", None)
        elif barred:
            out[rank] = (None, None)
        elif sole & claimed:
            out[rank] = ("duplicate", None)
        else:
            split = fixed or next(iter(found), own)
            claimed |= sole
            for k in shared:
                split_of.setdefault(k, split)
            out[rank] = ("admitted", split)
    return out


SCHEMA = "rank long, sole array<string>, shared array<string>, own string, fixed string, barred boolean"


def some(n, seed, keys):
    r = random.Random(seed)
    pick = lambda p, m: [f"{p}{min(int(r.expovariate(1 / 200)), keys)}" for _ in range(r.randint(0, m))] + [None] * (r.random() < 0.05)
    order = r.sample(range(10 * n), n)
    return [(k, pick("a", 3), pick("b", 2), r.choice(["train", "dev", "test"]), "train" if r.random() < 0.05 else None, r.random() < 0.1) for k in order]


def outcomes(df):
    return {x.rank: (x.outcome, x.split) for x in df.collect()}


def test_in_order_equals_the_loop(spark):
    rows = some(10_000, 7, 1200)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = admit.in_order(df, "rank", "sole", "shared", "own", "fixed", "barred")
    assert got.columns == [*df.columns, "split", "outcome", "round"]
    want = loop(rows)
    assert outcomes(got) == want and {x[0] for x in want.values()} == {"admitted", "duplicate", "bridge", None}
    assert 2 < got.agg(F.max("round")).first()[0] < 60


def test_independent_set_and_hot_keys(spark):
    rows = [(k, s if k % 3 else ["hot", *s], [], None, None, None) for k, s, *_ in some(3000, 3, 2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert outcomes(admit.in_order(df, "rank", "sole")) == {k: (o, None) for k, (o, _) in loop(rows).items()}
    shared = [(i, [], ["hot"], "dev" if i == 0 else "test", None, None) for i in range(2000)]  # all wait for the first, then none for another
    got = admit.in_order(spark.createDataFrame(shared, SCHEMA), "rank", None, "shared", "own")
    assert {(r.outcome, r.split) for r in got.collect()} == {("admitted", "dev")} and got.agg(F.max("round")).first()[0] == 2


def test_chains_empty_tables_and_equal_ranks(spark):
    chain = [(i, [f"k{i}", f"k{i + 1}"], [], None, None, None) for i in range(8)]
    got = outcomes(admit.in_order(spark.createDataFrame(chain, SCHEMA), "rank", "sole"))
    assert [got[i][0] for i in range(8)] == ["admitted", "duplicate"] * 4
    none = spark.createDataFrame([], SCHEMA)
    assert admit.in_order(none, "rank", "sole", "shared", "own").count() == 0
    bare = spark.createDataFrame([(1, [], [], "dev", None, None), (2, None, [None], "dev", "test", None), (3, [], [], "dev", None, True)], SCHEMA)
    assert outcomes(admit.in_order(bare, "rank", "sole", "shared", "own", "fixed", "barred")) == {1: ("admitted", "dev"), 2: ("admitted", "test"), 3: (None, None)}


def walk(rows, caps, per_group):
    used, seen, keep = {}, {}, []
    for r, q, g, f in sorted(rows, key=lambda x: x[0]):
        k = (q, bool(f))
        if used.get(k, 0) < caps[0 if f else 1] and seen.get(g, 0) < per_group:
            used[k], seen[g] = used.get(k, 0) + 1, seen.get(g, 0) + 1
            keep.append(r)
    return keep


@pytest.mark.parametrize("head", [admit.HEAD, 3])
def test_joint_caps_equal_the_walk(spark, monkeypatch, head):
    monkeypatch.setattr(admit, "HEAD", head)
    r = random.Random(11)
    n = 4000 if head > 3 else 100
    rows = [(k, r.choice([None, "a", "b", "c", "c", "c"]), r.choice([None, *range(n // 8)]), r.choice([True, True, False, None])) for k in r.sample(range(10 * n), n)]
    df = spark.createDataFrame(rows, "r long, q string, g long, f boolean").repartition(3)
    for caps, per_group in (((n // 16, n // 40), 4), ((n, 2), 2)):
        got = admit.joint_caps(df, "r", "q", "g", "f", caps, per_group)
        assert sorted(x.r for x in got.collect()) == walk(rows, caps, per_group)
    assert admit.joint_caps(df.where("false"), "r", "q", "g", "f").count() == 0


def test_most_rows_never_enter_a_round(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, [f"a{r.randrange(200)}", f"b{r.randrange(200)}"], [], None, None, None) for k in r.sample(range(10**6), 12_000)]
    written, cut = [], admit.Tables.cut

    def counted(self, df, name, **metrics):
        table, seen = cut(self, df, name, **metrics)
        written.append((name, seen["rows"]))
        return table, seen

    monkeypatch.setattr(admit.Tables, "cut", counted)
    got = outcomes(admit.in_order(spark.createDataFrame(rows, SCHEMA), "rank", "sole"))
    assert got == {k: (o, None) for k, (o, _) in loop(rows).items()}
    assert sum(n for name, n in written if name != "rows") < len(rows)  # of 24,000 pairs of a row and a key
