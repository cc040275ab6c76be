"""Hard negatives against all pairs, on vectors whose bounds discard much and on odd rows."""

import numpy as np
from pyspark.sql import functions as F

from quillspan.llm import op13_hard_negatives as hn


def brute(rows):
    own = [(i, d, (y + 1) % 10 if d % 7 == 0 else y, np.floor(np.array(e, float) * 256).astype(int)) for i, (d, e, y) in enumerate(rows) if d is not None and y is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, d, y, v in own:
        if d % 100:
            continue
        s = [(-int(v @ w), e, z == y) for j, e, z, w in own if j != i and len(w) == len(v)]
        for p, pid, _ in sorted(x for x in s if x[2])[:5]:
            n = sorted(x for x in s if not x[2] and 30 * -p <= 100 * -x[0] <= 90 * -p)[:10]
            out += [(d, pid, k + 1, e, -p, -q) for k, (q, e, _) in enumerate(n)]
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame([(d, None if e is None else [None if x is None else float(x) for x in e], y) for d, e, y in rows], "vec_id long, embedding array<double>, label int")
    for c in ("rid", "v", "goals", "score", "rank", "anchor"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def some(n=700, d=32):
    g = np.random.Generator(np.random.Philox(3))
    mid = g.normal(size=(12, d)) * np.linspace(2, 0.02, d)
    rows = [(i, mid[i % 12] * g.uniform(0.3, 1.2) + g.normal(size=d) * 0.1, int(g.choice([1, 1, 1, 2, 3, 5, 9]))) for i in range(n)]
    rows += [(100, mid[0], 1), (100, mid[0], 1), (101, mid[0], 2), (101, mid[0], 2), (200, mid[3], 7)]  # repeated ids and ties
    rows += [(None, mid[0], 1), (300, None, 1), (400, mid[1], None), (500, [None, *mid[0][1:]], 1), (501, [float("nan")] * d, 1), (502, [float("inf")] * d, 1)]
    rows += [(600, [1.0, 2.0], 1), (601, [1.0, 1.5], 1), (602, [0.7, 1.4], 2), (603, [], 1), (700, [], 1), (701, [], 2), (800, [0.0] * d, 4), (801, [0.0] * d, 4)]
    return rows


def test_hard_negatives(spark, monkeypatch):
    rows = some()
    df = table(spark, rows)
    want = brute(rows)
    got = lambda df: sorted(tuple(r) for r in hn.hard_negatives(spark, df).collect())
    assert len(want) > 150 and got(df) == want
    monkeypatch.setattr(hn, "BLOCK", 3)
    monkeypatch.setattr(hn, "CHUNK_BYTES", 1)
    monkeypatch.setattr(hn, "AXES", 0)
    assert got(df.coalesce(1)) == want
    assert got(df.where("false")) == [] == got(df.where("vec_id is null or label is null")) == got(df.where("vec_id = 200"))


def test_bounds_discard_and_enclose():
    rows = [r for r in some(2000) if r[1] is not None and len(r[1]) == 32 and all(x is not None and np.isfinite(x) for x in r[1])]
    v = np.floor(np.stack([r[1] for r in rows]).astype(float) * 256).astype(np.int64)
    rotation = hn.axes(list(v))[32]
    side = hn.Side(v, rotation)
    score = v @ v.T
    for step, k in enumerate(side.steps):
        near, off = side.r[:, :k] @ side.r[:, :k].T, np.outer(side.rest[step], side.rest[step]) + np.outer(side.norm, side.norm)
        assert (np.abs(score - near) <= off).all()
    n = len(v)
    w = hn.Windows(hn.part(side, np.arange(20)), np.zeros(20, np.int64), np.arange(20), np.full((20, 1), hn.LEAST), np.full((20, 1), hn.MOST), 5, True)
    w.feed(side, np.zeros(n, np.int64), np.arange(n), np.arange(n))
    assert w.left[0] == 20 * (n - 1) and w.left[-2] < 0.5 * w.left[0]
    for i in range(20):
        best = sorted((-score[i, j], j) for j in range(n) if j != i)[:5]
        assert [(-s, j) for s, j in best] == [(s, j) for a, s, j in zip(w.at.tolist(), w.score.tolist(), w.id.tolist()) if a == i]
