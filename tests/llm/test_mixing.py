"""Mixing against resharing by hand, bisected multipliers and the bounds that whole copies must keep."""

import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.llm.op12_mixing import mix
from quillspan.llm.store import Scratch

ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (None, "one two three", "a"), (4, "w " * 40, None), (None, "x y", None), (None, None, None), (5, "é\u00a0b c\x0bd", ""),
    (5, "é\u00a0b c\x0bd", ""), (6, " lead and trail \r\n", "Z"), (7, "long " * 30000, "zz"), (8, "tiny", "zz"), (9, "", "empty"),
]


def rows(n=600):
    g = np.random.Generator(np.random.Philox(5))
    hot = [(1000 + i, "same words here again", "hot") for i in range(n)]  # one large class
    return ODD + hot + [(3000 + i, "w " * int(g.integers(1, 400)), f"s{i % 7}") for i in range(n)]


def brute_targets(size):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, out, open_ = 1.5 * sum(size.values()), {}, set(order)
    while open_:
        rest = total - sum(out.values())
        level = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not above:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: 2.0 * size[s] for s in above}
        open_ -= above
    return out


def tilt(sizes, target):
    lo, hi = -60.0, 60.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(s * min(2.0, math.exp(min(50.0, mid * s))) for s in sizes) < target else (lo, mid)
    return lo


def test_mix(spark, monkeypatch):
    some = rows()
    docs = spark.createDataFrame(some, "doc_id long, text string, source string")
    for c in ("key", "hash", "times", "rest", "copies", "bucket", "target"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    got = mix(spark, docs.repartition(3)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(str((r.doc_id, r.size, r.source)) for r in got) == sorted(str((d, size(t), s)) for d, t, s in some)
    of = defaultdict(list)
    for _, t, s in some:
        of[s].append(size(t))
    want = brute_targets({s: sum(x) for s, x in of.items()})
    mine = defaultdict(list)
    for r in got:
        assert r.source_size == sum(of[r.source]) and math.isclose(r.target, want[r.source], rel_tol=1e-12) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        mine[r.source].append(r)
    assert sum(want.values()) == pytest.approx(1.5 * sum(map(sum, of.values())))
    for s, own in mine.items():
        left = min((r.size for r in own if r.size and r.copies < 2), default=0)
        assert abs(sum(r.taken for r in own) - want[s]) <= max(1, left / 2 + 1), s
        if 0 < want[s] < 2 * sum(of[s]):
            t = tilt([x for x in of[s] if x], want[s])
            assert all(math.isclose(r.rate, min(2.0, math.exp(t * r.size)), rel_tol=1e-4) for r in own if r.size)
            assert sum(abs(r.copies - r.rate) >= 1.0 for r in own if r.size) <= 0.1 * len(own) + 1  # rounding stays near the rates
    monkeypatch.setattr(Scratch, "BROADCAST_BYTES", 0)
    again = mix(spark, docs.repartition(2, "source")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mix(spark, docs.where("false")).count() == 0
    empty = mix(spark, docs.where("doc_id < 4 and source = 'a'")).collect()
    assert [(r.taken, r.target) for r in empty] == [(0, 0.0)] * 3


def test_no_python_in_the_plan(spark, capsys):
    mix(spark, spark.createDataFrame(ODD, "doc_id long, text string, source string")).explain()
    assert not re.search("Python|Arrow|Pandas", capsys.readouterr().out)
