"""Cross-tokenizer alignment against whole-text calls of both libraries and a token-by-token definition."""

import collections
import hashlib

import pytest
from pyspark.sql import functions as F

from quillspan.llm import op11_alignment as al

ROWS = [
    (1, "foo  bar\n baz it's 12 <|endoftext|> <s></s> x"), (2, None), (3, ""), (4, " "), (5, "  "), (6, "a\u2581b"), (7, "日本語 テキスト é ü  x\u3000 y\x85 z"),
    (8, "tab\t\t x \n\n  y   "), (9, "foo "), (10, "\x00 nul \x00x"), (11, "long " * 2000), (12, "x" * 5000), (None, "foo bar"), (1, "foo  bar\n baz"),
    (13, "🏠é中 " * 60), (14, "\ufeffabc \u200b d́ e"), (15, "a\x1c b\x1f c   d\r\r e\r f;\r g"), (16, "it's  'sx ' s 've we'll"), (17, "\u2581"), (18, "\n"),
    (19, "x\n"), (20, "ſ ﬁ Å Å"), (21, "one" + " " * 6000 + "two" + "\n" * 5000 + " three"), (22, "ab" * 3000 + " " + "the " * 3),
]


@pytest.fixture(scope="module")
def libs():
    from tokenizers import Tokenizer

    t = al.Tokenizers()
    lib = Tokenizer.from_file(t.a_path)
    lib.encode_special_tokens = True
    return t, lib


def brute(libs, rows):
    t, lib = libs
    out, count = [], collections.Counter()
    for d, text in rows:
        a, b = (lib.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)) if text else ([], [])
        if b"".join(t.a_bytes[i] for i in a) != (" " + (text or "")).encode() or b"".join(t.b_bytes[i] for i in b) != (" " + (text or "")).encode():
            out.append((d, 0, 0, 0, [], ""))
            continue
        ends = []
        for ids, of in ((a, t.a_bytes), (b, t.b_bytes)):
            p, e = 0, {}
            for i in ids:
                p += len(of[i])
                e[p] = i
            ends.append(e)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, rest = [], [list(e.items())[::-1] for e in ends]
        for c in cuts:
            own = []
            for r in rest:
                own.append([])
                while r and r[-1][0] <= c:
                    own[-1].append(str(r.pop()[1]))
            groups.append("|".join(map(",".join, own)))
        links = [(ends[0][c], ends[1][c]) for c in cuts]
        count.update(links)
        out.append((d, len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return sorted(str((d, a, b, g, len(x), sum(count[k] == best[k[1]] for k in x), sum(count[k] for k in x), h)) for d, a, b, g, x, h in out)


def test_alignment(spark, sf, libs, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    for c in ("pairs", "times", "count", "salt", "n_a", "n"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    got = lambda df: sorted(str(tuple(r)) for r in al.cross_alignment(spark, df).collect())
    want = brute(libs, ROWS)
    assert got(docs) == want and sum("''" in x for x in want) == 4
    assert got(docs.where("false")) == []
    assert got(docs.where("text is null or text = ''")) == ["(2, 0, 0, 0, 0, 0, 0, '')", "(3, 0, 0, 0, 0, 0, 0, '')"]
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(whole) == brute(libs, [tuple(r) for r in whole.select("doc_id", "text").collect()])


def test_alignment_forgets(libs, monkeypatch):
    monkeypatch.setattr(al, "KEPT", 0)
    seg = al.Segments(libs[0])
    for _ in range(2):
        which = seg.find(b" ab cd", [0, 3], [3, 6])
        assert [seg.tokens(which, k)[0].tolist() for k in (0, 1)] == [libs[1].encode(" ab cd").ids, libs[0].b.encode("ab cd")]


def test_links_of_tokens_without_bytes():
    import numpy as np

    a_group, b_group, i, j = al.align(np.array([1, 0, 2, 1]), np.array([1, 1, 1, 1, 0]))
    assert a_group.tolist() == [0, 0, 1, 2] and b_group.tolist() == [0, 1, 1, 2, 2]
    assert list(zip(i.tolist(), j.tolist())) == [(0, 0), (1, 0), (2, 2), (3, 3), (3, 4)]
