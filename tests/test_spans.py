"""Goldens of tokenizer, spans, projection, offsets and edits."""

import pytest
from pyspark.sql import functions as F

from quillspan.functions import spans as S
from quillspan.functions import text as X
from quillspan.operators import model, score
from quillspan.plans import catalogue


def one(spark, text, **cols):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize("text, want", [
    ("a\u0085b﻿c", [(0, 1), (2, 3), (3, 4), (4, 5)]),
    ("🏠 12 中", [(0, 1), (2, 4), (5, 6)]),
    ("中国12号", [(0, 1), (1, 2), (2, 4), (4, 5)]),
    ("a\x1cb", [(0, 1), (2, 3)]),
    ("", []), (" ", []),
])
def test_tokens(spark, text, want):
    r = one(spark, text, o=S.token_spans(F.col("text")))
    assert [tuple(x) for x in r.o] == want == model.tokenize(text)


def test_utf16(spark):
    text = F.col("text")
    r = one(spark, "🏠 12 中", o=F.transform(S.token_spans(text), lambda t: F.struct(X.utf16_offset(text, t["start"]), X.utf16_offset(text, t["end"]))))
    assert [tuple(x) for x in r.o] == [(0, 2), (3, 5), (6, 7)]


def test_limits(spark):
    for text in ("a" * 65, " " * 513, "a " * 129, " ", ""):
        assert not one(spark, text, ok=S.supported(F.col("text"), X.tokens(F.col("text")))).ok
        assert model.encode(text) is None
    assert model.encode("\ud800") is None and model.encode(None) is None
    assert len(model.encode("a" * 64, True)[0][0]) == 64 and len(model.encode(" " + "a" * 64, True)[0][0]) == 65


def spans_of(text, *parts):
    out, at = [], 0
    for label, raw in parts:
        at = text.index(raw, at)
        out.append((label, at, at + len(raw), raw))
        at += len(raw)
    return out


def frame(spark, text, spans):
    return spark.createDataFrame([(text, spans)], f"text string, components {S.SPANS}")


def test_projection(spark):
    text = "Flat 2, Tower A, 10th floor, Main Road, Sector 9, Town, County, State"
    fine = spans_of(text, ("unit", "Flat 2"), ("house", "Tower A"), ("level", "10th floor"), ("road", "Main Road"), ("suburb", "Sector 9"), ("city", "Town"), ("state_district", "County"), ("state", "State"))
    p = lambda: S.project(F.col("text"), F.col("components"))
    got = frame(spark, text, fine).select(p().alias("p")).first().p
    assert [(s.label, s.raw) for s in got] == [("street_address", "Flat 2, Tower A, 10th floor, Main Road"), ("locality", "Sector 9"), ("city", "Town"), ("district", "County"), ("state", "State")]
    assert frame(spark, text, [tuple(s) for s in got]).select(p().alias("p")).first().p == got
    text = "12 Phone Main Road"
    fine = spans_of(text, ("house_number", "12"), ("road", "Main Road"))
    assert len(frame(spark, text, fine).select(p().alias("p")).first().p) == 2


def test_valid(spark):
    good = spans_of("12 Main St", ("house_number", "12"), ("road", "Main St"))
    check = lambda s: frame(spark, "12 Main St", s).select(S.valid(F.col("text"), F.col("components")).alias("v")).first().v
    assert check(good) and check([])
    assert not check(good[::-1]) and not check([("road", 0, 0, "")]) and not check([("road", 3, 99, "Main St")]) and not check([("road", None, 3, "12 ")])


def test_bio(spark):
    text = "a b c d e"
    df = spark.createDataFrame([(text, ["I-city", "I-city", "B-city", "O", "I-state"])], "text string, tags array<string>")
    got = df.select(S.bio_to_spans(F.col("text"), F.col("tags"), S.token_spans(F.col("text"))).alias("s")).first().s
    want = [("city", 0, 3, "a b"), ("city", 4, 5, "c"), ("state", 8, 9, "e")]
    assert [tuple(x) for x in got] == want
    path = [model.TAGS.index(t) for t in ("I-city", "I-city", "B-city", "O", "I-state")]
    assert [tuple(x.values()) for x in model.path_spans(path, model.tokenize(text), text)] == want


def test_targets(spark):
    """Tags of labelled rows, read back as the same spans; a boundary inside a token is refused."""
    text = "12 Main St, Boston"
    o = S.token_spans(F.col("text"))
    tags = S.spans_to_bio(F.col("components"), o)
    good = spans_of(text, ("street_address", "12 Main St"), ("city", "Boston"))
    r = frame(spark, text, good).select(tags.alias("t"), S.bio_to_spans(F.col("text"), tags, o).alias("s")).first()
    assert r.t == ["B-street_address", "I-street_address", "I-street_address", "O", "B-city"] and [tuple(x) for x in r.s] == good
    with pytest.raises(Exception, match="cuts a token"):
        frame(spark, text, [("city", 12, 15, "Bos")]).select(tags.alias("t")).collect()


def test_accuracies(spark):
    a, b = [("city", 0, 1, "a")], [("city", 0, 3, "a b")]
    rows = [(a, a, ["B-city", "O"], ["B-city", "O"]), (a, b, ["B-city", "O"], ["B-city", "I-city"])]
    df = spark.createDataFrame(rows, f"gold {S.SPANS}, pred {S.SPANS}, gold_tags array<string>, pred_tags array<string>")
    assert tuple(score.accuracies(df, 2).first()) == (2, 1, 4, 3, 0.5, 0.25, 0.75)
    assert score.accuracies(df, None).first().all_inputs_accuracy is None and score.accuracies(df.where("false")).first().token_accuracy == 0


def test_gaps(spark):
    df = spark.createDataFrame([(" a\nb c,d\r\ne",)], "text string")
    assert df.select(S.gap_features(F.col("text"), S.token_spans(F.col("text"))).alias("g")).first().g == [" ", "\n", " ", "", "", "\n"]


def test_offsets_of_long_texts(spark):
    """Two million characters end in time, with the offsets of the plain tokenizer; null and blank texts keep their rows."""
    rows = [("ab, 中国\n🏠\x1c12 " * 130_000 + " " * 100_000,), (None,), (" \n",), ("a\rb",)]
    o = S.token_spans(F.col("text"))
    got = spark.createDataFrame(rows, "text string").select(o.alias("o"), S.gap_features(F.col("text"), o).alias("g")).collect()
    assert [tuple(x) for x in got[0].o] == model.tokenize(rows[0][0])
    assert got[0].g == (["", "", " ", "", "\n", " "] + [" ", "", " ", "", "\n", " "] * 129_999)
    assert got[1] == (None, None) and got[2] == ([], []) and got[3].g == ["", "\n"]


def test_gap_features_of_every_document(spark, tmp_path):
    rows = [(1, "a b\n" * 2000, 8000), (2, "a b", None), (3, "", 0), (4, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in catalogue.QUERIES["gap_features"](spark, str(tmp_path)).select("doc_id", "tokens", "line_breaks", "spaces").collect()}
    assert got == {(1, 4000, 1999, 2000), (2, 2, 0, 1), (3, 0, 0, 0), (4, None, None, None)}


@pytest.mark.parametrize("after, want", [
    ("123 Main St, Boston MA", [(0, "123 Main St"), (13, "Boston")]),
    ("X 123 Main St, Boston", [(2, "123 Main St"), (15, "Boston")]),
    ("123 Main Rd, Boston", [(13, "Boston")]),
    ("", None), ("zzz", []),
])
def test_rebase(after, want):
    text = "123 Main St, Boston"
    spans = [{"label": "street_address", "start": 0, "end": 11, "raw": "123 Main St"}, {"label": "city", "start": 13, "end": 19, "raw": "Boston"}]
    got = S.rebased(spans, text, after)
    assert got is None if want is None else [(s["start"], s["raw"]) for s in got] == want


def test_rebase_column(spark):
    df = frame(spark, "1 A St", [("road", 2, 6, "A St")]).withColumn("after", F.lit("11 A St"))
    assert df.select(S.rebase(F.col("components"), F.col("text"), F.col("after")).alias("r")).first().r[0].start == 3


def test_keys(spark):
    rows = [("Straße 1_A",), ("ﬁn ＡＢ",), (None,)]
    df = spark.createDataFrame(rows, "text string")
    got = df.select(X.identity(F.col("text")), X.key(F.col("text")), X.canonical(F.col("text")), X.identity_strict(F.col("text"))).collect()
    assert got[0][:3] == ("strasse1a", "strasse1_a", "strasse 1_a") and got[1][3] == "finab" and got[2][0] is None
    r = df.select(X.state_code(F.lit("north  carolina")), X.state_code(F.lit("tx")), X.state_code(F.lit("zz")), X.compact_ideographs(F.lit("北 京 a b"))).first()
    assert tuple(r) == ("NC", "TX", "unknown", "北京 a b")


def test_scripts(spark):
    yes, no = ["12 Main", "Straße", "12 Nguyễn", "São, №", "é"], ["Москва", "दिल्ली", "北京", "القاهرة"]
    df = spark.createDataFrame([(x,) for x in yes + no], "t string")
    assert [r[0] for r in df.select(X.is_latin(F.col("t"))).collect()] == [True] * 5 + [False] * 4


def test_split_is_stable_by_street(spark):
    text = lambda n: f"{n} Main Street, Boston"
    rows = [("us", text(n), spans_of(text(n), ("house_number", n), ("road", "Main Street"), ("city", "Boston"))) for n in ("1", "22")]
    df = spark.createDataFrame(rows, f"country string, text string, components {S.SPANS}")
    keys = [r[0] for r in df.select(S.group_key(F.col("country"), F.col("text"), F.col("components"))).collect()]
    assert keys[0] == keys[1]
    splits = spark.range(1000).select(X.hash_split(F.col("id").cast("string")).alias("s")).distinct().count()
    assert splits == 3
