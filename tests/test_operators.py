"""Selection, protection, consolidation, scoring, augmentation, model and streaming."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.functions import spans as S
from quillspan.operators import augment, corpus, model, protect, score, select
from quillspan.plans import catalogue
from quillspan.streaming import latest

C = "label,start,end,raw".split(",")


def test_joint_caps(spark):
    df = spark.createDataFrame([(1, "A", "x", True), (2, "A", "x", True), (3, "A", "y", True), (4, "B", "x", True)], "r int, q string, g string, f boolean")
    kept = select.joint_caps(df, "r", "q", "g", "f", (2, 1), 1)
    assert sorted(x.r for x in kept.collect()) == [1, 3]


def test_joint_caps_by_hand(spark):
    g = random.Random(5)
    rows = [(i, g.choice("AB"), g.choice("xyz"), g.random() < 0.5) for i in range(300)]
    used, seen, want = {}, {}, []
    for r, q, k, f in rows:
        if used.get((q, f), 0) < (7 if f else 5) and seen.get(k, 0) < 4:
            used[q, f], seen[k] = used.get((q, f), 0) + 1, seen.get(k, 0) + 1
            want.append(r)
    df = spark.createDataFrame(rows, "r int, q string, g string, f boolean").repartition(5)
    assert sorted(x.r for x in select.joint_caps(df, "r", "q", "g", "f", (7, 5), 4).collect()) == want


def test_sample_and_require(spark):
    df = spark.range(100).withColumnRenamed("id", "i")
    want = sorted(random.Random(7).sample(range(100), 5))
    assert sorted(r.i for r in select.exact_sample(df, "i", 5, 100, 7).collect()) == want
    with pytest.raises(ValueError):
        select.require(df.withColumn("k", F.col("i") % 30), ["k"], 4)


def test_consolidate(spark):
    rows = [
        (1, "12 Main St", "12mainst", "m1", "a", []), (2, "12 Main St", "12mainst", "m1", "a", []), (3, "P", "p", "m2", "a", ["k"]), (4, "Q", "q", "m2", "b", []),
        (5, "R", "r", "m3", "a", []), (6, "R", "r", "m3", "b", []), (7, "S", "s", "m4", "a", []), (8, "T", "t", "m4", "b", []),
    ]
    df = spark.createDataFrame(rows, "id int, text string, loose string, model_input string, signature string, street_keys array<string>")
    prot = spark.createDataFrame([("zzz", ["k"])], "loose string, street_keys array<string>")
    got = {r.id: r.reason for r in corpus.consolidate(df, prot).collect()}
    assert got == {1: None, 2: "duplicate", 3: "protected", 4: "protected", 5: "exact-label-conflict", 6: "exact-label-conflict", 7: "model-input-conflict", 8: "model-input-conflict"}


def test_coverage_of_every_row(spark, tmp_path):
    """All customers and suppliers count, whatever their keys; nations without any have zeros."""
    tables = {
        "nation": ([(0, "A"), (1, "B"), (2, "C")], "n_nationkey long, n_name string"),
        "customer": ([(1, 0, "ab"), (2, 0, "é"), (97, 0, None), (3, 1, "x")], "c_custkey long, c_nationkey long, c_name string"),
        "supplier": ([(1, 0), (5, 0), (7, None)], "s_suppkey long, s_nationkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = catalogue.QUERIES["coverage"](spark, str(tmp_path)).collect()
    assert sorted((r.country, r.files, r.bytes, r.audited) for r in got) == [("A", 3, 4, 2), ("B", 1, 1, 0), ("C", 0, 0, 0)]


def test_no_or_join(spark):
    a = spark.createDataFrame([(1, "x", "p"), (2, "y", "q"), (3, "z", "r")], "id int, k string, l string")
    b = spark.createDataFrame([("x", "zz"), ("n", "q")], "k string, l string")
    out = protect.without(a, b, ["k"], ["l"])
    assert [r.id for r in out.collect()] == [3]
    assert "NestedLoop" not in out._jdf.queryExecution().toString()


def spans(*parts):
    return [(label, 0, len(raw), raw) for label, raw in parts]


def test_multiset_scoring(spark):
    gold = spark.createDataFrame([("1", spans(("road", "Main, Road"), ("house_number", "12"), ("city", "Town"))), ("2", spans(("city", "Town")))], f"id string, components {S.SPANS}")
    pred = spark.createDataFrame([("1", "m", spans(("street_address", "road 12 main"), ("city", "TOWN"))), ("2", "m", spans(("city", "Town"), ("city", "Town")))], f"id string, model string, components {S.SPANS}")
    o = score.field_outcomes(gold, pred)
    assert {r.id: r.exact for r in score.row_outcomes(o).collect()} == {"1": True, "2": False}


def test_missing_predictions_count(spark):
    """A gold row that a model, or both, left out is missed in every figure."""
    city = spans(("city", "Town"))
    gold = spark.createDataFrame([("1", city), ("2", city), ("3", city)], f"id string, components {S.SPANS}")
    pred = spark.createDataFrame([("1", "a", city), ("2", "a", city), ("1", "b", city)], f"id string, model string, components {S.SPANS}")
    o = score.field_outcomes(gold, pred)
    assert {(r.model, r.correct, r.predicted, r.gold) for r in score.field_report(o, ["model"]).collect()} == {("a", 2, 2, 3), ("b", 1, 1, 3)}
    x = score.row_outcomes(o)
    assert score.paired(x.where("model = 'a'"), x.where("model = 'b'")).first().asDict() == {"both": 1, "only_a": 1, "only_b": 0, "neither": 1, "unmatched": 0}


def test_wilson(spark):
    low, high = score.wilson(F.lit(828), F.lit(842))
    r = spark.range(1).select(low, high).first()
    assert (round(r[0], 2), round(r[1], 2)) == (97.23, 99.01)


def panel(n, of=200):
    return {"us": {"rows": of, "exact": n}}


def test_gate(spark):
    def table(panels):
        return spark.createDataFrame([(p, c, v["rows"], v["exact"]) for p, some in panels.items() for c, v in some.items()], "panel string, country string, rows int, exact int")

    base = {k: panel(180) for k in ("clean", "old-us", "new-us", "partial", "reordered", "combined")}
    now = base | {"clean": panel(179), "partial": panel(120), "reordered": panel(140), "combined": panel(160)}
    got = score.gate(table(now), table(base)).first()
    assert got["eligible"] and round(got["score"], 3) == 0.7 and round(got["macro"], 3) == 0.895
    assert score.gate(table(now | {"new-us": panel(177)}), table(base)).first()["reasons"] == ["new-us-us-exact"]
    assert score.gate(table(now | {"new-us": panel(180, 201), "old-us": {"gb": {"rows": 5, "exact": 5}}, "clean": panel(170)}), table(base)).first()["reasons"] == ["clean-country-macro", "clean-us-exact", "new-us-us-rows", "old-us-countries"]
    for bad in (now | {"clean": {}}, now | {"clean": panel(0, 0)}):
        with pytest.raises(Exception, match="empty country slice"):
            score.gate(table(bad), table(base)).collect()


ROW = "12 Main Street, Boston, MA 02110"
PARTS = [{"label": n, "start": ROW.index(x), "end": ROW.index(x) + len(x), "raw": x} for n, x in (("street_address", "12 Main Street"), ("city", "Boston"), ("state", "MA"), ("postcode", "02110"))]
FINE = [{"label": n, "start": ROW.index(x), "end": ROW.index(x) + len(x), "raw": x} for n, x in (("house_number", "12"), ("road", "Main Street"), ("city", "Boston"), ("state", "MA"), ("postcode", "02110"))]


def good(text, parts):
    at = 0
    for p in parts:
        assert at <= p["start"] < p["end"] and text[p["start"] : p["end"]] == p["raw"]
        at = p["end"]


def annotated(spark, rows):
    return spark.createDataFrame(rows, f"id string, text string, components {S.SPANS}, source_components {S.SPANS}")


def test_omissions(spark):
    got = augment.partials(annotated(spark, [("a", ROW, PARTS, FINE)])).collect()
    for r in got:
        good(r.text, r.components)
    assert {r.text for r in got} == {
        "12 Main Street Boston MA", "12 Main Street Boston 02110", "12 Main Street", "12 Main Street Boston", "Boston MA", "Boston 02110", "Main Street Boston MA 02110",
    } and len(got) == 7
    alone = annotated(spark, [("b", "Boston, MA", [dict(PARTS[1], start=0, end=6), dict(PARTS[2], start=8, end=10)], []), ("c", "x", [], [])])
    assert augment.partials(alone).count() == 0  # one administrative field would be left


def test_structural_variants(spark):
    rows = [(str(i), ROW, PARTS, FINE) for i in range(80)] + [("loose", "x " + ROW, [dict(p, start=p["start"] + 2, end=p["end"] + 2) for p in PARTS], []), ("one", "Boston", [dict(PARTS[1], start=0, end=6)], [])]
    df = annotated(spark, rows)
    got = augment.structurals(df, None).collect()
    assert {r.kind for r in got} >= {"original", "partial", "reordered", "combined"} and len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, augment.structurals(df, None).collect()))
    every = {r.id: r for r in augment.structurals(df).collect()}
    assert len(every) == 3 * len(rows)
    for r in every.values():
        good(r.text, r.components)
    assert {every[f"loose:{m}"].kind for m in ("partial", "reordered", "combined")} == {"unannotated-text-fallback"}
    assert every["one:partial"].kind == "no-partial-fallback" and every["one:reordered"].kind == "unsafe-reorder-fallback" and every["one:reordered"].text == "Boston"
    moved = [every[f"{i}:reordered"] for i in range(80)]
    assert all(r.kind == "reordered" and [s.label for s in r.components] != [p["label"] for p in PARTS] and len(r.components) == 4 for r in moved) and len({r.text for r in moved}) > 6
    # omissions that lead to a blocked key are never chosen
    keys = augment.partials(df.where("id = '0'")).select(augment.ambiguity_key(F.col("components")).alias("blocked_key"))
    assert {r.kind for r in augment.structurals(df.where("id in ('0', '1')"), ("partial",), keys).collect()} == {"no-partial-fallback"}


def test_ambiguous_keys_and_panels(spark):
    other = [dict(PARTS[1], label="state"), *PARTS[2:]]
    df = annotated(spark, [("a", "Boston", [dict(PARTS[1], start=0, end=6)], []), ("b", "Boston", [dict(PARTS[1], label="state", start=0, end=6)], []), ("c", "Boston", [dict(PARTS[1], start=0, end=6)], [])])
    assert augment.ambiguous_keys(df).count() == 1 and augment.ambiguous_keys(df.where("id <> 'b'")).count() == 0 and other
    rows = annotated(spark, [(str(i), ROW, PARTS, FINE) for i in range(30)]).withColumns({"country": F.lit("us"), "group_key": (F.col("id").cast("int") % 20).cast("string")})
    got = augment.panels(rows, "2027", per_country=10).collect()
    assert {r.slice for r in got} == {"partial", "reordered", "combined", "zip-first"} and all(r.text != ROW for r in got)
    assert {r.text for r in got if r.slice == "zip-first"} == {"02110, 12 Main Street, Boston, MA"} and len({r.id for r in got if r.slice == "zip-first"}) == 10


def test_stress_and_layouts(spark):
    df = annotated(spark, [(str(i), ROW, PARTS, FINE) for i in range(60)])
    got = augment.stress(df.where("id = '3'")).collect()
    for r in got:
        good(r.text, r.components)
    want = {", ".join(x) for x in itertools.permutations([p["raw"] for p in PARTS])}
    assert {r.text for r in got if r.mode == "permutations"} == want and sum(r.mode == "permutations" for r in got) == 24
    subsets = {", ".join(x) for n in (1, 2, 3) for x in itertools.combinations([p["raw"] for p in PARTS], n)}
    assert {r.text for r in got if r.mode == "partial"} == subsets and sum(r.mode == "partial" for r in got) == 14
    assert [r.text for r in got if r.mode == "formatting"][1] == "12 Main Street , Boston , MA , 02110"
    out = augment.layouts(df).collect()
    for r in out:
        good(r.text, r.components)
        assert r.kind.endswith("whole") == (len(r.components) == len(PARTS))
    assert len({r.kind.split("/")[0] for r in out}) == 3 and 2 <= sum(not r.kind.endswith("whole") for r in out) <= 25


def test_upsert_and_variant_outcomes(spark):
    old = spark.createDataFrame([("a", "train", 1), ("b", "dev", 1)], "key string, split string, n int")
    new = spark.createDataFrame([("a", "dev", 2), ("b", "dev", 2), ("c", "train", 2)], "key string, split string, n int")
    got = protect.upsert(old, new, ["key"], F.when(F.col("split") == "train", 1).otherwise(0))
    assert sorted(map(tuple, got.collect())) == [("a", "train", 1), ("b", "dev", 2), ("c", "train", 2)]
    base = spark.createDataFrame([("x:1", True), ("y", False)], "id string, exact boolean")
    v = spark.createDataFrame([("x:1:partial", False), ("y:partial", True), ("y:combined", False), ("z:partial", True)], "id string, exact boolean")
    assert sorted(map(tuple, score.variant_outcomes(v, base).collect())) == [("combined", 0, 0, 0, 1), ("partial", 0, 1, 1, 0)]
    rows = spark.createDataFrame([("us", True), ("gb", False)], "country string, exact boolean")
    assert score.macro(rows, "country", groups=["us", "gb"]).first().macro == 0.5
    with pytest.raises(Exception, match="slice is empty"):
        score.macro(rows, "country", groups=["us", "fr"]).collect()


def test_align(spark):
    df = spark.createDataFrame([
        ("12 MAIN st, Boston", [{"label": "street_address", "raw": "12  main St"}, {"label": "city", "raw": "boston"}]), ("a a", [{"label": "city", "raw": "a"}]), ("a b", [{"label": "city", "raw": "a"}]),
        ("a.b", [{"label": "city", "raw": "a.b"}]), ("axb", [{"label": "city", "raw": "a.b"}]), ("a", [{"label": "odd", "raw": "a"}]), ("b a", [{"label": "city", "raw": "a"}, {"label": "state", "raw": "b"}]),
    ], "text string, parts array<struct<label:string,raw:string>>")
    got = [r.s if r.s is None else [x.raw for x in r.s] for r in df.select(augment.aligned(F.col("text"), F.col("parts")).alias("s")).collect()]
    assert got == [["12 MAIN st", "Boston"], None, None, ["a.b"], None, None, None]
    texts = spark.createDataFrame([("straße x",), ("İ" * 32,), ("don't 12ab",)], "t string")
    up, low, title = ([r[0] for r in texts.select(augment.case_text(F.col("t"), m)).collect()] for m in ("upper", "lower", "title"))
    assert up[0] == "STRASSE X" and low[1] == "İ" * 32 and title[2] == "Don'T 12Ab"


def tiny(seed):
    return {k: v for k, v in model.random_weights(seed).items() if k in ("transitions", "start", "end")}


def path_score(e, path, w):
    step, first = model.allowed()
    tr = (w["transitions"] + step).astype(float)
    s = float(w["start"][path[0]] + first[path[0]] + e[0, path[0]])
    for t in range(1, len(path)):
        s += tr[path[t - 1], path[t]] + e[t, path[t]]
    return s + float(w["end"][path[-1]])


@pytest.mark.parametrize("n", [1, 2, 3])
def test_decoding_by_enumeration(n):
    w = tiny(n)
    e = np.random.Generator(np.random.Philox(n)).standard_normal((n, model.N)).astype(np.float32)
    every = sorted(((path_score(e, p, w), p) for p in itertools.product(range(model.N), repeat=n)), key=lambda x: -x[0])
    assert model.viterbi(e, w) == list(every[0][1])
    for k in (1, 2, 8):
        got = model.kbest(e, w, k)
        assert [list(p) for _, p in every[:k]] == [p for p, _ in got]
        assert np.allclose([s for s, _ in every[:k]], [s for _, s in got], atol=1e-4)
    total = np.logaddexp.reduce([s for s, _ in every])
    assert abs(model.crf_loss(e, list(every[3][1]), w) - (total - every[3][0]) / n) < 1e-3


def test_codec():
    w = model.random_weights(1)
    data, _, _ = model.write_model(w, gap=True)
    back, gap = model.read_model(data)
    assert gap and all((back[k] == w[k]).all() for k in w) and sum(v.size for v in w.values()) == 154446
    data, restored, worst = model.write_model(w, bits=5)
    back, _ = model.read_model(data)
    assert all((back[k] == restored[k]).all() for k in w) and 0 < worst < 0.1
    for bad in (b"GPA2" + data[4:], data[:-1], data + b"\0", b""):
        with pytest.raises(ValueError):
            model.read_model(bad)


def test_parse_ignores_padding_and_order(spark):
    data, _, _ = model.write_model(model.random_weights(2), gap=True)
    w, gap = model.read_model(data)
    texts = ["12 Main St", "", None, "Boston, MA\n02110 USA and more words here", "x" * 65]
    assert model.greedy(np.array([[1.0, 3, 3], [2, 0, 1]])) == [1, 0] and len(model.parse_batch(texts, w, gap, decoder="greedy")) == len(texts)
    alone = [model.parse_batch([t], w, gap)[0] for t in texts]
    assert model.parse_batch(texts, w, gap) == alone
    got = model.parse(spark.createDataFrame([(t,) for t in texts], "text string"), data).collect()
    assert [r.parse.status for r in got] == ["unassessed", "unsupported", "unsupported", "unassessed", "unsupported"]


def test_streaming(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    e.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = latest.event_windows(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    assert spark.table("w").agg(F.sum("n")).first()[0] == e.count()
    q.stop()
    q = latest.each_batch(stream, lambda d: latest.newest(d.select("user_id", "event_id", "event_type"), "user_id", "event_id"), str(tmp_path / "out"), str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == e.select("user_id").distinct().count()


def test_corpora(spark):
    from quillspan.plans import corpora

    lines = []
    for i in range(40):
        text = f"{i} Main Street, Town {i % 20}, VT"
        spans, at = [], 0
        for label, raw in (("house_number", str(i)), ("road", "Main Street"), ("city", f"Town {i % 20}"), ("state", "VT")):
            at = text.index(raw, at)
            spans.append({"label": label, "start": at, "end": at + len(raw), "raw": raw})
        lines.append((str(i), text, "us", spans))
    lines.append(("bad", "x", "us", [{"label": "city", "start": 0, "end": 5, "raw": "x"}]))
    lines.append(("again", "7 main street town 7 VT", "us", []))
    rows = spark.createDataFrame(lines, f"id string, text string, country string, components {S.SPANS}")
    kept = corpora.pilot(rows, rows.where("id = '3'")).collect()
    plain = [r for r in kept if not r.variant]
    assert {r.id for r in plain} == {str(i) for i in range(40)} - {"3"} and {r.split for r in plain} <= {"train", "dev"}
    assert len(kept) - len(plain) == sum(r.split == "train" for r in plain)
    some, counts = corpora.country_pilot(rows.where("id not in ('bad', 'again')"), rows.where("id in ('1', '2')"), ["us"], 30)
    assert some.count() == 30 and counts.first().rows == 30 and counts.first().overlap <= 2
    parsed = spark.createDataFrame([("1", [{"label": "street_address", "raw": "1 main street"}, {"label": "city", "raw": "TOWN 1"}, {"label": "state", "raw": "vt"}]), ("2", [{"label": "city", "raw": "town"}])], "id string, parts array<struct<label:string,raw:string>>")
    got = {r.id: r.reason for r in corpora.pseudo_labels(rows, parsed).collect()}
    assert got == {"1": None, "2": "not-aligned"}
