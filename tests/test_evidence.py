"""Tables of a released comparison."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import evidence

PARTS = "array<struct<label:string,start:int,end:int,raw:string>>"


def parts(*xs):
    return [(label, at, None if at is None else at + len(raw), raw) for label, at, raw in xs]


@pytest.fixture(scope="module")
def tables(spark):
    a, b, c = parts(("road", 0, "Main St"), ("city", 9, "Bonn")), parts(("road", 0, "Ring"), ("city", 6, "Köln")), parts(("city", None, "Rom"))
    gold = spark.createDataFrame([("1", "x", "Main St, Bonn", a), ("2", "x", "Ring, Köln", b), ("3", None, "Rom", c)], f"id string, panel string, text string, components {PARTS}")
    other = parts(("city", 0, "Main St"), ("city", 9, "Bonn"))
    shouted = parts(("road", 0, "RING"), ("city", 6, "KÖLN"))
    pred = spark.createDataFrame([("1", "m", a), ("2", "m", shouted), ("3", "m", c), ("1", "n", other), ("3", "n", parts(("city", 0, "Riga"))), ("9", "n", a)], f"id string, model string, components {PARTS}")
    return gold, pred


def test_panels_and_flips(tables):
    o = evidence.outcomes(*tables)
    got = sorted((tuple(r) for r in evidence.panels(o).collect()), key=str)
    # n says nothing of row 2, whose failure counts; row 3 has no offsets, so no spans to be right about
    assert got == sorted([("x", "m", 2, 2, 1, 100.0, 50.0), ("x", "n", 2, 0, 0, 0.0, 0.0), (None, "m", 1, 1, 0, 100.0, None), (None, "n", 1, 0, 0, 0.0, None)], key=str)
    f = sorted((tuple(r) for r in evidence.flips(o, [("m", "n"), ("n", "m"), ("m", "absent")]).collect()), key=str)
    assert f == sorted([("x", "m", "n", 2, 2, 0), ("x", "n", "m", 2, 0, 2), ("x", "m", "absent", 2, 2, 0), (None, "m", "n", 1, 1, 0), (None, "n", "m", 1, 0, 1), (None, "m", "absent", 1, 1, 0)], key=str)


def test_failures_are_the_first_of_each_panel_and_model(tables):
    o = evidence.outcomes(*tables)
    assert sorted((r.panel, r.model, r.id, r.rn) for r in evidence.failures(o, n=1).collect()) == [("x", "m", "2", 1), ("x", "n", "1", 1)]
    missing = evidence.failures(o).where("id = '2' and model = 'n'").first()
    assert missing.predicted is None and len(missing.gold) == 2


def test_teacher_report_normalises_and_keeps_a_null_country(spark, tables):
    gold = tables[0].select("id", F.col("panel").alias("country"), "components")
    wide = parts(("road", 0, "ＭＡＩＮ"), ("road", 5, "st"), ("city", 9, " bonn "))
    pred = spark.createDataFrame([("1", wide), ("3", parts(("road", 0, "Rom")))], f"id string, components {PARTS}")
    got = {(r.country, r.every): (r.rows, r.exact_field_map) for r in evidence.teacher_report(gold, pred).collect()}
    assert got == {("x", False): (2, 1), (None, False): (1, 0), (None, True): (3, 1)}


def test_manifest_ignores_order_and_sees_every_change(spark, tables):
    gold, pred = tables
    digest = lambda df: tuple(evidence.manifest({"t": df}).first())
    assert digest(gold) == digest(gold.orderBy(F.desc("id")).repartition(3)) == digest(gold.select(*reversed(gold.columns)))
    assert len({digest(x) for x in (gold, gold.union(gold.limit(1)), gold.where("id <> '3'"), gold.withColumn("text", F.upper("text")))}) == 4
    assert digest(gold.where("false"))[1:] == (0, 0, 0)


def test_released_tables_of_nothing(spark, tables):
    gold, pred = tables
    out = evidence.released(gold.where("false"), pred, [("m", "n")])
    assert sorted(out) == ["failures", "flips", "inputs", "manifest", "panels", "predictions"]
    assert {r.name: r.rows for r in out["manifest"].collect()} == dict.fromkeys(["inputs", "predictions", "panels", "flips", "failures"], 0)
    assert {r.name: r.rows for r in evidence.released(gold, pred, [("m", "n")])["manifest"].collect()} == {"inputs": 3, "predictions": 5, "panels": 4, "flips": 2, "failures": 3}
