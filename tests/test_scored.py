"""Gold and predictions are dealt out once, by id, into as many tasks as their rows need."""

from pyspark.sql import functions as F

from quillspan.functions.spans import SPANS
from quillspan.operators import evidence, score


def part(label, raw):
    return (label, 0, 1, raw)


def sides(spark, n):
    gold = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("panel"), F.lit("x").alias("text"), F.array(F.struct(F.lit("city").alias("label"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("x").alias("raw"))).alias("components"))
    return gold, gold.select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), "components")


def test_outcomes_have_tasks_by_rows(spark, monkeypatch):
    """More tasks than spark.sql.shuffle.partitions (4 here), and no exchange between the outcomes and their rows."""
    monkeypatch.setattr(score, "SCORED", 50)
    gold, pred = sides(spark, 200)
    rows = score.row_outcomes(score.field_outcomes(gold, pred))
    got = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_if("exact").alias("exact")).collect()
    assert len(got) > 8 and max(r["n"] for r in got) < 100 and sum(r["n"] for r in got) == sum(r["exact"] for r in got) == 400
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1


def test_evidence_stays_where_rows_were_dealt(spark, monkeypatch):
    monkeypatch.setattr(score, "SCORED", 50)
    got = evidence.outcomes(*sides(spark, 200)).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_if(F.col("fields") & F.col("spans")).alias("exact")).collect()
    assert len(got) > 8 and sum(r["n"] for r in got) == sum(r["exact"] for r in got) == 400


def test_outcomes_of_odd_rows(spark):
    """Null ids and models meet nothing, null parts count nowhere, rows of one id count together, a bare row that a model leaves bare is right."""
    gold = [("1", [part("city", "b A"), part("city", "a")]), ("2", None), ("3", [part("category", "x"), part("city", None)]), (None, [part("city", "a")]), ("4", [part("city", "a")]), ("4", [part("city", "b")])]
    pred = [("1", "m", [part("city", "a a b")]), ("2", "m", [part("road", "r")]), (None, "m", [part("city", "a")]), ("4", "m", [part("city", "B a")]), ("5", None, [part("city", "a")])]
    o = score.field_outcomes(spark.createDataFrame(gold, f"id string, components {SPANS}"), spark.createDataFrame(pred, f"id string, model string, components {SPANS}"))
    got = {tuple(r) for r in o.where("model = 'm'").collect()}
    assert got == {
        ("1", "m", "city", True, True, True), ("2", "m", "street_address", False, True, False), ("3", "m", None, False, False, True),
        (None, "m", "city", True, False, False), (None, "m", "city", False, True, False), ("4", "m", "city", True, True, True),
    }
    odd = sorted((r.id or "", r.field or "", r.in_gold, r.in_pred, r.correct) for r in o.where("model is null").collect())
    assert odd == [("", "city", True, False, False), ("1", "city", True, False, False), ("2", "", False, False, True), ("3", "", False, False, True), ("4", "city", True, False, False), ("5", "city", False, True, False)]
