"""Consolidation deals rows out once for their texts and once for their model inputs."""

from pyspark.sql import functions as F

from quillspan.operators import corpus

COLUMNS = "id long, text string, loose string, model_input string, signature string, street_keys array<string>"


def test_rows_are_dealt_once_for_each_key(spark):
    rows = spark.range(0).select("id", *[F.lit("x").alias(c) for c in ("text", "loose", "model_input", "signature")], F.array(F.lit("k")).alias("street_keys"))
    out = corpus.consolidate(rows, rows.select("loose", "street_keys"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 4  # texts and model inputs, each with what is protected and what conflicts
    assert "count(distinct" not in plan and "Expand" not in plan


def test_rows_without_a_model_input_protect_no_other(spark):
    """Rows of one id without a model input have a key for the join alone; a first row counts where a text has one signature."""
    rows = [
        (1, "a", "guarded", None, "s", []), (1, "b", "l1", None, "s", []), (2, "c", "l2", "m", "s", []), (3, "c", "l2", "#1", "s", []), (4, "d", "l3", "m2", "s", []), (5, "d", "l3", "m3", "t", []),
        (6, None, "l4", "m4", "s", []), (6, None, "l4", "m5", "s", []), (None, "e", "guarded", None, "s", []), (None, "f", "l5", None, "s", []), (7, "g", "l6", "m6", "s", []), (8, "h", "guarded", "m6", "s", []),
    ]
    r = spark.createDataFrame(rows, COLUMNS)
    got = {(x.id, x.text, x.model_input): x.reason for x in corpus.consolidate(r, spark.createDataFrame([("guarded", [])], "loose string, street_keys array<string>")).collect()}
    conflict = "exact-label-conflict"
    assert got == {
        (1, "a", None): "protected", (1, "b", None): None, (2, "c", "m"): None, (3, "c", "#1"): "duplicate", (4, "d", "m2"): conflict, (5, "d", "m3"): conflict,
        (6, None, "m4"): None, (6, None, "m5"): None, (None, "e", None): "protected", (None, "f", None): None, (7, "g", "m6"): "protected", (8, "h", "m6"): "protected",
    }
