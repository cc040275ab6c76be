"""What a released comparison rests on: outcomes by panel, wins and losses of models, failing rows and digests of the tables.

gold: id (unique), panel, text, components; pred: id, model, components. A gold row without a model's prediction counts as
failed by that model, predictions without a gold row count nowhere, and a null panel is a panel of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import score, select, verify


def outcomes(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(id, panel, model, fields, spans, text, gold, predicted): whether a model's fields, as token multisets, and its ordered spans are gold's; spans is null where gold has no offsets."""
    seen = score.answering(gold, pred)
    exact = score.row_outcomes(score.field_outcomes(gold.select("id", "components"), pred, seen)).withColumnRenamed("exact", "fields")
    g = gold.select("id", "panel", "text", F.col("components").alias("gold"))
    p = pred.select("id", F.struct("model", F.col("components").alias("predicted")).alias("p")).repartition(seen[1], "id").groupBy("id").agg(F.collect_list("p").alias("p"))  # one for a model
    j = exact.join(g, "id").join(p, "id", "left")  # by id alone, so that what is dealt out stays where it is
    j = j.select("*", F.explode_outer(F.filter("p", lambda x: x["model"] == F.col("model"))).alias("of")).select("*", "of.predicted")
    placed = F.forall("gold", lambda s: s["start"].isNotNull())
    spans = F.when(placed, F.coalesce(F.col("gold") == F.col("predicted"), F.lit(False)))
    return j.select("id", "panel", "model", "fields", spans.alias("spans"), "text", "gold", "predicted")


def panels(outcomes: DataFrame) -> DataFrame:
    """(panel, model, rows, fields, spans, fields_percent, spans_percent): spans_percent over the rows whose gold has offsets."""
    r = outcomes.groupBy("panel", "model").agg(F.count("*").alias("rows"), F.count_if("fields").alias("fields"), F.count_if("spans").alias("spans"), F.count("spans").alias("placed"))
    percent = lambda n, of: F.when(F.col(of) > 0, F.round(100 * F.col(n) / F.col(of), 3)).alias(f"{n}_percent")
    return r.select("panel", "model", "rows", "fields", "spans", percent("fields", "rows"), percent("spans", "placed"))


def flips(outcomes: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(panel, a, b, rows, wins, losses) of each pair of models: rows that only a has right, and only b; models are pivoted by row, so rows shuffle once for all pairs."""
    names = sorted({m for p in pairs for m in p})
    right = lambda m: F.coalesce(F.bool_or(F.when(F.col("model") == m, F.col("fields"))), F.lit(False)).alias(m)
    r = outcomes.where(F.col("model").isin(*names)).groupBy("id", "panel").agg(F.struct(*map(right, names)).alias("m"))
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col("m").getField(a).alias("x"), F.col("m").getField(b).alias("y"))
    e = r.select("panel", F.explode(F.array(*[pair(a, b) for a, b in pairs])).alias("p")).select("panel", "p.*")
    return e.groupBy("panel", "a", "b").agg(F.count("*").alias("rows"), F.count_if(F.col("x") & ~F.col("y")).alias("wins"), F.count_if(~F.col("x") & F.col("y")).alias("losses"))


def failures(outcomes: DataFrame, by: str = "spans", n: int = 50, order: str | Column = "id") -> DataFrame:
    """(panel, model, rn, id, text, gold, predicted): the first n rows of each panel and model that fail."""
    wrong = outcomes.where(~F.col(by))
    rank = F.col(order) if isinstance(order, str) else order
    return select.top_n(wrong, ["panel", "model"], [rank, F.col("id")], n).select("panel", "model", "rn", "id", "text", "gold", "predicted")


def field_map(components: Column) -> Column:
    """Sorted (label, value): the normalised parts of each label in order, joined by blanks."""
    labels = F.array_sort(F.array_distinct(F.transform(components, lambda s: s["label"])))
    value = lambda k: F.array_join(F.filter(F.transform(F.filter(components, lambda s: s["label"] == k), lambda s: X.canonical_strict(s["raw"])), lambda v: v != ""), " ")
    return F.transform(labels, lambda k: F.struct(k.alias("label"), value(k).alias("value")))


def teacher_report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(country, every, rows, exact_field_map, accuracy) of one parser by the normalised content of its fields, which says nothing of spans; gold: id, country, components; pred: id, components.

    ``every`` marks the row over all countries.
    """
    j = gold.select("id", "country", field_map(F.col("components")).alias("g")).join(pred.select("id", field_map(F.col("components")).alias("p")), "id", "left")
    ok = j.select("country", F.coalesce(F.col("g") == F.col("p"), F.lit(False)).alias("ok"))
    r = ok.groupingSets([[F.col("country")], []], "country").agg((F.grouping("country") == 1).alias("every"), F.count("*").alias("rows"), F.count_if("ok").alias("exact_field_map"))
    return r.select("country", "every", "rows", "exact_field_map", (F.col("exact_field_map") / F.col("rows")).alias("accuracy"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, low, high) of released tables: counts and sums of row digests, which no order or partitioning of rows changes; an empty table has sums of 0."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias(c)
    out = None
    for name, df in tables.items():
        one = verify.fingerprints(df, df.columns[:1]).agg(F.count("*").alias("rows"), total("low"), total("high")).select(F.lit(name).alias("name"), "rows", "low", "high")
        out = one if out is None else out.union(one)
    return out


def released(gold: DataFrame, pred: DataFrame, pairs: list[tuple[str, str]], n: int = 15) -> dict[str, DataFrame]:
    """The tables of a release: inputs, predictions, panels, flips, failures, and a manifest of the others' digests."""
    o = outcomes(gold, pred)
    out = {"inputs": gold, "predictions": pred.join(gold.select("id"), "id", "left_semi"), "panels": panels(o), "flips": flips(o, pairs), "failures": failures(o, "fields", n)}
    return out | {"manifest": manifest(out)}
