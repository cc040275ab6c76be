"""Corpus audit and consolidation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions import text as X


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that holds, null if none."""
    return F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules])


def audit(df: DataFrame) -> DataFrame:
    """Adds reason (null: accepted) and type to rows (text, components, country)."""
    spans, toks = F.col("components"), X.tokens(F.col("text"))
    placeholder = F.exists(spans, lambda s: (s["label"] == "road") & X.identity(s["raw"]).isin("ninguno", "sinnombre", "unnamed", "unknown"))
    rules = (
        ("missing-text", F.coalesce(F.trim("text") == "", F.lit(True))),
        ("non-latin", ~X.is_latin(F.col("text"))),
        ("invalid-spans", ~F.coalesce(S.valid(F.col("text"), spans), F.lit(False))),
        ("known-geographic-contamination:Pasir-Gudang-is-in-Johor", (F.col("country") == "sg") & X.identity(F.col("text")).contains("pasirgudang")),
        ("placeholder-road", placeholder),
        ("replacement-character", F.col("text").contains("�")),
        ("unsupported", ~S.supported(F.col("text"), toks)),
    )
    return df.withColumn("reason", first_reason(*rules)).withColumn("type", S.address_type(spans))


def summary(df: DataFrame) -> DataFrame:
    """One row of counts: rows, texts, repeated texts, loose keys with several texts, texts with several labellings."""
    t = df.select("text", X.identity(F.col("text")).alias("loose"), F.to_json(S.signature(F.col("components"))).alias("sig"))
    by_text = t.groupBy("text").agg(F.count("*").alias("n"), F.countDistinct("sig").alias("sigs"), F.first("loose").alias("loose"))
    by_loose = by_text.groupBy("loose").agg(F.count("*").alias("texts"))
    a = by_text.agg(F.sum("n").alias("rows"), F.count("*").alias("texts"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("sigs") > 1).alias("conflicting"))
    return a.crossJoin(by_loose.agg(F.count_if(F.col("texts") > 1).alias("loose_collisions")))


def consolidate(rows: DataFrame, protected: DataFrame) -> DataFrame:
    """Adds reason to rows (id, text, loose, model_input, signature, street_keys); null: kept.

    Precedence: protected (a protected loose key or street key, for all rows of a text, and for all
    rows of a model input with such a row), then one text with several labellings, then one model
    input with several. Of equal (text, signature) the first by id is kept, others are duplicates.
    A null text or model input equals no other, so such a row is held to its own keys alone; null
    signatures equal each other; every row comes back once.
    """
    cols = rows.columns
    r = rows.withColumn("_text", F.coalesce(F.concat(F.lit("="), "text"), F.concat(F.lit("#"), F.col("id").cast("string")), F.lit("")))
    # a row without a model input has a key of its own, so that such rows do not meet in one task
    r = r.withColumn("_model", F.coalesce(F.concat(F.lit("="), "model_input"), F.concat(F.lit("#"), F.col("id").cast("string"))))
    r = r.withColumn("_sign", F.coalesce(F.concat(F.lit("="), F.col("signature").cast("string")), F.lit("")))
    loose = r.join(protected.select("loose").distinct(), "loose", "left_semi").select("_text")
    street = r.select("_text", F.explode("street_keys").alias("_k")).join(protected.select(F.explode("street_keys").alias("_k")).distinct(), "_k", "left_semi").select("_text")
    hit = loose.union(street).distinct().withColumn("_hit", F.lit(True))
    # the first row counts only where a text has one signature, so it is the text's
    texts = r.where("text is not null").groupBy("_text", "_sign").agg(F.min("id").alias("_first")).groupBy("_text").agg((F.count("*") > 1).alias("_exact"), F.min("_first").alias("_first"))
    model = r.where("model_input is not null").select("_model", "_sign").distinct().groupBy("_model").agg((F.count("*") > 1).alias("_other"))
    # joins on one key follow each other, so rows are dealt and sorted once for the texts and once for the model inputs
    r = r.join(hit, "_text", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))).join(texts.hint("shuffle_hash"), "_text", "left")
    hot = r.where("_hit and model_input is not null").select("_model").distinct().withColumn("_p", F.lit(True))
    r = r.join(hot, "_model", "left").join(model.hint("shuffle_hash"), "_model", "left")
    reason = first_reason(("protected", F.coalesce("_p", "_hit")), ("exact-label-conflict", F.col("_exact")), ("model-input-conflict", F.col("_other")), ("duplicate", F.col("id") != F.col("_first")))
    return r.select(*cols, reason.alias("reason"))


def coverage(countries: DataFrame, files: DataFrame, reports: DataFrame) -> DataFrame:
    """(country, files, bytes, audited): reference countries with what there is of each."""
    f = files.groupBy("country").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
    r = reports.groupBy("country").agg(F.sum("rows").alias("audited"))
    return countries.join(f, "country", "left").join(r, "country", "left").na.fill(0, ["files", "bytes", "audited"])
