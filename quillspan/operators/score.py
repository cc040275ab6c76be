"""Evaluation analytics as grouped DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import spans as S
from ..functions import text as X
from ..sources.shared import ROWS, Tables, dealt

Z = 1.95996398454


TOKENS = "array<struct<field:string,tokens:array<string>>>"
SCORED = 8 * ROWS  # gold and predicted rows of a task: what is scored of a row is small


def tokenised(components: Column) -> Column:
    """(field, tokens) of the parts that belong to a field and hold a token; no array counts as an empty one."""
    each = F.transform(components, lambda c: F.struct(S.field_of(c["label"]).alias("field"), X.scorer_tokens(c["raw"]).alias("tokens")))
    return F.coalesce(F.filter(each, lambda c: c["field"].isNotNull() & (F.size(c["tokens"]) > 0)), F.array().cast(TOKENS))


def multiset(tokens: Column) -> Column:
    """The tokens of all parts as one sorted array, comparable by value."""
    return F.array_sort(F.flatten(F.collect_list(tokens)))


def field_lists(df: DataFrame, id: str = "id", components: str = "components") -> DataFrame:
    """(id, field, tokens): the token multiset of each projected field."""
    c = dealt(df.select(id, tokenised(F.col(components)).alias("c")), id, rows=SCORED)
    return c.select(id, F.explode("c").alias("c")).groupBy(id, F.col("c.field").alias("field")).agg(multiset(F.col("c.tokens")).alias("tokens"))


def answering(gold: DataFrame, pred: DataFrame) -> tuple[Column, int]:
    """(the models as an array, tasks of gold and predictions together), from one count of each."""
    seen = pred.groupBy("model").count().collect()  # a few
    kind = pred.schema["model"].dataType
    models = F.array(*[F.struct(F.lit(r["model"]).cast(kind).alias("model")) for r in seen]) if seen else F.array().cast(ArrayType(StructType([StructField("model", kind)])))
    return models, max(1, -(-(gold.count() + sum(r["count"] for r in seen)) // SCORED))


def field_outcomes(gold: DataFrame, pred: DataFrame, seen: tuple[Column, int] | None = None) -> DataFrame:
    """(id, model, field, in_gold, in_pred, correct): the fields of gold and prediction compared as multisets.

    Every model answers for every gold row: one without a prediction is missed. Where neither gold
    nor prediction has a field, one correct outcome without a field stands for the row.

    Both sides are dealt out once, by id alone, and met by grouping: neither the multisets nor what
    is grouped by id and model later is shuffled again, and a task's rows do not grow with the table.
    """
    models, tasks = seen or answering(gold, pred)
    side = lambda df, model, own: df.select("id", model.alias("model"), F.lit(own).alias("own"), tokenised(F.col("components")).alias("c"))
    both = side(gold, F.lit(None).cast(pred.schema["model"].dataType), True).union(side(pred, F.col("model"), False)).repartition(tasks, "id")
    # a part without a field tells that gold has none, or that a prediction has some
    none, bare = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("array<string>").alias("tokens"))), F.size("c") == 0
    parts = F.when(F.col("own") & bare, none).when(F.col("own") | bare, F.col("c")).otherwise(F.concat("c", none))
    of = F.when(F.col("own"), models).otherwise(F.array(F.struct("model")))
    e = both.select("id", "own", parts.alias("c"), F.explode(of).alias("m"))
    e = e.select("id", "m.model", "own", F.explode("c").alias("c")).select("id", "model", "own", "c.*")
    alone = F.when(F.col("id").isNull() | F.col("model").isNull(), F.col("own")).alias("alone")  # nulls meet nothing
    mine = lambda own: (multiset(F.when(F.col("own") == own, F.col("tokens"))), F.count_if(F.col("own") == own) > 0)
    (g, in_gold), (p, in_pred) = mine(True), mine(False)
    j = e.groupBy("id", "model", "field", alone).agg(g.alias("g"), p.alias("p"), in_gold.alias("in_gold"), in_pred.alias("in_pred"))
    there = F.col("field").isNotNull()
    j = j.where(there | (F.col("in_gold") & ~F.col("in_pred")))
    correct = F.when(there, F.col("in_gold") & F.col("in_pred") & (F.col("g") == F.col("p"))).otherwise(True)
    return j.select("id", "model", "field", (there & F.col("in_gold")).alias("in_gold"), (there & F.col("in_pred")).alias("in_pred"), correct.alias("correct"))


def f1(tp: Column, predicted: Column, gold: Column) -> Column:
    return F.when(predicted + gold == 0, F.lit(None)).otherwise(2.0 * tp / (predicted + gold))


def field_report(outcomes: DataFrame, by: list[str] = ("model", "field")) -> DataFrame:
    ints = lambda c: F.sum(F.col(c).cast("long"))
    r = outcomes.where("field is not null").groupBy(*by).agg(ints("correct").alias("correct"), ints("in_pred").alias("predicted"), ints("in_gold").alias("gold"))
    return r.withColumn("f1", f1(F.col("correct"), F.col("predicted"), F.col("gold")))


def row_outcomes(outcomes: DataFrame) -> DataFrame:
    """(id, model, exact): every field of either side agrees."""
    return outcomes.groupBy("id", "model").agg(F.min("correct").alias("exact"))


def wilson(correct: Column, total: Column, z: float = Z) -> tuple[Column, Column]:
    """95 % interval of a rate, in percent."""
    p = correct / total
    center = (p + z * z / (2 * total)) / (1 + z * z / total)
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)
    return 100 * (center - half), 100 * (center + half)


def span_prf(df: DataFrame) -> DataFrame:
    """(label, tp, fp, fn) from exact spans; df: gold, pred span arrays."""
    bare = lambda c: F.transform(c, lambda s: F.struct(s["label"].alias("label"), s["start"].alias("start"), s["end"].alias("end")))
    g, p = bare("gold"), bare("pred")
    marked = lambda a, kind: F.transform(F.array_distinct(a), lambda s: F.struct(s["label"].alias("label"), F.lit(kind).alias("kind")))
    kinds = F.concat(marked(F.array_intersect(g, p), "tp"), marked(F.array_except(p, g), "fp"), marked(F.array_except(g, p), "fn"))
    e = df.select(F.explode(kinds).alias("x")).select("x.*")
    return e.groupBy("label").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")])


def accuracies(df: DataFrame, unsupported: int | None = 0) -> DataFrame:
    """One row of exact-span rates over supported rows and all inputs (null if their number is unknown) and the token rate.

    df: gold and pred span arrays, gold_tags and pred_tags of the supported rows.
    """
    same = F.size(F.filter(F.arrays_zip(F.col("gold_tags").alias("g"), F.col("pred_tags").alias("p")), lambda z: z["g"] == z["p"]))
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    r = df.agg(F.count("*").alias("rows"), F.count_if(F.col("gold") == F.col("pred")).alias("exact"), total(F.size("gold_tags")).alias("tokens"), total(same).alias("correct_tokens"))
    rate = lambda n, of: F.col(n) / F.greatest(of, F.lit(1))
    every = F.lit(None).cast("double") if unsupported is None else rate("exact", F.col("rows") + unsupported)
    return r.select("*", rate("exact", F.col("rows")).alias("supported_accuracy"), every.alias("all_inputs_accuracy"), rate("correct_tokens", F.col("tokens")).alias("token_accuracy"))


def macro(df: DataFrame, by: str, correct: str = "exact", groups: list[str] | None = None) -> DataFrame:
    """Mean over groups of each group's rate; a group of ``groups`` without a row is an error."""
    rates = df.groupBy(by).agg(F.avg(F.col(correct).cast("double")).alias("rate"))
    out = rates.agg(F.avg("rate").alias("macro"), F.count("*").alias("groups"), F.collect_set(by).alias("seen"))  # one entry for a group
    if groups is not None:
        lacking = F.size(F.array_except(F.array(*map(F.lit, groups)), "seen")) > 0
        out = out.withColumn("macro", F.when(lacking, F.raise_error(F.lit("a slice is empty")).cast("double")).otherwise(F.col("macro")))
    return out.select("macro", "groups")


def variant_outcomes(variants: DataFrame, base: DataFrame) -> DataFrame:
    """(kind, both, only_base, only_variant, neither) of variants (id ``base:kind``, exact) against the rows they were made from (id, exact)."""
    v = variants.select(F.regexp_extract("id", "^(.*):", 1).alias("id"), F.substring_index("id", ":", -1).alias("kind"), F.col("exact").alias("v"))
    j = v.join(base.select("id", F.col("exact").alias("b")), "id")
    n = lambda c: F.count_if(c)
    return j.groupBy("kind").agg(n(F.col("b") & F.col("v")).alias("both"), n(F.col("b") & ~F.col("v")).alias("only_base"), n(~F.col("b") & F.col("v")).alias("only_variant"), n(~F.col("b") & ~F.col("v")).alias("neither"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of both, only a, only b, neither; a and b: (id, exact). Ids must agree."""
    j = a.select("id", F.col("exact").alias("a")).join(b.select("id", F.col("exact").alias("b")), "id", "full_outer")
    return j.agg(
        F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"),
        F.count_if(~F.col("a") & ~F.col("b")).alias("neither"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"),
    )


def confusions(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(kind, field, n): missing, extra, changed fields, and swaps 'a->b' of equal content."""
    g = field_lists(gold).select("id", "field", F.col("tokens").alias("g"))
    p = field_lists(pred).select("id", "field", F.col("tokens").alias("p"))
    j = g.join(p, ["id", "field"], "full_outer").where("g is null or p is null or g <> p")
    kind = F.when(F.col("g").isNull(), "extra").when(F.col("p").isNull(), "missing").otherwise("changed")
    plain = j.select(kind.alias("kind"), "field")
    swap = g.join(p.withColumnRenamed("field", "other"), "id").where("g = p and field <> other").select(F.lit("swap").alias("kind"), F.concat_ws("->", "field", "other").alias("field"))
    return plain.union(swap).groupBy("kind", "field").agg(F.count("*").alias("n"))


def topk_recall(df: DataFrame, ks: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """Share of rows whose gold is among the first k candidates; df: gold, candidates array."""
    rank = F.array_position("candidates", F.col("gold"))
    return df.select(rank.alias("r")).agg(F.count("*").alias("rows"), *[F.count_if((F.col("r") > 0) & (F.col("r") <= k)).alias(f"top{k}") for k in ks])


def scope_rollup(df: DataFrame, country: str, scopes: dict[str, Column], correct: str) -> DataFrame:
    """(country or all, scope, rows, exact) by grouping sets over exploded scope membership."""
    member = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in scopes.items()]))
    e = df.select(F.col(country).alias("country"), F.explode(member).alias("scope"), F.col(correct).alias("ok"))
    g = e.groupingSets([[F.col("country"), F.col("scope")], [F.col("scope")]], "country", "scope").agg(F.count("*").alias("rows"), F.count_if("ok").alias("exact"), F.grouping("country").alias("g"))
    return g.select(F.when(F.col("g") == 1, "all").otherwise(F.col("country")).alias("country"), "scope", "rows", "exact")


def inverse_frequency(df: DataFrame, by: str) -> DataFrame:
    """(by, n, weight): total / (groups * n)."""
    g = df.groupBy(by).agg(F.count("*").alias("n"))
    t = g.agg(F.sum("n").alias("total"), F.count("*").alias("groups"))
    return g.crossJoin(F.broadcast(t)).select(by, "n", (F.col("total") / (F.col("groups") * F.col("n"))).alias("weight"))  # one row


def nearest_rank(df: DataFrame, value: str, ps: dict[str, float], by: list[str] = (), buckets: int = 1024, limit: int = 64) -> DataFrame:
    """The smallest value of each group whose share of values up to it reaches p; nulls don't count, NaN is the largest.

    Radix selection: rounds count values by bucket between the ends that still hold a rank, and go on
    with the one bucket in which it lies, whose own least and largest value are the next ends. They
    are the same once one value is left, so ties end at once. The state of a group is its buckets,
    however many distinct values it has. Buckets are equal in width, in every other round on a
    logarithmic scale, so that neither skewed nor widely spread values need many rounds.
    """
    tables = Tables(df.sparkSession)
    v = F.col(value).cast("double")
    kind = F.when(F.isnan(v), 2).when(v == float("inf"), 1).when(v == float("-inf"), -1).otherwise(0)
    d = df.where(v.isNotNull()).select(F.struct(F.lit(0), *by).alias("k"), v.alias("v"), kind.alias("kind"))
    n = lambda x: F.count_if(F.col("kind") == x)
    finite = F.when(F.col("kind") == 0, F.col("v"))
    s = d.groupBy("k").agg(F.count("*").alias("n"), n(-1).alias("low"), n(0).alias("mid"), n(1).alias("high"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))
    s = s.select("*", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in ps.items()])).alias("q")).select("*", "q.*")
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("n"), 9))) - F.col("low")
    out = F.when(rank <= 0, float("-inf")).when(rank > F.col("mid") + F.col("high"), float("nan")).when(rank > F.col("mid"), float("inf"))
    s = s.select("k", "name", rank.alias("rank"), "lo", "hi", out.alias("found"))
    log = lambda x: F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))  # noqa: E731  the least positive double has -1074
    done, half = [], lambda x: x / 2  # noqa: E731  the difference of two finite values may not be one
    for i in range(limit):
        s = s.withColumn("found", F.when(F.col("found").isNull() & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise(F.col("found")))
        s, seen = tables.cut(s, "ranks", left=F.count_if(F.col("found").isNull()))
        done.append(s.where("found is not null").select("k", "name", "found"))
        if not seen["left"]:
            break
        now = d.where("kind = 0").join(s.where("found is null"), "k").where("v between lo and hi")
        scale = half if i % 2 == 0 else log
        part = (scale(F.col("v")) - scale(F.col("lo"))) / F.nullif(scale(F.col("hi")) - scale(F.col("lo")), F.lit(0.0))
        part = F.coalesce(part, (half(F.col("v")) - half(F.col("lo"))) / (half(F.col("hi")) - half(F.col("lo"))))
        # the ends always lie in different buckets
        at = F.when(F.col("v") == F.col("hi"), buckets).when(F.col("v") == F.col("lo"), -1).otherwise(F.least(F.floor(part * buckets), F.lit(buckets - 1)))
        c = now.groupBy("k", "name", "rank", at.alias("at")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("k", "name").orderBy("at"))
        c = c.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
        s = c.select("k", "name", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"), "lo", "hi", F.lit(None).cast("double").alias("found"))
    else:
        raise RuntimeError("more rounds than the limit")
    every = reduce(DataFrame.unionByName, done)
    out = every.groupBy("k").agg(*[F.max(F.when(F.col("name") == name, F.col("found"))).alias(name) for name in ps])
    return out.select(*[F.col(f"k.{c}") for c in by], *[F.col(name).cast(df.schema[value].dataType).alias(name) for name in ps])


def percent_stack(df: DataFrame, part: str, value: str, by: str) -> DataFrame:
    """Lower and upper end of each part's band, as shares of its group."""
    w = Window.partitionBy(by).orderBy(part)
    up = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(value).over(Window.partitionBy(by))
    return df.select(by, part, ((up - F.col(value)) / total).alias("lower"), (up / total).alias("upper"))


def gate(now: DataFrame, before: DataFrame, drop: float = 0.005, share: float = 0.01) -> DataFrame:
    """One row (score, macro, eligible, reasons) of an epoch's panels; now, before: panel, country, rows, exact.

    The score is the mean of the partial, reordered and combined panels' country means. Against an
    epoch speak a clean macro that fell by more than ``drop``, and in the guarded panels other
    countries, other row counts, or a country that lost more than a ``share`` of its rows (one at
    least). A panel that is absent or has an empty country is an error.
    """
    guarded, scored = ["clean", "old-us", "new-us"], ["partial", "reordered", "combined"]
    side = lambda df, names: df.groupBy().agg(*[mean(n).alias(n) for n in names])

    def mean(name: str) -> Column:
        mine = F.col("panel") == name
        full = (F.count_if(mine) > 0) & (F.count_if(mine & (F.col("rows") > 0)) == F.count_if(mine))
        return F.when(full, F.avg(F.when(mine & (F.col("rows") > 0), F.col("exact") / F.col("rows")))).otherwise(F.raise_error(F.lit(f"panel {name} has an empty country slice")).cast("double"))

    pairs = now.where(F.col("panel").isin(*guarded)).alias("n").join(before.where(F.col("panel").isin(*guarded)).alias("b"), ["panel", "country"], "full_outer")
    lost = F.col("b.exact") - F.greatest(F.ceil(share * F.col("b.rows")), F.lit(1))
    found = F.array_compact(F.array(
        F.when(F.col("n.rows").isNull() | F.col("b.rows").isNull(), F.concat_ws("-", "panel", F.lit("countries"))),
        F.when(F.col("n.rows") != F.col("b.rows"), F.concat_ws("-", "panel", "country", F.lit("rows"))),
        F.when(F.col("n.exact") < lost, F.concat_ws("-", "panel", "country", F.lit("exact"))),
    ))
    each = pairs.select("panel", found.alias("found"))
    other = each.where(F.exists("found", lambda x: x.endswith("-countries"))).select("panel").distinct()  # of such a panel nothing else is held
    each = each.join(other.withColumn("other", F.lit(True)), "panel", "left").select(F.explode(F.when(F.col("other"), F.filter("found", lambda x: x.endswith("-countries"))).otherwise(F.col("found"))).alias("reason"))
    reasons = each.agg(F.array_sort(F.collect_set("reason")).alias("found"))
    one = side(now, ["clean", *scored]).crossJoin(side(before, ["clean"]).withColumnRenamed("clean", "ref")).crossJoin(reasons)  # one row each
    reasons = F.concat(F.when(F.col("clean") < F.col("ref") - drop, F.array(F.lit("clean-country-macro"))).otherwise(F.array().cast("array<string>")), "found")
    return one.select(((F.col("partial") + F.col("reordered") + F.col("combined")) / 3).alias("score"), F.col("clean").alias("macro"), (F.size(reasons) == 0).alias("eligible"), reasons.alias("reasons"))
