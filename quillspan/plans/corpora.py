"""Corpora and reports as whole dataflows: every row gets the first reason that speaks against it, null if it is kept.

Where rows have an order of arrival, ``admission`` and ``frozen_benchmark`` let a row depend on those
admitted before it; elsewhere a set rule stands (a key's first row by hash, a key whose rows
disagree). Neither depends on how the input is dealt out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import edits
from ..functions import labels as L
from ..functions import spans as S
from ..functions import text as X
from ..operators import admit, augment, corpus, protect, score, select
from ..sources.shared import Tables


def mapped(sources: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """Rows of several record layouts, each by its mapper, with their source."""
    out = None
    for name, (df, mapper) in sorted(sources.items()):
        part = mapper(df).select("id", "text", "components", "country", "reason", F.lit(name).alias("source"))
        out = part if out is None else out.unionByName(part)
    return out


def multi_source_audit(sources: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
    """(source, reason, type, rows): what mappers and then the audit say of each source, row by row in place."""
    a = corpus.audit(mapped(sources).withColumnRenamed("reason", "first"))
    return a.groupBy("source", F.coalesce("first", "reason", F.lit("ok")).alias("reason"), "type").agg(F.count("*").alias("rows"))


def representable(df: DataFrame) -> DataFrame:
    """Rows with their projected spans (``fields``) and whether the model could hold them."""
    fields = S.project(F.col("text"), F.col("components"))
    ok = F.coalesce(S.valid(F.col("text"), F.col("components")), F.lit(False)) & S.supported(F.col("text"), X.tokens(F.col("text")))
    return df.withColumn("fields", fields).withColumn("fits", ok & (F.size("fields") > 0))


def pilot(rows: DataFrame, protected: DataFrame) -> DataFrame:
    """(id, text, components, split, variant): valid unprotected rows, one for each text, with a layout variant of each training row; rows: id, text, components, country."""
    r = rows.where(S.valid(F.col("text"), F.col("components"))).withColumn("loose", X.identity(F.col("text")))
    r = protect.first_wins(protect.without(r, protected.select(X.identity(F.col("text")).alias("loose")), ["loose"]), ["loose"], ["id"])
    r = r.withColumn("split", X.hash_split(S.group_key(F.col("country"), F.col("text"), F.col("components")), 10, 0, 100))
    kept = r.select("id", "text", "components", "split", F.lit(False).alias("variant"))
    made = augment.layouts(kept.where("split = 'train'")).select("id", "text", "components", F.lit("train").alias("split"), F.lit(True).alias("variant"))
    return kept.unionByName(made)


def national_corpus(rows: DataFrame, protected: DataFrame, countries: list[str], seed: str) -> DataFrame:
    """Adds reason, split and fields to rows (id, text, country, components, language, provenance); protected: text, country, components."""
    lower = F.lower(F.coalesce("country", F.lit("")))
    r = representable(rows.withColumn("country", lower)).withColumn("loose", X.identity(F.col("text"))).withColumn("streets", S.street_keys(F.col("country"), F.col("components")))
    p = protected.select(X.identity(F.col("text")).alias("loose"), S.street_keys(F.lower("country"), F.col("components")).alias("streets"))
    hit = protect.overlapping(r, p, "id", "streets").union(r.join(p.select("loose").distinct(), "loose", "left_semi").select("id")).distinct().withColumn("hit", F.lit(True))
    first = corpus.first_reason(
        ("other-country", ~F.col("country").isin(*countries)), ("not-english", ~L.is_english(F.col("language"), F.col("provenance"))),
        ("protected", F.coalesce("hit", F.lit(False))), ("unrepresentable", ~F.col("fits")),
    )
    r = r.join(hit, "id", "left").withColumn("reason", first)
    key, sign = X.text_key(F.col("text")), F.xxhash64("country", F.to_json(S.signature(F.col("fields"))))
    r = r.withColumn("key", key).withColumn("sign", sign)
    groups = r.where("reason is null").groupBy("key").agg(F.min("id").alias("first"), (F.min("sign") != F.max("sign")).alias("differs"))
    late = F.when(F.col("differs"), "label-conflict").when(F.col("id") != F.col("first"), "duplicate")
    r = r.join(groups, "key", "left").withColumn("reason", F.coalesce("reason", late))
    split = X.hash_split(F.concat_ws("|", F.lit(seed), S.group_key(F.col("country"), F.col("text"), F.col("components"))))
    return r.withColumn("split", F.when(F.col("reason").isNull(), split)).select("id", "text", "country", "fields", "split", "reason")


def expansion(rows: DataFrame, known: DataFrame, protected: DataFrame, seed: str) -> DataFrame:
    """Adds reason, split, state and kind to candidates (id, text, country, components) for a corpus whose aliases already have splits.

    known: alias, split; protected: text. A row whose aliases belong to a set that is not for training
    is held out; one whose aliases would join different splits is a bridge; a text with several
    labellings is a conflict, and of rows with equal texts or equal fields the first by hash is kept.
    """
    r = representable(rows).withColumn("loose", X.identity(F.col("text")))
    c = F.col("components")
    group = S.group_key(F.col("country"), F.col("text"), c)
    r = r.withColumn("grp", group).withColumn("aliases", F.array_distinct(F.concat(L.alias_keys(F.col("country"), c), L.alias_keys(F.col("country"), F.col("fields")), F.array("grp"))))
    r = r.withColumn("own", X.hash_split(F.concat_ws("|", F.lit(seed), "grp")))
    tables = Tables(rows.sparkSession)
    r, _ = tables.cut(r, "keyed")  # projections and keys are made once, not once for each join
    guarded = r.join(protected.select(X.identity(F.col("text")).alias("loose")).distinct(), "loose", "left_semi").select("id", F.lit(True).alias("guarded"))
    old = protect.alias_splits(r, known).withColumnRenamed("splits", "old")
    # splits that an alias's rows would have, before any is admitted
    each = r.select("id", "own", F.explode("aliases").alias("alias"))
    crossed = each.groupBy("alias").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select("alias")
    bridged = each.join(crossed, "alias", "left_semi").select("id").distinct().withColumn("bridged", F.lit(True))
    r = r.join(guarded, "id", "left").join(old, "id", "left").join(bridged, "id", "left")
    train = F.coalesce(F.array_contains("old", "train"), F.lit(False))
    r = r.withColumn("kind", L.kind(c)).withColumn("split", F.when(train, "train").otherwise(F.col("own")))
    first = corpus.first_reason(
        ("unrepresentable", ~F.col("fits")), ("existing-or-protected", F.coalesce("guarded", F.lit(False))),
        ("heldout-group", F.coalesce(F.size(F.array_except("old", F.array(F.lit("train")))) > 0, F.lit(False))), ("split-bridge", F.coalesce("bridged", F.lit(False))),
        ("unsafe-partial", L.is_unsafe_partial(F.col("kind"), F.col("fields"))),
    )
    r = r.withColumn("reason", first).withColumn("key", X.text_key(F.col("text"))).withColumn("rank", select.hash_rank("id", seed="2026"))
    parts = F.transform("fields", lambda s: F.struct(s["label"].alias("label"), X.identity(s["raw"]).alias("raw")))
    r = r.withColumn("sign", F.xxhash64(F.to_json(parts))).withColumn("entity", F.xxhash64(F.to_json(F.array_sort(parts))))
    r, _ = tables.cut(r, "judged")
    left = r.where("reason is null")
    texts = left.groupBy("key").agg(F.min("rank").alias("t"), (F.min("sign") != F.max("sign")).alias("differs"))
    entities = left.groupBy("entity").agg(F.min("rank").alias("e"))
    late = F.when(F.col("differs"), "label-conflict").when((F.col("rank") != F.col("t")) | (F.col("rank") != F.col("e")), "duplicate")
    r = r.join(texts, "key", "left").join(entities, "entity", "left").withColumn("reason", F.coalesce("reason", late))
    state = F.coalesce(X.state_code(F.try_element_at(F.filter(c, lambda s: s["label"] == "state"), F.lit(1))["raw"]), F.lit("unknown"))
    return r.select("id", "text", "country", "components", "fields", "split", "kind", state.alias("state"), "grp", "rank", (F.coalesce(F.size("old"), F.lit(0)) == 0).alias("novel"), "reason")


def admission(rows: DataFrame, known: DataFrame, protected: DataFrame, seed: str) -> DataFrame:
    """Candidates (arrival, id, text, country, components) admitted in the order of arrival, which is unique; known and protected as in ``expansion``.

    Adds reason, split and round. A row takes the split of the first admitted row that shares an
    alias with it; one whose aliases have several is a bridge. Of rows with an equal text, or with
    equal fields, the first admitted stands. An admitted row whose text comes again with other labels
    is a conflict and leaves the corpus, though what it has claimed stays claimed.
    """
    r = representable(rows).withColumn("loose", X.identity(F.col("text")))
    c = F.col("components")
    r = r.withColumn("grp", S.group_key(F.col("country"), F.col("text"), c))
    r = r.withColumn("aliases", F.array_distinct(F.concat(L.alias_keys(F.col("country"), c), L.alias_keys(F.col("country"), F.col("fields")), F.array("grp"))))
    r = r.withColumn("own", X.hash_split(F.concat_ws("|", F.lit(seed), "grp")))
    guarded = protected.select(X.identity(F.col("text")).alias("loose")).distinct().withColumn("guarded", F.lit(True))
    old = r.select("arrival", F.explode("aliases").alias("alias")).join(known, "alias").groupBy("arrival").agg(F.collect_set("split").alias("old"))
    r = r.join(guarded, "loose", "left").join(old, "arrival", "left")
    first = corpus.first_reason(
        ("unrepresentable", ~F.col("fits")), ("existing-or-protected", F.coalesce("guarded", F.lit(False))),
        ("heldout-group", F.coalesce(F.size(F.array_except("old", F.array(F.lit("train")))) > 0, F.lit(False))),
    )
    r = r.withColumn("first", first)
    parts = F.transform("fields", lambda s: F.struct(s["label"].alias("label"), X.identity(s["raw"]).alias("raw")))
    r = r.withColumn("key", X.text_key(F.col("text"))).withColumn("sign", F.xxhash64(F.to_json(parts)))
    entity = X.digest(F.to_json(F.array_sort(parts)))
    r = r.withColumn("sole", F.array(F.concat(F.lit("t"), X.digest(F.col("key"))), F.concat(F.lit("e"), entity)))
    r = r.withColumn("fixed", F.when(F.array_contains("old", "train"), "train")).withColumn("unsafe", L.is_unsafe_partial(L.kind(c), F.col("fields")))
    went = admit.in_order(r.where("first is null"), "arrival", "sole", "aliases", "own", "fixed", "unsafe")
    late = F.when(F.col("outcome") == "bridge", "split-bridge").when(F.col("outcome").isNull(), "unsafe-partial").when(F.col("outcome") == "duplicate", "duplicate")
    went = went.select("arrival", "key", "sign", late.alias("late"), "split", "round")
    standing = went.where("late is null").select("key", "arrival", F.col("sign").alias("stands"))
    again = went.where("late = 'duplicate'").join(standing.select("key", "stands"), "key").where("sign <> stands").select("key").distinct()
    conflict = standing.join(again, "key", "left_semi").select("arrival", F.lit(True).alias("conflict"))
    out = r.join(went.drop("key", "sign"), "arrival", "left").join(conflict, "arrival", "left")
    reason = F.coalesce("first", "late", F.when(F.col("conflict"), "label-conflict"))
    return out.select("arrival", "id", "text", "country", "fields", F.when(reason.isNull(), F.col("split")).alias("split"), "round", reason.alias("reason"))


def selected(candidates: DataFrame, limit: int) -> DataFrame:
    """The first kept candidates of an expansion: groups, kinds and states in turn, new groups first."""
    return select.round_robin(candidates.where("reason is null"), "split", "state", "kind", "grp", "rank", "novel", limit)


def keyed(df: DataFrame) -> DataFrame:
    """Adds loose (identity of the text), grp and streets (group and street keys) and sign (labelled content)."""
    c = F.col("components")
    named = {"loose": X.identity(F.col("text")), "grp": S.group_key(F.col("country"), F.col("text"), c), "streets": S.street_keys(F.col("country"), c)}
    return df.withColumns(named | {"sign": X.digest(F.to_json(S.signature(c)))})


def near(rows: DataFrame, other: DataFrame, flag: str, *keys: str) -> DataFrame:
    """Adds whether a row shares a street or one of the given keys with any row of other: a semi join for each, its ids joined once."""
    ids = protect.overlapping(rows, other, "id", "streets").union(protect.matching(rows, other, "id", *[[k] for k in keys]))
    return rows.join(ids.distinct().withColumn(flag, F.lit(True)), "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def expanded_build(candidates: DataFrame, train: DataFrame, protected: DataFrame, caps: tuple[int, int] = (5000, 1000), per_group: int = 8) -> tuple[DataFrame, DataFrame]:
    """(candidates with split and reason, additions to train) of an existing corpus; candidates: id (unique, not null), source, country, text, components; train, protected: country, text, components.

    Of the candidates that nothing speaks against the first by digest stands for its text. Quotas of
    source, country and completeness and groups have room in the same order. A row goes to train if it
    shares a group or street with train, or by its group's digest; else to source-dev, and train rows
    that share a group or street with source-dev leave. Additions are the rows of train, their layout
    variants and, where ideographs stand apart, compacted texts: those that could be held, whose text
    is neither protected nor in source-dev, and whose labels no other row of the same text contradicts.
    """
    tables = Tables(candidates.sparkSession)
    rank = X.digest(F.col("id").cast("string"))
    r = keyed(corpus.audit(candidates).withColumnRenamed("reason", "bad").withColumn("rank", rank))
    old, kept_out = keyed(train).select("loose", "grp", "streets", "sign"), keyed(protected).select("loose", "grp", "streets")
    conflicts = protect.conflicting(r.where("loose is not null"), "loose", "sign").select("loose", F.lit(True).alias("differs"))
    known = old.where("loose is not null").groupBy("loose").agg(F.collect_set("sign").alias("known"))
    r = near(r, kept_out, "guarded", "loose", "grp").join(conflicts, "loose", "left").join(known, "loose", "left")
    same = F.array_contains("known", F.col("sign")) & (F.size("known") == 1)
    reason = F.coalesce("bad", corpus.first_reason(
        ("conflicting-candidate-labels", F.col("differs")), ("existing-training-duplicate", F.coalesce(same, F.lit(False))), ("conflict-with-existing-training", F.col("known").isNotNull()),
        ("protected-evaluation-overlap", F.col("guarded")),
    ))
    r, _ = tables.cut(r.select(*candidates.columns, "rank", "loose", "grp", "streets", "sign", reason.alias("reason")), "judged")
    first = r.where("reason is null").groupBy("loose").agg(F.min("rank").alias("first"))
    r = r.join(first, "loose", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("rank") != F.col("first"), "new-source-duplicate"))).drop("first")
    has = lambda n: F.exists("components", lambda s: s["label"] == n)
    left = r.where("reason is null").select("rank", "grp", F.struct("source", "country").alias("quota"), (has("house_number") & has("road")).alias("full"))
    room = admit.joint_caps(left, "rank", "quota", "grp", "full", caps, per_group).select("rank", F.lit(True).alias("room"))
    r = r.join(room, "rank", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("room").isNull(), "mixture-or-street-cap"))).drop("room")
    r = near(r, old, "ours", "grp")
    tenth = F.conv(F.substring("grp", 1, 8), 16, 10).cast("bigint") % 10 == 0
    r, _ = tables.cut(r.withColumn("split", F.when(F.col("reason").isNull(), F.when(F.col("ours") | ~tenth, "train").otherwise("source-dev"))), "split")
    held = r.where("split = 'source-dev'")
    r = near(r, held, "near", "grp").withColumn("reason", F.coalesce("reason", F.when((F.col("split") == "train") & F.col("near"), "supplementary-holdout-overlap")))
    decided = r.withColumn("split", F.when(F.col("reason").isNull(), F.col("split")))
    made = additions(decided.where("split = 'train'")).withColumn("loose", X.identity(F.col("text")))
    made = protect.without(made, kept_out.select("loose").union(held.select("loose")), ["loose"])
    made = representable(made).where("fits").withColumn("sign", X.digest(F.to_json(S.signature(F.col("components")))))
    differs = protect.conflicting(made.select("loose", "sign").union(old.select("loose", "sign")), "loose", "sign")
    made = made.join(differs.select("loose"), "loose", "left_anti")
    return decided.select(*candidates.columns, "split", "reason"), made.select("id", "origin", "kind", "country", "text", "components")


def additions(rows: DataFrame) -> DataFrame:
    """(id, origin, kind, country, text, components): the rows, a layout variant of each and compacted ideographs; origin is the row's own id."""
    rows = rows.withColumn("id", F.col("id").cast("string"))
    plain = rows.select("id", F.col("id").alias("origin"), F.lit("original").alias("kind"), "country", "text", "components")
    laid = augment.layouts(rows).withColumn("origin", F.regexp_replace("id", ":layout$", "")).join(rows.select(F.col("id").alias("origin"), "country"), "origin")
    apart = rows.where(F.col("country").isin("cn", "tw", "jp") & F.col("text").rlike(edits.IDEOGRAPH_GAPS)).withColumn("m", edits.compact_ideographs(F.col("text"), F.col("components")))
    tight = apart.select(F.concat("id", F.lit(":compact")).alias("id"), F.col("id").alias("origin"), F.lit("compact").alias("kind"), "country", "m.text", F.col("m.spans").alias("components"))
    return plain.unionByName(laid.select(*plain.columns)).unionByName(tight)


def country_pilot(rows: DataFrame, previous: DataFrame, countries: list[str], per_stratum: int) -> tuple[DataFrame, DataFrame]:
    """(first rows by hash of each country and type, one row of counts: how many of them a previous set holds too)."""
    r = rows.where(F.col("country").isin(*countries)).withColumn("type", S.address_type(F.col("components")))
    some = select.top_n(r, ["country", "type"], [select.hash_rank("id", seed="2026"), F.col("id")], per_stratum).drop("rn")
    marked = some.select("id", X.identity(F.col("text")).alias("loose")).join(previous.select(X.identity(F.col("text")).alias("loose")).distinct().withColumn("known", F.lit(True)), "loose", "left")
    return some, marked.agg(F.count("*").alias("rows"), F.count_if("known").alias("overlap"))


def frozen_benchmark(rows: DataFrame, blocked: DataFrame, per_stratum: int, seed: str, arrival: str | None = None) -> DataFrame:
    """Adds reason to entities (id, country, stratum, text, components, reason); blocked: country, components.

    The field set must be complete; no key of an entity may be blocked; of entities that share a key
    the first by hash stands or, if the column ``arrival`` says in which unique order they come, an
    entity goes that shares one with an earlier entity still standing; of those left each stratum
    gives its first by hash.
    """
    keys = L.entity_keys(F.col("country"), F.col("components"))
    named = lambda df: df.withColumn("keys", F.transform(keys, lambda k: F.concat_ws("|", k["country"], k["street"], k["field"], k["value"])))
    r = named(rows).withColumn("rank", select.hash_rank("id", seed=seed))
    seen = protect.overlapping(r, named(blocked), "id", "keys").withColumn("seen", F.lit(True))
    whole = L.has_exactly(F.col("components"), ["street_address", "city", "postcode"], ["state"], F.col("country") == "us")
    r = r.join(seen, "id", "left")
    r = r.withColumn("reason", F.coalesce("reason", corpus.first_reason(("missing-required-field", ~whole), ("replacement-character", F.col("text").contains("�")), ("blocked-entity", F.coalesce("seen", F.lit(False))))))
    left = r.where("reason is null")
    if arrival:
        later = admit.in_order(left, arrival, "keys").where("outcome <> 'admitted'").select("id")
    else:
        each = left.select("id", "rank", F.explode("keys").alias("k"))
        later = each.join(each.groupBy("k").agg(F.min("rank").alias("best")), "k").where("rank <> best").select("id")
    later = later.distinct().withColumn("later", F.lit(True))
    r = r.join(later, "id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("later"), "duplicate-entity")))
    best = select.top_n(r.where("reason is null").select("id", "stratum", "rank"), ["stratum"], [F.col("rank"), F.col("id")], per_stratum).select("id", F.lit(True).alias("taken"))
    return r.join(best, "id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("taken").isNull(), "not-drawn"))).select("id", "country", "stratum", "text", "components", "reason")


def score_report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(country, model, rows, exact, percent, low, high, field_f1, every): gold: id, country, components; pred: id, model, components.

    ``every`` marks the rows over all countries, so that a null country keeps a row of its own;
    predictions without a gold row have no country and count among the null ones.
    """
    outcomes = score.field_outcomes(gold, pred).join(gold.select("id", "country").distinct(), "id", "left")
    per_row = outcomes.groupBy("id", "model", "country").agg(F.min("correct").alias("exact"))
    every = (F.grouping("country") == 1).alias("every")
    cube = lambda df, *aggs: df.groupingSets([[F.col("country"), F.col("model")], [F.col("model")]], "country", "model").agg(every, *aggs)
    r = cube(per_row, F.count("*").alias("rows"), F.count_if("exact").alias("exact"))
    ints = lambda c: F.sum(F.when(F.col("field").isNotNull(), F.col(c).cast("long")).otherwise(0))
    f = cube(outcomes, score.f1(ints("correct"), ints("in_pred"), ints("in_gold")).alias("field_f1"))
    f = f.withColumnsRenamed({"country": "c2", "model": "m2", "every": "e2"})
    low, high = score.wilson(F.col("exact"), F.col("rows"))
    j = r.join(f, F.col("country").eqNullSafe(F.col("c2")) & F.col("model").eqNullSafe(F.col("m2")) & (F.col("every") == F.col("e2")))
    return j.select("country", "model", "rows", "exact", (100 * F.col("exact") / F.col("rows")).alias("percent"), low.alias("low"), high.alias("high"), "field_f1", "every")


def model_comparison(gold: DataFrame, pred: DataFrame, a: str, b: str) -> DataFrame:
    """(country, both, only_a, only_b, neither) of two models on the same rows."""
    x = score.row_outcomes(score.field_outcomes(gold, pred)).groupBy("id").agg(F.max(F.when(F.col("model") == a, F.col("exact"))).alias("a"), F.max(F.when(F.col("model") == b, F.col("exact"))).alias("b"))
    n = F.count_if
    return x.join(gold.select("id", "country"), "id").groupBy("country").agg(n(F.col("a") & F.col("b")).alias("both"), n(F.col("a") & ~F.col("b")).alias("only_a"), n(~F.col("a") & F.col("b")).alias("only_b"), n(~F.col("a") & ~F.col("b")).alias("neither"))


def pseudo_labels(texts: DataFrame, parsed: DataFrame) -> DataFrame:
    """(id, text, components, reason): a parser's parts (id, parts) as spans of the texts, where they cover these."""
    j = texts.join(parsed, "id").withColumn("components", augment.aligned(F.col("text"), F.col("parts")))
    return j.select("id", "text", "components", F.when(F.col("components").isNull(), "not-aligned").alias("reason"))
