"""Chat formatting from event logs, in DataFrame functions only.

A log row is an event of a conversation: ``message`` (a turn with its text), ``delta`` (text
streamed to the turn), ``edit`` (a new text for it) or ``regenerate`` (a new text for it, which
discards what later turns held until then). Logs are partitioned by conversation and sorted by
sequence; a turn's final text is its last message, edit or regeneration and the deltas after it.

Template of a turn: ``<s>[INST]role[/INST]text</s>``. Inside role and text a backslash is
doubled, and a backslash follows the first character of each control string; a backslash before
any character therefore stands for that character, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OPEN, MID, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
PLANTED = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, role, text) of a log (conv_id, seq, turn, kind, role, text).

    Null texts are empty; events of unknown kind count as messages; deltas before any message of
    their turn start it; the role is that of the last event of the turn that names one. Equal
    sequence numbers are ordered by kind and text.
    """
    e = events.select("conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    at = F.struct("seq", "kind", "text")
    e = e.withColumn("at", at)
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    # the last regeneration of each turn, then of all turns before: older events of this turn are void
    turns = e.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "role", "text"))).alias("log"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    turns = turns.withColumn("void", F.max("again").over(before))
    live = F.filter("log", lambda x: F.col("void").isNull() | (x["at"]["seq"] > F.col("void")))
    turns = turns.select("conv_id", "turn", live.alias("log")).where(F.size("log") > 0)
    # from the last event that sets the text on
    sets = F.array_max(F.filter(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i)), lambda i: i.isNotNull()))
    start = F.coalesce(sets, F.lit(0))
    tail = F.slice("log", start + 1, F.size("log"))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())
    return turns.select("conv_id", "turn", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(tail, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, mask: for each assistant turn its index, where it starts, and the code points lo to hi under the loss."""
    m = messages.select("conv_id", "turn", "role", escape(F.col("role")).alias("er"), escape(F.col("text")).alias("et"))
    m = m.withColumn("out", F.concat(F.lit(OPEN), "er", F.lit(MID), "et", F.lit(CLOSE)))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first())
    m = m.withColumn("i", F.row_number().over(w)).withColumn("start", F.sum(F.length("out").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("out"))
    lo = F.col("start") + len(OPEN + MID) + F.length("er")
    m = m.withColumn("span", F.when(F.col("role") == "assistant", F.struct(F.col("i"), F.col("start"), lo.alias("lo"), (lo + F.length("et")).alias("hi"))))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "out"))).alias("outs"), F.sort_array(F.collect_list("span")).alias("mask"))
    return g.select("conv_id", F.array_join(F.transform("outs", lambda x: x["out"]), "").alias("formatted"), "mask")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss (texts under the mask), parsed from the formatted string alone."""
    parts = F.split("formatted", CLOSE)
    f = formatted.withColumn("parts", F.slice(parts, 1, F.size(parts) - 1))
    body = lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
    role = lambda p: F.substring_index(body(p), MID, 1)
    text = lambda p: F.substring(p, F.length(role(p)) + len(OPEN + MID) + 1, F.length(p))
    f = f.withColumn("turns", F.transform("parts", lambda p: F.struct(unescape(role(p)).alias("role"), unescape(text(p)).alias("text"))))
    under = F.transform("mask", lambda s: unescape(F.substring(F.element_at("parts", s["i"]), (s["lo"] - s["start"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int"))))
    return f.withColumn("loss", under).drop("parts")


def as_events(conversations: DataFrame) -> DataFrame:
    """One message event for each row; rows of one turn follow one another by role and text."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return c.select("conv_id", F.row_number().over(w).alias("seq"), "role", "text").select("conv_id", "seq", F.col("seq").alias("turn"), F.lit("message").alias("kind"), "role", "text")


def chat_format(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Digests of every formatted conversation, read back from it.

    Rows of a null conv_id form one conversation; null roles and texts are empty; repeated rows
    are turns of their own; other columns are ignored; of an empty table only conversation -1,
    the planted one, comes back.
    """
    planted = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(planted)
    f = read_back(render(fold_events(as_events(rows))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return f.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS er,
    replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS et
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST]') + length(er) + length('[/INST]') + length(et) + length('</s>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
