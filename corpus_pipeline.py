"""Training-corpus pipeline over ``documents``: STAGES in order, each one operator of quillspan.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Null texts count as empty; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.llm.op1_toxicity import score_rows, train
from quillspan.llm.op2_minhash_dedup import near_components, with_class
from quillspan.llm.op4_decontamination import drop_contaminated
from quillspan.llm.op6_suffix_dedup import strip_repeats
from quillspan.llm.op9_packing import pack
from quillspan.llm.store import Scratch, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below 0.5; the network is fitted on the rows given that have labels.

    Null, empty and wordless texts score 0 and stay; long texts are scored to their end; repeated
    rows share one fate; a score of 0.5 goes; whatever the other columns are named, they stay.
    """
    scored = score_rows(spark, docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.where("score < 0.5").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of the smallest id.

    A reused id names a row only together with its text's class, so the other texts under it are
    judged by themselves; of one id's rows in a group one stays. A row without an id cannot be
    named for removal and stays. Null, empty and blank texts are near nothing; long texts enter
    whole; of equal rows one stays.
    """
    scratch = Scratch(spark)
    found = scratch.cut(near_components(spark, docs, rows=True).where("doc_id is not null"), "rows")
    twice = scratch.cut(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if not twice._rows:
        gone = scratch.cut(found.where("not kept").select("doc_id").distinct(), "gone")
        return docs.join(scratch.small(gone), "doc_id", "left_anti").select(*docs.columns)
    # of the classes that a group's smallest id names in it, the least stays
    pairs = found.where("v is not null").groupBy("root", "doc_id", "v").agg(F.first("kept").alias("kept"))
    least = pairs.where("kept").groupBy("root").agg(F.min("v").alias("least"))
    gone = pairs.join(least, "root", "left").where("not kept or v <> least").select(F.col("doc_id").alias("id"), F.col("v").alias("class")).distinct()
    gone = scratch.cut(gone, "gone")
    # whatever the table's columns are named, they stay apart in a struct
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), "text")
    gone, many = scratch.small(gone, 40), scratch.small(twice.withColumnRenamed("doc_id", "id"), rows=twice._rows)
    once = rows.join(many, "id", "left_anti").join(gone, "id", "left_anti").select("row")
    reused = with_class(rows.join(many, "id", "left_semi").select("row", "id", "text"), "class").join(gone, ["id", "class"], "left_anti")
    # rows of one id and class are copies; texts without words are told apart as they are
    same = Window.partitionBy("id", "class", F.when(F.col("class").isNull(), F.col("text"))).orderBy("text")
    reused = reused.withColumn("nth", F.row_number().over(same)).where("nth = 1")
    return once.union(reused.select("row")).select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur elsewhere too; rows of which nothing is left go.

    A character that a cut splits goes with it, and n_chars follows the text. Null, empty and short
    texts stay as they are; of equal long rows none stays, as each repeats the other; long texts
    are searched whole.
    """
    out = strip_repeats(spark, docs, whole=True)
    text = F.when(F.col("n_removed") == 0, F.col("row.text")).otherwise(F.col("kept").cast("string"))
    out = out.withColumn("_text", text).where("n_removed = 0 or trim(_text) <> ''")
    fresh = {"text": F.col("_text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("_text").cast("long"))}
    return out.select(*[fresh.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item: null and empty texts hold none, long ones are searched to their end, equal rows share one fate."""
    return drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, and their place in the training sequences: a null or empty text is its end id, equal rows are packed one by one, a long text takes several sequences."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("suffix_repeats", repeats), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
