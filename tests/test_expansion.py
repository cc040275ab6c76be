"""An expansion's rows are read and keyed once, however many joins follow."""

from pyspark.sql import functions as F

from quillspan.functions import spans as S
from quillspan.plans import catalogue, corpora


def test_rows_are_keyed_once(spark, sf):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        calls.add(1)
        return text

    r = catalogue.records(spark, sf).where("c_custkey <= 40")
    n = r.count()
    rows = r.select("id", seen("text").alias("text"), "country", "components")
    known = r.where("c_custkey = 1").select(S.group_key(F.col("country"), F.col("text"), F.col("components")).alias("alias"), F.lit("test").alias("split"))
    out = corpora.expansion(rows, known, r.where("c_custkey = 2").select("text"), "seed").collect()
    assert len(out) == n > 0 and calls.value == n
