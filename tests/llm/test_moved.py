"""What the near-duplicate join moves between tasks."""

import random

from quillspan.llm.op2_minhash_dedup import near_components


def written(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_sets_move_once_for_their_pairs(spark, tmp_path):
    r = random.Random(3)
    rows, n = [], 2500
    for i in range(40):
        words = [f"w{r.randrange(10**9)}" for _ in range(n)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "end"]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    before = written(spark)
    got = {x.doc_id: x.component_id for x in near_components(spark, docs).collect()}
    assert got == {i: i - i % 2 for i in range(80)}
    assert written(spark) - before < 1.3 * 8 * n * len(rows)
