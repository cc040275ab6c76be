"""Last ticket wins on a stream whose requests come late, twice and in other orders: the newest of the batch form, each once."""

import random

from pyspark.sql import functions as F

from quillspan.streaming import latest, tickets


def test_last_ticket_wins(spark, tmp_path):
    r = random.Random(9)
    rows = [(f"s{i % 12}", i, 1_700_000_000_000 + 40 * i, f"text {i}") for i in range(600)]
    rows += [r.choice(rows) for _ in range(100)]  # doubled
    rows += [(None, 5000, 1_700_000_000_000, "no session"), ("s1", None, 1_700_000_000_000, "no ticket")]
    order = sorted(rows, key=lambda x: x[2] + r.uniform(-3000, 3000))
    schema = "session string, ticket long, ms long, payload string"
    for n in range(4):
        part = order[n * len(order) // 4 : (n + 1) * len(order) // 4]
        spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("end", 0, 1_800_000_000_000, "")], schema).withColumn("ts", F.timestamp_millis("ms")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    key, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(key, tickets.STORE)
    try:
        stream = spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = tickets.last_tickets(stream, "session", "ticket", "ts", "payload", wait_ms=5000).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert q.awaitTermination(180)
    finally:
        spark.conf.set(key, old)
    got = spark.read.parquet(f"{tmp_path}/out").where("session <> 'end'").collect()
    assert len(got) == len({(x.session, x.ticket) for x in got}) >= 12
    batch = spark.createDataFrame(rows, schema).where("session is not null and ticket is not null")
    want = {x.session: (x.ticket, x.payload) for x in latest.newest(batch, "session", "ticket").collect()}
    last = {}
    for x in sorted(got, key=lambda x: x.ticket):
        last[x.session] = (x.ticket, x.payload)
    assert last == want
