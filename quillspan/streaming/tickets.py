"""Last ticket wins: a session's newest request is answered once it has rested, whatever comes late or twice."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # setting spark.sql.streaming.stateStore.providerClass


class Tickets(StatefulProcessor):
    """State of a session: its highest ticket, that ticket's payload, its timer, and whether it was answered."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ticket bigint, payload string, due bigint, answered boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Tickets that are not above the highest seen change nothing; a higher one starts the session's timer anew."""
        best = None
        for pdf in rows:
            i = pdf["ticket"].idxmax()
            if best is None or pdf["ticket"][i] > best[0]:
                best = int(pdf["ticket"][i]), pdf["payload"][i], int(pdf["ms"][i])
        old = self.newest.get() if self.newest.exists() else None
        if best is not None and (old is None or best[0] > old[0]):
            if old is not None and not old[3]:
                self.handle.deleteTimer(old[2])
            due = max(best[2] + self.wait, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(due)
            self.newest.update((best[0], best[1], due, False))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ticket, payload, due, answered = self.newest.get()
        if not answered:
            self.newest.update((ticket, payload, due, True))
            yield pd.DataFrame({"session": [key[0]], "ticket": [ticket], "payload": [payload]})

    def close(self) -> None:
        pass


def last_tickets(stream: DataFrame, session: str, ticket: str, ts: str, payload: str, wait_ms: int = 200, late: str = "1 minute") -> DataFrame:
    """(session, ticket, payload): each session's highest ticket, once ``wait_ms`` of event time pass without a higher one.

    A ticket is answered once at most; a lower or equal one that comes later is never answered. Rows
    without a session, ticket or time take no part. The state of a session is one row; the stream
    needs the state store ``STORE``.
    """
    t = stream.select(F.col(session).cast("string").alias("session"), F.col(ticket).cast("bigint").alias("ticket"), F.col(payload).cast("string").alias("payload"), F.col(ts).cast("timestamp").alias("ts"))
    t = t.where("session is not null and ticket is not null and ts is not null").withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return t.groupBy("session").transformWithStateInPandas(Tickets(wait_ms), "session string, ticket bigint, payload string", "Append", "EventTime")
