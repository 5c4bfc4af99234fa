"""Streaming forms.  Each takes a streaming DataFrame and keeps its checkpoint in the shared folder."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tieline.functions import text as X
from tieline.operators.threads import WEEK_SECONDS
from tieline.session import work_dir
from tieline.sources.tables import UpsertTable


def stream_files(spark: SparkSession, folder: str, schema, glob: str, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def clean_ingest(raw: DataFrame, delay: str = "7 days", min_chars: int = 100, max_chars: int = 2000) -> DataFrame:
    """Long enough mails with a content id, one per id while repeats arrive within the delay."""
    ident = X.content_id(F.col("from"), F.col("to"), F.date_format("date", "yyyy-MM-dd HH:mm:ss"), F.col("subject"))
    rows = raw.where(F.length("body") >= min_chars).select(
        ident.alias("email_id"), F.col("from").alias("sender_email"), F.col("to").alias("recipients_emails"), "date", "subject",
        F.length("body").alias("body_chars"), F.substring("body", 1, max_chars).alias("body_truncated"),
    )
    return rows.withWatermark("date", delay).dropDuplicatesWithinWatermark(["email_id"])


def volume(events: DataFrame, ts: str = "ts", window: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts per tumbling window, emitted once the watermark has passed it."""
    return (
        events.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "n")
    )


def pair_sums(mail: DataFrame) -> DataFrame:
    """Additive part of the dyadic rollup (averages stay sum and count)."""
    return (
        mail.select("sender", F.explode("recipients").alias("recipient"), "sentiment")
        .where("sender <> recipient")
        .groupBy("sender", "recipient")
        .agg(F.count("*").alias("n_emails"), F.sum("sentiment").alias("sum_sentiment"), F.count("sentiment").alias("n_sentiment"))
    )


def run_upsert(updates: DataFrame, path: str, key: list[str]) -> StreamingQuery:
    """Runs a rollup in update mode into an :class:`UpsertTable` until the input is read."""
    spark = updates.sparkSession
    return (
        updates.writeStream.outputMode("update").foreachBatch(UpsertTable(spark, path, key))
        .option("checkpointLocation", work_dir(spark, "stream")).trigger(availableNow=True).start()
    )


def run_to_table(rows: DataFrame, path: str) -> StreamingQuery:
    """Appends a stream to parquet files until the input is read."""
    return (
        rows.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", work_dir(rows.sparkSession, "stream")).trigger(availableNow=True).start()
    )


_TURN = "micros bigint, email_id string, sender string"
_SLOT_ROWS = "thread_key string, lane bigint, closes timestamp, responder string, original string, seconds double, first_at bigint, first_by string, last_at bigint, last_by string"
_REPLIES = "thread_key string, responder string, original string, seconds double"


def _replies(turns: list[tuple[int, str, str]]) -> list[tuple[str, str, float]]:
    """(responder, original, seconds) of neighbours by different senders within seven days; turns are in order."""
    return [
        (y[2], x[2], (y[0] - x[0]) / 1e6) for x, y in zip(turns, turns[1:], strict=False)
        if x[2] != y[2] and 0 < y[0] - x[0] < WEEK_SECONDS * 1_000_000
    ]


class SlotTurns(StatefulProcessor):
    """Holds the turns of one (thread, slot) until the watermark has passed the slot, then gives its replies and its ends."""

    def __init__(self, slot_seconds: int):
        self.slot_seconds = slot_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", _TURN)

    def handleInputRows(self, key, rows, timerValues):
        if not self.turns.exists():
            self.handle.registerTimer((key[1] + 1) * self.slot_seconds * 1000)
        for pdf in rows:
            micros = pdf["date"].astype("datetime64[us]").astype("int64").tolist()
            self.turns.appendList(list(zip(micros, pdf["email_id"], pdf["sender"], strict=True)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        turns = sorted(tuple(t) for t in self.turns.get())
        self.turns.clear()
        closes = pd.Timestamp((key[1] + 1) * self.slot_seconds, unit="s")
        first, last = turns[0], turns[-1]
        out = [(key[0], key[1], closes, *reply, None, None, None, None) for reply in _replies(turns)]
        # The slot's ends go to the thread's one lane of ends, its replies pass on in a lane of their own.
        out.append((key[0], -1, closes, None, None, None, first[0], first[2], last[0], last[2]))
        columns = ["thread_key", "lane", "closes", "responder", "original", "seconds", "first_at", "first_by", "last_at", "last_by"]
        frame = pd.DataFrame(out, columns=columns)
        yield frame.astype({"first_at": "Int64", "last_at": "Int64", "seconds": "float64"})

    def close(self) -> None:
        pass


class SlotBorders(StatefulProcessor):
    """Replies across slot borders: of a thread it keeps the end of its last closed slot, for seven days of event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros bigint, sender string")

    def handleInputRows(self, key, rows, timerValues):
        frames = list(rows)
        pdf = pd.concat(frames) if len(frames) > 1 else frames[0]
        if key[1] >= 0:
            yield pdf[["thread_key", "responder", "original", "seconds"]]
            return
        ends = sorted(zip(pdf["first_at"].astype("int64").tolist(), pdf["first_by"], pdf["last_at"].astype("int64").tolist(), pdf["last_by"], strict=True))
        held = self.last.get() if self.last.exists() else None
        out = []
        for first_at, first_by, last_at, last_by in ends:
            if held is not None:
                out += [(key[0], *reply) for reply in _replies([(held[0], "", held[1]), (first_at, "", first_by)])]
            held = (last_at, last_by)
        self.last.update(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(held[0] // 1000 + WEEK_SECONDS * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["thread_key", "responder", "original", "seconds"]).astype({"seconds": "float64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def thread_replies(mail: DataFrame, delay: str = "7 days", slot_seconds: int = 86_400) -> DataFrame:
    """Reply latencies per thread, the same as the batch operator's whatever order rows arrive in within ``delay``.

    Two stateful steps.  The first holds the turns of a (thread, slot) as a list until the watermark has passed the slot, so
    a busy thread is spread over its slots and no key holds more than one slot.  The second joins the slots' ends: one row a slot,
    and for each thread one value that seven days of event time remove.  Rows behind the watermark are late and go.
    ``mail``: thread_key, email_id, sender, date.  State lives in RocksDB, which the session is set to.
    """
    mail.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    slot = F.floor(F.unix_seconds("date") / slot_seconds).cast("bigint")
    turns = mail.where("thread_key <> '' and date is not null").withWatermark("date", delay).withColumn("slot", slot)
    slots = turns.groupBy("thread_key", "slot").transformWithStateInPandas(SlotTurns(slot_seconds), _SLOT_ROWS, "append", "eventTime", eventTimeColumnName="closes")
    return slots.groupBy("thread_key", "lane").transformWithStateInPandas(SlotBorders(), _REPLIES, "append", "eventTime")
