"""Thread features.  Long threads are cut into day slots before anything is ordered."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tieline.functions.text import strip
from tieline.operators.ordering import dealt, quantiles, sequenced, top_per_key
from tieline.session import cut_lineage

WEEK_SECONDS = 7 * 24 * 3600


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def thread_features(mail: DataFrame, thread: str = "thread_key") -> DataFrame:
    """Position, initiator, closer and hours since the previous mail, in (date, id) order; NULL dates last."""
    seq = sequenced(
        mail.select("email_id", thread, "date"),
        [thread],
        [F.col("date").asc_nulls_last(), F.col("email_id")],
        F.date_trunc("day", F.coalesce("date", F.lit("9999-12-31").cast("timestamp"))),
        previous=["date"],
    )
    return seq.select(
        "email_id",
        F.col("position").cast("bigint").alias("thread_position"),
        (F.col("position") == 0).alias("is_thread_initiator"),
        (F.col("position") == F.col("n_in_key") - 1).alias("is_thread_closer"),
        ((_micros("date") - _micros("prev_date")) / 3.6e9).alias("reply_latency_hours"),
    )


def reply_latencies(mail: DataFrame, thread: str = "thread_key", sender: str = "sender") -> DataFrame:
    """(responder, original, seconds) of consecutive mails by different senders within seven days."""
    seq = sequenced(
        mail.where(f"{thread} <> '' and date is not null").select("email_id", thread, F.col(sender).alias("sender"), "date"),
        [thread],
        [F.col("date"), F.col("email_id")],
        F.date_trunc("day", "date"),
        previous=["sender", "date"],
    )
    gap = (_micros("date") - _micros("prev_date")) / 1e6
    return (
        seq.where(F.col("sender") != F.col("prev_sender"))
        .select(F.col("sender").alias("responder"), F.col("prev_sender").alias("original"), gap.alias("seconds"))
        .where((F.col("seconds") > 0) & (F.col("seconds") < WEEK_SECONDS))
    )


def initiators(mail: DataFrame, thread: str = "thread_key", sender: str = "sender") -> DataFrame:
    """(thread, initiator): sender of the first mail, by partial ``min_by`` (no ordering of the thread)."""
    return (
        mail.where(f"{thread} <> '' and date is not null")
        .groupBy(thread)
        .agg(F.min_by(sender, F.struct("date", "email_id")).alias("initiator"))
    )


def response_ratio(mail: DataFrame) -> DataFrame:
    """Per person: median time others take to answer them over the median time they take, NULL if undefined."""
    lat = cut_lineage(reply_latencies(mail))  # both medians read it several times
    tome = quantiles(lat, "seconds", [0.5], ["original"]).select(F.col("original").alias("node"), F.col("q0").alias("to_me"))
    mine = quantiles(lat, "seconds", [0.5], ["responder"]).select(F.col("responder").alias("node"), F.col("q0").alias("by_me"))
    return tome.join(mine, "node", "full").select(
        "node", "to_me", "by_me", F.when(F.col("by_me") > 0, F.col("to_me") / F.col("by_me")).alias("response_time_ratio")
    )


def initiation_ratio(mail: DataFrame, known: DataFrame) -> DataFrame:
    """Per known person (node): threads started over threads taken part in as sender or recipient."""
    rows = mail.where("thread_key <> '' and date is not null")
    part = (
        rows.select("thread_key", F.explode(F.concat(F.array("sender"), F.col("recipients"))).alias("node"))
        .distinct()
        .join(known.select("node"), "node", "left_semi")
    )
    took = part.groupBy("node").agg(F.count("*").alias("participated"))
    began = initiators(mail).groupBy(F.col("initiator").alias("node")).agg(F.count("*").alias("initiated"))
    return took.join(began, "node", "left").select(
        "node",
        "participated",
        F.coalesce("initiated", F.lit(0)).alias("initiated"),
        (F.coalesce("initiated", F.lit(0)) / F.col("participated")).alias("initiation_ratio"),
    )


def breadth(mail: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct known recipients other than oneself, per sender."""
    dealt_out = dealt(mail.select("sender", "recipients"), mail.count(), "sender")
    pairs = dealt_out.select("sender", F.explode("recipients").alias("node")).where("sender <> node").distinct()
    return (
        pairs.join(known.select("node"), "node", "left_semi")
        .groupBy(F.col("sender").alias("node"))
        .agg(F.count("*").alias("communication_breadth"))
    )


def hold_out(messages: DataFrame, thread: str) -> DataFrame:
    """Every message of a thread with ``role``: the last one is the target, the others the prefix."""
    last = messages.groupBy(thread).agg(F.max(F.struct("date", "email_id")).alias("_last"), F.count("*").alias("n"))
    return messages.join(last, thread).select(
        *messages.columns,
        "n",
        F.when(F.struct("date", "email_id") == F.col("_last"), "target").otherwise("prefix").alias("role"),
    )


def last_answer(messages: DataFrame, cap: int = 400) -> DataFrame:
    """Per conversation: first line after the newest ``ANSWER:`` mark, else the newest message cut to ``cap``.

    ``messages``: conv_id, turn, text.  Blank and END messages do not count.
    """
    body = strip(F.col("text"))
    ok = messages.where((body != "") & (F.upper(body) != "END"))
    mark = r"(?is)answer\s*[:\-]\s*(.+)"
    has = F.regexp_like(body, F.lit(mark))
    pick = ok.groupBy("conv_id").agg(
        F.max_by(body, F.when(has, F.col("turn"))).alias("_marked"), F.max_by(body, "turn").alias("_newest")
    )
    said = strip(F.split_part(strip(F.regexp_extract("_marked", mark, 1)), F.lit("\n"), F.lit(1)))
    return pick.select("conv_id", F.coalesce(F.when(F.col("_marked").isNotNull(), said), F.substring("_newest", 1, cap)).alias("answer"))


def picks_by_length(mail: DataFrame, key: str, length: str, n: int) -> DataFrame:
    """Rows at the length positions ``round(q/(n+1) (N-1))``, q = 1..n (half to even); all when N ≤ n."""
    seq = sequenced(mail, [key], [F.col(length), F.col("email_id")], F.col(length))
    wanted = F.array(*[F.bround(F.lit(q / (n + 1)) * (F.col("n_in_key") - 1)).cast("bigint") for q in range(1, n + 1)])
    return seq.where((F.col("n_in_key") <= n) | F.array_contains(wanted, F.col("position").cast("bigint"))).drop("n_in_key")


__all__ = [
    "breadth", "hold_out", "initiation_ratio", "initiators", "last_answer", "picks_by_length",
    "reply_latencies", "response_ratio", "thread_features", "top_per_key",
]
