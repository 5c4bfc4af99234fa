"""Raw mail to the clean message table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tieline.functions import text as X
from tieline.operators.identity import resolve
from tieline.operators.ordering import top_per_key
from tieline.session import cut_lineage

CANDIDATES = {
    "from": ("from", "From", "sender"),
    "to": ("to", "To", "recipients"),
    "body": ("body", "Body", "text", "message", "content"),
    "subject": ("subject", "Subject"),
    "date": ("date", "Date", "timestamp"),
}


def resolve_columns(
    df: DataFrame, candidates: Mapping[str, Sequence[str]] = CANDIDATES, required: Sequence[str] = ("from", "to", "body")
) -> DataFrame:
    """Rename the first column found among each target's candidates; error when a required one is missing."""
    found = {t: next((c for c in names if c in df.columns), None) for t, names in candidates.items()}
    missing = [t for t in required if found.get(t) is None]
    if missing:
        raise ValueError(f"no column found for {missing} among {df.columns}")
    return df.withColumnsRenamed({c: t for t, c in found.items() if c and c != t})


def as_of(df: DataFrame, cutoff, column: str = "date") -> DataFrame:
    """Rows strictly before the cutoff; everything when the cutoff is None."""
    if cutoff is None:
        return df
    return df.where(F.col(column) < (cutoff if isinstance(cutoff, Column) else F.lit(cutoff).cast("timestamp")))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Exact de-duplication that keeps the first row of a total order."""
    return top_per_key(df, keys, order, 1, "_first").drop("_first")


def clean_mail(
    raw: DataFrame,
    aliases: DataFrame,
    domain: str,
    min_chars: int = 100,
    max_chars: int = 2000,
    thread_mode: str = "subject",
    body_form: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Clean table of ten columns: known party, long enough, truncated body, content id, de-duplicated.

    Of mails with one id the shortest stays, then that of the smallest digest.  ``body_form`` (a digest, say) is applied to
    the truncated body at once, so that no shuffle carries bodies of which only that form is wanted.

    ``thread_mode="self"`` makes every mail its own thread; ``"subject"`` keys threads by the
    normalised subject.
    """
    df = resolve_columns(raw)
    as_text = isinstance(df.schema["to"].dataType, T.StringType)
    df = df.select(
        F.col("from").alias("sender_email"),
        X.recipients_list(F.col("to"), as_text).alias("recipients_emails"),
        "date",
        "subject",
        (body_form or (lambda b: b))(F.substring("body", 1, max_chars)).alias("body_truncated"),
        F.unhex(F.md5("body")).alias("_body"),
        F.length("body").alias("body_chars"),
    ).where(F.col("body_chars") >= min_chars)
    df = df.withColumn(
        "email_id",
        X.content_id(F.col("sender_email"), F.col("recipients_emails"), F.col("date").cast("string"), F.col("subject")),
    )
    # Written once: addresses are read from here three times, and bodies of repeats are not shipped further.
    whole = [F.col(c) for c in ("body_chars", "_body", "recipients_emails", "subject")]
    df = cut_lineage(first_per_key(df, ["email_id"], whole).drop("_body"))
    rows = df.select("email_id", F.posexplode_outer("recipients_emails").alias("_pos", "address"))
    everyone = rows.select("address").unionByName(df.select(F.col("sender_email").alias("address"))).where("address is not null")
    names = resolve(everyone, aliases, domain)
    got = (
        rows.join(names, "address")
        .groupBy("email_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "name"))), lambda s: s["name"]).alias("recipients_resolved"))
    )
    sender = names.select(F.col("address").alias("sender_email"), F.col("name").alias("sender_resolved"))
    out = df.join(sender, "sender_email", "left").join(got, "email_id", "left")
    out = out.where("sender_resolved is not null or recipients_resolved is not null")
    thread = F.col("email_id") if thread_mode == "self" else F.substring(F.sha2(X.normalise_subject(F.col("subject")), 256), 1, 16)
    return out.select(
        "email_id",
        thread.alias("thread_id"),
        "sender_email",
        "sender_resolved",
        "recipients_emails",
        F.coalesce("recipients_resolved", F.array().cast("array<string>")).alias("recipients_resolved"),
        "date",
        "subject",
        "body_chars",
        "body_truncated",
    )


def text_features(df: DataFrame, body: str) -> DataFrame:
    """Adds the deterministic text columns of one message."""
    b = F.col(body)
    return df.withColumns(
        {
            "body_word_count": X.word_count(b),
            "n_questions": X.count_of(b, r"\?"),
            "n_exclamations": X.count_of(b, "!"),
            "n_imperatives": X.imperative_count(b),
            "n_modals": X.modal_counts(b),
            "n_first_person": X.count_of(b, X.any_of(["I", "me", "my", "mine", "we", "us", "our", "ours"])),
            "n_second_person": X.count_of(b, "(?iu)" + X.any_of(["you", "your", "yours"])),
            "politeness_score": X.politeness(b),
            "hedge_count": X.hedges(b),
        }
    )
