"""Parameterised lookups over mail, people and graph tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tieline.functions import text as X
from tieline.functions import vocabulary as V
from tieline.operators import phrases
from tieline.operators.corpus import as_of
from tieline.operators.ordering import dealt, top_per_key


def search_columns(q: str, *columns: str) -> Column:
    """Case-insensitive substring in any of the columns."""
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.lower(F.col(c)).contains(q.lower()), F.lit(False))
    return out


def bulk_fetch(mail: DataFrame, ids: Sequence[str], limit: int = 20) -> DataFrame:
    """Rows of at most ``limit`` ids, in the caller's order (column ``place``)."""
    ids = [str(i) for i in ids if i]
    if len(ids) > limit:
        raise ValueError(f"at most {limit} ids, got {len(ids)}")
    wanted = F.array(*[F.lit(i) for i in ids]) if ids else F.array().cast("array<string>")
    return (
        mail.where(F.col("email_id").isin(ids)).withColumn("place", F.array_position(wanted, F.col("email_id"))).orderBy("place")
    )


def find_emails(
    mail: DataFrame,
    *,
    sender: str | None = None,
    recipient: str | None = None,
    before_date: str | None = None,
    after_date: str | None = None,
    speech_act: str | None = None,
    topic: str | None = None,
    subject_contains: str | None = None,
    body_contains: str | None = None,
    decision_carrying: bool | None = None,
    action_required: bool | None = None,
    sentiment_min: float | None = None,
    sentiment_max: float | None = None,
    n: int = 10,
    body: str = "body_truncated",
) -> DataFrame:
    """Newest ``n`` mails matching every given filter; at least one filter is required."""
    c = F.col
    tests: list[Column] = []
    if sender:
        tests.append(c("sender") == sender)
    if recipient:
        tests.append(F.array_contains("recipients", recipient))
    if before_date:
        tests.append(c("date") < F.lit(before_date).cast("timestamp"))
    if after_date:
        tests.append(c("date") >= F.lit(after_date).cast("timestamp"))
    if speech_act:
        if speech_act not in V.SPEECH_ACTS:
            raise ValueError(f"unknown speech_act {speech_act!r}; allowed: {list(V.SPEECH_ACTS)}")
        tests.append(F.array_contains("speech_acts", speech_act))
    if topic:
        tests.append(F.array_contains("topics", topic))
    if subject_contains:
        tests.append(c("subject").ilike(f"%{subject_contains}%"))
    if body_contains:
        tests.append(c(body).ilike(f"%{body_contains}%"))
    if decision_carrying is not None:
        tests.append(c("decision_carrying") == bool(decision_carrying))
    if action_required is not None:
        tests.append(c("action_required") == bool(action_required))
    if sentiment_min is not None:
        tests.append(c("sentiment") >= float(sentiment_min))
    if sentiment_max is not None:
        tests.append(c("sentiment") <= float(sentiment_max))
    if not tests:
        raise ValueError("find_emails requires at least one filter")
    for test in tests:
        mail = mail.where(test)
    return mail.orderBy(F.desc("date"), "email_id").limit(int(n))


def email_content(mail: DataFrame, email_id: str, body: str = "body_truncated", cap: int = 4000) -> DataFrame:
    """One row per asked id: the mail with a capped body, or ``found = false``."""
    asked = mail.sparkSession.range(1).select(F.lit(email_id).alias("email_id"))
    hit = mail.where(F.col("email_id") == email_id)
    text = X.strip(F.coalesce(F.col(body), F.lit("")))
    return asked.join(hit, "email_id", "left").select(
        "email_id",
        F.col("sender").isNotNull().alias("found"),
        "subject",
        X.excerpt(F.col(body), cap).alias("body"),
        (F.length(text) > cap).alias("was_cut"),
        "body_chars",
        "date",
        "sender",
        "recipients",
        "sentiment",
    )


def thread_read_out(mail: DataFrame, thread: str, before_date: str | None = None, body: str = "body_truncated") -> DataFrame:
    """A thread in order: position (NULLs last), then date; excerpts of 300 characters."""
    return (
        as_of(mail.where(F.col("thread_key") == thread), before_date)
        .orderBy(F.asc_nulls_last("thread_position"), "date", "email_id")
        .withColumn("body_excerpt", X.excerpt(F.col(body), 300))
    )


def thread_history(mail: DataFrame, sender: str, recipient: str, before_date: str | None = None, n: int = 5) -> DataFrame:
    """Last ``n`` mails from one person to another."""
    rows = mail.where((F.col("sender") == sender) & F.array_contains("recipients", recipient))
    return as_of(rows, before_date).orderBy(F.desc("date"), "email_id").limit(n).select("email_id", "date", "subject")


def topic_collaborators(
    mail_topics: DataFrame, keyword: str, before_date: str | None = None, n: int = 5
) -> DataFrame:
    """Senders with the most mails on topics whose name holds the keyword.  ``mail_topics``: email_id, sender, date, topic."""
    hits = as_of(mail_topics.where(search_columns(keyword, "topic")), before_date)
    return (
        hits.groupBy(F.col("sender").alias("name"))
        .agg(F.count_distinct("email_id").alias("n_emails_on_topic"))
        .orderBy(F.desc("n_emails_on_topic"), "name")
        .limit(n)
    )


def person_cards(
    people: DataFrame, reports: DataFrame, members: DataFrame, mail_topics: DataFrame, before_date: str | None = None, k: int = 5
) -> DataFrame:
    """Identity cards for all ``people`` (name, title, tier): boss, reports, teams, mails before the cutoff, top topics."""
    from tieline.operators.rollups import top_items

    sent = as_of(mail_topics, before_date)
    boss = reports.groupBy(F.col("subordinate").alias("name")).agg(F.min("superior").alias("reports_to"))
    below = reports.groupBy(F.col("superior").alias("name")).agg(F.array_sort(F.collect_set("subordinate")).alias("direct_reports"))
    teams = members.groupBy("name").agg(F.array_sort(F.collect_set("team")).alias("teams"))
    count = sent.groupBy(F.col("sender").alias("name")).agg(F.count_distinct("email_id").alias("n_emails_sent"))
    topics = top_items(
        sent.where("topic is not null").select(F.col("sender").alias("name"), F.array("topic").alias("topics")), "name", "topics", k, "top_topics"
    )
    out = people
    for part in (boss, below, teams, count, topics):
        out = out.join(part, "name", "left")
    none = F.array().cast("array<string>")
    return out.withColumns(
        {c: F.coalesce(c, none) for c in ("direct_reports", "teams", "top_topics")}
        | {"n_emails_sent": F.coalesce("n_emails_sent", F.lit(0))}
    )


def ranked_contacts(edges: DataFrame, k: int) -> DataFrame:
    """Top ``k`` contacts per person and direction."""
    sides = F.array(
        F.struct(F.col("src").alias("name"), F.lit("out").alias("direction"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("name"), F.lit("in").alias("direction"), F.col("src").alias("other")),
    )
    rows = dealt(edges.select("weight", F.inline(sides)), 2 * edges.count(), "name")
    return top_per_key(rows, ["name", "direction"], [F.desc("weight"), F.col("other")], k)


def person_context(people: DataFrame, reports: DataFrame, members: DataFrame, edges: DataFrame, knows: DataFrame) -> DataFrame:
    """Boss, reports, five strongest correspondents (each direction its own entry), topics and teams per person."""
    sides = F.array(
        F.struct(F.col("src").alias("name"), F.col("dst").alias("other")),
        F.struct(F.col("dst").alias("name"), F.col("src").alias("other")),
    )
    around = dealt(edges.select("weight", F.inline(sides)), 2 * edges.count(), "name").distinct()
    top = top_per_key(around, ["name"], [F.desc("weight"), F.col("other")], 5)
    contacts = top.groupBy("name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "other", "weight"))),
            lambda s: F.concat(s["other"], F.lit(" ("), s["weight"].cast("string"), F.lit(" interactions)")),
        ).alias("contacts")
    )
    boss = reports.groupBy(F.col("subordinate").alias("name")).agg(F.min("superior").alias("reports_to"))
    below = reports.groupBy(F.col("superior").alias("name")).agg(F.array_sort(F.collect_set("subordinate")).alias("direct_reports"))
    teams = members.groupBy("name").agg(F.array_sort(F.collect_set("team")).alias("teams"))
    topics = knows.groupBy("name").agg(F.array_sort(F.collect_set("topic")).alias("topics"))
    out = people
    for part in (boss, below, contacts, topics, teams):
        out = out.join(part, "name", "left")
    return out


def entity_samples(mail: DataFrame, domains: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` longest mails per domain that occurs in a sender or recipient address.

    ``domains`` (domain) may be a substring of an address domain, so addresses are reduced to their distinct domains and these
    are met by substring.  Empty and null entries name no domain and give no rows.
    """
    text = F.lower(F.concat_ws(",", F.array("sender_email"), F.col("recipients_emails")))
    parts = mail.select("email_id", "body_chars", F.explode(F.array_distinct(F.transform(F.split(text, ","), X.domain_of))).alias("found"))
    hit = containing(parts.select("found").distinct().where("found is not null"), domains.select("domain", F.lower("domain").alias("low")))
    rows = parts.join(hit, "found").select("domain", "email_id", "body_chars").distinct()
    return top_per_key(rows, ["domain"], [F.desc("body_chars"), F.col("email_id")], k)


def containing(texts: DataFrame, wanted: DataFrame, run: int = 4) -> DataFrame:
    """(found, domain): the distinct texts of ``texts`` (found) that contain ``low`` of ``wanted`` (domain, low), by equality joins.

    Every suffix of a text starts with runs of 1 to ``run`` characters, and a text that contains a wanted string has each of the
    string's runs.  So a wanted string meets the texts at its rarest run (itself, if it is shorter), and ``contains`` then
    decides.  The suffix table has ``run`` rows a character of the distinct texts.
    """
    at = F.sequence(F.lit(1), F.length("found"))
    pieces = F.flatten(F.transform(at, lambda i: F.array(*[F.substr("found", i, F.lit(n)) for n in range(1, run + 1)])))
    starts = texts.where("found <> ''").select("found", F.explode(F.array_distinct(pieces)).alias("_run"))
    often = starts.groupBy("_run").agg(F.count("*").alias("_n"))
    size = F.least(F.length("low"), F.lit(run))
    own = F.transform(F.sequence(F.lit(1), F.length("low") - size + 1), lambda i: F.substr("low", i, size))
    asked = wanted.select("domain", "low").where("low <> ''").distinct().select("domain", "low", F.explode(own).alias("_run"))
    key = asked.join(often, "_run").groupBy("domain", "low").agg(F.count("*").alias("_met"), F.min_by("_run", F.struct("_n", "_run")).alias("_run"))
    return starts.join(key, "_run").where(F.col("found").contains(F.col("low"))).select("found", "domain").distinct()


def mailbox(mail: DataFrame, name: str | None = None) -> DataFrame:
    """Mails sent or received per person with a direction; one person's mailbox when ``name`` is given.

    A mail to oneself counts once, as sent.
    """
    cols = ["date", F.col("sender").alias("from"), F.array_join("recipients", ", ").alias("recipients_text"), "subject", "email_id"]
    if name is not None:
        mine = mail.where((F.col("sender") == name) | F.array_contains("recipients", name))
        way = F.when(F.col("sender") == name, "sent").otherwise("received")
        return mine.select(F.lit(name).alias("name"), way.alias("direction"), *cols).orderBy(F.desc("date"), "email_id")
    sent = mail.select(F.col("sender").alias("name"), F.lit("sent").alias("direction"), *cols)
    got = (
        mail.withColumn("name", F.explode(F.array_distinct("recipients")))
        .where("name <> sender")
        .select("name", F.lit("received").alias("direction"), *cols)
    )
    return sent.unionByName(got)


def phrase_matches(
    questions: DataFrame, mail: DataFrame, max_tied: int = 20, weights: dict[str, int] | None = None
) -> DataFrame:
    """Question → mails sharing the top phrase score, with the rules of the question mapper.

    ``questions``: qid, question, content.  ``mail``: email_id, sender and the weighted fields.
    Each phrase counts once per field.  A sender named in the question narrows the candidates
    when that sender exists.  Scores under 3 (2 when narrowed) or more than ``max_tied`` ties
    give no match.

    The phrases are found in one pass over the mails (:func:`phrases.finds`); a find is one row, no text is shuffled.
    """
    weights = weights or {"subject": 3, "sender": 4, "body_truncated": 1}
    q = questions.select(
        "qid",
        F.array_distinct(F.concat(X.signal_phrases(F.col("question")), X.signal_phrases(F.col("content")))).alias("phrases"),
        F.coalesce(X.sender_hint(F.col("question")), X.sender_hint(F.col("content"))).alias("hint"),
    )
    want = q.select("qid", "hint", F.size("phrases").alias("n_phrases"), F.explode("phrases").alias("phrase"))
    keys = want.select(F.lower("phrase").alias("low")).distinct()
    named = mail.withColumn("_sender", F.lower("sender"))
    found = phrases.finds(named, {c: F.col(c) for c in weights}, keys, ["email_id", "_sender"])
    points = F.create_map(*[F.lit(x) for c in weights.items() for x in c])[F.col("field")]
    scored = found.select("email_id", "_sender", "low", points.alias("points")).where("points > 0")
    senders = mail.select(F.lower("sender").alias("_hint")).distinct()
    q_hint = q.select("qid", F.lower("hint").alias("_hint")).join(senders, "_hint").select("qid", "_hint")
    pairs = (
        want.withColumn("low", F.lower("phrase"))
        .join(scored, "low")
        .join(q_hint, "qid", "left")
        .where(F.col("_hint").isNull() | (F.col("_sender") == F.col("_hint")))
        .groupBy("qid", "email_id")
        .agg(F.sum("points").alias("score"), F.max("n_phrases").alias("n_phrases"), F.max(F.col("_hint").isNotNull()).alias("narrowed"))
    )
    tops = pairs.groupBy("qid").agg(
        F.max("score").alias("top_score"), F.max_by(F.col("narrowed"), "score").alias("_narrow")
    )
    best = pairs.join(tops, "qid").where("score = top_score")
    ties = best.groupBy("qid").agg(F.count("*").alias("n_tied"))
    floor = F.when(F.col("_narrow"), 2).otherwise(3)
    return (
        best.join(ties, "qid")
        .where((F.col("top_score") >= floor) & (F.col("n_tied") <= max_tied))
        .select("qid", "email_id", "top_score", "n_phrases", "n_tied")
    )


def guarded_sql(spark, statement: str, cap: int = 200) -> DataFrame:
    """Read-only ad-hoc SQL over registered views: SELECT/WITH only, no changing verbs, at most ``cap`` rows.

    Adds ``truncated``: whether more rows existed.
    """
    import re

    text = statement.strip().rstrip(";")
    head = text.split(None, 1)[0].upper() if text else ""
    if head not in ("SELECT", "WITH"):
        raise ValueError("only SELECT or WITH statements are allowed")
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    verbs = r"\b(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|GRANT|REVOKE|MERGE|COPY|CALL|SET|CACHE|REFRESH)\b"
    found = re.search(verbs, bare, re.I)
    if found or ";" in bare:
        raise ValueError(f"statement not allowed: {found.group(0) if found else ';'}")
    cap = max(1, min(int(cap), 200))
    # The window holds at most cap + 1 rows; the statement runs once.
    page = spark.sql(text).limit(cap + 1)
    return page.withColumn("truncated", F.count("*").over(Window.partitionBy()) > cap).limit(cap)


def profiles(people: DataFrame, parts: Sequence[DataFrame], name: str | None = None) -> DataFrame:
    """Directory rows with every per-name table left-joined; one name or all."""
    out = people if name is None else people.where(F.col("name") == name)
    for part in parts:
        out = out.join(part, "name", "left")
    return out


def backfill(hits: DataFrame, full: DataFrame, key: str, column: str) -> DataFrame:
    """Fills a column missing on retrieved rows from the full table."""
    side = full.select(key, F.col(column).alias("_full"))
    return hits.join(side, key, "left").withColumn(column, F.coalesce(column, "_full", F.lit(""))).drop("_full")


def pick_candidate(df: DataFrame, candidates: str, wanted: Column) -> DataFrame:
    """The first list element whose ``dataset_id`` is the wanted one; rows without it are dropped."""
    hit = F.get(F.filter(candidates, lambda x: x["dataset_id"] == wanted), F.lit(0))
    return df.withColumn("candidate", hit).where("candidate is not null")


def decisions_between(mail: DataFrame, start: str, end: str, n: int = 10) -> DataFrame:
    """Oldest ``n`` decision mails in an inclusive date range."""
    day = F.col("date").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    return mail.where(day & F.col("decision_carrying")).orderBy("date", "email_id").limit(n)


def mails_of_person(mail: DataFrame, part: str, n: int = 10) -> DataFrame:
    """Newest ``n`` mails sent by or to anyone whose name holds ``part``."""
    low = part.lower()
    hit = F.lower("sender").contains(low) | F.exists("recipients", lambda r: F.lower(r).contains(low))
    return mail.where(hit).orderBy(F.desc("date"), "email_id").limit(n)


def with_fallback(queries: DataFrame, direct: DataFrame, fallback, key: str) -> DataFrame:
    """Direct rows per query; queries without any go to ``fallback``.  Adds ``used_fallback``."""
    left = queries.join(direct.select(key), key, "left_anti")
    return direct.withColumn("used_fallback", F.lit(False)).unionByName(
        fallback(left).withColumn("used_fallback", F.lit(True)), allowMissingColumns=True
    )


def embedded_label(text: Column) -> Column:
    """Label after ``[/INST] Category:`` up to a bracket or line end; NULL when absent."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?i)\[/INST\]\s*Category:\s*([^(\n\r<\[]+)", 1)), F.lit(""))


def zip_answers(df: DataFrame, key: str, questions: str, answers: str) -> DataFrame:
    """(key, pos, question, answer): lists zipped, missing answers as "", blank questions dropped."""
    z = df.select(key, F.posexplode(F.arrays_zip(F.col(questions).alias("q"), F.col(answers).alias("a"))).alias("pos", "z"))
    out = z.select(key, "pos", F.trim(F.coalesce("z.q", F.lit(""))).alias("question"), F.trim(F.coalesce("z.a", F.lit(""))).alias("answer"))
    return out.where("question <> ''")


def visible_to(name: str, broadcast: str = "*") -> Column:
    """A message is visible to its sender, its recipients and, when broadcast, to everyone."""
    everyone = (F.size("recipients") == 1) & (F.get("recipients", F.lit(0)) == broadcast)
    return everyone | (F.col("sender") == name) | F.array_contains("recipients", name)
