"""Scans, filters, identity and text features over the message corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieline.functions import text as X
from tieline.functions import vocabulary as V
from tieline.operators import corpus, identity
from tieline.plans.columns import listed, r6, stamp
from tieline.plans.registry import query
from tieline.plans.shapes import INTERNAL_DOMAIN
from tieline.session import cut_lineage

STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("clean_mail_scan", "A4", f"""
SELECT email_id, sender, array_to_string(recipients, '|') AS recipients, subject, {STAMP.format('date')} AS date,
       body_chars FROM mail""")
def _(t):
    return t.mail.select("email_id", "sender", listed("recipients", "recipients"), "subject", stamp("date", "date"), "body_chars")


@query("pruned_scan", "A5", "SELECT o_orderkey AS email_key, o_orderdate < TIMESTAMP '1998-01-01' AS early FROM orders")
def _(t):
    return t.orders.select(
        F.col("o_orderkey").alias("email_key"), (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")).alias("early")
    )


@query("recipient_lists", "B1", """
SELECT email_id, array_to_string(list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> ''), '|')
         AS recipients
FROM (SELECT email_id, ' , ' || array_to_string(recipients_emails, ' , ,') || ',' AS raw FROM mail)""")
def _(t):
    raw = F.concat(F.lit(" , "), F.array_join("recipients_emails", " , ,"), F.lit(","))
    return t.mail.select("email_id", listed(X.recipients_list(raw, True), "recipients"))


@query("known_party_filter", "B2", """
SELECT email_id FROM mail JOIN person ON name = sender WHERE level >= 3 OR len(recipients) > 0""")
def _(t):
    known = t.person.where("level >= 3").select(F.col("name").alias("sender"), F.lit(True).alias("known"))
    m = t.mail.select("email_id", "sender", "recipients").join(known, "sender", "left")
    return m.where(F.col("known").isNotNull() | (F.size("recipients") > 0)).select("email_id")


@query("minimum_length", "B3", "SELECT doc_id, length(text) AS body_chars FROM documents WHERE length(text) >= 100")
def _(t):
    return t.documents.select("doc_id", F.length("text").cast("bigint").alias("body_chars")).where("body_chars >= 100")


@query("truncated_body", "B4", """
SELECT doc_id, md5(substr(text, 1, 2000)) AS body_digest, substr(source, 1, 500) AS subject FROM documents""")
def _(t):
    return t.documents.select(
        "doc_id", F.md5(F.substring("text", 1, 2000)).alias("body_digest"), F.substring("source", 1, 500).alias("subject")
    )


@query("content_id", "B5", f"""
SELECT email_id, substr(sha256(concat_ws('|', lower(trim(sender_email)), array_to_string(list_sort(recipients_emails), ','),
       {STAMP.format('date')}, trim(subject))), 1, 16) AS content_id FROM mail""")
def _(t):
    day = F.date_format("date", "yyyy-MM-dd HH:mm:ss")
    return t.mail.select(
        "email_id", X.content_id(F.col("sender_email"), F.col("recipients_emails"), day, F.col("subject")).alias("content_id")
    )


@query("internal_mail", "B6", "SELECT email_id, sender, len(recipients) AS n_known FROM mail WHERE len(recipients) >= 1")
def _(t):
    return t.mail.where(F.size("recipients") >= 1).select("email_id", "sender", F.size("recipients").cast("bigint").alias("n_known"))


@query("real_names", "B7 B18", """
WITH raw AS (SELECT l_orderkey, l_linenumber, sender,
    CASE l_linenumber WHEN 1 THEN 'NaN' WHEN 2 THEN ' none ' WHEN 3 THEN '' WHEN 4 THEN 'Null' WHEN 5 THEN sender ELSE recipient END AS other
  FROM mail_line JOIN mail ON email_id = CAST(l_orderkey AS VARCHAR))
SELECT l_orderkey, sender, other, count(*) AS n FROM raw
WHERE other IS NOT NULL AND lower(trim(other)) NOT IN ('', 'nan', 'none', 'null') AND other <> sender GROUP BY ALL""")
def _(t):
    other = F.expr(
        "CASE l_linenumber WHEN 1 THEN 'NaN' WHEN 2 THEN ' none ' WHEN 3 THEN '' WHEN 4 THEN 'Null' WHEN 5 THEN sender ELSE recipient END"
    )
    m = t.mail.select("sender", F.col("email_id").cast("bigint").alias("l_orderkey"))
    raw = t.mail_line.join(m, "l_orderkey").select("l_orderkey", "sender", X.missing_to_null(other).alias("other"))
    return raw.where("other is not null and other <> sender").groupBy("l_orderkey", "sender", "other").agg(F.count("*").alias("n"))


@query("as_of_cutoff", "B9", """
SELECT sender, count(*) AS n FROM mail WHERE date < TIMESTAMP '1997-06-01' GROUP BY sender""")
def _(t):
    return corpus.as_of(t.mail.select("sender", "date"), "1997-06-01").groupBy("sender").agg(F.count("*").alias("n"))


BODY_SQL = """(CASE doc_id % 5 WHEN 0 THEN '----- Forwarded by A B' || chr(10) || text WHEN 1 THEN '  From: x' || chr(10) || text
  WHEN 2 THEN 'Hi From: x ' || text WHEN 3 THEN '> ' || replace(text, chr(10), chr(10) || '> ')
  ELSE text || chr(10) || '-----Original Message-----' || chr(10) || text END)"""


def marked_body():
    """A forwarded, quoted or plain copy of the document text."""
    return F.expr(
        r"""CASE doc_id % 5 WHEN 0 THEN '----- Forwarded by A B\n' || text WHEN 1 THEN '  From: x\n' || text
        WHEN 2 THEN 'Hi From: x ' || text WHEN 3 THEN '> ' || replace(text, '\n', '\n> ')
        ELSE text || '\n-----Original Message-----\n' || text END"""
    )


@query("forwarded_filter", "B10", f"""
WITH b AS (SELECT doc_id, substr(trim({BODY_SQL}), 1, 200) AS head FROM documents)
SELECT doc_id FROM b WHERE NOT (contains(head, '----- Forwarded by') OR contains(head, '-----Forwarded by')
  OR contains(head, '----- Original Message') OR contains(head, '-----Original Message') OR starts_with(head, 'From:'))""")
def _(t):
    return t.documents.where(~X.looks_forwarded(marked_body())).select("doc_id")


@query("quoted_filter", "B11", rf"""
WITH b AS (SELECT doc_id, string_split({BODY_SQL}, chr(10)) AS lines FROM documents),
f AS (SELECT doc_id, lines, list_position(list_transform(lines,
        lambda s: regexp_matches(s, '(?i)-{{3,}}\s*forwarded\s*by\s|-{{4,}}\s*original\s+message')), true) AS hit FROM b),
q AS (SELECT doc_id, len(lines) AS n, len(list_filter(list_transform(lines,
        lambda s, i: starts_with(ltrim(s), '>') OR coalesce(hit > 0 AND i >= hit, false)), lambda x: x)) AS quoted,
      len(regexp_extract_all(array_to_string(lines, chr(10)), '[^\s\p{{Z}}]+')) AS words FROM f)
SELECT doc_id, round(quoted / n, 6) AS quoted_fraction, words AS words FROM q WHERE words >= 50 AND quoted / n <= 0.30""")
def _(t):
    b = marked_body()
    d = t.documents.select("doc_id", X.quoted_fraction(b).alias("q"), X.blank_word_count(b).alias("words"))
    return d.where("words >= 50 and q <= 0.30").select("doc_id", r6("q", "quoted_fraction"), "words")


@query("length_bands", "B20", """
SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'medium' ELSE 'long' END AS band, count(*) AS n
FROM documents GROUP BY ALL""")
def _(t):
    return t.documents.groupBy(X.length_band(F.col("n_chars")).alias("band")).agg(F.count("*").alias("n"))


@query("acts_vocabulary", "B17", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter(
   [lower(act_a), lower(l_returnflag), lower(l_linestatus)], lambda x: x IN ('request','commit','deliver','propose','amend','meeting','refuse','accept')), '|') AS acts
FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN upper(act) ELSE act || '!' END AS act_a FROM mail_line)""")
def _(t):
    raw = F.when(F.col("l_returnflag") == "R", F.upper("act")).otherwise(F.concat("act", F.lit("!")))
    acts = F.filter(F.transform(F.array(raw, "l_returnflag", "l_linestatus"), F.lower), lambda x: x.isin(*V.SPEECH_ACTS))
    return t.mail_line.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", listed(acts, "acts"))


@query("fetch_bulk", "B15", """
WITH ids AS (SELECT list(email_id ORDER BY body_chars DESC, email_id) AS ids FROM
  (SELECT email_id, body_chars FROM mail ORDER BY body_chars DESC, email_id LIMIT 20))
SELECT email_id, list_position(ids, email_id) AS place, sender, subject FROM mail, ids WHERE list_contains(ids, email_id)""")
def _(t):
    from tieline.operators.retrieval import bulk_fetch

    top = t.mail.select("email_id", "body_chars").orderBy(F.desc("body_chars"), "email_id").limit(20)
    ids = [r[0] for r in top.collect()]
    return bulk_fetch(t.mail, ids).select("email_id", F.col("place").cast("bigint").alias("place"), "sender", "subject")


@query("multi_column_search", "B16", """
SELECT doc_id FROM documents WHERE lower(text) LIKE '%tion%' AND false OR contains(lower(lang), 'e') OR contains(lower(source), 'e')
   OR contains(lower(text), 'the ')""")
def _(t):
    from tieline.operators.retrieval import search_columns

    return t.documents.where(search_columns("E", "lang", "source") | search_columns("THE ", "text")).select("doc_id")


ALIAS_SQL = """
WITH tried AS MATERIALIZED (SELECT email_id, i, CASE i % 4 WHEN 0 THEN a WHEN 1 THEN replace(a, '.0', '_0') WHEN 2 THEN replace(a, '.0', '-0')
    ELSE upper(a) END AS address
  FROM (SELECT email_id, unnest(recipients_emails) AS a, generate_subscripts(recipients_emails, 1) AS i FROM mail)),
named AS MATERIALIZED (SELECT t.*, name FROM tried t LEFT JOIN person p
  ON p.email = replace(replace(lower(t.address), '_0', '.0'), '-0', '.0'))"""


def tried_form(a, i):
    """The spelling of address ``a`` at place ``i`` of its mail."""
    return (
        F.when(i % 4 == 0, a)
        .when(i % 4 == 1, F.replace(a, F.lit(".0"), F.lit("_0")))
        .when(i % 4 == 2, F.replace(a, F.lit(".0"), F.lit("-0")))
        .otherwise(F.upper(a))
    )


def tried_addresses(t):
    rows = t.mail.select("email_id", F.posexplode("recipients_emails").alias("p", "a")).withColumn("i", F.col("p") + 1)
    return rows.select("email_id", "i", tried_form(F.col("a"), F.col("i")).alias("address"))


def directory(t):
    """The customers as a people directory."""
    return t.person.select(
        F.col("person_key").alias("ord"),
        "name",
        F.lit("Customer").alias("given_name"),
        F.split_part("name", F.lit("#"), F.lit(2)).alias("family_name"),
        "email",
        F.concat(F.lower("title"), F.lit("-"), F.col("person_key").cast("string")).alias("folder_name"),
        F.lit("").alias("additional_name"),
    )


@query("resolve_addresses", "C1 C2", ALIAS_SQL + """
SELECT DISTINCT address, name FROM named WHERE name IS NOT NULL""")
def _(t):
    aliases = identity.alias_table(directory(t), INTERNAL_DOMAIN)
    return identity.resolve(tried_addresses(t), aliases, INTERNAL_DOMAIN)


@query("resolve_recipient_lists", "C3", ALIAS_SQL + """
SELECT m.email_id, coalesce(names, '') AS names FROM mail m LEFT JOIN
 (SELECT email_id, string_agg(name, '|' ORDER BY i) AS names FROM named WHERE name IS NOT NULL GROUP BY email_id) n
 ON n.email_id = m.email_id""")
def _(t):
    aliases = identity.alias_table(directory(t), INTERNAL_DOMAIN)
    # Written once: the lists are read three times, and each reading would build the mails again.
    df = cut_lineage(t.mail.select("email_id", F.transform("recipients_emails", lambda a, p: tried_form(a, p + 1)).alias("addresses")))
    got = identity.resolve_list(df, "email_id", "addresses", aliases, INTERNAL_DOMAIN, "names")
    return got.select("email_id", listed("names", "names"))


@query("alias_table", "H10 M4", """
WITH p AS (SELECT name, email, lower(title) || '-' || person_key AS folder, split_part(name, '#', 2) AS fam FROM person),
g AS (SELECT unnest(['customer.', 'customer_', 'customer', 'c', 'c.', 'c_', 'ccustomer.', 'cuustomer.', 'cusstomer.', 'custtomer.',
   'custoomer.', 'custommer.', 'customeer.', 'customerr.', '']) AS lead),
h AS (SELECT unnest(['.customer', '_customer', 'customer', 'c']) AS tail)
SELECT DISTINCT alias, name FROM (
  SELECT email AS alias, name FROM p UNION ALL SELECT folder || '@corp.example', name FROM p
  UNION ALL SELECT lead || fam || '@corp.example', name FROM p, g UNION ALL SELECT fam || tail || '@corp.example', name FROM p, h)""")
def _(t):
    return identity.alias_table(directory(t), INTERNAL_DOMAIN)


@query("clean_ingest", "A3 B1 B2 B3 B4 B5 C1 C3 D32 H9", f"""
WITH raw AS (SELECT email_id AS src, sender_email, recipients_emails, {STAMP.format('date')} AS date, subject, text, length(text) AS body_chars
  FROM mail JOIN documents d USING (doc_id) WHERE length(text) >= 100)
SELECT DISTINCT substr(sha256(concat_ws('|', sender_email, array_to_string(list_sort(recipients_emails), ','), date, trim(subject))), 1, 16) AS email_id,
  substr(sha256(regexp_replace(lower(subject), '^((re|fw|fwd): +)+', '')), 1, 16) AS thread_id, body_chars,
  array_to_string(list_transform(list_filter(recipients_emails, lambda x: ends_with(x, '@corp.example')),
     lambda x: 'C' || substr(replace(split_part(x, '@', 1), '.', '#'), 2)), '|') AS recipients_resolved,
  md5(substr(text, 1, 2000)) AS body_digest FROM raw""")
def _(t):
    aliases = identity.alias_table(directory(t), INTERNAL_DOMAIN)
    raw = t.mail.join(t.documents.select("doc_id", "text"), "doc_id").select(
        F.col("sender_email").alias("From"), F.col("recipients_emails").alias("To"), stamp("date", "date"), "subject", "text"
    )
    out = corpus.clean_mail(raw, aliases, INTERNAL_DOMAIN, body_form=F.md5)
    return out.select(
        "email_id", "thread_id", F.col("body_chars").cast("bigint").alias("body_chars"),
        listed("recipients_resolved", "recipients_resolved"), F.col("body_truncated").alias("body_digest"),
    )


@query("dedup_first", "D32", """
SELECT text_key, doc_id FROM (SELECT md5(text) AS text_key, doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn
 FROM documents) WHERE rn = 1""")
def _(t):
    d = t.documents.select(F.md5("text").alias("text_key"), "doc_id")
    return corpus.first_per_key(d, ["text_key"], [F.col("doc_id")])


WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}_]+')"


@query("text_counts", "H1", rf"""
SELECT doc_id, len({WORDS}) AS body_word_count, len(regexp_extract_all(text, '\?')) AS n_questions,
 len(regexp_extract_all(text, '!')) AS n_exclamations,
 len(list_filter({WORDS}, lambda w: w IN ('I', 'me', 'my', 'mine', 'we', 'us', 'our', 'ours'))) AS n_first_person,
 len(list_filter({WORDS}, lambda w: lower(w) IN ('you', 'your', 'yours'))) AS n_second_person FROM documents""")
def _(t):
    cols = ["body_word_count", "n_questions", "n_exclamations", "n_first_person", "n_second_person"]
    return corpus.text_features(t.documents.select("doc_id", "text"), "text").select("doc_id", *cols)


@query("modal_counts", "H2", rf"""
SELECT doc_id, m AS modal, len(list_filter(w, lambda x: x = m)) AS n
FROM (SELECT doc_id, regexp_extract_all(lower(text || ' We CAN, may will may_x'), '[\p{{L}}\p{{N}}_]+') AS w FROM documents),
 unnest(['will', 'would', 'should', 'must', 'could', 'may', 'might', 'can', 'shall']) AS u(m)""")
def _(t):
    body = F.concat("text", F.lit(" We CAN, may will may_x"))
    d = t.documents.select("doc_id", F.explode(X.modal_counts(body)).alias("modal", "n"))
    return d.withColumn("n", F.col("n").cast("bigint"))


IMPERATIVE_LIST = ", ".join(f"'{w}'" for w in V.IMPERATIVES)


@query("imperatives", "H3", rf"""
SELECT doc_id, len(list_filter(string_split_regex(body, '[.!?][\s\p{{Z}}]+|\n+'), lambda s:
  regexp_replace(lower(regexp_extract(s, '^[^\p{{L}}\p{{N}}_]*([^\s\p{{Z}}]*)', 1)), '[,;:]+$', '') IN ({IMPERATIVE_LIST}))) AS n_imperatives
FROM (SELECT doc_id, '- Send, it. Please go! * Review: x' || chr(10) || text || ' Make do. Do' AS body FROM documents)""")
def _(t):
    body = F.concat(F.lit("- Send, it. Please go! * Review: x\n"), F.col("text"), F.lit(" Make do. Do"))
    return t.documents.select("doc_id", X.imperative_count(body).alias("n_imperatives"))


def _marks(words, expr):
    return " + ".join(f"CAST(contains({expr}, '{w}') AS INT)" for w in words)


@query("politeness_hedges", "H4 H5", f"""
SELECT doc_id, round(least(({_marks(V.POLITE_MARKERS, 'b')}) / 5.0, 1.0), 6) AS politeness_score,
  CAST({_marks(V.HEDGE_MARKERS, 'b')} AS BIGINT) AS hedge_count
FROM (SELECT doc_id, lower(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN text || ' Thanks, please, MAYBE' ELSE text || ' I think it could be Kind of likely' END) AS b
 FROM documents)""")
def _(t):
    tail = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, " Thanks, please, MAYBE")
    b = F.concat("text", tail.otherwise(" I think it could be Kind of likely"))
    return t.documents.select("doc_id", r6(X.politeness(b), "politeness_score"), X.hedges(b).alias("hedge_count"))


@query("send_time_flags", "H6", """
SELECT event_id, hour(ts) < 8 OR hour(ts) >= 19 AS is_off_hours, isodow(ts) >= 6 AS is_weekend FROM events""")
def _(t):
    return t.events.select("event_id", X.is_off_hours(F.col("ts")).alias("is_off_hours"), X.is_weekend(F.col("ts")).alias("is_weekend"))


@query("recipient_counts", "H7", """
SELECT email_id, len(b) AS to_count, len(list_distinct(b)) AS unique_recipients, 0 AS cc_count, 0 AS bcc_count
FROM (SELECT email_id, list_concat(recipients_emails, recipients_emails) AS b FROM mail)""")
def _(t):
    twice = F.concat("recipients_emails", "recipients_emails")
    return t.mail.select(
        "email_id", F.size(twice).cast("bigint").alias("to_count"), F.size(F.array_distinct(twice)).cast("bigint").alias("unique_recipients"),
        F.lit(0).alias("cc_count"), F.lit(0).alias("bcc_count"),
    )


@query("subject_keys", "H8", r"""
SELECT email_id, trim(regexp_replace(lower(regexp_replace(s, '^(?:(?i:re|fwd?)\s*:\s*)+', '')), '\s+', ' ', 'g')) AS plain,
  trim(regexp_replace(regexp_replace(lower(trim(s)), '^(?:(?i:re|fwd?)\s*:\s*)+', ''), '\s+', ' ', 'g')) AS trimmed
FROM (SELECT email_id, CASE WHEN decision_carrying THEN ' ' ELSE '' END || 'FWD : ' || subject || '   Re: Tail' AS s FROM mail)""")
def _(t):
    s = F.concat(F.when(F.col("decision_carrying"), " ").otherwise(""), F.lit("FWD : "), F.col("subject"), F.lit("   Re: Tail"))
    return t.mail.select(
        "email_id", X.normalise_subject(s).alias("plain"), X.normalise_subject(s, lower_first=True).alias("trimmed")
    )


@query("address_domains", "H9", """
SELECT DISTINCT address, split_part(address, '@', 2) AS domain, split_part(address, '@', 2) AS tail_domain
FROM (SELECT unnest(recipients_emails) AS address FROM mail)""")
def _(t):
    a = t.mail.select(F.explode("recipients_emails").alias("address")).distinct()
    quoted = F.concat(F.lit('"<X'), F.upper("address"), F.lit('>" '))
    return a.select("address", X.domain_of(quoted).alias("domain"), X.trailing_domain(F.col("address")).alias("tail_domain"))


@query("coerced_dates", "H37", f"""
SELECT event_id, {STAMP.format("try_strptime(raw, '%Y-%m-%d %H:%M:%S')")} AS parsed FROM (SELECT event_id,
 CASE event_type WHEN 'error' THEN 'not a date' WHEN 'click' THEN NULL ELSE {STAMP.format('ts')} END AS raw FROM events)""")
def _(t):
    raw = F.when(F.col("event_type") == "error", "not a date").when(F.col("event_type") != "click", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return t.events.select("event_id", stamp(X.clean_date(raw), "parsed"))
