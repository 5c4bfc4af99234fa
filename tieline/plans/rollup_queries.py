"""Threads, pair and person rollups, corpus statistics, joins against lookup tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieline.functions import text as X
from tieline.operators import network, ordering, rollups, threads
from tieline.operators.ordering import top_per_key
from tieline.plans.columns import listed, r6, stamp
from tieline.plans.registry import query
from tieline.session import cut_lineage

STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


@query("edge_weights", "D1 I1", "SELECT * FROM contact")
def _(t):
    return t.contact


PAIR_SQL = f"""
WITH p AS (SELECT sender AS sender_id, recipient AS recipient_id, count(*) AS n_emails,
   sum(CAST(list_contains(speech_acts, 'request') AS INT)) AS n_request_sent, sum(CAST(list_contains(speech_acts, 'commit') AS INT)) AS n_commit_sent,
   sum(CAST(list_contains(speech_acts, 'deliver') AS INT)) AS n_deliver_sent, sum(CAST(list_contains(speech_acts, 'propose') AS INT)) AS n_propose_sent,
   sum(CAST(decision_carrying AS INT)) AS n_decision, sum(CAST(action_required AS INT)) AS n_action_required,
   avg(sentiment) AS mean_sentiment, avg(body_word_count) AS mean_body_words, avg(reply_latency_hours) AS mean_reply_latency_h,
   min(date) AS first_email_date, max(date) AS last_email_date
 FROM mail_full JOIN mail_to USING (email_id, sender, speech_acts, decision_carrying, action_required, sentiment, date)
 WHERE sender <> recipient GROUP BY ALL)
SELECT p.sender_id, p.recipient_id, p.n_emails, p.n_emails AS n_to, 0 AS n_cc, CAST(p.n_request_sent AS BIGINT) AS n_request_sent,
  CAST(p.n_commit_sent AS BIGINT) AS n_commit_sent, CAST(p.n_deliver_sent AS BIGINT) AS n_deliver_sent,
  CAST(p.n_propose_sent AS BIGINT) AS n_propose_sent, CAST(p.n_decision AS BIGINT) AS n_decision,
  CAST(p.n_action_required AS BIGINT) AS n_action_required, round(p.mean_sentiment, 6) AS mean_sentiment,
  round(p.mean_body_words, 6) AS mean_body_words, round(p.mean_reply_latency_h + 1e-9, 6) AS mean_reply_latency_h,
  round(p.mean_body_words - r.mean_body_words, 6) AS length_asymmetry,
  round(CASE WHEN r.n_commit_sent > 0 THEN p.n_request_sent / r.n_commit_sent END, 6) AS request_commit_ratio,
  {STAMP.format('p.first_email_date')} AS first_email_date, {STAMP.format('p.last_email_date')} AS last_email_date
FROM p LEFT JOIN p r ON r.sender_id = p.recipient_id AND r.recipient_id = p.sender_id"""


@query("pair_signals", "D2 C7 M5", PAIR_SQL)
def _(t):
    out = rollups.pair_signals(t.mail_full)
    means = ["mean_sentiment", "mean_body_words", "mean_reply_latency_h", "length_asymmetry", "request_commit_ratio"]
    keep = [c for c in out.columns if c not in means and not c.endswith("_date")]
    return out.select(
        *keep, *[r6(F.col(c) + 1e-9 if "latency" in c else c, c) for c in means], stamp("first_email_date", "first_email_date"), stamp("last_email_date", "last_email_date")
    )


TOP_SQL = """
SELECT sender, string_agg(item, '|' ORDER BY rn) AS top FROM (
  SELECT sender, item, row_number() OVER (PARTITION BY sender ORDER BY n DESC, item) AS rn FROM (
    SELECT sender, u.item, count(*) AS n FROM mail, unnest({items}) AS u(item) GROUP BY ALL)) WHERE rn <= 3 GROUP BY sender"""


@query("top_topics", "D4", TOP_SQL.format(items="topics"))
def _(t):
    return rollups.top_items(t.mail, "sender", "topics").select("sender", listed("top", "top"))


@query("active_year", "D5", """
SELECT sender, y AS most_active_year FROM (SELECT sender, y, row_number() OVER (PARTITION BY sender ORDER BY n DESC, y) AS rn
 FROM (SELECT sender, year(date) AS y, count(*) AS n FROM mail GROUP BY ALL)) WHERE rn = 1""")
def _(t):
    return rollups.active_year(t.mail, "sender")


@query("person_rollup", "D3 D4 D5 M5", f"""
WITH a AS (SELECT sender, count(*) AS n, sum(CAST(decision_carrying AS INT)) AS d, sum(CAST(action_required AS INT)) AS ar,
  sum(CAST(commitment_made AS INT)) AS cm, avg(CAST(list_contains(speech_acts, 'request') AS INT)) AS pr,
  avg(CAST(list_contains(speech_acts, 'commit') AS INT)) AS pc, avg(CAST(list_contains(speech_acts, 'deliver') AS INT)) AS pd,
  avg(sentiment) AS ms, avg(body_word_count) AS mw, avg(len(recipients_emails)) AS mt, avg(CAST(is_thread_initiator AS INT)) AS ti,
  avg(reply_latency_hours) AS rl, avg(CAST(is_off_hours AS INT)) AS oh, avg(politeness_score) AS po, sum(hedge_count) / count(*) AS hr
 FROM mail_full GROUP BY sender),
t AS ({TOP_SQL.format(items="topics")}), e AS ({TOP_SQL.format(items="entities")}),
y AS (SELECT sender, y, row_number() OVER (PARTITION BY sender ORDER BY n DESC, y) AS rn FROM
  (SELECT sender, year(date) AS y, count(*) AS n FROM mail GROUP BY ALL))
SELECT a.sender, n AS n_emails_sent, CAST(d AS BIGINT) AS n_decision_carrying_sent, CAST(ar AS BIGINT) AS n_action_required_sent,
 CAST(cm AS BIGINT) AS n_commitment_made_sent, round(pr, 6) AS pct_request_sent, round(pc, 6) AS pct_commit_sent,
 round(pd, 6) AS pct_deliver_sent, round(d / n, 6) AS pct_decision_carrying, round(ms, 6) AS mean_sentiment_sent,
 round(mw, 6) AS mean_body_words, round(mt, 6) AS mean_to_count, round(ti, 6) AS pct_thread_initiator,
 round(rl + 1e-9, 6) AS mean_reply_latency_received_hours, round(oh, 6) AS pct_off_hours, round(po, 6) AS politeness_baseline,
 round(hr, 6) AS hedge_rate, t.top AS top3_topics, e.top AS top3_entities, y AS most_active_year
FROM a LEFT JOIN t USING (sender) LEFT JOIN e USING (sender) LEFT JOIN (SELECT * FROM y WHERE rn = 1) USING (sender)""")
def _(t):
    out = rollups.person_rollup(t.mail_full)
    lists = ["top3_topics", "top3_entities"]
    real = [f.name for f in out.schema.fields if f.dataType.typeName() == "double"]
    keep = [c for c in out.columns if c not in lists + real]
    return out.select(*keep, *[r6(F.col(c) + 1e-9 if "latency" in c else c, c) for c in real], *[listed(c, c) for c in lists])


@query("corpus_stats", "D6", f"""
SELECT count(*) AS emails_loaded, count(date) AS valid_dates, count(*) - count(date) AS invalid_dates, {STAMP.format('min(date)')} AS date_min,
 {STAMP.format('max(date)')} AS date_max, count(*) FILTER (trim(subject) = '') AS empty_subjects, count(*) FILTER (body_chars = 0) AS empty_bodies,
 count(DISTINCT dom) AS unique_sender_domains, count(*) FILTER (dom = 'corp.example') AS internal_emails,
 count(*) FILTER (dom <> 'corp.example') AS external_emails FROM
 (SELECT CASE WHEN email_id LIKE '%7' THEN NULL ELSE date END AS date, subject, body_chars,
   split_part(CASE WHEN len(recipients) = 0 AND len(recipients_emails) > 0 THEN recipients_emails[1] ELSE sender_email END, '@', 2) AS dom FROM mail)""")
def _(t):
    m = t.mail.withColumn("date", F.when(~F.col("email_id").endswith("7"), F.col("date")))
    addr = F.when((F.size("recipients") == 0) & (F.size("recipients_emails") > 0), F.get("recipients_emails", F.lit(0))).otherwise(F.col("sender_email"))
    out = rollups.corpus_stats(m, X.trailing_domain(addr), "corp.example")
    keep = [c for c in out.columns if c not in ("date_min", "date_max")]
    return out.select(*keep, stamp("date_min", "date_min"), stamp("date_max", "date_max"))


@query("monthly_volume", "D7", "SELECT strftime(date, '%Y-%m') AS month, count(*) AS n FROM mail GROUP BY ALL")
def _(t):
    return t.mail.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


@query("top_domains", "D8", """
SELECT d AS domain, count(*) AS n FROM (SELECT split_part(a, '@', 2) AS d FROM (SELECT unnest(recipients_emails) AS a FROM mail))
WHERE d <> 'corp.example' GROUP BY d ORDER BY n DESC, domain LIMIT 15""")
def _(t):
    d = t.mail.select(F.explode("recipients_emails").alias("a"))
    return rollups.value_counts(d.select(X.trailing_domain(F.col("a")).alias("d")).where("d <> 'corp.example'"), "d", "domain", 15)


@query("top_senders", "D8 D36", "SELECT sender, count(*) AS n FROM mail GROUP BY sender ORDER BY n DESC, sender LIMIT 20")
def _(t):
    return rollups.value_counts(t.mail, "sender", "sender", 20)


@query("degree_distribution", "D9 I2", """
SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, count(*) AS total_degree, CAST(sum(i * weight) AS BIGINT) AS weighted_in,
 CAST(sum(o * weight) AS BIGINT) AS weighted_out, CAST(sum(weight) AS BIGINT) AS weighted_total
FROM (SELECT src AS node, 1 AS o, 0 AS i, weight FROM contact UNION ALL SELECT dst, 0, 1, weight FROM contact) GROUP BY node""")
def _(t):
    return network.degrees(t.contact)


@query("cc_frequency", "D10", """
SELECT r AS node, count(*) AS cc_frequency FROM (SELECT unnest(recipients[2:]) AS r FROM mail) GROUP BY r""")
def _(t):
    cc = t.mail.select(F.explode(F.slice("recipients", F.lit(2), F.greatest(F.size("recipients") - 1, F.lit(0)))).alias("node"))
    return cc.groupBy("node").agg(F.count("*").alias("cc_frequency"))


@query("communication_breadth", "D11", """
SELECT sender AS node, count(DISTINCT recipient) AS communication_breadth FROM mail_to WHERE sender <> recipient GROUP BY sender""")
def _(t):
    # The contacts hold every pair of the mails once.
    pairs = t.contact.select(F.col("src").alias("sender"), F.array("dst").alias("recipients"))
    return threads.breadth(pairs, network.nodes(t.contact))


@query("response_ratio", "D12", """
WITH a AS (SELECT original AS node, quantile_cont(seconds, 0.5) AS to_me FROM reply GROUP BY ALL),
b AS (SELECT responder AS node, quantile_cont(seconds, 0.5) AS by_me FROM reply GROUP BY ALL)
SELECT node, round(to_me, 6) AS to_me, round(by_me, 6) AS by_me, round(to_me / by_me, 6) AS response_time_ratio FROM a FULL JOIN b USING (node)""")
def _(t):
    return threads.response_ratio(t.mail).select(
        "node", r6("to_me", "to_me"), r6("by_me", "by_me"), r6("response_time_ratio", "response_time_ratio")
    )


@query("initiation_ratio", "D13 E3", """
WITH k AS (SELECT src AS node FROM contact UNION SELECT dst FROM contact),
p AS (SELECT DISTINCT thread_key, node FROM (SELECT thread_key, sender AS node FROM mail UNION ALL SELECT thread_key, recipient FROM mail_to)
  JOIN k USING (node) WHERE thread_key <> ''),
i AS (SELECT thread_key, sender AS node FROM (SELECT thread_key, sender, row_number() OVER (PARTITION BY thread_key ORDER BY date, email_id) AS rn
  FROM mail WHERE thread_key <> '') WHERE rn = 1),
c AS (SELECT node, count(*) AS initiated FROM i GROUP BY node)
SELECT node, count(*) AS participated, coalesce(any_value(initiated), 0) AS initiated,
  round(coalesce(any_value(initiated), 0) / count(*), 6) AS initiation_ratio FROM p LEFT JOIN c USING (node) GROUP BY node""")
def _(t):
    out = threads.initiation_ratio(t.mail, network.nodes(t.contact))
    return out.select("node", "participated", "initiated", r6("initiation_ratio", "initiation_ratio"))


@query("thread_features", "E1", """
SELECT email_id, thread_position, is_thread_initiator, is_thread_closer, round(reply_latency_hours, 6) AS reply_latency_hours FROM thread_row""")
def _(t):
    out = threads.thread_features(t.mail)
    return out.select("email_id", "thread_position", "is_thread_initiator", "is_thread_closer", r6("reply_latency_hours", "reply_latency_hours"))


@query("reply_latencies", "E2", "SELECT responder, original, round(seconds, 3) AS seconds FROM reply")
def _(t):
    return threads.reply_latencies(t.mail).select("responder", "original", r6("seconds", "seconds", 3))


@query("thread_initiators", "E3", """
SELECT thread_key, sender AS initiator FROM (SELECT thread_key, sender, row_number() OVER (PARTITION BY thread_key ORDER BY date, email_id) AS rn
 FROM mail WHERE thread_key <> '') WHERE rn = 1""")
def _(t):
    return threads.initiators(t.mail)


@query("teams", "D14", """
SELECT n_regionkey AS team, count(*) AS size, first(n_name ORDER BY score DESC, n_name) AS captain,
  'Team ' || n_regionkey || ' (' || first(n_name ORDER BY score DESC, n_name) || ')' AS name
FROM (SELECT n_regionkey, n_name, score FROM nation JOIN staff ON name = n_name) GROUP BY n_regionkey""")
def _(t):
    from tieline.operators.knowledge import team_table

    return team_table(t.staff.select(F.col("name").alias("node"), F.col("level").alias("community"), F.col("score")), "score")


@query("inferred_boss", "E4", """
SELECT subordinate, superior FROM (SELECT name AS subordinate, first_value(name) OVER (PARTITION BY level ORDER BY score DESC, name) AS superior FROM staff)
WHERE subordinate <> superior""")
def _(t):
    from tieline.operators.knowledge import inferred_boss

    return inferred_boss(t.staff.select(F.col("name").alias("node"), F.col("level").alias("community"), F.col("score")), "score")


DEFER_SQL = """
WITH d AS (SELECT src AS a, dst AS b, (weight % 21) / 10.0 - 1 AS raw_score FROM contact)"""


def deference(t):
    """Signed score per directed pair, from the pair's weight and the length of the names' digits."""
    return t.contact.select(F.col("src").alias("a"), F.col("dst").alias("b"), ((F.col("weight") % 21) / 10.0 - 1).alias("raw_score"))


@query("strongest_superior", "E5", DEFER_SQL + """
SELECT subordinate, superior, round(confidence, 6) AS confidence FROM (SELECT a AS subordinate, b AS superior, abs(raw_score) AS confidence,
 row_number() OVER (PARTITION BY a ORDER BY abs(raw_score) DESC, b) AS rn FROM d WHERE raw_score < -0.5) WHERE rn = 1""")
def _(t):
    from tieline.operators.knowledge import strongest_superior

    return strongest_superior(deference(t)).select("subordinate", "superior", r6("confidence", "confidence"))


@query("score_rank", "E6 D38", """
SELECT name, balance, rank() OVER (ORDER BY balance DESC) AS rank FROM person""")
def _(t):
    ranks = ordering.value_ranks(t.person, "balance")
    above = (F.col("n_total") - F.col("n_below") - F.col("n_equal") + 1).alias("rank")
    return t.person.select("name", "balance").join(ranks.select("balance", above), "balance").select("name", "balance", "rank")


@query("tier_population", "D38", """
SELECT level, count(*) AS people, first(name ORDER BY balance DESC, name) AS leader FROM person GROUP BY level""")
def _(t):
    best = t.person.groupBy("level").agg(F.count("*").alias("people"), F.max("balance").alias("_top"))
    at = t.person.select("level", F.col("balance").alias("_top"), "name").join(best, ["level", "_top"])
    return at.groupBy("level").agg(F.max("people").alias("people"), F.min("name").alias("leader"))


@query("eligible_pairs", "D25 H35", """
SELECT least(src, dst) AS person_a, greatest(src, dst) AS person_b, CAST(sum(weight) AS BIGINT) AS total FROM contact GROUP BY ALL HAVING sum(weight) >= 2""")
def _(t):
    return rollups.eligible_pairs(t.contact, 2)


@query("corpus_mean_words", "D26", """
SELECT round(coalesce(avg(body_word_count), 100.0), 6) AS mean_words,
 round(coalesce(avg(CASE WHEN body_word_count < 0 THEN body_word_count END), 100.0), 6) AS fallback FROM doc_words""")
def _(t):
    d = t.doc_features
    none = F.when(F.col("body_word_count") < 0, F.col("body_word_count"))
    return d.agg(
        r6(F.coalesce(F.avg("body_word_count"), F.lit(100.0)), "mean_words"), r6(F.coalesce(F.avg(none), F.lit(100.0)), "fallback")
    )


@query("latency_summary", "D27", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
 round(quantile_cont(value, 0.99), 6) AS p99, round(min(value), 6) AS min, round(max(value), 6) AS max FROM events GROUP BY event_type""")
def _(t):
    q = ordering.quantiles(t.events, "value", [0.5, 0.95, 0.99], ["event_type"])
    a = t.events.groupBy("event_type").agg(r6(F.avg("value"), "mean"), r6(F.min("value"), "min"), r6(F.max("value"), "max"))
    return a.join(q, "event_type").select("event_type", "n", "mean", r6("q0", "p50"), r6("q1", "p95"), r6("q2", "p99"), "min", "max")


@query("field_fill", "D28", """
SELECT field, round(n / total, 6) AS fill_rate FROM (SELECT count(*) AS total,
  count(*) FILTER (subject <> '') AS subject, count(*) FILTER (len(recipients) > 0) AS recipients, count(sentiment) AS sentiment,
  count(*) FILTER (len(topics) > 0) AS topics FROM mail) UNPIVOT (n FOR field IN (subject, recipients, sentiment, topics))""")
def _(t):
    from tieline.operators.quality import fill_rates

    m = t.mail.select("subject", listed("recipients", "recipients"), F.col("sentiment").cast("string").alias("sentiment"), listed("topics", "topics"))
    return fill_rates(m, ["subject", "recipients", "sentiment", "topics"]).select("field", r6("fill_rate", "fill_rate"))


@query("vocabulary_union", "D30", """
SELECT DISTINCT lower(trim(x)) AS item FROM (SELECT unnest(topics) AS x FROM mail UNION ALL SELECT ' ' || upper(p_type) || ' ' FROM part)""")
def _(t):
    from tieline.operators.knowledge import vocabulary

    a = t.mail.select(F.to_json("topics").alias("blob"))
    b = t.part.select(F.to_json(F.array(F.concat(F.lit(" "), F.upper("p_type"), F.lit(" ")))).alias("blob"))
    return vocabulary([(a, "blob"), (b, "blob")])


@query("canonical_topics", "D31 H30", """
WITH m AS (SELECT 'Brand ' || (CAST(split_part(p_brand, '#', 2) AS INT) % 4) AS canon, lower(p_brand) AS raw FROM part WHERE CAST(split_part(p_brand, '#', 2) AS INT) <= 20),
v AS (SELECT DISTINCT lower(u.x) AS raw FROM mail, unnest(topics) AS u(x))
SELECT DISTINCT v.raw, coalesce(canon, 'Other') AS canonical FROM v LEFT JOIN m ON m.raw = v.raw""")
def _(t):
    from tieline.operators.knowledge import invert_vocabulary

    k = F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int")
    groups = (
        t.part.where(k <= 20).groupBy(F.concat(F.lit("Brand "), (k % 4).cast("string")).alias("canonical"))
        .agg(F.collect_set("p_brand").alias("variants"))
    )
    raw = t.mail.select(F.explode("topics").alias("x")).select(F.lower("x").alias("raw")).distinct()
    return invert_vocabulary(raw, groups)


@query("median_fill", "C5", """
WITH f AS (SELECT c_name AS node, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS v FROM customer)
SELECT node, round(coalesce(v, (SELECT quantile_cont(v, 0.5) FROM f)), 6) AS v FROM f""")
def _(t):
    f = t.customer.select(F.col("c_name").alias("node"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("v"))
    return rollups.fill_with_median(f, ["v"]).select("node", r6("v", "v"))


@query("titles_and_levels", "C4", """
SELECT node, coalesce(title, 'Unknown') AS title, coalesce(level, -1) AS community FROM
 (SELECT src AS node FROM contact UNION SELECT dst FROM contact) LEFT JOIN (SELECT * FROM person WHERE level > 0) ON name = node""")
def _(t):
    known = t.person.where("level > 0").select(F.col("name").alias("node"), "title", "level")
    return network.nodes(t.contact).join(known, "node", "left").select(
        "node", F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("level", F.lit(-1)).alias("community")
    )


@query("seniority_fallback", "C6", """
SELECT name, round(coalesce(CASE WHEN level > 1 THEN level END, CASE WHEN balance > 0 THEN 5 * (balance / 10000) END, 0), 6) AS seniority FROM person""")
def _(t):
    from tieline.operators.scoring import seniority

    side = t.person.where("level > 1").select("name", F.col("level").alias("canonical_role_level"))
    p = t.person.select("name", F.when(F.col("balance") > 0, F.col("balance") / 10000).alias("directiveness"))
    return seniority(p, side).select("name", r6("seniority", "seniority"))


@query("decision_labels", "C10 H38", """
SELECT email_id, printf('P%03d', lab) AS project_id FROM (SELECT email_id, doc_id % 12 - 1 AS lab FROM mail WHERE decision_carrying) WHERE lab >= 0""")
def _(t):
    from tieline.operators.knowledge import flagged_labels

    labels = t.mail.select("email_id", (F.col("doc_id") % 12 - 1).alias("label"))
    return flagged_labels(labels, t.mail.where("decision_carrying"), "label", "P", "project_id")


@query("person_in_recipients", "C12", """
SELECT recipient AS person, count(DISTINCT email_id) AS received FROM mail_to GROUP BY recipient""")
def _(t):
    rows = t.mail.select("email_id", F.explode(F.array_distinct("recipients")).alias("person"))
    return rows.groupBy("person").agg(F.count("*").alias("received"))


@query("external_edges", "C13 G1", """
WITH o AS MATERIALIZED (SELECT sender AS person, split_part(u.a, '@', 2) AS domain, count(*) AS weight FROM mail, unnest(recipients_emails) AS u(a) GROUP BY 1, 2),
i AS MATERIALIZED (SELECT recipient AS person, lower(replace(place, '_', '')) || '.example' AS domain, count(*) AS weight FROM mail_line
  WHERE recipient IS NOT NULL GROUP BY 1, 2),
u AS (SELECT person, domain, 'out' AS direction, weight FROM o UNION ALL SELECT person, domain, 'in', weight FROM i)
SELECT * FROM u WHERE list_contains((SELECT list(lower(replace(n_name, '_', '')) || '.example') FROM nation WHERE n_regionkey < 3), domain)""")
def _(t):
    from tieline.operators.knowledge import external_edges

    domains = t.nation.where("n_regionkey < 3").select(F.concat(F.lower(F.replace("n_name", F.lit("_"))), F.lit(".example")).alias("domain"))
    sent = t.mail.select("sender_email", "recipients_emails")
    got = t.mail_line.where("recipient is not null").select(
        F.col("outside_email").alias("sender_email"),
        F.array(F.concat(F.lower(F.replace("recipient", F.lit("#"), F.lit("."))), F.lit("@corp.example"))).alias("recipients_emails"),
    )
    names = t.person.select(F.col("email").alias("address"), "name")
    return external_edges(sent.unionByName(got), names, domains)


@query("average_ranks", "E17", """
SELECT event_id, round(rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0, 1) AS avg_rank FROM events""")
def _(t):
    r = ordering.value_ranks(t.events, "value").select("value", F.round(ordering.average_rank(), 1).alias("avg_rank"))
    return t.events.select("event_id", "value").join(r, "value").select("event_id", "avg_rank")


@query("quantile_tiers", "E15", """
WITH q AS (SELECT list_sort(list_distinct(quantile_cont(balance, [0.2, 0.4, 0.6, 0.8]))) AS e FROM person)
SELECT name, len(list_filter(e, lambda x: x < balance)) AS tier FROM person, q""")
def _(t):
    from tieline.operators.scoring import quantile_tiers

    return quantile_tiers(t.person.select("name", "balance"), "balance").select("name", F.col("tier").cast("bigint").alias("tier"))


@query("thread_read_out", "F1 H24", f"""
WITH k AS (SELECT thread_key FROM mail WHERE thread_key <> '' GROUP BY thread_key ORDER BY count(*) DESC, thread_key LIMIT 1)
SELECT email_id, thread_position, {STAMP.format('date')} AS date, CASE WHEN length(trim(text)) > 300 THEN rtrim(substr(trim(text), 1, 299)) || '…' ELSE trim(text) END AS body_excerpt
FROM mail_full JOIN k USING (thread_key) JOIN documents USING (doc_id)""")
def _(t):
    from tieline.operators.retrieval import thread_read_out

    slim = cut_lineage(t.mail.select("email_id", "thread_key", "date", "doc_id"))
    key = slim.where("thread_key <> ''").groupBy("thread_key").count().orderBy(F.desc("count"), "thread_key").first()[0]
    # A place in a thread depends on that thread's mails alone.
    one = cut_lineage(slim.where(F.col("thread_key") == key))
    m = one.join(threads.thread_features(one), "email_id").join(t.documents.select("doc_id", F.col("text").alias("body_truncated")), "doc_id")
    return thread_read_out(m, key).select("email_id", "thread_position", stamp("date", "date"), "body_excerpt")


@query("strong_contacts", "F6", """
SELECT name, direction, other, weight, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY name, direction ORDER BY weight DESC, other) AS rn FROM (
 SELECT src AS name, 'out' AS direction, dst AS other, weight FROM contact UNION ALL SELECT dst, 'in', src, weight FROM contact)) WHERE rn <= 8""")
def _(t):
    from tieline.operators.retrieval import ranked_contacts

    return ranked_contacts(t.contact, 8).select("name", "direction", "other", "weight", "rank")


@query("top_by_metric", "F2 B12", """
SELECT name, title, level AS tier, balance AS score FROM person WHERE level = 3 ORDER BY balance DESC, name LIMIT 10""")
def _(t):
    from tieline.operators.scoring import leaders

    return leaders(t.person.withColumnRenamed("level", "tier"), "balance", allowed=("balance",), tier=3, n=10)


@query("person_mailbox", "C32", f"""
SELECT sender AS name, 'sent' AS direction, sender AS "from", array_to_string(recipients, ', ') AS recipients_text, subject, email_id, {STAMP.format('date')} AS date FROM mail
UNION ALL SELECT DISTINCT recipient, 'received', sender, array_to_string(recipients, ', '), subject, email_id, {STAMP.format('date')} FROM mail_to WHERE recipient <> sender""")
def _(t):
    from tieline.operators.retrieval import mailbox

    out = mailbox(t.mail)
    return out.select("name", "direction", "from", "recipients_text", "subject", "email_id", stamp("date", "date"))
