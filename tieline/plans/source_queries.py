"""Readers, sinks, model jobs and streams over files that Spark derives from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieline.functions import text as X
from tieline.operators import evaluation, models
from tieline.plans.columns import listed, r6, stamp
from tieline.plans.registry import query
from tieline.session import work_dir
from tieline.sources import readers, sinks
from tieline.sources.cache import TableCache
from tieline.streaming import jobs


@query("mail_files", "A2 A4 A20", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    path = work_dir(t.spark, "orders")
    sinks.write_table(t.orders.select("o_orderkey", "o_custkey"), path)
    return readers.read_mail(t.spark, path)


@query("csv_round_trip", "A6", """SELECT p_partkey, p_name || ' "x", y' AS p_name, p_retailprice FROM part""")
def _(t):
    path = work_dir(t.spark, "csv")
    sinks.write_csv(t.part.select("p_partkey", F.concat("p_name", F.lit(' "x", y')).alias("p_name"), "p_retailprice"), path)
    return readers.read_csv(t.spark, path, "p_partkey bigint, p_name string, p_retailprice double")


@query("last_log_record", "A8", """
SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def _(t):
    path = work_dir(t.spark, "log")
    e = t.events.select("user_id", "event_id", "event_type", F.col("event_id").alias("seq"))
    line = F.when(F.col("event_type") == "error", F.concat(F.lit('{"user_id": '), F.col("user_id").cast("string"))).otherwise(F.to_json(F.struct("user_id", "event_id", "seq")))
    e.select(line.alias("value")).write.text(path)
    return readers.read_log(t.spark, path, "user_id bigint, event_id bigint, seq bigint", ["user_id"], "seq").drop("seq")


@query("transcripts", "A9", "SELECT conv_id, turn, role, 'c' || (conv_id % 3) AS condition FROM conversations")
def _(t):
    path = work_dir(t.spark, "talk")
    c = t.conversations
    head = c.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).alias("turn_id"), F.lit(True).alias("_header"), F.col("conv_id").cast("string").alias("scenario_name"),
        F.concat(F.lit("c"), (F.col("conv_id") % 3).cast("string")).alias("condition"),
    )
    body = c.select("conv_id", F.col("turn").alias("turn_id"), F.col("role").alias("sender"), F.array(F.lit("*")).alias("recipients"), F.col("text").alias("body"))
    # Many conversations a file, whose lines name their own: a file each would cost more to make, list and open than to read.
    rows = head.unionByName(body, allowMissingColumns=True).withColumn("transcript", F.col("conv_id").cast("string"))
    rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn_id").drop("conv_id").write.json(path)
    out = readers.read_transcripts(t.spark, path)
    return out.select(F.col("scenario_name").cast("bigint").alias("conv_id"), F.col("turn_id").cast("bigint").alias("turn"), F.col("sender").alias("role"), "condition")


@query("verdicts", "A10 D20", """
WITH g AS (SELECT CAST(user_id AS VARCHAR) AS scenario, event_type AS condition, max(value) AS hi, round(avg(value), 3) AS mean FROM events GROUP BY ALL)
SELECT scenario, condition, 'clarity' AS dimension, round(hi, 6) AS score FROM g UNION ALL SELECT scenario, condition, '_mean', round(mean, 6) FROM g
UNION ALL SELECT scenario, condition, '_turn_flag_count', 0 FROM g""")
def _(t):
    path = work_dir(t.spark, "verdict")
    v = t.events.groupBy("user_id", "event_type").agg(F.max("value").alias("hi"), F.round(F.avg("value"), 3).alias("mean_score"))
    v = v.select(
        F.col("user_id").cast("string").alias("scenario_name"), F.col("event_type").alias("condition"), "mean_score",
        F.create_map(F.lit("clarity"), F.struct(F.col("hi").alias("score"), F.lit("ok").alias("justification"))).alias("scores"),
    )
    sinks.write_json_arrays(v, path)
    rows = evaluation.verdict_rows(readers.read_verdicts(t.spark, path))
    return rows.select("scenario", "condition", "dimension", r6("score", "score"))


@query("tool_call_log", "A11 D23", """
SELECT event_type AS tool, count(*) AS n, round(count(*) FILTER (CAST(props->>'$.k' AS BIGINT) > 90) / count(*), 4) AS error_rate FROM events GROUP BY 1""")
def _(t):
    path = work_dir(t.spark, "calls")
    k = F.get_json_object("props", "$.k").cast("bigint")
    t.events.select(F.col("event_type").alias("tool"), F.from_json("props", "map<string,string>").alias("args"), F.col("value").alias("latency_ms"), F.when(k > 90, "late").alias("error")).write.json(path)
    return evaluation.tool_usage(readers.read_tool_calls(t.spark, path))


@query("html_cells", "A13", r"""
SELECT page_id, u.i AS pos, c[u.i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS c FROM pages), unnest(range(1, len(c) + 1)) AS u(i)""")
def _(t):
    cells = readers.table_cells(F.col("html"), r'<a href="([^"]*)">([^<]*)</a>', 2)
    return t.pages.select("page_id", F.posexplode(cells).alias("p", "c")).select("page_id", (F.col("p") + 1).cast("bigint").alias("pos"), F.col("c.c0").alias("href"))


@query("partial_update", "A15", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN round(c_acctbal * 2, 2) ELSE c_acctbal END AS c_acctbal, c_name FROM customer""")
def _(t):
    new = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.round(F.col("c_acctbal") * 2, 2).alias("c_acctbal"))
    extra = new.select((-1 - F.col("c_custkey")).alias("c_custkey"), "c_acctbal")
    return sinks.update_columns(t.customer.select("c_custkey", "c_acctbal", "c_name"), new.unionByName(extra), "c_custkey", ["c_acctbal"])


@query("newest_source", "A19", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    live, final = work_dir(t.spark, "live"), work_dir(t.spark, "final")
    sinks.append_json(t.nation.limit(1), live)
    sinks.write_table(t.nation, final)
    out = readers.newest(t.spark, final, live, t.spark.read.parquet, t.spark.read.json)
    return out.select("n_nationkey", "n_name")


@query("people_directory", "A1", "SELECT s_name AS name, '' AS given_name, lower(s_name) AS email, 'N' || s_nationkey AS organisation FROM supplier")
def _(t):
    path = work_dir(t.spark, "people")
    people = t.supplier.select(F.col("s_name").alias("name"), F.lower("s_name").alias("email"), F.struct(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("legalName")).alias("affiliation"))
    sinks.write_json_arrays(people, path)
    return readers.read_people(t.spark, path).select("name", "given_name", "email", "organisation")


@query("organisation_list", "A7", """
SELECT domain, n_name AS company_name, 'R' || n_regionkey AS category, total_emails FROM (SELECT lower(n_name) || '.example' AS domain, n_name, n_regionkey, count(s_suppkey) AS total_emails
 FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL) ORDER BY total_emails DESC, domain LIMIT 10""")
def _(t):
    path = work_dir(t.spark, "organisations")
    n = t.nation.join(t.supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name", "n_regionkey").agg(F.count("s_suppkey").alias("total_emails"))
    rows = n.select(F.concat(F.lower("n_name"), F.lit(".example")).alias("domain"), F.col("n_name").alias("company_name"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("category"), "total_emails")
    sinks.write_json_arrays(rows, path, field="organizations")
    return readers.read_organisations(t.spark, path, 10).select("domain", "company_name", "category", "total_emails")


#: Tag of an annotator → act.
TAGS = {"req": "request", "cmt": "commit", "prop": "propose"}


@query("labelled_sentences", "A12 G7", """
WITH m AS (SELECT conv_id, turn, unnest([CASE turn % 3 WHEN 0 THEN 'request' WHEN 1 THEN 'commit' END, CASE turn % 4 WHEN 0 THEN 'request' WHEN 1 THEN 'propose' END]) AS act FROM conversations)
SELECT conv_id || '/' || turn AS sentence_id, text AS sentence_text, coalesce(array_to_string(list_sort(list(DISTINCT act) FILTER (act IS NOT NULL)), '|'), '') AS acts
FROM conversations JOIN m USING (conv_id, turn) GROUP BY ALL""")
def _(t):
    corpus, notes = work_dir(t.spark, "corpus-xml"), work_dir(t.spark, "notes-xml")
    # A thread element takes 64 turns of a conversation at most; the reader puts a thread's elements together by sentence id.
    c = t.conversations.withColumn("block", F.floor(F.col("turn") / 64))
    key = F.col("turn").cast("string").alias("_id")
    listno = F.col("conv_id").cast("string").alias("listno")
    sent = F.array_sort(F.collect_list(F.struct(key, F.col("text").alias("_VALUE"))))
    docs = c.groupBy("conv_id", "block").agg(sent.alias("s")).select(listno, F.array(F.struct(F.struct(F.col("s").alias("Sent")).alias("Text"))).alias("DOC"))
    docs.write.format("xml").option("rowTag", "thread").save(corpus)

    def marks(cond):
        return F.array_compact(F.collect_list(F.when(cond, F.struct(key, F.lit("x").alias("_VALUE")))))

    two = c.groupBy("conv_id", "block").agg(
        F.struct(marks(F.col("turn") % 3 == 0).alias("req"), marks(F.col("turn") % 3 == 1).alias("cmt"), marks(F.lit(False)).alias("prop")).alias("a"),
        F.struct(marks(F.col("turn") % 4 == 0).alias("req"), marks(F.lit(False)).alias("cmt"), marks(F.col("turn") % 4 == 1).alias("prop")).alias("b"),
    )
    two.select(listno, F.array(F.struct(F.col("a").alias("labels")), F.struct(F.col("b").alias("labels"))).alias("annotation")).write.format("xml").option("rowTag", "thread").save(notes)
    out = readers.read_labelled_sentences(t.spark, corpus, notes, TAGS)
    return out.select("sentence_id", "sentence_text", listed("acts", "acts"))


@query("run_logs", "A11", """
SELECT event_id::VARCHAR AS question_id, event_type AS category, 1 + (event_id % 2) AS n_tool_calls, value AS wall_time_ms, CAST(props->>'$.k' AS BIGINT) >= 50 AS passed FROM events""")
def _(t):
    path = work_dir(t.spark, "runs")
    call = F.struct(F.lit("search").alias("name"), F.col("value").alias("latency_ms"))
    e = t.events.select(
        F.col("event_id").cast("string").alias("question_id"), F.col("event_type").alias("category"), F.when(F.col("event_id") % 2 == 1, F.array(call, call)).otherwise(F.array(call)).alias("tool_calls"),
        F.col("value").alias("wall_time_ms"), (F.get_json_object("props", "$.k").cast("bigint") >= 50).alias("pass"),
    )
    sinks.append_json(e, path)
    return readers.read_runs(t.spark, path).select("question_id", "category", F.size("tool_calls").alias("n_tool_calls"), "wall_time_ms", "passed")


@query("missing_numbers", "B18", "SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events")
def _(t):
    read = F.when(F.col("event_type") == "error", F.lit("NaN")).otherwise(F.col("value").cast("string")).cast("double")
    return t.events.select("event_id", X.nan_to_null(read).alias("value"))


@query("graph_cache", "A20 A17", """
SELECT src, dst, weight FROM contact""")
def _(t):
    folder, inputs = work_dir(t.spark, "graph"), [f"{t.sf_dir}/{n}.parquet" for n in ("orders", "lineitem", "customer", "supplier", "nation", "documents")]

    def build():
        edges = t.contact
        # Merging the same edges again leaves one row a pair: what a second run of an ingest does.
        twice = sinks.merge_graph(edges, edges, ["src", "dst"], [F.col("weight").desc()])
        return {"nodes": t.person.select("name", "level"), "edges": twice}

    cache = TableCache(t.spark, folder, inputs, {"minimum": 1})
    cache.get(build)
    return cache.get(build)["edges"]


@query("embedded_texts", "L1 M3")
def _(t):
    out = models.embed_column(t.documents, "doc_id", "text", models.hashing_embedder(32))
    return out.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


def _echo(prompt: str) -> str:
    return prompt if "{" in prompt else "nothing"


@query("resumed_embeddings", "L1")
def _(t):
    path = work_dir(t.spark, "embeddings")
    jobs_log = models.AnswerLog(t.spark, path, "doc_id", "bigint", "array<float>")
    answer = models.embedding_batches(models.hashing_embedder(32))
    jobs_log.run(t.documents.where("doc_id % 2 = 0"), "text", answer)  # a first run that got half-way
    jobs_log.run(t.documents, "text", answer)
    return jobs_log.read().select("doc_id", F.size("result").alias("dims"), F.round(F.aggregate("result", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("resumed_payloads", "L2", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(props->>'$.k' AS BIGINT) END AS k, CASE WHEN event_type = 'error' THEN 'no JSON object' END AS failure FROM events""")
def _(t):
    prompt = F.when(F.col("event_type") == "error", "none").otherwise(F.concat(F.lit("answer: "), F.col("props")))
    asked = t.events.select("event_id", prompt.alias("prompt"))
    jobs_log = models.AnswerLog(t.spark, work_dir(t.spark, "payloads"), "event_id", "bigint", "string")
    jobs_log.run(asked.where("event_id % 3 = 0"), "prompt", models.payload_answers(_echo))
    jobs_log.run(asked, "prompt", models.payload_answers(_echo))
    return jobs_log.read().select("event_id", F.get_json_object("result", "$.k").cast("bigint").alias("k"), "failure")


@query("extracted_payloads", "L2 M3", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN CAST(props->>'$.k' AS BIGINT) END AS k, CASE WHEN event_type = 'error' THEN 'no JSON object' END AS failure FROM events""")
def _(t):
    prompt = F.when(F.col("event_type") == "error", "none").otherwise(F.concat(F.lit("answer: "), F.col("props")))
    out = models.extract_structured(t.events.select("event_id", prompt.alias("prompt")), "event_id", "prompt", _echo)
    return out.select("event_id", F.get_json_object("payload", "$.k").cast("bigint").alias("k"), "failure")


def event_stream(t):
    src = jobs.stream_files(t.spark, t.sf_dir, t.events.schema, "events.parquet")
    return src.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_volume", "N2 D7", """
WITH d AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS s, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, n FROM d WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY""")
def _(t):
    path = work_dir(t.spark, "volume")
    jobs.run_to_table(jobs.volume(event_stream(t)), path).awaitTermination()
    out = t.spark.read.schema("start timestamp, n bigint").parquet(path)
    return out.select(stamp("start", "start"), "n")


@query("stream_upsert", "N3 A14", """
SELECT 'u' || user_id AS sender, event_type AS recipient, count(*) AS n_emails, round(sum(value), 4) AS sum_sentiment FROM events GROUP BY ALL""")
def _(t):
    path = work_dir(t.spark, "pairs")
    mail = event_stream(t).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sender"), F.array("event_type").alias("recipients"), F.col("value").alias("sentiment"))
    jobs.run_upsert(jobs.pair_sums(mail), path, ["sender", "recipient"]).awaitTermination()
    return jobs.UpsertTable(t.spark, path, ["sender", "recipient"]).read().select("sender", "recipient", "n_emails", r6("sum_sentiment", "sum_sentiment", 4))


@query("stream_thread_replies", "N4 E2", """
SELECT thread_key, responder, original, round(s, 6) AS seconds FROM (SELECT event_type AS thread_key, 'u' || user_id AS responder, lag('u' || user_id) OVER w AS original,
 (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS s, ts FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id::VARCHAR))
WHERE responder <> original AND s > 0 AND s < 604800""")
def _(t):
    path, folder = work_dir(t.spark, "replies"), work_dir(t.spark, "events")
    cols = ["event_id", "user_id", "event_type", "ts"]
    t.events.select(cols).write.parquet(folder)
    # The stream ends with a row of its own thread far later: it moves the watermark past every event, so none stays held.
    last = t.events.agg(F.lit(None).cast("bigint").alias("event_id"), F.lit(None).cast("bigint").alias("user_id"), F.lit("end").alias("event_type"), (F.max("ts") + F.expr("INTERVAL 60 DAYS")).alias("ts"))
    last.select([F.col(c).cast(t.events.schema[c].dataType).alias(c) for c in cols]).write.mode("append").parquet(folder)
    mail = jobs.stream_files(t.spark, folder, t.events.select(cols).schema, "*.parquet").select(
        F.col("event_type").alias("thread_key"), F.col("event_id").cast("string").alias("email_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("sender"), F.col("ts").cast("timestamp").alias("date")
    )
    jobs.run_to_table(jobs.thread_replies(mail), path).awaitTermination()
    out = t.spark.read.schema("thread_key string, responder string, original string, seconds double").parquet(path)
    return out.select("thread_key", "responder", "original", r6("seconds", "seconds"))


@query("stream_clean_ingest", "N1 D32", """
WITH m AS (SELECT 'u' || user_id AS f, [event_type, 'all'] AS r, ts, event_type AS s, props || repeat('x', 100) AS b FROM events)
SELECT substr(sha256(concat_ws('|', f, array_to_string(list_sort(list_transform(r, lambda x: lower(x))), ','), strftime(ts, '%Y-%m-%d %H:%M:%S'), s)), 1, 16) AS email_id, f AS sender_email FROM m GROUP BY ALL""")
def _(t):
    path = work_dir(t.spark, "ingest")
    raw = event_stream(t).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("from"), F.array("event_type", F.lit("all")).alias("to"), F.col("ts").alias("date"),
        F.col("event_type").alias("subject"), F.concat("props", F.lit("x" * 100)).alias("body"),
    )
    jobs.run_to_table(jobs.clean_ingest(raw.unionByName(raw)), path).awaitTermination()
    out = t.spark.read.schema("email_id string, sender_email string").parquet(path)
    return out.select("email_id", "sender_email")


@query("guarded_sql", "B13 M1", "SELECT c_mktsegment AS segment, count(*) AS n, false AS truncated FROM customer GROUP BY 1")
def _(t):
    from tieline.operators.catalog import build_catalog

    t.customer.createOrReplaceTempView("people_view")
    return build_catalog(t.spark, {}).call("query_sql", sql="SELECT c_mktsegment AS segment, count(*) AS n FROM people_view GROUP BY c_mktsegment")


@query("representative_ids", "A7 C11", """
SELECT n_regionkey AS region, array_to_string(list(n_name ORDER BY n_name), '|') AS names FROM nation GROUP BY 1""")
def _(t):
    return t.nation.groupBy(F.col("n_regionkey").alias("region")).agg(listed(F.array_sort(F.collect_set("n_name")), "names"))
