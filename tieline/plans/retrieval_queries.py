"""Parameterised lookups, samples, personas and text assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieline.functions import text as X
from tieline.functions.payloads import first_json_object
from tieline.operators import persona as P
from tieline.operators import retrieval as R
from tieline.operators import rollups, sampling, threads, vectors
from tieline.plans.columns import listed, r6, stamp
from tieline.plans.registry import query
from tieline.session import cut_lineage

STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"
CUT = "1998-01-01"


@query("find_emails", "B8 M1", """
SELECT email_id, sender, subject FROM mail WHERE date < TIMESTAMP '1998-01-01' AND date >= TIMESTAMP '1995-01-01' AND list_contains(speech_acts, 'request')
 AND list_contains(topics, 'Brand#7') AND lower(subject) LIKE '%lot 1%' AND decision_carrying AND sentiment >= -0.9 AND sentiment <= 1 ORDER BY date DESC, email_id LIMIT 25""")
def _(t):
    out = R.find_emails(
        t.mail, before_date=CUT, after_date="1995-01-01", speech_act="request", topic="Brand#7", subject_contains="LOT 1",
        decision_carrying=True, sentiment_min=-0.9, sentiment_max=1.0, n=25,
    )
    return out.select("email_id", "sender", "subject")


@query("email_content", "B14 H24", """
WITH m AS (SELECT email_id, sender, trim(text) AS b, body_chars FROM mail JOIN documents USING (doc_id)), w AS (SELECT email_id FROM m ORDER BY body_chars DESC, email_id LIMIT 1)
SELECT email_id, true AS found, sender, md5(CASE WHEN length(b) > 4000 THEN rtrim(substr(b, 1, 3999)) || '…' ELSE b END) AS body_digest, length(b) > 4000 AS was_cut FROM m JOIN w USING (email_id)
UNION ALL SELECT 'nobody', false, NULL, md5(''), false""")
def _(t):
    m = t.mail.join(t.documents.select("doc_id", F.col("text").alias("body_truncated")), "doc_id")
    top = t.mail.select("email_id", "body_chars").orderBy(F.desc("body_chars"), "email_id").first()["email_id"]
    both = R.email_content(m, top).unionByName(R.email_content(m, "nobody"))
    return both.select("email_id", "found", "sender", F.md5("body").alias("body_digest"), "was_cut")


@query("thread_history", "F3", """
WITH p AS (SELECT src, dst FROM contact ORDER BY weight DESC, src, dst LIMIT 1)
SELECT email_id, subject FROM mail_to JOIN p ON src = sender AND dst = recipient WHERE date < TIMESTAMP '2030-01-01' ORDER BY date DESC, email_id LIMIT 5""")
def _(t):
    p = t.contact.orderBy(F.desc("weight"), "src", "dst").first()
    return R.thread_history(t.mail, p["src"], p["dst"], "2030-01-01").select("email_id", "subject")


@query("pair_lookup", "M2", """
WITH p AS (SELECT src, dst FROM contact ORDER BY weight DESC, src, dst LIMIT 1) SELECT c.src AS sender_id, c.dst AS recipient_id, c.weight AS n_emails FROM contact c JOIN p USING (src, dst)""")
def _(t):
    from tieline.operators.catalog import pair_lookup

    p = t.contact.orderBy(F.desc("weight"), "src", "dst").first()
    pairs = rollups.pair_base(t.mail_full).select("sender_id", "recipient_id", "n_emails")
    return pair_lookup(pairs, name1=p["src"], name2=p["dst"])


MT_SQL = "SELECT email_id, sender, date, u.x AS topic FROM mail, unnest(topics) AS u(x)"


def mail_topics(t):
    return t.mail.select("email_id", "sender", "date", F.explode_outer("topics").alias("topic"))


@query("topic_collaborators", "C14", f"""
WITH mt AS ({MT_SQL}) SELECT sender AS name, count(DISTINCT email_id) AS n_emails_on_topic FROM mt WHERE contains(lower(topic), 'brand#1') AND date < TIMESTAMP '1998-01-01'
GROUP BY sender ORDER BY n_emails_on_topic DESC, name LIMIT 10""")
def _(t):
    return R.topic_collaborators(mail_topics(t), "BRAND#1", CUT, 10)


CARD_SQL = f"""
rp AS (SELECT src AS s, min(dst) AS b FROM (SELECT *, min((weight % 21) / 10.0 - 1) OVER (PARTITION BY src) AS lo FROM contact WHERE (weight % 21) / 10.0 - 1 < -0.5) WHERE (weight % 21) / 10.0 - 1 = lo GROUP BY src),
mt AS ({MT_SQL} WHERE date < TIMESTAMP '1998-01-01'),
ct AS (SELECT sender, count(*) AS n FROM mail WHERE date < TIMESTAMP '1998-01-01' GROUP BY sender),
tt AS (SELECT sender, string_agg(topic, '|' ORDER BY rn) AS top FROM (SELECT sender, topic, row_number() OVER (PARTITION BY sender ORDER BY n DESC, topic) AS rn FROM
  (SELECT sender, topic, count(*) AS n FROM mt GROUP BY ALL)) WHERE rn <= 5 GROUP BY sender)"""


def membership(t):
    return t.person.select("name", "team")


@query("person_cards", "C15 M1", f"""
WITH {CARD_SQL}, br AS (SELECT b, string_agg(s, '|' ORDER BY s) AS reps FROM rp GROUP BY b)
SELECT name, title, level AS tier, rp.b AS reports_to, coalesce(br.reps, '') AS direct_reports, team AS teams, coalesce(n, 0) AS n_emails_sent, coalesce(top, '') AS top_topics
FROM person LEFT JOIN rp ON rp.s = name LEFT JOIN br ON br.b = name LEFT JOIN ct ON ct.sender = name LEFT JOIN tt ON tt.sender = name""")
def _(t):
    from tieline.plans.graph_queries import reports

    people = t.person.select("name", "title", F.col("level").alias("tier"))
    out = R.person_cards(people, reports(t), membership(t), mail_topics(t), CUT)
    lists = ["direct_reports", "teams", "top_topics"]
    return out.select("name", "title", "tier", "reports_to", "n_emails_sent", *[listed(c, c) for c in lists])


@query("person_context", "C16", """
WITH a AS (SELECT DISTINCT name, other, weight FROM (SELECT src AS name, dst AS other, weight FROM contact UNION ALL SELECT dst, src, weight FROM contact)),
k AS (SELECT name, string_agg(other || ' (' || weight || ' interactions)', '|' ORDER BY rn) AS contacts FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY weight DESC, other) AS rn FROM a) WHERE rn <= 5 GROUP BY name)
SELECT p.name, team AS teams, coalesce(contacts, '') AS contacts FROM person p LEFT JOIN k USING (name)""")
def _(t):
    from tieline.plans.graph_queries import reports

    knows = t.mail.select(F.col("sender").alias("name"), F.explode("topics").alias("topic")).distinct()
    out = R.person_context(t.person.select("name"), reports(t), membership(t), t.contact, knows)
    return out.select("name", listed("teams", "teams"), F.coalesce(F.array_join("contacts", "|"), F.lit("")).alias("contacts"))


@query("person_profiles", "C30", """
SELECT name, email, level, coalesce(b.received, 0) AS received, coalesce(c.sent, 0) AS sent FROM person LEFT JOIN (SELECT dst AS name, CAST(sum(weight) AS BIGINT) AS received FROM contact GROUP BY dst) b USING (name)
LEFT JOIN (SELECT src AS name, CAST(sum(weight) AS BIGINT) AS sent FROM contact GROUP BY src) c USING (name)""")
def _(t):
    got = t.contact.groupBy(F.col("dst").alias("name")).agg(F.sum("weight").alias("received"))
    gave = t.contact.groupBy(F.col("src").alias("name")).agg(F.sum("weight").alias("sent"))
    out = R.profiles(t.person.select("name", "email", "level"), [got, gave])
    return out.select("name", "email", "level", F.coalesce("received", F.lit(0)).alias("received"), F.coalesce("sent", F.lit(0)).alias("sent"))


@query("goby_names", "C19", """
SELECT name, 'Customer ' || split_part(name, '#', 2) AS spelling FROM person UNION ALL SELECT name, title || ' ' || split_part(name, '#', 2) FROM person""")
def _(t):
    from tieline.operators.identity import goby_names
    from tieline.plans.corpus_queries import directory

    people = directory(t).drop("additional_name").join(t.person.select("name", F.concat("title", F.lit(".")).alias("additional_name")), "name")
    return goby_names(people, t.person)


@query("fuzzy_names", "C20")
def _(t):
    from tieline.operators.identity import fuzzy_names

    left = t.supplier.select(F.concat(F.lit("Suplier "), F.substring("s_name", 10, 20)).alias("name"))
    return fuzzy_names(left, t.supplier.select(F.col("s_name").alias("name"))).select("name", "match", r6("ratio", "ratio"))


@query("folder_names", "C22", """
SELECT lower(title) || '-' || person_key AS folder, CASE WHEN level > 0 THEN name END AS name FROM person""")
def _(t):
    from tieline.plans.corpus_queries import directory

    d = directory(t)
    known = d.join(t.person.where("level > 0").select("name"), "name", "left_semi").select("folder_name", "name")
    return d.select("folder_name").join(known, "folder_name", "left").select(F.col("folder_name").alias("folder"), "name")


@query("body_backfill", "C23", """
SELECT email_id, md5(CASE WHEN decision_carrying THEN 'kept' ELSE text END) AS digest FROM mail JOIN documents USING (doc_id) WHERE action_required""")
def _(t):
    # Bodies lie once a document, so the hits go to them; one row a mail would carry every body again.
    hits = t.mail.where("action_required").select("email_id", "doc_id", F.when(F.col("decision_carrying"), F.lit("kept")).alias("body"))
    full = t.documents.select("doc_id", F.col("text").alias("body"))
    return R.backfill(hits, full, "doc_id", "body").select("email_id", F.md5("body").alias("digest"))


@query("entity_samples", "C25", """
WITH d AS (SELECT email_id, body_chars, u.a FROM mail, unnest(list_concat([sender_email], recipients_emails)) AS u(a)),
n AS MATERIALIZED (SELECT DISTINCT d.email_id, d.body_chars, split_part(a, '@', 2) AS dom FROM d),
w AS (SELECT * FROM (VALUES ('nation1'), ('ation2.ex')) v(domain)), x AS (SELECT DISTINCT domain, email_id, body_chars FROM n, w WHERE contains(dom, domain))
SELECT domain, email_id, body_chars, rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY body_chars DESC, email_id) AS rank FROM x) WHERE rank <= 10""")
def _(t):
    domains = t.region.where("r_regionkey < 2").select(F.when(F.col("r_regionkey") == 0, "nation1").otherwise("ation2.ex").alias("domain"))
    return R.entity_samples(t.mail, domains).select("domain", "email_id", "body_chars", "rank")


@query("array_candidates", "C26", """
SELECT l_orderkey, b FROM (SELECT l_orderkey, min(l_quantity) AS b FROM lineitem GROUP BY 1) JOIN (SELECT l_orderkey, max(l_linenumber) AS g FROM lineitem GROUP BY 1) USING (l_orderkey) WHERE g <> 3""")
def _(t):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("g"), F.min("l_quantity").alias("q"))
    cands = F.array(F.struct(F.lit(0).alias("dataset_id"), F.lit(0.0).alias("content")), F.struct(F.when(F.col("g") != 3, F.col("g")).alias("dataset_id"), F.col("q").alias("content")))
    return R.pick_candidate(rows.withColumn("cands", cands), "cands", F.col("g")).select("l_orderkey", F.col("candidate.content").alias("b"))


@query("temporal_retrieval", "C27", f"""
SELECT email_id, {STAMP.format('date')} AS date FROM mail WHERE date >= TIMESTAMP '1996-01-01' AND date <= TIMESTAMP '1996-06-30' AND decision_carrying ORDER BY date, email_id LIMIT 10""")
def _(t):
    return R.decisions_between(t.mail, "1996-01-01", "1996-06-30").select("email_id", stamp("date", "date"))


@query("person_retrieval", "C28", f"""
SELECT DISTINCT email_id, {STAMP.format('date')} AS date FROM (SELECT email_id, date, sender AS p FROM mail UNION ALL SELECT email_id, date, recipient FROM mail_to) WHERE contains(lower(p), '0099') ORDER BY date DESC, email_id LIMIT 10""")
def _(t):
    return R.mails_of_person(t.mail, "0099").select("email_id", stamp("date", "date"))


@query("retrieval_with_fallback", "C29", """
WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY label, i),
c AS MATERIALIZED (SELECT label, list(v ORDER BY i) AS centroid FROM x GROUP BY label), e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT label AS query_id, vec_id, rank, false AS used_fallback FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM e WHERE label < 4) WHERE rank <= 3
UNION ALL SELECT query_id, vec_id, rank, true FROM (SELECT c.label AS query_id, e.vec_id, row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(c.centroid, e.v), 9) DESC, e.vec_id) AS rank FROM c, e WHERE c.label >= 4) WHERE rank <= 3""")
def _(t):
    from tieline.operators.ordering import top_per_key
    from tieline.plans.vector_queries import label_queries

    direct = top_per_key(t.embeddings.where("label < 4").select(F.col("label").alias("query_id"), "vec_id"), ["query_id"], [F.col("vec_id")], 3)
    return R.with_fallback(label_queries(t), direct, lambda q: vectors.cosine_top_k(t.embeddings, q, 3), "query_id").select("query_id", "vec_id", "rank", "used_fallback")


@query("signal_phrases", "H23", r"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Jane Doe|Dr. Smith|10Q|FERC|May 5|Monday' WHEN 1 THEN 'PG&E|Friday|Sarah' ELSE 'Art Bo Cy' END AS phrases FROM documents""")
def _(t):
    q = F.expr(r"CASE doc_id % 3 WHEN 0 THEN 'did Jane Doe and Dr. Smith file 10Q at FERC on May 5 a Monday?' WHEN 1 THEN 'by Sarah about PG&E Friday' ELSE 'Art Bo Cy' END")
    return t.documents.select("doc_id", listed(X.signal_phrases(q), "phrases"))


@query("phrase_matches", "C21 H23 K13", r"""
WITH m AS (SELECT email_id, thread_key, 3 + (email_id % 2 = 0)::INT AS score FROM (SELECT CAST(email_id AS BIGINT) AS email_id, thread_key FROM mail WHERE thread_key <> '')),
s AS (SELECT email_id, score, min(email_id) OVER (PARTITION BY thread_key) AS qid, max(score) OVER (PARTITION BY thread_key) AS top_score FROM m),
n AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n_tied FROM s WHERE score = top_score)
SELECT qid, CAST(email_id AS VARCHAR) AS email_id, CAST(top_score AS BIGINT) AS top_score, n_tied FROM n WHERE n_tied <= 20""")
def _(t):
    lot = F.concat(F.lit("LOT"), F.split_part("thread_key", F.lit(" "), F.lit(2)), F.lit("Z"))
    # Written without bodies: each is joined on where the mails are read.
    slim = cut_lineage(t.mail.where("thread_key <> ''").select("email_id", "sender", "doc_id", lot.alias("lot")))
    texts = t.documents.select("doc_id", F.substring("text", 1, 1980).alias("body"))
    # Real bodies; every second mail also names its lot there.
    named = F.when(F.col("email_id").cast("bigint") % 2 == 0, F.col("lot"))
    m = slim.join(texts, "doc_id").select("email_id", "sender", F.concat(F.lit("x "), "lot").alias("subject"), F.concat_ws(" ", "body", named).alias("body_truncated"))
    q = slim.groupBy("lot").agg(F.min(F.col("email_id").cast("bigint")).alias("qid"))
    questions = q.select("qid", F.lit("").alias("question"), F.col("lot").alias("content"))
    out = R.phrase_matches(questions, m)
    return out.select("qid", "email_id", F.col("top_score").cast("bigint").alias("top_score"), "n_tied")


@query("json_objects", "H19", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(props->>'$.k' AS BIGINT) END AS k FROM events""")
def _(t):
    e = F.col("event_type")
    raw = (
        F.when(e == "click", F.concat(F.lit("Sure:\n```json\n"), F.col("props"), F.lit("\n```\nbye")))
        .when(e == "view", F.concat(F.lit("note \\{ x "), F.replace("props", F.lit("}"), F.lit(', "s": "a}b{"}')), F.lit(" {tail")))
        .when(e == "error", F.concat(F.lit("{broken "), F.col("props")))
        .otherwise(F.col("props"))
    )
    got = F.get_json_object(first_json_object(raw), "$.k").cast("bigint")
    return t.events.select("event_id", got.alias("k"))


@query("valid_signals", "H20 B17", """
SELECT event_id, CASE WHEN k % 2 = 0 THEN 'request|amend' ELSE 'commit' END AS speech_acts, k % 3 = 0 AS action_required, CASE WHEN k % 5 = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, (k - 50) / 10.0)) END AS sentiment
FROM (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events)""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    acts = F.when(k % 2 == 0, '["Request", "dance", "AMEND"]').otherwise('"Commit"')
    mood = F.when(k % 5 == 0, '"sad"').otherwise(((k - 50) / 10.0).cast("string"))
    raw = F.concat(F.lit('{"speech_acts": '), acts, F.when(k % 3 == 0, ', "action_required": true').otherwise(""), F.lit(', "sentiment": '), mood, F.lit("}"))
    s = t.events.select("event_id", P.valid_signals(raw).alias("s"))
    return s.select("event_id", listed(F.col("s.speech_acts"), "speech_acts"), F.col("s.action_required").alias("action_required"), F.col("s.sentiment").alias("sentiment"))


@query("snippets", "H24", """
WITH b AS (SELECT doc_id, text AS b, strpos(lower(text), 'e ') - 1 AS i, length(text) AS n FROM documents), s AS (SELECT *, greatest(0, i - 60) AS st FROM b)
SELECT doc_id, md5(CASE WHEN i < 0 THEN substr(b, 1, 120) ELSE substr(b, greatest(0, least(n, st + 120) - 120) + 1, 120) END) AS snippet FROM s""")
def _(t):
    return t.documents.select("doc_id", F.md5(X.snippet(F.col("text"), F.lit("E "), 120)).alias("snippet"))


@query("text_documents", "H25", """
SELECT name, name || ' — ' || title || '. Function: Unknown. ' || CASE WHEN level > 2 THEN 'Persona: formality=' || level || '. ' ELSE '' END || 'Topics: ' || team || ', x.' AS person_doc,
 name || ' (domain d' || level || '.example) is an external organization in the category ''' || title || '''. Relationship type to us: Unknown. Total observed email volume with us: ' || person_key || '.' AS entity_doc FROM person""")
def _(t):
    p = t.person
    doc = P.person_document(
        {"name": F.col("name"), "title": F.col("title"), "formality": F.when(F.col("level") > 2, F.col("level")), "topics": F.array("team", F.lit("x"))}
    )
    ent = P.entity_document(
        F.col("name"), F.concat(F.lit("d"), F.col("level").cast("string"), F.lit(".example")), F.col("title"), F.lit(None).cast("string"), F.col("person_key"), F.array().cast("array<string>")
    )
    return p.select("name", doc.alias("person_doc"), ent.alias("entity_doc"))


PERSONA_SQL = """
WITH m AS (SELECT sender, avg(CAST(list_contains(speech_acts, 'request') AS INT)) AS d, avg(CAST(decision_carrying AS INT)) AS a, avg(body_chars) AS w FROM mail GROUP BY sender),
g AS (SELECT avg(body_chars) AS mu FROM mail), s AS (SELECT sender, d, a, 1 / (1 + exp(-((w - mu) / mu))) AS v FROM m, g)"""


def persona_people(t):
    roll = t.mail.groupBy("sender").agg(
        F.avg(F.array_contains("speech_acts", "request").cast("double")).alias("pct_request_sent"),
        F.avg(F.col("decision_carrying").cast("double")).alias("pct_decision_carrying"),
        F.avg("body_chars").alias("mean_body_words"),
    )
    mu = t.mail.agg(F.avg("body_chars")).scalar()
    return P.signals(roll.withColumns({"top3_topics": F.array(F.lit("gas"), F.lit("power")), "hedge_rate": F.lit(0.25), "politeness_baseline": F.lit(0.6)}), mu)


@query("persona_signals", "H26", PERSONA_SQL + "SELECT sender, round(d, 6) AS directiveness, round(a, 6) AS agenda, round(v, 6) AS verbosity FROM s")
def _(t):
    p = persona_people(t)
    return p.select("sender", r6("directiveness_signal", "directiveness"), r6("agenda_setting_signal", "agenda"), r6("verbosity_signal", "verbosity"))


NARRATIVE_SQL = PERSONA_SQL + """
, y AS (SELECT *, CASE WHEN d > 0.4 AND a > 0.3 THEN 'directive' WHEN d < 0.2 AND a < 0.1 THEN 'passive' WHEN d > 0.3 THEN 'consultative' ELSE 'collaborative' END AS style,
 CASE WHEN v > 0.7 THEN 'verbose' WHEN v < 0.3 THEN 'terse' ELSE 'moderately concise' END AS verb FROM s)"""


@query("persona_narrative", "H27 L4", NARRATIVE_SQL + """
SELECT sender, style AS authority_style, CAST(3 AS INT) AS formality, 'Communicates in a ' || verb || ' style with a ' || style || ' authority pattern with hedge rate 0.25/100 words, primarily addressing gas, power.' AS communication_style,
 'Works in Unknown at the organisation, focused on gas, power.' AS role_summary FROM y""")
def _(t):
    p = P.narrative(persona_people(t).withColumn("function", F.lit(None).cast("string")))
    blank = p.withColumn("model", F.when(F.lit(False), F.col("heuristic")))
    m = P.heuristic_fallback(blank)
    return m.select("sender", *[F.col(f"model.{c}").alias(c) for c in ("authority_style", "formality", "communication_style", "role_summary")])


@query("merged_layers", "H28", NARRATIVE_SQL + """
SELECT sender, style AS authority_style, CASE WHEN d > 0.5 THEN 'law' ELSE 'gas|power' END AS expertise, round(d, 6) AS directiveness FROM y""")
def _(t):
    p = P.narrative(persona_people(t).withColumn("function", F.lit(None).cast("string")))
    model = F.col("heuristic").withField("expertise", F.when(F.col("directiveness_signal") > 0.5, F.array(F.lit("law"))).otherwise(F.array().cast("array<string>")))
    m = P.merge_layers(p.withColumn("model", model))
    return m.select("sender", "authority_style", listed("expertise", "expertise"), r6("directiveness_signal", "directiveness"))


@query("payload_rows", "L3", """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE substr(text, 1, 500) END AS deference_reasoning, 'transactional' AS relationship_type, '["' || source || '"]' AS shared_topics_json FROM documents""")
def _(t):
    ans = F.struct(
        F.lit(0.5).alias("deference_score"), F.when(F.col("doc_id") % 2 == 1, F.col("text")).alias("deference_reasoning"), F.lit(None).cast("string").alias("relationship_type"), F.array("source").alias("shared_topics")
    )
    d = t.documents.withColumn("a", ans)
    return d.select("doc_id", *P.pair_payload(F.col("a"))[1:])


@query("slugs", "H31", r"""
SELECT name, trim(regexp_replace(lower(name || ' & Co. (' || team || ')'), '[^a-z0-9]+', '_', 'g'), '_') AS slug, substr(trim(regexp_replace(lower(name || ' & Co.'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 12) AS short,
 replace(replace(replace(lower(title || ' J. X-Y'), ' ', '_'), '-', '_'), '.', '') AS name_slug FROM person""")
def _(t):
    return t.person.select(
        "name", X.slug(F.concat("name", F.lit(" & Co. ("), "team", F.lit(")"))).alias("slug"), X.slug(F.concat("name", F.lit(" & Co.")), "-", 12).alias("short"),
        X.name_slug(F.concat(F.lit(" "), "title", F.lit(" J. X-Y "))).alias("name_slug"),
    )


@query("list_parsing", "H36", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '|' || source WHEN 1 THEN lang || '|' || source ELSE '' END AS items FROM documents""")
def _(t):
    raw = F.expr("""CASE doc_id % 4 WHEN 0 THEN '["' || lang || '", "' || source || '"]' WHEN 1 THEN lang || ', ' || source || ',' WHEN 2 THEN '[broken' ELSE NULL END""")
    return t.documents.select("doc_id", listed(X.string_list(raw), "items"))


@query("embedded_labels", "H39", """
SELECT doc_id, lang AS label FROM documents WHERE doc_id % 3 > 0""")
def _(t):
    raw = F.concat(F.lit("[INST] x "), F.when(F.col("doc_id") % 3 > 0, "[/INST] category:  ").otherwise("none "), F.col("lang"), F.lit("(detail)"))
    return t.documents.select("doc_id", R.embedded_label(raw).alias("label")).where("label is not null")


@query("answer_zip", "H40", """
SELECT conv_id, u.i AS pos, 'q' || u.i AS question, CASE WHEN u.i < 2 THEN 'a' || u.i ELSE '' END AS answer FROM (SELECT DISTINCT conv_id FROM conversations), unnest(range(0, 3)) AS u(i)""")
def _(t):
    c = t.conversations.select("conv_id").distinct()
    qs, ans = F.array(F.lit("q0 "), F.lit("q1"), F.lit("q2")), F.array(F.lit("a0"), F.lit(" a1"))
    return R.zip_answers(c.select("conv_id", qs.alias("qs"), ans.alias("ans")), "conv_id", "qs", "ans").withColumn("pos", F.col("pos").cast("bigint"))


@query("visible_messages", "H41 A9", """
SELECT conv_id, turn FROM conversations WHERE role = 'user' OR turn % 2 = 0 OR role = 'system'""")
def _(t):
    to = F.when(F.col("role") == "system", F.array(F.lit("*"))).when(F.col("turn") % 2 == 0, F.array(F.lit("user"), F.lit("x"))).otherwise(F.array(F.lit("assistant")))
    m = t.conversations.select("conv_id", "turn", F.col("role").alias("sender"), to.alias("recipients"))
    return m.where(R.visible_to("user")).select("conv_id", "turn")


@query("last_answers", "E18", r"""
WITH b AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN 'so ANSWER: ' || replace(text, chr(10), ' ') || chr(10) || 'x' ELSE text END AS t FROM conversations WHERE trim(text) <> ''),
m AS (SELECT conv_id, max(turn) FILTER (turn % 3 = 1) AS am, max(turn) AS mx FROM b GROUP BY conv_id)
SELECT m.conv_id, md5(CASE WHEN am IS NOT NULL THEN trim(replace(d.text, chr(10), ' ')) ELSE substr(trim(b.t), 1, 400) END) AS answer FROM m JOIN b ON b.conv_id = m.conv_id AND b.turn = coalesce(am, mx) JOIN conversations d ON d.conv_id = b.conv_id AND d.turn = b.turn""")
def _(t):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    body = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("so ANSWER: "), flat, F.lit("\nx"))).otherwise(F.col("text"))
    out = threads.last_answer(t.conversations.where("trim(text) <> ''").select("conv_id", "turn", body.alias("text")))
    return out.select("conv_id", F.md5(F.trim("answer")).alias("answer"))


@query("thread_hold_out", "E19", """
SELECT email_id, row_number() OVER (PARTITION BY thread_key ORDER BY date DESC, email_id DESC) = 1 AS is_target FROM mail WHERE thread_key <> ''""")
def _(t):
    m = t.mail.where("thread_key <> ''").select("email_id", "thread_key", "date")
    return threads.hold_out(m, "thread_key").select("email_id", (F.col("role") == "target").alias("is_target"))


@query("length_picks", "E11", """
WITH s AS (SELECT sender, email_id, row_number() OVER (PARTITION BY sender ORDER BY body_chars, email_id) - 1 AS i, count(*) OVER (PARTITION BY sender) AS n FROM mail)
SELECT sender, email_id FROM s WHERE n <= 3 OR i IN (round_even(0.25 * (n - 1), 0), round_even(0.5 * (n - 1), 0), round_even(0.75 * (n - 1), 0))""")
def _(t):
    return threads.picks_by_length(t.mail.select("sender", "email_id", "body_chars"), "sender", "body_chars", 3).select("sender", "email_id")


@query("hold_outs", "E12 B11", r"""
WITH d AS (SELECT doc_id, len(regexp_extract_all(text, '[^\s\p{Z}]+')) AS w, len(list_filter(string_split(text, chr(10)), lambda s: starts_with(ltrim(s), '>'))) / len(string_split(text, chr(10))) AS q FROM documents)
SELECT sender, email_id, rank FROM (SELECT sender, email_id, row_number() OVER (PARTITION BY sender ORDER BY date DESC, email_id) AS rank FROM mail JOIN d USING (doc_id) WHERE w >= 50 AND q <= 0.3) WHERE rank <= 5""")
def _(t):
    m = t.mail.select("email_id", "sender", "date", "doc_id").join(t.documents.select("doc_id", "text"), "doc_id")
    return sampling.hold_outs(m, F.col("text")).select("sender", "email_id", "rank")


@query("bucketed_sample", "E8 M4", """
WITH b AS (SELECT sender, email_id, body_word_count AS w, decision_carrying AS dc, topics FROM mail_full),
k AS (SELECT sender, x, row_number() OVER (PARTITION BY sender ORDER BY n DESC, x) AS i FROM (SELECT sender, u.x, count(*) AS n FROM mail, unnest(topics) AS u(x) GROUP BY ALL)),
d AS (SELECT sender, email_id, 'decision' AS bucket FROM (SELECT *, row_number() OVER (PARTITION BY sender ORDER BY w DESC, email_id) AS r FROM b WHERE dc) WHERE r <= 5),
t1 AS (SELECT sender, email_id, 'topic_1' AS bucket FROM (SELECT b.*, row_number() OVER (PARTITION BY b.sender ORDER BY w DESC, b.email_id) AS r FROM b JOIN k ON k.sender = b.sender AND k.i = 1 AND list_contains(topics, x) WHERE b.email_id NOT IN (SELECT email_id FROM d)) WHERE r <= 5),
t2 AS (SELECT sender, email_id, 'topic_2' AS bucket FROM (SELECT b.*, row_number() OVER (PARTITION BY b.sender ORDER BY w DESC, b.email_id) AS r FROM b JOIN k ON k.sender = b.sender AND k.i = 2 AND list_contains(topics, x) WHERE b.email_id NOT IN (SELECT email_id FROM d UNION ALL SELECT email_id FROM t1)) WHERE r <= 5),
t3 AS (SELECT sender, email_id, 'topic_3' AS bucket FROM (SELECT b.*, row_number() OVER (PARTITION BY b.sender ORDER BY w DESC, b.email_id) AS r FROM b JOIN k ON k.sender = b.sender AND k.i = 3 AND list_contains(topics, x) WHERE b.email_id NOT IN (SELECT email_id FROM d UNION ALL SELECT email_id FROM t1 UNION ALL SELECT email_id FROM t2)) WHERE r <= 5),
u AS (SELECT * FROM d UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
l AS (SELECT sender, email_id, 'longest' AS bucket FROM (SELECT b.*, row_number() OVER (PARTITION BY sender ORDER BY w DESC, email_id) AS r FROM b WHERE email_id NOT IN (SELECT email_id FROM u)) WHERE r <= 5)
SELECT * FROM u UNION ALL SELECT * FROM l""")
def _(t):
    m = t.mail.select("sender", "email_id", "doc_id", "decision_carrying", "topics")
    m = cut_lineage(m.join(t.doc_features.select("doc_id", "body_word_count"), "doc_id").drop("doc_id"))
    return sampling.bucketed(m, rollups.top_items(m, "sender", "topics", 3, "topics"))


@query("person_representatives", "E9 G2", """
WITH s AS (SELECT sender AS name, email_id, body_chars, subject FROM mail), g AS (SELECT DISTINCT recipient AS name, email_id, body_chars FROM mail_to),
u AS (SELECT name, email_id, 0 AS part, r FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY body_chars DESC, email_id) AS r FROM s) WHERE r <= 8 UNION ALL
 SELECT name, email_id, 1, r FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY body_chars DESC, email_id) AS r FROM g) WHERE r <= 8 UNION ALL
 SELECT name, email_id, 2, r FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY body_chars DESC, email_id) AS r FROM s WHERE NOT (lower(subject) LIKE 're:%' OR lower(subject) LIKE 'fw:%' OR lower(subject) LIKE 'fwd:%')) WHERE r <= 4),
f AS (SELECT name, email_id, min(part * 100 + r) AS o FROM u GROUP BY ALL)
SELECT name, email_id, o // 100 AS part FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY o) AS k FROM f) WHERE k <= 20""")
def _(t):
    return sampling.representatives_per_person(t.mail)


@query("pair_representatives", "E10", """
WITH r AS (SELECT least(sender, recipient) AS person_a, greatest(sender, recipient) AS person_b, sender, sender < recipient AS fw, email_id, body_chars FROM mail_to WHERE sender <> recipient),
n AS (SELECT person_a, person_b FROM r GROUP BY ALL HAVING count(*) >= 2), k AS (SELECT *, row_number() OVER (PARTITION BY person_a, person_b, fw ORDER BY body_chars DESC, email_id) AS rank FROM r)
SELECT person_a, person_b, sender, email_id, rank FROM k JOIN n USING (person_a, person_b) WHERE rank <= CASE WHEN fw THEN 2 ELSE 3 END""")
def _(t):
    return sampling.representatives_per_pair(t.mail, 5, 2)


@query("stratified_sample", "E7", """
WITH r AS (SELECT event_id, qtype, role, row_number() OVER (PARTITION BY qtype, role ORDER BY md5('42|' || event_id), event_id) AS rank FROM qa),
k AS (SELECT greatest(1, 150 // count(*)) AS k FROM (SELECT DISTINCT qtype, role FROM qa))
SELECT event_id, qtype, role FROM r, k WHERE rank <= k ORDER BY rank, qtype, role LIMIT 150""")
def _(t):
    return sampling.stratified(t.qa, ["qtype", "role"], 150, "event_id").select("event_id", "qtype", "role")


@query("random_sample", "A18", "SELECT email_id, sender FROM mail ORDER BY md5('42|' || email_id), email_id LIMIT 100")
def _(t):
    return sampling.random_rows(t.mail.select("email_id", "sender"), 100, "email_id")


@query("persona_picks", "E13", """
WITH v AS (SELECT sender AS name, count(*) AS volume FROM mail GROUP BY 1),
p AS (SELECT name, level + 1 AS tier, person_key % 5 + 1 AS formality, volume,
  CASE WHEN level + 1 IN (1, 2) THEN 'senior' WHEN level + 1 IN (3, 4) THEN 'mid' WHEN level + 1 >= 5 THEN 'ic' END AS band FROM person JOIN v USING (name)),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY band ORDER BY volume DESC, name) AS rank FROM p WHERE band IS NOT NULL),
s AS (SELECT band, max(formality) - min(formality) AS span, count(*) AS n FROM r WHERE rank <= 5 GROUP BY band),
x AS (SELECT r.*, n, CAST(formality < 4 AS INT) AS side, row_number() OVER (PARTITION BY band, formality >= 4 ORDER BY rank) AS k
  FROM r JOIN s USING (band) WHERE rank > 5 AND (formality >= 4 OR formality <= 2) AND n >= 2 AND span < 3),
w AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY band ORDER BY side) AS o, least(count(*) OVER (PARTITION BY band), n - 1) AS quota FROM x WHERE k = 1),
d AS (SELECT band, max(quota) AS quota FROM w GROUP BY band)
SELECT band, name, tier, formality, volume FROM r JOIN s USING (band) LEFT JOIN d USING (band) WHERE rank <= 5 AND rank <= n - coalesce(quota, 0)
UNION ALL SELECT band, name, tier, formality, volume FROM w WHERE o <= quota""")
def _(t):
    sent = t.mail.groupBy(F.col("sender").alias("name")).agg(F.count("*").alias("volume"))
    p = t.person.join(sent, "name").select("name", (F.col("level") + 1).alias("tier"), (F.pmod(F.col("person_key"), F.lit(5)) + 1).alias("formality"), "volume")
    return sampling.persona_picks(p)


@query("resume_filter", "A16", "SELECT email_id FROM mail WHERE NOT decision_carrying")
def _(t):
    from tieline.sources.sinks import remaining

    return remaining(t.mail.select("email_id"), t.mail.where("decision_carrying").select("email_id"), ["email_id"])


@query("keyed_upsert", "A14 A17", """
SELECT l_orderkey, l_linenumber, sum(l_quantity) AS quantity, CASE WHEN l_linenumber % 2 = 0 THEN 'new' ELSE 'old' END AS version FROM lineitem GROUP BY ALL""")
def _(t):
    from tieline.session import work_dir
    from tieline.sources.tables import UpsertTable

    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("quantity"))
    even = F.col("l_linenumber") % 2 == 0
    table = UpsertTable(t.spark, work_dir(t.spark, "lines"), ["l_orderkey", "l_linenumber"])
    # First every line, the even ones without a quantity; then these as the new version, and once more as a repeated batch.
    table(lines.select("l_orderkey", "l_linenumber", F.when(~even, F.col("quantity")).alias("quantity"), F.lit("old").alias("version")), 0)
    new = lines.where(even).withColumn("version", F.lit("new"))
    table(new, 1)
    table(new, 1)
    return table.read()
