"""Scoring, agreement, overlap and evaluation tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tieline.functions import grading as G
from tieline.functions import text as X
from tieline.functions import vocabulary as V
from tieline.operators import evaluation as E
from tieline.operators import network, overlap, quality, scoring, stats
from tieline.plans.columns import listed, r6
from tieline.plans.registry import query

SCORED_SQL = """
WITH sc AS (SELECT p.*, a.score AS superior_score, b.score AS subordinate_score FROM staff_pair p
  LEFT JOIN (SELECT * FROM staff WHERE key % 7 > 0) a ON a.name = superior LEFT JOIN (SELECT * FROM staff WHERE key % 7 > 0) b ON b.name = subordinate),
st AS (SELECT *, superior_score - subordinate_score AS score_gap, CASE WHEN superior_score - subordinate_score IS NULL THEN 'missing'
  WHEN superior_score > subordinate_score THEN 'correct' ELSE 'wrong_order' END AS status FROM sc)"""


def scored(t):
    known = t.staff.where(F.col("key") % 7 > 0)
    return scoring.score_pairs(scoring.dominance_pairs(t.staff), known)


@query("dominance_pairs", "C8", "SELECT * FROM staff_pair")
def _(t):
    return scoring.dominance_pairs(t.staff)


@query("scored_pairs", "C9", SCORED_SQL + "SELECT superior, subordinate, score_gap, status FROM st")
def _(t):
    return scored(t).select("superior", "subordinate", "score_gap", "status")


@query("pair_accuracy", "K1", SCORED_SQL + """
SELECT count(*) FILTER (status = 'correct') AS correct, count(*) FILTER (status = 'wrong_order') AS wrong_order,
 count(*) FILTER (status = 'missing') AS missing, count(*) AS total_pairs, round(count(*) FILTER (status = 'correct') / count(*), 6) AS pair_accuracy,
 round(count(*) FILTER (status <> 'missing') / count(*), 6) AS coverage FROM st""")
def _(t):
    out = scoring.pair_accuracy(scored(t))
    return out.select("correct", "wrong_order", "missing", "total_pairs", r6("pair_accuracy", "pair_accuracy"), r6("coverage", "coverage"))


@query("person_pair_counts", "K1 D16", """
WITH p AS (SELECT name, level, CASE WHEN person_key % 7 > 0 THEN balance END AS score FROM person)
SELECT a.level AS superior_level, b.level AS subordinate_level, count(*) FILTER (a.score > b.score) AS correct, count(*) FILTER (a.score <= b.score) AS wrong_order,
 count(*) FILTER (a.score IS NULL OR b.score IS NULL) AS missing, count(*) AS total_pairs FROM p a JOIN p b ON a.level > b.level GROUP BY ALL""")
def _(t):
    known = t.person.where(F.col("person_key") % 7 > 0).select("name", F.col("balance").alias("score"))
    return scoring.count_pairs(t.person, known)


@query("accuracy_by_level", "D16", SCORED_SQL + """
SELECT superior_level, count(*) AS n, round(avg(CAST(status = 'correct' AS INT)), 6) AS accuracy FROM st WHERE status <> 'missing' GROUP BY 1""")
def _(t):
    s = scored(t).where("status <> 'missing'")
    return s.groupBy("superior_level").agg(F.count("*").alias("n"), r6(F.avg((F.col("status") == "correct").cast("double")), "accuracy"))


STAGE_SQL = SCORED_SQL + """,
g AS (SELECT 'A' || s AS stage, superior_level - subordinate_level AS gap, coalesce(score_gap > s * 100, false) AS correct FROM st, range(0, 3) r(s))"""


def staged(t):
    stages = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("s")
    rows = scored(t).select("*", stages)
    return rows.select(
        F.concat(F.lit("A"), F.col("s").cast("string")).alias("stage"),
        (F.col("superior_level") - F.col("subordinate_level")).alias("gap"),
        F.coalesce(F.col("score_gap") > F.col("s") * 100, F.lit(False)).alias("correct"),
    )


@query("accuracy_by_gap", "D17 H29", STAGE_SQL + """
SELECT stage, gap, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS accuracy FROM g GROUP BY stage, gap
UNION ALL SELECT stage, 0, count(*), round(avg(CAST(correct AS INT)), 6) FROM g GROUP BY stage""")
def _(t):
    return scoring.accuracy_by_gap(staged(t)).select("stage", "gap", "n", r6("accuracy", "accuracy"))


@query("accuracy_pivot", "D18", STAGE_SQL + """
SELECT stage, round(avg(CAST(correct AS INT)), 6) AS g0, round(avg(CAST(correct AS INT)) FILTER (gap = 1), 6) AS g1,
 round(avg(CAST(correct AS INT)) FILTER (gap = 2), 6) AS g2, round(avg(CAST(correct AS INT)) FILTER (gap = 3), 6) AS g3,
 round(avg(CAST(correct AS INT)) FILTER (gap = 4), 6) AS g4 FROM g GROUP BY stage""")
def _(t):
    long = scoring.accuracy_by_gap(staged(t))
    wide = long.groupBy("stage").pivot("gap", [0, 1, 2, 3, 4]).agg(F.first("accuracy"))
    return wide.select("stage", *[r6(F.col(str(i)), f"g{i}") for i in range(5)])


@query("min_max_scores", "E16", """
SELECT name, round((balance - (SELECT min(balance) FROM person)) / (SELECT max(balance) - min(balance) FROM person), 6) AS balance,
 round(1 - (ln(1 + level) - (SELECT min(ln(1 + level)) FROM person)) / (SELECT max(ln(1 + level)) - min(ln(1 + level)) FROM person), 6) AS level, CAST(0 AS DOUBLE) AS flat FROM person""")
def _(t):
    p = t.person.select("name", "balance", F.col("level").cast("double").alias("level"), F.lit(7.0).alias("flat"))
    out = scoring.min_max(p, ["balance", "level", "flat"], invert=["level"], log=["level"])
    return out.select("name", r6("balance", "balance"), r6("level", "level"), "flat")


COMPOSITE_SQL = """
WITH f AS (SELECT node, CAST(weighted_in AS DOUBLE) AS a, ln(1 + weighted_out) AS b, CAST(d AS DOUBLE) AS c FROM (
  SELECT node, sum(i * weight) AS weighted_in, sum(o * weight) AS weighted_out, count(*) AS d FROM
  (SELECT src AS node, 1 AS o, 0 AS i, weight FROM contact UNION ALL SELECT dst, 0, 1, weight FROM contact) GROUP BY node)),
m AS (SELECT min(a) AS la, max(a) AS ha, min(b) AS lb, max(b) AS hb, min(c) AS lc, max(c) AS hc FROM f),
s AS (SELECT node, 0.5 * ((a - la) / (ha - la)) + 0.3 * ((b - lb) / (hb - lb)) + 0.2 * (1 - (c - lc) / (hc - lc)) AS v FROM f, m),
q AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.2, 0.4, 0.6, 0.8]))) AS e FROM s)
SELECT node, round(v, 6) AS composite_score, len(list_filter(e, lambda x: x < v - 1e-12)) AS tier FROM s, q"""


@query("composite_score", "J5 E15 E16", COMPOSITE_SQL)
def _(t):
    d = network.degrees(t.contact).select(
        "node", F.col("weighted_in").cast("double").alias("a"), F.col("weighted_out").cast("double").alias("b"), F.col("total_degree").cast("double").alias("c")
    )
    out = scoring.composite(d, {"a": 0.5, "b": 0.3, "c": 0.2}, invert=["c"], log=["b"])
    return out.select("node", r6("composite_score", "composite_score"), F.col("tier").cast("bigint").alias("tier"))


BLEND_SQL = """
WITH p AS (SELECT name, score / 1000.0 AS c, (level - (SELECT min(level) FROM staff)) / (SELECT max(level) - min(level) FROM staff) AS s FROM staff)"""


def staff_people(t):
    return t.staff.select("name", (F.col("score") / 1000.0).alias("composite_score"), F.col("level").cast("double").alias("seniority"))


@query("blended_score", "J6", BLEND_SQL + """
, v AS (SELECT name, c + 1.5 * s AS v FROM p), q AS (SELECT list_sort(list_distinct(quantile_cont(v, [0.2, 0.4, 0.6, 0.8]))) AS e FROM v)
SELECT name, round(v, 6) AS composite_score_v3, len(list_filter(e, lambda x: x < v - 1e-12)) AS tier_v3 FROM v, q""")
def _(t):
    return scoring.blended(staff_people(t), 1.5).select("name", r6("composite_score_v3", "composite_score_v3"), F.col("tier_v3").cast("bigint").alias("tier_v3"))


@query("weight_sweep", "J7", BLEND_SQL + """
, r AS (SELECT w, avg(CAST(a.c + w * a.s > b.c + w * b.s AS INT)) AS acc, count(*) AS n FROM staff_pair JOIN p a ON a.name = superior
  JOIN p b ON b.name = subordinate, (SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0]) AS w) GROUP BY w)
SELECT CAST(w AS DOUBLE) AS weight, round(acc, 6) AS accuracy, n, row_number() OVER (ORDER BY acc DESC, w) = 1 AS best FROM r""")
def _(t):
    out = scoring.weight_sweep(staff_people(t), scoring.dominance_pairs(t.staff))
    return out.select("weight", r6("accuracy", "accuracy"), "n", "best")


@query("fold_tuning", "J8", """
WITH r AS (SELECT CAST('0x' || substr(md5('42|' || src || '|' || dst), 1, 8) AS BIGINT) % 5 AS fold, a.score - b.score AS diff, weight % 7 - 3 AS deference
  FROM trade JOIN staff a ON a.name = src JOIN staff b ON b.name = dst WHERE a.score - b.score IS NOT NULL),
p AS (SELECT fold, CAST(w AS DOUBLE) AS alpha, sum(CAST(diff + w * deference > 0 AS INT)) AS h, count(*) AS n FROM r, (SELECT unnest([0.5, 1.0, 1.5, 2.0, 2.5, 3.0]) AS w) GROUP BY ALL),
q AS (SELECT *, sum(h) OVER (PARTITION BY alpha) AS ha, sum(n) OVER (PARTITION BY alpha) AS na FROM p)
SELECT fold, alpha, round(h / n, 6) AS accuracy, CAST(na - n AS BIGINT) AS n_train, n AS n_test FROM q
 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY (ha - h) / (na - n) DESC, alpha) = 1""")
def _(t):
    s = t.staff.select(F.col("name").alias("n"), "score")
    e = t.trade.join(s.select(F.col("n").alias("src"), F.col("score").alias("s1")), "src").join(s.select(F.col("n").alias("dst"), F.col("score").alias("s2")), "dst")
    pairs = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.col("s1") - F.col("s2")).alias("diff"), (F.col("weight") % 7 - 3).alias("deference"))
    return scoring.tune_by_fold(pairs).select("fold", "alpha", r6("accuracy", "accuracy"), "n_train", "n_test")


def ladder_features(t):
    d = network.degrees(t.trade)
    return t.staff.join(d.withColumnRenamed("node", "name"), "name").select(
        "name", F.col("weighted_in").alias("in_degree"), F.col("weighted_out").alias("mean_to_count"), F.col("score").alias("pct_request_sent"),
        F.col("key").alias("length_asymmetry"), F.col("level").alias("seniority_narrative_numeric"),
    )


@query("ablation_ladder", "J9", """
WITH d AS (SELECT name, level, key, score, (SELECT sum(weight) FROM trade WHERE dst = name) AS win, (SELECT sum(weight) FROM trade WHERE src = name) AS wout FROM staff),
f AS (SELECT name, (win - (SELECT min(win) FROM d)) / (SELECT max(win) - min(win) FROM d) AS x0, (wout - (SELECT min(wout) FROM d)) / (SELECT max(wout) - min(wout) FROM d) AS x1,
 (score - (SELECT min(score) FROM d)) / (SELECT max(score) - min(score) FROM d) AS x2, (key - (SELECT min(key) FROM d)) / (SELECT max(key) - min(key) FROM d) AS x3,
 (level - (SELECT min(level) FROM d)) / (SELECT max(level) - min(level) FROM d) AS x5 FROM d),
s AS (SELECT 'A0' AS stage, name, x0 AS v FROM f UNION ALL SELECT 'A1', name, x0 + x1 FROM f UNION ALL SELECT 'A2', name, x0 + x1 + x2 FROM f
 UNION ALL SELECT 'A3', name, x0 + x1 + x2 + x3 FROM f UNION ALL SELECT 'A4', name, x0 + x1 + x2 + x3 FROM f UNION ALL SELECT 'A5', name, x0 + x1 + x2 + x3 + x5 FROM f)
SELECT a.stage, count(*) AS total_pairs, round(avg(CAST(a.v > b.v AS INT)), 6) AS accuracy FROM staff_pair JOIN s a ON a.name = superior
 JOIN s b ON b.name = subordinate AND b.stage = a.stage GROUP BY a.stage""")
def _(t):
    scores = scoring.ladder_scores(ladder_features(t))
    pairs = scoring.dominance_pairs(t.staff)
    hi = scores.select("stage", F.col("name").alias("superior"), F.col("score").alias("s1"))
    lo = scores.select("stage", F.col("name").alias("subordinate"), F.col("score").alias("s2"))
    j = pairs.join(hi, "superior").join(lo, ["stage", "subordinate"])
    return j.groupBy("stage").agg(F.count("*").alias("total_pairs"), r6(F.avg((F.col("s1") > F.col("s2")).cast("double")), "accuracy"))


@query("spearman", "K2 E17", """
WITH r AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS a, rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0 AS b
 FROM (SELECT value, CAST(props->>'$.k' AS BIGINT) AS k FROM events)) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def _(t):
    e = t.events.select("value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return stats.spearman(e, "value", "k").select("n", r6("rho", "rho"))


@query("spearman_ordinal", "K2", """
WITH r AS (SELECT row_number() OVER (ORDER BY value, event_id) AS a, row_number() OVER (ORDER BY k, event_id) AS b
 FROM (SELECT event_id, value, CAST(props->>'$.k' AS BIGINT) AS k FROM events)) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def _(t):
    e = t.events.select("event_id", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return stats.spearman_ordinal(e, "value", "k", "event_id").select("n", r6("rho", "rho"))


CONT_SQL = """
WITH c AS (SELECT event_type AS a, CAST(props->>'$.k' AS BIGINT) // 10 AS b, count(*) AS n FROM events GROUP BY 1, 2),
t AS (SELECT sum(n) AS t FROM c), ra AS (SELECT a, sum(n) AS m FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS m FROM c GROUP BY b)"""


def labelled_events(t):
    return t.events.select("event_type", F.floor(F.get_json_object("props", "$.k").cast("bigint") / 10).alias("band"))


@query("nmi", "K3", CONT_SQL + """
, h AS (SELECT (SELECT -sum(m / t * ln(m / t)) FROM ra, t) AS ha, (SELECT -sum(m / t * ln(m / t)) FROM rb, t) AS hb, (SELECT -sum(n / t * ln(n / t)) FROM c, t) AS hab)
SELECT CAST(t AS BIGINT) AS rows, round((ha + hb - hab) / ((ha + hb) / 2), 6) AS nmi FROM h, t""")
def _(t):
    return stats.nmi(labelled_events(t), "event_type", "band").select("rows", r6("nmi", "nmi"))


@query("adjusted_rand", "K4", CONT_SQL + """
, s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS ij, (SELECT sum(m * (m - 1) / 2.0) FROM ra) AS i, (SELECT sum(m * (m - 1) / 2.0) FROM rb) AS j, t * (t - 1) / 2.0 AS p FROM t)
SELECT round((ij - i * j / p) / ((i + j) / 2 - i * j / p), 6) AS ari FROM s""")
def _(t):
    return stats.rand_index(labelled_events(t), "event_type", "band").select(r6("ari", "ari"))


@query("purity", "K5", CONT_SQL + "SELECT round(sum(mx) / any_value(t), 6) AS purity FROM (SELECT b, max(n) AS mx FROM c GROUP BY b), t")
def _(t):
    return stats.purity(labelled_events(t), "event_type", "band").select(r6("purity", "purity"))


@query("kappa", "K6", """
WITH r AS (SELECT doc_id, quality AS g, CAST(n_chars >= (SELECT quantile_cont(n_chars, 0.5) FROM documents) AS INT) AS p FROM labels JOIN documents USING (doc_id)),
t AS (SELECT tag, CASE tag WHEN 'good' THEN g WHEN 'bad' THEN 1 - g ELSE 1 END AS g, CASE tag WHEN 'good' THEN p WHEN 'bad' THEN 1 - p ELSE 1 END AS p FROM r, (SELECT unnest(['good', 'bad', 'any']) AS tag)),
s AS (SELECT tag, count(*) AS n, sum(g) AS g, sum(p) AS p, sum(g * p) AS b FROM t GROUP BY tag),
k AS (SELECT tag, CASE WHEN g IN (0, n) OR p IN (0, n) THEN 0.0 ELSE ((n - g - p + 2 * b) / n - (g * p + (n - g) * (n - p)) / (n * n)) / (1 - (g * p + (n - g) * (n - p)) / (n * n)) END AS kappa FROM s)
SELECT tag, round(kappa, 6) AS kappa FROM k UNION ALL SELECT 'macro', round(avg(kappa), 6) FROM k""")
def _(t):
    from tieline.operators.ordering import quantiles

    med = quantiles(t.documents, "n_chars", [0.5]).select("q0").scalar()
    r = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    tag = lambda c: F.array(F.when(c, "good").otherwise("bad"), F.lit("any"))
    rows = r.select(tag(F.col("quality") == 1).alias("gold"), tag(F.col("n_chars") >= med).alias("pred"))
    return stats.kappa(rows, "gold", "pred", ["good", "bad", "any"]).select("tag", r6("kappa", "kappa"))


def bit_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % 2147483647"


def means_sql(replicates: int) -> str:
    """Means of the resampled rows ``d`` (grp, key, v): a Poisson count is the number of distribution values reached."""
    cdf = [sum(1 / math.factorial(i) for i in range(k + 1)) / math.e for k in range(18)]
    return f"""
h AS (SELECT grp, v, {bit_sql("'42|' || key")} AS h FROM d WHERE v IS NOT NULL),
m AS (SELECT r, {bit_sql("'42|a|' || r")} AS a, {bit_sql("'42|b|' || r")} AS b FROM range(0, {replicates}) x(r)),
w AS (SELECT grp, r, v, len(list_filter({cdf}, lambda c: c <= ((h * a + b) % 2147483647) / 2147483647.0::DOUBLE)) AS w FROM h, m),
means AS MATERIALIZED (SELECT grp, r, sum(v * w) / sum(w) AS mean FROM w GROUP BY grp, r HAVING sum(w) > 0)"""


@query("bootstrap_interval", "K7", f"""
WITH d AS (SELECT condition AS grp, event_id AS key, CAST(f1 AS DOUBLE) AS v FROM qa), {means_sql(200)}
SELECT grp AS condition, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.5), 6) AS median, round(quantile_cont(mean, 0.975), 6) AS high FROM means GROUP BY grp""")
def _(t):
    out = stats.bootstrap_interval(t.qa, "f1", "event_id", 200, by=["condition"])
    return out.select("condition", *[r6(c, c) for c in ("low", "median", "high")])


PAIRED = "mean_delta", "low", "high", "p"


def paired_arms(t):
    """Per question the mean F1 of both arms."""
    m = t.qa.groupBy("qid").pivot("condition", ["R1", "R2"]).agg(F.avg("f1"))
    return m.where("R1 is not null and R2 is not null")


@query("paired_bootstrap", "K8 G3", f"""
WITH q AS (SELECT qid AS key, avg(f1) FILTER (condition = 'R1') AS a, avg(f1) FILTER (condition = 'R2') AS b FROM qa GROUP BY qid),
d AS (SELECT 0 AS grp, key, b - a AS v FROM q WHERE b - a IS NOT NULL), {means_sql(300)},
o AS (SELECT list(mean ORDER BY mean) AS l FROM means), g AS (SELECT round(avg(v), 6) AS mean_delta FROM d)
SELECT 'plain' AS kind, mean_delta, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, round(avg(CAST(mean <= 0 AS INT)), 6) AS p FROM means, g GROUP BY mean_delta
UNION ALL SELECT 'mid_p', mean_delta, round(l[8], 6), round(l[292], 6), (SELECT round(avg(CASE WHEN mean < 0 THEN 1 WHEN mean = 0 THEN 0.5 ELSE 0 END), 6) FROM means) FROM o, g""")
def _(t):
    m = paired_arms(t)
    a = stats.paired_bootstrap(m, "R2", "R1", "qid", 300).select(F.lit("plain").alias("kind"), *PAIRED)
    b = stats.paired_bootstrap(m, "R2", "R1", "qid", 300, mid_p=True).select(F.lit("mid_p").alias("kind"), *PAIRED)
    return a.unionByName(b).select("kind", *[r6(c, c) for c in PAIRED])


@query("shared_questions", "G3", """
SELECT qid, round(avg(f1) FILTER (condition = 'R1'), 6) AS r1, round(avg(f1) FILTER (condition = 'R2'), 6) AS r2 FROM qa
GROUP BY qid HAVING count(*) FILTER (condition = 'R1') > 0 AND count(*) FILTER (condition = 'R2') > 0""")
def _(t):
    return paired_arms(t).select("qid", r6("R1", "r1"), r6("R2", "r2"))


@query("ranking_metrics", "K10", """
WITH k AS (SELECT event_type AS retriever, user_id AS qid, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS rank, CAST(props->>'$.k' AS BIGINT) >= 90 AS rel FROM events),
q AS (SELECT retriever, qid, min(rank) FILTER (rel) AS f, count(*) FILTER (rel) AS nr, count(*) FILTER (rel AND rank <= 5) AS h5, count(*) FILTER (rel AND rank <= 10) AS h10,
 coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 5), 0) AS dcg FROM k GROUP BY ALL),
i AS (SELECT m, sum(1 / log2(j + 1)) AS ideal FROM range(1, 6) a(m), range(1, 6) b(j) WHERE j <= m GROUP BY m)
SELECT retriever, count(*) AS n_queries, round(avg(coalesce(1 / f, 0)), 6) AS mrr, round(avg(CASE WHEN nr > 0 THEN h5 / nr ELSE 0 END), 6) AS recall_at_5,
 round(avg(CASE WHEN nr > 0 THEN h10 / nr ELSE 0 END), 6) AS recall_at_10, round(avg(CASE WHEN nr > 0 THEN dcg / ideal ELSE 0 END), 6) AS ndcg_at_5
FROM q LEFT JOIN i ON m = least(nr, 5) GROUP BY retriever""")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", "user_id").orderBy(F.desc("value"), "event_id")
    r = t.events.select(
        F.col("event_type").alias("retriever"), F.col("user_id").alias("qid"), F.row_number().over(w).alias("rank"),
        (F.get_json_object("props", "$.k").cast("bigint") >= 90).alias("relevant"),
    )
    out = stats.ranking_metrics(r, "retriever")
    return out.select("retriever", "n_queries", *[r6(c, c) for c in ("mrr", "recall_at_5", "recall_at_10", "ndcg_at_5")])


@query("subset_stats", "D19", """
WITH s AS (SELECT *, unnest(list_filter(['overall', CASE WHEN qtype IN ('relational', 'temporal') THEN 'relational_temporal' END, qtype, role], lambda x: x IS NOT NULL)) AS subset FROM qa)
SELECT subset, condition, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(avg(latency_ms), 6) AS mean_latency_ms, round(avg(CAST(used_fallback AS INT)), 6) AS fallback_rate
FROM s GROUP BY subset, condition""")
def _(t):
    out = E.subset_stats(t.qa)
    return out.select("subset", "condition", "n", r6("mean_f1", "mean_f1"), r6("mean_latency_ms", "mean_latency_ms"), r6("fallback_rate", "fallback_rate"))


@query("judge_scores", "D20", """
SELECT qtype, round(avg(f1) FILTER (condition = 'R1'), 6) AS r1, round(avg(f1) FILTER (condition = 'R2'), 6) AS r2,
 round(avg(f1) FILTER (condition = 'R1') - avg(f1) FILTER (condition = 'R2'), 6) AS delta FROM qa GROUP BY qtype""")
def _(t):
    out = E.arm_pivot(t.qa, ["qtype"], "condition", ["R1", "R2"], "f1")
    return out.select("qtype", r6("R1", "r1"), r6("R2", "r2"), r6("delta", "delta"))


def runs(t):
    return t.events.select(
        F.col("event_type").alias("category"), F.col("user_id").alias("question_id"), "event_id", F.col("value").alias("wall_time_ms"),
        (F.get_json_object("props", "$.k").cast("bigint") % 7).alias("n_tool_calls"), (F.get_json_object("props", "$.k").cast("bigint") >= 40).alias("passed"),
    )


RUN_SQL = """
WITH r AS (SELECT event_type AS category, user_id AS question_id, event_id, value AS ms, CAST(props->>'$.k' AS BIGINT) % 7 AS calls, CAST(props->>'$.k' AS BIGINT) >= 40 AS ok FROM events)"""


@query("run_headline", "D21", RUN_SQL + """
SELECT count(*) AS n, count(*) FILTER (ok) AS n_passed, round(avg(CAST(ok AS INT)), 6) AS pass_rate, CAST(sum(calls) AS BIGINT) AS total_calls, round(avg(calls), 6) AS mean_calls,
 round(avg(ms), 4) AS mean_ms, round(sum(ms), 2) AS total_ms FROM r""")
def _(t):
    out = E.headline(runs(t))
    return out.select("n", "n_passed", r6("pass_rate", "pass_rate"), "total_calls", r6("mean_calls", "mean_calls"), r6("mean_ms", "mean_ms", 4), r6("total_ms", "total_ms", 2))


@query("category_rates", "D22", RUN_SQL + """
SELECT category, count(*) AS n, count(*) FILTER (ok) AS n_passed, round(avg(CAST(ok AS INT)), 6) AS pass_rate,
 CAST(CASE category WHEN 'click' THEN 0.65 WHEN 'view' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS threshold, avg(CAST(ok AS INT)) >= CASE category WHEN 'click' THEN 0.65 WHEN 'view' THEN 0.5 ELSE 0.0 END AS meets_threshold,
 round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(max(ms), 6) AS max_ms FROM r GROUP BY category""")
def _(t):
    out = E.category_rates(runs(t), {"click": 0.65, "view": 0.5})
    return out.select("category", "n", "n_passed", r6("pass_rate", "pass_rate"), "threshold", "meets_threshold", r6("p50_ms", "p50_ms"), r6("max_ms", "max_ms"))


@query("tool_usage", "D23", """
SELECT tool, count(*) AS n, round(count(*) FILTER (err) / count(*), 4) AS error_rate FROM
 (SELECT unnest([event_type, 'k' || (CAST(props->>'$.k' AS BIGINT) % 3)]) AS tool, CAST(props->>'$.k' AS BIGINT) % 11 = 0 AS err FROM events) GROUP BY tool""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    calls = F.array(F.col("event_type"), F.concat(F.lit("k"), (k % 3).cast("string")))
    return E.tool_usage(t.events.select(F.explode(calls).alias("tool"), F.when(k % 11 == 0, "boom").alias("error")))


COMPARE_SQL = """
WITH x AS (SELECT event_id, CASE WHEN event_id % 2 = 1 AND user_id % 7 = 0 THEN -1 - event_id // 2 ELSE event_id // 2 END AS q, CAST(props->>'$.k' AS BIGINT) >= 60 AS ok FROM events),
b AS (SELECT q, ok FROM x WHERE event_id % 2 = 0), c AS (SELECT q, ok FROM x WHERE event_id % 2 = 1)"""


def two_runs(t):
    """Every event is an answer: even ids those of the base run, odd ids those of the candidate, a seventh of them to new questions."""
    half = F.floor(F.col("event_id") / 2)
    x = t.events.select(
        "event_id", F.when((F.col("event_id") % 2 == 1) & (F.col("user_id") % 7 == 0), -1 - half).otherwise(half).alias("question_id"),
        (F.get_json_object("props", "$.k").cast("bigint") >= 60).alias("passed"),
    )
    return x.where("event_id % 2 = 0").drop("event_id"), x.where("event_id % 2 = 1").drop("event_id")


@query("run_comparison", "C24", COMPARE_SQL + """
SELECT coalesce(b.q, c.q) AS question_id, CASE WHEN b.q IS NULL THEN '-' WHEN b.ok THEN '✓' ELSE '✗' END AS base, CASE WHEN c.q IS NULL THEN '-' WHEN c.ok THEN '✓' ELSE '✗' END AS candidate,
 CASE WHEN b.ok AND NOT c.ok THEN 'regression' WHEN NOT b.ok AND c.ok THEN 'improvement' ELSE '' END AS change FROM b FULL JOIN c ON b.q = c.q""")
def _(t):
    return E.compare_runs(*two_runs(t))


@query("outcome_differences", "G4", COMPARE_SQL + """
SELECT 'only_base' AS part, q AS question_id FROM b WHERE ok AND q NOT IN (SELECT q FROM c WHERE ok) UNION ALL
SELECT 'only_candidate', q FROM c WHERE ok AND q NOT IN (SELECT q FROM b WHERE ok)""")
def _(t):
    b, c = (r.where("passed").select("question_id") for r in two_runs(t))
    return b.exceptAll(c).select(F.lit("only_base").alias("part"), "question_id").unionByName(
        c.exceptAll(b).select(F.lit("only_candidate").alias("part"), "question_id")
    )


@query("cascade_metrics", "D37", """
WITH r AS (SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k, event_type AS e, user_id AS u FROM events),
s AS (SELECT *, list_distinct(list_filter([CASE WHEN k % 2 = 0 THEN 'alan_p' END, CASE WHEN k % 3 = 0 THEN 'bea_q' END, CASE WHEN k % 5 = 0 THEN 'cy' END], lambda x: x IS NOT NULL)) AS d FROM r),
m AS (SELECT *, CASE WHEN len(d) > 0 THEN len(list_filter(d, lambda x: x IN ('alan_p', 'cy'))) / len(d) END AS p,
 (CAST(list_contains(d, 'alan_p') AS INT) + CAST(list_contains(d, 'cy') AS INT)) AS c FROM s)
SELECT count(*) AS n, round(avg(CAST(k >= 50 AS INT)), 6) AS answer_pass_rate, round(avg(CAST(e IN ('click', 'view') AS INT)), 6) AS routing_accuracy, round(avg(p), 6) AS mean_dispatch_precision,
 round(avg(c / 2), 6) AS mean_dispatch_coverage, round(avg(CAST(c >= 1 AS INT)), 6) AS min_categories_met_rate, count(*) AS n_with_routing, count(*) FILTER (len(d) > 0) AS n_with_dispatches FROM m""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    edge = lambda src, dst, cond: F.when(cond, F.struct(F.lit(src).alias("src"), F.lit(dst).alias("dst")))
    r = t.events.select(
        F.col("event_id").alias("question_id"), (k >= 50).alias("passed"), F.upper("event_type").alias("initial_pick"),
        F.array_compact(
            F.array(edge("user", "Zed", k >= 0), edge("zed", "Alan P.", k % 2 == 0), edge("zed", "bea-q", k % 3 == 0), edge("alan_p", "Cy", k % 5 == 0), edge("cy", "user", k >= 0))
        ).alias("dispatches"),
        F.array(F.lit("Click"), F.lit("view")).alias("expected_initial"),
        F.create_map(F.lit("one"), F.array(F.lit("alan p")), F.lit("two"), F.array(F.lit("CY"))).alias("expected_targets"),
        F.lit(1).alias("min_categories"),
    )
    out = E.cascade_summary(E.cascade_metrics(r))
    real = ["answer_pass_rate", "routing_accuracy", "mean_dispatch_precision", "mean_dispatch_coverage", "min_categories_met_rate"]
    return out.select("n", *[r6(c, c) for c in real], "n_with_routing", "n_with_dispatches")


@query("strata_counts", "D39", "SELECT qtype, role, count(*) AS n FROM qa GROUP BY ALL")
def _(t):
    return t.qa.groupBy("qtype", "role").agg(F.count("*").alias("n"))


@query("enrichment_quality", "D33 H33", """
WITH b AS (SELECT md5(text) AS h, length(text) AS n, quality AS c, toxic FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS rows, round(100.0 * count(*) FILTER (toxic = 0) / count(*), 6) AS pct_populated, round(100.0 * count(*) FILTER (c = 1) / count(*), 6) AS pct_heuristic,
 round(100.0 * count(DISTINCT h) FILTER (toxic = 0) / count(*) FILTER (toxic = 0), 6) AS pct_unique, round(avg(32) FILTER (toxic = 0), 6) AS mean_length, CAST(0 AS DOUBLE) AS stdev_length, CAST(32 AS DOUBLE) AS median_length FROM b""")
def _(t):
    d = t.documents.join(t.labels, "doc_id").select(
        F.when(F.col("toxic") == 0, F.md5("text")).otherwise("  ").alias("role_summary"), F.col("quality").alias("confidence"),
        F.lit("Communicates in a terse style").alias("style"),
    )
    out = quality.enrichment_quality(d, "role_summary")
    return out.select("rows", *[r6(c, c) for c in out.columns if c != "rows"])


@query("quality_lights", "H33", """
WITH m AS (SELECT event_type AS metric, avg(value) AS v FROM events GROUP BY ALL), l AS (SELECT CASE WHEN v >= 50.2 THEN 'green' WHEN v >= 49.8 THEN 'yellow' ELSE 'red' END AS c FROM m)
SELECT count(*) FILTER (c = 'green') AS green, count(*) FILTER (c = 'yellow') AS yellow, count(*) FILTER (c = 'red') AS red,
 CASE WHEN count(*) FILTER (c = 'red') > 0 THEN 'review' WHEN count(*) FILTER (c = 'yellow') > 0 THEN 'caution' ELSE 'go' END AS verdict FROM l""")
def _(t):
    m = t.events.groupBy("event_type").agg(F.avg("value").alias("v"))
    return quality.verdict(m.select(quality.colour(F.col("v"), 50.2, 49.8).alias("colour")))


@query("monotone_means", "D34", """
WITH m AS (SELECT quality, round(avg(n_chars)) AS mean FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT count(*) AS groups, bool_and(coalesce(p <= mean, true)) AS monotone FROM (SELECT mean, lag(mean) OVER (ORDER BY quality) AS p FROM m)""")
def _(t):
    return quality.monotone(t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id"), "quality", "n_chars")


@query("known_entities", "D35", """
WITH d AS (SELECT CASE lower(trim(source)) WHEN 'web' THEN 'Web' WHEN 'news' THEN 'News' ELSE source END AS canon, lower(text) AS x FROM documents),
k AS (SELECT lang AS w, source FROM documents GROUP BY ALL),
g AS (SELECT source AS canonical, bool_or(contains(x, 'the') OR contains(x, 'und')) AS hit FROM (SELECT source, lower(text) AS x FROM documents) GROUP BY source)
SELECT count(*) FILTER (hit) AS hits, count(*) AS present, count(*) AS total FROM g""")
def _(t):
    keys = t.documents.select(F.col("source").alias("canonical")).distinct()
    variants = keys.select(F.lower("canonical").alias("variant"), "canonical")
    words = keys.withColumn("words", F.array(F.lit("the"), F.lit("und")))
    d = t.documents.select(F.upper("source").alias("name"), "text")
    return quality.known_entity_hits(d, variants, words, "name", "text")


PAIRED_TEXT = """
WITH n AS (SELECT count(*) AS n FROM benchmark), pr AS (SELECT doc_id, d.text AS a, b.text AS b FROM documents d, n JOIN benchmark b ON b.item_id = d.doc_id % n.n),
tk AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(a), '[^a-z0-9\\s]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS a,
 list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(b), '[^a-z0-9\\s]', ' ', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS b FROM pr)"""


def paired_texts(t):
    """Each document beside a benchmark item."""
    n = t.benchmark.agg(F.count("*")).scalar()
    b = t.benchmark.select(F.col("item_id").alias("_b"), F.col("text").alias("gold"))
    return t.documents.select("doc_id", F.col("text").alias("pred")).withColumn("_b", F.col("doc_id") % n).join(b, "_b")


@query("normalised_answers", "H11", PAIRED_TEXT + "SELECT doc_id, md5(array_to_string(a, ' ')) AS answer, md5(array_to_string(b, ' ')) AS gold FROM tk")
def _(t):
    return paired_texts(t).select("doc_id", F.md5(X.normalise_answer(F.col("pred"))).alias("answer"), F.md5(X.normalise_answer(F.col("gold"))).alias("gold"))


@query("token_f1", "H12 G6 M5", PAIRED_TEXT + """
, x AS (SELECT doc_id, w, sum(p) AS p, sum(g) AS g FROM (SELECT doc_id, unnest(a) AS w, 1 AS p, 0 AS g FROM tk UNION ALL SELECT doc_id, unnest(b), 0, 1 FROM tk) GROUP BY ALL),
s AS (SELECT doc_id, sum(p) AS p, sum(g) AS g, sum(least(p, g)) AS same FROM x GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(p, 0) AS BIGINT) AS n_pred, CAST(coalesce(g, 0) AS BIGINT) AS n_gold, CAST(coalesce(same, 0) AS BIGINT) AS n_same,
 CAST(round(CASE WHEN s.doc_id IS NULL THEN 1.0 WHEN same = 0 THEN 0.0 ELSE 2.0 * same / (p + g) END, 6) AS DOUBLE) AS f1 FROM tk LEFT JOIN s USING (doc_id)""")
def _(t):
    out = overlap.token_f1(paired_texts(t), "doc_id", F.col("pred"), F.col("gold"))
    return out.select("doc_id", "n_pred", "n_gold", "n_same", r6("f1", "f1"))


@query("overlap_diagnostics", "H13 G5", PAIRED_TEXT + r"""
, q AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(a), '[a-z0-9]+')) AS x, list_distinct(regexp_extract_all(lower(b), '[a-z0-9]+')) AS y, greatest(length(a), 1) AS la, greatest(length(b), 1) AS lb FROM pr)
SELECT doc_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 4) AS jaccard, len(list_intersect(x, y)) AS shared_tokens, len(x) AS first_tokens, len(y) AS second_tokens, round(la / lb, 3) AS length_ratio FROM q""")
def _(t):
    return overlap.diagnostics(paired_texts(t), "doc_id", F.col("pred"), F.col("gold"))


BIGRAM_SQL = """
g AS (SELECT doc_id, side, gram, count(*) AS n, min(i) AS f FROM (SELECT doc_id, side, substr(s, i, 2) AS gram, i FROM
  (SELECT doc_id, side, regexp_replace(lower(s), '\\s+', ' ', 'g') AS s FROM (SELECT doc_id, 'a' AS side, a AS s FROM pr UNION ALL SELECT doc_id, 'b', b FROM pr)) z, unnest(range(1, length(s))) AS u(i)) GROUP BY ALL),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, side ORDER BY n DESC, f) AS rank FROM g) WHERE rank <= 10)"""


@query("top_bigrams", "F5", PAIRED_TEXT + "," + BIGRAM_SQL + "SELECT doc_id, gram, n AS count, rank FROM tp WHERE side = 'a'")
def _(t):
    return overlap.top_bigrams(t.documents, "doc_id", F.col("text"))


@query("bigram_jaccard", "H14", PAIRED_TEXT + "," + BIGRAM_SQL + """
, c AS (SELECT doc_id, gram, count(*) AS k FROM tp GROUP BY ALL) SELECT doc_id, round(count(*) FILTER (k = 2) / count(*), 6) AS jaccard FROM c GROUP BY doc_id""")
def _(t):
    return overlap.bigram_jaccard(paired_texts(t), "doc_id", F.col("pred"), F.col("gold")).select("doc_id", r6("jaccard", "jaccard"))


@query("fuzzy_recall", "K9", PAIRED_TEXT + """
, q AS (SELECT doc_id, list_distinct(a) AS x, list_distinct(b) AS y FROM tk) SELECT doc_id, CAST(coalesce(len(x) > 0 AND len(y) > 0 AND
 len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.15, false) AS DOUBLE) AS recall FROM q""")
def _(t):
    p = paired_texts(t)
    return overlap.fuzzy_recall(p.select("doc_id", F.col("pred").alias("body")), p.select("doc_id", F.col("gold").alias("source")), "doc_id", 0.15)


@query("best_f1", "H12", PAIRED_TEXT + """
, x AS (SELECT doc_id, o, w, sum(p) AS p, sum(g) AS g FROM (SELECT doc_id, o, unnest(a) AS w, 1 AS p, 0 AS g FROM tk, range(2) r(o) UNION ALL SELECT doc_id, 0, unnest(b), 0, 1 FROM tk UNION ALL SELECT doc_id, 1, 'eauouon', 0, 1 FROM tk) GROUP BY ALL),
s AS (SELECT doc_id, o, sum(p) AS p, sum(g) AS g, sum(least(p, g)) AS same FROM x GROUP BY doc_id, o)
SELECT doc_id, round(max(CASE WHEN same = 0 THEN 0.0 ELSE 2.0 * same / (p + g) END), 6) AS f1 FROM s GROUP BY doc_id""")
def _(t):
    p = paired_texts(t).select("doc_id", "pred", F.array("gold", F.lit("The Eauouon.")).alias("options"))
    return overlap.best_f1(p, "doc_id", "pred", "options").select("doc_id", r6("f1", "f1"))


@query("pair_rows", "K11 H17", PAIRED_TEXT + """
, w AS (SELECT doc_id, list_distinct(a) AS x, list_distinct(b) AS y, a, b FROM tk)
SELECT doc_id AS qid, 'R' || (1 + doc_id % 2) AS condition, CASE WHEN regexp_matches(lower(pr.b), '\\bwho\\b') THEN 'relational' WHEN regexp_matches(lower(pr.b), '\\b(when|date|in\\s+[0-9]{4}|around\\s+[a-z0-9_]+\\s+[0-9]{4})\\b') THEN 'temporal' ELSE 'factual' END AS qtype,
 md5(trim(pr.a)) AS answer_digest, CAST(coalesce(len(x) > 0 AND len(y) > 0 AND len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.5, false) AS DOUBLE) AS recall_at_10 FROM w JOIN pr USING (doc_id)""")
def _(t):
    p = paired_texts(t)
    reply = F.concat(F.lit("Thinking. ANSWER: "), F.trim("pred"), F.lit(" [E1, 2]"))
    rec = overlap.fuzzy_recall(p.select("doc_id", F.col("pred").alias("body")), p.select("doc_id", F.col("gold").alias("source")), "doc_id")
    return p.join(rec, "doc_id").select(
        F.col("doc_id").alias("qid"), F.concat(F.lit("R"), (1 + F.col("doc_id") % 2).cast("string")).alias("condition"), X.question_type(F.col("gold")).alias("qtype"),
        F.md5(X.answer_text(reply)).alias("answer_digest"), F.col("recall").alias("recall_at_10"),
    )


@query("voice_attribution", "K12", """
WITH h AS (SELECT event_type AS variant, user_id AS u, CAST(props->>'$.k' AS BIGINT) AS k FROM events),
r AS (SELECT variant, count(*) AS n, avg(CAST(k % 3 = 0 OR (k % 3 = 1 AND k > 50) AS INT)) AS a, avg(CAST(k > 50 AS INT)) AS c, avg(CAST(k % 2 = 0 AS INT)) AS s FROM h GROUP BY variant)
SELECT variant, n, round(a, 6) AS attribution_rate, round(c, 6) AS closer_rate, round(s, 6) AS signoff_rate, a = (SELECT max(a) FROM r) AS best FROM r""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    h = t.events.select(
        F.col("event_type").alias("variant"), F.when(k % 3 == 0, "persona").when(k % 3 == 1, "actual").otherwise("control").alias("picked"),
        (k > 50).alias("persona_closer"), (k % 2 == 0).alias("signoff_match"),
    )
    rates = E.attribution(h, ["variant"])
    top = E.best_variant(rates, "variant", "attribution_rate", "n").select("variant").scalar()
    return rates.select("variant", "n", *[r6(c, c) for c in ("attribution_rate", "closer_rate", "signoff_rate")], (F.col("variant") == top).alias("best"))


@query("acceptance_gates", "K13", """
WITH m AS (SELECT qtype, avg(f1) FILTER (condition = 'R2') - avg(f1) FILTER (condition = 'R1') AS d FROM qa GROUP BY qtype)
SELECT qtype, CASE WHEN d >= 0.0 THEN 'PASS' ELSE 'FAIL' END AS f1_gate, CASE WHEN d >= 0.1 AND d - 0.05 > 0 THEN 'PASS' ELSE 'FAIL' END AS strict_gate FROM m""")
def _(t):
    m = E.arm_pivot(t.qa, ["qtype"], "condition", ["R2", "R1"], "f1")
    return m.select("qtype", E.gate(F.col("delta"), 0.0).alias("f1_gate"), E.gate(F.col("delta"), 0.1, F.col("delta") - 0.05).alias("strict_gate"))


@query("graded_answers", "H32", """
WITH g AS (SELECT event_id, event_type AS e, value AS v, CAST(props->>'$.k' AS INT) AS k FROM events)
SELECT event_id, CASE e WHEN 'click' THEN k % 2 = 0 WHEN 'view' THEN k <= 50 WHEN 'error' THEN abs(-v + 20) <= 10 OR k = 7 WHEN 'signup' THEN k % 2 = 0 AND k % 3 = 0 END AS passed FROM g""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int")
    e = F.col("event_type")
    answer = (
        F.when(e == "click", F.when(k % 2 == 0, "It was ALPHA team").otherwise("none"))
        .when(e == "view", F.format_string("about %d,000 mails", k))
        .when(e == "error", F.concat(F.lit("score −"), F.col("value").cast("string"), F.when(k == 7, " and –20.5").otherwise("")))
        .when(e == "signup", F.concat_ws(" ", F.when(k % 2 == 0, "Jane DOE"), F.when(k % 3 == 0, "smith")))
    )
    kind = F.when(e == "click", "contains").when(e == "view", "integer").when(e == "error", "numeric").when(e == "signup", "name_in_set").otherwise("judge")
    value = F.when(e == "click", " Alpha ").when(e == "view", "25000").when(e == "error", "-20")
    tol = F.when(e == "view", 25000.0).otherwise(10.0)
    names = F.array(F.lit("Jane Doe"), F.lit("Bo Smith"))
    return t.events.select("event_id", G.grade(answer, kind, value, tol, names, F.lit(2)).alias("passed"))


@query("stylometry", "H15", r"""
WITH b AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Dear all,' || chr(10) || text || chr(10) || 'JB' WHEN 1 THEN 'Sally,' || chr(10) || text || chr(10) || 'John Arnold ' || chr(10)
  WHEN 2 THEN text || chr(10) || '--' WHEN 3 THEN text || ' Sent from my  BlackBerry' WHEN 4 THEN '  ' || text ELSE '  Good morning x. ' || text END AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(list_transform(string_split_regex(t, '[.!?]+'), lambda s: len(regexp_extract_all(s, '[^\s\p{Z}]+'))), lambda n: n > 0) AS n,
  regexp_matches(t, '(?i)sent\s+from\s+my\s+blackberry') AS device_tag, lower(regexp_replace(substr(t, 1, 120), '^[\s\p{Z}]+', '')) AS head,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), lambda x: x <> '')[-1] AS tail FROM b)
SELECT doc_id, round(CASE WHEN len(n) > 0 THEN list_sum(n) / len(n) ELSE 0 END, 6) AS mean_sentence_length,
 CASE WHEN regexp_matches(head, '^(dear |good morning|good afternoon|good evening)') THEN 'formal' WHEN regexp_matches(substr(t, 1, 120), '(?m)^[A-Z][a-z]+,\s*$') THEN 'first_name' ELSE 'none' END AS salutation,
 CASE WHEN device_tag THEN 'blackberry' WHEN tail IS NULL THEN 'none' WHEN tail IN ('-', '--') THEN 'dash' WHEN regexp_matches(tail, '^[A-Z]{2,4}$') THEN 'initials'
  WHEN regexp_matches(tail, '^[A-Z][a-z]+(\s+[A-Z][a-z]+){0,2}$') THEN 'full_name' ELSE 'none' END AS signoff, device_tag FROM s""")
def _(t):
    b = F.expr(
        r"""CASE doc_id % 6 WHEN 0 THEN 'Dear all,\n' || text || '\nJB' WHEN 1 THEN 'Sally,\n' || text || '\nJohn Arnold \n' WHEN 2 THEN text || '\n--'
        WHEN 3 THEN text || ' Sent from my  BlackBerry' WHEN 4 THEN '  ' || text ELSE '  Good morning x. ' || text END"""
    )
    d = t.documents.select("doc_id", b.alias("t"))
    c = F.col("t")
    return d.select("doc_id", r6(X.mean_sentence_length(c), "mean_sentence_length"), X.salutation(c).alias("salutation"), X.signoff(c).alias("signoff"), X.device_tag(c).alias("device_tag"))


@query("stylometry_flags", "H16", PAIRED_TEXT + """
, z AS (SELECT doc_id, a || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'JB' ELSE chr(10) || '--' END AS a, b || CASE WHEN doc_id % 3 = 0 THEN chr(10) || 'XY' ELSE chr(10) || '-' END AS b FROM pr)
SELECT doc_id, (doc_id % 2 = 0) = (doc_id % 3 = 0) AS persona_matches_signoff FROM z""")
def _(t):
    a = F.concat("pred", F.when(F.col("doc_id") % 2 == 0, "\nJB").otherwise("\n--"))
    b = F.concat("gold", F.when(F.col("doc_id") % 3 == 0, "\nXY").otherwise("\n-"))
    return paired_texts(t).select("doc_id", (X.signoff(a) == X.signoff(b)).alias("persona_matches_signoff"))


@query("answer_marks", "H17", """
SELECT doc_id, md5(trim(text)) AS answer FROM documents""")
def _(t):
    reply = F.concat(F.lit("first\nanswer :\n "), F.col("text"), F.lit(" [E1, 3][E2] "))
    return t.documents.select("doc_id", F.md5(F.trim(X.answer_text(reply))).alias("answer"))


@query("citations", "H18", """
WITH k AS (SELECT event_id, CAST(props->>'$.k' AS INT) % 6 AS k FROM events)
SELECT event_id, array_to_string(list_filter(CASE WHEN k = 2 THEN ['id2', 'id1'] ELSE [CASE WHEN k BETWEEN 1 AND 3 THEN 'id' || k END, 'id2', 'id1'] END, lambda x: x IS NOT NULL)
 [1:], '|') AS cited FROM k WHERE k <> 1 UNION ALL SELECT event_id, 'id1|id2' FROM k WHERE k = 1""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("int") % 6
    text = F.concat(F.lit("so [E"), k.cast("string"), F.lit("] and [E2, E1, 9] [x]"))
    ids = F.array(F.lit("id1"), F.lit("id2"), F.lit("id3"))
    return t.events.select("event_id", listed(X.cited_ids(text, ids), "cited"))


@query("question_types", "H22", r"""
WITH q AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Who sent it?' WHEN 1 THEN 'It ran in 1999, whose?' WHEN 2 THEN 'What DATE' WHEN 3 THEN 'around june 2001 so' ELSE 'why' END || chr(10) || text AS t,
 CASE doc_id % 5 WHEN 0 THEN 'Vice President' WHEN 1 THEN 'President' WHEN 2 THEN 'Chief Risk Officer' WHEN 3 THEN 'trader' END AS title FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(lower(t), '\bwho\b') THEN 'relational' WHEN regexp_matches(lower(t), '\b(when|date|in\s+\d{4}|around\s+\w+\s+\d{4})\b') THEN 'temporal' ELSE 'factual' END AS qtype,
 CASE doc_id % 5 WHEN 0 THEN 'manager' WHEN 1 THEN 'executive' WHEN 2 THEN 'executive' ELSE 'ic' END AS role FROM q""")
def _(t):
    lead = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Who sent it?' WHEN 1 THEN 'It ran in 1999, whose?' WHEN 2 THEN 'What DATE' WHEN 3 THEN 'around june 2001 so' ELSE 'why' END")
    title = F.expr("CASE doc_id % 5 WHEN 0 THEN 'Vice President' WHEN 1 THEN 'President' WHEN 2 THEN 'Chief Risk Officer' WHEN 3 THEN 'trader' END")
    return t.documents.select("doc_id", X.question_type(F.concat(lead, F.lit("\n"), F.col("text"))).alias("qtype"), X.title_class(title).alias("role"))


ROLE_CASES = (
    ("Sr. VP & General Counsel", "SVP"), ("vice president, trading", "VP"), ("President & COO", "C-Suite"), ("Managing Director", "SVP"),
    ("director of gas", "Director"), ("Executive Director", "Unknown"), ("in-house lawyer", "Manager"), ("gas trader", "Employee"),
    ("Chief Compliance Officer", "C-Suite"), ("n/a", "Unknown"), ("svp", "SVP"), ("V.P. power", "VP"), ("baker", "Unknown"), ("MANAGER", "Manager"),
)


@query("canonical_roles", "H21 H29", f"""
WITH c AS (SELECT [{', '.join(f"'{b}'" for _, b in ROLE_CASES)}] AS r)
SELECT p_partkey, CASE WHEN p_size < 10 THEN 'Unknown' ELSE r[1 + p_partkey % {len(ROLE_CASES)}] END AS canonical_role,
 CASE WHEN p_size < 10 THEN NULL ELSE [4, 3, 6, 4, 2, NULL, 1, 0, 6, NULL, 4, 3, NULL, 1][1 + p_partkey % {len(ROLE_CASES)}] END AS level FROM part, c""")
def _(t):
    raw = F.get(F.array(*[F.lit(a) for a, _ in ROLE_CASES]), (F.col("p_partkey") % len(ROLE_CASES)).cast("int"))
    conf = F.when(F.col("p_size") < 10, 0.5).otherwise(0.6)
    p = t.part.select("p_partkey", X.canonical_role(raw, conf).alias("canonical_role"))
    return p.withColumn("level", X.ordinal_map(F.col("canonical_role"), V.TIERS))


@query("level_maps", "H29", """
SELECT p_partkey, [6, 4, 4, 3, 2, 1, 1, 0, 0, NULL][1 + p_partkey % 10] AS level FROM part""")
def _(t):
    names = ["CEO", "Managing Director", "Managing Director", "Vice President", "Director", "Manager", "In House Lawyer", "Trader", "Employee", "Cook"]
    title = F.get(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % 10).cast("int"))
    return t.part.select("p_partkey", X.ordinal_map(X.ordinal_map(title, V.TITLE_TIERS), V.LEVELS).alias("level"))
