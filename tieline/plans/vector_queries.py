"""Vector search, clusters and their validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieline.operators import density, stats, vectors
from tieline.plans.columns import r6
from tieline.plans.registry import query
from tieline.session import cut_lineage

CENTROIDS = """
WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS v FROM embeddings, unnest(range(1, 65)) AS u(i) GROUP BY label, i),
c AS MATERIALIZED (SELECT label, list(v ORDER BY i) AS centroid FROM x GROUP BY label),
e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"""
SIM = "round(list_cosine_similarity({a}, {b}), 9)"


@query("centroids", "D15 M5", CENTROIDS + """
SELECT label, n, round(list_sum(centroid), 6) AS total, round(centroid[1], 6) AS first FROM c JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label) WHERE n >= 5""")
def _(t):
    out = vectors.centroids(t.embeddings, min_size=5)
    total = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x)
    return out.select("label", "n", r6(total, "total"), r6(F.get("centroid", F.lit(0)), "first"))


def label_queries(t):
    return vectors.centroids(t.embeddings).select(F.col("label").alias("query_id"), F.col("centroid").alias("query"))


@query("cosine_top_k", "C17", CENTROIDS + f"""
SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT c.label AS query_id, e.vec_id, {SIM.format(a='c.centroid', b='e.v')} AS s,
 row_number() OVER (PARTITION BY c.label ORDER BY {SIM.format(a='c.centroid', b='e.v')} DESC, e.vec_id) AS rank FROM c, e) WHERE rank <= 10""")
def _(t):
    out = vectors.cosine_top_k(t.embeddings, label_queries(t), 10)
    return out.select("query_id", "vec_id", r6("similarity", "similarity"), "rank")


@query("cosine_filtered", "C17 B9", CENTROIDS + f"""
SELECT query_id, vec_id, rank FROM (SELECT c.label AS query_id, e.vec_id,
 row_number() OVER (PARTITION BY c.label ORDER BY {SIM.format(a='c.centroid', b='e.v')} DESC, e.vec_id) AS rank FROM c, e WHERE e.label >= 5) WHERE rank <= 5""")
def _(t):
    return vectors.cosine_top_k(t.embeddings.where("label >= 5"), label_queries(t), 5).select("query_id", "vec_id", "rank")


@query("nearest_centroid", "C18", CENTROIDS + f"""
SELECT vec_id, label, round(s, 6) AS similarity FROM (SELECT e.vec_id, c.label, {SIM.format(a='c.centroid', b='e.v')} AS s,
 row_number() OVER (PARTITION BY e.vec_id ORDER BY {SIM.format(a='c.centroid', b='e.v')} DESC, c.label) AS rn FROM c, e) WHERE rn = 1""")
def _(t):
    out = vectors.nearest_centroid(t.embeddings, vectors.centroids(t.embeddings))
    return out.select("vec_id", "label", r6("similarity", "similarity"))


@query("cluster_representatives", "E14", CENTROIDS + f"""
SELECT label, vec_id, round(s, 6) AS similarity, rank FROM (SELECT e.label, e.vec_id, {SIM.format(a='c.centroid', b='e.v')} AS s,
 row_number() OVER (PARTITION BY e.label ORDER BY {SIM.format(a='c.centroid', b='e.v')} DESC, e.vec_id) AS rank FROM e JOIN c USING (label)) WHERE rank <= 5""")
def _(t):
    return vectors.representatives(t.embeddings).select("label", "vec_id", r6("similarity", "similarity"), "rank")


@query("cluster_validation", "J10 K3 K4 K5", CENTROIDS + f"""
, a AS (SELECT vec_id, truth, pred FROM (SELECT e.vec_id, e.label AS truth, c.label AS pred, row_number() OVER (PARTITION BY e.vec_id ORDER BY {SIM.format(a='c.centroid', b='e.v')} DESC, c.label) AS rn FROM c, e) WHERE rn = 1),
k AS (SELECT truth, pred, count(*) AS n FROM a GROUP BY ALL), t AS (SELECT sum(n) AS t FROM k), ra AS (SELECT truth, sum(n) AS m FROM k GROUP BY 1), rb AS (SELECT pred, sum(n) AS m FROM k GROUP BY 1),
s AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM k) AS ij, (SELECT sum(m * (m - 1) / 2.0) FROM ra) AS i, (SELECT sum(m * (m - 1) / 2.0) FROM rb) AS j, t * (t - 1) / 2.0 AS p,
 (SELECT -sum(m / t * ln(m / t)) FROM ra, t) AS ha, (SELECT -sum(m / t * ln(m / t)) FROM rb, t) AS hb, (SELECT -sum(n / t * ln(n / t)) FROM k, t) AS hab,
 (SELECT sum(x) FROM (SELECT pred, max(n) AS x FROM k GROUP BY pred)) / t AS pu FROM t)
SELECT round((ij - i * j / p) / ((i + j) / 2 - i * j / p), 6) AS ari, round((ha + hb - hab) / ((ha + hb) / 2), 6) AS nmi, round(pu, 6) AS purity FROM s""")
def _(t):
    assigned = vectors.nearest_centroid(t.embeddings, vectors.centroids(t.embeddings)).select("vec_id", F.col("label").alias("pred"))
    j = assigned.join(t.embeddings.select("vec_id", F.col("label").alias("truth")), "vec_id")
    out = stats.rand_index(j, "truth", "pred")
    n = stats.nmi(j, "truth", "pred").select("nmi").scalar()
    p = stats.purity(j, "truth", "pred").scalar()
    return out.select(r6("ari", "ari"), r6(n, "nmi"), r6(p, "purity"))


@query("truncated_search", "J11", """
WITH e AS MATERIALIZED (SELECT vec_id, label, CAST(embedding[1:16] AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT label, i, avg(v[i]) AS m FROM
 (SELECT label, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS v FROM e), unnest(range(1, 17)) AS u(i) GROUP BY label, i),
c AS MATERIALIZED (SELECT label, list(m ORDER BY i) AS centroid FROM x GROUP BY label)
SELECT query_id, vec_id, round(s, 6) AS similarity, rank FROM (SELECT c.label AS query_id, e.vec_id, round(list_cosine_similarity(c.centroid, e.v), 9) AS s,
 row_number() OVER (PARTITION BY c.label ORDER BY round(list_cosine_similarity(c.centroid, e.v), 9) DESC, e.vec_id) AS rank FROM c, e) WHERE rank <= 10""")
def _(t):
    e = t.embeddings.select("vec_id", "label", vectors.truncated(F.col("embedding"), 16).alias("embedding"))
    q = vectors.centroids(e).select(F.col("label").alias("query_id"), F.col("centroid").alias("query"))
    return vectors.cosine_top_k(e, q, 10).select("query_id", "vec_id", r6("similarity", "similarity"), "rank")


@query("reduced_vectors", "J1")
def _(t):
    p = vectors.reduce_dimensions(t.embeddings)
    return p.select("vec_id", *[F.round(F.get("point", F.lit(i)), 6).alias(f"p{i}") for i in range(5)])


@query("density_clusters", "J2 J3")
def _(t):
    p = cut_lineage(vectors.reduce_dimensions(t.embeddings))
    # Both granularities read one forest, and its levels once.
    forest = density.spanning_forest(density.reachability(density.neighbours(p, 10)))
    return vectors.label_table(density.condensed_at(p, forest, {"project": 50, "topic": 10}), "vec_id", "project", "topic")


@query("cluster_label_table", "J3 H38", """
SELECT CAST(vec_id AS VARCHAR) AS email_id, label // 2 AS project_label, label - 1 AS topic_label, printf('P%03d', label // 2) AS project_id,
 CASE WHEN label > 0 THEN printf('T%03d', label - 1) END AS topic_id FROM embeddings""")
def _(t):
    e = t.embeddings.select("vec_id", F.floor(F.col("label") / 2).alias("p"), (F.col("label") - 1).alias("t"))
    return vectors.label_table(e, "vec_id", "p", "t")


@query("topics_write_back", "J4 A15", """
SELECT email_id, CASE WHEN doc_id % 30 > 0 THEN printf('T%03d', doc_id % 30 - 1) ELSE array_to_string(topics, '|') END AS topic_ids FROM mail""")
def _(t):
    from tieline.functions.text import padded_id
    from tieline.plans.columns import listed
    from tieline.plans.graph_queries import cluster_labels
    from tieline.sources.sinks import update_columns

    new = cluster_labels(t).where("topic_label >= 0").select("email_id", F.array(padded_id(F.col("topic_label"), "T")).alias("topic_ids"))
    out = update_columns(t.mail.select("email_id", F.col("topics").alias("topic_ids")), new, "email_id", ["topic_ids"])
    return out.select("email_id", listed("topic_ids", "topic_ids"))


@query("source_findability", "K14", CENTROIDS + f"""
, k AS (SELECT query_id, max(CAST(label = query_id AS INT)) AS found FROM (SELECT c.label AS query_id, e.label, row_number() OVER (PARTITION BY c.label ORDER BY {SIM.format(a='c.centroid', b='e.v')} DESC, e.vec_id) AS rank FROM c, e)
 WHERE rank <= 10 GROUP BY query_id) SELECT count(*) AS n, round(avg(found), 6) AS share FROM k""")
def _(t):
    near = vectors.cosine_top_k(t.embeddings, label_queries(t), 10).join(t.embeddings.select("vec_id", "label"), "vec_id")
    hit = near.groupBy("query_id").agg(F.max((F.col("label") == F.col("query_id")).cast("double")).alias("found"))
    return hit.agg(F.count("*").alias("n"), r6(F.avg("found"), "share"))
