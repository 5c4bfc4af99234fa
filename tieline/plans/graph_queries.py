"""Network measures and property-graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tieline.functions import text as X
from tieline.operators import knowledge as K
from tieline.operators import network, reach, rollups
from tieline.operators.retrieval import search_columns
from tieline.plans.columns import listed, r6
from tieline.plans.registry import query
from tieline.plans.rollup_queries import DEFER_SQL, deference

NODES = "SELECT src AS node FROM {e} UNION SELECT dst FROM {e}"


@query("graph_nodes", "I1", NODES.format(e="contact"))
def _(t):
    return network.nodes(t.contact)


@query("graph_density", "I9", f"""
WITH n AS (SELECT count(*) AS nodes FROM ({NODES.format(e="contact")})), e AS (SELECT count(*) AS edges FROM contact)
SELECT nodes, edges, round(edges / (nodes * (nodes - 1)), 9) AS density FROM n, e""")
def _(t):
    return network.density(t.contact).select("nodes", "edges", r6("density", "density", 9))


def _rank_rounds(n: int) -> str:
    steps = []
    for i in range(n):
        steps.append(
            f"""r{i + 1} AS MATERIALIZED (SELECT v.node, v.sink, 0.85 * coalesce(f.flow, 0) + (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE sink)) / (SELECT count(*) FROM vx) AS rank
 FROM vx v LEFT JOIN (SELECT l.dst AS node, sum(r.rank * l.share) AS flow FROM ln l JOIN r{i} r ON r.node = l.src GROUP BY 1) f ON f.node = v.node)"""
        )
    return ",\n".join(steps)


@query("pagerank", "I3", f"""
WITH e AS MATERIALIZED (SELECT * FROM contact), ow AS (SELECT src, sum(weight) AS w FROM e GROUP BY src),
ln AS MATERIALIZED (SELECT e.src, e.dst, e.weight / ow.w AS share FROM e JOIN ow ON ow.src = e.src),
vx AS MATERIALIZED (SELECT n.node, ow.src IS NULL AS sink FROM ({NODES.format(e="e")}) n LEFT JOIN ow ON ow.src = n.node),
r0 AS MATERIALIZED (SELECT node, sink, 1.0 / (SELECT count(*) FROM vx) AS rank FROM vx),
{_rank_rounds(8)}
SELECT node, round(rank, 9) AS pagerank FROM r8""")
def _(t):
    return network.pagerank(t.contact, tol=0.0, max_iter=8).select("node", r6("pagerank", "pagerank", 9))


@query("pagerank_converged", "I3")
def _(t):
    return network.pagerank(t.trade).select("node", r6("pagerank", "pagerank", 9))


@query("betweenness", "I4")
def _(t):
    return network.betweenness(t.tie).select("node", r6("betweenness", "betweenness", 9))


@query("communities", "I5")
def _(t):
    return network.louvain(t.tie)


REACH = """
WITH RECURSIVE l AS (SELECT src AS a, dst AS b FROM tie UNION SELECT dst, src FROM tie), r AS (
  SELECT a AS node, a AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other)"""


@query("weak_components", "I7", """
WITH RECURSIVE l AS MATERIALIZED (SELECT src AS a, dst AS b FROM contact UNION SELECT dst, src FROM contact), r(node, component) USING KEY (node) AS (
 SELECT DISTINCT a, a FROM l UNION SELECT cur.node, min(r.component) FROM r JOIN l ON l.a = r.node JOIN recurring.r AS cur ON cur.node = l.b WHERE r.component < cur.component GROUP BY cur.node)
SELECT node, component FROM r""")
def _(t):
    return network.components(t.contact)


@query("strong_components", "I8", """
WITH RECURSIVE r AS (SELECT src AS node, src AS other FROM contact UNION SELECT dst, dst FROM contact UNION SELECT r.node, t.dst FROM r JOIN contact t ON t.src = r.other)
SELECT a.node, min(a.other) AS component FROM r a JOIN r b ON b.node = a.other AND b.other = a.node GROUP BY a.node""")
def _(t):
    return network.strong_components(t.contact)


@query("path_estimates", "I11")
def _(t):
    out = reach.distance_estimates(t.contact)
    return out.select("weak_components", "largest_size", "steps", F.round("avg_shortest_path", 2).alias("avg_shortest_path"))


@query("clustering", "I10", """
WITH p AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM contact),
t AS MATERIALIZED (SELECT x.a AS i, x.b AS j, y.b AS k FROM p x JOIN p y ON y.a = x.b JOIN p z ON z.a = x.a AND z.b = y.b),
d AS (SELECT node, count(*) AS deg FROM (SELECT a AS node FROM p UNION ALL SELECT b FROM p) GROUP BY node),
c AS (SELECT node, count(*) AS tri FROM (SELECT i AS node FROM t UNION ALL SELECT j FROM t UNION ALL SELECT k FROM t) GROUP BY node),
n AS (SELECT deg, coalesce(tri, 0) AS tri FROM d LEFT JOIN c USING (node))
SELECT round(avg(CASE WHEN deg > 1 THEN 2.0 * tri / (deg * (deg - 1)) ELSE 0 END), 6) AS avg_clustering, round(2.0 * sum(tri) / sum(deg * (deg - 1)), 6) AS transitivity FROM n""")
def _(t):
    return network.clustering(t.contact).select(r6("avg_clustering", "avg_clustering"), r6("transitivity", "transitivity"))


@query("path_lengths", "I11 I7", REACH + """
, c AS (SELECT node, min(other) AS component FROM r GROUP BY node), big AS (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
m AS (SELECT node FROM c JOIN big USING (component)), d AS (SELECT node AS s, node AS v, 0 AS d FROM m UNION SELECT d.s, l.b, d.d + 1 FROM d JOIN l ON l.a = d.v WHERE d.d < 60),
x AS (SELECT s, v, min(d) AS d FROM d WHERE s <> v GROUP BY s, v)
SELECT (SELECT count(DISTINCT component) FROM c) AS weak_components, (SELECT count(*) FROM m) AS largest_size, CAST(max(d) AS BIGINT) AS diameter, round(avg(d), 6) AS avg_shortest_path FROM x""")
def _(t):
    out = network.path_summary(t.tie)
    return out.select("weak_components", "largest_size", "diameter", r6("avg_shortest_path", "avg_shortest_path"))


@query("top_subgraph", "F4", """
WITH d AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM contact UNION ALL SELECT dst FROM contact) GROUP BY node),
k AS (SELECT node FROM d ORDER BY n DESC, node LIMIT 60)
SELECT src, dst, weight FROM contact JOIN k a ON a.node = src JOIN k b ON b.node = dst""")
def _(t):
    return network.top_subgraph(t.contact, 60)


def typed_nodes(t):
    return t.person.select(F.col("name").alias("node"), F.when(F.col("level") == 0, "Team").when(F.col("level") == 1, "Project").otherwise("Person").alias("node_type"))


@query("typed_subgraph", "B19", """
WITH n AS (SELECT name AS node, CASE level WHEN 0 THEN 'Team' WHEN 1 THEN 'Project' ELSE 'Person' END AS node_type FROM person),
e AS (SELECT c.src, c.dst FROM contact c JOIN n a ON a.node = c.src AND a.node_type <> 'Team' JOIN n b ON b.node = c.dst AND b.node_type <> 'Team' WHERE c.weight >= 2),
d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node)
SELECT node, node_type, degree FROM n JOIN d USING (node) ORDER BY degree DESC, node LIMIT 60""")
def _(t):
    edges = t.contact.select("src", "dst", F.when(F.col("weight") >= 2, "STRONG").otherwise("WEAK").alias("edge_type"))
    return network.typed_subgraph(typed_nodes(t), edges, ["Person", "Project"], ["STRONG"], 60)


REPORT_SQL = DEFER_SQL + """
, rep AS (SELECT a AS subordinate, min(b) AS superior FROM (SELECT *, min(raw_score) OVER (PARTITION BY a) AS lo FROM d WHERE raw_score < -0.5) WHERE raw_score = lo GROUP BY a)"""


def reports(t):
    return K.strongest_superior(deference(t)).select("subordinate", "superior")


@query("org_chart", "I6", REPORT_SQL + """
, w1 AS (SELECT subordinate AS low, superior AS high, 1 AS depth FROM rep), w2 AS (SELECT DISTINCT low, superior AS high, 2 AS depth FROM w1 JOIN rep ON subordinate = high),
w3 AS (SELECT DISTINCT low, superior AS high, 3 AS depth FROM w2 JOIN rep ON subordinate = high),
w AS (SELECT low, high, min(depth) AS depth FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3) WHERE low <> high GROUP BY low, high)
SELECT low AS name, 'boss' AS relation, high AS other, depth FROM w UNION ALL SELECT high, 'report', low, depth FROM w""")
def _(t):
    return network.org_chart(reports(t), 3)


@query("reporting_edges", "I16", REPORT_SQL + "SELECT subordinate, superior FROM rep")
def _(t):
    return reports(t)


@query("membership_edges", "I16", """
SELECT name, level AS team FROM person""")
def _(t):
    people = t.person.select(F.col("name").alias("node"), F.col("level").alias("community"), F.col("balance").alias("score"))
    return K.member_edges(people, K.team_table(people, "score"))


@query("sent_edges", "I12", """
SELECT email_id, 'SENT_BY' AS edge_type, sender AS name FROM mail JOIN person p ON p.name = sender WHERE level > 0
UNION ALL SELECT DISTINCT email_id, 'SENT_TO', recipient FROM mail_to JOIN person p ON p.name = recipient WHERE level > 0""")
def _(t):
    return K.sent_edges(t.mail, t.person.where("level > 0"))


CLUSTER_SQL = "SELECT email_id, doc_id % 12 - 1 AS project_label, doc_id % 30 - 1 AS topic_label FROM mail"


def cluster_labels(t):
    return t.mail.select("email_id", (F.col("doc_id") % 12 - 1).alias("project_label"), (F.col("doc_id") % 30 - 1).alias("topic_label"))


@query("cluster_edges", "I13 C10", """
WITH c AS (SELECT email_id, doc_id % 12 - 1 AS p, doc_id % 30 - 1 AS t FROM mail WHERE decision_carrying)
SELECT email_id, 'ABOUT_PROJECT' AS edge_type, printf('P%03d', p) AS cluster_id FROM c WHERE p >= 0 UNION ALL
SELECT email_id, 'ABOUT_TOPIC', printf('T%03d', t) FROM c WHERE t >= 0""")
def _(t):
    flagged = t.mail.where("decision_carrying")
    labels = cluster_labels(t)
    p = K.flagged_labels(labels, flagged, "project_label", "P", "cluster_id").withColumn("edge_type", F.lit("ABOUT_PROJECT"))
    q = K.flagged_labels(labels, flagged, "topic_label", "T", "cluster_id").withColumn("edge_type", F.lit("ABOUT_TOPIC"))
    return p.unionByName(q)


@query("knowledge_edges", "I14 H30", """
SELECT DISTINCT sender AS name, CASE WHEN u.x = 'Brand#1' THEN 'First brand' ELSE 'Brand#' || split_part(u.x, '#', 2) END AS topic FROM mail, unnest(topics) AS u(x)""")
def _(t):
    mapping = t.part.where("p_brand = 'Brand#1'").select(F.lower("p_brand").alias("raw"), F.lit("First brand").alias("canonical")).distinct()
    return K.canonical_edges(t.mail.select(F.col("sender").alias("name"), F.transform("topics", lambda x: F.upper(x)).alias("topics")), "name", "topics", mapping)


@query("deference_edges", "I15 H34", """
SELECT CASE WHEN s < 0 THEN a ELSE b END AS junior, CASE WHEN s < 0 THEN b ELSE a END AS senior, round(abs(s), 6) AS score, round(s, 6) AS raw_score
FROM (SELECT src AS a, dst AS b, (weight % 41 - 20) / 10.0 AS s FROM trade) WHERE s <> 0""")
def _(t):
    pairs = t.trade.select(F.col("src").alias("person_a"), F.col("dst").alias("person_b"), ((F.col("weight") % 41 - 20) / 10.0).alias("deference_score"))
    return K.deference_edges(pairs).select("junior", "senior", r6("score", "score"), r6("raw_score", "raw_score"))


@query("relation_edges", "I15", """
SELECT src AS person_a, dst AS person_b, CASE WHEN weight % 2 = 0 THEN 'peer' ELSE 'transactional' END AS type FROM trade WHERE weight % 5 > 0""")
def _(t):
    pairs = t.trade.select(
        F.col("src").alias("person_a"), F.col("dst").alias("person_b"), F.when(F.col("weight") % 5 > 0, 1.0).alias("deference_score"),
        F.when(F.col("weight") % 2 == 0, "peer").alias("relationship_type"),
    )
    return K.relation_edges(pairs)


@query("known_contacts", "I17", """
SELECT src, dst, weight FROM contact JOIN (SELECT name FROM person WHERE level > 1) a ON a.name = src JOIN (SELECT name FROM person WHERE level > 1) b ON b.name = dst""")
def _(t):
    return K.between_known(t.contact, t.person.where("level > 1"))


@query("graph_audit", "D29 A17", """
SELECT 'Person' AS kind, count(*) AS n FROM person UNION ALL SELECT 'Email', count(*) FROM mail UNION ALL SELECT 'COMMUNICATES_WITH', count(*) FROM contact
UNION ALL SELECT 'REPORTS_TO', (SELECT count(DISTINCT src) FROM contact)""")
def _(t):
    return K.audit({"Person": t.person, "Email": t.mail, "COMMUNICATES_WITH": t.contact, "REPORTS_TO": reports(t)})


@query("topics_per_person", "D24 C31", """
WITH l AS (SELECT sender AS person, doc_id % 30 - 1 AS t FROM mail)
SELECT person, printf('T%03d', t) AS topic_id, CASE WHEN t % 2 = 0 THEN 'Topic ' || t ELSE printf('T%03d', t) END AS name, count(*) AS emails FROM l WHERE t >= 0 GROUP BY ALL""")
def _(t):
    names = cluster_labels(t).where("topic_label >= 0 and topic_label % 2 = 0").select("topic_label").distinct().select(
        X.padded_id(F.col("topic_label"), "T").alias("topic_id"), F.concat(F.lit("Topic "), F.col("topic_label").cast("string")).alias("name")
    )
    m = t.mail.select("email_id", F.col("sender").alias("person")).join(cluster_labels(t), "email_id").where("topic_label >= 0")
    counts = m.groupBy("person", X.padded_id(F.col("topic_label"), "T").alias("topic_id")).agg(F.count("*").alias("emails"))
    return counts.join(names, "topic_id", "left").select("person", "topic_id", F.coalesce("name", "topic_id").alias("name"), "emails")


@query("noise_counts", "C31 J3", """
SELECT count(*) FILTER (t < 0) AS noise, count(*) FILTER (t >= 0) AS clustered, count(DISTINCT CASE WHEN t >= 0 THEN t END) AS clusters FROM (SELECT doc_id % 30 - 1 AS t FROM mail)""")
def _(t):
    by = cluster_labels(t).groupBy("topic_label").agg(F.count("*").alias("n"))
    some = F.col("topic_label") >= 0
    return by.agg(
        F.sum(F.when(~some, F.col("n")).otherwise(0)).alias("noise"), F.sum(F.when(some, F.col("n")).otherwise(0)).alias("clustered"), F.count_if(some).alias("clusters")
    )


@query("cluster_context", "C11", """
WITH l AS (SELECT email_id, subject, decision_carrying, doc_id % 30 - 1 AS t FROM mail), e AS (SELECT * FROM l WHERE t >= 0),
r AS (SELECT t, email_id AS rep, subject AS rs, row_number() OVER (PARTITION BY t ORDER BY CAST(email_id AS BIGINT)) AS rn FROM e),
x AS (SELECT e.email_id, e.t, rs, row_number() OVER (PARTITION BY e.email_id ORDER BY rn) AS k FROM e JOIN (SELECT * FROM r WHERE rn <= 5) r ON r.t = e.t AND rep <> e.email_id)
SELECT email_id, printf('T%03d', t) AS topic_id, 'Topic ' || t AS topic_name, string_agg(rs, '|' ORDER BY k) AS examples FROM x WHERE k <= 3 GROUP BY ALL""")
def _(t):
    from tieline.operators.ordering import top_per_key

    labels = t.mail.select("email_id", "subject").join(cluster_labels(t), "email_id").where("topic_label >= 0").select("email_id", "subject", F.col("topic_label").alias("label"))
    reps = top_per_key(labels, ["label"], [F.col("email_id").cast("bigint")], 5)
    names = reps.groupBy("label").agg(
        F.concat(F.lit("Topic "), F.first(F.col("label").cast("string"))).alias("topic_name"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "email_id"))), lambda s: s["email_id"]).alias("rep_ids"),
    )
    return K.cluster_context(labels, names, t.mail.select("email_id", "subject"), "label", "T", 3).select(
        "email_id", "topic_id", "topic_name", listed("examples", "examples")
    )


@query("entity_volumes", "A7 D36", """
SELECT domain, count(*) AS total FROM (SELECT split_part(u.a, '@', 2) AS domain FROM mail, unnest(recipients_emails) AS u(a)) WHERE domain <> 'corp.example' GROUP BY domain ORDER BY total DESC, domain LIMIT 10""")
def _(t):
    orgs = t.mail.select(F.explode("recipients_emails").alias("a")).select(X.domain_of(F.col("a")).alias("domain")).where("domain <> 'corp.example'")
    return orgs.groupBy("domain").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "domain").limit(10)


@query("category_counts", "D36", "SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY ALL")
def _(t):
    return rollups.value_counts(t.customer, "c_mktsegment", "category")


@query("person_search", "B16 C28", """
SELECT name FROM person WHERE contains(lower(name), '99') OR contains(lower(title), 'auto')""")
def _(t):
    return t.person.where(search_columns("99", "name") | search_columns("AUTO", "title")).select("name")
