"""Property-graph tables: teams, reporting lines, typed edges, topics, external parties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tieline.functions import text as X


def team_table(people: DataFrame, score: str) -> DataFrame:
    """Size, captain and display name per community ≥ 0.  ``people``: node, community, score."""
    top = people.where("community >= 0").groupBy("community").agg(F.count("*").alias("size"), F.max(score).alias("_best"))
    lead = people.join(top, "community").where(F.col(score) == F.col("_best"))
    return (
        lead.groupBy(F.col("community").alias("team"))
        .agg(F.max("size").alias("size"), F.min("node").alias("captain"))
        .withColumn("name", F.concat(F.lit("Team "), F.col("team").cast("string"), F.lit(" ("), F.col("captain"), F.lit(")")))
    )


def inferred_boss(people: DataFrame, score: str) -> DataFrame:
    """(subordinate, superior): the best scored member leads the rest of a community of two or more."""
    lead = team_table(people, score).where("size >= 2").select(F.col("team").alias("community"), "captain")
    return people.join(lead, "community").where("node <> captain").select(
        F.col("node").alias("subordinate"), F.col("captain").alias("superior")
    )


def strongest_superior(defers: DataFrame, threshold: float = 0.5, both_signs: bool = False) -> DataFrame:
    """Per subordinate the superior of the strongest negative score below ``-threshold``.

    ``both_signs`` also reads positive scores, with the pair turned round.
    """
    rows = defers.select("a", "b", "raw_score")
    if both_signs:
        rows = rows.unionByName(rows.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("raw_score")).alias("raw_score")))
    low = rows.where(F.col("raw_score") < -threshold)
    best = low.groupBy("a").agg(F.max(F.abs("raw_score")).alias("confidence"))
    return (
        low.join(best, "a")
        .where(F.abs("raw_score") == F.col("confidence"))
        .groupBy(F.col("a").alias("subordinate"))
        .agg(F.min("b").alias("superior"), F.max("confidence").alias("confidence"))
    )


def flagged_labels(labels: DataFrame, flagged: DataFrame, label: str, letter: str, out: str) -> DataFrame:
    """Cluster ids of flagged mails only, noise dropped."""
    return (
        labels.where(F.col(label) >= 0)
        .join(flagged.select("email_id"), "email_id", "left_semi")
        .select("email_id", X.padded_id(F.col(label), letter).alias(out))
    )


def external_edges(mail: DataFrame, names: DataFrame, domains: DataFrame) -> DataFrame:
    """Person ↔ outside-domain mail counts: (person, domain, direction, weight).

    ``mail``: sender_email, recipients_emails.  ``names``: address → name.
    """
    rows = mail.select(F.lower("sender_email").alias("s"), F.explode("recipients_emails").alias("r")).select("s", F.lower("r").alias("r"))
    pairs = rows.groupBy("s", "r").agg(F.count("*").alias("n"))
    wanted = domains.select("domain").distinct()
    person = names.select("address", F.col("name").alias("person"))

    def one(inside: str, outside: str, tag: str) -> DataFrame:
        return (
            pairs.withColumn("domain", X.domain_of(F.col(outside)))
            .join(wanted, "domain", "left_semi")
            .join(person, F.col(inside) == F.col("address"))
            .groupBy("person", "domain", F.lit(tag).alias("direction"))
            .agg(F.sum("n").alias("weight"))
        )

    return one("s", "r", "out").unionByName(one("r", "s", "in"))


def vocabulary(sources: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct trimmed, lower-cased items of JSON list columns from several tables."""
    out = None
    for df, col in sources:
        items = df.select(F.explode(X.json_list(F.col(col))).alias("item")).select(F.lower(F.trim("item")).alias("item")).distinct()
        out = items if out is None else out.union(items)
    return out.distinct()


def invert_vocabulary(raw: DataFrame, groups: DataFrame, other: str = "Other") -> DataFrame:
    """(raw, canonical): variants to their canonical name, stragglers to ``other``."""
    inverted = (
        groups.select("canonical", F.explode("variants").alias("v"))
        .select(F.lower(F.trim("v")).alias("raw"), "canonical")
        .groupBy("raw")
        .agg(F.max("canonical").alias("canonical"))
    )
    return raw.join(inverted, "raw", "left").withColumn("canonical", F.coalesce("canonical", F.lit(other)))


def canonical_edges(owners: DataFrame, key: str, topics: str, mapping: DataFrame) -> DataFrame:
    """Distinct (key, topic) edges to canonical topics; unmapped topics in title case."""
    rows = owners.select(key, F.explode(topics).alias("t"))
    return (
        rows.withColumn("raw", F.lower(F.trim("t")))
        .join(mapping, "raw", "left")
        .select(key, F.coalesce("canonical", F.initcap("t")).alias("topic"))
        .distinct()
    )


def deference_edges(pairs: DataFrame) -> DataFrame:
    """(junior, senior, score, raw_score): a negative score means a defers to b, a positive one the reverse."""
    s = F.col("deference_score")
    return pairs.where(s.isNotNull() & (s != 0)).select(
        F.when(s < 0, F.col("person_a")).otherwise(F.col("person_b")).alias("junior"),
        F.when(s < 0, F.col("person_b")).otherwise(F.col("person_a")).alias("senior"),
        F.abs(s).alias("score"),
        s.alias("raw_score"),
    )


def relation_edges(pairs: DataFrame) -> DataFrame:
    return pairs.where("deference_score is not null").select(
        "person_a", "person_b", F.coalesce("relationship_type", F.lit("transactional")).alias("type")
    )


def sent_edges(mail: DataFrame, people: DataFrame) -> DataFrame:
    """SENT_BY and SENT_TO edges, only to people that exist: (email_id, edge_type, name)."""
    by = mail.select("email_id", F.lit("SENT_BY").alias("edge_type"), F.col("sender").alias("name"))
    to = mail.select("email_id", F.lit("SENT_TO").alias("edge_type"), F.explode("recipients").alias("name")).distinct()
    return by.unionByName(to).join(people.select("name"), "name", "left_semi").select("email_id", "edge_type", "name")


def member_edges(people: DataFrame, teams: DataFrame) -> DataFrame:
    """MEMBER_OF by community equality, communities ≥ 0."""
    return people.where("community >= 0").join(teams.select(F.col("team").alias("community")), "community").select(
        F.col("node").alias("name"), F.col("community").alias("team")
    )


def between_known(edges: DataFrame, people: DataFrame) -> DataFrame:
    """Communication edges with both ends in the person table."""
    known = people.select("name")
    return edges.join(known.withColumnRenamed("name", "src"), "src", "left_semi").join(
        known.withColumnRenamed("name", "dst"), "dst", "left_semi"
    ).select("src", "dst", "weight")


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per node or edge table."""
    out = None
    for kind, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def cluster_context(labels: DataFrame, names: DataFrame, mail: DataFrame, label: str, letter: str, k: int = 3) -> DataFrame:
    """Cluster id, name and the subjects of up to ``k`` representative mails other than the mail itself.

    ``names``: label, topic_name, rep_ids (a short ordered list per cluster).  The representatives
    are hydrated once per cluster, then attached to the mails as a short list.
    """
    reps = names.select(label, F.posexplode("rep_ids").alias("_pos", "email_id"))
    hydrated = (
        reps.join(mail.select("email_id", "subject"), "email_id")
        .groupBy(label)
        .agg(F.array_sort(F.collect_list(F.struct("_pos", "email_id", "subject"))).alias("_reps"))
    )
    known = names.select(label, "topic_name").join(hydrated, label, "left")
    rows = labels.where(F.col(label) >= 0).select("email_id", label).join(known, label, "left")
    other = F.slice(F.filter("_reps", lambda r: r["email_id"] != F.col("email_id")), 1, k)
    return rows.select(
        "email_id", X.padded_id(F.col(label), letter).alias("topic_id"), "topic_name", F.transform(other, lambda r: r["subject"]).alias("examples")
    )
