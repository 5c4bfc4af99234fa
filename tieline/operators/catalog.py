"""Named, argument-checked query catalogue over a set of tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from tieline.operators import network, retrieval, scoring
from tieline.operators.ordering import value_ranks
from tieline.operators.vectors import cosine_top_k

_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": (list, tuple)}


def check_args(schema: Mapping[str, Any], args: Mapping[str, Any]) -> str | None:
    """First problem of the arguments against a small schema, or None.

    Schema: name → {type, required, enum, minimum, max_items}.
    """
    for name, rule in schema.items():
        value = args.get(name)
        if value is None:
            if rule.get("required"):
                return f"missing argument {name!r}"
            continue
        kind = rule.get("type", "string")
        if not isinstance(value, _TYPES[kind]) or (kind in ("integer", "number") and isinstance(value, bool)):
            return f"argument {name!r} must be {kind}"
        if "enum" in rule and value not in rule["enum"]:
            return f"argument {name!r} must be one of {list(rule['enum'])}"
        if "minimum" in rule and value < rule["minimum"]:
            return f"argument {name!r} must be at least {rule['minimum']}"
        if "max_items" in rule and len(value) > rule["max_items"]:
            return f"argument {name!r} takes at most {rule['max_items']} items"
    unknown = sorted(set(args) - set(schema))
    return f"unknown argument {unknown[0]!r}" if unknown else None


@dataclass
class QueryCatalog:
    """Queries by name.  A bad call gives a one-row ``error, details`` DataFrame instead of raising."""

    spark: SparkSession
    entries: dict[str, tuple[str, Mapping[str, Any], Callable[..., DataFrame]]] = field(default_factory=dict)

    def register(self, name: str, description: str, schema: Mapping[str, Any], fn: Callable[..., DataFrame]) -> None:
        if name in self.entries:
            raise ValueError(f"{name} is already registered")
        self.entries[name] = (description, schema, fn)

    def subset(self, *names: str) -> QueryCatalog:
        return QueryCatalog(self.spark, {n: self.entries[n] for n in names})

    def describe(self) -> list[tuple[str, str]]:
        return [(n, d) for n, (d, _, _) in self.entries.items()]

    def call(self, name: str, **args: Any) -> DataFrame:
        if name not in self.entries:
            return self._error("UnknownQuery", name)
        _, schema, fn = self.entries[name]
        problem = check_args(schema, args)
        if problem:
            return self._error("InvalidArgs", problem)
        try:
            return fn(**{k: v for k, v in args.items() if v is not None})
        except (ValueError, KeyError) as e:
            return self._error(type(e).__name__, str(e))

    def _error(self, kind: str, details: str) -> DataFrame:
        return self.spark.range(1).select(F.lit(kind).alias("error"), F.lit(details).alias("details"))


def pair_lookup(pairs: DataFrame, **names: str) -> DataFrame:
    """One directed pair; accepts sender/recipient, name1/name2 or person_a/person_b."""
    for a, b in (("sender", "recipient"), ("name1", "name2"), ("person_a", "person_b")):
        if names.get(a) and names.get(b):
            return pairs.where((F.col("sender_id") == names[a]) & (F.col("recipient_id") == names[b]))
    raise ValueError("give sender and recipient")


def dominance_score(people: DataFrame, name: str, score: str = "composite_score_v3") -> DataFrame:
    """One person's row with ``rank_v3`` = 1 + number strictly above."""
    r = value_ranks(people, score)
    above = r.select(score, (F.col("n_total") - F.col("n_below") - F.col("n_equal") + 1).alias("rank_v3"))
    return people.where(F.col("name") == name).join(above, score, "left")


def build_catalog(spark: SparkSession, tables: Mapping[str, DataFrame], embed: Callable[[str], list[float]] | None = None) -> QueryCatalog:
    """The standard entries.

    ``tables``: mail (with body_truncated, thread_position), mail_topics, pairs, people, reports,
    members, edges, email_vectors (email_id, embedding), person_vectors (name, embedding).
    ``embed`` turns a query text into a vector.
    """
    cat = QueryCatalog(spark)
    text, req = {"type": "string"}, {"type": "string", "required": True}
    num = {"type": "integer", "minimum": 1}
    flag, real = {"type": "boolean"}, {"type": "number"}

    def vector(query: str) -> DataFrame:
        if embed is None:
            raise ValueError("no embedding function given")
        v = F.array(*[F.lit(float(x)) for x in embed(query)])
        return spark.range(1).select(F.lit(0).alias("query_id"), v.alias("query"))

    def semantic(query: str, n: int = 5, sender: str | None = None, before_date: str | None = None) -> DataFrame:
        m = retrieval.as_of(tables["mail"], before_date)
        m = m.where(F.col("sender") == sender) if sender else m
        items = tables["email_vectors"].join(m.select("email_id"), "email_id", "left_semi") if sender or before_date else tables["email_vectors"]
        near = cosine_top_k(items, vector(query), n, item="email_id")
        return near.join(tables["mail"].select("email_id", "subject", "sender", "date"), "email_id").orderBy("rank")

    def centrality(metric: str, tier: int | None = None, top_n: int = 10) -> DataFrame:
        allowed = [c for c in ("composite_score", "composite_score_v3", "pagerank", "betweenness", "in_degree", "tier") if c in tables["people"].columns]
        return scoring.leaders(tables["people"], metric, allowed, tier, top_n)

    def card(name: str, before_date: str | None = None) -> DataFrame:
        one = tables["people"].where(F.col("name") == name)
        return retrieval.person_cards(one, tables["reports"], tables["members"], tables["mail_topics"].where(F.col("sender") == name), before_date)

    def chart(name: str, depth: int = 2) -> DataFrame:
        return network.org_chart(tables["reports"], depth).where(F.col("name") == name)

    cat.register("get_person", "Identity card of one person", {"name": req, "before_date": text}, card)
    cat.register(
        "get_thread_history", "Last mails from one person to another", {"sender": req, "recipient": req, "before_date": text, "n": num},
        lambda **a: retrieval.thread_history(tables["mail"], **a),
    )
    cat.register(
        "find_topic_collaborators", "People with the most mails on a topic", {"topic": req, "before_date": text, "n": num},
        lambda topic, **a: retrieval.topic_collaborators(tables["mail_topics"], topic, **a),
    )
    cat.register("get_org_chart", "Bosses above and reports below", {"name": req, "depth": num}, chart)
    cat.register("get_email_content", "One mail in full", {"email_id": req}, lambda email_id: retrieval.email_content(tables["mail"], email_id))
    cat.register("search_emails_semantic", "Mails closest to a text", {"query": req, "n": num, "sender": text, "before_date": text}, semantic)
    cat.register(
        "get_thread", "All mails of a thread in order", {"thread_id": req, "before_date": text},
        lambda thread_id, **a: retrieval.thread_read_out(tables["mail"], thread_id, **a),
    )
    pair = {k: text for k in ("sender", "recipient", "name1", "name2", "person_a", "person_b")}
    cat.register("get_pair_signals", "Dyadic signals of two people", pair, lambda **a: pair_lookup(tables["pairs"], **a))
    cat.register("find_person", "People closest to a text", {"query": req, "k": num}, lambda query, k=5: cosine_top_k(tables["person_vectors"], vector(query), k, item="name"))
    cat.register(
        "find_emails", "Mails matching filters",
        {"sender": text, "recipient": text, "before_date": text, "after_date": text, "speech_act": text, "topic": text, "subject_contains": text, "body_contains": text,
         "decision_carrying": flag, "action_required": flag, "sentiment_min": real, "sentiment_max": real, "n": num},
        lambda **a: retrieval.find_emails(tables["mail"], **a),
    )
    cat.register(
        "get_emails_bulk", "Several mails in the given order", {"ids": {"type": "array", "required": True, "max_items": 20}, "focus": text},
        lambda ids, focus=None: retrieval.bulk_fetch(tables["mail"], ids),
    )
    cat.register("get_centrality", "Top people by a metric", {"metric": req, "tier": {"type": "integer"}, "top_n": num}, centrality)
    cat.register("get_dominance_score", "Scores and rank of one person", {"name": req}, lambda name: dominance_score(tables["people"], name))
    cat.register("query_sql", "Read-only SQL", {"sql": req, "limit": num}, lambda sql, limit=200: retrieval.guarded_sql(spark, sql, limit))
    return cat
