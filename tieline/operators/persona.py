"""Persona signals, rule-based narratives, text documents, and model payload shaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tieline.functions import text as X
from tieline.functions import vocabulary as V


def signals(people: DataFrame, mean_words: Column) -> DataFrame:
    """Adds directiveness, agenda setting, verbosity (sigmoid against the corpus mean) and topics.

    ``people``: pct_request_sent, pct_decision_carrying, mean_body_words, top3_topics.
    """
    words = F.when(F.col("mean_body_words") != 0, F.col("mean_body_words"))
    z = F.when(mean_words > 0, (F.coalesce(words, mean_words) - mean_words) / mean_words).otherwise(F.lit(0.0))
    return people.withColumns(
        {
            "directiveness_signal": F.coalesce("pct_request_sent", F.lit(0.0)),
            "agenda_setting_signal": F.coalesce("pct_decision_carrying", F.lit(0.0)),
            "verbosity_signal": 1.0 / (1.0 + F.exp(-z)),
            "expertise_topics": F.coalesce("top3_topics", F.array().cast("array<string>")),
        }
    )


def narrative(people: DataFrame, org: str = "the organisation") -> DataFrame:
    """Adds a rule-based narrative struct ``heuristic`` from the signals (confidence 1)."""
    d, a, v = F.col("directiveness_signal"), F.col("agenda_setting_signal"), F.col("verbosity_signal")
    style = (
        F.when((d > 0.4) & (a > 0.3), "directive").when((d < 0.2) & (a < 0.1), "passive").when(d > 0.3, "consultative").otherwise("collaborative")
    )
    p = F.coalesce("politeness_baseline", F.lit(0.5))
    formality = F.when(p > 0.7, 4).when(p > 0.5, 3).otherwise(2)
    verb = F.when(v > 0.7, "verbose").when(v < 0.3, "terse").otherwise("moderately concise")
    topics = F.col("expertise_topics")
    focus = F.when(F.size(topics) > 0, F.array_join(F.slice(topics, 1, 3), ", ")).otherwise("general business operations")
    hedge = F.coalesce(F.format_string(" with hedge rate %.2f/100 words", F.col("hedge_rate")), F.lit(""))
    hedge = F.when(F.col("hedge_rate").isNotNull(), hedge).otherwise("")
    level = F.when((d > 0.3) & (a > 0.2), "mid- to senior-level role with decision authority").otherwise("support or operational role")
    return people.withColumn(
        "heuristic",
        F.struct(
            formality.alias("formality"),
            style.alias("authority_style"),
            F.concat(
                F.lit("Communicates in a "), verb, F.lit(" style with a "), style, F.lit(" authority pattern"), hedge,
                F.lit(", primarily addressing "), focus, F.lit("."),
            ).alias("communication_style"),
            F.concat(F.lit("Works in "), F.coalesce("function", F.lit("Unknown")), F.lit(f" at {org}, focused on "), focus, F.lit(".")).alias("role_summary"),
            F.when(F.size(topics) > 0, F.slice(topics, 1, 5)).otherwise(F.array(F.lit(f"{org} operations"))).alias("expertise"),
            F.concat(
                F.format_string("Signal-based estimate (directiveness=%.2f, agenda_setting=%.2f): ", d, a), level, F.lit(".")
            ).alias("seniority_narrative"),
            F.lit(1).alias("confidence_self_report"),
        ),
    )


def merge_layers(people: DataFrame, model: str = "model") -> DataFrame:
    """Model narrative over deterministic signals; expertise falls back to the topics when empty."""
    m = F.col(model)
    keep = ["formality", "authority_style", "communication_style", "role_summary", "seniority_narrative", "confidence_self_report"]
    return people.withColumns(
        {c: m[c] for c in keep}
        | {"expertise": F.when(F.size(F.coalesce(m["expertise"], F.array().cast("array<string>"))) > 0, m["expertise"]).otherwise(F.col("expertise_topics"))}
    )


def heuristic_fallback(people: DataFrame, model: str = "model") -> DataFrame:
    """The model's answer, or the rule-based narrative (confidence 1) where its role summary is empty."""
    empty = F.coalesce(F.trim(F.col(model)["role_summary"]), F.lit("")) == ""
    return people.withColumn(model, F.when(empty, F.col("heuristic")).otherwise(F.col(model)))


def email_document(subject: Column, body: Column) -> Column:
    return F.concat(F.lit("Subject: "), F.coalesce(subject, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")))


def _some(col: Column, lead: str, tail: str = "") -> Column:
    return F.when(F.coalesce(col, F.lit("")) != "", F.concat(F.lit(lead), col, F.lit(tail)))


def person_document(p: dict[str, Column]) -> Column:
    """One searchable passage per person; parts without data are left out."""
    none = F.lit(None).cast("string")
    get = lambda k: p.get(k, none)
    dims = F.concat_ws(", ", *[F.when(get(d).isNotNull(), F.concat(F.lit(f"{d}="), get(d).cast("string"))) for d in ("formality", "verbosity", "directiveness", "agenda_setting")])
    lst = lambda k, n=None: F.array_join(F.slice(p[k], 1, n) if n else p[k], ", ") if k in p else none
    return F.concat_ws(
        " ",
        F.concat(p["name"], F.lit(" — "), F.coalesce(get("title"), F.lit("Unknown role")), F.lit(".")),
        _some(get("role_summary"), "Role: "),
        F.concat(F.lit("Function: "), F.coalesce(get("function"), F.lit("Unknown")), F.lit(".")),
        _some(get("authority_style"), "Authority style: ", "."),
        _some(dims, "Persona: ", "."),
        _some(get("communication_style"), "Style: "),
        _some(lst("topics"), "Topics: ", "."),
        _some(lst("expertise"), "Expertise: ", "."),
        _some(lst("contacts", 5), "Frequent contacts: ", "."),
    )


def entity_document(name: Column, domain: Column, category: Column, relation: Column, total: Column, contacts: Column, org: str = "us") -> Column:
    return F.concat_ws(
        " ",
        F.concat(name, F.lit(" (domain "), domain, F.lit(") is an external organization in the category '"), F.coalesce(category, F.lit("Unknown")), F.lit("'.")),
        F.concat(F.lit(f"Relationship type to {org}: "), F.coalesce(relation, F.lit("Unknown")), F.lit(".")),
        F.concat(F.lit(f"Total observed email volume with {org}: "), F.coalesce(total, F.lit(0)).cast("string"), F.lit(".")),
        _some(F.array_join(F.slice(contacts, 1, 5), ", "), "In direct contact: ", "."),
    )


def passages(rows: DataFrame, key: str) -> DataFrame:
    """Numbered passage block of the few retrieved rows per query.  ``rows``: key, rank, date, sender, subject, body."""
    line = F.concat(
        F.lit("[E"), F.col("rank").cast("string"), F.lit("] ("), F.coalesce(F.col("date").cast("string"), F.lit("unknown date")), F.lit(", "),
        F.coalesce("sender", F.lit("unknown sender")), F.lit(") "), F.trim(F.coalesce("subject", F.lit(""))), F.lit("\n"), F.trim(F.coalesce("body", F.lit(""))),
    )
    packed = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(packed, lambda s: s["line"]), "\n\n").alias("passages"))


SIGNAL_SCHEMA = (
    "speech_acts string, action_required string, commitment_made string, decision_carrying string, mentions_money string, "
    "mentions_regulator string, sentiment string, topics string, entities_mentioned string"
)


def valid_signals(payload: Column) -> Column:
    """JSON text to the validated signal struct.

    Known speech acts only (a single string counts as a list), flags default to false,
    sentiment defaults to 0 and is clamped to ±1, lists default to [].
    """
    p = F.from_json(payload, SIGNAL_SCHEMA)
    raw = p["speech_acts"]
    acts = F.when(F.startswith(raw, F.lit("[")), X.json_list(raw)).otherwise(F.when(raw.isNotNull(), F.array(raw)))
    acts = F.filter(F.transform(F.coalesce(acts, F.array().cast("array<string>")), lambda a: F.lower(a)), lambda a: a.isin(*V.SPEECH_ACTS))
    flag = lambda k: F.coalesce(~F.lower(p[k]).isin("false", "0", "0.0", "", "[]", "{}"), F.lit(False)).alias(k)
    mood = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(p["sentiment"].try_cast("double"), F.lit(0.0))))
    return F.struct(
        acts.alias("speech_acts"),
        *[flag(k) for k in ("action_required", "commitment_made", "decision_carrying", "mentions_money", "mentions_regulator")],
        mood.alias("sentiment"),
        X.json_list(p["topics"]).alias("topics"),
        X.json_list(p["entities_mentioned"]).alias("entities_mentioned"),
    )


def pair_payload(answer: Column) -> list[Column]:
    """Flattened, capped columns of a pair answer struct."""
    return [
        answer["deference_score"].alias("deference_score"),
        F.substring(F.coalesce(answer["deference_reasoning"], F.lit("")), 1, 500).alias("deference_reasoning"),
        F.substring(F.coalesce(answer["relationship_type"], F.lit("transactional")), 1, 50).alias("relationship_type"),
        F.to_json(F.coalesce(answer["shared_topics"], F.array().cast("array<string>"))).alias("shared_topics_json"),
    ]


def entity_payload(answer: Column) -> list[Column]:
    """Flattened, capped columns of an entity answer struct."""
    capped = lambda k, n, default: F.substring(F.coalesce(answer[k], F.lit(default)), 1, n).alias(k)
    return [
        capped("description", 500, ""), capped("business_relationship", 50, "Other"), capped("industry", 200, ""),
        capped("engagement_pattern", 50, "transactional"), capped("tone", 50, "transactional"),
        F.to_json(F.coalesce(answer["topics"], F.array().cast("array<string>"))).alias("topics_json"),
    ]
