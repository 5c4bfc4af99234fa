"""Text expressions.  All are native column functions, so they stay inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from tieline.functions import vocabulary as V

WORD = r"[\p{L}\p{N}_]+"
NOT_BEFORE, NOT_AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
SPACE = r"[\s\p{Z}]"


#: What counts as white space at the ends of a text: that of Unicode, line ends and separators included (fixed value).
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(col: Column) -> Column:
    """The text without white space at either end."""
    return F.btrim(col, F.lit(WHITE))


def strip_right(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITE))


def any_of(words: Iterable[str]) -> str:
    """Pattern for whole words out of a list, with Unicode-aware word edges."""
    return f"{NOT_BEFORE}(?:{'|'.join(words)}){NOT_AFTER}"


def count_of(col: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(pattern)).cast("bigint")


def contains_any(col: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | col.contains(n)
    return out


def marker_hits(col: Column, markers: Iterable[str]) -> Column:
    """How many distinct markers occur as substrings of the lower-cased text."""
    low = F.lower(F.coalesce(col, F.lit("")))
    total = F.lit(0)
    for m in markers:
        total = total + low.contains(m).cast("int")
    return total.cast("bigint")


def word_count(col: Column) -> Column:
    return count_of(col, WORD)


def politeness(col: Column) -> Column:
    return F.least(marker_hits(col, V.POLITE_MARKERS) / F.lit(5.0), F.lit(1.0))


def hedges(col: Column) -> Column:
    return marker_hits(col, V.HEDGE_MARKERS)


def _equals(word: str):
    # A factory: a default argument would be taken for the element index.
    return lambda x: x == word


def modal_counts(col: Column) -> Column:
    """Map modal → count; the text is scanned once for all modals."""
    hits = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(f"({any_of(V.MODALS)})"), F.lit(1))
    return F.map_from_arrays(
        F.array(*[F.lit(m) for m in V.MODALS]),
        F.array(*[F.size(F.filter(hits, _equals(m))) for m in V.MODALS]),
    )


def imperative_count(col: Column) -> Column:
    """Sentences whose first token is a bare imperative verb."""
    parts = F.split(F.coalesce(col, F.lit("")), rf"[.!?]{SPACE}+|\n+")
    first = F.transform(
        parts,
        lambda s: F.lower(
            F.regexp_replace(F.regexp_extract(s, r"^[^\p{L}\p{N}_]*([^\s\p{Z}]*)", 1), r"[,;:]+$", "")
        ),
    )
    return F.size(F.filter(first, lambda w: w.isin(*V.IMPERATIVES))).cast("bigint")


def normalise_subject(col: Column, lower_first: bool = False) -> Column:
    """Drop repeated reply/forward prefixes, fold blanks, lower-case.

    ``lower_first`` trims before looking for prefixes (the thread-split variant); otherwise a
    leading blank hides the prefix.
    """
    s = F.coalesce(col, F.lit(""))
    if lower_first:
        s = F.lower(F.trim(s))
    s = F.regexp_replace(s, r"^(?:(?i:re|fwd?)\s*:\s*)+", "")
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def domain_of(address: Column) -> Column:
    """Part after the first ``@``, lower-cased, without quotes, brackets and blanks; NULL without ``@``."""
    tail = F.regexp_extract(F.lower(address), r"^[^@]*@(.*)$", 1)
    return F.when(address.contains("@"), F.btrim(tail, F.lit('<>" ')))


def trailing_domain(address: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(address), r"@([\w.\-]+)$", 1), F.lit(""))


def missing_to_null(col: Column) -> Column:
    """NULL for the spellings of "missing": empty, nan, none, null in any case."""
    return F.when(~F.lower(strip(col)).isin(*V.MISSING_NAMES), col)


def nan_to_null(col: Column) -> Column:
    return F.when(~F.isnan(col), col)


def normalise_answer(col: Column) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(col, F.lit(""))), r"[^a-z0-9\s]", " ")
    s = F.regexp_replace(s, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def answer_tokens(col: Column) -> Column:
    return F.filter(F.split(normalise_answer(col), " "), lambda t: t != "")


def alnum_tokens(col: Column) -> Column:
    """Lower-cased ASCII alphanumeric tokens, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard of two token lists as sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def slug(col: Column, joiner: str = "_", cap: int | None = None) -> Column:
    s = F.btrim(F.regexp_replace(F.lower(col), r"[^a-z0-9]+", joiner), F.lit(joiner))
    return F.substring(s, 1, cap) if cap else s


def name_slug(col: Column) -> Column:
    """Display name or slug to a slug: blanks and dashes to underscores, dots dropped."""
    return F.replace(F.translate(F.lower(F.trim(col)), " -", "__"), F.lit("."), F.lit(""))


def excerpt(col: Column, cap: int) -> Column:
    """Trimmed text, cut to ``cap`` characters with a closing ellipsis when longer."""
    body = strip(F.coalesce(col, F.lit("")))
    return F.when(F.length(body) > cap, F.concat(strip_right(F.substring(body, 1, cap - 1)), F.lit("…"))).otherwise(body)


def snippet(body: Column, focus: Column, size: int) -> Column:
    """Window of ``size`` characters around the first case-insensitive hit, clamped to the text."""
    at = F.instr(F.lower(body), F.lower(focus)) - 1
    n = F.length(body)
    start = F.greatest(F.lit(0), at - size // 2)
    start = F.greatest(F.lit(0), F.least(n, start + size) - size)
    return F.when(at < 0, F.substring(body, 1, size)).otherwise(F.substr(body, start + 1, F.lit(size)))


def looks_forwarded(body: Column) -> Column:
    head = F.substring(strip(F.coalesce(body, F.lit(""))), 1, 200)
    return contains_any(head, V.FORWARD_MARKERS) | head.startswith("From:")


def quoted_fraction(body: Column) -> Column:
    """Share of lines that are quoted or come at or after a forward marker."""
    lines = F.split(F.coalesce(body, F.lit("")), "\n", -1)
    # One struct a body, bound once: a lambda evaluates its own expression again for every line.
    marked = F.transform(lines, lambda ln: F.struct(F.ltrim(ln).startswith(">").alias("quoted"), F.regexp_like(ln, F.lit(V.FORWARD_LINE)).alias("marker")))

    def share(flags: Column) -> Column:
        first, n = F.array_position(flags["marker"], True), F.size(flags)
        before = F.when(first > 0, F.slice(flags["quoted"], F.lit(1), (first - 1).cast("int"))).otherwise(flags["quoted"])
        return (F.size(F.filter(before, lambda q: q)) + F.when(first > 0, n - first + 1).otherwise(0)) / n

    return F.transform(F.array(marked), share)[0]


def blank_word_count(body: Column) -> Column:
    """Words as runs of non-blank characters."""
    return count_of(body, r"[^\s\p{Z}]+")


def mean_sentence_length(body: Column) -> Column:
    parts = F.filter(
        F.transform(F.split(body, r"[.!?]+"), lambda s: F.regexp_count(s, F.lit(r"[^\s\p{Z}]+"))), lambda n: n > 0
    )
    total = F.aggregate(parts, F.lit(0), lambda a, x: a + x)
    return F.when(F.size(parts) > 0, total / F.size(parts)).otherwise(F.lit(0.0))


def salutation(body: Column) -> Column:
    head = F.substring(body, 1, 120)
    low = F.lower(F.regexp_replace(head, r"^[\s\p{Z}]+", ""))
    formal = F.lit(False)
    for lead in ("dear ", "good morning", "good afternoon", "good evening"):
        formal = formal | low.startswith(lead)
    return (
        F.when(formal, "formal")
        .when(F.regexp_like(head, F.lit(r"(?m)^[A-Z][a-z]+,\s*$")), "first_name")
        .otherwise("none")
    )


def device_tag(body: Column) -> Column:
    return F.regexp_like(body, F.lit(r"(?i)sent\s+from\s+my\s+blackberry"))


def signoff(body: Column) -> Column:
    lines = F.filter(
        F.transform(F.split(body, "\n"), lambda s: F.regexp_replace(s, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")),
        lambda s: s != "",
    )
    tail = F.try_element_at(lines, F.lit(-1))
    return (
        F.when(device_tag(body), "blackberry")
        .when(tail.isNull(), "none")
        .when(tail.isin("-", "--"), "dash")
        .when(F.regexp_like(tail, F.lit(r"^[A-Z]{2,4}$")), "initials")
        .when(F.regexp_like(tail, F.lit(r"^[A-Z][a-z]+(\s+[A-Z][a-z]+){0,2}$")), "full_name")
        .otherwise("none")
    )


def answer_text(col: Column) -> Column:
    """Text after ``ANSWER:``, without citation marks."""
    body = F.when(
        F.regexp_like(col, F.lit(r"(?is)answer\s*:\s*.+")), F.regexp_extract(col, r"(?is)answer\s*:\s*(.+)", 1)
    ).otherwise(col)
    return strip(F.regexp_replace(body, r"\[E[\d,\s]+\]", ""))


def cited_ids(text: Column, retrieved: Column) -> Column:
    """``[E1, E3]`` marks to retrieved ids: in first-seen order, once each, out-of-range dropped."""
    groups = F.regexp_extract_all(text, F.lit(r"\[E(\d+(?:\s*,\s*E?\d+)*)\]"), F.lit(1))
    tokens = F.flatten(F.transform(groups, lambda g: F.split(g, ",")))
    idx = F.transform(tokens, lambda t: F.ltrim(F.regexp_replace(F.trim(t), "^E+", "")).cast("int"))
    ids = F.transform(
        F.filter(idx, lambda i: (i >= 1) & (i <= F.size(retrieved))), lambda i: F.get(retrieved, i - 1)
    )
    return F.array_distinct(ids)


def question_type(col: Column) -> Column:
    return (
        F.when(F.regexp_like(col, F.lit(V.WHO_QUESTION)), "relational")
        .when(F.regexp_like(col, F.lit(V.WHEN_QUESTION)), "temporal")
        .otherwise("factual")
    )


def title_class(col: Column) -> Column:
    t = F.coalesce(col, F.lit(""))
    return (
        F.when(F.regexp_like(t, F.lit(V.EXECUTIVE_TITLE)), "executive")
        .when(F.regexp_like(t, F.lit(V.MANAGER_TITLE)), "manager")
        .otherwise("ic")
    )


def canonical_role(raw: Column, confidence: Column, threshold: float = 0.6) -> Column:
    """Free-text role to one of six tiers, most senior rule first; "Unknown" below the threshold."""
    t = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    like = lambda p: F.regexp_like(t, F.lit(p))
    is_vp_text = t.contains("vice president") | t.contains("vice-president")
    out = F.when(F.coalesce(confidence, F.lit(0.0)) < threshold, F.lit("Unknown"))
    for tier in V.TIERS:
        out = out.when(t == tier.lower(), F.lit(tier))
    return (
        out.when(t.isin("", "unknown", "n/a", "na", "none"), F.lit("Unknown"))
        .when(contains_any(t, V.EXECUTIVE_WORDS) | like(r"\bchief\b.*\bofficer\b"), F.lit("C-Suite"))
        .when(like(r"\bpresident\b") & ~is_vp_text, F.lit("C-Suite"))
        .when(contains_any(t, V.SENIOR_VP_WORDS) | like(r"\b(evp|svp)\b") | like(r"\bsr\.?\s+vp\b"), F.lit("SVP"))
        .when(is_vp_text | like(r"\bvp\b") | like(r"\bv\.p\."), F.lit("VP"))
        .when(t.contains("director") & ~t.contains("executive director"), F.lit("Director"))
        .when(contains_any(t, V.MANAGER_WORDS), F.lit("Manager"))
        .when(contains_any(t, V.EMPLOYEE_WORDS), F.lit("Employee"))
        .otherwise(F.lit("Unknown"))
    )


def ordinal_map(col: Column, mapping: dict) -> Column:
    """Look a value up in a small fixed map; NULL when absent."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), col)


def signal_phrases(text: Column, cap: int = 10) -> Column:
    """Distinctive phrases of a question: pattern by pattern, de-duplicated, the longest ``cap``."""
    t = F.coalesce(text, F.lit(""))
    hits = lambda p: F.regexp_extract_all(t, F.lit(p), F.lit(1))
    stop = F.array(*[F.lit(w) for w in V.PHRASE_STOPWORDS])
    useful = lambda a: F.filter(a, lambda p: ~F.array_contains(stop, p))
    found = F.array_distinct(
        F.concat(
            useful(hits(V.PROPER_NOUN)),
            hits(V.TITLED_NAME),
            F.filter(useful(hits(V.STYLIZED)), lambda p: F.length(p) >= 2),
            useful(hits(V.ACRONYM)),
            hits(V.MONTH_DAY),
            hits(V.WEEKDAY),
            useful(hits(V.TRIGGER_NAME)),
        )
    )
    ordered = F.transform(
        F.array_sort(F.transform(found, lambda p, i: F.struct((-F.length(p)).alias("k"), i.alias("i"), p.alias("p")))),
        lambda s: s["p"],
    )
    return F.when(F.size(found) > cap, F.slice(ordered, 1, cap)).otherwise(found)


def sender_hint(text: Column) -> Column:
    """Name in "email from X Y" or "X Y's email", NULL when there is none."""
    a = F.nullif(F.regexp_extract(text, V.SENDER_HINT, 1), F.lit(""))
    b = F.nullif(F.regexp_extract(text, V.SENDER_HINT, 2), F.lit(""))
    return F.coalesce(a, b)


def padded_id(label: Column, letter: str) -> Column:
    """``P007``-style id, NULL for noise."""
    return F.when(label >= 0, F.format_string(f"{letter}%03d", label))


def string_list(col: Column) -> Column:
    """JSON array or comma text to a list of strings; blank or broken input gives []."""
    empty = F.array().cast("array<string>")
    parsed = F.from_json(col, "array<string>")
    plain = F.filter(F.transform(F.split(col, ","), lambda x: strip(x)), lambda x: x != "")
    return F.coalesce(
        F.when(strip(F.coalesce(col, F.lit(""))) == "", empty)
        .when(F.ltrim(col).startswith("["), parsed)
        .otherwise(plain),
        empty,
    )


def json_list(col: Column) -> Column:
    """JSON array of strings; anything else gives []."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.when(F.ltrim(col).startswith("["), F.from_json(col, "array<string>")), empty)


def recipients_list(col: Column, is_text: bool) -> Column:
    """NULL → [], comma text or list → trimmed, non-empty addresses."""
    items = F.split(col, ",") if is_text else col
    clean = F.filter(F.transform(items, lambda x: strip(x)), lambda x: x != "")
    return F.coalesce(clean, F.array().cast("array<string>"))


def content_id(sender: Column, recipients: Column, date_text: Column, subject: Column) -> Column:
    """First 16 hex digits of sha-256 over ``sender|sorted recipients|date|subject``."""
    rec = F.array_join(F.array_sort(F.transform(recipients, lambda r: F.lower(strip(r)))), ",")
    key = F.concat_ws("|", F.lower(strip(sender)), rec, date_text, strip(F.coalesce(subject, F.lit(""))))
    return F.substring(F.sha2(key, 256), 1, 16)


def length_band(n: Column) -> Column:
    return F.when(n < 500, "short").when(n < 2000, "medium").otherwise("long")


def is_weekend(ts: Column) -> Column:
    return F.coalesce(F.weekday(ts) >= 5, F.lit(False))


def is_off_hours(ts: Column) -> Column:
    return F.coalesce((F.hour(ts) < 8) | (F.hour(ts) >= 19), F.lit(False))


def clean_date(text: Column) -> Column:
    """Coercing parse: unparseable text becomes NULL."""
    return F.try_to_timestamp(text)
