"""Identity resolution: alias table, address lookup, name matching."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tieline.functions import vocabulary as V
from tieline.session import cut_lineage


PEOPLE_A_TASK = 10_000


def _list_map(mapping: dict[str, list[str]]):
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))]
    return F.create_map(*pairs)


def _formal_to_nick() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for nick, formals in V.NICKNAMES.items():
        for f in formals:
            if f != nick:
                out.setdefault(f, []).append(nick)
    return out


def alias_table(people: DataFrame, domain: str, manual: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Address → canonical name from a people directory.

    ``people``: ord, name, given_name, family_name, email, folder_name, additional_name.
    Generated per person: the address itself, the folder, given/family in both orders with
    three separators, initials, doubled letters, nicknames in both directions and the bare
    surname, again for a go-by name.  A later row overwrites an earlier one, except that the
    bare surname stays with its first claimant.  ``manual`` (alias, name) pairs apply last,
    for names that occur in the directory.
    """
    # A person gives some thirty rows: dealt out first, so that a task's share does not grow with the directory.
    people = people.repartition(people.count() // PEOPLE_A_TASK + 1, "ord")
    empty = F.array().cast("array<string>")
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    base = people.select(
        "ord",
        "name",
        low("email").alias("email"),
        low("folder_name").alias("folder"),
        low("family_name").alias("family"),
        low("given_name").alias("given"),
        F.rtrim(F.regexp_replace(low("additional_name"), r"\.+$", "")).alias("goby"),
    )
    names = F.array(F.col("given"), F.when(F.length("goby") > 1, F.col("goby")))
    named = (
        base.select("ord", "name", "family", F.explode(names).alias("g"))
        .where("g is not null and g <> '' and family <> ''")
    )
    g, fam, ini = F.col("g"), F.col("family"), F.substring("g", 1, 1)
    seps = F.array(F.lit("."), F.lit("_"), F.lit(""))
    joined = lambda a: F.transform(seps, lambda s: F.concat(a, s, fam))
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(g)),
        lambda i: F.concat(F.substr(g, F.lit(1), i), F.substr(g, i, F.lit(1)), F.substr(g, i + 1), F.lit("."), fam),
    )
    formals = F.coalesce(F.try_element_at(_list_map(V.NICKNAMES), g), empty)
    nicks = F.coalesce(F.try_element_at(_list_map(_formal_to_nick()), g), empty)
    also = F.flatten(F.transform(F.concat(formals, nicks), joined))
    locals_ = F.concat(
        joined(g),
        F.transform(seps, lambda s: F.concat(fam, s, g)),
        F.array(F.concat(ini, fam), F.concat(fam, ini), F.concat(ini, F.lit("."), fam), F.concat(ini, F.lit("_"), fam)),
        doubled,
        also,
    )
    at = F.lit(f"@{domain}")
    writes = (
        base.select("ord", "name", F.col("email").alias("alias"), F.lit(1).alias("strong"))
        .unionByName(
            base.where("folder <> ''").select("ord", "name", F.concat("folder", at).alias("alias"), F.lit(1).alias("strong"))
        )
        .unionByName(
            named.select("ord", "name", F.explode(locals_).alias("alias"), F.lit(1).alias("strong")).withColumn(
                "alias", F.concat("alias", at)
            )
        )
        .unionByName(named.select("ord", "name", F.concat(fam, at).alias("alias"), F.lit(0).alias("strong")))
    )
    order = F.struct("strong", F.when(F.col("strong") == 1, F.col("ord")).otherwise(-F.col("ord")))
    table = writes.groupBy("alias").agg(F.max_by("name", order).alias("name"))
    for alias, name in manual:
        known = people.where(F.col("name") == name).select(F.lit(alias).alias("alias"), "name").limit(1)
        table = table.join(known.select("alias"), "alias", "left_anti").unionByName(known)
    return table


def resolve(addresses: DataFrame, aliases: DataFrame, domain: str) -> DataFrame:
    """(address) → (address, name); unresolved addresses are absent.

    Exact match first.  Inside ``domain`` one separator kind at a time (``.``, ``_``, ``-``)
    is then replaced by ``.``; the first hit wins.  One equi-join serves all candidates.
    """
    a = F.lower(F.trim("address"))
    local = F.split_part(a, F.lit("@"), F.lit(1))
    inside = a.endswith(f"@{domain}")
    fixed = [F.when(inside, F.concat(F.replace(local, F.lit(s), F.lit(".")), F.lit(f"@{domain}"))) for s in "._-"]
    tries = addresses.select("address").distinct().select("address", F.posexplode(F.array(a, *fixed)).alias("_step", "alias"))
    return (
        tries.where("alias is not null")
        .join(aliases, "alias")
        .groupBy("address")
        .agg(F.min_by("name", "_step").alias("name"))
    )


def resolve_list(df: DataFrame, key: str, addresses: str, aliases: DataFrame, domain: str, out: str) -> DataFrame:
    """(key, out): names of an address list in order, misses dropped, duplicates kept."""
    rows = df.select(key, F.posexplode(addresses).alias("_pos", "address"))
    names = resolve(rows, aliases, domain)
    got = (
        rows.join(names, "address")
        .groupBy(key)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "name"))), lambda s: s["name"]).alias(out))
    )
    return df.select(key).join(got, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def goby_names(people: DataFrame, known: DataFrame) -> DataFrame:
    """Formal and go-by spellings → canonical name, for names present in ``known`` (name)."""
    goby = F.regexp_replace(F.trim(F.coalesce(F.col("additional_name"), F.lit(""))), r"\.+$", "")
    spell = F.array(
        F.when(goby != "", F.concat_ws(" ", goby, "family_name")), F.concat_ws(" ", "given_name", "family_name")
    )
    return (
        people.join(known.select("name").distinct(), "name", "left_semi")
        .select("name", F.explode(F.array_compact(spell)).alias("spelling"))
        .distinct()
    )


def _bigrams(df: DataFrame) -> DataFrame:
    """(name, gram): padded letter pairs of the lower-cased name, repeats numbered."""
    padded = F.concat(F.lit("\u0002"), F.lower("name"), F.lit("\u0003"))
    grams = F.transform(F.sequence(F.lit(1), F.length("name") + 1), lambda i: F.substr(padded, i, F.lit(2)))
    numbered = F.transform(
        grams, lambda x, i: F.concat(x, F.size(F.filter(F.slice(grams, F.lit(1), i), lambda y: y == x)).cast("string"))
    )
    return df.select("name").distinct().select("name", F.explode(numbered).alias("gram"))


#: Names longer than this are met by letter pairs alone: their spellings with two letters less are too many.
SHORT_NAME = 40


def _less_letters(names: DataFrame, threshold: float) -> DataFrame:
    """(name, size, gone, key): digests of the lower-cased name with none, one or two letters left out."""
    low, size = F.col("low"), F.length("low")
    without = lambda p, q: F.concat(F.substring(low, F.lit(1), p - 1), F.substring(low, p + 1, q - p - 1), F.substring(low, q + 1, size))
    entry = lambda gone, text: F.struct(F.lit(gone).alias("gone"), F.xxhash64(text).alias("key"))
    one = F.transform(F.sequence(F.lit(1), size), lambda p: entry(1, without(p, p)))
    two = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda p: F.transform(F.sequence(p + 1, size), lambda q: entry(2, without(p, q)))))
    none = F.array(entry(0, low))
    every = F.when(size > 1, F.concat(none, one, two)).when(size == 1, F.concat(none, one)).otherwise(none)
    short = names.select("name", F.lower("name").alias("low")).distinct().where(size <= SHORT_NAME)
    short = short.repartition(short.count() // PEOPLE_A_TASK + 1, "name")  # a small table becomes a few hundred rows a name
    kept = short.select("name", size.alias("size"), F.inline(F.array_distinct(every)))
    return kept.where(F.col("gone") <= (2 * F.col("size") - F.col("gone")) * (1 - threshold) + 1e-9)


def near_spellings(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(name, match): all pairs of short names that may reach ``threshold`` and are equal once at most two letters of each,
    three in all, are left out.  They meet in an equi-join."""
    mine = _less_letters(left, threshold)
    theirs = _less_letters(right, threshold).select(F.col("name").alias("match"), F.col("size").alias("_size"), F.col("gone").alias("_gone"), "key")
    edits, letters = F.col("gone") + F.col("_gone"), F.col("size") + F.col("_size")
    # The estimated size is that of the names, far less than that of their spellings: never sent whole to a task.
    met = mine.join(theirs.hint("merge"), "key").where((edits <= 3) & (edits <= letters * (1 - threshold) + 1e-9))
    return met.select("name", "match").distinct()


def _best_ratio(pairs: DataFrame, threshold: float) -> DataFrame:
    """(name, match, ratio): the best of the compared pairs (name, match) per name, ties to the larger match."""

    def ratios(batches):
        from difflib import SequenceMatcher

        for pdf in batches:
            r = [SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in zip(pdf["name"], pdf["match"])]
            yield pd.DataFrame({"name": pdf["name"], "match": pdf["match"], "ratio": r})

    scored = pairs.mapInPandas(ratios, "name string, match string, ratio double")
    return (
        scored.where(F.col("ratio") >= threshold)
        .groupBy("name")
        .agg(F.max(F.struct("ratio", "match")).alias("b"))
        .select("name", F.col("b.match").alias("match"), F.col("b.ratio").alias("ratio"))
    )


def fuzzy_names(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(name) → best (name, match, ratio) with a matching-block ratio of at least ``threshold``.

    Near spellings are compared first.  Any other pair of lengths ``a`` and ``b`` has a least number ``d`` of insertions and
    deletions, so a ratio of at most ``1 - d / (a + b)``: a name whose best is above that for every length that occurs is
    settled, its ties included.  The rest goes on by letter pairs.
    """
    close = cut_lineage(_best_ratio(near_spellings(left, right, threshold), threshold))
    size = F.length(F.lower("name"))
    apart = F.abs(F.col("_a") - F.col("_b"))
    unseen = F.when((F.col("_b") > SHORT_NAME) | (apart > 2), apart).when(apart == 1, 5).otherwise(4)
    lengths = left.select(size.alias("_a")).distinct().where(F.col("_a") <= SHORT_NAME).crossJoin(right.select(size.alias("_b")).distinct())
    others = lengths.groupBy("_a").agg(F.max(1 - unseen / F.greatest(F.col("_a") + F.col("_b"), F.lit(1))).alias("_most"))
    settled = close.join(others, size == F.col("_a")).where(F.col("ratio") > F.col("_most") + 1e-9).select("name", "match", "ratio")
    rest = left.select("name").join(settled.select("name"), "name", "left_anti")
    return settled.unionByName(_best_ratio(_share_letter_pairs(rest, right, threshold), threshold))


def _share_letter_pairs(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(name, match): every pair that may reach ``threshold``.

    A ratio ``t`` bounds the insertions and deletions between two names, and each of those
    destroys at most two padded letter pairs.  So a match keeps at least ``k`` pairs, and it is
    enough to look a name up by its rarest ``n - k + 1`` pairs.  The filter is exact; the ratio
    of the surviving candidates is computed in Arrow batches.
    """
    slack = 1.0 - threshold
    shortest, longest = threshold / (2 - threshold), (2 - threshold) / threshold
    loss = max(1.5 * slack * (1 + b) + 0.5 * (1 - b) for b in (shortest, longest))
    theirs = _bigrams(right).withColumnRenamed("name", "match")
    freq = theirs.groupBy("gram").agg(F.count("*").alias("_freq"))
    mine = _bigrams(left).join(freq, "gram", "left")
    rarest = Window.partitionBy("name").orderBy(F.coalesce("_freq", F.lit(0)), "gram")
    need = F.greatest(F.lit(1), F.ceil(F.length("name") * (1 - loss) + 1 - 1e-9))
    probe = mine.withColumn("_rn", F.row_number().over(rarest)).where(F.col("_rn") <= F.length("name") + 1 - need + 1)
    return (
        probe.select("name", "gram")
        .join(theirs, "gram")
        .where(F.least(F.length("name"), F.length("match")) >= F.greatest(F.length("name"), F.length("match")) * shortest - 1e-9)
        .select("name", "match")
        .distinct()
    )
