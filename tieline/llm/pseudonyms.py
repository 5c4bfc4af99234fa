"""Operator 2: format-preserving Feistel pseudonyms, with DataFrame functions only.

A value is replaced by a keyed permutation of the values of its format (kind, separators, numbers of digits), so equal values
get equal pseudonyms in every document, different values of a format stay different, and whoever holds the key can invert them.  The key is a parameter; keep
it out of code and logs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tieline.llm.common import with_whole_row

ROUNDS = 8
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9](?:[A-Za-z0-9\-]*+)(?:\.[A-Za-z0-9\-]++)+"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./\-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9]|[./\-][0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![0-9A-Za-z])"
ADDRESS6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){2,5})(?![0-9A-Za-z:])"
TOKEN = r"(?<![0-9A-Za-z_])(?:(?:AKIA|ASIA)[A-Z2-7]{16}|gh[opsu]_[0-9A-Za-z]{36})(?![0-9A-Za-z_])"
SOCIAL = r"(?<![0-9A-Za-z.\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.\-][0-9])"
#: Groupings that are phone numbers without a leading + or bracket.
NATIONAL = r"(?<![0-9A-Za-z.\-])(?:[2-9][0-9]{2}[ .\-][0-9]{3}[ .\-][0-9]{4}|0[1-9](?:[ .\-][0-9]{2}){4})(?![0-9A-Za-z]|[ .\-][0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .\-]?\(?|(?<![0-9A-Za-z])\()[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])"
ANY = "|".join([EMAIL, SECRET, TOKEN, IBAN, DATE, ADDRESS, ADDRESS6, SOCIAL, CARD, PHONE, NATIONAL])
#: Days of the 400 years that the calendar repeats after: 189 x 773, so that a Feistel network over the two factors is exact.
_FIRST_DAY, _DAY_FACTORS = "1800-01-01", (189, 773)
#: Steps of a cycle walk: a walk that is still outside its format then has odds below 1 in 10^20.
_WALK = 256


def _let(value: Column, body) -> Column:
    """``body`` over a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _digest(key: str, kind: str, round_no: Column, other: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}\x1f{kind}\x1f"), round_no.cast("string"), F.lit("\x1f"), other), 256)


def _number(digest: Column, at: Column | int, width: int = 4) -> Column:
    at = at if isinstance(at, Column) else F.lit(at)
    return F.conv(F.substring(digest, at, F.lit(width)), 16, 10).cast("bigint")


def _turn(c: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """``c`` moved ``by`` places round the alphabet that has it; other characters stay."""
    out = c
    for letters in alphabets:
        place = F.call_function("instr", F.lit(letters), c)
        out = F.when(place > 0, F.substring(F.lit(letters), ((place - 1 + by) % len(letters) + 1).cast("int"), F.lit(1))).otherwise(out)
    return out


def permute_text(value: Column, key: str, kind: str, alphabets: tuple[str, ...]) -> Column:
    """Balanced Feistel over the two halves of a string; every character stays within its alphabet.

    The round function digests key, kind, length, round and the other half; its digits turn this half's characters.
    """
    cut = (F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))

    def turned(half: Column, digest: Column) -> Column:
        shifted = F.transform(_chars(half), lambda c, i: _turn(c, _number(digest, (i % 16) * 4 + 1) + F.floor(i / 16), alphabets))
        return F.concat_ws("", shifted)

    def step(s: Column, n: Column) -> Column:
        mixed = _let(_digest(key, kind, n, F.concat(F.length(s["l"]).cast("string"), F.lit(":"), s["r"])), lambda d: turned(s["l"], d))
        return F.struct(s["r"].alias("l"), mixed.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["l"], s["r"]))


def permute_number(value: Column, key: str, kind: str, low: int, high: int) -> Column:
    """Feistel over ``value = high part * low + low part`` by modular addition: a permutation of 0 .. low * high - 1."""
    start = F.struct(F.floor(value / low).cast("bigint").alias("l"), (value % low).cast("bigint").alias("r"))

    def step(s: Column, n: Column) -> Column:
        size = F.when(n % 2 == 1, F.lit(high)).otherwise(F.lit(low))
        return F.struct(s["r"].alias("l"), ((s["l"] + _number(_digest(key, kind, n, s["r"].cast("string")), 1, 12)) % size).cast("bigint").alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * low + s["r"])


def _luhn(digits: Column, doubled: int) -> Column:
    """Sum of digits from the right; every second one, from place ``doubled`` on, counts twice with its digits added."""
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _pour(template: Column, signs: Column, kind: str = "[0-9]") -> Column:
    """The template with its characters of the kind (digits) replaced in order."""
    place = lambda i: F.length(F.regexp_replace(F.substring(template, F.lit(1), i + 1), f"[^{kind[1:-1]}]", ""))
    return F.concat_ws("", F.transform(_chars(template), lambda c, i: F.when(c.rlike(kind), F.substring(signs, place(i), F.lit(1))).otherwise(c)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


DECIMAL, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _email(m: Column, key: str) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(permute_text(name, key, "name", (DECIMAL, LOWER, UPPER)), F.substring(m, F.length(name) + 1, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    upper = m.rlike("[A-F]") & ~m.rlike("[a-f]")
    turned = permute_text(F.lower(m), key, "secret", ("0123456789abcdef",))
    return F.when(upper, F.upper(turned)).otherwise(turned)


def _card(m: Column, key: str) -> Column:
    body = lambda d: F.substring(d, F.lit(1), F.length(d) - 1)
    swapped = _let(permute_text(body(_digits(m)), key, "card", (DECIMAL,)), lambda b: F.concat(b, ((10 - _luhn(b, 0) % 10) % 10).cast("string")))
    return F.when(_luhn(_digits(m), 1) % 10 == 0, _pour(m, swapped)).otherwise(m)


def _address(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, x: a * 256 + x)
    swapped = _let(permute_number(number, key, "address", 65536, 65536), lambda n: F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(F.forall(parts, lambda x: x <= 255), swapped).otherwise(m)


def _address6(m: Column, key: str) -> Column:
    groups = F.filter(F.split(F.lower(m), ":"), lambda x: x != "")
    upper = m.rlike("[A-F]") & ~m.rlike("[a-f]")
    turned = _let(permute_text(F.concat_ws("", groups), key, "address6", ("0123456789abcdef",)), lambda d: _pour(F.lower(m), d, "[0-9a-f]"))
    valid = (F.size(groups) == 8) | (m.contains("::") & F.size(groups).between(3, 7) & m.rlike("[0-9]"))
    return F.when(valid, F.when(upper, F.upper(turned)).otherwise(turned)).otherwise(m)


def _mod97(text: Column) -> Column:
    """Remainder of the number that an IBAN's characters spell, letters as 10 to 35."""
    value = lambda c: (F.call_function("instr", F.lit(DECIMAL + UPPER), c) - 1).cast("int")
    return F.aggregate(_chars(text), F.lit(0), lambda a, c: _let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))


def _iban(m: Column, key: str) -> Column:
    country, bare = F.substring(m, 1, 2), F.regexp_replace(m, " ", "")
    body = F.substring(bare, F.lit(5), F.length(bare))
    check = lambda b: F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
    swapped = _let(permute_text(body, key, "iban", (DECIMAL, UPPER)), lambda b: F.concat(country, check(b), b))
    valid = F.length(bare).between(15, 34) & (_mod97(F.concat(body, F.substring(bare, 1, 4))) == 1)
    return F.when(valid, _pour(m, swapped, "[0-9A-Z]")).otherwise(m)


def _token(m: Column, key: str) -> Column:
    tail = F.substring(m, F.lit(5), F.length(m))
    upper = permute_text(tail, key, "token", (UPPER + "234567",))
    return F.concat(F.substring(m, 1, 4), F.when(m.rlike("^A"), upper).otherwise(permute_text(tail, key, "token", (DECIMAL, LOWER, UPPER))))


def _social(m: Column, key: str) -> Column:
    """Area (not 000, 666 or from 900), group (not 00) and serial (not 0000) as one number, permuted."""
    area, group, serial = (F.substring(m, at, n).cast("bigint") for at, n in ((1, 3), (5, 2), (8, 4)))
    areas = 898
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    two = lambda n, width: F.lpad(n.cast("string"), width, "0")

    def shown(n: Column) -> Column:
        a = F.floor(n / (99 * 9999)) + 1
        return F.concat_ws("-", two(a + F.when(a > 665, 1).otherwise(0), 3), two(F.floor(n / 9999) % 99 + 1, 2), two(n % 9999 + 1, 4))

    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    return F.when(valid, _let(permute_number(number, key, "social", 9999, 99 * areas), shown)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """Year-month-day, day.month.year, and month/day/year or, where that is no date, day/month/year.

    The pseudonym has the order of the given date and its numbers of digits: the walk goes on until the new date fits them.
    """
    field = lambda i: F.regexp_extract(m, r"^([0-9]+)[-./]([0-9]+)[-./]([0-9]+)$", i)
    read = lambda y, mo, d: F.concat_ws("-", F.lpad(field(y), 4, "0"), F.lpad(field(mo), 2, "0"), F.lpad(field(d), 2, "0")).try_cast("date")
    first = F.lit(_FIRST_DAY).cast("date")
    low, high = _DAY_FACTORS
    iso, slashed = m.contains("-"), m.contains("/")
    date = F.when(iso, read(1, 2, 3)).when(slashed, F.coalesce(read(3, 1, 2), read(3, 2, 1))).otherwise(read(3, 2, 1))
    month_first = slashed & read(3, 1, 2).isNotNull()
    month_width = F.when(iso, 2).when(month_first, F.length(field(1))).otherwise(F.length(field(2)))
    day_width = F.when(iso, 2).when(month_first, F.length(field(2))).otherwise(F.length(field(1)))
    known = F.struct(F.datediff(date, first).cast("bigint").alias("day"), month_width.alias("mw"), day_width.alias("dw"), month_first.alias("mf"))

    def moved(k: Column) -> Column:
        def fits(n: Column) -> Column:
            d = F.date_add(first, n.cast("int"))
            return ((k["mw"] == 2) | (F.month(d) <= 9)) & ((k["dw"] == 2) | (F.dayofmonth(d) <= 9)) & (~slashed | k["mf"] | (F.dayofmonth(d) > 12))

        step = lambda n: permute_number(n, key, "date", low, high)
        start = F.struct(step(k["day"]).alias("n"))
        # In most formats every date fits and nothing walks.
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), start, lambda s, i: F.when(fits(s["n"]), s).otherwise(F.struct(step(s["n"]).alias("n"))))
        return F.when((k["mw"] == 2) & (k["dw"] == 2) & (~slashed | k["mf"]), start).otherwise(walk)["n"]

    def shown(k: Column) -> Column:
        def text(d: Column) -> Column:
            month, day = F.lpad(F.month(d).cast("string"), k["mw"], "0"), F.lpad(F.dayofmonth(d).cast("string"), k["dw"], "0")
            year = F.lpad(F.year(d).cast("string"), 4, "0")
            return F.when(iso, F.concat_ws("-", year, month, day)).when(k["mf"], F.concat_ws("/", month, day, year)).otherwise(_let(F.when(slashed, "/").otherwise("."), lambda sep: F.concat(day, sep, month, sep, year)))

        return F.when(k["day"].between(0, low * high - 1), _let(F.date_add(first, moved(k).cast("int")), text)).otherwise(m)

    return _let(known, shown)


def _phone(m: Column, key: str) -> Column:
    """A leading country code stays, the other digits turn; of national groupings the first digit keeps to its range."""
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .\-(])", 0)
    rest = F.substring(m, F.length(country) + 1, F.length(m))
    swapped = F.concat(country, _pour(rest, permute_text(_digits(rest), key, "phone", (DECIMAL,))))

    def national(first: int, low: int, high: int) -> Column:
        number = permute_number(_digits(m).cast("bigint") - first, key, "national", low, high)
        return _pour(m, F.lpad((number + first).cast("string"), 10, "0"))

    local = F.when(m.startswith("0"), national(100_000_000, 30_000, 30_000)).otherwise(national(2_000_000_000, 80_000, 100_000))
    swapped = F.when(m.rlike(f"^(?:{NATIONAL})$"), local).otherwise(swapped)
    return F.when(F.length(_digits(m)).between(8, 15), swapped).otherwise(m)


_KINDS = (
    ("emails", EMAIL, _email), ("secrets", SECRET, _secret), ("tokens", TOKEN, _token), ("ibans", IBAN, _iban), ("dates", DATE, _date),
    ("addresses", ADDRESS, _address), ("addresses6", ADDRESS6, _address6), ("socials", SOCIAL, _social), ("cards", CARD, _card), ("phones", f"{PHONE}|{NATIONAL}", _phone),
)


def replace_values(text: Column, key: str) -> tuple[Column, Column]:
    """Columns for the matches of ``text`` and, over a column ``matches`` that holds them, for their pseudonyms."""
    found = F.regexp_extract_all(text, F.lit(f"(?:{ANY})"), F.lit(0))

    def pseudonym(m: Column) -> Column:
        return reduce(lambda rest, kind: F.when(m.rlike(f"^(?:{kind[1]})$"), kind[2](m, key)).otherwise(rest), reversed(_KINDS), m)

    return found, F.transform("matches", pseudonym)


def _replaced(df: DataFrame, text: Column, key: str) -> DataFrame:
    found, swapped = replace_values(text, key)
    df = df.withColumn("source", text).withColumn("matches", found)
    df = df.withColumn("swapped", F.when(F.size("matches") > 0, swapped))
    between = F.split("source", f"(?:{ANY})", -1)
    joined = F.concat_ws("", F.flatten(F.zip_with(between, "swapped", lambda gap, new: F.array(gap, F.coalesce(new, F.lit(""))))))
    return df.withColumn("text", F.when(F.size("matches") > 0, joined).otherwise(F.col("source")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_values, and one count a kind): texts with validated values replaced by pseudonyms.

    Card numbers must pass their check digit and IBANs their check sum (pseudonyms do too), addresses have octets to 255 or up
    to eight groups, dates exist between 1800 and 2199, phone numbers have 8 to 15 digits and a leading +, a bracket or a
    national grouping, hexadecimal secrets 32 digits or more; e-mail addresses keep their domain.  Anything else stays byte
    for byte.  Counts are of changed values.  Null texts stay null with zero counts, texts of any length are read whole,
    repeated rows are alike, further columns go no further, an empty table gives no rows.
    """
    df = _replaced(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("given")), F.col("given"), key)
    changed = F.filter(F.arrays_zip(F.col("matches").alias("m"), F.col("swapped").alias("s")), lambda p: p["m"] != p["s"])
    df = df.withColumn("changed", F.coalesce(changed, F.array().cast("array<struct<m:string,s:string>>")))
    count = lambda like: F.size(F.filter("changed", lambda p: p["m"].rlike(f"^(?:{like})$"))).cast("bigint")
    counts = [count(pattern).alias(f"n_{name}") for name, pattern, _ in _KINDS]
    return df.select("doc_id", "text", F.size("changed").cast("bigint").alias("n_values"), *counts)


def pseudonymise_documents(docs: DataFrame, key: str) -> DataFrame:
    """The documents with :func:`pseudonymise`'s texts and ``n_chars`` to match; other columns unchanged.

    Null, empty and long texts, repeated rows and the empty table as there.
    """
    df = _replaced(with_whole_row(docs), F.col("row.text"), key)
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(row.alias("row")).select("row.*")
