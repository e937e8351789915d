"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

One regular expression finds candidates; checksums, ranges and calendars validate them; a keyed Feistel
network permutes each value within its own format. It is a permutation, so equal values get equal
pseudonyms in all documents and different values different ones, and a card number stays a card number
that passes its check, a date a date, an address an address. Whoever has the key can undo it.

================  =====================================================  ===================================
kind              validated by                                           permuted
================  =====================================================  ===================================
card              issuer's digits, 13 to 19 digits, Luhn check           all but the first four; new check
iban              country, its length, remainder 1 modulo 97             letters and digits; new check
ssn               area, group and serial in their ranges                 within those ranges
phone             country code or area code, 8 to 15 digits              all digits but the country code
ip                four octets, not a version number                      the 32 bits of the address
date              calendar, 1900 to 2099                                 the day, among all days written alike
email             syntax                                                 letters and digits, not the top domain
secret            access keys, values of password or token fields        letters and digits, case by case
================  =====================================================  ===================================

Numbers are split in two halves that are changed in turn: a = (a + F(round, b)) mod A, then b likewise,
with F from SHA-256 over key, kind, round and the other half. Strings do the same for each position: a
letter moves among letters of its case, a digit among digits. A date whose way of writing does not suit
every day (without zeros, day before month with slashes) walks on until it meets a day that suits it. No
rounds are needed for texts without candidates, and the candidates' text is found with one scan.

The key is the caller's; the registered query takes it from ``KEY_CONF`` and makes one for the session where
that is unset.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.common import table

KEY_CONF = "spark.stratalog.pii.key"
ROUNDS = 8
#: Calling codes as assigned; digits that card numbers of the networks begin with.
CALLING = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[0578]|96|99)[0-9]|97[0-79])"
ISSUER = r"(?:4|5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720|3[4-9]|30[0-5]|60|62|64[4-9]|65|50(?:18|20|38)|5893|6304|6759|676[1-3])"
#: The length of an IBAN of each country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "ip": rf"(?<![0-9.vV])(?<!(?i:version|release|build|firmware) )(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "date": r"(?<![A-Za-z0-9/.-])(?:(?:19|20)[0-9]{2}(?:-[0-9]{2}-|/[0-9]{2}/)[0-9]{2}|(?:[0-9]{2}/[0-9]{2}/|[0-9]{2}\.[0-9]{2}\.|[0-9]{2}-[0-9]{2}-|[1-9]/[1-9][0-9]?/|[1-9][0-9]/[1-9]/"
    r"|[1-9]\.[1-9][0-9]?\.|[1-9][0-9]\.[1-9]\.|[1-9]-[1-9][0-9]?-|[1-9][0-9]-[1-9]-)(?:19|20)[0-9]{2})(?![A-SU-Za-z0-9/-]|T(?![0-9]))",
    "card": r"(?<![A-Za-z0-9.-])(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5}|[0-9]{13,19})(?![A-Za-z0-9-])",
    "phone": r"(?<![A-Za-z0-9+.-])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}"
    rf"|\+(?=(?:[0-9][ .-]?){{8,15}}(?![0-9])){CALLING}(?:[ .-]?\(?[0-9]{{1,8}}\)?){{1,5}})(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])(?:" + "|".join(rf"(?:{cs.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, cs in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<=(?i:password|passwd|secret|token|api_key)[ ]{0,2}[=:][ ]{0,2}[\"']{0,1})[A-Za-z0-9+/_-]{8,}",
}
ANY = "|".join(PATTERNS.values())
#: A text without any of these holds no candidate.
MAY_HOLD = r"[0-9@]|(?i:password|passwd|secret|token|api_key)"
#: Days from 1900-01-01 to 2099-12-31 are 17 * 4297.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 17, 4297


def _mixed(tag: str, turn: Column, other: Column, key: str) -> Column:
    """60 bits of a keyed hash as a long."""
    said = F.concat_ws("|", F.lit(f"{key}/{tag}"), turn.cast("string"), other.cast("string"))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, size_a: Column, b: Column, size_b: Column, tag: str, key: str, undo: bool = False) -> Column:
    """struct(a, b) permuted among 0 <= a < size_a, 0 <= b < size_b; ``undo`` is the inverse."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if undo else 1

    def turn(s: Column, r: Column) -> Column:
        # both lines look at one half and move the other
        new_a = F.pmod(s["a"] + sign * F.pmod(_mixed(tag, r, s["b"], key), size_a), size_a)
        new_b = F.pmod(s["b"] + sign * F.pmod(_mixed(tag, r, s["a"], key), size_b), size_b)
        even = r % 2 == 0
        return F.struct(F.when(even, new_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(new_b).alias("b"))

    return F.aggregate(turns, start, turn)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _padded(value: Column, digits: Column) -> Column:
    return F.substring_index(F.concat(F.lit("|"), F.concat(F.repeat(F.lit("0"), digits), value.cast("string"))), "|", -1).substr(
        F.length(value.cast("string")) + 1, digits
    )


def permuted_digits(digits: Column, tag: str, key: str, undo: bool = False) -> Column:
    """A string of 2 to 18 digits permuted among those of its length."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    a, b = digits.substr(F.lit(1), left).cast("long"), digits.substr(left + 1, right).cast("long")
    done = feistel(a, _power(left), b, _power(right), tag, key, undo)
    return _once(done, lambda s: F.concat(_padded(s["a"], left), _padded(s["b"], right)))


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def permuted_text(text: Column, tag: str, key: str, undo: bool = False) -> Column:
    """A string permuted position by position: letters among letters of their case, digits among digits.

    Positions of one half move by a key stream that hangs on the other half; all else stays in place.
    """
    half = F.floor((F.length(text) + 1) / 2).cast("int")
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if undo else 1
    start = F.struct(text.substr(F.lit(1), half).alias("a"), text.substr(half + 1, F.length(text)).alias("b"))

    def moved(own: Column, other: Column, r: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            stream = F.sha2(F.concat_ws("|", F.lit(f"{key}/{tag}"), r.cast("string"), F.floor(i / 16).cast("string"), other), 256)
            by = sign * F.conv(stream.substr((i % 16 * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")
            code = F.ascii(c)
            shift = lambda base, size: F.char((F.pmod(code - base + by, F.lit(size)) + base).cast("long"))
            return (
                F.when(c.rlike("^[0-9]$"), shift(48, 10))
                .when(c.rlike("^[a-z]$"), shift(97, 26))
                .when(c.rlike("^[A-Z]$"), shift(65, 26))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.filter(F.split(own, ""), lambda c: c != ""), one), "")

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, moved(s["a"], s["b"], r)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(moved(s["b"], s["a"], r)).alias("b"),
        )

    return F.aggregate(turns, start, turn, lambda s: F.concat(s["a"], s["b"]))


def hex_text(text: Column, tag: str, key: str, undo: bool = False) -> Column:
    """A lower- or upper-case hexadecimal string permuted among such strings."""
    half = F.floor((F.length(text) + 1) / 2).cast("int")
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if undo else 1
    small = F.lower(text)
    start = F.struct(small.substr(F.lit(1), half).alias("a"), small.substr(half + 1, F.length(text)).alias("b"))

    def moved(own: Column, other: Column, r: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            stream = F.sha2(F.concat_ws("|", F.lit(f"{key}/{tag}"), r.cast("string"), F.floor(i / 64).cast("string"), other), 256)
            by = F.instr(F.lit("0123456789abcdef"), stream.substr((i % 64 + 1).cast("int"), F.lit(1)))
            at = F.pmod(F.conv(c, 16, 10).cast("int") + sign * by, F.lit(16))
            return F.substring(F.lit("0123456789abcdef"), at + 1, F.lit(1))

        return F.array_join(F.transform(F.filter(F.split(own, ""), lambda c: c != ""), one), "")

    def turn(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, moved(s["a"], s["b"], r)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(moved(s["b"], s["a"], r)).alias("b"),
        )

    done = F.aggregate(turns, start, turn, lambda s: F.concat(s["a"], s["b"]))
    return F.when(text == small, done).otherwise(F.upper(done))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last digit not doubled."""

    def add(total: Column, c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return total + F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(c.cast("int"))

    backwards = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(backwards, F.lit(0), lambda t, x: add(t, x["c"], x["i"]).cast("int"))


def _refilled(form: Column, letters: str, fill: Column) -> Column:
    """``form`` with its characters of the class ``letters`` replaced, in order, by those of ``fill``."""
    chars = F.filter(F.split(form, ""), lambda c: c != "")
    at = lambda i: F.length(F.regexp_replace(form.substr(F.lit(1), i + 1), f"[^{letters}]", ""))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(f"^[{letters}]$"), fill.substr(at(i), F.lit(1))).otherwise(c)), "")


def card(value: Column, key: str, undo: bool = False) -> Column:
    digits = _digits(value)
    inner = permuted_digits(digits.substr(F.lit(5), F.length(digits) - 5), "card", key, undo)
    body = F.concat(digits.substr(F.lit(1), F.lit(4)), inner)
    check = F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    return _once(F.concat(body, check), lambda new: _refilled(value, "0-9", new))


def is_card(value: Column) -> Column:
    digits = _digits(value)
    return F.length(digits).between(13, 19) & digits.rlike(f"^{ISSUER}") & (_luhn_sum(digits) % 10 == 0)


def _iban_remainder(compact: Column) -> Column:
    turned = F.concat(compact.substr(F.lit(5), F.length(compact)), compact.substr(F.lit(1), F.lit(4)))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")

    def add(rest: Column, c: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), (rest * 10 + c.try_cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97).cast("int")

    return F.aggregate(chars, F.lit(0), add)


def is_iban(value: Column) -> Column:
    compact = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(compact).between(15, 34) & (_iban_remainder(compact) == 1)


def iban(value: Column, key: str, undo: bool = False) -> Column:
    compact = F.replace(value, F.lit(" "), F.lit(""))
    country = compact.substr(F.lit(1), F.lit(2))
    body = permuted_text(compact.substr(F.lit(5), F.length(compact)), "iban", key, undo)
    return _once(
        F.struct(country.alias("c"), body.alias("b")),
        lambda s: _refilled(
            value,
            "0-9A-Z",
            F.concat(s["c"], F.lpad((98 - _iban_remainder(F.concat(s["c"], F.lit("00"), s["b"]))).cast("string"), 2, "0"), s["b"]),
        ),
    )


def is_ssn(value: Column) -> Column:
    return value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def ssn(value: Column, key: str, undo: bool = False) -> Column:
    area, group, serial = (value.substr(F.lit(p), F.lit(n)).try_cast("int") for p, n in ((1, 3), (5, 2), (8, 4)))
    rank = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1  # areas 1 to 899 without 666
    done = feistel(rank, F.lit(898 * 99), serial - 1, F.lit(9999), "ssn", key, undo)

    def written(s: Column) -> Column:
        index = F.floor(s["a"] / 99)
        number = index + 1 + F.when(index >= 665, 1).otherwise(0)
        pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
        return F.concat_ws("-", pad(number, 3), pad(s["a"] % 99 + 1, 2), pad(s["b"] + 1, 4))

    return _once(done, written)


def phone(value: Column, key: str, undo: bool = False) -> Column:
    digits = _digits(value)
    code = F.length(F.regexp_extract(digits, f"^{CALLING}", 0))
    kept = F.when(value.startswith("+"), code).when((F.length(digits) == 11) & digits.startswith("1"), 1).otherwise(0)
    country, rest = digits.substr(F.lit(1), kept), digits.substr(kept + 1, F.length(digits))
    return _once(F.concat(country, permuted_digits(rest, "phone", key, undo)), lambda new: _refilled(value, "0-9", new))


def ip(value: Column, key: str, undo: bool = False) -> Column:
    octet = lambda i: F.get(F.split(value, r"\."), F.lit(i)).cast("long")
    done = feistel(octet(0) * 256 + octet(1), F.lit(65536), octet(2) * 256 + octet(3), F.lit(65536), "ip", key, undo)
    return _once(
        done, lambda s: F.concat_ws(".", *[x.cast("int").cast("string") for h in ("a", "b") for x in (F.floor(s[h] / 256), s[h] % 256)])
    )


def _date_parts(value: Column) -> tuple[Column, Column, Column]:
    return tuple(F.get(F.split(value, "[-/.]"), F.lit(i)) for i in range(3))


def _day_first(value: Column) -> Column:
    """With dots and dashes the day comes before the month, with slashes only if the first number is above 12."""
    first = _date_parts(value)[0]
    return value.rlike("^[0-9]{1,2}[.-]") | (value.rlike("^[0-9]{1,2}/") & (first.try_cast("int") > 12))


def _day(value: Column) -> Column:
    """The date, or null if the calendar has no such day."""
    x, y, z = _date_parts(value)
    dash = lambda y, m, d: F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    return F.when(value.rlike("^[0-9]{4}"), dash(x, y, z)).when(_day_first(value), dash(z, y, x)).otherwise(dash(z, x, y))


#: Steps after which a date has met one that is written alike; it is missed by chance less than once in 10^16 dates.
WALK = 64


def date(value: Column, key: str, undo: bool = False) -> Column:
    sep = F.regexp_extract(value, "[-/.]", 0)
    bare = value.rlike("^[1-9][-/.]|[-/.][1-9][-/.]")  # without zeros before one digit
    late = (sep == "/") & _day_first(value)  # the day is told from the month by its size
    base = F.lit(FIRST_DAY).cast("date")
    start = F.datediff(_day(value), base)
    at = lambda s: F.date_add(base, (s["a"] * DAYS_B + s["b"]).cast("int"))

    def suits(s: Column) -> Column:
        d, m = F.dayofmonth(at(s)), F.month(at(s))
        return (~bare | (d < 10) | (m < 10)) & (~late | (d > 12))

    def step(s: Column, i: Column) -> Column:
        return F.when((i > 0) & suits(s), s).otherwise(feistel(s["a"], F.lit(DAYS_A), s["b"], F.lit(DAYS_B), "date", key, undo))

    first = F.struct(F.floor(start / DAYS_B).cast("long").alias("a"), (start % DAYS_B).cast("long").alias("b"))
    plain = feistel(first["a"], F.lit(DAYS_A), first["b"], F.lit(DAYS_B), "date", key, undo)
    walked = F.aggregate(F.sequence(F.lit(0), F.lit(WALK)), first, step)

    def written(s: Column) -> Column:
        y, m, d = (F.date_format(at(s), f) for f in ("yyyy", "MM", "dd"))
        m, d = (F.when(bare, F.regexp_replace(x, "^0", "")).otherwise(x) for x in (m, d))
        return (
            F.when(value.rlike("^[0-9]{4}"), F.concat(y, sep, m, sep, d))
            .when(_day_first(value), F.concat(d, sep, m, sep, y))
            .otherwise(F.concat(m, sep, d, sep, y))
        )

    return _once(F.when(bare | late, walked).otherwise(plain), written)


def email(value: Column, key: str, undo: bool = False) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    name = domain.substr(F.lit(1), F.length(domain) - F.length(top) - 1)
    return F.concat(permuted_text(local, "local", key, undo), F.lit("@"), permuted_text(name, "domain", key, undo), F.lit("."), top)


def secret(value: Column, key: str, undo: bool = False) -> Column:
    return (
        F.when(value.startswith("AKIA"), F.concat(F.lit("AKIA"), permuted_text(value.substr(F.lit(5), F.length(value)), "secret", key, undo)))
        .when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), hex_text(value, "secret", key, undo))
        .otherwise(permuted_text(value, "secret", key, undo))
    )


def kind_of(value: Column) -> Column:
    """The kind of a candidate that passes its validation, else null."""
    whole = lambda k: value.rlike(f"^(?:{PATTERNS[k]})$")
    return (
        F.when(value.contains("@") & whole("email"), "email")
        .when(whole("ip"), "ip")
        .when(whole("ssn"), F.when(is_ssn(value), F.lit("ssn")))
        .when(whole("date"), F.when(_day(value).isNotNull(), F.lit("date")))
        .when(whole("card") & is_card(value), "card")
        .when(whole("phone") & ~whole("card"), "phone")
        .when(whole("iban") & is_iban(value), "iban")
        .when(value.rlike("^AKIA[0-9A-Z]{16}$"), "secret")
    )


def pseudonym(kind: Column, value: Column, key: str, undo: bool = False) -> Column:
    out = value
    for name, made in (("email", email), ("ip", ip), ("ssn", ssn), ("date", date), ("card", card), ("phone", phone), ("iban", iban), ("secret", secret)):
        out = F.when(kind == name, made(value, key, undo)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_replaced, kinds): every text with its personal values replaced.

    ``kinds`` lists the kind of each replaced value in order. A null text stays null, a text without valid
    values is returned as it is. Rows are treated one by one, repeated ones too; other columns are ignored,
    whatever their names. An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    found = F.regexp_extract_all("text", F.lit(f"({ANY})"), 1)
    none = F.array().cast("array<string>")
    some = rows.withColumn("found", F.when(F.col("text").rlike(MAY_HOLD), found).otherwise(none))
    # a value after "password=" is a secret whatever it looks like; its candidate starts a gap that ends so
    gaps = F.when(F.size("found") > 0, F.split("text", ANY, -1)).otherwise(none)
    field = r"(?i)(?:password|passwd|secret|token|api_key)[ ]{0,2}[=:][ ]{0,2}[\"']?$"
    marked = some.withColumn("gaps", gaps).withColumn(
        "kind",
        F.transform("found", lambda v, i: F.when(F.coalesce(F.get("gaps", i), F.lit("")).rlike(field), F.lit("secret")).otherwise(kind_of(v))),
    )
    replaced = F.transform("found", lambda v, i: F.coalesce(pseudonym(F.get("kind", i), v, key), v))
    filled = marked.withColumn("new", F.when(F.size("found") > 0, replaced).otherwise(none))
    joined = F.array_join(F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(F.get("new", i), F.lit("")))), "")
    kinds = F.filter("kind", lambda k: k.isNotNull())
    return filled.select(
        "doc_id",
        F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias("text"),
        F.coalesce(F.size(kinds), F.lit(0)).cast("long").alias("n_replaced"),
        F.coalesce(kinds, none).alias("kinds"),
    )


def session_key(spark: SparkSession) -> str:
    """The key in ``KEY_CONF``; a random one is put there if it is unset."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_CONF, key)
    return key


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), session_key(spark))
