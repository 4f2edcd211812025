"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Candidates are found by pattern and validated (checksums, calendar, number plans). A valid value is
permuted within its format by a keyed Feistel network: a card stays a card with a right check digit, a
date a date of the same digits and order, an address an address. The permutation depends on the value and
the key alone, so equal values stay linked across documents with no table of values, no shuffle and no
driver. The domain of an e-mail address, the country of an IBAN and the first digit of a card stay as
they are.

Every repetition of a group in the patterns is bounded, so neither the matcher's stack nor its time depends
on what a text repeats: a local part has at most 64 characters and a domain at most 127 labels of 63, the
limits of the mail standard, an IBAN 34 characters, a number 19 digits. What is longer is no valid value
and stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import quoted

KINDS = ("email", "iban", "ssn", "date", "ip", "phone", "card")
_LEFT, _RIGHT = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z0-9-]{1,63}(?![A-Za-z0-9-])"
#: Countries by the length of their IBAN.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_form(length: int) -> str:
    fours, rest = divmod(length - 4, 4)
    return f"(?:{IBAN_LENGTHS[length].replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: The country's length, so that a word after it stays out; other codes and lengths in one word only.
IBAN = rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(map(_iban_form, IBAN_LENGTHS))})|[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{8,31}}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
DATE = r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/)(?:19|20)[0-9]{2}"
IP = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
NANP = r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[ .-][0-9]{4}"
SPACED_CARD = r"[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3}(?![./-]?[0-9]))?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
CARD = rf"[0-9]{{13,19}}|{SPACED_CARD}"
#: Country codes by the number of digits after them, where all or nearly all numbers have it.
PLANS = {8: "45|47|65|852", 9: "27|31|33|34|41|48|61|351|420", 10: "7|30|44|52|90|91"}
#: After a space no group of a phone number begins another value.
_CARD_NEXT = r"(?:[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}(?:-[0-9]{4}){3})(?![ -][0-9]{4}(?![0-9]))|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}"
_GAP = rf"(?: (?!(?:{DATE}|{SSN}|{IP}|{_CARD_NEXT}){_RIGHT})|[.-])?"
_NEXT = rf"{_GAP}\(?[0-9]{{2,4}}\)?"
ABROAD = (
    "|".join(rf"\+(?:{codes})(?=[ .(-]|[0-9]{{{n}}}{_RIGHT})(?:{_GAP}\(?[0-9]\)?){{{n}}}" for n, codes in PLANS.items())
    + rf"|\+[2-9][0-9]{{0,2}}(?:{_NEXT}){{2}}(?:(?! (?:{NANP}){_RIGHT}){_NEXT}){{0,3}}"
)
ANY = (
    f"{EMAIL}|{_LEFT}(?:{IBAN}){_RIGHT}|{_LEFT}(?<!-)(?:{SSN})(?!-){_RIGHT}|{_LEFT}(?<![./-])(?:{DATE})(?![./-][0-9]){_RIGHT}"
    f"|{_LEFT}(?<!\\.)(?:{IP})(?!\\.[0-9]){_RIGHT}|{_LEFT}(?:{NANP}|{ABROAD}){_RIGHT}|{_LEFT}(?:{CARD}){_RIGHT}"
)
ROUNDS = 8
#: First day and number of days of the calendar that dates are permuted in: 1900 to 2099.
FIRST_DAY, DAYS = "1900-01-01", (319, 229)


def _noise(key: str, kind: str, i: Column, half: Column) -> Column:
    """52 keyed pseudo-random bits of a round and the other half."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half.cast("string"))
    return F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(13)), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """struct<x, y>: the keyed permutation of [0, left_size) x [0, right_size).

    A round adds noise of one half to the other, modulo its size, and swaps them; an even number of
    rounds leaves each where it was.
    """
    start = F.struct(left.cast("long").alias("x"), right.cast("long").alias("y"))
    return F.aggregate(
        F.array(*[F.lit(i) for i in range(ROUNDS)]),
        start,
        lambda s, i: F.struct(
            s["y"].alias("x"),
            F.pmod(s["x"] + _noise(key, kind, i, s["y"]), F.when(i % 2 == 0, left_size).otherwise(right_size).cast("long")).alias("y"),
        ),
    )


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """Digits of the same length, at most 34 of them; an empty string stays."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    size = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("long")
    left, right = F.substr(digits, F.lit(1), a), F.substr(digits, a + 1, n - a)
    number = lambda s: F.concat(F.lit("0"), s).cast("long")
    out = feistel(number(left), number(right), size(a), size(n - a), key, kind)
    return F.concat(F.lpad(out["x"].cast("string"), a, F.lit("0")), F.lpad(out["y"].cast("string"), n - a, F.lit("0")))


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def refilled(form: Column, digits: Column) -> Column:
    """form with its digits replaced in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(
        characters(form),
        start,
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike("[0-9]"), F.substr(digits, s["k"], F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + c.rlike("[0-9]").cast("int")).alias("k"),
        ),
        lambda s: s["out"],
    )


def luhn_sum(digits: Column) -> Column:
    """Sum of digits in which every second from the right, the last but one first, counts double."""
    n = F.length(digits)
    terms = F.transform(
        characters(digits),
        lambda c, i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.pmod(2 * c.cast("int"), F.lit(10)) + (c.cast("int") > 4).cast("int")).otherwise(c.cast("int")),
    )
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b)


def _card(m: Column, key: str) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permuted_digits(F.substr(digits, F.lit(2), n - 2), key, "card"))
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    valid = (F.pmod(luhn_sum(digits), F.lit(10)) == 0) & ~digits.rlike("^0+$")
    return F.when(valid, refilled(m, F.concat(body, check.cast("string"))))


def _mod97(text: Column) -> Column:
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(characters(text), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.left(plain, F.lit(2)), F.substr(plain, F.lit(5))
    new = refilled(body, permuted_digits(F.regexp_replace(body, "[^0-9]", ""), key, "iban"))
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), F.lit(2), F.lit("0"))
    whole = F.concat(check, new)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    spaced = F.aggregate(  # the spaces stay where they were
        characters(F.substr(m, F.lit(3))),
        start,
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c == " ", c).otherwise(F.substr(whole, s["k"], F.lit(1)))).alias("out"), (s["k"] + (c != " ").cast("int")).alias("k")
        ),
        lambda s: s["out"],
    )
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(body, F.left(plain, F.lit(4)))) == 1)
    return F.when(valid, F.concat(country, spaced))


def _ssn(m: Column, key: str) -> Column:
    part = lambda i, n: F.substr(m, F.lit(i), F.lit(n)).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    at = area - 1 - (area > 666).cast("int")  # 001-665 and 667-899
    out = feistel(at * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")
    a = F.floor(out["x"] / 99)
    digits = F.concat(
        F.lpad((a + 1 + (a >= 665).cast("int")).cast("string"), F.lit(3), F.lit("0")),
        F.lpad((F.pmod(out["x"], F.lit(99)) + 1).cast("string"), F.lit(2), F.lit("0")),
        F.lpad((out["y"] + 1).cast("string"), F.lit(4), F.lit("0")),
    )
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    return F.when(valid, refilled(m, digits))


#: Steps in which a date's permutation is walked until a date of the same form comes: a form holds a
#: fifth of all days at least, so a walk is longer once in 10**26 values.
WALK = 256


def _date(m: Column, key: str) -> Column:
    """Years first, else days first where that is a date, else months first. The form stays: one digit
    where one stood, and a date that can only be read months first stays one."""
    number = lambda i: F.regexp_extract(m, "([0-9]+)[^0-9]+([0-9]+)[^0-9]+([0-9]+)", i)
    iso = m.rlike("^[0-9]{4}-")
    as_date = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    days_first, months_first = as_date(number(3), number(2), number(1)), as_date(number(3), number(1), number(2))
    day = F.when(iso, as_date(number(1), number(2), number(3))).otherwise(F.coalesce(days_first, months_first))
    first = iso | days_first.isNotNull()
    long_day = iso | (F.length(F.when(first, number(1)).otherwise(number(2))) == 2)
    long_month = iso | (F.length(F.when(first, number(2)).otherwise(number(1))) == 2)
    a, b = DAYS
    at = lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), n.cast("int"))

    def step(s: Column) -> Column:
        out = feistel(F.floor(s["n"] / b), F.pmod(s["n"], F.lit(b)), F.lit(a), F.lit(b), key, "date")
        n = (out["x"] * b + out["y"]).cast("int")
        d, mo = F.day(at(n)), F.month(at(n))
        fits = (s["long_day"] | (d < 10)) & (s["long_month"] | (mo < 10)) & (s["first"] | (d > 12))
        return F.struct(n.alias("n"), fits.alias("done"), s["first"].alias("first"), s["long_day"].alias("long_day"), s["long_month"].alias("long_month"))

    start = F.struct(
        F.datediff(day, F.lit(FIRST_DAY).cast("date")).alias("n"), F.lit(False).alias("done"), first.alias("first"), long_day.alias("long_day"), long_month.alias("long_month")
    )
    end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda s, _: F.when(s["done"], s).otherwise(step(s)))
    separator = F.regexp_extract(m, "[^0-9]", 0)

    def write(s: Column) -> Column:
        d, mo, y = (f(at(s["n"])).cast("string") for f in (F.day, F.month, F.year))
        padded = lambda c, i: F.lpad(c, F.length(number(i)), F.lit("0"))
        parts = F.when(s["first"], F.concat(padded(d, 1), separator, padded(mo, 2))).otherwise(F.concat(padded(mo, 1), separator, padded(d, 2)))
        return F.when(iso, F.date_format(at(s["n"]), "yyyy-MM-dd")).otherwise(F.concat(parts, separator, y))

    written = F.transform(F.array(end), write)
    return F.when(day.isNotNull(), written[0])


def _ip(m: Column, key: str) -> Column:
    """Each octet keeps its number of digits; one with a leading zero isn't valid."""
    octets = F.split(m, r"\.")
    size = lambda i: F.when(F.length(octets[i]) == 1, 10).when(F.length(octets[i]) == 2, 90).otherwise(156)
    least = lambda i: F.when(F.length(octets[i]) == 1, 0).when(F.length(octets[i]) == 2, 10).otherwise(100)
    at = lambda i: octets[i].cast("int") - least(i)
    out = feistel(at(0) * size(1) + at(1), at(2) * size(3) + at(3), size(0) * size(1), size(2) * size(3), key, "ip")
    text = lambda v, i: F.concat_ws(
        ".", (F.floor(v / size(i + 1)) + least(i)).cast("string"), (F.pmod(v, size(i + 1)) + least(i + 1)).cast("string")
    )
    new = F.transform(F.array(out), lambda o: F.concat_ws(".", text(o["x"], 0), text(o["y"], 2)))[0]
    return F.when(~F.exists(octets, lambda x: (x.cast("int") > 255) | x.rlike("^0[0-9]")), new)


def _phone(m: Column, key: str) -> Column:
    """A number of the North American plan keeps its code 1 and the plan's first digits in range; one from
    abroad keeps the digits up to its first separator."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    national, code = F.right(digits, F.lit(10)), F.substr(digits, F.lit(1), F.length(digits) - 10)
    part = lambda i, n: F.substr(national, F.lit(i), F.lit(n)).cast("int")
    out = feistel((part(1, 1) - 2) * 100 + part(2, 2), (part(4, 1) - 2) * 1_000_000 + part(5, 6), F.lit(800), F.lit(8_000_000), key, "phone")
    home = F.concat(code, (out["x"] + 200).cast("string"), (out["y"] + 2_000_000).cast("string"))
    prefix = F.regexp_extract(m, r"^\+([0-9]{1,3})", 1)
    rest = F.substr(digits, F.length(prefix) + 1)
    abroad = F.concat(prefix, permuted_digits(rest, key, "phone"))
    is_home = m.rlike(f"^(?:{NANP})$")
    return F.when(is_home, refilled(m, home)).when(F.length(digits).between(8, 15), refilled(m, abroad))


def _email(m: Column, key: str) -> Column:
    """The local part's letters and digits shift by noise of the other half: one keyed digest a round
    has four hex digits for each of its characters, 32 at most. The domain stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    n = F.length(local)
    a = F.floor(n / 2).cast("int")

    def shifted(half: Column, other: Column, i: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), F.lower(domain), F.lower(other)), 512)

        def one(c: Column, at: Column, noise: Column) -> Column:
            by = F.conv(F.substr(noise, 4 * at + 1, F.lit(4)), 16, 10).cast("int")
            turn = lambda first, size: F.char(F.pmod(F.ascii(c) - first + by, F.lit(size)) + first)
            return F.when(c.rlike("[a-z]"), turn(97, 26)).when(c.rlike("[A-Z]"), turn(65, 26)).when(c.rlike("[0-9]"), turn(48, 10)).otherwise(c)

        # The array holds the digest, so it is made once and not for each character.
        return F.transform(F.array(digest), lambda noise: F.array_join(F.transform(characters(half), lambda c, at: one(c, at, noise)), ""))[0]

    start = F.struct(F.substr(local, F.lit(1), a).alias("x"), F.substr(local, a + 1, n - a).alias("y"))
    out = F.aggregate(
        F.array(*[F.lit(i) for i in range(ROUNDS)]), start, lambda s, i: F.struct(s["y"].alias("x"), shifted(s["x"], s["y"], i).alias("y"))
    )
    return F.concat(out["x"], out["y"], F.lit("@"), domain)


def kind_of(m: Column) -> Column:
    """The kind whose form a match has: the first in the order of KINDS."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(F.contains(m, F.lit("@")), "email").when(whole(IBAN), "iban").when(whole(SSN), "ssn").when(whole(DATE), "date").when(whole(IP), "ip")
        .when(whole(NANP) | whole(ABROAD), "phone").otherwise("card")
    )


def shortened(m: Column) -> Column:
    """The part of a match that can be valid: of a phone number the groups up to 15 digits, and of a card of
    19 digits in groups without a right check digit the first 16."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    phone = m.startswith(F.lit("+")) & (F.length(digits) > 15)
    card = m.rlike("^[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}$") & (F.pmod(luhn_sum(digits), F.lit(10)) != 0)
    return F.when(phone, F.regexp_extract(m, rf"^\+(?:[ .()-]*[0-9]){{1,15}}\)?{_RIGHT}", 0)).when(card, F.left(m, F.lit(19))).otherwise(m)


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The value's pseudonym, or null where it isn't valid for its kind."""
    makers = {"email": _email, "iban": _iban, "ssn": _ssn, "date": _date, "ip": _ip, "phone": _phone, "card": _card}
    out = F.lit(None).cast("string")
    for name in reversed(KINDS):
        out = F.when(kind == name, makers[name](m, key)).otherwise(out)
    return out


def running_sums(numbers: Column, chunk: int = 256) -> Column:
    """Before each of the numbers, the sum of those before it. Within chunks, then over them, so that
    appending to an array doesn't cost the square of its length."""
    sums = lambda x, first: F.aggregate(x, F.array(first), lambda s, n: F.array_append(s, F.element_at(s, -1) + n))
    parts = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(numbers) / chunk).cast("int") - 1)), lambda i: F.slice(numbers, i * chunk + 1, F.lit(chunk))
    )
    totals = F.transform(parts, lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n))
    within = F.zip_with(parts, F.slice(sums(totals, F.lit(0)), F.lit(1), F.size(parts)), lambda x, first: F.slice(sums(x, first), F.lit(1), F.size(x)))
    return F.flatten(within)


def pseudonymised(df: DataFrame, key: str, text_col: str = "text", found_col: str = "_found") -> DataFrame:
    """df with the text's valid personal values replaced, and found_col: array<struct<kind, start, end>>.

    Offsets are code points of the text before. A null text stays null and has found nothing; a text
    without valid values stays as it is, to the byte; other columns, repeated rows and empty tables
    pass through. Where df has a column named found_col, the new one's name gets underscores until
    it is its own.
    """
    while found_col.lower() in {c.lower() for c in df.columns}:
        found_col += "_"
    rows = df.select(F.struct(*quoted(df)).alias("_df"), F.col(text_col).alias("_text"))
    text = F.col("_text")
    none = F.array().cast("array<struct<gap:string,value:string,kind:string,new:string,rest:string>>")
    pieces, values = F.split(text, ANY), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    hits = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(values)), values, lambda gap, m: F.struct(gap.alias("gap"), shortened(m).alias("value"), m.alias("all"), kind_of(m).alias("kind"))
    )
    hits = F.transform(
        hits,
        lambda h: F.struct(
            h["gap"].alias("gap"), h["value"].alias("value"), h["kind"].alias("kind"), pseudonym(h["value"], h["kind"], key).alias("new"),
            F.substr(h["all"], F.length(h["value"]) + 1).alias("rest"),
        ),
    )
    some = text.rlike(ANY)
    out = rows.withColumn("_hits", F.when(some, hits).otherwise(none)).withColumn("_tail", F.when(some, F.element_at(pieces, -1)))
    lengths = F.transform("_hits", lambda h: F.length(h["gap"]) + F.length(h["value"]) + F.length(h["rest"]))
    spans = F.zip_with(
        "_hits",
        running_sums(lengths),
        lambda h, at: F.when(
            h["new"].isNotNull(),
            F.struct(h["kind"].alias("kind"), (at + F.length(h["gap"])).alias("start"), (at + F.length(h["gap"]) + F.length(h["value"])).alias("end")),
        ),
    )
    found = F.filter(spans, lambda x: x.isNotNull())
    new = F.concat(F.array_join(F.transform("_hits", lambda h: F.concat(h["gap"], F.coalesce(h["new"], h["value"]), h["rest"])), ""), "_tail")
    out = out.select("_df", F.when(F.size("_hits") > 0, new).otherwise(text).alias("_new"), found.alias("_spans"))
    return out.select(*[(F.col("_new") if c == text_col else F.col("_df").getField(c)).alias(c) for c in df.columns], F.col("_spans").alias(found_col))


def pseudonym_report(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of df: doc_id, text with pseudonyms, spans (kind:start:end), a count for each kind."""
    out = pseudonymised(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), key)
    kinds = F.transform("_found", lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    spans = F.array_join(F.transform("_found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", "text", spans.alias("spans"), *counts)
