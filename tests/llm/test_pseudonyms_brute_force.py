"""Pseudonyms against the same rules in plain Python, and texts that break matchers."""

import calendar
import datetime
import hashlib
import random
import re

import pytest

from lodestone.llm import pii

KEY = "k"


def noise(kind, i, half):
    return int(hashlib.sha256(f"{KEY}|{kind}|{i}|{half}".encode()).hexdigest()[:13], 16)


def feistel(x, y, left, right, kind):
    for i in range(pii.ROUNDS):
        x, y = y, (x + noise(kind, i, y)) % (left if i % 2 == 0 else right)
    return x, y


def permuted(digits, kind):
    a = len(digits) // 2
    b = len(digits) - a
    x, y = feistel(int("0" + digits[:a]), int("0" + digits[a:]), 10**a, 10**b, kind)
    return (str(x).zfill(a) if a else "") + (str(y).zfill(b) if b else "")


def refilled(form, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), form)


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d % 10 + (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def card(m):
    digits = re.sub("[^0-9]", "", m)
    if luhn(digits) % 10 or not digits.strip("0"):
        return None
    body = digits[0] + permuted(digits[1:-1], "card")
    return refilled(m, body + str(-luhn(body + "0") % 10))


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def iban(m):
    plain = m.replace(" ", "")
    if not 15 <= len(plain) <= 34 or mod97(plain[4:] + plain[:4]) != 1:
        return None
    new = refilled(plain[4:], permuted(re.sub("[^0-9]", "", plain[4:]), "iban"))
    whole = iter(str(98 - mod97(new + plain[:2] + "00")).zfill(2) + new)
    return plain[:2] + "".join(c if c == " " else next(whole) for c in m[2:])


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    x, y = feistel((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn")
    a = x // 99
    return f"{a + 1 + (a >= 665):03d}-{x % 99 + 1:02d}-{y + 1:04d}"


def day_of(y, m, d):
    return datetime.date(y, m, d) if 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1] else None


def date(m):
    begin = datetime.date(1900, 1, 1)
    p = re.split("[^0-9]", m)
    iso = len(p[0]) == 4
    first = True
    if iso:
        day = day_of(*map(int, p))
    else:
        day = day_of(int(p[2]), int(p[1]), int(p[0]))
        if day is None:
            first, day = False, day_of(int(p[2]), int(p[0]), int(p[1]))
    if day is None:
        return None
    at, (a, b) = (day - begin).days, pii.DAYS
    ld, lm = (2, 2) if iso else (len(p[0]), len(p[1])) if first else (len(p[1]), len(p[0]))
    while True:
        x, y = feistel(at // b, at % b, a, b, "date")
        at = x * b + y
        new = begin + datetime.timedelta(at)
        if (ld == 2 or new.day < 10) and (lm == 2 or new.month < 10) and (first or new.day > 12):
            break
    if iso:
        return new.isoformat()
    d, mo, sep = str(new.day).zfill(ld), str(new.month).zfill(lm), re.search("[^0-9]", m)[0]
    return sep.join([*((d, mo) if first else (mo, d)), str(new.year)])


def ip(m):
    octets = m.split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    size, least = {1: 10, 2: 90, 3: 156}, {1: 0, 2: 10, 3: 100}
    s, at = [size[len(o)] for o in octets], [int(o) - least[len(o)] for o in octets]
    x, y = feistel(at[0] * s[1] + at[1], at[2] * s[3] + at[3], s[0] * s[1], s[2] * s[3], "ip")
    new = [x // s[1], x % s[1], y // s[3], y % s[3]]
    return ".".join(str(v + least[len(o)]) for v, o in zip(new, octets))


def phone(m):
    digits = re.sub("[^0-9]", "", m)
    if re.fullmatch(pii.NANP, m):
        n = digits[-10:]
        x, y = feistel((int(n[0]) - 2) * 100 + int(n[1:3]), (int(n[3]) - 2) * 10**6 + int(n[4:]), 800, 8_000_000, "phone")
        return refilled(m, digits[:-10] + str(x + 200) + str(y + 2_000_000))
    if not 8 <= len(digits) <= 15:
        return None
    prefix = (re.match(r"\+([0-9]{1,3})", m) or [None, ""])[1]
    return refilled(m, prefix + permuted(digits[len(prefix) :], "phone"))


def email(m):
    local, domain = m.split("@")
    x, y = local[: len(local) // 2], local[len(local) // 2 :]
    for i in range(pii.ROUNDS):
        h = hashlib.sha512(f"{KEY}|email|{i}|{domain.lower()}|{y.lower()}".encode()).hexdigest()
        turned = ""
        for at, c in enumerate(x):
            for first, size in ((97, 26), (65, 26), (48, 10)):
                if first <= ord(c) < first + size:
                    c = chr((ord(c) - first + int(h[4 * at : 4 * at + 4], 16)) % size + first)
                    break
            turned += c
        x, y = y, turned
    return f"{x}{y}@{domain}"


FORMS = (("iban", pii.IBAN), ("ssn", pii.SSN), ("date", pii.DATE), ("ip", pii.IP), ("phone", f"{pii.NANP}|{pii.ABROAD}"))


def brute(text):
    out, spans, last = [], [], 0
    for m in re.finditer(pii.ANY, text or ""):
        value = m[0]
        kind = "email" if "@" in value else next((k for k, p in FORMS if re.fullmatch(p, value)), "card")
        digits = re.sub("[^0-9]", "", value)
        if value[0] == "+" and len(digits) > 15:
            value = (re.match(rf"\+(?:[ .()-]*[0-9]){{1,15}}\)?{pii._RIGHT}", value) or [""])[0]
        elif re.fullmatch("[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}", value) and luhn(digits) % 10:
            value = value[:19]
        new = globals()[kind](value)
        if new is not None:
            spans.append(f"{kind}:{m.start()}:{m.start() + len(value)}")
        out += [text[last : m.start()], value if new is None else new]
        last = m.start() + len(value)
    return text and "".join(out) + text[last:], ",".join(spans)


def generated(rng):
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    body = d(15)
    check = d(18)
    return rng.choice(
        [
            body + str(-luhn(body + "0") % 10), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{rng.randint(1, 999):03d}-{d(2)}-{d(4)}", "DE" + str(98 - mod97(check + "DE00")).zfill(2) + check,
            f"{rng.randint(1, 31)}/{rng.randint(1, 31)}/{rng.randint(1900, 2099)}", f"{rng.randint(1, 31):02d}.{rng.randint(1, 12):02d}.20{d(2)}", f"19{d(2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 31):02d}",
            ".".join(str(rng.randint(0, 280)) for _ in range(4)), f"({rng.randint(2, 9)}{d(2)}) {rng.randint(2, 9)}{d(2)}-{d(4)}", f"+44 20 {d(4)} {d(4)}", f"+1-{rng.randint(2, 9)}{d(2)}-{rng.randint(2, 9)}{d(2)}-{d(4)}",
            f"{rng.choice('abcXYZ')}{d(2)}.{rng.choice('klm')}_x@{rng.choice(['mail', 'Sub-1'])}.example.org", f"+49{d(rng.randint(5, 14))}", d(rng.randint(3, 20)), f"{d(4)}-{d(6)}-{d(5)}",
        ]
    )


HARD = [
    "a@b" + ".c" * 3000, "x" * 1_000_000 + "@b.com", "bob.smith@mail.example.com, 10.0.0.1; " * 20_000, "9" * 300_000, "+44 " + "20 " * 100_000, "GB82" + " AAAA" * 50_000,
    ("y" * 64 + "@example.com ") * 50, "z" * 65 + "@example.com", "a@" + "b" * 64 + ".com", "1." * 100_000, "@" * 1000, "3/4/2024 03/04/2024 2/29/2024 02/29/2024 29.2.2024 31.12.2099 1/1/1900",
    "01.2.3.4 1.2.3.4 255.255.255.255 0.0.0.0",
]


def test_every_value_as_in_plain_python(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice([generated(rng), "word", "2024", "é𝄞", "it."]) for _ in range(rng.randint(1, 12))) for _ in range(800)] + HARD + [None, ""]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    texts += [r["text"] for r in docs.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    found = set()
    for r in pii.pseudonym_report(df, KEY).collect():
        want = brute(texts[r.doc_id])
        assert (r.text, r.spans) == want, texts[r.doc_id][:200] if texts[r.doc_id] else None
        found |= {s.split(":")[0] for s in r.spans.split(",") if s}
    assert found == set(pii.KINDS)


@pytest.mark.parametrize("form", ["{d}/{m}/{y}", "{d:02d}/{m}/{y}", "{m:02d}/{d}/{y}", "{y}-{m:02d}-{d:02d}"])
def test_dates_are_permuted_within_their_form(spark, form):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(i) for i in range(0, 73_049, 37)]
    texts = sorted({form.format(d=x.day, m=x.month, y=x.year) for x in days})
    texts = [t for t in texts if form[1] != "m" or day_of(int(t.split("/")[2]), int(t.split("/")[1]), int(t.split("/")[0])) is None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    new = [r.text for r in pii.pseudonym_report(df, KEY).collect()]
    shape = lambda t: re.sub("[0-9]", "9", t)
    assert len(set(new)) == len(texts) and {shape(t) for t in new} <= {shape(t) for t in texts}


def test_callers_columns_stay(spark):
    df = spark.createDataFrame([(1, "10.0.0.1", "h", "t", "f", "d", "x")], "doc_id long, text string, _hits string, _tail string, _found string, _df string, _text string")
    row = pii.pseudonymised(df, KEY).first()
    assert row[0] == 1 and row[1] == brute("10.0.0.1")[0] and row[2:7] == ("h", "t", "f", "d", "x")
    assert [tuple(s) for s in row["_found_"]] == [("ip", 0, 8)]
