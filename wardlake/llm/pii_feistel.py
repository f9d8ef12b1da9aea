"""Format-preserving Feistel pseudonyms for personal data.

One regex finds candidate values; a value is replaced only when it validates
(Luhn sum, IBAN check digits, octet range, calendar date, assigned ranges).  The
replacement is a keyed permutation of the kind's own format -- a Feistel network
over the value's digits, letters or ranges -- so it validates again, equal values
stay equal in all documents (however they are punctuated), different values stay
different, and the key reverses it (``restore``).

card   first digit kept, check digit recomputed     phone  country code kept; leading 2-9 stay 2-9
iban   country kept, check digits recomputed        ssn    within the assignable ranges
ip     four octets                                  date   a day of 1900-2099, same notation
email  letters and digits of the local part; the domain is kept

DataFrame / SQL functions only, nothing is shuffled.  Defined results: null text
stays null, empty text empty; invalid values are left as they are; repeated rows
are rewritten alike; a null id gets its own row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

ROUNDS = 8
KINDS = ("email", "iban", "ip", "phone", "ssn", "date", "card")
#: Patterns by kind; possessive runs keep the search linear.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?!\w)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\w-])",
    "card": r"(?<!\w)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?!\w)",
}
ANY = "|".join([PATTERNS[k] for k in KINDS])
#: What is put into a candidate that does not validate while its inside is searched
#: (with a private-use character; texts that hold the pair are searched once), and
#: the token it is put behind.
MARK = "_\ue000"
FIRST_TOKEN = r"^\W*\w+"
#: Most tokens of a candidate (an IBAN in groups has up to 9).
MAX_TOKENS = 10
#: First day and the parts of the number of days: 487 * 150 days from 1900-01-01 to 2100-01-01.
FIRST_DAY, DAY_PARTS = "1900-01-01", (487, 150)


# ---- the permutation -------------------------------------------------------------

def feistel(values: Column, moduli: Column, secret: str, reverse: bool = False) -> Column:
    """Permute an array of integers, element i staying in [0, moduli[i]).

    Halves are swapped each round; the new half is the old one plus a keyed digest
    of the other, element by element.  ROUNDS is even, so the order is kept."""
    half = F.floor(F.size(values) / 2).cast("int")

    def halves(x):
        return F.slice(x, F.lit(1), half), F.slice(x, half + 1, F.size(x))

    def digest(round_, side, i):
        text = F.concat(F.lit(secret + "|"), round_.cast("string"), F.lit("|"), F.array_join(
            F.transform(side, lambda v: v.cast("string")), ","), F.lit("|"), i.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")

    def shift(x, mod, round_, side, sign):
        return F.transform(F.arrays_zip(x.alias("v"), mod.alias("m")), lambda e, i: F.pmod(
            e["v"] + sign * digest(round_, side, i), e["m"]))

    a, b = halves(values)
    ma, mb = halves(moduli)
    zero = F.struct(a.alias("a"), b.alias("b"), ma.alias("ma"), mb.alias("mb"))

    def forward(s, r):
        return F.struct(s["b"].alias("a"), shift(s["a"], s["ma"], r, s["b"], 1).alias("b"),
                        s["mb"].alias("ma"), s["ma"].alias("mb"))

    def backward(s, r):
        return F.struct(shift(s["b"], s["mb"], r, s["a"], -1).alias("a"), s["a"].alias("b"),
                        s["mb"].alias("ma"), s["ma"].alias("mb"))

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if reverse else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, zero, backward if reverse else forward, lambda s: F.concat(s["a"], s["b"]))


def _chars(s: Column) -> Column:
    """Characters of an ASCII string (an empty one has none)."""
    return F.filter(F.split(s, ""), lambda c: c != "")


def _digit(c: Column) -> Column:
    return (F.ascii(c) - 48).cast("bigint")


def _permuted_chars(s: Column, secret: str, reverse: bool) -> Column:
    """Characters of ``s`` with digits and letters permuted within their class;
    letters alike in both cases, other characters stay."""
    chars = _chars(s)
    is_digit, is_letter = (lambda c: c.rlike("[0-9]")), (lambda c: c.rlike("[A-Za-z]"))
    one = F.lit(1).cast("bigint")
    values = F.transform(chars, lambda c: F.when(is_digit(c), _digit(c)).when(
        is_letter(c), (F.ascii(F.upper(c)) - 65).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    moduli = F.transform(chars, lambda c: F.when(is_digit(c), 10 * one).when(is_letter(c), 26 * one).otherwise(one))
    return F.zip_with(chars, feistel(values, moduli, secret, reverse), lambda c, v: F.when(
        is_digit(c), F.chr(v + 48)).when(c.rlike("[A-Z]"), F.chr(v + 65)).when(
        c.rlike("[a-z]"), F.chr(v + 97)).otherwise(c))


def _filled(mask: Column, new: Column, keep: str) -> Column:
    """The mask with its characters outside the class ``keep`` replaced, in order."""
    chars = _chars(mask)
    at = lambda i: F.length(F.regexp_replace(F.substring(mask, F.lit(1), i + 1), keep, ""))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(keep), c).otherwise(F.get(new, at(i) - 1))), "")


# ---- kinds: (is valid, replacement) ----------------------------------------------

def _luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum of an array of digits; from the right, every second is doubled."""
    odd = 0 if doubled_first else 1
    return F.aggregate(F.transform(F.reverse(digits), lambda d, i: F.when(
        i % 2 == odd, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)),
        F.lit(0).cast("bigint"), lambda s, d: s + d)


def _digits(m: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(m, "[^0-9]", "")), _digit)


def _card(m: Column, secret: str, reverse: bool) -> tuple[Column, Column]:
    d = _digits(m)
    body = F.slice(d, F.lit(2), F.size(d) - 2)
    new = F.concat(F.slice(d, 1, 1), feistel(body, F.transform(body, lambda _: F.lit(10).cast("bigint")),
                                             secret + "|card", reverse))
    check = F.pmod(10 - _luhn_sum(new, True) % 10, F.lit(10))
    text = F.transform(F.concat(new, F.array(check)), lambda v: v.cast("string"))
    return _luhn_sum(d, False) % 10 == 0, _filled(m, text, "[^0-9]")


def _mod97(s: Column) -> Column:
    """Remainder of an IBAN-style string (letters count 10 to 35) by 97."""
    return F.aggregate(_chars(s), F.lit(0).cast("bigint"), lambda r, c: F.when(
        c.rlike("[0-9]"), (r * 10 + _digit(c)) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, secret: str, reverse: bool) -> tuple[Column, Column]:
    s = F.regexp_replace(m, " ", "")
    country, body = F.substring(s, 1, 2), F.substring(s, 5, 30)
    new = F.array_join(_permuted_chars(body, secret + "|iban", reverse), "")
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return _mod97(F.concat(body, F.substring(s, 1, 4))) == 1, _filled(m, _chars(F.concat(country, check, new)), " ")


def _ip(m: Column, secret: str, reverse: bool) -> tuple[Column, Column]:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("bigint"))
    new = feistel(octets, F.transform(octets, lambda _: F.lit(256).cast("bigint")), secret + "|ip", reverse)
    return F.forall(octets, lambda x: x < 256), F.array_join(F.transform(new, lambda v: v.cast("string")), ".")


def _phone(m: Column, secret: str, reverse: bool) -> tuple[Column, Column]:
    d = _digits(m)
    own = F.slice(d, -10, 10)
    # the first digit of area and exchange stays within 2-9 (or within 0-1)
    lead = lambda v, i: ((i == 0) | (i == 3))
    off = lambda v, i: F.when(lead(v, i) & (v >= 2), F.lit(2)).otherwise(F.lit(0)).cast("bigint")
    moduli = F.transform(own, lambda v, i: F.when(lead(v, i), F.when(v >= 2, F.lit(8)).otherwise(F.lit(2)))
                         .otherwise(F.lit(10)).cast("bigint"))
    values = F.transform(own, lambda v, i: v - off(v, i))
    new = F.zip_with(feistel(values, moduli, secret + "|phone", reverse), F.transform(own, off), lambda v, o: v + o)
    every = F.concat(F.slice(d, F.lit(1), F.size(d) - 10), new)
    return F.size(d) >= 10, _filled(m, F.transform(every, lambda v: v.cast("string")), "[^0-9]")


def _ssn(m: Column, secret: str, reverse: bool) -> tuple[Column, Column]:
    p = F.transform(F.split(m, "-"), lambda x: x.cast("bigint"))
    area, group, serial = F.get(p, 0), F.get(p, 1), F.get(p, 2)
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    long = lambda x: F.lit(x).cast("bigint")
    values = F.array(area - 1 - (area > 666).cast("bigint"), group - 1, serial - 1)
    new = feistel(values, F.array(long(898), long(99), long(9999)), secret + "|ssn", reverse)
    first = F.get(new, 0) + 1
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return valid, F.concat_ws("-", pad(first + (first >= 666).cast("bigint"), 3), pad(F.get(new, 1) + 1, 2),
                              pad(F.get(new, 2) + 1, 4))


def _date(m: Column, secret: str, reverse: bool) -> tuple[Column, Column]:
    iso = F.when(m.rlike("-"), m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    n = F.datediff(iso.try_cast("date"), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    a, b = DAY_PARTS
    parts = feistel(F.array(F.floor(n / b).cast("bigint"), n % b),
                    F.array(F.lit(a).cast("bigint"), F.lit(b).cast("bigint")), secret + "|date", reverse)
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.get(parts, 0) * b + F.get(parts, 1)).cast("int"))
    return n.isNotNull() & (n >= 0) & (n < a * b), F.when(m.rlike("-"), F.date_format(day, "yyyy-MM-dd")).otherwise(
        F.date_format(day, "MM/dd/yyyy"))


def _email(m: Column, secret: str, reverse: bool) -> tuple[Column, Column]:
    local = F.regexp_extract(m, "^([^@]*)@", 1)
    new = F.array_join(_permuted_chars(local, secret + "|email", reverse), "")
    return F.lit(True), F.concat(new, F.substring(m, F.length(local) + 1, F.length(m)))


_RULES: dict[str, Callable[[Column, str, bool], tuple[Column, Column]]] = {
    "email": _email, "iban": _iban, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card}


def kind_of(m: Column) -> Column:
    """Kind of a matched value, null when it does not validate."""
    out = F.lit(None).cast("string")
    for kind in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.when(_RULES[kind](m, "", False)[0], F.lit(kind))).otherwise(out)
    return out


def _replacement(m: Column, kind: Column, secret: str, reverse: bool) -> Column:
    out = m
    for k in KINDS:
        out = F.when(kind == k, _RULES[k](m, secret, reverse)[1]).otherwise(out)
    return out


def values(text: Column) -> Column:
    """array<struct<kind, val>> of all candidates in order; kind null: not valid."""
    return F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(
        kind_of(m).alias("kind"), m.alias("val")))


def rewritten(text: Column, found: Column, secret: str, reverse: bool = False) -> Column:
    """The text with its valid values replaced; ``found`` are its ``values``."""
    return F.array_join(F.zip_with(F.split(text, ANY, -1), found, lambda gap, v: F.concat(
        gap, F.when(v.isNull(), F.lit("")).otherwise(_replacement(v["val"], v["kind"], secret, reverse)))), "")


def opened(text: Column) -> Column:
    """The text with MARK behind the first token of every candidate that does not
    validate, again and again until all do: a valid value that such a candidate
    covers, or overlaps, is then a candidate of its own.  The mark ends in no word
    character and begins with one, so the token itself is no candidate any more."""
    def round_(acc, _):
        t = acc["t"]
        found = values(t)
        broken = F.array_join(F.zip_with(F.split(t, ANY, -1), found, lambda gap, v: F.concat(
            gap, F.when(v.isNull(), F.lit("")).when(v["kind"].isNull(), F.regexp_replace(
                v["val"], FIRST_TOKEN, "$0" + MARK)).otherwise(v["val"]))), "")
        more = acc["more"] & F.exists(found, lambda v: v["kind"].isNull())
        return F.when(more, F.struct(broken.alias("t"), F.lit(True).alias("more"))).otherwise(
            F.struct(t.alias("t"), F.lit(False).alias("more")))

    start = F.struct(text.alias("t"), F.lit(True).alias("more"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_TOKENS)), start, round_, lambda acc: acc["t"])


def pseudonymise(docs: DataFrame, secret: str, reverse: bool = False) -> DataFrame:
    """The rows of ``docs`` as a struct ``doc``, with the rewritten text and found,
    the array of (kind, val) of its candidates."""
    text = F.col("text")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    step = docs.select(doc, text.cast("string").alias("text"))
    step = step.withColumn("found", F.when(text.rlike(ANY), values(text)).otherwise(
        F.array().cast("array<struct<kind:string,val:string>>")))
    # only texts with a candidate that does not validate are looked at again
    again = F.exists("found", lambda v: v["kind"].isNull()) & ~F.contains(text, F.lit(MARK))
    step = step.select("doc", "text", "found", F.when(again, opened(text)).alias("opened"))
    step = step.select("doc", F.coalesce("opened", "text").alias("text"), F.col("opened").isNotNull().alias("again"), F.when(
        F.col("opened").isNotNull(), values(F.col("opened"))).otherwise(F.col("found")).alias("found"))
    some = F.exists("found", lambda v: v["kind"].isNotNull())
    new = F.when(some, rewritten(text, F.col("found"), secret, reverse)).otherwise(text)
    return step.select("doc", F.when(F.col("again"), F.replace(new, F.lit(MARK), F.lit(""))).otherwise(new).alias("text"), "found")


def replaced(docs: DataFrame, secret: str, reverse: bool = False) -> DataFrame:
    """``docs`` with its text rewritten, and n_chars where there is such a column."""
    out = pseudonymise(docs, secret, reverse)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("text") != F.col("doc.text"), F.length("text").cast(
        docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return out.select([new[c].alias(c) if c in new else F.col(f"doc.`{c}`") for c in docs.columns])


def restore(docs: DataFrame, secret: str) -> DataFrame:
    """The inverse of ``replaced`` with the same secret."""
    return replaced(docs, secret, reverse=True)


def op4_pseudonymise(spark: SparkSession, sf_dir: str, secret: str = "pseudonyms of the registered query") -> DataFrame:
    out = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), secret)

    def count(kind):
        return F.size(F.filter("found", lambda v: v["kind"] == kind)).cast("bigint")

    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc.doc_id", "text", *counts)
