"""Format-preserving pseudonyms by a keyed Feistel network, in DataFrame operations only.

Found and validated: e-mail addresses, card numbers (Luhn), IBANs (mod 97), North American phone and social-security
numbers, IPv4 addresses, calendar dates, cloud access keys and values named as token, password or secret. A value's
characters are numbers in their own radix (digit, letter, octet; day of a 400-year cycle for a date); those at even
and odd places are the two halves. In each round one half is shifted by a keyed SHA-256 of the other, each number in its
radix, so the map is a permutation of the values of that format: equal values have equal pseudonyms in all documents,
and different values different ones. Marks and spacing stay; a phone number has the same digits however it is spaced.
Check digits are computed anew, so pseudonyms are valid too. A run of numbers that doesn't
validate as a whole is searched for values made of some of them. What doesn't validate stays as it is.

The key is a secret of the caller: whoever has it can turn pseudonyms back.

Nulls: a null text stays null, with no values found; null ids play no part. Texts of any length are read whole. Equal texts
and repeated rows get equal results; an empty table gives none. Columns of any other names are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollumen.llm.common import named as column
from rollumen.llm.common import unused

ROUNDS = 8

#: The forms of each kind. Java's syntax; possessive where a run could be rescanned, and bounded where a group has to give back
#: (its matcher goes one call deeper for each turn): a domain has 127 labels at most.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}(?<=\.[A-Za-z]{2,24})"
KEYED = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
NAMES = r"(?i:token|password|passwd|secret|api_?key)"
NAMED = rf"(?<![A-Za-z]){NAMES}\s?[=:]\s?[\"']?[A-Za-z0-9_\-/+.]{{8,}}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4})(?![\w/-])"
IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w)"
#: Numbers parted by single spaces or dashes, of 13 digits or more: a card, or several values and other numbers side by side.
RUN = rf"(?<![\w.+-])(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{DATE}|{IP}|\d{{3}}\.\d{{3}}[ .-]\d{{4}})\d++(?!\w))*+(?!\w)"
ANY = "|".join((EMAIL, KEYED, NAMED, IBAN, DATE, IP, SSN, RUN, PHONE))
#: Days from 1800-01-01 over one Gregorian cycle, 146,097 = 189 * 773.
FIRST_DAY, DAY_RADIX = "1800-01-01", (189, 773)


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def bind(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ints(*values) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values])


def feistel(values: Column, radix: Column, key: str, label: Column) -> Column:
    """values, each below its radix, permuted. values and radix: arrays of int. A round has one digest of the half that stands, and a short one
    for each number of the other, so the work is in proportion to the numbers."""

    def rounds(w: Column) -> Column:
        def one_round(v: Column, r: Column) -> Column:
            other = F.concat_ws(",", F.transform(F.filter(v, lambda x, i: i % 2 != r % 2), lambda x: x.cast("string")))

            def shifted(drawn: Column) -> Column:
                def shift(x: Column, i: Column) -> Column:
                    number = F.conv(F.substring(F.sha2(F.concat_ws("|", drawn, i.cast("string")), 256), 1, 12), 16, 10).cast("long")
                    return F.when(i % 2 == r % 2, F.pmod(x + number, F.get(w["radix"], i).cast("long")).cast("int")).otherwise(x)

                return F.transform(v, shift)

            return bind(F.sha2(F.concat_ws("|", F.lit(key), label, r.cast("string"), other), 256), shifted)

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), w["values"], one_round)

    return bind(F.struct(values.alias("values"), radix.alias("radix")), rounds)


def chars(s: Column) -> Column:
    return F.filter(F.split(s, "", -1), lambda c: c != "")


def digits_of(s: Column) -> Column:
    return F.transform(chars(F.regexp_replace(s, r"\D", "")), lambda c: c.cast("int"))


def as_text(numbers: Column) -> Column:
    return F.concat_ws("", F.transform(numbers, lambda x: x.cast("string")))


def refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by those of the string."""
    gaps = F.split(form, r"\d", -1)
    return F.concat_ws("", F.zip_with(gaps, F.concat(chars(digits), F.array(F.lit(""))), lambda a, b: F.concat(a, b)))


def letters(s: Column, key: str, label: str) -> Column:
    """A string with digits, lower and upper case letters permuted among their own kind; others stay."""

    def coded(c: Column) -> Column:
        low = F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(F.ascii(c))
        wide = F.when(c.rlike("[0-9]"), 10).when(c.rlike("[a-zA-Z]"), 26).otherwise(1)
        return F.struct(low.alias("low"), wide.alias("wide"), (F.ascii(c) - low).cast("int").alias("x"))

    def put(codes: Column) -> Column:
        new = feistel(codes["x"], codes["wide"], key, F.lit(label))
        return F.concat_ws("", F.zip_with(codes, new, lambda c, x: F.char(c["low"] + x)))

    return bind(F.transform(chars(s), coded), put)


def hexes(s: Column, key: str, label: str) -> Column:
    """A string of lower-case hexadecimal digits, permuted."""
    values = F.transform(chars(s), lambda c: F.conv(c, 16, 10).cast("int"))
    new = feistel(values, F.transform(chars(s), lambda x: F.lit(16)), key, F.lit(label))
    return F.concat_ws("", F.transform(new, lambda x: F.lower(F.hex(x))))


def luhn(digits: Column) -> Column:
    """The digit that makes digits, an array without it, valid."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda x, i: F.when((n - i) % 2 == 1, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, x: a + x), F.lit(10))


def card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        n = F.size(d)
        body = F.slice(d, F.lit(2), n - 2)
        kept = F.slice(d, F.lit(1), F.lit(1))
        fresh = F.concat(kept, feistel(body, F.transform(body, lambda x: F.lit(10)), key, F.lit("card")))
        ok = luhn(F.slice(d, F.lit(1), n - 1)) == F.element_at(d, -1)
        return F.when(ok, bind(fresh, lambda f: refill(m, as_text(F.concat(f, F.array(luhn(f).cast("int")))))))

    return bind(digits_of(m), new)


def phone(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        extra, own = F.slice(d, F.lit(1), F.size(d) - 10), F.slice(d, F.size(d) - 9, F.lit(10))
        # area code and exchange start with 2 to 9; where they don't, with 0 or 1
        lead = lambda i: (i == 0) | (i == 3)
        base = F.transform(own, lambda x, i: F.when(lead(i) & (x > 1), 2).otherwise(0).cast("int"))
        radix = F.transform(own, lambda x, i: F.when(lead(i), F.when(x > 1, 8).otherwise(2)).otherwise(10).cast("int"))
        fresh = F.zip_with(feistel(F.zip_with(own, base, lambda x, b: x - b), radix, key, F.lit("phone")), base, lambda x, b: x + b)
        return refill(m, F.concat(as_text(extra), as_text(fresh)))

    return bind(digits_of(m), new)


def ssn(m: Column, key: str) -> Column:
    """The valid numbers alone are permuted: areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999, these as
    99 times 101."""
    part = lambda a, n: F.substring(m, a, n).cast("int")
    ok = ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    area, serial = part(1, 3), part(8, 4) - 1
    values = F.array(area - F.when(area > 666, 2).otherwise(1), part(5, 2) - 1, (serial / 101).cast("int"), serial % 101)

    def put(v: Column) -> Column:
        new = F.get(v, F.lit(0)) + 1
        return F.format_string("%03d-%02d-%04d", new + F.when(new > 665, 1).otherwise(0), F.get(v, F.lit(1)) + 1, F.get(v, F.lit(2)) * 101 + F.get(v, F.lit(3)) + 1)

    return F.when(ok, bind(feistel(values, ints(898, 99, 99, 101), key, F.lit("ssn")), put))


def ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    new = feistel(octets, F.transform(octets, lambda x: F.lit(256)), key, F.lit("ip"))
    ok = (F.array_max(octets) < 256) & ~m.rlike(r"(?:^|\.)0\d")
    return F.when(ok, F.concat_ws(".", F.transform(new, lambda x: x.cast("string"))))


def date(m: Column, key: str) -> Column:
    """Dates of 1800 to 2199; day/month/year is tried first, then month/day/year."""
    first = F.lit(FIRST_DAY).cast("date")

    def in_form(form: str) -> Column:
        day = F.datediff(F.to_date(F.try_to_timestamp(m, F.lit(form))), first)
        values = F.array((day / DAY_RADIX[1]).cast("int"), (day % DAY_RADIX[1]).cast("int"))
        new = feistel(values, ints(*DAY_RADIX), key, F.lit("date"))
        moved = F.date_format(F.date_add(first, F.get(new, F.lit(0)) * DAY_RADIX[1] + F.get(new, F.lit(1))), form)
        return F.when((day >= 0) & (day < DAY_RADIX[0] * DAY_RADIX[1]), moved)

    return F.when(m.contains("-"), in_form("yyyy-MM-dd")).otherwise(F.coalesce(in_form("dd/MM/yyyy"), in_form("MM/dd/yyyy")))


def mod97(s: Column) -> Column:
    """The remainder of a string of digits and capitals (A is 10) by 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars(s), F.lit(0), lambda a, c: (F.when(c.rlike("[0-9]"), a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97).cast("int"))


def iban(m: Column, key: str) -> Column:
    def new(s: Column) -> Column:
        body, country = F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 2)

        def put(b: Column) -> Column:
            check = F.lpad((98 - mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0")
            return spaced(m, F.concat(country, check, b))

        ok = mod97(F.concat(body, F.substring(s, 1, 4))) == 1
        return F.when(ok, bind(letters(body, key, "iban"), put))

    return bind(F.regexp_replace(m, " ", ""), new)


def spaced(form: Column, s: Column) -> Column:
    """The characters of s in the places of form's characters other than spaces."""
    gaps = F.split(form, "[^ ]", -1)
    return F.concat_ws("", F.zip_with(gaps, F.concat(chars(s), F.array(F.lit(""))), lambda a, b: F.concat(a, b)))


def email(m: Column, key: str) -> Column:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    return F.concat(letters(local, key, "email"), F.lit("@"), domain)


def named(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, rf"^{NAMES}\s?[=:]\s?[\"']?", 0)
    value = F.substring(m, F.length(name) + 1, F.length(m))
    return F.concat(name, F.when(value.rlike("^[0-9a-f]+$"), hexes(value, key, "secret")).otherwise(letters(value, key, "secret")))


#: In the order in which a match is tried: a form that fits but doesn't validate passes on to the next.
KINDS = (
    ("email", EMAIL, email),
    ("key", KEYED, lambda m, key: F.concat(F.lit("AKIA"), letters(F.substring(m, 5, 16), key, "key"))),
    ("secret", NAMED, named),
    ("iban", IBAN, iban),
    ("date", DATE, date),
    ("ip", IP, ip),
    ("ssn", SSN, ssn),
    ("card", CARD, card),
    ("phone", PHONE, phone),
)


def pseudonym(m: Column, key: str) -> Column:
    """A match's pseudonym; null if no kind of value validates."""
    return F.coalesce(*[F.when(m.rlike(whole(form)), make(m, key)) for _, form, make in KINDS])


def inside(m: Column, key: str) -> Column:
    """(p, n) of a run of numbers that is no value itself: those values in it that validate, each of whole numbers, are
    replaced; null if there are none. From left to right, social-security and phone numbers before cards, long before short."""

    def run(groups: Column) -> Column:
        size = F.size(groups)
        mark = lambda i: F.regexp_extract(F.get(groups, i), "^[ -]?", 0)

        def first(i: Column, form: str, make, alone: bool, most: int, least: int) -> Column:
            def at(n: Column) -> Column:
                free = ~((mark(i) == "-") | F.coalesce(mark(i + n) == "-", F.lit(False))) if alone else F.lit(True)
                own = F.regexp_replace(F.concat_ws("", F.slice(groups, i + 1, n)), "^[ -]", "")
                fits = lambda w: F.length(w).between(11, 37) & free & w.rlike(whole(form))
                return F.struct(bind(own, lambda w: F.when(fits(w), make(w, key))).alias("p"), (i + n).cast("int").alias("end"))

            tried = F.transform(F.sequence(F.lit(most), F.lit(least), F.lit(-1)), lambda n: F.when(i + n <= size, at(n)))
            return F.get(F.filter(tried, lambda x: x["p"].isNotNull()), F.lit(0))

        def step(acc: Column, i: Column) -> Column:
            def put(x: Column) -> Column:
                kept = F.struct(F.concat(acc["p"], F.get(groups, i)).alias("p"), acc["n"].alias("n"), (i + 1).cast("int").alias("end"))
                new = F.struct(F.concat(acc["p"], mark(i), x["p"]).alias("p"), (acc["n"] + 1).alias("n"), x["end"].alias("end"))
                return F.when(x.isNull(), kept).otherwise(new)

            # numbers of each kind: parted by marks they are 3, 3 or 4, and for cards of 13 to 19 digits up to 19
            found = F.coalesce(first(i, SSN, ssn, True, 3, 3), first(i, PHONE, phone, False, 4, 3), first(i, CARD, card, False, 19, 1))
            return F.when(i < acc["end"], acc).otherwise(bind(found, put))

        # a fold copies its string at each step: folds over parts, then their strings, copy far less than one over all
        wide = F.ceil(F.sqrt(size.cast("double"))).cast("int")
        empty = F.array().cast("array<string>")
        start = F.struct(empty.alias("p"), F.lit(0).alias("n"), F.lit(0).alias("end"))

        def part(acc: Column, at: Column) -> Column:
            mine = F.struct(F.lit("").alias("p"), F.lit(0).alias("n"), acc["end"].alias("end"))
            done = F.aggregate(F.sequence(at, F.least(at + wide, size) - 1), mine, step)
            return bind(done, lambda x: F.struct(F.concat(acc["p"], F.array(x["p"])).alias("p"), (acc["n"] + x["n"]).alias("n"), x["end"].alias("end")))

        done = F.aggregate(F.sequence(F.lit(0), size - 1, wide), start, part)
        return bind(done, lambda x: F.when(x["n"] > 0, F.struct(F.concat_ws("", x["p"]).alias("p"), x["n"].alias("n"))))

    return F.when(m.rlike(r"^\d++(?:[ -]\d++)++$"), bind(F.regexp_extract_all(m, F.lit(r"[ -]?\d+"), F.lit(0)), run))


def replaced(m: Column, key: str) -> Column:
    """(p, n): what stands in a match's place and how many values that replaces; null if none validates."""
    return bind(pseudonym(m, key), lambda p: F.when(p.isNotNull(), F.struct(p.alias("p"), F.lit(1).alias("n"))).otherwise(inside(m, key)))


def private_text(text: Column, key: str) -> Column:
    """(text, n): a text with pseudonyms in it, and how many values they replace."""
    some = text.rlike(rf"[0-9@]|{NAMES}")

    def put(found: Column) -> Column:
        def filled(new: Column) -> Column:
            parts = F.split(text, ANY, -1)
            between = F.zip_with(found, new, lambda m, p: F.coalesce(p["p"], m))
            whole_text = F.concat_ws("", F.zip_with(parts, F.concat(between, F.array(F.lit(""))), lambda a, b: F.concat(a, b)))
            n = F.aggregate(new, F.lit(0), lambda a, p: a + F.coalesce(p["n"], F.lit(0)))
            return F.when(F.size(found) > 0, F.struct(whole_text.alias("text"), n.cast("long").alias("n")))

        return bind(F.transform(found, lambda m: replaced(m, key)), filled)

    as_it_is = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    return F.coalesce(F.when(some, bind(F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1)), put)), as_it_is)


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", count: str | None = "n_private") -> DataFrame:
    """docs with its texts pseudonymised, and in the column `count` (if not None; it must be a new one) the number of
    values replaced. Column order is kept."""
    own = unused(docs, "private")
    new = docs.withColumn(own, private_text(column(text_col).cast("string"), key))
    kept = [F.col(f"{own}.text").alias(c) if c == text_col else column(c) for c in docs.columns]
    return new.select(*kept, *([] if count is None else [F.col(f"{own}.n").alias(count)]))
