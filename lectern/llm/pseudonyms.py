"""Format-preserving pseudonyms in DataFrame functions only.

Card numbers with a right check digit, IPv4 addresses, telephone numbers, account numbers with
right check digits and calendar dates are permuted by a keyed Feistel network within their own
format: lengths, separators and check digits stay right, every value has one pseudonym and no
two values share one, so equal values stay linked across documents.  Rounds take SHA-256 of
the key, the round, the kind and the other half.  The local part of an e-mail address, which
has no fixed format, becomes 128 bits of a keyed hash of the whole address.

Card and account numbers are looked for in whole runs of groups: any stretch of groups with
right check digits is a value, the longest first, so a neighbouring number hides none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: One pattern for each kind, tried in this order at a place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
DATE = r"(?<![\d./-])(?:(?:19|20)\d\d-[01]\d-[0-3]\d|[0-3]\d[./][01]\d[./](?:19|20)\d\d)(?![\d/-]|\.\d)"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d+.-])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d+.-])(?:1-)?\d{3}-\d{3}-\d{4}(?!\d)"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, DATE, PHONE))
#: Whole runs of groups, the groups in them, and what a stretch of groups must look like.
IBAN_RUN = r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,}+"
IBAN_GROUP = r"[A-Z0-9]+ ?"
IBAN = r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"
CARD_RUN = r"(?<![\d.-])\d(?:[ -]?\d){12,}+"
CARD_GROUP = r"\d+[ -]?"
CARD = r"^\d(?:[ -]?\d){12,18}$"
#: Most groups in a stretch: as many as a value has characters.
IBAN_GROUPS, CARD_GROUPS = 9, 19
#: Places of values while a text is worked on, and the sign that writes these characters out
#: where a text holds them itself.
MARKS, SIGN, TAILS = ("\ufdd0", "\ufdd1", "\ufdd2"), "\ufdd3", "\ufdd4\ufdd5\ufdd6\ufdd7"
KINDS = ("email", "ipv4", "date", "phone", "iban", "card")


def draw(key: str, kind: str, step: int, other: Column, bound) -> Column:
    """A number below `bound` from 60 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(step)), other.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), bound)


def feistel(left: Column, right: Column, a, b, key: str, kind: str) -> Column:
    """A permutation of pairs (left below a, right below b), as a struct(left, right)."""
    state = F.struct(left.cast("long").alias("x"), right.cast("long").alias("y"))
    for i in range(ROUNDS):
        # one lambda over a single item keeps the state from being written out twice a round
        state = F.element_at(F.transform(F.array(state), _round(i, a, b, key, kind)), 1)
    return state


def _round(i: int, a, b, key: str, kind: str):
    def step(s: Column) -> Column:
        if i % 2 == 0:
            return F.struct(F.pmod(s.x + draw(key, kind, i, s.y, a), a).alias("x"), s.y.alias("y"))
        return F.struct(s.x.alias("x"), F.pmod(s.y + draw(key, kind, i, s.x, b), b).alias("y"))

    return step


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A digit string of up to 36 digits, permuted among those of its length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    a, b = F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), n - half).cast("long")

    def whole(d: Column) -> Column:
        s = feistel(F.coalesce(F.substring(d, F.lit(1), half).cast("long"), F.lit(0)), F.substring(d, half + 1, n - half).cast("long"), a, b, key, kind)
        made = F.transform(F.array(s), lambda p: F.concat(F.when(half > 0, F.lpad(p.x.cast("string"), half, F.lit("0"))).otherwise(F.lit("")), F.lpad(p.y.cast("string"), n - half, F.lit("0"))))
        return F.element_at(made, 1)

    return F.element_at(F.transform(F.array(digits), whole), 1)


def poured(shape: Column, digits: Column) -> Column:
    """`digits` in place of the digits of `shape`, one by one."""
    places = F.sequence(F.lit(1), F.length(shape))
    return F.array_join(F.transform(places, lambda i: F.when(F.rlike(F.substring(shape, i, F.lit(1)), F.lit(r"\d")), F.substring(digits, F.length(digits_of(F.substring(shape, F.lit(1), i))), F.lit(1))).otherwise(F.substring(shape, i, F.lit(1)))), "")


def permute_letters(letters: Column, key: str, kind: str) -> Column:
    """Up to 30 capital letters, permuted in two parts, each among those of its length."""
    capitals, base26 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789ABCDEFGHIJKLMNOP"

    def number(c: Column) -> Column:
        return F.conv(F.translate(c, capitals, base26), 26, 10).cast("long")

    def written(x: Column, n: Column) -> Column:
        return F.when(n > 0, F.translate(F.lpad(F.conv(x.cast("string"), 10, 26), n, F.lit("0")), base26, capitals)).otherwise(F.lit(""))

    def part(p: Column) -> Column:
        n = F.length(p)
        half = F.floor(n / 2).cast("int")
        a, b = F.pow(F.lit(26.0), half).cast("long"), F.pow(F.lit(26.0), n - half).cast("long")
        s = feistel(F.coalesce(number(F.substring(p, F.lit(1), half)), F.lit(0)), number(F.substring(p, half + 1, n - half)), a, b, key, kind)
        return F.when(n > 0, F.element_at(F.transform(F.array(s), lambda q: F.concat(written(q.x, half), written(q.y, n - half))), 1)).otherwise(F.lit(""))

    return F.array_join(F.transform(F.array(F.substring(letters, 1, 15), F.substring(letters, 16, 15)), part), "")


def filled(shape: Column, chars: Column, kind: str) -> Column:
    """`chars` in place of the characters of a class of `shape`, one by one."""
    places = F.sequence(F.lit(1), F.length(shape))
    one = lambda i: F.substring(shape, i, F.lit(1))
    nth = lambda i: F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), F.lit(f"[^{kind}]"), F.lit("")))
    return F.array_join(F.transform(places, lambda i: F.when(F.rlike(one(i), F.lit(f"[{kind}]")), F.substring(chars, nth(i), F.lit(1))).otherwise(one(i))), "")


def luhn_sum(digits: Column) -> Column:
    """Weighted digit sum, the last digit with weight one."""
    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: _doubled(F.substring(back, i, F.lit(1)).cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda t, x: t + x)


def _doubled(d: Column, i: Column) -> Column:
    return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)


def mod97(digits: Column) -> Column:
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda t, x: F.when(x == "", t).otherwise((t * 10 + x.cast("int")) % 97))


def letters_as_numbers(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, ""), lambda x: F.when(F.rlike(x, F.lit("[A-Z]")), (F.ascii(x) - 55).cast("string")).otherwise(x)), "")


def bound(c: Column, f) -> Column:
    """f(c), with c worked out once."""
    return F.element_at(F.transform(F.array(c), f), 1)


def is_card(m: Column) -> Column:
    return F.rlike(m, F.lit(CARD)) & bound(digits_of(m), lambda d: luhn_sum(d) % 10 == 0)


def card(m: Column, key: str) -> Column:
    d = digits_of(m)
    body = permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
    return F.element_at(F.transform(F.array(body), lambda x: poured(m, F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))), 1)


def bare(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit(""))


def is_iban(m: Column) -> Column:
    b = bare(m)
    return F.rlike(m, F.lit(IBAN)) & (mod97(letters_as_numbers(F.concat(F.substring(b, F.lit(5), F.length(b) - 4), F.substring(b, 1, 4)))) == 1)


def iban(m: Column, key: str) -> Column:
    """The country stays; digits and letters are permuted each in their own places."""
    b = bare(m)
    land, account = F.substring(b, 1, 2), F.substring(b, F.lit(5), F.length(b) - 4)
    digits, letters = digits_of(account), F.regexp_replace(account, r"\d", "")
    new_digits = F.when(digits == "", F.lit("")).otherwise(permute_digits(digits, key, "iban"))
    parts = F.array(F.struct(new_digits.alias("d"), permute_letters(letters, key, "iban letters").alias("l")))
    body = F.transform(parts, lambda p: filled(F.when(digits == "", account).otherwise(filled(account, p.d, "0-9")), p.l, "A-Z"))
    made = F.transform(body, lambda a: F.concat(land, filled(F.substring(m, F.lit(3), F.length(m) - 2), F.concat(F.lpad((98 - mod97(letters_as_numbers(F.concat(a, land, F.lit("00"))))).cast("string"), 2, "0"), a), "A-Z0-9")))
    return F.element_at(made, 1)


def stretches(groups: Column, most: int, valid, make) -> Column:
    """Stretches of groups that are valid and don't overlap, by place: (start, n, value, made).

    From the right, one stands if none that stands and overlaps it is longer; from the left,
    the first of those that overlap is taken.  So each valid one is taken or overlaps a taken
    one that is as long or longer.
    """

    def of(i: Column, n: Column) -> Column:
        return F.regexp_replace(F.array_join(F.slice(groups, i, n), ""), "[ -]$", "")

    def longest(i: Column) -> Column:
        n = F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.lit(most), F.size(groups) - i + 1)), lambda n: bound(of(i, n), valid)))
        return F.element_at(F.transform(F.array(n), lambda n: F.when(n.isNotNull(), F.struct(i.alias("start"), n.alias("n"), of(i, n).alias("value"), F.length(F.regexp_replace(of(i, n), "[ -]", "")).alias("chars")))), 1)

    def strong(out: Column, c: Column) -> Column:
        near = F.slice(out, F.greatest(F.lit(1), F.size(out) - most + 1), F.lit(most))
        beaten = F.when(F.size(out) > 0, F.exists(near, lambda w: (w.start < c.start + c.n) & (w.chars > c.chars))).otherwise(F.lit(False))
        return F.when(beaten, out).otherwise(F.concat(out, F.array(c)))

    def first(out: Column, c: Column) -> Column:
        end = F.when(F.size(out) > 0, F.element_at(out, -1).start + F.element_at(out, -1).n).otherwise(F.lit(0))
        return F.when(c.start >= end, F.concat(out, F.array(c))).otherwise(out)

    none = F.array().cast("array<struct<start:int,n:int,value:string,chars:int>>")
    every = F.filter(F.transform(F.sequence(F.lit(1), F.size(groups)), longest), lambda c: c.isNotNull())
    standing = F.aggregate(F.reverse(every), none, strong)
    taken = F.aggregate(F.reverse(standing), none, first)
    return F.transform(taken, lambda c: F.struct(c.start.alias("start"), c.n.alias("n"), c.value.alias("value"), bound(c.value, make).alias("made")))


def marked(groups: Column, taken: Column, mark: str) -> Column:
    """The run again, with a mark in place of each taken stretch."""

    def step(s: Column, t: Column) -> Column:
        whole = F.array_join(F.slice(groups, t.start, t.n), "")
        before = F.array_join(F.slice(groups, s.at, t.start - s.at), "")
        return F.struct((t.start + t.n).alias("at"), F.concat(s.run, before, F.lit(mark), F.substring(whole, F.length(t.value) + 1, F.lit(1))).alias("run"))

    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("run"))
    return F.aggregate(taken, start, step, lambda s: F.concat(s.run, F.array_join(F.slice(groups, s.at, F.size(groups) - s.at + 1), "")))


def woven(between: Column, found: Column) -> Column:
    """The texts between with the values found between them."""
    return F.array_join(F.flatten(F.zip_with(between, found, lambda b, f: F.array(b, F.coalesce(f, F.lit(""))))), "")


def by_groups(rows: DataFrame, name: str, mark: str, run: str, group: str, most: int, valid, make) -> DataFrame:
    """`text` with a mark for every value in runs, and the pseudonyms in column `name`."""
    runs = F.transform(F.regexp_extract_all("text", F.lit(run), F.lit(0)), lambda m: F.regexp_extract_all(m, F.lit(group), F.lit(0)))
    taken = F.transform(runs, lambda g: F.struct(g.alias("groups"), stretches(g, most, valid, make).alias("taken")))
    rows = rows.withColumn("runs", F.when(F.rlike("text", F.lit(run)), taken))
    hit = F.col("runs").isNotNull()
    made = F.flatten(F.transform("runs", lambda r: F.transform(r.taken, lambda t: t.made)))
    text = woven(F.split("text", run, -1), F.transform("runs", lambda r: marked(r.groups, r.taken, mark)))
    return rows.withColumn(name, F.when(hit, made).otherwise(F.array().cast("array<string>"))).withColumn("text", F.when(hit, text).otherwise(F.col("text"))).drop("runs")


def ipv4(m: Column, key: str) -> Column:
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    s = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], F.lit(65536), F.lit(65536), key, "ipv4")
    made = F.transform(F.array(s), lambda q: F.concat_ws(".", *[x.cast("string") for x in (F.floor(q.x / 256), q.x % 256, F.floor(q.y / 256), q.y % 256)]))
    return F.element_at(made, 1)


#: The country calling codes of one and two digits; all others have three.
COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def phone(m: Column, key: str) -> Column:
    """The country code stays, found by its digits whatever follows it; the digits behind it are
    permuted, so one number has one pseudonym in all its spellings."""
    digits = digits_of(m)
    sign = F.when(F.startswith(m, F.lit("1-")), "+").otherwise(F.substring(m, 1, 1))
    land = F.regexp_extract(F.concat(sign, digits), COUNTRY, 1)
    rest = F.substring(digits, F.length(land) + 1, F.length(digits))
    return bound(permute_digits(rest, key, "phone"), lambda d: poured(m, F.concat(land, d)))


#: Days from 1900-01-01 to 2099-12-31: 319 times 229.
DAYS = (319, 229)


def date(m: Column, key: str) -> Column:
    """A calendar date of 1900 to 2099 in one of the written orders; day first where both fit."""
    first = F.rlike(m, F.lit(r"^\d{4}-"))
    sign = F.substring(m, 3, 1)
    iso = F.when(first, m).otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
    turned = F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2))
    as_day, as_month = F.try_to_date(iso, "yyyy-MM-dd"), F.when(~first, F.try_to_date(turned, "yyyy-MM-dd"))
    day = F.coalesce(as_day, as_month)
    number = F.datediff(day, F.lit("1900-01-01").cast("date"))
    s = feistel(F.floor(number / DAYS[1]), number % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, "date")

    def written(q: Column) -> Column:
        new = F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), (q.x * DAYS[1] + q.y).cast("int")), "yyyy-MM-dd")
        y, mo, d = F.substring(new, 1, 4), F.substring(new, 6, 2), F.substring(new, 9, 2)
        return F.when(first, new).when(as_day.isNotNull(), F.concat(d, sign, mo, sign, y)).otherwise(F.concat(mo, sign, d, sign, y))

    return F.when(day.isNotNull(), F.element_at(F.transform(F.array(s), written), 1))


def email(m: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 32), F.lit("@mail.invalid"))


def kind_of(m: Column) -> Column:
    out = F.lit("phone")
    for kind, pattern in (("date", DATE), ("ipv4", IPV4), ("email", EMAIL)):
        out = F.when(F.rlike(m, F.lit(f"^(?:{pattern})$")), F.lit(kind)).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """The pseudonym, or null if the value is not valid for its kind."""
    return F.when(kind == "email", email(m, key)).when(kind == "ipv4", ipv4(m, key)).when(kind == "date", date(m, key)).otherwise(phone(m, key))


def pseudonymise(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, text with valid private values replaced, n_replaced, and
    n_<kind> for every kind.

    Null texts stay null and empty ones empty, with zero counts.  Numbers that are not valid
    (a wrong check digit, no such day) stay as they are.  Very long texts are taken whole;
    repeated rows give equal rows; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    own = [(c, SIGN + t) for c, t in zip((SIGN, *MARKS), TAILS)]
    holds_own = F.contains("text", F.lit(SIGN)) | F.contains("text", F.lit(MARKS[0])) | F.contains("text", F.lit(MARKS[1])) | F.contains("text", F.lit(MARKS[2]))
    escaped = F.col("text")
    for c, written in own:
        escaped = F.replace(escaped, F.lit(c), F.lit(written))
    rows = rows.withColumn("own", holds_own).withColumn("text", F.when(F.col("own"), escaped).otherwise(F.col("text")))

    none = F.array().cast("array<struct<value:string,kind:string,made:string>>")
    found = F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("value"), kind_of(m).alias("kind")))
    known = F.transform(found, lambda f: F.struct(f.value.alias("value"), f.kind.alias("kind"), pseudonym(f.value, f.kind, secret).alias("made")))
    rows = rows.withColumn("found", F.when(F.rlike("text", F.lit(ANY)), known).otherwise(none))
    rows = rows.withColumn("text", F.when(F.size("found") > 0, F.array_join(F.split("text", ANY, -1), MARKS[0])).otherwise(F.col("text")))
    rows = by_groups(rows, "ibans", MARKS[1], IBAN_RUN, IBAN_GROUP, IBAN_GROUPS, is_iban, lambda m: iban(m, secret))
    rows = by_groups(rows, "cards", MARKS[2], CARD_RUN, CARD_GROUP, CARD_GROUPS, is_card, lambda m: card(m, secret))

    for mark, values in zip(MARKS, (F.transform("found", lambda f: F.coalesce(f.made, f.value)), F.col("ibans"), F.col("cards"))):
        rows = rows.withColumn("text", F.when(F.size(values) > 0, woven(F.split("text", mark, -1), values)).otherwise(F.col("text")))
    plain = F.col("text")
    for c, written in reversed(own):
        plain = F.replace(plain, F.lit(written), F.lit(c))
    rows = rows.withColumn("text", F.when(F.col("own"), plain).otherwise(F.col("text")))

    def grouped(name: str, kind: str) -> Column:
        return F.transform(name, lambda m: F.struct(m.alias("value"), F.lit(kind).alias("kind"), m.alias("made")))

    rows = rows.withColumn("found", F.concat(F.filter("found", lambda f: f.made.isNotNull()), grouped("ibans", "iban"), grouped("cards", "card")))

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f.kind == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(F.col("id").alias(key), "text", F.size("found").cast("long").alias("n_replaced"), *map(number, KINDS))
