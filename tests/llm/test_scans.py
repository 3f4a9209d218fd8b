import itertools
import random
import re
from re import _parser

from lectern.llm import licenses, pseudonyms, secrets

SECRET = [
    re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I),
    re.compile(rb"AKIA[A-Z0-9]+"),
    re.compile(rb"[0-9a-f]+"),
]


def test_automaton_equals_regexes():
    rng = random.Random(1)
    bits = [b"password", b"passwd", b"Token", b"SECRET", b"api_key", b"=", b":", b" ", b'"', b"AKIA", b"ABCDEFGHIJKLMNOP12", b"0123456789abcdef", b"abc", b"f", b".", b"-", b"x", b"ghp_"]
    scanner = secrets.scanner_of(secrets.RULES)
    for _ in range(4000):
        data = b"".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))
        want = []
        for k, p in enumerate(SECRET):
            for m in p.finditer(data):
                if k == 0 and len(m.group(2)) >= 6 or k == 1 and m.end() - m.start() >= 20 or k == 2 and m.end() - m.start() >= 24:
                    want.append((m.start(), k, m.end()))
        got = [(a, k, b) for a, k, b in scanner.spans(data) if k < 3 and b - a >= secrets.RULES[k].least and not (k == 0 and secrets.value_length(data[a:b]) < 6)]
        assert got == sorted(want)


def test_secret_cases(spark):
    rows = [(1, "é token = 'abcdef12' x"), (2, None), (3, ""), (3, ""), (4, "-----BEGIN RSA PRIVATE KEY-----")]
    got = sorted((r.doc_id, [tuple(f) for f in r.found]) for r in secrets.scan(spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, found int")).collect())
    assert got == [(1, [("assign", 2, 19)]), (2, []), (3, []), (3, []), (4, [("private_key", 0, 31)])]
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_base_places(spark, sf):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, "MIT License mit license; the General Public\nLicense"), (-2, None), (-3, ""), (-4, "license"), (-5, "apache license"), (-6, "x apache license é"), (-7, "Licensed under the Apache License, Version 2.0. See https://www.apache.org/licenses/LICENSE-2.0")], "doc_id long, text string")
    docs = docs.union(extra)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    hits = 0
    for r in docs.collect():
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        words = word.findall(text)
        places = [(i, lab) for phrase, lab in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(words), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None)), r.doc_id
        assert g.base_labels == sorted({lab for _, lab in places}) and set(g.base_labels) <= set(g.labels)
        hits += bool(places)
    assert hits > 5
    assert got[-7].labels == ["apache", "apache-2.0"] and got[-7].score == 0.9
    assert len(licenses.rules()) > 200


def examples(parsed):
    """One text for every way through a parsed regex: alternatives, classes, options."""
    ways = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            ways.append([chr(arg)])
        elif op == "IN":
            ways.append([" "] if str(arg[0][0]) == "CATEGORY" else [chr(v) for _, v in arg])
        elif op == "BRANCH":
            ways.append([x for part in arg[1] for x in examples(part)])
        elif op == "SUBPATTERN":
            ways.append(examples(arg[3]))
        elif op == "MAX_REPEAT":
            some = examples(arg[2])
            ways.append(["", *some] if arg[0] == 0 else some)
        else:
            assert op == "AT", op
    return ["".join(x) for x in itertools.product(*ways)]


def test_license_keywords_are_implied(spark):
    gate = licenses.gate_words()
    names = []
    for label, words, rule in [*licenses.NAMES, *licenses.TEXTS]:
        for text in examples(_parser.parse(rule)):
            assert re.fullmatch(rule, text), (rule, text)
            assert any(w in text for w in words.split("|")) and any(w in text for w in gate), (label, text)
            names.append(text)
    for _, _, words, rule in licenses.rules():
        assert all(any(g in w for g in gate) for w in words.split("|")), rule
    texts = [f"x {t} y" for t in dict.fromkeys(names)] + ["Released under Apache-2.0", "bsd-3-clause", "SPDX-License-Identifier: WTFPL", "an example of a submit limit"]
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    made = [(t, label, re.compile(rule, re.A)) for t, label, _, rule in licenses.rules()]
    for r in rows:  # every rule tried, with no gate and no keyword
        hits = sorted((m.start(), -m.end(), t, label) for t, label, rule in made for m in rule.finditer(texts[r.doc_id].lower()))
        ends, want = {1: 0, 2: 0, 3: 0}, []
        for start, back, t, label in hits:
            if -back > max(ends[k] for k in ends if k <= t):
                ends[t] = max(ends[t], -back)
                want.append((start, -back, t, label))
        assert [tuple(f) for f in r.found] == want, texts[r.doc_id]
        assert bool(want) == (r.doc_id < len(texts) - 1)


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_pseudonyms(spark):
    rows = [(1, "call +1 (017) 555-7713 or mail a.b@c.example.com; card 4845168114407329, not 9807915762804490"), (2, "card 4845 1681 1440 7329 at 10.0.0.1 on 2024-02-29 and 31/12/1999, no 2023-02-30."), (3, None), (4, ""), (5, "GB82 WEST 1234 DE89370400440532013000 DE89370400440532013001"), (6, "card 4845168114407329")]
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame([(a, b, "k") for a, b in rows], "doc_id long, text string, found string"), "key").collect()}
    assert out[3].text is None and out[4].text == "" and out[4].n_replaced == 0
    one = re.search(r"card (\d{16}), not 9807915762804490$", out[1].text)
    assert one and luhn(one[1]) and one[1] != "4845168114407329" and out[1].n_replaced == 3
    assert re.match(r"call \+1 \(\d{3}\) \d{3}-\d{4} or mail u[0-9a-f]{32}@mail\.invalid;", out[1].text) and "017) 555" not in out[1].text
    two = re.match(r"card (\d{4} \d{4} \d{4} \d{4}) at (\d+\.\d+\.\d+\.\d+) on (\d{4}-\d\d-\d\d) and (\d\d/\d\d/\d{4}), no 2023-02-30\.$", out[2].text)
    assert two and two[1].replace(" ", "") == one[1] and two[2] != "10.0.0.1" and two[3] != "2024-02-29"
    assert out[6].text == f"card {one[1]}"
    iban = re.match(r"GB82 WEST 1234 DE(\d{20}) DE89370400440532013001$", out[5].text)
    assert iban and int(iban[1][2:] + "1314" + iban[1][:2]) % 97 == 1 and iban[1] != "89370400440532013000"


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def test_pseudonyms_beside_other_numbers(spark):
    card = r"(\d{4} \d{4} \d{4} \d{4})"
    cases = [
        ("4111 1111 1111 1111 05/27", rf"^{card} 05/27$", 1),
        ("4111111111111111 123", r"^(\d{16}) 123$", 1),
        ("order 12 4111 1111 1111 1111", rf"^order 12 {card}$", 1),
        ("ID12 4111 1111 1111 1111 2024-02-29", rf"^ID12 {card} \d{{4}}-\d\d-\d\d$", 2),
        ("NO12 PAYMENT 4111-1111-1111-1111-7", r"^NO12 PAYMENT (\d{4}-\d{4}-\d{4}-\d{4})-7$", 1),
        ("4111 1111 1111 1111 5500 0000 0000 0004", rf"^{card} {card}$", 2),
        ("\ufdd0\ufdd3\ufdd5 4111111111111111 \ufdd2", "^\ufdd0\ufdd3\ufdd5 (\\d{16}) \ufdd2$", 1),
        ("9807915762804490 \ufdd1\ufdd3", "^9807915762804490 \ufdd1\ufdd3$", 0),
    ]
    ibans = [
        ("GB82 WEST 1234 5698 7654 32", r"^(GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d)$", 1),
        ("to NL91ABNA0417164300.", r"^to (NL\d\d[A-Z]{4}\d{10})\.$", 1),
        ("BE68 5390 0754 7034 PAID FR14 2004 1010 0505 0001 3M02 606", r"^(BE\d\d \d{4} \d{4} \d{4}) PAID (FR\d\d \d{4} \d{4} \d{4} \d{4} \d[A-Z]\d\d \d{3})$", 2),
        ("GB82 WEST 1234 5698 7654 33", r"^GB82 WEST 1234 5698 7654 33$", 0),
    ]
    rows = [(i, text) for i, (text, _, _) in enumerate([*cases, *ibans])]
    out = {r.doc_id: r for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "key").collect()}
    for i, (text, want, n) in enumerate([*cases, *ibans]):
        made = re.search(want, out[i].text)
        assert made and out[i].n_replaced == n, (text, out[i])
        for value in made.groups():
            plain = re.sub("[ -]", "", value)
            assert value not in text and (luhn(plain) if plain.isdigit() else mod97(plain) == 1)


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    got = spark.range(319 * 229).select(pseudonyms.feistel(F.floor(F.col("id") / 229), F.col("id") % 229, F.lit(319), F.lit(229), "k", "date").alias("s"))
    assert got.distinct().count() == 319 * 229
    digits = spark.range(100000).select(pseudonyms.permute_digits(F.lpad(F.col("id").cast("string"), 5, "0"), "k", "card").alias("d"))
    assert digits.distinct().count() == 100000 and digits.filter("d rlike '^[0-9]{5}$'").count() == 100000
    letters = spark.range(26**3).select(pseudonyms.permute_letters(F.concat(*[F.char(65 + F.floor(F.col("id") / 26**i) % 26) for i in range(3)]), "k", "iban letters").alias("d"))
    assert letters.distinct().count() == 26**3 and letters.filter("d rlike '^[A-Z]{3}$'").count() == 26**3
    long = spark.range(1).select(pseudonyms.permute_letters(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZABCD"), "k", "iban letters").alias("d")).first().d
    assert re.fullmatch("[A-Z]{30}", long)


def test_phone_spellings_stay_linked(spark):
    rows = [(0, "+1 017 555 7713"), (1, "+1-017-555-7713"), (2, "+10175557713"), (3, "+44 20 7946 0958"), (4, "+442079460958"), (5, "(017) 555-7713")]
    got = {r.doc_id: re.sub(r"\D", "", r.text) for r in pseudonyms.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), secret="k").collect()}
    assert got[0] == got[1] == got[2] != "10175557713" and got[3] == got[4] and got[3].startswith("44") and got[0] == "1" + got[5]


def test_secret_query_equals_brute_force(spark, sf):
    """Counts and hash of the base kinds over whole documents; their spans stay among all."""
    import hashlib

    from lectern.llm import queries

    sf = sf.replace("0.001", "0.01")
    rules = [
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
        ("access", r"(AKIA[A-Z0-9]+)", 20),
        ("hex", r"([0-9a-f]+)", 24),
    ]
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = 0
    for r in queries.op2_secret_scan(spark, sf).collect():
        spans = [(m.start(), place, m.end(), kind) for place, (kind, rule, least) in enumerate(rules) for m in re.finditer(rule, texts[r.doc_id]) if len(m[1]) >= least]
        listed = [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(spans)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}
        found += len(spans)
    assert found > 0
