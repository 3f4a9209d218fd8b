"""Text operations as column functions; nothing here shuffles or leaves the JVM.

Patterns that stand for Unicode white space carry (?U), since Java's \\s is ASCII without it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANGLA = r"ঀ-৿"
WORD = rf"[A-Za-z{BANGLA}']+"
SENTENCE_END = r"""(?U)(?<=[.!?।])\s+|(?<=[.!?।]["”’'])\s+"""

# What a broken font writes for seven glyphs.
LIGATURES = (("¿", "fi"), ("À", "fl"), ("൵", "ff"), ("൶", "ffi"), ("µ", "‘"), ("¶", "’"), ("«", "…"))
SHIFT = 29

# Common English words.
COMMON_WORDS = """
the a an is are was were be been being and or but if then so because
to of in on at for with without by from up down out about into over
under again further this that these those i you he she it we they
me him her us them my your his its our their what which who whom
have has had do does did not no yes can could will would shall should
may might must let us go went come came see saw look read write
say said tell told ask asked make made take took give gave get got
know knew think thought like as very just also all any some more
most other such only own same than too where when why how there
here now today tomorrow yesterday school class book student teacher
boy girl name day time water good bad happy new old
""".split()

# Teaching phrases around an answer, by a name for each.
SCAFFOLDING = (
    ("greeting", r"^(dear students|hello,?\s*(dear\s+)?students|hi,?\s*(dear\s+)?students)\b"),
    ("greeting_alone", r"^(hello|hi)[!.]?\s*(dear students)?[,!.]?\s*$"),
    ("hope", r"i hope you('re| are)( all)? (doing well|fine|well)"),
    ("begin", r"^(now,?\s*)?let('s| us)\s+(begin|start|get started( with)?|get ready for|focus on)\s+(our\s+)?lesson\b"),
    ("unit_lesson", r"\bunit\s+\d+,?\s*lesson\s+\d+\b"),
    ("page", r"\bon page\s+\d+\b"),
    ("class", r"^we are in class\s+\d+\b.*\b(learning about|studying)\b"),
    ("you_asked", r"""^you asked\b.*\?["”’]?\s*$"""),
    ("answer_question", r"""^(now,?\s*)?(let'?s|to) answer (the|your) question\b.*\?["”’]?\s*$"""),
    ("repeat", r"^(i'?ll|i will|let me)\s+repeat\b"),
    ("understand", r"^(do you|does everyone)\s+understand\??\s*$"),
    ("sense", r"^does that make sense\??\s*$"),
    ("can_anyone", r"^(now,?\s*)?can (anyone|you) tell me\b"),
    ("tell_me", r"^now,?\s*tell me\b"),
    ("learned", r"^(so,?\s*)?what (have|did) we (learn|learned) today\b"),
    ("praise", r"^(great job|well done|good job)\b"),
)

# Fixed value: an answer that says the passages hold none.
SELF_REFUSAL = r"passages?\s*(provided)?\s*do(es)?\s*not\s*(contain|have)\s*(enough|any)?\s*information"


def stripped(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def repair_span(c: Column) -> Column:
    """Shift back a span of a broken font; a span without a control character stays."""
    first, last = max(0x20 - SHIFT, 0), 0x7E - SHIFT
    codes = [i for i in range(first, last + 1) if chr(i) != " "]
    shifted = F.translate(c, "".join(map(chr, codes)), "".join(chr(i + SHIFT) for i in codes))
    for found, glyph in LIGATURES:
        shifted = F.replace(shifted, F.lit(found), F.lit(glyph))
    return F.when(F.rlike(c, F.lit(r"[\x00-\x08\x0B-\x1F]")), shifted).otherwise(c)


def common_word_share(c: Column) -> Column:
    """Share of English words that are common ones; 0 without words."""
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-zA-Z']+"), F.lit(0))
    known = F.array(*map(F.lit, COMMON_WORDS))
    hits = F.filter(found, lambda w: F.array_contains(known, w))
    return F.when(F.size(found) > 0, F.size(hits) / F.size(found)).otherwise(0.0)


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def term_counts(found: Column) -> Column:
    """token and tf of the distinct words of an array, in order: runs of the sorted words."""

    def bound(value: Column, body) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def runs(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return bound(begins, lambda b: F.transform(b, lambda a, i: F.struct(F.get(s, a).alias("token"), (F.coalesce(F.get(b, i + 1), F.size(s)) - a).alias("tf"))))

    return F.when(F.size(found) > 0, bound(F.sort_array(found), runs)).otherwise(F.array().cast("array<struct<token:string,tf:int>>"))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_END), stripped), lambda s: s != "")


def without_bangla(c: Column) -> Column:
    """Each Bangla run becomes one space; punctuation stays."""
    return F.regexp_replace(c, f"[{BANGLA}]+", " ")


def is_scaffolding(sentence: Column) -> Column:
    hit = F.lit(False)
    for _, pattern in SCAFFOLDING:
        hit = hit | F.rlike(sentence, F.lit(f"(?iuU){pattern}"))
    return hit


def scaffolding_names(sentence: Column) -> Column:
    return F.array_compact(F.array(*[F.when(F.rlike(sentence, F.lit(f"(?iuU){p}")), F.lit(n)) for n, p in SCAFFOLDING]))


def is_bangla(sentence: Column) -> Column:
    """At least one Bangla word, and no fewer than others."""
    found = words(sentence)
    bangla = F.size(F.filter(found, lambda w: F.rlike(w, F.lit(f"[{BANGLA}]"))))
    return (bangla > 0) & (bangla >= F.size(found) - bangla)


def content_sentences(c: Column, without_echo: bool = False) -> Column:
    """Sentences that are not scaffolding, nor (in echo mode) Bangla ones."""
    kept = F.filter(sentences(c), lambda s: ~is_scaffolding(s))
    return F.filter(kept, lambda s: ~is_bangla(s)) if without_echo else kept


def sentence_lengths(c: Column) -> Column:
    """Words of each sentence that has any."""
    return F.filter(F.transform(sentences(c), n_words), lambda n: n > 0)


def max_sentence_words(c: Column) -> Column:
    return F.coalesce(F.array_max(sentence_lengths(c)), F.lit(0))


def mean_sentence_words(c: Column) -> Column:
    """Unrounded; 0 without words."""
    lengths = sentence_lengths(c)
    return F.when(F.size(lengths) > 0, F.aggregate(lengths, F.lit(0), lambda t, n: t + n) / F.size(lengths)).otherwise(0.0)


def syllables(c: Column) -> Column:
    """Groups of vowels of each word, without a silent e at its end; one at least."""
    each = F.transform(words(F.lower(c)), lambda w: F.greatest(F.lit(1), F.regexp_count(F.regexp_replace(w, "(?<=[^aeiouy])e$", ""), F.lit("[aeiouy]+"))))
    return F.aggregate(each, F.lit(0), lambda t, n: t + n)


def reading_grade(c: Column, digits: int = 2) -> Column:
    """Flesch-Kincaid grade (Kincaid et al. 1975) of the English part, to `digits` decimals.

    Null under 30 tokens or outside -5 to 25.  Syllables follow the rule above, so the score
    is close to, but not, that of other implementations."""
    english = without_bangla(c)
    n = F.size(words(english))
    count = F.greatest(F.lit(1), F.size(sentences(english)))
    return grade_of(F.size(tokens(english)), n, count, syllables(english), digits)


def grade_of(n_tokens: Column, n: Column, count: Column, n_syllables: Column, digits: int = 2) -> Column:
    """The grade from counts of tokens, words, sentences and syllables."""
    score = 0.39 * (n / F.greatest(F.lit(1), count)) + 11.8 * (n_syllables / F.greatest(F.lit(1), n)) - 15.59
    # by the double itself: F.round goes by its shortest decimal form and lifts 9.825 (a bit less)
    score = F.floor(score * float(10**digits) + 0.5) / float(10**digits)
    return F.when((n_tokens >= 30) & (n > 0) & score.between(-5, 25), score)


def punctuation_density(c: Column) -> Column:
    """Sentence marks per 100 words, one decimal; 0 without words."""
    return F.when(n_words(c) > 0, F.round(100 * F.regexp_count(c, F.lit("[.!?।]")) / n_words(c), 1)).otherwise(0.0)


def chunk_words(c: Column, most: int = 600, overlap: int = 50) -> Column:
    """Windows of `most` tokens that share `overlap` with the next, the last one as short as
    it comes, but never inside its neighbour."""
    if overlap >= most:
        raise ValueError("overlap must be smaller than a window")
    found = tokens(c)
    stride = most - overlap
    count = F.when(F.size(found) <= most, 1).otherwise(1 + F.ceil((F.size(found) - most) / stride)).cast("int")
    made = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.array_join(F.slice(found, i * stride + 1, F.lit(most)), " "))
    return F.when(F.size(found) > 0, made).otherwise(F.array().cast("array<string>"))


def strip_furniture(c: Column, title: Column) -> Column:
    """A page without its running header, footer and title lines."""
    lines = F.split(c, "\n")
    lines = F.when(F.element_at(lines, 1) == "2026", F.slice(lines, F.lit(2), F.size(lines))).otherwise(lines)

    def digits(x: Column) -> Column:
        return F.rlike(F.coalesce(stripped(x), F.lit("")), F.lit(r"^\p{Nd}+$"))

    def at(all_lines: Column, i: Column) -> Column:
        return F.get(all_lines, i)

    def keep(all_lines: Column):
        def test(x: Column, i: Column) -> Column:
            before, after = at(all_lines, i - 1), at(all_lines, i + 1)
            unit = F.coalesce(x == "Unit", F.lit(False)) & digits(after)
            number = digits(x) & (F.coalesce(after == "Unit", F.lit(False)) | F.coalesce(before == "Unit", F.lit(False)))
            return ~((x == "English for Today") | (x == title) | unit | number)

        return test

    return F.array_join(F.element_at(F.transform(F.array(lines), lambda all_lines: F.filter(all_lines, keep(all_lines))), 1), "\n")


def split_stages(c: Column) -> Column:
    """Texts of the numbered activities of a unit in order, with what comes before them."""
    marked = F.regexp_replace(c, r"(?mU)^(\s*\d+\.\d+(?!\.\d)\s)", "\u0001$1")
    return F.filter(F.transform(F.split(marked, "\u0001"), stripped), lambda s: s != "")


def stage_type(text: Column, number: Column) -> Column:
    heading = F.lower(F.element_at(F.split(text, "\n"), 1))
    vocabulary = F.rlike(heading, F.lit("new words|word meaning|vocabulary"))
    return F.when(vocabulary, "vocabulary").when((number == 1) | F.contains(heading, F.lit("language focus")), "passage").otherwise("exercise")


def body_of(chunk: Column) -> Column:
    """A chunk without its header line; whole if it has one line."""
    return F.regexp_replace(chunk, r"^[^\n]*\n", "")


def without_header(transcript: Column) -> Column:
    """A transcript without its # lines."""
    return stripped(F.array_join(F.filter(F.split(transcript, "\n"), lambda x: ~F.startswith(stripped(x), F.lit("#"))), "\n"))


def parsed_verdict(c: Column, schema: str) -> Column:
    """JSON of a model's answer, which may stand in a fence."""
    text = stripped(c)
    inner = stripped(F.regexp_replace(stripped(F.regexp_replace(text, "^`+|`+$", "")), "(?i)^json", ""))
    return F.from_json(F.when(F.startswith(text, F.lit("```")), inner).otherwise(text), schema)


def read_verdict(c: Column) -> Column:
    """suitable, reason and unparsed from a model's answer, which may stand in a fence: unparsed
    is the text itself where it is no JSON or says nothing that is a yes or no."""
    text = stripped(c)
    inner = stripped(F.regexp_replace(stripped(F.regexp_replace(text, "^`+|`+$", "")), "(?i)^json", ""))
    body = F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)
    found = F.try_parse_json(body)
    suitable = F.try_variant_get(found, "$.suitable", "boolean")
    return F.struct(suitable.alias("suitable"), F.try_variant_get(found, "$.reason", "string").alias("reason"), F.when(c.isNotNull() & suitable.isNull(), body).alias("unparsed"))
