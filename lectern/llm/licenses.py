"""License scans: ordered signature rules over whole texts, in DataFrame functions only.

A text is tried with a rule if it holds a keyword of the rule; every alternative of a rule holds
one of its keywords.  The gate, which decides which texts are looked at, is made from all of them.  Rules come in tiers: identifiers first, then statements and addresses, then bare
names.  A detection is dropped if one of an equal or earlier tier contains its interval.
Detections are handled in order of start in one fold, so a text with many costs no pairs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label, keywords (literals with | between), name as a regex over lower-cased text.
NAMES = (
    ("apache-1.1", "apache", r"apache (?:software )?license,? (?:version |v)?1\.1"),
    ("apache-2.0", "apache", r"apache (?:software )?license,? (?:version |v)?2(?:\.0)?|\bapache[ -]2\.0\b"),
    ("apache", "apache", r"apache (?:software )?license"),
    ("mit", "mit license|expat license", r"(?:the )?\bmit license|\bexpat license"),
    ("mit-0", "mit no attribution|mit-0", r"\bmit no attribution|\bmit-0\b"),
    ("bsd-2-clause", "bsd", r"(?:simplified|freebsd|2-clause|two-clause) bsd license|bsd-2-clause|bsd 2-clause"),
    ("bsd-3-clause", "bsd", r"(?:new|modified|3-clause|three-clause) bsd license|bsd-3-clause|bsd 3-clause"),
    ("bsd-4-clause", "bsd", r"(?:original|4-clause|four-clause) bsd license|bsd-4-clause"),
    ("bsd", "bsd", r"\bbsd licen[cs]e|\bbsd-style licen[cs]e"),
    ("gpl-1.0", "gpl|general public licen", r"(?:gnu )?general public licen[cs]e,? (?:version |v)?1(?:\.0)?\b|\bgpl[ -]?v?1\b"),
    ("gpl-2.0", "gpl|general public licen", r"(?:gnu )?general public licen[cs]e,? (?:version |v)?2(?:\.0)?\b|\bgpl[ -]?v?2(?:\.0)?\b"),
    ("gpl-3.0", "gpl|general public licen", r"(?:gnu )?general public licen[cs]e,? (?:version |v)?3(?:\.0)?\b|\bgpl[ -]?v?3(?:\.0)?\b"),
    ("gpl", "gnu general public licen|gpl", r"\bgnu general public licen[cs]e|\bgnu gpl\b|\bgpl\b"),
    ("lgpl-2.1", "lgpl|lesser general public licen", r"lesser general public licen[cs]e,? (?:version |v)?2\.1|\blgpl[ -]?v?2\.1"),
    ("lgpl-3.0", "lgpl|lesser general public licen", r"lesser general public licen[cs]e,? (?:version |v)?3(?:\.0)?\b|\blgpl[ -]?v?3(?:\.0)?\b"),
    ("lgpl", "lgpl|lesser general public licen|library general public licen", r"(?:lesser|library) general public licen[cs]e|\blgpl\b"),
    ("agpl-3.0", "agpl|affero general public licen", r"affero general public licen[cs]e,? (?:version |v)?3(?:\.0)?\b|\bagpl[ -]?v?3(?:\.0)?\b"),
    ("agpl", "agpl|affero general public licen", r"affero general public licen[cs]e|\bagpl\b"),
    ("fdl", "free documentation licen", r"gnu free documentation licen[cs]e"),
    ("mpl-1.1", "mozilla public licen|mpl-1.1|mpl 1.1", r"mozilla public licen[cs]e,? (?:version |v)?1\.1|\bmpl[ -]1\.1"),
    ("mpl-2.0", "mozilla public licen|mpl-2.0|mpl 2.0", r"mozilla public licen[cs]e,? (?:version |v)?2(?:\.0)?\b|\bmpl[ -]2\.0"),
    ("mpl", "mozilla public licen", r"mozilla public licen[cs]e"),
    ("epl-1.0", "eclipse public licen", r"eclipse public licen[cs]e,? (?:-? ?version |-? ?v ?)?1\.0"),
    ("epl-2.0", "eclipse public licen", r"eclipse public licen[cs]e,? (?:-? ?version |-? ?v ?)?2\.0"),
    ("epl", "eclipse public licen", r"eclipse public licen[cs]e"),
    ("cddl-1.0", "cddl|development and distribution licen", r"common development and distribution licen[cs]e|\bcddl\b"),
    ("cpl-1.0", "common public licen", r"common public licen[cs]e"),
    ("cc0-1.0", "cc0|creative commons zero", r"\bcc0\b|creative commons zero"),
    ("cc-by-nc-nd-4.0", "cc-by|cc by", r"\bcc[ -]by[ -]nc[ -]nd[ -]4\.0"),
    ("cc-by-nc-sa-4.0", "cc-by|cc by", r"\bcc[ -]by[ -]nc[ -]sa[ -]4\.0"),
    ("cc-by-nc-4.0", "cc-by|cc by", r"\bcc[ -]by[ -]nc[ -]4\.0"),
    ("cc-by-nd-4.0", "cc-by|cc by", r"\bcc[ -]by[ -]nd[ -]4\.0"),
    ("cc-by-sa-4.0", "cc-by|cc by", r"\bcc[ -]by[ -]sa[ -]4\.0"),
    ("cc-by-sa-3.0", "cc-by|cc by", r"\bcc[ -]by[ -]sa[ -]3\.0"),
    ("cc-by-4.0", "cc-by|cc by|creative commons attribution", r"\bcc[ -]by[ -]4\.0|creative commons attribution 4\.0"),
    ("cc-by-3.0", "cc-by|cc by|creative commons attribution", r"\bcc[ -]by[ -]3\.0|creative commons attribution 3\.0"),
    ("cc-by-nc", "cc-by|cc by|creative commons attribution", r"\bcc[ -]by[ -]nc\b|creative commons attribution-noncommercial"),
    ("cc-by-sa", "cc-by|cc by|creative commons attribution", r"\bcc[ -]by[ -]sa\b|creative commons attribution-sharealike"),
    ("cc-by", "cc-by|cc by|creative commons attribution", r"\bcc[ -]by\b|creative commons attribution"),
    ("isc", "isc licen", r"\bisc licen[cs]e"),
    ("zlib", "zlib licen|zlib/libpng licen", r"\bzlib licen[cs]e|zlib/libpng licen[cs]e"),
    ("boost-1.0", "boost software licen", r"boost software licen[cs]e"),
    ("unlicense", "the unlicense", r"\bthe unlicense\b"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b"),
    ("artistic-2.0", "artistic licen", r"artistic licen[cs]e,? (?:version |v)?2(?:\.0)?"),
    ("artistic", "artistic licen", r"artistic licen[cs]e"),
    ("python-2.0", "python software foundation licen|psf licen", r"python software foundation licen[cs]e|\bpsf licen[cs]e"),
    ("ruby", "ruby licen", r"\bruby licen[cs]e"),
    ("php-3.0", "php licen", r"\bphp licen[cs]e"),
    ("openssl", "openssl licen", r"openssl licen[cs]e"),
    ("ofl-1.1", "open font licen|ofl-1.1|ofl 1.1", r"sil open font licen[cs]e|\bofl[ -]1\.1"),
    ("ms-pl", "microsoft public licen|ms-pl", r"microsoft public licen[cs]e|\bms-pl\b"),
    ("ms-rl", "microsoft reciprocal licen|ms-rl", r"microsoft reciprocal licen[cs]e|\bms-rl\b"),
    ("eupl-1.2", "eupl|european union public licen", r"european union public licen[cs]e|\beupl\b"),
    ("odbl-1.0", "open database licen|odbl", r"open database licen[cs]e|\bodbl\b"),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e"),
    ("ncsa", "ncsa open source licen|ncsa licen", r"university of illinois/ncsa open source licen[cs]e|\bncsa licen[cs]e"),
    ("bsl-1.1", "business source licen", r"business source licen[cs]e"),
    ("sspl-1.0", "server side public licen|sspl", r"server side public licen[cs]e|\bsspl\b"),
    ("elastic-2.0", "elastic licen", r"elastic licen[cs]e"),
    ("upl-1.0", "universal permissive licen", r"universal permissive licen[cs]e"),
    ("public-domain", " the public domain", r"(?:dedicated to|placed in|released (?:in)?to|in) the public domain"),
)
#: Texts and addresses of their own: label, keyword, regex.
TEXTS = (
    ("mit", "permission is hereby granted, free of charge", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission to use, copy", r"permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms"),
    ("all-rights-reserved", "all rights reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"proprietary and confidential"),
    ("apache-2.0", "apache.org/licenses", r"apache\.org/licenses/license-2\.0"),
    ("gpl", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", "gnu.org/licenses", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", "gnu.org/licenses", r"gnu\.org/licenses/agpl"),
    ("cc0-1.0", "creativecommons.org", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", "creativecommons.org", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "creativecommons.org", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nc", "creativecommons.org", r"creativecommons\.org/licenses/by-nc"),
    ("mit", "opensource.org/licenses", r"opensource\.org/licenses/mit"),
    ("mpl-2.0", "mozilla.org/mpl", r"mozilla\.org/mpl/2\.0"),
)
#: Of tiers 1, 2 and 3, and of a base phrase alone.
CONFIDENCE = (1.0, 0.9, 0.6)
BASE_CONFIDENCE = 0.5
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


#: What may stand between two words: white space, and the signs of a wrapped comment after it.
GAP = r"(?:\s[\s*#/;]*)"


def spaced(pattern: str) -> str:
    """A pattern whose blanks, but those in brackets, stand for any gap."""
    return re.sub(r"\[[^\]]*\]|\\s\+| ", lambda m: m[0] if m[0][0] == "[" else GAP, pattern)


def rules() -> list[tuple[int, str, str, str]]:
    """(tier, label, keywords, regex), several from each name."""
    made = []
    for label, word, name in NAMES:
        made += [
            (1, label, "spdx-licen", rf"spdx-licen[cs]e-identifier:\s*{label.replace('.', chr(92) + '.')}(?:-only|-or-later)?"),
            (2, label, word, rf"(?:licen[cs]ed|released|distributed|available|published|provided|covered)\s+(?:as is\s+)?(?:under|by)\s+(?:the\s+)?(?:terms\s+(?:and conditions\s+)?of\s+)?(?:the\s+)?(?:gnu\s+)?(?:{name})"),
            (2, label, word, rf"(?:under|subject to)\s+the\s+(?:terms|conditions|provisions)\s+of\s+(?:the\s+)?(?:gnu\s+)?(?:{name})"),
            (2, label, word, rf"licen[cs]e\s*[:=]\s*[\"']?(?:{name})"),
            (3, label, word, rf"(?:{name})"),
        ]
    made += [(2, label, word, text) for label, word, text in TEXTS]
    return [(tier, label, words, spaced(pattern)) for tier, label, words, pattern in made]


def pieces(keyword: str) -> list[str]:
    """What a text holds if it holds the keyword, whatever stands between its words; the piece
    that few texts hold first."""
    return sorted(keyword.split(), key=lambda w: ("licen" not in w, -len(w)))


def gate_words() -> list[str]:
    """Literals of which every keyword of every rule holds one."""
    words = {"licen"} | {w.strip() for _, _, keywords, _ in rules() for w in keywords.split("|")}
    return sorted(w for w in words if not any(v != w and v in w for v in words))


def holds(text: Column, keywords: list[str]) -> Column:
    """Whether the text holds all pieces of one of the keywords."""
    return F.exists(F.array(*[F.array(*map(F.lit, pieces(k))) for k in keywords]), lambda ws: F.forall(ws, lambda w: F.contains(text, w)))


def gated(text: Column) -> Column:
    return holds(text, gate_words())


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def places(text: Column, pattern: Column) -> Column:
    """(start, end) of all matches of a pattern, from what lies between them."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.split(text, pattern, -1)

    def at(i: Column) -> Column:
        start = F.length(F.array_join(F.slice(between, 1, i + 1), "")) + F.length(F.array_join(F.slice(found, 1, i), ""))
        return F.struct(start.alias("start"), (start + F.length(F.element_at(found, i + 1))).alias("end"))

    return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), F.size(found) - 1), at)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def detections(text: Column) -> Column:
    """array of (start, end, tier, label) that stand, by start."""
    table = F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(name).alias("label"), F.array(*[F.array(*map(F.lit, pieces(k))) for k in w.split("|")]).alias("words"), F.lit(r).alias("rule")) for t, name, w, r in rules()])
    tried = F.filter(table, lambda r: F.exists(r.words, lambda ws: F.forall(ws, lambda w: F.contains(text, w))))
    hits = F.flatten(F.transform(tried, lambda r: F.transform(places(text, r.rule), lambda p: F.struct(p.start.alias("start"), (-p.end).alias("back"), r.tier.alias("tier"), r.label.alias("label")))))
    empty = F.array().cast("array<struct<start:int,back:int,tier:int,label:string>>")

    def step(state: Column, h: Column) -> Column:
        reach = F.greatest(*[F.when(h.tier >= t, state[f"end{t}"]).otherwise(F.lit(0)) for t in (1, 2, 3)])
        stands = -h.back > reach
        ends = [F.when(stands & (h.tier == t), F.greatest(state[f"end{t}"], -h.back)).otherwise(state[f"end{t}"]).alias(f"end{t}") for t in (1, 2, 3)]
        return F.struct(*ends, F.when(stands, F.concat(state.kept, F.array(h))).otherwise(state.kept).alias("kept"))

    start = F.struct(*[F.lit(0).alias(f"end{t}") for t in (1, 2, 3)], empty.alias("kept"))
    return F.aggregate(F.array_sort(hits), start, step, lambda s: s.kept)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, n_words, n_base, first_word, last_word, base_labels, labels
    (arrays, sorted), found (start, end, tier, label), score.

    Null and empty texts have no words and score 0.  Very long texts are scanned whole;
    repeated rows are scanned alike; an empty table gives no rows; other columns are ignored.
    """
    lowered = F.coalesce(lower_ascii(F.col(f"`{text}`").cast("string")), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("id"), lowered.alias("low"))
    rows = rows.withColumn("norm", F.trim(F.regexp_replace("low", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")))
    spaces = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit("")))
    rows = rows.withColumn("n_words", F.when(F.col("norm") == "", 0).otherwise(spaces + 1).cast("long"))
    rows = rows.withColumn("padded", F.when(F.contains("norm", F.lit("license")), F.concat(F.lit(" "), F.col("norm"), F.lit(" ")))).drop("norm")
    counts, firsts, lasts, labels = [], [], [], []

    def spaces_in(part: Column) -> Column:
        return (F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))).cast("long")

    for phrase, label in PHRASES:
        there = F.contains("padded", F.lit(f" {phrase} "))
        before = F.substring_index("padded", f" {phrase} ", 1)
        after = F.substring_index("padded", f" {phrase} ", -1)
        counts.append(F.when(there, F.regexp_count("padded", F.lit(f" {phrase}(?= )"))).otherwise(0))
        firsts.append(F.when(there, spaces_in(before)))
        lasts.append(F.when(there, F.col("n_words") - spaces_in(after) - len(phrase.split()) - F.when(F.length(after) > 0, 0).otherwise(0)))
        labels.append(F.when(there, F.lit(label)))
    rows = rows.select("id", "low", "n_words", sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_sort(F.array_compact(F.array(*labels))).alias("base_labels"))
    none = F.array().cast("array<struct<start:int,back:int,tier:int,label:string>>")
    rows = rows.withColumn("hits", F.when(gated(F.col("low")), detections(F.col("low"))).otherwise(none))
    best = F.array_min(F.transform("hits", lambda h: h.tier))
    score = F.when(best == 1, CONFIDENCE[0]).when(best == 2, CONFIDENCE[1]).when(best == 3, CONFIDENCE[2]).when(F.col("n_base") > 0, BASE_CONFIDENCE).otherwise(0.0)
    return rows.select(
        F.col("id").alias(key), "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("hits", lambda h: h.label)))).alias("labels"),
        F.transform("hits", lambda h: F.struct(h.start.alias("start"), (-h.back).alias("end"), h.tier.alias("tier"), h.label.alias("label"))).alias("found"), score.alias("score"),
    )
