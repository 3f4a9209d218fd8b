"""The registered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lexical, licenses, mixing, mixing_lm, pseudonyms, quality, repeats, secrets, setjoin, sharding, spelling, token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    return mixing_lm.score(table(spark, sf_dir, "documents"), held_out=held).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x.kind.isin(*secrets.BASE))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("found", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, secrets.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"), secret="lectern-2026")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"), length=400)

    def covered(runs: str):
        return F.aggregate(runs, F.lit(0).cast("long"), lambda t, r: t + r.end - r.start)

    return rows.select("doc_id", "n_bytes", covered("runs").alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("kept_text").alias("text"), covered("passages").alias("n_passage_words"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = licenses.scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.compression_bands(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("in_band")).alias("kept"), "ratio", "bad_chunks")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_target_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.fit_mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.link_components(table(spark, sf_dir, "documents"), link=setjoin.Link(width=3, per_100=90)).select("doc_id", "n_shingles", "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_files(table(spark, sf_dir, "documents"))
    return token_files.read_files(spark, path).withColumnRenamed("key", "doc_id")


def op11_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rows = sharding.shuffled(table(spark, sf_dir, "documents"), shards=24)
    return rows.select("row.doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_context_mixing": op1_context_mixing,
        "op2_secret_scan": op2_secret_scan,
        "op3_pseudonyms": op3_pseudonyms,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_license_scan": op5_license_scan,
        "op6_quality_rules": op6_quality_rules,
        "op7_decontamination": op7_decontamination,
        "op8_target_mixture": op8_target_mixture,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_token_files": op10_token_files,
        "op11_hypergeometric_shards": op11_hypergeometric_shards,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_lexical_search": op13_lexical_search,
    }


#: Lower case over A-Z alone.
LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: op9: whole texts by distinct sets; links between sets of like size by shared shingles.
#: op12: a table of crc32 by recursion, a checksum for each distinct pair of document and run; near
#: words share what is left of them without one letter.
#: op13: scores of every pair of item and document that share a term.
SQL = {
    "op12_spelling_variants": r"""
        WITH RECURSIVE shift AS (
          SELECT range AS b, range AS v, 0 AS k FROM range(256)
          UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM shift WHERE k < 8),
        crc AS (SELECT list(v ORDER BY b) AS t FROM shift WHERE k = 8),
        run AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(LOWERED, '[A-Za-z\x{C0}-\x{FF}]+')) AS w FROM documents),
        own AS (SELECT doc, w, count(*) AS n FROM run GROUP BY ALL),
        code AS (SELECT doc, w, n, list_transform(string_split(doc || ':' || w, ''), lambda c: unicode(c)) AS points FROM own),
        bytes AS (SELECT doc, w, n, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END)) AS bs FROM code),
        hashed AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bs, lambda b: b::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h FROM bytes, crc),
        word AS (
          SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, sum(n)::BIGINT AS n
          FROM hashed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
        cut AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)),
        near AS (
          SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM cut a JOIN word b ON a.rest = b.word
          UNION SELECT b.word, a.word, a.n FROM cut a JOIN word b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS form, max(m) AS m FROM near GROUP BY word),
        formed AS (SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN form END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM word LEFT JOIN best ON word.word = best.word),
        chain AS (SELECT word, coalesce(form, word) AS root FROM formed UNION SELECT chain.word, formed.form FROM chain JOIN formed ON chain.root = formed.word WHERE form IS NOT NULL),
        ended AS (SELECT chain.word, chain.root FROM chain JOIN formed ON chain.root = formed.word WHERE form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN ended USING (word)
    """.replace("LOWERED", LOWER.format("text")),
    "op13_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(LOWERED, 'TERM') AS ts FROM documents),
        item AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(regexp_extract_all(LOWERED, 'TERM'))) AS t FROM benchmark),
        whole AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS size FROM d WHERE len(ts) > 0),
        tf AS (SELECT r, doc_id, len(ts) AS n, t, count(*) AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS t FROM d) GROUP BY r, doc_id, ts, t),
        df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
        w AS (SELECT t, floor(1000 * ln((2 * whole.n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, whole),
        x AS (SELECT r, doc_id, t, (1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * tf.n * whole.n) // size)) AS x FROM tf, whole),
        scored AS (SELECT q, item_id, r, doc_id, sum(w * x)::BIGINT AS score FROM item JOIN w USING (t) JOIN x USING (t) GROUP BY ALL HAVING sum(w * x) > 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 50
    """.replace("LOWERED", LOWER.format("text")).replace("TERM", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"),
    "op9_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
          SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (
          SELECT r, doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
            ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS shingles FROM w),
        kinds AS (SELECT min(r) AS k, list_sort(shingles) AS sorted FROM s WHERE len(shingles) > 0 GROUP BY 2),
        member AS (SELECT s.r, s.doc_id, len(shingles) AS n, k FROM s LEFT JOIN kinds ON list_sort(shingles) = sorted AND len(shingles) > 0),
        part AS (SELECT k, len(sorted) AS n, unnest(sorted) AS shingle FROM kinds),
        pairs AS (
          SELECT a.k AS x, b.k AS y FROM part a JOIN part b ON a.shingle = b.shingle AND a.k < b.k AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
          GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        links AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
        reach AS (SELECT k AS x, k AS y FROM kinds UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
        lowest AS (SELECT k, min(doc_id) AS low FROM member GROUP BY k),
        class AS (SELECT x AS k, min(low) AS component_id FROM reach JOIN lowest ON reach.y = lowest.k GROUP BY x)
        SELECT doc_id, n AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM member LEFT JOIN class USING (k)
    """,
}


def oracle_sql() -> dict[str, str]:
    return SQL
