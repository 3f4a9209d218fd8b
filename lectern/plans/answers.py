"""Queries of what surrounds an answer: sources and context, verdicts, settings, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..functions.tables import settled, stored, work_path
from ..operators import chat, corpus, evaluation, fusion, retrieval, style, transcripts
from ..sources import files
from .queries import BODY, DENSE_SQL, FK_SQL, _vectors
from .registry import LENGTHS, NO_BANGLA, SQL, TOKENS, WORDS, documents, query, table


def placed_chunks(spark, sf_dir):
    """The five best vectors of each question, and all vectors as chunks with a place in a book."""
    questions, chunks = _vectors(spark, sf_dir)
    label = F.col("lesson_id").cast("int")
    placed = chunks.withColumn("unit", F.expr("cast(lesson_id as int) div 3 + 1")).withColumn("lesson_no", label % 3 + 1).withColumn("lesson_title", F.concat(F.lit("T"), "lesson_id")).withColumn("page", (F.col("chunk_id") % 50 + 1).cast("int"))
    hits = fusion.best_chunks(questions, chunks, 5, "dense")
    return hits.withColumn("sparse", F.lit(0.0)).withColumn("rrf", 1.0 / (60 + F.col("rank"))), placed.drop("embedding")


HITS_SQL = f"""d AS ({DENSE_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_id::VARCHAR) AS rank FROM d),
    h AS (SELECT query_id, chunk_id, rank, label, label // 3 + 1 AS unit, label % 3 + 1 AS lesson_no, chunk_id % 50 + 1 AS page, dense FROM r WHERE rank <= 5)"""


@query(
    "c9_sources",
    f"""WITH {HITS_SQL} SELECT query_id, count(*)::INTEGER AS n, md5(string_agg(concat_ws(':', rank, label, unit, lesson_no, 'T' || label, page, printf('%.6f', dense)), ',' ORDER BY rank)) AS sources_md5,
    first('Unit ' || unit || ', Lesson ' || lesson_no || ', page ' || page ORDER BY rank) AS citation FROM h GROUP BY query_id""",
)
def c9_sources(spark, sf_dir):
    """The best chunks of each question as its list of sources, and the first one in words."""
    hits, placed = placed_chunks(spark, sf_dir)
    listed = retrieval.sources(hits, placed)
    line = F.transform("sources", lambda s: F.concat_ws(":", s["rank"].cast("string"), s.lesson_id, s.unit.cast("string"), s.lesson_no.cast("string"), s.lesson_title, s.page.cast("string"), F.format_string("%.6f", s.dense)))
    return listed.select("query_id", F.size("sources").alias("n"), F.md5(F.array_join(line, ",").cast("binary")).alias("sources_md5"), retrieval.citation(F.col("sources")).alias("citation"))


@query(
    "c11_context_parts",
    f"""WITH {HITS_SQL}, l AS (SELECT DISTINCT query_id, label FROM h),
    p AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY e.label // 3 + 1, e.label % 3 + 1, e.vec_id % 50 + 1, e.vec_id::VARCHAR) AS position, coalesce(text, '') AS text FROM l JOIN embeddings e ON e.label = l.label LEFT JOIN documents ON doc_id = vec_id),
    n AS (SELECT query_id, position, '[' || position || '] ' || text AS entry FROM p),
    b AS (SELECT *, coalesce(sum(strlen(entry) + 2) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 65536 AS part FROM n)
    SELECT query_id, part::INTEGER AS part, count(*) AS chunks, (sum(strlen(entry) + 2) - 2)::BIGINT AS bytes, md5(string_agg(entry, chr(10) || chr(10) ORDER BY position)) AS context_md5 FROM b GROUP BY query_id, part""",
)
def c11_context_parts(spark, sf_dir):
    """The whole parent lessons of each question's hits, numbered, in parts of bounded size."""
    hits, placed = placed_chunks(spark, sf_dir)
    texts = documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "text")
    lessons = settled(retrieval.lessons_of(hits, placed))
    alike = retrieval.same_lessons(lessons)
    once = lessons.join(alike.select(F.col("same_as").alias("query_id")).distinct(), "query_id", "left_semi")
    parts = retrieval.lesson_context_parts(once, placed.join(texts, "chunk_id", "left")).select(F.col("query_id").alias("same_as"), "part", "chunks", "bytes", F.md5(F.col("context").cast("binary")).alias("context_md5"))
    return alike.select("query_id", "same_as").join(parts, "same_as").drop("same_as")


@query("d10_session_messages", "SELECT conv_id AS session_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 2, CASE WHEN role = 'user' THEN 0 ELSE 1 END, turn)::INTEGER AS place FROM conversations")
def d10_session_messages(spark, sf_dir):
    """Messages of all sessions in order; two turns share a time."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("turn").alias("ordinal"), F.timestamp_seconds(F.expr("1700000000 + turn div 2")).alias("created_at"))
    return chat.ordered_messages(rows).select("session_id", "turn", "place")


JUDGED = Settings(most_sentence_words=60, most_grade=30.0, least_coverage=0.2)


@query(
    "e12_judged_reports",
    f"""WITH e AS (SELECT *, (string_split(message_id, '/')[1]::INT + string_split(message_id, '/')[2]::INT) % 5 AS kind, max_sentence_words > 60 OR coverage < 0.2 OR coalesce(fk_grade, 0) > 30 AS fails FROM ({SQL['e11_style_reports']}))
    SELECT message_id, NOT fails AND kind < 4 AS judge_ran, CASE WHEN NOT fails THEN CASE kind WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END END AS judge_suitable, CASE WHEN NOT fails THEN CASE kind WHEN 0 THEN 'fits' WHEN 1 THEN 'too hard' END END AS judge_reason,
    CASE WHEN NOT fails AND kind = 3 THEN 'suitable: yes' END AS unparsed, NOT fails AND kind IN (0, 2, 4) AS passed FROM e""",
)
def e12_judged_reports(spark, sf_dir):
    """Reports on all assistant messages with verdicts plain, fenced, unreadable or missing."""
    rows = table(spark, sf_dir, "conversations")
    book = rows.filter("role = 'user'").select(F.lit("b").alias("book_id"), "text")
    none = spark.createDataFrame([], "grade int, teacher_answer string, provenance string")
    answers = rows.filter("role = 'assistant'").select(F.concat_ws("/", "conv_id", "turn").alias("message_id"), F.lit("b").alias("book_id"), F.col("text").alias("answer"), ((F.col("conv_id") + F.col("turn")) % 5).alias("kind"))
    said = F.when(F.col("kind") == 0, '{"suitable": true, "reason": "fits"}').when(F.col("kind") == 1, '```json\n{"suitable": false, "reason": "too hard"}\n```').when(F.col("kind") == 2, ' ```{"suitable": true, "reason": null}``` ').when(F.col("kind") == 3, "suitable: yes")
    verdicts = answers.select("message_id", said.alias("text")).filter("text is not null")
    return style.style_reports(answers.drop("kind"), style.vocabulary(book, none, 5), verdicts, limits=JUDGED).select("message_id", "judge_ran", "judge_suitable", "judge_reason", "unparsed", "passed")


@query(
    "e8_vocabulary",
    f"""WITH b AS (SELECT DISTINCT conv_id % 3 AS book, unnest({WORDS.format("lower(regexp_replace(text, '^[^' || chr(10) || ']*' || chr(10), ''))")}) AS word FROM conversations WHERE role = 'user'),
    f AS (SELECT DISTINCT unnest({WORDS.format('lower(text)')}) AS word FROM conversations WHERE role = 'assistant' AND conv_id % 4 = 1)
    SELECT book::VARCHAR AS book_id, word FROM b UNION ALL SELECT NULL, word FROM f""",
)
def e8_vocabulary(spark, sf_dir):
    """Words of three books, and of the sample answers of grade 5."""
    rows = table(spark, sf_dir, "conversations")
    book = rows.filter("role = 'user'").select((F.col("conv_id") % 3).cast("string").alias("book_id"), "text")
    samples = rows.filter("role = 'assistant'").select((F.col("conv_id") % 4 + 4).cast("int").alias("grade"), F.col("text").alias("teacher_answer"), F.lit("real").alias("provenance"))
    style.load_fewshot(samples, 5)
    return style.vocabulary(book, samples, 5)


@query(
    "e15_guide_profiles",
    """SELECT doc_id, concat_ws('; ', 'Source: ' || source, CASE WHEN doc_id % 2 = 0 THEN 'Letters: ' || n_chars END) AS profile, md5('## 2. Text' || chr(10) || 'L ' || doc_id) AS section_md5 FROM documents""",
)
def e15_guide_profiles(spark, sf_dir):
    """A guide for each document, with a table of grades and a section of text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    mine = F.concat(F.lit("| 5 | "), "source", F.lit(" | "), F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string")).otherwise(""), F.lit(" |"))
    guide = F.concat(F.lit("# Guide\n\n## 1. Grades\n\n| Grade | Source | Letters |\n|---|---|---|\n| 4 | other | 1 |\n"), mine, F.lit("\n\n---\n\n## 2. Text\nL "), F.col("doc_id").cast("string"), F.lit("\n\n---\n"))
    read = rows.select("doc_id", style.guide_sections(guide).alias("s"))
    return read.select("doc_id", style.grade_profile(F.col("s")[1], 5).alias("profile"), F.md5(F.col("s")[2].cast("binary")).alias("section_md5"))


@query(
    "g13_changed_settings",
    """WITH s AS (SELECT doc_id % 7 AS run, count(*) AS n, max(n_chars) AS longest, min(source) AS src FROM documents GROUP BY 1),
    p AS (SELECT run, unnest([{'name': '$.top_k', 'v': (run % 3)::VARCHAR}, {'name': '$.sizes.n', 'v': n::VARCHAR}, {'name': '$.sizes.longest', 'v': longest::VARCHAR}, {'name': '$.sizes.parts[0]', 'v': run::VARCHAR}, {'name': '$.sizes.parts[1].src', 'v': '"' || src || '"'}, {'name': '$.none', 'v': 'null'}]) AS x FROM s
      UNION ALL SELECT run, {'name': '$.odd', 'v': 'true'} FROM s WHERE run % 2 = 1),
    f AS (SELECT run, x.name AS name, x.v AS v FROM p)
    SELECT r.other AS run, coalesce(a.name, b.name) AS name, a.v AS one, b.v AS other FROM (VALUES (1), (2), (3)) r(other) JOIN f b ON b.run = r.other LEFT JOIN f a ON a.run = 0 AND a.name = b.name WHERE a.v IS DISTINCT FROM b.v""",
)
def g13_changed_settings(spark, sf_dir):
    """Nested settings of runs over the documents: where runs 1 to 3 differ from run 0."""
    runs = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 7).cast("int").alias("k")).agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"), F.min("source").alias("src"))
    odd = F.when(F.col("k") % 2 == 1, F.lit(', "odd": true')).otherwise("")
    text = F.format_string('{"top_k": %d, "sizes": {"n": %d, "longest": %d, "parts": [%d, {"src": "%s"}]}, "none": null%s}', F.col("k") % 3, "n", "longest", "k", "src", odd)
    manifests = runs.select(F.col("k").cast("string").alias("run_id"), text.alias("settings"))
    out = None
    for k in (1, 2, 3):
        part = evaluation.changed_settings(manifests, "0", str(k)).select(F.lit(k).alias("run"), "name", "one", "other")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "h6_bangla_words",
    f"""WITH w AS (SELECT unnest({WORDS.format("text || ' আমি ভাত-' || 'কখগঘ'[doc_id % 4 + 1] || ' খাই।'")}) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE regexp_matches(word, '[ঀ-৿]') GROUP BY word ORDER BY n DESC, word LIMIT 20""",
)
def h6_bangla_words(spark, sf_dir):
    """The commonest Bangla words of all documents, with a Bangla sentence after each."""
    letter = F.substr(F.lit("কখগঘ"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1))
    rows = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("file"), F.concat("text", F.lit(" আমি ভাত-"), letter, F.lit(" খাই।")).alias("text"))
    return transcripts.top_words(rows, 20, bangla=True)


@query(
    "h7_trust_warnings",
    f"""WITH h AS ({SQL['h2_file_stats']}), b AS (SELECT doc_id, {BODY} AS body FROM documents), t AS (SELECT doc_id, body, {NO_BANGLA.format('body')} AS t FROM b),
    g AS (SELECT doc_id, body, CASE WHEN len({TOKENS.format('t')}) >= 30 AND len({WORDS.format('t')}) > 0 THEN {FK_SQL} END AS fk FROM t)
    SELECT doc_id, concat_ws('; ', CASE WHEN punct_per_100w < 8 THEN 'few sentence marks' END, CASE WHEN max_words > 60 THEN 'a missing full stop' END, CASE WHEN fk IS NULL OR fk NOT BETWEEN -5 AND 25 THEN 'no reading grade' END, CASE WHEN NOT regexp_matches(body, '[ঀ-৿]') THEN 'no Bangla' END) AS warnings FROM h JOIN g USING (doc_id)""",
)
def h7_trust_warnings(spark, sf_dir):
    """What makes the numbers of each document doubtful."""
    stats = transcripts.file_stats(documents(spark, sf_dir).select(F.col("doc_id").alias("file"), "text"), 6)
    return stats.select(F.col("file").alias("doc_id"), F.array_join(transcripts.warnings(), "; ").alias("warnings"))


@query(
    "h8_thresholds_table",
    f"""WITH c AS ({SQL['h3_combined_stats']}), l AS (SELECT unnest({LENGTHS.format('body')}) AS x FROM (SELECT {BODY} AS body FROM documents)), o AS (SELECT x, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS n FROM l),
    p AS (SELECT max(x) FILTER (k = greatest(1, floor(0.95::DOUBLE * n))) AS p95, max(n) AS measured, avg(x) AS mean FROM o)
    SELECT unnest(range(5))::INTEGER AS row, unnest([printf('| Max sentence length | %d words | 95th percentile of %d sentences |', p95, measured), printf('| Mean sentence length | %.1f words | mean over %d transcripts |', mean, files), '| Bangla word ratio | 0.0% | Bangla words of all words |',
      printf('| Reading grade | %.2f | all transcripts together |', fk_grade), printf('| Corpus size | %d words | %d transcripts |', words, files)]) AS line FROM c, p""",
)
def h8_thresholds_table(spark, sf_dir):
    """The table of thresholds over all documents as transcripts."""
    return transcripts.thresholds_table(transcripts.combined_stats(documents(spark, sf_dir).select(F.col("doc_id").alias("file"), "text")))


@query("a8_known_files", "SELECT sha256(text) AS file_hash, min(doc_id) AS doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 1")
def a8_known_files(spark, sf_dir):
    """Documents as uploads where books of every third one exist already."""
    uploads = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("name"), F.col("doc_id").alias("arrived"), F.col("text").cast("binary").alias("content"))
    books = documents(spark, sf_dir).filter("doc_id % 3 = 0").select(F.sha2("text", 256).alias("file_hash"))
    return corpus.new_files(uploads, books).select("file_hash", F.col("arrived").alias("doc_id"))


@query("a9_media_listing", "SELECT source, (sum(strlen(text) + 1) / 1e6)::DOUBLE AS megabytes FROM documents GROUP BY source")
def a9_media_listing(spark, sf_dir):
    """Documents written as files by source, listed by metadata: megabytes of each folder."""
    path = work_path(spark, "media")
    documents(spark, sf_dir).select("source", "text").write.partitionBy("source").text(path)
    listed = files.media_files(spark, path, ("txt",))
    return listed.groupBy(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source")).agg((F.sum("length") / 1e6).alias("megabytes"))


@query("a10_manifest_summary", "SELECT CASE WHEN n_chars = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'skipped' ELSE 'done' END AS status, count(*) AS n FROM documents GROUP BY 1")
def a10_manifest_summary(spark, sf_dir):
    status = F.when(F.col("n_chars") == 0, "failed").when(F.col("doc_id") % 3 == 0, "skipped").otherwise("done")
    return files.manifest_summary(table(spark, sf_dir, "documents").select(status.alias("status")))


BEST = 10


@query(
    "c2_sparse_top",
    f"""WITH w AS (SELECT doc_id, unnest({WORDS.format('lower(text)')}) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS tf FROM w GROUP BY ALL), s AS (SELECT doc_id, sum(tf) AS size FROM c GROUP BY ALL),
    b AS (SELECT count(*) AS n, avg(size) AS mean FROM s), f AS (SELECT token, count(*) AS df FROM c GROUP BY ALL),
    p AS (SELECT doc_id, token, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean)) AS weight FROM c JOIN s USING (doc_id) JOIN f USING (token), b),
    x AS (SELECT q.doc_id AS query_id, p.doc_id AS chunk_id, round(sum(q.tf * p.weight), 6) AS sparse FROM c q JOIN p USING (token) WHERE q.doc_id % 20 = 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sparse DESC, chunk_id::VARCHAR) AS rank FROM x)
    SELECT query_id, rank::INTEGER AS rank, chunk_id, round(sparse, 3) AS sparse FROM r WHERE rank <= {BEST}""",
)
def c2_sparse_top(spark, sf_dir):
    """Every twentieth document as a question to all of them, by lexical weights."""
    chunks = documents(spark, sf_dir).select(F.lit("b").alias("book_id"), F.col("doc_id").alias("chunk_id"), "text")
    terms = stored(retrieval.lexical_terms(chunks), "terms")
    sizes = retrieval.book_sizes(terms)
    part = F.transform("terms", lambda t: F.struct(t.token.alias("token"), retrieval.saturated(t.tf, F.col("size"), F.col("mean")).alias("weight")))
    weighed = terms.join(sizes, "book_id").select("book_id", "chunk_id", part.alias("sparse"))
    asked = terms.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "book_id", F.explode("terms").alias("t")).select("query_id", "book_id", "t.token", "t.tf")
    rated = asked.join(retrieval.token_spread(terms), ["book_id", "token"]).join(sizes, "book_id")
    weight = F.col("tf") * retrieval.idf(F.col("n"), F.col("df"))
    questions = rated.groupBy("query_id", "book_id").agg(F.collect_list(F.struct("token", weight.alias("weight"))).alias("sparse"))
    best = fusion.best_chunks(questions, weighed, BEST, "sparse")
    return best.select("query_id", "rank", "chunk_id", F.round("sparse", 3).alias("sparse"))
