"""Queries of the corpus build: books set from the documents, some of them faulty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import stored, work_path
from ..operators import corpus
from ..sources import chunk_store
from .registry import ASCII, SHIFTED, TOKENS, documents, query

#: Documents of a book, lines of a page, lines from one numbered activity to the next.
UNITS, PAGE, ACTIVITY = 5, 20, 7
#: What is wrong with a book by its number modulo 6: no page number of its last unit, footers of
#: its second unit that name another, no contents, footers with other page numbers.
SOUND, NO_NUMBER, WRONG_FOOTER, NO_CONTENTS, NO_FOOTER = (0, 1), 2, 3, 4, 5


def spans(spark, sf_dir) -> DataFrame:
    """Spans of books whose units are documents: a contents page, then pages of twenty lines with
    running header, footer and repeated title; activities are numbered, every line comes in two
    spans, and second spans of letters and full stops stand in the broken font."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    docs = documents(spark, sf_dir).select("doc_id", F.expr(f"doc_id div {UNITS}").alias("book"), F.expr(f"cast(doc_id div {UNITS} as string)").alias("book_id"), (F.col("doc_id") % UNITS + 1).cast("int").alias("unit"), lines.alias("lines"))
    sized = docs.withColumn("pages", F.ceil(F.size("lines") / PAGE).cast("int"))
    before = F.coalesce(F.sum("pages").over(Window.partitionBy("book_id").orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    units = sized.select("*", (before + 1).cast("int").alias("printed"), F.concat(F.lit("Reading "), "doc_id").alias("title"), (F.col("book") % 6).alias("kind"), (F.max("unit").over(Window.partitionBy("book_id")) == F.col("unit")).alias("is_last"))

    def span(block: int | str, line, text, kind: int = 0):
        return F.struct(F.lit(block).cast("int").alias("block_no") if isinstance(block, int) else F.col(block).alias("block_no"), line.cast("int").alias("line_no"), F.lit(0).alias("span_no"), F.lit(kind).alias("block_type"), text.cast("string").alias("text"))

    number = F.when((F.col("kind") == NO_NUMBER) & F.col("is_last"), F.lit("")).otherwise(F.col("printed").cast("string"))
    entry = F.array(span("unit", F.lit(0), F.concat(F.lit("Unit "), "unit")), span("unit", F.lit(1), F.col("title")), span("unit", F.lit(2), number))
    listed = units.filter(F.col("kind") != NO_CONTENTS).select("book_id", F.lit(1).alias("page_no"), F.explode(F.when(F.col("printed") == 1, F.concat(F.array(span(0, F.lit(0), F.lit("Contents"))), entry)).otherwise(entry)).alias("s"))

    paged = units.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("pages") - 1))).withColumn("page_no", F.col("printed") + F.col("p") + 1)
    foot = F.col("printed") + F.col("p") + F.when(F.col("kind") == NO_FOOTER, 1000).otherwise(0)
    named = F.col("unit") + F.when((F.col("kind") == WRONG_FOOTER) & (F.col("unit") == 2), 7).otherwise(0)
    year = F.when(F.col("page_no") % 3 == 0, F.lit("2026")).otherwise(F.lit(""))
    furniture = F.array(span(0, F.lit(0), year), span(0, F.lit(1), F.lit("English for Today")), span(2, F.lit(0), foot), span(2, F.lit(1), F.lit("Unit")), span(2, F.lit(2), named), span(2, F.lit(3), F.col("title")), span(3, F.lit(0), F.lit("picture"), 1))
    around = paged.select("book_id", "page_no", F.explode(furniture).alias("s"))

    rows = paged.select("book_id", "page_no", "unit", F.posexplode(F.slice("lines", F.col("p") * PAGE + 1, F.lit(PAGE))).alias("line_no", "line"), (F.col("p") * PAGE).alias("first"))
    i = F.col("first") + F.col("line_no")
    has_text = F.rlike("line", F.lit(r"(?U)\S"))
    line = F.when(has_text & (i % ACTIVITY == 0), F.concat(F.col("unit").cast("string"), F.lit("."), (i + 1).cast("string"), F.lit(" "), "line")).otherwise(F.col("line"))
    half = F.expr("length(line) div 2")
    lined = rows.withColumn("line", line).withColumn("one", F.left("line", half)).withColumn("two", F.substr("line", half + 1))
    broken = F.when(F.rlike("two", F.lit(r"^[a-zA-Z. ]*\.[a-zA-Z. ]*$")), F.translate("two", ASCII, SHIFTED)).otherwise(F.col("two"))
    halves = F.array(*[F.struct(F.lit(1).alias("block_no"), F.col("line_no"), F.lit(k).alias("span_no"), F.lit(0).alias("block_type"), t.alias("text")) for k, t in enumerate((F.col("one"), broken))])
    body = lined.select("book_id", "page_no", F.explode(halves).alias("s"))
    return listed.unionByName(around).unionByName(body).select("book_id", "page_no", "s.*")


UNIT_SQL = f"""d AS (SELECT doc_id, doc_id // {UNITS} AS book, doc_id % {UNITS} + 1 AS unit, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    u AS (SELECT *, book % 6 AS kind, 'Reading ' || doc_id AS title, 2 + coalesce(sum((len(l) + {PAGE - 1}) // {PAGE}) OVER (PARTITION BY book ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page, (len(l) + {PAGE - 1}) // {PAGE} AS pages FROM d)"""


@query(
    "b6_unit_ranges",
    f"""WITH {UNIT_SQL} SELECT book::VARCHAR AS book_id, unit::INTEGER AS unit_no, title, page::INTEGER AS first_page, (page + pages - 1)::INTEGER AS last_page FROM u WHERE kind IN (0, 1, {WRONG_FOOTER})""",
)
def b6_unit_ranges(spark, sf_dir):
    """First and last page of every unit, of the books whose contents and offset can be read."""
    ranges = corpus.build_books(spans(spark, sf_dir)).ranges
    return ranges.select("book_id", "unit_no", "title", "first_page", "last_page")


@query(
    "b7_book_faults",
    f"""WITH {UNIT_SQL} SELECT book::VARCHAR AS book_id, CASE kind WHEN {NO_NUMBER} THEN 'contents: no page of unit ' || max(unit) WHEN {WRONG_FOOTER} THEN 'footer: page ' || max(CASE WHEN unit = 2 THEN page END) || ' of unit 2 names unit 9'
    WHEN {NO_CONTENTS} THEN 'contents: no page' ELSE 'offset: no footer of unit 1, printed page 1' END AS reason FROM u WHERE kind > 1 GROUP BY book, kind HAVING kind <> {WRONG_FOOTER} OR max(unit) >= 2""",
)
def b7_book_faults(spark, sf_dir):
    """Why each faulty book gives no chunks; sound books are not listed."""
    return corpus.build_books(spans(spark, sf_dir)).faults


@query(
    "b14_build_chunks",
    f"""WITH {UNIT_SQL}, ok AS (SELECT * FROM u WHERE kind IN (0, 1) OR kind = {WRONG_FOOTER} AND (SELECT max(x.unit) FROM u x WHERE x.book = u.book) < 2),
    r AS (SELECT book, unit, title, page, unnest(range(len(l))) AS i, unnest(l) AS line FROM ok),
    m AS (SELECT *, CASE WHEN i % {ACTIVITY} = 0 THEN unit || '.' || (i + 1) || ' ' || line ELSE line END AS full_line, sum(CASE WHEN i % {ACTIVITY} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book, unit ORDER BY i) AS slot FROM r WHERE regexp_matches(line, '\\S')),
    s AS (SELECT book, unit, title, page, slot, lower(first(full_line ORDER BY i)) AS heading, string_agg(full_line, ' ' ORDER BY i) AS text FROM m GROUP BY ALL),
    t AS (SELECT *, dense_rank() OVER (PARTITION BY book, unit ORDER BY slot) AS stage, {TOKENS.format('text')} AS w FROM s),
    p AS (SELECT *, unnest(range(0, CASE WHEN len(w) <= 600 THEN 1 ELSE 1 + CAST(ceil((len(w) - 600) / 550.0) AS BIGINT) END)) AS piece FROM t)
    SELECT book || '/' || unit || '/' || stage || '/' || piece AS chunk_id, book::VARCHAR AS book_id, 'u' || unit || '-s' || stage AS lesson_id, unit::INTEGER AS unit, stage::INTEGER AS lesson_no, title AS lesson_title, page::INTEGER AS page,
    CASE WHEN regexp_matches(heading, 'new words|word meaning|vocabulary') THEN 'vocabulary' WHEN stage = 1 OR contains(heading, 'language focus') THEN 'passage' ELSE 'exercise' END AS type,
    md5('Unit ' || unit || ', Lesson ' || stage || ': ' || title || chr(10) || array_to_string(w[piece * 550 + 1 : piece * 550 + 600], ' ')) AS text_md5 FROM p""",
)
def b14_build_chunks(spark, sf_dir):
    """Spans of all books to chunks, by whole texts."""
    chunks = corpus.build_books(spans(spark, sf_dir)).chunks
    return chunks.select("chunk_id", "book_id", "lesson_id", "unit", "lesson_no", "lesson_title", "page", "type", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "a7_chunk_store",
    f"""WITH {UNIT_SQL}, b AS (SELECT book, max(unit) AS units, max(kind) AS kind FROM u GROUP BY book),
    r AS (SELECT book, unit, unnest(range(len(l))) AS i, unnest(l) AS line FROM u),
    m AS (SELECT *, sum(CASE WHEN i % {ACTIVITY} = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY book, unit ORDER BY i) AS slot FROM r WHERE regexp_matches(line, '\\S')),
    s AS (SELECT book, unit, slot, len({TOKENS.format("string_agg(CASE WHEN i % 7 = 0 THEN '0.0 ' || line ELSE line END, ' ')")}) AS n FROM m GROUP BY ALL),
    c AS (SELECT book, sum(CASE WHEN n <= 600 THEN 1 ELSE 1 + CAST(ceil((n - 600) / 550.0) AS BIGINT) END)::BIGINT AS n FROM s GROUP BY book)
    SELECT book::VARCHAR AS book_id, CASE WHEN kind IN (0, 1) OR kind = {WRONG_FOOTER} AND units < 2 THEN 'ready' ELSE 'failed' END AS status, CASE WHEN kind IN (0, 1) OR kind = {WRONG_FOOTER} AND units < 2 THEN c.n ELSE 0 END AS chunk_count,
    CASE WHEN kind IN (0, 1) OR kind = {WRONG_FOOTER} AND units < 2 THEN c.n ELSE 0 END AS chunks_read, 2::BIGINT AS version FROM b LEFT JOIN c USING (book)""",
)
def a7_chunk_store(spark, sf_dir):
    """All books published twice, the second time with their chunks in other batches; status and
    counts as recorded, and chunks as read back, of the latest version."""
    build = corpus.build_books(spans(spark, sf_dir))
    made, path = stored(build.chunks, "chunks"), work_path(spark, "store")
    chunk_store.publish(made.withColumn("text", F.lit("old")), build.faults, path)
    version = chunk_store.publish(made, build.faults, path)
    read = chunk_store.chunks(spark, path).filter("text <> 'old'").groupBy("book_id").agg(F.count("*").alias("n"))
    state = chunk_store.books(spark, path)
    return state.join(read, "book_id", "left").select("book_id", "status", "chunk_count", F.coalesce("n", F.lit(0)).alias("chunks_read"), F.lit(version).cast("long").alias("version"))
