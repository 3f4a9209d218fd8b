"""Corpus build: spans of pages to lesson-tagged, word-bounded chunks, for many books at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions import text as T
from ..functions.tables import settled, stored


def page_lines(spans: DataFrame) -> DataFrame:
    """book_id, page_no, k, line: the lines of each page, numbered from 1, from spans(book_id,
    page_no, block_no, line_no, span_no, block_type, text).  Spans are repaired and joined; lines
    without text drop.  Only the spans of one line are ever gathered."""
    by_line = spans.filter("block_type = 0").withColumn("text", T.repair_span(F.col("text"))).groupBy("book_id", "page_no", "block_no", "line_no")
    lines = by_line.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_no", "text"))), lambda s: s.text), "").alias("line"))
    parts = lines.filter(T.stripped(F.col("line")) != "").select("book_id", "page_no", "block_no", "line_no", F.posexplode(F.split("line", "\n")).alias("part", "line"))
    order = Window.partitionBy("book_id", "page_no").orderBy("block_no", "line_no", "part")
    return parts.select("book_id", "page_no", F.row_number().over(order).alias("k"), "line")


def assemble_pages(spans: DataFrame) -> DataFrame:
    """book_id, page_no, text: the lines of each page in one text."""
    return page_lines(spans).groupBy("book_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda s: s.line), "\n").alias("text"))


UNIT_ROW = "array<struct<unit_no int, title string, printed_page int, pos int>>"


def marked_lines(lines: DataFrame) -> DataFrame:
    """page_lines with what neighbours tell: kept (false for headers, footers and empty lines, of
    whatever unit), listed (the page begins with Contents), printed and footer_unit (a page number
    that has the line Unit and a unit number below it)."""
    order = Window.partitionBy("book_id", "page_no").orderBy("k")
    seen = lines.withColumn("before", F.lag("line").over(order)).withColumn("after", F.lead("line").over(order)).withColumn("below", F.lead("line", 2).over(order)).withColumn("top", F.first("line").over(order))

    def digits(x: Column) -> Column:
        return F.coalesce(F.rlike(T.stripped(x), F.lit(r"^\p{Nd}+$")), F.lit(False))

    number = digits(F.col("line")) & (F.col("after").eqNullSafe("Unit") | F.col("before").eqNullSafe("Unit"))
    unit = (F.col("line") == "Unit") & digits(F.col("after"))
    year = (F.col("k") == 1) & (F.col("line") == "2026")
    kept = ~(number | unit | year | (F.col("line") == "English for Today")) & (T.stripped(F.col("line")) != "")
    p, u = F.regexp_extract("line", r"(\d{1,9})\z", 1), F.regexp_extract("below", r"^(\d{1,9})", 1)
    foot = F.col("after").eqNullSafe("Unit") & (p != "") & (u != "")
    return seen.select(*lines.columns, kept.alias("kept"), F.startswith(T.stripped(F.col("top")), F.lit("Contents")).alias("listed"), F.when(foot, p.cast("int")).alias("printed"), F.when(foot, u.cast("int")).alias("footer_unit"))


def parsed_contents(lines: DataFrame) -> DataFrame:
    """book_id, units, error: the entries of the first page of each book that begins with
    Contents, read in order: a unit's name, its title, and the next line of digits, before which
    no other unit begins.  Only the lines of that page are gathered."""
    marked = lines if "listed" in lines.columns else marked_lines(lines)
    found = marked.filter("listed").select("book_id", "page_no", "k", T.stripped(F.col("line")).alias("line"))
    head = found.groupBy("book_id").agg(F.min("page_no").alias("page_no"))
    rows = found.filter("line <> ''").join(head, ["book_id", "page_no"], "left_semi").select("book_id", "k", "line")
    listed = rows.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x.line).alias("list"))
    nothing = F.struct(F.lit(None).cast("int").alias("unit_no"), F.lit(None).cast("string").alias("title"), F.array().cast(UNIT_ROW).alias("units"))

    def read(s: Column, line: Column) -> Column:
        found = F.regexp_extract(line, r"^Unit\s+(\d{1,9})$", 1)
        name = F.when(found != "", found.cast("int"))
        page = F.when(F.rlike(line, F.lit(r"^\d{1,9}$")), line.cast("int"))
        entry = F.struct(s.unit_no.alias("unit_no"), s.title.alias("title"), page.alias("printed_page"), F.size(s.units).alias("pos"))
        seeks = F.struct(name.alias("unit_no"), F.lit(None).cast("string").alias("title"), s.units.alias("units"))
        names = F.struct(s.unit_no.alias("unit_no"), line.alias("title"), s.units.alias("units"))
        closes = F.struct(F.lit(None).cast("int").alias("unit_no"), F.lit(None).cast("string").alias("title"), F.concat(s.units, F.array(entry)).alias("units"))
        return F.when(s.unit_no.isNull(), seeks).when(s.title.isNull(), names).when(page.isNull(), s).otherwise(closes)

    def ended(s: Column) -> Column:
        error = F.when(s.unit_no.isNotNull() & s.title.isNull(), F.format_string("contents: no title of unit %d", s.unit_no)).when(s.unit_no.isNotNull(), F.format_string("contents: no page of unit %d", s.unit_no))
        return F.struct(s.units.alias("units"), F.coalesce(error, F.when(F.size(s.units) == 0, "contents: no unit")).alias("error"))

    return listed.select("book_id", F.aggregate("list", nothing, read, ended).alias("r")).select("book_id", "r.*")


def contents(lines: DataFrame) -> DataFrame:
    """book_id, unit_no, title, printed_page, pos of the books whose contents can be read."""
    return parsed_contents(lines).filter("error is null").select("book_id", F.explode("units").alias("u")).select("book_id", "u.*")


def footers(marked: DataFrame) -> DataFrame:
    """book_id, page_no, printed, footer_unit: the first page number, line Unit and unit number
    of each page of marked_lines that has them one below the other."""
    rows = marked.filter("printed is not null").select("book_id", "page_no", F.struct("k", "printed", "footer_unit").alias("f"))
    return rows.groupBy("book_id", "page_no").agg(F.min("f").alias("f")).select("book_id", "page_no", "f.printed", "f.footer_unit")


def page_ranges(units: DataFrame, foot: DataFrame, totals: DataFrame) -> DataFrame:
    """book_id, unit_no, title, pos, first_page, last_page in pages of the file: the offset is
    that of the first page whose footer names the first unit's printed page and number."""
    order = Window.partitionBy("book_id").orderBy("pos")
    first = units.filter("pos = 0").select("book_id", F.col("unit_no").alias("footer_unit"), F.col("printed_page").alias("printed"))
    offsets = foot.join(first, ["book_id", "footer_unit", "printed"]).groupBy("book_id").agg(F.min(F.col("page_no") - F.col("printed")).alias("offset"))
    start = units.join(offsets, "book_id").join(totals, "book_id").withColumn("first_page", F.col("printed_page") + F.col("offset"))
    return start.select("book_id", "unit_no", "title", "pos", "first_page", F.coalesce(F.lead("first_page").over(order) - 1, F.col("total")).alias("last_page"), "total")


def pages_in(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """pages(book_id, page_no, ...) with the ranges they lie in.  Rows are dealt by book once, and
    what follows by unit or stage finds them there."""
    low, high = F.greatest(F.col("first_page"), F.lit(0)), F.least(F.col("last_page"), F.col("total"))
    return pages.join(ranges.filter(low <= high).drop("total"), "book_id").filter(F.col("page_no").between(F.col("first_page"), F.col("last_page")))


def misplaced_pages(ranges: DataFrame, foot: DataFrame) -> DataFrame:
    """Pages in a range whose footer names another unit; none in a sound book."""
    return pages_in(ranges, foot).filter("footer_unit <> unit_no").select("book_id", "page_no", "pos", "unit_no", "footer_unit")


def unit_lines(ranges: DataFrame, marked: DataFrame) -> DataFrame:
    """book_id, pos, unit_no, title, first_page, page_no, k, line: what stands in each unit,
    without headers, footers, repeated titles and empty lines."""
    return pages_in(ranges, marked.filter("kept").select("book_id", "page_no", "k", "line")).filter(~F.col("line").eqNullSafe(F.col("title")))


def books_with_text(ranges: DataFrame, marked: DataFrame) -> DataFrame:
    """book_id of the books that have a line in any unit, by the first and last line of each page
    in the order of letters: if one is not the title, the unit has text."""
    pages = marked.filter("kept").groupBy("book_id", "page_no").agg(F.min("line").alias("least"), F.max("line").alias("most"))
    return pages_in(ranges, pages).filter(~F.col("least").eqNullSafe(F.col("title")) | ~F.col("most").eqNullSafe(F.col("title"))).select("book_id").distinct()


ACTIVITY = r"(?U)^\s*\d+\.\d+(?!\.\d)"


def stage_lines(rows: DataFrame) -> DataFrame:
    """unit_lines with stage_no and heading: a numbered activity begins a stage, and so does what
    comes before the first one.  Rows of a unit are sorted, never gathered."""
    unit = Window.partitionBy("book_id", "pos").orderBy("page_no", "k")
    begins = F.rlike("line", F.lit(ACTIVITY + r"\s+\S")) | F.rlike("line", F.lit(ACTIVITY + r"\s*\z")) & F.lead("line").over(unit).isNotNull()
    slots = rows.withColumn("begins", begins.cast("int")).withColumn("slot", F.sum("begins").over(unit))
    stage = Window.partitionBy("book_id", "pos", "slot").orderBy("page_no", "k")
    numbered = slots.withColumn("stage_no", F.dense_rank().over(Window.partitionBy("book_id", "pos").orderBy("slot")))
    return numbered.withColumn("heading", F.first("line").over(stage)).drop("begins")


def piece_rows(rows: DataFrame, most: int = SETTINGS.chunk_words, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """The word windows of each stage: what every line gives to each window it touches is sent
    there, so a task never holds more than windows."""
    if overlap >= most:
        raise ValueError("overlap must be smaller than a window")
    stride = most - overlap
    keys = ["book_id", "pos", "slot"]
    stage = Window.partitionBy(*keys).orderBy("page_no", "k")
    counted = rows.withColumn("tokens", T.tokens(F.col("line"))).withColumn("n", F.size("tokens").cast("long"))
    placed = counted.withColumn("upto", F.sum("n").over(stage)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys))).withColumn("at", F.col("upto") - F.col("n"))
    last = F.when(F.col("total") <= most, F.lit(0).cast("long")).otherwise(F.ceil((F.col("total") - most) / stride))
    first_piece = F.when(F.col("at") < most, F.lit(0).cast("long")).otherwise(F.expr(f"(at - {most}) div {stride} + 1"))
    last_piece = F.least(last, F.expr(f"(upto - 1) div {stride}"))
    sent = placed.filter("n > 0").withColumn("piece", F.explode(F.sequence(first_piece, last_piece)))
    begin = F.greatest(F.col("piece") * stride - F.col("at"), F.lit(0))
    size = F.least(F.col("upto"), F.col("piece") * stride + most) - F.greatest(F.col("at"), F.col("piece") * stride)
    part = F.array_join(F.slice("tokens", (begin + 1).cast("int"), size.cast("int")), " ")
    named = ["unit_no", "title", "first_page", "stage_no"]
    grouped = sent.withColumn("part", part).groupBy(*keys, *named, "piece").agg(F.first("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x.part), " ").alias("body"))
    return grouped.withColumn("type", T.stage_type(F.col("heading"), F.col("stage_no"))).withColumn("piece", F.col("piece").cast("int"))


def stages(units: DataFrame) -> DataFrame:
    """One row per stage of whole unit texts: book_id, unit_no, title, first_page, stage_no, type, text."""
    rows = units.select("book_id", "unit_no", "title", "first_page", F.posexplode(T.split_stages(F.col("text"))).alias("k", "text"))
    return rows.withColumn("stage_no", F.col("k") + 1).withColumn("type", T.stage_type(F.col("text"), F.col("stage_no"))).drop("k")


def chunks(stage_rows: DataFrame, most: int = SETTINGS.chunk_words, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """Word-bounded pieces of whole stage texts, with their header, lesson id and chunk id."""
    return with_header(stage_rows.select("*", F.posexplode(T.chunk_words(F.col("text"), most, overlap)).alias("piece", "body")))


def with_header(rows: DataFrame) -> DataFrame:
    header = F.format_string("Unit %d, Lesson %d: %s\n", "unit_no", "stage_no", "title")
    return rows.select(
        F.concat_ws("/", "book_id", "unit_no", "stage_no", "piece").alias("chunk_id"), "book_id", F.concat(F.lit("u"), "unit_no", F.lit("-s"), "stage_no").alias("lesson_id"), F.col("unit_no").alias("unit"),
        F.col("stage_no").alias("lesson_no"), F.col("title").alias("lesson_title"), F.col("first_page").alias("page"), "type", F.concat(header, "body").alias("text"),
    )


@dataclass(frozen=True)
class Build:
    """chunks of the sound books; faults(book_id, reason) of all others; ranges of all whose
    contents and offset are known."""

    chunks: DataFrame
    faults: DataFrame
    ranges: DataFrame


def build_books(spans: DataFrame) -> Build:
    """Chunks of every sound book of spans, and the first reason against each of the others, in
    the order: contents, page offset, footers that name another unit, no text."""
    lines = stored(marked_lines(page_lines(spans)), "lines")
    foot = settled(footers(lines))
    read = settled(parsed_contents(lines))
    units = read.filter("error is null").select("book_id", F.explode("units").alias("u")).select("book_id", "u.*")
    totals = settled(spans.groupBy("book_id").agg(F.max("page_no").alias("total")))
    ranges = settled(page_ranges(units, foot, totals))
    known = totals.select("book_id").join(read.select("book_id", "error", F.lit(True).alias("read")), "book_id", "left")
    no_contents = known.filter("read is null or error is not null").select("book_id", F.lit(1).alias("step"), F.lit(0).alias("pos"), F.lit(0).alias("page_no"), F.coalesce("error", F.lit("contents: no page")).alias("reason"))
    unplaced = units.filter("pos = 0").join(ranges.select("book_id").distinct(), "book_id", "left_anti").select("book_id", F.lit(2).alias("step"), F.lit(0).alias("pos"), F.lit(0).alias("page_no"), F.format_string("offset: no footer of unit %d, printed page %d", "unit_no", "printed_page").alias("reason"))
    misplaced = misplaced_pages(ranges, foot).select("book_id", F.lit(3).alias("step"), "pos", F.col("page_no").cast("int").alias("page_no"), F.format_string("footer: page %d of unit %d names unit %d", F.col("page_no").cast("int"), "unit_no", "footer_unit").alias("reason"))
    early = settled(no_contents.unionByName(unplaced).unionByName(misplaced))
    sound = ranges.join(early.select("book_id").distinct(), "book_id", "left_anti")
    made = with_header(piece_rows(stage_lines(unit_lines(sound, lines))))
    empty = sound.select("book_id").distinct().join(books_with_text(sound, lines), "book_id", "left_anti").select("book_id", F.lit(4).alias("step"), F.lit(0).alias("pos"), F.lit(0).alias("page_no"), F.lit("no text in any unit").alias("reason"))
    first = early.unionByName(empty).groupBy("book_id").agg(F.min(F.struct("step", "pos", "page_no", "reason")).alias("f"))
    return Build(made, first.select("book_id", "f.reason"), ranges.drop("total"))


def build_chunks(spans: DataFrame) -> DataFrame:
    """The chunks of build_books; look there for what became of the other books."""
    return build_books(spans).chunks


def chunk_profile(chunk_rows: DataFrame) -> DataFrame:
    """Counts by book, unit and type, with subtotals, and the range of words."""
    n = F.size(T.tokens(T.body_of(F.col("text"))))
    return chunk_rows.withColumn("n", n).rollup("book_id", "unit", "type").agg(F.count("*").alias("chunks"), F.min("n").alias("least_words"), F.max("n").alias("most_words"))


def new_files(files: DataFrame, books: DataFrame) -> DataFrame:
    """Files(name, arrived, content) whose bytes no book has yet, the first of equal ones."""
    hashed = files.withColumn("file_hash", F.sha2("content", 256)).drop("content")
    fresh = hashed.join(books.select("file_hash"), "file_hash", "left_anti")
    return fresh.withColumn("k", F.row_number().over(Window.partitionBy("file_hash").orderBy("arrived", "name"))).filter("k = 1").drop("k")


def book_status(chunk_rows: DataFrame, book_ids: DataFrame) -> DataFrame:
    """book_id, chunk_count, status: ready, or failed where no chunk came out."""
    counts = chunk_rows.groupBy("book_id").agg(F.count("*").alias("chunk_count"))
    return book_ids.join(counts, "book_id", "left").select("book_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.when(F.col("chunk_count") > 0, "ready").otherwise("failed").alias("status"))


def write_chunks(chunk_rows: DataFrame, path: str) -> None:
    """Replace the partitions of the books in chunk_rows, all of a book or nothing."""
    chunk_rows.repartition("book_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)
