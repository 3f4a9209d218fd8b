"""What the registered queries share: the registry, the tables, and the SQL of the text rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions import text as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


#: Printable ASCII, and the same in the broken font.
ASCII = "".join(map(chr, range(0x20, 0x7F)))
SHIFTED = "".join(chr(ord(c) - T.SHIFT) for c in ASCII)

# SQL of the text rules, for regular expressions without lookbehind
WORDS = "regexp_extract_all({0}, '[A-Za-zঀ-৿'']+')"
TOKENS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
SENTENCES = """list_filter(list_transform(string_split(regexp_replace({0}, '([.!?।]["”’'']?)\\s+', '\\1␞', 'g'), '␞'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"""
LENGTHS = f"list_filter(list_transform({SENTENCES}, lambda s: len({WORDS.format('s')})), lambda n: n > 0)"
NO_BANGLA = "regexp_replace({0}, '[ঀ-৿]+', ' ', 'g')"
