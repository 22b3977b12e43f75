"""Where queries are entered by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def enter(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return enter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: SQL pieces that several statements share.
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}\p{M}_]+')"
SENTENCES = r"string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
#: A lexicon from the corpus: terms of middling document frequency, dealt to four types.
LEXICON = rf"""lex_df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TOKENS}) AS term FROM documents) GROUP BY term),
    lexicon AS (SELECT term, 't' || ((row_number() OVER (ORDER BY df DESC, term) - 1) % 4) AS label, row_number() OVER (ORDER BY df DESC, term) - 1 AS ordinal
        FROM (SELECT * FROM lex_df WHERE df BETWEEN 20 AND 60 ORDER BY df DESC, term LIMIT 40))"""
