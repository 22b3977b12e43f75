"""A document store as a table of (id, text, embedding, metadata): append, get, delete, update, describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def appended(store: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The store and those new rows whose id it lacks; of new rows with one id any stays."""
    return store.unionByName(new.dropDuplicates([key]).join(store.select(key), key, "left_anti"))


def got(store: DataFrame, where: Column | None = None, limit: int | None = None, key: str = "id") -> DataFrame:
    out = store.filter(where) if where is not None else store
    return out.orderBy(key).limit(limit) if limit else out


def deleted(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return store.join(ids.select(key), key, "left_anti")


def updated(store: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Rows with the fields that a change gives (not null) in place of their own."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *(F.col(c).alias(f"__new_{c}") for c in fields))
    joined = store.join(renamed, key, "left")
    return joined.select(*(F.coalesce(f"__new_{c}", c).alias(c) if c in fields else F.col(c) for c in store.columns))


def described(store: DataFrame, group: str) -> DataFrame:
    return store.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def page_summary(chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct sources and categories, mean length."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.count_distinct("source").alias("n_sources"), F.count_distinct("category").alias("n_categories"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


def semantic_summary(chunks: DataFrame) -> DataFrame:
    """(intent, n, mean_chars, mean_noise) of each intent, means rounded half to even."""
    return chunks.groupBy("intent").agg(F.count("*").alias("n"), F.bround(F.avg("n_chars"), 2).alias("mean_chars"), F.bround(F.avg("noise"), 4).alias("mean_noise"))


def metadata(columns: dict[str, Column]) -> Column:
    """A flat map of strings for a store that knows no nesting: arrays and structs as JSON, null as an absent key."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def semantic_overview(chunks: DataFrame) -> DataFrame:
    """One row: chunks, their distinct sources, basins and regions (sorted), mean length and tokens (one digit, half to even), and the number of each intent."""
    known = lambda c: F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(c)
    intents = chunks.groupBy("intent").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("intent", "n")))).alias("intents"))
    whole = chunks.agg(F.count("*").alias("n_chunks"), known("source").alias("sources"), known("basin").alias("basins"), known("region").alias("regions"), F.bround(F.avg(F.length("content")), 1).alias("mean_chars"), F.bround(F.avg(F.floor(F.length("content") / 4)), 1).alias("mean_tokens"))
    return whole.join(F.broadcast(intents), how="cross")  # one row each


def as_dict(columns: list[str]) -> Column:
    """All fields of a row as JSON, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def as_schema(chunks: DataFrame) -> DataFrame:
    """Chunks in the exchanged form: id, headers, content, intent, at most five keywords, place in the hierarchy, sentences; fields that the chunks lack are null."""
    have = set(chunks.columns)
    field = lambda name, kind="string": F.col(name) if name in have else F.lit(None).cast(kind).alias(name)
    keywords = F.slice(field("semantic_keywords", "array<string>"), 1, 5).alias("semantic_keywords")
    return chunks.select(
        field("id", "long"), field("context_summary"), field("contextual_header"), field("content"), field("content_with_header"), field("intent").alias("intent_category"),
        keywords, field("level"), field("parent_id"), field("children_ids", "array<string>"), field("sentences", "array<string>"),
    )


def metrics_line(**values: Column) -> Column:
    """Measures as one line of `name: value`, three digits each, in the order given."""
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{k}: "), F.format_number(v, 3)) for k, v in values.items()))
