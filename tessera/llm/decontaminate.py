"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is a run of `span` item words (a shorter item is one window). Its words are ordered by their frequency in all
documents; since a window has to be contained whole, the prefix that a document must share is its single rarest word.
Documents are joined to windows on that word only; the place of the word in the window and the window's length bound
where it can stand, and the words there are compared exactly.

The benchmark is broadcast in blocks of a bounded number of words; one block is the usual case. With more, rows are
numbered and written once, the blocks follow each other, each written before the next one is broadcast, and only the
rows that a block hits are merged.

Inputs: null and empty texts have no words and are hit by nothing; items without words, or with a null id, are no
items; equal item texts count for each of their ids; repeated document rows are judged each; empty tables give no hits;
only the named columns are read, so further columns never clash. Long texts are handled whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Words in a window; a document is contaminated if one in so many of its words is hit; item words in a broadcast block.
SPAN, ONE_IN, BLOCK_WORDS = 13, 20, 1_000_000
#: Bytes of UTF-8 to word characters: ASCII letters in lower case, digits, and all beyond ASCII; the rest separates.
WORD_BYTES = bytes(b if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def windows_of(items: list[tuple[str, bytes]], span: int = SPAN) -> dict[tuple[bytes, ...], set[str]]:
    """Window -> ids of the items that hold it."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = words_of(text)
        for at in range(max(1, len(words) - span + 1) if words else 0):
            found.setdefault(tuple(words[at : at + span]), set()).add(item)
    return found


class Matcher:
    """Windows by their rarest word."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]], counts: dict[bytes, int]):
        self.windows = {w: tuple(ids) for w, ids in windows.items()}
        self.places: dict[bytes, list[tuple[int, int]]] = {}
        for w in windows:
            at = min(range(len(w)), key=lambda i: (counts.get(w[i], 0), w[i], i))
            found = self.places.setdefault(w[at], [])
            if (at, len(w)) not in found:
                found.append((at, len(w)))

    def match(self, text: bytes | None) -> tuple[int, list[int], list[str]]:
        """How many words, the places in words of those that are hit as start, end, start, ..., and the items."""
        words = words_of(text)
        n, places, windows = len(words), self.places, self.windows
        items: set[str] = set()
        spans: list[tuple[int, int]] = []
        for i in [i for i, w in enumerate(words) if w in places]:
            for offset, size in places[words[i]]:
                start = i - offset
                if start >= 0 and start + size <= n:
                    ids = windows.get(tuple(words[start : start + size]))
                    if ids is not None:
                        items.update(ids)
                        spans.append((start, start + size))
        flat: list[int] = []
        for a, b in sorted(spans):
            if flat and a <= flat[-1]:
                flat[-1] = max(flat[-1], b)
            else:
                flat += (a, b)
        return n, flat, sorted(items)


def word_counts(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """How often each word of a bounded vocabulary stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value.__contains__, Counter()
        for batch in batches:
            for part in common.slices(batch, "text"):
                for t in part.column(0).to_pylist():
                    counts.update(filter(known, words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in rows.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def _matched(docs: DataFrame, items: list[tuple[str, bytes]], span: int, text: str, key: str, whole: bool):
    """The matches of each row, and the broadcast that they need."""
    windows = windows_of(items, span)
    counts = word_counts(docs, {w for window in windows for w in window}, text) if windows else {}
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(windows, counts))

    def work():
        match = shared.value.match
        return lambda texts: list(zip(*map(match, texts), strict=True)) if texts else [[], [], []]

    return common.annotate(docs, text, key, "n_words long, spans array<long>, items array<string>", work, whole, as_bytes=True), shared


def _verdict(found: DataFrame, one_in: int) -> DataFrame:
    hit = F.expr("aggregate(transform(spans, (x, i) -> CASE WHEN i % 2 = 1 THEN x ELSE -x END), 0L, (a, x) -> a + x)")
    found = found.withColumn("n_hit", hit)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words")))


def find(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, one_in: int = ONE_IN, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, whole: bool = False) -> DataFrame:
    """(doc_id, n_words, spans, items, n_hit, contaminated) of each row; with `whole`, `row` instead of doc_id.

    spans: the word places that are hit, as start, end, start, ...; items: sorted ids of the items with windows there.
    """
    items = benchmark.select(F.col(item_key).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).filter("item IS NOT NULL AND text IS NOT NULL").distinct()
    # An upper bound of the words: every second byte could be one.
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // (2 * block_words)))
    held = lambda b: [(r["item"], r["text"].encode()) for r in items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()]
    if blocks == 1:
        return _verdict(_matched(docs, held(0), span, text, key, whole)[0], one_in)
    first = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if whole else F.col(f"`{key}`").cast("long")
    name = "row" if whole else "doc_id"
    rows = common.written(docs.select(F.monotonically_increasing_id().alias("no"), first.alias(name), F.col(f"`{text}`").cast("string").alias("text")), "rows")
    lengths = hits = None
    for b in range(blocks):
        found, shared = _matched(rows, held(b), span, "text", "no", False)
        found = common.written(found.filter("size(items) > 0") if lengths is not None else found, "block")
        shared.destroy()
        if lengths is None:
            lengths = found.select("doc_id", "n_words")
        part = found.filter("size(items) > 0").select(F.col("doc_id").alias("no"), "spans", "items")
        hits = part if hits is None else hits.unionByName(part)
    union = """aggregate(array_sort(transform(sequence(0, size(s) - 1, 2), i -> struct(get(s, i) AS a, get(s, i + 1) AS b))), cast(array() AS array<bigint>),
        (acc, x) -> CASE WHEN size(acc) > 0 AND x.a <= element_at(acc, -1) THEN concat(slice(acc, 1, size(acc) - 1), array(greatest(element_at(acc, -1), x.b))) ELSE concat(acc, array(x.a, x.b)) END)"""
    merged = hits.groupBy("no").agg(F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select("no", F.expr(union).alias("spans"), "items")
    out = rows.select("no", name).join(lengths.withColumnRenamed("doc_id", "no"), "no").join(merged, "no", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return _verdict(out.select(name, "n_words", none("spans", "bigint"), none("items", "string")), one_in)


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that are not contaminated, with their columns."""
    return find(docs, benchmark, whole=True, **options).filter(~F.col("contaminated")).select("row.*")


#: The normalised form of a word, for brute-force versions in tests: a fixed value of the contract.
WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
