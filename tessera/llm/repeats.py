"""Substring dedup by hashing of lines and the clauses in them.

A text is cut into units behind line ends and behind . ! ? , ; : with white space. A unit is normalised (A-Z in lower
case, white space runs as one blank) and taken with as many units before it as it takes to have `least` words; that run
is known by its digest. Digests are grouped over all documents. The earliest occurrence, by document id and then place,
is kept; every other one counts as repeated. Repeated runs of a document that overlap or follow each other are one span;
spans of at least `span` words are reported with their place in the original text, in code points, end exclusive. So short
units inside a repeated passage are found, and short phrases that recur by chance are not.

Inputs: null and empty texts have no units; rows with equal keys are one document, of which each row keeps what is
earliest (their spans are united, so they should have one text); rows with a null key are left alone; an empty table gives
an empty one; only the key and the text column are read, so further columns never clash. Long texts are handled whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Words that a unit needs, alone or with those before it; words that a reported span needs.
LEAST, SPAN = 8, 25
CUT = re.compile("[.!?,;:][\x20\x09-\x0d]|\n")
SPACE = " \t\n\x0b\x0c\r"


def units(text: str | None, least: int = LEAST) -> list[tuple[int, int, int, int, bytes, bool]]:
    """(start, end, words before it, words to its end, digest, whether it stood in this text before) of the run that ends with each unit, where there is one; no outer white space."""
    if not text:
        return []
    out, seen, start, words = [], set(), 0, []
    begins: list[tuple[int, int]] = []  # of each unit: its place, and the number of words before it
    for end in [*(m.end() for m in CUT.finditer(text)), len(text)]:
        raw = text[start:end]
        own = raw.encode().lower().split()
        if own:
            begins.append((start + len(raw) - len(raw.lstrip(SPACE)), len(words)))
            words += own
            first = len(begins) - 1
            while first and len(words) - begins[first][1] < least:
                first -= 1
            at, before = begins[first]
            if len(words) - before >= least:
                digest = hashlib.md5(b" ".join(words[before:]), usedforsecurity=False).digest()
                out.append((at, end - len(raw) + len(raw.rstrip(SPACE)), before, len(words), digest, digest in seen))
                seen.add(digest)
        start = end
    return out


def unit_table(docs: DataFrame, least: int = LEAST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, end, w0, w1, h1, h2, again): a row for each run; w0 and w1 are its words, end exclusive, h1 and h2 the digest's halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, "text", 2 << 20):
                ids, rows = [], []
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = units(t, least)
                    ids += [i] * len(found)
                    rows += found
                start, end, w0, w1, digest, again = zip(*rows, strict=True) if rows else ((), (), (), (), (), ())
                halves = np.frombuffer(b"".join(digest), dtype=">i8").astype(np.int64).reshape(-1, 2)
                columns = [pa.array(ids, pa.int64()), *(pa.array(x, pa.int32()) for x in (start, end, w0, w1)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(again, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "w0", "w1", "h1", "h2", "again"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, start int, end int, w0 int, w1 int, h1 long, h2 long, again boolean")


def repeated(docs: DataFrame, least: int = LEAST, span: int = SPAN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, end, n_words, first_doc_id): the spans that stand earlier, there or in other documents, of which first_doc_id is the first."""
    found = common.written(unit_table(docs, least, text, key), "units")
    # Within a document each digest is counted once, so what several documents share shows in least and greatest.
    shared = found.filter(~F.col("again")).groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").select("h1", "h2", "first")
    # Written, so that the join deals both sides itself and can split a digest that very many runs have.
    shared = common.written(shared, "shared")
    hit = found.join(shared, ["h1", "h2"], "left").filter("again OR first < doc_id").select("doc_id", "start", "end", "w0", "w1", F.coalesce("first", "doc_id").alias("first"))
    before = Window.partitionBy("doc_id").orderBy("w0", "w1")
    reach = F.max("w1").over(before.rowsBetween(Window.unboundedPreceding, -1))
    hit = hit.withColumn("opens", F.when(F.col("w0") <= reach, 0).otherwise(1)).withColumn("no", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    merged = hit.groupBy("doc_id", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("w1") - F.min("w0")).alias("n_words"), F.min("first").alias("first_doc_id"))
    return merged.filter(F.col("n_words") >= span).select("doc_id", "start", "end", "n_words", "first_doc_id")


def removed(docs: DataFrame, least: int = LEAST, span: int = SPAN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the repeated spans cut from the text, and `removed`, their places in the original text (null where nothing was removed; an input column of that name gives way)."""
    spans = repeated(docs, least, span, text, key).groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{text}`").cast("string").alias("t"))
    pieces = """concat_ws('', transform(sequence(0, size(cut)), i -> substring(t,
        CASE WHEN i = 0 THEN 1 ELSE get(cut, i - 1).end + 1 END,
        CASE WHEN i = size(cut) THEN length(t) ELSE get(cut, i).start - CASE WHEN i = 0 THEN 0 ELSE get(cut, i - 1).end END END)))"""
    left = F.when(F.col("cut").isNull(), F.col("t")).otherwise(F.expr(pieces))
    kept = [left.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c != "removed"]
    return rows.join(spans, "id", "left").select(*kept, F.col("cut").alias("removed"))
