"""What the operators of this package share: reading tables, shared scratch tables, and bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tessera.scratch import written  # noqa: F401 - the operators take it from here

#: Bytes of text that a Python worker holds as objects at a time, unless one row alone is longer.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch, each with at most that many bytes of text or one row."""
    n = batch.num_rows
    if not n:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(lengths):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    yield batch.slice(start, n - start)


def mapped(df: DataFrame, text: str, schema: str | StructType, work: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow over bounded slices. work() runs once in each task and returns what maps one slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        for batch in batches:
            for part in slices(batch, text):
                yield each(part)

    return df.mapInArrow(run, schema)


def annotate(docs: DataFrame, text: str, key: str, fields: str, work: Callable[[], Callable[[list], list]], whole: bool = False, as_bytes: bool = False) -> DataFrame:
    """Columns computed from each row's text in one pass without a shuffle.

    work() runs once in each task; what it returns maps a list of texts (None where null) to a list of columns, each a
    list, in the order of `fields` (DDL). The result has doc_id and these columns; with `whole`, instead of doc_id, the
    column `row` with all columns of docs in a struct, so that no name clashes.
    """
    cast = F.col(f"`{text}`").cast("binary" if as_bytes else "string")
    if whole:
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), cast.alias("text"))
    else:
        rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), cast.alias("text"))
    added = StructType.fromDDL(fields)
    schema = StructType([rows.schema[0], *added])
    types = [to_arrow_type(f.dataType) for f in added]

    def wrapped() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        each = work()

        def one(part: pa.RecordBatch) -> pa.RecordBatch:
            columns = each(part.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=schema.names)

        return one

    return mapped(rows, "text", schema, wrapped)
