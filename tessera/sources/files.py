"""Reading and writing: files with pages (PDF by a callable), chunk files, question sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import SourceError
from tessera.functions import text
from tessera.schemas import PAGE_CHUNK, QUESTION


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content")


def pdf_pages(content: bytes) -> list[tuple[int, str, list]]:
    """(page number, text, tables) by whichever PDF library the workers have; no pages if the file cannot be read."""
    import io

    try:
        import pdfplumber
    except ImportError:
        pdfplumber = None
    if pdfplumber is not None:
        try:
            with pdfplumber.open(io.BytesIO(content)) as pdf:
                return [(i, page.extract_text() or "", page.extract_tables() or []) for i, page in enumerate(pdf.pages, 1)]
        except Exception:  # noqa: BLE001 - a broken file is tried with the other library
            pass
    try:
        import pypdf
    except ImportError as e:
        raise SourceError("neither pdfplumber nor pypdf is installed") from e
    try:
        return [(i, page.extract_text() or "", []) for i, page in enumerate(pypdf.PdfReader(io.BytesIO(content)).pages, 1)]
    except Exception:  # noqa: BLE001 - as with an empty file
        return []


def pages(found: DataFrame, extract: Callable[[bytes], list[tuple[int, str, list]]] = pdf_pages) -> DataFrame:
    """(path, category, page, text, has_table): tables follow the text of their page as lines of cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(path, n, body, [[["" if c is None else str(c) for c in r] for r in t] for t in tables]) for path, content in zip(batch["path"], batch["content"], strict=True) for n, body, tables in extract(bytes(content))]
            yield pd.DataFrame(rows, columns=["path", "page", "body", "tables"])

    out = found.mapInPandas(run, "path string, page int, body string, tables array<array<array<string>>>")
    told = F.transform("tables", lambda t: F.concat(F.lit("\n[TABLE DATA]\n"), text.table_text(t)))
    return out.select("path", text.category_of(F.col("path")).alias("category"), "page", F.concat(F.col("body"), F.array_join(told, "")).alias("text"), (F.size("tables") > 0).alias("has_table"))


def full_text(page_table: DataFrame) -> DataFrame:
    """(path, text): pages in order, with a blank line between."""
    return page_table.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines."""
    chunks.write.mode("overwrite").json(path)


def write_semantic(chunks: DataFrame, path: str) -> None:
    """Semantic chunks as JSON lines in the exchanged form (schema), with all fields (all), and a summary of one row; chunks have (id, source, basin, region, content, intent, ...)."""
    from tessera.operators import store

    where = path.rstrip("/")
    store.as_schema(chunks).write.mode("overwrite").option("ignoreNullFields", "false").json(f"{where}/schema")
    chunks.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{where}/all")
    store.semantic_overview(chunks).write.mode("overwrite").json(f"{where}/summary")


def write_results(results: DataFrame, path: str) -> None:
    """Results of an evaluation as JSON lines, and their summary."""
    from tessera.operators import evaluation

    where = path.rstrip("/")
    results.write.mode("overwrite").json(f"{where}/results")
    evaluation.run_summary(results).coalesce(1).write.mode("overwrite").json(f"{where}/summary")


def sizes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, files, bytes) of those that exist."""
    rows, jvm = [], spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if system.exists(where):
            found = system.getContentSummary(where)
            rows.append((path, found.getFileCount(), found.getLength()))
    return spark.createDataFrame(rows, "path string, files long, bytes long")


def wiped(spark: SparkSession, paths: list[str], confirm: bool = False) -> DataFrame:
    """What stands at the paths is deleted, if confirmed; (path, files, bytes) of what was, or would be."""
    found = spark.createDataFrame(sizes(spark, paths).collect(), "path string, files long, bytes long")
    if confirm:
        for path in paths:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return found


def read_chunks(spark: SparkSession, path: str, schema: str = PAGE_CHUNK) -> DataFrame:
    return spark.read.schema(schema).json(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A question set: one JSON array of objects."""
    return spark.read.schema(QUESTION).option("multiLine", True).json(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A graph, an index or a calibration as Parquet tables in one folder, overwritten."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in names}
