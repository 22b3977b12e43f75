"""Column functions on text: tokens, sentences, cleaning, headers, ids, templates.

Classes of characters are spelled as Unicode properties, since \\w and \\b mean ASCII to the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the text formats.
TOKEN = r"[\p{L}\p{N}\p{M}_]+"
SENTENCE_END = r"(?<=[.!?])\s+"
NOISE = [r"Page \d+ of \d+", r"\d+\s*\|\s*Page", r"©.*?\d{4}", r"All rights reserved", r"www\.\S+", r"http[s]?://\S+", r"^\s*\d+\s*$"]
HEADERS = {"markdown": r"^#+\s+(.+)$", "numbered": r"^(\d+\.[\d.]*)\s+(.+)$", "caps": r"^([A-Z][A-Z\s]{5,50})$", "formal": r"^(Chapter|Section|Part)\s+[\dIVXLC]+[:\s]+(.+)"}
UNITS = r"\d+\.?\d*\s*(%|mm|cm|m|kg|ha|L|°C|pH|kPa|bar|m³)"
MODALS = r"^(should|must|need to|require|recommend|ensure|avoid|maintain)"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokens(c: Column | str) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit(TOKEN), F.lit(0))


def words(c: Column | str) -> Column:
    """What white space separates."""
    return F.filter(F.split(text_of(c), r"\s+"), lambda w: w != "")


def sentences(c: Column | str, least: int = 0) -> Column:
    """Trimmed sentences of at least so many characters."""
    parts = F.transform(F.split(text_of(c), SENTENCE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) >= least) if least else parts


def token_estimate(c: Column | str) -> Column:
    return F.floor(F.length(text_of(c)) / 4).cast("long")


def clean_page(c: Column | str) -> Column:
    """White space collapsed, page marks dropped, runs of dots and dashes cut to three."""
    out = F.regexp_replace(text_of(c), r"\s+", " ")
    for pattern, by in ((r"Page \d+ of \d+", ""), (r"\d+\s*\|\s*Page", ""), (r"\.{3,}", "..."), (r"-{3,}", "---")):
        out = F.regexp_replace(out, pattern, by)
    return F.trim(out)


def without_noise(c: Column | str) -> Column:
    """The noise patterns removed one after another."""
    out = text_of(c)
    for pattern in NOISE:
        out = F.regexp_replace(out, f"(?im){pattern}", "")
    return out


def noise_ratio(raw: Column, reduced: Column) -> Column:
    """The part of the characters that without_noise() removed; 0 for an empty text."""
    return F.when(F.length(raw) > 0, (F.length(raw) - F.length(reduced)) / F.length(raw)).otherwise(F.lit(0.0))


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def quotes_normalised(c: Column) -> Column:
    """Curly quotes made straight; not part of the cleaning unless asked for."""
    return F.translate(c, "“”‘’", "\"\"''")


def header_kind(line: Column) -> Column:
    """The first kind of header that a trimmed line is, or null."""
    out = None
    for kind, pattern in HEADERS.items():
        out = F.when(line.rlike(pattern), kind) if out is None else out.when(line.rlike(pattern), kind)
    return out


def chunk_id(source: Column, page: Column, index: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", source, page.cast("string"), index.cast("string"))), 1, 12)


def cache_key(model: Column, prompt: Column) -> Column:
    return F.md5(F.concat(model, F.lit(":"), prompt))


def document_title(filename: Column, most: int) -> Column:
    plain = F.translate(F.regexp_replace(filename, r"\.pdf", ""), "_-", "  ")
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("..."))).otherwise(plain)


def contextual_header(title: Column, section: Column, page: Column) -> Column:
    """[Document: ...] [Section: ...] [Page: n]; what is empty is left out."""
    return F.concat_ws(
        " ",
        F.when(F.length(title) > 0, F.concat(F.lit("[Document: "), document_title(title, 50), F.lit("]"))),
        F.when(F.length(section) > 0, F.concat(F.lit("[Section: "), section, F.lit("]"))),
        F.when(page > 0, F.concat(F.lit("[Page: "), page.cast("string"), F.lit("]"))),
    )


def header_path(headers: Column) -> Column:
    """The first three headers, each cut to 30 characters."""
    return F.array_join(F.transform(F.slice(headers, 1, 3), lambda h: F.substring(h, 1, 30)), " > ")


def injected(filename: Column, path: Column, region: Column, chunk: Column) -> Column:
    return F.concat(F.lit("[DOC_ORIGIN: "), filename, F.lit("]\n[SUB_SECTION: "), path, F.lit("]\n[LOCAL_SCOPE: "), region, F.lit("]\n[CONTENT]: "), chunk)


def propositions(c: Column | str) -> Column:
    """Sentences of 20 characters or more that state a measure or start with a modal."""
    return F.filter(sentences(c, 20), lambda s: s.rlike(f"(?i){UNITS}") | s.rlike(f"(?i){MODALS}"))


def table_text(rows: Column) -> Column:
    """Rows of cells (array<array<string>>) as lines; null cells are empty."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda x: F.coalesce(x, F.lit(""))), " | ")), "\n")


def category_of(path: Column, root: str = "documents") -> Column:
    """The folder that a file stands in; `uncategorized` for the root."""
    parent = F.element_at(F.split(path, "/"), -2)
    return F.when(parent == root, "uncategorized").otherwise(parent)


def variants(answer: Column, original: Column, n: int) -> Column:
    """A model's lines without list marks, longer than ten characters, at most n, behind the original."""
    lines = F.transform(F.split(answer, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^[\d.\-*)]+\s*", "")))
    return F.concat(F.array(original), F.slice(F.filter(lines, lambda x: F.length(x) > 10), 1, n))


def html_text(c: Column | str) -> Column:
    """Scripts, styles and tags removed, the common entities decoded, white space collapsed."""
    out = F.regexp_replace(text_of(c), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return squeezed(out)


def global_header(filename: Column, subtopics: list[Column], fallback: Column) -> Column:
    """Document: title; Topic: the first two sub-topics that are not null, or the fallback."""
    found = F.slice(F.array_compact(F.array(*subtopics)), 1, 2)
    topic = F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(fallback)
    return F.concat(F.lit("Document: "), document_title(filename, 40), F.lit("; Topic: "), topic)
