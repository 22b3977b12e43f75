"""Tags by lexicon tables and rules. Lexicons are DataFrames, so that each domain brings its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text

#: Word bounds that hold for letters of any script.
LEFT, RIGHT = r"(?<![\p{L}\p{N}\p{M}_])", r"(?![\p{L}\p{N}\p{M}_])"
#: Classes of intent, each with three patterns that count one point: fixed values. Ties go to the class listed first.
INTENTS = {
    "Technical": [text.UNITS, r"\b(specification|parameter|measurement|value|rate|coefficient|ratio)\b", r"\b(table|figure|equation|formula|calculation)\b"],
    "Instructional": [r"\b(should|must|need to|require|recommend|ensure|avoid|maintain)\b", r"\b(step|procedure|method|process|guide|instruction|how to)\b", r"\b(first|then|next|finally|after|before)\b"],
    "Conceptual": [r"\b(is defined as|refers to|means|concept|theory|principle)\b", r"\b(because|therefore|thus|however|although|in order to)\b", r"\b(importance|significance|role|impact|effect|relationship)\b"],
}

#: Labels of a named-entity model and the types that they stand for; others are left out: fixed values.
NER_TYPES = {"ORG": "organization", "GPE": "region", "LOC": "region", "PRODUCT": "technology", "QUANTITY": "metric", "PERCENT": "metric"}
#: Patterns of the entities that the agent looks for: fixed values.
AGENT_PATTERNS = [
    "drip irrigation|sprinkler irrigation|flood irrigation|micro-irrigation",
    "soil moisture|water use efficiency|evapotranspiration|crop coefficient",
    "wheat|maize|corn|tomato|citrus|olive|almond|cotton",
    "IoT|precision agriculture|remote sensing|GPS|sensor",
]


def model_mentions(found: DataFrame) -> DataFrame:
    """(doc_id, type, entity, start, end) from a model's (doc_id, label, text, start, end): labels become types, unknown ones go, entities are in lower case."""
    types = F.create_map(*(F.lit(x) for pair in NER_TYPES.items() for x in pair))
    return found.select("doc_id", F.element_at(types, F.col("label")).alias("type"), F.lower("text").alias("entity"), "start", "end").filter("type IS NOT NULL")


def agent_entities(column: Column, patterns: list[str] | None = None) -> Column:
    """The sorted distinct matches of the patterns, in lower case."""
    found = [F.regexp_extract_all(column, F.lit(f"(?i){LEFT}(?:{p}){RIGHT}"), F.lit(0)) for p in (AGENT_PATTERNS if patterns is None else patterns)]
    return F.array_sort(F.array_distinct(F.transform(F.concat(*found), F.lower)))


def lexicon_terms(lexicon: DataFrame, label: str = "label", most: int = 100_000) -> list[tuple[str, str, int]]:
    """(label, term, ordinal) of a lexicon, which is small by what it is; larger ones are refused."""
    rows = lexicon.select(label, "term", "ordinal").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a lexicon may have {most} terms")
    return sorted(((r[label], r["term"], r["ordinal"]) for r in rows), key=lambda r: (r[2], r[0], r[1]))


def topics(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, topics): sorted labels of which a term stands in the text as a substring, whatever the case."""
    by: dict[str, list[str]] = {}
    for label, term, _ in lexicon_terms(lexicon):
        by.setdefault(label, []).append(term.lower())
    low = F.lower(text.text_of(column))
    found = [F.when(F.reduce(F.array(*(low.contains(t) for t in terms)), F.lit(False), lambda a, x: a | x), F.lit(label)) for label, terms in sorted(by.items())]
    labels = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
    return docs.select(F.col(key).alias("doc_id"), labels.alias("topics"))


def first_of(lexicon: DataFrame, column: Column) -> Column:
    """The first term by ordinal that stands in the text as a substring, or null."""
    out, low = None, F.lower(column)
    for _, term, _ in lexicon_terms(lexicon):
        out = F.when(low.contains(term.lower()), F.lit(term)) if out is None else out.when(low.contains(term.lower()), F.lit(term))
    return out if out is not None else F.lit(None).cast("string")


def mentions(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, type, entity, start): words and their places that the lexicon (label, term, ordinal) names, each entity and type once a document, at its first place.

    Tokens are joined to the lexicon, which need not be small; a term is one token. Places are token numbers from 0.
    """
    each = docs.select(F.col(key).alias("doc_id"), F.posexplode(text.tokens(column)).alias("at", "term"))
    hit = each.join(lexicon.select(F.lower("term").alias("term"), F.col("label").alias("type")).distinct(), "term")
    return hit.groupBy("doc_id", "type", F.col("term").alias("entity")).agg(F.min("at").cast("long").alias("start"))


def phrase_mentions(docs: DataFrame, patterns: dict[str, str], key: str = "doc_id", column: str = "text") -> DataFrame:
    """(doc_id, type, entity, start): matches of one pattern for each type, with their character places, first of each entity.

    Places come from the lengths of what stands between matches, as no function gives them.
    """
    parts = []
    for kind, pattern in patterns.items():
        p = f"(?i){LEFT}(?:{pattern}){RIGHT}"
        rows = docs.select(F.col(key).alias("doc_id"), text.text_of(column).alias("t")).filter(F.col("t").rlike(p))
        rows = rows.select("doc_id", F.regexp_extract_all("t", F.lit(p), F.lit(0)).alias("m"), F.split("t", p, -1).alias("gap"))
        rows = rows.select("doc_id", "m", "gap", F.posexplode("m").alias("i", "found"))
        start = F.aggregate(F.slice("gap", F.lit(1), F.col("i") + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("m", F.lit(1), F.col("i")), F.lit(0), lambda a, x: a + F.length(x))
        parts.append(rows.select("doc_id", F.lit(kind).alias("type"), F.lower("found").alias("entity"), start.cast("long").alias("start")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("doc_id", "type", "entity").agg(F.min("start").alias("start"))


def intent(column: Column) -> Column:
    """Technical, Instructional or Conceptual: the class with most points."""
    scores = {k: sum((column.rlike("(?i)" + p).cast("int") for p in ps[1:]), column.rlike("(?i)" + ps[0]).cast("int")) for k, ps in INTENTS.items()}
    most = F.greatest(*scores.values())
    out = None
    for k, s in scores.items():
        out = F.when(s == most, k) if out is None else out.when(s == most, k)
    return out


def measures(column: Column) -> Column:
    """Sorted distinct numbers with units, as `n unit`."""
    found = F.regexp_extract_all(column, F.lit(text.UNITS), F.lit(0))
    spaced = F.transform(found, lambda m: F.regexp_replace(m, r"^(\d+\.?\d*)\s*", "$1 "))
    return F.array_sort(F.array_distinct(spaced))


def keywords(entities: Column, topics_: Column, column: Column, terms: list[str], generic: list[str], most: int = 5) -> Column:
    """Up to `most`: two entities, two topics (blanks for _), then domain terms that stand in the text, then generic ones; none twice whatever the case."""
    low = F.lower(column)
    told = F.concat(
        F.slice(entities, 1, 2),
        F.transform(F.slice(topics_, 1, 2), lambda x: F.replace(x, F.lit("_"), F.lit(" "))),
        F.array_compact(F.array(*(F.when(low.contains(t.lower()), F.lit(t)) for t in terms))),
        F.array(*map(F.lit, generic)),
    )
    once = F.filter(told, lambda x, i: F.array_position(F.transform(told, F.lower), F.lower(x)) == i + 1)
    return F.slice(once, 1, most)


def data_lexicon(docs: DataFrame, low: int = 20, high: int = 60, most: int = 40, types: int = 4) -> DataFrame:
    """(label, term, ordinal): a lexicon drawn from the corpus, terms of middling document frequency, most frequent first."""
    from pyspark.sql import Window

    df = docs.select("doc_id", F.explode(F.array_distinct(text.tokens("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    top = df.filter(F.col("df").between(low, high)).orderBy(F.desc("df"), "term").limit(most)
    rank = F.row_number().over(Window.orderBy(F.desc("df"), "term")) - 1  # of `most` rows
    return top.withColumn("ordinal", rank.cast("long")).select(F.concat(F.lit("t"), (F.col("ordinal") % types).cast("string")).alias("label"), "term", "ordinal")
