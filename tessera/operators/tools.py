"""Retrieval tools of agents, each for a batch of asked texts at once, and the state that an agent keeps of its questions.

asked: (ask_id, query_id, text, k) and for the graph entities(array). Every tool gives (ask_id, context, sources); an
asked text for which nothing is found has no row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph, routing

#: Attempts, rounds and missing entities a round of the agent; entities, nodes, paths and documents that the graph tool tells: fixed values.
ATTEMPTS, ROUNDS, MISSING = 5, 5, 2
ENTITIES, NODES, PATHS, DOCUMENTS = 3, 5, 3, 3
#: Intent -> the orchestrator's tool and how many results it asks for: fixed values.
REACT = {"factual": ("vector_search", 5), "relational": ("graph_search", 2), "summary": ("vector_search", 10), "reasoning": ("vector_search", 8), "procedural": ("vector_search", 5), "comparative": ("vector_search", 8)}
#: Characters of a result that the orchestrator shows.
SHOWN = 500


@dataclass(frozen=True)
class Graph:
    """edges(src, dst, doc_id), nodes(entity, type, frequency, ...) and mentions(doc_id, type, entity, start)."""

    edges: DataFrame
    nodes: DataFrame
    mentions: DataFrame

    @classmethod
    def of(cls, mentions: DataFrame) -> Graph:
        return cls(graph.cooccurrences(mentions), graph.nodes(mentions), mentions)


def _joined(rows: DataFrame, by: list[str], order: str, value: str, separator: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return rows.groupBy(*by).agg(F.array_join(ordered, separator).alias("context"))


def vector_search(docs: DataFrame, asked: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The texts of the best documents in order, with blank lines between. retrieve(queries(query_id, text), k) ranks."""
    most = asked.agg(F.coalesce(F.max("k"), F.lit(0))).first()[0]
    if not most:
        return asked.sparkSession.createDataFrame([], f"ask_id {asked.schema['ask_id'].dataType.simpleString()}, context string, sources array<string>")
    found = retrieve(asked.select(F.col("ask_id").alias("query_id"), "text"), most).withColumnRenamed("query_id", "ask_id")
    found = found.join(asked.select("ask_id", "k"), "ask_id").filter("rank <= k").join(docs.select("doc_id", "text"), "doc_id")
    rows = found.select("ask_id", "rank", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("string").alias("source"))
    sources = rows.groupBy("ask_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return _joined(rows, ["ask_id"], "rank", "text", "\n\n").join(sources, "ask_id")


def graph_search(g: Graph, asked: DataFrame) -> DataFrame:
    """A block for each entity that is a node (or names one): the nodes and paths around it; then the graph's lines for the whole text. Sources are the entities' first documents."""
    each = asked.select("ask_id", "text", "k", F.posexplode(F.slice("entities", 1, ENTITIES)).alias("no", "asked"))
    named = graph.resolve(each.select("asked").distinct(), g.nodes)
    each = each.join(named, "asked")
    met = graph.traverse(g.edges, each.select(F.col("entity").alias("start")).distinct(), 2, 20, paths=True).join(g.nodes.select("entity", "type"), "entity", "left")
    near = each.select("ask_id", "no", "k", F.col("entity").alias("start")).join(met, "start")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("ask_id", "no").orderBy("depth", "entity"))).filter("r <= k")
    line = F.concat(F.lit("- "), "entity", F.lit(" ("), F.coalesce("type", F.lit("unknown")), F.lit(") at depth "), F.col("depth").cast("string"))
    path = F.when(F.col("depth") > 0, F.concat(F.lit("Path: "), F.array_join("path", " -> ")))
    told = near.groupBy("ask_id", "no", "start").agg(
        F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("r", line.alias("x")))), lambda x: x["x"]), 1, NODES), "\n").alias("nodes"),
        F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(path.isNotNull(), F.struct("r", path.alias("x"))))), lambda x: x["x"]), 1, PATHS), "\n").alias("paths"),
    )
    blocks = told.select("ask_id", "no", F.concat_ws("\n", F.concat(F.lit("Entity: "), "start"), F.nullif("nodes", F.lit("")), F.nullif("paths", F.lit(""))).alias("block"))
    words = asked.select(F.col("ask_id").alias("query_id"), F.posexplode(routing.query_entities()).alias("ordinal", "entity"))
    lines = graph.context_lines(g.edges, g.nodes, words).select(F.col("query_id").alias("ask_id"), F.lit(ENTITIES).alias("no"), F.col("context").alias("block"))
    context = _joined(blocks.unionByName(lines), ["ask_id"], "no", "block", "\n\n")
    documents = each.join(graph.related_documents(g.mentions, DOCUMENTS), "entity")
    sources = documents.select("ask_id", F.explode(F.transform("documents", lambda d: d.cast("string"))).alias("s")).groupBy("ask_id").agg(F.array_sort(F.collect_set("s")).alias("sources"))
    return context.join(sources, "ask_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def hybrid_search(vector: DataFrame, graph_: DataFrame) -> DataFrame:
    """Both tools' contexts under their names, and all their sources."""
    both = vector.select("ask_id", F.col("context").alias("v"), F.col("sources").alias("vs")).join(graph_.select("ask_id", F.col("context").alias("g"), F.col("sources").alias("gs")), "ask_id", "full")
    none = F.array().cast("array<string>")
    head = lambda c, name: F.when(F.length(c) > 0, F.concat(F.lit(f"=== {name} ===\n"), F.col(c)))
    context = F.concat_ws("\n\n", head("v", "Semantic Search Results"), head("g", "Graph Traversal Results"))
    return both.select("ask_id", context.alias("context"), F.array_sort(F.array_union(F.coalesce("vs", none), F.coalesce("gs", none))).alias("sources"))


def execute(docs: DataFrame, g: Graph, asked: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The tool that each row of asked names (vector, graph or hybrid, which gives half of k to either)."""
    whole, halves = asked.filter("tool <> 'hybrid'"), asked.filter("tool = 'hybrid'").withColumn("k", F.floor(F.col("k") / 2).cast("int"))
    every = whole.unionByName(halves)
    vector = vector_search(docs, every.filter("tool <> 'graph'"), retrieve)
    around = graph_search(g, every.filter("tool <> 'vector'"))
    both = hybrid_search(vector.join(halves.select("ask_id"), "ask_id", "left_semi"), around.join(halves.select("ask_id"), "ask_id", "left_semi"))
    return vector.join(halves.select("ask_id"), "ask_id", "left_anti").unionByName(around.join(halves.select("ask_id"), "ask_id", "left_anti")).unionByName(both)


def reset(queries: DataFrame) -> DataFrame:
    """(query_id, attempts, visited, contexts, sources, tools): an agent's state before it has done anything."""
    none = F.array().cast("array<string>")
    return queries.select("query_id", F.lit(0).cast("long").alias("attempts"), *(none.alias(c) for c in ("visited", "contexts", "sources", "tools")))


def can_continue(attempts: Column, most: int = ATTEMPTS) -> Column:
    return attempts < most


def unvisited(entities: Column, visited: Column) -> Column:
    """Those entities that were not visited, whatever the case, each once."""
    seen = F.transform(visited, F.lower)
    return F.filter(F.array_distinct(entities), lambda e: ~F.array_contains(seen, F.lower(e)))


def advanced(state: DataFrame, asked: DataFrame, found: DataFrame) -> DataFrame:
    """The state after these (ask_id, query_id, tool, entities) were carried out: an attempt each, their entities visited, contexts in the order of ask_id, each once."""
    rows = asked.join(found, "ask_id", "left")
    got = F.col("context").isNotNull() & (F.length("context") > 0)
    done = rows.groupBy("query_id").agg(
        F.count("*").alias("n"), F.flatten(F.collect_list(F.when(F.col("tool") != "vector", F.slice("entities", 1, ENTITIES)))).alias("new_visited"),
        F.transform(F.array_sort(F.collect_list(F.when(got, F.struct("ask_id", "context")))), lambda x: x["context"]).alias("new_contexts"),
        F.flatten(F.collect_list(F.when(got, F.col("sources")))).alias("new_sources"), F.collect_set(F.when(got, F.col("tool"))).alias("new_tools"),
    )
    both = lambda c, sort: (F.array_sort if sort else lambda x: x)(F.array_union(c, F.coalesce(f"new_{c}", F.array().cast("array<string>")))).alias(c)
    return state.join(done, "query_id", "left").select(
        "query_id", (F.col("attempts") + F.coalesce("n", F.lit(0))).alias("attempts"), both("visited", True), both("contexts", False), both("sources", True), both("tools", True),
    )


def context_steps(length: Column) -> Column:
    """How sure an answer by a model is, by the length of its context: fixed values."""
    return F.when(length > 2000, 0.85).when(length > 1000, 0.8).otherwise(0.7)


def synthesis_prompt(query: Column, subs: Column, context: Column, most: int = 4000) -> Column:
    """What a model is given to answer a question out of its parts' contexts. subs: array of (text, type)."""
    parts = F.array_join(F.transform(subs, lambda s: F.concat(F.lit("- "), s["sub_text"], F.lit(" ("), s["sub_type"], F.lit(")"))), "\n")
    task = "Answer the question out of the context alone. Use what is found for each part, name the facts that the answer rests on, and say what is missing."
    return F.concat_ws("\n\n", F.lit(task), F.concat(F.lit("Question: "), query), F.concat(F.lit("Parts:\n"), parts), F.concat(F.lit("Context:\n"), F.substring(context, 1, most)), F.lit("Answer:"))


def synthesized(rows: DataFrame, llm=None, most: int = 2000) -> DataFrame:
    """rows (query_id, query, subs, contexts) with `answer` and `confidence`: a model's, or the start of the contexts; none for no context."""
    whole = F.array_join(F.filter("contexts", lambda c: F.length(c) > 0), "\n\n---\n\n")
    rows = rows.withColumn("context", whole)
    has = F.length("context") > 0
    start = F.substring("context", 1, most)
    if llm is None:
        said, sure = start, F.lit(0.5)
    else:  # what a model fails to say falls back as well
        told = llm.column(synthesis_prompt(F.col("query"), F.col("subs"), F.col("context")))
        rows = rows.withColumn("told", told)
        said, sure = F.coalesce("told", start), F.when(F.col("told").isNull(), 0.5).otherwise(context_steps(F.length("context")))
    out = rows.withColumn("answer", F.when(has, said).otherwise("Insufficient context to answer the query.")).withColumn("confidence", F.when(has, sure).otherwise(0.0))
    return out.drop("context", "told")


def shown_results(docs: DataFrame, ranked: DataFrame, tool: str, most: int = SHOWN) -> DataFrame:
    """(query_id, rank, doc_id, text, source, score, tool): results as the orchestrator shows them, texts cut."""
    source = F.coalesce(*(F.col(c).cast("string") for c in ("source",) if c in docs.columns), F.lit("Unknown"))
    own = docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, most).alias("text"), source.alias("source"))
    return ranked.join(own, "doc_id").select("query_id", "rank", "doc_id", "text", "source", "score", F.lit(tool).alias("tool"))


def document_summaries(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, summary) of the asked documents (doc_id); of those that are missing it says so. docs: (doc_id, text, source) and perhaps summary."""
    from tessera.operators import answers

    told = answers.document_card(F.col("source"), F.col("text"), F.col("summary")) if "summary" in docs.columns else F.concat(F.lit("Document: "), "source", F.lit("\n\nExcerpt: "), F.substring("text", 1, SHOWN))
    return asked.join(docs.select("doc_id", told.alias("summary")), "doc_id", "left").select("doc_id", F.coalesce("summary", F.concat(F.lit("Document "), F.col("doc_id").cast("string"), F.lit(" not found."))).alias("summary"))


def labelled_context(results: DataFrame) -> DataFrame:
    """(query_id, context) of (query_id, call, kind, rank, source, text): documents under the number of the call that found them, graph and summaries under their names, rules between."""
    label = F.when(F.col("kind") == "documents", F.concat(F.lit("[Source "), F.col("call").cast("string"), F.lit(": "), "source", F.lit("]"))).when(F.col("kind") == "graph", "[Knowledge Graph Context]").otherwise("[Document Summary]")
    rows = results.select("query_id", F.struct("call", "rank").alias("place"), F.concat(label, F.lit("\n"), "text").alias("part"))
    return _joined(rows, ["query_id"], "place", "part", "\n\n---\n\n")


def react_tool(intent: Column) -> tuple[Column, Column]:
    """The tool that serves an intent, and how many results (of the graph: how deep); that of vector search with five for others."""
    tool, n = F.lit("vector_search"), F.lit(5)
    for name, (t, k) in REACT.items():
        tool, n = F.when(intent == name, t).otherwise(tool), F.when(intent == name, k).otherwise(n)
    return tool, n
