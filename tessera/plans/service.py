"""What a service in front of the engine calls: one object that holds the tables, and a function for each request, over batches of questions."""

from __future__ import annotations

from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import ModelError
from tessera.operators import evaluation, lexical, tools
from tessera.plans import pipelines


@dataclass
class Service:
    """docs(doc_id, text), the entities' mentions, and perhaps a model and a reranker. The index is built at the first question, once."""

    docs: DataFrame
    mentions: DataFrame
    llm: object | None = None
    reranker: object | None = None
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    built: lexical.Index | None = None
    graph: tools.Graph | None = None

    def load(self) -> Service:
        if self.built is None:
            self.built = lexical.index(self.docs)
        if self.graph is None:
            self.graph = tools.Graph.of(self.mentions)
        return self

    def health(self) -> DataFrame:
        """(component, ready): whether each part is there; nothing is built for it."""
        parts = {"documents": self.docs, "index": self.built, "graph": self.graph, "model": self.llm, "reranker": self.reranker}
        return self.docs.sparkSession.createDataFrame([(k, v is not None) for k, v in parts.items()], "component string, ready boolean")

    def info(self) -> DataFrame:
        """(name, n): documents, terms, nodes and edges."""
        self.load()
        count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        return count(self.docs, "documents").unionByName(count(self.built.terms, "terms")).unionByName(count(self.graph.nodes, "nodes")).unionByName(count(self.graph.edges, "edges"))

    def query(self, questions: DataFrame, how: str = "answer") -> DataFrame:
        """Questions (query_id, text) answered by the plain run, the agent or the orchestrator."""
        self.load()
        if how == "answer":
            return pipelines.answer(self.docs, questions, self.synonyms, self.mentions, self.llm, reranker=self.reranker, built=self.built)
        if how == "agent":
            return pipelines.agent(self.docs, questions, self.graph, llm=self.llm, built=self.built)
        if how == "orchestrator":
            return pipelines.react(self.docs, questions, self.graph, llm=self.llm, built=self.built)
        raise ModelError(f"unknown way to answer: {how}")

    def query_async(self, questions: DataFrame, how: str = "answer") -> Future:
        """As query(), planned in a thread of its own."""
        with ThreadPoolExecutor(1) as pool:
            return pool.submit(self.query, questions, how)

    def query_stream(self, questions: DataFrame, size: int = 100) -> DataFrame:
        """(query_id, part, text): answers in parts of so many characters, in order."""
        told = self.query(questions).select("query_id", "answer")
        starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("answer") - 1, F.lit(0)) / size).cast("int"))
        return told.select("query_id", "answer", F.explode(starts).alias("part")).select("query_id", "part", F.substring("answer", F.col("part") * size + 1, F.lit(size)).alias("text"))

    def evaluate(self, answered: DataFrame) -> DataFrame:
        """(id, question, answer, context) with scores, verdict, advice and report."""
        rows = answered.select("id", "question", F.array().cast("array<string>").alias("key_concepts"))
        return pipelines.evaluate(rows, answered.select("id", "answer", "context"), self.llm)

    def summary(self, results: DataFrame) -> DataFrame:
        return evaluation.run_summary(results)
