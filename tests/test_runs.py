"""Whole runs, tools, sinks and services on small fixtures."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.errors import ModelError, SourceError
from tessera.operators import answers, chunking, evaluation, graph, store, tagging, tools, vector_search
from tessera.plans import pipelines
from tessera.plans.service import Service
from tessera.sources import files
from tests.test_goldens import edges, rows, value

DOCS = [(1, "Drip irrigation saves water. Tomato needs water in summer."), (2, "Wheat is sown in autumn. Drip irrigation is rare for wheat."), (3, "Soil moisture is measured by a sensor."), (4, "Nothing of use here at all.")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


@pytest.fixture(scope="module")
def mentions(spark):
    found = [(1, "method", "drip irrigation", 0), (1, "crop", "tomato", 30), (2, "crop", "wheat", 0), (2, "method", "drip irrigation", 25), (3, "measure", "soil moisture", 0), (3, "technology", "sensor", 30)]
    return spark.createDataFrame(found, "doc_id long, type string, entity string, start long")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


class Says:
    """A model that always says the same."""

    def __init__(self, words):
        self.words = words

    def column(self, *inputs):
        return F.concat(F.lit(self.words), F.substring(inputs[0], 1, 0))


def simple_split(text, size, overlap, separators):
    """Recursive splitting, written anew: (piece, fits) by the first separator that occurs, then merged in order."""
    sep = next((s for s in separators if s in text), None)
    if sep is None:
        pieces, rest = [text], []
    else:
        cut = text.split(sep)
        pieces, rest = [p for p in [cut[0], *[sep + c for c in cut[1:]]] if p], separators[separators.index(sep) + 1 :]
    out, window = [], []

    def emit():
        if "".join(window).strip():
            out.append("".join(window).strip())

    for piece in [*pieces, None]:
        if piece is None or len(piece) >= size:
            emit()
            window.clear()
            if piece is not None:
                out.extend(simple_split(piece, size, overlap, rest) if rest else [piece])
            continue
        if window and sum(map(len, window)) + len(piece) > size:
            emit()
            while window and (sum(map(len, window)) > overlap or sum(map(len, window)) + len(piece) > size):
                window.pop(0)
        window.append(piece)
    return out


def test_recursive_split_against_plain_python(spark, sf):
    rng = random.Random(1)
    texts = ["".join(rng.choice(["word", "a", "longerword", ", ", "; ", ". ", "\n", "\n\n", " "]) for _ in range(rng.randrange(400))) for _ in range(60)] + ["x" * 1500, "a, b, " + "y" * 700 + "; c"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text"))
    got = {}
    for r in chunking.recursive_split(table, 300, 45).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["content"])
    want = {r["doc_id"]: simple_split(r["text"], 300, 45, ["\n\n", "\n", ". ", "; ", ", ", " "]) for r in table.collect() if r["text"]}
    assert got == {k: v for k, v in want.items() if v}


def test_semantic_chunks_split_and_score(spark):
    long = ("w" * 30 + " ") * 80
    table = spark.createDataFrame([(1, "", ["a" * 900, "b" * 900, "c" * 20, long], [0.9, 0.95, 0.1]), (2, "One only", ["One only"], []), (3, None, [], [])], "doc_id long, text string, sentences array<string>, sims array<double>")
    got = chunking.semantic_chunks(table, percentile=1.0, drop=0.15).orderBy("doc_id", "chunk_no").collect()
    # The only break stands before the long sentence: the three before it are one chunk, the long one is split by force.
    assert [(r["doc_id"], r["boundary_score"]) for r in got][:2] == [(1, 1.0), (1, 0.7)] and got[0]["n_sentences"] == 3
    assert got[-1]["content"] == "One only" and {r["doc_id"] for r in got} == {1, 2}
    mid = chunking.semantic_chunks(table.filter("doc_id = 1"), percentile=0.0, drop=None, most=None).orderBy("chunk_no").first()
    assert mid["boundary_score"] == 0.5  # cut at a similarity of 0.9


def test_semantic_ingestion(spark, docs, tmp_path):
    lexicon = spark.createDataFrame([("water", "water", 0), ("crops", "wheat", 1)], "label string, term string, ordinal long")
    chunks = pipelines.sequential_ids(pipelines.ingest_semantic(docs, F.concat(F.lit("file_"), F.col("doc_id").cast("string"), F.lit(".pdf")), lexicon))
    got = {r["doc_id"]: r for r in chunks.collect()}
    assert [got[i]["id"] for i in (1, 2, 3, 4)] == [1, 2, 3, 4] and got[1]["topics"] == ["water"] and got[2]["topics"] == ["crops"]
    assert got[1]["contextual_header"] == "[Document: file 1]" and got[1]["content_with_header"].endswith(DOCS[0][1]) and "[SUB_SECTION: Main Content]" in got[1]["injected"]
    out = chunks.withColumn("source", F.lit("s")).withColumn("basin", F.lit("")).withColumn("region", F.when(F.col("doc_id") == 1, "north"))
    files.write_semantic(out, str(tmp_path))
    summary = spark.read.json(f"{tmp_path}/summary").first()
    assert (summary["n_chunks"], summary["sources"], summary["regions"]) == (4, ["s"], ["north"])
    assert "level" in spark.read.json(f"{tmp_path}/schema").columns and spark.read.json(f"{tmp_path}/all").count() == 4
    assert files.wiped(spark, [f"{tmp_path}/all", f"{tmp_path}/none"]).count() == 1 and spark.read.json(f"{tmp_path}/all").count() == 4
    assert files.wiped(spark, [f"{tmp_path}/all"], confirm=True).first()["bytes"] > 0 and files.sizes(spark, [f"{tmp_path}/all"]).count() == 0


def test_agent_entities_and_model_labels(spark):
    assert value(spark, tagging.agent_entities(F.lit("Tomatoes? Tomato under DRIP irrigation, tomato; iot."))) == ["drip irrigation", "iot", "tomato"]
    found = spark.createDataFrame([(1, "ORG", "FAO", 0, 3), (1, "DATE", "May", 4, 7)], "doc_id long, label string, text string, start int, end int")
    assert rows(tagging.model_mentions(found), "type", "entity") == [("organization", "fao")]


def test_agent_routes_refines_and_stops(spark, docs, mentions):
    g = tools.Graph.of(mentions)
    got = {r["query_id"]: r for r in pipelines.agent(docs, asked(spark, "What is the relationship of drip irrigation to tomato?", "define sensor", "define maize and citrus and olive and almond"), g).collect()}
    assert got[0]["tools"] == ["graph"] and "Entity: drip irrigation" in got[0]["answer"] and got[0]["visited"] == ["drip irrigation", "tomato"] and got[0]["sources"] == ["1", "2"]
    assert got[1]["tools"] == ["vector"] and got[1]["missing"] == 0 and got[1]["attempts"] == 1
    # Four parts leave one attempt: one round, which may overshoot by its two entities.
    assert got[2]["sub_queries"] == 4 and got[2]["attempts"] == 6 and got[2]["visited"] == ["almond", "citrus"] and got[2]["confidence"] == 0.0  # no text tells of any


def test_hybrid_tool_halves_and_names_its_parts(spark, docs, mentions):
    q = spark.createDataFrame([("a", 1, "compare wheat", "hybrid", 4, ["wheat"]), ("b", 2, "zzz", "graph", 4, ["nowhere"])], "ask_id string, query_id long, text string, tool string, k int, entities array<string>")
    got = {r["ask_id"]: r for r in tools.execute(docs, tools.Graph.of(mentions), q, lambda x, n: pipelines.retrieve(docs, x, n)).collect()}
    assert set(got) == {"a"} and got["a"]["context"].startswith("=== Semantic Search Results ===\n") and "=== Graph Traversal Results ===\nEntity: wheat" in got["a"]["context"]
    state = tools.advanced(tools.reset(q.select("query_id")), q, spark.createDataFrame([("a", "ctx", ["2"])], "ask_id string, context string, sources array<string>"))
    assert sorted(rows(state, "query_id", "attempts", "visited", "contexts", "sources", "tools")) == [(1, 1, ["wheat"], ["ctx"], ["2"], ["hybrid"]), (2, 1, ["nowhere"], [], [], [])]


def test_synthesis_by_a_model(spark):
    row = spark.createDataFrame([(1, "q", [("part", "factual")], ["c" * 1500]), (2, "q", [("part", "factual")], [])], "query_id long, query string, subs array<struct<sub_text:string,sub_type:string>>, contexts array<string>")
    assert sorted(rows(tools.synthesized(row, Says("told")), "query_id", "answer", "confidence")) == [(1, "told", 0.8), (2, "Insufficient context to answer the query.", 0.0)]
    assert [value(spark, tools.context_steps(F.lit(n))) for n in (10, 1001, 2001)] == [0.7, 0.8, 0.85]
    assert "- part (factual)" in value(spark, tools.synthesis_prompt(F.lit("q"), F.array(F.struct(F.lit("part").alias("sub_text"), F.lit("factual").alias("sub_type"))), F.lit("c")))


def test_react(spark, docs, mentions):
    told = "## Executive Summary\nShort.\n## Detailed Findings\n1. One [Source: a]\n2. Two\n"
    got = {r["query_id"]: r for r in pipelines.react(docs, asked(spark, "How is wheat related to drip irrigation, relationship between", "why is water saved", "what is a sensor"), tools.Graph.of(mentions), Says(told)).collect()}
    assert got[0]["intent"] == "relational" and got[0]["tools"] == ["graph_search"] and got[0]["n_results"] == 0
    assert got[1]["intent"] == "reasoning" and got[1]["tools"] == ["vector_search", "graph_search"]
    assert got[2]["tools"] == ["vector_search"] and got[2]["summary"] == "Short." and len(got[2]["findings"]) == 2 and got[2]["sources"] == ["Unknown"]


def test_context_is_labelled_by_call(spark):
    parts = spark.createDataFrame([(1, 1, "documents", 1, "s", "t"), (1, 2, "graph", 0, "", "g"), (1, 3, "summary", 0, "", "u")], "query_id long, call int, kind string, rank long, source string, text string")
    assert tools.labelled_context(parts).first()["context"] == "[Source 1: s]\nt\n\n---\n\n[Knowledge Graph Context]\ng\n\n---\n\n[Document Summary]\nu"
    d = spark.createDataFrame([(1, "text", "s")], "doc_id long, text string, source string")
    assert sorted(rows(tools.document_summaries(d, spark.createDataFrame([(1,), (2,)], "doc_id long")), "summary")) == [("Document 2 not found.",), ("Document: s\n\nExcerpt: text",)]
    assert value(spark, answers.document_card(F.lit("s"), F.lit("text"), F.lit("sum"))) == "Document: s\nSummary: sum\nExcerpt: text"


def test_paths_of_any_length_with_relations(spark):
    chain = [(chr(97 + i), chr(98 + i)) for i in range(12)]
    e = edges(spark, chain)
    pairs = spark.createDataFrame([("a", "m"), ("a", "zz"), ("m", "a")], "a string, b string")
    found = graph.shortest_paths(e, pairs)
    assert sorted(rows(found, "a", "b", "length")) == [("a", "m", 12), ("a", "zz", -1), ("m", "a", 12)]
    named = e.withColumn("relation", F.concat("src", F.lit("-"), "dst"))
    steps = graph.path_relations(found.filter("a = 'm'"), named).orderBy("step")
    assert rows(steps, "src", "dst", "relation")[:2] == [("m", "l", "l-m"), ("l", "k", "k-l")] and {r[0] for r in rows(graph.path_relations(found, e), "relation")} == {"related_to"}


def test_pagerank_converges(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a")])
    few, exact = ({r["entity"]: r["rank"] for r in graph.pagerank(e, rounds=n, tolerance=t).collect()} for n, t in ((100, 1e-6), (60, None)))
    assert all(abs(few[k] - exact[k]) < 1e-5 for k in exact) and abs(sum(few.values()) - 1) < 1e-9
    n = spark.createDataFrame([("a", "t", 3)], "entity string, type string, frequency long")
    top = graph.most_central(graph.pagerank(e), e, n, 2).collect()
    assert len(top) == 2 and {r["entity"]: (r["type"], r["connections"]) for r in top}["a"] == ("t", 4)


def test_five_judges_and_a_run(spark):
    prompts = evaluation.judge_prompts(F.lit("Q"), F.lit("A"), F.lit("C"))
    assert set(prompts) == set(evaluation.JUDGES) and "CONTEXT:\nC" in value(spark, prompts["faithfulness"]) and "CONTEXT" not in value(spark, prompts["safety"])
    questions = spark.createDataFrame([(1, "why water", ["water"]), (2, "why wheat", ["rye"])], "id int, question string, key_concepts array<string>")
    answered = spark.createDataFrame([(1, "because water is scarce in summer", "water is scarce in summer and more"), (2, "", "")], "id int, answer string, context string")
    judged = pipelines.evaluate(questions, answered, Says("SCORE: 8"))
    assert {(r["score"], r["verdict"]) for r in judged.collect()} == {(0.8, "PASS")}
    plain = pipelines.evaluate(questions, answered)
    got = {(r["part"], r["name"]): r["value"] for r in evaluation.run_summary(plain).collect()}
    assert got["mean", "concept_coverage"] == 0.5 and got["verdict", "FAIL"] == 1 and ("mean", "safety") not in got and got["rate", "pass_rate"] == 0.5
    assert json.loads(plain.filter("id = 2").first()["report"])["verdict"] == "FAIL"


def test_service(spark, docs, mentions):
    s = Service(docs, mentions)
    assert not {r["component"]: r["ready"] for r in s.health().collect()}["index"]
    assert {r["name"]: r["n"] for r in s.info().collect()}["documents"] == 4
    q = asked(spark, "what is drip irrigation")
    whole = s.query(q).first()["answer"]
    parts = s.query_stream(q, 20).orderBy("part").collect()
    assert "".join(r["text"] for r in parts) == whole and s.query_async(q, "agent").result().count() == 1 and s.query(q, "orchestrator").count() == 1
    assert s.evaluate(spark.createDataFrame([(1, "q", "a", "c")], "id int, question string, answer string, context string")).count() == 1
    with pytest.raises(ModelError):
        s.query(q, "nothing")


def test_a_model_reranks(spark, docs):
    class Longest:
        def column(self, query, text):
            return F.length(text).cast("double")

    got = pipelines.answer(docs, asked(spark, "what is wheat"), reranker=Longest()).first()
    assert got["citations"].startswith("[1] doc 2") or got["citations"].startswith("[1] doc 1")


def test_chunks_as_schema(spark):
    c = spark.createDataFrame([(1, "text", ["a"] * 7)], "id long, content string, semantic_keywords array<string>")
    got = store.as_schema(c).first()
    assert len(got["semantic_keywords"]) == 5 and got["level"] is None and got["content"] == "text"
    assert json.loads(value(spark, F.lit('{"a":1}'))) == {"a": 1} and json.loads(c.select(store.as_dict(["id", "content"]).alias("j")).first()["j"]) == {"id": 1, "content": "text"}
    assert value(spark, store.metrics_line(clarity=F.lit(0.5), gain=F.lit(1.0))) == "clarity: 0.500 | gain: 1.000"


def test_nearest_by_hashed_texts(spark, docs):
    got = vector_search.hashed_nearest(asked(spark, "drip irrigation wheat", ""), docs, 2).collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"])] == [2, 1]


def test_scratch_must_be_shared(spark, monkeypatch):
    from tessera import scratch

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(SourceError):
        scratch.shared_dir(Far)
