"""Results worked out by hand, and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import text, vectors
from tessera.operators import answers, chunk_quality, chunking, evaluation, fusion, graph, lexical, memory, routing, sentences, store, tagging, vector_search
from tessera.streaming import ops


def ranking(spark, ids, scores=None):
    return spark.createDataFrame([(1, i, float(scores[k]) if scores else 1.0, k + 1) for k, i in enumerate(ids)], "query_id long, doc_id long, score double, rank long")


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_reciprocal_fusion_keeps_first_seen_on_ties(spark):
    out = sorted(rows(fusion.reciprocal(ranking(spark, [10, 20]), ranking(spark, [20, 10])), "rank", "doc_id", "score"))
    assert [r[1] for r in out] == [10, 20]
    assert out[0][2] == out[1][2] == round(1 / 61 + 1 / 62, 9)


def test_reciprocal_fusion_of_one_ranking(spark):
    assert rows(fusion.reciprocal(ranking(spark, [5]), ranking(spark, [])), "doc_id", "score") == [(5, round(1 / 61, 9))]


def test_reciprocal_fusion_ignores_the_scale_of_scores(spark):
    a, b = ranking(spark, [1, 2, 3], [3, 2, 1]), ranking(spark, [3, 4], [9, 1])
    c = ranking(spark, [1, 2, 3], [300, 200, 100])
    assert sorted(rows(fusion.reciprocal(a, b), "doc_id", "score")) == sorted(rows(fusion.reciprocal(c, b), "doc_id", "score"))


def test_weighted_fusion_with_an_empty_ranking(spark):
    out = sorted(rows(fusion.weighted(ranking(spark, [1, 2], [0.8, 0.4]), ranking(spark, [])), "doc_id", "score"))
    assert out == [(1, 0.7), (2, 0.35)]


def test_okapi_against_plain_python(spark):
    texts = ["the cat sat", "the dog sat on the cat", "the bird", "the the"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    q = spark.createDataFrame([(1, "the the cat")], "query_id long, text string")
    toks = [t.split() for t in texts]
    n, avgdl = len(toks), sum(map(len, toks)) / len(toks)
    df = {w: sum(w in t for t in toks) for t in toks for w in t}
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    want = {}
    for i, t in enumerate(toks):
        s = sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avgdl)) for w in ["the", "the", "cat"] if w in t)
        if any(w in t for w in ("the", "cat")):
            want[i] = s
    got = dict(rows(lexical.scores(lexical.index(docs), q), "doc_id", "score"))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def sims(spark, values):
    return spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "doc_id long, pos long, sim double")


def test_change_points_cannot_fire_at_width_three(spark):
    assert chunk_quality.change_points(sims(spark, [0.9, 0.1, 0.9, 0.0, 1.0]), width=3).count() == 0


def test_change_point_at_width_five(spark):
    assert rows(chunk_quality.change_points(sims(spark, [0.9, 0.9, 0.1, 0.9, 0.9])), "position", F.round("mean", 6), F.round("deviation", 6)) == [(3, 0.74, 0.32)]


def test_clarity_of_two_chunks(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.6, 0.8]), (2, 0, [1.0, 0.0])], "doc_id long, pos long, embedding array<double>")
    assert sorted(rows(chunk_quality.boundary_clarity(v), "doc_id", F.round("clarity", 9))) == [(1, 0.4), (2, 1.0)]


def gain_pair_by_pair(spark, v, h):
    """Mean positive similarity over all pairs of rows at different positions, as the SQL has it."""
    a, b = (v.select("doc_id", F.col("pos").alias(i), F.col("embedding").alias(e)) for i, e in (("i", "ea"), ("j", "eb")))
    mi = a.join(b, "doc_id").filter("i <> j").groupBy("doc_id", "i").agg(F.avg(F.greatest(vectors.cosine(F.col("ea"), F.col("eb")), F.lit(0.0))).alias("mi")).groupBy("doc_id").agg(F.avg("mi").alias("mi"))
    gain = F.when(F.col("mi").isNull(), 1.0).otherwise(vectors.clipped(F.col("h") * (1 - F.col("mi"))))
    return dict(rows(h.join(mi, "doc_id", "left"), "doc_id", gain))


@pytest.mark.parametrize("most", [2, 3, 8192])
def test_gain_of_odd_rows_equals_all_pairs(spark, most, monkeypatch):
    """Over several blocks of a document, or one: repeated positions, copies, nulls, no length, other widths, NaN."""
    monkeypatch.setattr(chunk_quality, "LEAST", most)
    monkeypatch.setattr(chunk_quality, "MOST", most)
    monkeypatch.setattr(chunk_quality, "HELD", 8)
    rng = np.random.default_rng(3)
    made = [(1, i, rng.normal(size=4).tolist()) for i in range(9)] + [(1, 3, rng.normal(size=4).tolist()), (1, 3, None), (1, 9, [1.0, None, 0.0, 2.0]), (1, 10, [0.0] * 4), (1, 11, [1.0, 2.0]), (1, 12, [])]
    made += [(2, 0, [1.0, 0.0]), (2, 1, [0.6, 0.8]), (3, 0, [1.0, 0.0]), (4, 5, [1.0, 0.0]), (4, 5, [1.0, 0.0]), (5, 0, [1.0, 1.0]), (5, 0, [1.0, 1.0]), (5, 1, [1.0, 1.0])]
    made += [(6, None, [1.0]), (None, 0, [1.0]), (7, 0, [1.0, math.nan]), (7, 1, [0.0, 0.0]), (8, 0, [1.0, 0.0]), (8, 1, [-1.0, 0.0]), (9, 0, None), (9, 1, None)]
    v = spark.createDataFrame(made, "doc_id long, pos long, embedding array<double>")
    h = spark.createDataFrame([(d, d, 0.7) for d in range(1, 12)], "doc_id long, pos long, h double")
    got = dict(rows(chunk_quality.information_gain(v, h), "doc_id", "gain"))
    want = gain_pair_by_pair(spark, v, h)
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 for d in want), (got, want)


def test_gain_makes_no_row_of_a_pair(spark):
    """12,000 rows of one document are 144 million pairs: as rows they would take minutes."""
    v = spark.range(12_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("pos"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.sin(F.col("id") * k).cast("float")).alias("embedding"))
    h = spark.createDataFrame([(1, 0, 1.0)], "doc_id int, pos long, h double")
    x = np.array([r["embedding"] for r in v.select("embedding").collect()])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    want = 1 - (sum(np.maximum(x[i : i + 1000] @ x.T, 0).sum() for i in range(0, len(x), 1000)) - (x * x).sum()) / len(x) / (len(x) - 1)
    gain = chunk_quality.information_gain(v, h)
    assert abs(gain.first()["gain"] - want) < 1e-9
    assert "FlatMapGroupsInArrow" in gain._jdf.queryExecution().toString()


def test_sentences(spark):
    t = F.lit("Aaaa bbbb cc. Dd! Eeee ffff gggg?")
    assert len(value(spark, text.sentences(t))) == 3
    assert len(value(spark, text.sentences(t, 11))) == 2
    assert len(value(spark, text.sentences(F.lit("123456789."), 10))) == 1 and len(value(spark, text.sentences(F.lit("123456789."), 11))) == 0


def test_windows_at_the_start(spark):
    docs = spark.createDataFrame([(1, " ".join(f"sentence {c}." for c in "abcde"))], "doc_id long, text string")
    r = sentences.sentence_index(docs).filter("position = 0").first()
    assert (r["window_before"], r["window_after"]) == ("", "sentence b. sentence c. sentence d.")
    assert r["window_full"] == "sentence a. sentence b. sentence c. sentence d."


def test_chunk_id(spark):
    assert value(spark, text.chunk_id(F.lit("a"), F.lit(1), F.lit(0))) == "a3932579fe52"


def test_answer_confidence(spark):
    assert value(spark, evaluation.answer_confidence(F.lit("x [Source: a] not sure"), F.lit(3))) == 0.65


@pytest.mark.parametrize(("said", "want"), [("SCORE: 8", 0.8), ("SCORE: 5", 1.0), ("SCORE: 4", 0.8), ("SCORE: 1", 1.0), ("none", 0.5)])
def test_scores(spark, said, want):
    assert value(spark, evaluation.parsed_score(F.lit(said))) == want


def test_score_with_a_scale(spark):
    assert value(spark, evaluation.parsed_score(F.lit("SCORE: 5"), scale=10)) == 0.5


@pytest.mark.parametrize(("score", "want"), [(0.7, "PASS"), (0.69, "MARGINAL"), (0.5, "MARGINAL"), (0.49, "FAIL")])
def test_verdicts(spark, score, want):
    assert value(spark, evaluation.verdict(F.lit(score))) == want


def test_calibration_takes_the_bias_off_twice_unless_corrected(spark):
    args = (F.lit(0.7), F.lit(0.5), F.lit(0.7), F.lit(0.2), F.lit(1.0))
    assert value(spark, F.round(evaluation.calibrated(*args), 9)) == 0.3
    assert value(spark, F.round(evaluation.calibrated(*args, corrected=True), 9)) == 0.5


def test_calibration_of_few_pairs_does_nothing(spark):
    r = evaluation.fit_calibration(spark.createDataFrame([(0.1, 0.9)], "human double, judge double")).first()
    assert (r["bias"], r["scale"]) == (0.0, 1.0)


@pytest.mark.parametrize(("hops", "shortest", "want"), [(4, 2, 0.5), (0, 2, 1.0), (2, 0, 1.0)])
def test_step_efficiency(spark, hops, shortest, want):
    assert value(spark, evaluation.step_efficiency(F.lit(hops), F.lit(shortest))) == want


def test_loops(spark):
    assert abs(value(spark, evaluation.loop_prevention(F.array(F.lit("x"), F.lit("y"), F.lit("x")))) - 2 / 3) < 1e-12


@pytest.mark.parametrize(("apart", "edges"), [(499, 1), (500, 0)])
def test_pairs_within_the_distance(spark, apart, edges):
    m = spark.createDataFrame([(1, "a", "x", 0), (1, "b", "y", apart)], "doc_id long, type string, entity string, start long")
    assert graph.cooccurrences(m).count() == edges


def test_default_route(spark):
    r = routing.classify(spark.createDataFrame([(1, "zzz")], "query_id long, text string")).first()
    assert (r["intent"], r["confidence"]) == ("reasoning", 0.3)


@pytest.mark.parametrize(
    ("question", "want"),
    [("What is drip irrigation?", "factual"), ("Summarize the report", "summary"), ("How to install a pump", "procedural"), ("Compare drip and sprinkler", "comparative"), ("relationship between soil and water", "relational"), ("Why is yield low", "reasoning")],
)
def test_routes(spark, question, want):
    assert routing.classify(spark.createDataFrame([(1, question)], "query_id long, text string")).first()["intent"] == want


def test_decomposition(spark):
    q = spark.createDataFrame([(1, "What is soil and how to water it?")], "query_id long, text string")
    assert sorted(rows(routing.decompose(q), "sub_no", "sub_text", "sub_type", "tool")) == [(0, "What is soil?", "factual", "vector"), (1, "how to water it?", "procedural", "vector")]


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src string, dst string, doc_id long")


def test_paths_and_traversal(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("d", "c"), ("x", "y")])
    pairs = spark.createDataFrame([("a", "d"), ("a", "x")], "a string, b string")
    assert sorted(rows(graph.shortest_paths(e, pairs), "a", "b", "length", "path")) == [("a", "d", 3, ["a", "b", "c", "d"]), ("a", "x", -1, None)]
    found = graph.traverse(e, spark.createDataFrame([("a",)], "start string"), 2)
    assert sorted(rows(found, "depth", "entity")) == [(0, "a"), (1, "b"), (2, "c")]


def test_pagerank_sums_to_one_with_dangling_nodes(spark):
    ranks = graph.pagerank(edges(spark, [("a", "b"), ("a", "b"), ("a", "c"), ("c", "b")]), rounds=30)
    got = dict(rows(ranks, "entity", "rank"))
    assert abs(sum(got.values()) - 1) < 1e-9 and got["b"] > got["c"] > got["a"]


def test_segments_at_the_least_length(spark):
    s = spark.createDataFrame([(1, 0, "a" * 100, True), (1, 1, "b" * 799, True), (1, 2, "c" * 800, True)], "doc_id long, position long, sentence string, is_break boolean")
    assert sorted(rows(chunking.semantic_segments(s), "chunk_no", F.length("content"))) == [(0, 900), (1, 800)]


def test_bridges(spark):
    chunks = F.array(F.lit("x" * 90 + "ab. cdefg."), F.lit("second"), F.lit("third"))
    assert value(spark, chunking.bridged(chunks))[:2] == ["x" * 90 + "ab. cdefg.", "cdefg. second"]
    assert value(spark, chunking.bridged(F.array(F.lit("y" * 30), F.lit("z")))) == ["y" * 30, "yyy z"]


def test_recursive_split_covers_all_words(spark):
    body = "\n\n".join(" ".join(f"w{i}x{j}." for j in range(40)) for i in range(6))
    docs = spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, text string")
    out = chunking.recursive_split(docs, 200, 30).collect()
    assert {r["doc_id"] for r in out} == {1} and max(len(r["content"]) for r in out) <= 200
    # A separator stays at the head of the piece behind it.
    assert {w.strip(".") for r in out for w in r["content"].split()} - {""} == {w.strip(".") for w in body.split()}


def test_cosine_of_a_null_vector(spark):
    assert value(spark, vectors.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0.0


def test_nearest_in_blocks(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(20)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id < 4").withColumnRenamed("vec_id", "query_id")
    whole = sorted(rows(vector_search.nearest(q, v, 3), "query_id", "rank", "vec_id"))
    monkeypatch.setattr(vector_search, "QUERY_BYTES", 16)
    assert sorted(rows(vector_search.nearest(q, v, 3), "query_id", "rank", "vec_id")) == whole


def test_store(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    assert store.appended(s, spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "id long, text string")).count() == 3
    assert rows(store.updated(s, spark.createDataFrame([(2, "z")], "id long, text string")).orderBy("id"), "text") == [("a",), ("z",)]
    assert rows(store.deleted(s, spark.createDataFrame([(1,)], "id long")), "id") == [(2,)]


def test_memory_and_topics(spark):
    turns = spark.createDataFrame([(1, 0, "user", "apples and pears"), (1, 1, "assistant", "yes"), (1, 2, "user", "fast cars"), (1, 3, "assistant", "no"), (1, 4, "user", "alone")], "conv_id long, turn long, role string, text string")
    pairs = memory.exchanges(turns)
    assert memory.history(pairs, 1).first()["history"] == "User: fast cars\nAssistant: no"
    assert sorted(rows(memory.topic_shifts(pairs), "exchange", "clear")) == [(1, False), (2, True)]


def test_keywords_are_not_doubled(spark):
    k = tagging.keywords(F.array(F.lit("Wheat")), F.array(F.lit("water_use")), F.lit("wheat basin"), ["wheat", "basin"], ["farming", "water"])
    assert value(spark, k) == ["Wheat", "water use", "basin", "farming", "water"]


def test_rerank_threshold(spark):
    c = spark.createDataFrame([(1, 1, "a b", "a b c"), (1, 2, "a b", "z")], "query_id long, doc_id long, query string, text string")
    assert rows(answers.reranked(c, 5, threshold=0.5), "doc_id", "rerank_score") == [(1, 1.0)]


def test_stream_and_batch_agree(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = ops.source(spark, f"{sf}/events.parquet")
    got = ops.to_memory(ops.windowed_counts(stream), "test_windows")
    assert got.agg(F.sum("n")).first()[0] == batch.count()


def test_stream_ingestion(spark, sf, tmp_path):
    ops.ingest(ops.source(spark, f"{sf}/documents.parquet"), str(tmp_path / "chunks"), str(tmp_path / "checkpoint"))
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == chunking.sliding_windows(spark.read.parquet(f"{sf}/documents.parquet")).count()


def test_pages_from_files(spark, tmp_path):
    from tessera.sources import files

    (tmp_path / "documents" / "maps").mkdir(parents=True)
    (tmp_path / "documents" / "maps" / "a.pdf").write_bytes(b"one\ftwo")
    extract = lambda content: [(i, t, [[["x", None]]] if i == 1 else []) for i, t in enumerate(content.decode().split("\f"), 1)]
    pages = files.pages(files.files(spark, str(tmp_path)), extract)
    assert sorted(rows(pages, "page", "category", "text", "has_table")) == [(1, "maps", "one\n[TABLE DATA]\nx | ", True), (2, "maps", "two", False)]
    assert files.full_text(pages).first()["text"] == "one\n[TABLE DATA]\nx | \n\ntwo"


def test_multi_hop(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    paths, hubs = graph.multi_hop(e, spark.createDataFrame([("a",), ("d",)], "entity string"))
    assert rows(paths, "a", "b", "length", "between") == [("a", "d", 3, ["b", "c"])]
    assert sorted(rows(hubs, "entity", "n")) == [("b", 2), ("c", 2)]


def test_report_and_markdown(spark):
    import json

    scores = {"faithfulness": F.lit(0.12345), "answer_relevancy": F.lit(None).cast("double"), "context_relevancy": F.lit(0.9), "domain_accuracy": F.lit(0.9), "safety": F.lit(0.9)}
    told = json.loads(value(spark, evaluation.report(F.lit("q" * 200), scores, evaluation.overall(scores))))
    assert (len(told["query"]), told["scores"]["faithfulness"], told["recommendations"]) == (100, 0.123, ["grounding"]) and "answer_relevancy" not in told["scores"]
    findings = F.array(F.struct(F.lit("x").alias("text"), F.lit("[Source: s]").alias("citation")), F.struct(F.lit("y").alias("text"), F.lit("").alias("citation")))
    text_ = value(spark, answers.markdown(F.lit("sum"), findings, F.lit("[1] s"), F.lit(0.5)))
    assert "1. x [Source: s]\n2. y\n" in text_ and text_.endswith("Confidence: 0.50")


def test_judges_take_any_model(spark):
    class Says:
        def column(self, c):
            return F.concat(F.lit("Score: "), c)

    df = spark.createDataFrame([("8",), ("none",)], "p string")
    assert sorted(rows(evaluation.judged(df, Says(), {"safety": F.col("p")}), "safety")) == [(0.5,), (0.8,)]


def test_metadata_is_flat(spark):
    m = value(spark, store.metadata({"a": F.lit(1), "b": F.to_json(F.array(F.lit("x"))), "c": F.lit(None).cast("string")}))
    assert m == {"a": "1", "b": '["x"]'}


def test_prompt_leaves_out_what_is_empty(spark):
    p = value(spark, answers.prompt("Be brief.", F.lit(""), F.lit("ctx"), F.lit(None).cast("string"), F.lit("why")))
    assert p == "Be brief.\n\nContext:\nctx\n\nQuestion:\nwhy"
