"""The pipeline's stages against brute force, each on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import pii
from tests.llm.test_operators import components_of, contamination, measures, shingles, strict


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(f(spark, out[-1], sf).cache())
    return [{r["doc_id"]: r for r in df.collect()} for df in out]


def test_quality_stage(stages):
    want = set()
    for d, r in stages[0].items():
        n, _, _, _, repeated = measures(r["text"])
        if not (n < 10 or 100 * repeated > 20 * n):
            want.add(d)
    assert set(stages[1]) == want  # so few labels show no further cutoff
    assert all(stages[1][d] == stages[0][d] for d in want)


def test_near_duplicate_stage(stages):
    found = components_of({d: shingles(r["text"]) for d, r in stages[1].items()})
    assert set(stages[2]) == {d for d, c in found.items() if c == d}


def test_decontamination_stage(spark, sf, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    found = contamination([(d, r["text"]) for d, r in stages[2].items()], items)
    assert set(stages[3]) == {d for d, x in found.items() if not x[3]}


def test_pii_stage(spark, stages):
    """Each text is what the strict patterns and the trained model leave of it; those without spans stay as they are."""
    docs = spark.createDataFrame([(d, r["text"]) for d, r in stages[3].items()], "doc_id long, text string")
    model = pii.fit(pii.pattern_counts(docs))
    assert set(stages[4]) == set(stages[3])
    changed = 0
    for d, r in stages[4].items():
        text = stages[3][d]["text"]
        base, spans = pii.spans_of(text, model)
        assert {k: v for k, v in base.items() if v} == {k: v for k, v in strict(text).items() if v}
        assert r["text"] == pii.redacted(text, spans) and r["n_chars"] == len(r["text"])
        assert all(r[c] == stages[3][d][c] for c in ("lang", "source"))
        changed += bool(spans)
        assert spans or r["text"] == text
    assert changed


def test_last_stage(stages):
    assert set(stages[5]) == set(stages[4]) and all(r["n_tokens"] == len(r["ids"]) for r in stages[5].values())


def test_run(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"]: (r["n_tokens"], r["decoded_sha256"]) for r in got.collect()} == {d: (r["n_tokens"], r["decoded_sha256"]) for d, r in stages[5].items()}
    assert got.select(F.count_distinct("doc_id")).first()[0] == len(stages[5])
