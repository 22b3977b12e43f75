"""Queries of lexical and vector search, fusion, chunk quality and the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text, vectors
from tessera.operators import answers, chunk_quality, evaluation, fusion, lexical, sentences, store, vector_search
from tessera.plans.registry import SENTENCES, TOKENS, query, table

POSTINGS = rf"""tok AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents), posts AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2),
    dl AS (SELECT doc_id, len({TOKENS})::DOUBLE AS dl FROM documents), stats AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*)::DOUBLE AS df FROM posts GROUP BY 1)"""
OKAPI = POSTINGS + ", raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df, stats), terms AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw)"
PLUS = POSTINGS + ", terms AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df, stats)"


def _bm25(terms: str, k1: float, k: int) -> str:
    return rf"""{terms}, q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY 1, 2),
    lex AS (SELECT query_id, doc_id, round(sum(times * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
        FROM q JOIN terms USING (term) JOIN posts USING (term) JOIN dl USING (doc_id), stats GROUP BY 1, 2),
    lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM lex) WHERE rank <= {k} AND score > 0)"""


HASHED = rf"""emb0 AS (SELECT 'd' AS kind, doc_id AS id, unnest({TOKENS}) AS term FROM documents UNION ALL SELECT 'q', item_id, unnest({TOKENS}) FROM benchmark),
    emb1 AS (SELECT kind, id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS dim, count(*)::DOUBLE AS c FROM emb0 GROUP BY 1, 2, 3),
    emb AS (SELECT kind, id, dim, c / sqrt(sum(c * c) OVER (PARTITION BY kind, id)) AS w FROM emb1),
    sem AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(q.w * d.w), 6) AS score FROM emb q JOIN emb d ON q.dim = d.dim AND q.kind = 'q' AND d.kind = 'd' GROUP BY 1, 2),
    semantic AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM sem) WHERE rank <= 20)"""
BOTH = "b AS (SELECT query_id, doc_id, s.rank AS s_rank, s.score AS s_score, k.rank AS k_rank, k.score AS k_score FROM semantic s FULL JOIN lexical k USING (query_id, doc_id))"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _lexical(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return lexical.search(table(spark, d, "documents"), _items(spark, d), k).select("query_id", "doc_id", "score", "rank")


def _semantic(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return vector_search.hashed_nearest(_items(spark, d), table(spark, d, "documents"), k).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {OKAPI} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM terms")
def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical.index(table(spark, d, "documents")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {OKAPI} SELECT term, df::BIGINT AS df, round(idf, 6) AS idf FROM terms")
def bm25_index_update(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    half = lexical.index(docs.filter("doc_id % 2 = 0"))
    return lexical.extended(half, docs.filter("doc_id % 2 <> 0")).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_bm25(OKAPI, 1.5, 10)} SELECT query_id, doc_id, score, rank FROM lexical")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d)


@query(f"WITH {_bm25(PLUS, 1.2, 10)} SELECT query_id, doc_id, score, rank FROM lexical")
def bm25_plus_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(table(spark, d, "documents"), _items(spark, d), 10, mode="plus", k1=1.2).select("query_id", "doc_id", "score", "rank")


@query(f"WITH {HASHED} SELECT query_id, doc_id, score, rank FROM semantic")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return _semantic(spark, d)


@query(
    f"""WITH {_bm25(OKAPI, 1.5, 10)}, {HASHED}, {BOTH}, f AS (SELECT *, round(coalesce(1 / (60.0::DOUBLE + s_rank), 0) + coalesce(1 / (60.0::DOUBLE + k_rank), 0), 9) AS score FROM b)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s_rank ASC NULLS LAST, k_rank NULLS FIRST, doc_id)::BIGINT AS rank FROM f"""
)
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.reciprocal(_semantic(spark, d), _lexical(spark, d))


@query(
    f"""WITH {_bm25(OKAPI, 1.5, 10)}, {HASHED}, {BOTH}, m AS (SELECT *, max(s_score) OVER (PARTITION BY query_id) AS sm, max(k_score) OVER (PARTITION BY query_id) AS km FROM b),
    f AS (SELECT *, round(0.7::DOUBLE * CASE WHEN sm > 0 THEN coalesce(s_score, 0) / sm ELSE 0 END + 0.3::DOUBLE * CASE WHEN km > 0 THEN coalesce(k_score, 0) / km ELSE 0 END, 9) AS score FROM m)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s_rank ASC NULLS LAST, k_rank NULLS FIRST, doc_id)::BIGINT AS rank FROM f"""
)
def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.weighted(_semantic(spark, d), _lexical(spark, d))


@query(
    f"""WITH {_bm25(OKAPI, 1.5, 10)}, {HASHED}, {BOTH}, f AS (SELECT *, round(coalesce(1 / (60.0::DOUBLE + s_rank), 0) + coalesce(1 / (60.0::DOUBLE + k_rank), 0), 9) AS score FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s_rank ASC NULLS LAST, k_rank NULLS FIRST, doc_id)::BIGINT AS rank FROM f)
    SELECT query_id, rank, doc_id, score, md5(text) AS text_md5 FROM r JOIN documents USING (doc_id) WHERE rank <= 5"""
)
def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    best = fusion.reciprocal(_semantic(spark, d), _lexical(spark, d), k=5)
    return fusion.with_documents(best, table(spark, d, "documents")).select("query_id", "rank", "doc_id", "score", F.md5("text").alias("text_md5"))


@query(
    f"""WITH {_bm25(OKAPI, 1.5, 10)}, {HASHED}, u AS (SELECT query_id, doc_id, score FROM semantic UNION ALL SELECT query_id, doc_id, score FROM lexical),
    m AS (SELECT query_id, doc_id, round(max(score), 9) AS score FROM u GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM m) WHERE rank <= 10"""
)
def multi_query_merge(spark: SparkSession, d: str) -> DataFrame:
    return fusion.merged(_semantic(spark, d).unionByName(_lexical(spark, d)), 10)


@query(
    f"""WITH {_bm25(OKAPI, 1.5, 10)}, c AS (SELECT query_id, doc_id, round(len(list_intersect(list_distinct(q.t), d.t)) / len(list_distinct(q.t))::DOUBLE, 9) AS rerank_score
        FROM lexical JOIN (SELECT item_id AS query_id, {TOKENS} AS t FROM benchmark) q USING (query_id) JOIN (SELECT doc_id, {TOKENS} AS t FROM documents) d USING (doc_id))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id)::BIGINT AS rerank FROM c) WHERE rerank <= 5 AND rerank_score >= 0.2"""
)
def rerank_default(spark: SparkSession, d: str) -> DataFrame:
    found = fusion.with_documents(_lexical(spark, d), table(spark, d, "documents")).join(_items(spark, d).withColumnRenamed("text", "query"), "query_id")
    return answers.reranked(found, 5, threshold=0.2).select("query_id", "doc_id", "rerank_score", "rerank")


@query(
    f"""WITH {_bm25(OKAPI, 1.5, 10)}, rel AS (SELECT b.item_id AS query_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    h AS (SELECT l.query_id, l.rank, (r.doc_id IS NOT NULL)::INT AS hit FROM lexical l LEFT JOIN rel r ON l.query_id = r.query_id AND l.doc_id = r.doc_id),
    s AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY rank) AS sofar FROM h),
    p AS (SELECT query_id, sum(CASE WHEN hit = 1 THEN sofar / rank::DOUBLE ELSE 0 END) AS s, sum(hit) AS h FROM s GROUP BY 1), t AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1)
    SELECT query_id, round(CASE WHEN h > 0 THEN s / h ELSE 0 END, 9)::DOUBLE AS ap, round(coalesce(h, 0) / n::DOUBLE, 9)::DOUBLE AS recall FROM t LEFT JOIN p USING (query_id)"""
)
def retrieval_precision(spark: SparkSession, d: str) -> DataFrame:
    docs, items = table(spark, d, "documents"), _items(spark, d).withColumnRenamed("text", "q")
    # A document that holds an item whole has each inner word of it: they meet on the longest one, then texts are compared.
    inner = F.array_sort(F.transform(F.slice(text.tokens("q"), 2, F.greatest(F.size(text.tokens("q")) - 2, F.lit(1))), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    asked = items.select("query_id", "q", F.element_at(inner, 1)["t"].alias("term"))
    terms = lexical.postings(docs).select("doc_id", "term").join(asked, "term")
    relevant = terms.join(docs.select("doc_id", "text"), "doc_id").filter(F.contains("text", "q")).select("query_id", "doc_id")
    return evaluation.average_precision(_lexical(spark, d), relevant).select("query_id", F.round("ap", 9).alias("ap"), F.round("recall", 9).alias("recall"))


VECTORS = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings"


def _nearest_sql(where: str = "") -> str:
    return f"""WITH v AS ({VECTORS}), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0 {where})
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::BIGINT AS rank FROM s) WHERE rank <= 10"""


@query(_nearest_sql())
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return vector_search.nearest(v.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id"), v, 10)


@query(_nearest_sql("AND v.label = 1"))
def vector_topk_where(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return vector_search.nearest(v.filter(F.col("vec_id") % 100 == 0).withColumnRenamed("vec_id", "query_id"), v.filter("label = 1"), 10)


@query(f"SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS length, round(sqrt(list_dot_product(n, n)), 6) AS unit FROM (SELECT *, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS n FROM ({VECTORS}))")
def vector_normalise(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return v.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"), F.round(vectors.norm(vectors.normalised(F.col("embedding"))), 6).alias("unit"))


#: Embeddings in order, a label as a document, every eight of its rows as a chunk.
ROWS = f"v AS ({VECTORS}), r AS (SELECT label AS doc_id, vec_id AS pos, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, e FROM v)"
SIMS = ROWS + ", n AS (SELECT doc_id, pos, i, e, lead(e) OVER (PARTITION BY doc_id ORDER BY pos) AS e2 FROM r), sims AS (SELECT doc_id, pos, round(list_cosine_similarity(e, e2), 9) AS sim FROM n WHERE e2 IS NOT NULL)"


def _rows(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    v = table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("pos"), "embedding")
    return v.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1) / 8))


@query(f"WITH {SIMS} SELECT doc_id, pos, sim FROM sims")
def pairwise_consecutive_sim(spark: SparkSession, d: str) -> DataFrame:
    return chunk_quality.consecutive(_rows(spark, d))


@query(f"WITH {SIMS} SELECT r.doc_id, r.pos, s.sim AS next_sim, lag(s.sim) OVER (PARTITION BY r.doc_id ORDER BY r.pos) AS prev_sim FROM r LEFT JOIN sims s ON r.doc_id = s.doc_id AND r.pos = s.pos")
def per_chunk_similarity(spark: SparkSession, d: str) -> DataFrame:
    return chunk_quality.neighbours(_rows(spark, d))


@query(
    f"WITH {SIMS}, p AS (SELECT doc_id, quantile_cont(1 - sim, 0.8) AS limit0 FROM sims GROUP BY 1) SELECT doc_id, pos, round(1 - sim, 9) AS dissim, round(limit0, 9) AS limit_ FROM sims JOIN p USING (doc_id) WHERE 1 - sim >= limit0"
)
def breakpoints_p80(spark: SparkSession, d: str) -> DataFrame:
    b = chunk_quality.breakpoints(chunk_quality.consecutive(_rows(spark, d)), 0.8, drop=None)
    return b.select("doc_id", "pos", F.round("dissim", 9).alias("dissim"), F.round("limit", 9).alias("limit_"))


@query(
    f"""WITH {SIMS}, d AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, avg(sim) OVER f AS m, stddev_pop(sim) OVER f AS s FROM sims
        WINDOW w AS (PARTITION BY doc_id ORDER BY pos), f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT doc_id, (i + 1)::BIGINT AS position, sim, round(m, 6) AS mean, round(m - 1.5 * s, 6) AS threshold, round((m - 1.5 * s - sim) / (s + 1e-8), 6) AS confidence FROM d WHERE i >= 2 AND i < n - 2 AND n >= 5 AND sim < m - 1.5 * s"""
)
def change_points_w5(spark: SparkSession, d: str) -> DataFrame:
    c = chunk_quality.change_points(chunk_quality.consecutive(_rows(spark, d)))
    return c.select("doc_id", "position", "sim", *(F.round(x, 6).alias(x) for x in ("mean", "threshold", "confidence")))


@query(
    f"""WITH {SIMS}, g AS (SELECT doc_id, sim, sim - lag(sim) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM sims), a AS (SELECT doc_id, avg(g) AS g, count(*) AS m, min(sim) AS sim FROM g GROUP BY 1)
    SELECT DISTINCT r.doc_id, round(CASE WHEN a.m IS NULL THEN 1 WHEN a.m = 1 THEN 1 - a.sim ELSE least(greatest(0.5 - a.g, 0), 1) END, 6)::DOUBLE AS clarity FROM r LEFT JOIN a USING (doc_id)"""
)
def boundary_clarity(spark: SparkSession, d: str) -> DataFrame:
    return chunk_quality.boundary_clarity(_rows(spark, d)).select("doc_id", F.round("clarity", 6).alias("clarity"))


@query(
    f"""WITH {SIMS}, c AS (SELECT *, i // 8 AS chunk FROM r), p AS (SELECT a.doc_id, a.chunk, list_cosine_similarity(a.e, b.e) AS sim FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.chunk = b.chunk AND a.pos < b.pos),
    w AS (SELECT doc_id, avg(v) AS within0 FROM (SELECT doc_id, chunk, var_pop(sim) AS v FROM p GROUP BY 1, 2) GROUP BY 1), b AS (SELECT doc_id, var_pop(sim) AS between0 FROM sims GROUP BY 1)
    SELECT doc_id, round(between0, 6) AS between_, round(within0, 6) AS within_, round(between0 / (within0 + 1e-8), 4) AS stickiness FROM b JOIN w USING (doc_id)"""
)
def stickiness(spark: SparkSession, d: str) -> DataFrame:
    s = chunk_quality.stickiness(_rows(spark, d))
    return s.select("doc_id", F.round("between", 6).alias("between_"), F.round("within", 6).alias("within_"), F.round("stickiness", 4).alias("stickiness"))


@query(
    f"""WITH {ROWS}, h AS (SELECT (doc_id % 10)::INT AS doc_id, avg(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w)::DOUBLE * least(1.0, len(w) / 200.0) ELSE 0 END) AS h
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS w FROM documents) GROUP BY 1),
    mi AS (SELECT a.doc_id, a.pos, avg(greatest(list_cosine_similarity(a.e, b.e), 0)) AS mi FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.pos <> b.pos GROUP BY 1, 2), s AS (SELECT doc_id, avg(mi) AS mi FROM mi GROUP BY 1)
    SELECT h.doc_id, round(CASE WHEN mi IS NULL THEN 1 ELSE least(greatest(h * (1 - mi), 0), 1) END, 6)::DOUBLE AS gain FROM h LEFT JOIN s USING (doc_id)""".replace("\\\\s", "\\s")
)
def chunk_information_gain(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "documents").select((F.col("doc_id") % 10).cast("int").alias("doc_id"), chunk_quality.entropy(text.words("text")).alias("h"))
    return chunk_quality.information_gain(_rows(spark, d), h).select("doc_id", F.round("gain", 6).alias("gain"))


@query(f"WITH {SIMS}, s AS (SELECT avg(sim) AS m, stddev_pop(sim) AS s FROM sims) SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE sim < m - 1.5 * s)::BIGINT AS boundaries FROM sims, s")
def global_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return chunk_quality.global_boundaries(chunk_quality.consecutive(_rows(spark, d)))


@query(
    rf"""WITH q AS (SELECT item_id AS query_id, list_distinct({TOKENS}) AS qt FROM benchmark),
    s AS (SELECT doc_id, a, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS p FROM (SELECT doc_id, list_filter(list_transform({SENTENCES}, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 10) AS a FROM documents)),
    t AS (SELECT doc_id, p, a, unnest(list_distinct(regexp_extract_all(lower(sentence), '[\p{{L}}\p{{N}}\p{{M}}_]+'))) AS term FROM s), qq AS (SELECT query_id, len(qt) AS n, unnest(qt) AS term FROM q),
    c AS (SELECT query_id, doc_id, p, round(count(*) / any_value(n)::DOUBLE, 6) AS score FROM qq JOIN t USING (term) GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, p)::BIGINT AS rank FROM c)
    SELECT k.query_id, k.rank, k.doc_id, k.p::BIGINT AS position, k.score, md5(array_to_string(s.a[greatest(k.p - 3, 0) + 1 : k.p + 4], ' ')) AS text_md5 FROM k JOIN s ON k.doc_id = s.doc_id AND k.p = s.p WHERE rank <= 5 AND score >= 0.1"""
)
def sentence_retrieval(spark: SparkSession, d: str) -> DataFrame:
    index = sentences.sentence_index(table(spark, d, "documents"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(text.tokens("text")).alias("t"))
    q = asked.select("query_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    own = index.select("doc_id", "position", F.explode(F.array_distinct(text.tokens("sentence"))).alias("term"))
    scored = own.join(q, "term").groupBy("query_id", "doc_id", "position").agg(F.round(F.count("*") / F.first("n"), 6).alias("score"))
    return sentences.retrieve(index, scored, threshold=0.1).select("query_id", "rank", "doc_id", "position", "score", F.md5("text").alias("text_md5"))


@query("WITH t AS (SELECT md5(coalesce(text, '')) AS text_hash, count(*)::BIGINT AS n_rows FROM documents GROUP BY 1), c AS (SELECT DISTINCT md5(text) AS text_hash FROM documents WHERE doc_id % 3 = 0) SELECT t.text_hash, n_rows, c.text_hash IS NOT NULL AS hit FROM t LEFT JOIN c USING (text_hash)")
def embedding_cache_miss(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return vector_search.cache_split(docs, docs.filter("doc_id % 3 = 0").select(F.md5("text").alias("text_hash")))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'changed' ELSE lang END AS lang, CASE WHEN doc_id % 10 = 0 THEN 'moved' ELSE source END AS source FROM documents")
def store_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    changes = docs.filter("doc_id % 5 = 0").select("doc_id", F.lit("changed").alias("lang"), F.when(F.col("doc_id") % 10 == 0, "moved").alias("source"))
    return store.updated(docs, changes, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT doc_id + 1000000000, lang FROM documents WHERE doc_id % 100 = 1")
def store_delete_append(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    left = store.deleted(docs, docs.filter("doc_id % 4 = 0"), "doc_id")
    new = docs.filter("doc_id % 100 = 1")
    return store.appended(store.appended(left, new, "doc_id"), new.withColumn("doc_id", F.col("doc_id") + 1000000000), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE lang = 'de' AND source <> 'src0' ORDER BY doc_id LIMIT 50")
def store_get_filtered(spark: SparkSession, d: str) -> DataFrame:
    return store.got(table(spark, d, "documents").select("doc_id", "lang", "source"), (F.col("lang") == "de") & (F.col("source") != "src0"), 50, "doc_id").select("doc_id", "source")


@query("SELECT source, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY 1")
def store_info(spark: SparkSession, d: str) -> DataFrame:
    return store.described(table(spark, d, "documents"), "source")


@query("SELECT lang, source, count(*)::BIGINT AS n, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY ROLLUP (lang, source)")
def chunk_stats_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))
