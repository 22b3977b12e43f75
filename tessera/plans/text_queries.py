"""Queries of sources, cleaning, sentences, chunking and tagging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import chunking, sentences, store, tagging
from tessera.plans.registry import LEXICON, ORACLES, SENTENCES, TOKENS, query, table


@query(
    r"""SELECT page_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)"""
)
def html_text(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "pages").select("page_id", text.html_text("html").alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@query(
    rf"""SELECT doc_id, len({TOKENS})::BIGINT AS n_tokens, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda w: w <> ''))::BIGINT AS n_words,
    length(text)::BIGINT AS n_chars, (length(text) // 4)::BIGINT AS token_estimate FROM documents"""
)
def doc_token_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        "doc_id", F.size(text.tokens("text")).cast("long").alias("n_tokens"), F.size(text.words("text")).cast("long").alias("n_words"), F.length("text").cast("long").alias("n_chars"), text.token_estimate("text").alias("token_estimate")
    )


@query(
    r"""SELECT doc_id, length(t)::BIGINT AS n_chars, md5(t) AS text_md5 FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), 'Page \d+ of \d+', '', 'g'), '\d+\s*\|\s*Page', '', 'g'), '\.{3,}', '...', 'g'), '-{3,}', '---', 'g')) AS t FROM documents)"""
)
def clean_page(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", text.clean_page("text").alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("text_md5"))


@query(
    r"""SELECT doc_id, CASE WHEN length(r) > 0 THEN round((length(r) - length(t)) / length(r)::DOUBLE, 9) ELSE 0 END AS noise_ratio, md5(trim(regexp_replace(t, '\s+', ' ', 'g'))) AS clean_md5
    FROM (SELECT doc_id, coalesce(text, '') AS r, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
    '(?im)Page \d+ of \d+', '', 'g'), '(?im)\d+\s*\|\s*Page', '', 'g'), '(?im)©.*?\d{4}', '', 'g'), '(?im)All rights reserved', '', 'g'), '(?im)www\.\S+', '', 'g'), '(?im)http[s]?://\S+', '', 'g'), '(?im)^\s*\d+\s*$', '', 'g') AS t FROM documents)"""
)
def clean_noise_ratio(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", text.text_of("text").alias("r"), text.without_noise("text").alias("t"))
    return t.select("doc_id", F.round(text.noise_ratio(F.col("r"), F.col("t")), 9).alias("noise_ratio"), F.md5(text.squeezed(F.col("t"))).alias("clean_md5"))


@query("SELECT doc_id, length(trim(text))::BIGINT AS n_chars FROM documents WHERE length(text) >= 50 AND length(trim(text)) >= 50")
def short_doc_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter((F.length("text") >= 50) & (F.length(F.trim("text")) >= 50))
    return docs.select("doc_id", F.length(F.trim("text")).cast("long").alias("n_chars"))


def _windows_sql(first: bool) -> str:
    kept = r"list_filter(list_transform({0}, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 10)" if first else r"list_transform({0}, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g'))"
    return rf"""WITH s AS (SELECT doc_id, {kept.format(SENTENCES)} AS a FROM documents), e AS (SELECT doc_id, a, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS p FROM s)
        SELECT doc_id, p::BIGINT AS position, md5(sentence) AS sentence_md5, md5(array_to_string(a[greatest(p - 3, 0) + 1 : p], ' ')) AS before_md5,
        md5(array_to_string(a[p + 2 : p + 4], ' ')) AS after_md5, md5(array_to_string(a[greatest(p - 3, 0) + 1 : p + 4], ' ')) AS full_md5 FROM e {"" if first else "WHERE length(sentence) >= 10"}"""


def _windows(spark: SparkSession, d: str, first: bool) -> DataFrame:
    out = sentences.sentence_index(table(spark, d, "documents"), filter_first=first)
    return out.select("doc_id", "position", F.md5("sentence").alias("sentence_md5"), F.md5("window_before").alias("before_md5"), F.md5("window_after").alias("after_md5"), F.md5("window_full").alias("full_md5"))


@query(_windows_sql(True))
def sentence_index(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d, True)


@query(_windows_sql(False))
def sentence_index_presplit(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d, False)


SLIDING = r"""w0 AS (SELECT doc_id, text AS t, length(text) AS n, unnest(range(0, length(text), 1000)) AS start FROM documents WHERE length(text) > 0),
    w1 AS (SELECT *, substring(t, start + 1, 1400) AS w FROM w0), w2 AS (SELECT *, CASE WHEN strpos(reverse(w), ' .') > 0 THEN length(w) - strpos(reverse(w), ' .') - 1 ELSE -1 END AS p FROM w1),
    windows AS (SELECT doc_id, start::BIGINT AS start, regexp_replace(CASE WHEN start + 1400 < n AND p > 200 THEN substring(w, 1, p + 1) ELSE w END, '^\s+|\s+$', '', 'g') AS content FROM w2),
    kept AS (SELECT * FROM windows WHERE length(content) >= 200)"""


@query(f"WITH {SLIDING} SELECT doc_id, start, length(content)::BIGINT AS n_chars, md5(content) AS content_md5 FROM kept")
def sliding_char_windows(spark: SparkSession, d: str) -> DataFrame:
    w = chunking.sliding_windows(table(spark, d, "documents"))
    return w.select("doc_id", "start", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5"))


@query(
    f"""WITH {SLIDING}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM kept)
    SELECT doc_id, i::BIGINT AS chunk_index, n::BIGINT AS total_chunks, substr(md5(doc_id || '_1_' || i), 1, 12) AS chunk_id FROM r"""
)
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_rows(chunking.sliding_windows(table(spark, d, "documents"))).select("doc_id", "chunk_index", "total_chunks", "chunk_id")


@query(
    f"""WITH {SLIDING} SELECT count(*)::BIGINT AS n_chunks, count(DISTINCT k.doc_id)::BIGINT AS n_sources, count(DISTINCT d.source)::BIGINT AS n_categories, round(avg(length(content)), 6) AS mean_chars
    FROM kept k JOIN documents d USING (doc_id)"""
)
def page_chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    w = chunking.sliding_windows(docs).join(docs.select("doc_id", F.col("source").alias("category")), "doc_id")
    return store.page_summary(w.select(F.col("doc_id").alias("source"), "category", F.col("content").alias("text")))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
    k AS (SELECT doc_id, no, trim(raw) AS line, CASE WHEN regexp_matches(trim(raw), '^#+\s+(.+)$') THEN 'markdown' WHEN regexp_matches(trim(raw), '^(\d+\.[\d.]*)\s+(.+)$') THEN 'numbered'
        WHEN regexp_matches(trim(raw), '^([A-Z][A-Z\s]{5,50})$') THEN 'caps' WHEN regexp_matches(trim(raw), '^(Chapter|Section|Part)\s+[\dIVXLC]+[:\s]+(.+)') THEN 'formal' END AS kind FROM l)
    SELECT coalesce(kind, 'none') AS kind, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs, min(no)::BIGINT AS first_line FROM k GROUP BY 1"""
)
def header_detect(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    kinds = lines.select("doc_id", "no", F.coalesce(text.header_kind(F.trim("raw")), F.lit("none")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.min("no").cast("long").alias("first_line"))


@query(
    r"""SELECT doc_id, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: length(l) BETWEEN 5 AND 60)[1:3], lambda h: substring(h, 1, 30)), ' > ') AS path,
    array_to_string(list_filter(['[Document: ' || replace(replace(source || '_' || lang, '_', ' '), '-', ' ') || ']', '[Section: ' || lang || ']', CASE WHEN doc_id % 7 > 0 THEN '[Page: ' || (doc_id % 7) || ']' END], lambda x: x IS NOT NULL), ' ') AS header,
    md5('[DOC_ORIGIN: ' || source || ']' || chr(10) || '[SUB_SECTION: ' || lang || ']' || chr(10) || '[LOCAL_SCOPE: ' || lang || ']' || chr(10) || '[CONTENT]: ' || text) AS injected_md5 FROM documents"""
)
def contextual_header(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    short = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: F.length(x).between(5, 60))
    return docs.select(
        "doc_id", text.header_path(short).alias("path"), text.contextual_header(F.concat_ws("_", "source", "lang"), F.col("lang"), F.col("doc_id") % 7).alias("header"),
        F.md5(text.injected(F.col("source"), F.col("lang"), F.col("lang"), F.col("text"))).alias("injected_md5"),
    )


@query(
    """SELECT doc_id, 'Document: ' || replace(replace(source || '_' || lang, '_', ' '), '-', ' ') || '; Topic: ' || CASE WHEN len(t) > 0 THEN array_to_string(t[1:2], '; ') WHEN contains(lower(text), 'que') THEN 'que management' ELSE 'general practices' END AS header
    FROM (SELECT *, list_filter([CASE WHEN contains(lower(text), 'the') THEN 'the Basin' END, CASE WHEN contains(lower(text), 'und') THEN 'und systems' END, CASE WHEN contains(lower(text), 'der') THEN 'der cultivation' END], lambda x: x IS NOT NULL) AS t FROM documents)"""
)
def global_header(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    told = [F.when(low.contains(w), F.lit(f"{w} {kind}")) for w, kind in (("the", "Basin"), ("und", "systems"), ("der", "cultivation"))]
    fallback = F.when(low.contains("que"), "que management").otherwise("general practices")
    return table(spark, d, "documents").select("doc_id", text.global_header(F.concat_ws("_", "source", "lang"), told, fallback).alias("header"))


@query(r"""SELECT page_id, CASE WHEN string_split(url, '/')[-2] = 'documents' THEN 'uncategorized' ELSE string_split(url, '/')[-2] END AS category FROM pages""")
def category_from_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.category_of(F.col("url")).alias("category"))


@query(
    r"""SELECT n_regionkey::BIGINT AS region, string_agg(array_to_string([coalesce(n_name, ''), CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE n_nationkey::VARCHAR END], ' | '), chr(10) ORDER BY n_nationkey) AS body FROM nation GROUP BY 1"""
)
def table_text(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array("n_name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey").cast("string")))
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", cells.alias("c")))), lambda x: x["c"]).alias("rows"))
    return rows.select("region", text.table_text(F.col("rows")).alias("body"))


@query(
    rf"""WITH {LEXICON} SELECT d.doc_id, coalesce(string_agg(DISTINCT l.label, ',' ORDER BY l.label), '') AS topics, arg_min(l.term, l.ordinal) AS first_term
    FROM documents d LEFT JOIN lexicon l ON contains(lower(d.text), l.term) GROUP BY d.doc_id"""
)
def topic_tags(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    lexicon = tagging.data_lexicon(docs).cache()
    tagged = tagging.topics(docs, lexicon).select("doc_id", F.array_join("topics", ",").alias("topics"))
    return tagged.join(docs.select("doc_id", tagging.first_of(lexicon, text.text_of("text")).alias("first_term")), "doc_id")


@query(
    r"""WITH s AS (SELECT doc_id,
        (regexp_matches(text, '(?i)\d+\.?\d*\s*(%|mm|cm|m|kg|ha|L|°C|pH|kPa|bar|m³)'))::INT + regexp_matches(text, '(?i)\b(specification|parameter|measurement|value|rate|coefficient|ratio)\b')::INT + regexp_matches(text, '(?i)\b(table|figure|equation|formula|calculation)\b')::INT AS t,
        regexp_matches(text, '(?i)\b(should|must|need to|require|recommend|ensure|avoid|maintain)\b')::INT + regexp_matches(text, '(?i)\b(step|procedure|method|process|guide|instruction|how to)\b')::INT + regexp_matches(text, '(?i)\b(first|then|next|finally|after|before)\b')::INT AS i,
        regexp_matches(text, '(?i)\b(is defined as|refers to|means|concept|theory|principle)\b')::INT + regexp_matches(text, '(?i)\b(because|therefore|thus|however|although|in order to)\b')::INT + regexp_matches(text, '(?i)\b(importance|significance|role|impact|effect|relationship)\b')::INT AS c FROM documents)
    SELECT doc_id, CASE WHEN t >= i AND t >= c THEN 'Technical' WHEN i >= c THEN 'Instructional' ELSE 'Conceptual' END AS intent FROM s"""
)
def chunk_intent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tagging.intent(F.col("text")).alias("intent"))


@query(
    f"""WITH i AS ({ORACLES["chunk_intent"]}), c AS ({ORACLES["clean_noise_ratio"]}) SELECT intent, count(*)::BIGINT AS n, round_even(avg(length(text)), 2)::DOUBLE AS mean_chars, round_even(avg(noise_ratio), 4)::DOUBLE AS mean_noise
    FROM documents JOIN i USING (doc_id) JOIN c USING (doc_id) GROUP BY 1"""
)
def semantic_chunk_summary(spark: SparkSession, d: str) -> DataFrame:
    raw, reduced = text.text_of("text"), text.without_noise("text")
    rows = table(spark, d, "documents").select(tagging.intent(F.col("text")).alias("intent"), F.length("text").alias("n_chars"), F.round(text.noise_ratio(raw, reduced), 9).alias("noise"))
    return store.semantic_summary(rows)


@query(
    rf"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform({SENTENCES}, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 20)) AS s FROM documents)
    SELECT doc_id, count(*)::BIGINT AS n, md5(string_agg(s, '|' ORDER BY s)) AS all_md5 FROM s
    WHERE regexp_matches(s, '(?i)\d+\.?\d*\s*(%|mm|cm|m|kg|ha|L|°C|pH|kPa|bar|m³)') OR regexp_matches(s, '(?i)^(should|must|need to|require|recommend|ensure|avoid|maintain)') GROUP BY doc_id"""
)
def propositions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", text.propositions("text").alias("p")).filter(F.size("p") > 0)
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("p"), "|")).alias("all_md5"))


@query(
    rf"""WITH {LEXICON}, m AS (SELECT doc_id, list_distinct({TOKENS}) AS ws, list_distinct(regexp_extract_all(text, '\d+\.?\d*\s*(?:%|mm|cm|m|kg|ha|L|°C|pH|kPa|bar|m³)')) AS ms FROM documents),
    e AS (SELECT m.doc_id, list_sort(list(l.term)) AS es FROM m JOIN lexicon l ON list_contains(m.ws, l.term) AND l.label IN ('t0', 't1') GROUP BY m.doc_id)
    SELECT m.doc_id, coalesce(array_to_string(e.es, ','), '') AS entities,
        array_to_string(list_sort(list_distinct(list_transform(ms, lambda x: regexp_replace(x, '^(\d+\.?\d*)\s*', '\1 ')))), ',') AS measures FROM m LEFT JOIN e USING (doc_id)"""
)
def chunk_entities(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    hit = tagging.mentions(docs, tagging.data_lexicon(docs).filter(F.col("label").isin("t0", "t1"))).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("entity")), ",").alias("entities"))
    return docs.select("doc_id", F.array_join(tagging.measures(F.col("text")), ",").alias("measures")).join(hit, "doc_id", "left").select("doc_id", F.coalesce("entities", F.lit("")).alias("entities"), "measures")


@query(
    rf"""WITH k AS (SELECT doc_id, list_concat(list_concat(list_sort(list_distinct(list_filter({TOKENS}, lambda w: length(w) = 9)))[1:2], ['source ' || source]),
        list_concat(list_filter(['the', 'water basin', 'der', 'la', 'que', 'Of'], lambda t: contains(lower(text), lower(t))), ['agriculture', 'water', 'farming', 'resource', 'management'])) AS k FROM documents),
    u AS (SELECT doc_id, list_filter(k, lambda x, i: list_position(list_transform(k, lambda y: lower(y)), lower(x)) = i) AS k FROM k) SELECT doc_id, array_to_string(k[1:5], ',') AS keywords FROM u"""
)
def chunk_keywords(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    own = F.array_sort(F.array_distinct(F.filter(text.tokens("text"), lambda w: F.length(w) == 9)))
    found = tagging.keywords(own, F.array(F.concat(F.lit("source_"), F.col("source"))), text.text_of("text"), ["the", "water basin", "der", "la", "que", "Of"], ["agriculture", "water", "farming", "resource", "management"])
    return docs.select("doc_id", F.array_join(found, ",").alias("keywords"))


@query(
    rf"""WITH s AS (SELECT doc_id, unnest(a) AS sentence, generate_subscripts(a, 1) AS p FROM (SELECT doc_id, list_filter(list_transform({SENTENCES}, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) > 10) AS a FROM documents)),
    g AS (SELECT *, coalesce(sum((length(sentence) % 5 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM s),
    c AS (SELECT doc_id, seg, string_agg(sentence, ' ' ORDER BY p) AS content, count(*) AS n FROM g GROUP BY 1, 2),
    k AS (SELECT *, sum((seg = 0 OR length(content) >= 800)::INT) OVER (PARTITION BY doc_id ORDER BY seg) - 1 AS chunk_no FROM c)
    SELECT doc_id, chunk_no::BIGINT AS chunk_no, sum(n)::BIGINT AS n_sentences, md5(string_agg(content, ' ' ORDER BY seg)) AS content_md5 FROM k GROUP BY 1, 2"""
)
def semantic_split(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences("text", 11)).alias("position", "sentence")).withColumn("is_break", F.length("sentence") % 5 == 0)
    return chunking.semantic_segments(s).select("doc_id", "chunk_no", "n_sentences", F.md5("content").alias("content_md5"))


@query()
def recursive_split(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive_split(table(spark, d, "documents"))


@query(
    rf"""WITH RECURSIVE {SLIDING}, w AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS i FROM kept),
    b(doc_id, i, content) AS (SELECT doc_id, i, content FROM w WHERE i = 0 UNION ALL
        SELECT doc_id, i, CASE WHEN length(bridge) > 0 THEN bridge || ' ' || content ELSE content END FROM (
            SELECT doc_id, i, content, trim(CASE WHEN instr(tail, '. ') > 1 THEN substr(tail, instr(tail, '. ') + 2) ELSE tail END, ' ') AS bridge FROM (
                SELECT w.doc_id, w.i, w.content, CASE WHEN floor(length(b.content) * 0.1) > 0 THEN right(b.content, floor(length(b.content) * 0.1)::INT) ELSE '' END AS tail FROM b JOIN w ON w.doc_id = b.doc_id AND w.i = b.i + 1)))
    SELECT doc_id, i::INTEGER AS chunk_index, content FROM b"""
)
def bridged_chunks(spark: SparkSession, d: str) -> DataFrame:
    w = chunking.sliding_windows(table(spark, d, "documents")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "content"))), lambda x: x["content"]).alias("c"))
    return w.select("doc_id", F.posexplode(chunking.bridged(F.col("c"))).alias("chunk_index", "content"))


@query(
    rf"""WITH {SLIDING}, c AS (SELECT doc_id, start, list_distinct(list_filter((regexp_split_to_array(lower(content), '\s+'))[1:20], lambda w: w <> '')) AS w FROM kept),
    p AS (SELECT doc_id, b AS page_num, list_distinct(regexp_split_to_array(lower(substring(text, b * 2000 + 1, 2000)), '\s+')) AS pw FROM (SELECT *, unnest(range(0, length(text) // 2000 + 1)) AS b FROM documents)),
    h AS (SELECT doc_id, start, page_num, row_number() OVER (PARTITION BY doc_id, start ORDER BY page_num) AS r FROM c JOIN p USING (doc_id) WHERE len(list_intersect(w, pw)) > 0.5 * len(w))
    SELECT doc_id, start, page_num::BIGINT AS page_num FROM h WHERE r <= 2"""
)
def chunk_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    pages = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 2000).cast("int"))).alias("page_num"))
    pages = pages.select("doc_id", "page_num", F.substring("text", F.col("page_num") * 2000 + 1, F.lit(2000)).alias("text"))
    w = chunking.sliding_windows(docs).withColumn("chunk_id", F.col("start"))
    return chunking.page_numbers(w, pages).select("doc_id", F.col("chunk_id").alias("start"), F.col("page_num").cast("long").alias("page_num"))
