"""The queries of this package, by name, and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontaminate, licenses, maxent, neardup, pii, quality, repeats, sharding, token_counts


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(common.table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated(common.table(spark, sf_dir, "documents"))


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(common.table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts.count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 512)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.assign(common.table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_substring_dedup, op3_minhash_neardup, op4_pii, op5_token_counts, op6_decontamination, op7_license_scan, op8_sharding, op9_byte_bpe, op10_quality_rules, pipeline)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
GRID = ", ".join(f"('{rule}', {step}, {cutoff!r}::DOUBLE)" for rule, grid in quality.RULES.items() for step, cutoff in enumerate(grid))
RISK = repr(quality.ALPHA)
ORACLE_SQL = {
    "op2_substring_dedup": r"""
        WITH cut AS (
            SELECT doc_id, string_split(regexp_replace(text, '([.!?,;:][\x20\x09-\x0D]|\n)', '\1' || chr(1), 'g'), chr(1)) AS parts
            FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        parts AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS no FROM cut),
        placed AS (
            SELECT doc_id, no, raw, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY no) - length(raw) AS base,
                trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS bare
            FROM parts),
        units AS (SELECT doc_id, no, bare, length(bare) - length(replace(bare, ' ', '')) + 1 AS n,
            base + length(raw) - length(ltrim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS first,
            base + length(rtrim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS last FROM placed WHERE bare <> ''),
        summed AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY no) AS total FROM units),
        words AS (SELECT doc_id, string_split(string_agg(bare, ' ' ORDER BY no), ' ') AS w FROM units GROUP BY 1),
        runs AS (SELECT a.doc_id, a.no, b.first, a.last, a.total - b.total + b.n AS n, b.total - b.n AS before, a.total
            FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.no <= a.no AND a.total - b.total + b.n >= 8 AND a.total - b.total < 8),
        keyed AS (SELECT r.*, array_to_string(w[before + 1 : total], ' ') AS key FROM runs r JOIN words USING (doc_id)),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, no) AS place, min(doc_id) OVER (PARTITION BY key) AS first_doc_id FROM keyed),
        hits AS (SELECT *, max(total) OVER (PARTITION BY doc_id ORDER BY before, total ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranked WHERE place > 1),
        islands AS (SELECT *, sum((reach IS NULL OR before > reach)::INT) OVER (PARTITION BY doc_id ORDER BY before, total ROWS UNBOUNDED PRECEDING) AS island FROM hits)
        SELECT doc_id, min(first)::INTEGER AS start, max(last)::INTEGER AS "end", (max(total) - min(before))::INTEGER AS n_words, min(first_doc_id) AS first_doc_id
        FROM islands GROUP BY doc_id, island HAVING max(total) - min(before) >= 25""",
    "op3_minhash_neardup": rf"""
        WITH RECURSIVE w AS (SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array({LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
        linked AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
        reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
        lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(w.doc_id, l.b), w.doc_id) AS component_id, coalesce(least(w.doc_id, l.b), w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN lowest l ON l.a = w.doc_id""",
    "op6_decontamination": rf"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        i AS (SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        win AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        dw AS (SELECT row, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT row, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
        hit AS (SELECT row, p, n, item FROM dw JOIN win USING (k, n)),
        words AS (SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT row, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT row, p, n FROM hit)) GROUP BY 1),
        items AS (SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN words USING (row) LEFT JOIN items USING (row)""",
    "op10_quality_rules": rf"""
        WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
        v AS (SELECT row, p, array_to_string(w[p : p + 4], ' ') AS k FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)),
        r AS (SELECT row, count(DISTINCT q) AS n FROM (SELECT row, unnest(range(p, p + 5)) AS q FROM (SELECT row, p, count(*) OVER (PARTITION BY row, k) AS c FROM v) WHERE c > 1) GROUP BY 1),
        m AS (SELECT row, doc_id, stratum, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN r USING (row)),
        f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN n_symbols / word_chars::DOUBLE ELSE 0 END AS symbol_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines::DOUBLE ELSE 0 END AS dup_line_ratio,
            CASE WHEN n_words > 0 THEN n_repeat_words / n_words::DOUBLE ELSE 0 END AS repeat_word_ratio, CASE WHEN n_words > 0 THEN 0.0 - word_chars / n_words::DOUBLE ELSE -10 END AS short_words, CASE WHEN n_words > 0 THEN word_chars / n_words::DOUBLE ELSE 0 END AS long_words FROM m),
        long AS (SELECT row, stratum, unnest(['symbol_ratio', 'dup_line_ratio', 'repeat_word_ratio', 'short_words', 'long_words']) AS rule, unnest([symbol_ratio, dup_line_ratio, repeat_word_ratio, short_words, long_words]) AS x FROM f),
        good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
        held AS (SELECT row, stratum, rule, x FROM long WHERE row IN (SELECT row FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good))),
        path(rule, step, cutoff) AS (VALUES {GRID}),
        tried AS (SELECT stratum, step, count(DISTINCT row) AS n, count(DISTINCT row) FILTER (WHERE x > cutoff) AS k FROM held JOIN path USING (rule) GROUP BY 1, 2),
        tail AS (SELECT stratum, step, n, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1 - {RISK}))) AS p
            FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM tried WHERE k <= n * {RISK}) GROUP BY 1, 2, 3),
        taken AS (SELECT stratum, min(step) AS step FROM tail WHERE p <= {quality.DELTA} * n / (SELECT count(DISTINCT row) FROM held) GROUP BY 1),
        cut AS (SELECT stratum, rule, cutoff FROM taken JOIN path USING (step)),
        broken AS (SELECT row, string_agg(rule, ',' ORDER BY rule) AS rules FROM long JOIN cut USING (stratum, rule) WHERE x > cutoff GROUP BY 1)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS rejected_by FROM f LEFT JOIN broken USING (row)""",
}
