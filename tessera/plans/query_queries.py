"""Queries of query understanding, conversation memory, answers and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import answers, evaluation, memory, routing
from tessera.plans.registry import TOKENS, query, table

#: Openings that make questions of the corpus' own texts.
OPENINGS = ["what is ", "How does it affect the relationship between ", "Compare versus ", "why is ", "how to install ", "summarize ", "Tell me about And ", ""]
QUESTIONS = "questions AS (SELECT doc_id AS query_id, (" + repr(OPENINGS) + ")[(doc_id % 8 + 1)::INT] || text || CASE WHEN doc_id % 5 = 0 THEN ' and Who is there? or then what' ELSE '?' END AS text FROM documents)"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    opening = F.element_at(F.array(*map(F.lit, OPENINGS)), (F.col("doc_id") % 8 + 1).cast("int"))
    end = F.when(F.col("doc_id") % 5 == 0, " and Who is there? or then what").otherwise("?")
    return table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.concat(opening, F.col("text"), end).alias("text"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _intent_sql() -> str:
    scores = []
    for name, patterns in routing.INTENT_PATTERNS.items():
        hit = " OR ".join(f"regexp_matches(low, {_sql_text('(?i)' + p)})" for p in patterns)
        words = " + ".join(f"contains(low, {_sql_text(w)})::INT" for w in routing.INTENT_KEYWORDS[name])
        extra = {"reasoning": " + CASE WHEN nw > 15 THEN 0.5 ELSE 0 END", "relational": " + CASE WHEN nw > 15 THEN 0.3 ELSE 0 END", "factual": " + CASE WHEN regexp_matches(text, '[0-9]') THEN 0.3 ELSE 0 END"}.get(name, "")
        scores.append(f"(CASE WHEN {hit} THEN 3 ELSE 0 END + {words}{extra})::DOUBLE")
    return f"""WITH {QUESTIONS}, l AS (SELECT *, lower(text) AS low, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS nw FROM questions),
        s AS (SELECT query_id, [{", ".join(scores)}] AS s FROM l), m AS (SELECT query_id, s, list_max(s) AS most FROM s)
        SELECT query_id, CASE WHEN least(most / 5, 1) < 0.2 THEN 'reasoning' ELSE ({list(routing.INTENT_PATTERNS)!r})[list_position(s, most)] END AS intent,
            round(CASE WHEN least(most / 5, 1) < 0.2 THEN 0.3 ELSE least(most / 5, 1) END, 6)::DOUBLE AS confidence FROM m"""


@query(_intent_sql())
def intent_route(spark: SparkSession, d: str) -> DataFrame:
    return routing.classify(_questions(spark, d)).select("query_id", "intent", F.round("confidence", 6).alias("confidence"))


_STRATEGY_ROWS = ", ".join(f"('{s[0]}', {s[3]}, {s[4]}, {s[5]}, {s[6]}, {s[8]})" for s in routing.STRATEGIES)


@query(
    f"""WITH i AS ({_intent_sql()}), s(intent, use_graph, graph_depth, top_k, semantic_weight, use_query_expansion) AS (VALUES {_STRATEGY_ROWS})
    SELECT query_id, i.intent, use_graph, graph_depth::INTEGER AS graph_depth, top_k::INTEGER AS top_k, semantic_weight::DOUBLE AS semantic_weight, use_query_expansion FROM i JOIN s USING (intent)"""
)
def strategy_lookup(spark: SparkSession, d: str) -> DataFrame:
    return routing.with_strategy(routing.classify(_questions(spark, d))).select("query_id", "intent", "use_graph", "graph_depth", "top_k", "semantic_weight", "use_query_expansion")


@query(
    rf"""WITH {QUESTIONS}, e AS (SELECT query_id, list_distinct_keep FROM (SELECT query_id, list_concat(list_filter({TOKENS}, lambda w: length(w) > 2 AND NOT list_contains({routing.STOP_WORDS!r}, w)),
        list_transform(regexp_extract_all(regexp_replace(text, '([^\p{{L}}\p{{N}}\p{{M}}_])', '\1\1', 'g'), '(?:^|[^\p{{L}}\p{{N}}\p{{M}}_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)(?:$|[^\p{{L}}\p{{N}}\p{{M}}_])', 1), lambda w: lower(regexp_replace(w, '(\s)\s', '\1', 'g')))) AS a FROM questions) t, LATERAL (SELECT list_filter(t.a, lambda x, i: list_position(t.a, x) = i) AS list_distinct_keep))
    SELECT query_id, array_to_string(list_distinct_keep[1:10], '|') AS entities FROM e"""
)
def query_entities(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("query_id", F.array_join(routing.query_entities(), "|").alias("entities"))


SYNONYMS = {"affect": ["change", "alter", "move"], "the": ["a", "this"], "install": ["set up", "deploy"], "versus": ["against"]}
_EXPANSIONS = ", ".join(f"CASE WHEN contains(lower(text), '{t}') THEN {s[:2]!r} ELSE [] END" for t, s in SYNONYMS.items())


@query(
    f"""WITH {QUESTIONS}, e AS (SELECT query_id, text, list_sort(list_distinct(flatten([{_EXPANSIONS}])))[1:3] AS e FROM questions)
    SELECT query_id, md5(CASE WHEN len(e) > 0 THEN text || ' ' || array_to_string(e, ' ') ELSE text END) AS expanded_md5, len(e)::BIGINT AS n FROM e"""
)
def query_expand(spark: SparkSession, d: str) -> DataFrame:
    q = _questions(spark, d).withColumn("e", routing.expanded(F.col("text"), SYNONYMS))
    low = F.lower("text")
    n = F.least(F.size(F.array_distinct(F.concat(*(F.when(low.contains(t), F.array(*map(F.lit, s[:2]))).otherwise(F.array().cast("array<string>")) for t, s in SYNONYMS.items())))), F.lit(3))
    return q.select("query_id", F.md5("e").alias("expanded_md5"), n.cast("long").alias("n"))


@query(
    r"""WITH v AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^[\d.\-*)]+\s*', ''))) AS l FROM documents)
    SELECT doc_id, len(list_filter(l, lambda x: length(x) > 10)[1:3])::BIGINT + 1 AS n, md5(array_to_string(list_concat(['original'], list_filter(l, lambda x: length(x) > 10)[1:3]), '|')) AS variants_md5,
        CASE WHEN length(text) > 10 AND length(text) < 500 THEN 'rewritten' ELSE 'original' END AS used FROM v"""
)
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "documents").select("doc_id", text.variants(F.col("text"), F.lit("original"), 3).alias("v"), routing.rewritten(F.col("text"), F.lit("original")).alias("r"))
    return v.select("doc_id", F.size("v").cast("long").alias("n"), F.md5(F.array_join("v", "|")).alias("variants_md5"), F.when(F.col("r") == "original", "original").otherwise("rewritten").alias("used"))


def _sub_sql() -> str:
    kinds, n = [], []
    for name, (a, b) in routing.SUB_PATTERNS.items():
        ra, rb = (f"regexp_matches(low, {_sql_text(p)})" for p in (a, b))
        kinds.append(f"WHEN {ra} OR {rb} THEN '{name}'")
        n.append(f"WHEN kind = '{name}' THEN {ra}::INT + {rb}::INT")
    tools = " ".join(f"WHEN kind = '{k}' THEN '{t}'" for k, t in routing.TOOLS.items())
    return rf"""WITH {QUESTIONS}, p AS (SELECT query_id, flatten(list_transform(string_split_regex(text, '(?i)\s+(?:and|or|also|then|but)\s+'), lambda x: string_split_regex(x, '\?\s*'))) AS p FROM questions),
        a AS (SELECT query_id, list_transform(list_filter(list_transform(p, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: x || '?') AS a FROM p),
        s AS (SELECT query_id, unnest(a) AS sub_text, generate_subscripts(a, 1) - 1 AS sub_no FROM a), l AS (SELECT *, lower(sub_text) AS low FROM s),
        k AS (SELECT *, CASE {" ".join(kinds)} ELSE 'factual' END AS kind FROM l)
        SELECT query_id, sub_no::BIGINT AS sub_no, md5(sub_text) AS text_md5, kind AS sub_type, CASE {tools} END AS tool, round(least(0.95, 0.7 + 0.1 * CASE {" ".join(n)} END), 6)::DOUBLE AS confidence FROM k"""


@query(_sub_sql())
def decompose(spark: SparkSession, d: str) -> DataFrame:
    s = routing.decompose(_questions(spark, d))
    return s.select("query_id", "sub_no", F.md5("sub_text").alias("text_md5"), "sub_type", "tool", F.round("confidence", 6).alias("confidence"))


@query(
    """SELECT item_id AS query_id, i::BIGINT AS sub_no, k AS sub_type, 'part ' || i || ' of ' || item_id AS sub_text, CASE WHEN i % 2 = 0 THEN 'x,y' ELSE '' END AS entities,
    CASE k WHEN 'factual' THEN 'vector' WHEN 'relational' THEN 'graph' ELSE 'hybrid' END AS tool FROM benchmark, (SELECT unnest(range(0, 3)) AS i, unnest(['factual', 'relational', 'procedural']) AS k)"""
)
def decomposition_parse(spark: SparkSession, d: str) -> DataFrame:
    line = lambda i, k, e: F.concat(F.lit(f"{k}: part {i} of "), F.col("item_id").cast("string"), F.lit(e))
    a = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws("\n", line(0, "FACTUAL", " | ENTITIES: x, y"), line(1, "RELATIONAL", ""), line(2, "PROCEDURAL", " | ENTITIES: x,y"), F.lit("no such line")).alias("answer"))
    return routing.parse_decomposition(a).withColumn("entities", F.array_join("entities", ","))


@query(
    rf"""WITH e AS (SELECT doc_id, text, list_distinct({TOKENS})[1:1] AS unused, list_filter([source, lang, 'the', 'und', 'que'], lambda x: true) AS e FROM documents)
    SELECT doc_id, len(list_filter(e, lambda x: NOT contains(lower(text), x)))::BIGINT AS n_missing, length(text) > 0 AND len(list_filter(e, lambda x: NOT contains(lower(text), x))) <= 2 AS sufficient FROM e"""
)
def context_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    enough, missing = routing.sufficiency(F.array("source", "lang", F.lit("the"), F.lit("und"), F.lit("que")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(missing).cast("long").alias("n_missing"), enough.alias("sufficient"))


EXCHANGES = """n AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    ex AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS exchange, text AS question, answer FROM n WHERE role = 'user' AND r2 = 'assistant')"""


@query(f"WITH {EXCHANGES} SELECT conv_id, (2 * count(*))::BIGINT AS messages, md5(string_agg('User: ' || question || chr(10) || 'Assistant: ' || answer, chr(10) ORDER BY exchange)) AS history_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY exchange DESC) AS r FROM ex) WHERE r <= 2 GROUP BY 1")
def memory_window(spark: SparkSession, d: str) -> DataFrame:
    h = memory.history(memory.exchanges(table(spark, d, "conversations")), 2)
    return h.select("conv_id", "messages", F.md5("history").alias("history_md5"))


@query(
    rf"""WITH {EXCHANGES}, w AS (SELECT conv_id, exchange, list_distinct(list_filter(regexp_split_to_array(lower(question), '\s+'), lambda x: x <> '')) AS w FROM ex),
    k AS (SELECT *, flatten(list(w) OVER (PARTITION BY conv_id ORDER BY exchange ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) AS known FROM w),
    o AS (SELECT conv_id, exchange, CASE WHEN len(known) > 0 AND len(w) > 0 THEN len(list_intersect(w, known)) / len(w)::DOUBLE END AS overlap FROM k)
    SELECT conv_id, exchange, round(overlap, 6) AS overlap, coalesce(overlap < 0.3, false) AS clear FROM o"""
)
def topic_shift(spark: SparkSession, d: str) -> DataFrame:
    t = memory.topic_shifts(memory.exchanges(table(spark, d, "conversations")))
    return t.select("conv_id", "exchange", F.round("overlap", 6).alias("overlap"), "clear")


@query(
    rf"""WITH t AS (SELECT conv_id, turn, role, text, role || '#' || turn AS s, {TOKENS} AS w FROM conversations)
    SELECT conv_id, count(*) FILTER (WHERE role = 'user')::BIGINT AS queries, arg_max(text, turn) FILTER (WHERE role = 'user') AS last_question, array_to_string(list(s ORDER BY turn)[-10:], ',') AS sources, len(list_distinct(flatten(list(w))))::BIGINT AS words FROM t GROUP BY 1"""
)
def conversation_state(spark: SparkSession, d: str) -> DataFrame:
    return memory.state(table(spark, d, "conversations"))


#: Question, answer and context of each exchange: the context is the answer's first half and the question.
CASES = EXCHANGES + ", cases AS (SELECT conv_id * 1000 + exchange AS id, question, answer, substring(answer, 1, length(answer) // 2) || ' ' || question AS context FROM ex)"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    e = memory.exchanges(table(spark, d, "conversations"))
    context = F.concat(F.substring("answer", F.lit(1), F.floor(F.length("answer") / 2).cast("int")), F.lit(" "), F.col("question"))
    return e.select((F.col("conv_id") * 1000 + F.col("exchange")).alias("id"), "question", "answer", context.alias("context"))


CLAIMS = CASES + rf""", cl0 AS (SELECT id, context, unnest(string_split(answer, '. ')[1:5]) AS raw, generate_subscripts(string_split(answer, '. ')[1:5], 1) - 1 AS no FROM cases),
    cl1 AS (SELECT id, lower(context) AS ctx, no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS s FROM cl0), cl2 AS (SELECT *, list_filter(list_distinct(regexp_split_to_array(lower(s), '\s+')), lambda w: w <> '' AND NOT list_contains({evaluation.CLAIM_STOP!r}, w)) AS w FROM cl1 WHERE length(s) >= 20),
    claims AS (SELECT id, no::BIGINT AS claim_no, substring(s, 1, 100) AS claim, len(list_filter(w, lambda x: contains(ctx, x))) >= len(w) * 0.3 AS grounded FROM cl2)"""


@query(f"WITH {CLAIMS} SELECT * FROM claims")
def claim_grounding(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.claims(_cases(spark, d))


RELEVANT = "CASE WHEN length({q}) = 0 OR length({a}) = 0 THEN 0 ELSE least(1, len(list_filter({w}, lambda x: contains(lower({a}), x))) / greatest(len({w}), 1)::DOUBLE) END"
WORDS_SQL = rf"list_filter(list_distinct(regexp_split_to_array(lower(question), '\s+')), lambda w: w <> '' AND NOT list_contains({evaluation.QUESTION_STOP!r}, w))"


@query(f"WITH {CASES} SELECT id, round({RELEVANT.format(q='question', a='answer', w=WORDS_SQL)}, 6)::DOUBLE AS answer_relevancy, round({RELEVANT.format(q='question', a='context', w=WORDS_SQL)}, 6)::DOUBLE AS context_relevancy FROM cases")
def relevancy_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).select("id", F.round(evaluation.relevancy(F.col("question"), F.col("answer")), 6).alias("answer_relevancy"), F.round(evaluation.relevancy(F.col("question"), F.col("context")), 6).alias("context_relevancy"))


@query(
    f"""WITH {CLAIMS}, f AS (SELECT id, avg(grounded::INT) AS f FROM claims GROUP BY 1), m AS (SELECT c.id, CASE WHEN answer = '' OR context = '' THEN 0 ELSE coalesce(f.f, 0.5) END AS fa,
        {RELEVANT.format(q='question', a='answer', w=WORDS_SQL)} AS ar, {RELEVANT.format(q='question', a='context', w=WORDS_SQL)} AS cr, CASE WHEN c.id % 6 <= 0 OR c.id % 4 <= 0 THEN 1 ELSE least(1, (c.id % 4) / (c.id % 6)::DOUBLE) END AS se FROM cases c LEFT JOIN f USING (id)),
    s AS (SELECT *, round(0.4 * fa + 0.3 * ar + 0.2 * cr + 0.1 * se, 6)::DOUBLE AS score FROM m)
    SELECT id, round(fa, 6)::DOUBLE AS faithfulness, round(se, 6)::DOUBLE AS step_efficiency, score, CASE WHEN score >= 0.7 THEN 'PASS' WHEN score >= 0.5 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict,
        round(len(list_distinct([id % 2, id % 3, id % 5])) / 3.0, 6)::DOUBLE AS loop_prevention FROM s"""
)
def agentic_metrics(spark: SparkSession, d: str) -> DataFrame:
    cases = _cases(spark, d)
    m = cases.join(evaluation.faithfulness(cases, evaluation.claims(cases)), "id").withColumn("step_efficiency", evaluation.step_efficiency(F.col("id") % 6, F.col("id") % 4))
    score = evaluation.raw_score(faithfulness=F.col("faithfulness"), answer_relevancy=evaluation.relevancy(F.col("question"), F.col("answer")), context_relevancy=evaluation.relevancy(F.col("question"), F.col("context")), step_efficiency=F.col("step_efficiency"))
    m = m.withColumn("score", F.round(score, 6))
    loop = evaluation.loop_prevention(F.array(F.col("id") % 2, F.col("id") % 3, F.col("id") % 5))
    return m.select("id", F.round("faithfulness", 6).alias("faithfulness"), F.round("step_efficiency", 6).alias("step_efficiency"), "score", evaluation.verdict(F.col("score")).alias("verdict"), F.round(loop, 6).alias("loop_prevention"))


#: People's labels against a stand-in judge: the part of a document's words that are distinct.
PAIRS = rf"pairs AS (SELECT l.doc_id, l.quality::DOUBLE AS human, len(list_distinct(t)) / greatest(len(t), 1)::DOUBLE AS judge FROM labels l JOIN (SELECT doc_id, {TOKENS} AS t FROM documents) USING (doc_id))"
FIT = PAIRS + ", fit AS (SELECT count(*) AS n, avg(human) AS mh, avg(judge) AS ml, avg(judge) - avg(human) AS bias, CASE WHEN stddev_pop(judge) > 0 THEN stddev_pop(human) / stddev_pop(judge) ELSE 1 END AS scale, stddev_pop(human - judge) AS sigma FROM pairs)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    t = text.tokens("text")
    docs = table(spark, d, "documents").select("doc_id", (F.size(F.array_distinct(t)) / F.greatest(F.size(t), F.lit(1))).alias("judge"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("human")).join(docs, "doc_id")


@query(f"WITH {FIT} SELECT n::BIGINT AS n, round(mh, 6) AS mean_h, round(ml, 6) AS mean_l, round(bias, 6) AS bias, round(scale, 6) AS scale, round(sigma, 6) AS sigma FROM fit")
def ppi_fit(spark: SparkSession, d: str) -> DataFrame:
    f = evaluation.fit_calibration(_pairs(spark, d))
    return f.select("n", *(F.round(c, 6).alias(c) for c in ("mean_h", "mean_l", "bias", "scale", "sigma")))


@query(
    f"""WITH {FIT}, c AS (SELECT doc_id, least(greatest((judge - bias) * scale + mh - ml * scale, 0), 1) AS c, sigma, n FROM pairs, fit)
    SELECT doc_id, round(c, 6)::DOUBLE AS calibrated, round(least(greatest(c - 1.959963984540054 * sigma / sqrt(n), 0), 1), 6)::DOUBLE AS low, round(least(greatest(c + 1.959963984540054 * sigma / sqrt(n), 0), 1), 6)::DOUBLE AS high FROM c"""
)
def ppi_calibrate(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    rows = pairs.join(F.broadcast(evaluation.fit_calibration(pairs)), how="cross")  # one row
    value = evaluation.calibrated(F.col("judge"), F.col("mean_h"), F.col("mean_l"), F.col("bias"), F.col("scale"))
    rows = rows.withColumn("c", value)
    low, high = evaluation.interval(F.col("c"), F.col("sigma"), F.col("n"))
    return rows.select("doc_id", F.round("c", 6).alias("calibrated"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


OUTPUTS = """outputs AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Score: ' || (doc_id % 11) || '/10 yes REASON: ' || source WHEN 1 THEN 'I give ' || (doc_id % 7) || ' out of 7, fail' WHEN 2 THEN chr(10) || (doc_id % 150) || chr(10)
    WHEN 3 THEN 'rating ' || (doc_id % 10) / 10.0 WHEN 4 THEN 'unclear' ELSE 'GROUNDED: yes | EVIDENCE: ' || lang || chr(10) || 'GROUNDED: no | EVIDENCE: none' END AS o FROM documents)"""


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    i, s = F.col("doc_id"), lambda c: c.cast("string")
    o = (
        F.when(i % 6 == 0, F.concat(F.lit("Score: "), s(i % 11), F.lit("/10 yes REASON: "), F.col("source"))).when(i % 6 == 1, F.concat(F.lit("I give "), s(i % 7), F.lit(" out of 7, fail")))
        .when(i % 6 == 2, F.concat(F.lit("\n"), s(i % 150), F.lit("\n"))).when(i % 6 == 3, F.concat(F.lit("rating "), s((i % 10) / 10.0))).when(i % 6 == 4, "unclear")
        .otherwise(F.concat(F.lit("GROUNDED: yes | EVIDENCE: "), F.col("lang"), F.lit("\nGROUNDED: no | EVIDENCE: none")))
    )
    return table(spark, d, "documents").select("doc_id", o.alias("o"))


@query(
    rf"""WITH {OUTPUTS}, f AS (SELECT doc_id, o, coalesce(nullif(regexp_extract(o, '(?i)(?:score|rating)[:\s]*(\d+(?:\.\d+)?)\s*(?:/\s*10|/\s*5|/\s*1)?', 1), ''), nullif(regexp_extract(o, '(?i)(\d+(?:\.\d+)?)\s*(?:/\s*10|/\s*5|out of)', 1), ''),
        nullif(regexp_extract(o, '(?:^|\n)\s*(\d+(?:\.\d+)?)\s*(?:$|\n)', 1), ''))::DOUBLE AS x, lower(o) AS low FROM outputs)
    SELECT doc_id, round(CASE WHEN x IS NULL THEN 0.5 WHEN x <= 1 THEN x WHEN x <= 5 THEN x / 5 WHEN x <= 10 THEN x / 10 ELSE least(1, x / 100) END, 6)::DOUBLE AS score,
        CASE WHEN contains(low, 'yes') OR contains(low, 'pass') OR contains(low, 'true') THEN 'yes' WHEN contains(low, 'no') OR contains(low, 'fail') OR contains(low, 'false') THEN 'no' ELSE 'unclear' END AS verdict,
        substring(trim(regexp_extract(o, '(?i)REASON:\s*([^\n]+)', 1)), 1, 200) AS reason,
        array_to_string(list_transform(list_filter(string_split(o, chr(10)), lambda l: regexp_matches(l, '(?i)GROUNDED:')), lambda l: starts_with(lower(trim(regexp_extract(l, '(?i)GROUNDED:\s*([^|]*)', 1))), 'yes') || ':' || trim(regexp_extract(l, '(?i)EVIDENCE:\s*(.*)', 1))), ';') AS claims FROM f"""
)
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o")
    told = F.array_join(F.transform(evaluation.claim_lines(o), lambda c: F.concat(c["grounded"].cast("string"), F.lit(":"), c["evidence"])), ";")
    return _outputs(spark, d).select("doc_id", F.round(evaluation.parsed_score(o), 6).alias("score"), evaluation.parsed_verdict(o).alias("verdict"), evaluation.reason(o).alias("reason"), told.alias("claims"))


#: Judges' scores out of labels: some are missing.
SCORES = "scores AS (SELECT doc_id, (doc_id % 11) / 10.0::DOUBLE AS a, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 7) / 6.0::DOUBLE END AS b, quality::DOUBLE AS c, 1 - toxic::DOUBLE AS e FROM labels), o AS (SELECT *, round((0.25 * a + coalesce(0.2 * b, 0) + 0.15 * c + 0.15 * e) / (0.25 + CASE WHEN b IS NULL THEN 0 ELSE 0.2 END + 0.15 + 0.15), 6)::DOUBLE AS score FROM scores), v AS (SELECT *, CASE WHEN score >= 0.7 THEN 'PASS' WHEN score >= 0.5 THEN 'MARGINAL' ELSE 'FAIL' END AS verdict FROM o)"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    s = {
        "faithfulness": (F.col("doc_id") % 11) / 10.0, "answer_relevancy": F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 7) / 6.0), "context_relevancy": F.col("quality").cast("double"),
        "domain_accuracy": F.lit(None).cast("double"), "safety": 1 - F.col("toxic").cast("double"),
    }
    rows = table(spark, d, "labels").select("doc_id", F.round(evaluation.overall(s), 6).alias("score"), F.array_join(evaluation.advice(s), ",").alias("advice"))
    return rows.withColumn("verdict", evaluation.verdict(F.col("score")))


@query(
    f"""WITH {SCORES} SELECT doc_id, score, verdict, CASE WHEN a < 0.6 OR coalesce(b < 0.6, false) OR c < 0.6 OR e < 0.7 THEN
    array_to_string(list_filter([CASE WHEN a < 0.6 THEN 'grounding' END, CASE WHEN b < 0.6 THEN 'relevancy' END, CASE WHEN c < 0.6 THEN 'retrieval' END, CASE WHEN e < 0.7 THEN 'safety' END], lambda x: x IS NOT NULL), ',') ELSE 'adequate' END AS advice FROM v"""
)
def judge_overall(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


@query(f"WITH {SCORES} SELECT count(*)::BIGINT AS n, round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE verdict = 'PASS')::BIGINT AS passed, count(*) FILTER (WHERE verdict = 'MARGINAL')::BIGINT AS marginal, count(*) FILTER (WHERE verdict = 'FAIL')::BIGINT AS failed, round((count(*) FILTER (WHERE verdict = 'PASS') + 0.5 * count(*) FILTER (WHERE verdict = 'MARGINAL')) / count(*), 6)::DOUBLE AS pass_rate FROM v")
def judge_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.summary(_scores(spark, d))


@query(
    """SELECT doc_id, round(len(list_filter([lang, 'the ', 'UND', 'Zzz'], lambda c: contains(lower(text), lower(c)))) / 4.0, 6)::DOUBLE AS coverage,
    round(least(greatest(0.5 + CASE WHEN doc_id % 5 >= 3 THEN 0.2 WHEN doc_id % 5 >= 1 THEN 0.1 ELSE 0 END + CASE WHEN contains(text || CASE WHEN doc_id % 2 = 0 THEN '[Source: x]' ELSE ' not sure' END, '[Source:') THEN 0.1 ELSE 0 END
        - CASE WHEN doc_id % 2 = 1 THEN 0.15 ELSE 0 END, 0), 1), 2)::DOUBLE AS confidence FROM documents"""
)
def answer_quality(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat("text", F.when(F.col("doc_id") % 2 == 0, "[Source: x]").otherwise(" not sure"))
    cover = evaluation.concept_coverage(F.array("lang", F.lit("the "), F.lit("UND"), F.lit("Zzz")), F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.round(cover, 6).alias("coverage"), evaluation.answer_confidence(answer, F.col("doc_id") % 5).alias("confidence"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Sum of ' || source ELSE 'plain ' || lang END AS summary, CASE WHEN doc_id % 2 = 0 THEN 'first=[Source: a];second ' || lang || '=' ELSE '' END AS findings,
    round(least(0.4 + 0.1 * (doc_id % 3) + 0.05 * CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END, 0.95), 6)::DOUBLE AS confidence FROM documents"""
)
def structured_answers(spark: SparkSession, d: str) -> DataFrame:
    full = F.concat(F.lit("## Executive Summary\nSum of "), F.col("source"), F.lit("\n## Detailed Findings\n1. first [Source: a]\n2. second "), F.col("lang"), F.lit("\n## End\n"))
    answer = F.when(F.col("doc_id") % 2 == 0, full).otherwise(F.concat(F.lit("plain "), F.col("lang"), F.lit("\nmore")))
    summary, findings = evaluation.structured_answer(answer)
    rows = table(spark, d, "documents").select("doc_id", summary.alias("summary"), findings.alias("f"))
    told = F.array_join(F.transform("f", lambda x: F.concat(x["text"], F.lit("="), x["citation"])), ";")
    return rows.select("doc_id", "summary", told.alias("findings"), F.round(evaluation.structured_confidence(F.col("doc_id") % 3, F.size("f")), 6).alias("confidence"))


@query(
    """WITH r AS (SELECT doc_id // 10 AS query_id, (doc_id % 10 + 1)::BIGINT AS rank, source, doc_id % 4 AS page, lang AS category, text FROM documents),
    c AS (SELECT query_id, string_agg('[' || rank || '] Source: ' || source || ', Page ' || page || ' (' || category || ')' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM r GROUP BY 1),
    t AS (SELECT query_id, string_agg('[' || rank || '] ' || source || CASE WHEN page > 0 THEN ', Page ' || page ELSE '' END, chr(10) ORDER BY rank) AS citations FROM r WHERE rank <= 5 GROUP BY 1)
    SELECT query_id, md5(context) AS context_md5, citations, md5(substring(context, 1, 2000)) AS answer_md5 FROM c JOIN t USING (query_id)"""
)
def answer_assembly(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 10).cast("long").alias("query_id"), (F.col("doc_id") % 10 + 1).alias("rank"), "source", (F.col("doc_id") % 4).alias("page"), F.col("lang").alias("category"), "text")
    c = answers.context_blocks(r)
    return c.join(answers.citations(r), "query_id").join(answers.extractive(c), "query_id").select("query_id", F.md5("context").alias("context_md5"), "citations", F.md5("answer").alias("answer_md5"))
