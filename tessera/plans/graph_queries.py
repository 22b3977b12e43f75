"""Queries of the entity graph, from texts by a lexicon and from orders by their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import graph, sentences, tagging
from tessera.plans.registry import LEXICON, SENTENCES, TOKENS, query, table
from tessera.scratch import written

MENTIONS = LEXICON + rf""", mt AS (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS p FROM (SELECT doc_id, {TOKENS} AS t FROM documents)),
    mentions AS (SELECT doc_id, l.label AS type, term AS entity, min(p)::BIGINT AS start FROM mt JOIN lexicon l USING (term) GROUP BY 1, 2, 3)"""
EDGES = MENTIONS + """, edges AS (SELECT a.doc_id, a.entity AS src, b.entity AS dst FROM mentions a JOIN mentions b ON a.doc_id = b.doc_id AND (a.type, a.start, a.entity) < (b.type, b.start, b.entity)
        AND a.type <> b.type AND abs(a.start - b.start) < 500), around AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges)"""
NODES = "nodes AS (SELECT entity, count(*)::BIGINT AS frequency, count(DISTINCT doc_id)::BIGINT AS n_docs, arg_min(type, (doc_id, type)) AS type FROM mentions GROUP BY 1)"


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    """Written once, as queries use them several times."""
    docs = table(spark, d, "documents")
    return written(tagging.mentions(docs, tagging.data_lexicon(docs)), "mentions")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.cooccurrences(_mentions(spark, d))


def _starts(edges: DataFrame) -> DataFrame:
    """All names, as starts of traversals."""
    return graph.both_ways(edges).select(F.col("a").alias("start")).distinct()


@query(f"WITH {MENTIONS} SELECT * FROM mentions")
def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _mentions(spark, d)


@query(
    r"""WITH t AS (SELECT doc_id, lower(text) AS t, string_split_regex(text, '(?i)\b(?:gnu general|apache license|mit license|cc by)\b') AS gap, regexp_extract_all(text, '(?i)\b(?:gnu general|apache license|mit license|cc by)\b') AS m
        FROM documents WHERE regexp_matches(text, '(?i)\b(?:gnu general|apache license|mit license|cc by)\b')),
    e AS (SELECT doc_id, gap, m, unnest(range(1, len(m) + 1)) AS i FROM t)
    SELECT doc_id, 'license' AS type, lower(m[i]) AS entity, min(list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM e GROUP BY 1, 3"""
)
def phrase_mentions(spark: SparkSession, d: str) -> DataFrame:
    return tagging.phrase_mentions(table(spark, d, "documents"), {"license": "gnu general|apache license|mit license|cc by"})


@query(f"WITH {EDGES} SELECT doc_id, src, dst FROM edges")
def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d)


@query(f"WITH {EDGES}, {NODES}, kept AS (SELECT entity FROM nodes WHERE frequency >= 30) SELECT src, dst, count(*)::BIGINT AS n FROM edges WHERE src IN (SELECT entity FROM kept) AND dst IN (SELECT entity FROM kept) GROUP BY 1, 2")
def frequent_edges(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    return graph.cooccurrences(m, kept=graph.nodes(m, 30)).groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {MENTIONS}, {NODES} SELECT entity, type, frequency, n_docs FROM nodes")
def entity_frequency(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(_mentions(spark, d))


@query(f"WITH {MENTIONS} SELECT entity, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS documents FROM mentions GROUP BY 1")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return graph.inverted(_mentions(spark, d)).select("entity", F.array_join(F.array_sort(F.transform("documents", lambda x: x.cast("string"))), ",").alias("documents"))


@query(f"WITH {MENTIONS}, {NODES} SELECT type, count(*)::BIGINT AS n, sum(frequency)::BIGINT AS frequency FROM nodes GROUP BY 1")
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.statistics(graph.nodes(_mentions(spark, d)))


@query(f"WITH {EDGES} SELECT entity, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS entity, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1")
def entity_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_edges(spark, d))


@query(
    f"""WITH {MENTIONS}, {NODES}, asked AS (SELECT DISTINCT substr(entity, 1, 3) AS asked FROM nodes),
    p AS (SELECT asked, entity, row_number() OVER (PARTITION BY asked ORDER BY (entity <> asked)::INT, -frequency, entity) AS r FROM asked JOIN nodes ON contains(entity, asked) OR contains(asked, entity)) SELECT asked, entity FROM p WHERE r = 1"""
)
def entity_resolve(spark: SparkSession, d: str) -> DataFrame:
    n = graph.nodes(_mentions(spark, d))
    return graph.resolve(n.select(F.substring("entity", 1, 3).alias("asked")).distinct(), n)


@query(
    f"""WITH {EDGES}, names AS (SELECT DISTINCT a AS entity FROM around), o AS (SELECT DISTINCT src, dst FROM edges), nb AS (SELECT a AS entity, count(*) AS n FROM around GROUP BY 1),
    rel AS (SELECT entity, count(*) AS n FROM (SELECT src AS entity FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
    r AS (SELECT entity AS start, entity FROM names UNION SELECT n.entity, o.dst FROM names n JOIN o ON n.entity = o.src UNION SELECT n.entity, p.dst FROM names n JOIN o ON n.entity = o.src JOIN o p ON o.dst = p.src),
    rc AS (SELECT start AS entity, count(*) AS n FROM r GROUP BY 1) SELECT n.entity, nb.n::BIGINT AS neighbours, rel.n::BIGINT AS relations, rc.n::BIGINT AS reach FROM names n JOIN nb USING (entity) JOIN rel USING (entity) JOIN rc USING (entity)"""
)
def query_entity(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.query_entity(e, graph.both_ways(e).select(F.col("a").alias("entity")).distinct())


TRAVERSED = """starts AS (SELECT DISTINCT a AS start FROM around), l1 AS (SELECT start, b AS entity FROM starts JOIN around ON start = a WHERE b <> start),
    l2 AS (SELECT DISTINCT l1.start, b AS entity FROM l1 JOIN around ON l1.entity = a), d AS (SELECT start, entity, min(depth) AS depth FROM (SELECT start, start AS entity, 0 AS depth FROM starts UNION ALL SELECT start, entity, 1 FROM l1 UNION ALL SELECT start, entity, 2 FROM l2) GROUP BY 1, 2),
    t AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, entity) AS r FROM d)"""


@query(f"WITH {EDGES}, {TRAVERSED} SELECT start, entity, depth::INTEGER AS depth FROM t WHERE r <= 20")
def bfs_two_hop(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.traverse(e, _starts(e))


@query(f"WITH {EDGES}, {TRAVERSED} SELECT entity, count(DISTINCT start)::BIGINT AS n FROM t WHERE r <= 10 GROUP BY 1 HAVING count(DISTINCT start) > 1 ORDER BY 2 DESC, 1 LIMIT 5")
def hub_entities(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.hubs(graph.traverse(e, _starts(e), most=10))


@query(
    f"""WITH RECURSIVE {EDGES}, names AS (SELECT DISTINCT a AS entity FROM around), pairs AS (SELECT x.entity AS a, y.entity AS b FROM names x, names y WHERE x.entity < y.entity),
    walk(a, here, n) AS (SELECT entity, entity, 0 FROM names UNION SELECT w.a, r.b, w.n + 1 FROM walk w JOIN around r ON w.here = r.a WHERE w.n < 40), best AS (SELECT a, here AS b, min(n) AS n FROM walk GROUP BY 1, 2)
    SELECT p.a, p.b, coalesce(best.n, -1)::BIGINT AS length FROM pairs p LEFT JOIN best USING (a, b)"""
)
def shortest_path_len(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    names = graph.both_ways(e).select("a").distinct()
    pairs = names.join(names.select(F.col("a").alias("b")), F.col("a") < F.col("b"))  # of the lexicon's forty names
    return graph.shortest_paths(e, pairs).select("a", "b", "length")


#: Brands of an order's parts as entities, types as types: a dense graph at scale.
ORDER_EDGES = """om AS (SELECT l_orderkey AS doc_id, p_type AS type, p_brand AS entity, min(l_linenumber)::BIGINT AS start FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
    oe AS (SELECT a.doc_id, a.entity AS src, b.entity AS dst FROM om a JOIN om b ON a.doc_id = b.doc_id AND (a.type, a.start, a.entity) < (b.type, b.start, b.entity) AND a.type <> b.type)"""


def _order_edges(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber").join(parts, "l_partkey")
    m = lines.groupBy(F.col("l_orderkey").alias("doc_id"), F.col("p_type").alias("type"), F.col("p_brand").alias("entity")).agg(F.min("l_linenumber").cast("long").alias("start"))
    return graph.cooccurrences(m)


@query(f"WITH {ORDER_EDGES} SELECT src, dst, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS n_docs FROM oe GROUP BY 1, 2")
def order_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return _order_edges(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"))


@query(
    f"""WITH RECURSIVE {ORDER_EDGES}, w AS (SELECT src, dst, count(*)::DOUBLE AS w FROM oe GROUP BY 1, 2), s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w),
    n AS (SELECT DISTINCT entity FROM (SELECT src AS entity FROM w UNION ALL SELECT dst FROM w)), c AS (SELECT count(*)::DOUBLE AS n FROM n), feeds AS (SELECT DISTINCT src FROM s),
    ranks(i, entity, rank) AS (SELECT 0, entity, 1 / c.n FROM n, c UNION ALL
        SELECT any_value(i) + 1, entity, 0.15 / any_value(cn) + 0.85 * (sum(flow) + any_value(loose) / any_value(cn)) FROM (
            SELECT r.i, n.entity, c.n AS cn, CASE WHEN s.dst = n.entity THEN r.rank * s.share ELSE 0 END AS flow, (SELECT coalesce(sum(q.rank), 0) FROM ranks q WHERE q.entity NOT IN (SELECT src FROM feeds)) AS loose
            FROM n, c, ranks r LEFT JOIN s ON s.src = r.entity WHERE r.i < 20) GROUP BY entity)
    SELECT entity, round(rank, 6)::DOUBLE AS rank FROM ranks WHERE i = 20"""
)
def pagerank_20(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(_order_edges(spark, d), rounds=20, tolerance=None).select("entity", F.round("rank", 6).alias("rank"))


@query(
    f"""WITH RECURSIVE {ORDER_EDGES}, w AS (SELECT src, dst, count(*)::DOUBLE AS w FROM oe GROUP BY 1, 2), s AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM w),
    n AS (SELECT DISTINCT entity FROM (SELECT src AS entity FROM w UNION ALL SELECT dst FROM w)), c AS (SELECT count(*)::DOUBLE AS n FROM n), feeds AS (SELECT DISTINCT src FROM s),
    ranks(i, entity, rank) AS (SELECT 0, entity, 1 / c.n FROM n, c UNION ALL
        SELECT any_value(i) + 1, entity, 0.15 / any_value(cn) + 0.85 * (sum(flow) + any_value(loose) / any_value(cn)) FROM (
            SELECT r.i, n.entity, c.n AS cn, CASE WHEN s.dst = n.entity THEN r.rank * s.share ELSE 0 END AS flow, (SELECT coalesce(sum(q.rank), 0) FROM ranks q WHERE q.entity NOT IN (SELECT src FROM feeds)) AS loose
            FROM n, c, ranks r LEFT JOIN s ON s.src = r.entity WHERE r.i < 60) GROUP BY entity),
    bag AS (SELECT entity, count(*) AS n FROM (SELECT src AS entity FROM oe UNION ALL SELECT dst FROM oe) GROUP BY 1)
    SELECT entity, round(rank, 4)::DOUBLE AS pagerank, bag.n::BIGINT AS connections FROM ranks JOIN bag USING (entity) WHERE i = 60"""
)
def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    e = written(_order_edges(spark, d), "order_edges")
    kinds = e.select(F.col("src").alias("entity")).distinct().select("entity", F.lit("brand").alias("type"), F.lit(0).cast("long").alias("frequency"))
    best = graph.most_central(graph.pagerank(e, tolerance=1e-9), e, kinds, k=1000)
    return best.select("entity", F.round("pagerank", 4).alias("pagerank"), "connections")


@query(
    f"""WITH {EDGES}, {NODES} SELECT 'total' AS part, 'nodes' AS name, count(*)::BIGINT AS n FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'frequent', entity, frequency FROM nodes ORDER BY frequency DESC, entity LIMIT 20)"""
)
def graph_overview(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    return graph.overview(graph.nodes(m), graph.cooccurrences(m), m)


@query(
    f"""WITH {EDGES}, {TRAVERSED.replace("starts AS", "starts AS MATERIALIZED")}, p1 AS (SELECT start, start AS entity, [start] AS path FROM starts), p2 AS (SELECT start, entity, [start, entity] AS path FROM l1),
    p3 AS (SELECT l1.start, r.b AS entity, min([l1.start, l1.entity, r.b]) AS path FROM l1 JOIN around r ON l1.entity = r.a GROUP BY 1, 2),
    u AS (SELECT start, entity, path, row_number() OVER (PARTITION BY start, entity ORDER BY len(path)) AS k FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3))
    SELECT t.start, t.entity, t.depth::INTEGER AS depth, array_to_string(u.path, '>') AS path FROM t JOIN u ON t.start = u.start AND t.entity = u.entity AND u.k = 1 WHERE r <= 20"""
)
def bfs_paths(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    return graph.traverse(e, _starts(e), paths=True).select("start", "entity", "depth", F.array_join("path", ">").alias("path"))


@query(
    f"""WITH RECURSIVE {EDGES}, names AS (SELECT DISTINCT a AS entity FROM around), pick AS (SELECT entity FROM names ORDER BY entity LIMIT 3), pairs AS (SELECT x.entity AS a, y.entity AS b FROM pick x, pick y WHERE x.entity < y.entity),
    walk(a, here, n) AS (SELECT entity, entity, 0 FROM pick UNION SELECT w.a, r.b, w.n + 1 FROM walk w JOIN around r ON w.here = r.a WHERE w.n < 40), best AS (SELECT a, here AS b, min(n) AS n FROM walk GROUP BY 1, 2)
    SELECT p.a, p.b, coalesce(best.n, -1)::BIGINT AS length, greatest(coalesce(best.n, -1) - 1, -1)::INTEGER AS n_between FROM pairs p LEFT JOIN best USING (a, b)"""
)
def multi_hop_paths(spark: SparkSession, d: str) -> DataFrame:
    e = written(_edges(spark, d), "edges")
    names = graph.both_ways(e).select(F.col("a").alias("entity")).distinct().orderBy("entity").limit(3)  # a question of three names
    paths, _ = graph.multi_hop(e, names)
    between = F.when(F.col("length") < 0, -1).otherwise(F.coalesce(F.size(F.coalesce("between", F.array().cast("array<string>"))), F.lit(0)))
    return paths.select("a", "b", "length", between.cast("int").alias("n_between"))


@query(
    r"""WITH a AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', 'z', 'g') AS t FROM documents),
    f AS (SELECT doc_id, list_concat(regexp_extract_all(lower(t), '\b(?:gnu|apache|mit|cc)\b'), regexp_extract_all(lower(t), '\b(?:license|rights reserved)\b')) AS f FROM a)
    SELECT doc_id, array_to_string(list_sort(list_distinct(f)), ',') AS entities FROM f WHERE len(f) > 0"""
)
def agent_entities(spark: SparkSession, d: str) -> DataFrame:
    found = tagging.agent_entities(text.text_of("text"), ["gnu|apache|mit|cc", "license|rights reserved"])
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("entities")).filter("entities <> ''")


LABELS = ["ORG", "DATE", "GPE", "LOC", "PRODUCT", "QUANTITY", "PERCENT"]


@query(
    f"""WITH f AS (SELECT doc_id, ({LABELS!r})[(doc_id % 7 + 1)::INT] AS label, substr(text, 1, 12) AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN label = 'ORG' THEN 'organization' WHEN label IN ('GPE', 'LOC') THEN 'region' WHEN label = 'PRODUCT' THEN 'technology' ELSE 'metric' END AS type, lower(t) AS entity, 0 AS start, length(t)::INTEGER AS "end" FROM f WHERE label <> 'DATE'"""
)
def model_mentions(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("doc_id") % 7 + 1).cast("int"))
    found = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", label.alias("label"), F.substring("text", 1, 12).alias("text"), F.lit(0).alias("start")).withColumn("end", F.length("text"))
    return tagging.model_mentions(found)


@query(
    f"""WITH {EDGES}, {NODES}, asked AS (SELECT doc_id AS query_id, entity, start AS ordinal FROM mentions), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ordinal, entity) AS r FROM asked),
    rel AS (SELECT a AS entity, array_to_string(list_sort(list(b))[1:5], ', ') AS rel FROM around GROUP BY 1)
    SELECT query_id, string_agg('- ' || entity || ' (' || n.type || ') is related to: ' || rel, chr(10) ORDER BY r) AS context FROM f JOIN nodes n USING (entity) JOIN rel USING (entity) WHERE r <= 5 GROUP BY 1""".replace("\\\\p", "\\p")
)
def graph_context(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    asked = m.select(F.col("doc_id").alias("query_id"), F.struct("start", "entity").alias("ordinal"), "entity")
    return graph.context_lines(graph.cooccurrences(m), graph.nodes(m), asked)


@query(
    rf"""WITH {MENTIONS}, s AS (SELECT doc_id, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS position FROM (SELECT doc_id, list_filter(list_transform({SENTENCES}, lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: length(s) >= 10) AS a FROM documents)),
    h AS (SELECT DISTINCT doc_id, position, entity FROM s JOIN mentions USING (doc_id) WHERE contains(lower(sentence), entity)) SELECT a.doc_id, a.position::BIGINT AS position, a.entity AS src, b.entity AS dst FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.position = b.position AND a.entity < b.entity"""
)
def sentence_pair_edges(spark: SparkSession, d: str) -> DataFrame:
    s = sentences.sentence_index(table(spark, d, "documents")).select("doc_id", "position", "sentence")
    return graph.sentence_pairs(s, _mentions(spark, d).select("doc_id", "entity"))
