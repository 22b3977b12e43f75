"""An entity graph as two tables: nodes(entity, type, frequency, ...) and edges(src, dst, doc_id), a bag of directed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.scratch import written


def nodes(mentions: DataFrame, least: int = 1) -> DataFrame:
    """(entity, type, frequency, n_docs): one mention a document and type; the type is that of the first document, then of the first place."""
    out = mentions.groupBy("entity").agg(F.count("*").alias("frequency"), F.count_distinct("doc_id").alias("n_docs"), F.min_by("type", F.struct("doc_id", "type")).alias("type"))
    return out.filter(F.col("frequency") >= least).select("entity", "type", "frequency", "n_docs")


def inverted(mentions: DataFrame) -> DataFrame:
    """(entity, documents): sorted documents of each entity; not cut by any least frequency."""
    return mentions.groupBy("entity").agg(F.array_sort(F.collect_set("doc_id")).alias("documents"))


def cooccurrences(mentions: DataFrame, distance: int = 500, kept: DataFrame | None = None) -> DataFrame:
    """(doc_id, src, dst): pairs of different types less than `distance` apart in a document, in the order of type, place and entity.

    The pairs of a document are quadratic in its entities only. Edges at nodes that are not kept go.
    """
    order = F.struct("type", "start", "entity")
    a = mentions.select("doc_id", F.col("entity").alias("src"), F.col("type").alias("ta"), F.col("start").alias("sa"), order.alias("oa"))
    b = mentions.select("doc_id", F.col("entity").alias("dst"), F.col("type").alias("tb"), F.col("start").alias("sb"), order.alias("ob"))
    out = a.join(b, "doc_id").filter((F.col("oa") < F.col("ob")) & (F.col("ta") != F.col("tb")) & (F.abs(F.col("sa") - F.col("sb")) < distance)).select("doc_id", "src", "dst")
    if kept is not None:
        out = out.join(kept.select(F.col("entity").alias("src")), "src", "left_semi").join(kept.select(F.col("entity").alias("dst")), "dst", "left_semi").select("doc_id", "src", "dst")
    return out


def sentence_pairs(sentences: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, position, src, dst): entities of one document that both stand in a sentence as substrings."""
    hit = sentences.join(entities, "doc_id").filter(F.contains(F.lower("sentence"), F.lower("entity"))).select("doc_id", "position", "entity").distinct()
    a, b = hit.withColumnRenamed("entity", "src"), hit.withColumnRenamed("entity", "dst")
    return a.join(b, ["doc_id", "position"]).filter("src < dst")


def statistics(node_table: DataFrame) -> DataFrame:
    """(type, n, frequency) of each type."""
    return node_table.groupBy("type").agg(F.count("*").alias("n"), F.sum("frequency").alias("frequency"))


def overview(node_table: DataFrame, edges: DataFrame, mentions: DataFrame, most: int = 20) -> DataFrame:
    """(part, name, n): nodes, edges (a bag), nodes of each type, and the most frequent entities, which are counted over all mentions, kept or not."""
    said = lambda df, part, name, n: df.select(F.lit(part).alias("part"), name.alias("name"), n.cast("long").alias("n"))
    total = lambda df, name: said(df.agg(F.count("*").alias("n")), "total", F.lit(name), F.col("n"))
    top = nodes(mentions).orderBy(F.desc("frequency"), "entity").limit(most)
    return total(node_table, "nodes").unionByName(total(edges, "edges")).unionByName(said(statistics(node_table), "type", F.col("type"), F.col("n"))).unionByName(said(top, "frequent", F.col("entity"), F.col("frequency")))


def degrees(edges: DataFrame) -> DataFrame:
    """(entity, out_degree, in_degree) over the bag of edges."""
    ends = edges.select(F.col("src").alias("entity"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("entity"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("entity").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()


def resolve(asked: DataFrame, node_table: DataFrame, most: int = 10_000) -> DataFrame:
    """(asked, entity): the node of that name, else the most frequent one that contains the name or stands in it.

    asked: (asked). Names that are nodes are joined. The others are told apart by scans of the nodes, each against a
    broadcast block of at most `most` names.
    """
    low = written(asked.select("asked", F.lower("asked").alias("low")).distinct(), "asked")
    exact = low.join(node_table.select(F.col("entity").alias("low")), "low", "left_semi").select("asked", F.col("low").alias("entity"))
    loose = written(low.join(node_table.select(F.col("entity").alias("low")), "low", "left_anti"), "asked")
    best = F.min_by("entity", F.struct(-F.col("frequency"), F.col("entity")))
    blocks = -(-loose.count() // most)
    for b in range(blocks):
        block = loose.filter(F.pmod(F.xxhash64("asked"), F.lit(blocks)) == b)
        pair = node_table.join(F.broadcast(block), F.col("entity").contains(F.col("low")) | F.col("low").contains(F.col("entity")))
        exact = exact.unionByName(pair.groupBy("asked").agg(best.alias("entity")))
    return exact


def related_documents(mentions: DataFrame, most: int = 3) -> DataFrame:
    """(entity, documents): the first documents of each entity, ranked before they are gathered."""
    by = Window.partitionBy("entity").orderBy("doc_id")
    first = mentions.select("entity", "doc_id").distinct().withColumn("r", F.row_number().over(by)).filter(F.col("r") <= most)
    return first.groupBy("entity").agg(F.array_sort(F.collect_list("doc_id")).alias("documents"))


def traverse(edges: DataFrame, starts: DataFrame, depth: int = 2, most: int | None = 20, paths: bool = False) -> DataFrame:
    """(start, entity, depth) reached both ways, the nearest `most` of each start by (depth, entity), starts included at 0; with `paths` also the least path.

    starts: (start). Each level is one join of the frontier with the edges and one anti join with what was met.
    """
    around = written(both_ways(edges), "graph")
    met = starts.select("start", F.col("start").alias("entity"), F.lit(0).alias("depth"), F.array("start").alias("path"))
    frontier = met
    for d in range(1, depth + 1):
        step = frontier.join(around, frontier["entity"] == around["a"]).select("start", F.col("b").alias("entity"), *([F.concat("path", F.array("b")).alias("path")] if paths else []))
        new = step.groupBy("start", "entity").agg(F.min("path").alias("path")) if paths else step.distinct().withColumn("path", F.lit(None).cast("array<string>"))
        frontier = written(new.join(met.select("start", "entity"), ["start", "entity"], "left_anti").select("start", "entity", F.lit(d).alias("depth"), "path"), "graph")
        met = met.unionByName(frontier)
    order = Window.partitionBy("start").orderBy("depth", "entity")
    met = met.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).drop("r") if most else met
    return met if paths else met.drop("path")


def query_entity(edges: DataFrame, names: DataFrame, depth: int = 2) -> DataFrame:
    """(entity, neighbours, relations, reach): distinct neighbours both ways, edges out and in (bag), nodes within `depth` along out-edges, itself included."""
    around = both_ways(edges).groupBy(F.col("a").alias("entity")).agg(F.count("*").alias("neighbours"))
    bag = degrees(edges).select("entity", (F.col("out_degree") + F.col("in_degree")).alias("relations"))
    out = edges.select("src", "dst").distinct()
    reach = names.select(F.col("entity").alias("start"), F.col("entity"))
    total = reach
    for _ in range(depth):
        reach = reach.join(out, reach["entity"] == out["src"]).select("start", F.col("dst").alias("entity")).distinct()
        total = total.union(reach)
    size = total.distinct().groupBy(F.col("start").alias("entity")).agg(F.count("*").alias("reach"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return names.join(around, "entity", "left").join(bag, "entity", "left").join(size, "entity", "left").select("entity", zero("neighbours"), zero("relations"), zero("reach"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, longest: int | None = None) -> DataFrame:
    """(a, b, length, path): the shortest undirected path of each pair, of several the least in order; -1 and null if there is none (of at most `longest`, if given).

    All pairs advance together, a level a join, until nothing new is met; at each level a node keeps its least path. A start
    whose pairs are all settled goes no further.
    """
    around = written(both_ways(edges).withColumnRenamed("a", "u").withColumnRenamed("b", "v"), "graph")
    asked = written(pairs.select("a", "b").distinct(), "graph")
    frontier = asked.select("a").distinct().select("a", F.col("a").alias("at"), F.array("a").alias("path"))
    met, level = frontier, 0
    while longest is None or level < longest:
        level += 1
        if level > 1:
            left = asked.join(met.select("a", F.col("at").alias("b")), ["a", "b"], "left_anti").select("a").distinct()
            frontier = frontier.join(left, "a", "left_semi")
        new = frontier.join(around, frontier["at"] == around["u"]).select("a", F.col("v").alias("at"), F.concat("path", F.array("v")).alias("path"))
        new = new.join(met.select("a", "at"), ["a", "at"], "left_anti").groupBy("a", "at").agg(F.min("path").alias("path"))
        frontier = written(new, "graph")
        if frontier.isEmpty():
            break
        met = written(met.unionByName(frontier), "graph")
    found = met.select("a", F.col("at").alias("b"), "path")
    return asked.join(found, ["a", "b"], "left").select("a", "b", F.coalesce((F.size("path") - 1).cast("long"), F.lit(-1)).alias("length"), "path")


def path_relations(paths: DataFrame, edges: DataFrame, default: str = "related_to") -> DataFrame:
    """(a, b, step, src, dst, relation) of each step of (a, b, path): the least relation of an edge that way, else of one the other way, else the default.

    edges: (src, dst) and perhaps relation.
    """
    steps = paths.filter("size(path) > 1").select("a", "b", F.posexplode(F.transform(F.slice("path", F.lit(1), F.size("path") - 1), lambda x, i: F.struct(x.alias("src"), F.get("path", i + 1).alias("dst")))).alias("step", "e"))
    steps = steps.select("a", "b", "step", "e.src", "e.dst")
    told = F.col("relation") if "relation" in edges.columns else F.lit(default)
    named = edges.groupBy("src", "dst").agg(F.min(told).alias("there"))
    back = named.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("there").alias("back"))
    return steps.join(named, ["src", "dst"], "left").join(back, ["src", "dst"], "left").select("a", "b", "step", "src", "dst", F.coalesce("there", "back", F.lit(default)).alias("relation"))


def pagerank(edges: DataFrame, node_table: DataFrame | None = None, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, cut_each: int = 5) -> DataFrame:
    """(entity, rank): parallel edges weigh more, what dangles is spread evenly.

    Ends after the round in which ranks change by less than `tolerance` a node on average, and after `rounds` at the
    latest; without a tolerance after so many rounds, of which every few are planned as one.
    """
    weights = written(edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w")), "graph")  # the one time that edges are read
    if node_table is None:
        node_table = weights.select(F.col("src").alias("entity")).union(weights.select(F.col("dst").alias("entity")))
    base = node_table.select("entity").distinct().join(weights.select(F.col("src").alias("entity")).distinct().withColumn("feeds", F.lit(True)), "entity", "left")
    base = written(base, "graph")
    weights = written(weights.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy("src"))).select("src", "dst", "share"), "graph")
    n = base.count()
    ranks = base.select("entity", "feeds", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(1, rounds + 1):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("feeds").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        flow = weights.join(ranks, weights["src"] == ranks["entity"]).groupBy(F.col("dst").alias("entity")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        joined = base.join(flow, "entity", "left").join(F.broadcast(loose), how="cross")  # one row
        new = joined.select("entity", "feeds", (F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("loose") / max(n, 1))).alias("rank"))
        if tolerance is not None:
            new = written(new.join(ranks.select("entity", F.col("rank").alias("before")), "entity"), "graph")
            change = new.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0
            ranks = new.select("entity", "feeds", "rank")
            if change < n * tolerance:
                break
        else:
            ranks = written(new, "graph") if i % cut_each == 0 or i == rounds else new
    return ranks.select("entity", "rank")


def most_central(ranks: DataFrame, edges: DataFrame, node_table: DataFrame, k: int = 20) -> DataFrame:
    """(entity, pagerank, type, frequency, connections) of the k nodes of highest rank, six digits of it; connections count the bag of edges."""
    best = ranks.select("entity", F.round("rank", 6).alias("pagerank")).orderBy(F.desc("pagerank"), "entity").limit(k)
    bag = degrees(edges).select("entity", (F.col("out_degree") + F.col("in_degree")).alias("connections"))
    out = best.join(node_table.select("entity", "type", "frequency"), "entity", "left").join(bag, "entity", "left")
    return out.select("entity", "pagerank", F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("frequency", F.lit(0)).alias("frequency"), F.coalesce("connections", F.lit(0)).alias("connections"))


def hubs(traversed: DataFrame, most: int = 5) -> DataFrame:
    """(entity, n) of entities met from more than one start, the most met first."""
    return traversed.groupBy("entity").agg(F.count_distinct("start").alias("n")).filter("n > 1").orderBy(F.desc("n"), "entity").limit(most)


def context_lines(edges: DataFrame, node_table: DataFrame, asked: DataFrame, names: int = 5, related: int = 5) -> DataFrame:
    """(query_id, context): a line for each of a query's first entities, with its first related ones in order.

    asked: (query_id, ordinal, entity).
    """
    first = asked.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("ordinal"))).filter(F.col("r") <= names)
    near = both_ways(edges).withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter(F.col("n") <= related)
    around = near.groupBy(F.col("a").alias("entity")).agg(F.array_join(F.array_sort(F.collect_list("b")), ", ").alias("rel"))
    line = F.concat(F.lit("- "), F.col("entity"), F.lit(" ("), F.col("type"), F.lit(") is related to: "), F.col("rel"))
    rows = first.join(node_table.select("entity", "type"), "entity").join(around, "entity").select("query_id", "r", line.alias("line"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("context"))


def multi_hop(edges: DataFrame, names: DataFrame, depth: int = 2, reach: int = 10, longest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Between the named entities (entity): (a, b, length, between) of all pairs' shortest paths, and the hubs that traversals from several of them meet."""
    pairs = names.select(F.col("entity").alias("a")).join(names.select(F.col("entity").alias("b")), F.col("a") < F.col("b"))  # of a question's few names
    paths = shortest_paths(edges, pairs, longest).select("a", "b", "length", F.when(F.size("path") > 2, F.slice("path", F.lit(2), F.size("path") - 2)).alias("between"))
    return paths, hubs(traverse(edges, names.select(F.col("entity").alias("start")), depth, reach))
