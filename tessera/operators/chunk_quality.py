"""Measures of a chunking, from embeddings in order: similarity of neighbours, breaks, change points, clarity, stickiness, information gain."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tessera.functions import vectors

#: Threshold in standard deviations, and the window of change points. At width 3 a point cannot lie 1.5 deviations below its own window's mean.
K, WIDTH = 1.5, 5
#: Rows of a document that are compared with as many at a time, at least and at most; similarities that a worker holds at a time.
LEAST, MOST, HELD = 256, 8192, 1 << 22
#: Documents whose sizes are broadcast.
FEW = 100_000


def consecutive(rows: DataFrame, digits: int = 9) -> DataFrame:
    """(doc_id, pos, sim) of each row and the next, from (doc_id, pos, embedding)."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    following = rows.withColumn("e2", F.lead("embedding").over(by)).filter("e2 IS NOT NULL")
    return following.select("doc_id", "pos", F.round(vectors.cosine(F.col("embedding"), F.col("e2")), digits).alias("sim"))


def neighbours(rows: DataFrame, digits: int = 9) -> DataFrame:
    """(doc_id, pos, prev_sim, next_sim), null at the ends."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    sims = rows.join(consecutive(rows, digits), ["doc_id", "pos"], "left").select("doc_id", "pos", F.col("sim").alias("next_sim"))
    return sims.withColumn("prev_sim", F.lag("next_sim").over(by)).select("doc_id", "pos", "prev_sim", "next_sim")


def breakpoints(sims: DataFrame, percentile: float = 0.95, drop: float | None = 0.15) -> DataFrame:
    """Rows whose dissimilarity reaches the document's percentile, or `drop`."""
    d = sims.withColumn("dissim", 1 - F.col("sim"))
    limit = d.groupBy("doc_id").agg(F.percentile("dissim", F.lit(percentile)).alias("limit"))
    hit = F.col("dissim") >= F.col("limit") if drop is None else (F.col("dissim") >= F.col("limit")) | (F.col("dissim") >= drop)
    return d.join(limit, "doc_id").filter(hit).select("doc_id", "pos", "dissim", "limit")


def change_points(sims: DataFrame, width: int = WIDTH, k: float = K) -> DataFrame:
    """(doc_id, position, sim, mean, deviation, threshold, confidence): where a similarity lies under its window's mean by k deviations.

    Only where the window is whole; position is that of the sentence behind.
    """
    half = width // 2
    by = Window.partitionBy("doc_id").orderBy("pos")
    over = by.rowsBetween(-half, half)
    d = sims.withColumn("i", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    d = d.withColumn("mean", F.avg("sim").over(over)).withColumn("deviation", F.stddev_pop("sim").over(over)).withColumn("threshold", F.col("mean") - k * F.col("deviation"))
    inside = (F.col("i") >= half) & (F.col("i") < F.col("n") - half) & (F.col("n") >= width)
    fired = d.filter(inside & (F.col("sim") < F.col("threshold")))
    return fired.select("doc_id", (F.col("i") + 1).cast("long").alias("position"), "sim", "mean", "deviation", "threshold", ((F.col("threshold") - F.col("sim")) / (F.col("deviation") + 1e-8)).alias("confidence"))


def boundary_clarity(rows: DataFrame) -> DataFrame:
    """(doc_id, clarity): half minus the mean step of neighbour similarities, clipped; for two chunks their dissimilarity; 1 for one."""
    s = consecutive(rows)
    by = Window.partitionBy("doc_id").orderBy("pos")
    steps = s.withColumn("g", F.col("sim") - F.lag("sim").over(by)).groupBy("doc_id").agg(F.avg("g").alias("g"), F.count("*").alias("m"), F.first("sim").alias("sim"))
    value = F.when(F.col("m").isNull(), 1.0).when(F.col("m") == 1, 1 - F.col("sim")).otherwise(vectors.clipped(0.5 - F.col("g")))
    return rows.select("doc_id").distinct().join(steps, "doc_id", "left").select("doc_id", value.alias("clarity"))


def pair_similarities(rows: DataFrame) -> DataFrame:
    """(doc_id, chunk, i, j, sim) of the pairs i < j within a chunk, from (doc_id, chunk, pos, embedding): quadratic in a chunk's sentences only."""
    a = rows.select("doc_id", "chunk", F.col("pos").alias("i"), F.col("embedding").alias("ea"))
    b = rows.select("doc_id", "chunk", F.col("pos").alias("j"), F.col("embedding").alias("eb"))
    return a.join(b, ["doc_id", "chunk"]).filter("i < j").select("doc_id", "chunk", "i", "j", vectors.cosine(F.col("ea"), F.col("eb")).alias("sim"))


def stickiness(rows: DataFrame) -> DataFrame:
    """(doc_id, between, within, stickiness): variance of neighbour similarities over the mean variance within chunks.

    rows: (doc_id, chunk, pos, embedding); neighbours are all rows of a document in order.
    """
    within = pair_similarities(rows).groupBy("doc_id", "chunk").agg(F.var_pop("sim").alias("v")).groupBy("doc_id").agg(F.avg("v").alias("within"))
    between = consecutive(rows).groupBy("doc_id").agg(F.var_pop("sim").alias("between"))
    return between.join(within, "doc_id").select("doc_id", "between", "within", (F.col("between") / (F.col("within") + 1e-8)).alias("stickiness"))


def _unit(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of unit length) of the vectors of each length; those that are null or hold a null are left out."""
    flat = column.flatten()
    ends = np.cumsum(np.where(column.is_null(), 0, column.value_lengths().fill_null(0)))
    holes = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    size = np.diff(ends, prepend=0)
    whole = ~column.is_null().to_numpy(zero_copy_only=False) & (holes[ends] == holes[ends - size])
    values, out = flat.to_numpy(zero_copy_only=False).astype(np.float64), []
    for width in np.unique(size[whole]):
        rows = np.flatnonzero(whole & (size == width))
        x = values[(ends[rows] - width)[:, None] + np.arange(width)]
        with np.errstate(all="ignore"):
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.where(np.isfinite(length), x / np.where(length == 0, 1, length), np.nan)
        out.append((rows, x))
    return out


def _positive(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray | None = None) -> float:
    """The sum of the positive products of rows of a and b, each times the weights of its rows."""
    total, step = 0.0, max(1, HELD // max(1, len(b)))
    weights = np.ones((len(b), 1)) if wb is None else np.stack([np.ones(len(b)), wb], axis=1)
    for start in range(0, len(a), step):
        sims = a[start : start + step] @ b.T
        np.maximum(sims, 0, out=sims)
        own = sims @ weights
        total += wa[start : start + step] @ own[:, 0] + (0.0 if wb is None else own[:, 1].sum())
    return float(total)


def _compared(part: pa.Table) -> tuple[float, int]:
    """Of two blocks of a document, or one with itself, in rows (block, pos, n, embedding): the sum over rows of their mean
    positive similarity to rows of the other block at other positions, times the share of these; in one block, its positions."""
    part = part.combine_chunks()
    block, n = part.column("block").to_numpy(), part.column("n").to_numpy()
    pos = part.column("pos").combine_chunks().dictionary_encode().indices.to_numpy()
    at = np.bincount(pos)[pos]  # rows of the same position; all of them are in the block
    # A position counts once, whatever its rows, and has n - at others.
    weight = np.where(n > at, 1 / (at * np.maximum(n - at, 1.0)), 0.0)
    first = block == block.min()
    alone, total = bool(first.all()), 0.0
    for rows, x in _unit(part.column("embedding").combine_chunks()):
        one, w = first[rows], weight[rows]
        if not alone:
            total += _positive(x[one], x[~one], w[one], w[~one])
            continue
        total += _positive(x, x, w)
        single = at[rows] == 1
        total -= float(w[single] @ np.maximum((x[single] * x[single]).sum(axis=1), 0))
        shared = rows[~single & (w > 0)]
        order = np.argsort(pos[shared], kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(pos[shared][order])) + 1) if len(order) else []:
            own = x[np.searchsorted(rows, shared[same])]
            total -= _positive(own, own, weight[shared[same]])
    return total, len(np.unique(pos[n > at])) if alone else 0


def information_gain(rows: DataFrame, entropies: DataFrame) -> DataFrame:
    """(doc_id, gain) from (doc_id, pos, embedding) and (doc_id, pos, h): mean entropy times one minus the mean positive similarity to the others.

    All pairs of a document count. Its rows are dealt into blocks of bounded size by position, and each pair of blocks is
    one product of matrices, so pairs are never rows of a table; a row is sent once for each block of its document.
    """
    own = rows.select("doc_id", "pos", "embedding").filter("doc_id IS NOT NULL AND pos IS NOT NULL")
    sizes = own.groupBy("doc_id").agg(F.count("*").alias("n"))
    docs, pairs = sizes.agg(F.count("*"), F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0))).first()
    most = min(MOST, max(LEAST, math.isqrt(int(pairs / (4 * rows.sparkSession.sparkContext.defaultParallelism)))))
    sized = own.join(F.broadcast(sizes) if docs <= FEW else sizes, "doc_id").withColumn("blocks", F.ceil(F.col("n") / most))
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("pos"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("doc_id", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "pos", "n", "embedding")
    schema = StructType([StructField("doc_id", rows.schema["doc_id"].dataType), StructField("total", DoubleType()), StructField("positions", LongType())])

    def run(key: tuple, part: pa.Table) -> pa.Table:
        # One block of a pair may have no rows; a block is compared with itself under its own number only.
        total, positions = _compared(part) if key[1].as_py() == key[2].as_py() or len(part.column("block").unique()) == 2 else (0.0, 0)
        return pa.table({"doc_id": pa.array([key[0].as_py()], part.schema.field("doc_id").type), "total": [total], "positions": pa.array([positions], pa.int64())})

    sums = dealt.groupBy("doc_id", "a", "b").applyInArrow(run, schema).groupBy("doc_id").agg(F.sum("total").alias("total"), F.sum("positions").alias("positions"))
    shared = sums.filter("positions > 0").select("doc_id", (F.col("total") / F.col("positions")).alias("mi"))
    h = entropies.groupBy("doc_id").agg(F.avg("h").alias("h"))
    return h.join(shared, "doc_id", "left").select("doc_id", F.when(F.col("mi").isNull(), 1.0).otherwise(vectors.clipped(F.col("h") * (1 - F.col("mi")))).alias("gain"))


def entropy(words: F.Column) -> F.Column:
    """Distinct words over all, less for under 200 words."""
    n = F.size(words)
    return F.when(n > 0, F.size(F.array_distinct(words)) / n * F.least(F.lit(1.0), n / 200)).otherwise(F.lit(0.0))


def global_boundaries(sims: DataFrame, k: float = K) -> DataFrame:
    """(n, boundaries): similarities under the overall mean by k deviations."""
    stats = sims.agg(F.avg("sim").alias("m"), F.stddev_pop("sim").alias("s"))
    return sims.join(F.broadcast(stats), how="cross").agg(F.count("*").alias("n"), F.count_if(F.col("sim") < F.col("m") - k * F.col("s")).alias("boundaries"))  # one row
