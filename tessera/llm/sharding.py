"""Shards by best-fit-decreasing bin packing.

Rows with equal texts are a group that no shard divides. Items enter, by size from the largest, the bin with the
tightest remaining capacity that holds them, found in a balanced tree.

With a number of shards given, groups that are large against a shard are items of their own; the many small ones are
gathered by the hash of their text into a fixed number of buckets, each an item, so the driver packs a number of items
that the parameters bound, whatever the corpus. The smallest capacity whose packing needs no more bins is searched for. A
group larger than a whole shard can stand in no shard undivided: it is cut into parts, by the hash of the key, each an
item (copies of one text that hold a third of all bytes are then spread over a third of the shards).

With a capacity given, no shard holds more than that, but where a single row does (it then has a shard to itself). Groups
of at least a 64th of a shard are items; smaller ones are run together in the order of their hash into items of at most
a 32nd of a shard; a group beyond the capacity is cut into runs of rows that fit. Items are dealt by hash into cells of
many shards each and every cell is packed by one task, so nothing is gathered on the driver and any number of shards is
packed at once. A cell leaves at most one shard less than half full.

Inputs: a null text counts as an empty one (size 1); rows with equal keys and texts each get a slot, in an order that is
fixed by the key and otherwise free; an empty table gives an empty one; only the key and the text column are read, so
further columns never clash.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Buckets of small groups; a group is an item of its own from this share of a shard on; rows for one numbering task; items that a cell has about.
BUCKETS, LARGE, ROWS, CELL = 4_096, 64, 100_000, 50_000


class Bins:
    """Bins in a treap by (remaining capacity, number): a balanced tree in expectation, seeded and so repeatable."""

    def __init__(self):
        self.root, self.random = None, random.Random(0)

    def add(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._join(self._join(low, [key, self.random.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity of at least size."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            self.root = low
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self.root = self._join(low, rest)
        return node[0]

    def _split(self, node, key):
        """Keys below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            node[3] = a
            return node, b
        a, b = self._split(node[2], key)
        node[2] = b
        return a, node

    def _join(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] < b[1]:
            a[3] = self._join(a[3], b)
            return a
        b[2] = self._join(a, b[2])
        return b


def pack(sizes: list[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item, items in the order of falling size; None if more than `most` bins were needed or an item exceeds the capacity."""
    bins, opened, out = Bins(), 0, []
    for size in sizes:
        if size > capacity:
            return None
        found = bins.take(size)
        if found is None:
            if opened == most:
                return None
            found = (capacity, opened)
            opened += 1
        bins.add((found[0] - size, found[1]))
        out.append(found[1])
    return out


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """The bin of each item when there are so many bins: by the smallest capacity that the packing finds to do."""
    low, high, best = max([-(-sum(sizes) // shards), *sizes[:1]]), 2 * max(sum(sizes), 1), None
    while low < high:
        middle = (low + high) // 2
        found = pack(sizes, middle, shards)
        if found is None:
            low = middle + 1
        else:
            high, best = middle, found
    return best or pack(sizes, low, shards) or [0] * len(sizes)


def sized(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, digest): UTF-8 bytes plus 1; equal texts have equal digests."""
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("digest"))


def assign(docs: DataFrame, shards: int | None = 16, capacity: int | None = None, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, large: int = LARGE, rows: int = ROWS, cell: int = CELL) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row, with a number of shards or else a capacity in bytes.

    Slots of a shard are numbered without gaps from 0. They are counted within parts of about `rows` rows, so no task
    holds a shard.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    base = common.written(sized(docs, text, key), "sized")
    total, n = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    placed = _into(base, shards, total, buckets, large) if shards else _within(base, capacity, total, n, large, rows, cell)
    # Numbering: each shard falls into pieces of about `rows` rows by the key's hash.
    pieces = max(1, -(-n // rows))
    items = placed.select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(pieces)).cast("int").alias("piece"))
    counts = items.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "piece", before.alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("doc_id", "text_crc32", "size"))
    return items.withColumn("number", number).join(offsets, ["shard", "piece"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"))


def _into(base: DataFrame, shards: int, total: int, buckets: int, large: int) -> DataFrame:
    """base with `shard`, for a number of shards: the driver packs the buckets of small groups and at most `large` groups a shard."""
    spark = base.sparkSession
    room = max(1, -(-total // shards))
    base = base.withColumn("bucket", F.pmod(F.col("digest"), F.lit(buckets)).cast("long"))
    groups = base.groupBy("digest").agg(F.sum("size").alias("bytes"))
    own = [(r["digest"], r["bytes"]) for r in groups.filter(F.col("bytes") >= max(1, -(-room // large))).collect()]
    known = spark.createDataFrame([(d, -(-b * 4 // room) if b > room else 1) for d, b in own], "digest long, parts int")
    items = base.join(F.broadcast(known), "digest", "left")
    salt = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(F.lit(0)).cast("int")
    items = items.withColumn("item", F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(F.col("digest"))).withColumn("part", F.when(F.col("parts").isNull(), F.lit(-1)).otherwise(salt))
    held = [(r["item"], r["part"], r["bytes"]) for r in items.groupBy("item", "part").agg(F.sum("size").alias("bytes")).collect()]
    held.sort(key=lambda x: (-x[2], x[0], x[1]))
    bins = pack_into([x[2] for x in held], shards)
    placed = spark.createDataFrame([(i, p, b) for (i, p, _), b in zip(held, bins, strict=True)], "item long, part int, shard int")
    return items.join(F.broadcast(placed), ["item", "part"])


def _within(base: DataFrame, capacity: int, total: int, n: int, large: int, rows: int, cell: int) -> DataFrame:
    """base with `shard`, for a capacity: items as the module tells, packed cell by cell in tasks."""
    small = max(1, -(-capacity // large))  # bytes from which a group is an item
    groups = base.groupBy("digest").agg(F.sum("size").alias("bytes"), F.max("size").alias("each"))
    # Small groups, in the order of their hash within strips, follow each other into runs of at most twice `small`.
    strips = max(1, -(-n // rows))
    strip = F.pmod(F.xxhash64("digest"), F.lit(strips)).cast("int")
    summed = F.sum("bytes").over(Window.partitionBy("strip").orderBy("digest"))
    gathered = groups.filter(F.col("bytes") < small).withColumn("strip", strip).select("digest", F.col("strip").cast("long").alias("item"), F.floor((summed - F.col("bytes")) / small).cast("long").alias("part"), F.lit(1).alias("kind"))
    fitting = groups.filter((F.col("bytes") >= small) & (F.col("bytes") <= capacity)).select("digest", F.col("digest").alias("item"), F.lit(0).cast("long").alias("part"), F.lit(2).alias("kind"))
    known = common.written(gathered.unionByName(fitting), "items")
    whole = base.join(known, "digest").select("doc_id", "size", "text_crc32", "kind", "item", "part")
    # What is larger than a shard: rows of one size, numbered within pieces, so many to a part as fit.
    beyond = base.join(groups.filter(F.col("bytes") > capacity).select("digest"), "digest", "left_semi")
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(strips)).cast("long")
    number = F.row_number().over(Window.partitionBy("digest", "piece").orderBy("doc_id")) - 1
    many = F.greatest(F.lit(1), F.floor(F.lit(capacity) / F.col("size")))
    cut = beyond.withColumn("piece", piece).withColumn("run", F.floor(number / many).cast("long")).select("doc_id", "size", "text_crc32", F.lit(3).alias("kind"), F.col("digest").alias("item"), (F.col("piece") * (n + 1) + F.col("run")).alias("part"))
    items = common.written(whole.unionByName(cut), "parts")
    held = items.groupBy("kind", "item", "part").agg(F.sum("size").alias("bytes"))
    held = common.written(held, "held")
    # Cells of about so many items, but of 64 shards at least, so that what a cell leaves open is little.
    cells = max(1, min(-(-held.count() // cell), total // (64 * capacity)))
    dealt = held.withColumn("cell", F.pmod(F.xxhash64("kind", "item", "part"), F.lit(cells)).cast("int"))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "kind", "item", "part"], ascending=[False, True, True, True], ignore_index=True)
        sizes = frame["bytes"].tolist()
        alone = sum(s > capacity for s in sizes)  # single rows beyond the capacity: a shard for each
        return frame[["cell", "kind", "item", "part"]].assign(own=[*range(alone), *(alone + b for b in pack(sizes[alone:], capacity))])

    found = common.written(dealt.groupBy("cell").applyInPandas(packed, "cell int, kind int, item long, part long, own int"), "packed")
    # Shards are numbered through all cells, of which there are few against the shards.
    opened = found.groupBy("cell").agg((F.max("own") + 1).alias("opened"))
    first = F.coalesce(F.sum("opened").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = found.join(opened.select("cell", first.alias("first")), "cell").select("kind", "item", "part", (F.col("first") + F.col("own")).cast("int").alias("shard"))
    return items.join(numbered, ["kind", "item", "part"])
