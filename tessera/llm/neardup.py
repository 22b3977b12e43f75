"""MinHash near-dedup: fast similarity sketches, banding, exact verification.

A document's set is its distinct `span`-word shingles. Sketch: in round after round every element is hashed to one of
the coordinates and to a value that grows with the round; a coordinate keeps its least value, and rounds go on until all
coordinates hold one. After as many rounds as there are coordinates, each further round serves one fixed coordinate, so
all fill for certain; estimates are concentrated as if each coordinate were drawn on its own, at a cost of the set's
size plus t log t in place of their product.

Equal sets are one class, known by its smallest document, before anything is compared. Coordinates are grouped into
bands; in a bucket of classes that agree on a band, each is compared with the smallest one only, so a group of any size
gives as many pairs as it has members. Links are confirmed on the full sets and joined to components.

Where a bucket still holds members of different components that were not compared, these are joined exactly: shingles
are ordered by rarity (those of one component alone first), and two sets can be similar enough only if they share one
of their rarest, at places that leave room for the overlap that their sizes ask for. Sets that share a frequent template
but differ in the rest have their own words there, so they meet nowhere, and the work grows with the documents and not
with the pairs. On each shingle the members of its largest component are never paired with each other.

So a link can be lost only if its two sets agree on no band at all (36 bands of 4: about one in a million at the least
similarity) and no other links join them.

Inputs: null, empty or blank texts have empty sets and are linked with nothing; a text of fewer words is one shingle;
rows with equal keys are one document, linked as any of them is; rows with a null key are linked with nothing and kept;
an empty table gives an empty one; only the key and the text column are read, so further columns never clash. Long
texts are handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: Words in a shingle, least similarity (as a part of 100), bands, coordinates in a band, words whose hashes a worker remembers.
SPAN, LEAST, BANDS, ROWS, MEMO = 5, 75, 36, 4, 500_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def shingle_sets(texts: list[bytes | None], words: Words, span: int = SPAN) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    get, out = words.__getitem__, []
    weights = ODD * (2 * np.arange(len(ODD), dtype=np.uint64) + np.uint64(1))
    for text in texts:
        split = text.lower().split() if text else []
        n = len(split)
        h = np.fromiter(map(get, split), np.uint64, n)
        if not n:
            out.append(h)
            continue
        size = min(span, n)
        total = np.full(n - size + 1, size, dtype=np.uint64)
        for k in range(size):
            total += h[k : n - size + 1 + k] * weights[k % len(weights)] * np.uint64(1 + 2 * (k // len(weights)))
        out.append(np.unique(mix(total)))
    return out


def sketches(sets: list[np.ndarray], coordinates: int = BANDS * ROWS) -> np.ndarray:
    """A row of filled coordinates for each set; for empty sets all bits are set."""
    t = coordinates
    out = np.full((len(sets), t), np.uint64(0xFFFFFFFFFFFFFFFF))
    flat = out.ravel()
    active = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.uint64(0xFFFFFFFF)
    for r in range(2 * t):
        if not len(active):
            break
        if r < 4 or r % 4 == 0:  # those that are full by now leave
            elements = np.concatenate([sets[i] for i in active])
            owner = np.repeat(active, [len(sets[i]) for i in active])
        x = mix(elements + np.uint64((r + 1) * int(ODD[0]) & 0xFFFFFFFFFFFFFFFF))
        at = (x >> np.uint64(32)) * np.uint64(t) >> np.uint64(32) if r < t else np.full(len(x), r - t, dtype=np.uint64)
        np.minimum.at(flat, owner * t + at.astype(np.int64), (x & low) | np.uint64(r) << np.uint64(32))
        if r < 3 or r % 4 == 3:
            active = active[(out[active] == none).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each set and band; equal keys mean an equal band."""
    parts = sketch.reshape(len(sketch), bands, rows)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * ODD[1], parts.shape[:2]).copy()
    for k in range(rows):
        total = mix(total + parts[:, :, k] * ODD[k % len(ODD)] + np.uint64(k))
    return total.view(np.int64)


def _sketched(docs: DataFrame, text: str, key: str, span: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands): digest and bands are null for empty sets."""

    def work():
        words = Words()

        def each(texts: list[bytes | None]) -> list[list]:
            sets = shingle_sets(texts, words, span)
            keys = band_keys(sketches(sets, bands * rows), bands, rows)
            return [
                [len(s) for s in sets],
                [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                [k if len(s) else None for s, k in zip(sets, keys, strict=True)],
            ]

        return each

    return common.annotate(docs, text, key, "n_shingles long, digest binary, bands array<long>", work, as_bytes=True)


def _confirmed(pairs: DataFrame, texts: DataFrame, span: int, least: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; pairs come to a task in the order of a, whose set is made once."""
    met = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    met = met.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            for part in common.slices(batch, "text_b"):
                keep = []
                for ta, tb in zip(part.column(2), part.column(3), strict=True):
                    ta, tb = ta.as_py(), tb.as_py()
                    if last[0] != ta:
                        last = (ta, shingle_sets([ta], words, span)[0])
                    a, b = last[1], shingle_sets([tb], words, span)[0]
                    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
                        keep.append(False)
                        continue
                    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
                    both = int((a[at] == b).sum())
                    keep.append(100 * both >= least * (len(a) + len(b) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): the smallest node reachable.

    Rounds of taking the least label around and then the label of one's label, each written to the shared folder, until
    nothing changes; labels reach twice as far in each round or better.
    """
    both = common.written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = common.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("l")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("l").alias("m"))
        new = labels.join(around, "node").select("node", "l", F.least("l", "m").alias("m"))
        new = common.written(new, "labels")
        jump = new.select(F.col("node").alias("m"), F.col("m").alias("j"))
        new = common.written(new.join(jump, "m").select("node", "l", F.least("m", "j").alias("m")), "labels")
        changed = new.filter("l <> m").limit(1).count()
        labels = new.select("node", F.col("m").alias("l"))
        if not changed:
            return labels.select("node", F.col("l").alias("component"))


def _rest(members: DataFrame, texts: DataFrame, span: int, least: int) -> DataFrame:
    """All links between different components of (node, component), by prefixes of the rarest shingles."""
    own = texts.withColumnRenamed("doc_id", "node").join(members, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for part in common.slices(batch, "text", 1 << 20):
                sets = shingle_sets(part.column(2).to_pylist(), words, span)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["node", "component", "n", "shingles"])

    sets = common.written(own.select("node", "component", "text").mapInArrow(run, "node long, component long, n long, shingles array<long>"), "sets")
    each = sets.select("node", "component", "n", F.explode("shingles").alias("s"))
    # Shingles that several components have: how many documents hold each, and the component that most of these are in.
    counts = each.groupBy("s", "component").agg(F.count("*").alias("c"))
    shared = counts.groupBy("s").agg(F.sum("c").alias("df"), F.count("*").alias("components"), F.max_by("component", F.struct("c", "component")).alias("major")).filter("components > 1").select("s", "df", "major")
    held = each.join(common.written(shared, "shared"), "s").groupBy("node", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s", "major"))).alias("own"))
    # Places from 0 in the order of rarity, in which the shingles of one component alone come first.
    first = f"n - size(own) + i < n - (n * {least} + 99) div 100 + 1"
    prefix = held.select("node", "component", "n", "own", F.posexplode("own").alias("i", "x")).filter(first)
    length = F.log(F.col("n").cast("double")) / float(np.log(100 / least))
    prefix = common.written(prefix.select("node", "component", "n", (F.col("n") - F.size("own") + F.col("i")).alias("p"), F.col("x.s").alias("s"), (F.col("component") == F.col("x.major")).alias("major"), length.alias("length")), "prefix")
    # The smaller set is found by the larger one, in the classes of length that can be similar enough.
    small = prefix.filter(f"(n - p) * {100 + least} >= {2 * least} * n").select("s", F.floor("length").alias("length"), *(F.col(c).alias(f"a_{c}") for c in ("node", "component", "n", "p", "major")))
    large = prefix.select("s", F.explode(F.sequence(F.floor(F.col("length") - 1 - 1e-6), F.floor(F.col("length") + 1e-6))).alias("length"), *(F.col(c).alias(f"b_{c}") for c in ("node", "component", "n", "p", "major")))
    room = f"""a_component <> b_component AND (a_n < b_n OR (a_n = b_n AND a_node < b_node)) AND 100 * a_n >= {least} * b_n
        AND least(a_n - a_p, b_n - b_p) * {100 + least} >= {least} * (a_n + b_n)"""
    met = small.filter("NOT a_major").join(large, ["s", "length"]).filter(room).unionByName(small.filter("a_major").join(large.filter("NOT b_major"), ["s", "length"]).filter(room))
    pairs = common.written(met.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct(), "rest")
    return _confirmed(pairs, texts, span, least)


def link(docs: DataFrame, span: int = SPAN, least: int = LEAST, bands: int = BANDS, rows: int = ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    all_rows = common.written(_sketched(docs, text, key, span, bands, rows), "sketches")
    sets = all_rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = common.written(sets.groupBy("digest").agg(F.min("doc_id").alias("node")), "classes")
    alone = sets.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", "digest"], "left_semi")
    banded = alone.select(F.col("doc_id").alias("node"), F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("top")).filter("a <> top").select("key", "a")
    met = common.written(banded.join(buckets, "key").filter("node <> a").select("key", "a", F.col("node").alias("b")), "met")
    # All that is compared, now or later, stands in such a bucket: its texts are gathered once.
    ids = met.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    texts = common.written(own.join(ids, "doc_id", "left_semi"), "texts")
    # Each is compared with the smallest of all its buckets' first, which settles most; then with the others' that are still of another component.
    first = common.written(met.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first")
    links = common.written(_confirmed(first, texts, span, least), "links")
    # One document may have rows with different texts: its classes are one node.
    same = sets.join(classes, "digest").filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")).distinct()
    split = sets.groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x <> y").select(F.col("doc_id").alias("b"))
    links = common.written(links.union(same.join(split, "b").select("a", "b")), "links")
    found = components(links)
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    other = met.select("a", "b").distinct().join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
    other = common.written(other.select("a", "b").join(first, ["a", "b"], "left_anti"), "other")
    if other.limit(1).count():
        links = common.written(links.union(_confirmed(other, texts, span, least)), "links")
        found = components(links)
    # Members of a bucket that are neither in one component nor were compared with each other.
    labelled = met.select("key", F.col("b").alias("node")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = labelled.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    rest = common.written(labelled.join(open_keys, "key", "left_semi").select("node", "component").distinct(), "open")
    if rest.limit(1).count():
        more = common.written(_rest(rest, texts, span, least), "links")
        if more.limit(1).count():
            found = components(links.union(more))
    named = classes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = all_rows.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    ids = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return ids.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that are the smallest of their component, with their columns; rows that share a key stay or go together."""
    drop = link(docs, key=key, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(drop, "id", "left_anti").select("row.*")
