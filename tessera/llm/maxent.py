"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | before) = P(class | before) * P(word | class, before). Both factors see the words before, themselves: hashed
features of one and two words before (n-grams) and of the second and the third before alone (skips).

The first factor starts from a log-linear model over hashed features of the classes before: bias, one before, two before,
and the second and third before alone. It is trained by distributed gradient steps on counts of (three classes before,
class) that all training texts give; their number is bounded by the number of classes. The second starts from the word's
share of its class. From there on both are softmaxes over binary trees, one over the classes and one over the words of
each class, which the counts halve. The log-odds of each fork are what the start gives, plus the weights of the features
at that fork, hashed into one table of SLOTS, where near forks of one feature lie together. Forks with weights of 0 give the start; each one is normalised, so all are.
Each of PASSES goes over all words of the training texts: tasks sum, for each weight, what was seen less what was
expected and its variance, rounded to integers, so that the order in which tasks are added does not matter; the driver
takes a damped Newton step.

Texts are split once: the numbers of their words are written, and training and scoring read these.

Classes: the `hot` most frequent words (seen twice or more) fall, by the group (language) they mostly stand in, into
tiers of about equal weight; all other words into one class for each group, told by the word's end, so that the class
of any word, seen or not, is known without a look at the counts of all words. The trees of the classes of other words
have buckets of word ends as leaves; a word has its share of its bucket, where one part is kept for unseen words, as
large as the number of words seen once. An unseen word has that part over the number of words that are still unseen in its
bucket, as the numbers seen once and twice tell (Chao's estimate). Before a word, other words stand with a hash of their own.

What is broadcast (hot words, trees, weights) is bounded by parameters. Counts of all other words grow with the corpus
and are joined, not broadcast.

Inputs: null and empty texts are the end token alone; repeated rows are learnt from and scored each; an empty table
gives an empty one; a missing group column is one group; only the named columns are read, so further columns never
clash. Long texts are handled whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import mmap
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

#: Words known on every worker, groups, tiers of hot words in a group, buckets of word ends, hashed features, gradient steps, their length.
HOT, GROUPS, TIERS, ENDS, HASHED, STEPS, RATE = 200_000, 4, 7, 4_096, 1 << 12, 24, 0.4
#: Weights of word features at forks, passes over all words, the length of their steps, what damps them; words that a worker holds the forks of at a time.
SLOTS, PASSES, STRIDE, DAMP, HELD = 1 << 22, 2, 0.5, 3.0, 1 << 13
#: Slots that are summed together, the parts of one that gradients are rounded to, words after which a worker looks at its sums, from where on it takes them over.
BLOCK, PARTS, SAFE, NEAR = 1 << 16, 1 << 8, 1 << 21, 1 << 30
#: Levels of forks whose weights lie together: what a word reads of them is in one line of the cache.
HIGH = 4
#: The most that a weight comes to, so that the odds of a fork are finite.
HIGHEST = 16.0
#: The end of a text; no word holds white space.
END = b"\n"
#: Words that a worker counts before it passes their counts on.
FLUSH = 300_000
FEATURES = 5
#: Hashes that words beyond the hot ones are told apart by, so that they and their end make a positive 32-bit number.
OTHERS = 1 << 19
#: Training words for each task of a pass, where there are more tasks than cores: every task passes on sums of its own.
WORDS = 1 << 22
#: Tasks of a gradient step.
TASKS = 4


def words_of(text: bytes | None) -> list[bytes]:
    return [*(text.lower().split() if text else ()), END]


def word_end(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDS


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, grp, end) from (text, grp): how often each word stands in all texts, its main group, the bucket of its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for grp, own in counts.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array([grp] * len(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["word", "grp", "n"])
            counts.clear()

        for batch in batches:
            for part in common.slices(batch, "text"):
                for text, grp in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts.setdefault(grp, Counter()).update(words_of(text))
                if sum(map(len, counts.values())) >= FLUSH:
                    yield from out()
        yield from out()

    found = rows.mapInArrow(run, "word binary, grp string, n long").groupBy("word", "grp").agg(F.sum("n").alias("n"))
    found = found.groupBy("word").agg(F.sum("n").alias("n"), F.max_by("grp", F.struct("n", "grp")).alias("grp"))
    return found.withColumn("end", (F.crc32(F.substring("word", -3, 3)) % ENDS).cast("int"))


@dataclass
class Tree:
    """Binary trees over consecutive leaves: the forks on the way to each leaf."""

    starts: np.ndarray  # of each leaf, in the next two; one more at the end
    forks: np.ndarray
    right: np.ndarray  # whether the way goes to the second part
    bounds: np.ndarray  # of each fork: first leaf, first leaf of the second part, end
    keys: np.ndarray  # of each fork, for hashing: 32 bits; those of HIGH levels have the key of the first, but for their place below it in the last bits


def tree_over(groups: list[np.ndarray], weight: np.ndarray, first: int = 0) -> Tree:
    """A tree over each group of leaves, in its order, halved by weight. Forks are numbered from 0 and hashed as from `first`."""
    order = np.concatenate([np.empty(0, np.int64), *groups]).astype(np.int32)
    summed = np.concatenate([[0.0], np.cumsum(weight[order] + 1e-9)])
    ends = np.cumsum([len(g) for g in groups], dtype=np.int64)
    low, high = ends - np.array([len(g) for g in groups], dtype=np.int64), ends
    steps, bounds, keys, n = [], [], [], 0
    # The key of the fork that a fork lies below, its place there: 1, then 2 and 3, and so on; 0 before the first one.
    key, below = np.zeros(len(low), dtype=np.uint64), np.zeros(len(low), dtype=np.uint64)
    while (split := high - low > 1).any():
        low, high, key, below = low[split], high[split], key[split], below[split]
        own = (below == 0) | (below >= 1 << HIGH)
        key = np.where(own, mixed(np.arange(first + n, first + n + len(low), dtype=np.uint64)) >> np.uint64(32 + HIGH) << np.uint64(HIGH), key)
        below = np.where(own, np.uint64(1), below)
        middle = np.clip(np.searchsorted(summed, (summed[low] + summed[high]) / 2), low + 1, high - 1)
        size = high - low
        fork = np.repeat(np.arange(len(low)), size)
        at = np.arange(len(fork)) - np.repeat(np.cumsum(size) - size, size) + low[fork]
        steps.append((order[at], (fork + n).astype(np.int32), at >= middle[fork]))
        bounds.append(np.stack([low, middle, high], axis=1))
        keys.append((key | below).astype(np.uint32))
        n += len(low)
        key, below = np.tile(key, 2), np.concatenate([2 * below, 2 * below + 1])
        low, high = np.concatenate([low, middle]), np.concatenate([middle, high])
    leaf, fork, right = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, bool))
    del steps
    by = np.argsort(leaf, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(leaf, minlength=len(weight)))]).astype(np.int64)
    bounds = np.concatenate(bounds) if bounds else np.empty((0, 3), np.int64)
    return Tree(starts, fork[by], right[by], bounds, np.concatenate([np.empty(0, np.uint32), *keys]))


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)


@dataclass
class Vocabulary:
    """What every worker knows of the words."""

    tokens: int  # N: tokens in training texts
    types: int  # V: distinct ones
    hot: dict[bytes, int]  # word -> its place in the next two
    hot_class: np.ndarray
    hot_count: np.ndarray
    ends: np.ndarray  # bucket of a word's end -> group
    classes: int
    class_weight: np.ndarray  # log10 of the denominator of P(word | class)
    unseen: np.ndarray  # for each group's class of other words, log10 of what an unseen one has
    end_weight: np.ndarray  # what all other words with an end have, the unseen one among them
    end_unseen: np.ndarray  # what the unseen ones have
    end_each: np.ndarray  # log10 of what each of them has
    class_tree: Tree
    word_tree: Tree  # leaves: the hot words, then the ends; no fork joins classes

    def places(self) -> dict[bytes, int]:
        """word -> place among the hot ones; for others -1 - (a hash of the word * ENDS + its end)."""

        class Places(dict):
            def __missing__(self, word: bytes) -> int:
                return -1 - (zlib.crc32(word) % OTHERS * ENDS + zlib.crc32(word[-3:]) % ENDS)

        return Places(self.hot)


def vocabulary(counts: DataFrame, hot: int = HOT, groups: int = GROUPS, tiers: int = TIERS) -> Vocabulary:
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # The groups beyond the largest count as the first: what the driver gathers is ENDS times `groups` rows at most.
    most = counts.groupBy("grp").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "grp").limit(groups).select("grp").collect()
    counts = counts.withColumn("grp", F.when(F.col("grp").isin([r["grp"] for r in most]), F.col("grp")).otherwise(most[0]["grp"] if most else None))
    by_end = counts.groupBy("end", "grp").agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once"), F.sum((F.col("n") == 2).cast("long")).alias("twice")).collect()
    weight = Counter()
    for r in by_end:
        weight[r["grp"]] += r["n"]
    names = {g: i for i, (g, _) in enumerate(sorted(weight.items(), key=lambda x: (-x[1], x[0]))[:groups])}
    n_groups = max(1, len(names))
    votes, total, once, twice = np.zeros((ENDS, n_groups)), np.zeros(ENDS), np.zeros(ENDS), np.zeros(ENDS)
    for r in by_end:
        votes[r["end"], names.get(r["grp"], 0)] += r["n"]
        total[r["end"]] += r["n"]
        once[r["end"]] += r["once"]
        twice[r["end"]] += r["twice"]
    ends = votes.argmax(axis=1)
    # The least count at which no more than `hot` words are left, from how many words there are of each count.
    of_count = counts.filter("n >= 2").groupBy("n").agg(F.count("*").alias("words"))
    below = F.sum("words").over(Window.orderBy(F.desc("n")))  # a row for each count that occurs, about the square root of all tokens at most
    least = of_count.withColumn("total", below).filter(F.col("total") <= hot).agg(F.min("n")).first()[0]
    top = counts.filter(F.col("n") >= least if least is not None else F.lit(False)).select("word", "n", "grp").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    words = top.column("word").to_pylist()
    n = top.column("n").to_numpy().astype(np.int64)
    groups_of = top.column("grp").to_pylist()
    grp = np.array([names.get(g, 0) for g in groups_of], dtype=np.int64)
    classes = n_groups * (tiers + 1) + 1
    of = np.zeros(len(words), dtype=np.int64)
    for g in range(n_groups):
        rows = np.flatnonzero(grp == g)
        before = np.cumsum(n[rows]) - n[rows]
        of[rows] = g * (tiers + 1) + np.minimum(before * tiers // max(1, n[rows].sum()), tiers - 1)
    # The end of a text is a class of its own, and known to all, hot or not.
    if END not in words:
        ended = counts.filter(F.col("word") == F.lit(END)).select("n").first()
        words, n, of = [*words, END], np.append(n, ended["n"] if ended else 0), np.append(of, 0)
    of[words.index(END)] = classes - 1
    known = {w: i for i, w in enumerate(words)}
    denominators = np.bincount(of, weights=n, minlength=classes).astype(float)
    for i, w in enumerate(words):
        total[word_end(w)] -= n[i]
    unseen = np.zeros(n_groups)
    for g in range(n_groups):
        # Words seen once are never hot, so all of them count here.
        part = once[ends == g].sum() + 1
        unseen[g] = np.log10(part)
        denominators[g * (tiers + 1) + tiers] = max(0.0, total[ends == g].sum()) + part
    end_unseen = once + 1 / np.bincount(ends, minlength=n_groups)[ends]
    end_weight = np.maximum(0.0, total) + end_unseen
    end_each = np.log10(end_unseen / np.maximum(1.0, once * (once - 1) / (2 * (twice + 1))))
    leaves = [np.flatnonzero(of == c) for c in range(classes)]
    for g in range(n_groups):
        leaves[g * (tiers + 1) + tiers] = len(words) + np.flatnonzero(ends == g)
    class_tree = tree_over([np.arange(classes)], np.bincount(of, weights=n, minlength=classes) + np.bincount(ends * (tiers + 1) + tiers, weights=end_weight, minlength=classes))
    word_tree = tree_over(leaves, np.concatenate([n, end_weight]), classes)
    return Vocabulary(int(tokens), int(types), known, of, n, ends, classes, np.log10(np.maximum(denominators, 1.0)), unseen, end_weight, end_unseen, end_each, class_tree, word_tree)


def context_of(n: np.ndarray, found: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Of all words of texts with so many words: classes, contexts (three classes before, packed)."""
    tiers = (v.classes - 1) // len(v.unseen)
    of = np.where(found >= 0, v.hot_class[np.maximum(found, 0)], v.ends[(-1 - found) % ENDS] * tiers + tiers - 1).astype(np.int64)
    base, pad = v.classes + 1, v.classes
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    context = np.zeros(len(of), dtype=np.int64)
    for back in (3, 2, 1):
        before = np.full(len(of), pad)
        before[back:] = of[:-back] if back < len(of) else of[:0]
        context = context * base + np.where(place >= back, before, pad)
    return of, context


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists of numbers, and all their numbers."""
    return np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy().astype(np.int64)


def parts_of(batches: Iterator[pa.RecordBatch], ids: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most that many numbers in the lists of a column, or one row."""
    for batch in batches:
        offsets = batch.column(ids).offsets.to_numpy()
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def split_rows(rows: DataFrame, shared) -> DataFrame:
    """(doc_id, held_out, n, known, base, ids, rare) from (doc_id, text, held_out): the words of each text by number, and
    what the base score needs: what the hot words among them give, and the others, each once, for the join with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        places = v.places()
        base_of, unseen, nothing = np.log10(v.hot_count + 1.0), v.end_each.tolist(), v.tokens == 0
        for batch in batches:
            for part in common.slices(batch, "text"):
                split = [words_of(t) for t in part.column(1).to_pylist()]
                n = np.array([len(w) for w in split], dtype=np.int64)
                found = np.fromiter(map(places.__getitem__, chain.from_iterable(split)), np.int32, n.sum())
                is_hot = found >= 0
                owner = np.repeat(np.arange(len(n)), n)
                known = np.bincount(owner, weights=is_hot, minlength=len(n)) * (not nothing)
                base = np.bincount(owner, weights=np.where(is_hot, base_of[np.maximum(found, 0)], 0.0), minlength=len(n)) * (not nothing)
                others, times, shares, starts = [], [], [], [0]
                for words, last in zip(split, np.cumsum(n), strict=True):
                    if not nothing:
                        rest = Counter(words[i] for i in np.flatnonzero(~is_hot[last - len(words) : last]).tolist())
                        others += rest
                        times += rest.values()
                        shares += [unseen[word_end(w)] for w in rest]
                    starts.append(len(others))
                rare = pa.StructArray.from_arrays([pa.array(others, pa.binary()), pa.array(times, pa.int32()), pa.array(shares, pa.float32())], names=["word", "times", "part"])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(found))
                columns = [part.column(0), part.column(2), pa.array(n), pa.array(known.astype(np.int64)), pa.array(base), ids, pa.ListArray.from_arrays(pa.array(starts, pa.int32()), rare)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n", "known", "base", "ids", "rare"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, n long, known long, base double, ids array<int>, rare array<struct<word:binary,times:int,part:float>>")


def features(contexts: np.ndarray, classes: int, hashed: int = HASHED) -> np.ndarray:
    """The hashed features of each context: [context, feature]."""
    base = classes + 1
    one, two, three = contexts % base, contexts // base % base, contexts // base**2
    told = np.stack([np.zeros_like(one), 1 + one, 1 + base + one * base + two, 1 + base + base**2 + two, 1 + 2 * base + base**2 + three], axis=1).astype(np.uint64)
    told = (told + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    told = (told ^ told >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (told >> np.uint64(32)).astype(np.int64) % hashed


def log_shares(contexts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """ln P(class | context): [context, class]."""
    x = weights[features(contexts, weights.shape[1], len(weights))].sum(axis=1)
    x -= x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def event_counts(learnt: DataFrame, shared) -> DataFrame:
    """(context, class, n) of all training texts (ids): bounded by the number of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for part in parts_of(batches, 0):
            of, context = context_of(*lists_of(part.column(0)), v)
            new, n = np.unique(context * v.classes + of, return_counts=True)
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([counts, n]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys // v.classes), pa.array((keys % v.classes).astype(np.int32)), pa.array(counts)], names=["context", "class", "n"])

    return learnt.mapInArrow(run, "context long, class int, n long").groupBy("context", "class").agg(F.sum("n").alias("n"))


def train(events: DataFrame, classes: int, hashed: int = HASHED, steps: int = STEPS, rate: float = RATE) -> np.ndarray:
    """The weights [feature, class]: in each step every task gives the gradient over its events, and the driver adds them up.

    A step is scaled for each weight by the counts that were seen and expected, so frequent and rare features move alike.
    """
    spark = events.sparkSession
    # The events are few whatever the corpus, and so are the tasks, each of which sends a gradient of all weights.
    events = events.coalesce(TASKS)
    weights = np.zeros((hashed, classes), dtype=np.float32)

    def summed(given: np.ndarray | None) -> np.ndarray:
        """The counts by feature and class: those seen, or those that weights lead to expect."""
        shared = spark.sparkContext.broadcast(given)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, total, met = shared.value, np.zeros((hashed, classes)), False
            for batch in batches:
                met = met or batch.num_rows > 0
                contexts, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                counts = np.zeros((len(contexts), classes))
                np.add.at(counts, (at, batch.column(1).to_numpy()), batch.column(2).to_numpy())
                if w is not None:
                    counts = counts.sum(axis=1, keepdims=True) * np.exp(log_shares(contexts, w))
                for k in features(contexts, classes, hashed).T:
                    np.add.at(total, k, counts)
            if met:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["sums"])

        out = np.zeros((hashed, classes))
        for r in events.mapInArrow(run, "sums binary").collect():
            out += np.frombuffer(bytes(r["sums"]), dtype=np.float32).reshape(hashed, classes)
        shared.destroy()
        return out

    seen = summed(None)
    for step in range(steps):
        expected = summed(weights)
        length = rate * 2 / FEATURES if step else 1.0
        weights = (weights + length * (seen - expected) / (0.5 * (seen + expected) + 1)).astype(np.float32)
    return weights


def trim() -> None:
    """Gives back to the system what earlier tasks of this worker have freed (the texts they split): all of an executor's workers share its memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # other C libraries have no such function
        ctypes.CDLL(None).malloc_trim(0)


def table(shape: int | tuple[int, ...], kind: type) -> np.ndarray:
    """Zeros in memory of their own, in large pages where the system has them: places in it are met at random. It goes back to the system as soon as nothing holds it."""
    n = int(np.prod(shape)) * np.dtype(kind).itemsize
    large = 1 << 21
    own = mmap.mmap(-1, n + large, **({"flags": mmap.MAP_PRIVATE | mmap.MAP_ANONYMOUS} if hasattr(mmap, "MAP_ANONYMOUS") else {}))
    if n >= large and hasattr(mmap, "MADV_HUGEPAGE"):
        try:
            own.madvise(mmap.MADV_HUGEPAGE)
        except OSError:  # a system without large pages
            pass
    out = np.frombuffer(own, np.uint8)
    first = -out.ctypes.data % large
    return out[first : first + n].view(kind).reshape(shape)


class Forks:
    """The forks of words in their contexts, and the weights of the features there."""

    def __init__(self, v: Vocabulary, model: np.ndarray, slots: np.ndarray):
        self.v, self.model, self.slots = v, model, slots
        self.shift = np.uint32(32 - (len(slots).bit_length() - 1))
        self.blank = not slots.any()
        if not self.blank:
            self.slots = table(slots.shape, np.float32)
            self.slots[:] = slots
        # The odds of classes in each context met so far: few contexts, as there are few classes.
        self.met = np.zeros((v.classes + 1) ** 3, dtype=bool)
        self.starts = table((len(self.met), len(v.class_tree.bounds)), np.float32)
        # Where a hot word's way through the trees starts: its class's way, then its own.
        place = np.concatenate([[0.0], np.cumsum(np.concatenate([v.hot_count, v.end_weight])[self.order()] + 1e-9)])
        a, m, b = v.word_tree.bounds.T
        start = (np.log(place[b] - place[m]) - np.log(place[m] - place[a])).astype(np.float32)

        def told(tree: Tree, odds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            out = table(len(tree.forks), np.uint64)
            both = out.view(np.uint32).reshape(-1, 2)  # of a little-endian machine, as Arrow's are
            for i in range(0, len(out), BLOCK):
                forks = tree.forks[i : i + BLOCK]
                both[i : i + BLOCK, 0] = (forks if odds is None else odds[forks]).view(np.uint32)
                both[i : i + BLOCK, 1] = tree.keys[forks] << np.uint32(1) | tree.right[i : i + BLOCK]
            return tree.starts.astype(np.int32), out

        # For either tree: where each leaf's way starts; of each fork on it, in one number, the key with the way as its last
        # bit, and what the odds start from (of classes: the fork, as they depend on the context).
        self.ways = told(v.class_tree, None), told(v.word_tree, start)

    def order(self) -> np.ndarray:
        tiers, hot = (self.v.classes - 1) // len(self.v.unseen), len(self.v.hot_class)
        leaf_class = np.concatenate([self.v.hot_class, self.v.ends * tiers + tiers - 1])
        assert len(leaf_class) == hot + ENDS
        return np.argsort(leaf_class, kind="stable")

    def class_start(self, contexts: np.ndarray) -> np.ndarray:
        """ln odds of the second part at each fork of the classes: [context, fork]."""
        a, m, b = self.v.class_tree.bounds.T
        out = np.empty((len(contexts), len(m)), dtype=np.float32)
        for start in range(0, len(contexts), HELD):
            shares = np.exp(log_shares(contexts[start : start + HELD], self.model))
            summed = np.concatenate([np.zeros((len(shares), 1)), np.cumsum(shares, axis=1)], axis=1)
            out[start : start + HELD] = np.log(np.maximum(summed[:, b] - summed[:, m], 1e-12)) - np.log(np.maximum(summed[:, m] - summed[:, a], 1e-12))
        return out

    def parts(self, n: np.ndarray, found: np.ndarray, of: np.ndarray, context: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """For parts of the words, and in each for either tree: which words; of each fork on their ways: the word's place among these, the way (1 to the second part), ln odds; its slots, an array for each feature."""
        v, hot = self.v, len(self.v.hot_class)
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        leaf = np.where(found >= 0, found, hot + (-1 - found) % ENDS)
        word = mixed(found.astype(np.uint64))
        back = []
        for k in (1, 2, 3):
            shifted = np.zeros(len(word), dtype=np.uint64)
            shifted[k:] = word[:-k] if k < len(word) else word[:0]
            back.append(np.where(place >= k, shifted, np.uint64(k)))
        with np.errstate(over="ignore"):
            told = [mixed(back[0]), mixed(back[0] * np.uint64(3) + mixed(back[1])), mixed(back[1] + np.uint64(5)), mixed(back[2] + np.uint64(7))]
        told = [(h >> np.uint64(32)).astype(np.uint32) for h in told]
        # Words with the same word before them follow each other, so that their slots are met together.
        # To sort numbers that end in their place is several times quicker than argsort.
        order = (np.sort(told[0].astype(np.uint64) << np.uint64(32) | np.arange(len(leaf), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.intp)
        told = [h[order] for h in told]
        of, leaf = of[order], leaf[order]
        if len(new := np.unique(context[~self.met[context]])):
            self.starts[new] = self.class_start(new)
            self.met[new] = True
        at = context[order] * self.starts.shape[1]
        for a in range(0, len(of), HELD):
            b = min(len(of), a + HELD)
            for (starts, forks), leaves in zip(self.ways, (of[a:b], leaf[a:b]), strict=True):
                first = starts[leaves]
                size = starts[leaves + 1] - first
                own = np.repeat(np.arange(b - a), size)
                # All places are within bounds. To clip them is quicker than to look whether one has to be refused, and to
                # take by place quicker than to repeat.
                way = np.arange(len(own), dtype=np.intp)
                way += (first - (np.cumsum(size, dtype=np.int32) - size)).take(own, mode="clip")
                both = forks.take(way, mode="clip").view(np.uint32).reshape(-1, 2)  # of a little-endian machine, as Arrow's are
                odds, key = both[:, 0].copy(), both[:, 1].copy()
                right = key & np.uint32(1)  # the slot of a fork must not tell the way
                below = key >> np.uint32(1) & np.uint32((1 << HIGH) - 1)
                key >>= np.uint32(HIGH + 1)
                x = self.starts.take(at[a:b].take(own, mode="clip") + odds.view(np.int32), mode="clip") if forks is self.ways[0][1] else odds.view(np.float32)
                slots = []
                for h in told:
                    slot = h[a:b].take(own, mode="clip")
                    slot ^= key
                    slot *= np.uint32(0x9E3779B1)
                    slot >>= self.shift
                    slot ^= below
                    slot = slot.astype(np.intp)
                    if not self.blank:  # all weights are 0 in the first pass
                        x += self.slots.take(slot, mode="clip")
                    slots.append(slot)
                yield order[a:b], own, right.astype(np.float32), x, slots

    def logs(self, n: np.ndarray, found: np.ndarray, of: np.ndarray, context: np.ndarray) -> np.ndarray:
        """ln of the share of each word, or for other words of their end."""
        out = np.zeros(len(of))
        for words, own, way, x, _ in self.parts(n, found, of, context):
            out[words] -= np.bincount(own, weights=np.log(1 + np.exp(x * (1 - 2 * way))), minlength=len(words))
        return out

    def add(self, sums: np.ndarray, n: np.ndarray, found: np.ndarray, of: np.ndarray, context: np.ndarray) -> Iterator[int]:
        """Adds to the sums of slots what was seen less what was expected in the upper half of a number, and the variance in
        the lower one, both in integers. How many words were added, again and again, so that the sums can be taken over."""
        for words, _, way, x, at in self.parts(n, found, of, context):
            p = 1 / (1 + np.exp(-x))
            both = np.empty((len(p), 2), dtype=np.int32)  # of a little-endian machine
            both[:, 0] = p * (1 - p) * PARTS + 0.5
            both[:, 1] = np.rint((way - p) * PARTS)
            both = both.view(np.int64).ravel()
            for slot in at:
                np.add.at(sums, slot, both)
            yield len(words)


def packed(x: np.ndarray) -> bytes:
    """Integers, mostly small, as compressed planes of bytes: their number, then those that are not all 0."""
    x = (x << 1 ^ x >> 63).view(np.uint64)
    planes = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([planes]) + pa.compress(x.reshape(-1, 1).view(np.uint8).T[:planes].tobytes(), "zstd", asbytes=True)


def unpacked(x: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, : x[0]] = np.frombuffer(pa.decompress(x[1:], n * x[0], "zstd", asbytes=True), np.uint8).reshape(x[0], n).T
    out = out.view(np.uint64).ravel()
    return (out >> np.uint64(1)).view(np.int64) ^ -(out & np.uint64(1)).view(np.int64)


def fit(learnt: DataFrame, shared, model, size: int, passes: int = PASSES) -> np.ndarray:
    """The weights of the words' features at forks, from all words of the training texts (ids)."""
    spark = learnt.sparkSession
    slots = np.zeros(size, dtype=np.float32)
    for _ in range(passes):
        given = spark.sparkContext.broadcast(slots)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            trim()
            v, forks = shared.value, Forks(shared.value, model.value, given.value)
            # Neither half of a sum can overflow: between two looks at them no half grows by more than NEAR. Few tasks have a
            # sum that comes near; only these hold both halves as numbers of their own.
            sums, taken, total = table(size, np.int64), 0, None

            def halves(start: int) -> np.ndarray:
                """Both sums of a block of slots."""
                own = sums[start : start + BLOCK]
                low = own & 0xFFFFFFFF
                out = np.stack([(own - low) >> 32, low])
                return out if total is None else out + total[:, start : start + BLOCK]

            for part in parts_of(batches, 0):
                n, found = lists_of(part.column(0))
                for words in forks.add(sums, n, found, *context_of(n, found, v)):
                    taken += words
                    if taken > SAFE:
                        taken = 0
                        if any(np.abs(own >> 32).max() >= NEAR or (own & 0xFFFFFFFF).max() >= NEAR for own in np.split(sums, range(BLOCK, size, BLOCK))):
                            total = table((2, size), np.int64) if total is None else total
                            for start in range(0, size, BLOCK):
                                total[:, start : start + BLOCK] = halves(start)
                            sums[:] = 0
            for start in range(0, size, BLOCK):
                own = halves(start)
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([start // BLOCK], pa.int32()), pa.array([packed(own)], pa.binary())], names=["block", "sums"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for block, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own = unpacked(told, 2 * min(size, BLOCK)).reshape(2, -1)
                    sums[block] = sums[block] + own if block in sums else own
            for block, (g, h) in sums.items():
                step = STRIDE * g / (h + DAMP * PARTS)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([step.astype(np.float32).tobytes()], pa.binary())], names=["block", "step"])

        found = learnt.mapInArrow(run, "block int, sums binary").repartition("block").mapInArrow(summed, "block int, step binary")
        slots = slots.copy()
        for r in found.toLocalIterator():
            own = slots[r["block"] * BLOCK : (r["block"] + 1) * BLOCK]
            own += np.frombuffer(bytes(r["step"]), dtype=np.float32)
            np.clip(own, -HIGHEST, HIGHEST, out=own)
        given.destroy()
    return slots


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", group: str | None = "lang", hot: int = HOT, steps: int = STEPS, size: int = SLOTS, passes: int = PASSES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row, learnt from the rows not held out.

    score is the log10 probability of the text over all known words and an estimated number of unseen ones in each bucket.
    """
    spark = docs.sparkSession
    grp = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("")) if group and group in docs.columns else F.lit("")
    own = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"), grp.alias("grp"), held_out(F.col(f"`{key}`").cast("long")).alias("held_out"))
    learnt = own.filter(~F.col("held_out"))
    counts = common.written(word_counts(learnt.select("text", "grp")), "words")
    v = vocabulary(counts, hot)
    shared = spark.sparkContext.broadcast(v)
    # Rows, not documents, are numbered: keys may repeat.
    runs = common.written(split_rows(own.select("doc_id", "text", "held_out"), shared).withColumn("row", F.monotonically_increasing_id()), "runs")
    # From here on words are numbers: what workers hold beside their sums is without the words themselves.
    shared.destroy()
    shared = spark.sparkContext.broadcast(replace(v, hot={}))
    ids = runs.filter(~F.col("held_out")).select("ids").coalesce(max(spark.sparkContext.defaultParallelism, v.tokens // WORDS))
    events = common.written(event_counts(ids, shared), "events")
    model = spark.sparkContext.broadcast(train(events, v.classes, steps=steps))
    slots = spark.sparkContext.broadcast(fit(ids, shared, model, size, passes))
    ten = 1 / np.log(10)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        v, forks = shared.value, Forks(shared.value, model.value, slots.value)
        ends_of = np.log10(v.end_weight)
        for part in parts_of(batches, 5):
            n, found = lists_of(part.column(5))
            logs = forks.logs(n, found, *context_of(n, found, v)) * ten
            logs -= np.where(found >= 0, 0.0, ends_of[(-1 - found) % ENDS])
            sums = np.bincount(np.repeat(np.arange(len(n)), n), weights=logs, minlength=len(n))
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sums), part.column(6)], names=["doc_id", "held_out", "n", "known", "base", "model", "row"])

    scored = runs.select("doc_id", "held_out", "n", "known", "base", "ids", "row").mapInArrow(run, "doc_id long, held_out boolean, n long, known long, base double, model double, row long")
    rare = runs.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times", "r.part")
    joined = rare.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    extra = joined.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(F.lit(0))).alias("k"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("b"),
        F.sum(F.col("times") * F.coalesce(F.log10(F.col("c").cast("double")), F.col("part").cast("double"))).alias("m"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.join(extra, "row", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + zero("k")).cast("long").alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("b") - F.col("n") * float(np.log10(v.tokens + v.types + 1))).alias("base_score"), (F.col("model") + zero("m")).alias("score"),
    )
