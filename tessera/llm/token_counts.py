"""Token counts by rank-synchronous array merging.

Pre-tokens that a worker has not met before are held as ragged numpy arrays (all symbols in one array, with the place
where each sequence starts). In a step every sequence applies its own lowest-rank pair, at all its places at once; the
sequences that have no pair left drop out. What survives is counted. Counts of pre-tokens met before are looked up.

Inputs: null and empty texts have 0 tokens; repeated rows are counted each; an empty table gives an empty one; only
doc_id and the text column are read, so further columns never clash. Long texts are handled whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common, pretoken

#: The split that a ByteLevel pre-tokenizer with use_regex makes: a fixed value of the format.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose counts a worker remembers.
MEMO = 400_000


def byte_chars() -> dict[int, str]:
    """The printable character by which a ByteLevel vocabulary names each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    """The merges of a tokenizer file as sorted arrays: pair of symbols -> rank and merged symbol."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], specials: list[str], odd: str):
        self.specials, self.odd = specials, odd
        self.first = np.array([vocab[c] for _, c in sorted(byte_chars().items())], dtype=np.int64)
        left, right, out = (np.array([vocab[x] for x in part], dtype=np.int64) for part in (*zip(*merges, strict=True), [a + b for a, b in merges]))
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.out = key[order], order.astype(np.int64), out[order]

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """How many symbols survive in each piece."""
        counts = np.zeros(len(pieces), dtype=np.int64)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        symbols = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        ids = np.flatnonzero(sizes)  # the pieces still in work
        owner = np.repeat(np.arange(len(ids)), sizes[ids])
        none = np.int64(len(self.keys))
        while len(ids):
            # A pair belongs to its left symbol; the last symbol of a sequence has none.
            pair = np.append(symbols[:-1] << 32 | symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where(np.append(owner[1:] == owner[:-1], False) & (self.keys[at] == pair), self.rank[at], none)
            lowest = np.minimum.reduceat(rank, np.flatnonzero(np.append(True, owner[1:] != owner[:-1])))
            done = lowest == none
            if done.any():
                counts[ids[done]] = np.bincount(owner, minlength=len(ids))[done]
                keep = ~done
                held = keep[owner]
                rank, at, symbols = rank[held], at[held], symbols[held]
                owner = (np.cumsum(keep) - 1)[owner[held]]
                ids, lowest = ids[keep], lowest[keep]
                if not len(ids):
                    break
            hit = rank == lowest[owner]
            # In a run of overlapping places (aaa) every second one counts, from the left.
            places = np.flatnonzero(hit)
            new = np.ones(len(places), dtype=bool)
            new[1:] = np.diff(places) > 1
            order = np.arange(len(places))
            since = order - np.maximum.accumulate(np.where(new, order, 0))
            places = places[since % 2 == 0]
            symbols[places] = self.out[at[places]]
            stay = np.ones(len(symbols), dtype=bool)
            stay[places + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        return counts


def load(path: str) -> Merges:
    """The tokenizer of a tokenizers .json file with a byte-level BPE model, read on the driver."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    library = Tokenizer.from_file(path)
    odd = pretoken.disagreed(lambda a, b: len(library.pre_tokenizer.pre_tokenize_str(a + b)) == 1)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in told["model"]["merges"]]
    return Merges(merges, told["model"]["vocab"], [t["content"] for t in told["added_tokens"]], odd)


class Counter:
    """Counts the tokens of texts, in one worker."""

    def __init__(self, merges: Merges, memo: int = MEMO, chunk: int = pretoken.CHUNK):
        self.merges, self.most, self.chunk = merges, memo, chunk
        self.known: dict[str, int] = {}
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.specials, key=len, reverse=True)))) if merges.specials else None

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and how many special tokens stand between them."""
        if self.special is None or not self.special.search(text):
            return pretoken.stitched(text, BYTE_LEVEL, self.merges.odd, self.chunk), 0
        parts = self.special.split(text)
        return [p for part in parts for p in pretoken.stitched(part, BYTE_LEVEL, self.merges.odd, self.chunk)], len(parts) - 1

    def counts(self, texts: list[str | None]) -> list[int]:
        split = [self.pieces(t or "") for t in texts]
        met = set().union(*(p for p, _ in split))
        new = [p for p in met if p not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, new = {}, list(met)
        if new:
            self.known.update(zip(new, self.merges.count([p.encode() for p in new]).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, p)) + n for p, n in split]


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens) of each row: one pass, no shuffle."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load(path))  # the size of the vocabulary file, whatever the corpus
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"), F.col(text).cast("string").alias("text"))

    def work():
        counter = Counter(shared.value)

        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            n = counter.counts(part.column(2).to_pylist())
            return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

        return each

    return common.mapped(rows, "text", "doc_id long, n_bytes long, n_tokens long", work)
