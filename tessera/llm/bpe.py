"""Byte-level BPE encoding and decoding by overlapping chunk encoding.

A text is cut into chunks that overlap; the chunks are pre-tokenised in parallel, each on its own, and stitched where both
sides start a pre-token at the same place, and the pre-tokens are then encoded by merging pairs in the order of their ranks. Decoding concatenates the raw
bytes of the ids.

Inputs: null and empty texts have no ids; repeated rows are encoded each; an empty table gives an empty one; only the
key and the text column are read, so further columns never clash. Long texts are handled whole. Ids that the vocabulary
lacks make decode() fail with a KeyError.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.llm import common, pretoken

#: Pre-tokens whose ids a worker remembers; threads that pre-tokenise the chunks of a text.
MEMO, THREADS = 300_000, 2


class Ranks:
    """A rank file, read on the driver; its pattern; the code points on which the library's pattern differs."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}
        self.pattern = pattern
        # A vocabulary in which "a" or "1" merges with any byte shows whether the library keeps two characters together.
        probe = {bytes([b]): b for b in range(256)} | {a + bytes([b]): 256 + 256 * k + b for k, a in enumerate((b"a", b"1")) for b in range(0x80, 256)}
        library = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=probe, special_tokens={})
        self.odd = pretoken.disagreed(lambda a, b: library.encode_ordinary(a + b)[0] > 255)


class Coder:
    """Encodes and decodes in one worker."""

    def __init__(self, ranks: Ranks, memo: int = MEMO, chunk: int = pretoken.CHUNK, threads: int = THREADS):
        import tiktoken

        self.told, self.most, self.chunk, self.threads = ranks, memo, chunk, threads
        # Its pattern takes whatever it is given as one piece, so it merges the pre-tokens that were found here.
        self.library = tiktoken.Encoding("ranks", pat_str="(?s:.+)", mergeable_ranks=ranks.ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.said: dict[str, str] = {}

    def _learn(self, pieces: list[str]) -> None:
        new = [p for p in set(pieces) if p not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known, self.said, new = {}, {}, list(set(pieces))
        single = self.library.encode_ordinary
        for p in new:
            ids = single(p)
            self.known[p] = tuple(ids)
            self.said[p] = ",".join(map(str, ids))

    def encode(self, text: str | None) -> list[int]:
        pieces = pretoken.stitched(text or "", self.told.pattern, self.told.odd, self.chunk, threads=self.threads)
        self._learn(pieces)
        return list(chain.from_iterable(map(self.known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """How many ids, the digest of the ids in decimal with commas, and that of the bytes which the ids decode to."""
        pieces = pretoken.stitched(text or "", self.told.pattern, self.told.odd, self.chunk, threads=self.threads)
        self._learn(pieces)
        ids = list(chain.from_iterable(map(self.known.__getitem__, pieces)))
        said = ",".join(map(self.said.__getitem__, pieces))
        return len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def _shared(docs: DataFrame, path: str, pattern: str):
    return docs.sparkSession.sparkContext.broadcast(Ranks(path, pattern))  # the size of the rank file, whatever the corpus


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = (), digest: bool = False) -> DataFrame:
    """(key, ids array<int>) and the columns in `keep`, of each row; with `digest`, decoded_sha256 too, of the bytes that the ids decode to."""
    shared = _shared(docs, path, pattern)
    # Columns that are kept travel in a struct, so that no name clashes.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in (key, *keep))).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = rows.select("row").schema.add("ids", ArrayType(IntegerType()))
    if digest:
        schema = schema.add("decoded_sha256", "string")

    def work():
        coder = Coder(shared.value)

        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            ids = [coder.encode(t) for t in part.column(1).to_pylist()]
            columns = [pa.array(ids, pa.list_(pa.int32()))]
            if digest:
                columns.append(pa.array([hashlib.sha256(coder.decode(x)).hexdigest() for x in ids], pa.string()))
            return pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)

        return each

    return common.mapped(rows, "text", schema, work).select("row.*", *schema.names[1:])


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, bytes) of each row of ids; null ids decode to no bytes."""
    shared = _shared(rows, path, pattern)

    def run(batches):
        coder = Coder(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], names=[key, "bytes"])

    found = rows.select(F.col(f"`{key}`"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    return found.mapInArrow(run, rows.select(F.col(f"`{key}`")).schema.add("bytes", "binary"))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text, decodes its ids, and keeps digests of both. One pass, no shuffle."""
    shared = _shared(docs, path, pattern)
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def work():
        coder = Coder(shared.value)

        def each(part: pa.RecordBatch) -> pa.RecordBatch:
            found = [coder.digests(t) for t in part.column(1).to_pylist()]
            n, ids, back = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    return common.mapped(rows, "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", work)
