"""Pluggable models: anything with these methods will do; the defaults are deterministic and need no weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Embedder(Protocol):
    def column(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def column(self, query: Column, text: Column) -> Column: ...


class Llm(Protocol):
    def column(self, prompt: Column) -> Column: ...


class HashingEmbedder:
    """Token counts by hash of the token, of length 1."""

    def __init__(self, dims: int = 256):
        self.dims = dims

    def column(self, text: Column) -> Column:
        from tessera.functions import text as functions

        counts = F.transform(functions.tokens(text), lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % self.dims)

        @F.pandas_udf("array<float>")
        def spread(buckets: pd.Series) -> pd.Series:
            def one(b) -> np.ndarray:
                v = np.bincount(np.asarray(b, dtype=np.int64), minlength=self.dims).astype(np.float64)
                n = np.linalg.norm(v)
                return (v / n if n else v).astype(np.float32)

            return buckets.map(one)

        return spread(counts)


class Loaded:
    """A model that each worker loads once: load() gives a function from a list of inputs to a list of outputs."""

    def __init__(self, load: Callable[[], Callable[[list], list]], kind: str):
        self.load, self.kind = load, kind

    def column(self, *inputs: Column) -> Column:
        load = self.load

        @F.pandas_udf(self.kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for values in batches:
                yield pd.Series(model(values.tolist()))

        return run(inputs[0] if len(inputs) == 1 else F.to_json(F.struct(*(c.alias(f"i{i}") for i, c in enumerate(inputs)))))
