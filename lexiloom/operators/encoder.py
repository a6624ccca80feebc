"""The encoder seam: text to vectors. Neural encoders plug in here; the built-in one hashes words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V

PROMPTS = ("query", "document", "passage")


@dataclass
class Encoder:
    """`encode(texts) -> rows of floats`, with prefixes by prompt type; the callable is loaded once a worker batch."""

    encode: Callable[[list[str]], np.ndarray]
    prefixes: dict[str, str] = field(default_factory=dict)
    max_tokens: int = 512
    normalize: bool = True

    def apply(self, df: DataFrame, column: str, prompt: str = "document", out: str = "embedding") -> DataFrame:
        """All columns of `df` and `out`, array<float>. Text is cut, then prefixed; only `column` travels to Python."""
        if prompt not in PROMPTS:
            raise ValueError(f"unknown prompt type {prompt!r}")
        encode, normalize = self.encode, self.normalize

        @F.pandas_udf("array<float>")
        def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                x = np.asarray(encode(texts.tolist()), dtype=np.float32)
                if normalize and len(x):
                    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                yield pd.Series(list(x))

        text = F.concat(F.lit(self.prefixes.get(prompt, "")), T.truncate_chars(T.fix_empty(F.col(column)), self.max_tokens))
        return df.withColumn(out, vectors(text))


def hashing_embedding(text: Column, dim: int, max_tokens: int = 512) -> Column:
    """Deterministic bag-of-words vector: word ids modulo `dim`, signed by the next bit, unit length; JVM only."""
    ids = T.token_ids(text, 1 << 30, max_tokens)
    signed = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.aggregate(ids, F.lit(0.0), lambda s, i: s + F.when(i % dim == j, F.when(F.floor(i / dim) % 2 == 0, 1.0).otherwise(-1.0)).otherwise(0.0)))
    return V.normalize(signed)


def gramian_svd(vectors: DataFrame, column: str, rank: int) -> tuple[np.ndarray, DataFrame]:
    """Truncated SVD by the Gramian: partial d x d sums on the executors, eigenvectors on the driver (d is the vector size).

    Returns the projection (d x rank) and `vectors` with column `reduced`, projected and of unit length.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            x = np.stack(b["v"].to_numpy()).astype(float) if len(b) else None
            if x is not None:
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pd.DataFrame({"g": [total.ravel()], "d": [len(total)]})

    parts = vectors.select(F.col(column).alias("v")).mapInPandas(partial, "g array<double>, d int")
    summed = parts.select(F.posexplode("g").alias("j", "x")).groupBy("j").agg(F.sum("x").alias("x")).orderBy("j").collect()  # d x d numbers
    d = int(np.sqrt(len(summed)))
    value, vector = np.linalg.eigh(np.array([r["x"] for r in summed]).reshape(d, d))
    basis = vector[:, np.argsort(-value)[:rank]]
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])])

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float) @ basis
        return pd.Series(list(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)))

    return basis, vectors.withColumn("reduced", project(F.col(column)))


def embed_with_cache(cache, encoder: Encoder, df: DataFrame, idx: str, column: str, *, model: str, dataset: str, prompt: str = "document") -> DataFrame:
    """(idx, embedding) of one column, stored under the model, dataset, column, prompt and length that made it."""
    rows = df.select(idx, column)
    arguments = {"model": model, "dataset": dataset, "column": column, "prompt": prompt, "max_tokens": encoder.max_tokens}
    return cache.get("embeddings", lambda: encoder.apply(rows, column, prompt).select(idx, "embedding"), **arguments)
