"""Embedding as a table operator.

Default embedder: hashed bag of words. Each lower-cased
word goes to bucket ``int(md5(word)[:8], 16) % dim``; the vector holds the
integer counts (cosine is scale-free, so callers normalise at scoring time,
which keeps integer dot products exact). The dense vector is computed row by
row (no shuffle, no grouping); the sparse ``(id, bucket, count)`` form explodes
words and pre-aggregates per (id, bucket) map-side, so a huge text costs at
most ``dim`` rows per task.

``embed_with`` is the hook for a real model: ``mapInPandas`` calls the model
on batches of ``Params.embed_batch`` texts; a failed batch is kept with a NULL
vector and an error text (a quarantine the caller can count) instead of being
dropped silently.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import words
from lectern.params import DEFAULT, Params


def hash_bucket(token, dim: int):
    return (F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long") % dim).cast("int")


def hashed_counts(df: DataFrame, id_cols: list[str], text_col: str, dim: int = DEFAULT.embed_dim) -> DataFrame:
    """Sparse form: ``(*ids, bucket, count)`` for every non-empty bucket."""
    toks = df.select(*id_cols, F.explode(words(F.lower(F.col(text_col)))).alias("tok"))
    return toks.groupBy(*id_cols, hash_bucket(F.col("tok"), dim).alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def _counts_udf(dim: int):
    @F.arrow_udf("array<double>")
    def counts(tokens: pa.Array) -> pa.Array:
        # each distinct word of the Arrow batch is hashed once, then one np.bincount: row r, bucket j -> r * dim + j
        lens = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = pc.dictionary_encode(tokens.flatten().cast(pa.large_binary()))
        if isinstance(found, pa.ChunkedArray):
            found = found.combine_chunks()
        bucket = np.array([int.from_bytes(hashlib.md5(w, usedforsecurity=False).digest()[:4], "big") % dim
                           for w in found.dictionary.to_pylist()], np.int64)
        full = np.flatnonzero(lens)
        rows = np.repeat(np.arange(len(full)), lens[full])
        sums = np.bincount(rows * dim + bucket[found.indices.to_numpy(zero_copy_only=False)], minlength=len(full) * dim).astype(np.float64)
        ends = np.append(0, np.cumsum(np.where(lens > 0, dim, 0)))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sums), mask=pa.array(lens == 0))
    return counts


def hashed_embedding(df: DataFrame, id_cols: list[str], text_col: str, dim: int = DEFAULT.embed_dim,
                     out_col: str = "embedding") -> DataFrame:
    """Dense form: ``df`` plus ``array<double>`` of bucket counts (NULL for texts
    without words), row by row with no shuffle: texts are split JVM-side, and
    an Arrow batch of word lists is hashed and counted at once."""
    return df.withColumn(out_col, _counts_udf(dim)(words(F.lower(F.col(text_col)))))


def embed_with(df: DataFrame, text_col: str, model: Callable[[list[str]], list[list[float]]],
               params: Params = DEFAULT, out_col: str = "embedding") -> DataFrame:
    """U2 hook: call ``model`` on batches of texts inside executors (Arrow batches)."""
    size = params.embed_batch
    schema = T.StructType(list(df.schema.fields) + [
        T.StructField(out_col, T.ArrayType(T.DoubleType()), True),
        T.StructField("embed_error", T.StringType(), True)])

    def run(it):
        for pdf in it:
            vecs, errs = [], []
            texts = pdf[text_col].fillna("").tolist()
            for lo in range(0, len(texts), size):
                part = texts[lo:lo + size]
                try:
                    out = model(part)
                    vecs += [list(map(float, v)) for v in out]
                    errs += [None] * len(part)
                except Exception as e:  # noqa: BLE001 - quarantined per batch
                    vecs += [None] * len(part)
                    errs += [f"{type(e).__name__}: {e}"] * len(part)
            yield pdf.assign(**{out_col: pd.Series(vecs, dtype=object), "embed_error": errs})

    return df.mapInPandas(run, schema)
