"""Sizes of texts in tokens of a public tokenizer, and a hashed, projected vector of each text."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rank file of a byte-level BPE vocabulary (one base64 token and its rank a line); a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed pattern: how text is split before the merges of the rank files.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Dimensions a text's vector is projected to, and the hashed dimensions it comes from.
DIMENSIONS, HASHED = 4, 4096
_SEED = 1729


@lru_cache(maxsize=2)
def encoding(ranks: bytes):
    """The tokenizer, built once a Python process."""
    import tiktoken

    merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("lectern", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})


@lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    return np.random.default_rng(_SEED).choice([-1.0, 1.0], size=(HASHED, DIMENSIONS))


def project(ids: np.ndarray) -> np.ndarray:
    """The hashed vector of distinct token ids on random directions, scaled to unit variance."""
    if not len(ids):
        return np.zeros(DIMENSIONS)
    cells = np.unique(ids) * 2654435761 % HASHED
    return _directions()[cells].sum(0) / np.sqrt(len(cells))


def _measure(ranks, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks.value).encode_ordinary
        for b in batches:
            sizes, vectors = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, DIMENSIONS))
            for i, t in enumerate(b.column(text).to_pylist()):
                ids = np.asarray(encode(t), np.int64)
                sizes[i], vectors[i] = len(ids), project(ids)
            arrays = [b.column(c) for c in keep] + [pa.array(sizes), *[pa.array(vectors[:, i].astype(np.float32)) for i in range(DIMENSIONS)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "n_tokens", *[f"v{i}" for i in range(DIMENSIONS)]])

    return run


def measured(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``keep`` with ``n_tokens`` of the whole text and its projected vector ``v0..``; rows without text are dropped."""
    spark: SparkSession = df.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    kept = df.select(*keep, df[text].alias("__text")).dropna(subset=["__text"])
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(_measure(ranks, keep, "__text"), f"{types}, n_tokens long, " + ", ".join(f"v{i} float" for i in range(DIMENSIONS)))
