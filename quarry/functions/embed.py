"""Embedding functions.

The default embedder needs no model: a hashed bag of words. Tokens are
maximal runs of letters/digits of the lower-cased text; each token goes to
bucket ``int(md5(token)[:h], 16)`` with ``dim = 16**h``; the vector is the
bucket counts divided by their L2 norm, stored as ``array<float>``.

Tokenising and hashing stay JVM-side (one ``transform`` per text); only the
count-to-dense step runs in Python, vectorised over an Arrow batch.

A real model plugs in through :func:`model_embedder`, an iterator
``pandas_udf`` that loads the model once per task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf, pandas_udf

from quarry import constants as K

TOKEN_RE = r"[\p{L}\p{N}]+"
#: Texts counted at once, so that memory does not follow the Arrow batch.
SLICE_TEXTS = 2048


def hex_digits(dim: int) -> int:
    h = round(math.log(dim, 16))
    if 16 ** h != dim or h < 1:
        raise ValueError("embedding width must be a power of 16")
    return h


def token_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_RE), 0)


def _bucket_of(dim: int):
    """md5-prefix bucket of one token (cached per worker; vocabularies repeat)."""
    h = hex_digits(dim)
    cache: dict[str, int] = {}

    def bucket(tok: str) -> int:
        b = cache.get(tok)
        if b is None:
            b = int(hashlib.md5(tok.encode("utf-8")).hexdigest()[:h], 16)
            if len(cache) < 2_000_000:
                cache[tok] = b
        return b

    return bucket


def _densify(dim: int):
    @arrow_udf("array<float>")
    def densify(tokens: pa.Array) -> pa.Array:
        bucket = _bucket_of(dim)
        parts = [dense(tokens.slice(lo, SLICE_TEXTS), bucket) for lo in range(0, len(tokens), SLICE_TEXTS)]
        vecs = np.concatenate(parts) if parts else np.empty((0, dim), np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * dim), pa.array(vecs.ravel()))

    def dense(tokens: pa.Array, bucket: Callable[[str], int]) -> np.ndarray:
        n = len(tokens)
        lens = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        numbered = tokens.flatten().dictionary_encode()  # each distinct token is hashed once
        ub = np.fromiter(map(bucket, numbered.dictionary.to_pylist()), np.int64, len(numbered.dictionary))
        rows = np.repeat(np.arange(n), lens)
        counts = np.bincount(rows * dim + ub[numbered.indices.to_numpy()], minlength=n * dim)
        counts = counts.reshape(n, dim).astype(np.float64)
        norm = np.sqrt((counts * counts).sum(axis=1))
        norm[norm == 0] = 1.0
        return (counts / norm[:, None]).astype(np.float32)

    return densify


_DENSIFY = {}


def hashed_embedding(text: Column, dim: int = K.EMBED_DIM) -> Column:
    """L2-normalised hashed bag-of-words vector of ``text``.

    Tokens come from the JVM regex; buckets are computed once per distinct
    token of an Arrow batch, which Arrow numbers, and counted with ``bincount``.
    """
    if dim not in _DENSIFY:
        _DENSIFY[dim] = _densify(dim)
    return _DENSIFY[dim](token_list(text))


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]]):
    """Wrap a model loader as an iterator pandas UDF ``text -> array<float>``.

    ``load()`` runs once per task; the returned callable embeds a list of
    texts. A failing call raises, failing the task (Spark retries it).
    """

    @pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            vecs = model(texts.tolist())
            if len(vecs) != len(texts) or any(v is None for v in vecs):
                raise RuntimeError("embedding model returned no vector for some input")
            yield pd.Series([np.asarray(v, dtype=np.float32) for v in vecs])

    return embed
