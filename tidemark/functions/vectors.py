"""Vector arithmetic as Column expressions, for places where a row holds few vectors."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0.0 when either vector is all zeros."""
    return let(
        norm(a) * norm(b), lambda size: F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))
    )


def hashed_terms(terms: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: term counts in `dims` hash buckets."""

    @F.arrow_udf("array<float>")
    def counted(held: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy()
        words = held.flatten().dictionary_encode()
        bucket = np.array([int.from_bytes(md5(w.encode()).digest()[:4]) % dims for w in words.dictionary.to_pylist()], dtype=np.int64)
        cells = np.repeat(np.arange(len(held)) * dims, sizes) + bucket[words.indices.to_numpy()]
        counts = np.bincount(cells, minlength=len(held) * dims).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * dims, pa.int32()), pa.array(counts))

    return counted(terms)


def cosines(a: Column, b: Column) -> Column:
    """Cosine similarity of vectors of one model, many rows at once; null when either is missing or all zeros."""

    @F.arrow_udf("double")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        both = pc.and_(left.is_valid(), right.is_valid())
        out = np.full(len(left), np.nan)
        x, y = left.filter(both), right.filter(both)
        if len(x):
            sizes = np.unique(np.r_[pc.list_value_length(x).to_numpy(), pc.list_value_length(y).to_numpy()])
            if len(sizes) > 1:
                raise ValueError("vectors of one model must have one length")
            x, y = (v.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(v), -1) for v in (x, y))
            length = lambda v: np.sqrt(np.einsum("ij,ij->i", v, v))
            scale = length(x) * length(y)
            out[both.to_numpy(zero_copy_only=False)] = np.divide(np.einsum("ij,ij->i", x, y), scale, out=np.full(len(x), np.nan), where=scale > 0)
        return pa.array(out, mask=np.isnan(out))

    return similar(a, b)
