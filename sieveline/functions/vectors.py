"""Vector expressions in the JVM: doubles, summed in index order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null where one of the vectors is all zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it within ``body``: lambdas would evaluate it per element."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """Unit length in doubles; an all-zero vector stays as it is."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def mean_vector(vectors: Column, width: int) -> Column:
    """Mean of an array of vectors in its order, never renormalised."""
    n = F.size(vectors)
    zero = F.array_repeat(F.lit(0.0), width)
    return F.transform(F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double"))), lambda x: x / n)


def _hasher(dimensions: int):
    """A function from text to its bag of words in hash buckets; words seen before are looked up."""
    from hashlib import sha256

    known: dict[str, tuple[int, float]] = {}

    def embed(t: str) -> np.ndarray:
        v = np.zeros(dimensions)
        for w in t.lower().split():
            at = known.get(w)
            if at is None:
                h = sha256(w.encode()).digest()
                at = int.from_bytes(h[:4], "big") % dimensions, 1.0 if h[4] % 2 == 0 else -1.0
                if len(known) < 1 << 18:
                    known[w] = at
            v[at[0]] += at[1]
        n = float(np.sqrt((v * v).sum()))
        return v / n if n else v

    return embed


def hash_embedding(text: Column, dimensions: int) -> Column:
    """Bag of words in hash buckets: +-1 at SHA-256(word) mod ``dimensions``, by the parity of its fifth byte; unit length.

    Arrow batches in Python: the JVM has no way to add up by bucket within a row in one pass.  Null texts give null,
    texts without words the zero vector.
    """

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _hasher(dimensions)
        for texts in batches:
            yield pd.Series([None if t is None else one(t) for t in texts])

    return embed(text)


def mean_embedding(texts: Column, dimensions: int) -> Column:
    """Mean of the hash embeddings of an array of texts, in its order; null for null and empty arrays."""

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = _hasher(dimensions)
        for lists in batches:
            out = []
            for ts in lists:
                total = np.zeros(dimensions)
                for t in ts if ts is not None else ():
                    total = total + one(t)
                out.append(total / len(ts) if ts is not None and len(ts) else None)
            yield pd.Series(out)

    return embed(texts)


def int8(a: Column) -> Column:
    """(scale, q): values rounded half up to -127..127 at scale = greatest magnitude / 127, or 1."""
    top = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return let(scale, lambda k: F.struct(k.alias("scale"), F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(x.cast("double") / k + 0.5).cast("int")))).alias("q")))


def from_int8(e: Column) -> Column:
    return F.transform(e["q"], lambda q: q * e["scale"])
