"""Vector expressions; sums run in double whatever the stored type."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from daftar.functions.text import tokenize


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """``v`` at length 1; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A unit vector of a text's words: each adds one, with the sign and at the place that its hash tells. The default embedder; zeros without words, null for a null text."""

    @F.pandas_udf("array<double>")
    def spread(hashes: pd.Series) -> pd.Series:
        def one(h):
            if h is None:
                return None
            h = np.asarray(h, np.int64)
            v = np.bincount(h % size, np.where(h & (1 << 40), 1.0, -1.0), size)
            return v / max(np.sqrt((v * v).sum()), 1e-300)

        return hashes.map(one)

    return spread(F.transform(tokenize(text), lambda w: F.xxhash64(w)))
