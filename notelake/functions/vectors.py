"""Vector expressions in double precision, JVM-side."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null for vectors of length zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.lit(1.0) - F.when(norm > 0, dot(a, b) / norm)


def from_blob(blob: Column) -> Column:
    """Little-endian float32 bytes as array<float> (through Arrow, as there is no JVM decoder)."""
    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        import numpy as np

        return blobs.map(lambda b: None if b is None else np.frombuffer(bytes(b), "<f4").astype("float32"))

    return decode(blob)
