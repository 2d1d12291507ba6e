"""What both vector operators take from a table of embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def keyed(df: DataFrame, *columns: Column) -> DataFrame:
    """`df` with k1 and k2, a 128-bit hash of the columns: equal vectors meet under it without being moved."""
    return df.withColumn("k1", F.xxhash64(*columns)).withColumn("k2", F.xxhash64(F.lit(1), *columns))
