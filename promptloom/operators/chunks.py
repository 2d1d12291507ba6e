"""Running totals over long histories of few keys: rows in chunks of bounded size, totals carried from chunk to chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join that pairs null keys with null keys; the columns of ``left`` and what ``right`` adds."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(renamed[f"__{c}"])
    return left.join(renamed, same, how).drop(*[f"__{c}" for c in on])


def with_chunks(rows: DataFrame, key: list[str], order: tuple[str, str], seconds: int, most: int) -> DataFrame:
    """Rows with ``_chunk``, ascending with ``order`` (a time and a number): an interval of ``seconds``, cut where one
    key has more than ``most`` rows in it. The cuts are rows: about every ``most``-th one in order, found from a sample
    by hash, so that a burst is cut as well as a steady flow. Only crowded intervals are sampled and joined; without
    any, nothing is."""
    at, number = order
    span = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / F.lit(seconds * 1_000_000))
    place = F.struct(at, number)
    placed = rows.withColumn("_span", span)
    crowded = placed.groupBy(*key, "_span").agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most).drop("_rows")
    rate = max(1, most // 64)
    sampled = placed.select(*key, "_span", at, number).where(F.pmod(F.xxhash64(at, number), F.lit(rate)) == 0)
    in_order = F.sort_array(F.collect_list(place))
    cuts = join_null_safe(sampled, crowded, [*key, "_span"]).groupBy(*key, "_span").agg(
        F.filter(in_order, lambda _, i: (i > 0) & (i % F.lit(-(-most // rate)) == 0)).alias("_cuts")
    )
    sized = join_null_safe(placed, cuts, [*key, "_span"], "left")
    part = F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda cut: cut <= place)))
    return sized.withColumn("_chunk", F.struct(F.col("_span"), part.alias("_part"))).drop("_span", "_cuts")


def running_totals(
    rows: DataFrame, key: list[str], order: tuple[str, str], sums: list[str], seconds: int = 86_400, most: int = 100_000
) -> DataFrame:
    """Adds ``running_<c>`` for each of ``sums``: its total over the key's rows up to this one, in order. A window holds
    a chunk at most; across chunks only their totals are added up, one row for each."""
    placed = with_chunks(rows, key, order, seconds, most)
    inside = Window.partitionBy(*key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"_in_{c}": F.sum(c).over(inside) for c in sums})
    totals = placed.groupBy(*key, "_chunk").agg(*[F.sum(c).alias(f"_all_{c}") for c in sums])
    carried = totals.select(*key, "_chunk", *[F.coalesce(F.sum(f"_all_{c}").over(earlier), F.lit(0)).alias(f"_before_{c}") for c in sums])
    joined = join_null_safe(local, carried, [*key, "_chunk"])
    added = {f"running_{c}": F.coalesce(f"_in_{c}", F.lit(0)) + F.col(f"_before_{c}") for c in sums}
    return joined.withColumns(added).drop("_chunk", *[f"_{k}_{c}" for k in ("in", "before") for c in sums])
