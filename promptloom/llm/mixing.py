"""Mixing sources to target weights: hash-random keys, ranges of keys, prefix sums, one exact cut per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import packed_rows, settled, text_only

#: `[^\x20\x09-\x0D]+`
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target out of (source, source_size), one row per source.

    Sources in code-point order, null last, weigh `weights` in turn and share `share` of all words. A target stops at
    `most` times its source's size; what is above goes to the others by weight, until no target is above. The fixed
    point has a closed form: a source is at its stop if target-per-weight at the stop, most * size / weight, is below
    the level; with sources in that order, the level is (total - stops so far) / (weights left), and the first source
    whose stop is not below it ends the stops. One window over sources, whose number is that of the vocabulary of
    `source`; no driver loop.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    stop = F.lit(float(most)) * F.col("source_size")
    rows = sizes.select("source", "source_size", weight.alias("weight")).withColumn("stop", stop).withColumn("stop_at", F.col("stop") / F.col("weight"))
    by_stop = Window.orderBy("stop_at", F.col("source").isNull(), "source")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    total = F.lit(float(share)) * F.sum("source_size").over(every)
    stopped = F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", (total - stopped) / left).withColumn("place", F.row_number().over(by_stop))
    # of the sources that do not reach their stop the first one; none: all are at their stops
    first_free = F.min(F.when(F.col("level") <= F.col("stop_at"), F.struct("place", "level"))).over(every)
    rows = rows.withColumn("first_free", first_free)
    target = F.least(F.col("stop"), F.coalesce(F.col("first_free.level") * F.col("weight"), F.col("stop")))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    documents: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 42,
    ranges: int = 1024,
    whole: bool = False,
) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, taken: words that the mix takes of each row.

    Documents of a source stand in the order of a hash of their id. A source's budget is its target in whole words:
    full epochs of all its documents, then its documents from the smallest key on until the budget is used up. The
    one at the cut gives just the words that are left; with `whole` it gives all if half of it fits, else nothing.

    Keys are uniform, so `ranges` equal ranges of them are equal parts of a source, however large it is. Sums per
    (source, range) combine before the shuffle; prefix sums over the at most `ranges` rows of a source give where a
    range begins, prefix sums inside a range give each document's place. Only narrow rows move; texts do not.

    Nulls: a null text has size 0 and null source is a source of its own, last in order. A row with a null doc_id is
    ordered by its text's hash. Repeated rows are taken one by one; which of equal rows is cut makes no difference.
    An empty table gives no rows.
    """
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text")), F.lit(seed))
    rows = text_only(documents, "doc_id", "text", "source").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("text").alias("text_hash"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        key.alias("key"),
    ).withColumn("range", F.least(F.lit(ranges - 1), F.floor((F.col("key") / F.lit(2.0**64) + F.lit(0.5)) * ranges).cast("int")))
    rows = settled(rows)
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.withColumn("begin", F.coalesce(F.sum("range_size").over(running), F.lit(0))).select("source", "range", "begin")
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    plan = begins.join(targets, begins["source"].eqNullSafe(targets["source"])).select(
        begins["source"].alias("__source"), begins["range"].alias("__range"), "begin", "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["__source"]) & (placed["range"] == plan["__range"]))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - F.col("epochs") * F.col("source_size") - F.col("begin") - F.col("inside")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    if whole:
        part = F.when(2 * part >= F.col("size"), F.col("size")).otherwise(0)
    return (
        joined.withColumn("epochs", epochs)
        .withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
        .select("doc_id", "text_hash", "source", "size", "source_size", "target", "taken")
    )


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 42) -> DataFrame:
    """`documents` as the mix takes them: a row for each epoch that takes it, whole. Rows with an empty text add
    nothing to a budget and stay once. Rows equal in id, source and text are taken alike, by the largest count."""
    taken = mix(documents, weights, share, most, seed, whole=True)
    times = F.max(F.when(F.col("size") == 0, 1).otherwise(F.col("taken") / F.col("size"))).cast("int").alias("times")
    taken = taken.groupBy("doc_id", "text_hash", "source").agg(times).where("times > 0")
    same = (
        F.col("row.doc_id").eqNullSafe(taken["doc_id"])
        & (F.xxhash64("row.text") == taken["text_hash"])
        & F.col("row.source").cast("string").eqNullSafe(taken["source"])
    )
    joined = packed_rows(documents).join(taken, same)
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("epoch")).select("row.*")
