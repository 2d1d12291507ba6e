"""Approximate nearest neighbours on several shifted Hilbert orderings of projected vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import partitions, settled, whole_groups
from promptloom.llm.vectors import keyed, usable


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `cells` (n, m), integers below 2^bits; m * bits at most 63.
    Gray-code walk from the highest bit down, as in Skilling's "Programming the Hilbert curve" (2004)."""
    x = cells.astype(np.uint64).T.copy()
    m = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(m):
            flip = (x[i] & q) != 0
            swap = np.where(flip, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, m):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[m - 1] & (one << np.uint64(level)), (one << np.uint64(level)) - one, np.uint64(0))
    x ^= turn
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << one) | ((x[i] >> np.uint64(level)) & one)
    return key.astype(np.int64)


class Ordering:
    """One random projection to a few axes, its grid and its shift."""

    def __init__(self, number: int, dims: int, axes: int, bits: int, seed: int):
        rng = np.random.Generator(np.random.PCG64([seed, number]))
        basis = np.linalg.qr(rng.standard_normal((dims, min(axes, dims))))[0]
        self.basis, self.bits = basis, bits
        self.shift = rng.random(basis.shape[1])

    def keys(self, unit: np.ndarray, spread: float, centre: np.ndarray) -> np.ndarray:
        """The grid spans three standard deviations to both sides, shifted by part of a cell of the coarsest level."""
        low = (unit - centre) @ self.basis / spread
        cells = np.floor((low / 6 + 0.5 + (self.shift - 0.5) * 0.25) * (1 << self.bits))
        return hilbert_keys(np.clip(cells, 0, (1 << self.bits) - 1), self.bits)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total, square = 0, None, 0.0
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column(0))
            n, total, square = n + len(x), x.sum(axis=0) + (0 if total is None else total), square + float((x * x).sum())
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([square])], ["n", "total", "square"])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _curve_keys(orderings: int, dims: int, axes: int, bits: int, seed: int, centre: np.ndarray, spread: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves = [Ordering(i, dims, axes, bits, seed) for i in range(orderings)]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            keys = np.concatenate([c.keys(x, spread, centre) for c in curves])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(orderings, dtype=np.int32), len(x))), pa.array(keys), pa.array(np.tile(batch.column(0).to_numpy(), orderings))],
                ["ordering", "key", "rep"],
            )

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place among its task's rows of the ordering."""
    from pyspark import TaskContext

    seen: dict[int, int] = {}
    task = TaskContext.get().partitionId()
    for batch in batches:
        if not batch.num_rows:
            continue
        ordering = batch.column(0).to_numpy()
        place = np.empty(len(ordering), np.int64)
        for o in np.unique(ordering):
            own = np.flatnonzero(ordering == o)
            place[own] = np.arange(len(own)) + seen.get(int(o), 0)
            seen[int(o)] = seen.get(int(o), 0) + len(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.full(len(ordering), task, np.int32)), pa.array(place), batch.column(2)], ["ordering", "task", "place", "rep"]
        )


def _nearest(k: int):
    """Rerank inside a block: the k nearest of its vectors for each query that reaches it, by the true distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["ordering", "block"], rows=1 << 13):
            ordering, block, side, rep, first = (table.column(c).to_numpy() for c in ("ordering", "block", "side", "rep", "first"))
            x = matrix(table.column("vector").combine_chunks())
            cuts = np.flatnonzero((ordering[1:] != ordering[:-1]) | (block[1:] != block[:-1])) + 1
            for part in np.split(np.arange(len(rep)), cuts):
                q, c = part[side[part] == 1], part[side[part] == 0]
                if not len(q) or not len(c):
                    continue
                near = x[c] - x[c].mean(axis=0)  # about the block's centre, squares lose least
                squares = (near**2).sum(axis=1)
                for at in range(0, len(q), 256):
                    own = q[at : at + 256]
                    asked = x[own] - x[c].mean(axis=0)
                    rough = squares - 2 * asked @ near.T  # without the query's own square: the order is the same
                    few = min(len(c), k)
                    # all that may be as near as the k-th, whatever rounding did; ties are broken by exact distance and id
                    slack = 1e-12 * (squares.max() + (asked**2).sum(axis=1)) * x.shape[1]
                    i, j = np.nonzero(rough <= (np.partition(rough, few - 1, axis=1)[:, few - 1] + slack)[:, None])
                    gaps = np.sqrt(((x[c][j] - x[own][i]) ** 2).sum(axis=1))
                    order = np.lexsort((first[c][j], gaps, i))
                    i, j, gaps = i[order], j[order], gaps[order]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j, gaps = i[rank < k], j[rank < k], gaps[rank < k]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rep[own][i]), pa.array(rep[c][j]), pa.array(first[c][j]), pa.array(gaps)], ["query", "rep", "first", "score"]
                    )

    return run


def search(
    embeddings: DataFrame,
    every: int = 100,
    k: int = 10,
    orderings: int = 16,
    reach: float = 0.04,
    axes: int = 8,
    bits: int = 5,
    block_rows: int = 1024,
    seed: int = 42,
) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` nearest found of each row whose vec_id is divisible by `every`.

    Each of `orderings` random projections to `axes` axes with a shifted grid puts all vectors in the order of a
    Hilbert curve. Orders are range-partitioned by (ordering, key); places are the task's own counts plus the rows of
    the tasks before, so a vector's block of `block_rows` places is exact. A query goes to its own block and those
    that lie within `reach` of all vectors on both sides; each block ranks its vectors by the true distance in double
    precision, and the best of all blocks are merged. A task holds one block and the queries that reach it.

    `reach` is a share, because vectors without structure (the test data: 64 nearly independent axes) have their
    neighbours anywhere along a curve; clustered data do with far less. With the defaults recall on the test tables
    is above 0.95.

    Equal vectors become one, with its k + 1 smallest ids, before anything is ordered, so a vector that a third of
    all rows hold costs no more than another; ties go to the smaller vec_id. Null ids and vectors that are null,
    empty, zero or hold null or non-finite components take no part, nor do vectors of another length than most have.
    An id that is repeated with other vectors stands for each of them. Other columns are not looked at, whatever they are
    called. No usable query: no rows.
    """
    spark = embeddings.sparkSession
    n = partitions(spark)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    dims = length["d"] if length else 1
    rows = keyed(rows.where(F.size("vector") == dims), F.col("vector"))
    smallest = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    few = rows.withColumn("nth", smallest).where(F.col("nth") <= k + 1)
    # a vector goes by its hash: its ids may be those of other vectors too
    reps = few.groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.array_sort(F.collect_set("vec_id")).alias("ids"), F.first("vector").alias("vector"))
    reps = settled(reps.withColumn("rep", F.col("k1")))
    wanted = rows.where(F.col("vec_id") % every == 0).select("vec_id", "k1", "k2")
    queries = wanted.join(reps.select("k1", "k2", "rep"), ["k1", "k2"]).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")).distinct()
    queries = settled(queries)

    sums = reps.select("vector").mapInArrow(_sums, "n long, total array<double>, square double").collect()
    count = sum(r["n"] for r in sums)
    centre = np.sum([r["total"] for r in sums], axis=0) / max(count, 1) if sums else np.zeros(dims)
    spread = float(np.sqrt(max(sum(r["square"] for r in sums) / max(count * dims, 1) - float(centre @ centre) / dims, 1e-30)))

    keys = reps.select("rep", "vector").mapInArrow(_curve_keys(orderings, dims, axes, bits, seed, centre, spread), "ordering int, key long, rep long")
    ordered = keys.repartitionByRange(n, "ordering", "key", "rep").sortWithinPartitions("ordering", "key", "rep")
    placed = settled(ordered.mapInArrow(_places, "ordering int, task int, place long, rep long"))
    counts = placed.groupBy("ordering", "task").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy("ordering").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("ordering", "task", F.coalesce(before, F.lit(0)).alias("before"))
    blocks = placed.join(F.broadcast(counts), ["ordering", "task"]).select(
        "rep", F.struct("ordering", F.floor((F.col("place") + F.col("before")) / block_rows).alias("block")).alias("at")
    )
    blocks = blocks.groupBy("rep").agg(F.collect_set("at").alias("at"))
    far = int(np.ceil(reach * count / block_rows)) if count else 0
    asked = queries.select("query").distinct()
    wide = reps.select("rep", "first", "vector").join(blocks, "rep").join(asked, F.col("rep") == F.col("query"), "left")
    wide = wide.select("rep", "first", "vector", F.col("query").isNotNull().alias("asks"), F.explode("at").alias("at"))
    last = max(0, (count - 1) // block_rows)
    reached = F.sequence(F.greatest(F.lit(0), F.col("at.block") - far), F.least(F.lit(last), F.col("at.block") + far))
    here = wide.select(F.col("at.ordering").alias("ordering"), F.col("at.block").alias("block"), F.lit(0).alias("side"), "rep", "first", "vector")
    asking = wide.where("asks").select(F.col("at.ordering").alias("ordering"), F.explode(reached).alias("block"), F.lit(1).alias("side"), "rep", "first", "vector")
    dealt = here.unionByName(asking).repartition(n, "ordering", "block").sortWithinPartitions("ordering", "block", "side")
    found = dealt.mapInArrow(_nearest(k + 1), "query long, rep long, first long, score double").distinct()
    nearest = F.row_number().over(Window.partitionBy("query").orderBy("score", "first"))
    found = found.withColumn("nth", nearest).where(F.col("nth") <= k + 1).drop("nth", "first")
    ids = reps.select("rep", F.explode("ids").alias("vec_id"))
    pairs = queries.join(found.join(ids, "rep"), "query").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
