"""Embedding near-duplicates: products of int8 tiles with error bounds, full precision only where they leave doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import partitions, run_starts, settled, whole_groups
from promptloom.llm.components import components
from promptloom.llm.hilbert import matrix
from promptloom.llm.simhash import spanning
from promptloom.llm.vectors import keyed, usable

#: 127 * 127 * 1024 < 2^24: sums of so many products are exact in single precision.
EXACT = 1024
#: Covers what rounding adds to bounds worked out in double precision.
SLACK = 1e-9


class Tile:
    """Unit vectors as int8 with a scale each. `error` is the length of what quantising took off a vector."""

    def __init__(self, vectors: np.ndarray):
        self.unit = vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.codes = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.length = np.sqrt((near * near).sum(axis=1))
        self.error = np.sqrt(((self.unit - near) ** 2).sum(axis=1))

    def bounds(self, rows: slice, other: Tile) -> tuple[np.ndarray, np.ndarray]:
        """Quantised cosines of rows x other, and how far off they can be: with u = q + e on both sides,
        u.v - q.q' = q.e' + e.v, at most |q| |e'| + |e|, v being of length 1."""
        product = np.zeros((rows.stop - rows.start, len(other.codes)), np.float64)
        for at in range(0, self.codes.shape[1], EXACT):
            part = slice(at, at + EXACT)
            product += self.codes[rows, part].astype(np.float32) @ other.codes[:, part].astype(np.float32).T
        product *= self.scale[rows][:, None]
        product *= other.scale
        return product, self.length[rows][:, None] * other.error + self.error[rows][:, None] + SLACK


def close_pairs(left: Tile, right: Tile, threshold: float, raw_left: np.ndarray, raw_right: np.ndarray, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs with cosine >= threshold, block by block. A pair whose lower bound reaches it is in, one whose
    upper bound does not is out, the others are worked out in double precision from the vectors as given."""
    norm_left, norm_right = (np.sqrt((x * x).sum(axis=1)) for x in (raw_left, raw_right))
    for at in range(0, len(raw_left), rows):
        part = slice(at, min(at + rows, len(raw_left)))
        cosine, doubt = left.bounds(part, right)
        sure = cosine - doubt >= threshold
        i, j = np.nonzero((cosine + doubt >= threshold) & ~sure)
        good = np.zeros(len(i), bool)
        for b in range(0, len(i), 1 << 14):
            x, y = i[b : b + (1 << 14)] + at, j[b : b + (1 << 14)]
            good[b : b + (1 << 14)] = (raw_left[x] * raw_right[y]).sum(axis=1) / (norm_left[x] * norm_right[y]) >= threshold
        p, q = np.nonzero(sure)
        yield np.concatenate((p, i[good])) + at, np.concatenate((q, j[good]))


def _links(threshold: float):
    """For each group of one tile or two: what each vector's links add to its count, and a forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["part", "first", "second"], rows=1 << 12):
            part, first, second, side, rep, copies = (table.column(c).to_numpy() for c in ("part", "first", "second", "side", "rep", "copies"))
            vectors = table.column("vector").combine_chunks()
            for rows in np.split(np.arange(len(rep)), run_starts(part, first, second)[1:]):
                x = matrix(vectors.slice(rows[0], len(rows)))  # one length in a group
                one = side[rows[0]] == 2
                a, b = (np.arange(len(rows)),) * 2 if one else (np.flatnonzero(side[rows] == 0), np.flatnonzero(side[rows] == 1))
                if not len(a) or not len(b):
                    continue
                left = Tile(x[a])
                right = left if one else Tile(x[b])
                added, forests = np.zeros(len(rows), np.int64), []
                for i, j in close_pairs(left, right, threshold, x[a], x[b]):
                    i, j = a[i], b[j]
                    i, j = i[i != j], j[i != j]
                    added += np.bincount(i, copies[rows][j], len(rows)).astype(np.int64)
                    if not one:
                        added += np.bincount(j, copies[rows][i], len(rows)).astype(np.int64)
                    forests.append(spanning(i, j, len(rows)))
                i, j = spanning(*(np.concatenate(f) for f in zip(*forests, strict=True)), len(rows))
                has = np.flatnonzero(added)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate((rep[rows][has], rep[rows][i]))),
                        pa.array(np.concatenate((np.zeros(len(has), np.int64), rep[rows][j])), mask=np.arange(len(has) + len(i)) < len(has)),
                        pa.array(np.concatenate((added[has], np.zeros(len(i), np.int64)))),
                    ],
                    ["rep", "other", "links"],
                )

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93, tile: int = 4096) -> DataFrame:
    """vec_id, label, n_links, component_id, kept per row: vectors of one label and length with a cosine of at least
    `threshold` are linked; n_links counts the other rows linked directly, component_id is the smallest vec_id that
    links reach.

    Equal vectors of a label become one with a count first. The others of a label are cut into tiles of about `tile`
    vectors by a hash; each pair of tiles of a label is one group, so a task holds two tiles, whatever a label's share.
    A tile product is a matrix product of int8 codes; error bounds per vector settle nearly all pairs, so no link is
    lost and none added, and full precision is left for those that the bounds leave open. Groups give out counts and
    a forest, never their pairs. All pairs of a label are compared: the work grows with its square, as the contract's
    exact count of links asks.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with
    nothing and are their own component; so are rows with a null vec_id, whose component_id is null. Repeated rows are
    vectors of their own that link with each other. An empty table gives no rows.
    """
    n = partitions(embeddings.sparkSession)
    base = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = keyed(base, F.col("label"), F.size("vector"), F.col("vector"))
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"))
    # -0.0 and 0.0 hash apart: such vectors are linked by their cosine instead
    reps = rows.where(takes_part).groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("label").alias("label")
    )
    reps = settled(reps.withColumn("part", F.xxhash64("label", F.size("vector"))))
    tiles = reps.groupBy("part").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    placed = (
        reps.join(tiles, "part")
        .withColumn("own", F.pmod(F.xxhash64("k1", "k2"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "part",
            F.least("own", "other").alias("first"),
            F.greatest("own", "other").alias("second"),
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
            "rep",
            "copies",
            "vector",
        )
    )
    dealt = placed.repartition(n, "part", "first", "second").sortWithinPartitions("part", "first", "second")
    found = settled(dealt.mapInArrow(_links(threshold), "rep long, other long, links long"))
    counts = found.where("other IS NULL").groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(found.where("other IS NOT NULL"), "rep", "other")
    # a vec_id repeated with other vectors is one node; its rows share counts by vector through the key
    classes = (
        reps.select("k1", "k2", "rep", "copies")
        .join(counts, "rep", "left")
        .join(linked, F.col("rep") == F.col("node"), "left")
        .select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    some = rows.withColumn("takes_part", takes_part).select("vec_id", "label", "k1", "k2", "takes_part")
    joined = some.where("takes_part").join(classes, ["k1", "k2"]).select("vec_id", "label", "n_links", "component_id")
    alone = some.where("NOT takes_part").select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
