"""Hard negatives by exact integer products, several candidates packed into each number (Kronecker substitution)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptloom.llm.common import partitions, run_starts, single_thread, whole_groups, written
from promptloom.llm.hilbert import matrix
from promptloom.llm.vectors import keyed

#: A double holds integers below 2^53 exactly: the wide number that matrix products can work on.
WIDE = 53
#: Rows whose squared length passes this take no part: products of two others always fit a long.
LARGEST = 2.0**62
_NONE = np.iinfo(np.int64).min


def codes_of(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of every component."""
    return np.floor(vectors * scale).astype(np.int64)


class Packed:
    """Candidates (rows of codes) whose components, biased to be no less than zero, stand in separated fields of one
    number each: for components j, number h = sum over fields f of candidate[f * half + h][j] << (f * width). A field is
    wide enough for the whole sum over the components, so one multiplication by an anchor's (biased) component serves
    all fields of a number and no field ever carries into the next."""

    def __init__(self, codes: np.ndarray, anchor_low: int, anchor_high: int):
        self.count, self.dims = codes.shape
        self.anchor_low = anchor_low
        self.low = int(codes.min(initial=0))
        codes = codes - self.low
        self.sums = codes.sum(axis=1) + self.low * self.dims
        largest = int(codes.max(initial=0)) * (anchor_high - anchor_low)
        #: Components whose sums may share a field, and the bits of a field.
        self.step, self.width = max(1, self.dims), max(1, (largest * self.dims).bit_length())
        while 2 * self.width > WIDE and self.step > 1:
            self.step = (self.step + 1) // 2
            self.width = max(1, (largest * self.step).bit_length())
        self.wide = 2 * self.width > WIDE
        if self.wide:  # a double has no room for two fields: one number of all candidates, as long as need be
            self.bytes = -(-(largest * self.dims).bit_length() // 64) * 8
            self.numbers = [self._number(codes[:, j]) for j in range(self.dims)]
            return
        self.fields = max(1, min(WIDE // self.width, self.count or 1))
        self.half = -(-self.count // self.fields)
        numbers = np.zeros((self.half, self.dims), np.int64)
        for f in range(self.fields):
            part = codes[f * self.half : (f + 1) * self.half]
            numbers[: len(part)] |= part << (f * self.width)
        self.numbers = np.ascontiguousarray(numbers.T, dtype=np.float64)

    def _number(self, column: np.ndarray) -> int:
        fields = np.zeros((self.count, self.bytes // 8), "<u8")
        fields[:, 0] = column
        return int.from_bytes(fields.tobytes(), "little")

    def products(self, anchors: np.ndarray) -> np.ndarray:
        """Inner products of anchors (rows of codes) with the candidates, exactly."""
        biased = anchors - self.anchor_low
        own = self.low * biased.sum(axis=1)
        if self.wide:
            out = np.zeros((len(anchors), self.count), np.int64)
            for i, row in enumerate(biased.tolist()):
                total = sum(a * number for a, number in zip(row, self.numbers, strict=True))
                fields = np.frombuffer(total.to_bytes(self.bytes * self.count, "little"), "<u8").reshape(self.count, -1)
                out[i] = fields[:, 0].astype(np.int64)  # what is left after the biases fits 64 bits, whatever wraps here
        else:
            out = np.zeros((len(anchors), self.fields * self.half), np.int64)
            mask = (1 << self.width) - 1
            left = biased.astype(np.float64)
            for at in range(0, self.dims, self.step):
                part = (left[:, at : at + self.step] @ self.numbers[at : at + self.step]).astype(np.int64)
                for f in range(self.fields):
                    out[:, f * self.half : (f + 1) * self.half] += (part >> (f * self.width)) & mask
            out = out[:, : self.count]
        # sum ab = sum a'b' + low_b sum a' + low_a sum b, with a' = a - low_a, b' = b - low_b
        return out + own[:, None] + self.anchor_low * self.sums


class Best:
    """The first `k` candidates of each query: higher scores first, ties by candidate number. Candidates come in
    ascending slices, so that one which only equals a query's k-th score is never needed."""

    def __init__(self, k: int, low: np.ndarray):
        self.k, self.floor = k, low.copy()
        self.held = [np.zeros(0, np.int64)] * 3

    def add(self, queries: np.ndarray, scores: np.ndarray, allowed: np.ndarray, start: int) -> None:
        """scores of queries x the candidates from `start` on; `allowed` where they may count."""
        passing = allowed & (scores >= self.floor[queries][:, None])
        if np.count_nonzero(passing) > 8 * self.k * len(queries) and scores.shape[1] > self.k:
            seen = np.where(passing, scores, _NONE)
            kth = np.partition(seen, -self.k, axis=1)[:, -self.k]
            passing &= scores >= kth[:, None]
        i, j = np.nonzero(passing)
        if not len(i):
            return
        held = [np.concatenate(x) for x in zip(self.held, (queries[i], scores[i, j], j + start), strict=True)]
        order = np.lexsort((held[2], -held[1], held[0]))
        held = [x[order] for x in held]
        begin = run_starts(held[0])
        rank = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        held = [x[rank < self.k] for x in held]
        full = rank[rank < self.k] == self.k - 1
        self.held = held
        self.floor[held[0][full]] = held[1][full] + 1  # int64: scores stay below 2^62


def _parts(rows: int, size: int) -> Iterator[slice]:
    for at in range(0, rows, size):
        yield slice(at, min(at + size, rows))


def _packed(anchors: np.ndarray, candidates: np.ndarray, size: int) -> list[tuple[slice, Packed]]:
    """Slices of candidates, each packed once for all anchors."""
    low, high = int(anchors.min(initial=0)), int(anchors.max(initial=0))
    return [(part, Packed(candidates[part], low, high)) for part in _parts(len(candidates), size)]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, np.ndarray], pa.Array, np.ndarray, np.ndarray]]:
    """Columns, scores, and the codes' rows of anchors and candidates of each (length, block, slab)."""
    single_thread()
    keys = ["length", "block", "slab"]
    for table in whole_groups(batches, keys, rows=1 << 12):
        bounds = run_starts(*(table.column(k).to_numpy() for k in keys))
        for a, b in zip(bounds, [*bounds[1:], table.num_rows], strict=True):
            group = table.slice(a, b - a).combine_chunks()
            columns = {c: group.column(c).to_numpy() for c in ("side", "vec_id", "k1", "k2", "copies", "label")}
            rows = group.column("vector").combine_chunks()
            yield columns, group.column("scores").combine_chunks(), rows, columns["side"] == 0


FOUND = "anchor long, k1 long, k2 long, floor long, score long, vec_id long, copies long"


def _emit(columns: dict, anchors: np.ndarray, floors: np.ndarray, scores: np.ndarray, candidates: np.ndarray, copies: np.ndarray) -> pa.RecordBatch:
    arrays = [columns["vec_id"][anchors], columns["k1"][anchors], columns["k2"][anchors], floors, scores, columns["vec_id"][candidates], copies]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in arrays], ["anchor", "k1", "k2", "floor", "score", "vec_id", "copies"])


def _positives(k: int, scale: int, size: int) -> Callable:
    """Of each group: every anchor's first k other rows of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, _, vectors, is_anchor in _groups(batches):
            codes = codes_of(matrix(vectors), scale)

            def own(a: np.ndarray, c: np.ndarray) -> np.ndarray:
                same = np.ones(np.broadcast_shapes(a.shape, c.shape), bool)
                for name in ("vec_id", "k1", "k2"):
                    same &= columns[name][a] == columns[name][c]  # noqa: B023
                return same

            for label in np.unique(columns["label"][is_anchor]):
                same = columns["label"] == label
                c = np.flatnonzero(~is_anchor & same)
                anchors = np.flatnonzero(is_anchor & same)
                packed = _packed(codes[anchors], codes[c], size)
                for rows in _parts(len(anchors), size):
                    a = anchors[rows]
                    best = Best(k, np.full(len(a), _NONE + 1))
                    for part, numbers in packed:
                        alone = own(a[:, None], c[part]) & (columns["copies"][c[part]] == 1)
                        best.add(np.arange(len(a)), numbers.products(codes[a]), ~alone, part.start)
                    q, score, j = best.held
                    # an anchor's equal rows are other rows
                    yield _emit(columns, a[q], np.zeros(len(q), np.int64), score, c[j], columns["copies"][c[j]] - own(a[q], c[j]))

    return run


def _negatives(k: int, low: int, high: int, scale: int, size: int) -> Callable:
    """Of each group: for every anchor and score of a positive, the first k rows of other labels within the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, positive, vectors, is_anchor in _groups(batches):
            anchors, c = np.flatnonzero(is_anchor), np.flatnonzero(~is_anchor)
            if not len(anchors):
                continue
            codes, labels = codes_of(matrix(vectors), scale), columns["label"]
            packed = _packed(codes[anchors], codes[c], size)
            for rows in _parts(len(anchors), size):
                a = anchors[rows]
                listed = positive.take(pa.array(a)).to_pylist()
                owner = np.repeat(np.arange(len(a)), [len(x) for x in listed])
                level = np.concatenate([np.arange(len(x)) for x in listed])
                scores = [s for x in listed for s in x]
                most = np.array([high * s // 100 for s in scores], np.int64)
                best = Best(k, np.array([-(-low * s // 100) for s in scores], np.int64))
                for part, numbers in packed:
                    product, other = numbers.products(codes[a]), labels[a][:, None] != labels[c[part]]
                    for n in range(level.max() + 1):  # one positive of each anchor at a time
                        q = np.flatnonzero(level == n)
                        values = product[owner[q]]
                        best.add(q, values, other[owner[q]] & (values <= most[q][:, None]), part.start)
                q, score, j = best.held
                yield _emit(columns, a[owner[q]], np.array(scores, np.int64)[q], score, c[j], columns["copies"][c[j]])

    return run


def _first(found: DataFrame, key: list[str], k: int) -> DataFrame:
    """The first k rows of each key, a row with copies standing for as many; `rank` from 1."""
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    few = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    before = F.coalesce(F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = few.withColumn("before", before).where(F.col("before") < k)
    last = F.least(F.col("before") + F.col("copies"), F.lit(k)).cast("int")
    return taken.withColumn("rank", F.explode(F.sequence(F.col("before").cast("int") + 1, last))).drop("place", "before")


def mine(
    embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    scale: int = 256, block: int = 1 << 17, slab: int = 1 << 14, size: int = 1 << 11,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score out of vec_id, label, embedding.

    A row's score is the integer inner product of floor(scale * x) with the anchor's. Anchors are the rows whose vec_id
    `every` divides; an anchor's positives are its first `positives` other rows of its label, its negatives to each of
    them the first `negatives` rows of other labels with low% <= negative / positive <= high%. Higher scores come first,
    ties go to the smaller vec_id.

    Anchors meet all rows, in groups of about `block` candidates and `slab` anchors (hash-dealt, whatever the labels or
    repeats), which is all that a task holds at a time. Within one, candidates are packed: `size` of them at a time, two
    or more to a double where the codes' range allows, else in Python integers of any length; sums are exact either way.
    A group gives out its best rows only; windows over these find the best of all. One round looks for positives, among
    rows of the anchor's label alone, the next for negatives between the bounds that the positives set.

    Rows take no part if vec_id, label or vector is null, if a component is null or not finite, or if the sum of their
    squared codes (each taken one larger) reaches 2^62 (so that every score fits a long). Zero and empty vectors do take part; rows of
    another length are never compared. Repeated rows are rows of their own: candidates as often as they stand there,
    anchors that each give their own results, and positives of each other. An anchor without positives, or a positive
    without negatives, gives no rows; nor does an empty table. Further columns are not looked at.
    """
    session = embeddings.sparkSession
    n = partitions(session)
    integral = dict(embeddings.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint")
    label = F.col("label").cast("long") if integral else F.xxhash64("label")
    base = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("label").isNotNull(), label).alias("label"), F.col("embedding").alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double")) * scale + 1, F.lit(2.0)))
    base = base.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(finite).where(square < LARGEST)
    reps = keyed(base, F.col("label"), F.size("vector"), F.col("vector")).groupBy("vec_id", "k1", "k2")
    reps = written(reps.agg(F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector")))
    is_anchor = F.col("vec_id") % every == 0
    total, anchors = reps.agg(F.count("*"), F.count(F.when(is_anchor, 1))).first()
    # no more rows in a block than the bound, and as many blocks as partitions if they fill a slice each
    blocks = max(1, -(-total // block), min(n, -(-total // size)))
    slabs = max(1, -(-anchors // slab))

    def spread(which: str, count: int):
        return F.pmod(F.xxhash64(F.lit(which), "vec_id", "k1", "k2"), F.lit(count)).cast("int")

    def each(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    carried = ["vec_id", "k1", "k2", "copies", "label", "vector"]
    candidates = reps.select(
        F.size("vector").alias("length"), spread("block", blocks).alias("block"), each(slabs).alias("slab"), F.lit(1).alias("side"),
        *carried, F.lit(None).cast("array<long>").alias("scores"),
    )

    def met(queries: DataFrame, find: Callable) -> DataFrame:
        asked = queries.select(
            F.size("vector").alias("length"), each(blocks).alias("block"), spread("slab", slabs).alias("slab"), F.lit(0).alias("side"), *carried, "scores"
        )
        keys = ["length", "block", "slab"]
        dealt = asked.unionByName(candidates).repartition(n, *keys).sortWithinPartitions(*keys, "side", "vec_id")
        return dealt.mapInArrow(find, FOUND)

    asking = reps.where(is_anchor)
    near = met(asking.withColumn("scores", F.lit(None).cast("array<long>")), _positives(positives, scale, size))
    near = written(_first(near, ["anchor", "k1", "k2"], positives).select("anchor", "k1", "k2", F.col("vec_id").alias("positive_id"), F.col("score").alias("floor")))
    bounds = near.groupBy(F.col("anchor").alias("vec_id"), "k1", "k2").agg(F.sort_array(F.collect_set("floor")).alias("scores"))
    far = met(asking.join(bounds, ["vec_id", "k1", "k2"]), _negatives(negatives, low, high, scale, size))
    key = ["anchor", "k1", "k2", "floor"]
    far = _first(far, key, negatives).select(*key, "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    times = asking.select(F.col("vec_id").alias("anchor"), "k1", "k2", F.col("copies").alias("times"))
    rows = near.join(far, key).join(times, ["anchor", "k1", "k2"])
    return rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", F.col("floor").alias("positive_score"), "negative_score"
    )
