"""SimHash near-duplicates: bit planes compared 64 pairs to a word, with carry-save counters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.common import byte_texts, packed_rows, partitions, run_starts, settled, slices, text_only, whole_groups
from promptloom.llm.components import components

BITS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `words` words, joined by one space; the whole sequence if it has fewer."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(tokens) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray, block: int = 1 << 14) -> int:
    """Bit b is set if it is set in over half the hashes; zero for no hash."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), block):
        part = hashes[i : i + block]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * counts > len(hashes)) if len(hashes) else []
    return sum(1 << int(b) for b in set_bits)


def _fingerprints(words: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = np.array([fingerprint(shingle_hashes(t, words, seed)) for t in byte_texts(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(documents: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for every row; null and empty texts have 0."""
    return text_only(documents, "doc_id", "text").mapInArrow(_fingerprints(words, seed), "doc_id long, fp long")


def planes_of(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit b of 64 neighbouring fingerprints in one word; the tail is padded with zeros."""
    padded = np.zeros(-(-len(prints) // 64) * 64, np.uint64)
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").astype(np.uint64)


class Counters:
    """Carry-save counters of 64 distances to a word: bit k of all counts in one array, and one bit that stays
    set once a count is past what the bits hold."""

    def __init__(self, shape, radius: int):
        self.radius = radius
        self.bits = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
        self.past = np.zeros(shape, np.uint64)

    def add(self, ones: np.ndarray) -> None:
        carry = ones
        for i, bit in enumerate(self.bits):
            self.bits[i], carry = bit ^ carry, bit & carry
        self.past |= carry

    def exceeded(self) -> np.ndarray:
        """Bits of the pairs whose count is above the radius."""
        above, equal = np.zeros_like(self.past), np.full_like(self.past, FULL)
        for i in reversed(range(len(self.bits))):
            if self.radius >> i & 1:
                equal &= self.bits[i]
            else:
                above |= equal & self.bits[i]
                equal &= ~self.bits[i]
        return self.past | above

    def keep(self, alive: np.ndarray) -> None:
        self.bits = [b[alive] for b in self.bits]
        self.past = self.past[alive]


def close_pairs(queries: np.ndarray, prints: np.ndarray, radius: int, step: int = 8, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Indices (query, print) of all pairs at most `radius` bits apart. Every `step` planes, words of 64 pairs that
    are all past the radius are abandoned."""
    planes = planes_of(prints)
    words = planes.shape[1]
    tail = FULL if len(prints) % 64 == 0 else np.uint64((1 << len(prints) % 64) - 1)
    found_q, found_p = [], []
    for at in range(0, len(queries), rows):
        part = queries[at : at + rows]
        q, w = (x.ravel() for x in np.meshgrid(np.arange(len(part)), np.arange(words), indexing="ij"))
        counters = Counters(len(q), radius)
        for b in range(BITS):
            mask = np.uint64(0) - ((part >> np.uint64(b)) & np.uint64(1))  # all ones where the query's bit is set
            counters.add(planes[b][w] ^ mask[q])
            if b % step == step - 1 and b < BITS - 1:
                alive = counters.exceeded() != FULL
                if not alive.all():
                    q, w = q[alive], w[alive]
                    counters.keep(alive)
                    if not len(q):
                        break
        if not len(q):
            continue
        near = ~counters.exceeded()
        near[w == words - 1] &= tail
        hit = np.flatnonzero(near)
        bits = np.unpackbits(near[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        i, bit = np.nonzero(bits)
        found_q.append(q[hit[i]] + at)
        found_p.append(w[hit[i]] * 64 + bit)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_p)


def close_rows(a: np.ndarray, b: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """Whether a[i] and b[i] are at most `radius` bits apart, by the same counters."""
    planes = planes_of(a ^ b)
    word = np.arange(planes.shape[1])
    counters = Counters(len(word), radius)
    for i in range(BITS):
        counters.add(planes[i][word])
        if i % step == step - 1 and i < BITS - 1:
            alive = counters.exceeded() != FULL
            word = word[alive]
            counters.keep(alive)
            if not len(word):
                break
    near = np.zeros(planes.shape[1], np.uint64)
    near[word] = ~counters.exceeded()
    return np.unpackbits(near.astype("<u8").view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def spanning(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the components of the links: at most n - 1 of them."""
    labels = np.arange(n)
    while True:  # the smallest label wins along the links, then labels are followed to their roots
        low = np.minimum(labels[left], labels[right])
        after = labels.copy()
        np.minimum.at(after, labels[left], low)
        np.minimum.at(after, labels[right], low)
        after = after[after]
        if (after == labels).all():
            break
        labels = after
    nodes = np.flatnonzero(labels != np.arange(n))
    return nodes, labels[nodes]


def _compare(radius: int, small: int = 48):
    """Links inside the tiles of a partition sorted by bucket and tile pair. Small buckets are compared at offsets
    1, 2, ... over the whole table, larger ones as query rows against bit planes."""

    def links(bucket, prints, ids, sides):
        starts = np.append(run_starts(bucket), len(bucket))
        sizes = np.diff(starts)
        lasts = np.repeat(starts[1:], sizes)
        brief = np.repeat(sizes <= small, sizes)
        for offset in range(1, int(min(small, sizes.max(initial=0)))):
            i = np.flatnonzero(brief & (np.arange(len(bucket)) + offset < lasts))
            if not len(i):
                break
            j = i + offset
            i, j = (x[(sides[i] != sides[j]) | (sides[i] == 2)] for x in (i, j))
            if len(i):
                near = close_rows(prints[i], prints[j], radius)
                yield ids[i[near]], ids[j[near]]
        for k in np.flatnonzero(sizes > small):
            part = slice(starts[k], starts[k + 1])
            p, d, s = prints[part], ids[part], sides[part]
            rows, columns = (np.arange(len(p)),) * 2 if s[0] == 2 else (np.flatnonzero(s == 0), np.flatnonzero(s == 1))
            near = []
            for at in range(0, len(rows), 1024):
                q, c = close_pairs(p[rows[at : at + 1024]], p[columns], radius)
                a, b = rows[q + at], columns[c]
                near.append(spanning(a[a != b], b[a != b], len(p)))
            a, b = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (np.zeros(0, int),) * 2
            a, b = spanning(a, b, len(p))
            yield d[a], d[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["bucket", "first", "second"]):
            bucket, first, second, side = (table.column(c).to_numpy() for c in ("bucket", "first", "second", "side"))
            starts = run_starts(bucket, first, second)
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(bucket))))
            for a, b in links(group, table.column("fp").to_numpy().view(np.uint64), table.column("rep").to_numpy(), side):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _bucket_keys(radius: int, blocks: int) -> list:
    """One key per choice of blocks - radius blocks: two fingerprints within the radius agree in one of them at least."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << cuts[i + 1]) - (1 << cuts[i])) for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        # the masked bits as they are, with the number of the choice: equal if and only if the blocks are
        keys.append(F.struct(F.lit(n).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(signed)).alias("bits")))
    return keys


def near_links(nodes: DataFrame, radius: int = 3, blocks: int = 5, tile: int = 4096) -> DataFrame:
    """Links (a, b) that join what pairs of `nodes` (fp, rep; fp distinct) within `radius` bits join: every such pair
    is connected by the links given.

    A pair within the radius differs in at most `radius` of the blocks, so it agrees in one choice of the others:
    the buckets lose nothing. A bucket of more than `tile` fingerprints is cut into tiles by a hash, and each pair of
    tiles is a group of its own, so no task holds more than two tiles of a bucket at a time.
    """
    n = partitions(nodes.sparkSession)
    rows = nodes.select("fp", "rep", F.explode(F.array(*_bucket_keys(radius, blocks))).alias("key")).select(
        "fp", "rep", F.xxhash64("key.choice", "key.bits").alias("bucket")
    )
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    tiles = F.ceil(F.col("size") / tile).cast("int")
    placed = (
        rows.join(sizes, "bucket")
        .withColumn("tiles", tiles)
        .withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "bucket",
            F.least("own", "other").alias("first"),
            F.greatest("own", "other").alias("second"),
            F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"),
            "fp",
            "rep",
        )
    )
    dealt = placed.repartition(n, "bucket", "first", "second").sortWithinPartitions("bucket", "first", "second")
    return dealt.mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(documents: DataFrame, words: int = 3, radius: int = 3, blocks: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links of at most `radius` differing bits reach.

    Texts are lower-cased (A-Z), cut at ASCII white space and hashed whole in shingles of `words` words. Exact
    copies of a fingerprint become one node before anything is compared, whatever their number.

    Nulls: null and empty texts have fingerprint 0 and link like any other. A row with a null doc_id gets a
    fingerprint and the component of its equals; it is never the id of one. Rows of one doc_id are one document,
    so their fingerprints are linked. An empty table gives no rows.
    """
    prints = settled(fingerprints(documents, words, seed))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    linked = components(near_links(nodes.where("rep IS NOT NULL"), radius, blocks))
    classes = nodes.join(linked, nodes["rep"] == linked["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_first(documents: DataFrame, words: int = 3, radius: int = 3, blocks: int = 5, seed: int = 42) -> DataFrame:
    """`documents` with one document of each near-duplicate group, the smallest doc_id. Rows without an id stay.
    Of rows that repeat a doc_id all or none stay: they are one document."""
    groups = near_duplicates(documents, words, radius, blocks, seed)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return packed_rows(documents).join(gone, F.col("row.doc_id") == gone["doc_id"], "left_anti").select("row.*")
