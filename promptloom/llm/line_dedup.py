"""Line de-duplication over a sorted stream of line hashes, answered as keep bitmaps."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from promptloom.llm.common import SPACE, byte_texts, packed_rows, partitions, run_starts, slices, text_only, written

DROP, OPEN, EDGE = 1, 0, 2
_RUNS = "kind int, h1 long, h2 long, doc long, pos long"
_RUNS_ARROW = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("pos", pa.int64())])


def line_key(line: bytes) -> bytes:
    """White space off both ends, A-Z as a-z; other letters stay."""
    return line.strip(SPACE).lower()


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            digests, docs, places = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), byte_texts(batch), strict=True):
                if doc is None:
                    continue
                tag = zlib.crc32(text) << 31
                for place, line in enumerate(text.split(b"\n")):
                    key = line_key(line)
                    if _long_enough(key, min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        docs.append(doc)
                        places.append(tag | place)
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(docs, pa.int64()), pa.array(places, pa.int64())],
                ["h1", "h2", "doc", "pos"],
            )

    return run


class _Group:
    """The group that a batch leaves unfinished. Its documents come from the largest id down."""

    def __init__(self, key, first: bool, min_docs: int, put):
        self.key, self.first, self.min_docs, self.put = key, first, min_docs, put
        self.docs, self.keeper, self.last = 0, None, None
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def extend(self, doc: np.ndarray, pos: np.ndarray) -> None:
        fresh = np.ones(len(doc), bool)
        fresh[1:] = doc[1:] != doc[:-1]
        fresh[0] = self.last is None or doc[0] != self.last
        rank = self.docs - 1 + np.cumsum(fresh)
        if self.keeper is None:
            self.keeper = int(doc[0])
        self.docs, self.last = int(rank[-1]) + 1, doc[-1]
        if self.first:
            self.put(OPEN, self.key, doc, pos)
            return
        self.waiting.append((doc[rank >= 1], pos[rank >= 1]))
        if self.docs >= self.min_docs:
            for d, p in self.waiting:
                self.put(DROP, self.key, d, p)
            self.waiting.clear()

    def close(self, end: bool) -> None:
        if self.first or end:
            self.put(EDGE, self.key, np.array([self.keeper]), np.array([self.docs]))
        if end:
            for d, p in self.waiting:
                self.put(OPEN, self.key, d, p)


def _stream(min_docs: int):
    """Reads a sorted partition once. A group is the run of one hash; a document's rank is its place in the run,
    largest id first. Rank 0 keeps its lines, the others lose them once min_docs documents are seen; until then
    at most min_docs - 2 documents wait. The first and the last group may go on in a neighbouring partition:
    rows that only the whole group can decide come out as OPEN, with one EDGE row (largest id, documents seen)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def put(kind, key, doc, pos):
            if len(doc):
                h1, h2 = (np.full(len(doc), k, np.int64) if np.ndim(k) == 0 else k for k in key)
                out.append((np.full(len(doc), kind, np.int32), h1, h2, doc, pos))

        def flush():
            if out:
                columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RUNS_ARROW, strict=True)], schema=_RUNS_ARROW)

        group = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc, pos = (batch.column(i).to_numpy() for i in range(4))
            starts = run_starts(h1, h2)
            head = 0
            if group is not None:
                if group.key == (h1[0], h2[0]):
                    head = int(starts[1]) if len(starts) > 1 else len(doc)
                    group.extend(doc[:head], pos[:head])
                    if head == len(doc):
                        yield from flush()
                        continue
                group.close(end=False)
            tail = int(starts[-1])
            if group is None and head < tail:  # the partition's first group, whole in this batch
                head = int(starts[1])
                group = _Group((h1[0], h2[0]), True, min_docs, put)
                group.extend(doc[:head], pos[:head])
                group.close(end=False)
            if head < tail:
                part = slice(head, tail)
                begins = starts[(starts >= head) & (starts < tail)] - head
                fresh = np.ones(tail - head, bool)
                fresh[1:] = doc[part][1:] != doc[part][:-1]
                fresh[begins] = True
                seen = np.cumsum(fresh)
                lengths = np.diff(np.append(begins, tail - head))
                rank = seen - np.repeat(seen[begins], lengths)
                total = np.repeat(np.maximum.reduceat(rank, begins) + 1, lengths)
                drop = (rank >= 1) & (total >= min_docs)
                put(DROP, (h1[part][drop], h2[part][drop]), doc[part][drop], pos[part][drop])
            group = _Group((h1[-1], h2[-1]), group is None, min_docs, put)
            group.extend(doc[tail:], pos[tail:])
            yield from flush()
        if group is not None:
            group.close(end=True)
        yield from flush()

    return run


def _bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for places in batch.column(2).to_pylist():
            keep = np.ones((max(places) // 8 + 1) * 8, dtype=bool)
            keep[places] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([len(p) for p in batch.column(2).to_pylist()], pa.int64()), pa.array(maps, pa.binary())],
            ["doc_id", "text_crc", "n_dropped", "keep_bitmap"],
        )


def line_keep_bitmaps(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Which lines each document loses: doc_id, text_crc (CRC-32 of the text), n_dropped, keep_bitmap.

    A line's key is the stripped, ASCII-lower-cased line. Keys of at least `min_chars` code points that
    `min_docs` documents hold lose all their lines except those of the largest doc_id. keep_bitmap is
    zlib-compressed, one bit per line, first line in the highest bit; lines behind its end are kept. A document
    without a row keeps all lines.

    128-bit hashes of the keys are range-partitioned by (hash, document), sorted by hash, document from the
    largest down and position, and read as a stream: a line that a third of all documents hold spreads over
    many partitions. What a group that crosses a partition's edge needs is one row per edge, two per partition
    at most, which is what is broadcast.

    Nulls: a null text is one empty line; a row with a null doc_id takes no part and keeps all its lines. Rows
    of one doc_id count as one document; each text has its own bitmap. An empty table gives no rows.
    """
    lines = text_only(documents, "doc_id", "text").mapInArrow(_hashes(min_chars), "h1 long, h2 long, doc long, pos long")
    n = partitions(documents.sparkSession)
    ordered = lines.repartitionByRange(n, "h1", "h2", F.col("doc").desc()).sortWithinPartitions("h1", "h2", F.col("doc").desc(), "pos")
    runs = written(ordered.mapInArrow(_stream(min_docs), _RUNS))
    edges = runs.where(F.col("kind") == EDGE).groupBy("h1", "h2").agg(F.sum("pos").alias("docs"), F.max("doc").alias("keeper"))
    undecided = (
        runs.where(F.col("kind") == OPEN)
        .join(F.broadcast(edges), ["h1", "h2"])
        .where((F.col("docs") >= min_docs) & (F.col("doc") != F.col("keeper")))
    )
    drops = runs.where(F.col("kind") == DROP).select("doc", "pos").unionByName(undecided.select("doc", "pos"))
    per_document = (
        drops.select(F.col("doc").alias("doc_id"), F.shiftright("pos", 31).alias("text_crc"), F.col("pos").bitwiseAND((1 << 31) - 1).alias("place"))
        .distinct()
        .groupBy("doc_id", "text_crc")
        .agg(F.collect_list("place").alias("places"))
    )
    return per_document.mapInArrow(_bitmap, "doc_id long, text_crc long, n_dropped long, keep_bitmap binary")


def kept_lines(text: bytes, bitmap: bytes | None) -> list[bytes]:
    """The lines that stay."""
    lines = text.split(b"\n")
    if bitmap is None:
        return lines
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return [line for i, line in enumerate(lines) if i >= len(keep) or keep[i]]


def _with_bitmaps(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, keep) of `documents`, joined on the id and the text's checksum."""
    crc = F.crc32(F.coalesce("row.text", F.lit("")).cast("binary"))
    side = bitmaps.select("doc_id", "text_crc", F.col("keep_bitmap").alias("keep"))
    joined = packed_rows(documents).join(side, (F.col("row.doc_id") == side["doc_id"]) & (crc == side["text_crc"]), "left")
    return joined.select("row", "keep")


@F.pandas_udf(StringType())
def _kept_text(text, bitmap):
    return text.combine(bitmap, lambda t, m: t if m is None else b"\n".join(kept_lines(t.encode(), m)).decode())


def drop_lines(documents: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """`documents` with the lines that `bitmaps` marks taken out of `text`; other columns stay. Texts that lose
    nothing, null ones included, are as they were."""
    keep, text = F.col("keep"), F.col("row.text")
    left = F.when(keep.isNull(), text).otherwise(_kept_text(text, keep))
    return _with_bitmaps(documents, bitmaps).select(F.col("row").withField("text", left).alias("row")).select("row.*")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        lines, dropped, shas = [], [], []
        for text, bitmap in zip(byte_texts(batch), batch.column(2).to_pylist(), strict=True):
            kept = kept_lines(text, bitmap)
            lines.append(text.count(b"\n") + 1)
            dropped.append(lines[-1] - len(kept))
            shas.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(shas)],
            ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
        )


def line_digests(documents: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row of `documents`."""
    narrow = text_only(documents, "doc_id", "text")
    joined = _with_bitmaps(narrow, line_keep_bitmaps(narrow, min_chars, min_docs))
    return joined.select("row.doc_id", "row.text", "keep").mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
