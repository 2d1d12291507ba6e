"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and line rules: `[\x20\x09-\x0D]`.
SPACE = b" \t\n\x0b\x0c\r"


def _shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is named only a local session may go on, with a folder of its
    own; on a cluster it is an error, as executors would each write to their own disk."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of `df`: cuts the lineage, and what several branches read is computed once. For narrow frames; Spark
    removes its files when nothing refers to them and spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder: as `settled`, but compressed, for frames of many rows. A range
    partitioning whose edges matter must be read from one such table: planned twice, it may be cut elsewhere."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Explicit number for repartition calls: a stated number is not changed between two reads of one exchange."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Cuts batches into runs of rows of about `limit` bytes of text, so that the arrays made per run stay
    small whatever the batch size. A longer text is a run of its own, never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def byte_texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    column = batch.column(batch.schema.get_field_index(text))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches sorted by `keys`. Holds `rows` rows and one group at most, so
    groups must have a bound."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(table.num_rows, dtype=bool)
        for key in keys:
            column = table.column(key).to_numpy()
            last &= column == column[-1]
        cut = int(np.argmax(last))  # sorted: the last group is the tail
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, count = rest.to_batches(), 0 if cut else rest.num_rows
        count = rest.num_rows if cut else 0  # a group longer than `rows` waits for as many rows again
    if held:
        yield pa.Table.from_batches(held)


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Positions at which any of the sorted columns changes, 0 included."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64)
    change = np.zeros(len(columns[0]) - 1, dtype=bool)
    for column in columns:
        change |= column[1:] != column[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1))


def single_thread() -> None:
    """Spark runs one task per core: libraries below must not start threads of their own."""
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
        os.environ[name] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def packed_rows(df: DataFrame) -> DataFrame:
    """One struct column, `row`: no column of `df` can clash with one made here. `row.*` unpacks it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def text_only(documents: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that further ones, whatever their names, never meet those made here."""
    return documents.select(*[F.col(f"`{c}`") for c in columns])
