"""Registered streaming queries: the derived events written once as files, then read as a stream."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import rules
from promptloom.operators import history
from promptloom.sources import derived
from promptloom.sources.tables import FEEDBACK, RUNS, SHELL_EVENTS, DayTable, Rollup, typed, work_dir
from promptloom.streaming import events as live


#: Events in a file of a stream's input: a file is about what one task reads.
EVENTS_PER_FILE = 100_000


def _source(spark: SparkSession, sf_dir: str, root: str, batches: int = 4) -> DataFrame:
    """The events as files of a time range each, a quarter of the files a micro-batch. There are as many files as the
    events ask for, so that a batch is read by many tasks however much it holds."""
    count = derived.table(spark, sf_dir, "events").count()
    at_once = max(1, math.ceil(count / (batches * EVENTS_PER_FILE)))
    typed(derived.shell_events(spark, sf_dir), SHELL_EVENTS).repartitionByRange(
        batches * at_once, "ts", "event_seq"
    ).write.parquet(f"{root}/in")
    return live.read_event_stream(spark, f"{root}/in", files_per_trigger=at_once)


def _run(stream: DataFrame, root: str) -> None:
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{root}/out")
    )
    query.awaitTermination()


def completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completion with a file per micro-batch, the ends of each time range before its starts; an event waits for as
    long as a range lasts, so that none is late."""
    root = work_dir(spark)
    events = typed(derived.shell_events(spark, sf_dir), SHELL_EVENTS)
    at = F.unix_micros("ts")
    first, last = events.agg(F.min(at), F.max(at)).first()
    if first is None:
        return spark.createDataFrame([], "event_seq bigint, shell string, pid int, exit_code int, completed_at string")
    length = (last - first) // 4 + 1
    for part in range(4):
        for kind in ("done", "start"):
            some = events.where((F.col("kind") == kind) & (F.floor((at - first) / length) == part))
            some.write.mode("append").parquet(f"{root}/in")
    stream = live.read_event_stream(spark, f"{root}/in", files_per_trigger=1)
    matching = live.Completion(spark, f"{root}/completion", delay_seconds=length / 1e6)
    run_batches(stream, matching, root)
    matching.finish()
    return matching.completed().select(
        "event_seq", "shell", "pid", "exit_code",
        F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("completed_at"),
    )


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], root: str) -> None:
    """Every micro-batch there is through ``step``."""
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark)
    _run(live.ingest(_source(spark, sf_dir, root)), root)
    return spark.read.parquet(f"{root}/out").select(
        "event_id", "command_hash", "raw_command_preview", "token_estimate", "input_type",
        "risk_level",
    )


def _run_upsert(updates: DataFrame, root: str, *key: str) -> DataFrame:
    """Runs an updating aggregate and returns its rows as of the last micro-batch. Each batch writes only the rows
    that it changed, in a folder of its own that a repeated batch replaces; the newest row of a key counts."""
    query = (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", f"{root}/checkpoint")
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/out/batch={n}"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = F.struct(*[c for c in updates.columns if c not in key])
    written = updates.sparkSession.read.parquet(f"{root}/out")
    return written.groupBy(*key).agg(F.max_by(rows, "batch").alias("last")).select(*key, "last.*")


def running_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running counts after the last micro-batch."""
    root = work_dir(spark)
    counts = live.running_command_patterns(live.ingest(_source(spark, sf_dir, root)))
    return _run_upsert(counts, root, "command_pattern").select(
        "command_pattern", "usage_count",
        F.round("average_token_estimate", 6).alias("average_token_estimate"),
    )


def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live events by day. Update mode keeps the state of days within the history watermark only; a day's count
    stands as last written once its state is gone."""
    root = work_dir(spark)
    source = live.read_within_history(_source(spark, sf_dir, root), rules.HISTORY_DAYS)
    daily = source.groupBy(F.window("ts", "1 day").alias("day"), "kind").agg(F.count("*").alias("events"))
    return _run_upsert(daily, root, "day", "kind").select(
        F.date_format("day.start", "yyyy-MM-dd").alias("day"), "kind", "events"
    )


def _files(df: DataFrame, path: str, files: int = 4) -> None:
    """Rows dealt by hash, so that every file - a micro-batch each - has old and new ones."""
    df.repartition(files).write.parquet(path)


def _stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def running_prompt_patterns(spark: SparkSession, runs: DataFrame) -> DataFrame:
    """Prompt shapes after several micro-batches of runs."""
    root = work_dir(spark)
    _files(typed(runs, RUNS), f"{root}/in")
    rollup = Rollup(spark, f"{root}/patterns", history.PROMPT_PARTIALS, history.merge_prompt_partials)
    run_batches(_stream(spark, f"{root}/in", RUNS), live.Mining(rollup, history.prompt_partials, compact_every=2), root)
    return history.patterns_of(rollup.read())


def rated_live(spark: SparkSession, feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """Feedback that reached a pattern, runs and feedback both arriving in several micro-batches of any order."""
    root = work_dir(spark)
    _files(typed(runs, RUNS), f"{root}/runs", 2)
    _files(typed(feedback, FEEDBACK), f"{root}/feedback", 2)
    rating = live.Rating(spark, f"{root}/rating")
    both = live.rate_stream(_stream(spark, f"{root}/feedback", FEEDBACK), _stream(spark, f"{root}/runs", RUNS))
    run_batches(both, rating, root)
    return rating.rated()


def retained_table(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    """The stored events after a stream whose every batch ages them."""
    root = work_dir(spark)
    table = DayTable(spark, f"{root}/events", SHELL_EVENTS, "ts")
    run_batches(_source(spark, sf_dir, root), live.Retention(table, days), root)
    return table.read().select("event_seq", "kind", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
