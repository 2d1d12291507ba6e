"""Input schemas, readers and writers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROMPTS = "prompt_id bigint, created_at timestamp, command_name string, text string"
SHELL_EVENTS = (
    "event_seq bigint, ts timestamp, kind string, shell string, pid int, cwd string, "
    "command string, exit_code int"
)
TOOL_OUTPUTS = (
    "output_id bigint, ts timestamp, command_name string, args array<string>, stdout string, "
    "stderr string, exit_code int"
)
FEEDBACK = (
    "feedback_id string, created_at timestamp, run_id string, rating string, notes string"
)
RUNS = (
    "run_id string, created_at timestamp, input_hash string, input_preview string, optimized_preview string, "
    "input_token_estimate int, optimized_token_estimate int, token_savings int, token_savings_percent double, "
    "input_type string, risk_level string, command_name string, was_optimized boolean, status string, pattern_hash string"
)
LOGGED_EVENTS = (
    "event_id string, event_seq bigint, created_at timestamp, shell string, pid int, cwd string, command_hash string, "
    "raw_command_preview string, optimized_preview string, token_estimate int, input_type string, risk_level string, "
    "was_modified boolean, status string, command_pattern string"
)
EXCLUDE_RULES = "scope string, pattern string"
ARCHIVE = "output_id bigint, ts timestamp, file_stem string, content string"


def _read(spark: SparkSession, path: str, schema: str, fmt: str) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def typed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, cast to it."""
    fields = T.StructType.fromDDL(schema)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def read_prompts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table of prompts; ``fmt='text'`` reads each file as one prompt."""
    if fmt == "text":
        files = spark.read.text(path, wholetext=True)
        meta = F.col("_metadata")
        return files.select(
            F.xxhash64(meta["file_path"]).alias("prompt_id"),
            meta["file_modification_time"].alias("created_at"),
            F.lit(None).cast("string").alias("command_name"),
            F.col("value").alias("text"),
        )
    return _read(spark, path, PROMPTS, fmt)


def read_shell_events(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, SHELL_EVENTS, fmt)


def with_output(outputs: DataFrame) -> DataFrame:
    """Standard output followed by standard error, as one text."""
    both = F.concat(F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit("")))
    return outputs.withColumn("output", both).drop("stdout", "stderr")


def read_tool_outputs(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return with_output(_read(spark, path, TOOL_OUTPUTS, fmt))


def read_feedback(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, FEEDBACK, fmt)


def read_exclude_rules(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, EXCLUDE_RULES, fmt)


def write_by_date(df: DataFrame, path: str, at: str = "created_at", mode: str = "append") -> None:
    """Append to a table partitioned by day, so retention and audits prune by day.

    Rows are rebalanced by day: adaptive execution gives small days to one task and cuts a large day into as many
    writers as its size asks for.
    """
    dated = df.withColumn("date", F.to_date(at))
    dated.hint("rebalance", "date").write.mode(mode).partitionBy("date").parquet(path)


def write_runs(runs: DataFrame, path: str) -> None:
    write_by_date(runs, path)


def write_shell_events(events: DataFrame, path: str) -> None:
    write_by_date(events, path)


def write_feedback(feedback: DataFrame, path: str) -> None:
    write_by_date(feedback, path)


class DayTable:
    """Rows by day under a manifest of live folders; reading, appending and retention survive a stop at any point.

    Rows of one write stand in a folder of their own, by day. The manifest lists which days of which folders count; it
    has versions, and a new one takes effect at once when it is complete. So a write that stops halfway leaves folders
    that nothing lists, and a repeated one (same ``load``) replaces its folder and adds nothing twice. Folders that the
    manifest does not list go after each change. One writer at a time; the driver handles names of folders and days,
    never rows.
    """

    MANIFEST = "load string, date date"

    def __init__(self, spark: SparkSession, path: str, schema: str, at: str = "created_at"):
        self.spark, self.path, self.schema, self.at = spark, path.rstrip("/"), schema, at
        self.manifest = Versions(spark, f"{self.path}/manifest", self.MANIFEST)

    def _live(self) -> list[tuple[str, str]]:
        return sorted((r["load"], str(r["date"])) for r in self.manifest.before().collect())

    def _commit(self, live: set[tuple[str, str]]) -> None:
        rows = self.spark.createDataFrame(sorted(live), "load string, date string")
        self.manifest.write(rows.select("load", F.col("date").cast("date")).coalesce(1), self._next())
        self._sweep(live)

    def _next(self) -> int:
        number = self.manifest.newest()
        return 0 if number is None else number + 1

    def _sweep(self, live: set[tuple[str, str]]) -> None:
        files = Files(self.spark, f"{self.path}/data")
        for load, date in files.names("load=*/date=*"):
            if (load.split("=", 1)[1], date.split("=", 1)[1]) not in live:
                files.delete(f"{load}/{date}")

    def _put(self, rows: DataFrame, load: str) -> set[tuple[str, str]]:
        """Writes rows by day into a folder of their own; a large day has as many writers as its size asks for."""
        dated = typed(rows, self.schema).withColumn("date", F.to_date(self.at))
        folder = f"{self.path}/data/load={load}"
        dated.hint("rebalance", "date").write.mode("overwrite").partitionBy("date").parquet(folder)
        days = self.spark.read.schema("date date").parquet(folder).distinct().collect()
        return {(load, str(r["date"])) for r in days}

    def append(self, rows: DataFrame, load: str) -> None:
        live = {x for x in self._live() if x[0] != load}
        self._commit(live | self._put(rows, load))

    def read(self) -> DataFrame:
        folders = [f"{self.path}/data/load={load}/date={day}" for load, day in self._live()]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def retain(self, now: str, days: int) -> int:
        """Drops rows older than ``days`` before ``now``; returns how many went. Days that end before the limit leave the
        manifest; of the limit's own day the rows to keep are written again; later days are not looked at."""
        limit = F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
        first_kept = str(self.spark.range(1).select(F.to_date(limit)).first()[0])
        live = set(self._live())
        old = {x for x in live if x[1] < first_kept}
        split = {x for x in live if x[1] == first_kept}
        if not old | split:
            return 0
        touched = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/load={load}/date={day}" for load, day in sorted(old | split)])
        count = touched.where(F.col(self.at) < limit).count()
        if not count:
            return 0
        kept = set()
        if split:
            rest = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/load={load}/date={day}" for load, day in sorted(split)])
            kept = self._put(rest.where(F.col(self.at) >= limit), f"kept-{self._next()}")
        self._commit(live - old - split | kept)
        return count

    def newest(self):
        """The latest time in the table, from its last day; None without rows."""
        live = self._live()
        last = max((day for _, day in live), default=None)
        if last is None:
            return None
        folders = [f"{self.path}/data/load={load}/date={day}" for load, day in live if day == last]
        return self.spark.read.schema(self.schema).parquet(*folders).agg(F.max(self.at).cast("string")).first()[0]


def work_dir(spark: SparkSession) -> str:
    """A fresh folder in the shared folder that spark.checkpoint.dir names. A local session without one gets
    a folder of its own; on a cluster that is an error, as executors would write to their own disks."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.startswith(("spark:", "yarn", "k8s", "local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = shared.rstrip("/") if shared else tempfile.mkdtemp(prefix="promptloom-")
    return f"{base}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows read back from a table in the shared folder.

    For a frame that several later steps need: it is computed once, its lineage is cut, and a lost
    executor costs a re-read instead of a re-run of the text pipeline.
    """
    path = f"{work_dir(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """The file system of a folder, as the driver sees it: names only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self, name: str) -> list[int]:
        """The numbers n of the folders ``name=n`` whose writing was completed, ascending."""
        found = self._files.globStatus(self._path(f"{self.folder}/{name}=*/_SUCCESS")) or []
        return sorted(int(status.getPath().getParent().getName().split("=")[1]) for status in found)

    def names(self, pattern: str) -> list[tuple[str, str]]:
        """The last two names of each path that fits ``pattern``."""
        found = self._files.globStatus(self._path(f"{self.folder}/{pattern}")) or []
        return [(status.getPath().getParent().getName(), status.getPath().getName()) for status in found]

    def delete(self, name: str) -> None:
        self._files.delete(self._path(f"{self.folder}/{name}"), True)


class Versions:
    """A table that each micro-batch writes anew out of the version before: a batch that runs again, after a failure,
    finds the same predecessor and replaces its own output. Two versions stay; a version counts once it is complete."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._files = Files(spark, path)

    def newest(self, before: int | None = None) -> int | None:
        numbers = [n for n in self._files.numbers("v") if before is None or n < before]
        return numbers[-1] if numbers else None

    def before(self, batch: int | None = None) -> DataFrame:
        """The newest version, or the newest older than ``batch``; empty if there is none."""
        number = self.newest(batch)
        if number is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={number}")

    def write(self, df: DataFrame, batch: int) -> None:
        """Replaces version ``batch`` and drops those before its predecessor."""
        df.write.mode("overwrite").parquet(f"{self.path}/v={batch}")
        for n in [n for n in self._files.numbers("v") if n < batch][:-1]:
            self._files.delete(f"v={n}")


def read_parts(spark: SparkSession, path: str, schema: str, name: str = "batch", after: int | None = None) -> DataFrame:
    """The rows of the completed folders ``name=n``, with the column ``name``: those with n above ``after``, or all."""
    numbers = [n for n in Files(spark, path).numbers(name) if after is None or n > after]
    if not numbers:
        return spark.createDataFrame([], f"{schema}, {name} bigint")
    reader = spark.read.schema(f"{schema}, {name} bigint").option("basePath", path)
    return reader.parquet(*[f"{path.rstrip('/')}/{name}={n}" for n in numbers])


class Rollup:
    """An aggregate that grows: partial aggregates of each load, merged when read.

    ``merge`` makes one row per key out of partials of the same schema, in any order and split, so that neither the
    order of loads nor late rows matter and no load reads the history. Load n is a folder that a repeated load
    replaces. ``compact`` folds all loads so far into one base; a base of version n stands for the loads up to n,
    whether or not their folders are gone yet, so stopping anywhere loses and doubles nothing.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.schema, self.merge = spark, path.rstrip("/"), schema, merge
        self.base = Versions(spark, f"{self.path}/base", schema)

    def add(self, partials: DataFrame, load: int) -> None:
        typed(partials, self.schema).write.mode("overwrite").parquet(f"{self.path}/loads/load={load}")

    def read(self) -> DataFrame:
        loads = read_parts(self.spark, f"{self.path}/loads", self.schema, "load", self.base.newest()).drop("load")
        return self.merge(self.base.before().unionByName(loads))

    def compact(self) -> None:
        files = Files(self.spark, f"{self.path}/loads")
        loads, done = files.numbers("load"), self.base.newest()
        if loads and (done is None or loads[-1] > done):
            self.base.write(self.read(), loads[-1])
        for n in loads:
            files.delete(f"load={n}")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_archive(spark: SparkSession, archive: DataFrame, path: str, max_files: int, batch: int) -> None:
    """Adds outputs to a stored archive that holds the ``max_files`` newest: those of the stored version and the new ones
    together, the first by time and id from each task. A new version takes the place of the old one at once."""
    stored_archive = Versions(spark, path, ARCHIVE)
    both = stored_archive.before(batch).unionByName(typed(archive, ARCHIVE))
    stored_archive.write(both.orderBy(F.desc("ts"), F.desc("output_id")).limit(max_files), batch)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    return Versions(spark, path, ARCHIVE).before()
