"""Live shell events: the batch operators in streaming form, and completion in event order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import rules
from promptloom.operators.events import complete_events, log_events
from promptloom.sources.tables import SHELL_EVENTS, DayTable, Rollup, Versions, read_parts, typed

COMPLETED = (
    "event_seq bigint, ts timestamp, shell string, pid int, cwd string, command string, "
    "completed_at timestamp, exit_code int"
)
WAITING = SHELL_EVENTS + ", settled_until bigint, newest bigint"
ARRIVED = (
    "kind string, run_id string, created_at timestamp, feedback_id string, rating string, "
    "pattern_hash string, was_optimized boolean"
)
FIRST_SEEN = "pattern_hash string, first_seen_at timestamp"
RATED = "feedback_id string, created_at timestamp, rating string, pattern_hash string"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def read_event_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(SHELL_EVENTS).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def ingest(events: DataFrame) -> DataFrame:
    """Filter, redact, classify and estimate start events as they arrive. Stateless."""
    return log_events(events.where(F.col("kind") == "start"))


def running_command_patterns(logged: DataFrame) -> DataFrame:
    """Use count and mean token estimate per command shape so far (update or complete mode)."""
    return (
        logged.where(F.col("command_pattern") != "")
        .groupBy("command_pattern")
        .agg(
            F.count(F.lit(1)).alias("usage_count"),
            F.avg("token_estimate").alias("average_token_estimate"),
        )
    )


class Completion:
    """Matching of ends to starts while events arrive in any order, as a ``foreachBatch`` step.

    Events wait until the newest time seen lies ``delay_seconds`` behind them; then their order is settled, and
    :func:`complete_events` runs over them and the starts still open - as Spark jobs in chunks, whatever share of the
    events one (shell, pid) has. What it closes is final, for a stack's pops depend on earlier events alone. Under
    ``root`` stand a table of what waits (open starts, and events of the last ``delay_seconds``), one of what came out
    and one of what came too late: an event that is older than a settled time would change decided pairs. Each batch
    writes them from the version before and replaces its own output when it runs again.

    Starts older than ``history_days`` at the settled time are dropped, as stored history is.
    """

    def __init__(self, spark: SparkSession, root: str, delay_seconds: float, history_days: int = rules.HISTORY_DAYS):
        self.spark, self.root, self.history_days = spark, root.rstrip("/"), history_days
        self.delay = int(delay_seconds * 1_000_000)
        self.waiting = Versions(spark, f"{self.root}/waiting", WAITING)

    def __call__(self, batch: DataFrame, number: int) -> None:
        self._settle(typed(batch, SHELL_EVENTS), number, self.delay)

    def finish(self, number: int = 1 << 40) -> None:
        """Settles all that waits, at the end of a stream that will not go on."""
        self._settle(self.spark.createDataFrame([], SHELL_EVENTS), number, -1)

    def _settle(self, arrived: DataFrame, number: int, delay: int) -> None:
        at = F.unix_micros("ts")
        held = self.waiting.before(number)
        # up to `mark` pairs are decided; `newest` is the latest time of all events so far
        mark, newest = held.agg(F.max("settled_until"), F.max("newest")).first()
        held = held.where("event_seq IS NOT NULL").select(*_names(SHELL_EVENTS))
        late = F.lit(False) if mark is None else at < mark
        latest, missed = arrived.agg(F.max(at), F.count_if(late)).first()
        if missed:
            self._append(arrived.where(late), "late", number)
        if latest is None and newest is None:
            return  # nothing has come yet
        newest = max(x for x in (newest, latest) if x is not None)
        until = max(newest - delay, mark or 0)
        events = held.unionByName(arrived.where(~late))
        kept = events.where(at >= until)
        if until != mark:
            pairs = complete_events(events.where(at < until)).persist()
            self._append(pairs.where("status = 'completed'").select(*_names(COMPLETED)), "out", number)
            still = pairs.where((F.col("status") == "started") & (at >= until - self.history_days * 86_400_000_000))
            still = still.select("event_seq", "ts", F.lit("start").alias("kind"), "shell", "pid", "cwd", "command", "exit_code")
            kept = still.unionByName(kept)
        else:  # no further time is settled: what was decided before stays so
            kept = events
        marked = self.spark.createDataFrame([(None,) * len(_names(SHELL_EVENTS))], SHELL_EVENTS)  # keeps the times if nothing waits
        times = {"settled_until": F.lit(until).cast("long"), "newest": F.lit(newest).cast("long")}
        self.waiting.write(kept.unionByName(marked).withColumns(times), number)
        if until != mark:
            pairs.unpersist()

    def _append(self, rows: DataFrame, table: str, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={number}")

    def completed(self) -> DataFrame:
        """The starts that were closed so far, with their ends."""
        return self._written("out", COMPLETED)

    def late(self) -> DataFrame:
        """Events that came after their time had been settled."""
        return self._written("late", SHELL_EVENTS)

    def _written(self, table: str, schema: str) -> DataFrame:
        return read_parts(self.spark, f"{self.root}/{table}", schema).drop("batch")


def read_within_history(events: DataFrame, history_days: int = rules.HISTORY_DAYS) -> DataFrame:
    """Events under a watermark of ``history_days``: later ones, and old state, are dropped."""
    return events.withWatermark("ts", f"{history_days} days")


class Retention:
    """As a ``foreachBatch`` step: stores what arrives in a day table, then drops what is older than ``days`` before the
    newest time there. A batch that runs again replaces what it stored; rows that come too late go with the next batch."""

    def __init__(self, table: DayTable, days: int = rules.HISTORY_DAYS):
        self.table, self.days = table, days

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.table.append(batch, f"batch-{number}")
        newest = self.table.newest()
        if newest is not None:
            self.table.retain(newest, self.days)


class Mining:
    """As a ``foreachBatch`` step: adds what a batch's rows say about patterns to a rollup, and folds the rollup's loads
    together now and then. Late rows count like others, in any order of batches."""

    def __init__(self, rollup: Rollup, partials: Callable[[DataFrame], DataFrame], compact_every: int = 32):
        self.rollup, self.partials, self.compact_every = rollup, partials, compact_every

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.rollup.add(self.partials(batch), number)
        if number % self.compact_every == self.compact_every - 1:
            self.rollup.compact()


def rate_stream(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """Feedback and runs as one stream, for :class:`Rating`: the streaming form of joining feedback to runs and patterns.

    No watermark: rows of any time, in any order, take part.
    """
    given = feedback.select(F.lit("feedback").alias("kind"), "run_id", "created_at", "feedback_id", "rating")
    known = runs.select(F.lit("run").alias("kind"), "run_id", "created_at", "pattern_hash", "was_optimized")
    return given.unionByName(known, allowMissingColumns=True)


class Rating:
    """Feedback that reached a pattern, as it comes in: a ``foreachBatch`` step over :func:`rate_stream`.

    Feedback meets the runs of its id, and then any optimized run of the same shape that came no later than itself: that
    is what it takes for the pattern to exist, and the shape's hash holds the type. Each may arrive before the other by
    any time, so nothing expires. Under ``root`` stand what arrived, the first time of each shape, the feedback that met
    its run and waits for its pattern, and what came out. Each pair of feedback and run is found once, by the batch that
    brings the later of the two; a shape's first time only moves back, so what came out stays right. A batch that runs
    again finds what stood before it and replaces its own output. The joins are Spark jobs in the session's own
    settings, so adaptive execution may split the feedback of a popular run or shape over tasks.
    """

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 32):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every
        self.shapes = Rollup(spark, f"{self.root}/shapes", FIRST_SEEN, self._merge)
        self.waiting = Versions(spark, f"{self.root}/waiting", RATED)

    @staticmethod
    def _merge(partials: DataFrame) -> DataFrame:
        return partials.groupBy("pattern_hash").agg(F.min("first_seen_at").alias("first_seen_at"))

    def __call__(self, batch: DataFrame, number: int) -> None:
        typed(batch, ARRIVED).write.mode("overwrite").partitionBy("kind").parquet(f"{self.root}/arrived/batch={number}")
        arrived = read_parts(self.spark, f"{self.root}/arrived", ARRIVED).where(F.col("batch") <= number)
        given = arrived.where("kind = 'feedback' AND run_id IS NOT NULL AND created_at IS NOT NULL").select(
            "run_id", "feedback_id", "created_at", "rating", "batch"
        )
        known = arrived.where("kind = 'run' AND pattern_hash IS NOT NULL")
        seen = known.where((F.col("batch") == number) & F.col("was_optimized") & F.col("created_at").isNotNull())
        self.shapes.add(self._merge(seen.withColumnRenamed("created_at", "first_seen_at")), number)
        known = known.where("run_id IS NOT NULL").select("run_id", "pattern_hash", "batch")
        new, old = F.col("batch") == number, F.col("batch") < number
        met = given.where(new).join(known.drop("batch"), "run_id").unionByName(given.where(old).join(known.where(new).drop("batch"), "run_id"))
        pairs = self.waiting.before(number).unionByName(met.select(*_names(RATED)))
        reached = F.coalesce(F.col("first_seen_at") <= F.col("created_at"), F.lit(False))
        pairs = pairs.join(self.shapes.read(), "pattern_hash", "left").select(*_names(RATED), reached.alias("reached")).persist()
        pairs.where("reached").drop("reached").write.mode("overwrite").parquet(f"{self.root}/out/batch={number}")
        self.waiting.write(pairs.where("NOT reached").drop("reached"), number)
        pairs.unpersist()
        if number % self.compact_every == self.compact_every - 1:
            self.shapes.compact()

    def rated(self) -> DataFrame:
        """The feedback that reached a pattern so far."""
        return read_parts(self.spark, f"{self.root}/out", RATED).drop("batch")


class LateRows:
    """As a ``foreachBatch`` step: keeps the rows that are older than the watermark which the batches before have set,
    ``delay_seconds`` behind their newest time."""

    def __init__(self, spark: SparkSession, root: str, schema: str, at: str, delay_seconds: float):
        self.spark, self.root, self.schema, self.at = spark, root.rstrip("/"), schema, at
        self.delay = int(delay_seconds * 1_000_000)
        self.marks = Versions(spark, f"{self.root}/marks", "newest bigint")

    def __call__(self, batch: DataFrame, number: int) -> None:
        at = F.unix_micros(self.at)
        newest = self.marks.before(number).agg(F.max("newest")).first()[0]
        rows = typed(batch, self.schema)
        if newest is not None:
            rows.where(at < newest - self.delay).write.mode("overwrite").parquet(f"{self.root}/late/batch={number}")
        latest = rows.agg(F.max(at)).first()[0]
        known = [x for x in (newest, latest) if x is not None]
        self.marks.write(self.spark.createDataFrame([(max(known, default=None),)], "newest bigint"), number)

    def read(self) -> DataFrame:
        return read_parts(self.spark, f"{self.root}/late", self.schema).drop("batch")
