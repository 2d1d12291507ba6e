"""Shell events: filtering, logging form, and matching of ends to starts."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptloom.functions import rules
from promptloom.functions.regex import any_of, found, java, sub
from promptloom.functions.staging import built_once
from promptloom.functions.text import (
    clip,
    command_pattern,
    estimate_tokens,
    redact,
    strip,
    text_hash,
)
from promptloom.operators.chunks import join_null_safe, with_chunks
from promptloom.operators.optimize import with_classification


def is_observable(command: Column, own_tool: str = rules.OWN_TOOL) -> Column:
    """False for blank commands, calls of the analysing tool itself, and shell-hook noise."""
    noise = [
        f"{own_tool} ", f"command {own_tool} ", f"__{own_tool}_", *rules.HOOK_NOISE,
        f'eval "$({own_tool} shell-hook',
    ]
    bare = strip(command)
    return (bare != "") & ~any_of([bare.startswith(head) for head in noise])


def observable_commands(df: DataFrame, command: str = "command") -> DataFrame:
    return df.where(is_observable(F.col(command)))


def without_prefix(command: Column) -> Column:
    """Command without leading ``sudo`` and ``VAR=value`` words."""
    return sub(strip(command), rules.COMMAND_PREFIX, "")


def _compiles(spark: SparkSession, pattern: str) -> bool:
    """Whether the engine that will run the pattern takes it. Asked of the driver's JVM: no job."""
    try:
        spark._jvm.java.util.regex.Pattern.compile(java(pattern))
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


def _searched(spark: SparkSession, bare: Column, patterns: list[str]) -> Column:
    """Whether one of the ``^...`` rules finds something; a broken one falls back to a prefix test."""
    return any_of([found(bare, p) if _compiles(spark, p) else bare.startswith(p.lstrip("^")) for p in patterns])


def _leading_runs(bare: Column, longest: Column) -> Column:
    """The text itself and every part of it that ends before a blank, up to a length: all that a prefix rule can name."""
    words = F.split(bare, " ", -1)
    lengths = F.transform(words, F.length)
    ends = F.aggregate(
        lengths, F.struct(F.lit(-1).alias("end"), F.array().cast("array<int>").alias("ends")),
        lambda s, n: F.struct(
            (s["end"] + 1 + n).alias("end"),
            F.when(s["end"] + 1 + n <= longest, F.array_append(s["ends"], s["end"] + 1 + n)).otherwise(s["ends"]).alias("ends"),
        ),
        lambda s: s["ends"],
    )
    return F.transform(ends, lambda n: F.substring(bare, F.lit(1), n))


def exclude_commands(df: DataFrame, rules_table: DataFrame, command: str = "command", searched_at_once: int = 100) -> DataFrame:
    """Drop rows whose command a rule names; ``rules_table`` has a column ``pattern``.

    A rule that does not begin with ``^`` names the commands that equal it or go on with a blank behind it. Any number
    of these is one equi-join: the leading runs of words of each distinct command meet the rules. Rules that begin with
    ``^`` are searched for as regular expressions, ``searched_at_once`` of them in one pass over the distinct commands
    that no rule before has named; they are the only ones that come to the driver, a pass at a time. Commands without
    text match no rule. A command that many rows hold is looked at once; rows are then anti-joined by command, which
    skew-join handling can split.
    """
    spark = df.sparkSession
    patterns = rules_table.select("pattern").where("pattern IS NOT NULL").distinct()
    regexes = patterns.where(F.col("pattern").startswith("^"))
    prefixes = patterns.where(~F.col("pattern").startswith("^"))
    named = df.withColumn("_bare", without_prefix(F.col(command)))
    longest = prefixes.agg(F.coalesce(F.max(F.length("pattern")), F.lit(-1))).first()[0]
    commands = named.select("_bare").where("_bare IS NOT NULL").distinct()
    runs = commands.select("_bare", F.explode(_leading_runs(F.col("_bare"), F.lit(longest))).alias("pattern"))
    hits = runs.join(prefixes, "pattern", "left_semi").select("_bare")
    some: list[str] = []
    for row in regexes.orderBy("pattern").toLocalIterator():
        some.append(row["pattern"])
        if len(some) == searched_at_once:
            hits, some = hits.unionByName(commands.where(_searched(spark, F.col("_bare"), some))), []
    if some:
        hits = hits.unionByName(commands.where(_searched(spark, F.col("_bare"), some)))
    return named.join(hits.distinct(), "_bare", "left_anti").select(*df.columns)


def merge_rules(global_rules: DataFrame, project_rules: DataFrame) -> DataFrame:
    """Distinct union of global and project exclusion rules."""
    return global_rules.union(project_rules).distinct()


def log_events(starts: DataFrame, own_tool: str = rules.OWN_TOOL) -> DataFrame:
    """Start rows as stored: observable only, redacted, classified, estimated, shaped."""
    observed = starts.where(is_observable(F.col("command"), own_tool))
    bare = observed.withColumn("_command", strip(F.col("command")))
    redacted = with_classification(bare, "_command", "_class").withColumn(
        "_redacted", redact(F.col("_command"))
    )
    return redacted.select(*built_once("events/stored", _stored_columns))


def _stored_columns() -> list[Column]:
    text = F.col("_redacted")
    return [
        F.sha2(F.concat(F.lit("event:"), F.col("event_seq").cast("string")), 256).alias("event_id"),
        F.col("event_seq"),
        F.col("ts").alias("created_at"),
        F.col("shell"),
        F.col("pid"),
        F.col("cwd"),
        text_hash(text).alias("command_hash"),
        clip(redact(text), rules.PREVIEW_LIMIT).alias("raw_command_preview"),
        F.lit("").alias("optimized_preview"),
        estimate_tokens(text).alias("token_estimate"),
        F.col("_class.input_type").alias("input_type"),
        F.col("_class.risk_level").alias("risk_level"),
        F.lit(False).alias("was_modified"),
        F.lit("started").alias("status"),
        command_pattern(text).alias("command_pattern"),
    ]


def complete_events(events: DataFrame, chunk_seconds: int = 3600, chunk_rows: int = 100_000) -> DataFrame:
    """Close each start with the ``done`` that ends it: per (shell, pid), last open start first.

    This is bracket matching. With +1 per start and -1 per done, the running sum S and its running
    minimum M give every row a nesting level S - M; a done that lowers M has no open start and is
    dropped; at one level starts and dones alternate, so a start's end is the next row there.

    One (shell, pid) may hold a large share of all rows, so no window runs over a whole pid. Rows are cut into chunks in
    time order of about ``chunk_rows`` rows at most, bursts included; chunk totals (few rows) carry sum and minimum from
    chunk to chunk; pairs inside a chunk are found there, and only each chunk's leftovers - at most one start and one
    done per level - are matched across chunks, level by level.
    """
    key = ["shell", "pid"]
    order = [F.col("ts"), F.col("event_seq")]
    rows = events.withColumn("_step", F.when(F.col("kind") == "start", 1).otherwise(-1))
    rows = with_chunks(rows, key, ("ts", "event_seq"), chunk_seconds, chunk_rows)
    in_chunk = Window.partitionBy(*key, "_chunk").orderBy(*order)
    upto = in_chunk.rowsBetween(Window.unboundedPreceding, 0)
    before = in_chunk.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_sum", F.sum("_step").over(upto)).withColumns(
        {"_low": F.min("_sum").over(upto), "_low_before": F.min("_sum").over(before)}
    )

    chunks = local.groupBy(*key, "_chunk").agg(
        F.sum("_step").alias("_net"), F.min("_sum").alias("_min")
    )
    earlier = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        chunks.withColumn("_offset", F.coalesce(F.sum("_net").over(earlier), F.lit(0)))
        .withColumn(
            "_floor",
            F.least(F.lit(0), F.min(F.col("_offset") + F.col("_min")).over(earlier)),
        )
        .select(*key, "_chunk", "_offset", "_floor")
    )

    total = F.col("_offset") + F.col("_sum")
    low = F.least(F.col("_floor"), F.col("_offset") + F.col("_low"))
    low_before = F.least(F.col("_floor"), F.col("_offset") + F.col("_low_before"))
    is_start = F.col("kind") == "start"
    levelled = (
        join_null_safe(local, carried, [*key, "_chunk"])
        .withColumns(
            {
                "_orphan": ~is_start & (low < low_before),
                "_level": total - low + F.when(is_start, 0).otherwise(1),
            }
        )
        .where(~F.col("_orphan"))
        .select(*events.columns, "_chunk", "_level")
    )

    end = F.when(
        F.col("kind") == "done", F.struct(F.col("ts").alias("at"), F.col("exit_code").alias("code"))
    )
    at_level = Window.partitionBy(*key, "_level", "_chunk").orderBy(*order)
    paired = levelled.withColumns(
        {"_end": F.lead(end).over(at_level), "_first": F.row_number().over(at_level) == 1}
    )
    closed = paired.where(is_start & F.col("_end").isNotNull())
    left_over = paired.where(F.when(is_start, F.col("_end").isNull()).otherwise(F.col("_first")))
    across = Window.partitionBy(*key, "_level").orderBy(*order)
    matched = left_over.withColumn("_end", F.lead(end).over(across)).where(is_start)
    return closed.unionByName(matched).select(
        "event_seq",
        "ts",
        *key,
        "cwd",
        "command",
        F.col("_end.at").alias("completed_at"),
        F.col("_end.code").alias("exit_code"),
        F.when(F.col("_end").isNull(), F.lit("started"))
        .otherwise(F.lit("completed"))
        .alias("status"),
    )


def audit(events: DataFrame, risk: str = "high", limit: int = 20) -> DataFrame:
    """Newest events of a risk level."""
    return (
        events.where(F.col("risk_level") == risk)
        .orderBy(F.desc("created_at"), F.desc("event_seq"))
        .limit(limit)
    )


__all__ = [
    "audit", "complete_events", "exclude_commands", "is_observable", "log_events",
    "merge_rules", "observable_commands", "without_prefix",
]
