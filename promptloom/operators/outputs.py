"""Tool outputs: condensing, savings report and failure archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.functions import outputs as o
from promptloom.functions import rules
from promptloom.functions.staging import built_once, evaluate_here
from promptloom.functions.text import line_count


def condense(df: DataFrame, limits: rules.OutputLimits = o.LIMITS) -> DataFrame:
    """Add ``route`` and ``condensed`` to a table of tool outputs (column ``output``)."""
    routed = df.withColumn("route", o.route(F.col("command_name"), F.col("args")))
    expression = built_once(
        "condense",
        lambda: evaluate_here(
            o.condensed(F.col("route"), F.col("args"), F.col("output"), F.col("exit_code"), limits)
        ),
        limits,
    )
    return routed.withColumn("condensed", expression)


def output_savings(df: DataFrame) -> DataFrame:
    """Raw and condensed line counts and the saved percentage, per command and in total."""
    counted = condense(df).select(
        "command_name",
        line_count(F.col("output")).alias("raw"),
        line_count(F.col("condensed")).alias("kept"),
    )
    per_command = counted.groupBy("command_name").agg(
        F.sum("raw").alias("raw_lines"), F.sum("kept").alias("condensed_lines")
    )
    # The total row comes from the small per-command result: rolling up the counted rows instead
    # would double them before the shuffle.
    both = per_command.rollup("command_name").agg(
        F.sum("raw_lines").alias("raw_lines"), F.sum("condensed_lines").alias("condensed_lines")
    )
    saved = F.col("raw_lines") - F.col("condensed_lines")
    return both.select(
        F.coalesce("command_name", F.lit("TOTAL")).alias("command_name"),
        "raw_lines",
        "condensed_lines",
        F.when(F.col("raw_lines") > 0, (saved * 100 / F.col("raw_lines")).cast("bigint"))
        .otherwise(F.lit(0))
        .alias("saved_percent"),
    )


def archive_failures(
    df: DataFrame, mode: str = "failures", max_files: int = rules.ARCHIVE_MAX_FILES
) -> DataFrame:
    """The newest full outputs worth keeping: long enough, and failed unless mode is 'always'.

    Only ids and times are ranked; the winning rows' texts are fetched by a join on the id, so the
    ranking never moves the (up to 1 MiB) texts.
    """
    if mode == "never":
        wanted = df.limit(0)
    else:
        wanted = df.where(F.length("output") >= rules.ARCHIVE_MIN_CHARS)
        if mode == "failures":
            wanted = wanted.where(F.col("exit_code") != 0)
    newest = (
        wanted.select("output_id", "ts").orderBy(F.desc("ts"), F.desc("output_id")).limit(max_files)
    )
    kept = wanted.join(F.broadcast(newest.select("output_id")), "output_id", "left_semi")
    return kept.select(
        "output_id",
        "ts",
        o.archive_name(F.col("command_name")).alias("file_stem"),
        o.archive_text(F.col("output")).alias("content"),
    )
