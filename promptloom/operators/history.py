"""History of runs and events: stored forms, mined patterns, feedback, statistics, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import rules
from promptloom.functions.staging import evaluate_here
from promptloom.functions.text import (
    clip,
    command_name,
    prompt_pattern_hash,
    redact,
    text_hash,
)
from promptloom.operators.chunks import running_totals


def run_key(prompt_id: Column) -> Column:
    """Deterministic run id, so that a job can be run again without new keys."""
    return F.sha2(F.concat(F.lit("run:"), prompt_id.cast("string")), 256)


def runs_from(results: DataFrame, text: str = "text") -> DataFrame:
    """Optimizer results in stored form: secrets out, hashed, previewed, with the shape hash."""
    prepared = results.withColumns(
        {
            "_input": evaluate_here(redact(F.col(text))),
            "_output": evaluate_here(redact(F.col("optimized_text"))),
        }
    )
    return prepared.select(
        run_key(F.col("prompt_id")).alias("run_id"),
        "created_at",
        text_hash(F.col("_input")).alias("input_hash"),
        clip(redact(F.col("_input")), rules.PREVIEW_LIMIT).alias("input_preview"),
        clip(redact(F.col("_output")), rules.PREVIEW_LIMIT).alias("optimized_preview"),
        "input_token_estimate",
        "optimized_token_estimate",
        "token_savings",
        "token_savings_percent",
        "input_type",
        "risk_level",
        "command_name",
        "was_optimized",
        "status",
        prompt_pattern_hash(F.col("input_type"), F.col("_input")).alias("pattern_hash"),
    )


PROMPT_PARTIALS = (
    "pattern_hash string, uses bigint, savings double, first struct<created_at:timestamp,run_id:string,input_type:string>, "
    "last struct<created_at:timestamp,run_id:string,original:string,optimized:string>"
)
COMMAND_PARTIALS = "command_pattern string, uses bigint, tokens bigint, last_seen_at timestamp"
SUCCESS_PARTIALS = "pattern_hash string, success double"


def prompt_partials(runs: DataFrame) -> DataFrame:
    """What a set of runs adds to its prompt shapes, in a form that can be merged (PROMPT_PARTIALS).

    All aggregates combine partially before the shuffle, so a shape that holds a third of all runs costs one row per
    task. Previews are cut to the pattern limit before the aggregation sorts them, and only each task's newest travel.
    """
    limit = rules.PATTERN_PREVIEW_LIMIT
    short = runs.where("was_optimized").select(
        "pattern_hash", "token_savings_percent", "input_type", "run_id", "created_at",
        evaluate_here(clip(F.col("input_preview"), limit)).alias("original"),
        evaluate_here(clip(F.col("optimized_preview"), limit)).alias("optimized"),
    )
    return short.groupBy("pattern_hash").agg(
        F.count(F.lit(1)).alias("uses"),
        F.sum("token_savings_percent").alias("savings"),
        F.min(F.struct("created_at", "run_id", "input_type")).alias("first"),
        F.max_by(F.struct("created_at", "run_id", "original", "optimized"), F.struct("created_at", "run_id")).alias("last"),
    )


def merge_prompt_partials(partials: DataFrame) -> DataFrame:
    """One row per shape, whatever the split and order of the partials."""
    newest = F.struct("last.created_at", "last.run_id")
    return partials.groupBy("pattern_hash").agg(
        F.sum("uses").alias("uses"), F.sum("savings").alias("savings"), F.min("first").alias("first"), F.max_by("last", newest).alias("last")
    )


def patterns_of(partials: DataFrame) -> DataFrame:
    """Prompt shapes out of one partial each."""
    return partials.select(
        "pattern_hash",
        F.col("first.input_type").alias("pattern_type"),
        F.col("last.original").alias("original_pattern_preview"),
        F.col("last.optimized").alias("optimized_pattern_preview"),
        F.col("uses").alias("usage_count"),
        (F.col("savings") / F.col("uses")).alias("average_savings_percent"),
        F.col("first.run_id").alias("first_run_id"),
        F.col("first.created_at").alias("first_seen_at"),
    )


def prompt_patterns(runs: DataFrame) -> DataFrame:
    """Prompt shapes of the optimized runs: use count, mean saving, type and id of the first, previews of the last."""
    return patterns_of(prompt_partials(runs))


def command_partials(events: DataFrame) -> DataFrame:
    """What a set of logged events adds to its command shapes, mergeable (COMMAND_PARTIALS)."""
    return events.where(F.col("command_pattern") != "").groupBy("command_pattern").agg(
        F.count(F.lit(1)).alias("uses"), F.sum("token_estimate").alias("tokens"), F.max("created_at").alias("last_seen_at")
    )


def merge_command_partials(partials: DataFrame) -> DataFrame:
    return partials.groupBy("command_pattern").agg(
        F.sum("uses").alias("uses"), F.sum("tokens").alias("tokens"), F.max("last_seen_at").alias("last_seen_at")
    )


def commands_of(partials: DataFrame) -> DataFrame:
    """Command shapes out of one partial each."""
    return partials.select(
        text_hash(F.col("command_pattern")).alias("pattern_hash"),
        "command_pattern",
        command_name(F.col("command_pattern")).alias("command_name"),
        F.col("uses").alias("usage_count"),
        (F.col("tokens") / F.col("uses")).alias("average_token_estimate"),
        "last_seen_at",
    )


def command_patterns(events: DataFrame) -> DataFrame:
    """Command shapes: use count, mean token estimate, last use."""
    return commands_of(command_partials(events))


def merge_success_partials(partials: DataFrame) -> DataFrame:
    """Sums of rating deltas per pattern (SUCCESS_PARTIALS) out of those of several loads of feedback."""
    return partials.groupBy("pattern_hash").agg(F.sum("success").alias("success"))


def top_commands(patterns: DataFrame, n: int = rules.TOP_COMMANDS) -> DataFrame:
    return patterns.orderBy(F.desc("usage_count"), "command_name", "pattern_hash").limit(n)


# --- feedback ---------------------------------------------------------------------------------

def is_valid_rating() -> Column:
    return F.col("rating").isin(list(rules.RATING_DELTA))


def valid_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback rows that may be stored, notes redacted and cut."""
    return feedback.where(is_valid_rating()).withColumn(
        "notes", clip(redact(F.coalesce("notes", F.lit(""))), rules.NOTES_PREVIEW_LIMIT)
    )


def rejected_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.where(~F.coalesce(is_valid_rating(), F.lit(False)))


def feedback_to_runs(feedback: DataFrame, runs: DataFrame) -> DataFrame:
    """Feedback with its run's type and shape hash, null where the run is unknown.

    Runs are unique by id, so adaptive execution may split the feedback of a popular run over tasks.
    Feedback without a run id does not take part in the join: it would all land in one task.
    """
    slim = runs.select("run_id", "input_type", "pattern_hash")
    nothing = [F.lit(None).cast(slim.schema[c].dataType).alias(c) for c in ("input_type", "pattern_hash")]
    joined = feedback.where("run_id IS NOT NULL").join(slim, "run_id", "left").select(*feedback.columns, *slim.columns[1:])
    return joined.unionByName(feedback.where("run_id IS NULL").select("*", *nothing))


def runs_to_patterns(rated: DataFrame, patterns: DataFrame) -> DataFrame:
    """Rated runs with the pattern of their shape, if it existed when the feedback came."""
    known = patterns.select("pattern_hash", "pattern_type", "first_seen_at")
    return rated.where(F.col("pattern_hash").isNotNull()).join(known, "pattern_hash").where(
        F.col("first_seen_at") <= F.col("created_at")
    )


def rating_delta() -> Column:
    return F.when(F.col("rating") == "good", rules.RATING_DELTA["good"]).otherwise(rules.RATING_DELTA["bad"])


def pattern_success(rated_patterns: DataFrame) -> DataFrame:
    """Sum of the rating deltas per pattern."""
    return rated_patterns.groupBy("pattern_hash").agg(F.sum(rating_delta()).alias("success_score"))


def history_bonus(patterns: DataFrame, success: DataFrame) -> DataFrame:
    """Mean success per input type, within the bonus limit. Unrated patterns count as 0."""
    scored = patterns.select("pattern_hash", "pattern_type").join(success, "pattern_hash", "left")
    mean = F.avg(F.coalesce("success_score", F.lit(0.0)))
    limit = F.lit(rules.BONUS_LIMIT)
    return scored.groupBy(F.col("pattern_type").alias("input_type")).agg(
        F.greatest(-limit, F.least(limit, mean)).alias("bonus")
    )


def with_history_bonus(prompts: DataFrame, bonus: DataFrame) -> DataFrame:
    """Look up the bonus of each row's input type; 0 where there is no history.

    The bonus table has one row per input type, a fixed set of at most eight values, so it is
    always small enough to broadcast.
    """
    joined = prompts.join(F.broadcast(bonus), "input_type", "left")
    return joined.withColumn("bonus", F.coalesce("bonus", F.lit(0.0)))


def bonus_changes(patterns: DataFrame, rated_patterns: DataFrame) -> DataFrame:
    """What moves an input type's bonus, and when: a new pattern (it counts, and has no success yet), and a rating. Both
    are summed per type and time before they go anywhere, so a popular instant is one row."""
    new = patterns.select(F.col("pattern_type").alias("input_type"), F.col("first_seen_at").alias("at"), F.lit(1).alias("patterns"), F.lit(0.0).alias("success"))
    ratings = rated_patterns.select(F.col("pattern_type").alias("input_type"), F.col("created_at").alias("at"), F.lit(0).alias("patterns"), rating_delta().alias("success"))
    return new.unionByName(ratings).groupBy("input_type", "at").agg(F.sum("patterns").alias("patterns"), F.sum("success").alias("success"))


def with_bonus_as_of(prompts: DataFrame, changes: DataFrame, key: str = "prompt_id", at: str = "created_at") -> DataFrame:
    """Each prompt's ``bonus`` as it stood when the prompt came: mean success of the patterns of its type that existed
    before then, by the ratings given before then, within the bonus limit; 0 without history.

    Prompts and changes are one history per type, in time order, changes of an instant behind its prompts; what a prompt
    gets are the running totals at its place. A type may hold most prompts: the history is cut into chunks, and only
    narrow rows go through it; the prompts are joined back by their key, which must be unique.
    """
    # below zero for prompts: behind no change of their instant; distinct, so that a crowd at one instant can be cut
    number = -1 - F.pmod(F.xxhash64(key), F.lit(1 << 62))
    none = F.lit(None)
    asked = prompts.select("input_type", F.col(at).alias("at"), number.alias("number"), F.col(key), none.cast("long").alias("patterns"), none.cast("double").alias("success"))
    given = changes.select("input_type", "at", F.lit(1).cast("long").alias("number"), none.cast(asked.schema[key].dataType).alias(key), "patterns", "success")
    history = running_totals(asked.unionByName(given), ["input_type"], ("at", "number"), ["patterns", "success"])
    limit = F.lit(rules.BONUS_LIMIT)
    mean = F.when(F.col("running_patterns") > 0, F.col("running_success") / F.col("running_patterns")).otherwise(F.lit(0.0))
    known = history.where(F.col("number") < 0).select(key, F.greatest(-limit, F.least(limit, mean)).alias("bonus"))
    return prompts.join(known, key)


# --- statistics and retention -----------------------------------------------------------------

def run_stats(runs: DataFrame) -> DataFrame:
    return runs.agg(
        F.count(F.lit(1)).alias("optimization_runs"),
        F.coalesce(F.sum(F.col("was_optimized").cast("int")), F.lit(0)).alias("optimized_runs"),
        F.coalesce(F.sum("token_savings"), F.lit(0)).alias("total_token_savings"),
        F.coalesce(F.avg("token_savings_percent"), F.lit(0.0)).alias("avg_savings_percent"),
    )


def event_stats(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("shell_events"),
        F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("observed_token_estimate"),
        F.count_if(F.col("risk_level") == "high").alias("high_risk_events"),
    )


def distinct_hashes(runs: DataFrame) -> DataFrame:
    """How far equal inputs and equal shapes collapse.

    Distinct counts run as grouped counts: equal hashes merge before they are shuffled.
    """
    none = F.lit(0).cast("bigint")
    inputs = runs.groupBy("input_hash").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), none).alias("runs"),
        F.count(F.lit(1)).alias("distinct_inputs"),
        none.alias("distinct_shapes"),
    )
    shapes = runs.select("pattern_hash").distinct().agg(
        none.alias("runs"), none.alias("distinct_inputs"),
        F.count(F.lit(1)).alias("distinct_shapes"),
    )
    totals = ["runs", "distinct_inputs", "distinct_shapes"]
    return inputs.unionAll(shapes).agg(*[F.sum(c).alias(c) for c in totals])


def retain(df: DataFrame, now: Column, days: int = rules.HISTORY_DAYS, at: str = "created_at"):
    """Rows not older than ``days``: exactly the limit stays."""
    return df.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days)))


def expired_count(df: DataFrame, now: Column, days: int = rules.HISTORY_DAYS, at: str = "created_at"):
    return df.agg(
        F.count_if(F.col(at) < now - F.make_dt_interval(days=F.lit(days))).alias("deleted")
    )
