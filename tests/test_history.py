from pyspark.sql import functions as F

from promptloom.operators import history as h
from promptloom.operators.optimize import optimize

TEXT = "Please please help me fix this issue. " * 8


def runs(spark):
    df = spark.createDataFrame(
        [(1, TEXT, "codex"), (2, TEXT, "llm"), (3, "git status", "llm"), (4, "Short text", "llm")],
        "prompt_id bigint, text string, command_name string",
    ).withColumn("created_at", F.timestamp_seconds(F.col("prompt_id") * 100))
    return h.runs_from(optimize(df))


def feedback(spark, rows):
    return spark.createDataFrame(
        rows, "feedback_id string, prompt_id bigint, sec bigint, rating string, notes string"
    ).select(
        "feedback_id", F.timestamp_seconds("sec").alias("created_at"),
        h.run_key(F.col("prompt_id")).alias("run_id"), "rating", "notes",
    )


def test_patterns_and_feedback(spark):
    all_runs = runs(spark)
    patterns = h.prompt_patterns(all_runs)
    (pattern,) = patterns.collect()
    assert pattern.usage_count == 2 and pattern.pattern_type == "ai_prompt"
    given = feedback(spark, [
        ("a", 1, 500, "good", "useful"), ("b", 2, 600, "bad", ""), ("c", 2, 700, "good", None),
        ("early", 1, 50, "good", ""), ("meh", 1, 500, "meh", ""), ("lost", 99, 500, "good", ""),
        ("cmd", 3, 500, "good", ""),
    ])
    assert [r.feedback_id for r in h.rejected_feedback(given).collect()] == ["meh"]
    valid = h.valid_feedback(given)
    rated = h.runs_to_patterns(h.feedback_to_runs(valid, all_runs), patterns)
    assert {r.feedback_id for r in rated.collect()} == {"a", "b", "c"}
    success = h.pattern_success(rated)
    assert [r.success_score for r in success.collect()] == [0.0]
    bonus = h.history_bonus(patterns, h.pattern_success(rated.where("rating = 'good'")))
    assert [(r.input_type, r.bonus) for r in bonus.collect()] == [("ai_prompt", 2.0)]
    prompts = spark.createDataFrame([("ai_prompt",), ("mixed_input",)], "input_type string")
    got = {r.input_type: r.bonus for r in h.with_history_bonus(prompts, bonus).collect()}
    assert got == {"ai_prompt": 2.0, "mixed_input": 0.0}


def test_bonus_limit(spark):
    patterns = spark.createDataFrame([("p", "t"), ("q", "u")], "pattern_hash string, pattern_type string")
    success = spark.createDataFrame([("p", 99.0), ("q", -99.0)], "pattern_hash string, success_score double")
    got = {r.input_type: r.bonus for r in h.history_bonus(patterns, success).collect()}
    assert got == {"t": 15.0, "u": -15.0}


def test_stats(spark):
    row = h.run_stats(runs(spark)).first()
    assert row.optimization_runs == 4 and row.optimized_runs == 2 and row.total_token_savings > 0
    empty = h.run_stats(runs(spark).limit(0)).first()
    assert tuple(empty) == (0, 0, 0, 0.0)
    row = h.distinct_hashes(runs(spark)).first()
    assert (row.runs, row.distinct_inputs, row.distinct_shapes) == (4, 3, 3)


def test_retention_limit_is_kept(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "sec bigint").select(
        F.timestamp_seconds("sec").alias("created_at")
    )
    now = F.timestamp_seconds(F.lit(1 + 90 * 86400))
    assert h.retain(df, now).count() == 2
    assert h.expired_count(df, now).first().deleted == 1


def test_bonus_as_of_replays_history(spark):
    """Patterns, ratings and prompts one after the other; a prompt sees what came before its instant only."""
    import random

    rng = random.Random(7)
    kinds = ["a", "b"]
    patterns = [(f"p{i}", rng.choice(kinds), rng.randrange(0, 400)) for i in range(30)]
    rated = [(f"f{i}", p, kind, rng.choice(["good", "bad", "bad"]), seen + rng.randrange(0, 200)) for i in range(200) for p, kind, seen in [rng.choice(patterns)]]
    prompts = [(i, rng.choice([*kinds, "c"]), rng.choice([50, 50, rng.randrange(0, 700)])) for i in range(300)]

    def timed(rows, columns):
        return spark.createDataFrame(rows, columns + ", sec bigint").withColumn("sec", F.timestamp_seconds("sec"))

    changes = h.bonus_changes(
        timed(patterns, "pattern_hash string, pattern_type string").withColumnRenamed("sec", "first_seen_at"),
        timed(rated, "feedback_id string, pattern_hash string, pattern_type string, rating string").withColumnRenamed("sec", "created_at"),
    )
    asked = timed(prompts, "prompt_id bigint, input_type string").withColumnRenamed("sec", "created_at")
    got = {r.prompt_id: r.bonus for r in h.with_bonus_as_of(asked, changes).collect()}
    for i, kind, at in prompts:
        known = [p for p, k, seen in patterns if k == kind and seen < at]
        total = sum(1 if rating == "good" else -2 for _, _, k, rating, when in rated if k == kind and when < at)
        assert got[i] == (max(-15, min(15, total / len(known))) if known else 0)
