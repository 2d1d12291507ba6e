"""The per-row prompt compression pipeline over a table of prompts.

One narrow pass: no shuffle, no Python worker. Each stage is a column of its own, so that Catalyst
keeps the stages as separate projections instead of copying long regex chains into every use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import compress, rules
from promptloom.functions.classify import classify
from promptloom.functions.regex import let
from promptloom.functions.staging import built_once, evaluate_here
from promptloom.functions.text import (
    estimate_tokens,
    fences,
    first_where,
    protect_fences,
    restore_fences,
    savings,
    savings_percent,
    strip,
)

RESULT_FIELDS = [
    "optimized_text", "was_optimized", "reason", "optimization_score", "semantic_risk_penalty",
    "optimized_token_estimate", "token_savings", "token_savings_percent", "status",
]


def _fact_columns(text: Column) -> dict[str, Column]:
    """Everything about the input that does not depend on the level."""
    go = F.col("_class.should_optimize")
    return {
        "_masked": F.when(go, protect_fences(text)),
        "_fences": F.when(go, fences(text)),
        "_facts": F.when(go, compress.risk_facts(text)),
        "_task": F.when(go, compress.derive_task(F.col("_class.input_type"), text)),
        "_constraints": F.when(go, compress.extract_constraints(text)),
    }


def _phrase_stages(level: str) -> list[dict[str, Column]]:
    """Filler phrases level by level: each starts from the text of the level below."""
    stages, previous, source = [], None, "_masked"
    for lv in rules.LEVELS[: rules.LEVELS.index(level) + 1]:
        stages.append(
            {f"_phrased_{lv}": compress.drop_filler_phrases(F.col(source), lv, previous)}
        )
        previous, source = lv, f"_phrased_{lv}"
    return stages


def _compact_stages(level: str) -> list[dict[str, Column]]:
    """The compaction steps of one level, one stage per step."""

    def log_step(text: Column, _: str) -> Column:
        wanted = F.col("_class.input_type").isin(rules.LOG_TYPES)
        return let(text, lambda t: F.when(wanted, compress.compress_log(t)).otherwise(t))

    def restore(text: Column, _: str) -> Column:
        return strip(restore_fences(text, F.col("_fences")))

    name = f"_compact_{level}"
    steps = [*compress.COMPACT_STEPS, log_step, restore]
    first = {name: F.col(f"_phrased_{level}")}
    return [first, *({name: step(F.col(name), level)} for step in steps)]


def _scored(candidates: Column, level: str, bonus: Column) -> Column:
    """Non-empty candidates with token count, penalty and score."""
    before = F.col("input_token_estimate")

    def score(text: Column) -> Column:
        def with_tokens(tokens: Column) -> Column:
            penalty = compress.risk_penalty_of(F.col("_facts"), text, level)
            return let(
                penalty,
                lambda p: F.struct(
                    text.alias("text"),
                    tokens.alias("tokens"),
                    p.cast("double").alias("penalty"),
                    compress.optimization_score(savings_percent(before, tokens), p, bonus)
                    .cast("double")
                    .alias("score"),
                ),
            )

        return let(estimate_tokens(text), with_tokens)

    stripped = F.filter(F.transform(candidates, strip), lambda t: t != "")
    return F.transform(stripped, score)


def _choose_first(scored: Column, gate: float) -> Column:
    """The first shorter candidate whose score reaches the gate."""
    shorter = F.filter(scored, lambda c: c["tokens"] < F.col("input_token_estimate"))

    def pick(valid: Column) -> Column:
        return let(
            first_where(valid, lambda c: c["score"] >= F.lit(gate)),
            lambda won: F.struct(
                won.alias("won"),
                F.when(won.isNotNull(), won["score"])
                .otherwise(F.coalesce(F.array_max(F.transform(valid, lambda c: c["score"])), F.lit(0.0)))
                .alias("score"),
                F.when(won.isNotNull(), F.lit(rules.REASON_COMPRESSED))
                .when(F.size(valid) > 0, F.lit(rules.REASON_REJECTED))
                .otherwise(F.lit(rules.REASON_NO_GAIN))
                .alias("reason"),
                won["penalty"].alias("penalty"),
            ),
        )

    return let(shorter, pick)


def _choose_best(scored: Column, gate: float) -> Column:
    """The candidate with the highest score, earlier wins ties; it must still save tokens."""
    ranked = F.transform(
        scored, lambda c, i: F.struct(c["score"].alias("s"), (-i).alias("neg"), c.alias("c"))
    )

    def pick(best: Column) -> Column:
        accepted = (best["tokens"] < F.col("input_token_estimate")) & (best["score"] >= F.lit(gate))
        return F.struct(
            F.when(accepted, best).alias("won"),
            F.coalesce(best["score"], F.lit(0.0)).alias("score"),
            F.when(best.isNull(), F.col("_class.reason"))
            .when(accepted, F.lit(rules.REASON_COMPRESSED))
            .otherwise(F.lit(rules.REASON_REJECTED_BEST))
            .alias("reason"),
            best["penalty"].alias("penalty"),
        )

    return let(F.array_max(ranked)["c"], pick)


def _result(text: Column, chosen: Column, pick: str) -> Column:
    go = F.col("_class.should_optimize")
    before = F.col("input_token_estimate")
    high_risk = (F.col("_class.input_type") == "dangerous_command") & (
        F.col("_class.risk_level") == "high"
    )
    won = chosen["won"]
    after = F.coalesce(won["tokens"], before)
    clamp = pick == "best"
    if pick == "best":
        status = F.when(won.isNotNull(), F.lit("ok")).otherwise(F.lit("preserved"))
    else:
        status = F.when(high_risk, F.lit("high_risk_unmodified")).otherwise(F.lit("ok"))
    return F.struct(
        F.coalesce(won["text"], text).alias("optimized_text"),
        won.isNotNull().alias("was_optimized"),
        F.when(go, chosen["reason"]).otherwise(F.col("_class.reason")).alias("reason"),
        F.coalesce(chosen["score"], F.lit(0.0)).alias("optimization_score"),
        chosen["penalty"].alias("semantic_risk_penalty"),
        after.alias("optimized_token_estimate"),
        savings(before, after, clamp).alias("token_savings"),
        savings_percent(before, after, clamp).alias("token_savings_percent"),
        status.alias("status"),
    )


def _builder(text: str, classifier):
    return lambda part, make: built_once(f"optimize/{part}/{text}", make, classifier)


def _staged(df: DataFrame, text: str, levels: tuple[str, ...], classifier) -> DataFrame:
    """Classification, facts and the compact form of each level, as columns."""
    body, build = F.col(text), _builder(text, classifier)
    staged = df.withColumn("_class", build("class", lambda: evaluate_here(classifier(body))))
    staged = staged.withColumn(
        "input_token_estimate", build("tokens", lambda: estimate_tokens(body))
    )
    staged = staged.withColumns(build("facts", lambda: _fact_columns(body)))
    highest = max(levels, key=rules.LEVELS.index)
    for stage in build(f"phrases/{highest}", lambda: _phrase_stages(highest)):
        staged = staged.withColumns(stage)
    for same_step in zip(*[build(f"compact/{lv}", lambda: _compact_stages(lv)) for lv in levels]):
        staged = staged.withColumns({k: v for stage in same_step for k, v in stage.items()})
    return staged


def compact(df: DataFrame, level: str = "conservative", text: str = "text") -> DataFrame:
    """Add the compact form of every text that may be compressed (null for commands)."""
    staged = _staged(df, text, (level,), classify)
    return staged.select(*df.columns, F.col(f"_compact_{level}").alias("compact"))


def with_level_results(
    df: DataFrame,
    text: str = "text",
    levels: tuple[str, ...] = ("conservative",),
    min_score: float | None = None,
    pick: str = "first",
    bonus: str | None = None,
    extra_candidates: str | None = None,
    classifier=classify,
) -> DataFrame:
    """Add one result struct per level (``result_<level>``) plus the classification columns.

    The levels share the classification, the protected text and the filler phrases of the lower
    levels, so three levels cost far less than three runs.

    pick='first': the structured form, then the compact form, then ``extra_candidates``; the first
    that is shorter and scores at least the gate wins. pick='best': highest score wins, no bonus.
    """
    if min_score is None:
        min_score = 0.0 if pick == "first" else rules.MIN_SAVINGS_PERCENT
    columns = df.columns
    body = F.col(text)
    staged = _staged(df, text, levels, classifier)
    build = _builder(text, classifier)
    staged = staged.withColumns(
        {
            f"_structured_{lv}": build(
                f"structured/{lv}",
                lambda: compress.structured_prompt(
                    F.col("_class.input_type"), F.col("_task"), F.col("_constraints"),
                    F.col(f"_compact_{lv}"), lv,
                ),
            )
            for lv in levels
        }
    )
    bonus_col = F.lit(0.0) if bonus is None or pick == "best" else F.col(bonus)

    def choose_for(lv: str) -> Column:
        compact, structured = F.col(f"_compact_{lv}"), F.col(f"_structured_{lv}")
        ordered = [structured, compact] if pick == "first" else [compact, structured]
        candidates = F.array(*ordered)
        if extra_candidates and pick == "first" and lv != "conservative":
            extra = F.coalesce(F.col(extra_candidates), F.array().cast("array<string>"))
            candidates = F.concat(candidates, extra)
        gate = compress.effective_gate(lv, min_score)
        choose = _choose_first if pick == "first" else _choose_best
        won = let(_scored(candidates, lv, bonus_col), lambda scored: choose(scored, gate))
        return evaluate_here(F.when(F.col("_class.should_optimize"), won))

    staged = staged.withColumns(
        {
            f"_chosen_{lv}": build(
                f"chosen/{lv}/{pick}/{min_score}/{bonus}/{extra_candidates}",
                lambda: choose_for(lv),
            )
            for lv in levels
        }
    )
    return staged.select(
        *columns,
        F.col("_class.input_type").alias("input_type"),
        F.col("_class.risk_level").alias("risk_level"),
        "input_token_estimate",
        *[
            build(
                f"result/{lv}/{pick}",
                lambda: _result(body, F.col(f"_chosen_{lv}"), pick).alias(f"result_{lv}"),
            )
            for lv in levels
        ],
    )


def optimize(df: DataFrame, level: str = "conservative", **options) -> DataFrame:
    """One row per prompt with the compressed text, token counts, score and status."""
    out = with_level_results(df, levels=(level,), **options)
    keep = [c for c in out.columns if not c.startswith("result_")]
    return out.select(*keep, F.col(f"result_{level}.*"))


def optimize_levels(df: DataFrame, levels: tuple[str, ...] = tuple(rules.LEVELS), **options):
    """One row per prompt and level; the prompt table is read and classified once."""
    out = with_level_results(df, levels=levels, **options)
    keep = [c for c in out.columns if not c.startswith("result_")]
    pairs = F.array(
        *[F.struct(F.lit(lv).alias("level"), F.col(f"result_{lv}").alias("r")) for lv in levels]
    )
    return out.select(*keep, F.explode(pairs).alias("_pair")).select(
        *keep, F.col("_pair.level").alias("level"), F.col("_pair.r.*")
    )


def dry_run(df: DataFrame, level: str = "conservative", **options) -> DataFrame:
    """What compression would do, under the names a dry run reports."""
    return optimize(df, level, **options).select(
        "prompt_id",
        F.col("text").alias("original_input"),
        F.col("input_type").alias("classified_type"),
        "risk_level",
        "input_token_estimate",
        "optimized_token_estimate",
        F.col("token_savings").alias("estimated_savings"),
        F.col("token_savings_percent").alias("estimated_savings_percent"),
        "was_optimized",
        "reason",
        F.col("optimized_text").alias("optimized_output"),
    )


def with_classification(df: DataFrame, text: str = "text", into: str = "class") -> DataFrame:
    """Add the classification struct of a text column."""
    return df.withColumn(
        into, built_once(f"classify/{text}", lambda: evaluate_here(classify(F.col(text))))
    )


def compare_levels(df: DataFrame, levels: tuple[str, ...] = tuple(rules.LEVELS), **options):
    """Tokens before and after, and the saved share, per level."""
    out = with_level_results(df, levels=levels, **options)
    sums = out.agg(
        F.count(F.lit(1)).alias("prompts"),
        F.sum("input_token_estimate").alias("before"),
        *[
            F.sum(F.col(f"result_{lv}.optimized_token_estimate")).alias(f"after_{lv}")
            for lv in levels
        ],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(lv).alias("level"), F.col(f"after_{lv}").alias("tokens_after"))
            for lv in levels
        ]
    )
    return sums.select("prompts", "before", F.explode(pairs).alias("p")).select(
        F.col("p.level").alias("level"),
        "prompts",
        F.col("before").alias("tokens_before"),
        F.col("p.tokens_after").alias("tokens_after"),
        F.when(F.col("before") > 0,
               (F.col("before") - F.col("p.tokens_after")) * 100.0 / F.col("before"))
        .otherwise(F.lit(0.0))
        .alias("savings_percent"),
    )
