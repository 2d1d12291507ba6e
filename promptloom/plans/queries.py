"""Registered queries: one per operator, each over whole derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import classify as c
from promptloom.functions import compress, rules
from promptloom.functions import outputs as o
from promptloom.functions import text as t
from promptloom.functions.regex import let
from promptloom.functions.staging import built_once, evaluate_here
from promptloom.operators import events, history, intext, outputs
from promptloom.operators import optimize as opt
from promptloom.plans import streams
from promptloom.sources import derived
from promptloom.sources import tables
from promptloom.sources.tables import stored, with_output

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = "TIMESTAMP_NTZ '2024-04-10 00:00:00'"


def register(name: str):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return add


def stamp(col: str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def over(name: str, source: Callable, key: str, **columns: Callable[[], Column]) -> None:
    """Register a projection of computed columns over a source table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cols = built_once(
            f"query/{name}", lambda: [make().alias(alias) for alias, make in columns.items()]
        )
        return source(spark, sf_dir).select(key, *cols)

    QUERIES[name] = run


# --- source tables ----------------------------------------------------------------------------

def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prompts and documents as (id, text); document ids are negative."""
    prompts = derived.prompts(spark, sf_dir).select(F.col("prompt_id").alias("id"), "text")
    docs = derived.table(spark, sf_dir, "documents").select(
        (-F.col("doc_id") - 1).alias("id"), "text"
    )
    return prompts.unionAll(docs)


def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.shell_events(spark, sf_dir).where("kind = 'start'")


def tool_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_output(derived.tool_outputs(spark, sf_dir))


def tool_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool outputs as texts of many lines."""
    return tool_outputs(spark, sf_dir).select("output_id", F.col("output").alias("text"))


def stop_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with one sentence per line, so that whole-line stop phrases occur."""
    return derived.prompts(spark, sf_dir).withColumn(
        "text", F.regexp_replace("text", r"\. ", ".\n")
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt tool command lines in four forms."""
    p, text = F.col("prompt_id"), F.col("text")
    form = F.floor(p / 1000) % 4
    cmd = F.col("command_name")
    args = (
        F.when(form == 0, F.array(cmd, F.lit("-p"), text))
        .when(form == 1, F.array(cmd, F.lit("-v"), F.concat(F.lit("--prompt="), text)))
        .when(form == 2, F.array(cmd, F.lit("exec"), text, F.lit("--json")))
        .otherwise(F.array(cmd, F.lit("run"), F.lit("--message")))
    )
    return derived.prompts(spark, sf_dir).select("prompt_id", args.alias("args"))


def classed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return opt.with_classification(derived.prompts(spark, sf_dir)).select(
        "*", F.col("class.input_type").alias("input_type")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.runs_from(opt.optimize(derived.prompts(spark, sf_dir), "conservative"))


def logged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.log_events(starts(spark, sf_dir))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.valid_feedback(derived.feedback(spark, sf_dir))


def rated_patterns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Patterns, and the feedback that reached one. The runs are stored first, as they are in
    practice: feedback comes later and reads them."""
    all_runs = stored(runs(spark, sf_dir))
    patterns = history.prompt_patterns(all_runs)
    rated = history.feedback_to_runs(feedback(spark, sf_dir), all_runs)
    return patterns, history.runs_to_patterns(rated, patterns)


def bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    patterns, rated = rated_patterns(spark, sf_dir)
    return history.history_bonus(patterns, history.pattern_success(rated))



def col() -> Column:
    return F.col("text")


# --- sources and sinks ------------------------------------------------------------------------

def _read_back(df: DataFrame, write: Callable[[DataFrame, str], None]) -> DataFrame:
    """Through the sink and the table it makes."""
    path = f"{tables.work_dir(df.sparkSession)}/table"
    write(df, path)
    return df.sparkSession.read.parquet(path)


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classed_prompts(spark, sf_dir).select(
        "prompt_id", "input_type", F.col("class.risk_level").alias("risk_level"),
        F.col("class.should_optimize").alias("should_optimize"),
        F.col("class.reason").alias("reason"),
    )


@register("s1_read_prompts")
def s1(spark, sf_dir):
    path = f"{tables.work_dir(spark)}/prompts"
    tables.typed(derived.prompts(spark, sf_dir), tables.PROMPTS).write.parquet(path)
    return tables.read_prompts(spark, path).select(
        "prompt_id", stamp("created_at").alias("created_at"), "command_name", "text"
    )


@register("s2_read_tool_outputs")
def s2(spark, sf_dir):
    path = f"{tables.work_dir(spark)}/outputs"
    tables.typed(derived.tool_outputs(spark, sf_dir), tables.TOOL_OUTPUTS).write.parquet(path)
    return tables.read_tool_outputs(spark, path).select(
        "output_id", "command_name", F.array_join("args", " ").alias("args"), "exit_code", "output"
    )


@register("s3_write_runs")
def s3(spark, sf_dir):
    return _read_back(runs(spark, sf_dir), tables.write_runs).select(
        "run_id", stamp("created_at").alias("created_at"), "input_hash", "input_preview",
        "optimized_preview", "input_token_estimate", "optimized_token_estimate", "token_savings",
        F.round("token_savings_percent", 6).alias("token_savings_percent"), "input_type",
        "risk_level", "command_name", "was_optimized", "status",
    )


@register("s4_write_shell_events")
def s4(spark, sf_dir):
    return _read_back(logged(spark, sf_dir), tables.write_shell_events).select(
        "event_id", stamp("created_at").alias("created_at"), "shell", "pid", "cwd", "command_hash",
        "raw_command_preview", "optimized_preview", "token_estimate", "input_type", "risk_level",
        "was_modified", "status",
    )


@register("s5_write_feedback")
def s5(spark, sf_dir):
    return _read_back(feedback(spark, sf_dir), tables.write_feedback).select(
        "feedback_id", stamp("created_at").alias("created_at"), "run_id", "rating", "notes"
    )


@register("s6_export_json")
def s6(spark, sf_dir):
    path = f"{tables.work_dir(spark)}/json"
    tables.export_json(_report(spark, sf_dir), path)
    return spark.read.text(path)


@register("s6_export_tsv")
def s6_tsv(spark, sf_dir):
    path = f"{tables.work_dir(spark)}/tsv"
    report = _report(spark, sf_dir)
    tables.export_tsv(report, path)
    return spark.read.schema(report.schema).option("sep", "\t").option("header", True).csv(path)


@register("s7_archive_failures")
def s7(spark, sf_dir):
    return outputs.archive_failures(tool_outputs(spark, sf_dir)).select(
        "output_id", stamp("ts").alias("ts"), "file_stem", "content"
    )


@register("s7_rotate_archive")
def s7_rotate(spark, sf_dir):
    """The stored archive after three batches of outputs: the newest of all of them."""
    path = f"{tables.work_dir(spark)}/archive"
    for batch in range(3):
        some = tool_outputs(spark, sf_dir).where(F.col("output_id") % 3 == batch)
        tables.write_archive(spark, outputs.archive_failures(some), path, rules.ARCHIVE_MAX_FILES, batch)
    return tables.read_archive(spark, path).select("output_id", stamp("ts").alias("ts"), "file_stem", "content")


# --- projections ------------------------------------------------------------------------------

over("p1_redact", texts, "id", redacted=lambda: t.redact(col()))
over("p2_preview", texts, "id", preview=lambda: t.preview(col()),
     short_preview=lambda: t.preview(col(), rules.NOTES_PREVIEW_LIMIT))
over("p3_text_hash", texts, "id", text_hash=lambda: t.text_hash(t.redact(col())))
over("p4_estimate_tokens", texts, "id", tokens=lambda: t.estimate_tokens(col()))


@register("p5_token_savings")
def p5(spark, sf_dir):
    counted = derived.prompts(spark, sf_dir).select(
        "prompt_id",
        t.estimate_tokens(col()).alias("tokens_in"),
        t.estimate_tokens(t.redact(col())).alias("tokens_out"),
    )
    before, after = F.col("tokens_in"), F.col("tokens_out")
    return counted.select(
        "*",
        t.savings(before, after).alias("saved"),
        F.round(t.savings_percent(before, after), 6).alias("saved_percent"),
        t.savings(before, after, clamp=True).alias("saved_clamped"),
        F.round(t.savings_percent(before, after, clamp=True), 6).alias("saved_percent_clamped"),
    )


over("p6_prompt_shape", texts, "id", shape=lambda: t.prompt_shape(col()))
over("p7_prompt_pattern_hash", classed_prompts, "prompt_id",
     pattern_hash=lambda: t.prompt_pattern_hash(F.col("input_type"), t.redact(col())))
over("p8_command_pattern", starts, "event_seq", pattern=lambda: t.command_pattern(F.col("command")))
over("p9_command_name", starts, "event_seq",
     command_name=lambda: t.command_name(t.command_pattern(F.col("command"))))
over("p10_base_name", starts, "event_seq",
     base_name=lambda: t.base_name(F.element_at(F.split("command", " "), 1)))
over("p11_protect_fences", texts, "id", protected=lambda: t.protect_fences(col()),
     fences=lambda: F.size(t.fences(col())),
     same=lambda: t.restore_fences(t.protect_fences(col()), t.fences(col())) == col())
for _level in rules.LEVELS:
    over(f"p12_remove_filler_{_level}", texts, "id",
         cleaned=lambda lv=_level: compress.remove_filler(col(), lv))
over("p13_clean_fragments", texts, "id", cleaned=lambda: compress.clean_fragments(col()))
over("p14_first_meaningful_line", texts, "id", line=lambda: compress.first_meaningful_line(col()))
over("p15_derive_task", classed_prompts, "prompt_id",
     task=lambda: compress.derive_task(F.col("input_type"), col()))


def _structured(level: str) -> Column:
    return compress.structured_prompt(
        F.col("input_type"), compress.derive_task(F.col("input_type"), col()),
        compress.extract_constraints(col()), col(), level,
    )


over("p16_structured_prompt", classed_prompts, "prompt_id",
     sections=lambda: _structured("moderate"), terse=lambda: _structured("aggressive"))
over("p17_final_error_line", texts, "id", error_line=lambda: compress.final_error_line(col()))
over("p18_extract_paths", texts, "id", paths=lambda: F.array_join(compress.extract_paths(col()), "|"),
     shell_lines=lambda: F.array_join(compress.extract_shell_lines(col()), "|"))


def _penalised(spark, sf_dir):
    return derived.prompts(spark, sf_dir).withColumn(
        "candidate",
        built_once(
            "query/candidate",
            lambda: compress.collapse_repeated_lines(
                let(t.protect_fences(col()), lambda x: compress.remove_filler(x, "moderate"))
            ),
        ),
    )


over("p19_risk_penalty", _penalised, "prompt_id",
     conservative=lambda: compress.risk_penalty(col(), F.col("candidate"), "conservative"),
     aggressive=lambda: compress.risk_penalty(col(), F.col("candidate"), "aggressive"))
over("p20_optimization_score", _penalised, "prompt_id",
     score=lambda: F.round(
         compress.optimization_score(
             t.savings_percent(t.estimate_tokens(col()), t.estimate_tokens(F.col("candidate"))),
             compress.risk_penalty(col(), F.col("candidate"), "moderate"),
             F.lit(1.5),
         ), 6))


@register("p21_classify")
def p21(spark, sf_dir):
    return opt.with_classification(texts(spark, sf_dir)).select(
        "id", "class.input_type", "class.risk_level", "class.should_optimize", "class.reason"
    )


over("p22_dangerous_rule", starts, "event_seq",
     rule=lambda: F.coalesce(c.dangerous_rule(F.col("command")), F.lit("")))


@register("p23_prompt_argument")
def p23(spark, sf_dir):
    found = built_once("query/p23", lambda: t.prompt_argument(F.col("args")))
    return calls(spark, sf_dir).select("prompt_id", found.alias("f")).select(
        "prompt_id", F.col("f.idx").alias("idx"), F.col("f.value").alias("value")
    )


RESULT = [
    "input_type", "risk_level", "input_token_estimate", "optimized_token_estimate",
    "was_optimized", "reason", "status", "optimized_text",
]


def _optimized(level: str, pick: str) -> Query:
    def run(spark, sf_dir):
        return opt.optimize(derived.prompts(spark, sf_dir), level, pick=pick).select(
            "prompt_id", *RESULT, F.round("optimization_score", 6).alias("score")
        )

    return run


for _level in rules.LEVELS:
    QUERIES[f"p24_optimize_{_level}"] = _optimized(_level, "first")
QUERIES["p24_optimize_best_moderate"] = _optimized("moderate", "best")


@register("p24_optimize_with_bonus")
def p24_bonus(spark, sf_dir):
    """Prompts, runs, feedback, bonus, and prompts again with what they have earned."""
    columns = derived.prompts(spark, sf_dir).columns
    earned = history.with_history_bonus(classed_prompts(spark, sf_dir), bonus(spark, sf_dir))
    results = opt.optimize(earned.select(*columns, "bonus"), "conservative", bonus="bonus")
    return results.select("prompt_id", *RESULT, F.round("optimization_score", 6).alias("score"))


@register("p25_dry_run")
def p25(spark, sf_dir):
    return opt.dry_run(derived.prompts(spark, sf_dir), "aggressive").withColumn(
        "estimated_savings_percent", F.round("estimated_savings_percent", 6)
    )


# --- in-text operators ------------------------------------------------------------------------

def _clause_query(level: str) -> Query:
    def run(spark, sf_dir):
        return intext.dedupe_clauses(texts(spark, sf_dir), level).select("id", "deduped")

    return run


for _level in ("moderate", "aggressive"):
    over(f"t1_drop_stop_lines_{_level}", stop_texts, "prompt_id",
         kept=lambda lv=_level: compress.drop_stop_lines(col(), lv))
    QUERIES[f"t2_dedupe_clauses_{_level}"] = _clause_query(_level)
over("t3_dedupe_sentences", texts, "id", deduped=lambda: compress.dedupe_sentences(col()))
over("t4_dedupe_paragraphs", texts, "id", deduped=lambda: compress.dedupe_paragraphs(col()))
over("t5_collapse_repeated_lines", texts, "id",
     collapsed=lambda: compress.collapse_repeated_lines(col()))
over("t6_dedupe_tracebacks", texts, "id", deduped=lambda: compress.dedupe_tracebacks(col()))
over("t7_compress_log", tool_texts, "output_id", compressed=lambda: compress.compress_log(col()))
over("t8_extract_constraints", texts, "id",
     constraints=lambda: F.array_join(compress.extract_constraints(col()), "|"))


def _compacted(level: str) -> Query:
    def run(spark, sf_dir):
        return opt.compact(derived.prompts(spark, sf_dir), level).select("prompt_id", "compact")

    return run


for _level in rules.LEVELS:
    QUERIES[f"t9_compact_{_level}"] = _compacted(_level)


# --- filters ----------------------------------------------------------------------------------

@register("f1_is_dangerous")
def f1(spark, sf_dir):
    return starts(spark, sf_dir).where(c.is_dangerous(F.col("command"))).select(
        "event_seq", "command"
    )


over("f2_looks_like_shell", texts, "id", shell_like=lambda: c.looks_like_shell(t.strip(col())))
over("f3_looks_like_log", texts, "id", log_like=lambda: c.looks_like_log(col()))
over("f4_has_marker", texts, "id", ai=lambda: c.has_marker(col(), rules.AI_MARKERS),
     code=lambda: c.has_marker(col(), rules.CODE_MARKERS),
     debug=lambda: c.has_marker(col(), rules.DEBUG_MARKERS))
over("f5_has_fence_path_command", texts, "id", fence=lambda: c.has_fence(col()),
     path=lambda: c.has_path(col()), inline_command=lambda: c.has_inline_command(col()))
over("f6_looks_like_instruction", texts, "id",
     instruction=lambda: c.looks_like_instruction(t.strip(col())))
over("f7_moderate_risk", starts, "event_seq",
     moderate=lambda: c.is_moderate_risk_shell(F.col("command")),
     destructive_sql=lambda: c.is_destructive_sql(F.col("command")))


@register("f8_observable_command")
def f8(spark, sf_dir):
    return events.observable_commands(starts(spark, sf_dir)).select("event_seq", "command")


def _rules(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stored global and project rules."""
    path = f"{tables.work_dir(spark)}/rules"
    derived.exclude_rules(spark, sf_dir).write.parquet(path)
    stored_rules = tables.read_exclude_rules(spark, path)
    return tuple(stored_rules.where(F.col("scope") == scope).select("pattern") for scope in ("global", "project"))


@register("f9_exclude_commands")
def f9(spark, sf_dir):
    """Logging leaves out what the merged rules name."""
    merged = events.merge_rules(*_rules(spark, sf_dir))
    return events.exclude_commands(starts(spark, sf_dir), merged).select("event_seq", "command")


@register("f10_should_optimize")
def f10(spark, sf_dir):
    return opt.with_classification(derived.prompts(spark, sf_dir)).where(
        "class.should_optimize"
    ).select("prompt_id", "class.input_type")


@register("f11_rejected_feedback")
def f11(spark, sf_dir):
    return history.rejected_feedback(derived.feedback(spark, sf_dir)).select(
        "feedback_id", "rating"
    )


@register("f12_audit")
def f12(spark, sf_dir):
    return events.audit(logged(spark, sf_dir), "high", 20).select(
        stamp("created_at").alias("created_at"), "raw_command_preview", "cwd", "risk_level"
    )


@register("f13_min_score_gate")
def f13(spark, sf_dir):
    scored = opt.optimize(derived.prompts(spark, sf_dir), "moderate", min_score=20.0)
    return scored.select("prompt_id", "was_optimized", "reason")


@register("f14_compressible_output")
def f14(spark, sf_dir):
    return tool_outputs(spark, sf_dir).where(
        F.length("output") >= rules.OUTPUT_MIN_CHARS
    ).select("output_id", F.length("output").alias("chars"))


# --- joins ------------------------------------------------------------------------------------

@register("j1_complete_events")
def j1(spark, sf_dir):
    return events.complete_events(derived.shell_events(spark, sf_dir)).select(
        "event_seq", "shell", "pid", "status", "exit_code",
        stamp("completed_at").alias("completed_at"),
    )


@register("j2_feedback_to_runs")
def j2(spark, sf_dir):
    return history.feedback_to_runs(feedback(spark, sf_dir), runs(spark, sf_dir)).select(
        "feedback_id", "rating", "run_id", "input_type"
    )


@register("j3_runs_to_patterns")
def j3(spark, sf_dir):
    return rated_patterns(spark, sf_dir)[1].select(
        "feedback_id", "rating", "pattern_hash", "pattern_type"
    )


@register("j3_live")
def j3_live(spark, sf_dir):
    """The same out of two streams."""
    rated = streams.rated_live(spark, feedback(spark, sf_dir), runs(spark, sf_dir))
    return rated.select("feedback_id", "rating", "pattern_hash")


@register("j4_with_history_bonus")
def j4(spark, sf_dir):
    prompts = classed_prompts(spark, sf_dir)
    return history.with_history_bonus(prompts, bonus(spark, sf_dir)).select(
        "prompt_id", "input_type", F.round("bonus", 6).alias("bonus")
    )


@register("j4_bonus_as_of")
def j4_as_of(spark, sf_dir):
    """The bonus that each prompt met when it came."""
    patterns, rated = rated_patterns(spark, sf_dir)
    known = history.with_bonus_as_of(classed_prompts(spark, sf_dir), history.bonus_changes(patterns, rated))
    return known.select("prompt_id", "input_type", F.round("bonus", 6).alias("bonus"))


@register("j5_clause_overlap")
def j5(spark, sf_dir):
    return intext.overlapping_clauses(texts(spark, sf_dir), "id", "text", 0.85)


@register("j5_clause_pairs")
def j5_pairs(spark, sf_dir):
    """The pairs themselves, between classes of sentences with the same keywords."""
    return intext.overlapping_pairs(stored(intext.clause_bags(texts(spark, sf_dir), "id", "text")), "id", 0.85)


@register("j5_clause_classes")
def j5_classes(spark, sf_dir):
    """The class of each sentence, by its first place in the text."""
    return intext.clause_bags(texts(spark, sf_dir), "id", "text").select("id", "pos", "first_pos", F.size("bag").alias("keywords"))


@register("j6_exclude_global_rules")
def j6(spark, sf_dir):
    own = spark.createDataFrame([("sudo",), ("^cat ",)], "pattern string")
    kept = events.exclude_commands(starts(spark, sf_dir), events.merge_rules(_rules(spark, sf_dir)[0], own))
    return kept.select("event_seq", events.without_prefix(F.col("command")).alias("bare"))


# --- aggregates -------------------------------------------------------------------------------

@register("a1_run_stats")
def a1(spark, sf_dir):
    return history.run_stats(runs(spark, sf_dir)).withColumn(
        "avg_savings_percent", F.round("avg_savings_percent", 6)
    )


@register("a2_event_stats")
def a2(spark, sf_dir):
    return history.event_stats(logged(spark, sf_dir))


def _shown(patterns: DataFrame) -> DataFrame:
    return patterns.select(
        "pattern_hash", "pattern_type", "original_pattern_preview", "optimized_pattern_preview",
        "usage_count", F.round("average_savings_percent", 6).alias("average_savings_percent"),
        "first_run_id",
    )


def _shown_commands(patterns: DataFrame) -> DataFrame:
    return patterns.select(
        "pattern_hash", "command_pattern", "command_name", "usage_count",
        F.round("average_token_estimate", 6).alias("average_token_estimate"),
        stamp("last_seen_at").alias("last_seen_at"),
    )


@register("a3_prompt_patterns")
def a3(spark, sf_dir):
    return _shown(history.prompt_patterns(runs(spark, sf_dir)))


def _loads(rows: DataFrame, key: str, schema: str, merge: Callable, partials: Callable) -> DataFrame:
    """Partials of three loads, none of which reads what an earlier one did; the first two are folded in between."""
    rollup = tables.Rollup(rows.sparkSession, f"{tables.work_dir(rows.sparkSession)}/rollup", schema, merge)
    for load in range(3):
        rollup.add(partials(rows.where(F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(3)) == load)), load)
        if load == 1:
            rollup.compact()
    return rollup.read()


@register("a3_patterns_by_load")
def a3_by_load(spark, sf_dir):
    merged = _loads(stored(runs(spark, sf_dir)), "run_id", history.PROMPT_PARTIALS, history.merge_prompt_partials, history.prompt_partials)
    return _shown(history.patterns_of(merged))


@register("a4_patterns_by_load")
def a4_by_load(spark, sf_dir):
    merged = _loads(stored(logged(spark, sf_dir)), "event_id", history.COMMAND_PARTIALS, history.merge_command_partials, history.command_partials)
    return _shown_commands(history.commands_of(merged))


@register("a5_success_by_load")
def a5_by_load(spark, sf_dir):
    def partials(rated: DataFrame) -> DataFrame:
        return history.pattern_success(rated).withColumnRenamed("success_score", "success")

    rated = stored(rated_patterns(spark, sf_dir)[1].select("feedback_id", "rating", "pattern_hash"))
    merged = _loads(rated, "feedback_id", history.SUCCESS_PARTIALS, history.merge_success_partials, partials)
    return merged.withColumnRenamed("success", "success_score")


@register("a4_command_patterns")
def a4(spark, sf_dir):
    return _shown_commands(history.command_patterns(logged(spark, sf_dir)))


@register("a5_pattern_success")
def a5(spark, sf_dir):
    return history.pattern_success(rated_patterns(spark, sf_dir)[1])


@register("a6_history_bonus")
def a6(spark, sf_dir):
    return bonus(spark, sf_dir).select("input_type", F.round("bonus", 6).alias("bonus"))


@register("a7_compare_levels")
def a7(spark, sf_dir):
    return opt.compare_levels(derived.prompts(spark, sf_dir)).withColumn(
        "savings_percent", F.round(F.col("savings_percent").cast("double"), 6)
    )


@register("a8_output_savings")
def a8(spark, sf_dir):
    return outputs.output_savings(tool_outputs(spark, sf_dir))


@register("a9_distinct_hashes")
def a9(spark, sf_dir):
    return history.distinct_hashes(stored(runs(spark, sf_dir)))


# --- sort, limit, set operations --------------------------------------------------------------

@register("k1_top_commands")
def k1(spark, sf_dir):
    return history.top_commands(history.command_patterns(logged(spark, sf_dir))).select(
        "command_name", "usage_count",
        F.round("average_token_estimate", 6).alias("average_token_estimate"),
    )


@register("k2_newest_first")
def k2(spark, sf_dir):
    return events.audit(logged(spark, sf_dir), "low", 50).select(
        "event_id", stamp("created_at").alias("created_at"), "raw_command_preview"
    )


@register("k3_best_candidate")
def k3(spark, sf_dir):
    return opt.optimize(derived.prompts(spark, sf_dir), "conservative", pick="best").select(
        "prompt_id", "was_optimized", "optimized_text",
        F.round("optimization_score", 6).alias("score"),
    )


@register("k4_first_acceptable_candidate")
def k4(spark, sf_dir):
    return opt.optimize(derived.prompts(spark, sf_dir), "conservative", min_score=15.0).select(
        "prompt_id", "was_optimized", "optimized_text", "reason"
    )


@register("u1_merge_rules")
def u1(spark, sf_dir):
    """Rule tables: every tool seen in the events, and every command word, as exclusion rules."""
    seen = starts(spark, sf_dir).select(t.command_pattern(F.col("command")).alias("pattern"))
    names = seen.select(t.command_name(F.col("pattern")).alias("pattern"))
    return events.merge_rules(seen, names)


over("u2_line_picks", tool_texts, "output_id", picks=lambda: compress.compress_log(col()))


@register("u3_candidates")
def u3(spark, sf_dir):
    """An extra candidate joins the two local ones; it wins only when those are not accepted."""
    prompts = derived.prompts(spark, sf_dir).withColumn(
        "extra", F.array(F.lit("Fix this."), F.lit("Debug /srv/jobs/report.py KeyError: no such region"))
    )
    return opt.optimize(
        prompts, "moderate", min_score=3.0, extra_candidates="extra"
    ).select("prompt_id", "was_optimized", "optimized_text")


@register("u4_retain")
def u4(spark, sf_dir):
    kept = history.retain(logged(spark, sf_dir), F.expr(NOW), 90)
    return kept.select("event_id", stamp("created_at").alias("created_at"))


@register("u4_rewrite")
def u4_rewrite(spark, sf_dir):
    """The stored table after its expired days are gone."""
    table = tables.DayTable(spark, f"{tables.work_dir(spark)}/events", tables.LOGGED_EVENTS)
    table.append(logged(spark, sf_dir), "first")
    table.retain("2024-04-10 00:00:00", 90)
    return table.read().select("event_id", stamp("created_at").alias("created_at"))


@register("u4_expired_count")
def u4_count(spark, sf_dir):
    return history.expired_count(logged(spark, sf_dir), F.expr(NOW), 90)


# --- tool outputs -----------------------------------------------------------------------------

@register("o0_router")
def o0(spark, sf_dir):
    return tool_outputs(spark, sf_dir).select(
        "output_id", o.route(F.col("command_name"), F.col("args")).alias("route")
    )


def _route(*kinds: str) -> Query:
    def run(spark, sf_dir):
        picked = tool_outputs(spark, sf_dir).where(
            o.route(F.col("command_name"), F.col("args")).isin(*kinds)
        )
        return outputs.condense(picked).select("output_id", "route", "condensed")

    return run


for _name, _kinds in {
    "o1_git_status": ["git_status"], "o2_git_log": ["git_log"], "o3_git_diff": ["git_diff"],
    "o4_git_action": ["git_action"], "o5_tests": ["test"], "o6_docker": ["docker"],
    "o7_listings": ["kubectl", "listing", "matches"], "o8_file_read": ["file_read"],
    "o9_build": ["build"], "o10_lint": ["lint"], "o11_cloud": ["cloud"],
    "o12_download": ["download"], "o13_generic": ["generic"],
}.items():
    QUERIES[_name] = _route(*_kinds)


# --- streaming --------------------------------------------------------------------------------

QUERIES["st1_complete_stream"] = streams.completed
QUERIES["st2_running_patterns"] = streams.running_patterns
QUERIES["st3_ingest"] = streams.ingested
QUERIES["st4_retention_stream"] = streams.retained


@register("st2_running_prompt_patterns")
def st2_prompts(spark, sf_dir):
    return _shown(streams.running_prompt_patterns(spark, runs(spark, sf_dir)))


QUERIES["st4_retained_table"] = streams.retained_table
