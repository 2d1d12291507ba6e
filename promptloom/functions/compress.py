"""Prompt compression steps: each takes a text column and gives a text column.

All steps work inside one row, without any shuffle; all but clause de-duplication are built-in
expressions. Substring tests guard regexes
throughout: on most rows most rules cannot fire, and a substring test costs about a hundredth of a
regex pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions import rules
from promptloom.functions.clauses import fold_udf
from promptloom.functions.regex import (
    contains_any,
    contains_one_of,
    find_all,
    found,
    java,
    let,
    sql_text,
    sub,
)
from promptloom.functions.staging import evaluate_here
from promptloom.functions.text import (
    FENCE_KEY_HEAD,
    fences,
    first_where,
    lines,
    protect_fences,
    restore_fences,
    rstrip,
    rstrip_chars,
    sentences,
    squeeze,
    strip,
    strip_chars,
    take,
    take_last,
)

_ODD_CASE = ["ſ", "ı", "İ"]


# --- filler -----------------------------------------------------------------------------------

def _level_lists(level: str, by_level: tuple) -> list:
    count = rules.LEVELS.index(level) + 1
    return [item for group in by_level[:count] for item in group]


def filler_rules(level: str) -> list[tuple[str, str]]:
    return _level_lists(
        level, (rules.FILLER_CONSERVATIVE, rules.FILLER_MODERATE, rules.FILLER_AGGRESSIVE)
    )


def _filler_words(level: str) -> list[str]:
    return _level_lists(
        level,
        (
            rules.FILLER_CONSERVATIVE_WORDS,
            rules.FILLER_MODERATE_WORDS,
            rules.FILLER_AGGRESSIVE_WORDS,
        ),
    )


def drop_filler_phrases(col: Column, level: str, start_level: str | None = None) -> Column:
    """Apply the ordered phrase list of a level, skipping phrases whose key word is absent.

    ``start_level`` says the phrases of the lower levels were applied already.
    """
    skip = len(filler_rules(start_level)) if start_level else 0
    todo = list(zip(filler_rules(level), _filler_words(level)))[skip:]
    rule_array = "array({})".format(
        ", ".join(
            f"named_struct('pattern', {sql_text(java(pattern, 'i'))}, "
            f"'replacement', {sql_text(replacement)}, "
            f"'words', array({', '.join(sql_text(w) for w in word.split('|'))}))"
            for (pattern, replacement), word in todo
        )
    )

    def live_rules(low: Column) -> Column:
        def may_fire(odd: Column) -> Column:
            return F.filter(
                F.expr(rule_array),
                lambda rule: odd | F.exists(rule["words"], lambda w: F.contains(low, w)),
            )

        return let(contains_any(low, _ODD_CASE + ["i̇"]), may_fire)

    return let(
        col,
        lambda text: F.aggregate(
            let(F.lower(text), live_rules),
            text,
            lambda acc, rule: F.regexp_replace(acc, rule["pattern"], rule["replacement"]),
        ),
    )


def tidy(col: Column) -> Column:
    """Repair the gaps that removed phrases leave."""
    out = let(
        col,
        lambda t: F.when(contains_any(t, ["  ", "\t"]), sub(t, r"[ \t]{2,}", " ")).otherwise(t),
    )
    out = sub(out, r"\.\s*\.", ".")
    out = sub(out, r"^\s*[.!?,;]\s*", "", "m")
    out = sub(out, r"\s+([.!?,;])", r"\1")
    return let(
        out,
        lambda t: F.when(t.contains("\n\n\n"), sub(t, r"\n{3,}", "\n\n")).otherwise(t),
    )


def clean_fragments(col: Column) -> Column:
    """Drop one-word fragments, join the sentences by one space, capitalise the start."""

    def whole(s: Column) -> Column:
        return s.rlike(r"^\p{IsUppercase}") | found(rstrip_chars(s, ".!?"), r"\S\s+\S")

    kept = F.filter(sentences(strip(col)), lambda s: (s != "") & whole(s))
    out = sub(F.array_join(kept, " "), r"([.!?])\s*\1+", r"\1")
    out = sub(out, r"\.\s*\.", ".")
    return let(
        out,
        lambda t: F.when(
            t.rlike(r"^\p{IsLowercase}"),
            F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t))),
        ).otherwise(t),
    )


def finish_filler(phrased: Column, level: str) -> Column:
    out = tidy(phrased)
    if level != "conservative":
        out = clean_fragments(out)
    return strip(out)


def remove_filler(col: Column, level: str = "conservative") -> Column:
    return finish_filler(drop_filler_phrases(col, level), level)


# --- lines, sentences, paragraphs -------------------------------------------------------------

def drop_stop_lines(col: Column, level: str) -> Column:
    """Drop lines that are nothing but a stop phrase of the level."""
    phrases = {
        "conservative": [],
        "moderate": rules.STOP_MODERATE,
        "aggressive": rules.STOP_MODERATE + rules.STOP_AGGRESSIVE,
    }[level]
    if not phrases:
        return col
    pattern = rf"\A(?:{'|'.join(p[1:] for p in phrases)})"
    kept = F.filter(lines(col), lambda line: ~found(strip(line), pattern, "i"))
    return F.array_join(kept, "\n")


def dedupe_masked_clauses(col: Column, level: str) -> Column:
    """Greedy clause de-duplication of text whose fences are already masked.

    A Python UDF must stay a stage of its own: Spark cannot run one inside a lambda's input.
    """
    if level == "conservative":
        return col
    return evaluate_here(fold_udf(rules.CLAUSE_THRESHOLD[level], FENCE_KEY_HEAD)(col))


def first_of_each(items: Column, keys: Column) -> Column:
    """Items whose key did not occur earlier, in order.

    Texts without a repeated key (nearly all) pay one hash pass; the others sort their keys, so
    the cost stays n log n for a text of any length.
    """

    def firsts(ranked: Column) -> Column:
        first = F.transform(
            ranked,
            lambda r, j: F.when((j == 0) | (F.get(ranked, j - 1)["k"] != r["k"]), r["i"]),
        )
        at = F.sort_array(F.filter(first, lambda i: i.isNotNull()))
        return F.transform(at, lambda i: F.get(items, i))

    ranked = F.sort_array(
        F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    )
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), items).otherwise(
        let(ranked, firsts)
    )


def sentence_key(sentence: Column) -> Column:
    return squeeze(strip_chars(F.lower(sentence), " .!?"))


def dedupe_masked_sentences(col: Column) -> Column:
    """Keep the first of equal sentences of text whose fences are already masked."""

    def is_fence(s: Column) -> Column:
        return s.startswith(FENCE_KEY_HEAD)

    def rebuild(parts: Column, kept: Column) -> Column:
        removed = F.size(parts) - F.size(kept)
        body = F.array_join(kept, " ")
        marker = F.concat(
            F.lit("\n[removed "), removed.cast("string"), F.lit(" duplicate sentence(s)]")
        )
        return F.when(removed >= 2, F.concat(body, marker)).otherwise(body)

    def run(parts: Column) -> Column:
        # Fence placeholders are kept however often they occur: each gets a key of its own.
        keys = F.transform(
            parts,
            lambda s, i: F.when(
                is_fence(s), F.concat(F.lit("\n"), i.cast("string"))
            ).otherwise(sentence_key(s)),
        )
        kept = let(keys, lambda k: first_of_each(parts, k))
        return let(kept, lambda k: rebuild(parts, k))

    return let(
        col,
        lambda text: let(
            sentences(strip(text)),
            lambda all_parts: F.when(F.size(all_parts) <= 1, text).otherwise(
                let(F.filter(all_parts, lambda s: s != ""), run)
            ),
        ),
    )


def dedupe_sentences(col: Column) -> Column:
    return restore_fences(dedupe_masked_sentences(protect_fences(col)), fences(col))


def dedupe_paragraphs(col: Column) -> Column:
    """Keep the first of equal paragraphs (white space aside)."""

    def rebuild(paras: Column, kept: Column) -> Column:
        removed = F.size(paras) - F.size(kept)
        marker = F.concat(
            F.lit("[removed "), removed.cast("string"), F.lit(" duplicate paragraph(s)]")
        )
        return F.array_join(
            F.when(removed > 0, F.array_append(kept, marker)).otherwise(kept), "\n\n"
        )

    def run(paras: Column) -> Column:
        kept = let(F.transform(paras, squeeze), lambda keys: first_of_each(paras, keys))
        return let(kept, lambda k: rebuild(paras, k))

    def split_up(text: Column) -> Column:
        pieces = F.transform(F.split(text, r"(?dU)\n\s*\n", -1), strip)
        return let(F.filter(pieces, lambda p: p != ""), run)

    return let(
        strip(col),
        lambda text: F.when(text.contains("\n"), split_up(text)).otherwise(text),
    )


def collapse_repeated_lines(col: Column) -> Column:
    """Adjacent equal lines become one line and a repeat count; line ends are trimmed."""

    def runs(rows: Column, keys: Column) -> Column:
        starts = F.filter(
            F.transform(
                keys,
                lambda k, i: F.when((i > 0) & (k != "") & (k == F.get(keys, i - 1)), None).otherwise(
                    i
                ),
            ),
            lambda i: i.isNotNull(),
        )

        def emit(all_starts: Column, start: Column, j: Column) -> Column:
            count = F.coalesce(F.get(all_starts, j + 1), F.size(rows)) - start
            line = rstrip(F.get(rows, start))
            return F.when(
                count > 1,
                F.concat(
                    line, F.lit("\n[previous line repeated "), count.cast("string"), F.lit(" times]")
                ),
            ).otherwise(line)

        return let(
            starts,
            lambda at: F.array_join(F.transform(at, lambda s, j: emit(at, s, j)), "\n"),
        )

    return let(
        lines(col),
        lambda rows: let(
            F.transform(rows, lambda r: squeeze(strip(r))), lambda keys: runs(rows, keys)
        ),
    )


def dedupe_tracebacks(col: Column) -> Column:
    """Keep the first of equal traceback blocks; text after the blocks is gathered once."""

    def block(part: Column) -> Column:
        rows = lines(F.concat(F.lit(rules.TRACEBACK_HEAD), part))

        def is_final(row: Column) -> Column:
            return let(
                strip(row),
                lambda s: s.rlike(rf"(?dUi)\A(?:{rules.FINAL_ERROR})")
                & ~F.startswith(F.lower(s), F.lit("traceback")),
            )

        def cut(all_rows: Column, end: Column) -> Column:
            body = strip(F.array_join(F.transform(take(all_rows, end), rstrip), "\n"))
            tail = F.filter(
                F.transform(F.slice(all_rows, end + 1, F.size(all_rows)), rstrip),
                lambda r: strip(r) != "",
            )
            return F.struct(body.alias("body"), squeeze(body).alias("key"), tail.alias("tail"))

        def with_rows(all_rows: Column) -> Column:
            end = first_where(
                F.transform(all_rows, lambda r, i: F.when(is_final(r), i + 1)),
                lambda i: i.isNotNull(),
            )
            return let(F.coalesce(end, F.size(all_rows)), lambda e: cut(all_rows, e))

        return let(rows, with_rows)

    def rebuild(prefix: Column, blocks: Column) -> Column:
        bodies = F.transform(blocks, lambda b: b["body"])
        keys = F.transform(blocks, lambda b: b["key"])
        tails = F.flatten(F.transform(blocks, lambda b: b["tail"]))
        kept = let(bodies, lambda bs: let(keys, lambda ks: first_of_each(bs, ks)))
        suffix = let(
            tails,
            lambda ts: let(
                F.transform(ts, strip), lambda ks: F.array_join(first_of_each(ts, ks), "\n")
            ),
        )

        def assemble(uniq: Column) -> Column:
            removed = F.size(blocks) - F.size(uniq)
            marker = F.concat(
                F.lit("[removed "), removed.cast("string"), F.lit(" duplicate traceback block(s)]")
            )
            pieces = F.concat(
                F.array(prefix), uniq, F.array(suffix),
                F.array(F.when(removed > 0, marker).otherwise(F.lit(""))),
            )
            return F.array_join(F.filter(pieces, lambda p: strip(p) != ""), "\n\n")

        return let(kept, assemble)

    def run(text: Column, parts: Column) -> Column:
        blocks = F.transform(F.slice(parts, 2, F.size(parts)), block)
        return F.when(F.size(parts) <= 2, text).otherwise(
            let(blocks, lambda bs: rebuild(rstrip(F.get(parts, F.lit(0))), bs))
        )

    return let(
        col,
        lambda text: F.when(
            text.contains(rules.TRACEBACK_HEAD),
            let(
                F.split(text, r"Traceback \(most recent call last\):", -1),
                lambda parts: run(text, parts),
            ),
        ).otherwise(text),
    )


# A path may start where a run of path characters starts, or right after the previous match.
_JAVA_TEXT_PATH = (
    r"(?:/[^\s:]+|[A-Za-z]:\\[^\s:]+|(?:(?<![\w.-])|\G)[\w.-]++/[\w./:@+-]+)(?::\d+)?"
)


def line_has_path(line: Column) -> Column:
    return contains_any(line, ["/", ":\\"]) & found(line, _JAVA_TEXT_PATH)


def compress_log(col: Column, max_lines: int = rules.LOG_MAX_LINES) -> Column:
    """Long logs: head, last error lines, last path lines and tail, each line once."""

    def run(rows: Column) -> Column:
        odd = lambda r: contains_any(r, _ODD_CASE)
        errors = F.filter(
            rows,
            lambda r: let(F.lower(r), lambda low: contains_one_of(low, rules.LOG_ERROR_WORDS))
            | (odd(r) & found(r, rules.LOG_ERROR_LINE, "i")),
        )
        picks = F.array_distinct(
            F.concat(
                take(rows, rules.LOG_HEAD),
                take_last(errors, rules.LOG_ERRORS),
                take_last(F.filter(rows, line_has_path), rules.LOG_PATHS),
                take_last(rows, rules.LOG_TAIL),
            )
        )
        return let(
            picks,
            lambda p: F.concat(
                F.array_join(take(p, max_lines), "\n"),
                F.lit("\n[compressed log from "),
                F.size(rows).cast("string"),
                F.lit(" to "),
                F.least(F.size(p), F.lit(max_lines)).cast("string"),
                F.lit(" lines]"),
            ),
        )

    return let(
        col,
        lambda text: let(
            lines(text),
            lambda rows: F.when(F.size(rows) <= max_lines, text).otherwise(run(rows)),
        ),
    )


# --- task, constraints, structured prompt -----------------------------------------------------

def first_meaningful_line(col: Column) -> Column:
    return F.coalesce(
        first_where(F.transform(lines(col), strip), lambda r: r != ""), F.lit("")
    )


def extract_constraints(col: Column) -> Column:
    stated = F.filter(
        lines(col), lambda r: let(F.lower(r), lambda low: contains_one_of(low, rules.CONSTRAINT_WORDS))
    )
    cleaned = F.filter(F.transform(stated, lambda r: strip_chars(r, " -\t")), lambda r: r != "")
    return let(
        col,
        lambda t: F.when(
            let(F.lower(t), lambda low: contains_one_of(low, rules.CONSTRAINT_WORDS)),
            take(F.array_distinct(cleaned), rules.CONSTRAINT_LIMIT),
        ).otherwise(F.array().cast("array<string>")),
    )


def derive_task(input_type: Column, col: Column) -> Column:
    def sentence(first: Column) -> Column:
        short = F.when(
            F.length(first) > rules.TASK_LIMIT,
            F.concat(rstrip(F.substring(first, 1, rules.TASK_CUT)), F.lit("...")),
        ).otherwise(first)
        return F.when(first == "", F.lit(rules.TASK_DEFAULT)).otherwise(
            let(
                short,
                lambda s: F.concat(
                    F.upper(F.substring(s, 1, 1)),
                    F.substring(s, F.lit(2), F.length(s)),
                    F.lit("."),
                ),
            )
        )

    return (
        F.when(
            input_type.isin("debugging_request", "log_or_traceback"), F.lit(rules.TASK_DEBUG)
        )
        .when(input_type == "code_instruction", F.lit(rules.TASK_CODE))
        .when(input_type == "mixed_input", F.lit(rules.TASK_MIXED))
        .otherwise(let(rstrip_chars(remove_filler(first_meaningful_line(col)), "."), sentence))
    )


def structured_prompt(
    input_type: Column, task: Column, constraints: Column, compact: Column, level: str
) -> Column:
    """Task, constraints, context and expected output, as sections or (aggressive) terse lines."""

    def context_of(context: Column) -> Column:
        first = first_meaningful_line(context)
        rest = strip(
            let(lines(context), lambda rows: F.array_join(F.slice(rows, 2, F.size(rows)), "\n"))
        )
        stated = (first != "") & F.contains(F.lower(task), rstrip_chars(F.lower(first), "."))
        return F.when(stated, rest).otherwise(context)

    def terse(context: Column) -> Column:
        repeats = rstrip_chars(F.lower(context), ".") == rstrip_chars(F.lower(task), ".")
        return strip(
            F.concat_ws(
                "\n",
                task,
                F.when(
                    F.size(constraints) > 0,
                    F.concat(F.lit("Constraints: "), F.array_join(constraints, "; ")),
                ),
                F.when((context != "") & ~repeats, context),
            )
        )

    def sections(context: Column) -> Column:
        def section(title: Column, body: Column) -> Column:
            text = strip(body)
            return F.when(text != "", F.concat(title, F.lit(":\n"), text))

        bullets = F.array_join(
            F.transform(constraints, lambda c: F.concat(F.lit("- "), c)), "\n"
        )
        title = F.when(input_type == "code_instruction", F.lit("Input")).otherwise(F.lit("Context"))
        wanted = (
            F.when(
                input_type.isin("debugging_request", "log_or_traceback"), F.lit(rules.OUTPUT_DEBUG)
            )
            .when(input_type == "code_instruction", F.lit(rules.OUTPUT_CODE))
            .when(input_type == "mixed_input", F.lit(rules.OUTPUT_MIXED))
        )
        return strip(
            F.concat_ws(
                "\n\n",
                section(F.lit("Task"), task),
                section(F.lit("Constraints"), bullets),
                section(title, context),
                section(F.lit("Output"), wanted),
            )
        )

    return let(
        strip(compact),
        lambda ctx: let(context_of(ctx), terse if level == "aggressive" else sections),
    )


# --- safety score -----------------------------------------------------------------------------

def final_error_line(col: Column) -> Column:
    """The last error line of a text, else null."""
    maybe = contains_any(col, _ODD_CASE) | let(
        F.lower(col), lambda low: contains_any(low, rules.FINAL_ERROR_HINTS)
    )
    hits = find_all(col, rules.FINAL_ERROR, "i")
    return F.when(
        maybe, let(hits, lambda h: F.when(F.size(h) > 0, strip(F.element_at(h, -1))))
    )


def extract_paths(col: Column) -> Column:
    return F.when(
        contains_any(col, ["/", ":\\"]), F.array_distinct(find_all(col, _JAVA_TEXT_PATH))
    ).otherwise(F.array().cast("array<string>"))


def extract_shell_lines(col: Column) -> Column:
    return F.filter(
        F.transform(
            lines(col), lambda r: F.when(found(r, r"\A" + rules.SHELL_LINE[1:]), strip(r))
        ),
        lambda r: r.isNotNull(),
    )


def risk_facts(col: Column) -> Column:
    """What a compressed form must keep: fences, last error, paths, shell lines."""
    return F.struct(
        F.array_distinct(fences(col)).alias("fences"),
        final_error_line(col).alias("error"),
        extract_paths(col).alias("paths"),
        extract_shell_lines(col).alias("shell"),
    )


def _lost_distinct(paths: Column, candidate: Column) -> Column:
    """How many of the distinct paths the candidate lost; paths it names itself need no search."""
    return F.size(F.filter(F.array_except(paths, extract_paths(candidate)), lambda x: ~F.contains(candidate, x)))


def risk_penalty_of(facts: Column, candidate: Column, level: str) -> Column:
    def missing(items: Column, weight: float, own: Column | None = None) -> Column:
        """Items that the candidate lost. What it holds of the same kind (``own``) is a set, so only items
        outside it are looked for in the text."""
        if own is None:
            return F.size(F.filter(items, lambda x: ~F.contains(candidate, x))) * F.lit(weight)
        lost = F.filter(F.array_except(items, own), lambda x: ~F.contains(candidate, x))
        every = let(lost, lambda gone: F.when(F.size(gone) == 0, 0).otherwise(F.size(F.filter(items, lambda x: F.array_contains(gone, x)))))
        return every * F.lit(weight)

    error_lost = facts["error"].isNotNull() & ~F.contains(candidate, facts["error"])
    critical = missing(facts["fences"], rules.PENALTY_FENCE) + F.when(
        error_lost, F.lit(rules.PENALTY_ERROR)
    ).otherwise(F.lit(0.0))
    soft = _lost_distinct(facts["paths"], candidate) * F.lit(rules.PENALTY_PATH) + missing(
        facts["shell"], rules.PENALTY_SHELL, extract_shell_lines(candidate)
    )
    if level == "aggressive":
        return let(critical, lambda c: c + F.when(c == 0, soft * F.lit(0.5)).otherwise(soft))
    return critical + soft


def risk_penalty(original: Column, candidate: Column, level: str) -> Column:
    return let(risk_facts(original), lambda facts: risk_penalty_of(facts, candidate, level))


def optimization_score(percent: Column, penalty: Column, bonus: Column) -> Column:
    return percent - penalty + bonus


def effective_gate(level: str, min_score: float) -> float:
    """Score a candidate must reach at a level."""
    if level == "aggressive":
        return 0.0
    return min(min_score, rules.MODERATE_GATE) if level == "moderate" else min_score


def ready_for_python(text: Column, level: str) -> Column:
    """Stop-phrase removal as a stage of its own, so that the UDF after it reads a plain column:
    Spark leaves a UDF unplanned when its collapsed input mixes lambdas and staged fields."""
    out = drop_stop_lines(text, level)
    return out if level == "conservative" else evaluate_here(out)


# Compaction of masked text after the filler phrases are gone: step(text, level), in order.
COMPACT_STEPS = [
    finish_filler,
    ready_for_python,
    dedupe_masked_clauses,
    lambda t, level: dedupe_tracebacks(t),
    lambda t, level: dedupe_masked_sentences(t),
    lambda t, level: dedupe_paragraphs(t),
    lambda t, level: collapse_repeated_lines(t),
]
