"""Ordered rule chain that tells shell commands, prompts, code and logs apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions import rules
from promptloom.functions.regex import (
    OTHER_LINE_ENDS,
    any_of,
    contains_any,
    contains_one_of,
    found,
    java,
    let,
    sql_text,
)
from promptloom.functions.text import lines, strip, unify_line_ends

CLASSIFICATION = (
    "struct<input_type:string,risk_level:string,should_optimize:boolean,reason:string,"
    "metadata:map<string,string>>"
)
# One shell word, quotes included; possessive so that long input cannot backtrack.
_SHELL_WORD = (
    r"(?:[^ \t\r\n'\"\\]++|\\[\s\S]|'[^']*+'|\"(?:[^\"\\]++|\\[\s\S])*+\")++"
)
_BALANCED = rf"\A(?:[ \t\r\n]++|{_SHELL_WORD})*+\z"
_UNQUOTE = r"(?s)'([^']*+)'|\"((?:[^\"\\]++|\\.)*+)\"|\\(.)"
_ODD_CASE = ["ſ", "ı", "İ"]
_DANGEROUS = "array({})".format(
    ", ".join(
        f"named_struct('name', {sql_text(p)}, 'pattern', {sql_text(java(p, 'i'))}, "
        f"'word', {sql_text(w)})"
        for p, w in zip(rules.DANGEROUS_PATTERNS, rules.DANGEROUS_WORDS)
    )
)


_QUOTES = ["'", '"', "\\"]
_SPACE = r"[ \t\r\n]"
# A plain word, and one that a command separator (&&, |, ;) also ends.
_PLAIN = r"[^ \t\r\n]++"
_PLAIN_TO_SEPARATOR = r"(?:[^ \t\r\n|;&]|&(?!&))++"


def _pick_two(col: Column, word: str) -> Column:
    head = rf"\A{_SPACE}*+({word})(?:{_SPACE}++({word}))?"
    return F.array(F.regexp_extract(col, head, 1), F.regexp_extract(col, head, 2))


def _quoted_words(segment: Column) -> Column:
    """First two words of a segment with quotes: removed where they balance, else kept."""
    unquoted = F.transform(
        _pick_two(segment, _SHELL_WORD), lambda w: F.regexp_replace(w, _UNQUOTE, "$1$2$3")
    )
    return F.when(segment.rlike(_BALANCED), unquoted).otherwise(_pick_two(segment, _PLAIN))


def _two_words(text: Column, first_segment: bool) -> Column:
    """First two shell words of a text or of its first segment.

    Quotes can change them only if one of the two contains a quote; else the rest of the text is
    never looked at.
    """

    def checked(pair: Column) -> Column:
        segment = text
        if first_segment:
            segment = strip(F.get(F.split(text, r"&&|[|;]", 2), F.lit(0)))
        quoted = contains_any(F.concat(pair[0], pair[1]), _QUOTES)
        return F.when(quoted, _quoted_words(segment)).otherwise(pair)

    return let(_pick_two(text, _PLAIN_TO_SEPARATOR if first_segment else _PLAIN), checked)


def _runs_command(word: Column, prefixes: list[str]) -> Column:
    return word.isin(prefixes) | any_of([word.startswith(p) for p in ("./", "../", "/")])


def shell_line(line: Column, prefixes: list[str] | None = None) -> Column:
    """Does this one (stripped) line start like a shell command?"""
    prefixes = prefixes or rules.SHELL_PREFIXES
    bare = F.when(
        line.startswith("$ ") | line.startswith("# "),
        strip(F.substring(line, F.lit(3), F.length(line))),
    ).otherwise(line)

    def verdict(pair: Column) -> Column:
        second = pair[1]
        first = F.when(pair[0].isin(rules.SHELL_WRAPPERS) & (second != ""), second).otherwise(
            pair[0]
        )
        assigned = first.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*=") & (second != "")
        return _runs_command(first, prefixes) | (assigned & _runs_command(second, prefixes))

    return (line != "") & let(bare, lambda b: let(_two_words(b, True), verdict))


def looks_like_shell(text: Column, prefixes: list[str] | None = None) -> Column:
    """One line: the line is shell-like. More lines: no prompt marker and every line is."""

    def block(rows: Column) -> Column:
        full = F.filter(F.transform(rows, strip), lambda r: r != "")
        return F.forall(full, lambda r: shell_line(r, prefixes))

    # Most prose fails on its first line; only the rest pays for the other tests.
    first = let(
        strip(F.substring_index(unify_line_ends(text), "\n", 1)), lambda f: (f == "") | shell_line(f, prefixes)
    )
    multi = first & ~has_marker(text, rules.AI_MARKERS) & block(lines(text))
    return F.when(contains_any(text, ["\n", *OTHER_LINE_ENDS]), multi).otherwise(
        shell_line(text, prefixes)
    )


def shell_type(text: Column) -> Column:
    first = let(_two_words(strip(text), False), lambda p: p[0])
    return let(
        first,
        lambda w: F.when(w == "git", F.lit("git_instruction"))
        .when(w.isin(rules.FILESYSTEM_COMMANDS), F.lit("filesystem_instruction"))
        .otherwise(F.lit("raw_shell_command")),
    )


def dangerous_rule(text: Column) -> Column:
    """The first dangerous pattern found in the text, else null."""

    def first_hit(low: Column) -> Column:
        odd = contains_any(text, _ODD_CASE)
        hits = F.filter(
            F.expr(_DANGEROUS),
            lambda rule: (F.contains(low, rule["word"]) | odd) & F.rlike(text, rule["pattern"]),
        )
        return F.get(hits, F.lit(0))["name"]

    return let(F.lower(text), first_hit)


def is_dangerous(text: Column) -> Column:
    return dangerous_rule(text).isNotNull()


def is_destructive_sql(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("drop")) & found(text, rules.DESTRUCTIVE_SQL, "i")


def is_moderate_risk_shell(text: Column) -> Column:
    return found(text, rules.MODERATE_RISK)


def looks_like_log(text: Column, low: Column | None = None) -> Column:
    """At least two lines, and a third of the non-blank ones, start like log records."""
    unified = unify_line_ends(text)
    log_lines = F.regexp_count(unified, F.lit(rf"(?dUmi)^[^\S\n]*{rules.LOG_PREFIX}"))
    full_lines = F.regexp_count(unified, F.lit(r"(?dUm)^[^\S\n]*\S"))
    return unified.contains("\n") & (
        log_lines >= F.greatest(F.lit(2), F.floor(full_lines / 3))
    )


def has_marker(text: Column, markers: list[str]) -> Column:
    return let(F.lower(text), lambda low: contains_one_of(low, markers))


def has_fence(text: Column) -> Column:
    """An opening and a later closing fence."""
    return text.contains("```") & found(text, rules.FENCE)


def has_path(text: Column) -> Column:
    return contains_any(text, ["/", ":\\"]) & found(text, rules.FILE_PATH)


def has_inline_command(text: Column) -> Column:
    return contains_one_of(text, rules.INLINE_COMMAND_HINTS) & found(text, rules.INLINE_COMMAND)


def looks_like_instruction(text: Column) -> Column:
    return (
        text.endswith("?")
        | F.lower(text).rlike(r"(?dU)\A" + rules.IMPERATIVE[1:])
        | (text.rlike(rf"(?dU)\A\s*+(?:\S++\s++){{{rules.INSTRUCTION_WORDS - 1}}}\S") & ~shell_line(text))
    )


def classify(col: Column, prefixes: list[str] | None = None) -> Column:
    """Struct of input type, risk, whether to compress, reason and metadata. First rule wins."""

    def result(kind, risk, optimise: bool, reason, meta=None) -> Column:
        kind, risk, reason = (F.lit(v) if isinstance(v, str) else v for v in (kind, risk, reason))
        meta = meta if meta is not None else F.create_map().cast("map<string,string>")
        return F.struct(
            kind.alias("input_type"),
            risk.alias("risk_level"),
            F.lit(optimise).alias("should_optimize"),
            reason.alias("reason"),
            meta.alias("metadata"),
        ).cast(CLASSIFICATION)

    def flag(name: str, value: Column) -> Column:
        return F.create_map(F.lit(name), value.cast("string"))

    def command(text: Column, danger: Column) -> Column:
        return F.when(
            danger.isNotNull(),
            result(
                "dangerous_command", "high", False, F.concat(F.lit(rules.REASON_DANGEROUS), danger)
            ),
        ).otherwise(
            result(
                shell_type(text),
                F.when(is_moderate_risk_shell(text), F.lit("medium")).otherwise(F.lit("low")),
                False, rules.REASON_SHELL, flag("shell_like", F.lit(True)),
            )
        )

    def prose(text: Column, low: Column, seen: Column) -> Column:
        ai, code, fence, logs = seen["ai"], seen["code"], seen["fence"], seen["logs"]
        debug_context = result(
            F.when(ai, F.lit("debugging_request")).otherwise(F.lit("log_or_traceback")),
            F.when(has_path(text), F.lit("medium")).otherwise(F.lit("low")),
            True, rules.REASON_DEBUG, flag("has_paths", has_path(text)),
        )
        return (
            F.when(seen["debug"] & (low.contains("traceback") | logs), debug_context)
            .when(
                fence & (ai | code),
                result(
                    "mixed_input", "medium", True, rules.REASON_MIXED,
                    flag("has_code_fence", F.lit(True)),
                ),
            )
            .when(logs, result("log_or_traceback", "low", True, rules.REASON_LOG))
            .when(
                code | fence,
                result(
                    "code_instruction",
                    F.when(fence, F.lit("medium")).otherwise(F.lit("low")),
                    True, rules.REASON_CODE, flag("has_code_fence", fence),
                ),
            )
            .when(
                ai & has_inline_command(text),
                result("mixed_input", "medium", True, rules.REASON_INLINE),
            )
            .when(
                ai | looks_like_instruction(text),
                result("ai_prompt", "low", True, rules.REASON_PROMPT),
            )
            .otherwise(result("ai_prompt", "low", True, rules.REASON_OTHER))
        )

    def chain(text: Column, low: Column, shell: Column) -> Column:
        seen = F.struct(
            contains_one_of(low, rules.DEBUG_MARKERS).alias("debug"),
            contains_one_of(low, rules.AI_MARKERS).alias("ai"),
            contains_one_of(low, rules.CODE_MARKERS).alias("code"),
            has_fence(text).alias("fence"),
            looks_like_log(text, low).alias("logs"),
        )
        dangerous_sql = low.contains("drop") & is_destructive_sql(text)
        return (
            F.when(text == "", result("ai_prompt", "low", False, rules.REASON_EMPTY))
            .when(shell | dangerous_sql, let(dangerous_rule(text), lambda d: command(text, d)))
            .otherwise(let(seen, lambda m: prose(text, low, m)))
        )

    def with_low(text: Column) -> Column:
        shell = looks_like_shell(text, prefixes)
        return let(F.lower(text), lambda low: let(shell, lambda sh: chain(text, low, sh)))

    return let(strip(col), with_low)
