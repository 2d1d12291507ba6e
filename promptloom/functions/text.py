"""Scalar text functions over a column: redaction, previews, hashes, token estimates, shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions import rules
from promptloom.functions.regex import (
    OTHER_LINE_ENDS,
    WHITE_SPACE,
    any_of,
    contains_any,
    contains_one_of,
    find_all,
    found,
    let,
    sub,
)

_OTHER_LINE_END = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(col: Column) -> Column:
    """Trim white space at both ends. One parameter only: Spark would fill a second one with the
    element index when the function is used as a lambda."""
    return strip_chars(col, WHITE_SPACE)


def rstrip(col: Column) -> Column:
    return rstrip_chars(col, WHITE_SPACE)


def strip_chars(col: Column, chars: str) -> Column:
    return F.trim(col, F.lit(chars))


def rstrip_chars(col: Column, chars: str) -> Column:
    return F.rtrim(col, F.lit(chars))


def squeeze(col: Column) -> Column:
    """White-space runs become one space."""
    return sub(col, r"\s+", " ")


def unify_line_ends(col: Column) -> Column:
    odd = contains_one_of(col, OTHER_LINE_ENDS)
    return F.when(odd, F.regexp_replace(col, _OTHER_LINE_END, "\n")).otherwise(col)


def lines(col: Column) -> Column:
    """Lines of a text; a final line end does not open another line, empty text has none."""

    def cut(text: Column) -> Column:
        body = F.when(
            text.endswith("\n"), F.substring(text, F.lit(1), F.length(text) - 1)
        ).otherwise(text)
        return F.when(text == "", F.array().cast("array<string>")).otherwise(
            F.split(body, "\n", -1)
        )

    return let(col, lambda raw: let(unify_line_ends(raw), cut))


def line_count(col: Column) -> Column:
    newlines = F.octet_length(col) - F.octet_length(F.replace(col, F.lit("\n"), F.lit("")))
    plain = newlines + F.when((col == "") | col.endswith("\n"), 0).otherwise(1)
    odd = contains_any(col, OTHER_LINE_ENDS)
    return F.when(odd, F.size(lines(col))).otherwise(plain)


def sentences(stripped: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` followed by white space."""
    return F.split(stripped, r"(?dU)(?<=[.!?])\s+", -1)


def first_where(items: Column, test) -> Column:
    """First array element passing ``test``, else null."""
    return F.get(F.filter(items, test), F.lit(0))


def take(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def take_last(items: Column, n: int) -> Column:
    return let(items, lambda a: F.slice(a, F.greatest(F.size(a) - (n - 1), F.lit(1)), n))


# --- redaction, preview, hash -----------------------------------------------------------------

def redact(col: Column) -> Column:
    """Replace secrets by placeholders, rule after rule.

    Cheap substring tests decide whether any rule can fire; clean text (nearly all rows) never
    reaches a regex.
    """
    low = F.lower(col)
    suspicious = (
        contains_any(col, ["AKIA", "ASIA", "ghp_", "github_pat_", "sk-", "PRIVATE KEY-----", "eyJ"])
        | contains_any(low, ["aws_secret_access_key", "bearer", "ſ", "ı", "İ"])
        | (
            col.contains("=")
            & contains_any(col, ["KEY", "TOKEN", "SECRET", "PASS", "PWD"])
        )
        | (
            (col.contains("=") | col.contains(":"))
            & contains_any(low, ["api", "token", "secret", "password"])
        )
    )
    out = col
    for pattern, replacement in rules.SECRET_RULES:
        out = sub(out, pattern, replacement)
    return F.when(suspicious, out).otherwise(col)


def clip(redacted: Column, limit: int) -> Column:
    """Shorten already redacted text to ``limit`` characters with a marker."""
    text = strip(redacted)
    head = rstrip(F.substring(text, 1, limit - rules.PREVIEW_RESERVE))
    return F.when(
        F.length(text) > limit, F.concat(head, F.lit(rules.PREVIEW_MARKER))
    ).otherwise(text)


def preview(col: Column, limit: int = rules.PREVIEW_LIMIT) -> Column:
    return clip(redact(col), limit)


def text_hash(col: Column) -> Column:
    return F.sha2(col, 256)


# --- token estimate ---------------------------------------------------------------------------

def estimate_tokens(col: Column) -> Column:
    """Heuristic token count: characters over four, denser for code, logs and many lines. No text, null
    or empty, has none."""
    code = found(col, rules.TOKEN_CODE)
    log = found(col, rules.TOKEN_LOG, "i")
    many_lines = col.contains("\n") & (line_count(col) > rules.TOKEN_LINES_OVER)
    factor = F.lit(1.0)
    for test, extra in (
        (code, rules.TOKEN_CODE_EXTRA),
        (log, rules.TOKEN_LOG_EXTRA),
        (many_lines, rules.TOKEN_LINES_EXTRA),
    ):
        factor = factor + F.when(test, F.lit(extra)).otherwise(F.lit(0.0))
    raw = F.length(col) / F.lit(rules.TOKEN_CHARS) * factor + F.lit(rules.TOKEN_ROUND_UP)
    return F.when(col.isNull() | (col == ""), F.lit(0)).otherwise(F.greatest(F.lit(1), raw.cast("int")))


def savings(before: Column, after: Column, clamp: bool = False) -> Column:
    diff = before - after
    return F.greatest(F.lit(0), diff) if clamp else diff


def savings_percent(before: Column, after: Column, clamp: bool = False) -> Column:
    pct = F.when(
        before == 0, F.lit(0.0)
    ).otherwise((before - after) / before.cast("double") * F.lit(100.0))
    return F.greatest(F.lit(0.0), pct) if clamp else pct


# --- shapes -----------------------------------------------------------------------------------

def prompt_shape(col: Column, limit: int | None = None) -> Column:
    """Text without its particulars. Keys are made of the whole shape; ``limit`` cuts it for display."""
    shaped = sub(col, rules.FENCE, "<code_block>")
    shaped = sub(shaped, rules.SHAPE_PATH, "<path>")
    shaped = sub(shaped, r"\b\d+\b", "<num>")
    whole = F.lower(strip(squeeze(shaped)))
    return whole if limit is None else F.substring(whole, 1, limit)


def prompt_pattern_hash(input_type: Column, redacted: Column) -> Column:
    return text_hash(F.concat(input_type, F.lit(":"), prompt_shape(redacted)))


def words(col: Column) -> Column:
    """White-space separated words; empty text has none."""
    return F.filter(F.split(col, r"(?U)\s+", -1), lambda w: w != "")


def command_pattern(col: Column, first_words: int | None = None) -> Column:
    """Command without its particulars, all of it; ``first_words`` cuts it for display."""
    def generalise(token: Column) -> Column:
        return (
            F.when(token.startswith("-"), token)
            .when(token.contains("/") | found(token, r"\d"), F.lit("<arg>"))
            .when(F.length(token) > rules.COMMAND_PATTERN_LONG, F.lit("<long>"))
            .otherwise(token)
        )

    parts = words(col) if first_words is None else take(words(col), first_words)
    return F.array_join(F.transform(parts, generalise), " ")


def command_name(pattern: Column) -> Column:
    return F.substring_index(pattern, " ", 1)


def base_name(argv0: Column) -> Column:
    return F.substring_index(argv0, "/", -1)


# --- code fences ------------------------------------------------------------------------------

def _fence_key(index: Column) -> Column:
    return F.concat(F.lit(FENCE_KEY_HEAD), index.cast("string"), F.lit("__"))


FENCE_KEY_HEAD = f"__{rules.OWN_TOOL.upper()}_CODE_BLOCK_"


def fences(col: Column) -> Column:
    """Code fences of a text in order; texts without back-ticks never reach the regex."""
    return F.when(
        col.contains("```"), find_all(col, rules.FENCE)
    ).otherwise(F.array().cast("array<string>"))


def protect_fences(col: Column) -> Column:
    """Swap every code fence for a numbered placeholder."""

    def zip_keys(parts: Column) -> Column:
        return F.array_join(
            F.transform(
                parts,
                lambda part, i: F.when(
                    i < F.size(parts) - 1, F.concat(part, _fence_key(i))
                ).otherwise(part),
            ),
            "",
        )

    return F.when(
        col.contains("```"), let(F.split(col, f"(?d){rules.FENCE}", -1), zip_keys)
    ).otherwise(col)


def restore_fences(col: Column, blocks: Column) -> Column:
    """Put fences back in place of their placeholders, in one pass over the text. A placeholder without a
    block stays."""

    def put_back(text: Column) -> Column:
        numbers = F.regexp_extract_all(text, F.lit(f"{FENCE_KEY_HEAD}([0-9]+)__"), F.lit(1))

        def block(number: Column) -> Column:
            at = number.try_cast("int")
            known = F.when(at.cast("string") == number, F.get(blocks, at))
            return F.coalesce(known, F.concat(F.lit(FENCE_KEY_HEAD), number, F.lit("__")))

        def join(parts: Column) -> Column:
            filled = let(F.transform(numbers, block), lambda b: F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(b, i), F.lit("")))))
            return F.array_join(filled, "")

        return let(F.split(text, f"{FENCE_KEY_HEAD}[0-9]+__", -1), join)

    return let(
        col, lambda t: F.when(t.contains(FENCE_KEY_HEAD), put_back(t)).otherwise(t)
    )


# --- command line payload ---------------------------------------------------------------------

def prompt_argument(args: Column) -> Column:
    """The text a prompt tool was called with: ``struct(idx, value)``, null when there is none.

    A prompt flag wins; otherwise the longest argument that reads like natural language, first on
    ties. ``idx`` counts from 0 and includes the command itself at 0.
    """
    none = F.lit(None).cast("struct<idx:int,value:string>")

    def by_flag(item: Column, i: Column) -> Column:
        inline = any_of([item.startswith(f"{flag}=") for flag in rules.PROMPT_FLAGS])
        return (
            F.when(
                item.isin(rules.PROMPT_FLAGS) & (i < F.size(args) - 1),
                F.struct((i + 1).alias("idx"), F.get(args, i + 1).alias("value")),
            )
            .when(
                inline,
                F.struct(
                    i.alias("idx"),
                    F.substring(item, F.instr(item, "=") + 1, F.length(item)).alias("value"),
                ),
            )
            .otherwise(none)
        )

    def prose(item: Column, i: Column) -> Column:
        reads_like_text = (F.size(words(item)) >= rules.PAYLOAD_WORDS) | (
            F.length(item) > rules.PAYLOAD_CHARS
        )
        return F.when(
            (i > 0) & reads_like_text,
            F.struct(F.length(item).alias("n"), (-i).alias("neg"), item.alias("value")),
        )

    flagged = first_where(F.transform(args, by_flag), lambda s: s.isNotNull())
    longest = F.array_max(F.transform(args, prose))
    return F.coalesce(
        flagged,
        let(
            longest,
            lambda m: F.when(
                m.isNotNull(), F.struct((-m["neg"]).alias("idx"), m["value"].alias("value"))
            ).otherwise(none),
        ),
    )
