"""Condensers for tool outputs: one expression per kind of tool and a router over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promptloom.functions import rules
from promptloom.functions.regex import any_of, contains_any, found, let, sub
from promptloom.functions.rules import OutputLimits
from promptloom.functions.text import first_where, lines, rstrip, strip, take, take_last

LIMITS = OutputLimits()


def _starts(col: Column, heads: list[str]) -> Column:
    return any_of([col.startswith(h) for h in heads])


def _join(rows: Column) -> Column:
    return F.array_join(rows, "\n")


def _note(rows: Column, head: str, tail: str) -> Column:
    return F.concat(F.lit(head), F.size(rows).cast("string"), F.lit(tail))


def _last(rows: Column) -> Column:
    return F.element_at(rows, -1)


def _labelled(label: str, items: Column, n: int | None) -> Column:
    """``label: a, b`` or null when there is no item."""
    return F.when(
        F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(_first(items, n), ", "))
    )


def _first(rows: Column, n: int | None) -> Column:
    return rows if n is None else take(rows, n)


def _fits(rows: Column, n: int | None) -> Column:
    return F.lit(True) if n is None else F.size(rows) <= n


def _cap(text: Column, rows: Column, n: int | None, tail: str = " total lines]") -> Column:
    """Text of at most ``n`` lines passes; longer text keeps the first ``n`` and a count."""
    if n is None:
        return text
    capped = F.concat(_join(take(rows, n)), _note(rows, "\n[", tail))
    return F.when(F.size(rows) <= n, text).otherwise(capped)


def cap_lines(text: Column, n: int | None, tail: str = " total lines]") -> Column:
    return let(lines(strip(text)), lambda rows: _cap(text, rows, n, tail))


def git_status(text: Column, rows: Column, limits: OutputLimits = LIMITS) -> Column:
    staged_heads = ["new file:", "modified:", "deleted:", "renamed:"]
    noise = ["#", "On branch", "Your branch", "Changes", "Untracked", "  (use"]

    def run(all_rows: Column) -> Column:
        bare = F.transform(
            all_rows,
            lambda r: F.struct(
                strip(r).alias("s"),
                r.contains("??").alias("unknown"),
            ),
        )
        staged = F.filter(bare, lambda r: _starts(r["s"], staged_heads))
        rest = F.filter(
            bare,
            lambda r: ~_starts(r["s"], staged_heads) & (r["s"] != "") & ~_starts(r["s"], noise),
        )
        texts = lambda items: F.transform(items, lambda r: r["s"])
        untracked = F.transform(
            F.filter(rest, lambda r: r["unknown"]), lambda r: F.ltrim(r["s"], F.lit("? "))
        )
        branch = first_where(all_rows, lambda r: r.contains("On branch"))
        report = F.concat_ws(
            "\n",
            strip(branch),
            _labelled("staged", texts(staged), limits.status_names),
            _labelled("modified", texts(F.filter(rest, lambda r: ~r["unknown"])), limits.status_names),
            _labelled("untracked", untracked, limits.status_names),
        )
        return let(
            report,
            lambda t: F.when(F.size(all_rows) == 0, text)
            .when(t == "", F.lit("clean"))
            .otherwise(t),
        )

    return run(rows)


def git_log(text: Column, rows: Column) -> Column:
    short = F.forall(take(rows, 5), lambda r: F.length(r) < 120)
    verbose = F.exists(take(rows, 10), lambda r: r.startswith("Author:"))

    def is_head(r: Column) -> Column:
        return r.startswith("commit ")

    def is_message(r: Column) -> Column:
        return r.startswith("    ") & (strip(r) != "")

    def subjects(marks: Column) -> Column:
        # marks: heads and message lines in order; a subject is a message right after a head.
        def pair(m: Column, i: Column) -> Column:
            before = F.get(marks, i - 1)
            return F.when(
                (i > 0) & ~is_head(m) & is_head(before) & (F.length(before) > 7),
                F.concat(F.substring(before, 8, 7), F.lit(" "), strip(m)),
            )

        return F.filter(F.transform(marks, pair), lambda s: s.isNotNull())

    marks = F.filter(rows, lambda r: is_head(r) | is_message(r))
    commits = let(marks, subjects)
    return F.when(short & ~verbose, text).otherwise(
        let(commits, lambda c: F.when(F.size(c) > 0, _join(c)).otherwise(text))
    )


def git_diff(text: Column, rows: Column, limits: OutputLimits = LIMITS) -> Column:
    kept = F.filter(rows, lambda r: _starts(r, ["diff --", "---", "+++", "@@", "+", "-"]))
    report = let(
        kept,
        lambda k: F.when(
            ~_fits(k, limits.diff_lines),
            F.concat(_join(_first(k, limits.diff_lines)), _note(rows, "\n[diff truncated, ", " total lines]")),
        ).otherwise(_join(k)),
    )
    return F.when(_fits(rows, limits.diff_passes), text).otherwise(report)


def git_action(verb: Column, text: Column, rows: Column, exit_code: Column, limits: OutputLimits = LIMITS) -> Column:
    arrow = first_where(rows, lambda r: r.contains("->"))
    target = F.regexp_extract(strip(arrow), r"(?dU)(\S+)\z", 1)
    sha = F.regexp_extract(F.get(rows, F.lit(0)), "[0-9a-f]{7,}", 0)
    done = (
        F.when(verb == "push", F.concat(F.lit("ok "), F.coalesce(target, F.lit("pushed"))))
        .when(
            verb == "commit",
            F.concat(F.lit("ok "), F.coalesce(F.nullif(sha, F.lit("")), F.lit("committed"))),
        )
        .otherwise(F.lit("ok"))
    )
    return F.when(exit_code == 0, done).otherwise(_cap(text, rows, limits.action_lines))


def suite_run(text: Column, rows: Column, exit_code: Column, limits: OutputLimits = LIMITS) -> Column:
    def passed() -> Column:
        summary = F.filter(take_last(rows, 10), lambda r: found(r, r"pass|ok|success|\d+ test", "i"))
        return let(
            summary,
            lambda s: F.when(F.size(s) > 0, _join(s))
            .when(F.size(rows) > 0, _last(rows))
            .otherwise(F.lit("ok")),
        )

    def failed() -> Column:
        failures = F.transform(
            F.filter(rows, lambda r: found(r, "fail|error|panic|assert|FAILED", "i")), strip
        )
        summary = first_where(
            take_last(rows, 5), lambda r: found(r, r"\d+.*(?:pass|fail)", "i")
        )
        tail = F.when(summary != "", F.array(strip(summary))).otherwise(
            F.array().cast("array<string>")
        )
        return let(
            failures,
            lambda f: F.when(F.size(f) > 0, _join(F.concat(_first(f, limits.test_failures), tail))).otherwise(
                _cap(text, rows, limits.test_lines)
            ),
        )

    return F.when(exit_code == 0, passed()).otherwise(failed())


def collapse_output_lines(text: Column, rows: Column, max_lines: int | None) -> Column:
    """Long output: adjacent equal lines once with a count, then a cap on the line number."""

    def runs(bare: Column) -> Column:
        starts = F.filter(
            F.transform(
                bare,
                lambda b, i: F.when((i > 0) & (b == F.get(bare, i - 1)), None).otherwise(i),
            ),
            lambda i: i.isNotNull(),
        )

        def emit(at: Column, start: Column, j: Column) -> Column:
            count = F.coalesce(F.get(at, j + 1), F.size(rows)) - start
            row = F.get(rows, start)
            mark = F.concat(F.lit("  [repeated "), count.cast("string"), F.lit("x]"))
            return F.when(count > 1, F.array(row, mark)).otherwise(F.array(row))

        kept = let(
            starts, lambda at: F.flatten(F.transform(at, lambda s, j: emit(at, s, j)))
        )
        return let(
            kept,
            lambda k: F.when(
                ~_fits(k, max_lines),
                F.concat(_join(_first(k, max_lines)), _note(rows, "\n[", " total lines]")),
            ).otherwise(_join(k)),
        )

    return F.when(_fits(rows, max_lines), text).otherwise(
        let(F.transform(rows, strip), runs)
    )


def docker(sub_command: Column, text: Column, rows: Column, limits: OutputLimits = LIMITS) -> Column:
    table = F.concat(
        take(rows, 1),
        _first(F.transform(F.slice(rows, 2, F.size(rows)), lambda r: sub(r, r"\s{2,}", "  ")), limits.container_rows),
    )
    return (
        F.when(
            sub_command == "ps", F.when(F.size(rows) == 0, text).otherwise(_join(table))
        )
        .when(sub_command.isin("logs", "compose"), collapse_output_lines(text, rows, limits.container_lines))
        .otherwise(_cap(text, rows, limits.container_lines))
    )


def file_read(text: Column, rows: Column, limits: OutputLimits = LIMITS) -> Column:
    if limits.file_passes is None:
        return text
    report = F.concat(
        _join(take(rows, limits.file_head)),
        _note(rows, "\n...\n[", " total lines]\n"),
        _join(take_last(rows, limits.file_tail)),
    )
    return F.when(_fits(rows, limits.file_passes), text).otherwise(report)


def build_run(text: Column, rows: Column, exit_code: Column, limits: OutputLimits = LIMITS) -> Column:
    errors = F.filter(rows, lambda r: contains_any(r, ["error", "Error", "ERROR"]))
    failed = let(
        errors,
        lambda e: F.when(F.size(e) > 0, _join(_first(e, limits.build_errors))).otherwise(_cap(text, rows, limits.build_lines)),
    )
    passed = F.when(F.size(rows) > 0, _last(rows)).otherwise(F.lit("ok"))
    return F.when(exit_code == 0, passed).otherwise(failed)


def lint_run(text: Column, rows: Column, limits: OutputLimits = LIMITS) -> Column:
    issues = F.filter(rows, lambda r: contains_any(r, ["error", "warn", "Error", "Warning"]))
    summary = F.filter(take_last(rows, 5), lambda r: found(r, r"\d"))
    return F.when(_fits(rows, limits.lint_issues), text).otherwise(_join(F.concat(_first(issues, limits.lint_issues), summary)))


def cloud_response(text: Column, limits: OutputLimits = LIMITS) -> Column:
    if limits.cloud_chars is None:
        return text
    return F.when(
        F.length(text) > limits.cloud_chars,
        F.concat(
            F.substring(text, 1, limits.cloud_chars),
            F.lit("\n[truncated, "),
            F.length(text).cast("string"),
            F.lit(" bytes total]"),
        ),
    ).otherwise(text)


def download(rows: Column, limits: OutputLimits = LIMITS) -> Column:
    kept = F.filter(rows, lambda r: ~found(r, r"\A(?:\s*\d+%|#|=+>)"))
    return let(_join(kept), lambda t: cap_lines(t, limits.download_lines))


def generic(text: Column, rows: Column, limits: OutputLimits = LIMITS) -> Column:
    return let(collapse_output_lines(text, rows, limits.generic_lines), lambda t: cap_lines(t, limits.generic_lines))


def route(command: Column, args: Column) -> Column:
    """Name of the condenser for a command line; first fitting rule wins."""
    first = F.coalesce(F.get(args, F.lit(0)), F.lit(""))
    runs = lambda name: first == name
    git = command == "git"
    return (
        F.when(git & runs("status"), "git_status")
        .when(git & runs("log"), "git_log")
        .when(git & first.isin("diff", "show"), "git_diff")
        .when(git & first.isin("push", "pull", "fetch", "add", "commit"), "git_action")
        .when(command.isin("cargo", "npm", "pnpm", "yarn") & runs("test"), "test")
        .when(command == "pytest", "test")
        .when(
            (command == "python")
            & F.array_contains(args, "-m")
            & F.array_contains(args, "pytest"),
            "test",
        )
        .when((command == "go") & runs("test"), "test")
        .when(command.isin("jest", "vitest", "mocha"), "test")
        .when((command == "docker") & (F.size(args) > 0), "docker")
        .when(command == "kubectl", "kubectl")
        .when(command.isin("ls", "find", "tree"), "listing")
        .when(command.isin("cat", "head", "tail", "bat"), "file_read")
        .when(command.isin("grep", "rg", "ag"), "matches")
        .when(command.isin("cargo", "npm", "pnpm") & runs("build"), "build")
        .when(command.isin("eslint", "ruff", "clippy", "golangci-lint", "rubocop"), "lint")
        .when((command == "cargo") & runs("clippy"), "lint")
        .when(command == "aws", "cloud")
        .when(command.isin("curl", "wget"), "download")
        .otherwise("generic")
    )


def condensed(kind: Column, args: Column, output: Column, exit_code: Column, limits: OutputLimits = LIMITS) -> Column:
    """The condensed output, within ``limits``. Only the branch of a row's route is evaluated."""
    first = F.coalesce(F.get(args, F.lit(0)), F.lit(""))

    def by_route(rows: Column) -> Column:
        return (
            F.when(kind == "git_status", git_status(output, rows, limits))
            .when(kind == "git_log", git_log(output, rows))
            .when(kind == "git_diff", git_diff(output, rows, limits))
            .when(kind == "git_action", git_action(first, output, rows, exit_code, limits))
            .when(kind == "test", suite_run(output, rows, exit_code, limits))
            .when(kind == "docker", docker(first, output, rows, limits))
            .when(kind == "kubectl", _cap(output, rows, limits.list_lines))
            .when(kind == "listing", _cap(output, rows, limits.list_lines, " total entries]"))
            .when(kind == "file_read", file_read(output, rows, limits))
            .when(kind == "matches", _cap(output, rows, limits.list_lines, " matches total]"))
            .when(kind == "build", build_run(output, rows, exit_code, limits))
            .when(kind == "lint", lint_run(output, rows, limits))
            .when(kind == "download", download(rows, limits))
            .otherwise(generic(output, rows, limits))
        )

    return (
        F.when(F.length(output) < limits.passes_chars, output)
        .when(kind == "cloud", cloud_response(output, limits))
        .otherwise(let(lines(strip(output)), by_route))
    )


def archive_text(output: Column, limit: int | None = rules.ARCHIVE_MAX_CHARS) -> Column:
    """Output as archived: cut at the size limit with a marker; whole without a limit."""
    if limit is None:
        return output
    return F.when(
        F.length(output) > limit,
        F.concat(F.substring(output, 1, limit), F.lit(f"\n[truncated at {limit} bytes]")),
    ).otherwise(output)


def archive_name(command: Column) -> Column:
    return F.substring(F.translate(command, "/ ", "__"), 1, rules.ARCHIVE_NAME_CHARS)


