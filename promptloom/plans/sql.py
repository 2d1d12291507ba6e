"""DuckDB SQL builders for the reference form of each text function (correctness checks only)."""

from __future__ import annotations

from itertools import count

from promptloom.functions import rules
from promptloom.functions.regex import WHITE_SPACE

_names = count()


NOT_EMPTY = " <> ''"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def fresh() -> str:
    return f"v{next(_names)}"


def let(x: str, body) -> str:
    v = fresh()
    return f"list_transform([{x}], lambda {v}: {body(v)})[1]"


def each(xs: str, body) -> str:
    v = fresh()
    return f"list_transform({xs}, lambda {v}: {body(v)})"


def each_i(xs: str, body) -> str:
    v, i = fresh(), fresh()
    return f"list_transform({xs}, lambda {v}, {i}: {body(v, i)})"


def keep(xs: str, body) -> str:
    v = fresh()
    return f"list_filter({xs}, lambda {v}: {body(v)})"


def keep_i(xs: str, body) -> str:
    v, i = fresh(), fresh()
    return f"list_filter({xs}, lambda {v}, {i}: {body(v, i)})"


def strip(x: str, chars: str = WHITE_SPACE) -> str:
    return f"trim({x}, {q(chars)})"


def rstrip(x: str, chars: str = WHITE_SPACE) -> str:
    return f"rtrim({x}, {q(chars)})"


def pattern(p: str, flags: str = "") -> str:
    return q(f"(?{flags}){p}" if flags else p)


def sub(x: str, p: str, r: str = "", flags: str = "") -> str:
    return f"regexp_replace({x}, {pattern(p, flags)}, {q(r)}, 'g')"


def found(x: str, p: str, flags: str = "") -> str:
    return f"regexp_matches({x}, {pattern(p, flags)})"


def find_all(x: str, p: str, flags: str = "") -> str:
    return f"regexp_extract_all({x}, {pattern(p, flags)})"


def has(x: str, word: str) -> str:
    return f"contains({x}, {q(word)})"


def has_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(has(x, w) for w in words) + ")"


def starts_any(x: str, heads: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(h)})" for h in heads) + ")"


def within(x: str, values: list[str]) -> str:
    return f"({x} IN ({', '.join(q(v) for v in values)}))"


def squeeze(x: str) -> str:
    return sub(x, r"\s+", " ")


def lines(x: str) -> str:
    cut = lambda t: (
        f"CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split(CASE WHEN ends_with({t}, chr(10)) "
        f"THEN left({t}, length({t}) - 1) ELSE {t} END, chr(10)) END"
    )
    return let(x, cut)


def join(xs: str, by: str = "\n") -> str:
    return f"coalesce(array_to_string({xs}, {q(by)}), '')"


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def first_of_each(xs: str, keys: str) -> str:
    return keep_i(xs, lambda _, i: f"list_position({keys}, {keys}[{i}]) = {i}")


def words(x: str) -> str:
    return keep(f"string_split_regex({x}, '\\s+')", lambda w: f"{w} <> ''")


# --- redaction, tokens, shapes ----------------------------------------------------------------

def redact(x: str) -> str:
    for p, r in rules.SECRET_RULES:
        x = sub(x, p, r)
    return x


def clip(x: str, limit: int) -> str:
    cut = lambda t: (
        f"CASE WHEN length({t}) > {limit} THEN {rstrip(f'left({t}, {limit - 32})')} "
        f"|| {q(rules.PREVIEW_MARKER)} ELSE {t} END"
    )
    return let(strip(x), cut)


def tokens(x: str) -> str:
    def body(t: str) -> str:
        ascii_words = _encode(t)
        code = found(ascii_words, rules.TOKEN_CODE)
        log = found(ascii_words, rules.TOKEN_LOG, "i")
        many = f"(contains({t}, chr(10)) AND len({lines(t)}) > 8)"
        case = lambda c, v: f"CASE WHEN {c} THEN {v}::DOUBLE ELSE 0.0::DOUBLE END"
        factor = f"(1.0::DOUBLE + {case(code, 0.15)} + {case(log, 0.15)} + {case(many, 0.10)})"
        raw = f"trunc(length({t})::DOUBLE / 4.0::DOUBLE * {factor} + 0.999::DOUBLE)::INTEGER"
        return f"CASE WHEN coalesce({t}, '') = '' THEN 0 ELSE greatest(1, {raw}) END"

    return let(x, body)


def percent(before: str, after: str) -> str:
    return (
        f"(CASE WHEN {before} = 0 THEN 0.0::DOUBLE ELSE "
        f"({before} - {after})::DOUBLE / {before}::DOUBLE * 100.0::DOUBLE END)"
    )


def shape(x: str) -> str:
    out = sub(x, rules.FENCE, "<code_block>")
    out = sub(out, rules.SHAPE_PATH, "<path>")
    out = sub(out, r"\b\d+\b", "<num>")
    return f"lower({strip(squeeze(out))})"


def command_pattern(x: str) -> str:
    general = lambda t: (
        f"CASE WHEN starts_with({t}, '-') THEN {t} WHEN contains({t}, '/') OR {found(t, '[0-9]')} "
        f"THEN '<arg>' WHEN length({t}) > 40 THEN '<long>' ELSE {t} END"
    )
    return join(each(words(x), general), " ")


# --- fences -----------------------------------------------------------------------------------

FENCE_HEAD = f"__{rules.OWN_TOOL.upper()}_CODE_BLOCK_"


def protect(x: str) -> str:
    parts = f"string_split_regex({x}, {q(rules.FENCE)})"
    glue = lambda ps: join(
        each_i(
            ps,
            lambda p, i: f"CASE WHEN {i} < len({ps}) THEN {p} || {q(FENCE_HEAD)} || ({i} - 1) || '__' "
            f"ELSE {p} END",
        ),
        "",
    )
    return let(parts, glue)


def restore(x: str, blocks: str) -> str:
    """Up to the eight fences that any text of the test tables can hold."""
    for i in range(8):
        x = f"replace({x}, {q(f'{FENCE_HEAD}{i}__')}, coalesce({blocks}[{i + 1}], ''))"
    return x


# --- classifier -------------------------------------------------------------------------------

_WORD = r"(?:[^ \t\r\n'\"\\]|\\[\s\S]|'[^']*'|\"(?:[^\"\\]|\\[\s\S])*\")+"


def two_words(seg: str) -> str:
    def pick(word: str) -> str:
        p = rf"^[ \t\r\n]*({word})(?:[ \t\r\n]+({word}))?"
        return f"[regexp_extract({seg}, {q(p)}, 1), regexp_extract({seg}, {q(p)}, 2)]"

    unquoted = each(
        pick(_WORD), lambda w: sub(w, r"(?s)'([^']*)'|\"((?:[^\"\\]|\\.)*)\"|\\(.)", r"\1\2\3")
    )
    balanced = found(seg, rf"\A(?:[ \t\r\n]+|{_WORD})*\z")
    plain = pick(r"[^ \t\r\n]+")
    quoted = has_any(seg, ["'", '"', "\\"])
    return f"(CASE WHEN {quoted} AND {balanced} THEN {unquoted} ELSE {plain} END)"


def _runs(w: str) -> str:
    return f"({within(w, rules.SHELL_PREFIXES)} OR {starts_any(w, ['./', '../', '/'])})"


def shell_line(x: str) -> str:
    def by_line(t: str) -> str:
        bare = (
            f"CASE WHEN starts_with({t}, '$ ') OR starts_with({t}, '# ') "
            f"THEN {strip(f'substring({t}, 3)')} ELSE {t} END"
        )
        seg = strip(f"string_split_regex({bare}, '&&|[|;]')[1]")

        def verdict(p: str) -> str:
            first = (
                f"(CASE WHEN {within(p + '[1]', rules.SHELL_WRAPPERS)} AND {p}[2] <> '' "
                f"THEN {p}[2] ELSE {p}[1] END)"
            )
            return let(
                first,
                lambda f: f"({_runs(f)} OR ({found(f, '^[A-Za-z_][A-Za-z0-9_]*=')} "
                f"AND {p}[2] <> '' AND {_runs(p + '[2]')}))",
            )

        return f"({t} <> '' AND {let(seg, lambda s: let(two_words(s), verdict))})"

    return let(x, by_line)


def looks_like_shell(t: str) -> str:
    full = keep(each(lines(t), strip), lambda r: f"{r} <> ''")
    every = f"len({keep(full, lambda r: f'NOT {shell_line(r)}')}) = 0"
    return (
        f"(CASE WHEN contains({t}, chr(10)) THEN NOT {has_any(f'lower({t})', rules.AI_MARKERS)} "
        f"AND {every} ELSE {shell_line(t)} END)"
    )


def dangerous(t: str) -> str:
    cases = " ".join(f"WHEN {found(t, p, 'i')} THEN {q(p)}" for p in rules.DANGEROUS_PATTERNS)
    return f"(CASE {cases} END)"


def looks_like_log(t: str) -> str:
    full = keep(lines(t), lambda r: f"{strip(r)} <> ''")
    return let(
        full,
        lambda rows: f"(len({keep(rows, lambda r: found(r, '^\\s*' + rules.LOG_PREFIX, 'i'))}) "
        f">= greatest(2, len({rows}) // 3))",
    )


def shell_type(t: str) -> str:
    first = f"({two_words(t)})[1]"
    return let(
        first,
        lambda w: f"CASE WHEN {w} = 'git' THEN 'git_instruction' WHEN "
        f"{within(w, rules.FILESYSTEM_COMMANDS)} THEN 'filesystem_instruction' "
        f"ELSE 'raw_shell_command' END",
    )


def looks_like_instruction(t: str) -> str:
    return (
        f"(ends_with({t}, '?') OR {found(f'lower({t})', rules.IMPERATIVE)} "
        f"OR (len({words(t)}) >= 6 AND NOT {shell_line(t)}))"
    )


def class_ctes(source: str, text: str = "text", name: str = "classed") -> str:
    """CTEs that add c_type, c_risk, c_go, c_reason to a table."""
    t = "c_t"
    return f"""
    {name}_0 AS (SELECT *, {strip(text)} AS c_t FROM {source}),
    {name}_1 AS (SELECT *, {looks_like_shell(t)} AS c_shell, {dangerous(t)} AS c_danger,
        {found(t, rules.DESTRUCTIVE_SQL, 'i')} AS c_sql,
        {has_any('lower(c_t)', rules.DEBUG_MARKERS)} AS c_debug,
        {has_any('lower(c_t)', rules.AI_MARKERS)} AS c_ai,
        {has_any('lower(c_t)', rules.CODE_MARKERS)} AS c_code,
        {found(t, rules.FENCE)} AS c_fence, {looks_like_log(t)} AS c_log,
        {found(t, rules.FILE_PATH)} AS c_path, {found(t, rules.INLINE_COMMAND)} AS c_inline,
        {found(t, rules.MODERATE_RISK)} AS c_moderate, {looks_like_instruction(t)} AS c_ask
      FROM {name}_0),
    {name}_2 AS (SELECT *, CASE WHEN c_t = '' THEN 1
        WHEN c_danger IS NOT NULL AND (c_shell OR c_sql) THEN 2 WHEN c_shell THEN 3
        WHEN c_debug AND (contains(lower(c_t), 'traceback') OR c_log) THEN 4
        WHEN c_fence AND (c_ai OR c_code) THEN 5 WHEN c_log THEN 6
        WHEN c_code OR c_fence THEN 7 WHEN c_inline AND c_ai THEN 8
        WHEN c_ai OR c_ask THEN 9 ELSE 10 END AS c_rule FROM {name}_1),
    {name} AS (SELECT *,
      CASE c_rule WHEN 1 THEN 'ai_prompt' WHEN 2 THEN 'dangerous_command'
        WHEN 3 THEN {shell_type(t)}
        WHEN 4 THEN (CASE WHEN c_ai THEN 'debugging_request' ELSE 'log_or_traceback' END)
        WHEN 5 THEN 'mixed_input' WHEN 6 THEN 'log_or_traceback' WHEN 7 THEN 'code_instruction'
        WHEN 8 THEN 'mixed_input' ELSE 'ai_prompt' END AS c_type,
      CASE WHEN c_rule = 2 THEN 'high'
        WHEN (c_rule = 3 AND c_moderate) OR (c_rule = 4 AND c_path) OR c_rule IN (5, 8)
          OR (c_rule = 7 AND c_fence) THEN 'medium' ELSE 'low' END AS c_risk,
      c_rule > 3 AS c_go,
      CASE c_rule WHEN 1 THEN {q(rules.REASON_EMPTY)}
        WHEN 2 THEN {q(rules.REASON_DANGEROUS)} || c_danger WHEN 3 THEN {q(rules.REASON_SHELL)}
        WHEN 4 THEN {q(rules.REASON_DEBUG)} WHEN 5 THEN {q(rules.REASON_MIXED)}
        WHEN 6 THEN {q(rules.REASON_LOG)} WHEN 7 THEN {q(rules.REASON_CODE)}
        WHEN 8 THEN {q(rules.REASON_INLINE)} WHEN 9 THEN {q(rules.REASON_PROMPT)}
        ELSE {q(rules.REASON_OTHER)} END AS c_reason
      FROM {name}_2)"""


# --- compression ------------------------------------------------------------------------------

# RE2 word boundaries are ASCII: accented letters pass through as ASCII word characters.
_ACCENTED = "àâäçèéêëîïñóôöùûüßáíúÀÂÄÇÈÉÊËÎÏÑÓÔÖÙÛÜÁÍÚœæ"


def _encode(x: str) -> str:
    for ch in _ACCENTED:
        x = f"replace({x}, {q(ch)}, 'Zq{ord(ch):x}qZ')"
    return x


def _decode(x: str) -> str:
    for ch in _ACCENTED:
        x = f"replace({x}, 'Zq{ord(ch):x}qZ', {q(ch)})"
    return x


def filler_list(level: str) -> list[tuple[str, str]]:
    lists = [rules.FILLER_CONSERVATIVE, rules.FILLER_MODERATE, rules.FILLER_AGGRESSIVE]
    return [r for group in lists[: rules.LEVELS.index(level) + 1] for r in group]


def clean_fragments(x: str) -> str:
    whole = lambda s: (
        f"{s} <> '' AND ({found(s, '^\\p{Lu}')} OR len({words(rstrip(s, '.!?'))}) > 1)"
    )
    out = join(keep(sentences(strip(x)), whole), " ")
    for ch in ".!?":
        out = sub(out, rf"[{ch}](?:\s*[{ch}])+", ch)
    out = sub(out, r"\.\s*\.", ".")
    return let(
        out,
        lambda t: f"CASE WHEN {found(t, '^\\p{Ll}')} THEN upper(left({t}, 1)) || substring({t}, 2) "
        f"ELSE {t} END",
    )


def remove_filler(x: str, level: str) -> str:
    out = _encode(x)
    for p, r in filler_list(level):
        out = sub(out, p, r, "i")
    out = _decode(out)
    out = sub(out, r"[ \t]{2,}", " ")
    out = sub(out, r"\.\s*\.", ".")
    out = sub(out, r"^\s*[.!?,;]\s*", "", "m")
    out = sub(out, r"\s+([.!?,;])", r"\1")
    out = sub(out, r"\n{3,}", "\n\n")
    if level != "conservative":
        out = clean_fragments(out)
    return strip(out)


def drop_stop_lines(x: str, level: str) -> str:
    phrases = {
        "conservative": [], "moderate": rules.STOP_MODERATE,
        "aggressive": rules.STOP_MODERATE + rules.STOP_AGGRESSIVE,
    }[level]
    if not phrases:
        return x
    drop = lambda r: " OR ".join(found(strip(r), p, "i") for p in phrases)
    return join(keep(lines(x), lambda r: f"NOT ({drop(r)})"))


def bag(s: str) -> str:
    stop = "[" + ", ".join(q(w) for w in rules.STOPWORDS) + "]"
    return (
        f"list_distinct({keep(find_all(f'lower({s})', '[a-z]+'), lambda w: f'length({w}) > 2 AND NOT list_contains({stop}, {w})')})"
    )


def overlap(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})))"


def dedupe_clauses(x: str, level: str) -> str:
    """Greedy fold over the sentences of masked text."""
    if level == "conservative":
        return x
    limit = rules.CLAUSE_THRESHOLD[level]
    item = lambda s: (
        f"{{'kept': [{s}], 'bags': CASE WHEN starts_with({s}, {q(FENCE_HEAD)}) THEN "
        f"[]::VARCHAR[][] ELSE [{bag(s)}] END}}"
    )

    def fold(parts: str) -> str:
        acc, it, b = fresh(), fresh(), fresh()
        mine = f"{it}['bags'][1]"
        fresh_bag = f"(len({it}['bags']) = 0 OR len({mine}) = 0)"
        repeated = (
            f"len(list_filter({acc}['bags'], lambda {b}: len({b}) > 0 AND "
            f"{overlap(mine, b)} >= {limit}::DOUBLE)) > 0"
        )
        step = (
            f"CASE WHEN {fresh_bag} THEN {{'kept': list_concat({acc}['kept'], {it}['kept']), "
            f"'bags': {acc}['bags']}} WHEN {repeated} THEN {acc} ELSE "
            f"{{'kept': list_concat({acc}['kept'], {it}['kept']), "
            f"'bags': list_concat({acc}['bags'], {it}['bags'])}} END"
        )
        start = "{'kept': []::VARCHAR[], 'bags': []::VARCHAR[][]}"
        state = f"list_reduce({each(parts, item)}, lambda {acc}, {it}: {step}, {start})"
        return join(f"({state})['kept']", " ")

    return let(
        x,
        lambda t: let(
            sentences(strip(t)),
            lambda ps: f"CASE WHEN len({ps}) <= 1 THEN {t} ELSE {fold(ps)} END",
        ),
    )


def dedupe_sentences(x: str) -> str:
    """On masked text."""
    key = lambda s: (
        f"CASE WHEN starts_with({s}, {q(FENCE_HEAD)}) THEN chr(10) || {s} ELSE "
        f"{squeeze(strip(f'lower({s})', ' .!?'))} END"
    )
    is_fence = lambda s: f"starts_with({s}, {q(FENCE_HEAD)})"

    def rebuild(ps: str, ks: str) -> str:
        kept = keep_i(
            ps, lambda s, i: f"{is_fence(s)} OR list_position({ks}, {ks}[{i}]) = {i}"
        )
        return let(
            kept,
            lambda k: f"{join(k, ' ')} || CASE WHEN len({ps}) - len({k}) >= 2 THEN chr(10) || "
            f"'[removed ' || (len({ps}) - len({k})) || ' duplicate sentence(s)]' ELSE '' END",
        )

    return let(
        x,
        lambda t: let(
            sentences(strip(t)),
            lambda ps: f"CASE WHEN len({ps}) <= 1 THEN {t} ELSE "
            f"{let(each(ps, key), lambda ks: rebuild(ps, ks))} END",
        ),
    )


def dedupe_paragraphs(x: str) -> str:
    paras = keep(
        each(f"string_split_regex({strip(x)}, '\\n\\s*\\n')", strip), lambda p: f"{p} <> ''"
    )

    def rebuild(ps: str, ks: str) -> str:
        return let(
            first_of_each(ps, ks),
            lambda k: f"{join(k, chr(10) * 2)} || CASE WHEN len({ps}) > len({k}) THEN "
            f"{q(chr(10) * 2 + '[removed ')} || (len({ps}) - len({k})) || ' duplicate paragraph(s)]' "
            f"ELSE '' END",
        )

    return let(paras, lambda ps: let(each(ps, squeeze), lambda ks: rebuild(ps, ks)))


def collapse_lines(x: str) -> str:
    def runs(rows: str, keys: str) -> str:
        starts = keep(
            each_i(
                keys,
                lambda k, i: f"CASE WHEN {i} > 1 AND {k} <> '' AND {k} = {keys}[{i} - 1] THEN 0 "
                f"ELSE {i} END",
            ),
            lambda i: f"{i} > 0",
        )
        emit = lambda at: each_i(
            at,
            lambda s, j: let(
                f"coalesce({at}[{j} + 1], len({rows}) + 1) - {s}",
                lambda n: f"{rstrip(f'{rows}[{s}]')} || CASE WHEN {n} > 1 THEN chr(10) || "
                f"'[previous line repeated ' || {n} || ' times]' ELSE '' END",
            ),
        )
        return let(starts, lambda at: join(emit(at)))

    return let(
        lines(x),
        lambda rows: let(
            each(rows, lambda r: squeeze(strip(r))), lambda keys: runs(rows, keys)
        ),
    )


def dedupe_tracebacks(x: str) -> str:
    head = rules.TRACEBACK_HEAD

    def block(part: str) -> str:
        def final(r: str) -> str:
            s = strip(r)
            return f"({found(s, '^(?:' + rules.FINAL_ERROR + ')', 'i')} AND NOT starts_with(lower({s}), 'traceback'))"

        def cut(rows: str) -> str:
            ends = keep(each_i(rows, lambda r, i: f"CASE WHEN {final(r)} THEN {i} ELSE 0 END"), lambda i: f"{i} > 0")
            return let(
                f"coalesce({ends}[1], len({rows}))",
                lambda e: f"{{'body': {strip(join(each(f'{rows}[1:{e}]', rstrip)))}, 'tail': "
                f"{keep(each(f'{rows}[({e}+1):]', rstrip), lambda r: strip(r) + NOT_EMPTY)}}}",
            )

        return let(lines(f"{q(head)} || {part}"), cut)

    def rebuild(parts: str) -> str:
        def assemble(bs: str) -> str:
            bodies = each(bs, lambda b: f"{b}['body']")
            tails = f"flatten({each(bs, lambda b: b + "['tail']")})"
            uniq = let(bodies, lambda b: let(each(b, squeeze), lambda k: first_of_each(b, k)))
            suffix = let(tails, lambda t: let(each(t, strip), lambda k: join(first_of_each(t, k))))
            return let(
                uniq,
                lambda u: join(
                    keep(
                        f"list_concat([{rstrip(f'{parts}[1]')}], list_concat({u}, [{suffix}, CASE WHEN "
                        f"len({bs}) > len({u}) THEN '[removed ' || (len({bs}) - len({u})) || "
                        f"' duplicate traceback block(s)]' ELSE '' END]))",
                        lambda p: f"{strip(p)} <> ''",
                    ),
                    "\n\n",
                ),
            )

        return let(each(f"{parts}[2:]", block), assemble)

    return let(
        x,
        lambda t: let(
            f"string_split({t}, {q(head)})",
            lambda ps: f"CASE WHEN len({ps}) <= 2 THEN {t} ELSE {rebuild(ps)} END",
        ),
    )


def compress_log(x: str, n: int = 80) -> str:
    def run(rows: str) -> str:
        errors = keep(rows, lambda r: found(r, rules.LOG_ERROR_LINE, "i"))
        paths = keep(rows, lambda r: found(r, rules.TEXT_PATH))
        last = lambda xs, k: let(xs, lambda a: f"{a}[greatest(len({a}) - {k - 1}, 1):]")
        picks = (
            f"list_concat(list_concat({rows}[1:15], {last(errors, 30)}), "
            f"list_concat({last(paths, 20)}, {last(rows, 15)}))"
        )
        return let(
            let(picks, lambda p: first_of_each(p, p)),
            lambda p: f"{join(f'{p}[1:{n}]')} || chr(10) || '[compressed log from ' || len({rows}) "
            f"|| ' to ' || least(len({p}), {n}) || ' lines]'",
        )

    return let(
        x,
        lambda t: let(
            lines(t), lambda rows: f"CASE WHEN len({rows}) <= {n} THEN {t} ELSE {run(rows)} END"
        ),
    )


def first_line(x: str) -> str:
    return f"coalesce({keep(each(lines(x), strip), lambda r: r + NOT_EMPTY)}[1], '')"


def constraints(x: str) -> str:
    stated = keep(lines(x), lambda r: has_any(f"lower({r})", rules.CONSTRAINT_WORDS))
    cleaned = keep(each(stated, lambda r: strip(r, " -\t")), lambda r: f"{r} <> ''")
    return f"({let(cleaned, lambda c: first_of_each(c, c))})[1:8]"


def derive_task(kind: str, x: str) -> str:
    def sentence(f: str) -> str:
        short = f"CASE WHEN length({f}) > 140 THEN {rstrip(f'left({f}, 137)')} || '...' ELSE {f} END"
        return let(
            short,
            lambda s: f"CASE WHEN {f} = '' THEN {q(rules.TASK_DEFAULT)} ELSE "
            f"upper(left({s}, 1)) || substring({s}, 2) || '.' END",
        )

    first = rstrip(remove_filler(first_line(x), "conservative"), ".")
    return (
        f"(CASE WHEN {within(kind, ['debugging_request', 'log_or_traceback'])} THEN "
        f"{q(rules.TASK_DEBUG)} WHEN {kind} = 'code_instruction' THEN {q(rules.TASK_CODE)} "
        f"WHEN {kind} = 'mixed_input' THEN {q(rules.TASK_MIXED)} ELSE {let(first, sentence)} END)"
    )


def structured(kind: str, task: str, cons: str, compact: str, level: str) -> str:
    def context(c: str) -> str:
        rest = strip(join(f"({lines(c)})[2:]"))
        return let(
            first_line(c),
            lambda f: f"CASE WHEN {f} <> '' AND contains(lower({task}), {rstrip(f'lower({f})', '.')}) "
            f"THEN {rest} ELSE {c} END",
        )

    def terse(c: str) -> str:
        same = f"{rstrip(f'lower({c})', '.')} = {rstrip(f'lower({task})', '.')}"
        return strip(
            f"concat_ws(chr(10), {task}, CASE WHEN len({cons}) > 0 THEN 'Constraints: ' || "
            f"{join(cons, '; ')} END, CASE WHEN {c} <> '' AND NOT ({same}) THEN {c} END)"
        )

    def sections(c: str) -> str:
        sec = lambda title, body: let(
            strip(body), lambda b: f"CASE WHEN {b} <> '' THEN {title} || ':' || chr(10) || {b} END"
        )
        bullets = join(each(cons, lambda k: f"'- ' || {k}"))
        title = f"CASE WHEN {kind} = 'code_instruction' THEN 'Input' ELSE 'Context' END"
        wanted = (
            f"CASE WHEN {within(kind, ['debugging_request', 'log_or_traceback'])} THEN "
            f"{q(rules.OUTPUT_DEBUG)} WHEN {kind} = 'code_instruction' THEN {q(rules.OUTPUT_CODE)} "
            f"WHEN {kind} = 'mixed_input' THEN {q(rules.OUTPUT_MIXED)} ELSE '' END"
        )
        return strip(
            f"concat_ws(chr(10) || chr(10), {sec(q('Task'), task)}, {sec(q('Constraints'), bullets)}, "
            f"{sec(title, c)}, {sec(q('Output'), wanted)})"
        )

    return let(strip(compact), lambda c: let(context(c), terse if level == "aggressive" else sections))


def final_error(x: str) -> str:
    return let(
        find_all(x, rules.FINAL_ERROR, "i"),
        lambda h: f"CASE WHEN len({h}) > 0 THEN {strip(f'{h}[len({h})]')} END",
    )


def paths(x: str) -> str:
    return let(find_all(x, rules.TEXT_PATH), lambda p: first_of_each(p, p))


def shell_lines(x: str) -> str:
    return each(keep(lines(x), lambda r: found(r, rules.SHELL_LINE)), strip)


def penalty(text: str, candidate: str, level: str) -> str:
    missing = lambda xs, w: f"len({keep(xs, lambda v: f'NOT contains({candidate}, {v})')}) * {w}::DOUBLE"
    blocks = let(find_all(text, rules.FENCE), lambda b: first_of_each(b, b))
    error = let(
        final_error(text),
        lambda e: f"CASE WHEN {e} IS NOT NULL AND NOT contains({candidate}, {e}) THEN 70.0::DOUBLE "
        f"ELSE 0.0::DOUBLE END",
    )
    soft = f"({missing(paths(text), 12.0)} + {missing(shell_lines(text), 25.0)})"
    return let(
        f"{missing(blocks, 100.0)} + {error}",
        lambda c: f"{c} + {soft} * CASE WHEN {c} = 0 AND {q(level)} = 'aggressive' THEN 0.5::DOUBLE "
        f"ELSE 1.0::DOUBLE END",
    )


def compact_ctes(source: str, level: str, name: str, text: str = "text", kind: str = "c_type"):
    """CTE chain that adds ``compact`` to a table; one step per CTE."""
    steps = [
        lambda x: remove_filler(x, level),
        lambda x: drop_stop_lines(x, level),
        lambda x: dedupe_clauses(x, level),
        dedupe_tracebacks,
        dedupe_sentences,
        dedupe_paragraphs,
        collapse_lines,
        lambda x: f"CASE WHEN {within(kind, rules.LOG_TYPES)} THEN {compress_log(x)} ELSE {x} END",
        lambda x: strip(restore(x, "k_blocks")),
    ]
    out = [
        f"{name}_0 AS (SELECT *, {protect(text)} AS k0, {find_all(text, rules.FENCE)} AS k_blocks "
        f"FROM {source})"
    ]
    for i, step in enumerate(steps, 1):
        out.append(f"{name}_{i} AS MATERIALIZED (SELECT * EXCLUDE (k{i-1}), {step(f'k{i-1}')} AS k{i} FROM {name}_{i-1})")
    out.append(
        f"{name} AS (SELECT * EXCLUDE (k{len(steps)}), k{len(steps)} AS compact FROM {name}_{len(steps)})"
    )
    return ",\n".join(out)


def optimize_ctes(source: str, level: str, name: str, pick: str = "first", gate: float = 0.0, bonus: str = "0.0"):
    """CTE chain from classified prompts to results (c_* columns must be there)."""
    order = ["s_text", "compact"] if pick == "first" else ["compact", "s_text"]
    score = lambda c, i: (
        f"{percent('n_in', f'n_{i}')} - p_{i} + {bonus}"
    )
    base = f"""{compact_ctes(source, level, name + '_k')},
    {name}_s AS MATERIALIZED (SELECT *, {derive_task('c_type', 'text')} AS task, {constraints('text')} AS cons,
        {tokens('text')} AS n_in FROM {name}_k),
    {name}_t AS MATERIALIZED (SELECT *, {structured('c_type', 'task', 'cons', 'compact', level)} AS s_text FROM {name}_s),
    {name}_u AS MATERIALIZED (SELECT *, {order[0]} AS t_1, {order[1]} AS t_2, {tokens(order[0])} AS n_1,
        {tokens(order[1])} AS n_2, {penalty('text', order[0], level)} AS p_1,
        {penalty('text', order[1], level)} AS p_2 FROM {name}_t),
    {name}_v AS (SELECT *, {score('t_1', 1)} AS z_1, {score('t_2', 2)} AS z_2,
        t_1 <> '' AS v_1, t_2 <> '' AS v_2 FROM {name}_u),"""
    if pick == "first":
        choose = f"""{name}_w AS (SELECT *, v_1 AND n_1 < n_in AS ok_1, v_2 AND n_2 < n_in AS ok_2 FROM {name}_v),
    {name}_x AS (SELECT *, CASE WHEN NOT c_go THEN 0 WHEN ok_1 AND z_1 >= {gate} THEN 1
        WHEN ok_2 AND z_2 >= {gate} THEN 2 ELSE 0 END AS won FROM {name}_w),
    {name}_y AS (SELECT *, CASE WHEN won = 1 THEN z_1 WHEN won = 2 THEN z_2 WHEN NOT c_go THEN 0.0
        WHEN ok_1 AND ok_2 THEN greatest(z_1, z_2) WHEN ok_1 THEN z_1 WHEN ok_2 THEN z_2 ELSE 0.0 END AS score,
        CASE WHEN NOT c_go THEN c_reason WHEN won > 0 THEN {q(rules.REASON_COMPRESSED)}
        WHEN ok_1 OR ok_2 THEN {q(rules.REASON_REJECTED)} ELSE {q(rules.REASON_NO_GAIN)} END AS reason,
        CASE WHEN c_type = 'dangerous_command' AND c_risk = 'high' THEN 'high_risk_unmodified' ELSE 'ok' END AS status
        FROM {name}_x),"""
    else:
        choose = f"""{name}_w AS (SELECT *, CASE WHEN NOT c_go THEN 0 WHEN v_1 AND (NOT v_2 OR z_1 >= z_2) THEN 1
        WHEN v_2 THEN 2 ELSE 0 END AS best FROM {name}_v),
    {name}_x AS (SELECT *, CASE WHEN best = 1 AND n_1 < n_in AND z_1 >= {gate} THEN 1
        WHEN best = 2 AND n_2 < n_in AND z_2 >= {gate} THEN 2 ELSE 0 END AS won FROM {name}_w),
    {name}_y AS (SELECT *, CASE best WHEN 1 THEN z_1 WHEN 2 THEN z_2 ELSE 0.0 END AS score,
        CASE WHEN NOT c_go OR best = 0 THEN c_reason WHEN won > 0 THEN {q(rules.REASON_COMPRESSED)}
        ELSE {q(rules.REASON_REJECTED_BEST)} END AS reason,
        CASE WHEN won > 0 THEN 'ok' ELSE 'preserved' END AS status FROM {name}_x),"""
    return f"""{base}
    {choose}
    {name} AS (SELECT *, won > 0 AS was_optimized,
        CASE won WHEN 1 THEN t_1 WHEN 2 THEN t_2 ELSE text END AS optimized_text,
        CASE won WHEN 1 THEN n_1 WHEN 2 THEN n_2 ELSE n_in END AS n_out FROM {name}_y)"""


# --- tool outputs -----------------------------------------------------------------------------

def cap(text: str, rows: str, n: int, tail: str = " total lines]") -> str:
    return (
        f"CASE WHEN len({rows}) <= {n} THEN {text} ELSE {join(f'{rows}[1:{n}]')} || chr(10) || '[' "
        f"|| len({rows}) || {q(tail)} END"
    )


def cap_text(text: str, n: int) -> str:
    return let(text, lambda t: let(lines(strip(t)), lambda rows: cap(t, rows, n)))


def _labelled(label: str, xs: str) -> str:
    return let(
        xs,
        lambda v: f"CASE WHEN len({v}) > 0 THEN {q(label + ': ')} || {join(f'{v}[1:10]', ', ')} END",
    )


def git_status(t: str, rows: str) -> str:
    staged = ["new file:", "modified:", "deleted:", "renamed:"]
    noise = ["#", "On branch", "Your branch", "Changes", "Untracked", "  (use"]
    other = lambda r: (
        f"NOT {starts_any(strip(r), staged)} AND {strip(r)} <> '' AND NOT {starts_any(strip(r), noise)}"
    )
    pick = lambda test: each(keep(rows, test), strip)
    untracked = each(pick(lambda r: f"{other(r)} AND contains({r}, '??')"), lambda r: f"ltrim({r}, '? ')")
    report = (
        f"concat_ws(chr(10), {strip(keep(rows, lambda r: has(r, 'On branch')) + '[1]')}, "
        f"{_labelled('staged', pick(lambda r: starts_any(strip(r), staged)))}, "
        f"{_labelled('modified', pick(lambda r: f'{other(r)} AND NOT ' + has(r, '??')))}, "
        f"{_labelled('untracked', untracked)})"
    )
    return (
        f"CASE WHEN len({rows}) = 0 THEN {t} ELSE "
        f"{let(report, lambda x: f'''CASE WHEN {x} = '' THEN 'clean' ELSE {x} END''')} END"
    )


def git_log(t: str, rows: str) -> str:
    """A message counts when the last commit line or message before it is a commit line."""
    head = lambda r: f"starts_with({r}, 'commit ')"
    message = lambda r: f"(starts_with({r}, '    ') AND {strip(r)} <> '')"

    def subjects(marks: str) -> str:
        pair = lambda m, i: (
            f"CASE WHEN {i} > 1 AND NOT {head(m)} AND {head(f'{marks}[{i} - 1]')} AND "
            f"length({marks}[{i} - 1]) > 7 THEN substring({marks}[{i} - 1], 8, 7) || ' ' || {strip(m)} END"
        )
        return keep(each_i(marks, pair), lambda x: f"{x} IS NOT NULL")

    commits = let(keep(rows, lambda r: f"{head(r)} OR {message(r)}"), subjects)
    long = keep(f"{rows}[1:5]", lambda r: f"length({r}) >= 120")
    author = keep(f"{rows}[1:10]", lambda r: f"starts_with({r}, 'Author:')")
    return (
        f"CASE WHEN len({long}) = 0 AND len({author}) = 0 THEN {t} ELSE "
        f"{let(commits, lambda c: f'CASE WHEN len({c}) > 0 THEN {join(c)} ELSE {t} END')} END"
    )


def git_diff(t: str, rows: str) -> str:
    kept = keep(rows, lambda r: starts_any(r, ["diff --", "---", "+++", "@@", "+", "-"]))
    report = let(
        kept,
        lambda k: f"CASE WHEN len({k}) > 80 THEN {join(f'{k}[1:80]')} || chr(10) || "
        f"'[diff truncated, ' || len({rows}) || ' total lines]' ELSE {join(k)} END",
    )
    return f"CASE WHEN len({rows}) <= 50 THEN {t} ELSE {report} END"


def git_action(verb: str, t: str, rows: str, code: str) -> str:
    arrow = keep(rows, lambda r: has(r, "->"))
    return (
        f"CASE WHEN {code} <> 0 THEN {cap(t, rows, 30)} "
        f"WHEN {verb} = 'push' THEN 'ok ' || coalesce(regexp_extract({strip(arrow + '[1]')}, '\\S+$'), 'pushed') "
        f"WHEN {verb} = 'commit' THEN 'ok ' || coalesce(nullif(regexp_extract({rows}[1], '[0-9a-f]{{7,}}'), ''), 'committed') "
        f"ELSE 'ok' END"
    )


def _tail(rows: str, n: int) -> str:
    return f"{rows}[greatest(len({rows}) - {n - 1}, 1):]"


def suite(t: str, rows: str, code: str) -> str:
    good = keep(_tail(rows, 10), lambda r: found(r, r"pass|ok|success|\d+ test", "i"))
    bad = each(keep(rows, lambda r: found(r, "fail|error|panic|assert", "i")), strip)
    count = keep(_tail(rows, 5), lambda r: found(r, r"\d+.*(?:pass|fail)", "i"))
    return (
        f"CASE WHEN {code} = 0 THEN {let(good, lambda g: f'''CASE WHEN len({g}) > 0 THEN {join(g)} WHEN len({rows}) > 0 THEN {rows}[-1] ELSE 'ok' END''')} "
        f"ELSE {let(bad, lambda b: f'CASE WHEN len({b}) > 0 THEN {join(f'list_concat({b}[1:30], {each(count, strip)}[1:1])')} ELSE {cap(t, rows, 40)} END')} END"
    )


def collapse_output(t: str, rows: str, n: int) -> str:
    def runs(keys: str) -> str:
        starts = keep(
            each_i(
                keys,
                lambda k, i: f"CASE WHEN {i} > 1 AND {k} = {keys}[{i} - 1] THEN 0 ELSE {i} END",
            ),
            lambda i: f"{i} > 0",
        )
        emit = lambda at: each_i(
            at,
            lambda x, j: let(
                f"coalesce({at}[{j} + 1], len({rows}) + 1) - {x}",
                lambda m: f"CASE WHEN {m} > 1 THEN [{rows}[{x}], '  [repeated ' || {m} || 'x]'] "
                f"ELSE [{rows}[{x}]] END",
            ),
        )
        kept = let(starts, lambda at: f"flatten({emit(at)})")
        return let(
            kept,
            lambda k: f"CASE WHEN len({k}) > {n} THEN {join(f'{k}[1:{n}]')} || chr(10) || '[' || "
            f"len({rows}) || ' total lines]' ELSE {join(k)} END",
        )

    return f"CASE WHEN len({rows}) <= {n} THEN {t} ELSE {let(each(rows, strip), runs)} END"


def docker(sub_command: str, t: str, rows: str) -> str:
    table = join(f"list_concat({rows}[1:1], {each(f'{rows}[2:21]', lambda r: sub(r, chr(92) + 's{2,}', '  '))})")
    return (
        f"CASE WHEN {sub_command} = 'ps' THEN {table} WHEN {sub_command} IN ('logs', 'compose') "
        f"THEN {collapse_output(t, rows, 40)} ELSE {cap(t, rows, 40)} END"
    )


def file_read(t: str, rows: str) -> str:
    return (
        f"CASE WHEN len({rows}) <= 80 THEN {t} ELSE {join(f'{rows}[1:40]')} || chr(10) || '...' || "
        f"chr(10) || '[' || len({rows}) || ' total lines]' || chr(10) || {join(_tail(rows, 10))} END"
    )


def build_run(t: str, rows: str, code: str) -> str:
    errors = keep(rows, lambda r: found(r, "error|Error|ERROR"))
    return (
        f"CASE WHEN {code} = 0 THEN {rows}[-1] ELSE "
        f"{let(errors, lambda e: f'CASE WHEN len({e}) > 0 THEN {join(f'{e}[1:20]')} ELSE {cap(t, rows, 30)} END')} END"
    )


def lint_run(t: str, rows: str) -> str:
    issues = keep(rows, lambda r: found(r, "error|warning|warn|Error|Warning"))
    summary = keep(_tail(rows, 5), lambda r: found(r, r"\d+"))
    return (
        f"CASE WHEN len({rows}) <= 30 THEN {t} ELSE "
        f"{join(f'list_concat({issues}[1:30], {summary})')} END"
    )


def cloud(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 2000 THEN left({t}, 2000) || chr(10) || '[truncated, ' || "
        f"length({t}) || ' bytes total]' ELSE {t} END"
    )


def download(rows: str) -> str:
    return cap_text(join(keep(rows, lambda r: f"NOT {found(r, '^(?:' + chr(92) + 's*' + chr(92) + 'd+%|#|=+>)')}")), 50)


def generic(t: str, rows: str) -> str:
    return cap_text(collapse_output(t, rows, 60), 60)


ROUTE = f"""CASE
    WHEN command_name = 'git' AND a1 = 'status' THEN 'git_status'
    WHEN command_name = 'git' AND a1 = 'log' THEN 'git_log'
    WHEN command_name = 'git' AND a1 IN ('diff', 'show') THEN 'git_diff'
    WHEN command_name = 'git' AND a1 IN ('push', 'pull', 'fetch', 'add', 'commit') THEN 'git_action'
    WHEN command_name IN ('cargo', 'npm', 'pnpm', 'yarn', 'go') AND a1 = 'test' THEN 'test'
    WHEN command_name IN ('pytest', 'jest', 'vitest', 'mocha') THEN 'test'
    WHEN command_name = 'python' AND list_contains(args, '-m') AND list_contains(args, 'pytest') THEN 'test'
    WHEN command_name = 'docker' AND len(args) > 0 THEN 'docker'
    WHEN command_name = 'kubectl' THEN 'kubectl'
    WHEN command_name IN ('ls', 'find', 'tree') THEN 'listing'
    WHEN command_name IN ('cat', 'head', 'tail', 'bat') THEN 'file_read'
    WHEN command_name IN ('grep', 'rg', 'ag') THEN 'matches'
    WHEN command_name IN ('cargo', 'npm', 'pnpm') AND a1 = 'build' THEN 'build'
    WHEN command_name IN ('eslint', 'ruff', 'clippy', 'golangci-lint', 'rubocop') THEN 'lint'
    WHEN command_name = 'cargo' AND a1 = 'clippy' THEN 'lint'
    WHEN command_name = 'aws' THEN 'cloud' WHEN command_name IN ('curl', 'wget') THEN 'download'
    ELSE 'generic' END"""


def condensed() -> str:
    t, rows, code, a1 = "output", "o_rows", "exit_code", "a1"
    by = {
        "git_status": git_status(t, rows), "git_log": git_log(t, rows),
        "git_diff": git_diff(t, rows), "git_action": git_action(a1, t, rows, code),
        "test": suite(t, rows, code), "docker": docker(a1, t, rows), "kubectl": cap(t, rows, 30),
        "listing": cap(t, rows, 30, " total entries]"), "file_read": file_read(t, rows),
        "matches": cap(t, rows, 30, " matches total]"), "build": build_run(t, rows, code),
        "lint": lint_run(t, rows), "cloud": cloud(t), "download": download(rows),
        "generic": generic(t, rows),
    }
    cases = " ".join(f"WHEN route = {q(k)} THEN ({v})" for k, v in by.items())
    return f"CASE WHEN length(output) < 100 THEN output {cases} END"
