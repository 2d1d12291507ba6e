"""DuckDB SQL per registered query, over the same given tables."""

from __future__ import annotations

from promptloom.functions import rules
from promptloom.plans import sql as s
from promptloom.plans.sql import q
from promptloom.sources import derived

START = "TIMESTAMP '2024-01-01 00:00:00'"
NOW = "TIMESTAMP '2024-04-10 00:00:00'"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _template(template: str) -> str:
    parts = [q(part) for part in template.split("{T}")]
    return " || text || ".join(parts)


_prompt_text = " ".join(
    f"WHEN {k} THEN {_template(tpl)}" for k, tpl in enumerate(derived.PROMPT_TEMPLATES)
)
_routes = derived.TOOL_ROUTES
_args = " ".join(f"WHEN {i} THEN {_list(r[1]) if r[1] else '[]::VARCHAR[]'}" for i, r in enumerate(_routes))

TABLES = {
    "prompts": f"""SELECT conv_id * 1000 + turn AS prompt_id,
        {START} + to_seconds(conv_id * 1000 + turn) AS created_at,
        {_list(derived.PROMPT_COMMANDS)}[conv_id % 3 + 1] AS command_name,
        CASE (conv_id * 7 + turn) % 12 {_prompt_text} END AS text
        FROM conversations""",
    "texts": """SELECT prompt_id AS id, text FROM prompts
        UNION ALL SELECT -doc_id - 1, text FROM documents""",
    "shell_starts": f"""SELECT event_id * 4 AS event_seq, ts, 'start' AS kind, 'bash' AS shell,
        (1000 + user_id % 50)::INTEGER AS pid, '/w/' || event_type AS cwd,
        replace(replace({_list(derived.EVENT_COMMANDS)}[event_id % {len(derived.EVENT_COMMANDS)} + 1],
          '{{U}}', user_id::VARCHAR), '{{E}}', event_type) AS command, NULL::INTEGER AS exit_code
        FROM events""",
    "shell_dones": """SELECT event_id * 4 + extra AS event_seq,
        ts + to_seconds((event_id * 37) % 97 * 600) AS ts, 'done' AS kind, 'bash' AS shell,
        (1000 + user_id % 50)::INTEGER AS pid, NULL::VARCHAR AS cwd, NULL::VARCHAR AS command,
        CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS exit_code
        FROM events, (VALUES (1), (2)) x(extra)
        WHERE (extra = 1 AND (event_id % 5 <> 0 OR (user_id % 50) % 10 = 9))
           OR (extra = 2 AND (user_id % 50) % 10 = 9 AND event_id % 3 = 0)""",
    "shell_events": "SELECT * FROM shell_starts UNION ALL SELECT * FROM shell_dones",
    "tool_outputs": f"""SELECT doc_id AS output_id, {START} + to_seconds(doc_id * 60) AS ts,
        {_list([r[0] for r in _routes])}[doc_id % 16 + 1] AS command_name,
        CASE WHEN doc_id % 16 = 6 THEN [{_list(derived.DOCKER_ARGS)}[(doc_id // 32) % 3 + 1]]
          ELSE (CASE doc_id % 16 {_args} END) END AS args,
        {_list([r[2] for r in _routes])}[doc_id % 16 + 1] ||
          replace(text, ' ', CASE WHEN doc_id % 16 = 2 THEN chr(10) || '+' ELSE chr(10) END) ||
          {_list([r[3] for r in _routes])}[doc_id % 16 + 1] ||
          CASE WHEN (doc_id // 16) % 2 <> 0 THEN chr(10) || 'error: x' ELSE '' END AS output,
        ((doc_id // 16) % 2)::INTEGER AS exit_code
        FROM documents""",
    "tool_texts": "SELECT output_id, output AS text FROM tool_outputs",
    "raw_feedback": f"""SELECT 'f' || doc_id AS feedback_id,
        {START} + to_seconds(pid + CASE WHEN doc_id % 5 = 0 THEN -1 ELSE 600 END) AS created_at,
        sha256('run:' || pid) AS run_id,
        CASE WHEN doc_id % 17 = 0 THEN 'meh' WHEN quality = 1 THEN 'good' ELSE 'bad' END AS rating,
        CASE WHEN doc_id % 4 = 0 THEN ' password: abcdef0123456789 leaked ' ELSE 'ok' END AS notes
        FROM (SELECT *, (doc_id // 8) * 1000 + doc_id % 3 AS pid FROM labels)""",
    "feedback": f"""SELECT feedback_id, created_at, run_id, rating,
        {s.clip(s.redact('notes'), 512)} AS notes FROM raw_feedback
        WHERE rating IN ('good', 'bad')""",
    "stop_texts": """SELECT prompt_id, regexp_replace(text, '\\. ', '.' || chr(10), 'g') AS text
        FROM prompts""",
    "observed": """SELECT * FROM shell_starts WHERE trim(command) <> ''
        AND NOT (""" + s.starts_any(
        "trim(command)",
        [f"{rules.OWN_TOOL} ", f"command {rules.OWN_TOOL} ", f"__{rules.OWN_TOOL}_",
         *rules.HOOK_NOISE, f'eval "$({rules.OWN_TOOL} shell-hook'],
    ) + ")",
}
ORDER = list(TABLES)
NEEDS = {
    "texts": ["prompts"], "shell_events": ["shell_starts", "shell_dones"],
    "feedback": ["raw_feedback"], "stop_texts": ["prompts"], "tool_texts": ["tool_outputs"],
    "observed": ["shell_starts"],
}


def _closure(names: list[str]) -> list[str]:
    out = set(names)
    for name in names:
        out |= set(_closure(NEEDS.get(name, [])))
    return [n for n in ORDER if n in out]


def query(tables: str, select: str, *ctes: str) -> str:
    parts = [f"{name} AS ({TABLES[name]})" for name in _closure(tables.split())]
    return "WITH " + ",\n".join([*parts, *ctes]) + "\n" + select


ORACLE: dict[str, str] = {}


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


def over(name: str, table: str, key: str, **columns: str) -> None:
    cols = ", ".join(f"{expr} AS {alias}" for alias, expr in columns.items())
    ORACLE[name] = query(table, f"SELECT {key}, {cols} FROM {table}")


CLASSED = s.class_ctes("prompts")
LOGGED = (
    "stripped AS (SELECT *, trim(command) AS text FROM observed)",
    s.class_ctes("stripped"),
    f"""logged AS (SELECT sha256('event:' || event_seq) AS event_id, event_seq, ts AS created_at,
        shell, pid, cwd, sha256(red) AS command_hash, {s.clip(s.redact('red'), 4096)} AS raw_command_preview,
        '' AS optimized_preview, {s.tokens('red')} AS token_estimate, c_type AS input_type,
        c_risk AS risk_level, false AS was_modified, 'started' AS status,
        {s.command_pattern('red')} AS command_pattern
        FROM (SELECT *, {s.redact('text')} AS red FROM classed))""",
    """command_patterns AS (SELECT sha256(command_pattern) AS pattern_hash, command_pattern,
        split_part(command_pattern, ' ', 1) AS command_name, count(*) AS usage_count,
        avg(token_estimate) AS average_token_estimate, max(created_at) AS last_seen_at
        FROM logged WHERE command_pattern <> '' GROUP BY command_pattern)""",
)
RUNS = (
    CLASSED,
    s.optimize_ctes("classed", "conservative", "o"),
    f"""runs AS MATERIALIZED (SELECT sha256('run:' || prompt_id) AS run_id, created_at,
        sha256(red_in) AS input_hash, {s.clip(s.redact('red_in'), 4096)} AS input_preview,
        {s.clip(s.redact('red_out'), 4096)} AS optimized_preview, n_in AS input_token_estimate,
        n_out AS optimized_token_estimate, n_in - n_out AS token_savings,
        {s.percent('n_in', 'n_out')} AS token_savings_percent, c_type AS input_type,
        c_risk AS risk_level, command_name, was_optimized, status,
        sha256(c_type || ':' || {s.shape('red_in')}) AS pattern_hash
        FROM (SELECT *, {s.redact('text')} AS red_in, {s.redact('optimized_text')} AS red_out FROM o))""",
)
PATTERNS = (
    *RUNS,
    f"""prompt_patterns AS (SELECT pattern_hash, count(*) AS usage_count,
        avg(token_savings_percent) AS average_savings_percent,
        arg_min(input_type, (created_at, run_id)) AS pattern_type,
        arg_min(run_id, (created_at, run_id)) AS first_run_id, min(created_at) AS first_seen_at,
        {s.clip('arg_max(input_preview, (created_at, run_id))', 1024)} AS original_pattern_preview,
        {s.clip('arg_max(optimized_preview, (created_at, run_id))', 1024)} AS optimized_pattern_preview
        FROM runs WHERE was_optimized GROUP BY pattern_hash)""",
)
RATED = (
    *PATTERNS,
    f"""rated AS (SELECT f.feedback_id, f.rating, f.created_at,
        r.pattern_hash
        FROM feedback f JOIN runs r ON f.run_id = r.run_id)""",
    """rated_patterns AS (SELECT r.feedback_id, r.rating, r.pattern_hash, p.pattern_type, r.created_at
        FROM rated r JOIN prompt_patterns p ON r.pattern_hash = p.pattern_hash
        AND p.first_seen_at <= r.created_at)""",
    """success AS (SELECT pattern_hash,
        sum(CASE WHEN rating = 'good' THEN 1.0::DOUBLE ELSE -2.0::DOUBLE END) AS success_score
        FROM rated_patterns GROUP BY pattern_hash)""",
    """bonuses AS (SELECT p.pattern_type AS input_type,
        greatest(-15.0::DOUBLE, least(15.0::DOUBLE, avg(coalesce(x.success_score, 0.0::DOUBLE)))) AS bonus
        FROM prompt_patterns p LEFT JOIN success x ON p.pattern_hash = x.pattern_hash
        GROUP BY p.pattern_type)""",
)

# --- sources and sinks ------------------------------------------------------------------------
ORACLE["s1_read_prompts"] = query(
    "prompts", f"SELECT prompt_id, {stamp('created_at')} AS created_at, command_name, text FROM prompts"
)
ORACLE["s2_read_tool_outputs"] = query(
    "tool_outputs",
    f"SELECT output_id, command_name, {s.join('args', ' ')} AS args, exit_code, output FROM tool_outputs",
)
ORACLE["s3_write_runs"] = query(
    "prompts",
    f"""SELECT run_id, {stamp('created_at')} AS created_at, input_hash, input_preview,
    optimized_preview, input_token_estimate, optimized_token_estimate, token_savings,
    round(token_savings_percent, 6) AS token_savings_percent, input_type, risk_level, command_name,
    was_optimized, status FROM runs""",
    *RUNS,
)
_EVENT_COLS = f"""event_id, {stamp('created_at')} AS created_at, shell, pid, cwd, command_hash,
    raw_command_preview, optimized_preview, token_estimate, input_type, risk_level, was_modified, status"""
ORACLE["s4_write_shell_events"] = query("observed", f"SELECT {_EVENT_COLS} FROM logged", *LOGGED)
ORACLE["s5_write_feedback"] = query(
    "feedback",
    f"SELECT feedback_id, {stamp('created_at')} AS created_at, run_id, rating, notes FROM feedback",
)
ORACLE["s6_export_json"] = query(
    "prompts",
    """SELECT to_json({'prompt_id': prompt_id, 'input_type': c_type, 'risk_level': c_risk,
    'should_optimize': c_go, 'reason': c_reason})::VARCHAR AS value FROM classed""",
    CLASSED,
)
ORACLE["s6_export_tsv"] = query(
    "prompts",
    "SELECT prompt_id, c_type AS input_type, c_risk AS risk_level, c_go AS should_optimize, c_reason AS reason FROM classed",
    CLASSED,
)
ORACLE["s7_archive_failures"] = query(
    "tool_outputs",
    f"""SELECT output_id, {stamp('ts')} AS ts,
    left(replace(replace(command_name, '/', '_'), ' ', '_'), 40) AS file_stem,
    CASE WHEN length(output) > 1048576 THEN left(output, 1048576) || chr(10) ||
      '[truncated at 1048576 bytes]' ELSE output END AS content
    FROM tool_outputs WHERE exit_code <> 0 AND length(output) >= 500
    ORDER BY ts DESC, output_id DESC LIMIT 20""",
)

# --- projections ------------------------------------------------------------------------------
over("p1_redact", "texts", "id", redacted=s.redact("text"))
over("p2_preview", "texts", "id", preview=s.clip(s.redact("text"), 4096),
     short_preview=s.clip(s.redact("text"), 512))
over("p3_text_hash", "texts", "id", text_hash=f"sha256({s.redact('text')})")
over("p4_estimate_tokens", "texts", "id", tokens=s.tokens("text"))
ORACLE["p5_token_savings"] = query(
    "prompts",
    f"""SELECT prompt_id, a AS tokens_in, b AS tokens_out, a - b AS saved,
    round({s.percent('a', 'b')}, 6) AS saved_percent, greatest(0, a - b) AS saved_clamped,
    round(greatest(0.0::DOUBLE, {s.percent('a', 'b')}), 6) AS saved_percent_clamped
    FROM (SELECT prompt_id, {s.tokens('text')} AS a, {s.tokens(s.redact('text'))} AS b FROM prompts)""",
)
over("p6_prompt_shape", "texts", "id", shape=s.shape("text"))
ORACLE["p7_prompt_pattern_hash"] = query(
    "prompts",
    f"SELECT prompt_id, sha256(c_type || ':' || {s.shape(s.redact('text'))}) AS pattern_hash FROM classed",
    CLASSED,
)
over("p8_command_pattern", "shell_starts", "event_seq", pattern=s.command_pattern("command"))
over("p9_command_name", "shell_starts", "event_seq",
     command_name=f"split_part({s.command_pattern('command')}, ' ', 1)")
over("p10_base_name", "shell_starts", "event_seq",
     base_name="string_split(string_split(command, ' ')[1], '/')[-1]")
over("p11_protect_fences", "texts", "id", protected=s.protect("text"),
     fences=f"len({s.find_all('text', rules.FENCE)})::INTEGER",
     same=f"{s.restore(s.protect('text'), s.find_all('text', rules.FENCE))} = text")
for _level in rules.LEVELS:
    over(f"p12_remove_filler_{_level}", "texts", "id", cleaned=s.remove_filler("text", _level))
over("p13_clean_fragments", "texts", "id", cleaned=s.clean_fragments("text"))
over("p14_first_meaningful_line", "texts", "id", line=s.first_line("text"))
ORACLE["p15_derive_task"] = query(
    "prompts", f"SELECT prompt_id, {s.derive_task('c_type', 'text')} AS task FROM classed", CLASSED
)
ORACLE["p16_structured_prompt"] = query(
    "prompts",
    f"""SELECT prompt_id, {s.structured('c_type', 'task', 'cons', 'text', 'moderate')} AS sections,
    {s.structured('c_type', 'task', 'cons', 'text', 'aggressive')} AS terse FROM tasked""",
    CLASSED,
    f"""tasked AS MATERIALIZED (SELECT *, {s.derive_task('c_type', 'text')} AS task,
        {s.constraints('text')} AS cons FROM classed)""",
)
over("p17_final_error_line", "texts", "id", error_line=s.final_error("text"))
over("p18_extract_paths", "texts", "id", paths=s.join(s.paths("text"), "|"),
     shell_lines=s.join(s.shell_lines("text"), "|"))
_CANDIDATE = (
    f"""cand_0 AS MATERIALIZED (SELECT prompt_id, text,
        {s.remove_filler(s.protect('text'), 'moderate')} AS k FROM prompts)""",
    f"cand AS MATERIALIZED (SELECT prompt_id, text, {s.collapse_lines('k')} AS candidate FROM cand_0)",
)
ORACLE["p19_risk_penalty"] = query(
    "prompts",
    f"""SELECT prompt_id, {s.penalty('text', 'candidate', 'conservative')} AS conservative,
    {s.penalty('text', 'candidate', 'aggressive')} AS aggressive FROM cand""",
    *_CANDIDATE,
)
ORACLE["p20_optimization_score"] = query(
    "prompts",
    f"""SELECT prompt_id, round({s.percent('a', 'b')} - p + 1.5::DOUBLE, 6) AS score FROM (
    SELECT prompt_id, {s.tokens('text')} AS a, {s.tokens('candidate')} AS b,
    {s.penalty('text', 'candidate', 'moderate')} AS p FROM cand)""",
    *_CANDIDATE,
)
ORACLE["p21_classify"] = query(
    "texts",
    """SELECT id, c_type AS input_type, c_risk AS risk_level, c_go AS should_optimize,
    c_reason AS reason FROM classed""",
    s.class_ctes("texts"),
)
over("p22_dangerous_rule", "shell_starts", "event_seq",
     rule=f"coalesce({s.dangerous('command')}, '')")
_FLAGS = ", ".join(q(f) for f in rules.PROMPT_FLAGS)
ORACLE["p23_prompt_argument"] = query(
    "prompts",
    f"""SELECT prompt_id, (CASE WHEN flag_i IS NOT NULL THEN flag_v.idx ELSE best.idx END)::INTEGER AS idx,
    CASE WHEN flag_i IS NOT NULL THEN flag_v.val ELSE best.val END AS value
    FROM (SELECT c.prompt_id,
        min(i) FILTER (is_flag) AS flag_i, arg_min(v, i) FILTER (is_flag) AS flag_v,
        arg_max({{'idx': i, 'val': arg}}, (length(arg), -i)) FILTER (prose) AS best
      FROM (SELECT prompt_id, i - 1 AS i, args[i] AS arg,
          (args[i] IN ({_FLAGS}) AND i < len(args)) OR regexp_matches(args[i], '^(--prompt|-p|--message|-m|--input|--text)=') AS is_flag,
          CASE WHEN args[i] IN ({_FLAGS}) AND i < len(args) THEN {{'idx': i, 'val': args[i + 1]}}
            ELSE {{'idx': i - 1, 'val': regexp_extract(args[i], '^[^=]*=([\\s\\S]*)$', 1)}} END AS v,
          i > 1 AND (len({s.words('args[i]')}) >= 5 OR length(args[i]) > 80) AS prose
        FROM calls, (SELECT unnest(range(1, 5)) AS i) WHERE i <= len(args)) c
      GROUP BY c.prompt_id)""",
    """calls AS (SELECT prompt_id, CASE (prompt_id // 1000) % 4
        WHEN 0 THEN [command_name, '-p', text]
        WHEN 1 THEN [command_name, '-v', '--prompt=' || text]
        WHEN 2 THEN [command_name, 'exec', text, '--json']
        ELSE [command_name, 'run', '--message'] END AS args FROM prompts)""",
)
_RESULT = """prompt_id, c_type AS input_type, c_risk AS risk_level, n_in AS input_token_estimate,
    n_out AS optimized_token_estimate, was_optimized, reason, status, optimized_text,
    round(score, 6) AS score"""
for _level in rules.LEVELS:
    ORACLE[f"p24_optimize_{_level}"] = query(
        "prompts", f"SELECT {_RESULT} FROM o", CLASSED, s.optimize_ctes("classed", _level, "o")
    )
ORACLE["p24_optimize_best_moderate"] = query(
    "prompts", f"SELECT {_RESULT} FROM o", CLASSED,
    s.optimize_ctes("classed", "moderate", "o", "best", 3.0),
)
ORACLE["p24_optimize_with_bonus"] = query(
    "prompts feedback", f"SELECT {_RESULT} FROM ob", *RATED,
    """classed_b AS (SELECT c.*, coalesce(b.bonus, 0.0::DOUBLE) AS earned FROM classed c
        LEFT JOIN bonuses b ON c.c_type = b.input_type)""",
    s.optimize_ctes("classed_b", "conservative", "ob", bonus="earned"),
)
ORACLE["p25_dry_run"] = query(
    "prompts",
    f"""SELECT prompt_id, text AS original_input, c_type AS classified_type, c_risk AS risk_level,
    n_in AS input_token_estimate, n_out AS optimized_token_estimate, n_in - n_out AS estimated_savings,
    round({s.percent('n_in', 'n_out')}, 6) AS estimated_savings_percent, was_optimized, reason,
    optimized_text AS optimized_output FROM o""",
    CLASSED, s.optimize_ctes("classed", "aggressive", "o"),
)

# --- in-text operators ------------------------------------------------------------------------
_FENCES = s.find_all("text", rules.FENCE)
for _level in ("moderate", "aggressive"):
    over(f"t1_drop_stop_lines_{_level}", "stop_texts", "prompt_id", kept=s.drop_stop_lines("text", _level))
    over(f"t2_dedupe_clauses_{_level}", "texts", "id",
         deduped=s.restore(s.dedupe_clauses(s.protect("text"), _level), _FENCES))
over("t3_dedupe_sentences", "texts", "id",
     deduped=s.restore(s.dedupe_sentences(s.protect("text")), _FENCES))
over("t4_dedupe_paragraphs", "texts", "id", deduped=s.dedupe_paragraphs("text"))
over("t5_collapse_repeated_lines", "texts", "id", collapsed=s.collapse_lines("text"))
over("t6_dedupe_tracebacks", "texts", "id", deduped=s.dedupe_tracebacks("text"))
over("t7_compress_log", "tool_texts", "output_id", compressed=s.compress_log("text"))
over("t8_extract_constraints", "texts", "id", constraints=s.join(s.constraints("text"), "|"))
for _level in rules.LEVELS:
    ORACLE[f"t9_compact_{_level}"] = query(
        "prompts", "SELECT prompt_id, CASE WHEN c_go THEN compact END AS compact FROM k",
        CLASSED, s.compact_ctes("classed", _level, "k"),
    )

# --- filters ----------------------------------------------------------------------------------
ORACLE["f1_is_dangerous"] = query(
    "shell_starts",
    f"SELECT event_seq, command FROM shell_starts WHERE {s.dangerous('command')} IS NOT NULL",
)
over("f2_looks_like_shell", "texts", "id",
     shell_like=s.let(s.strip("text"), lambda x: s.looks_like_shell(x)))
over("f3_looks_like_log", "texts", "id", log_like=s.looks_like_log("text"))
over("f4_has_marker", "texts", "id", ai=s.has_any("lower(text)", rules.AI_MARKERS),
     code=s.has_any("lower(text)", rules.CODE_MARKERS),
     debug=s.has_any("lower(text)", rules.DEBUG_MARKERS))
over("f5_has_fence_path_command", "texts", "id", fence=s.found("text", rules.FENCE),
     path=s.found("text", rules.FILE_PATH), inline_command=s.found("text", rules.INLINE_COMMAND))
over("f6_looks_like_instruction", "texts", "id",
     instruction=s.let(s.strip("text"), s.looks_like_instruction))
over("f7_moderate_risk", "shell_starts", "event_seq",
     moderate=s.found("command", rules.MODERATE_RISK),
     destructive_sql=s.found("command", rules.DESTRUCTIVE_SQL, "i"))
ORACLE["f8_observable_command"] = query("observed", "SELECT event_seq, command FROM observed")
_BARE = f"regexp_replace(trim(command), {q(rules.COMMAND_PREFIX)}, '')"


_FIXED_RULES = ", ".join(f"({q(scope)}, {q(p)})" for scope, p in derived.EXCLUDE_RULES)
_RULES = f"""rules AS (SELECT * FROM (VALUES {_FIXED_RULES}) x(scope, pattern)
    UNION SELECT 'project', 'kubectl delete pod ' || event_type || '-' || user_id FROM events WHERE user_id % 7 = 0)"""
_NAMED = """EXISTS (SELECT 1 FROM used WHERE CASE WHEN starts_with(pattern, '^') THEN regexp_matches(bare, pattern)
    ELSE bare = pattern OR starts_with(bare, pattern || ' ') END)"""
ORACLE["f9_exclude_commands"] = query(
    "shell_starts",
    f"""SELECT event_seq, command FROM (SELECT *, {_BARE} AS bare FROM shell_starts) WHERE NOT {_NAMED}""",
    _RULES, "used AS (SELECT DISTINCT pattern FROM rules)",
)
ORACLE["f10_should_optimize"] = query(
    "prompts", "SELECT prompt_id, c_type AS input_type FROM classed WHERE c_go", CLASSED
)
ORACLE["f11_rejected_feedback"] = query(
    "raw_feedback",
    "SELECT feedback_id, rating FROM raw_feedback WHERE rating NOT IN ('good', 'bad')",
)
ORACLE["f12_audit"] = query(
    "observed",
    f"""SELECT {stamp('created_at')} AS created_at, raw_command_preview, cwd, risk_level FROM logged
    WHERE risk_level = 'high' ORDER BY logged.created_at DESC, event_seq DESC LIMIT 20""",
    *LOGGED,
)
ORACLE["f13_min_score_gate"] = query(
    "prompts", "SELECT prompt_id, was_optimized, reason FROM o", CLASSED,
    s.optimize_ctes("classed", "moderate", "o", "first", 3.0),
)
ORACLE["f14_compressible_output"] = query(
    "tool_outputs",
    "SELECT output_id, length(output)::INTEGER AS chars FROM tool_outputs WHERE length(output) >= 100",
)

# --- joins ------------------------------------------------------------------------------------
ORACLE["j1_complete_events"] = query(
    "shell_events",
    f"""SELECT event_seq, shell, pid, CASE WHEN e_kind = 'done' THEN 'completed' ELSE 'started' END AS status,
    CASE WHEN e_kind = 'done' THEN e_code END AS exit_code,
    CASE WHEN e_kind = 'done' THEN {stamp('e_ts')} END AS completed_at
    FROM (SELECT *, lead(kind) OVER w AS e_kind, lead(exit_code) OVER w AS e_code, lead(ts) OVER w AS e_ts
      FROM levelled WINDOW w AS (PARTITION BY shell, pid, lvl ORDER BY ts, event_seq))
    WHERE kind = 'start'""",
    """steps AS (SELECT *, sum(CASE WHEN kind = 'start' THEN 1 ELSE -1 END)
        OVER (PARTITION BY shell, pid ORDER BY ts, event_seq ROWS UNBOUNDED PRECEDING) AS run_sum
        FROM shell_events)""",
    """lows AS (SELECT *, least(0, min(run_sum) OVER
        (PARTITION BY shell, pid ORDER BY ts, event_seq ROWS UNBOUNDED PRECEDING)) AS low FROM steps)""",
    """levelled AS (SELECT *, run_sum - low + CASE WHEN kind = 'start' THEN 0 ELSE 1 END AS lvl
        FROM (SELECT *, coalesce(lag(low) OVER (PARTITION BY shell, pid ORDER BY ts, event_seq), 0)
          AS low_before FROM lows) WHERE NOT (kind = 'done' AND low < low_before))""",
)
ORACLE["j2_feedback_to_runs"] = query(
    "prompts feedback",
    """SELECT f.feedback_id, f.rating, f.run_id, r.input_type FROM feedback f
    LEFT JOIN runs r ON f.run_id = r.run_id""",
    *RUNS,
)
ORACLE["j3_runs_to_patterns"] = query(
    "prompts feedback", "SELECT feedback_id, rating, pattern_hash, pattern_type FROM rated_patterns",
    *RATED,
)
ORACLE["j4_with_history_bonus"] = query(
    "prompts feedback",
    """SELECT c.prompt_id, c.c_type AS input_type, round(coalesce(b.bonus, 0.0::DOUBLE), 6) AS bonus
    FROM classed c LEFT JOIN bonuses b ON c.c_type = b.input_type""",
    *RATED,
)
ORACLE["j4_bonus_as_of"] = query(
    "prompts feedback",
    """SELECT c.prompt_id, c.c_type AS input_type, round(CASE WHEN coalesce(known, 0) = 0 THEN 0.0::DOUBLE
      ELSE greatest(-15.0::DOUBLE, least(15.0::DOUBLE, coalesce(success, 0.0) / known)) END, 6) AS bonus
    FROM classed c
    LEFT JOIN (SELECT c.prompt_id, count(*) AS known FROM classed c JOIN prompt_patterns p
      ON p.pattern_type = c.c_type AND p.first_seen_at < c.created_at GROUP BY ALL) k USING (prompt_id)
    LEFT JOIN (SELECT c.prompt_id, sum(CASE WHEN rating = 'good' THEN 1.0::DOUBLE ELSE -2.0::DOUBLE END) AS success
      FROM classed c JOIN rated_patterns r ON r.pattern_type = c.c_type AND r.created_at < c.created_at GROUP BY ALL) s
      USING (prompt_id)""",
    *RATED,
)
ORACLE["j5_clause_overlap"] = query(
    "texts",
    f"""SELECT b.id, (b.pos - 1)::INTEGER AS pos, (min(a.pos) - 1)::INTEGER AS first_pos,
    count(*)::INTEGER AS partners
    FROM bags a JOIN bags b ON a.id = b.id AND a.pos < b.pos
    WHERE {s.overlap('a.bag', 'b.bag')} >= 0.85::DOUBLE GROUP BY b.id, b.pos""",
    f"""sents AS (SELECT id, unnest(ss) AS sent, unnest(range(1, len(ss) + 1)) AS pos FROM
        (SELECT id, {s.keep(s.sentences(s.strip('text')), lambda x: x + " <> ''")} AS ss FROM texts))""",
    f"""bags AS MATERIALIZED (SELECT * FROM (SELECT id, pos, {s.bag('sent')} AS bag FROM sents)
        WHERE len(bag) > 0)""",
)
ORACLE["j6_exclude_global_rules"] = query(
    "shell_starts",
    f"""SELECT event_seq, bare FROM (SELECT *, {_BARE} AS bare FROM shell_starts) WHERE NOT {_NAMED}""",
    _RULES, "used AS (SELECT pattern FROM rules WHERE scope = 'global' UNION VALUES ('sudo'), ('^cat '))",
)

# --- aggregates -------------------------------------------------------------------------------
ORACLE["a1_run_stats"] = query(
    "prompts",
    """SELECT count(*) AS optimization_runs, coalesce(sum(was_optimized::INTEGER), 0)::BIGINT AS optimized_runs,
    coalesce(sum(token_savings), 0)::BIGINT AS total_token_savings,
    round(coalesce(avg(token_savings_percent), 0), 6) AS avg_savings_percent FROM runs""",
    *RUNS,
)
ORACLE["a2_event_stats"] = query(
    "observed",
    """SELECT count(*) AS shell_events, coalesce(sum(token_estimate), 0)::BIGINT AS observed_token_estimate,
    count(*) FILTER (risk_level = 'high') AS high_risk_events FROM logged""",
    *LOGGED,
)
ORACLE["a3_prompt_patterns"] = query(
    "prompts",
    """SELECT pattern_hash, pattern_type, original_pattern_preview, optimized_pattern_preview,
    usage_count, round(average_savings_percent, 6) AS average_savings_percent, first_run_id
    FROM prompt_patterns""",
    *PATTERNS,
)
ORACLE["a4_command_patterns"] = query(
    "observed",
    f"""SELECT pattern_hash, command_pattern, command_name, usage_count,
    round(average_token_estimate, 6) AS average_token_estimate, {stamp('last_seen_at')} AS last_seen_at
    FROM command_patterns""",
    *LOGGED,
)
ORACLE["a5_pattern_success"] = query(
    "prompts feedback", "SELECT pattern_hash, success_score FROM success", *RATED
)
ORACLE["a6_history_bonus"] = query(
    "prompts feedback", "SELECT input_type, round(bonus, 6) AS bonus FROM bonuses", *RATED
)
ORACLE["a7_compare_levels"] = query(
    "prompts",
    """SELECT level, prompts, tokens_before, tokens_after,
    round((tokens_before - tokens_after) * 100.0::DOUBLE / tokens_before, 6) AS savings_percent FROM (
    """ + " UNION ALL ".join(
        f"""SELECT {q(lv)} AS level, count(*) AS prompts, sum(n_in)::BIGINT AS tokens_before,
        sum(n_out)::BIGINT AS tokens_after FROM {lv}""" for lv in rules.LEVELS
    ) + ")",
    CLASSED, *[s.optimize_ctes("classed", lv, lv) for lv in rules.LEVELS],
)
ORACLE["a9_distinct_hashes"] = query(
    "prompts",
    """SELECT count(*) AS runs, count(DISTINCT input_hash) AS distinct_inputs,
    count(DISTINCT pattern_hash) AS distinct_shapes FROM runs""",
    *RUNS,
)

# --- sort, limit, set operations --------------------------------------------------------------
ORACLE["k1_top_commands"] = query(
    "observed",
    """SELECT command_name, usage_count, round(average_token_estimate, 6) AS average_token_estimate
    FROM command_patterns ORDER BY usage_count DESC, command_name, pattern_hash LIMIT 10""",
    *LOGGED,
)
ORACLE["k2_newest_first"] = query(
    "observed",
    f"""SELECT event_id, {stamp('created_at')} AS created_at, raw_command_preview FROM logged
    WHERE risk_level = 'low' ORDER BY logged.created_at DESC, event_seq DESC LIMIT 50""",
    *LOGGED,
)
ORACLE["k3_best_candidate"] = query(
    "prompts", "SELECT prompt_id, was_optimized, optimized_text, round(score, 6) AS score FROM o",
    CLASSED, s.optimize_ctes("classed", "conservative", "o", "best", 5.0),
)
ORACLE["k4_first_acceptable_candidate"] = query(
    "prompts", "SELECT prompt_id, was_optimized, optimized_text, reason FROM o", CLASSED,
    s.optimize_ctes("classed", "conservative", "o", "first", 15.0),
)
ORACLE["u1_merge_rules"] = query(
    "shell_starts",
    f"""SELECT {s.command_pattern('command')} AS pattern FROM shell_starts
    UNION SELECT split_part({s.command_pattern('command')}, ' ', 1) FROM shell_starts""",
)
over("u2_line_picks", "tool_texts", "output_id",
     picks=s.compress_log("text"))
_EXTRA = [q("Fix this."), q("Debug /srv/jobs/report.py KeyError: no such region")]
_extra_wins = " ".join(
    f"WHEN k_{i} < n_in AND {s.percent('n_in', f'k_{i}')} - r_{i} >= 3.0 THEN {i}" for i in (1, 2)
)
ORACLE["u3_candidates"] = query(
    "prompts",
    f"""SELECT prompt_id, was_optimized OR picked > 0 AS was_optimized, CASE WHEN was_optimized THEN optimized_text
    WHEN picked > 0 THEN [{", ".join(_EXTRA)}][picked] ELSE text END AS optimized_text
    FROM (SELECT *, CASE WHEN was_optimized OR NOT c_go THEN 0 {_extra_wins} ELSE 0 END AS picked FROM scored_extra)""",
    CLASSED,
    s.optimize_ctes("classed", "moderate", "o", "first", 3.0),
    "scored_extra AS MATERIALIZED (SELECT *, "
    + ", ".join(
        f"{s.tokens(e)} AS k_{i}, {s.penalty('text', e, 'moderate')} AS r_{i}" for i, e in enumerate(_EXTRA, 1)
    )
    + " FROM o)",
)
ORACLE["u4_retain"] = query(
    "observed",
    f"""SELECT event_id, {stamp('created_at')} AS created_at FROM logged
    WHERE created_at >= {NOW} - INTERVAL 90 DAY""",
    *LOGGED,
)
ORACLE["u4_rewrite"] = ORACLE["u4_retain"]
ORACLE["u4_expired_count"] = query(
    "observed",
    f"SELECT count(*) FILTER (created_at < {NOW} - INTERVAL 90 DAY) AS deleted FROM logged", *LOGGED
)

# --- tool outputs -----------------------------------------------------------------------------
_ROUTED = f"""routed AS (SELECT *, {s.ROUTE} AS route
    FROM (SELECT *, coalesce(args[1], '') AS a1 FROM tool_outputs))"""
_CONDENSED = f"""condensed AS MATERIALIZED (SELECT *, {s.condensed()} AS condensed
    FROM (SELECT *, {s.lines(s.strip('output'))} AS o_rows FROM routed))"""
ORACLE["o0_router"] = query("tool_outputs", "SELECT output_id, route FROM routed", _ROUTED)
for _name, _kinds in {
    "o1_git_status": ["git_status"], "o2_git_log": ["git_log"], "o3_git_diff": ["git_diff"],
    "o4_git_action": ["git_action"], "o5_tests": ["test"], "o6_docker": ["docker"],
    "o7_listings": ["kubectl", "listing", "matches"], "o8_file_read": ["file_read"],
    "o9_build": ["build"], "o10_lint": ["lint"], "o11_cloud": ["cloud"],
    "o12_download": ["download"], "o13_generic": ["generic"],
}.items():
    ORACLE[_name] = query(
        "tool_outputs",
        f"SELECT output_id, route, condensed FROM condensed WHERE {s.within('route', _kinds)}",
        _ROUTED, _CONDENSED,
    )
ORACLE["a8_output_savings"] = query(
    "tool_outputs",
    f"""SELECT coalesce(command_name, 'TOTAL') AS command_name, raw_lines, condensed_lines,
    CASE WHEN raw_lines > 0 THEN trunc((raw_lines - condensed_lines) * 100.0::DOUBLE / raw_lines)::BIGINT
      ELSE 0 END AS saved_percent
    FROM (SELECT command_name, sum(raw)::BIGINT AS raw_lines, sum(kept)::BIGINT AS condensed_lines
      FROM (SELECT command_name, len({s.lines('output')}) AS raw, len({s.lines('condensed')}) AS kept
        FROM condensed) GROUP BY ROLLUP (command_name))""",
    _ROUTED, _CONDENSED,
)

# --- streaming: what the batch form gives ---------------------------------------------------------
ORACLE["st1_complete_stream"] = (
    "SELECT event_seq, shell, pid, exit_code, completed_at FROM (" + ORACLE["j1_complete_events"] + ") WHERE status = 'completed'"
)
ORACLE["st2_running_patterns"] = query(
    "observed",
    "SELECT command_pattern, usage_count, round(average_token_estimate, 6) AS average_token_estimate FROM command_patterns",
    *LOGGED,
)
ORACLE["st3_ingest"] = query(
    "observed",
    "SELECT event_id, command_hash, raw_command_preview, token_estimate, input_type, risk_level FROM logged",
    *LOGGED,
)
ORACLE["st4_retention_stream"] = query(
    "shell_events", "SELECT strftime(ts, '%Y-%m-%d') AS day, kind, count(*) AS events FROM shell_events GROUP BY ALL"
)

# --- the same results by other ways: loads, streams, stored tables -------------------------------
ORACLE["a3_patterns_by_load"] = ORACLE["a3_prompt_patterns"]
ORACLE["st2_running_prompt_patterns"] = ORACLE["a3_prompt_patterns"]
ORACLE["a4_patterns_by_load"] = ORACLE["a4_command_patterns"]
ORACLE["a5_success_by_load"] = ORACLE["a5_pattern_success"]
ORACLE["s7_rotate_archive"] = ORACLE["s7_archive_failures"]
ORACLE["j3_live"] = query("prompts feedback", "SELECT feedback_id, rating, pattern_hash FROM rated_patterns", *RATED)
ORACLE["st4_retained_table"] = query(
    "shell_events",
    f"""SELECT event_seq, kind, {stamp('ts')} AS ts FROM shell_events
    WHERE ts >= (SELECT max(ts) FROM shell_events) - INTERVAL 7 DAY""",
)
_SENTENCES = (
    f"""sents AS (SELECT id, unnest(ss) AS sent, unnest(range(0, len(ss))) AS pos FROM
        (SELECT id, {s.keep(s.sentences(s.strip('text')), lambda x: x + " <> ''")} AS ss FROM texts))""",
    f"""bags AS (SELECT *, min(pos) OVER (PARTITION BY id, bag) AS first_pos
        FROM (SELECT id, pos, list_sort({s.bag('sent')}) AS bag FROM sents) WHERE len(bag) > 0)""",
    "classes AS MATERIALIZED (SELECT id, pos, bag FROM bags WHERE pos = first_pos)",
)
ORACLE["j5_clause_pairs"] = query(
    "texts",
    f"""SELECT a.id, a.pos::INTEGER AS first_pos, b.pos::INTEGER AS second_pos,
    len(list_intersect(a.bag, b.bag))::INTEGER AS shared
    FROM classes a JOIN classes b ON a.id = b.id AND a.pos < b.pos WHERE {s.overlap('a.bag', 'b.bag')} >= 0.85::DOUBLE""",
    *_SENTENCES,
)
ORACLE["j5_clause_classes"] = query(
    "texts", "SELECT id, pos::INTEGER AS pos, first_pos::INTEGER AS first_pos, len(bag)::INTEGER AS keywords FROM bags", *_SENTENCES
)
