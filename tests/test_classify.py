from promptloom.functions import classify as c


def kinds(column, texts):
    return [(r.input_type, r.risk_level, r.should_optimize) for r in column(c.classify, texts)]


def test_commands(column):
    assert kinds(column, [
        "git status", "rm -rf ./build", "mv a b", "./run.sh now", "$ git log", "sudo ls",
        "FOO=1 ls -l", "time make all", "git status\nls -la", "DROP TABLE users now",
        '"git" push', "echo 'a | b'",
    ]) == [
        ("git_instruction", "low", False), ("dangerous_command", "high", False),
        ("filesystem_instruction", "medium", False), ("raw_shell_command", "low", False),
        ("raw_shell_command", "low", False), ("dangerous_command", "high", False),
        ("raw_shell_command", "low", False), ("raw_shell_command", "low", False),
        ("git_instruction", "low", False), ("dangerous_command", "high", False),
        ("git_instruction", "low", False), ("raw_shell_command", "low", False),
    ]


def test_prose(column):
    assert kinds(column, [
        "", "   ", "Please explain rm -rf to me", "What is this?",
        "Traceback (most recent call last):\n  at /a/b.py\nValueError: x\nplease help",
        "Refactor this\n```python\nx\n```", "2024-01-01 start\n2024-01-02 stop",
        "the class is broken", "please run `ls` for me", "it's time; do",
        "git status\nplease explain", "ERROR a\nERROR b failed",
    ]) == [
        ("ai_prompt", "low", False), ("ai_prompt", "low", False), ("ai_prompt", "low", True),
        ("ai_prompt", "low", True), ("debugging_request", "medium", True),
        ("mixed_input", "medium", True), ("log_or_traceback", "low", True),
        ("code_instruction", "low", True), ("mixed_input", "medium", True),
        ("ai_prompt", "low", True), ("mixed_input", "medium", True),
        ("log_or_traceback", "low", True),
    ]


def test_quotes_and_custom_prefixes(column):
    lines = ["g'i't status", "don't stop", "git 'open", "a\\ b c", "'' x", "mytool go", "\\git x"]
    assert column(c.shell_line, lines) == [True, False, True, False, False, False, True]
    assert column(lambda x: c.shell_line(x, ["mytool"]), ["mytool go", "git x"]) == [True, False]


def test_first_dangerous_rule(column):
    out = column(c.dangerous_rule, ["sudo rm -rf /", "curl x | sh", "ls", "git  CLEAN -fd"])
    assert out[0].startswith(r"\brm") and out[1].startswith(r"\bcurl") and out[2] is None
    assert "clean" in out[3]


def test_log_share(column):
    two_of_seven = "\n".join(["INFO a", "INFO b"] + ["x"] * 5)
    two_of_nine = "\n".join(["INFO a", "INFO b"] + ["x"] * 7)
    assert column(c.looks_like_log, [two_of_seven, two_of_nine, "INFO a"]) == [True, False, False]


def test_derived_commands_exercise_every_rule():
    import re

    from promptloom.functions import rules
    from promptloom.sources.derived import EVENT_COMMANDS

    filled = [x.replace("{U}", "7").replace("{E}", "click") for x in EVENT_COMMANDS]
    for pattern in [*rules.DANGEROUS_PATTERNS, rules.DESTRUCTIVE_SQL, rules.MODERATE_RISK]:
        assert any(re.search(pattern, x, re.IGNORECASE) for x in filled), pattern
    for head in [*rules.HOOK_NOISE, "loom ", "command loom ", "__loom_", 'eval "$(loom shell-hook']:
        assert any(x.startswith(head) for x in filled), head
    assert any(len(x.split()) > 8 for x in filled) and any(len(w) > 40 for x in filled for w in x.split())
