from promptloom.operators.outputs import archive_failures, condense, output_savings

SCHEMA = "output_id bigint, command_name string, args array<string>, output string, exit_code int"


def one(spark, command, args, output, code=0):
    df = spark.createDataFrame([(1, command, args, output, code)], SCHEMA)
    return condense(df).first().condensed


def rows(n, head="line"):
    return [f"{head} {i} with some padding" for i in range(n)]


def test_short_output_passes(spark):
    assert one(spark, "find", ["."], "a\nb") == "a\nb"
    assert one(spark, "ps", [], "") == ""


def test_listings(spark):
    body = rows(40)
    for cmd, args, tail in (
        ("find", ["."], "entries"), ("kubectl", ["get"], "lines"), ("rg", ["x"], None),
    ):
        want = "[40 matches total]" if tail is None else f"[40 total {tail}]"
        assert one(spark, cmd, args, "\n".join(body)) == "\n".join(body[:30]) + "\n" + want


def test_file_read(spark):
    body = rows(100)
    out = one(spark, "cat", ["x"], "\n".join(body)).split("\n")
    assert out == body[:40] + ["...", "[100 total lines]"] + body[-10:]


def test_git_status(spark):
    text = (
        "On branch main\nYour branch is up to date with 'origin/main'.\n\nChanges not staged:\n"
        "  (use x)\n\tmodified:   a.py\n\tnew file:   b.py\n\nUntracked files:\n?? c.txt\n M d.py\n"
    )
    assert one(spark, "git", ["status"], text) == (
        "On branch main\nstaged: modified:   a.py, new file:   b.py\nmodified: (use x), M d.py\n"
        "untracked: c.txt"
    )


def test_git_log(spark):
    text = (
        "commit 0123456789abcdef\nAuthor: A <a@b>\nDate: x\n\n    Fix it\n\n    body line\n\n"
        "commit fedcba9876543210\nAuthor: A <a@b>\n\n    Add it\n" + " " * 40
    )
    assert one(spark, "git", ["log"], text) == "0123456 Fix it\nfedcba9 Add it"
    short = "\n".join(rows(10))
    assert one(spark, "git", ["log"], short) == short


def test_git_diff_and_actions(spark):
    diff = ["diff --git a b"] + ["+x"] * 90 + [" ctx"] * 20
    assert one(spark, "git", ["diff"], "\n".join(diff)) == "\n".join(
        diff[:80]
    ) + "\n[diff truncated, 111 total lines]"
    push = "\n".join(rows(5)) + "\n   abc..def  main -> main\n"
    assert one(spark, "git", ["push"], push) == "ok main"
    assert one(spark, "git", ["push"], "\n".join(rows(5))) == "ok pushed"
    assert one(spark, "git", ["commit"], "[main abc1234f] x\n" + push) == "ok abc1234f"
    # only the first line is looked at
    assert one(spark, "git", ["commit"], "hook ran\n[main abc1234f] x\n" + push) == "ok committed"
    assert one(spark, "git", ["pull"], push, 1) == push


def test_suites(spark):
    body = rows(12) + ["3 passed in 0.1s"]
    assert one(spark, "pytest", [], "\n".join(body)) == "3 passed in 0.1s"
    assert one(spark, "cargo", ["test"], "\n".join(rows(12))) == rows(12)[-1]
    failed = rows(12) + ["  FAILED a", "2 passed, 1 failed"]
    assert one(spark, "go", ["test"], "\n".join(failed), 1) == (
        "FAILED a\n2 passed, 1 failed\n2 passed, 1 failed"
    )
    assert one(spark, "g", ["test"], "\n".join(rows(12)), 0) == "\n".join(rows(12))


def test_builds_lint_cloud_network(spark):
    body = rows(40)
    assert one(spark, "npm", ["build"], "\n".join(body)) == body[-1]
    assert one(spark, "npm", ["build"], "\n".join(body + ["Error: a"]), 2) == "Error: a"
    assert one(spark, "ruff", [], "\n".join(body + ["warn x", "Found y"])) == "\n".join(
        ["warn x"] + body[-3:]
    )
    assert one(spark, "aws", [], "x" * 3000) == "x" * 2000 + "\n[truncated, 3000 bytes total]"
    got = one(spark, "curl", [], "\n".join([" 10%", "# bar", "==>", *body]))
    assert got == "\n".join(body)


def test_docker(spark):
    body = ["NAME   STATUS"] + [f"a{i}    up" for i in range(30)]
    assert one(spark, "docker", ["ps"], "\n".join(body)) == "\n".join(
        ["NAME   STATUS"] + [f"a{i}  up" for i in range(20)]
    )
    logs = ["same line"] * 45 + ["end"]
    assert one(spark, "docker", ["logs"], "\n".join(logs)) == "same line\n  [repeated 45x]\nend"


def test_generic(spark):
    body = rows(61)
    assert one(spark, "ps", ["aux"], "\n".join(body)) == "\n".join(body[:60] + ["[62 total lines]"][:0]) + (
        "\n[61 total lines]"
    )
    repeated = ["x"] * 3 + rows(70)
    out = one(spark, "ps", ["aux"], "\n".join(repeated)).split("\n")
    # the collapsed text has 60 lines and a marker, so the final cap fires again
    assert out == ["x", "  [repeated 3x]"] + rows(70)[:58] + ["[61 total lines]"]


def test_savings_and_archive(spark):
    data = [
        (1, "find", ["."], "\n".join(rows(62)), 0), (2, "find", ["."], "\n".join(rows(62)), 1),
        (3, "a/b c", [], "y" * 600, 1), (4, "a", [], "y" * 499, 1),
        (5, "big", [], "z" * 1_048_580, 1),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.command_name: r for r in output_savings(df).collect()}
    assert (got["find"].raw_lines, got["find"].condensed_lines, got["find"].saved_percent) == (124, 62, 50)
    assert got["TOTAL"].raw_lines == 127
    timed = df.selectExpr("*", "timestamp_seconds(output_id) ts")
    kept = {r.output_id: r for r in archive_failures(timed).collect()}
    assert set(kept) == {2, 3, 5} and kept[3].file_stem == "a_b_c"
    assert kept[5].content == "z" * 1_048_576 + "\n[truncated at 1048576 bytes]"
    assert {r.output_id for r in archive_failures(timed, max_files=1).collect()} == {5}
    assert {r.output_id for r in archive_failures(timed, mode="always").collect()} == {1, 2, 3, 5}
    assert archive_failures(timed, mode="never").count() == 0


def test_limits_are_options(spark):
    from promptloom.functions.rules import OutputLimits
    from promptloom.operators.outputs import condense

    text = "\n".join(f"row {i}" for i in range(200))
    frame = spark.createDataFrame([("ls", [], text, 0)], "command_name string, args array<string>, output string, exit_code int")
    assert condense(frame).first().condensed.endswith("[200 total entries]")
    assert condense(frame, OutputLimits(list_lines=None)).first().condensed == text
    assert condense(frame, OutputLimits(list_lines=3)).first().condensed.count("\n") == 3
