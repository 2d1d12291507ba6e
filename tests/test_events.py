import random

import pytest

from promptloom.operators import events as e
from promptloom.operators.chunks import running_totals, with_chunks
from promptloom.sources.tables import SHELL_EVENTS


def frame(spark, rows):
    from pyspark.sql import functions as F

    base = spark.createDataFrame(
        rows, "event_seq bigint, sec bigint, kind string, shell string, pid int"
    )
    return base.select(
        "event_seq", F.timestamp_seconds("sec").alias("ts"), "kind", "shell", "pid",
        F.lit("/w").alias("cwd"), F.lit("ls").alias("command"),
        F.when(F.col("kind") == "done", F.col("event_seq").cast("int")).alias("exit_code"),
    )


def brute_force(rows):
    out, stacks = {}, {}
    for seq, sec, kind, shell, pid in sorted(rows, key=lambda r: (r[1], r[0])):
        stack = stacks.setdefault((shell, pid), [])
        if kind == "start":
            stack.append(seq)
            out[seq] = None
        elif stack:
            out[stack.pop()] = seq
    return out


def test_golden_order(spark):
    kinds = ["start", "start", "done", "done", "done", "start", "start", "done"]
    rows = [(i, i, k, "bash", 1) for i, k in enumerate(kinds)]
    got = {r.event_seq: r.exit_code for r in e.complete_events(frame(spark, rows)).collect()}
    assert got == {0: 3, 1: 2, 5: None, 6: 7}


@pytest.mark.parametrize("chunk", [1, 7, 50, 10_000])
@pytest.mark.parametrize("share", [0.4, 0.5, 0.65])
def test_chunks_match_brute_force(spark, chunk, share):
    rng = random.Random(chunk * 100 + int(share * 100))
    rows = [
        (i, rng.randrange(400), "start" if rng.random() < share else "done",
         rng.choice(["bash", "zsh"]), 1 if rng.random() < 0.6 else rng.randrange(2, 5))
        for i in range(1500)
    ]
    got = {r.event_seq: r.exit_code for r in e.complete_events(frame(spark, rows), chunk).collect()}
    assert got == brute_force(rows)


def test_deep_nesting_over_chunks(spark):
    rows = [(i, i, "start", "sh", 1) for i in range(200)]
    rows += [(200 + i, 200 + i, "done", "sh", 1) for i in range(250)]
    got = {r.event_seq: r.exit_code for r in e.complete_events(frame(spark, rows), 10).collect()}
    assert got == {i: 399 - i for i in range(200)}


def test_filters(column):
    seen = column(e.is_observable, [
        "ls", "  ", "loom stats", "command loom x", "__loom_hook", "trap x", "history -a", "loomx",
    ])
    assert seen == [True, False, False, False, False, False, False, True]
    assert column(e.without_prefix, ["sudo A=1 b=2 git x", "sudo", "git x"]) == ["git x", "sudo", "git x"]


def rules_frame(spark, patterns):
    return spark.createDataFrame([(p,) for p in patterns], "pattern string")


def test_exclusion(spark):
    names = ["git rebase main", "git rebased", "sudo curl x", "X=1 docker exec a", "npm test", "ls (", "ls(x", None, "", "a  b c", "a  bc", "sudo"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "command string, i int")
    kept = e.exclude_commands(df, rules_frame(spark, ["git rebase", "^curl", "docker exec", "npm test", "^ls (", "a  b", None, "npm test"]))
    assert kept.columns == df.columns
    assert [r.command for r in kept.orderBy("i").collect()] == ["git rebased", "ls(x", None, "", "a  bc", "sudo"]
    assert e.exclude_commands(df, rules_frame(spark, [])).count() == len(names)
    # as many passes as rules
    few = e.exclude_commands(df, rules_frame(spark, ["^curl", "^git", "^ls [(]", "^npm"]), searched_at_once=1)
    assert {r.command for r in few.collect()} == {"X=1 docker exec a", "ls(x", None, "", "a  b c", "a  bc", "sudo"}


def test_exclusion_by_many_rules(spark):
    """100,000 prefix rules, some of them regular expressions, on commands of which a third are one."""
    from pyspark.sql import functions as F

    rules = spark.range(100_000).select(F.concat(F.lit("tool"), "id", F.lit(" run")).alias("pattern"))
    rules = rules.unionByName(rules_frame(spark, [f"^tool{i} s" for i in range(250)]))
    verb = F.element_at(F.array(F.lit("run"), F.lit("run x"), F.lit("runs"), F.lit("stop")), (F.col("id") % 4 + 1).cast("int"))
    name = F.when(F.col("id") % 3 == 0, F.lit("tool7")).otherwise(F.concat(F.lit("tool"), F.col("id") % 150_000))
    df = spark.range(30_000).select(F.concat_ws(" ", name, verb).alias("command"))
    kept = e.exclude_commands(df, rules)
    want = [
        r.command for r in df.collect()
        if not (r.command.split()[1] == "run" and int(r.command.split()[0][4:]) < 100_000)
        and not (r.command.split()[1] == "stop" and int(r.command.split()[0][4:]) < 250)
    ]
    assert sorted(r.command for r in kept.collect()) == sorted(want)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_logged_form(spark):
    from pyspark.sql import functions as F

    rows = [(1, 5, "start", "bash", 7)]
    df = frame(spark, rows).withColumn(
        "command", F.lit(" export OPENAI_API_KEY=sk-abcdefghijklmnopqrstuvwxyz123456")
    )
    row = e.log_events(df).first()
    assert "sk-" not in row.raw_command_preview and "REDACTED" in row.raw_command_preview
    assert row.input_type == "raw_shell_command" and row.status == "started"
    assert SHELL_EVENTS.startswith("event_seq")


def test_completion_keeps_null_keys_and_cuts_hot_hours(spark):
    """One pid-hour with most rows, cut into many chunks, and rows whose shell or pid is null."""
    rows, n = [], 0
    for i in range(600):
        for kind in ("start", "start", "done") if i % 3 else ("start", "done", "done"):
            rows.append((n, 1_700_000_000.0 + i * 0.5 + len(rows) % 7 * 0.01, kind, "bash", 7))
            n += 1
    rows += [(n + i, 1_700_000_000.0 + i, k, s, p) for i, (k, s, p) in enumerate(
        [("start", None, 1), ("done", None, 1), ("start", "zsh", None), ("start", None, None), ("done", None, None)])]
    frame = spark.createDataFrame(rows, "event_seq long, at double, kind string, shell string, pid int").selectExpr(
        "event_seq", "timestamp_micros(cast(at * 1e6 as bigint)) AS ts", "kind", "shell", "pid",
        "'/' AS cwd", "'x' AS command", "0 AS exit_code",
    )
    from promptloom.operators.events import complete_events

    open_, want = {}, {}
    for r in sorted(frame.collect(), key=lambda r: (r.ts, r.event_seq)):
        stack = open_.setdefault((r.shell, r.pid), [])
        if r.kind == "start":
            stack.append(r.event_seq)
            want[r.event_seq] = None
        elif stack:
            want[stack.pop()] = r.ts
    got = complete_events(frame, chunk_rows=50).collect()
    assert {r.event_seq: r.completed_at for r in got} == want


def test_bursts_are_cut_by_rows(spark):
    """Nine tenths of an hour within one second, many of them within one microsecond."""
    from pyspark.sql import functions as F

    n, most = 60_000, 1000
    second = F.when(F.col("id") % 10 == 0, F.col("id") % 3600).otherwise(1800)
    micros = F.when(F.col("id") % 10 == 0, 0).otherwise(F.when(F.col("id") % 10 < 6, 7).otherwise(F.col("id") % 1000))
    rows = spark.range(n).select(
        F.col("id").alias("event_seq"), F.timestamp_micros((1_700_000_000 - 1_700_000_000 % 3600 + second) * 1_000_000 + micros).alias("ts"),
        F.lit("bash").alias("shell"), F.lit(1).alias("pid"),
    )
    chunks = with_chunks(rows, ["shell", "pid"], ("ts", "event_seq"), 3600, most).groupBy("_chunk").agg(
        F.count("*").alias("n"), F.min(F.struct("ts", "event_seq")).alias("low"), F.max(F.struct("ts", "event_seq")).alias("high")
    ).orderBy("_chunk").collect()
    assert sum(c.n for c in chunks) == n and max(c.n for c in chunks) < 2 * most and len(chunks) < 2 * n / most
    assert all(a.high < b.low for a, b in zip(chunks, chunks[1:]))


def test_running_totals(spark):
    """A key with most rows in few instants, null keys, empty sums; every chunk size gives the same."""
    rng = random.Random(8)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else "x", rng.choice([10, 10, 10, 500, 90_000, 200_000]), i, rng.choice([None, 1, 2, -3])) for i in range(900)]
    frame = spark.createDataFrame(rows, "k string, sec bigint, n bigint, v bigint").selectExpr("k", "timestamp_seconds(sec) AS at", "n", "v")
    want, total = {}, {}
    for k, _, n, v in sorted(rows, key=lambda r: (r[1], r[2])):
        total[k] = total.get(k, 0) + (v or 0)
        want[n] = total[k]
    for most in (5, 70, 100_000):
        got = running_totals(frame, ["k"], ("at", "n"), ["v"], most=most)
        assert got.columns == ["k", "at", "n", "v", "running_v"]
        assert {r.n: r.running_v for r in got.collect()} == want


def test_pairs_of_overlapping_clauses(spark):
    """One text of many sentences, with repeats, against all pairs."""
    from pyspark.sql import functions as F

    from promptloom.operators.intext import clause_bags, overlapping_pairs

    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "theta"]
    texts = [(1, " ".join(" ".join(rng.sample(words, rng.randint(1, 6))).capitalize() + "." for _ in range(120))), (2, "the. of. 12!"), (3, None), (4, "")]
    bags = clause_bags(spark.createDataFrame(texts, "id bigint, text string"), "id", "text").cache()
    rows = {r.pos: (r.first_pos, set(r.bag)) for r in bags.collect()}
    assert all(min(q for q in rows if rows[q][1] == rows[p][1]) == rows[p][0] for p in rows) and len(rows) == 120
    for threshold in (0.7, 0.85, 1.0):
        got = {(r.first_pos, r.second_pos): r.shared for r in overlapping_pairs(bags, "id", threshold).collect()}
        first = [p for p in rows if rows[p][0] == p]
        want = {(a, b): len(rows[a][1] & rows[b][1]) for a in first for b in first if a < b}
        assert got == {(a, b): n for (a, b), n in want.items() if n / min(len(rows[a][1]), len(rows[b][1])) >= threshold} and got
    # forty thousand sentences in one text: their keywords are rows of many tasks
    sentences = F.transform(F.sequence(F.lit(0), F.lit(39_999)), lambda i: F.concat(F.lit("word"), F.translate(F.lower(F.conv(i % 39_990, 10, 26)), "0123456789", "qrstuvwxyz"), F.lit(" stays here.")))
    long = spark.range(1).select("id", F.array_join(sentences, " ").alias("text"))
    many = overlapping_pairs(clause_bags(long, "id", "text"), "id", 0.9)
    assert many.count() == 0


def test_pairs_travel_once_by_text(spark):
    """Short and long texts give the pairs of all rows against all, also where a key comes twice: a repeated row takes
    no keyword's place among those that a class looks up. Sentences are shuffled once."""
    from promptloom.operators.intext import clause_bags, overlapping_pairs

    rng = random.Random(11)
    words = ["alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "theta", "lambda", "upsilon"]
    text = "Alone alpha beta gamma delta kappa sigma. Alpha beta gamma delta kappa sigma omega theta. "
    text += "Omega theta. Alone again. " + " ".join(" ".join(rng.sample(words, rng.randint(1, 9))) + "." for _ in range(30))
    rows = [(1, text), (1, text), (2, text), (3, "Alpha beta. Beta alpha gamma."), (3, "Gamma. Delta gamma."), (None, text)]
    bags = clause_bags(spark.createDataFrame(rows, "id bigint, text string"), "id", "text")
    assert bags._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    found = [(r.id, r.pos, set(r.bag)) for r in bags.collect() if r.pos == r.first_pos]
    want = sorted(
        (i, a, b, len(x & y)) for i, a, x in found for j, b, y in found
        if i == j and a < b and len(x & y) / min(len(x), len(y)) >= 0.85
    )
    assert want.count((1, 0, 1, 6)) == 4 and want.count((2, 0, 1, 6)) == 1
    for most in (1, 30, 4096):
        got = overlapping_pairs(bags, "id", 0.85, most=most)
        assert got.columns == ["id", "first_pos", "second_pos", "shared"]
        assert sorted(tuple(r) for r in got.collect()) == want
