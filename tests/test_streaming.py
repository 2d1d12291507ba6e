import random

from pyspark.sql import functions as F

from promptloom.operators.events import complete_events, log_events
from promptloom.operators.history import command_patterns
from promptloom.plans import streams
from promptloom.sources import derived
from promptloom.sources.tables import FEEDBACK, RUNS, DayTable, typed
from promptloom.streaming.events import Completion, LateRows, Rating, Retention, rate_stream

SF = "/root/testdata/sf0.001"


def test_completion_equals_batch(spark):
    live = {(r.event_seq, r.exit_code, r.completed_at) for r in streams.completed(spark, SF).collect()}
    batch = complete_events(derived.shell_events(spark, SF)).where("status = 'completed'").select(
        "event_seq", "exit_code",
        F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"),
    )
    assert live == {tuple(r) for r in batch.collect()} and len(live) > 100


SPANS = "event_seq bigint, sec double, kind string, shell string, pid int"


def shell_frame(spark, rows):
    return spark.createDataFrame(rows, SPANS).selectExpr(
        "event_seq", "timestamp_micros(cast(sec * 1e6 as bigint)) AS ts", "kind", "shell", "pid",
        "'/w' AS cwd", "'ls' AS command", "IF(kind = 'done', cast(event_seq as int), NULL) AS exit_code",
    )


def close(spark, root, batches, delay, finish=True, again=()):
    """The pairs out of batches, each in its own micro-batch; those of ``again`` run twice."""
    matching = Completion(spark, str(root), delay)
    for n, rows in enumerate(batches):
        for _ in range(1 + (n in again)):
            matching(shell_frame(spark, rows), n)
    if finish:
        matching.finish()
    return {(r.event_seq, r.exit_code) for r in matching.completed().collect()}, matching


def test_late_starts_and_batches_that_run_again(spark, tmp_path):
    """Ends before their starts, a pid with most events, a batch repeated after a failure: as the batch form."""
    rng = random.Random(4)
    rows = [
        (i, 1_700_000_000 + i * 0.5, "start" if rng.random() < 0.55 else "done", "bash", 1 if i % 3 else 2) for i in range(400)
    ] + [(1000, 1_700_000_000.0, "start", None, None), (1001, 1_700_000_199.0, "done", None, None)]
    rows.sort(key=lambda r: r[1])
    batches = []
    for at in range(0, len(rows), 201):
        part = rows[at : at + 201]
        batches += [[r for r in part if r[2] == "done"], [r for r in part if r[2] == "start"]]
    want = {(r.event_seq, r.exit_code) for r in complete_events(shell_frame(spark, rows)).where("status = 'completed'").collect()}
    got, matching = close(spark, tmp_path / "a", [*batches, []], 110, again=(2,))
    assert got == want and len(want) > 100 and matching.late().count() == 0


def test_events_wait_until_their_time_is_settled(spark, tmp_path):
    start, done, later = (1, 100.0, "start", "sh", 1), (2, 110.0, "done", "sh", 1), (3, 300.0, "start", "sh", 1)
    got, _ = close(spark, tmp_path / "a", [[done], [start]], 60, finish=False)
    assert got == set()  # nothing newer has come: a start between them may
    got, _ = close(spark, tmp_path / "b", [[done], [start], [later]], 60, finish=False)
    assert got == {(1, 2)}
    # a start of a settled time changes nothing and is kept apart
    got, matching = close(spark, tmp_path / "c", [[start, done], [later], [(4, 105.0, "start", "sh", 1)]], 60)
    assert got == {(1, 2)} and [r.event_seq for r in matching.late().collect()] == [4]


def test_ingest_and_counts_equal_batch(spark):
    starts = derived.shell_events(spark, SF).where("kind = 'start'")
    cols = ["event_id", "command_hash", "raw_command_preview", "token_estimate", "input_type", "risk_level"]
    live = {tuple(r) for r in streams.ingested(spark, SF).select(cols).collect()}
    assert live == {tuple(r) for r in log_events(starts).select(cols).collect()}
    counts = {(r.command_pattern, r.usage_count) for r in streams.running_patterns(spark, SF).collect()}
    batch = command_patterns(log_events(starts)).select("command_pattern", "usage_count")
    assert counts == {tuple(r) for r in batch.collect()}


def test_late_rows_are_kept(spark, tmp_path):
    """Older than the watermark that earlier batches have set; the batch that moves it is not judged by it."""
    step = LateRows(spark, str(tmp_path), "id bigint, at timestamp", "at", 10)
    for number, seconds in enumerate(([100, 50], [], [95, 89], [95, 200], [150, 195])):
        rows = spark.createDataFrame([(t, t) for t in seconds], "id bigint, sec bigint").selectExpr("id", "timestamp_seconds(sec) AS at")
        step(rows, number)
    assert sorted(r.id for r in step.read().collect()) == [89, 150]


def test_stored_events_age_as_they_arrive(spark, tmp_path):
    table = DayTable(spark, str(tmp_path), "id bigint, at timestamp", "at")
    step = Retention(table, days=3)
    for number, days in enumerate(([1, 2], [9, 5], [5, 7], [5, 7], [10])):
        step(spark.createDataFrame([(d, d * 86_400 + 7) for d in days], "id bigint, sec bigint").selectExpr("id", "timestamp_seconds(sec) AS at"), number)
    assert sorted(r.id for r in table.read().collect()) == [7, 7, 9, 10]


def test_micro_batches_of_many_files(spark, tmp_path, monkeypatch):
    """More events make more files of a micro-batch, not larger ones: a batch is read by many tasks."""
    monkeypatch.setattr(streams, "EVENTS_PER_FILE", 50)
    columns = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
    rows = spark.range(1000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 7) AS ts", "id % 40 AS user_id", "'view' AS event_type"
    )
    rows.union(spark.createDataFrame([(None, None, None, None)], columns)).write.parquet(f"{tmp_path}/events.parquet")
    stream = streams._source(spark, str(tmp_path), str(tmp_path / "work"))
    files = spark.read.parquet(f"{tmp_path}/work/in").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 12 and max(r["count"] for r in files) < 400
    sizes = []
    streams.run_batches(stream, lambda batch, n: sizes.append(batch.select(F.input_file_name()).distinct().count()), str(tmp_path / "run"))
    assert 3 <= len(sizes) <= 4 and max(sizes) > 3 and sum(sizes) == len(files)
    logged = log_events(derived.shell_events(spark, str(tmp_path)).where("kind = 'start'")).select("event_id", "risk_level")
    got = streams.ingested(spark, str(tmp_path)).select("event_id", "risk_level")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, logged.collect()), key=repr)


def given_frame(spark, rows):
    """Feedback out of (id, day, run)."""
    rows = spark.createDataFrame(rows, "feedback_id string, day double, run_id string")
    at = F.timestamp_seconds(F.col("day") * 86_400)
    return typed(rows.select("*", at.alias("created_at"), F.lit("good").alias("rating"), F.lit("").alias("notes")), FEEDBACK)


def known_frame(spark, rows):
    """Runs out of (id, day, shape, optimized)."""
    rows = spark.createDataFrame(rows, "run_id string, day double, pattern_hash string, was_optimized boolean")
    rows = rows.withColumn("created_at", F.timestamp_seconds(F.col("day") * 86_400))
    others = [name for name in (f.split()[0] for f in RUNS.split(", ")) if name not in rows.columns]
    return typed(rows.select("*", *[F.lit(None).alias(c) for c in others]), RUNS)


def expected(given, known):
    """Feedback with each run of its id, where an optimized run of the shape came no later."""
    first = {}
    for _, day, shape, optimized in known:
        if optimized and day is not None and shape is not None:
            first[shape] = min(day, first.get(shape, day))
    return sorted(
        (f, shape) for f, at, run in given for key, _, shape, _ in known
        if run is not None and run == key and at is not None and shape in first and first[shape] <= at
    )


def test_feedback_of_any_time_is_rated_live(spark):
    """Years between feedback, its run and the first run of the shape, in either order; times before 1970."""
    known = [(f"r{i}", -2000.0 + 97 * i, f"s{i % 7}", i % 14 < 7) for i in range(60)]
    given = [(f"f{i}", -1990.0 + 53 * i, f"r{i * 31 % 64}") for i in range(100)]
    got = streams.rated_live(spark, given_frame(spark, given), known_frame(spark, known))
    want = expected(given, known)
    assert got.columns == ["feedback_id", "created_at", "rating", "pattern_hash"]
    assert sorted((r.feedback_id, r.pattern_hash) for r in got.collect()) == want and 50 < len(want) < 94


def test_rating_by_batches_in_any_order(spark, tmp_path):
    """Repeated keys, missing values, batches of one kind or of nothing, batches that run again: as the batch form."""
    rng = random.Random(7)
    ids, days = [*(f"r{i}" for i in range(12)), None], [*(40.0 * i for i in range(20)), None]
    shapes = ["s0", "s1", "s2", "s3", None]
    known = [(rng.choice(ids), rng.choice(days), rng.choice(shapes), rng.choice([True, False, None])) for _ in range(30)]
    known += [("r0", 0.0, "never", False), known[0]]
    given = [(f"f{i % 50}", rng.choice(days), rng.choice(ids)) for i in range(60)] + [("late", 900.0, "r0")] * 2
    parts = [(given[:20], known[:3]), (given[20:40], []), ([], []), ([], known[3:20]), (given[40:], known[20:])]
    rating = Rating(spark, str(tmp_path), compact_every=2)
    for number, (some, others) in enumerate(parts):
        for _ in range(1 + (number in (1, 3))):
            rating(rate_stream(given_frame(spark, some), known_frame(spark, others)), number)
        got = sorted((r.feedback_id, r.pattern_hash) for r in rating.rated().collect())
        come = parts[: number + 1]
        assert got == expected([r for p in come for r in p[0]], [r for p in come for r in p[1]])
    assert len(got) > 40 and ("late", "never") not in got
