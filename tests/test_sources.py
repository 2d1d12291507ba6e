import pytest
from pyspark.sql import functions as F

from promptloom.sources import tables as s


def test_prompt_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two\n")
    row = s.read_prompts(spark, str(tmp_path), "text").first()
    assert row.text == "line one\nline two\n" and row.prompt_id is not None


def test_outputs_concatenate(spark, tmp_path):
    data = [(1, None, "ls", ["-l"], "out", "err", 0), (2, None, "ls", [], None, "err", 1)]
    path = str(tmp_path / "o")
    spark.createDataFrame(data, s.TOOL_OUTPUTS).write.parquet(path)
    got = {r.output_id: r.output for r in s.read_tool_outputs(spark, path).collect()}
    assert got == {1: "outerr", 2: "err"}


def test_json_and_tsv(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\tb"), (2, None)], "id int, v string")
    assert [r.value for r in s.as_json(df).orderBy("value").collect()] == [
        '{"id":1,"v":"a\\tb"}', '{"id":2}',
    ]
    s.export_json(df, str(tmp_path / "j"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "j")).count() == 2
    s.export_tsv(df, str(tmp_path / "t"))
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t"))
    assert {r.id for r in back.collect()} == {"1", "2"}


SCHEMA = "id bigint, created_at timestamp"


def hours(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint").select("id", F.timestamp_seconds(F.col("id") * 7200).alias("created_at"))


def ids(table):
    return sorted(r.id for r in table.read().collect())


def test_writers_by_day(spark, tmp_path):
    s.write_runs(hours(spark, range(100)), str(tmp_path / "runs"))
    assert (tmp_path / "runs" / "date=1970-01-01").exists()


def test_retention_of_a_day_table(spark, tmp_path):
    table = s.DayTable(spark, str(tmp_path / "t"), SCHEMA)
    assert ids(table) == [] and table.retain("1970-01-05 06:00:00", 2) == 0 and table.newest() is None
    table.append(hours(spark, range(60)), "a")
    table.append(hours(spark, [5, *range(60, 100)]), "b")
    table.append(hours(spark, [5, *range(60, 100)]), "b")  # a load that runs again
    assert ids(table) == sorted([*range(100), 5])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "data").rglob("*.parquet") if "date=1970-01-04" in str(p)}
    # limit: 1970-01-03 06:00 -> ids below 27 go, one of them twice
    assert table.retain("1970-01-05 06:00:00", 2) == 28
    assert ids(table) == list(range(27, 100)) and table.newest().startswith("1970-01-09")
    assert table.retain("1970-01-05 06:00:00", 2) == 0
    assert before and all(p.stat().st_mtime_ns == at for p, at in before.items())
    assert not list((tmp_path / "t" / "data").glob("load=*/date=1970-01-01"))


@pytest.mark.parametrize("step", ["manifest", "sweep"])
def test_retention_that_stops_between_its_steps(spark, tmp_path, step, monkeypatch):
    table = s.DayTable(spark, str(tmp_path / "t"), SCHEMA)
    table.append(hours(spark, range(100)), "a")

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(*((s.Versions, "write", stop) if step == "manifest" else (s.DayTable, "_sweep", stop)))
        with pytest.raises(RuntimeError):
            table.retain("1970-01-05 06:00:00", 2)
    again = s.DayTable(spark, str(tmp_path / "t"), SCHEMA)
    # before the commit nothing has happened, after it all has
    assert ids(again) == list(range(100) if step == "manifest" else range(27, 100))
    again.retain("1970-01-05 06:00:00", 2)
    again.append(hours(spark, [200]), "b")
    assert ids(again) == [*range(27, 100), 200]
    assert not list((tmp_path / "t" / "data").glob("load=*/date=1970-01-01"))


def test_versions(spark, tmp_path):
    table = s.Versions(spark, str(tmp_path / "v"), "id bigint")
    assert table.before().count() == 0
    for n in (0, 1, 2, 2, 5):
        table.write(table.before(n).unionByName(spark.createDataFrame([(n,)], "id bigint")), n)
    assert [r.id for r in table.before().orderBy("id").collect()] == [0, 1, 2, 5]
    assert sorted(p.name for p in (tmp_path / "v").glob("v=*")) == ["v=2", "v=5"]


def test_archive_keeps_the_newest_of_all_writes(spark, tmp_path):
    path = str(tmp_path / "archive")
    for batch, rows in enumerate(([5, 1, 9], [7, 2], [], [3])):
        frame = spark.createDataFrame([(i, "x", str(i)) for i in rows], "output_id bigint, file_stem string, content string")
        s.write_archive(spark, frame.withColumn("ts", F.timestamp_seconds("output_id")), path, 3, batch)
        assert s.read_archive(spark, path).count() == 3
    assert {r.output_id for r in s.read_archive(spark, path).collect()} == {5, 7, 9}


def test_rollup_of_any_split(spark, tmp_path):
    """Loads in any order, one of them twice, folded at any point, stopped while folding."""
    merge = lambda df: df.groupBy("k").agg(F.sum("n").alias("n"))
    rollup = s.Rollup(spark, str(tmp_path / "r"), "k string, n bigint", merge)
    assert rollup.read().count() == 0
    for load, rows in enumerate(([("a", 1), ("b", 2)], [("a", 3)], [("a", 3)], [("c", 5)])):
        rollup.add(spark.createDataFrame(rows, "k string, n bigint"), load)
        rollup.add(spark.createDataFrame(rows, "k string, n bigint"), load)
        if load == 1:
            rollup.compact()
            # as if stopped before the folded loads were removed, then run again
            rollup.add(spark.createDataFrame(rows, "k string, n bigint"), load)
    assert {r.k: r.n for r in rollup.read().collect()} == {"a": 7, "b": 2, "c": 5}
    rollup.compact()
    assert {r.k: r.n for r in rollup.read().collect()} == {"a": 7, "b": 2, "c": 5}


def test_empty_schema_reads(spark, tmp_path):
    for reader, schema in (
        (s.read_prompts, s.PROMPTS), (s.read_shell_events, s.SHELL_EVENTS),
        (s.read_feedback, s.FEEDBACK), (s.read_exclude_rules, s.EXCLUDE_RULES),
    ):
        path = str(tmp_path / reader.__name__)
        spark.createDataFrame([], schema).write.parquet(path)
        assert reader(spark, path).count() == 0
