"""Every registered query against its DuckDB form, over whole tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from promptloom.plans.oracle import ORACLE
from promptloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
# What these queries leave unchanged would be the text itself: they must change some rows.
MUST_CHANGE = {
    "p1_redact": ("texts", "id", "redacted"),
    "p12_remove_filler_conservative": ("texts", "id", "cleaned"),
    "p12_remove_filler_aggressive": ("texts", "id", "cleaned"),
    "t1_drop_stop_lines_moderate": ("stop_texts", "prompt_id", "kept"),
    "t1_drop_stop_lines_aggressive": ("stop_texts", "prompt_id", "kept"),
    "t2_dedupe_clauses_moderate": ("texts", "id", "deduped"),
    "t3_dedupe_sentences": ("texts", "id", "deduped"),
    "t4_dedupe_paragraphs": ("texts", "id", "deduped"),
    "t5_collapse_repeated_lines": ("texts", "id", "collapsed"),
    "t6_dedupe_tracebacks": ("texts", "id", "deduped"),
    "t7_compress_log": ("tool_texts", "output_id", "compressed"),
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def norm(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    want = [tuple(norm(row[names.index(c)]) for c in cols) for row in cursor.fetchall()]
    assert got == sorted(want, key=repr)
    assert got


@pytest.mark.parametrize("name", sorted(MUST_CHANGE))
def test_query_changes_rows(spark, name):
    from promptloom.plans import queries
    from promptloom.sources import derived

    table, key, column = MUST_CHANGE[name]
    source = {"prompts": derived.prompts}.get(table) or getattr(queries, table)
    before = {r[key]: r.text for r in source(spark, SF).select(key, "text").collect()}
    after = {r[key]: r[column] for r in QUERIES[name](spark, SF).select(key, column).collect()}
    assert any(after[k].split() != before[k].split() for k in before)


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_unbounded_joins(spark):
    """No cross or nested-loop join anywhere but between two one-row totals."""
    for name in ("j1_complete_events", "j2_feedback_to_runs", "j4_with_history_bonus", "f9_exclude_commands", "j4_bonus_as_of", "j5_clause_pairs"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
