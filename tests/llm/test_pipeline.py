"""The registered queries on a small table: against their SQL, and the pipeline stage by stage by brute force."""

import glob
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from test_operators import lines_by_force, print_by_force

import __spark_entry__ as entry
import corpus_pipeline
from promptloom.llm.oracle import ORACLE
from promptloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    rows = sorted(tuple(r[names.index(c)] for c in columns) for r in want.fetchall())
    assert rows and sorted(tuple(r[c] for c in columns) for r in got.collect()) == rows


def test_entry_registers_all():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's documents, written and read again as on a cluster."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(root / name))
        out.append(spark.read.parquet(str(root / name)))
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def test_stages_keep_the_columns_and_only_drop_what_they_judge(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    docs, clean, lines, single, mixed, packed = stages
    assert all(df.columns == docs.columns for df in (clean, lines, single, mixed))
    before, after = texts(docs), texts(clean)
    assert after.items() <= before.items() and len(after) > 0.8 * len(before)
    assert texts(lines) == {i: "\n".join(kept) for i, kept in lines_by_force(after).items()}

    kept = texts(single)
    prints = {i: print_by_force(t) for i, t in texts(lines).items()}
    parent = {i: i for i in prints}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    ids = sorted(prints)
    array = np.array([prints[i] for i in ids], np.uint64)
    for n, a in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(array[n + 1 :] ^ array[n]) <= 3):
            x, y = root(a), root(ids[n + 1 + int(m)])
            parent[max(x, y)] = min(x, y)
    assert set(kept) == {i for i in ids if root(i) == i}

    times = Counter(r.doc_id for r in mixed.collect())
    assert times.keys() <= kept.keys() and max(times.values()) <= 2
    words, sources = {i: len(t.encode().split()) for i, t in kept.items()}, defaultdict(Counter)
    for r in single.collect():
        sources[r.source].update(size=words[r.doc_id], taken=times[r.doc_id] * words[r.doc_id], longest=0)
        sources[r.source]["longest"] = max(sources[r.source]["longest"], words[r.doc_id])
    total = sum(c["size"] for c in sources.values())
    assert abs(sum(c["taken"] for c in sources.values()) - 1.5 * total) <= sum(c["longest"] for c in sources.values())

    lengths = Counter()
    for r in packed.collect():
        lengths[r.doc_id] += r.length
        assert r.offset + r.length <= 4096
    assert lengths.keys() == times.keys()
    assert all(lengths[i] % n == 0 for i, n in times.items())
