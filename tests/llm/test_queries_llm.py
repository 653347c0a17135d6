"""The registered queries at the smallest scale, and the pipeline against brute force."""

import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from riskgrid.llm import quality
from riskgrid.llm.queries import QUERIES, SQL
from riskgrid.llm.shared import remainder

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def test_one_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) < set(entry.queries()) and "pipeline" in entry.queries() and set(SQL) < set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, tables, name):
    got = QUERIES[name](spark, data)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert Counter(map(tuple, got.collect())) == Counter(tables.execute(f"SELECT {columns} FROM ({SQL[name]})").fetchall())


def test_held_out_languages(spark, data, tables):
    lang = dict(tables.execute("SELECT doc_id, lang FROM documents").fetchall())
    held = [r for r in QUERIES["op1_language_id"](spark, data).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held) > 20


def test_held_out_quality(spark, data, tables):
    label = dict(tables.execute("SELECT doc_id, quality FROM labels").fetchall())
    held = [r for r in QUERIES["op9_quality_classifier"](spark, data).collect() if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.85 * len(held) > 10


def test_pipeline_stage_by_stage(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, got[-1], data).write.parquet(f"{tmp_path}/{k}")
        got.append(spark.read.parquet(f"{tmp_path}/{k}"))
        assert name == "packing" or got[-1].columns == docs.columns
    rows = [{r.doc_id: r for r in g.collect()} for g in got[:4]]
    # 9: what the classifier accepts, unchanged
    machine = quality.train(docs, spark.read.parquet(f"{data}/labels.parquet").where(remainder("doc_id", 3) != 1))
    good = {r.doc_id for r in quality.score(docs, machine).collect() if r.predicted}
    assert rows[1] == {i: r for i, r in rows[0].items() if i in good} and 0 < len(good) < len(rows[0])
    # 7: one document of each group of similar sets
    shingles = {}
    for i, r in rows[1].items():
        words = r.text.encode().lower().split()
        shingles[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in shingles}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in shingles:
        for b in shingles:
            if a < b and shingles[a] and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    assert rows[2] == {i: r for i, r in rows[1].items() if find(i) == i} and len(rows[2]) < len(rows[1])
    # 2: later copies of 100 bytes cut out
    seen, cut = set(), {}
    for i, r in sorted(rows[2].items()):
        text, gone = r.text.encode(), set()
        for k in range(len(text) - 99):
            if (piece := text[k : k + 100]) in seen:
                gone |= set(range(k, k + 100))
            seen.add(piece)
        left = bytes(c for k, c in enumerate(text) if k not in gone).decode("utf-8", "ignore")
        if not gone or left.strip(" "):
            cut[i] = left
    assert {i: r.text for i, r in rows[3].items()} == cut and all(r.n_chars == len(r.text) for r in rows[3].values())
    # 6: word counts of the sources near their targets
    words = Counter()
    for r in got[4].collect():
        words[r.source] += len(r.text.encode().split())
        assert rows[3][r.doc_id].text.startswith(r.text)
    sizes = Counter()
    for r in rows[3].values():
        sizes[r.source] += len(r.text.encode().split())
    from riskgrid.llm.mixing import targets

    assert all(abs(words[s] - goal) <= 64 for s, goal in targets(dict(sizes), [5, 2, 1], 3).items())
    # 3: every token of every row once
    ends = Counter()
    for r in got[5].collect():
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048 and got[5].where("start = 0").count() == got[4].count()


def test_pipeline_runs(spark, data):
    assert entry.queries()["pipeline"](spark, data).count() > 100


def test_the_rest_works_without_this_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy), "HOME": "/tmp"})
