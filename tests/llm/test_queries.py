"""Registered corpus queries against their SQL twins, and the pipeline."""

import os
import re
import sys
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


def test_all_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if re.match(r"op\d+_", x)} and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_minhash_near_dedup", "op3_warc", "op4_license_scan", "op5_decontamination", "op8_secret_scan", "op10_embedding_near_dedup", "op12_filter_audit", "op13_source_audit"])
def test_same_rows_as_sql(spark, name):
    import duckdb
    from compare import TABLES, rows_of

    from convoeval.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(ORACLES[name])
    cols, got, _ = rows_of(df.columns, df.collect())
    ocols, want, _ = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert cols == ocols and got == want


def test_native_queries_run_no_python(spark):
    from convoeval.llm.queries import QUERIES

    for name in ("op4_license_scan", "op8_secret_scan"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name


def test_pipeline_stages(spark):
    import corpus_pipeline
    from test_lines_and_links import brute_lines, brute_links
    from test_scans import brute_contamination

    from convoeval.llm.common import stored

    tables = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark", "labels")}
    docs, kept = tables["documents"], []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        kept.append({r.doc_id: r for r in docs.collect()})
    assert [len(s) for s in kept] == sorted((len(s) for s in kept), reverse=True)
    assert all(set(corpus) <= set(before) for before, corpus in zip(kept, kept[1:]))
    columns = tables["documents"].columns
    toxic, lines, near, clean, last = kept
    assert [*next(iter(clean.values())).asDict()] == columns
    marks = {r.doc_id: r.toxic for r in tables["labels"].collect()}
    assert sum(marks.get(d) == 0 for d in toxic) == sum(v == 0 for v in marks.values())  # no clean one goes
    assert {(r.doc_id, r.text) for r in lines.values()} == {(d, t) for d, _, _, t in brute_lines([(r.doc_id, r.text) for r in toxic.values()])}
    assert set(near) == {d for d, _, _, keep in brute_links([(r.doc_id, r.text) for r in lines.values()], 80) if keep}
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    assert set(clean) == {d for d, r in near.items() if not brute_contamination(r.text, items)[1]}
    assert all(r.round_trip and r.n_chars == len(r.text) for r in last.values()) and set(last) == set(clean)
