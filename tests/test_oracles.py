"""Registered queries against their SQL twins on the smallest tables, and plan checks."""

import os
import sys
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "flagship_conversation_report", "sco2_token_prf", "agg3_strict_mean_by_category", "agg8_leaderboard", "led2_scene_set_in_range",
    "led4_top_scenes", "led9_rollups", "led13_take_until", "val6_unmentioned", "ret3_bm25_topk", "ret5_semantic_topk", "ret6_rrf",
    "ret14_hit_scope", "nrm5_build_samples_questions", "nrm12_dedupe_documents", "nrm15_merge_samples", "jn5_visible_tail",
    "txt2_parse_turns", "txt4_pack_lines", "txt10_boundary_strength", "mem7_apply_operations", "mem10_running_ledger",
    "ans10_batch_prompt", "smp1_small_set", "smp6_training_rows", "pro3_gap_stats", "inc1_completed",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))


@pytest.fixture(scope="module")
def con():
    import duckdb
    from compare import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows_as_sql(spark, con, name):
    from compare import rows_of

    from convoeval.plans import ORACLES, QUERIES

    df = QUERIES[name](spark, FOLDER)
    cols, got, _ = rows_of(df.columns, df.collect())
    cur = con.execute(ORACLES[name])
    ocols, want, _ = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert cols == ocols and got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    from convoeval.sources.readers import read_samples

    df = read_samples(spark, f"{FOLDER}/documents.parquet", "src3", column="source").select("doc_id")
    plan = plan_of(df)
    assert "EqualTo(source,src3)" in plan and "ReadSchema: struct<doc_id:bigint,source:string>" in plan


def test_number_of_partitions_does_not_matter(spark):
    from convoeval.plans import QUERIES

    def rows(name, n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, QUERIES[name](spark, FOLDER).collect()))

    try:
        for name in ("smp1_small_set", "nrm13_mix_distractors", "txt11_semantic_chunks", "ret3_bm25_topk"):
            assert rows(name, "1") == rows(name, "7")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_cross_join_in_the_plans(spark):
    from convoeval.plans import QUERIES

    for name in SAMPLE:
        plan = plan_of(QUERIES[name](spark, FOLDER))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_profile_report_rounds_and_prints_as_sql(spark, tmp_path):
    """Means half way between two rounded values, below a thousandth, above ten million and just below zero."""
    import datetime

    import duckdb
    from compare import rows_of

    from convoeval.plans import ORACLES, QUERIES

    con = duckdb.connect()
    ties = [69, 273, 561]  # seconds in 40 gaps: their double and its decimal text round to different sides
    corpora = [[0] * 40 + [s] for s in ties] + [[0] * 40 + [1], [0, 30 * 365 * 86400], [0] * 400 + [7, -1]]
    start = datetime.datetime(1990, 1, 1)
    rows = [(u, start + datetime.timedelta(seconds=at)) for u, times in enumerate(corpora) for at in times]
    con.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, 'view', 1.5, 'a')", [(i, ts, u) for i, (u, ts) in enumerate(rows)])
    con.execute(f"COPY e TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute("CREATE VIEW events AS SELECT * FROM e")
    for name in ("pro11_profile_report", "pro3_gap_stats"):
        df = QUERIES[name](spark, str(tmp_path))
        cols, got, _ = rows_of(df.columns, df.collect())
        cur = con.execute(ORACLES[name])
        ocols, want, _ = rows_of([c[0] for c in cur.description], cur.fetchall())
        assert cols == ocols and got == want
