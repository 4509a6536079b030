"""Tables that grow by batches: bounded segments, batches that run again, rankings equal to the stored index."""

import math
import random

import pytest
from pyspark.sql import functions as F
from test_retrieval import okapi

from convoeval.operators import memory as M
from convoeval.operators import retrieval as R
from convoeval.streaming import index as SI
from convoeval.streaming import ledger as SL
from convoeval.streaming import memory as SM
from convoeval.streaming import segments as S


def plain(rows, place):
    rows.drop("segment").coalesce(1).write.mode("overwrite").parquet(place)


def test_a_hundred_batches_leave_few_segments(spark, tmp_path):
    path = str(tmp_path)
    for i in range(100):
        S.add_segment(spark.createDataFrame([(i,)], "x int"), i, path, plain, plain, fan=4)
    live = S.live_segments(spark, path)
    assert len(live) <= 3 * math.ceil(math.log(100, 4)) and len({s[0] for s in live}) == len(live)
    assert sorted(r["x"] for r in S.read_segments(spark, path).collect()) == list(range(100))
    # the last batch runs again, as after a lost driver: nothing comes twice
    S.add_segment(spark.createDataFrame([(99,)], "x int"), 99, path, plain, plain, fan=4)
    assert sorted(r["x"] for r in S.read_segments(spark, path).collect()) == list(range(100))
    assert len(S.read_segments(spark, path).inputFiles()) <= 12
    assert S.drop_dead_segments(spark, path) > 80
    assert sorted(r["x"] for r in S.read_segments(spark, path).collect()) == list(range(100))


def streamed(spark, folder, df, batches):
    df.withColumn("_f", F.pmod(F.xxhash64(df.columns[0]), F.lit(batches))).repartitionByRange(batches, "_f").drop("_f").write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_ranking_on_a_streamed_index(spark, tmp_path):
    rng = random.Random(4)
    docs = [[rng.choice([f"w{i}" for i in range(30)]) for _ in range(rng.randint(0, 25))] for _ in range(120)]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "id long, text string")
    q = spark.createDataFrame([(0, "w1 w2 w2"), (1, "w3 none"), (2, "zzz")], "qid long, text string")
    SI.start_index(streamed(spark, f"{tmp_path}/in", d, 7), f"{tmp_path}/out", f"{tmp_path}/state", buckets=4, stretch_docs=8, fan=3).awaitTermination()
    index = SI.open_index(spark, f"{tmp_path}/out", buckets=4)
    assert any(level > 0 for _, level, _ in S.live_segments(spark, f"{tmp_path}/out"))
    kept = [i for i, x in enumerate(docs) if x]
    assert index.n_docs == len(kept) and index.n_blank == 120 - len(kept)
    got = {}
    for r in R.bm25_topk(q, index, 6).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for qid, query in enumerate([["w1", "w2", "w2"], ["w3", "none"], ["zzz"]]):
        scores = okapi([docs[i] for i in kept], query)
        want = sorted(range(len(kept)), key=lambda j: (-round(scores[j], 9), kept[j]))[:6]
        assert [i for _, i in sorted(got[qid])] == [kept[j] for j in want]


def test_streamed_vectors_are_searched_exactly(spark, tmp_path):
    rng = random.Random(9)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in centres[i % 6]]) for i in range(400)] + [(400, None), (401, [0.0] * 8), (402, [])]
    d = spark.createDataFrame(rows, "id long, embedding array<float>")
    SI.start_vectors(streamed(spark, f"{tmp_path}/in", d, 6), f"{tmp_path}/out", f"{tmp_path}/state", cells=6, block_rows=8, fan=3).awaitTermination()
    q = spark.createDataFrame([(i, rows[i * 7][1]) for i in range(5)], "qid long, embedding array<float>")
    hits, looked = SI.search_vectors(spark, q, f"{tmp_path}/out", 5, 2)
    stored = {r["id"]: r["embedding"] for r in d.where(F.size("embedding") > 0).collect()}
    asked = {r["qid"]: r["embedding"] for r in q.collect()}

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else 0.0

    got = {}
    for r in hits.collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for qid, v in asked.items():
        assert [i for _, i in sorted(got[qid])] == sorted(stored, key=lambda i: (-cos(v, stored[i]), i))[:5]
    blocks = S.read_segments(spark, f"{tmp_path}/out").count()
    assert looked.count() < 0.6 * blocks * len(asked)


def test_scoped_vectors_are_searched_exactly(spark):
    from convoeval.operators.vectorblocks import scoped_search

    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(10)]
    chunks = [(t, p, [c + rng.gauss(0, 0.1) for c in centres[p // 20 % 10]] if p % 11 else None) for t in (0, 1) for p in range(300)]
    asked = [(f"{t}_{p}", t, p, [c + rng.gauss(0, 0.1) for c in centres[p % 10]]) for t in (0, 1) for p in (0, 5, 150, 299)]
    d = spark.createDataFrame(chunks, "task_id int, position long, embedding array<double>")
    q = spark.createDataFrame(asked, "qid string, task_id int, position long, embedding array<double>")
    hits, looked = scoped_search(q, d, 4, 16, 2)

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b)), 9)

    got = {}
    for r in hits.collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["position"]))
    for qid, t, p, v in asked:
        seen = {i: x for u, i, x in chunks if u == t and i <= p and x}
        assert [i for _, i in sorted(got.get(qid, []))] == sorted(seen, key=lambda i: (-cos(v, seen[i]), i))[:4]
    assert looked.count() < 0.6 * sum(p // 16 + 1 for _, _, p, _ in asked)


SCHEMA = "key string, seq long, operation string, target_id string, content string, mentioned_at string"


@pytest.mark.parametrize("fan", [2, 100])
def test_memory_and_ledger_do_not_depend_on_merges(spark, tmp_path, fan):
    rng = random.Random(12)
    ops = [("k", i, rng.choice(["ADD", "ADD", "UPDATE", "UPDATE", "DELETE", "TOUCH"]), f"m{rng.randrange(6)}", f"text {i}", "d") for i in range(150)]
    rng.shuffle(ops)
    df = spark.createDataFrame(ops, SCHEMA)
    stream = streamed(spark, f"{tmp_path}/in", df.select("seq", *[c for c in df.columns if c != "seq"]), 6)
    SM.start_memory(stream, f"{tmp_path}/out", f"{tmp_path}/state", fan).awaitTermination()
    living = lambda x: sorted((r["memory_id"], r["seq"], r["content"]) for r in x.collect())
    assert living(SM.read_memory(spark, f"{tmp_path}/out")) == living(M.apply_operations(df))
    tx = spark.createDataFrame([(i, f"2024-01-0{rng.randint(1, 5)}", rng.choice("ab"), rng.randint(1, 900) / 4) for i in range(200)], "i int, date string, scene string, amount double").withColumn("date", F.col("date").cast("date"))
    SL.start_ledger(streamed(spark, f"{tmp_path}/tx", tx, 6), [], f"{tmp_path}/ledger", f"{tmp_path}/ls", fan).awaitTermination()
    got = SL.read_ledger(spark, f"{tmp_path}/ledger", []).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, M.running_ledger(tx, []).collect()))
    assert SL.current_totals(spark, f"{tmp_path}/ledger", []).count() == tx.select("date", "scene").distinct().count()


def test_state_of_the_memory_stream_is_kept_by_pages(spark, tmp_path):
    edits = [(f"k{i % 7}", i, "ADD", None if i == 5 else f"m{i % 2600}", f"text {i}", "d") for i in range(3000)]
    df = spark.createDataFrame(edits, SCHEMA)
    stream = streamed(spark, f"{tmp_path}/in", df.select("seq", *[c for c in df.columns if c != "seq"]), 2)
    q = SM.start_memory(stream, f"{tmp_path}/out", f"{tmp_path}/state")
    q.awaitTermination()
    rows = max(p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators)
    assert 0 < rows <= SM.PAGES < len({(e[0], e[3]) for e in edits})
    facts = S.read_segments(spark, f"{tmp_path}/out").collect()
    assert sorted((r["key"], r["memory_id"] or "", r["seq"], r["content"]) for r in facts) == sorted((e[0], e[3] or "", e[1], e[4]) for e in edits)
    assert SM.read_memory(spark, f"{tmp_path}/out").count() == 3000


def test_postings_of_more_documents_are_sorted_by_more_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PART_DOCS", 16, raising=False)
    docs = spark.createDataFrame([(i, f"the w{i % 9}") for i in range(300)], "id long, text string")
    for name, n in (("few", 15), ("many", 300)):
        index = R.build_bm25(docs.where(F.col("id") < n), f"{tmp_path}/{name}", stretch_docs=4, buckets=2)
        assert index.n_docs == n and {r["term"]: r["df"] for r in index.terms.collect()}["the"] == n
    files = {name: len(list((tmp_path / name / "postings" / "bucket=-1").glob("*.parquet"))) for name in ("few", "many")}
    assert files["few"] == 1 and files["many"] >= 8
    q = spark.createDataFrame([(0, "w3")], "qid long, text string")
    assert [r["id"] for r in R.bm25_topk(q, index, 3).orderBy("rank").collect()] == [3, 12, 21]
