"""Replay against a sequential loop, parsers, and stream equals batch."""

import random

from pyspark.sql import functions as F

from convoeval.operators import memory as M
from convoeval.sources.writers import write_category_store
from convoeval.streaming import index as SI
from convoeval.streaming import ledger as SL
from convoeval.streaming import memory as SM

SCHEMA = "key string, seq long, operation string, target_id string, content string, mentioned_at string"


def replay(ops):
    """Sequential statement of the edit rules; an ADD brings its own id."""
    items = {}
    for key, _, verb, target, content, day in sorted(ops, key=lambda o: o[1]):
        mine = items.setdefault(key, [])
        if verb == "ADD" and content:
            mine.append([target, content, day])
        elif verb == "UPDATE" and target and content:
            for item in mine:
                if item[0] == target:
                    item[1] = content
                    break
        elif verb == "DELETE" and target:
            items[key] = [i for i in mine if i[0] != target]
    return sorted((k, *i) for k, v in items.items() for i in v)


def edits(n=400, seed=1):
    rng = random.Random(seed)
    out = []
    for seq in range(n):
        verb = rng.choice(["ADD", "ADD", "UPDATE", "UPDATE", "DELETE", "TOUCH"])
        target = rng.choice(["a", "b", "c", "", None]) if verb != "ADD" else rng.choice("abc")
        out.append((rng.choice("xy"), seq, verb, target, rng.choice([f"t{seq}", ""]), f"d{seq}"))
    return out


def living(df):
    return sorted((r["key"], r["memory_id"], r["content"], r["mentioned_at"]) for r in df.collect())


def test_replay(spark):
    ops = edits()
    assert living(M.apply_operations(spark.createDataFrame(ops, SCHEMA))) == replay(ops)
    golden = [("k", 0, "ADD", "p", "p", "d"), ("k", 1, "UPDATE", "p", "q", "d"), ("k", 2, "TOUCH", "p", None, "d"),
              ("k", 3, "DELETE", "z", None, "d")]
    df = spark.createDataFrame(golden, SCHEMA)
    assert living(M.apply_operations(df)) == [("k", "p", "q", "d")]
    assert sum(r["n"] for r in M.executed_counts(df).collect()) == 4


def test_replay_goes_on_from_a_state(spark):
    ops = edits(200, 2)
    first = M.apply_operations(spark.createDataFrame(ops[:90], SCHEMA))
    both = M.apply_operations(spark.createDataFrame(ops[90:], SCHEMA), first)
    assert living(both) == replay(ops)


def parts(spark, folder, rows, schema, n=4):
    df = spark.createDataFrame(rows, schema)
    size = -(-len(rows) // n)
    for i in range(n):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.parquet(f"{folder}/p{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"), df


def test_stream_memory_equals_batch(spark, tmp_path):
    ops = edits(160, 3)
    stream, df = parts(spark, tmp_path / "in", ops, SCHEMA)
    SM.start_memory(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert SM.late_edits(spark, str(tmp_path / "out")).count() == 0
    assert living(SM.read_memory(spark, str(tmp_path / "out"))) == living(M.apply_operations(df)) == replay(ops)


def test_stream_memory_in_any_order_of_arrival(spark, tmp_path):
    ops = edits(160, 5)
    random.Random(1).shuffle(ops)
    stream, df = parts(spark, tmp_path / "in", ops, SCHEMA, 5)
    SM.start_memory(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert SM.late_edits(spark, str(tmp_path / "out")).count() > 0
    assert living(SM.read_memory(spark, str(tmp_path / "out"))) == living(M.apply_operations(df)) == replay(sorted(ops, key=lambda o: o[1]))


def test_stream_ledger_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"2024-01-0{rng.randint(1, 5)}", rng.choice("ab"), rng.randint(1, 900) / 100) for _ in range(200)]
    stream, df = parts(spark, tmp_path / "in", rows, "date string, scene string, amount double")
    day = F.col("date").cast("date")
    SL.start_ledger(stream.withColumn("date", day), [], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = SL.read_ledger(spark, str(tmp_path / "out"), []).collect()
    want = M.running_ledger(df.withColumn("date", day), []).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_stream_index_counts_every_text_once(spark, tmp_path):
    rows = [(i, f"w{i % 3} w{i % 2} w{i % 2}") for i in range(20)]
    stream, _ = parts(spark, tmp_path / "in", rows, "id long, text string")
    SI.start_index(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    index = SI.open_index(spark, str(tmp_path / "out"))
    assert index.n_docs == 20 and index.avg_len == 3.0
    assert {r["term"]: r["df"] for r in index.terms.collect()}["w2"] == sum(1 for i in range(20) if i % 3 == 2)


def test_items_round_trip(spark):
    text = " [m1][mentioned at 2024] likes tea [x, y]\nnoise\n[m2][mentioned at 2025] reads (a) []\n[m3][mentioned at d]  "
    items = M.parse_items(spark.createDataFrame([(1, text)], "k int, t string"), ["k"], "t")
    got = [(r["memory_id"], r["content"], r["links"]) for r in items.orderBy("line_no").collect()]
    assert got == [("m1", "likes tea", "x, y"), ("m2", "reads (a)", "")]
    assert M.format_items(items, ["k"], "line_no").first()["text"] == (
        "[m1][mentioned at 2024] likes tea [x, y]\n[m2][mentioned at 2025] reads (a) []"
    )


def test_operations_of_unknown_verbs(spark):
    text = "**OPERATION:** UPDATE\n- Target Memory ID: a\n**OPERATION:** MERGE\n- Memory Item Content: late\n**OPERATION:** TOUCH"
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(M.parse_operations(F.col("t"))).alias("o")).select("o.*")
    assert [tuple(r) for r in df.collect()] == [("UPDATE", "a", "late"), ("TOUCH", None, None)]


def test_category_store_on_disk(spark, tmp_path):
    schema = "character string, category string, seq long, content string"
    old = spark.createDataFrame([("c", "activity", 1, "a"), ("c", "profile", 2, "p"), ("d", "event", 3, "e")], schema)
    new = spark.createDataFrame([("c", "activity", 4, "b"), ("c", "profile", 5, "q"), ("c", "junk", 6, "z")], schema)
    path = str(tmp_path / "store")
    write_category_store(old, path)
    write_category_store(M.category_store(old, new, M.CATEGORIES, ["activity"]), path)
    assert sorted(r["content"] for r in spark.read.parquet(path).collect()) == ["a", "b", "e", "q"]
