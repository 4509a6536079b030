"""Many patterns in many texts against containment tests."""

import random

from convoeval.operators import patterns as P
from convoeval.operators import validation as V


def test_mentions_of_any_block_and_part(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abä ") for _ in range(n))
    patterns = [(rng.choice([0, 0, 0, 1, 2]), word(rng.randint(0, 5))) for _ in range(150)] + [(0, None), (9, "a"), (None, "a")]
    texts = [(rng.choice([0, 0, 0, 1, 3]), word(rng.randint(0, 40))) for _ in range(60)] + [(2, None), (0, ""), (None, "a")]
    a = spark.createDataFrame(patterns, "task_id int, pattern string").repartition(3)
    b = spark.createDataFrame(texts, "task_id int, text string").repartition(3)
    want = sorted({(t, p) for t, p in patterns if p is not None and t is not None and any(u == t and x is not None and p in x for u, x in texts)})
    for limits in ((20_000, 16_000_000), (7, 50)):
        assert sorted(tuple(r) for r in P.mentioned(a, b, *limits).collect()) == want
    assert P.mentioned(a.where("false"), b).count() == 0 and P.mentioned(a, b.where("false")).count() == 0


def test_unmentioned_transactions(spark):
    tx = spark.createDataFrame([(1, 1, "Tea", 12.5), (1, 2, "Bus", 7.0), (1, 3, "Rent", 800.25), (2, 1, "Tea", 3.0), (1, 4, "Gym", 99.99), (1, 5, "Zoo", 41.0)], "task_id int, ord int, scene string, amount double")
    talk = spark.createDataFrame([(1, "a TEA for me"), (1, "paid 7.00 today and 1800"), (1, "it was 99,99"), (3, "tea 3.0")], "task_id int, text string")
    assert sorted((r["task_id"], r["ord"]) for r in V.unmentioned(tx, talk).collect()) == [(1, 5), (2, 1)]


def test_mentioned_facts_of_one_very_common_key(spark):
    facts = spark.createDataFrame([(0, f"Name{i}") for i in range(300)] + [(1, None)], "task_id int, scene string")
    talk = spark.createDataFrame([(0, " ".join(f"nAME{i}," for i in range(j, 300, 40))) for j in range(20)], "task_id int, text string")
    got = {r["scene"] for r in P.mentioned_facts(facts, talk).collect()}
    text = " ".join(r["text"].lower() for r in talk.collect())
    assert got == {f"Name{i}" for i in range(300) if f"name{i}" in text}
