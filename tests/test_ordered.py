"""Bucketed running sums, previous rows and medians give what one window gives."""

import datetime
import random
import statistics
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import pandas as pd
import pytest
from pyspark.sql import functions as F

from convoeval.operators import chunking as C
from convoeval.operators import ordered as O
from convoeval.operators.ledger import take_until

from test_text import tokens_of


def rows(spark, n=300, seed=1):
    rng = random.Random(seed)
    data = [(rng.choice(["a", "a", "a", "b", "c"]), i, rng.randint(-5, 9)) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, o long, v long")


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_prefix_and_previous(spark, width):
    data, df = rows(spark)
    got = {r["o"]: r["run"] for r in O.prefix_sums(df, ["k"], ["o"], O.id_bucket("o", width), run=F.col("v")).collect()}
    prev = {r["o"]: r["prev_v"] for r in O.with_previous(df, ["k"], "o", ["v"], O.id_bucket("o", width)).collect()}
    run, last = {}, {}
    for k, o, v in data:
        run[k] = run.get(k, 0) + v
        assert got[o] == run[k] and prev[o] == last.get(k)
        last[k] = v


def test_medians(spark):
    data, df = rows(spark, 501, 2)
    got = {r["k"]: r["median"] for r in O.exact_medians(df, ["k"], "v").collect()}
    for k in "abc":
        assert got[k] == statistics.median(v for kk, _, v in data if kk == k)


def test_take_until(spark):
    df = spark.createDataFrame([(i, 36) for i in range(6)], "s long, q long")
    assert sorted(r["s"] for r in take_until(df, "s", "q", 50, 70, 2).collect()) == [0, 1]
    assert sorted(r["s"] for r in take_until(df, "s", "q", 500, 3, 2).collect()) == [0, 1, 2]


def fold(records, low, high):
    """Record-by-record statement of the chunk fold."""
    chunks, text, first = [], "", 0
    for i, (_, _, record, boundary) in enumerate(records):
        if not record:
            continue
        if text:
            size = tokens_of(text + "\n" + record)
            if size > high or (size >= low and boundary):
                chunks.append((first, i - 1, text))
                text, first = "", i
        text = text + "\n" + record if text else record
    if text:
        chunks.append((first, len(records) - 1, text))
    return chunks


@pytest.mark.parametrize("block", [1, 40])
def test_chunk_fold_in_blocks(spark, block):
    rng = random.Random(9)
    data = []
    for corpus, n in (("long", 400), ("short", 3), ("mid", 61)):
        for i in range(n):
            record = "" if rng.random() < 0.1 else "".join(rng.choice("ab 1,中 ") for _ in range(rng.randint(1, 30))).strip()
            data.append((corpus, i, record, rng.random() < 0.2))
    schema = "corpus string, ord long, record_text string, boundary boolean"
    df = spark.createDataFrame(data, schema).withColumns({"timestamp": F.lit("t"), "location": F.lit("p")})
    numbered = C.numbered_records(df, "corpus", "ord")
    ids = C.semantic_chunk_ids(numbered, "corpus", "ord", 12, 25, block)
    got = C.semantic_chunks(df, numbered, ids, "corpus", "ord").orderBy("corpus", "chunk_id").collect()
    for corpus in ("long", "short", "mid"):
        want = fold([d for d in data if d[0] == corpus], 12, 25)
        mine = [(r["start_id"], r["end_id"], r["text"]) for r in got if r["corpus"] == corpus]
        assert mine == want
        assert all(r["token_count"] == tokens_of(r["text"]) for r in got)


def test_boundary_weights(spark):
    base = "2024-01-01 00:00:00"
    times = [base, "2024-01-01 06:00:00", "2024-01-01 12:00:01", "2024-01-02 12:00:02", "2024-01-09 12:00:03", None, "bad"]
    data = [("c", i, t, "p", "x" * 10) for i, t in enumerate(times)]
    df = spark.createDataFrame(data, "corpus string, ord long, timestamp string, location string, action string")
    got = C.with_boundaries(df, "corpus", "ord", ["action"]).orderBy("ord").collect()
    assert [round(r["strength"] - 0.05, 2) for r in got[1:]] == [0.1, 0.2, 0.4, 0.6, 0.0, 0.0]

def test_mean_gap_does_not_depend_on_id_buckets(spark):
    """Gaps whose mean is half way between two rounded values, in a corpus that lies across an edge of id buckets."""
    from convoeval.operators import profiling as P

    def fold(gaps):
        return reduce(lambda a, g: a + g / 60, gaps, 0.0)  # sum() of floats is compensated

    for seed in range(2000):
        rng = random.Random(seed)
        g = [rng.randint(1, 70_000) for _ in range(64)]
        g[-1] += (24 - sum(g)) % 48
        whole, cut = fold(g) / 64, (fold(g[:30]) + fold(g[30:])) / 64
        if half_up(whole) != half_up(cut):
            break
    at, rows = 0, []
    for i, gap in enumerate([0, *g]):
        at += gap
        stamp = (datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=at)).strftime("%Y-%m-%d %H:%M:%S")
        rows += [("far", (1 << 20) - 31 + i, stamp), ("near", i, stamp)]
    df = spark.createDataFrame(rows, "corpus string, ord long, timestamp string")
    got = {r["corpus"]: r["mean"] for r in P.gap_stats(P.gaps(df, "corpus", "ord"), "corpus").collect()}
    assert got == {"far": half_up(whole), "near": half_up(whole)}
    # a corpus with more records than a bucket is still cut, and all its gaps count
    cut = P.gap_stats(P.gaps(df, "corpus", "ord", 10), "corpus").collect()
    assert [r["n_gaps"] for r in cut] == [64, 64] and all(abs(r["mean"] - whole) < 1e-3 for r in cut)


def half_up(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def test_corpora_across_buckets_stay_whole(spark):
    """Corpora whose ids cross the edge of a bucket lie in two partitions when they are numbered."""
    edge = 1 << 20
    df = spark.createDataFrame(
        [(c, o, f"word {o % 7} and more {c}", o % 5 == 0) for c in range(40) for o in range(edge - 30, edge + 30)],
        "corpus long, ord long, record_text string, boundary boolean",
    )
    # as at size: several partitions, and a join planned by shuffle turns out to be small
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")
    for name, value in zip(names, ("-1", "16KB", "false"), strict=True):
        spark.conf.set(name, value)
    try:
        got = C.semantic_chunk_ids(C.numbered_records(df, "corpus", "ord"), "corpus", "ord", 20, 40).collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert len(got) == 40 * 60
    for c in range(40):
        ids = [r["chunk_id"] for r in sorted(got, key=lambda r: r["ord"]) if r["corpus"] == c]
        assert ids == sorted(ids) and sorted(set(ids)) == list(range(ids[-1] + 1)) and len(set(ids)) > 5


def test_blocks_of_many_corpora_are_folded_at_once():
    """A frame holds as many whole corpora as a batch brings; batches cut corpora anywhere."""
    names = [c for c in range(50) for _ in range(1 + c % 7)]
    pdf = pd.DataFrame({"corpus": names, "_block": 0, "n": range(len(names))})
    for size in (1, 3, 40, 1000):
        frames = list(C.whole_groups((pdf.iloc[i : i + size] for i in range(0, len(pdf), size)), ["corpus", "_block"]))
        assert pd.concat(frames)["n"].tolist() == list(range(len(names)))
        held = [set(f["corpus"]) for f in frames]
        assert sum(map(len, held)) == 50 and len(frames) <= -(-len(pdf) // size) + 1


def test_chunk_sizes_are_told_once(spark):
    """The size of a chunk is worked out in one pass, however much is read off it."""
    told = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def size(n):
        told.add(1)
        return n

    data = [(c, i * 700 % 7919, ["x", None, f"p{i % 3}"][i % 3]) for c in ("a", "b") for i in range(31)]
    df = spark.createDataFrame(data, "corpus string, n int, p string")
    got = C.chunk_stats(df.select("corpus", size("n").alias("token_count"), F.array("p").alias("locations")), "corpus").orderBy("corpus").collect()
    assert told.value == len(data)
    sizes = [n for c, n, _ in data if c == "a"]
    bins = [sum(lo <= n < hi for n in sizes) for lo, hi in ((0, 3000), (3000, 4000), (4000, 5000), (5000, 6000), (6000, 10**9))]
    for r in got:
        assert (r["n_chunks"], r["min_tokens"], r["max_tokens"], r["median_tokens"], r["n_places"]) == (31, min(sizes), max(sizes), statistics.median(sizes), 2)
        assert r["mean_tokens"] == round(sum(sizes) / 31, 6) and [r[f"n_{i}"] for i in range(5)] == bins
