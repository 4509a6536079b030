"""Ranking against brute force, and both BM25 ways against each other."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from convoeval.operators import retrieval as R
from convoeval.operators import substrings as X
from convoeval.operators.blockmax import stretch_bounds


def okapi(docs, query, k1=1.5, b=0.75, eps=0.25):
    """Scores of the public Okapi formula, documents as token lists."""
    n = len(docs)
    avg = sum(map(len, docs)) / n
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: eps * mean if v < 0 else v for t, v in idf.items()}
    return [
        sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / avg)) for t in query)
        for d in docs
    ]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = [[rng.choice(words[: rng.randint(3, 40)]) for _ in range(rng.randint(1, 20))] for _ in range(60)]
    queries = [[rng.choice(words + ["none"]) for _ in range(rng.randint(1, 6))] for _ in range(12)] + [["zzz"]]
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)] + [(1000, " .. ")], "id long, text string")
    q = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(queries)], "qid long, text string")
    return docs, queries, d, q


@pytest.mark.parametrize("limits", [{}, {"stretch_docs": 2, "slice_docs": 10, "buckets": 3}])
def test_bm25(corpus, limits):
    docs, queries, d, q = corpus
    index = R.build_bm25(d, **limits)
    assert index.n_docs == 60 and index.n_blank == 1
    got = {}
    for r in R.bm25_topk(q, index, 8).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"], r["score"]))
    for qid, query in enumerate(queries):
        scores = [round(s, 9) + 0.0 for s in okapi(docs, query)]
        want = sorted(range(60), key=lambda i: (-scores[i], i))[:8]
        mine = sorted(got[qid])
        assert [i for _, i, _ in mine] == want
        assert all(abs(s - scores[i]) < 1e-8 for _, i, s in mine)


@pytest.mark.parametrize("limits", [{}, {"max_queries": 1}])
def test_scan_and_stored_index_rank_alike(corpus, limits):
    _, _, d, q = corpus
    stored = R.bm25_topk(q, R.build_bm25(d, stretch_docs=4), 9).collect()
    scanned = R.bm25_scan_topk(q, R.scan_bm25(d), 9, **limits).collect()
    assert sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in stored) == sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in scanned)


def test_scoped_bm25_sees_only_the_prefix(spark, corpus):
    docs, queries, _, _ = corpus
    chunks = spark.createDataFrame(
        [(t, i, " ".join(docs[(i + t) % 60]) if i % 7 else "--") for t in (0, 1) for i in range(20)],
        "task_id int, position long, text string",
    )
    asked = spark.createDataFrame(
        [(f"{t}_{p}_{k}", t, p, " ".join(queries[k])) for t in (0, 1) for p in (1, 9, 50) for k in range(4)],
        "qid string, task_id int, position long, text string",
    )
    got = {}
    for r in R.bm25_scoped_topk(asked, chunks, 4, bucket_rows=3).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["position"], r["score"]))
    for t in (0, 1):
        for p in (1, 9, 50):
            seen = [i for i in range(min(p, 19) + 1) if i % 7]
            texts = [docs[(i + t) % 60] for i in seen]
            for k in range(4):
                scores = okapi(texts, queries[k])
                want = sorted(range(len(seen)), key=lambda j: (-round(scores[j], 9), seen[j]))[:4]
                assert [x for _, x, _ in sorted(got.get(f"{t}_{p}_{k}", []))] == [seen[j] for j in want]


@pytest.mark.parametrize("max_weights", [2_000_000, 5])
def test_whole_tasks_rank_as_full_prefixes(spark, corpus, max_weights):
    docs, queries, _, _ = corpus
    chunks = spark.createDataFrame(
        [(t, 3 * i, " ".join(docs[(i + t) % 60]) if i % 7 else "--") for t in (0, 1, 2) for i in range(20)] + [(3, 0, "--")],
        "task_id int, position long, text string",
    )
    asked = spark.createDataFrame(
        [(f"{t}_{k}", t, 60, " ".join(queries[k])) for t in (0, 1, 3, 4) for k in range(4)] + [("none", 0, 60, "?"), ("strange", 0, 60, "qqqq")],
        "qid string, task_id int, position long, text string",
    )
    row = lambda r: (r["qid"], r["position"], r["score"], r["rank"])
    want = sorted(map(row, R.bm25_scoped_topk(asked, chunks, 5).collect()))
    assert sorted(map(row, R.bm25_task_topk(asked.drop("position"), chunks, 5, max_weights=max_weights).collect())) == want
    assert len(want) == 9 * 5


@pytest.mark.parametrize("per_block", [1000, 2])
def test_semantic_topk(spark, per_block):
    rng = random.Random(4)
    vec = lambda: [rng.gauss(0, 1) for _ in range(6)]
    vs, qs = [vec() for _ in range(50)] + [[0.0] * 6], [vec() for _ in range(7)]
    d = spark.createDataFrame(list(enumerate(vs)), "id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame(list(enumerate(qs)), "qid long, embedding array<float>")
    got = {}
    for r in R.semantic_topk(q, d, 5, per_block).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    for i, x in enumerate(qs):
        want = sorted(range(51), key=lambda j: (-cos(x, vs[j]), j))[:5]
        assert [j for _, j in sorted(got[i])] == want


def test_rrf_credits(spark):
    a = spark.createDataFrame([(0, 1, 1), (0, 2, 3)], "qid int, id int, rank int")
    b = spark.createDataFrame([(0, 1, 2)], "qid int, id int, rank int")
    got = {r["id"]: r["score"] for r in R.rrf([a, b], 5).collect()}
    assert abs(got[1] - (1 / 61 + 1 / 62)) < 1e-8 and abs(got[2] - 1 / 63) < 1e-8


def test_query_blocks(spark):
    q = spark.createDataFrame([(i, f"alpha {i}") for i in range(5)], "qid int, text string")
    packed, n = R.query_blocks(q, ["qid", "text"], 2)
    assert n == 3 and packed.select(F.sum(F.size("queries"))).first()[0] == 5


def test_substring_scores_against_all_pairs(spark):
    """Words inside words, short words, repeated words, words in nothing; zero scores in the order of the items."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab cä") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", "Needle in Haystack needleneedle", None]
    asked = ["needle", "needle needle hay", "a", "ab ca", "zzz zz", "ABCÄ abc", "", "ä b", "stack zzz needle"]
    items = spark.createDataFrame(list(enumerate(texts)), "id int, content string").repartition(3)
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, text string")
    index = X.build_trigrams(items, ["id"])
    share, times = {}, {}
    for name, found in (("share", X.keyword_score_topk(index, q, ["id"])), ("times", X.term_frequency_topk(index, q, ["id"]))):
        for r in found.collect():
            (share if name == "share" else times).setdefault(r["qid"], []).append((r["rank"], r["id"], round(r["score"], 6), r["content"]))
    for i, text in enumerate(asked):
        w = text.lower().split()
        low = [(j, t.lower()) for j, t in enumerate(texts) if t is not None]
        a = sorted(((-round(sum(x in t for x in w) / len(w), 6), j) for j, t in low if any(x in t for x in w)) if w else [])[:5]
        b = sorted((-sum(t.count(x) for x in w), j) for j, t in low)[:5] if w else []
        assert [(j, s) for _, j, s, _ in sorted(share.get(i, []))] == [(j, -s) for s, j in a], text
        assert [(j, s, c) for _, j, s, c in sorted(times.get(i, []))] == [(j, -s, texts[j]) for s, j in b], text


def test_few_words_are_counted_without_an_index(spark, monkeypatch):
    lines = ["aaaa the an", "The theme", "", "xan xan", None, "none", "Ärger an der ÄRGER"]
    items = spark.createDataFrame([(i, "s" * (i % 2), t) for i, t in enumerate(lines)], "id long, part string, content string")
    q = spark.createDataFrame([(1, "aa an"), (2, "the the qq"), (3, "ärger"), (4, "zz"), (5, "  ")], "qid int, text string")
    index = X.build_trigrams(items, ["id", "part"])
    row = lambda r: (r["qid"], r["id"], r["part"], r["content"], r["score"], r["rank"])
    want = [sorted(map(row, f(index, q, ["id", "part"]).collect())) for f in (X.keyword_score_topk, X.term_frequency_topk)]

    def built(*_, **__):
        raise AssertionError("an index was built")

    monkeypatch.setattr(X, "build_trigrams", built)
    assert [sorted(map(row, f(items, q, ["id", "part"]).collect())) for f in (X.keyword_score_topk, X.term_frequency_topk)] == want
    assert (1, 0, "", "aaaa the an", 3, 1) in want[1]
    monkeypatch.setattr(X, "SCANNED_WORDS", 3)
    with pytest.raises(AssertionError, match="an index was built"):
        X.keyword_score_topk(items, q, ["id", "part"])


def test_trigrams_leave_few_rows_to_compare(spark):
    rng = random.Random(6)
    items = spark.createDataFrame([(i, " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(8))) for i in range(1_000)], "id int, content string")
    index = X.build_trigrams(items, ["id"])
    asked = items.limit(40).select(F.substring("content", 1, 6).alias("word")).distinct()
    met = X.candidates(asked, index)
    assert met.count() < 0.01 * 1_000 * asked.count() and met.select("word").distinct().count() == asked.count()


def test_files_by_ending_and_folder(spark):
    paths = ["a/b.txt", "a/.git/c.txt", "node_modules/x.md", "d.bin", "e.md", "embeddings.md", None, "venv/y/z.py", "q/embeddings"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r["path"] for r in R.searched_files(df).collect()] == ["a/b.txt", "e.md", "embeddings.md"]


@pytest.mark.parametrize("limits", [{}, {"stretch_docs": 1}])
def test_bm25_with_a_negative_mean_idf_and_string_ids(spark, limits):
    """Few documents that share most words: every way must rank documents without a hit above the others."""
    docs = [["a", "b", "c"], ["a", "b", "c"], ["a", "b", "d"], ["x"], ["a", "c", "b", "b"], ["a"], ["y"]]
    names = [f"doc-{i:02d}" for i in range(len(docs))]
    d = spark.createDataFrame([(n, " ".join(x)) for n, x in zip(names, docs)], "id string, text string").repartition(3)
    queries = [["a"], ["a", "b"], ["c", "q"], ["b", "x"]]
    q = spark.createDataFrame([(f"q{i}", " ".join(x)) for i, x in enumerate(queries)], "qid string, text string")
    index = R.build_bm25(d, **limits)
    got = {}
    for r in R.bm25_topk(q, index, 3).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["id"]))
    for i, query in enumerate(queries):
        scores = [round(s, 9) + 0.0 for s in okapi(docs, query)]
        assert [n for _, n in sorted(got[f"q{i}"])] == [names[k] for k in sorted(range(len(docs)), key=lambda k: (-scores[k], k))[:3]]


def test_a_ranking_reads_only_the_files_of_its_terms(spark, corpus, tmp_path):
    _, _, d, _ = corpus
    index = R.build_bm25(d, str(tmp_path / "index"), buckets=16)
    q = spark.createDataFrame([(0, "w1 w2 w1")], "qid long, text string")
    met = {r[0] for r in spark.createDataFrame([("w1",), ("w2",)], "t string").select(R.bucket_of(F.col("t"), 16)).collect()}
    blocks = index.blocks_of(sorted(met))
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN", plan)
    read = {r[0].split("bucket=")[1].split("/")[0] for r in blocks.select(F.input_file_name()).distinct().collect()}
    assert {int(x) for x in read} == met and index.postings.select("bucket").distinct().count() > 10
    assert R.bm25_topk(q, R.open_bm25(spark, str(tmp_path / "index")), 3).count() == 3


def skipping_corpus(spark, n):
    """Documents of which few fit a query well, with one word in all of them."""
    rng = random.Random(8)
    docs = [["the", *(rng.choice([f"w{i}" for i in range(300)]) for _ in range(rng.randint(4, 30)))] for _ in range(n)]
    for i in range(0, n, 97):
        docs[i] += ["rare", "pair"]
    return docs, spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "id long, text string")


def test_blocks_that_cannot_enter_are_skipped(spark):
    docs, d = skipping_corpus(spark, 2_000)
    index = R.build_bm25(d, stretch_docs=16)
    q = spark.createDataFrame([(0, "the rare pair")], "qid long, text string")
    idf = R.floored_idf(F.lit(index.n_docs), F.col("df"), F.lit(index.mean_idf), index.epsilon)
    asked = R.query_terms(q, ["qid"]).join(index.terms, "term").select(
        "qid", "term", (F.col("qtf") * idf).alias("weight"), F.lit(index.avg_len).alias("avg_len"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("upto"))
    blocks = index.postings.where("bucket >= 0").drop("bucket")
    scored, rest = R.reachable(asked, blocks, [], 5, 8, index.k1, index.b)
    assert rest.count() < 40 and scored.count() < 600  # of about 128 stretches and 2 000 documents
    scores = [round(s, 9) for s in okapi(docs, ["the", "rare", "pair"])]
    want = sorted(range(2_000), key=lambda i: (-scores[i], i))[:5]
    assert [r["id"] for r in R.bm25_topk(q, index, 5).orderBy("rank").collect()] == want


def scoped_rows(spark, n, size):
    """Rows that the ranking of ten questions at the end of one task meets: heads, histogram, postings."""
    docs, _ = skipping_corpus(spark, n)
    chunks = spark.createDataFrame([(0, i, " ".join(x)) for i, x in enumerate(docs)], "task_id int, position long, text string")
    asked = spark.createDataFrame([(str(i), 0, n - 1 - i, "the rare pair") for i in range(10)], "qid string, task_id int, position long, text string")
    index = R.build_scoped(chunks, size)
    _, weights = R.scoped_weights(asked, index, 1.5, 0.75, 0.25)
    scored, _ = R.reachable(weights, index.blocks, ["task_id"], 3, 4, 1.5, 0.75)
    at = weights.select(F.col("upto").alias("at"), F.floor(F.col("upto") / size).alias("block")).distinct()
    heads = stretch_bounds(weights, index.blocks.drop("docs"), ["task_id"], 1.5, 0.75).count()
    partial = at.join(index.updates, "block").count()
    widest = index.blocks.where("term = 'the'").agg(F.max("n")).first()[0]
    return heads + partial + scored.count(), widest


def test_scoped_work_grows_slower_than_the_chunks(spark):
    """Twice the chunks, the same questions; a stop word lies in many blocks."""
    (few, wide), (more, wider) = scoped_rows(spark, 800, 16), scoped_rows(spark, 1_600, 16)
    assert wide == wider == 16 and more < 1.6 * few and more < 10 * 1_600 / 2


def test_scoring_takes_a_bounded_number_of_tokens_at_a_time():
    import pyarrow as pa

    sizes = [3, 5, 1, 40, 2, 2, 9, 1, 1, 1, 1]
    whole = pa.RecordBatch.from_arrays([pa.array(range(11)), pa.array([["w"] * n for n in sizes])], ["id", "t"])
    pieces = [p.column("id").to_pylist() for p in R._bounded(whole, 3, 10)]
    assert sum(pieces, []) == list(range(11)) and all(0 < len(p) <= 3 for p in pieces)
    assert all(len(p) == 1 or sum(sizes[i] for i in p) <= 10 for p in pieces) and [3] in pieces
    assert list(R._bounded(whole.slice(0, 0), 3, 10)) == []
