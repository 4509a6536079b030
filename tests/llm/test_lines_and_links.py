"""Line dedup, MinHash and vector near-dedup against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoeval.llm import line_dedup, near_dup, stages, vector_dup
from convoeval.llm.common import components

BLANK = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute_lines(rows, min_docs=5):
    holders = {}
    for r in set(rows):
        for k in {lower(x.strip(BLANK)) for x in (r[1] or "").split("\n")}:
            if len(k) >= 40:
                holders.setdefault(k, set()).add(r)
    keeper = {k: max((r[0] for r in v if r[0] is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if (k := lower(x.strip(BLANK))) not in keeper or keeper[k] == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def got_lines(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


def test_line_dedup_odd_rows(odd, nothing):
    done = line_dedup.dedup_lines(odd)
    assert done.columns == [*odd.columns, "n_lines", "n_dropped", "kept_text"]
    assert got_lines(done) == brute_lines([(r.doc_id, r.text) for r in odd.collect()])
    assert line_dedup.dedup_lines(nothing).count() == 0


@pytest.mark.parametrize("bits,most", [(23, 1 << 26), (6, 16)])
def test_line_dedup_does_not_depend_on_the_filters(spark, bits, most):
    """Filters so small that they are full let more lines shuffle and change nothing."""
    rng = random.Random(1)
    lines = [f"line number {i} " + "filler " * 6 for i in range(60)]
    rows = [(i, "\n".join(rng.choice(lines if rng.random() < 0.6 else [f"{rng.random()} " + "own " * 12]) for _ in range(6))) for i in range(150)]
    done = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bits=bits, max_filter_bytes=most)
    assert got_lines(done) == brute_lines(rows)


def test_suspects_miss_nothing(spark):
    h = [hash((i, "x")) for i in range(3000)]
    df = spark.createDataFrame([(x,) for x in h + h[:500] + h[:3] * 2000], "h long").repartition(4)
    assert {x for x in h[:500]} <= {r.h for r in line_dedup.suspects(df, flush=700).collect()}


def test_full_range_filters_lose_no_suspect(spark):
    """Hashes reach the filters in many small batches, so later ones meet full filters."""
    h = [hash((i, "y")) for i in range(900)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, 20)
    try:
        found = [r.h for r in line_dedup.suspects(spark.createDataFrame([(x,) for x in h * 2], "h long").repartition(6), bits=6).collect()]
    finally:
        spark.conf.set(size, old)
    assert sorted(found) == sorted(h)


def test_line_dedup_with_full_range_filters_and_whole_scan_filter(spark):
    lines = [f"line number {i} " + "filler " * 6 for i in range(400)]
    rows = [(d, "\n".join(lines[d % 4 :: 4])) for d in range(32)]
    done = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), bits=6)
    assert got_lines(done) == brute_lines(rows)


def test_a_text_of_many_shared_lines_takes_linear_time(spark):
    text = "\n".join(f"shared line number {i} with more than forty signs" for i in range(200_000))
    df = spark.createDataFrame([(1, "own line\n" + text), (2, text)], "doc_id long, text string")
    start = time.monotonic()
    got = got_lines(line_dedup.dedup_lines(df, min_docs=2))
    assert got == [(1, 200_001, 200_000, "own line"), (2, 200_000, 0, text)] and time.monotonic() - start < 60


def shingles(text, width=5):
    w = [x for x in "".join(" " if c in BLANK else c for c in lower(text or "")).split(" ") if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_links(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [d]
        c = min(ids, default=None) if ids != [None] else None
        out.append((d, len(sets[i]), c, c is None or d == c))
    return sorted(out, key=repr)


def got_links(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def near_copies(seed, groups, size, edits, words=120):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits + 1)):
                w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_near_duplicates_odd_rows(odd, nothing):
    done = near_dup.near_duplicates(odd)
    assert done.columns == [*odd.columns, "n_shingles", "component_id", "kept"]
    assert got_links(done) == brute_links([(r.doc_id, r.text) for r in odd.collect()])
    assert near_dup.near_duplicates(nothing).count() == 0


def test_near_copy_without_doc_id(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(None, " ".join(base)), (7, " ".join([*base[:50], "x", *base[51:]]))]
    got = got_links(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute_links(rows) and (None, 96, 7, False) in got


@pytest.mark.parametrize("edits", [2, 4, 7])
def test_near_duplicates_against_all_pairs(spark, edits):
    """Groups whose members are partly below the threshold, linked through each other."""
    rows = near_copies(edits, 6, 40, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got_links(near_dup.near_duplicates(df)) == brute_links(rows)


def test_rest_blocks_find_what_the_centre_misses(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rows = near_copies(9, 2, 70, 9)
    assert got_links(near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_links(rows)


def test_the_stage_links_from_0_80_on(spark):
    base = [f"w{i}" for i in range(100)]
    near, far = list(base), list(base)
    near[30] = near[60] = "x"  # 86 of 106 shingles shared: 0.811
    far[20] = far[50] = far[80] = "x"  # 81 of 111: 0.730
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string").withColumn("n_chars", F.lit(1))
    assert sorted(r.doc_id for r in stages.distinct_documents(spark, df, "").collect()) == [1, 3]


def test_bands_follow_the_threshold():
    assert near_dup.bands_for(0.85) == 30 and near_dup.bands_for(1) == 30
    for t in (0.5, 0.7, 0.8, 0.85, 0.95):
        assert near_dup.miss_at(t, near_dup.bands_for(t)) <= near_dup.MISS


def test_bounds_and_miss():
    steps = near_dup.bounds(0.85, 1e-6)
    assert [k for k, _ in steps] == [25, 50, 75, 100, 125, 150] and all(m < 0.85 * k for k, m in steps)
    assert near_dup.miss_at(0.85) < 1e-7
    rng = np.random.default_rng(0)
    left = rng.integers(0, 2, (500, 150), np.uint32)
    right = np.where(rng.random((500, 150)) < 0.87, left, 7)
    assert len(near_dup.survivors(left, right, steps)) == 500


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows):
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [ok(v) for _, v in rows]
    link = [[good[i] and good[j] and i != j and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.9 for j, (_, w) in enumerate(rows)] for i, (_, v) in enumerate(rows)]
    out = []
    for i, (d, _) in enumerate(rows):
        reach, todo = {i}, [i]
        while todo:
            new = {j for j in range(len(rows)) if link[todo[-1]][j]} - reach
            todo.pop()
            reach |= new
            todo += new
        c = min((rows[j][0] for j in reach if rows[j][0] is not None), default=None)
        out.append((d, sum(link[i]), c, c is None or c == d))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1024, 16])
def test_vector_duplicates_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dup, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        base = rng.standard_normal(24)
        for _ in range(1 if g < 6 else 9 + 8 * (g % 3)):
            rows.append((len(rows), (base + rng.standard_normal(24) * 0.28).tolist()))
    rows += [(len(rows) + k, rows[-1][1]) for k in range(4)]
    odd = [None, [], [0.0] * 24, [1.0, None] * 12, [float("nan")] * 24, [float("inf")] * 24, [1.0], [2.0], [-1.0]]
    rows += [(1000 + k, v) for k, v in enumerate(odd)] + [(None, rows[-1][1]), (1003, rows[3][1])]
    df = spark.createDataFrame([(d, v, 1) for d, v in rows], "vec_id long, embedding array<double>, cls int").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dup.vector_duplicates(df).collect()), key=repr)
    assert got == brute_vectors(rows)
    assert vector_dup.vector_duplicates(df.where("false")).count() == 0


def test_tables_are_enough_for_the_miss():
    bits, tables = vector_dup.plan(50_000, 0.9)
    assert (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables <= 1e-3


def test_very_large_and_small_components_keep_their_links(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal(24)
    rows = [(i, ((base + rng.standard_normal(24) * 0.01) * scale).tolist()) for i, scale in enumerate([1e200, 1e-200, 1.0, 1e200, 1e-200, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in vector_dup.vector_duplicates(df).collect()) == [(i, 5, 0, i == 0) for i in range(6)]


CLASHING = ["score", "n_lines", "n_dropped", "kept_text", "n_shingles", "component_id", "kept", "n_hit", "text_hash", "n_words", "own score"]


def test_stages_leave_own_columns_alone(spark, odd, nothing):
    """All but the last stage return what they keep with every column as it was; none crashes on odd or no rows."""
    folder = "/root/testdata/sf0.001"
    docs = odd.selectExpr("*", *[f"concat('own ', doc_id) as `{c}`" for c in CLASHING], "1L as n_chars")
    for name, stage in stages.STAGES:
        kept = stage(spark, docs, folder)
        assert set(kept.columns) >= set(docs.columns) and stage(spark, docs.where("false"), folder).count() == 0, name
        if name != "sentencepiece":
            assert kept.columns == docs.columns
        for r in kept.collect():
            assert {r[c] for c in CLASHING} == {None if r.doc_id is None else f"own {r.doc_id}"}, name
        docs = kept.select(docs.columns)
