"""Benchmark decontamination with an FM-index per shard of documents.

A shard is an Arrow batch of documents, or a slice of one. Its words become numbers of the benchmark vocabulary; stretches
without benchmark words cannot lie in a match and are left out of the index, the rest is kept as runs.
The index is a suffix order, its Burrows-Wheeler transform in a wavelet matrix, and every eighth suffix
position. All test phrases are searched backward at once; each step is two rank queries per phrase.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.llm.common import slices, word_bytes

BLOCK_WORDS = 2_000_000
SAMPLE = 8
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


class WaveletMatrix:
    """Rank and access over a sequence of numbers below 2**levels."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        v = values
        for level in reversed(range(levels)):
            bit = v >> level & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(v) - int(self.ones[-1][-1]))
            v = np.concatenate((v[bit == 0], v[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        lo, hi = np.zeros_like(at), at
        for k in range(self.levels):
            bit = symbol >> (self.levels - 1 - k) & 1
            a, b = self.ones[k][lo], self.ones[k][hi]
            lo, hi = np.where(bit, self.zeros[k] + a, lo - a), np.where(bit, self.zeros[k] + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for k in range(self.levels):
            one = self.ones[k][at + 1] - self.ones[k][at]
            value = value * 2 + one
            at = np.where(one, self.zeros[k] + self.ones[k][at], at - self.ones[k][at])
        return value


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Places of ``s`` in suffix order, by doubling; zeros are separators, ordered by place."""
    n = len(s)
    gaps = s == 0
    rank = np.where(gaps, np.cumsum(gaps) - 1, s + int(gaps.sum())).astype(np.int64)
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-width or None] = rank[width:] + 1
        key = rank * (max(n, int(rank.max())) + 2) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class FmIndex:
    """Index of a word sequence whose runs are closed by zeros (the last place is a zero)."""

    def __init__(self, s: np.ndarray, levels: int):
        sa = suffix_order(s)
        before = s[sa - 1]
        self.matrix = WaveletMatrix(before, levels)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=1 << levels))))
        # a walk to the left ends at the first word of its run at the latest
        sampled = (sa % SAMPLE == 0) | (before == 0)
        self.rank_of = np.cumsum(sampled) - 1
        self.sampled, self.places = sampled, sa[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open ranges in the suffix order for phrases, one a row, padded at the left."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.sampled), np.int64)
        wide = phrases.shape[1]
        for step in range(wide):
            live = np.flatnonzero((lengths > step) & (hi > lo))
            c = phrases[live, wide - 1 - step]
            lo[live], hi[live] = self.below[c] + self.matrix.rank(c, lo[live]), self.below[c] + self.matrix.rank(c, hi[live])
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        at, steps = at.copy(), np.zeros(len(at), np.int64)
        live = np.flatnonzero(~self.sampled[at])
        while len(live):
            c = self.matrix.access(at[live])
            at[live] = self.below[c] + self.matrix.rank(c, at[live])
            steps[live] += 1
            live = live[~self.sampled[at[live]]]
        return self.places[self.rank_of[at]] + steps


def phrases_of(items: list[tuple], window: int) -> dict:
    """Vocabulary and windows of benchmark rows: each window's numbers, length and item ids."""
    table, vocab, windows = word_bytes(), {}, {}
    for item, text in items:
        words = (text or "").encode().translate(table).split()
        ids = [vocab.setdefault(w, len(vocab) + 1) for w in words]
        for i in range(max(1, len(ids) - window + 1) if ids else 0):
            owners = windows.setdefault(tuple(ids[i : i + window]), set())
            if item is not None:
                owners.add(str(item))
    keys = list(windows)
    lengths = np.array([len(k) for k in keys], np.int64)
    rows = np.zeros((len(keys), window), np.int64)
    for i, k in enumerate(keys):
        rows[i, window - len(k) :] = k
    return {"vocab": vocab, "rows": rows, "lengths": lengths, "items": [sorted(windows[k]) for k in keys],
            "levels": max(1, int(len(vocab)).bit_length()), "shortest": int(lengths.min()) if len(keys) else 0}


def scan(texts: list[str | None], known: dict) -> list[tuple]:
    """(words, hit words, items, merged spans) of each text of a shard."""
    table, get = word_bytes(), known["vocab"].get
    counts, ids = [], []
    for text in texts:
        words = (text or "").encode().translate(table).split()
        counts.append(len(words))
        ids.append(np.fromiter(map(get, words, [0] * len(words)), np.int64, len(words)))
        ids.append(np.zeros(1, np.int64))
    starts = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)))
    s = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    found: list[tuple[list, list]] = [([], []) for _ in texts]
    hits = np.zeros(len(s) + 1, np.int64)
    # runs of benchmark words, each with the zero that closes it
    inside = np.concatenate(([0], (s > 0).astype(np.int8), [0]))
    first, last = np.flatnonzero(np.diff(inside) == 1), np.flatnonzero(np.diff(inside) == -1)
    long = last - first >= max(1, known["shortest"])
    first, last = first[long], last[long]
    if len(first) and len(known["rows"]):
        sizes = last - first + 1
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        places = np.repeat(first - offsets[:-1], sizes) + np.arange(offsets[-1])
        index = FmIndex(s[places], known["levels"])
        lo, hi = index.search(known["rows"], known["lengths"])
        n = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(n)), n)
        at = places[index.locate(np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()))]
        np.add.at(hits, at, 1)
        np.add.at(hits, at + known["lengths"][which], -1)
        pairs = np.unique(np.stack((np.searchsorted(starts, at, "right") - 1, which)), axis=1)
        for doc, w in pairs.T.tolist():
            found[doc][0].extend(known["items"][w])
    covered = np.concatenate(([0], (np.cumsum(hits[:-1]) > 0).astype(np.int8), [0]))
    edges = np.diff(covered)
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    for doc, b, e in zip((np.searchsorted(starts, begin, "right") - 1).tolist(), begin.tolist(), end.tolist(), strict=True):
        found[doc][1].append({"start": b - int(starts[doc]), "end": e - int(starts[doc])})
    return [(n, sum(x["end"] - x["start"] for x in spans), sorted(set(items)), spans) for n, (items, spans) in zip(counts, found, strict=True)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = 4 << 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, text_hash, n_words, n_hit, items, spans).

    ``items`` are the benchmark item_ids, as strings and sorted, with a window of ``window`` words in the
    text (an item of fewer words is one window, one of none has none); ``spans`` are the merged places of
    those windows in words, end exclusive. An item without id marks words and is not named. Null or empty
    texts have no words; each row of ``docs`` gives one row, repeated rows too; no rows give none. Other
    columns are not read.

    The benchmark reaches the tasks in blocks of ``block_words`` words, so what is sent has a fixed bound;
    with several blocks the spans of a document are united.
    """
    spark = docs.sparkSession
    words = F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    bench = benchmark.select("item_id", "text")
    total = bench.agg(F.sum(words.cast("long"))).first()[0] or 0
    blocks = -(-total // block_words) or 1
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    parts = []
    for b in range(blocks):
        block = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(phrases_of([tuple(r) for r in block.toLocalIterator()], window))
        parts.append(rows.mapInArrow(_scanner(shared, shard_bytes), f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, {RESULT}"))
    if blocks == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    # equal rows are told apart by their count, which is the same in each block
    merged = out.groupBy("doc_id", "text_hash").agg(
        (F.count(F.lit(1)) / blocks).cast("int").alias("copies"), F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("all"))
    united = F.aggregate(
        "all", F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
        )).otherwise(F.concat(acc, F.array(x))))
    return merged.withColumn("spans", united).select(
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"), "doc_id", "text_hash", "n_words", "items", "spans").select(
        "doc_id", "text_hash", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_hit"), "items", "spans")


def _scanner(shared, shard_bytes: int):
    def run(batches):
        known = shared.value
        for shard in slices(batches, "text", shard_bytes):
            n_words, n_hit, items, spans = zip(*scan(shard.column("text").to_pylist(), known), strict=True)
            yield pa.RecordBatch.from_arrays(
                [shard.column("doc_id"), shard.column("text_hash"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "text_hash", "n_words", "n_hit", "items", "spans"])

    return run
