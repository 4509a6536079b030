"""Cutting narratives into chunks at time, place and length boundaries.

The cut is a fold over the records of a corpus, but a chunk is bounded by
``max_tokens``, so where the next chunk starts depends only on a bounded look
ahead. Each block of records works that out for all its records at once; one
small row per block then tells where a walk that enters the block leaves it. The
rows are chained per corpus and the blocks are read off in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.functions.text import char_counts, collapse, estimate_tokens, record_text
from convoeval.operators.ordered import counted_medians, id_bucket, prefix_sums, with_previous
from convoeval.session import cut_lineage, gathered

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
# Boundary weights by time gap (seconds), place, length change.
WEEK, DAY, SIX_HOURS = 604_800, 86_400, 21_600
COUNTS = ["n_letter", "n_cjk", "n_digit", "n_symbol", "n_space"]


def content_length(fields: list[str]) -> Column:
    total = F.lit(0)
    for f in fields:
        total = total + F.coalesce(F.length(f), F.lit(0))
    return total


def _seconds(col: str) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(F.col(col), F.lit(TIME_FORMAT)))


def boundary_strength(prev: dict[str, Column], cur: dict[str, Column], avg_len: Column) -> Column:
    """Strength of a cut before the current record.

    ``prev`` and ``cur`` hold ``seconds``, ``place`` and ``length``.
    """
    gap = F.abs(cur["seconds"] - prev["seconds"])
    time = (
        F.when(gap.isNull(), 0.0).when(gap > WEEK, 0.6).when(gap > DAY, 0.4)
        .when(gap > SIX_HOURS, 0.2).otherwise(0.1)
    )
    both = (F.coalesce(prev["place"], F.lit("")) != "") & (F.coalesce(cur["place"], F.lit("")) != "")
    place = F.when(both & (prev["place"] != cur["place"]), 0.3).otherwise(0.0)
    change = F.abs(cur["length"] - prev["length"]) / F.nullif(prev["length"], F.lit(0))
    density = F.when(change.isNull(), 0.0).when(change > 0.5, 0.2).when(change > 0.3, 0.15).otherwise(0.05)
    ratio = cur["length"] / F.nullif(avg_len, F.lit(0.0))
    anomaly = F.when((ratio > 3.0) | (ratio < 0.3), 0.15).otherwise(0.0)
    return time + place + density + anomaly


def with_boundaries(
    records: DataFrame, corpus: str, order: str, fields: list[str], threshold: float = 0.5,
    bucket_rows: int = 1 << 17,
) -> DataFrame:
    """Adds record text, length, ``strength`` and ``boundary`` against the record before."""
    base = records.withColumns(
        {
            "record_text": record_text(F.col("timestamp"), F.col("location"), [F.col(f) for f in fields]),
            "seconds": _seconds("timestamp"),
            "length": content_length(fields),
        }
    )
    means = base.groupBy(corpus).agg(F.avg("length").alias("avg_length"))
    rows = with_previous(
        base, [corpus], order, ["seconds", "location", "length"], id_bucket(order, bucket_rows)
    ).join(means, corpus)
    strength = boundary_strength(
        {"seconds": F.col("prev_seconds"), "place": F.col("prev_location"), "length": F.col("prev_length")},
        {"seconds": F.col("seconds"), "place": F.col("location"), "length": F.col("length")},
        F.col("avg_length"),
    )
    value = F.round(F.when(F.col("prev_length").isNotNull(), strength).otherwise(0.0), 6)
    return rows.withColumn("strength", value).withColumn("boundary", F.col("strength") >= threshold)


# the fold, block by block ---------------------------------------------------------
def _estimate(c: np.ndarray) -> np.ndarray:
    """Token estimates of count rows (letters, cjk, digits, symbols, blanks)."""
    raw = c[:, 0] / 4.0 + c[:, 1] / 2.0 + c[:, 2] / 3.0 + c[:, 3] / 2.0 + c[:, 4] / 1.5
    return np.maximum(np.floor(raw * 1.1), 1)


def _first_over(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int) -> np.ndarray:
    """Per start s the first i > s where records s..i reach ``limit`` tokens, else the end of its group."""
    lo, hi = starts + 1, ends
    while np.any(lo < hi):
        mid = (lo + hi) // 2
        at = np.minimum(mid, ends - 1)
        c = sums[at + 1] - sums[starts]
        c[:, 4] += at - starts  # the line break between two records is one blank
        reached = (_estimate(c) >= limit) & (mid < ends)
        hi = np.where(reached, mid, hi)
        lo = np.where(reached | (lo >= hi), lo, np.minimum(mid + 1, hi))
    return lo


def next_starts(counts: np.ndarray, boundary: np.ndarray, ends: np.ndarray, low: int, high: int) -> np.ndarray:
    """Index of the next chunk start for each record; ``ends`` has the end of its group, where the records stop."""
    n = len(counts)
    sums = np.vstack([np.zeros((1, 5)), np.cumsum(counts, axis=0)])
    starts = np.arange(n)
    over = _first_over(sums, starts, ends, high + 1)
    ready = _first_over(sums, starts, ends, low)
    flagged = np.append(np.where(boundary, np.arange(n), n), n)
    after = np.minimum.accumulate(flagged[::-1])[::-1]
    return np.minimum(over, after[ready])


def _changes(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Places of the rows whose keys differ from those of the row before."""
    new = np.zeros(max(len(pdf) - 1, 0), dtype=bool)
    for k in keys:
        values = pdf[k].to_numpy()
        new |= values[1:] != values[:-1]
    return np.flatnonzero(new) + 1


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of whole groups of a partition that is sorted by ``keys``; a batch and a group are held at a time."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        edges = _changes(pdf, keys)
        if held and any(held[-1][k].iloc[-1] != pdf[k].iloc[0] for k in keys):
            edges = np.insert(edges, 0, 0)
        if len(edges):
            done = [*held, pdf.iloc[: edges[-1]]]
            yield pd.concat(done, ignore_index=True) if held else done[0]
            held = []
            pdf = pdf.iloc[edges[-1] :]
        held.append(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def _fold(pdf: pd.DataFrame, keys: list[str], low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All groups of a frame at once: next starts, first rows and sizes of the groups, numbers of their own rows."""
    first = np.append(0, _changes(pdf, keys))
    sizes = np.diff(np.append(first, len(pdf)))
    counts = pdf[COUNTS].to_numpy(dtype="float64")
    nxt = next_starts(counts, pdf["boundary"].to_numpy(dtype=bool), np.repeat(first + sizes, sizes), low, high)
    return nxt, first, sizes, np.add.reduceat(pdf["_own"].to_numpy(dtype="int64"), first)


def _block_maps(corpus: str, low: int, high: int, halo: int):
    """Per block: for each possible entry the exit into the next block and the starts passed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, [corpus, "_block"]):
            nxt, first, _, n_own = _fold(pdf, [corpus, "_block"], low, high)
            blocks = pdf["_block"].to_numpy()[first]
            exits, passed = nxt.tolist(), [1] * len(pdf)
            maps: tuple[list[bytes], list[bytes]] = ([], [])
            for lo, own, block in zip(first.tolist(), n_own.tolist(), blocks.tolist(), strict=True):
                hi = lo + own
                for i in range(hi - 1, lo - 1, -1):
                    if exits[i] < hi:
                        passed[i] += passed[exits[i]]
                        exits[i] = exits[exits[i]]
                k = lo + (min(own, halo) if block else 1)  # the first block is entered at its first record
                maps[0].append((np.array(exits[lo:k], dtype="<i8") - hi).astype("<i4").tobytes())
                maps[1].append(np.array(passed[lo:k], dtype="<i4").tobytes())
            yield pd.DataFrame({corpus: pdf[corpus].to_numpy()[first], "_block": blocks, "_exits": maps[0], "_passed": maps[1]})

    return run


def _chain(corpus: str):
    """Entries of all blocks, over a partition of whole corpora one after the other.

    A block has an entry inside its first ``halo`` records or none at all: a short
    last block may lie wholly inside the last chunk.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, entry, base = None, 0, 0
        for pdf in batches:
            out = []
            for name, block, exits_raw, passed_raw in pdf[[corpus, "_block", "_exits", "_passed"]].itertuples(index=False):
                if name != current:
                    current, entry, base = name, 0, 0
                exits = np.frombuffer(exits_raw, dtype="<i4")
                passed = np.frombuffer(passed_raw, dtype="<i4")
                if entry < len(exits):
                    out.append((name, block, entry, base))
                    base += int(passed[entry])
                    entry = int(exits[entry])
                else:
                    out.append((name, block, np.iinfo("int32").max, base))
            yield pd.DataFrame(out, columns=[corpus, "_block", "_entry", "_base"])

    return run


def _mark(corpus: str, order: str, low: int, high: int):
    """Chunk number of every record of a block, given its entry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, [corpus, "_block"]):
            nxt, first, sizes, n_own = _fold(pdf, [corpus, "_block"], low, high)
            step, marks = nxt.tolist(), [0] * len(pdf)
            entries = first + pdf["_entry"].to_numpy(dtype="int64")[first]
            for i, stop in zip(entries.tolist(), (first + n_own).tolist(), strict=True):
                while i < stop:
                    marks[i] = 1
                    i = step[i]
            starts = np.array(marks, dtype="int64")
            seen = np.cumsum(starts)
            number = pdf["_base"].to_numpy() - 1 + seen - np.repeat(seen[first] - starts[first], sizes)
            rows = pdf[[corpus, order, "idx"]].assign(chunk_id=number)
            yield rows[pdf["_own"].to_numpy(dtype=bool)]

    return run


def numbered_records(records: DataFrame, corpus: str, order: str) -> DataFrame:
    """Slim rows for the fold, written once: all that follows reads them several times.

    ``idx`` counts all records of a corpus, ``_idx`` those with text.
    """
    filled = F.col("record_text") != ""
    slim = records.select(
        corpus, order, "boundary", filled.alias("filled"),
        *[c.alias(n) for n, c in char_counts(collapse(F.col("record_text"))).items()],
    )
    rows = prefix_sums(
        slim, [corpus], [order], id_bucket(order, 1 << 20), _all=F.lit(1).cast("long"), _filled=F.col("filled").cast("long")
    )
    return cut_lineage(
        rows.withColumns({"idx": F.col("_all") - 1, "_idx": F.col("_filled") - 1}).drop("_all", "_filled")
    )


def semantic_chunk_ids(
    rows: DataFrame, corpus: str, order: str, min_tokens: int = 3000, max_tokens: int = 6000,
    block_rows: int = 1 << 16,
) -> DataFrame:
    """``(corpus, order, idx, chunk_id)`` for the rows of ``numbered_records``.

    Records without text take no part. Equal to the record-by-record fold for any
    block size: a chunk holds fewer than ``max_tokens + 2`` records, since every
    record adds at least one character and one blank.
    """
    halo = max_tokens + 2
    block_rows = max(block_rows, halo)
    types = dict(rows.dtypes)
    home = F.floor(F.col("_idx") / block_rows)
    near_start = (F.col("_idx") % block_rows < halo) & (home > 0)
    blocks = F.when(near_start, F.array(home, home - 1)).otherwise(F.array(home))
    spread_rows = (
        rows.where("filled").withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_block") == home)
    )
    key = f"`{corpus}` {types[corpus]}"
    in_order = [corpus, "_block", "_idx"]
    maps = gathered(spread_rows, corpus, "_block").sortWithinPartitions(*in_order).mapInPandas(
        _block_maps(corpus, min_tokens, max_tokens, halo), f"{key}, _block long, _exits binary, _passed binary"
    )
    # one row of a few dozen kilobytes at most per block of records, read as a stream
    entries = gathered(maps, corpus).sortWithinPartitions(corpus, "_block").mapInPandas(
        _chain(corpus), f"{key}, _block long, _entry int, _base long"
    )
    placed = spread_rows.join(entries, [corpus, "_block"])
    return gathered(placed, corpus, "_block").sortWithinPartitions(*in_order).mapInPandas(
        _mark(corpus, order, min_tokens, max_tokens),
        f"{key}, `{order}` {types[order]}, idx long, chunk_id long",
    )


def semantic_chunks(records: DataFrame, rows: DataFrame, ids: DataFrame, corpus: str, order: str) -> DataFrame:
    """Chunk records; a chunk is bounded by the token limit, so its texts fit one row.

    Ids run from the first record of a chunk to the one before the next chunk; the
    first chunk starts at 0 and the last ends with the corpus.
    """
    texts = records.select(corpus, order, "record_text", "timestamp", "location")
    row = F.struct(F.col("idx").alias("o"), F.col("record_text").alias("t"), "timestamp", "location")
    grouped = (
        texts.join(ids, [corpus, order]).groupBy(corpus, "chunk_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    )
    places = F.array_distinct(F.filter(F.col("r.location"), lambda x: F.coalesce(x, F.lit("")) != ""))
    chunks = grouped.select(
        corpus, "chunk_id",
        F.array_join(F.col("r.t"), "\n").alias("text"),
        F.size("r").alias("record_count"),
        F.element_at("r", 1)["timestamp"].alias("start_time"),
        F.element_at("r", -1)["timestamp"].alias("end_time"),
        places.alias("locations"),
    )
    # where chunks start and end comes from the slim ids, not from the texts
    first = F.when(F.col("chunk_id") == 0, 0).otherwise(F.min("idx")).alias("start_id")
    starts = ids.groupBy(corpus, "chunk_id").agg(first)
    following = starts.select(
        corpus, (F.col("chunk_id") - 1).alias("chunk_id"), (F.col("start_id") - 1).alias("_end")
    )
    size = rows.groupBy(corpus).agg(F.max("idx").alias("_last"))
    return (
        chunks.join(starts, [corpus, "chunk_id"]).join(following, [corpus, "chunk_id"], "left").join(size, corpus)
        .withColumns({"end_id": F.coalesce("_end", "_last"), "token_count": estimate_tokens(F.col("text"))})
        .drop("_end", "_last")
    )


def chunk_narrative(
    records: DataFrame, corpus: str, order: str, fields: list[str], min_tokens: int = 3000,
    max_tokens: int = 6000, threshold: float = 0.5, block_rows: int = 1 << 16,
) -> DataFrame:
    """Records to chunks in one call."""
    ready = with_boundaries(records, corpus, order, fields, threshold)
    rows = numbered_records(ready, corpus, order)
    ids = cut_lineage(semantic_chunk_ids(rows, corpus, order, min_tokens, max_tokens, block_rows))
    texts = records.withColumn(
        "record_text", record_text(F.col("timestamp"), F.col("location"), [F.col(f) for f in fields])
    )
    return semantic_chunks(texts, rows, ids, corpus, order)


# Edges of the size report.
SIZE_EDGES = [(3000, "<3k"), (4000, "3k-4k"), (5000, "4k-5k"), (6000, "5k-6k")]


def chunk_stats(chunks: DataFrame, corpus: str) -> DataFrame:
    """Count, sizes, size distribution and distinct places per corpus.

    The sizes, which are costly to tell, are counted in one pass; the rest is read off the counts.
    """
    bucket = F.lit(">6k")
    for edge, name in reversed(SIZE_EDGES):
        bucket = F.when(F.col("token_count") < edge, name).otherwise(bucket)
    hist = cut_lineage(chunks.groupBy(corpus, "token_count").agg(F.count(F.lit(1)).alias("_n")))
    sized, given = hist.withColumn("_b", bucket), F.col("token_count").isNotNull()
    names = [name for _, name in SIZE_EDGES] + [">6k"]
    base = sized.groupBy(corpus).agg(
        F.sum("_n").alias("n_chunks"),
        F.round(F.sum(F.col("token_count") * F.col("_n")) / F.sum(F.when(given, F.col("_n"))), 6).alias("mean_tokens"),
        F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"),
        *[F.sum(F.when(F.col("_b") == n, F.col("_n")).otherwise(0)).alias(f"n_{i}") for i, n in enumerate(names)],
    )
    counted = hist.where(given).select(corpus, F.col("token_count").cast("double").alias("_v"), "_n")
    medians = counted_medians(counted, [corpus]).withColumnRenamed("median", "median_tokens")
    places = chunks.select(corpus, F.explode_outer("locations").alias("p")).groupBy(corpus).agg(
        F.countDistinct("p").alias("n_places")
    )
    return base.join(medians, corpus).join(places, corpus)

