"""Line dedup: drop lines that many documents share, keep them in one document.

A Bloom filter per hash range finds the line hashes seen more than once: a hash that the once-seen filter
already holds is named as suspect, and an exact distinct removes repeated names, so no filter ever takes a
hash away. The suspects' bits then make one filter of bounded size for the scan, which lets only suspected
repeats shuffle with their text. Those are confirmed by their text, so a false positive costs a row and never
a line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.llm.common import BLANKS, ascii_lower, stored

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
PROBES = 5


def lines_of(text: Column) -> Column:
    """All lines of a text, split at line feeds; null or empty is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def slots(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """``PROBES`` bit numbers below 2**bits for each 64-bit hash, by double hashing."""
    x = h.view(np.uint64)
    step = (x * GOLDEN) | np.uint64(1)
    return [((x + np.uint64(i) * step) >> np.uint64(64 - bits)).astype(np.int64) for i in range(PROBES)]


class Bloom:
    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.data = np.zeros(1 << bits - 3, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for s in slots(h, self.bits):
            found &= (self.data[s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)
        return found

    def add(self, h: np.ndarray) -> None:
        for s in slots(h, self.bits):
            np.bitwise_or.at(self.data, s >> 3, np.left_shift(1, s & 7).astype(np.uint8))


def suspects(hashes: DataFrame, bits: int = 23, flush: int = 1_000_000) -> DataFrame:
    """Distinct hashes ``h`` that occur at least twice, with few false ones and none missing.

    Each task first counts its own hashes, so a very common line leaves it once, marked as seen twice.
    Per hash range a filter of 2**bits bits takes the hashes in as they stream by; there are
    so many ranges that it has about 8 bits or more for each counted hash. A full filter only adds false ones.
    """

    def combine(batches):
        kept, held = [], 0

        def out():
            h, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n > 1)], ["h", "twice"])

        for batch in batches:
            kept.append(batch.column("h").to_numpy())
            held += len(kept[-1])
            if held >= flush:
                yield out()
                kept, held = [], 0
        if held:
            yield out()

    def watch(batches):
        once = Bloom(bits)
        for batch in batches:
            h, n = np.unique(batch.column("h").to_numpy(), return_counts=True)
            marked = np.isin(h, batch.column("h").to_numpy()[batch.column("twice").to_numpy(zero_copy_only=False)])
            again = h[(n > 1) | marked | once.has(h)]
            once.add(h)
            yield pa.RecordBatch.from_arrays([pa.array(again)], ["h"])

    counted = stored(hashes.mapInArrow(combine, "h long, twice boolean"), "hashes")
    parts = max(int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-counted.count() * 8 >> bits))
    return counted.repartition(parts, "h").mapInArrow(watch, "h long").distinct()


def suspect_filter(found: DataFrame, max_bytes: int = 1 << 26) -> tuple[int, bytes]:
    """One Bloom filter over all suspects, at most ``max_bytes`` long.

    It has 16 bits a suspect as long as that fits. Past the bound it fills up: more lines then count as
    suspected and shuffle, and the result stays the same.
    """
    n = found.count()
    bits = int(min(max(13, np.ceil(np.log2(max(n, 1) * 16))), np.log2(max_bytes * 8)))
    piece = min(bits, 19)

    def build(batches):
        own = Bloom(bits)
        for batch in batches:
            own.add(batch.column("h").to_numpy())
        rows = own.data.reshape(-1, 1 << piece - 3)
        for i in np.flatnonzero(rows.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([rows[i].tobytes()], pa.binary())], ["at", "data"])

    def merge(table: pa.Table) -> pa.Table:
        data = np.bitwise_or.reduce([np.frombuffer(x.as_py(), np.uint8) for x in table.column("data")])
        return pa.table({"at": table.column("at")[:1], "data": pa.array([data.tobytes()], pa.binary())})

    merged = found.mapInArrow(build, "at long, data binary").groupBy("at").applyInArrow(merge, "at long, data binary")
    whole = np.zeros((1 << bits - piece, 1 << piece - 3), np.uint8)
    for row in merged.toLocalIterator():
        whole[row["at"]] = np.frombuffer(bytes(row["data"]), np.uint8)
    return bits, whole.tobytes()


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, bits: int = 23, max_filter_bytes: int = 1 << 26) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the columns n_lines, n_dropped and kept_text added.

    A line's key is the line without white space at its ends and with A-Z lower-cased. Keys of at least
    ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines except in the
    largest doc_id holding it. Rows equal in doc_id and text are one document, and each of them comes
    back; rows that share only the doc_id are different documents and all keep the lines of the largest
    doc_id. A row without doc_id counts as a document and keeps a line only where no holder has a doc_id.
    A null or empty text is one empty line. Other columns pass through, those named like the new ones
    are replaced; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    t = F.xxhash64("text")
    trimmed = F.transform(lines_of(F.col("text")), lambda x: F.btrim(x, F.lit(BLANKS)))
    hashes = docs.select(F.explode(F.array_distinct(F.transform(
        F.filter(trimmed, lambda k: F.char_length(k) >= min_chars), lambda k: F.xxhash64(ascii_lower(k))))).alias("h"))
    shared = spark.sparkContext.broadcast(suspect_filter(stored(suspects(hashes, bits), "suspects"), max_filter_bytes))

    @F.arrow_udf("array<boolean>")
    def suspected(hashes: pa.Array) -> pa.Array:
        bits, data = shared.value
        flags = pa.array(Bloom(bits, data).has(hashes.flatten().to_numpy()))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *hashes.value_lengths().to_pylist()]), pa.int32()), flags)

    # the text stays in the JVM: only hashes are probed
    numbered = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(BLANKS)).alias("key")))
    lines = docs.select("doc_id", t.alias("t"), F.transform(
        F.filter(numbered, lambda x: F.char_length(x["key"]) >= min_chars),
        lambda x: F.struct(x["i"].alias("i"), ascii_lower(x["key"]).alias("key"))).alias("lines")).where(F.size("lines") > 0)
    flagged = lines.withColumn("seen", suspected(F.transform("lines", lambda x: F.xxhash64(x["key"]))))
    seen = stored(flagged.select("doc_id", "t", F.explode(F.filter(
        F.zip_with("lines", "seen", lambda x, y: F.struct(x["i"].alias("i"), x["key"].alias("key"), y.alias("seen"))),
        lambda x: x["seen"])).alias("x")).select("doc_id", "t", "x.i", "x.key"), "suspected")

    # counts and keepers are combined in each task, so a very common line is no hot row
    # (written, so that the join below shuffles both sides anew and Spark can split a hot key)
    common = stored(seen.select("key", "doc_id", "t").distinct().groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs), "common-lines")
    drops = seen.join(common, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy("doc_id", "t").agg(F.collect_set("i").alias("gone"))

    @F.arrow_udf("array<boolean>")
    def marks(gone: pa.Array) -> pa.Array:
        """For each line up to the last one that goes whether it goes, so that a line is looked up in one step."""
        out = []
        for places in gone:
            at = places.values.to_numpy()
            out.append(np.zeros(at.max(initial=-1) + 1, bool))
            out[-1][at] = True
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, out)]), pa.int32()), pa.array(np.concatenate(out) if out else np.zeros(0, bool)))

    drops = drops.withColumn("marks", marks("gone"))
    joined = docs.join(drops, docs["doc_id"].eqNullSafe(drops["doc_id"]) & (F.xxhash64(docs["text"]) == drops["t"]), "left")
    text, gone = F.coalesce(docs["text"], F.lit("")), drops["gone"]
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.coalesce(F.get(drops["marks"], i), F.lit(False))), "\n")
    return joined.select(
        *[docs[c] for c in docs.columns],
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(gone.isNull(), text).otherwise(kept).alias("kept_text"),
    )
