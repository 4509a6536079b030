"""Retrieval indexes that grow with a stream: postings for BM25, cells of vectors for cosine."""

from __future__ import annotations

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from convoeval.operators import retrieval as R
from convoeval.operators import vectorblocks as V
from convoeval.operators.blockmax import in_blocks
from convoeval.session import cut_lineage
from convoeval.streaming.segments import add_segment, live_segments, read_segments, segment_number

#: Numbers of stretches are below 2**NUMBER_BITS in a segment.
NUMBER_BITS = 40

#: Numbers of blocks are below 2**CELL_BITS in a cell of a segment.
CELL_BITS = 24


def _run(stream: DataFrame, checkpoint: str, each) -> StreamingQuery:
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


# postings -------------------------------------------------------------------------------
def start_index(docs: DataFrame, path: str, checkpoint: str, buckets: int = 64, stretch_docs: int = 128, fan: int = 8) -> StreamingQuery:
    """Postings of new documents ``(id, text)``, one segment per micro-batch, merged in levels.

    Only new texts are cut into tokens. A merge deals the postings anew to stretches that fit the larger
    number of documents. Ids are unique over the whole stream.
    """

    def write(batch: DataFrame, place: str) -> None:
        batch = batch.persist()  # counted and written
        n = batch.count()
        R.write_postings(batch.select("id", "text"), place, buckets, R.stretch_of(n, stretch_docs), n)
        batch.unpersist()

    def merge(blocks: DataFrame, place: str) -> None:
        n = blocks.where(F.col("bucket") == R.DOCUMENTS).agg(F.sum("n").alias("n")).first()["n"] or 0
        flat = blocks.select("bucket", "term", F.explode("docs").alias("d")).select("bucket", "term", "d.*")
        R.write_blocks(in_blocks(flat.withColumn("block", R.stretch_of(n, stretch_docs)), ["bucket", "term", "block"], "id", parts=R.parts_of(n)), place)

    return _run(docs, checkpoint, lambda batch, number: add_segment(batch, number, path, write, merge, fan))


def open_index(spark: SparkSession, path: str, buckets: int = 64, **params: float) -> R.Bm25Index:
    """The streamed postings as an index for rankings: the live segments side by side, figures added up anew."""
    number = F.shiftleft(segment_number(spark, path).cast("long"), NUMBER_BITS)
    postings = read_segments(spark, path).withColumn("block", F.col("block") + number).drop("segment")
    terms = cut_lineage(R.term_table(postings))
    return R.Bm25Index(postings, terms, buckets, **R.figures(postings, terms), **params)


# vectors --------------------------------------------------------------------------------
def start_vectors(vectors: DataFrame, path: str, checkpoint: str, cells: int = 64, block_rows: int = 256, fan: int = 8) -> StreamingQuery:
    """New vectors ``(id, embedding)`` in cells, one segment per micro-batch, merged in levels.

    The pivots of the cells are at most ``cells`` vectors of the first batch that has any, those with the
    smallest hash of their id. Each cell of a segment lies in blocks with centre and radius.
    """
    spark = vectors.sparkSession

    def pivots(rows: DataFrame) -> np.ndarray:
        place, schema = f"{path}/pivots", "h long, v array<double>"
        try:
            held = spark.read.schema(schema).parquet(place).orderBy("h").collect()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            held = []
        if not held:
            rows.orderBy(F.xxhash64("id"), "id").limit(cells).select(F.xxhash64("id").alias("h"), V.units("embedding").alias("v")).coalesce(1).write.mode(
                "overwrite").parquet(place)
            held = spark.read.schema(schema).parquet(place).orderBy("h").collect()
        return np.array([r["v"] for r in held])

    def put(rows: DataFrame, place: str) -> None:
        # rows(cell, id, embedding)
        sizes = {r["cell"]: max(1, -(-r["n"] // block_rows)) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one a cell
        parts = F.element_at(F.create_map(*[F.lit(x) for pair in (sizes or {0: 1}).items() for x in pair]), F.col("cell"))
        block = F.pmod(F.xxhash64("id"), parts)
        V.pack(rows.withColumn("block", block), ["cell", "block"]).write.mode("overwrite").partitionBy("cell").parquet(place)

    def write(batch: DataFrame, place: str) -> None:
        rows = batch.where(F.size("embedding") > 0).persist()
        found = pivots(rows)
        put(V.nearest_cell(rows, found) if len(found) else rows.withColumn("cell", F.lit(0)), place)
        rows.unpersist()

    def merge(blocks: DataFrame, place: str) -> None:
        size = F.size("x") / F.size("ids")
        flat = blocks.select("cell", F.posexplode("ids").alias("i", "id"), "x", size.cast("int").alias("size"))
        put(flat.select("cell", "id", F.slice("x", F.col("i") * F.col("size") + 1, F.col("size")).alias("embedding")), place)

    return _run(vectors, checkpoint, lambda batch, number: add_segment(batch, number, path, write, merge, fan))


def vectors_topk(spark: SparkSession, queries: DataFrame, path: str, k: int, first: int = 8) -> DataFrame:
    """Exact cosine top ``k`` over the streamed vectors: ``(qid, id, score, rank)`` for ``queries(qid, embedding)``."""
    return search_vectors(spark, queries, path, k, first)[0]


def search_vectors(spark: SparkSession, queries: DataFrame, path: str, k: int, first: int) -> tuple[DataFrame, DataFrame]:
    """The ranking, and the blocks ``(qid, block)`` that were looked through."""
    number = F.shiftleft(segment_number(spark, path).cast("long"), NUMBER_BITS) + F.shiftleft(F.col("cell").cast("long"), CELL_BITS)
    blocks = read_segments(spark, path).withColumn("block", F.col("block") + number).drop("segment")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()
    asked = cut_lineage(queries.where(F.size("embedding") > 0).select("qid", V.units("embedding").alias("q"), F.lit(None).cast(id_type).alias("upto")))
    heads = cut_lineage(blocks.select("block", "centre", "radius"))

    def of_cells(pairs: DataFrame) -> DataFrame:
        """Only the folders of the cells that ``pairs`` names are read."""
        cell = F.pmod(F.shiftright("block", CELL_BITS), F.lit(1 << NUMBER_BITS - CELL_BITS))
        return blocks.where(F.col("cell").isin([r["c"] for r in pairs.select(cell.alias("c")).distinct().collect()])).drop("cell")

    return V.block_topk(asked, of_cells, [], lambda floor: V.head_bounds(asked, heads, floor), k, first)
