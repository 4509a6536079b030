"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir) and returns what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoeval.llm import decontaminate, line_dedup, near_dup, pieces, toxicity
from convoeval.llm.queries import PIECES, table


def beside(docs: DataFrame, names: list[str], work) -> DataFrame:
    """``work`` over ``docs`` whose own columns named like those in ``names`` are set aside and come back as they were."""
    free = "own " * (1 + max(c.count("own ") for c in ["", *docs.columns]))
    aside = {c: f"{free}{c}" for c in docs.columns if c in names}
    return work(docs.withColumnsRenamed(aside)).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def civil_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (9): documents with a score of 0.5 or more go.

    Null and empty texts have the score of a text without evidence; equal texts share their fate, repeated
    rows too. Own columns of any name stay as they are. No rows give none.
    """
    return beside(docs, ["score"], lambda d: toxicity.score(d, table(spark, sf_dir, "labels")).where("score < 0.5"))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup (1): lines that many documents share stay in one of them. No document goes.

    A null text comes back empty; n_chars, where there is one, follows the text. Repeated rows come back as
    often as they came. Own columns of any other name stay as they are. No rows give none.
    """

    def work(d: DataFrame) -> DataFrame:
        done = line_dedup.dedup_lines(d).withColumn("text", F.col("kept_text"))
        return done.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in d.columns else done

    return beside(docs, ["n_lines", "n_dropped", "kept_text"], work)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup (2): of each group that links of similarity 0.8 or more connect the smallest doc_id stays.

    Texts without words link with nothing and stay, so do groups whose rows all lack a doc_id; rows that
    repeat the smallest doc_id stay too. Own columns of any name stay as they are. No rows give none.
    """
    return beside(docs, ["n_shingles", "component_id", "kept"], lambda d: near_dup.near_duplicates(d, percent=80).where("kept"))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (5): documents that hold a benchmark window go.

    Texts without words hold none and stay; repeated rows share their fate. Own columns of any name stay as
    they are. No rows give none.
    """
    found = decontaminate.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = found.where("n_hit > 0").select("doc_id", "text_hash").distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["doc_id"]) & (F.xxhash64(docs["text"]) == hit["text_hash"]), "left_anti")


def encoded_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding (7): every document with its ids, and whether they decode to it.

    Null and empty texts have no ids. Own columns named ids, n_tokens or round_trip are replaced by the
    encoding's, all others stay; repeated rows come back as often as they came. No rows give none.
    """
    return pieces.encode_pieces(docs, PIECES)


STAGES = [
    ("toxicity", civil_documents),
    ("line_dedup", shared_lines),
    ("minhash_near_dedup", distinct_documents),
    ("decontamination", clean_documents),
    ("sentencepiece", encoded_documents),
]
