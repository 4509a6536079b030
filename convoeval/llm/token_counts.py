"""Token counts: texts are encoded in batches of about equal bytes, and only the lengths come back.

Each Arrow function holds one tokenizer. Long texts are cut where the tokenizer starts a new word in any
case, so the pieces have as many tokens as the whole, and pieces of many texts fill batches by their bytes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.llm.common import slices

#: Before a blank that follows another sign, byte-level words end whatever stands around.
SAFE = re.compile(r"(?<=\S)(?=[ \t\n\r])")


def load(data: bytes, json_file: bool):
    """(function from texts to lengths, whether texts may be cut at ``SAFE``) of a tokenizer file.

    Both libraries run without begin, end or added special tokens; strings of special tokens inside a
    text are handled as the library does by default. Nothing is truncated or padded.
    """
    if not json_file:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=data)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_buffer(data)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)], cuttable(json.loads(data))


def cuttable(form: dict) -> bool:
    """Whether cuts at ``SAFE`` change no token: byte-level words of the text as it is, no special string with blanks."""
    words = form.get("pre_tokenizer") or {}
    plain = words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space")
    return bool(plain) and form.get("normalizer") is None and not any(
        re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in form.get("added_tokens") or [])


def pieces(text: str, size: int) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only at ``SAFE``; a run without blanks stays whole."""
    at = 0
    while len(text) - at > size and (cut := SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def lengths(texts: list[str | None], count, cut: bool, piece_chars: int, batch_bytes: int) -> list[int]:
    """Number of tokens of each text, encoded in batches of at most about ``batch_bytes`` characters."""
    out, held, owners, size = [0] * len(texts), [], [], 0

    def encode():
        for i, n in zip(owners, count(held), strict=True):
            out[i] += n
        held.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for piece in (pieces(text, piece_chars) if cut else [text]) if text else []:
            held.append(piece)
            owners.append(i)
            size += len(piece)
            if size >= batch_bytes:
                encode()
                size = 0
    if held:
        encode()
    return out


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, piece_chars: int = 1 << 15, batch_bytes: int = 1 << 18) -> DataFrame:
    """``docs(text, ...)`` with n_bytes, n_tokens and over_limit added.

    ``path`` names a tokenizer file, .json for the tokenizers library and .model for sentencepiece; only the
    driver reads it, the tasks get its bytes (their number is the vocabulary's). n_bytes is the UTF-8 length,
    n_tokens what the library gives for the whole text, over_limit whether that is more than ``limit``.
    Null and empty texts have no bytes and no tokens. All rows come back, repeated rows and rows without id
    too; columns named like the new ones are replaced; no rows give none. Texts of any length are encoded in
    pieces where the tokenizer allows it (byte-level words), else whole.
    """
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    json_file = path.endswith(".json")
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count, cut = load(bytes(shared.value), json_file)
        for batch in batches:
            parts = []
            for part in slices([pa.RecordBatch.from_arrays([batch], ["text"])], "text"):
                parts += lengths(part.column("text").to_pylist(), count, cut, piece_chars, batch_bytes)
            yield pa.array(parts, pa.int64())

    return docs.select(
        *docs.columns,
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        tokens("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
