"""License scans: an exact set-similarity join of blocks of text with licence notices, in DataFrame functions.

A block is a window of twice a notice's number of words; blocks start at every multiple of that number, so any
stretch as long as the notice lies inside one, across line ends too. The tokens of the notices are ordered by
how many texts hold them, rarest first. A text with a block that holds at least the threshold of a notice's
tokens must share one of the notice's rarest tokens (prefix filter), have enough tokens (length filter) and, at
the first shared token, enough tokens left on both sides (positional filter). The blocks of the texts that pass
are verified on the whole token sets.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoeval.llm.common import ascii_lower, stored

#: Fixed phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Notices as they usually stand. Short ones must match in full at the default threshold.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("all-rights-reserved", "all rights reserved"),
]

#: No words: control characters, signs and spaces of ASCII. Capitals are lower-cased before.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _spaces(text: Column) -> Column:
    return (F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def scan_licenses(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, threshold: float = 0.9) -> DataFrame:
    """``docs(doc_id, text)`` as (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``n_base`` counts the places where the words of one of ``PHRASES`` stand consecutively (line ends are
    no words), ``first_word`` and ``last_word`` are the smallest and largest of their starts in words from
    0, null without a place. ``labels`` has besides the base labels those of the notices of which one block
    holds at least ``threshold`` of the distinct words. ``score`` is 1 with a base place, else the largest
    share reached by a block, else 0. Null or empty texts have no words. Every row of ``docs`` gives one
    row, repeated rows too; no rows give none. Other columns are not read.
    """
    sets = [(i, label, sorted(set(text.split())), len(text.split())) for i, (label, text) in enumerate(notices)]
    needs = [max(1, math.ceil(threshold * len(words) - 1e-9)) for _, _, words, _ in sets]
    vocab = sorted({w for _, _, words, _ in sets for w in words})
    norm = F.concat(F.lit(" "), F.regexp_replace(ascii_lower(F.coalesce("text", F.lit(""))), NO_WORD, " "), F.lit(" "))
    base = docs.select("doc_id", F.xxhash64("text").alias("t"), F.regexp_replace(norm, " +", " ").alias("norm"))
    any_phrase = " (?:" + "|".join(p for p, _ in PHRASES) + ")(?= )"
    hit = F.col("n_base") > 0
    base = base.withColumns({
        "n_base": F.regexp_count("norm", F.lit(any_phrase)).cast("long"),
        "tokens": F.array_intersect(F.split("norm", " ", -1), F.lit(vocab)),
    })
    # a text is kept for the blocks only where all its words together hold enough of a notice
    enough = reduce(lambda a, b: a | b, [F.size(F.array_intersect("tokens", F.lit(words))) >= need for (_, _, words, _), need in zip(sets, needs, strict=True)])
    texts = stored(base.select(
        "doc_id", "t", "n_base", "tokens", F.when(enough, F.col("norm")).alias("norm"),
        F.when(F.col("norm") == " ", F.lit(0)).otherwise(_spaces(F.col("norm")) - 1).cast("long").alias("n_words"),
        F.when(hit, _spaces(F.split("norm", any_phrase, 2)[0])).alias("first_word"),
        F.when(hit, _spaces(F.regexp_extract("norm", f"(?s)^(.*){any_phrase}", 1))).alias("last_word"),
        F.when(hit, F.array_compact(F.array(*[F.when(F.contains("norm", F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES]))).otherwise(
            F.array().cast("array<string>")).alias("base"),
    ), "license-texts")

    matched = similar_blocks(texts, sets, needs)
    found = matched.groupBy("doc_id", "t").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")).select(
        F.col("doc_id").alias("found_id"), F.col("t").alias("found_t"), "more", "share")
    out = texts.drop("tokens", "norm").join(found, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("t") == F.col("found_t")), "left")
    every = F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(every), ",").alias("labels"),
        F.when(hit, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def similar_blocks(texts: DataFrame, sets: list[tuple[int, str, list[str], int]], needs: list[int]) -> DataFrame:
    """(doc_id, t, label, share) of the blocks of ``texts(doc_id, t, tokens, norm)`` that hold enough of a set.

    ``tokens`` are distinct and from the sets' vocabulary; texts without ``norm`` have no such block. The
    order of the vocabulary (its size is that of the notices, not of the data) comes back to the driver;
    texts meet a table of prefix tokens that is as small.
    """
    spark = texts.sparkSession
    counts = dict(tuple(r) for r in texts.select(F.explode("tokens").alias("w")).groupBy("w").count().collect())
    ranks = {w: i for i, w in enumerate(sorted({w for _, _, words, _ in sets for w in words}, key=lambda w: (counts.get(w, 0), w)))}
    prefixes, wholes = [], []
    for (i, label, words, length), need in zip(sets, needs, strict=True):
        own = sorted(words, key=ranks.get)
        wholes.append((i, label, own, need, length))
        prefixes += [(w, i, at, len(own), need) for at, w in enumerate(own[: len(own) - need + 1])]
    index = spark.createDataFrame(prefixes, "token string, notice int, at int, n int, need int")
    rare = sorted({p[0] for p in prefixes})
    near = texts.where(F.col("norm").isNotNull() & F.arrays_overlap("tokens", F.lit(rare)))
    order = F.create_map(*[F.lit(x) for w in ranks for x in (w, ranks[w])])
    ordered = near.withColumn("tokens", F.transform(
        F.array_sort(F.transform("tokens", lambda w: F.struct(F.element_at(order, w).alias("rank"), w.alias("w")))), lambda x: x["w"]))
    pairs = ordered.select("doc_id", "t", "norm", "tokens", F.posexplode("tokens").alias("pos", "token")).join(F.broadcast(index), "token").where(
        (F.size("tokens") >= F.col("need"))
        & (F.least(F.size("tokens") - F.col("pos"), F.col("n") - F.col("at")) >= F.col("need")))
    # a text's notices come together in its own row, so that its words are dealt out once
    whole = spark.createDataFrame(wholes, "notice int, label string, words array<string>, required int, length int")
    asked = pairs.select("doc_id", "t", "norm", "tokens", "notice").distinct().join(F.broadcast(whole), "notice").where(
        F.size(F.array_intersect("tokens", "words")) >= F.col("required"))
    words = asked.select("doc_id", "t", "notice", "label", "words", "required", "length", F.posexplode(F.split(F.btrim("norm"), " ", -1)).alias("at", "word")).where(
        F.array_contains("words", F.col("word")))
    cell = F.floor(F.col("at") / F.col("length")).cast("int")
    blocks = words.select("doc_id", "t", "notice", "label", "required", F.size("words").alias("size"), "word", F.explode(F.array(cell, cell - 1)).alias("block")).where("block >= 0")
    held = blocks.groupBy("doc_id", "t", "notice", "label", "required", "size", "block").agg(F.size(F.collect_set("word")).alias("held"))
    return held.where(F.col("held") >= F.col("required")).select("doc_id", "t", "label", (F.col("held") / F.col("size")).alias("share"))
