"""Answer metrics as Columns; only ROUGE-L leaves the JVM."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoeval.functions.stem import stem
from convoeval.functions.text import normalise_answer, strip

METRICS = ["f1_score", "precision", "recall", "exact_match", "sub_em"]


def common_tokens(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two token arrays.

    Works inside the row: the distinct shared tokens come from a hash
    intersection, each is then counted on both sides. No shuffle.
    """

    def count(items: Column, token: Column) -> Column:
        return F.size(items) - F.size(F.array_remove(items, token))

    shared = F.array_intersect(left, right)
    each = F.transform(shared, lambda t: F.least(count(left, t), count(right, t)))
    return F.aggregate(each, F.lit(0), lambda a, n: a + n)


def token_metrics(p: Column, g: Column, pred: Column, gold: Column) -> Column:
    """Struct of precision, recall, F1, set match and containment.

    ``p``/``g`` are the token arrays of the normalised texts ``pred``/``gold``. All
    four must be plain columns: an expression would be worked out anew inside
    every lambda call.
    """
    n = common_tokens(p, g)
    none = (F.size(p) == 0) | (F.size(g) == 0) | (n == 0)

    def or_zero(value: Column) -> Column:
        return F.when(none, 0.0).otherwise(value)

    return F.struct(
        or_zero(2.0 * n / (F.size(p) + F.size(g))).alias("f1_score"),
        or_zero(n / F.size(p)).alias("precision"),
        or_zero(n / F.size(g)).alias("recall"),
        exact_match(p, g).alias("exact_match"),
        sub_em(pred, gold).alias("sub_em"),
    )


def exact_match(p: Column, g: Column) -> Column:
    """Equality of two token sets."""
    same = F.array_sort(F.array_distinct(p)) == F.array_sort(F.array_distinct(g))
    return F.when(same, 1.0).otherwise(0.0)


def sub_em(pred: Column, gold: Column) -> Column:
    """Either normalised text holds the other; the empty text is held by all."""
    held = F.contains(pred, gold) | F.contains(gold, pred)
    return F.when(held, 1.0).otherwise(0.0)


def keyword_hit_rate(response: Column, expected: Column) -> Column:
    """Share of the comma separated gold terms found in the lower-cased response."""
    terms = F.transform(F.split(F.lower(expected), ","), strip)
    return F.size(F.filter(terms, lambda t: F.contains(response, t))) / F.size(F.split(expected, ","))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; NULL when a norm is zero."""

    def dot(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _rouge_tokens(text: str, memo: dict[str, str], stemmed: bool = True) -> list[str]:
    found = re.findall(r"[a-z0-9]+", text.lower())
    if not stemmed:
        return found
    for t in found:
        if t not in memo:
            memo[t] = stem(t) if len(t) > 3 else t
    return [memo[t] for t in found]


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one big-integer row per item."""
    where: dict[str, int] = {}
    for i, token in enumerate(a):
        where[token] = where.get(token, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


#: Items up to which the sequences of a pair are compared beside those of other pairs.
BESIDE = 512


def lcs_lengths(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """Longest common subsequences of pairs of sequences: all pairs go forward together, an item of ``right`` a step.

    The bit rows of the pairs lie side by side in words of 64 bits; a sum carries from word to word. Pairs
    with a longer side are compared one by one.
    """
    out = np.zeros(len(left), np.int64)
    near = [k for k, (a, b) in enumerate(zip(left, right, strict=True)) if a and b and max(len(a), len(b)) <= BESIDE]
    for k, (a, b) in enumerate(zip(left, right, strict=True)):
        if a and b and max(len(a), len(b)) > BESIDE:
            out[k] = _lcs(a, b)
    near.sort(key=lambda k: (-len(right[k]), k))
    for at in range(0, len(near), 2048):
        part = near[at : at + 2048]
        codes: dict[str, int] = {}
        a = [np.array([codes.setdefault(t, len(codes)) for t in left[k]]) for k in part]
        b = [np.array([codes.get(t, -1) for t in right[k]]) for k in part]
        sizes, steps = np.array([*map(len, a)]), np.array([*map(len, b)])
        width = -(-int(sizes.max()) // 64)
        pair = np.repeat(np.arange(len(part)), sizes)
        place = np.concatenate([np.arange(n) for n in sizes])
        keys, row = np.unique(pair * (len(codes) + 1) + np.concatenate(a), return_inverse=True)
        masks = np.zeros((len(keys) + 1, width), np.uint64)  # the last row: an item that the other side lacks
        np.bitwise_or.at(masks, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        state = np.full((len(part), width), ~np.uint64(0))
        asked = np.full((len(part), int(steps.max())), -1)
        for i, x in enumerate(b):
            asked[i, : len(x)] = np.where(x < 0, -1, i * (len(codes) + 1) + x)
        found = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        found = np.where((asked >= 0) & (keys[found] == asked), found, len(keys))
        for j in range(int(steps.max())):
            n = int(np.searchsorted(-steps, -j, side="left"))  # pairs that still have an item here come first
            hit = state[:n] & masks[found[:n, j]]
            carry = np.zeros(n, np.uint64)
            for w in range(width):
                own = state[:n, w].copy()
                first = own + hit[:, w]
                total = first + carry
                carry = ((first < own) | (total < first)).astype(np.uint64)
                state[:n, w] = total | (own & ~hit[:, w])
        bits = np.arange(width * 64) < sizes[:, None]
        free = np.unpackbits(state.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").astype(bool)
        out[part] = (bits & ~free).sum(axis=1)
    return out


#: Characters that are held as tokens at a time; their tokens take about ten times that.
AT_A_TIME = 1 << 20


def rouge_l_values(pred: list[str | None], gold: list[str | None], stemmed: bool = True) -> np.ndarray:
    """ROUGE-L F of pairs of normalised answers, on stemmed tokens or on tokens as they are."""
    memo: dict[str, str] = {}  # stems of one batch
    ends = np.cumsum([len(a or "") + len(b or "") for a, b in zip(pred, gold, strict=True)], dtype=np.int64)
    edges = [0, *(np.flatnonzero(np.diff(ends // AT_A_TIME)) + 1).tolist(), len(pred)]
    parts = [_rouge_l_part(pred[lo:hi], gold[lo:hi], memo, stemmed) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    return np.concatenate(parts)


def _rouge_l_part(pred: list[str | None], gold: list[str | None], memo: dict[str, str], stemmed: bool) -> np.ndarray:
    p, g = ([_rouge_tokens(t, memo, stemmed) if t else [] for t in side] for side in (pred, gold))
    both = np.array([len(a) + len(b) for a, b in zip(p, g, strict=True)], float)
    return np.divide(2.0 * lcs_lengths(g, p), both, out=np.zeros(len(p)), where=both > 0)


def rouge_l_value(pred: str | None, gold: str | None) -> float:
    return float(rouge_l_values([pred], [gold])[0])


@F.pandas_udf(T.DoubleType())
def _rouge_l(pred: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series(rouge_l_values(pred.tolist(), gold.tolist()))


@F.pandas_udf(T.DoubleType())
def _rouge_l_plain(pred: pd.Series, gold: pd.Series) -> pd.Series:
    return pd.Series(rouge_l_values(pred.tolist(), gold.tolist(), False))


def rouge_l(response: Column, expected: Column, stemmed: bool = True) -> Column:
    return (_rouge_l if stemmed else _rouge_l_plain)(normalise_answer(response), normalise_answer(expected))


def vector_f1_floor(score: Column) -> Column:
    """Similarity score floored at zero."""
    return F.greatest(score, F.lit(0.0))


__all__ = [
    "METRICS", "common_tokens", "token_metrics", "exact_match", "sub_em",
    "keyword_hit_rate", "cosine", "lcs_lengths", "rouge_l", "rouge_l_value", "vector_f1_floor",
]
