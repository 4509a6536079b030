"""Toxicity scores of texts whose spelling may be disguised.

A character language model is counted over all documents. Disguised tokens (letters replaced by digits
or signs, letters spelled out with gaps, letters repeated) span a lattice of readings, and a Viterbi pass
under the language model and fixed channel costs picks one. The restored words are scored by the
evidence that labelled documents give for them.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.llm.common import slices, stored

#: Fixed readings of digits and signs.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t"}
SUBSTITUTE, DROP_REPEAT, KEEP_REPEAT = -0.7, -0.2, -2.0

#: Character classes: 0 a gap, 1-26 a-z, 27 other letters.
CLASSES = 28

#: Chance that a stem or feature without meaning passes the test of its counts, over all that are tested.
CHANCE = 0.01

#: Numbers and shares of words from which a stem is a feature.
COUNTS, RATES = (1, 2, 3, 5), (0.002, 0.005, 0.01, 0.02)


def _tables() -> tuple[bytes, bytes]:
    classes, tokens = bytearray(256), bytearray([32] * 256)
    for i in range(256):
        c = chr(i).lower() if i < 128 else ""
        if i >= 128:
            classes[i], tokens[i] = 27, i
        elif "a" <= c <= "z":
            classes[i], tokens[i] = ord(c) - 96, ord(c)
        elif c in LEET or c.isdigit():
            tokens[i] = i
    return bytes(classes), bytes(tokens)


TO_CLASS, TO_TOKEN = _tables()
SIGNS = rb"0-9@$!+"
DISGUISED = re.compile(rb"[a-z][" + SIGNS + rb"]|[" + SIGNS + rb"][a-z]|([a-z])\1\1")
CLOSING = re.compile(rb"[!+]+(?![a-z0-9])")  # a sign at the end of a word is no letter
SPELLED = re.compile(rb"(?<![^ ])(?:[a-z" + SIGNS + rb"] ){3,}[a-z" + SIGNS + rb"](?![^ ])")


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities of a character given the two before it, counted over all texts of ``docs``.

    The counts have one row for each of at most 28**3 triples.
    """

    def count(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in slices(batches, "text"):
            text = "\n\n".join(t for t in batch.column("text").to_pylist() if t).encode()
            for at in range(0, len(text), 1 << 21):
                c = np.frombuffer(text[at : at + (1 << 21) + 2].translate(TO_CLASS), np.uint8).astype(np.int32)
                if len(c) > 2:
                    total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], ["code", "n"])

    counts = np.full(CLASSES**3, 0.1)
    for code, n in docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n")).toLocalIterator():
        counts[code] += n
    counts = counts.reshape(CLASSES, CLASSES, CLASSES)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def restore(token: str, lm: np.ndarray) -> str:
    """The likeliest reading of a token of a-z, digits and signs under ``lm``.

    Paths keep the last two characters as their state. A digit or sign reads as one of its letters; a
    letter after an equal one may be dropped. What all paths share is put aside, so time grows with the length.
    """
    paths, agreed = {(0, 0): (0.0, None)}, []
    for i, ch in enumerate(token):
        reads = [(c, SUBSTITUTE) for c in LEET.get(ch, "")] or [(ch, 0.0)]
        repeated = i > 0 and token[i - 1] == ch and (i > 1 and token[i - 2] == ch or i + 1 < len(token) and token[i + 1] == ch)
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, out) in paths.items():
            steps = []
            for c, cost in reads:
                k = ord(c) - 96 if "a" <= c <= "z" else 27 if c > "\x7f" else 0
                steps.append((score + cost + lm[a, b, k] + (KEEP_REPEAT if repeated else 0.0), (b, k), (out, c)))
            if repeated:
                steps.append((score + DROP_REPEAT, (a, b), out))
            for s, state, o in steps:
                if state not in after or s > after[state][0]:
                    after[state] = (s, o)
        paths = after
        if len(paths) == 1:
            ((state, (score, out)),) = paths.items()
            agreed.append(_letters(out))
            paths = {state: (score, None)}
    return "".join(agreed) + max((score + lm[a, b, 0], _letters(out)) for (a, b), (score, out) in paths.items())[1]


def _letters(path: tuple | None) -> str:
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


class Reader:
    """The set of restored words of a text; readings are remembered up to a bound."""

    def __init__(self, lm: np.ndarray, words: frozenset[str] | None = None):
        self.lm, self.words, self.known = lm, words, {}

    def read(self, token: bytes, spelled: bool = False) -> list[str]:
        if (token, spelled) not in self.known:
            if len(self.known) > 20_000:
                self.known.clear()
            text = token.decode("utf-8", "replace").strip("!") or ""
            if not spelled:
                text = re.sub(r"(.)\1{4,}", r"\1\1\1\1", re.sub(r"([$@!+])\1\1+$", "", text))
            found = []
            if len(text) >= 3 or spelled:
                if not DISGUISED.search(text.encode()) and not spelled:
                    found = [text]
                else:
                    word = restore(text, self.lm)
                    found = [word]
                    if spelled and self.words:
                        found += [w for w in self.words if len(w) > 3 and w in word]
            if len(token) > 64:
                return found
            self.known[token, spelled] = found
        return self.known[token, spelled]

    def counts_of(self, text: str | None) -> tuple[Counter, int]:
        """How often each word stands in a text, restored ones besides what is written; and all words."""
        data = CLOSING.sub(b" ", (text or "").encode().translate(TO_TOKEN))
        tokens = Counter(data.split())
        n = tokens.total()
        joined = b" ".join(tokens)
        out = Counter(dict(zip(joined.decode("utf-8", "replace").split(" "), tokens.values(), strict=False)) if tokens else {})
        if DISGUISED.search(joined):
            for t, k in tokens.items():
                if DISGUISED.search(t):
                    for w in self.read(t):
                        out[w] += k
        for m in SPELLED.finditer(b" ".join(data.split())):
            out.update(self.read(m[0].replace(b" ", b""), True))
        return out, n


def stems_of(counts: Counter, known: frozenset[str] | None = None) -> Counter:
    """Occurrences of whole words (closed by a space) and of their beginnings of 4 to 7 letters."""
    out: Counter = Counter()
    for w, n in counts.items():
        for stem in (w + " ", *(w[:k] for k in range(4, min(len(w), 8)))):
            if known is None or stem in known:
                out[stem] += n
    return out


def levels_of(stems: dict[str, int], n_words: int) -> list[str]:
    """Features of a text: a stem with each number and each share of the words that it reaches."""
    return [f"{stem}>={x}" for stem, n in sorted(stems.items()) for x in (*(c for c in COUNTS if n >= c), *(r for r in RATES if n >= r * n_words))]


def fit(rows: list[tuple[int, list[str]]], prior: tuple[int, int], share: float = 0.02) -> tuple[float, dict[str, float]]:
    """The score of a text without evidence and of each feature, from (label, features) of labelled texts.

    ``prior`` are toxic and all texts. Features enter one at a time: the one in most toxic texts that no
    earlier feature is in, less ten times the other texts it is in, as long as that is ``share`` of the
    toxic texts or more than chance gives; those that only accompany stronger ones stay out. Features in five times that number and
    in no other text enter besides. A feature's score is the share of toxic texts among its own.
    """
    empty = (prior[0] + 0.5) / (prior[1] + 10)
    names = sorted({f for _, found in rows for f in found})
    if not names or not prior[0]:
        return empty, {}
    at = {f: i for i, f in enumerate(names)}
    y = np.array([label for label, _ in rows], float)
    doc = np.concatenate([np.full(len(found), i) for i, (_, found) in enumerate(rows)]).astype(np.int64)
    col = np.array([at[f] for _, found in rows for f in found], np.int64)
    pos, every = np.bincount(col, y[doc], len(names)), np.bincount(col, minlength=len(names))
    # so many toxic texts and no other are rarer than CHANCE among all features
    by_chance = math.log(len(names) / CHANCE) / -math.log((prior[0] + 0.5) / (prior[1] + 1))
    least = max(2.0, min(share * prior[0], by_chance))
    chosen = set(np.flatnonzero((pos == every) & (pos >= 5 * least)).tolist())
    worth = np.where(y > 0, 1.0, -10.0)
    while True:
        gain = np.bincount(col, worth[doc], len(names))
        best = int(gain.argmax())
        if gain[best] < least:
            break
        chosen.add(best)
        worth[doc[col == best]] = 0
    bare = np.ones(len(rows), bool)
    bare[doc[np.isin(col, list(chosen))]] = False
    return float((y[bare].sum() + 0.5) / (bare.sum() + 10)), {names[f]: float((pos[f] + 0.5) / (every[f] + 1)) for f in sorted(chosen)}


def train(docs: DataFrame, labels: DataFrame, lm: np.ndarray, sample_rows: int = 10_000, share: float = 0.02) -> tuple[float, dict[str, float]]:
    """Fit on at most ``sample_rows`` labelled rows, those with the smallest hash of their doc_id.

    Labels are read only where crc32(doc_id as text) mod 5 is not 0. Candidate stems are likelier in toxic
    texts and stand in at least ``share`` of them or in more of them than chance gives: the binomial tail of
    their counts, by Chernoff's bound, is below CHANCE over the number of stems.
    """
    spark = docs.sparkSession
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        "toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    shared = spark.sparkContext.broadcast(lm)

    # at most sample_rows rows of two integers are sent to the tasks; equal texts count once
    rows = stored(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").where("text is not null").groupBy(
        F.xxhash64("text").alias("t")).agg(F.max_by("text", "toxic").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"), "toxic-sample")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sums = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    toxic, n = int(sums[0]), int(sums[1])

    def stems(batches):
        reader, both = Reader(shared.value), (Counter(), Counter())
        for batch in slices(batches, "text"):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                both[label].update(stems_of(reader.counts_of(text)[0]).keys())
        names = list(both[0] | both[1])
        for at in range(0, len(names), 100_000):
            part = names[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([both[k][x] for x in part], pa.int64()) for k in (1, 0))], ["stem", "pos", "neg"])

    pos, neg = F.sum("pos"), F.sum("neg")
    odds = F.log((pos + 0.5) / (toxic + 1)) - F.log((neg + 0.5) / (n - toxic + 1))
    counted = stored(rows.repartition(parts).mapInArrow(stems, "stem string, pos long, neg long").groupBy("stem").agg(
        pos.alias("pos"), neg.alias("neg"), odds.alias("odds")), "stems")
    q, rate = (toxic + 0.5) / (n + 1), F.col("pos") / (F.col("pos") + F.col("neg"))
    # log of the bound; a stem in toxic texts only has no second term
    tail = F.col("pos") * F.log(rate / q) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - rate) / (1 - q))).otherwise(0.0)
    strong = counted.where(((F.col("pos") >= max(2.0, share * toxic)) & (F.col("odds") >= 0.5))
                           | ((F.col("pos") > 0) & (rate > q) & (tail >= math.log(max(1, counted.count()) / CHANCE))))
    lexicon = frozenset(r["stem"] for r in strong.collect())

    def features(batches):
        reader = Reader(shared.value, frozenset(k.strip() for k in lexicon))  # as in scoring
        for batch in slices(batches, "text"):
            counted = [reader.counts_of(t) for t in batch.column("text").to_pylist()]
            found = [levels_of(stems_of(c, lexicon), k) for c, k in counted]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(found, pa.list_(pa.string()))], ["toxic", "found"])

    held = rows.repartition(parts).mapInArrow(features, "toxic int, found array<string>")
    return fit([(r["toxic"], r["found"]) for r in held.collect()], (toxic, n), share)


def score(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> DataFrame:
    """``docs(doc_id, text, ...)`` with the column score (0 to 1) added, from the text alone.

    The strongest evidence counts. An empty or null text has the score of a text without evidence. Equal
    texts have equal scores. Without usable labels every score is near 0.05. Every row comes back, repeated
    rows too; a column named score is replaced; no rows give none. Labels of a doc_id that disagree
    count as toxic; labels that are null or neither 0 nor 1 are not read.
    """
    spark = docs.sparkSession
    docs = docs.drop("score")
    lm = language_model(docs)
    empty, weights = train(docs, labels, lm, sample_rows)
    shared = spark.sparkContext.broadcast((lm, empty, weights))

    @F.arrow_udf("double")
    def rate(texts: pa.Array) -> pa.Array:
        lm, empty, weights = shared.value
        known = frozenset(f.partition(">=")[0] for f in weights)
        reader, scores = Reader(lm, frozenset(k.strip() for k in known)), []
        for text in texts:
            counts, n = reader.counts_of(text.as_py())
            scores.append(max((weights[f] for f in levels_of(stems_of(counts, known), n) if f in weights), default=empty))
        return pa.array(scores, pa.float64())

    return docs.withColumn("score", rate(F.coalesce("text", F.lit(""))))
