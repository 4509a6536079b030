"""SentencePiece encoding and decoding with a batched Viterbi over numpy arrays.

For the words of one length, all positions advance together: substring hashes probe the sorted piece keys,
and a piece may follow another where the byte-pair merges of the two would leave them apart. Under that
rule one path reaches each position; its piece is kept as backpointer by a vectorised maximum. The result
is the library's own encoding of a BPE model, which a sum of piece scores would not give.
"""

from __future__ import annotations

import heapq
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from convoeval.llm.common import slices

SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Longer words, and words after several spaces, are merged one by one.
LONGEST = 64
NO_LIMIT = 1 << 40
PAIR_BITS = 20


class Model(NamedTuple):
    pieces: list[str]  # ordinary pieces
    ids: np.ndarray  # their ids
    scores: np.ndarray
    byte_ids: np.ndarray  # ids of the 256 byte pieces, -1 without
    unknown: int
    forms: list[bytes]  # what each id of the whole vocabulary decodes to


def load_model(path: str) -> Model:
    """Pieces of a SentencePiece BPE model file, read where the driver runs."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.vocab_size()
    plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    byte_ids, forms = np.full(256, -1), [b""] * n
    for i in range(n):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            forms[i] = bytes([int(piece[3:5], 16)])
        elif sp.is_unknown(i):
            forms[i] = " ⁇ ".encode()
        elif not sp.is_control(i):
            forms[i] = piece.replace(SPACE, " ").encode()
    return Model([sp.id_to_piece(i) for i in plain], np.array(plain), np.array([sp.get_score(i) for i in plain]), byte_ids, sp.unk_id(), forms)


def codes_hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of rows of code points, one column more than ``codes``."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + codes[:, i] + np.uint64(1)
    return out


def prepared(model: Model) -> dict:
    """Everything an ``Encoder`` needs, as plain arrays and dicts that travel to the tasks.

    Pieces are numbered by place in ``model.pieces``; other characters are numbers from ``first`` on.
    """
    pieces = model.pieces
    longest = max(map(len, pieces))
    # single characters come before all merges, then higher scores first
    single = np.array([len(p) == 1 for p in pieces])
    rank = np.empty(len(pieces), np.int64)
    rank[np.lexsort((model.ids, -model.scores, ~single))] = np.arange(len(pieces)) + 1
    rank[single] = 0
    hashes = np.array([int(codes_hash(np.array([[ord(c) for c in p]], np.uint64))[0, -1]) for p in pieces], np.uint64)
    order = np.argsort(hashes)
    state = {
        **model._asdict(), "number": {p: i for i, p in enumerate(pieces)}, "first": len(pieces), "longest": longest, "rank": rank,
        "power": np.array([pow(int(BASE), k, 1 << 64) for k in range(2 * longest + 2)], np.uint64), "size": np.array([len(p) for p in pieces]),
        "hash": hashes, "by_hash": order, "keys": hashes[order],
    }
    own = Encoder(state)
    left, right, reachable = np.arange(len(pieces)), np.arange(len(pieces)), np.ones(len(pieces), bool)
    for i, p in enumerate(pieces):
        if len(p) > 1:
            merged, cut = own.merge(p, True)
            reachable[i] = merged == [p] and all(x in own.number for x in cut)
            if reachable[i]:
                left[i], right[i] = (own.number[x] for x in cut)
    return {**state, "left": left, "right": right, "reachable": reachable}


class Encoder:
    def __init__(self, state: dict, memory: int = 200_000):
        self.__dict__.update(state)
        self.memory = memory
        self.words: dict[str, bytes] = {}
        # pairs met before, one a slot
        self.pair_keys, self.pair_free = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def merge(self, word: str, last: bool = False):
        """The pieces of a word by merging the best pair again and again, the leftmost of equals.

        With ``last`` also the two parts of the last merge.
        """
        parts: list[str | None] = list(word)
        nxt, prv = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple] = []
        cut: tuple = (None, None)

        def offer(a: int) -> None:
            b = nxt[a]
            if b < len(parts):
                at = self.number.get(parts[a] + parts[b])
                if at is not None:
                    heapq.heappush(heap, (-self.scores[at], a, parts[a], b, parts[b]))

        for a in range(len(parts) - 1):
            offer(a)
        while heap:
            _, a, x, b, y = heapq.heappop(heap)
            if parts[a] != x or b >= len(parts) or nxt[a] != b or parts[b] != y:
                continue
            cut = (x, y)
            parts[a], parts[b] = x + y, None
            nxt[a] = nxt[b]
            if nxt[b] < len(parts):
                prv[nxt[b]] = a
            if prv[a] >= 0:
                offer(prv[a])
            offer(a)
        out = [p for p in parts if p is not None]
        return (out, cut) if last else out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 without."""
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.by_hash[at], -1)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges of two neighbouring pieces leave them apart.

        Both are taken apart again, the later merge first; at every step a merge across the border that
        comes before what has been undone would have joined them.
        """
        free, open_ = np.ones(len(a), bool), np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), NO_LIMIT)
        while len(open_):
            both = self.find(self.hash[a] * self.power[self.size[b]] + self.hash[b])
            joined = (both >= 0) & (self.rank[both] < limit)
            free[open_[joined]] = False
            ra, rb = self.rank[a], self.rank[b]
            # undo the later merge; on equal terms the right one is later
            undo_a = ra > rb
            done = joined | ((ra == 0) & (rb == 0))
            limit = np.where(undo_a, ra, rb + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
            go = ~done
            a, b, limit, open_ = a[go], b[go], limit[go], open_[go]
        return free

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        known = (a < self.first) & (b < self.first)
        out = np.ones(len(a), bool)  # a character without a piece never merges
        keys = a[known].astype(np.int64) * self.first + b[known]
        slot = ((keys.view(np.uint64) * BASE) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        held = self.pair_free[slot]
        new = np.flatnonzero(self.pair_keys[slot] != keys)
        if len(new):
            fresh, first, back = np.unique(keys[new], return_index=True, return_inverse=True)
            free = self.apart(fresh // self.first, fresh % self.first)
            held[new] = free[back]
            at = slot[new][first]
            self.pair_free[at], self.pair_keys[at] = free, -1
            self.pair_keys[at] = fresh
            # two fresh pairs of one slot: the key that stayed decides, its value must be its own
            lost = self.pair_keys[at] != fresh
            self.pair_keys[at[lost]] = -1
        out[known] = held
        return out

    def viterbi(self, words: list[str]) -> list[bytes]:
        """The ids (int32, as bytes) of words of one length."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).astype(np.uint64)
        prefix = codes_hash(codes)
        last, width = np.full((n, size + 1), -1, np.int64), np.zeros((n, size + 1), np.int64)
        for end in range(1, size + 1):
            for k in range(1, min(end, self.longest) + 1):
                start = end - k
                piece = self.find(prefix[:, end] - prefix[:, start] * self.power[k])
                fits = (piece >= 0) & self.reachable[piece]
                if k == 1:
                    piece = np.where(fits, piece, self.first + codes[:, start].astype(np.int64))
                    fits[:] = True
                rows = np.flatnonzero(fits)
                if start and len(rows):
                    rows = rows[last[rows, start] >= 0]
                    rows = rows[self.may_follow(last[rows, start], piece[rows])]
                # one path ends here; the maximum keeps it
                width[rows, end] = np.maximum(width[rows, end], k)
                last[rows, end] = piece[rows]
        # follow the backpointers from the right
        found, at, live, column = np.zeros((n, size), np.int64), np.full(n, size), np.arange(n), size
        count = np.zeros(n, np.int64)
        while len(live):
            column -= 1
            found[live, column] = last[live, at[live]]
            count[live] += 1
            at[live] -= width[live, at[live]]
            live = live[at[live] > 0]
        known = found < self.first
        ids = self.ids[np.where(known, found, 0)].astype(np.int32)
        whole = known.all(axis=1).tolist()
        return [ids[i, size - c :].tobytes() if whole[i] else self.to_ids(found[i, size - c :].tolist()) for i, c in enumerate(count.tolist())]

    def to_ids(self, numbers: list[int]) -> bytes:
        out: list[int] = []
        for x in numbers:
            if x < self.first:
                out.append(int(self.ids[x]))
            else:
                own = [int(self.byte_ids[v]) for v in chr(x - self.first).encode("utf-8", "replace")]
                out += own if min(own) >= 0 else [self.unknown]
        return np.array(out, np.int32).tobytes()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        if len(self.words) > self.memory:
            self.words.clear()
        units = [units_of(t) for t in texts]
        fresh: dict[int, list[str]] = {}
        for word in set().union(*units) - self.words.keys():
            if len(word) > LONGEST or word[:2] == SPACE * 2:
                self.words[word] = self.to_ids([self.number[p] if p in self.number else self.first + ord(p) for p in self.merge(word)])
            else:
                fresh.setdefault(len(word), []).append(word)
        for same in fresh.values():
            for at in range(0, len(same), 20_000):
                part = same[at : at + 20_000]
                self.words.update(zip(part, self.viterbi(part), strict=True))
        return [np.frombuffer(b"".join(map(self.words.__getitem__, u)), np.int32) for u in units]


def units_of(text: str | None) -> list[str]:
    """Words with the spaces before them as signs; line ends, which no piece holds, stand alone."""
    if not text:
        return []
    return re.findall(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+", SPACE + text.replace(" ", SPACE))


def decode(ids: list[int], forms: list[bytes]) -> str:
    text = b"".join([forms[i] for i in ids]).decode("utf-8", "replace")
    return text.removeprefix(" ")


def encode_pieces(docs: DataFrame, path: str, slice_bytes: int = 1 << 21) -> DataFrame:
    """``docs(doc_id, text, ...)`` with ids (array of int), n_tokens and round_trip added.

    The ids are those of the SentencePiece BPE model at ``path``, which only the driver reads; its pieces
    go to the tasks (their number is the vocabulary's). ``round_trip`` says whether decoding gives the text
    back; it does unless the text holds the space sign U+2581 itself. A null text has no ids and counts as
    empty. All rows come back, repeated rows too; columns named like the new ones are replaced; no rows
    give none.
    """
    spark = docs.sparkSession
    docs = docs.drop("ids", "n_tokens", "round_trip")
    shared = spark.sparkContext.broadcast(prepared(load_model(path)))
    names = docs.columns
    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes) + ", ids array<int>, n_tokens long, round_trip boolean"

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in slices(batches, "text", slice_bytes):
            texts = batch.column("text").to_pylist()
            ids = encoder.encode(texts)
            whole = [decode(i.tolist(), encoder.forms) == (t or "") for i, t in zip(ids, texts, strict=True)]
            sizes = [len(i) for i in ids]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), lists, pa.array(sizes, pa.int64()), pa.array(whole)], [*names, "ids", "n_tokens", "round_trip"])

    return docs.mapInArrow(run, schema)
