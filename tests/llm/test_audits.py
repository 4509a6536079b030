"""Token counts, filter interaction audit and source divergence audit against the libraries and plain Python."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from conftest import PIECES

from convoeval.llm import filter_audit, queries, source_audit, token_counts

BPE = queries.bpe_path()


# token counts

TOKEN_ROWS = [
    "", None, " ", "\n\n", "it's  a   test\t\n ok", "x" * 50_000, "word " * 20_000, "naïve 你好 🙂\x00\x01 can't", "a<|endoftext|> b <|endoftext|>", "<|endoftext|>" * 2_000,
    "你好世界" * 5_000, " " * 30_000 + "end", "a b  c\x1c d\x85 e", "1 2  3   4    5" * 3_000, "don't 'll 've" * 3_000, "tab\tand\r\nline " * 4_000, "'" * 3_000 + "s t" * 3_000,
]


def library_counts(texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(BPE)
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("piece,batch", [(1 << 15, 1 << 18), (7, 50), (1, 1)])
def test_token_counts_are_the_librarys(spark, piece, batch):
    """Cuts anywhere they are allowed change no count."""
    rng = random.Random(4)
    signs = ["a", "B", "é", "你", "1", "٣", " ", "  ", "\n", "\t", " ", " ", "'", "'s", "'re", ".", "<|endoftext|>", "🙂", "\x1c", "\x85", "​", "\r"]
    texts = (TOKEN_ROWS if piece > 100 else [t and t[:400] for t in TOKEN_ROWS]) + ["".join(rng.choices(signs, k=rng.randrange(120))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in token_counts.count_tokens(df, BPE, 100, piece, batch).collect()}
    want = library_counts(texts)
    assert [got[i].n_tokens for i in range(len(texts))] == want
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert all(got[i].over_limit == (n > 100) for i, n in enumerate(want))


def test_token_counts_odd_rows(odd, nothing):
    rows = odd.withColumnRenamed("n", "n_tokens")
    done = token_counts.count_tokens(rows, BPE)
    assert done.columns == [*(c for c in rows.columns if c != "n_tokens"), "n_bytes", "n_tokens", "over_limit"]
    texts = [r.text for r in odd.collect()]
    assert sorted(r.n_tokens for r in done.collect()) == sorted(library_counts(texts))
    assert token_counts.count_tokens(nothing, BPE).count() == 0


def test_token_counts_of_a_sentencepiece_model(spark):
    from sentencepiece import SentencePieceProcessor

    texts = [t and t[:3_000] for t in TOKEN_ROWS]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = SentencePieceProcessor(model_file=PIECES)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df, PIECES).collect()}
    assert got == {i: len(model.encode(t)) if t else 0 for i, t in enumerate(texts)}


def test_pieces_are_bounded_and_whole():
    text = "some words and more " * 5_000
    parts = list(token_counts.pieces(text, 1_000))
    assert "".join(parts) == text and max(map(len, parts)) < 1_100
    assert list(token_counts.pieces("x" * 5_000, 10)) == ["x" * 5_000] and list(token_counts.pieces("", 10)) == [""]


# filter audit

BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def brute_audit(rows, labels):
    """rows: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    marks = defaultdict(lambda: (0, 0))
    for d, q, t in labels:
        if d is not None:
            marks[d] = (max(marks[d][0], int(q == 1)), max(marks[d][1], int(t == 1)))
    smallest = {}
    for d, text, _ in rows:
        if d is not None:
            smallest[text or ""] = min(d, smallest.get(text or "", d))
    docs = []
    for d, text, source in rows:
        t = text or ""
        w = BLANK.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                 "E": d is not None and smallest[t] < d}
        docs.append((source or "", {k for k, v in fails.items() if v}, *(marks[d] if d is not None else (0, 0))))
    out = {}
    for part in {p for p, *_ in docs}:
        own = [x[1:] for x in docs if x[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failing = [x for x in own if f in x[0]]
                total[f] += len(gone)
                out[part, "".join(order), i + 1] = [len(left), len(gone), len(failing) - len(gone), sum(x[0] == {f} for x in own), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def got_audit(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def audit(docs, labels):
    return filter_audit.audit(filter_audit.failures(docs), labels, list("ABCDE"))


def test_filter_audit_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "ROWS_PER_TASK", 20)
    rng = random.Random(6)
    texts = ["", None, " \n", "one two", "UPPER CASE", "w " * 60, "# " + " ".join(f"w{i}" for i in range(80)), " ".join(f"W{i}" for i in range(80)), " ".join(f"w{i}" for i in range(70))]
    rows = [(rng.choice([*range(60), None]), rng.choice(texts), rng.choice(["a", "b", "b", "b", None, ""])) for _ in range(200)] + [(500, texts[-1], "clean"), (501, texts[-1] + " x", "clean")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1])) for d in range(0, 80, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], "doc_id long, text string, source string, part int, row int, A int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = got_audit(audit(docs, marks))
    assert got == brute_audit(rows, labels) and len(got) == 600 * 4
    assert any(k[0] == "clean" and v[0] == 2 for k, v in got.items())


def test_filter_audit_of_odd_and_empty_tables(spark, odd, nothing):
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = odd.selectExpr("*", "cast(null as string) as source", "1 as kept")
    assert got_audit(audit(docs, marks)) == brute_audit([(r.doc_id, r.text, None) for r in odd.collect()], [])
    assert audit(nothing.selectExpr("*", "'s' as source"), marks).count() == 0


def test_audit_of_two_named_filters(spark):
    rows = spark.createDataFrame([(1, "p", True, True), (2, "p", False, True), (3, "p", False, False)], "doc_id long, part string, X boolean, Y boolean")
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    got = got_audit(filter_audit.audit(rows, marks, ["X", "Y"]))
    assert got == {("p", "XY", 1): [2, 1, 0, 0, 1, 0, 1], ("p", "XY", 2): [1, 1, 1, 1, 0, 1, 3], ("p", "YX", 1): [1, 2, 0, 1, 1, 1, 3], ("p", "YX", 2): [1, 0, 1, 0, 0, 0, 1]}


# source audit

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute_divergence(rows, min_docs=3, top=200):
    """rows: (text, lang, source)."""
    docs = [(s or "", lang or "", Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))) for t, lang, s in rows]
    out = []
    for lang in {x[1] for x in docs}:
        seen = Counter(w for _, x, c in docs if x == lang for w in c)
        kept = sorted(w for w, n in seen.items() if n >= min_docs)
        counts = {s: Counter() for s, x, _ in docs if x == lang}
        for s, x, c in docs:
            if x == lang:
                counts[s].update(c)

        def shares(c):
            n = sum(c[w] for w in kept)
            return [1 + 10**9 * (c[w] + 1) // (n + len(kept)) for w in kept]

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in counts:
            pair = [(t, sum((a - b) ** 2 // b for a, b in zip(p[s], p[t]))) for t in counts if t != s]
            term = [(w, (a - b) ** 2 // b) for w, a, b in zip(kept, p[s], q) if counts[s][w] and a > b]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                for i, (item, v) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]):
                    out.append((lang, s, part, item, v, i + 1))
    return sorted(out)


def got_divergence(df):
    return sorted(tuple(r) for r in df.collect())


def source_rows(seed, n, sources, vocab):
    rng = random.Random(seed)
    words = [rng.choice(["é", "你好", "Wort", "term", "X", "zz"]) + "abcdefgh"[i % 8] * (i // 8) for i in range(vocab)]
    return [(" ".join(rng.choices(words[: rng.randrange(2, vocab)], k=rng.randrange(40))), rng.choice(["en", "en", "en", "de", None, ""]), f"s{rng.randrange(sources) ** 2 // sources}") for _ in range(n)]


@pytest.mark.parametrize("block,fan_in,chunk,window,matrix,side,held", [(1 << 26, 512, 4096, 200_000, 1024, 128, 256), (2_000, 512, 5, 2, 4, 2, 1), (1, 3, 7, 50, 1, 128, 1)])
def test_source_audit_does_not_depend_on_blocks(spark, monkeypatch, block, fan_in, chunk, window, matrix, side, held):
    monkeypatch.setattr(source_audit, "CHUNK", chunk)
    monkeypatch.setattr(source_audit, "WINDOW", window)
    monkeypatch.setattr(source_audit, "MATRIX", matrix)
    monkeypatch.setattr(source_audit, "SIDE", side)
    monkeypatch.setattr(source_audit, "HELD", held)
    monkeypatch.setattr(source_audit, "frequencies", lambda *a, f=source_audit.frequencies: f(*a, fan_in))
    rows = source_rows(block, 120, 9, 90)
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "text string, lang string, source string, i int, z int").repartition(4)
    assert got_divergence(source_audit.divergence(df, top=20, block_bytes=block)) == brute_divergence(rows, top=20)


def test_source_audit_odd_rows(spark, odd, nothing):
    docs = odd.selectExpr("*", "case when doc_id > 8 then 'x' end as lang", "cast(doc_id % 3 as string) as source")
    assert got_divergence(source_audit.divergence(docs)) == brute_divergence([(r.text, r.lang, r.source) for r in docs.collect()])
    assert source_audit.divergence(nothing.selectExpr("*", "'x' as lang", "'y' as source")).count() == 0
    alone = spark.createDataFrame([(None, "xx", "a"), ("", "xx", "b"), ("1 2 3", "yy", "c")], "text string, lang string, source string")
    assert got_divergence(source_audit.divergence(alone)) == [("xx", "a", "pair", "b", 0, 1), ("xx", "b", "pair", "a", 0, 1)]


def test_long_text_is_indexed_in_parts():
    text = ("Wort, " * 300_000 + "ä" * 2_000_000).encode()
    parts = list(source_audit.words_of(text))
    assert len(parts) > 1 and sum(map(len, parts)) == 300_001
