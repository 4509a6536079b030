"""Page extraction, piece encoding and toxicity scores."""

import itertools
import random

import numpy as np
import pytest
from conftest import FOLDER  # noqa: F401  (tests/llm/conftest.py)

from convoeval.llm import html_text, pieces, toxicity

PIECES = "/opt/tokenizers/piece_bpe_32k.model"

# pages

ARTICLE = (
    '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><nav><ul><li>menu</ul></nav><div class="ad">buy</div><article><h1>T &amp; U</h1>'
    "<p>one\n  two&nbsp;<b>three</b><br>four<p>five<div class='comments'><p>a comment</div><form>f</form><p>six &lt;b&gt; &am</article><footer>&copy; x</footer>")


def test_article_without_the_rest():
    lines, keep, decided = html_text.kept_lines(ARTICLE)
    assert decided and [lines[i][0] for i in keep] == ["T & U", "one two three four", "five", "six <b> &am"]
    assert html_text.kept_lines(None) == ([], [], False) and html_text.kept_lines("<p")[1] == []
    lines, keep, decided = html_text.kept_lines("<header>h</header><div id=cookie-notice>c</div><p>a<p>b<aside>s</aside><!-- <p>x --><div role=navigation>n</div>tail")
    assert not decided and [lines[i][0] for i in keep] == ["a", "b", "tail"]


def test_shared_lines_is_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(12))] for _ in range(2))
        best = max((len(c) for n in range(len(a) + 1) for c in itertools.combinations(a, n) if _inside(c, b)), default=0)
        for bits in (1 << 31, 4):
            got = html_text.shared_lines(a, b, bits)
            assert len(got) == best and got == sorted(set(got)) and _inside([a[i] for i in got], b)


def _inside(c, b):
    rest = iter(b)
    return all(any(y == x for y in rest) for x in c)


def page(*lines):
    return "<body>" + "".join(f"<div>{x}</div>" for x in lines)


PAGES = [
    (1, "http://h/a/1", page("Site name", "Story one", "More stories")), (2, "https://h/a/2?x=1", page("Site name", "Story two", "Site name", "More stories")),
    (3, "http://h/b/9", page("Site name", "alone in its folder", "More stories")), (4, "http://h/c/8", page("Site name", "alone as well", "More stories")),
    (5, "http://other/a/1", page("Site name", "no partner")), (6, "http://i/x/1", page("copy", "of", "it")), (7, "http://i/x/2", page("copy", "of", "it")),
    (8, None, page("Site name")), (9, "http://h/a/3", None), (10, "http://k/a/10", ARTICLE), (11, "", ""), (1, "http://h/a/1", page("Site name", "Story one", "More stories")), (None, "http://j/a/1", page("frame", "null id")),
    (12, "http://j/a/2", page("frame", "twelve")),
]
WANT = {
    1: "Story one", 2: "Story two\nSite name", 3: "alone in its folder", 4: "alone as well", 5: "Site name\nno partner", 6: "copy\nof\nit", 7: "copy\nof\nit", 8: "Site name", 9: "",
    10: "T & U\none two three four\nfive\nsix <b> &am", 11: "", None: "null id", 12: "twelve",
}


def test_main_text_pairs_pages_of_a_host(spark):
    rows = [r for i, r in enumerate(PAGES) if i != 11]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, key int, lines int").repartition(3)
    got = html_text.main_text(df).collect()
    assert {r.page_id: r.text for r in got} == WANT and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.main_text(df.where("false")).count() == 0


def test_repeated_pages_are_copies_of_each_other(spark):
    df = spark.createDataFrame([PAGES[0], PAGES[11]], "page_id long, url string, html string")
    assert [r.text for r in html_text.main_text(df).collect()] == ["Site name\nStory one\nMore stories"] * 2


def test_large_hosts_are_dealt_out(spark):
    rows = [(i, f"http://big/a/{i}", page("frame", f"text {i}", "foot")) for i in range(60)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), block_pages=10).collect()
    assert {r.page_id: r.text for r in got} == {i: f"text {i}" for i in range(60)}


def test_pages_with_an_article_are_compared_too(spark):
    """What two articles share is found by the alignment and stays by their markup; what only one page has in its menu goes."""
    article = lambda i: f"<nav>menu {i}</nav><p>frame</p><article><p>shared</p><p>story {i}</p></article><footer>foot</footer>"
    rows = [(i, f"http://h/a/{i}", article(i)) for i in range(4)] + [(i, f"http://h/b/{i}", page("frame", f"text {i}")) for i in (4, 5)] + [(6, "http://one/a", article(6))]
    got = {r.page_id: (r.text, r.n_shared) for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: (f"shared\nstory {i}", 3) for i in range(4)} | {i: (f"text {i}", 1) for i in (4, 5)} | {6: ("shared\nstory 6", 0)}


def test_lines_beside_an_article_go_only_if_they_are_shared(spark):
    """A headline over the article and a part behind it are a page's own, the frame is not; a page without partner goes by its markup."""
    part = lambda i: f"<nav>menu {i}</nav><p>frame</p><h1>head {i}</h1><article><p>shared</p><p>story {i}</p></article><div class=ad>buy {i}</div><p>end {i}</p><footer>foot</footer>"
    rows = [(i, f"http://h/a/{i}", part(i)) for i in range(4)] + [(4, "http://one/a", part(4)), (5, "http://h/a/1", part(1)), (6, "http://two/a/1", part(6)), (7, "http://two/a/2", "<p>other</p>")]
    whole = lambda i: f"head {i}\nshared\nstory {i}\nend {i}"
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got, cut = ({r.page_id: (r.text, r.n_shared) for r in html_text.main_text(df, block_pages=n).collect()} for n in (1000, 1))
    assert got == cut == {i: (whole(i), 3) for i in range(4)} | {4: ("shared\nstory 4", 0), 5: (whole(1), 3), 6: ("frame\n" + whole(6), 0), 7: ("other", 0)}


def test_empty_pages_are_no_partners(spark):
    rows = [(i, f"http://h/a/{i}", page("frame", f"text {i}") if i % 2 else ["", None, "<p> </p>"][i % 3]) for i in range(9)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == {i: f"text {i}" if i % 2 else "" for i in range(9)}


def brute_main_text(rows):
    """Partners by a plain look at the sorted pages of each host and folder."""
    pages = []
    for page_id, url, html in rows:
        lines, keep, decided = html_text.kept_lines(html)
        host, _, rest = url.split("://", 1)[1].partition("/")
        pages.append([page_id, host.lower(), "/" + rest, [x[0] for x in lines], [] if decided else keep, keep])
    folder = lambda p: p[2].rsplit("/", 1)[0]
    sizes = {}
    for p in pages:
        sizes[p[1], folder(p)] = sizes.get((p[1], folder(p)), 0) + 1
    group = lambda p: (p[1], "/" + folder(p) if sizes[p[1], folder(p)] > 1 else "")
    opened = lambda p: [p[3][i] for i in p[4]]
    out = {}
    for p in pages:
        own = sorted((q for q in pages if group(q) == group(p)), key=lambda q: (q[2].encode(), q[0]))
        at = own.index(p)
        near = [q for q in (next((q for q in own[:at][::-1] if opened(q) != opened(p)), None), next((q for q in own[at + 1 :] if opened(q) != opened(p)), None)) if q]
        gone = set()
        if near and p[4]:
            partner = max(near, key=lambda q: html_text._alike(q[2], p[2]))[3]
            codes = {x: i for i, x in enumerate({*p[3], *partner})}
            gone = set(html_text.shared_lines([codes[x] for x in p[3]], [codes[x] for x in partner])) & set(p[4])
        out[p[0]] = "\n".join(p[3][i] for i in p[5] if i not in gone)
    return out


@pytest.mark.parametrize("block,parts", [(1000, 4), (5, 4), (1, 40)])
def test_main_text_against_a_brute_force_pairing(spark, block, parts):
    """Hot folder, runs of copies over partition edges, articles between, large frames; partners never depend on the parts."""
    rng = random.Random(2)
    frame = [f"menu {i}" for i in range(40)]
    rows = []
    for i in range(160):
        host, folder = rng.choice(["big", "big", "big", "small"]), rng.choice(["a", "a", "a", "b", f"own{i}"])
        kind = rng.random()
        lines = ["same", "copy", "all over"] if kind < 0.5 else [*frame[:20], f"story {i}", "more", *frame[20:]] if kind < 0.8 else ["same", f"text {i}", "copy"]
        rows.append((i, f"http://{host}/{folder}/{rng.randrange(30):02d}{rng.choice(['', '?x=1', '#t'])}", ARTICLE if kind > 0.95 else page(*lines)))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.page_id: r.text for r in html_text.main_text(df, block_pages=block).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == brute_main_text(rows)
    assert any("menu" not in got[i] and "story" in got[i] for i in got)


# pieces

TEXTS = [
    "", " ", "     ", "  Hello   world\n\n  x\t你好 🙂 é", "a" * 300, "def f(x):\n        return x+1  ", "    " * 9 + "x", "naïve ÅÅ ́e ﬁ ½ \r\n end ", "internationalization " * 3, "\x00\x01 b",
    "The quick brown fox jumps over the lazy dog; " * 20, "x" * 5000, "Ωμέγα кириллица العربية हिन्दी", "a" * 63 + " " + "b" * 65,
]


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.prepared(pieces.load_model(PIECES)))


def test_ids_are_the_library_s(encoder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(0)
    texts = TEXTS + ["".join(rng.choices("etaoin shrdlu\n ▁ABC,.é", k=rng.randrange(60))).replace("▁", "") for _ in range(400)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == sp.encode(text), text
        assert pieces.decode(ids.tolist(), encoder.forms) == text


def test_pairs_stay_apart_as_merges_say(encoder):
    """The rule for neighbours against merging their joint text."""
    rng = random.Random(5)
    a, b = (np.array([rng.randrange(3, encoder.first) for _ in range(3000)]) for _ in range(2))
    want = [encoder.merge(encoder.pieces[x] + encoder.pieces[y]) == [encoder.pieces[x], encoder.pieces[y]] for x, y in zip(a, b, strict=True)]
    assert encoder.apart(a, b).tolist() == want and 0 < sum(want) < 3000
    assert encoder.may_follow(a, b).tolist() == want and encoder.may_follow(a, b).tolist() == want


def test_encoded_rows(spark, odd, nothing, encoder):
    done = pieces.encode_pieces(odd.withColumnRenamed("size", "ids"), PIECES)
    rows = done.collect()
    assert done.columns[-3:] == ["ids", "n_tokens", "round_trip"] and len(rows) == odd.count()
    assert all(r.round_trip and r.n_tokens == len(r.ids) and r["ids"] == encoder.encode([r.text])[0].tolist() for r in rows)
    assert pieces.encode_pieces(nothing, PIECES).count() == 0
    sign = spark.createDataFrame([(1, "a ▁ b")], "doc_id long, text string")
    assert [r.round_trip for r in pieces.encode_pieces(sign, PIECES).collect()] == [False]


# toxicity


def test_disguises_are_read():
    rng = random.Random(0)
    lm = np.full((28, 28, 28), np.log(1e-4))
    text = "you are an idiot and a moron so stupid this is trash worthless pathetic people said the idiot loser "
    codes = list((text * 20).encode().translate(toxicity.TO_CLASS))
    counts = np.full((28, 28, 28), 0.1)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        counts[a, b, c] += 1
    lm = np.log(counts / counts.sum(axis=2, keepdims=True))
    reader = toxicity.Reader(lm, frozenset(["idiot", "moron", "trash"]))
    for shown, word in [("1d10t", "idiot"), ("m0ron", "moron"), ("$tup1d", "stupid"), ("tr@sh", "trash"), ("idiooot", "idiot"), ("w0rthl3ss", "worthless"), ("L0S3R", "loser"), ("i d i o t", "idiot"), ("i.d.1.0.t", "idiot")]:
        assert word in reader.counts_of(f"so, {shown}! he")[0], shown
    assert reader.counts_of("a plain text, here.")[0] == {"a": 1, "plain": 1, "text": 1, "here": 1}
    assert reader.counts_of(None) == ({}, 0)


def test_long_disguises_are_read():
    codes = list(("so the idiot said " * 20).encode().translate(toxicity.TO_CLASS))
    counts = np.full((28, 28, 28), 0.1)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        counts[a, b, c] += 1
    reader = toxicity.Reader(np.log(counts / counts.sum(axis=2, keepdims=True)))
    for shown in ("iiiidioooooooooooooooooooot", "idio" + "o" * 100_000 + "t", "1d" + "1" * 40 + "0t"):
        assert "idiot" in reader.counts_of(f"the {shown} said")[0], len(shown)
    assert len(toxicity.restore("ab1c" * 20_000, reader.lm)) == 80_000


def test_a_word_anywhere_in_a_spelled_run_is_read():
    codes = list(("so the idiot said " * 20).encode().translate(toxicity.TO_CLASS))
    counts = np.full((28, 28, 28), 0.1)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        counts[a, b, c] += 1
    reader = toxicity.Reader(np.log(counts / counts.sum(axis=2, keepdims=True)), frozenset(["idiot"]))
    for start in range(56, 72):
        run = " ".join("said" * 40)[: 2 * start] + "1 d 1 0 t " + " ".join("said" * 3)
        assert "idiot" in reader.counts_of(run)[0], start


def test_rare_toxic_word_has_weight(spark):
    """A word in 1.5 % of the toxic texts and in no other."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"word{k}" for k in range(100)], k=20) + (["zwick"] if i < 12 else ["gnarf"] if i < 800 else [])), int(i < 800)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    scored = toxicity.score(df.select("doc_id", "text"), df.select("doc_id", "toxic")).where("doc_id < 12 or doc_id >= 3900").collect()
    assert all((r.score >= 0.5) == (r.doc_id < 12) for r in scored)


def toxic_corpus(spark, n=1500, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = rng.choices([f"word{k}" for k in range(300)], k=rng.randrange(5, 80))
        bad = rng.random() < 0.15
        if bad:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(["gnarf", "blorg", "9narf", "b l o r g"])
        docs.append((i, " ".join(w), "xx"))
        labels.append((i, 1, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, score string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = toxic_corpus(spark)
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    held = [(got[r.doc_id], r.toxic) for r in labels.where("crc32(cast(doc_id as string)) % 5 = 0").collect()]
    assert len(held) > 200 and sum((s >= 0.5) == bool(y) for s, y in held) / len(held) > 0.97
    # labels of held-out rows are not read
    swapped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    assert {r.doc_id: r.score for r in toxicity.score(docs, swapped).collect()} == got


def test_scores_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1), (4, 0), (5, None), (None, 1), (6, 7), (7, 0)], "doc_id long, toxic int")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.text or "", set()).add(r.score)
    assert all(len(v) == 1 for v in by.values())
    assert toxicity.score(nothing, labels).count() == 0
    assert all(r.score < 0.5 for r in toxicity.score(odd, labels.where("false")).collect())
