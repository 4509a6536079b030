"""Metrics against plain restatements."""

import random
import string
from collections import Counter

from convoeval.functions import scoring as S
from convoeval.functions.scoring import lcs_lengths, rouge_l_value
from convoeval.functions.stem import stem
from convoeval.operators import evaluation as E


def normal(s):
    s = s.replace(",", "").lower()
    return " ".join("".join(c for c in s if c not in set(string.punctuation)).split())


def metrics(pred, gold):
    p, g = normal(pred), normal(gold)
    pt, gt = p.split(), g.split()
    n = sum((Counter(pt) & Counter(gt)).values())
    if not pt or not gt or not n:
        pr = rc = f1 = 0.0
    else:
        pr, rc = n / len(pt), n / len(gt)
        f1 = 2 * pr * rc / (pr + rc)
    return f1, pr, rc, float(set(pt) == set(gt)), float(p in g or g in p)


def test_token_scores(spark):
    rng = random.Random(5)

    def text():
        return " ".join(rng.choice(["a", "B", "b,", "c.", "the", " ", "d-e"]) for _ in range(rng.randint(0, 8)))

    pairs = [("a b b c", "b b d"), ("", ""), ("", "x"), ("b a a", "a b")] + [(text(), text()) for _ in range(300)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, response string, expected string")
    got = {r["i"]: tuple(r[m] for m in E.S.METRICS) for r in E.token_scores(df).collect()}
    for i, p in enumerate(pairs):
        assert all(abs(x - y) < 1e-12 for x, y in zip(got[i], metrics(*p))), p
    assert abs(got[0][0] - 4 / 7) < 1e-12 and got[1][3:] == (1.0, 1.0) and got[3][3] == 1.0


def test_keyword_rate(spark):
    rows = [("The Cat sat", "cat, dog"), ("x", ""), ("b", "B , c,")]
    df = spark.createDataFrame(rows, "response string, expected string")
    assert [r["keyword_hit_rate"] for r in E.keyword_scores(df).collect()] == [0.5, 1.0, 2 / 3]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge_l():
    rng = random.Random(6)
    for _ in range(200):
        p = [rng.choice("a b cc dd".split()) for _ in range(rng.randint(1, 12))]
        g = [rng.choice("a b cc dd".split()) for _ in range(rng.randint(1, 12))]
        n = lcs(p, g)
        want = 2 * n / (len(p) + len(g)) if n else 0.0
        assert abs(rouge_l_value(" ".join(p), " ".join(g)) - want) < 1e-12
    assert rouge_l_value("", "") == 0.0
    assert rouge_l_value("running dogs", "the dog runs") == 2 * 1 / 5


def test_stems():
    known = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster",
        "motoring": "motor", "hopping": "hop", "hoping": "hope", "falling": "fall", "filing": "file",
        "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam",
        "predication": "predic", "feudalism": "feudal", "decisiveness": "decis", "sensibiliti": "sensibl",
        "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good",
        "revival": "reviv", "allowance": "allow", "adjustable": "adjust", "replacement": "replac",
        "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control",
        "dying": "die", "skies": "sky",
    }
    assert {w: stem(w) for w in known} == known


def test_lcs_of_many_pairs_at_once():
    rng = random.Random(3)
    pairs = [([rng.choice("abcde") for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 200, 600]))], [rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 7, 64, 130, 500, 700]))]) for _ in range(250)]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    assert lcs_lengths([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [lcs(a, b) for a, b in pairs]


def test_rouge_holds_a_bounded_number_of_tokens(monkeypatch):
    """A batch goes to tokens in parts of bounded size, whatever its rows; the scores are those of single pairs."""
    rng = random.Random(4)
    sides = [[None if rng.random() < 0.1 else " ".join(rng.choice("abcde") for _ in range(rng.randrange(40))) for _ in range(200)] for _ in range(2)]
    want = [S.rouge_l_value(a, b) for a, b in zip(*sides, strict=True)]
    most, part = [], S.lcs_lengths
    monkeypatch.setattr(S, "AT_A_TIME", 500)
    monkeypatch.setattr(S, "lcs_lengths", lambda a, b: most.append(sum(map(len, a)) + sum(map(len, b))) or part(a, b))
    assert S.rouge_l_values(*sides).tolist() == want and max(most) <= 500 and len(S.rouge_l_values([], [])) == 0
