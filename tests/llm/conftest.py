import pytest

FOLDER = "/root/testdata/sf0.001"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
SENTENCE = "The same long line stands in many documents of this small corpus, word for word."

#: Extra columns with names that the operators use inside.
CLASHES = ["n", "t", "key", "cls", "gone", "seen", "lines", "sha", "h", "a", "b", "root", "size", "items", "line"]


def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, ties and very long texts."""
    return [
        (None, SENTENCE + "\nno id"), (None, None), (1, None), (2, ""), (3, " \t\n \r\n"), (4, SENTENCE + "\nfour"), (4, SENTENCE + "\nfour"), (4, "another text of four"),
        (5, SENTENCE.upper() + " \n five"), (6, "  " + SENTENCE), (7, SENTENCE + "\n" + SENTENCE + "\nseven"), (8, SENTENCE), (9, "x" * 200_000), (10, "long words " * 30_000),
        (11, "long words " * 30_000), (12, "tie"), (13, "tie"), (14, "naïve 你好 🙂\x00\x01 token: abcdef12345"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, *range(len(CLASHES))) for r in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASHES))


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
