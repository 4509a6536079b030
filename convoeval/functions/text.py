"""Text kernels: Column in, Column out, on the JVM side but for ``pack_lines``."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation and the white space of Unicode text, written
# as a regex class that Java and RE2 read alike.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
TRUNCATED_HEAD = "...[Earlier memory truncated]...\n\n"
TRUNCATED_TAIL = "\n...[Later turns truncated]..."
CONVERSATION_HEADER = "Below is a conversation between"
LABEL_HINT = "What are the labels for the above sentence?"
ERROR_PREFIX = "ERROR"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also inside filters and branches."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def words(text: Column) -> Column:
    """Split at white space, no empty items."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def drop_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def tokens(text: Column) -> Column:
    """Retrieval tokens: lower case, ASCII punctuation deleted, split at space."""
    return words(drop_punctuation(F.lower(text)))


def normalise_answer(text: Column, remove_articles: bool = False) -> Column:
    """Answer text for scoring. Articles stay unless asked for."""
    out = drop_punctuation(F.lower(text))
    if remove_articles:
        out = F.regexp_replace(out, r"\b(a|an|the|and)\b", " ")
    return collapse(out)


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal; empty needle counts 0."""
    return F.when(
        F.length(needle) > 0,
        (F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / F.length(needle),
    ).otherwise(0).cast("long")


LETTERS = "[a-zA-Z]+"


def char_counts(text: Column, rest: Column | None = None) -> dict[str, Column]:
    """Counts the token estimate is made of; ``text`` must be collapsed.

    A count is what a text loses when the runs of a class are taken out: one pass
    over the runs instead of one match per character. ``rest`` is the text without its
    letters, where a caller has it: the other classes are then looked for there only.
    """
    text, whole = (text, None) if rest is None else (rest, text)
    size = F.length(text)

    def lost(runs: str) -> Column:
        return size - F.length(F.regexp_replace(text, runs, ""))

    return {
        "n_letter": lost(LETTERS) if whole is None else F.length(whole) - size,
        "n_cjk": lost(r"[\x{4e00}-\x{9fff}]+"),
        "n_digit": lost(r"\p{Nd}+"),
        "n_symbol": F.length(F.regexp_replace(text, "[a-zA-Z0-9 ]+", "")),
        "n_space": size - F.length(F.replace(text, F.lit(" "), F.lit(""))),
    }


def estimate_tokens(text: Column) -> Column:
    """Rough token count of mixed text, 10 % up; empty is 0, else at least 1."""

    def count(flat: Column) -> Column:
        return once(F.regexp_replace(flat, LETTERS, ""), lambda rest: total(char_counts(flat, rest)))

    def total(c: dict[str, Column]) -> Column:
        raw = (
            c["n_letter"] / 4.0
            + c["n_cjk"] / 2.0
            + c["n_digit"] / 3.0
            + c["n_symbol"] / 2.0
            + c["n_space"] / 1.5
        )
        return F.greatest(F.floor(raw * 1.1), F.lit(1))

    given = F.coalesce(text, F.lit(""))
    return (F.least(F.length(given), F.lit(1)) * once(collapse(given), count)).cast("int")


def money(amount: Column) -> Column:
    """Two decimals as text, half-even on the binary value."""
    return F.replace(F.format_number(amount, 2), F.lit(","), F.lit(""))


def keep_tail(text: Column, budget: Column | int, marker: str = TRUNCATED_HEAD) -> Column:
    """The last ``budget`` characters behind a marker when the text is longer."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    start = F.length(text) - budget + 1
    return F.when(
        F.length(text) > budget, F.concat(F.lit(marker), F.substring(text, start, budget))
    ).otherwise(text)


def keep_head(text: Column, budget: Column | int, marker: str = TRUNCATED_TAIL) -> Column:
    """The first ``budget`` characters, then a marker, when the text is longer."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.when(
        F.length(text) > budget, F.concat(F.substring(text, F.lit(1), budget), F.lit(marker))
    ).otherwise(text)


def strip_query_prefix(query: Column) -> Column:
    """Text after the first ``]``; the whole query when there is none."""
    return F.when(
        F.contains(query, F.lit("]")),
        strip(F.regexp_replace(query, r"(?s)^[^\]]*\]", "")),
    ).otherwise(query)


def _packed(text: str, size: int) -> list[str]:
    pieces, at, end = [], 0, len(text)
    while at < end:
        if text[at] == "\n":
            at += 1
            continue
        to = end
        if end - at > size:
            to = text.rfind("\n", at, at + size + 1)  # the last line end within reach
            if to < 0:
                to = text.find("\n", at)
                to = end if to < 0 else to
        pieces.append(text[at:to])
        at = to
    return pieces


def pack_lines(text: Column, size: int = 1000) -> Column:
    """Whole lines packed greedily into pieces of at most ``size`` characters.

    A line longer than ``size`` stays whole. A piece starts at a non-blank line and ends at the last line end
    within reach, which is looked for from behind: a regex tries every character. Null texts give null.
    """

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        done = [pa.array([], pa.list_(pa.string()))]
        for at in range(0, len(texts), 256):  # few texts at a time are Python objects
            done.append(pa.array([None if t is None else _packed(t, size) for t in texts.slice(at, 256).to_pylist()], pa.list_(pa.string())))
        return pa.concat_arrays(done)

    return pack(text)


def split_words(text: Column, size: int = 5000, back: int = 200) -> Column:
    """Pieces of ``size`` characters, cut at the last blank among the last ``back``."""
    piece = (
        rf"(?s)(?:(?!\A){SPACE}++)?+"
        rf"(.{{1,{size}}}\z|.{{{max(size - back, 1)},{size - 1}}}(?= )|.{{{size}}})"
    )
    pieces = F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(1)), strip)
    return F.when(F.length(text) <= size, F.array(text)).otherwise(pieces)


def keep_ends(items: Column, limit: int) -> Column:
    """First and last ``limit // 2`` items when there are more than ``limit``."""
    half = limit // 2
    ends = F.concat(F.slice(items, 1, half), F.slice(items, -half, half))
    return F.when(F.size(items) > limit, ends).otherwise(items)


def join_chunks(chunks: Column) -> Column:
    """Chunks joined by a blank line; the repeated first line is dropped."""

    def body(chunk: Column, i: Column) -> Column:
        repeated = (i > 0) & chunk.startswith(CONVERSATION_HEADER) & F.contains(chunk, F.lit("\n"))
        return F.when(repeated, F.regexp_replace(chunk, r"^[^\n]*\n", "")).otherwise(chunk)

    return F.array_join(F.transform(chunks, body), "\n\n")


def shorten_prompt(text: Column, limit: int, side: str) -> Column:
    """Bring a prompt to ``limit`` estimated tokens at four characters each."""
    chars = limit * 4
    if side == "left":
        short = F.right(text, F.lit(chars))
    elif side == "right":
        short = F.left(text, F.lit(chars))
    elif side == "middle":
        short = F.concat(F.left(text, F.lit(chars // 2)), F.right(text, F.lit(chars - chars // 2)))
    elif side == "error":
        short = F.raise_error(F.lit(f"prompt longer than {limit} tokens"))
    else:
        raise ValueError("side must be left, right, middle or error")
    return F.when(estimate_tokens(text) > limit, short).otherwise(text)


def record_text(timestamp: Column, location: Column, fields: list[Column]) -> Column:
    """``[time] place | field field ...``; the head only when both parts exist."""
    has_head = (F.coalesce(timestamp, F.lit("")) != "") & (F.coalesce(location, F.lit("")) != "")
    head = F.when(has_head, F.concat(F.lit("["), timestamp, F.lit("] "), location))
    filled = [F.when(strip(f) != "", f) for f in fields]
    body = F.nullif(F.concat_ws(" ", *filled), F.lit(""))
    return F.concat_ws(" | ", head, body)


def add_label_hint(query: Column) -> Column:
    return F.when(
        F.contains(query, F.lit(LABEL_HINT)), query
    ).otherwise(F.concat(F.lit("Sentence: "), query, F.lit("\n" + LABEL_HINT)))


def prefix_date(query: Column, date: Column) -> Column:
    return F.concat(F.lit("["), date, F.lit("] "), query)


def split_documents(context: Column) -> Column:
    """Numbered documents of one context; text before the first one is dropped."""
    parts = F.split(context, "\nDocument ")
    first = F.when(
        F.get(parts, F.lit(0)).startswith("Document "), F.array(strip(F.get(parts, F.lit(0))))
    ).otherwise(F.array().cast("array<string>"))
    rest = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.concat(F.lit("Document "), strip(p)),
    )
    return F.concat(first, rest)


def said(role: Column, text: Column) -> Column:
    return F.concat(role, F.lit(' said, "'), text, F.lit('"'))
