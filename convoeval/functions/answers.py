"""Post-processing of answers and judge replies, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from convoeval.functions.text import SPACE, strip

THINK_END = "</think>"


def strip_think(text: Column) -> Column:
    """What follows the last closing think tag; NULL when a tag is left open."""
    closed = F.contains(text, F.lit(THINK_END))
    opened = F.contains(text, F.lit("<think>"))
    return (
        F.when(closed, strip(F.substring_index(text, THINK_END, -1)))
        .when(opened, F.lit(None).cast("string"))
        .otherwise(text)
    )


def extract_tag(text: Column, tag: str = "answer") -> Column:
    """Content of the first ``<tag>...</tag>``, NULL without one."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def _balanced(text: Column, opener: str) -> Column:
    """Text up to the brace that closes the last ``opener``; NULL if unbalanced."""
    tail = F.substring_index(text, opener, -1)

    def step(acc: Column, ch: Column) -> Column:
        depth = acc["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        open_ = acc["depth"] > 0
        return F.struct(
            F.when(open_, depth).otherwise(0).cast("int").alias("depth"),
            (acc["n"] + F.when(open_, 1).otherwise(0)).cast("int").alias("n"),
        )

    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
    # only braces matter for the balance: fold over runs, not over characters
    end = F.aggregate(F.regexp_extract_all(tail, F.lit(r"[{}]"), F.lit(0)), start, step)
    pattern_end = F.when(end["depth"] == 0, end["n"])
    before = F.array_join(
        F.slice(F.split(tail, r"(?<=[{}])"), F.lit(1), F.coalesce(pattern_end, F.lit(0))), ""
    )
    inner = strip(F.substring(before, F.lit(1), F.greatest(F.length(before) - 1, F.lit(0))))
    return F.when(F.contains(text, F.lit(opener)) & pattern_end.isNotNull(), inner)


def extract_boxed(text: Column, fallback_chars: int = 2000) -> Column:
    """Final answer from a boxed expression, else the end of the text."""
    boxed = F.coalesce(_balanced(text, "\\boxed{"), _balanced(text, "\\box{"))
    plain = strip(F.regexp_extract(boxed, r"(?s)^\\text\{([^\n]+)\}$", 1))
    spaced = strip(F.substring_index(F.substring_index(text, "\\boxed ", -1), "$", 1))
    return (
        F.when(F.contains(text, F.lit("\\boxed ")), spaced)
        .when(F.coalesce(boxed, F.lit("")) == "", F.right(text, F.lit(fallback_chars)))
        .when(boxed.rlike(r"^\\text\{([^\n]+)\}$"), plain)
        .otherwise(boxed)
    )


def repair_json(text: Column) -> Column:
    """Quote repair of a JSON object wrapped in prose marks."""
    out = F.regexp_replace(text, r'\\"', "'")
    out = F.replace(F.replace(out, F.lit("json"), F.lit("")), F.lit("`"), F.lit(""))
    out = strip(F.replace(strip(out), F.lit("\\'"), F.lit("")))
    singles = F.length(out) - F.length(F.replace(out, F.lit("'"), F.lit("")))
    doubles = F.length(out) - F.length(F.replace(out, F.lit('"'), F.lit("")))
    swapped = F.replace(F.replace(out, F.lit('"'), F.lit("")), F.lit("'"), F.lit('"'))
    return F.when(singles > doubles, swapped).otherwise(out)


def batch_reply(text: Column) -> Column:
    """A batch reply as a map from number to raw answer."""
    return F.from_json(repair_json(text), "map<string,string>")


def batch_answer(raw: Column) -> Column:
    """One raw answer: option marks removed, values of a nested object joined."""
    nested = F.array_join(F.map_values(F.from_json(raw, "map<string,string>")), ", ")
    flat = strip(F.regexp_replace(raw, r"\((a|b)\)", ""))
    return F.when(raw.startswith("{"), nested).otherwise(flat)


def classify_error(message: Column, bad_request: Column) -> Column:
    """Error class of a failed call, as the prefix stored in the answer."""
    return (
        F.when(~bad_request, "ERROR_API_CALL")
        .when(message.rlike("context_length_exceeded|maximum context length"),
              "ERROR_CONTEXT_LENGTH_EXCEEDED")
        .when(message.rlike("content_filter|ResponsibleAIPolicyViolation"), "ERROR_CONTENT_FILTER")
        .otherwise("ERROR_BAD_REQUEST")
    )


def parse_verdict(text: Column) -> Column:
    """1 when the reply contains ``yes`` and nowhere ``no``."""
    low = F.lower(text)
    good = F.contains(low, F.lit("yes")) & ~F.contains(low, F.lit("no"))
    return F.when(good, 1.0).otherwise(0.0)


def judge_score(reply: Column) -> Column:
    """Struct of status and a 0..1 score from a JSON judge reply on a 0..5 scale."""
    parsed = F.from_json(reply, "score double, reasoning string")
    good = F.get_json_object(reply, "$").isNotNull() & parsed.isNotNull()
    return F.struct(
        F.when(good, "success").otherwise("error").alias("status"),
        F.when(good, F.coalesce(parsed["score"], F.lit(0.0)) / 5.0).otherwise(0.0).alias("score"),
    )


def final_number(text: Column) -> Column:
    """The number behind ``####`` without thousands commas, NULL without one."""
    pattern = r"#### (-?[0-9.,]+)"
    return F.when(text.rlike(pattern), F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")))


def number_reward(text: Column, truth: Column, format_score: float = 0.1) -> Column:
    found = final_number(text)
    return F.when(found.isNull(), 0.0).when(found == truth, 1.0).otherwise(format_score)


def fill_template(template: Column, question: Column, answer: Column, response: Column) -> Column:
    out = F.replace(template, F.lit("{{question}}"), question)
    out = F.replace(out, F.lit("{{reference_answer}}"), answer)
    return F.replace(out, F.lit("{{model_answer}}"), response)


