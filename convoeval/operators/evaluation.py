"""Scoring of response tables: cheap metrics, reuse of costly ones, averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoeval.functions import scoring as S
from convoeval.functions.text import normalise_answer, words
from convoeval.operators.reports import MISSING, mean_valid

# Tasks whose answers are comma separated keywords, costly metrics.
KEYWORD_TASKS = ("booksum", "infbench")
COSTLY = ["bert_score", "llm_score"]


def expected_metrics(task: str) -> list[str]:
    base = [*S.METRICS, "bert_score", "rouge_score", "llm_score"]
    return [*base, "keyword_hit_rate"] if task in KEYWORD_TASKS else base


def with_tokens(df: DataFrame, response: str = "response", expected: str = "expected") -> DataFrame:
    """Adds normalised texts ``_pred``, ``_gold`` and their tokens ``_p``, ``_g``.

    The steps are separate projections on purpose: each text is cleaned once per
    row and the metrics refer to finished columns.
    """
    sides = df.withColumns(
        {"_pred": normalise_answer(F.col(response)), "_gold": normalise_answer(F.col(expected))}
    )
    return sides.withColumns({"_p": words(F.col("_pred")), "_g": words(F.col("_gold"))})


def token_scores(df: DataFrame, response: str = "response", expected: str = "expected") -> DataFrame:
    """Adds precision, recall, F1, set match and containment."""
    m = S.token_metrics(F.col("_p"), F.col("_g"), F.col("_pred"), F.col("_gold"))
    out = with_tokens(df, response, expected).withColumn("_m", m)
    out = out.withColumns({m: F.coalesce(F.col(f"_m.{m}"), F.lit(MISSING)) for m in S.METRICS})
    return out.drop("_m", "_p", "_g", "_pred", "_gold")


def keyword_scores(df: DataFrame, response: str = "response", expected: str = "expected") -> DataFrame:
    """Adds the keyword hit rate."""
    low = df.withColumn("_low", F.lower(F.col(response)))
    rate = S.keyword_hit_rate(F.col("_low"), F.col(expected))
    return low.withColumn("keyword_hit_rate", F.coalesce(rate, F.lit(MISSING))).drop("_low")


def score_answers(df: DataFrame, task: str, rouge: bool = True, stemmed: bool = True) -> DataFrame:
    """Adds every computed metric for ``response`` against ``expected``.

    Native columns come first, the one Arrow stage (ROUGE-L) sits on top of them.
    A metric that fails is -1 at the output.
    """
    out = token_scores(df)
    if task in KEYWORD_TASKS:
        out = keyword_scores(out)
    if rouge:
        out = out.withColumn("rouge_score", S.rouge_l(F.col("response"), F.col("expected"), stemmed))
    return out


def average_scores(scored: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    long = scored.select(*keys, *metrics).unpivot(keys, metrics, "metric", "value")
    return mean_valid(long, keys)


def reuse_costly(responses: DataFrame, old: DataFrame, metrics: list[str] = COSTLY) -> DataFrame:
    """Left joins valid old costly metrics by ``qid``; NULL means to compute."""
    kept = old.select("qid", *[F.nullif(F.col(m), F.lit(MISSING)).alias(m) for m in metrics])
    return responses.join(kept, "qid", "left")


def rescore(responses: DataFrame, old: DataFrame, compute, metrics: list[str] = COSTLY) -> DataFrame:
    """Runs ``compute(rows) -> rows`` only on rows that lack a costly metric.

    ``compute`` gets the rows without a valid old value and returns ``qid`` and
    the metrics; the results fill the gaps, valid old values stay.
    """
    joined = reuse_costly(responses, old, metrics)
    todo = joined.where(" OR ".join(f"{m} IS NULL" for m in metrics)).drop(*metrics)
    fresh = compute(todo).select("qid", *[F.col(m).alias(f"_new_{m}") for m in metrics])
    out = joined.join(fresh, "qid", "left")
    filled = {m: F.coalesce(F.col(m), F.col(f"_new_{m}"), F.lit(MISSING)) for m in metrics}
    return out.withColumns(filled).drop(*[f"_new_{m}" for m in metrics])
