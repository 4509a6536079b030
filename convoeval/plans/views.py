"""How the given tables stand for conversations, scores, ledgers and corpora.

Every view has a DataFrame form and the same thing as SQL text for the twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoeval.functions.text import PUNCTUATION
from convoeval.plans.registry import table

# SQL spelling of the text kernels -----------------------------------------
SQL_SPACE = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_SQL_PUNCT = PUNCTUATION.replace("'", "''")


def sql_words(text: str) -> str:
    spaced = f"regexp_replace({text}, '{SQL_SPACE}+', ' ', 'g')"
    return f"list_filter(string_split({spaced}, ' '), lambda w: w <> '')"


def sql_plain(text: str) -> str:
    return f"translate(lower({text}), '{_SQL_PUNCT}', '')"


def sql_tokens(text: str) -> str:
    return sql_words(sql_plain(text))


def sql_collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '{SQL_SPACE}+', ' ', 'g'))"


def sql_normal(text: str) -> str:
    return sql_collapse(sql_plain(text))


def sql_strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{SQL_SPACE}+', ''), '{SQL_SPACE}+$', '')"


# question and answer pairs: a user turn and the assistant turn behind it -----
def qa_pairs(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("expected")
    )
    given = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("response"))
    return asked.join(given, ["conv_id", "turn"]).withColumn(
        "qid", F.concat_ws("_", F.lit("conv"), "conv_id", "turn")
    )


SQL_PAIRS = """pairs AS (
  SELECT a.conv_id, a.turn, u.text AS expected, a.text AS response,
         'conv_' || a.conv_id || '_' || a.turn AS qid
  FROM conversations a JOIN conversations u
    ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
  WHERE a.role = 'assistant' AND u.role = 'user')"""


# scores: agent = source, task = lang, an unlabelled document is -1 -----------
def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Wide evaluation records, one row per document."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source")
    labels = table(spark, folder, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("agent"),
        F.col("lang").alias("task"),
        F.col("doc_id").alias("qid"),
        F.concat(F.lit("cat"), F.col("doc_id") % 3).alias("category"),
        F.coalesce(F.col("quality").cast("double"), F.lit(-1.0)).alias("quality"),
        F.coalesce(F.col("toxic").cast("double"), F.lit(-1.0)).alias("toxic"),
    )


def long_scores(spark: SparkSession, folder: str) -> DataFrame:
    return scores(spark, folder).unpivot(
        ["agent", "task", "qid", "category"], ["quality", "toxic"], "metric", "value"
    )


SQL_SCORES = """scores AS (
  SELECT d.source AS agent, d.lang AS task, d.doc_id AS qid, 'cat' || (d.doc_id % 3) AS category,
         coalesce(CAST(l.quality AS DOUBLE), -1.0) AS quality,
         coalesce(CAST(l.toxic AS DOUBLE), -1.0) AS toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
long_scores AS (
  SELECT agent, task, qid, category, 'quality' AS metric, quality AS value FROM scores
  UNION ALL
  SELECT agent, task, qid, category, 'toxic' AS metric, toxic AS value FROM scores)"""


# the large ledger: line items; order = session --------------------------------
def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("session"),
        F.to_date("l_shipdate").alias("date"),
        F.col("l_returnflag").alias("scene"),
        F.col("l_linestatus").alias("subscene"),
        F.col("l_extendedprice").alias("amount"),
    )


SQL_LEDGER = """ledger AS (
  SELECT l_orderkey AS session, CAST(l_shipdate AS DATE) AS date, l_returnflag AS scene,
         l_linestatus AS subscene, l_extendedprice AS amount
  FROM lineitem)"""


# the event ledger: task = user, scene = event type -----------------------------
def event_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("task_id"),
        F.col("event_id").alias("ord"),
        F.to_date("ts").alias("date"),
        F.col("event_type").alias("scene"),
        F.col("value").alias("amount"),
    )


SQL_EVENT_LEDGER = """event_ledger AS (
  SELECT user_id AS task_id, event_id AS ord, CAST(ts AS DATE) AS date, event_type AS scene,
         value AS amount
  FROM events)"""


# narratives: corpus = user, record = event ---------------------------------------
def narrative(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select(
        F.col("user_id").alias("corpus"),
        F.col("event_id").alias("ord"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col("event_type").alias("location"),
        F.col("props").alias("action"),
        F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("dialogue"),
        F.when(F.col("event_id") % 5 == 0, F.col("value").cast("string")).alias("environment"),
    )


SQL_NARRATIVE = """narrative AS (
  SELECT user_id AS corpus, event_id AS ord, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
         event_type AS location, props AS action,
         CASE WHEN event_id % 3 = 0 THEN event_type END AS dialogue,
         CASE WHEN event_id % 5 = 0 THEN CAST(value AS VARCHAR) END AS environment
  FROM events)"""

NARRATIVE_FIELDS = ["action", "dialogue", "environment"]


# memory edits: event types stand for verbs ------------------------------------------
def memory_edits(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.col("event_type")
    verb = (
        F.when(kind == "signup", "ADD").when(kind == "purchase", "UPDATE")
        .when(kind == "error", "DELETE").otherwise("TOUCH")
    )
    return e.select(
        F.col("user_id").alias("key"),
        F.col("event_id").alias("seq"),
        verb.alias("operation"),
        F.get_json_object("props", "$.k").alias("target_id"),
        F.when(kind.isin("signup", "purchase"), F.format_string("v%d", "event_id")).alias("content"),
        F.date_format("ts", "yyyy-MM-dd").alias("mentioned_at"),
    )


SQL_EDITS = """edits AS (
  SELECT user_id AS key, event_id AS seq,
         CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'purchase' THEN 'UPDATE'
                         WHEN 'error' THEN 'DELETE' ELSE 'TOUCH' END AS operation,
         json_extract_string(props, '$.k') AS target_id,
         CASE WHEN event_type IN ('signup', 'purchase') THEN 'v' || event_id END AS content,
         strftime(ts, '%Y-%m-%d') AS mentioned_at
  FROM events)"""
