"""Incremental processing and batch model calls with a stub."""

from pyspark.sql import functions as F

from convoeval.operators import incremental as I
from convoeval.plans.registry import query, table


def _responses(spark, d):
    return table(spark, d, "events").select(
        F.concat(F.lit("q"), F.get_json_object("props", "$.k"), F.lit("_"), "user_id").alias("qid"),
        F.when(F.col("event_type") == "error", "ERROR_API_CALL: x").otherwise(F.col("event_type")).alias("response"),
        F.col("event_id").alias("line"), F.col("user_id").alias("task_id"),
    )


_R = """r AS (SELECT 'q' || json_extract_string(props, '$.k') || '_' || user_id AS qid,
  CASE WHEN event_type = 'error' THEN 'ERROR_API_CALL: x' ELSE event_type END AS response, event_id AS line, user_id AS task_id FROM events),
done AS (SELECT qid, arg_min(response, line) AS response, min(line) AS line FROM r WHERE NOT starts_with(response, 'ERROR') GROUP BY qid)"""


@query("inc1_completed", f"WITH {_R} SELECT * FROM done")
def inc1(spark, d):
    return I.completed(_responses(spark, d), ["line"]).select("qid", "response", "line")


@query("inc2_remaining", f"WITH {_R} SELECT DISTINCT qid, task_id FROM r WHERE qid NOT IN (SELECT qid FROM done)")
def inc2(spark, d):
    r = _responses(spark, d)
    questions = r.select("qid", "task_id").distinct()
    samples = r.select("task_id").distinct()
    return I.remaining(samples, questions, I.completed(r, ["line"]))[1].select("qid", "task_id")


@query("inc2_remaining_samples", f"WITH {_R} SELECT DISTINCT task_id FROM r WHERE qid NOT IN (SELECT qid FROM done)")
def inc2_samples(spark, d):
    r = _responses(spark, d)
    return I.remaining(r.select("task_id").distinct(), r.select("qid", "task_id").distinct(), I.completed(r, ["line"]))[0]


def _evaluations(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    m = docs.join(table(spark, d, "labels"), "doc_id", "left")
    metric = F.map_filter(
        F.create_map(
            F.lit("quality"), F.col("quality").cast("double"), F.lit("toxic"),
            F.when(F.col("toxic") == 1, -1.0).otherwise(F.col("toxic").cast("double")),
        ),
        lambda k, v: v.isNotNull(),
    )
    return m.select(F.col("doc_id").alias("qid"), metric.alias("metric"))


@query("inc3_audit_completeness", """SELECT d.doc_id AS qid, CASE WHEN l.doc_id IS NULL THEN 'quality,toxic' ELSE 'toxic' END AS missing
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.toxic = 1""")
def inc3(spark, d):
    bad = I.audit_completeness(_evaluations(spark, d), ["quality", "toxic"])
    return bad.withColumn("missing", F.array_join("missing", ","))


@query("inc3_needs_rerun", """SELECT count(*) AS n_evaluated, count(*) FILTER (WHERE l.doc_id IS NULL OR l.toxic = 1) AS n_incomplete,
  (SELECT count(*) FROM pages) AS n_responses, count(*) FILTER (WHERE l.doc_id IS NULL OR l.toxic = 1) > 0 OR count(*) <> (SELECT count(*) FROM pages) AS rerun
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def inc3_rerun(spark, d):
    return I.needs_rerun(table(spark, d, "pages"), _evaluations(spark, d), ["quality", "toxic"])


@query("inc4_latest_evaluation", """SELECT user_id AS agent, event_type AS task, max(event_id) AS line, arg_max(value, event_id) AS value
FROM events GROUP BY ALL""")
def inc4(spark, d):
    e = table(spark, d, "events").select(
        F.col("user_id").alias("agent"), F.col("event_type").alias("task"), F.col("event_id").alias("line"), "value"
    )
    return I.latest(e, ["agent", "task"], ["line"])


@query("inc5_discover_tasks", "SELECT DISTINCT lang AS task FROM documents WHERE lang NOT LIKE '.%'")
def inc5(spark, d):
    return table(spark, d, "documents").select(F.col("lang").alias("task")).where(~F.col("task").startswith(".")).distinct()
