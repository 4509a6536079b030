"""Aggregates and report tables."""

from pyspark.sql import functions as F

from convoeval.operators import reports
from convoeval.plans.registry import query, table
from convoeval.plans.views import SQL_SCORES, long_scores, scores

LANGS = ["de", "en", "es", "fr"]


@query("agg1_mean_valid", f"""WITH {SQL_SCORES}
SELECT agent, metric, round(avg(nullif(value, -1)), 6) AS avg_value, count(nullif(value, -1)) AS n_valid
FROM long_scores GROUP BY agent, metric""")
def agg1(spark, d):
    return reports.mean_valid(long_scores(spark, d), ["agent"])


_STRICT = "CASE WHEN bool_or(value = -1) THEN -1.0 ELSE {} END"


@query("agg2_strict_mean", f"""WITH {SQL_SCORES}
SELECT agent, task, metric, round({_STRICT.format('avg(value)')}, 6) AS avg_value,
       round({_STRICT.format('sum(value)')}, 6) AS total_value, count(*) AS n
FROM long_scores GROUP BY agent, task, metric""")
def agg2(spark, d):
    return reports.strict_mean(long_scores(spark, d), ["agent", "task"])


@query("agg3_strict_mean_by_category", f"""WITH {SQL_SCORES}
SELECT agent, metric, category, CAST(grouping(category) AS INTEGER) AS is_total,
       round({_STRICT.format('avg(value)')}, 6) AS avg_value, count(*) AS n
FROM long_scores
GROUP BY GROUPING SETS ((agent, metric), (agent, metric, category))""")
def agg3(spark, d):
    return reports.strict_mean_levels(long_scores(spark, d), ["agent"], "category")


@query("agg4_question_total", f"""WITH {SQL_SCORES},
counts AS (SELECT agent, category, metric, count(*) AS n, min(qid) AS first_qid
           FROM long_scores GROUP BY ALL),
firsts AS (SELECT agent, n, row_number() OVER (PARTITION BY agent, category ORDER BY first_qid, metric) AS r
           FROM counts)
SELECT agent, CAST(sum(n) AS BIGINT) AS total_questions FROM firsts WHERE r = 1 GROUP BY agent""")
def agg4(spark, d):
    return reports.question_total(long_scores(spark, d), ["agent"])


@query("agg5_task_category_rules", f"""WITH {SQL_SCORES},
rules AS (SELECT DISTINCT lang AS task, 'cat' || (doc_id % 3) AS category
          FROM documents WHERE lang IN ('de', 'es') AND doc_id % 3 = 1)
SELECT agent, task, category, metric, count(*) AS n
FROM long_scores s
WHERE task NOT IN (SELECT task FROM rules)
   OR EXISTS (SELECT 1 FROM rules r WHERE r.task = s.task AND r.category = s.category)
GROUP BY ALL""")
def agg5(spark, d):
    rules = scores(spark, d).where("task IN ('de', 'es') AND category = 'cat1'").select("task", "category")
    kept = reports.filter_by_rules(long_scores(spark, d), rules)
    return kept.groupBy("agent", "task", "category", "metric").agg(F.count("*").alias("n"))


@query("agg6_metric_table", f"""WITH {SQL_SCORES}
SELECT agent, round(CASE WHEN bool_or(quality = -1) THEN -1.0 ELSE avg(quality) END, 6) AS quality,
       round(CASE WHEN bool_or(toxic = -1) THEN -1.0 ELSE avg(toxic) END, 6) AS toxic,
       CAST(-1.0 AS DOUBLE) AS llm_score
FROM scores GROUP BY agent""")
def agg6(spark, d):
    return reports.metric_table(long_scores(spark, d), ["agent"], ["quality", "toxic", "llm_score"])


@query("agg7_category_metric_table", f"""WITH {SQL_SCORES}
SELECT category, agent,
       round(CASE WHEN bool_or(quality = -1) THEN -1.0 ELSE avg(quality) END, 6) AS quality,
       round(CASE WHEN bool_or(toxic = -1) THEN -1.0 ELSE avg(toxic) END, 6) AS toxic
FROM scores GROUP BY category, agent""")
def agg7(spark, d):
    return reports.metric_table(long_scores(spark, d), ["category", "agent"], ["quality", "toxic"])


#: Tasks of few documents each: some have a missing score, some do not.
_CELLS = """cells AS (SELECT agent, task || (qid % 12) AS task, CASE WHEN bool_or(value = -1) THEN -1.0 ELSE avg(value) END AS score
          FROM long_scores WHERE metric = 'quality' GROUP BY ALL),
best AS (SELECT task, max(nullif(score, -1)) AS best FROM cells GROUP BY task),
means AS (SELECT agent, avg(nullif(score, -1)) AS agent_avg FROM cells GROUP BY agent)"""


def _fine(spark, d):
    return long_scores(spark, d).withColumn("task", F.concat("task", (F.col("qid") % 12).cast("string")))


@query("agg8_leaderboard", f"""WITH {SQL_SCORES}, {_CELLS}
SELECT c.agent, c.task, round(c.score, 6) AS score, round(m.agent_avg, 6) AS agent_avg,
       coalesce(c.score <> -1 AND abs(c.score - b.best) < 1e-6, FALSE) AS best_in_task,
       coalesce(abs(m.agent_avg - (SELECT max(agent_avg) FROM means)) < 1e-6, FALSE) AS best_average
FROM cells c JOIN best b USING (task) JOIN means m USING (agent)""")
def agg8(spark, d):
    return reports.leaderboard(_fine(spark, d), "quality")


_WIDE = ", ".join(f"round(max(CASE WHEN task = '{x}{i}' THEN nullif(score, -1) END), 6) AS {x}{i}" for x in LANGS for i in range(12))


@query("agg8_leaderboard_wide", f"""WITH {SQL_SCORES}, {_CELLS}
SELECT agent, round(agent_avg, 6) AS agent_avg, {_WIDE}
FROM cells JOIN means USING (agent) GROUP BY agent, agent_avg""")
def agg8_wide(spark, d):
    return reports.leaderboard_wide(_fine(spark, d), "quality", [f"{x}{i}" for x in LANGS for i in range(12)])


@query("agg9_presence_matrix", """
SELECT source AS agent,
       CAST(bool_or(lang = 'de') AS INTEGER) AS de, CAST(bool_or(lang = 'en') AS INTEGER) AS en,
       CAST(bool_or(lang = 'es') AS INTEGER) AS es, CAST(bool_or(lang = 'fr') AS INTEGER) AS fr
FROM documents WHERE n_chars > 2000 OR doc_id IN (SELECT doc_id FROM labels) GROUP BY source""")
def agg9(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source", "lang")
    responses = docs.where("n_chars > 2000")
    evaluated = docs.join(table(spark, d, "labels"), "doc_id", "left_semi")
    outputs = responses.unionByName(evaluated).select(
        F.col("source").alias("agent"), F.col("lang").alias("task")
    )
    return reports.presence_matrix(outputs, LANGS)


@query("agg10_scaling_series", f"""WITH {SQL_SCORES},
named AS (SELECT agent, 'synth-ss' || (1 + qid % 7) AS task, quality FROM scores),
cells AS (SELECT agent, task, avg(nullif(quality, -1)) AS score FROM named GROUP BY agent, task)
SELECT agent, CAST(regexp_extract(task, '^synth-ss(\\d+)', 1) AS INTEGER) AS sessions,
       round(score, 6) AS score
FROM cells WHERE score IS NOT NULL""")
def agg10(spark, d):
    named = scores(spark, d).withColumn("task", F.concat(F.lit("synth-ss"), F.col("qid") % 7 + 1))
    cells = named.groupBy("agent", "task").agg(F.avg(reports.valid("quality")).alias("score"))
    return reports.scaling_series(cells).withColumn("score", F.round("score", 6))


@query("agg11_timing", """WITH b AS (
  SELECT user_id AS task_id, CAST(ts AS DATE) AS position, count(*) AS n, max(value) AS duration
  FROM events GROUP BY ALL)
SELECT task_id, round(avg(duration / n), 9) AS avg_generation_time,
       round(sum(duration), 6) AS total_time, CAST(sum(n) AS BIGINT) AS questions
FROM b GROUP BY task_id""")
def agg11(spark, d):
    batches = table(spark, d, "events").select(
        F.col("user_id").alias("task_id"), F.to_date("ts").alias("position"),
        F.col("value").alias("duration"),
    )
    timed = reports.question_timing(batches)
    return timed.groupBy("task_id").agg(
        F.round(F.avg("generation_time"), 9).alias("avg_generation_time"),
        F.round(F.sum("duration"), 6).alias("total_time"),
        F.sum("n").alias("questions"),
    )


@query("agg12_judge_summary", """
SELECT count(*) AS total_items, count(CASE WHEN status = 'success' THEN score END) AS evaluated_items,
       coalesce(round_even(avg(CASE WHEN status = 'success' THEN score END), 4), 0.0) AS average_score
FROM (SELECT value AS score, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status
      FROM events)""")
def agg12(spark, d):
    details = table(spark, d, "events").select(
        F.col("value").alias("score"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"),
    )
    return reports.judge_summary(details)
