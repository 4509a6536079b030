"""Ledger questions, rollups and ledger validation."""

from pyspark.sql import functions as F

from convoeval.operators import ledger as L
from convoeval.operators import validation as V
from convoeval.plans.registry import query, table
from convoeval.plans.views import SQL_EVENT_LEDGER, SQL_LEDGER, event_ledger, ledger

_YEARS = """years AS (SELECT DISTINCT year(date) AS y FROM ledger),
ranges AS (SELECT y AS qid, make_date(y, 2, 1) AS s, make_date(y, 11, 15) AS e FROM years)"""


def _ranges(tx):
    y = tx.select(F.year("date").alias("qid")).distinct()
    return y.withColumns(
        {"start": F.make_date("qid", F.lit(2), F.lit(1)), "end": F.make_date("qid", F.lit(11), F.lit(15))}
    )


@query("led1_scene_in_range", f"""WITH {SQL_LEDGER}, {_YEARS},
q AS (SELECT DISTINCT y || scene AS qid, scene, make_date(y, 2, 1) AS s, make_date(y, 11, 15) AS e
      FROM (SELECT DISTINCT year(date) AS y, scene FROM ledger))
SELECT q.qid, q.scene, round(coalesce(sum(l.amount), 0.0), 2) AS answer
FROM q LEFT JOIN ledger l ON l.scene = q.scene AND l.date BETWEEN q.s AND q.e GROUP BY q.qid, q.scene""")
def led1(spark, d):
    tx = ledger(spark, d)
    q = (
        tx.select(F.year("date").alias("y"), "scene").distinct()
        .select(
            F.concat("y", "scene").alias("qid"), "scene", F.array("scene").alias("scenes"),
            F.make_date("y", F.lit(2), F.lit(1)).alias("start"),
            F.make_date("y", F.lit(11), F.lit(15)).alias("end"),
        )
    )
    return L.spend(q, L.daily(tx)).select("qid", "scene", "answer")


@query("led2_scene_set_in_range", f"""WITH {SQL_LEDGER}, {_YEARS}
SELECT r.qid, round(coalesce(sum(l.amount), 0.0), 2) AS answer
FROM ranges r LEFT JOIN ledger l ON l.date BETWEEN r.s AND r.e
  AND l.scene IN (SELECT scene FROM (SELECT DISTINCT scene FROM ledger) ORDER BY scene LIMIT 2)
GROUP BY r.qid""")
def led2(spark, d):
    tx = ledger(spark, d)
    two = tx.select("scene").distinct().agg(F.slice(F.array_sort(F.collect_set("scene")), 1, 2)).scalar()
    return L.spend(_ranges(tx).withColumn("scenes", two), L.daily(tx)).select("qid", "answer")


@query("led3_total_in_range", f"""WITH {SQL_LEDGER}, {_YEARS}
SELECT r.qid, round(coalesce(sum(l.amount), 0.0), 2) AS answer
FROM ranges r LEFT JOIN ledger l ON l.date BETWEEN r.s AND r.e GROUP BY r.qid""")
def led3(spark, d):
    tx = ledger(spark, d)
    return L.spend(_ranges(tx), L.daily(tx)).select("qid", "answer")


@query("led4_top_scenes", f"""WITH {SQL_LEDGER}, {_YEARS},
t AS (SELECT r.qid, l.scene, round(sum(l.amount), 2) AS total
      FROM ranges r JOIN ledger l ON l.date BETWEEN r.s AND r.e GROUP BY ALL),
b AS (SELECT qid, string_agg(scene, ', ' ORDER BY scene) AS answer
      FROM (SELECT *, rank() OVER (PARTITION BY qid ORDER BY total DESC) AS k FROM t) WHERE k = 1 GROUP BY qid)
SELECT r.qid, b.answer FROM ranges r LEFT JOIN b USING (qid)""")
def led4(spark, d):
    tx = ledger(spark, d)
    return L.top_scenes(_ranges(tx), L.daily(tx)).select("qid", "answer")


@query("led5_busiest_dates", f"""WITH {SQL_LEDGER},
c AS (SELECT scene, date, count(*) AS n FROM ledger GROUP BY ALL)
SELECT scene, string_agg(CAST(date AS VARCHAR), ', ' ORDER BY date) AS answer
FROM (SELECT *, rank() OVER (PARTITION BY scene ORDER BY n DESC) AS k FROM c) WHERE k = 1 GROUP BY scene""")
def led5(spark, d):
    return L.busiest_dates(L.daily(ledger(spark, d)), [])


@query("led6_largest_single", f"""WITH {SQL_LEDGER}, {_YEARS}
SELECT r.qid, max(l.amount) AS answer FROM ranges r LEFT JOIN ledger l ON l.date BETWEEN r.s AND r.e
GROUP BY r.qid""")
def led6(spark, d):
    tx = ledger(spark, d)
    return L.largest_single(_ranges(tx), L.daily(tx)).select("qid", "answer")


@query("led7_scene_on_date", f"""WITH {SQL_LEDGER},
q AS (SELECT DISTINCT date, s.scene FROM ledger, (SELECT DISTINCT scene FROM ledger) s)
SELECT CAST(q.date AS VARCHAR) || q.scene AS qid, round(coalesce(sum(l.amount), 0.0), 2) AS answer
FROM q LEFT JOIN ledger l ON l.date = q.date AND l.scene = q.scene GROUP BY q.date, q.scene""")
def led7(spark, d):
    tx = ledger(spark, d)
    scenes = tx.select("scene").distinct().agg(F.collect_set("scene")).scalar()
    q = tx.select("date").distinct().withColumn("scene", F.explode(scenes))
    q = q.withColumn("qid", F.concat(F.col("date").cast("string"), "scene"))
    return L.on_date(q, L.daily(tx)).select("qid", "answer")


@query("led8_grand_total", f"WITH {SQL_LEDGER} SELECT round(sum(amount), 2) AS answer FROM ledger")
def led8(spark, d):
    return ledger(spark, d).agg(F.round(F.sum("amount"), 2).alias("answer"))


@query("led9_rollups", f"""WITH {SQL_LEDGER}
SELECT date, scene, subscene, CAST(grouping(date, scene, subscene) AS INTEGER) AS level,
       round(sum(amount), 2) AS amount, count(*) AS n
FROM ledger GROUP BY GROUPING SETS ((scene), (scene, subscene), (date), (date, scene))""")
def led9(spark, d):
    return L.rollups(ledger(spark, d))


@query("led10_make_questions")
def led10(spark, d):
    return L.make_questions(
        event_ledger(spark, d), ["signup", "error", "click", "view", "purchase"], seed=7
    )


@query("led11_sample_dates", f"""WITH {SQL_EVENT_LEDGER},
s AS (SELECT task_id, unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM event_ledger GROUP BY task_id),
r AS (SELECT task_id, CAST(CAST(d AS DATE) AS VARCHAR) AS day, row_number() OVER (PARTITION BY task_id
  ORDER BY CAST('0x' || left(md5('7|' || CAST(CAST(d AS DATE) AS VARCHAR)), 15) AS BIGINT)) AS k FROM s)
SELECT task_id, string_agg(day, ',' ORDER BY day) AS days FROM r WHERE k <= 5 GROUP BY task_id""")
def led11(spark, d):
    spans = event_ledger(spark, d).groupBy("task_id").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return spans.select("task_id", F.array_join(L.sample_dates(F.col("a"), F.col("b"), 5, 7), ",").alias("days"))


@query("led12_ledger_summary", f"""WITH {SQL_EVENT_LEDGER}
SELECT task_id, count(DISTINCT date) AS num_sessions, count(*) AS num_transactions, min(date) AS start,
       max(date) AS "end", round(sum(amount), 2) AS total_amount
FROM event_ledger GROUP BY task_id""")
def led12(spark, d):
    return L.summary(event_ledger(spark, d), ["task_id"], "date")


@query("led13_take_until", """WITH s AS (
  SELECT l_orderkey AS sample, count(*) AS n_questions FROM lineitem GROUP BY l_orderkey),
r AS (SELECT *, sum(n_questions) OVER (ORDER BY sample) AS run, row_number() OVER (ORDER BY sample) AS rn FROM s)
SELECT sample, n_questions FROM r WHERE run - n_questions < 7000 AND rn <= 70""")
def led13(spark, d):
    sizes = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sample")).agg(
        F.count("*").alias("n_questions")
    )
    return L.take_until(sizes, "sample", "n_questions", n=7000, cap=70)


@query("val1_category_distribution", """
SELECT event_type AS category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent
FROM events GROUP BY event_type""")
def val1(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("category"))
    return V.distribution(e, "category")


_VAL_TX = """tx AS (
  SELECT user_id AS task_id, event_id AS ord,
         CASE WHEN event_type = 'error' THEN strftime(ts, '%Y/%m/%d') ELSE strftime(ts, '%Y-%m-%d') END AS date_text,
         value - 5.0 AS amount
  FROM events)"""


@query("val2_transaction_findings", f"""WITH {_VAL_TX}
SELECT c_custkey AS task_id, NULL AS ord, 'no transactions' AS finding FROM customer
WHERE c_custkey NOT IN (SELECT task_id FROM tx)
UNION ALL SELECT task_id, ord, 'amount not positive' FROM tx WHERE amount <= 0
UNION ALL SELECT task_id, ord, 'bad date' FROM tx WHERE try_strptime(date_text, '%Y-%m-%d') IS NULL""")
def val2(spark, d):
    e = table(spark, d, "events")
    tx = e.select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("ord"),
        F.when(F.col("event_type") == "error", F.date_format("ts", "yyyy/MM/dd"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date_text"),
        (F.col("value") - 5.0).alias("amount"),
    )
    samples = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"))
    return V.transaction_findings(samples, tx)


@query("val3_total_mismatches", """WITH s AS (
  SELECT o_orderkey AS task_id, o_totalprice AS answer FROM orders),
t AS (SELECT l_orderkey AS task_id, sum(l_extendedprice) AS expected FROM lineitem GROUP BY l_orderkey)
SELECT task_id, answer, round(expected, 2) AS expected FROM s JOIN t USING (task_id)
WHERE abs(expected - answer) > 0.01""")
def val3(spark, d):
    answers = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_totalprice").alias("answer"))
    tx = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_extendedprice").alias("amount"))
    return V.total_mismatches(answers, tx).withColumn("expected", F.round("expected", 2))


@query("val4_chunk_count", """
SELECT conv_id AS task_id, max(turn) + 1 AS num_sessions, count(*) FILTER (WHERE role <> 'system') AS n_chunks
FROM conversations GROUP BY conv_id
HAVING max(turn) + 1 <> count(*) FILTER (WHERE role <> 'system')""")
def val4(spark, d):
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), "turn", "role")
    samples = t.groupBy("task_id").agg((F.max("turn") + 1).alias("num_sessions"))
    return V.chunk_count_mismatches(samples, t.where("role <> 'system'"))


@query("val5_question_position", """WITH q AS (
  SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last_position, role FROM conversations)
SELECT conv_id AS task_id, 'q' || conv_id || '_' || turn AS qid, turn AS position, last_position
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r
      FROM q WHERE role = 'user' AND turn <> last_position) WHERE r = 1""")
def val5(spark, d):
    t = table(spark, d, "conversations").select(
        F.col("conv_id").alias("task_id"), F.col("turn").alias("position"), "role"
    )
    q = t.where("role = 'user'").withColumns(
        {"qid": F.concat(F.lit("q"), "task_id", F.lit("_"), "position"), "ord": F.col("position")}
    )
    return V.position_offenders(q, t)


_VAL6 = """tx AS (
  SELECT e.user_id AS task_id, e.event_id AS ord, e.event_type AS scene, e.value AS amount
  FROM events e),
ch AS (SELECT user_id AS task_id, CASE WHEN event_id % 11 = 0 THEN 'a ' || event_type ELSE '' END || props AS text
       FROM events)"""


@query("val6_unmentioned", f"""WITH {_VAL6}
SELECT task_id, ord, scene, amount FROM tx WHERE NOT EXISTS (
  SELECT 1 FROM ch WHERE ch.task_id = tx.task_id AND (
    contains(lower(ch.text), lower(tx.scene)) OR contains(ch.text, CAST(tx.amount AS VARCHAR))
    OR contains(ch.text, printf('%.2f', tx.amount)) OR contains(ch.text, CAST(CAST(floor(tx.amount) AS BIGINT) AS VARCHAR))))""")
def val6(spark, d):
    tx = table(spark, d, "events").select(
        F.col("user_id").alias("task_id"), F.col("event_id").alias("ord"),
        F.col("event_type").alias("scene"), F.col("value").alias("amount"),
    )
    kind = F.when(F.col("event_id") % 11 == 0, F.concat(F.lit("a "), "event_type")).otherwise("")
    chunks = table(spark, d, "events").select(
        F.col("user_id").alias("task_id"), F.concat(kind, "props").alias("text")
    )
    return V.unmentioned(tx, chunks)
