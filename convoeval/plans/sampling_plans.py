"""Sampling and training tables."""

from pyspark.sql import functions as F

from convoeval.operators import sampling as S
from convoeval.plans.join_plans import chunks_and_questions
from convoeval.plans.registry import query, table


def _orders(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("qid"), F.col("o_custkey").alias("task_id"), F.col("o_orderpriority").alias("category")
    )


def sql_draw(seed, *ids):
    text = " || '|' || ".join([f"'{seed}'", *ids])
    return f"CAST('0x' || left(md5({text}), 15) AS BIGINT)"


@query("smp1_small_set", f"""WITH n AS (SELECT o_custkey AS task_id, count(*) AS n FROM orders
    JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey),
r AS (SELECT *, sum(n) OVER (ORDER BY {sql_draw(3, 'task_id')}, task_id) - n AS before FROM n),
q AS (SELECT o_orderkey AS qid, task_id, o_orderpriority AS category, before,
        row_number() OVER (PARTITION BY task_id ORDER BY {sql_draw(4, 'o_orderkey')}, o_orderkey) AS k
      FROM orders JOIN r ON task_id = o_custkey WHERE before < 100)
SELECT qid, task_id, category FROM q WHERE k <= 100 - before""")
def smp1(spark, d):
    samples = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"))
    return S.small_set(samples, _orders(spark, d), n=100, seed=3)


@query("smp2_cap_questions", f"""SELECT qid, task_id, category FROM (
  SELECT o_orderkey AS qid, o_custkey AS task_id, o_orderpriority AS category,
    row_number() OVER (PARTITION BY o_custkey ORDER BY {sql_draw(0, 'o_orderkey')}, o_orderkey) AS k FROM orders) WHERE k <= 10""")
def smp2(spark, d):
    return S.cap_questions(_orders(spark, d))


@query("smp3_stratified", f"""WITH i AS (SELECT l_returnflag AS data_source,
  l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS row_id FROM lineitem)
SELECT data_source, row_id FROM (SELECT *, row_number() OVER (PARTITION BY data_source
  ORDER BY {sql_draw(0, 'row_id')}, row_id) AS k FROM i) WHERE k <= 20""")
def smp3(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("data_source"),
        F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
    )
    return S.stratified(rows, "data_source", "row_id")


@query("smp4_exclude_sources", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src1', 'src2')")
def smp4(spark, d):
    return S.exclude_sources(table(spark, d, "documents"), "source", ["src1", "src2"]).select("doc_id", "source")


@query("smp5_batch_questions", """WITH r AS (
  SELECT o_custkey AS task_id, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT task_id, i // 10 AS batch_index, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS question_ids
FROM r GROUP BY ALL""")
def smp5(spark, d):
    q = _orders(spark, d).select(
        "task_id", "qid", F.col("qid").alias("ord"), F.col("category").alias("query"), F.col("category").alias("answer")
    )
    return S.batch_questions(q, 10).select("task_id", "batch_index", F.array_join("question_ids", ",").alias("question_ids"))


@query("smp6_training_rows", """WITH q AS (
  SELECT conv_id AS task_id, turn, conv_id || '_' || turn AS qid, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i
  FROM conversations WHERE role = 'user'),
b AS (SELECT task_id, i // 2 AS batch_index, string_agg(qid, ',' ORDER BY i) AS question_ids, string_agg(text, '|' ORDER BY i) AS content FROM q GROUP BY ALL),
c AS (SELECT conv_id AS task_id, count(*) AS num_chunks, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id)
SELECT task_id, batch_index, question_ids, content, context, num_chunks, 'set' AS data_source, 'agent' AS agent_name FROM b JOIN c USING (task_id)""")
def smp6(spark, d):
    chunks, questions = chunks_and_questions(spark, d)
    q = questions.select("task_id", "qid", F.col("position").alias("ord"), "query", F.col("query").alias("answer"))
    rows = S.training_rows(chunks, q, "set", "agent", k=2)
    return rows.select(
        F.col("extra_info.task_id").alias("task_id"), F.col("extra_info.batch_index").alias("batch_index"),
        F.array_join("extra_info.question_ids", ",").alias("question_ids"),
        F.array_join(F.get("prompt", F.lit(0))["content"], "|").alias("content"),
        "context", F.col("extra_info.num_chunks").alias("num_chunks"), "data_source", "agent_name",
    )


@query("smp7_profile_training", """WITH c AS (SELECT source AS data_source, count(*) AS n FROM documents GROUP BY source)
SELECT data_source, n, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS n_rows, (SELECT count(*) FROM c) AS n_sources
FROM c ORDER BY n DESC, data_source LIMIT 10""")
def smp7(spark, d):
    return S.profile_training(table(spark, d, "documents").withColumnRenamed("source", "data_source"))


@query("smp8_drop_uniform_groups", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING min(l_returnflag) <> max(l_returnflag))""")
def smp8(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    return S.drop_uniform_groups(rows, "l_orderkey", "l_returnflag").drop("l_returnflag")


@query("smp9_group_relative", """WITH s AS (SELECT l_orderkey, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((l_quantity - m) / (coalesce(sd, 0.0) + 0.000001), 5) AS advantage
FROM lineitem JOIN s USING (l_orderkey)""")
def smp9(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    out = S.group_relative(rows, "l_orderkey", "l_quantity").withColumn("advantage", F.round("advantage", 5))
    return out.drop("l_quantity")


@query("smp10_overlong_penalty", """
SELECT doc_id, round(least(-(n_chars - (4000 - 1000)) / CAST(1000 AS DOUBLE), 0.0), 6) AS penalty FROM documents""")
def smp10(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.round(S.overlong_penalty(F.col("n_chars"), 4000, 1000), 6).alias("penalty")
    )
