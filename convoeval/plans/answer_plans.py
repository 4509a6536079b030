"""Answer post-processing."""

from pyspark.sql import functions as F

from convoeval.functions import answers as A
from convoeval.operators import prompts as P
from convoeval.plans.join_plans import chunks_and_questions
from convoeval.plans.registry import query, table
from convoeval.plans.views import sql_strip


def _turns(spark, d):
    return table(spark, d, "conversations")


@query("ans1_strip_think", f"""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN {sql_strip('text')} WHEN 1 THEN NULL ELSE text END AS answer FROM conversations""")
def ans1(spark, d):
    raw = (
        F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>a</think> b</think>\n"), "text"))
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("<think>"), "text")).otherwise(F.col("text"))
    )
    return _turns(spark, d).select("conv_id", "turn", A.strip_think(raw).alias("answer"))


@query("ans2_extract_boxed", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN event_type WHEN 2 THEN CAST(user_id AS VARCHAR)
  WHEN 3 THEN 'no box ' || event_type ELSE 'x' || user_id END AS answer FROM events""")
def ans2(spark, d):
    n = F.col("event_id") % 5
    raw = (
        F.when(n == 0, F.concat(F.lit("first \\boxed{no} then \\boxed{ "), "props", F.lit(" } done } end")))
        .when(n == 1, F.concat(F.lit("so \\boxed{\\text{"), "event_type", F.lit("}} ok")))
        .when(n == 2, F.concat(F.lit("$\\boxed "), "user_id", F.lit(" $ tail")))
        .when(n == 3, F.concat(F.lit("no box "), "event_type"))
        .otherwise(F.concat(F.lit("\\box{x"), "user_id", F.lit("} and \\boxed{open")))
    )
    return table(spark, d, "events").select("event_id", A.extract_boxed(raw).alias("answer"))


@query("ans3_extract_tag", f"""SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN NULL ELSE {sql_strip('text')} END AS answer FROM conversations""")
def ans3(spark, d):
    raw = F.when(F.col("turn") % 4 == 3, F.col("text")).otherwise(
        F.concat(F.lit("a <answer>"), "text", F.lit("</answer> b <answer>z</answer>"))
    )
    return _turns(spark, d).select("conv_id", "turn", A.extract_tag(raw).alias("answer"))


@query("ans4_parse_batch_answers", """SELECT event_id, 0 AS i, event_type AS answer FROM events
UNION ALL SELECT event_id, 1, CASE WHEN event_type <> 'view' THEN user_id || ', k' END FROM events
UNION ALL SELECT event_id, 2, CAST(user_id AS VARCHAR) FROM events""")
def ans4(spark, d):
    raw = F.concat(
        F.lit("```json\n{'0': '(a) "), "event_type",
        F.when(F.col("event_type") != "view", F.concat(F.lit("', '1': {'x': '"), "user_id", F.lit("', 'y': 'k'}, '2': "))).otherwise("', '2': "),
        F.col("user_id").cast("string"), F.lit("}\n```"),
    )
    replies = table(spark, d, "events").select("event_id", raw.alias("reply"))
    return P.parse_batch_answers(replies, ["event_id"], "reply", 3)


@query("ans5_classify_error", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'ERROR_API_CALL'
  WHEN event_type = 'click' THEN 'ERROR_CONTEXT_LENGTH_EXCEEDED' WHEN event_type = 'error' THEN 'ERROR_CONTENT_FILTER'
  ELSE 'ERROR_BAD_REQUEST' END AS class, FALSE AS completed FROM events""")
def ans5(spark, d):
    kind = F.col("event_type")
    message = (
        F.when(kind == "click", "maximum context length is 8").when(kind == "error", "ResponsibleAIPolicyViolation")
        .otherwise("context of other kind")
    )
    c = A.classify_error(message, kind != "view")
    return table(spark, d, "events").select("event_id", c.alias("class"), (~c.startswith("ERROR")).alias("completed"))


@query("ans6_parse_verdict", """SELECT conv_id, turn, CAST(CASE WHEN contains(lower(text), 'yes') AND NOT contains(lower(text), 'no') THEN 1.0 ELSE 0.0 END
  + CASE WHEN turn % 2 = 0 AND NOT contains(lower(text), 'no') AND NOT contains(lower(text), 'yes') THEN 1.0 ELSE 0.0 END AS DOUBLE) AS verdict
FROM conversations""")
def ans6(spark, d):
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Yes, "), "text")).otherwise(F.col("text"))
    return _turns(spark, d).select("conv_id", "turn", A.parse_verdict(reply).alias("verdict"))


@query("ans7_normalise_judge", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'error' ELSE 'success' END AS status,
  CAST(CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE (p_size % 6) / 5.0 END AS DOUBLE) AS score FROM part""")
def ans7(spark, d):
    reply = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("score "), "p_size")).otherwise(
        F.concat(F.lit('{"score": '), F.col("p_size") % 6, F.lit(', "reasoning": "'), "p_name", F.lit('"}'))
    )
    j = table(spark, d, "part").select("p_partkey", A.judge_score(reply).alias("j"))
    return j.select("p_partkey", "j.status", "j.score")




def rubric_texts(spark, d):
    """The rubric file as lines derived from the part types."""
    head = F.when(F.col("p_type") == "LARGE", "# type LARGE\nRate {{model_answer}}\n").otherwise(
        "intro\n# type MEDIUM、ECONOMY\nJudge {{question}} against {{reference_answer}}: {{model_answer}}\n"
    )
    kinds = table(spark, d, "part").where("p_type IN ('MEDIUM', 'LARGE')")
    return kinds.select(head.alias("text")).distinct()


@query("ans8_judge_prompt", """SELECT p_partkey, CASE WHEN p_type = 'LARGE' THEN 'Rate ' || p_brand
  ELSE 'Judge ' || p_name || ' against ' || p_size || ': ' || p_brand END AS prompt
FROM part WHERE (p_type IN ('MEDIUM', 'ECONOMY') AND EXISTS (SELECT 1 FROM part WHERE p_type = 'MEDIUM')) OR p_type = 'LARGE'""")
def ans8(spark, d):
    items = table(spark, d, "part").select(
        "p_partkey", F.col("p_type").alias("task_type"), F.col("p_name").alias("question"),
        F.col("p_size").cast("string").alias("reference_answer"), F.col("p_brand").alias("model_answer"),
    )
    return P.judge_prompts(items, P.parse_rubric(rubric_texts(spark, d))).select("p_partkey", "prompt")


@query("ans8_template_choice", """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN 'abstention'
  WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'default' END AS template FROM orders""")
def ans8_template(spark, d):
    qid = F.concat(F.lit("q_"), "o_orderkey", F.when(F.col("o_orderkey") % 10 == 3, "_abs").otherwise(""), F.lit("_0"))
    q = table(spark, d, "orders").select("o_orderkey", qid.alias("qid"), F.col("o_orderpriority").alias("category"))
    known = table(spark, d, "orders").where("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(
        F.col("o_orderpriority").alias("category")
    ).distinct()
    return P.choose_template(q, known).select("o_orderkey", "template")


@query("ans9_final_number", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_partkey || '000' END AS number,
  CAST(CASE WHEN l_returnflag = 'N' THEN 0.0 WHEN l_returnflag = 'A' AND l_partkey > 0 THEN 1.0 ELSE 0.1 END AS DOUBLE) AS reward FROM lineitem""")
def ans9(spark, d):
    raw = F.when(F.col("l_returnflag") == "N", "so 5").otherwise(
        F.concat(F.lit("so #### "), "l_partkey", F.lit(",000"))
    )
    truth = F.when(F.col("l_returnflag") == "A", (F.col("l_partkey") * 1000).cast("string")).otherwise("7")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        A.final_number(raw).alias("number"), A.number_reward(raw, truth).alias("reward"),
    )


@query("ans10_batch_prompt", """WITH q AS (
  SELECT conv_id AS task_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx FROM conversations WHERE role = 'user'),
b AS (SELECT task_id, idx // 2 AS batch_index, string_agg((idx % 2) || ': ' || text, chr(10) ORDER BY idx) AS queries, count(*) AS n,
        max(turn) AS position FROM q GROUP BY ALL),
c AS (SELECT b.task_id, b.batch_index, string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn) AS context
      FROM b JOIN conversations c ON c.conv_id = b.task_id AND c.turn <= b.position GROUP BY ALL),
r AS (SELECT *, 2500 - n * 300 - length(queries) - 100 AS room FROM b JOIN c USING (task_id, batch_index))
SELECT task_id, batch_index, 'Your memory:' || chr(10) || CASE WHEN length(context) > room
   THEN '...[Earlier memory truncated]...' || chr(10) || chr(10) || right(context, CAST(greatest(room, 0) AS BIGINT)) ELSE context END
   || chr(10) || chr(10) || queries AS prompt FROM r""")
def ans10(spark, d):
    chunks, questions = chunks_and_questions(spark, d)
    return P.batch_prompts(questions, chunks, 2, budget=2500, reserve_per_question=300)


@query("ans11_drop_unrated", "SELECT p_partkey FROM part WHERE (p_type IN ('MEDIUM', 'ECONOMY') AND EXISTS (SELECT 1 FROM part WHERE p_type = 'MEDIUM')) OR p_type = 'LARGE'")
def ans11(spark, d):
    items = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("task_type"))
    return P.drop_unrated(items, P.parse_rubric(rubric_texts(spark, d))).select("p_partkey")
