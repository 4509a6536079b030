"""Joins."""

from pyspark.sql import functions as F

from convoeval.operators import evaluation
from convoeval.operators import joins as J
from convoeval.operators import retrieval as R
from convoeval.operators.patterns import mentioned_facts
from convoeval.functions.scoring import cosine
from convoeval.plans.registry import query, table


@query("jn1_match_answers", """
SELECT q.l_orderkey AS id, q.l_linenumber AS type, q.l_partkey AS question, a.o_orderpriority AS answer
FROM lineitem q JOIN orders a ON a.o_orderkey = q.l_orderkey""")
def jn1(spark, d):
    q = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("type"), F.col("l_partkey").alias("question")
    )
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("answer"))
    return J.match_answers(q, a, ["id"])


@query("jn2_with_category", """
SELECT d.doc_id AS qid, d.lang, coalesce('q' || l.quality, 'unknown') AS category
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def jn2(spark, d):
    r = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "lang")
    c = table(spark, d, "labels").select(F.col("doc_id").alias("qid"), F.concat(F.lit("q"), "quality").alias("category"))
    return J.with_category(r, c)


@query("jn3_not_answered", "SELECT doc_id AS qid, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn3(spark, d):
    q = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "lang")
    return J.not_answered(q, table(spark, d, "labels").select(F.col("doc_id").alias("qid")))


@query("jn4_with_questions", """
SELECT c_custkey AS task_id, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def jn4(spark, d):
    s = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"), "c_mktsegment")
    return J.with_questions(s, table(spark, d, "orders").select(F.col("o_custkey").alias("task_id")))


def chunks_and_questions(spark, d):
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("task_id"), F.col("turn").alias("position"), "role", "text"
    )
    q = c.where("role = 'user'").select(
        F.concat_ws("_", "task_id", "position").alias("qid"), "task_id", "position", F.col("text").alias("query")
    )
    return c.select("task_id", "position", "text"), q


_Q = """q AS (SELECT conv_id || '_' || turn AS qid, conv_id AS task_id, turn AS position
          FROM conversations WHERE role = 'user')"""


@query("jn5_visible_extent", f"""WITH {_Q}
SELECT q.qid, q.task_id, q.position, max(c.turn) AS upto, count(*) AS n_visible,
       CAST(sum(length(c.text)) AS BIGINT) AS n_chars
FROM q JOIN conversations c ON c.conv_id = q.task_id AND c.turn <= q.position GROUP BY ALL""")
def jn5(spark, d):
    chunks, questions = chunks_and_questions(spark, d)
    return J.visible_extent(questions.drop("query"), chunks)


@query("jn5_visible_tail", f"""WITH {_Q},
v AS (SELECT q.qid, q.task_id, string_agg(c.text, chr(10) || chr(10) ORDER BY c.turn) AS t, max(c.turn) AS upto
      FROM q JOIN conversations c ON c.conv_id = q.task_id AND c.turn <= q.position GROUP BY ALL)
SELECT qid, task_id, upto, CASE WHEN length(t) > 700
  THEN '...[Earlier memory truncated]...' || chr(10) || chr(10) || substr(t, length(t) - 699) ELSE t END AS context FROM v""")
def jn5_tail(spark, d):
    chunks, questions = chunks_and_questions(spark, d)
    return J.visible_tail(questions, chunks, 700)


@query("jn6_label_centroid_scores", """WITH c AS (
  SELECT label, list(m ORDER BY i) AS centre FROM (
    SELECT label, i, avg(x) AS m FROM (
      SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY label)
SELECT e.vec_id, c.label, CAST(round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.centre), 6) AS DOUBLE) AS score
FROM embeddings e, c""")
def jn6(spark, d):
    e = table(spark, d, "embeddings")
    flat = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(
        F.col("label").alias("label"), F.col("c.m").alias("centre")
    )
    packed, n = R.query_blocks(centre, ["label", "centre"])
    rows = R.beside_blocks(e.select("vec_id", "embedding"), packed, n)
    return rows.select("vec_id", "embedding", F.explode("queries").alias("q")).select(
        "vec_id", "q.label", F.round(cosine(F.col("embedding"), F.col("q.centre")), 6).alias("score")
    )


@query("jn7_rescore", """
SELECT d.doc_id AS qid, coalesce(CAST(nullif(l.quality, 0) AS DOUBLE), round(d.n_chars * 0.001, 6)) AS bert_score,
       coalesce(CAST(nullif(l.toxic, 0) AS DOUBLE), round(d.n_chars * 0.002, 6)) AS llm_score
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def jn7(spark, d):
    responses = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), "n_chars")
    old = table(spark, d, "labels").select(
        F.col("doc_id").alias("qid"),
        F.when(F.col("quality") == 0, -1.0).otherwise(F.col("quality").cast("double")).alias("bert_score"),
        F.when(F.col("toxic") == 0, -1.0).otherwise(F.col("toxic").cast("double")).alias("llm_score"),
    )

    def compute(rows):
        return rows.select(
            "qid", F.round(F.col("n_chars") * 0.001, 6).alias("bert_score"),
            F.round(F.col("n_chars") * 0.002, 6).alias("llm_score"),
        )

    return evaluation.rescore(responses, old, compute).select("qid", "bert_score", "llm_score")


@query("jn8_drop_ignored", """
SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE n_name NOT IN (SELECT n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA')""")
def jn8(spark, d):
    nation = table(spark, d, "nation")
    ignored = nation.join(
        table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_name").alias("name"))
    customers = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return J.drop_ignored(customers.select("c_custkey", "n_name"), ignored, "n_name")


@query("jn9_zip_dates", """WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS session, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, i - 1 AS ord, session, CASE i WHEN 1 THEN '2024-01-01' WHEN 2 THEN '2024-01-02' ELSE 'Unknown' END AS date FROM l""")
def jn9(spark, d):
    dates = F.array(F.lit("2024-01-01"), F.lit("2024-01-02"))
    zipped = J.zip_dates(F.split("text", "\n"), dates)
    return table(spark, d, "documents").select("doc_id", F.posexplode(zipped).alias("ord", "z")).select(
        "doc_id", "ord", "z.session", "z.date"
    )


@query("jn10_mentioned", """WITH f AS (SELECT p_partkey, 'src' || (p_partkey % 20) AS task_id, unnest(string_split(p_name, ' ')) AS scene FROM part),
w AS (SELECT DISTINCT task_id, scene FROM f)
SELECT p_partkey, task_id, scene FROM f JOIN (SELECT * FROM w WHERE EXISTS (
  SELECT 1 FROM documents d WHERE d.source = w.task_id AND contains(lower(d.text), lower(w.scene)))) USING (task_id, scene)""")
def jn10(spark, d):
    names = table(spark, d, "part").select(
        "p_partkey", F.concat(F.lit("src"), F.col("p_partkey") % 20).alias("task_id"), F.explode(F.split("p_name", " ")).alias("scene"))
    return mentioned_facts(names, table(spark, d, "documents").select(F.col("source").alias("task_id"), "text"))
