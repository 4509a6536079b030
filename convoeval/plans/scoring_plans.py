"""Answer metrics over question and answer pairs."""

from pyspark.sql import functions as F

from convoeval.functions import scoring as S
from convoeval.functions.text import normalise_answer
from convoeval.operators import evaluation
from convoeval.plans.registry import query, table
from convoeval.plans.views import SQL_PAIRS, SQL_SPACE, qa_pairs, sql_normal, sql_words

_SIDES = f"""sides AS (
  SELECT qid, conv_id, turn, {sql_normal('response')} AS p, {sql_normal('expected')} AS g
  FROM pairs),
tok AS (
  SELECT qid, conv_id, turn, p, g, {sql_words('p')} AS pt, {sql_words('g')} AS gt FROM sides),
pc AS (SELECT qid, t, count(*) AS n FROM (SELECT qid, unnest(pt) AS t FROM tok) GROUP BY qid, t),
gc AS (SELECT qid, t, count(*) AS n FROM (SELECT qid, unnest(gt) AS t FROM tok) GROUP BY qid, t),
common AS (SELECT qid, sum(least(pc.n, gc.n)) AS n FROM pc JOIN gc USING (qid, t) GROUP BY qid),
metrics AS (
  SELECT t.qid, t.conv_id, t.turn,
    CASE WHEN coalesce(c.n, 0) = 0 THEN 0.0 ELSE 2.0 * c.n / (len(pt) + len(gt)) END AS f1_score,
    CASE WHEN coalesce(c.n, 0) = 0 THEN 0.0 ELSE 1.0 * c.n / len(pt) END AS precision,
    CASE WHEN coalesce(c.n, 0) = 0 THEN 0.0 ELSE 1.0 * c.n / len(gt) END AS recall,
    CASE WHEN list_sort(list_distinct(pt)) = list_sort(list_distinct(gt)) THEN 1.0 ELSE 0.0 END AS exact_match,
    CASE WHEN contains(p, g) OR contains(g, p) THEN 1.0 ELSE 0.0 END AS sub_em
  FROM tok t LEFT JOIN common c USING (qid))"""


@query("sco1_normalise_answer", f"""
SELECT conv_id, turn, {sql_normal('text')} AS normal FROM conversations""")
def sco1(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", normalise_answer(F.col("text")).alias("normal")
    )


@query("sco2_token_prf", f"""WITH {SQL_PAIRS}, {_SIDES}
SELECT qid, CAST(round(f1_score, 6) AS DOUBLE) AS f1_score,
       CAST(round(precision, 6) AS DOUBLE) AS precision, CAST(round(recall, 6) AS DOUBLE) AS recall
FROM metrics""")
def sco2(spark, d):
    m = evaluation.token_scores(qa_pairs(spark, d))
    return m.select("qid", *[F.round(c, 6).alias(c) for c in ["f1_score", "precision", "recall"]])


@query("sco3_exact_match", f"""WITH {SQL_PAIRS}, {_SIDES}
SELECT qid, CAST(exact_match AS DOUBLE) AS exact_match FROM metrics""")
def sco3(spark, d):
    sides = evaluation.with_tokens(qa_pairs(spark, d))
    return sides.select("qid", S.exact_match(F.col("_p"), F.col("_g")).alias("exact_match"))


@query("sco4_sub_em", f"""WITH {SQL_PAIRS}, {_SIDES}
SELECT qid, CAST(sub_em AS DOUBLE) AS sub_em FROM metrics""")
def sco4(spark, d):
    sides = evaluation.with_tokens(qa_pairs(spark, d))
    return sides.select("qid", S.sub_em(F.col("_pred"), F.col("_gold")).alias("sub_em"))


#: ROUGE-L on tokens as they are: one row of the dynamic programme per pair and token, a running maximum each.
_ROUGE = f"""rt AS (SELECT qid, regexp_extract_all({sql_normal('expected')}, '[a-z0-9]+') AS g, regexp_extract_all({sql_normal('response')}, '[a-z0-9]+') AS p FROM pairs),
gold AS (SELECT qid, unnest(g) AS t, generate_subscripts(g, 1) AS i, p FROM rt),
lcs AS (SELECT qid, 0 AS j, i, 0 AS v FROM gold
  UNION ALL
  SELECT qid, j + 1, i, max(w) OVER (PARTITION BY qid ORDER BY i ROWS UNBOUNDED PRECEDING)
  FROM (SELECT l.qid, l.j, l.i, CASE WHEN g.t = g.p[l.j + 1] THEN coalesce(lag(v) OVER (PARTITION BY l.qid ORDER BY l.i), 0) + 1 ELSE v END AS w
        FROM lcs l JOIN gold g ON g.qid = l.qid AND g.i = l.i WHERE l.j < len(g.p))),
rouge AS (SELECT qid, CASE WHEN len(g) + len(p) = 0 THEN 0.0 ELSE 2.0 * coalesce((SELECT max(v) FROM lcs WHERE lcs.qid = rt.qid), 0) / (len(g) + len(p)) END AS rouge_score FROM rt)"""


@query("sco5_rouge_l", f"""WITH RECURSIVE {SQL_PAIRS}, {_ROUGE}
SELECT qid, CAST(round(rouge_score, 6) AS DOUBLE) AS rouge_score FROM rouge""")
def sco5(spark, d):
    return qa_pairs(spark, d).select(
        "qid", F.round(S.rouge_l(F.col("response"), F.col("expected"), stemmed=False), 6).alias("rouge_score")
    )


_TERMS = (
    "list_transform(string_split(expected, ','), lambda t: lower(regexp_replace(regexp_replace(t, "
    f"'^{SQL_SPACE}+', ''), '{SQL_SPACE}+$', '')))"
)


@query("sco6_keyword_hit_rate", f"""WITH {SQL_PAIRS}
SELECT qid, round(len(list_filter({_TERMS}, lambda t: contains(lower(response), t))) * 1.0
                  / len({_TERMS}), 6) AS keyword_hit_rate
FROM pairs""")
def sco6(spark, d):
    scored = evaluation.keyword_scores(qa_pairs(spark, d))
    return scored.select("qid", F.round("keyword_hit_rate", 6).alias("keyword_hit_rate"))


@query("sco7_score_answers", f"""WITH RECURSIVE {SQL_PAIRS}, {_SIDES}, {_ROUGE}
SELECT qid, CAST(round(coalesce(f1_score, -1), 6) AS DOUBLE) AS f1_score,
       CAST(round(coalesce(precision, -1), 6) AS DOUBLE) AS precision,
       CAST(round(coalesce(recall, -1), 6) AS DOUBLE) AS recall,
       CAST(coalesce(exact_match, -1) AS DOUBLE) AS exact_match,
       CAST(coalesce(sub_em, -1) AS DOUBLE) AS sub_em,
       round(len(list_filter({_TERMS}, lambda t: contains(lower(response), t))) * 1.0
             / len({_TERMS}), 6) AS keyword_hit_rate,
       CAST(round(rouge_score, 6) AS DOUBLE) AS rouge_score
FROM metrics JOIN pairs USING (qid) JOIN rouge USING (qid)""")
def sco7(spark, d):
    scored = evaluation.score_answers(qa_pairs(spark, d), task="booksum", stemmed=False)
    return scored.select(
        "qid", *[F.round(c, 6).alias(c) for c in [*S.METRICS, "keyword_hit_rate", "rouge_score"]]
    )


@query("sco8_semantic_score", """
SELECT a.vec_id, CAST(round(greatest(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
       CAST(b.embedding AS DOUBLE[])), 0.0), 6) AS DOUBLE) AS bert_score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def sco8(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    gold = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("gold"))
    score = S.vector_f1_floor(S.cosine(F.col("embedding"), F.col("gold")))
    return e.join(gold, "vec_id").select("vec_id", F.round(score, 6).alias("bert_score"))


@query("flagship_conversation_report", f"""WITH {SQL_PAIRS}, {_SIDES},
long AS (
  SELECT conv_id % 10 AS cohort, 'f1_score' AS metric, f1_score AS value FROM metrics
  UNION ALL SELECT conv_id % 10, 'precision', precision FROM metrics
  UNION ALL SELECT conv_id % 10, 'recall', recall FROM metrics
  UNION ALL SELECT conv_id % 10, 'exact_match', exact_match FROM metrics
  UNION ALL SELECT conv_id % 10, 'sub_em', sub_em FROM metrics)
SELECT cohort, metric, CAST(round(avg(value), 6) AS DOUBLE) AS avg_value, count(*) AS n_valid
FROM long GROUP BY cohort, metric""")
def flagship(spark, d):
    scored = evaluation.score_answers(
        qa_pairs(spark, d).withColumn("cohort", F.col("conv_id") % 10), task="", rouge=False
    )
    return evaluation.average_scores(scored, ["cohort"], S.METRICS)
