"""Retrieval over documents, benchmark texts and vectors."""

from pyspark.sql import functions as F

from convoeval.functions import scoring as S
from convoeval.functions.text import tokens
from convoeval.operators import retrieval as R
from convoeval.operators.blockmax import raw_idf
from convoeval.operators.substrings import keyword_score_topk, term_frequency_topk
from convoeval.operators.vectorblocks import semantic_scoped_topk
from convoeval.plans.registry import ORACLES, query, table
from convoeval.plans.views import sql_strip, sql_tokens


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def asked_texts(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


_TOK = f"""tok AS MATERIALIZED (SELECT doc_id AS id, {sql_tokens('text')} AS t FROM documents),
docs AS (SELECT id, t, len(t) AS dl FROM tok WHERE len(t) > 0),
tf AS MATERIALIZED (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM docs) GROUP BY id, term),
df AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs)"""
_BM25 = f"""{_TOK},
idf0 AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, st),
idf AS MATERIALIZED (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM idf0) ELSE raw END AS idf FROM idf0),
q AS (SELECT item_id AS qid, unnest({sql_tokens('text')}) AS term FROM benchmark),
qt AS MATERIALIZED (SELECT qid, term, count(*) AS qtf FROM q GROUP BY qid, term),
hit AS (SELECT qid, tf.id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
        FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN docs ON docs.id = tf.id, st GROUP BY qid, tf.id),
every AS (SELECT q.qid, docs.id, round(coalesce(hit.score, 0.0), 9) AS score
          FROM (SELECT DISTINCT qid FROM qt) q CROSS JOIN docs LEFT JOIN hit ON hit.qid = q.qid AND hit.id = docs.id),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM every)"""


@query("ret1_tokenize", f"SELECT doc_id, list_aggregate({sql_tokens('text')}, 'string_agg', ' ') AS tokens FROM documents")
def ret1(spark, d):
    t = tokens(F.col("text"))
    return table(spark, d, "documents").select(
        "doc_id", F.when(F.size(t) > 0, F.array_join(t, " ")).alias("tokens")
    )


@query("ret2_bm25_terms", f"""WITH {_TOK}
SELECT term, df, round(ln(n - df + 0.5) - ln(df + 0.5), 6) AS raw_idf, n AS n_docs, round(avgdl, 6) AS avg_len
FROM df, st""")
def ret2(spark, d):
    return bm25_terms(R.scan_bm25(_docs(spark, d)))


def bm25_terms(index):
    return index.terms.select(
        "term", "df",
        F.round(raw_idf(F.lit(index.n_docs), F.col("df")), 6).alias("raw_idf"),
        F.lit(index.n_docs).alias("n_docs"),
        F.round(F.lit(index.avg_len), 6).alias("avg_len"),
    )


@query("ret3_bm25_topk", f"""WITH {_BM25}
SELECT qid, id, round(score, 6) AS score, rank FROM bm WHERE rank <= 20""")
def ret3(spark, d):
    index = R.scan_bm25(_docs(spark, d))
    return R.bm25_scan_topk(asked_texts(spark, d), index, 20).withColumn("score", F.round("score", 6))


@query("ret3_stored_index", ORACLES["ret3_bm25_topk"])
def ret3_stored(spark, d):
    index = R.build_bm25(_docs(spark, d))
    return R.bm25_topk(asked_texts(spark, d), index, 20).withColumn("score", F.round("score", 6))


@query("ret4_cosine", """
SELECT a.vec_id, CAST(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS DOUBLE) AS cosine
FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) b USING (label)""")
def ret4(spark, d):
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("head"))
    return e.join(first, "label").select(
        "vec_id", F.round(S.cosine(F.col("embedding"), F.col("head")), 6).alias("cosine")
    )


_COS = """cos AS (SELECT b.item_id AS qid, v.vec_id AS id,
    round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 9) AS score
  FROM benchmark b JOIN embeddings q ON q.vec_id = b.item_id CROSS JOIN embeddings v),
sem AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM cos)"""


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def query_vectors(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "embedding")
    return e.join(table(spark, d, "benchmark").select(F.col("item_id").alias("qid")), "qid", "left_semi")


@query("ret5_semantic_topk", f"""WITH {_COS}
SELECT qid, id, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM sem WHERE rank <= 20""")
def ret5(spark, d):
    return R.semantic_topk(query_vectors(spark, d), _vectors(spark, d), 20).withColumn("score", F.round("score", 6))


@query("ret6_rrf", f"""WITH {_BM25}, {_COS},
both_lists AS (SELECT qid, id, rank FROM bm WHERE rank <= 40 UNION ALL SELECT qid, id, rank FROM sem WHERE rank <= 40),
fused AS (SELECT qid, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM both_lists GROUP BY qid, id)
SELECT qid, id, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 20""")
def ret6(spark, d):
    keyword = R.bm25_scan_topk(asked_texts(spark, d), R.scan_bm25(_docs(spark, d)), 40)
    vector = R.semantic_topk(query_vectors(spark, d), _vectors(spark, d), 40)
    return R.rrf([keyword, vector], 20).withColumn("score", F.round("score", 6))


_QW = """qw AS (SELECT p_partkey AS qid, list_filter(string_split(lower(p_name), ' '), lambda w: w <> '') AS w
  FROM (SELECT min(p_partkey) AS p_partkey, p_name FROM part GROUP BY p_name))"""


def _names(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_name").agg(F.min("p_partkey").alias("qid")).select("qid", F.col("p_name").alias("text"))


@query("ret7_keyword_score_topk", f"""WITH {_QW},
s AS (SELECT qid, item_id AS id, round(len(list_filter(w, lambda x: contains(lower(text), x))) * 1.0 / len(w), 9) AS score
      FROM qw, (SELECT page_id AS item_id, html AS text FROM pages) i)
SELECT qid, id, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def ret7(spark, d):
    items = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("content"))
    out = keyword_score_topk(items, _names(spark, d), ["id"])
    return out.select("qid", "id", F.round("score", 6).alias("score"), "rank")


_LINES = f"""ln AS (SELECT conv_id, turn, i AS line_number, {sql_strip('line')} AS content FROM (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM conversations))"""


@query("ret8_term_frequency_topk", f"""WITH {_LINES},
qw AS (SELECT r_regionkey AS qid, list_filter(string_split(lower(r_name || ' the an re'), ' '), lambda w: w <> '') AS w FROM region),
s AS (SELECT qid, conv_id, turn, line_number,
        CAST(list_sum(list_transform(w, lambda x: (length(lower(content)) - length(replace(lower(content), x, ''))) // length(x))) AS BIGINT) AS score
      FROM ln, qw WHERE content <> '')
SELECT qid, conv_id, turn, line_number, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, conv_id, turn, line_number) AS rank FROM s) WHERE rank <= 5""")
def ret8(spark, d):
    lines = R.lines_of(table(spark, d, "conversations"), ["conv_id", "turn"], "text")
    asked = table(spark, d, "region").select(
        F.col("r_regionkey").alias("qid"), F.concat("r_name", F.lit(" the an re")).alias("text")
    )
    out = term_frequency_topk(lines, asked, ["conv_id", "turn", "line_number"])
    return out.drop("content")


_GREP = "th(e|an)[a-z]+ing"


@query("ret9_grep", f"""WITH l AS (
  SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number
  FROM documents),
h AS (SELECT *, count(*) OVER (PARTITION BY id) AS n_matches, row_number() OVER (PARTITION BY id ORDER BY line_number) AS r
      FROM l WHERE regexp_matches(line, '{_GREP}', 'i'))
SELECT id, n_matches, line_number, {sql_strip('line')} AS line FROM h WHERE r <= 10""")
def ret9(spark, d):
    return R.grep(_docs(spark, d), _GREP)


@query("ret9_grep_totals", f"""WITH l AS (
  SELECT doc_id AS id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_GREP}', 'i'))) AS n FROM documents)
SELECT CAST(sum(n) AS BIGINT) AS total_matches, count(*) FILTER (WHERE n > 0) AS docs_with_matches, count(*) AS docs_searched FROM l""")
def ret9_totals(spark, d):
    return R.grep_totals(_docs(spark, d), _GREP)


_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', '')"


@query("ret9_grep_files", rf"""WITH p AS (SELECT page_id AS id, {_PATH} AS path, html AS text FROM pages),
kept AS (SELECT * FROM p WHERE (ends_with(path, '.html') OR ends_with(path, '/')) AND NOT list_contains(string_split(path, '/')[:-2], 'es')),
l AS (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_number FROM kept),
h AS (SELECT *, count(*) OVER (PARTITION BY id) AS n_matches, row_number() OVER (PARTITION BY id ORDER BY line_number) AS r
      FROM l WHERE regexp_matches(line, 'th(e|an)', 'i'))
SELECT id, n_matches, line_number, {sql_strip('line')} AS line FROM h WHERE r <= 10 ORDER BY id, line_number LIMIT 20""")
def ret9_files(spark, d):
    """The report of a search over a folder: endings, skipped folders, ten lines a file and twenty in all."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.expr(_PATH).alias("path"), F.col("html").alias("text"))
    return R.grep(R.searched_files(pages, endings=(".html", "/"), skipped=("es",)), "th(e|an)", total=20)


_SCOPED = f"""c AS (SELECT conv_id, turn, {sql_tokens('text')} AS t FROM conversations),
q AS (SELECT conv_id, turn AS upto, t FROM (SELECT c.conv_id, c.turn, c.t FROM c JOIN conversations x USING (conv_id, turn) WHERE x.role = 'user')),
vis AS (SELECT q.conv_id, q.upto, c.turn, c.t, len(c.t) AS dl FROM q JOIN c ON c.conv_id = q.conv_id AND c.turn <= q.upto WHERE len(c.t) > 0),
st AS (SELECT conv_id, upto, count(*) AS n, avg(dl) AS avgdl FROM vis GROUP BY ALL),
tf AS (SELECT conv_id, upto, turn, dl, term, count(*) AS tf FROM (SELECT conv_id, upto, turn, dl, unnest(t) AS term FROM vis) GROUP BY ALL),
df AS (SELECT conv_id, upto, term, count(*) AS df FROM tf GROUP BY ALL),
raw AS (SELECT conv_id, upto, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN st USING (conv_id, upto)),
mean AS (SELECT conv_id, upto, avg(raw) AS m FROM raw GROUP BY ALL),
qt AS (SELECT conv_id, upto, term, count(*) AS qtf FROM (SELECT conv_id, upto, unnest(t) AS term FROM q) GROUP BY ALL),
hit AS (SELECT conv_id, upto, turn, round(sum(qtf * (CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END)
          * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
        FROM qt JOIN tf USING (conv_id, upto, term) JOIN raw USING (conv_id, upto, term) JOIN mean USING (conv_id, upto) JOIN st USING (conv_id, upto)
        GROUP BY ALL),
every AS (SELECT vis.conv_id, vis.upto, vis.turn, coalesce(hit.score, 0.0) AS score
          FROM vis SEMI JOIN qt ON qt.conv_id = vis.conv_id AND qt.upto = vis.upto
          LEFT JOIN hit ON hit.conv_id = vis.conv_id AND hit.upto = vis.upto AND hit.turn = vis.turn),
near AS (SELECT conv_id, upto, turn, score, row_number() OVER (PARTITION BY conv_id, upto ORDER BY score DESC, turn) AS rank FROM every)"""


@query("ret14_hit_scope", f"""WITH {_SCOPED}
SELECT conv_id || '_' || upto AS qid, conv_id AS task_id, turn AS position, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM near WHERE rank <= 3""")
def ret14(spark, d):
    chunks, questions = _turns(spark, d)
    return R.bm25_scoped_topk(questions, chunks, 3).withColumn("score", F.round("score", 6))


def _turns(spark, d):
    """Turns as chunks and user turns as questions; a turn's vector is one of the given ones, dealt by its number."""
    turns = table(spark, d, "conversations")
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    number = F.pmod(F.col("conv_id") * 8 + F.col("turn"), vectors.select(F.count(F.lit(1))).scalar())
    chunks = turns.withColumn("vec_id", number).join(vectors, "vec_id").select(
        F.col("conv_id").alias("task_id"), F.col("turn").alias("position"), "role", "text", "embedding")
    return chunks, chunks.where("role = 'user'").withColumn("qid", F.concat_ws("_", "task_id", "position"))


_SCOPED_COS = """vec AS (SELECT conv_id, turn, role, CAST(embedding AS DOUBLE[]) AS e FROM conversations
  JOIN embeddings ON vec_id = (conv_id * 8 + turn) % (SELECT count(*) FROM embeddings)),
cos AS (SELECT a.conv_id, a.turn AS upto, b.turn, round(list_cosine_similarity(a.e, b.e), 9) AS score
  FROM vec a JOIN vec b ON a.conv_id = b.conv_id AND b.turn <= a.turn WHERE a.role = 'user'),
sem AS (SELECT *, row_number() OVER (PARTITION BY conv_id, upto ORDER BY score DESC, turn) AS rank FROM cos)"""


@query("ret14_semantic", f"""WITH {_SCOPED_COS}
SELECT conv_id || '_' || upto AS qid, conv_id AS task_id, turn AS position, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM sem WHERE rank <= 3""")
def ret14_semantic(spark, d):
    chunks, questions = _turns(spark, d)
    return semantic_scoped_topk(questions, chunks, 3).withColumn("score", F.round("score", 6))


@query("ret14_rrf", f"""WITH {_SCOPED}, {_SCOPED_COS},
lists AS (SELECT conv_id, upto, turn, rank FROM near WHERE rank <= 6 UNION ALL SELECT conv_id, upto, turn, rank FROM sem WHERE rank <= 6),
fused AS (SELECT conv_id, upto, turn, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY conv_id, upto, turn)
SELECT conv_id || '_' || upto AS qid, turn AS position, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, upto ORDER BY score DESC, turn) AS rank FROM fused) WHERE rank <= 3""")
def ret14_rrf(spark, d):
    chunks, questions = _turns(spark, d)
    lists = [R.bm25_scoped_topk(questions, chunks, 6), semantic_scoped_topk(questions, chunks, 6)]
    fused = R.rrf([x.withColumnRenamed("position", "id") for x in lists], 3)
    return fused.withColumnRenamed("id", "position").withColumn("score", F.round("score", 6))
