"""Streams over the given tables, run to their end, and model calls with stubs."""

import uuid

from pyspark.sql import functions as F

from convoeval.operators import inference as INF
from convoeval.operators import memory as M
from convoeval.operators import retrieval as R
from convoeval.plans.join_plans import chunks_and_questions
from convoeval.plans.memory_plans import _KV
from convoeval.plans.registry import ORACLES, query, table
from convoeval.plans.retrieval_plans import asked_texts, bm25_terms, query_vectors
from convoeval.plans.views import event_ledger, memory_edits, sql_strip, sql_tokens
from convoeval.session import checkpoint_dir
from convoeval.sources.readers import stream_turns
from convoeval.streaming.index import open_index, start_index, start_vectors, vectors_topk
from convoeval.streaming.ledger import read_ledger, start_ledger
from convoeval.streaming.memory import read_memory, start_memory


def _folders(spark):
    base = f"{checkpoint_dir(spark)}/{uuid.uuid4()}"
    return f"{base}/out", f"{base}/state"


class _Streamed:
    """Reads the named table of a folder as a stream instead of a table.

    The rows are dealt out to four files first, against their order, and come one
    file a batch, so that state and late rows cross batches.
    """

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def table(self, name):
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        folder, _ = _folders(self.spark)
        rows.repartition(4, F.xxhash64(*rows.columns)).write.parquet(folder)
        return self.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query("src9_stream_turns", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def src9(spark, d):
    out, state = _folders(spark)
    schema = spark.read.parquet(f"{d}/conversations.parquet").schema
    turns = stream_turns(spark, f"{d}/*conversations.parquet", schema)
    q = (
        turns.select("conv_id", "turn", "role", F.length("text").alias("n")).writeStream
        .option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out)
    )
    q.awaitTermination()
    return spark.read.parquet(out)


@query("mem11_stream_ledger", f"{_KV} SELECT title, value FROM kv")
def mem11(spark, d):
    out, state = _folders(spark)
    tx = event_ledger(_Streamed(spark, d), d)
    start_ledger(tx, [], out, state).awaitTermination()
    return read_ledger(spark, out, [])


@query("mem12_stream_memory", ORACLES["mem7_apply_operations"])
def mem12(spark, d):
    out, state = _folders(spark)
    start_memory(memory_edits(_Streamed(spark, d), d), out, state).awaitTermination()
    return read_memory(spark, out)


def _stream_index(spark, d):
    out, state = _folders(spark)
    docs = _Streamed(spark, d).table("documents").select(F.col("doc_id").alias("id"), "text")
    start_index(docs, out, state, fan=3).awaitTermination()
    return open_index(spark, out)


@query("ret11_incremental_index", ORACLES["ret2_bm25_terms"])
def ret11(spark, d):
    return bm25_terms(_stream_index(spark, d))


@query("ret11_ranking", ORACLES["ret3_bm25_topk"])
def ret11_ranking(spark, d):
    return R.bm25_topk(asked_texts(spark, d), _stream_index(spark, d), 20).withColumn("score", F.round("score", 6))


@query("ret11_vectors", ORACLES["ret5_semantic_topk"])
def ret11_vectors(spark, d):
    out, state = _folders(spark)
    vectors = _Streamed(spark, d).table("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    start_vectors(vectors, out, state, cells=16, block_rows=32, fan=3).awaitTermination()
    return vectors_topk(spark, query_vectors(spark, d), out, 20).withColumn("score", F.round("score", 6))


def _echo(client, texts):
    return [f"echo {t[:20]}" for t in texts]


@query("inf1_batch_infer", "SELECT item_id, 'echo ' || left(text, 20) AS response FROM benchmark")
def inf1(spark, d):
    rows = table(spark, d, "benchmark")
    return INF.batch_infer(rows, _echo, "text", partitions=4).select("item_id", "response")


def _note(memory, chunk):
    return f"{'' if memory == INF.EMPTY_MEMORY else memory}|{chunk[:5]}"[-50:]


@query("inf2_fold_summary", """SELECT conv_id AS task_id, right(string_agg('|' || left(text, 5), '' ORDER BY turn), 50) AS memory
FROM conversations GROUP BY conv_id""")
def inf2(spark, d):
    chunks, _ = chunks_and_questions(spark, d)
    return INF.fold_summary(chunks, _note, ["task_id"], "position")


def _length(client, texts):
    return [str(t.startswith("Retrieved") and t.endswith("Answer:")) for t in texts]


@query("inf3_answer_by_retrieval", """SELECT conv_id || '_' || turn AS qid, 'True' AS response FROM conversations WHERE role = 'user'""")
def inf3(spark, d):
    chunks, questions = chunks_and_questions(spark, d)
    return INF.answer_by_retrieval(questions, chunks, _length, k=3).select("qid", "response")


def _extract(client, texts):
    return [f"**ACTIVITY ITEMS:**\n{t}" for t in texts]


def _suggest(client, texts):
    return [f"**Category: profile**\n- Suggestion: {t.splitlines()[0]}" if t else "" for t in texts]


def _operate(client, texts):
    return [f"**OPERATION:** ADD\n- Memory Item Content: {t}" for t in texts]


@query("inf4_consolidate_memory", """SELECT conv_id AS key, turn << 20 AS seq,
  trim(string_split(ltrim(text, chr(10) || ' '), chr(10))[1]) AS content FROM conversations WHERE trim(text) <> ''""")
def inf4(spark, d):
    turns = table(spark, d, "conversations")
    texts = turns.select(
        F.col("conv_id").alias("key"), F.col("turn").alias("seq"), "text", F.lit("2024-01-01").alias("date")
    )
    state = memory_edits(spark, d).where("operation = 'NONE'").select(
        "key", "seq", F.col("target_id").alias("memory_id"), "content", "mentioned_at"
    )
    out = INF.consolidate_memory(texts, state, _extract, _suggest, _operate, M.CATEGORIES)
    return out["state"].select("key", "seq", "content")


_ICL_ALL, _SHORT_ALL, _LONG_FROM = 20, 20, 45


@query("ret10_adaptive_retrieve", f"""WITH ch AS (SELECT source AS task_id, doc_id AS position, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth,
  CASE WHEN doc_id % 20 IN (3, 4) THEN replace(text, chr(10), chr(10) || 'Label: 7 ') ELSE text END AS text,
  CAST(embedding AS DOUBLE[]) AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings)),
kind AS (SELECT task_id, count(*) AS n_chunks, max(position) AS stop, CASE
    WHEN sum(CASE WHEN nth <= 10 THEN len(regexp_extract_all(text, '\\nLabel:\\s*\\d+')) ELSE 0 END) >= 50 THEN 'icl'
    WHEN count(*) >= {_LONG_FROM} AND substr(task_id, 4)::INT % 3 = 0 THEN 'long' ELSE 'short' END AS task_type FROM ch GROUP BY task_id),
q0 AS (SELECT 'q' || item_id AS qid, 'src' || (item_id % 20) AS task_id, text AS query, CAST(embedding AS DOUBLE[]) AS e
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id % (SELECT count(*) FROM embeddings)),
q AS (SELECT q0.*, n_chunks, task_type, (task_type = 'icl' AND n_chunks <= {_ICL_ALL}) OR (task_type = 'short' AND n_chunks <= {_SHORT_ALL}) AS whole FROM q0 JOIN kind USING (task_id)),
tok AS (SELECT task_id, position, {sql_tokens('text')} AS t FROM ch),
tf AS (SELECT task_id, position, dl, term, count(*) AS tf FROM (SELECT task_id, position, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY ALL),
st AS (SELECT task_id, count(*) AS n, avg(len(t)) AS avgdl FROM tok WHERE len(t) > 0 GROUP BY task_id),
raw AS (SELECT task_id, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT task_id, term, count(*) AS df FROM tf GROUP BY ALL) JOIN st USING (task_id)),
mean AS (SELECT task_id, avg(raw) AS m FROM raw GROUP BY task_id),
asked AS (SELECT qid, task_id, CASE WHEN task_type = 'long' AND contains(query, ']') THEN {sql_strip("substr(query, instr(query, ']') + 1)")} ELSE query END AS text
  FROM q WHERE NOT whole AND task_type <> 'short'),
qt AS (SELECT qid, task_id, term, count(*) AS qtf FROM (SELECT qid, task_id, unnest({sql_tokens('text')}) AS term FROM asked) GROUP BY ALL),
hit AS (SELECT qid, task_id, position, sum(qtf * (CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN tf USING (task_id, term) JOIN raw USING (task_id, term) JOIN mean USING (task_id) JOIN st USING (task_id) GROUP BY ALL),
bm AS (SELECT a.qid, tok.position, row_number() OVER (PARTITION BY a.qid ORDER BY round(coalesce(score, 0), 9) DESC, tok.position) AS rank
  FROM (SELECT DISTINCT qid, task_id FROM qt) a JOIN tok ON tok.task_id = a.task_id AND len(t) > 0 LEFT JOIN hit ON hit.qid = a.qid AND hit.position = tok.position),
sem AS (SELECT qid, position, row_number() OVER (PARTITION BY qid ORDER BY round(list_cosine_similarity(q.e, ch.e), 9) DESC, position) AS rank
  FROM q JOIN ch USING (task_id) WHERE NOT whole AND task_type <> 'icl'),
fused AS (SELECT qid, position, row_number() OVER (PARTITION BY qid ORDER BY round(sum(1.0 / (60 + rank)), 9) DESC, position) AS rank
  FROM (SELECT * FROM bm WHERE rank <= 20 UNION ALL SELECT * FROM sem WHERE rank <= 20) JOIN (SELECT qid FROM q WHERE task_type = 'long') USING (qid) GROUP BY qid, position)
SELECT qid, position, (position + 1)::INT AS rank FROM q JOIN ch USING (task_id) WHERE whole
UNION ALL SELECT qid, position, rank::INT FROM bm JOIN q USING (qid) WHERE task_type = 'icl' AND rank <= {_ICL_ALL}
UNION ALL SELECT qid, position, rank::INT FROM sem JOIN q USING (qid) WHERE task_type = 'short' AND rank <= {_SHORT_ALL}
UNION ALL SELECT qid, position, rank::INT FROM fused WHERE rank <= 10""")
def ret10(spark, d):
    from convoeval.operators import routing
    from convoeval.plans.text_plans import labelled_chunks

    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = vectors.select(F.count(F.lit(1))).scalar()

    def with_vector(rows, number):
        return rows.withColumn("vec_id", F.pmod(number, n)).join(vectors, "vec_id", "left").drop("vec_id")

    chunks = labelled_chunks(spark, d)
    placed = with_vector(chunks.select("task_id", "position"), F.col("position"))
    asked = table(spark, d, "benchmark").select(
        "item_id", F.concat(F.lit("q"), "item_id").alias("qid"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("task_id"),
        F.col("text").alias("query"),
    )
    # so that every branch has tasks, only every third of the large ones counts as long
    types = routing.task_types(chunks, icl_labels=50, long_chunks=_LONG_FROM, long_chars=1 << 60).withColumn("task_type", F.when(
        (F.col("task_type") == routing.LONG) & (F.substring("task_id", 4, 9).cast("int") % 3 != 0), routing.SHORT).otherwise(F.col("task_type")))
    return routing.adaptive_retrieve(with_vector(asked, F.col("item_id")).drop("item_id"), chunks, types, top_k=10, icl_all=_ICL_ALL, short_all=_SHORT_ALL, vectors=placed)
