"""Readers and writers over files that Spark derives from the given tables."""

from pyspark.sql import functions as F

from convoeval.operators import chunking as C
from convoeval.operators import incremental as I
from convoeval.operators import normalise as N
from convoeval.operators import reports as REP
from convoeval.operators import sampling as S
from convoeval.plans.join_plans import chunks_and_questions
from convoeval.operators.joins import match_answers
from convoeval.plans.registry import query, table
from convoeval.plans.report_plans import LANGS
from convoeval.plans.stream_plans import _folders
from convoeval.plans.views import NARRATIVE_FIELDS, SQL_SCORES, long_scores, narrative, scores
from convoeval.sources import readers as R
from convoeval.sources import writers as W


def _session_files(spark, d):
    """One dialogue with one session per turn, as JSON lines."""
    out, _ = _folders(spark)
    turn = F.struct(
        F.col("role").alias("speaker"), "text", F.when(F.col("turn") % 2 == 0, "a picture").alias("blip_caption")
    )
    n = (F.col("turn") + 9).cast("string")
    talk = F.create_map(
        F.lit("speaker_a"), F.lit("user"), F.lit("speaker_b"), F.lit("assistant"),
        F.concat(F.lit("session_"), n, F.lit("_date_time")), F.concat(F.lit("day "), n),
    )
    head = F.to_json(F.struct(
        F.concat_ws("_", "conv_id", "turn").alias("sample_id"),
        F.create_map(F.lit("s"), F.lit("x")).alias("session_summary"),
        F.array(F.struct(
            F.concat(F.lit("Who is "), "role", F.lit("?")).alias("question"), F.col("role").alias("answer"),
            F.lit(1).alias("category"), F.array(F.concat(F.lit("D"), n, F.lit(":1"))).alias("evidence"),
        )).alias("qa"),
    ))
    # the session itself is an array under a key of its own name
    body = F.concat(
        F.expr("left(t, length(t) - 1)"), F.lit(', "session_'), "n", F.lit('": '), "s", F.lit("}")
    )
    rows = table(spark, d, "conversations").select(
        head.alias("h"), F.to_json(talk).alias("t"), n.alias("n"), F.to_json(F.array(turn)).alias("s")
    )
    line = F.concat(F.expr("left(h, length(h) - 1)"), F.lit(', "conversation": '), body, F.lit("}"))
    rows.select(line.alias("value")).write.text(out)
    return R.read_session_dialogues(spark, out, lines=True)


@query("src2_session_dialogues", """SELECT conv_id || '_' || turn AS sample_id, CAST(turn + 9 AS INTEGER) AS session, 'day ' || (turn + 9) AS date,
  role AS speaker, text, CASE WHEN turn % 2 = 0 THEN 'a picture' END AS caption FROM conversations""")
def src2(spark, d):
    return _session_files(spark, d)[0].select("sample_id", "session", "date", "speaker", "text", "caption")


@query("src2_session_questions", """SELECT conv_id || '_' || turn || '_0' AS qid, 'Who is ' || role || '?' AS query, role AS answer,
  CAST(turn + 9 AS INTEGER) AS evidence_session FROM conversations""")
def src2_questions(spark, d):
    q = _session_files(spark, d)[1]
    return q.select("qid", "query", "answer", N.evidence_session(F.col("evidence"), F.col("n_sessions")).alias("evidence_session"))


@query("src3_json_tree", "SELECT doc_id, 'lang=' || lang AS category FROM documents")
def src3(spark, d):
    out, _ = _folders(spark)
    table(spark, d, "documents").select("doc_id", "lang").write.partitionBy("lang").json(f"{out}/cases")
    return R.read_json_tree(spark, out, "doc_id bigint", "cases", lines=True).select("doc_id", "category")


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("src4_read_qa_files", """SELECT event_type AS type, CAST(event_id AS VARCHAR) AS id, 'Who did ' || event_id || '?' AS question,
  CAST(user_id AS VARCHAR) AS answer FROM events WHERE event_id % 7 <> 0""")
def src4(spark, d):
    out, _ = _folders(spark)
    events = table(spark, d, "events").select("event_type", F.col("event_id").alias("id"), "user_id")
    for i, kind in enumerate(KINDS):  # one file family per event type, names in singular and plural
        mine, s = events.where(F.col("event_type") == kind), "s" if i % 2 else ""
        mine.select("id", F.concat(F.lit("Who did "), "id", F.lit("?")).alias("question")).write.json(f"{out}/set1/question/{kind}_question{s}.json")
        mine.where("id % 7 <> 0").select("id", F.col("user_id").alias("answer")).write.json(f"{out}/set1/answer/{kind}_answer{s}.json")
    questions, answers = R.read_qa_files(spark, out, lines=True)
    return match_answers(questions, answers, ["corpus", "type", "id"]).drop("corpus")


def _results(spark, d):
    """A results tree: task folders with evaluated and responses outputs."""
    out, _ = _folders(spark)
    rows = scores(spark, d)
    for task in LANGS:
        mine = rows.where(F.col("task") == task).select(
            F.col("qid").cast("string").alias("qid"), F.create_map(F.lit("quality"), F.col("quality")).alias("metric")
        )
        mine.write.json(f"{out}/{task}/evaluated_my_agent_{len(task)}.jsonl")
        mine.select("qid").write.json(f"{out}/{task}/responses_{task}.jsonl")
    return out


@query("src6_read_evaluations", f"""WITH {SQL_SCORES}
SELECT task, 'my_agent' AS agent, CAST(qid AS VARCHAR) AS qid, 'quality' AS metric, quality AS value FROM scores""")
def src6(spark, d):
    return R.long_metrics(R.read_evaluations(spark, _results(spark, d)))


@query("inc5_discover_outputs", "SELECT DISTINCT lang AS task, lang AS agent FROM documents")
def inc5(spark, d):
    return R.discover_outputs(spark, _results(spark, d))


_GOOD = "FROM events WHERE event_type <> 'view'"


@query("src5_read_responses", f"SELECT 'q' || event_id AS qid, event_type AS response, value AS generation_time {_GOOD}")
def src5(spark, d):
    out, _ = _folders(spark)
    good = F.to_json(F.struct(
        F.concat(F.lit("q"), "event_id").alias("qid"), F.col("event_type").alias("response"), F.col("value").alias("generation_time")
    ))
    line = F.when(F.col("event_type") == "view", F.concat(F.lit("{broken "), "props")).otherwise(good)
    table(spark, d, "events").select(line.alias("value")).write.text(out)
    return R.read_responses(spark, out).select("qid", "response", "generation_time")


def _samples(spark, d):
    docs = table(spark, d, "documents")
    questions = F.array(F.struct(
        F.concat(F.lit("q"), "doc_id").alias("qid"), F.lit("Which language?").alias("query"), F.col("lang").alias("answer"),
        F.lit(0).alias("position"), F.col("source").alias("category"),
    ))
    return docs.select(
        F.concat(F.lit("t"), "doc_id").alias("task_id"), questions.alias("questions"), F.split("text", "\n").alias("chunks")
    )


@query("src7_read_canonical", """SELECT 't' || doc_id AS task_id, 'q' || doc_id AS qid, lang AS answer, source AS category FROM documents""")
def src7(spark, d):
    out, _ = _folders(spark)
    _samples(spark, d).write.json(f"{out}/small_valsets/samples.jsonl")
    stored = R.read_canonical(spark, f"{out}/samples.jsonl", small=True)
    return R.to_long(stored)[1].select("task_id", "qid", "answer", "category")


@query("src8_persona_dialogues", """SELECT 'm' || conv_id || '_' || turn AS task_id, 0 AS session, 0 AS turn, 'Speaker 1' AS speaker, role AS text FROM conversations
UNION ALL SELECT 'm' || conv_id || '_' || turn, 0, 1, 'Speaker 2', role FROM conversations
UNION ALL SELECT 'm' || conv_id || '_' || turn, 1, 0, 'Speaker 2', text FROM conversations""")
def src8(spark, d):
    out, _ = _folders(spark)
    turn = F.struct(F.col("role").alias("text"))
    table(spark, d, "conversations").select(
        F.struct(F.concat(F.lit("m"), F.concat_ws("_", "conv_id", "turn")).alias("initial_data_id")).alias("metadata"),
        F.array(F.struct(F.array(turn, turn).alias("dialog"))).alias("previous_dialogs"),
        F.array(F.struct(F.lit("Speaker 2").alias("id"), "text")).alias("dialog"),
        F.struct(F.col("role").alias("A"), F.lit("Who?").alias("B")).alias("self_instruct"),
    ).write.json(out)
    return R.read_persona_dialogues(spark, out, lines=True)[0]


@query("snk1_write_canonical", """SELECT 't' || doc_id AS task_id, unnest(string_split(text, chr(10))) AS text,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position FROM documents""")
def snk1(spark, d):
    out, _ = _folders(spark)
    samples = _samples(spark, d)
    W.write_canonical(samples, out)
    W.write_canonical(samples.where("task_id = ''"), out)  # kept: no rebuild asked for
    return R.to_long(R.read_canonical(spark, out))[0]


@query("snk2_append_results", f"SELECT 'q' || event_id AS qid, event_type AS response {_GOOD}")
def snk2(spark, d):
    out, _ = _folders(spark)
    rows = table(spark, d, "events").select(F.concat(F.lit("q"), "event_id").alias("qid"), F.col("event_type").alias("response"))
    W.append_results(rows.where("response = 'click'"), out)
    W.append_results(rows.where("response <> 'view'"), out, I.completed(R.read_responses(spark, out), ["qid"]))
    return R.read_responses(spark, out).select("qid", "response")


@query("snk3_write_training", """SELECT conv_id AS task_id, count(*) AS n_questions, max(n) AS num_chunks FROM (
  SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) WHERE role = 'user' GROUP BY conv_id""")
def snk3(spark, d):
    out, _ = _folders(spark)
    chunks, q = chunks_and_questions(spark, d)
    q = q.select("task_id", "qid", F.col("position").alias("ord"), "query", F.col("query").alias("answer"))
    W.write_training(S.require_rows(S.training_rows(chunks, q, "set", "agent")), out)
    rows = spark.read.parquet(out)
    return rows.groupBy(F.col("extra_info.task_id").alias("task_id")).agg(
        F.sum(F.size("extra_info.question_ids")).alias("n_questions"), F.max("extra_info.num_chunks").alias("num_chunks")
    )


@query("snk4_write_report", f"""WITH {SQL_SCORES}
SELECT agent, metric, round(avg(nullif(value, -1)), 6) AS avg_value, count(nullif(value, -1)) AS n_valid FROM long_scores GROUP BY agent, metric""")
def snk4(spark, d):
    out, _ = _folders(spark)
    W.write_report(REP.mean_valid(long_scores(spark, d), ["agent"]), out)
    return spark.read.schema("agent string, metric string, avg_value double, n_valid bigint").option("header", True).csv(out)


@query("snk5_write_chunks", "SELECT user_id AS corpus, count(*) AS n_records FROM events GROUP BY user_id")
def snk5(spark, d):
    out, _ = _folders(spark)
    W.write_chunks(C.chunk_narrative(narrative(spark, d), "corpus", "ord", NARRATIVE_FIELDS, 100, 200), out, "corpus")
    chunks = spark.read.schema("corpus bigint, chunk_id bigint, record_count bigint").json(f"{out}/json")
    return chunks.groupBy("corpus").agg(F.sum("record_count").alias("n_records"))
