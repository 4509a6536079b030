"""Normalisation of raw question/answer rows, documents and narratives."""

from pyspark.sql import functions as F

from convoeval.functions.text import add_label_hint, prefix_date, split_documents
from convoeval.operators import normalise as N
from convoeval.plans.registry import query, table
from convoeval.plans.views import SQL_NARRATIVE, narrative, sql_strip


def raw_qa(spark, d):
    """Question/answer rows with JSON text columns, one per document."""
    docs = table(spark, d, "documents")
    chunks = F.when(F.col("doc_id") % 7 == 0, "{bad").otherwise(F.to_json(F.split("text", "\n")))
    pairs = F.concat(
        F.lit('[{"question": "Which language?", "answer": "'), "lang",
        F.lit('"}, {"question": "", "answer": "x"}, {"question": "How long?", "answers": ["'),
        F.col("n_chars").cast("string"), F.lit('", "chars"]}, ["Where from?", "'), "source",
        F.lit('"], ["id'), "doc_id", F.lit('", "Which id?", "'), "doc_id", F.lit('"]]'),
    )
    return docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" d"), "doc_id")).alias("instance_id"),
        F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("data_source"),
        chunks.alias("chunks"),
        F.when(F.col("doc_id") % 11 == 0, "nonsense").otherwise(pairs).alias("questions_and_answers"),
    )


_LINES = """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS position
  FROM documents WHERE doc_id % 7 <> 0)"""
_PAIRS = """pairs AS (
  SELECT doc_id, 0 AS i, 'Which language?' AS question, lang AS answer FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id, 1, '', 'x' FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id, 2, 'How long?', n_chars || ', chars' FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id, 3, 'Where from?', source FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT doc_id, 4, 'Which id?', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 11 <> 0)"""
_TASK = "'qa_' || CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id AS VARCHAR) ELSE 'd' || doc_id END"


@query("src1_read_samples", """
SELECT doc_id, source AS data_source FROM documents WHERE source = 'src3'""")
def src1(spark, d):
    from convoeval.sources.readers import read_samples

    docs = read_samples(spark, f"{d}/documents.parquet", "src3", column="source")
    return docs.select("doc_id", F.col("source").alias("data_source"))


@query("nrm1_parse_chunks", f"WITH {_LINES} SELECT doc_id, position, text FROM lines")
def nrm1(spark, d):
    return raw_qa(spark, d).select("doc_id", F.posexplode(N.parse_chunks(F.col("chunks"))).alias("position", "text"))


@query("nrm2_parse_qa_pairs", f"WITH {_PAIRS} SELECT doc_id, count(*) AS n_pairs FROM pairs GROUP BY doc_id "
       "UNION ALL SELECT doc_id, 0 FROM documents WHERE doc_id % 11 = 0")
def nrm2(spark, d):
    return raw_qa(spark, d).select(
        "doc_id", F.size(N.parse_qa_pairs(F.col("questions_and_answers"))).alias("n_pairs")
    )


@query("nrm3_extract_qa", f"WITH {_PAIRS} SELECT doc_id, i, question, answer FROM pairs")
def nrm3(spark, d):
    pairs = raw_qa(spark, d).select(
        "doc_id", F.posexplode(N.parse_qa_pairs(F.col("questions_and_answers"))).alias("i", "pair")
    )
    qa = N.extract_qa(F.col("pair"))
    return pairs.withColumn("qa", qa).select("doc_id", "i", "qa.question", "qa.answer")


@query("nrm4_resolve_id", f"SELECT doc_id, {_TASK} AS task_id FROM documents")
def nrm4(spark, d):
    rid = N.resolve_id([F.col("instance_id")], F.col("doc_id"))
    return raw_qa(spark, d).select("doc_id", F.concat(F.lit("qa_"), rid).alias("task_id"))


@query("nrm5_build_samples_questions", f"""WITH {_PAIRS}
SELECT {_TASK} || '_' || i AS qid, {_TASK} AS task_id, question AS query, answer,
       CASE WHEN doc_id % 7 = 0 THEN 0 ELSE len(string_split(d.text, chr(10))) - 1 END AS position,
       CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE d.source END AS category
FROM pairs JOIN documents d USING (doc_id) WHERE question <> ''""")
def nrm5(spark, d):
    return N.build_samples(raw_qa(spark, d), ["instance_id"], "qa", "unknown", "doc_id")[1]


@query("nrm5_build_samples_chunks", f"WITH {_LINES} SELECT {_TASK} AS task_id, position, text FROM lines")
def nrm5_chunks(spark, d):
    return N.build_samples(raw_qa(spark, d), ["instance_id"], "qa", "unknown", "doc_id")[0]


_HINT = "What are the labels for the above sentence?"


@query("nrm6_label_hint", f"""WITH q AS (
  SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text || ' {_HINT}' ELSE text END AS query FROM benchmark)
SELECT item_id, CASE WHEN contains(query, '{_HINT}') THEN query
                     ELSE 'Sentence: ' || query || chr(10) || '{_HINT}' END AS query FROM q""")
def nrm6(spark, d):
    given = F.when(F.col("item_id") % 3 == 0, F.concat("text", F.lit(" " + _HINT))).otherwise(F.col("text"))
    return table(spark, d, "benchmark").select("item_id", add_label_hint(given).alias("query"))


@query("nrm7_source_catalog", """WITH asked AS (
  SELECT DISTINCT n_name || CASE WHEN n_nationkey % 3 = 0 THEN '_' || (n_nationkey + 10)
                                 WHEN n_nationkey % 3 = 1 THEN '-s' || n_nationkey ELSE '' END AS task,
         n_name, n_nationkey, n_regionkey FROM nation),
c AS (SELECT n_name AS task, n_regionkey FROM nation WHERE n_regionkey <> 2)
SELECT a.task, 'source_' || c.n_regionkey AS data_source, lower(c.task) AS prefix, c.n_regionkey = 1 AS hint,
       CASE WHEN c.task IS NULL THEN NULL WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey + 10 AS VARCHAR)
            WHEN n_nationkey % 3 = 1 THEN 's' || n_nationkey END AS parameter
FROM asked a LEFT JOIN c ON c.task = a.n_name""")
def nrm7(spark, d):
    nation = table(spark, d, "nation")
    key = F.col("n_nationkey")
    suffix = (
        F.when(key % 3 == 0, F.concat(F.lit("_"), (key + 10).cast("string")))
        .when(key % 3 == 1, F.concat(F.lit("-s"), key.cast("string"))).otherwise("")
    )
    asked = nation.select(F.concat("n_name", suffix).alias("task"))
    catalog = nation.where("n_regionkey <> 2").select(
        F.col("n_name").alias("task"),
        F.concat(F.lit("source_"), "n_regionkey").alias("data_source"),
        F.lower("n_name").alias("prefix"),
        (F.col("n_regionkey") == 1).alias("hint"),
    )
    return N.source_catalog(asked, catalog)


@query("nrm8_flatten_answer", """
SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS part,
  CASE WHEN l_linenumber % 3 = 0 THEN '1. ' || l_returnflag || chr(10) || '2. ' || l_linestatus
       WHEN l_linenumber % 3 = 1 THEN l_returnflag || ', ' || l_suppkey ELSE l_returnflag END AS answer
FROM lineitem""")
def nrm8(spark, d):
    n = F.col("l_linenumber") % 3
    raw = (
        F.when(n == 0, F.concat(F.lit('[{"event": "'), "l_returnflag", F.lit('", "x": 1}, {"text": "'), "l_linestatus", F.lit('"}]')))
        .when(n == 1, F.concat(F.lit('["'), "l_returnflag", F.lit('", '), "l_suppkey", F.lit("]")))
        .otherwise(F.col("l_returnflag"))
    )
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"),
        N.flatten_answer(raw).alias("answer"),
    )


@query("nrm9_rewrite_by_category", """WITH q AS (SELECT 'q_' || o_orderkey AS qid, 'What about ' || o_orderpriority || '?' AS query, o_orderstatus AS answer,
  'nothing' AS adversarial_answer, CAST(o_custkey % 5 + 1 AS INTEGER) AS category,
  CAST('0x' || left(md5('0|q_' || o_orderkey), 15) AS BIGINT) % 2 = 0 AS first FROM orders)
SELECT qid, CASE category WHEN 2 THEN query || ' Use DATE of CONVERSATION to answer with an approximate date.'
  WHEN 5 THEN query || ' Select the correct answer: (a) ' || CASE WHEN first THEN 'Not mentioned in the conversation' ELSE 'nothing' END
    || ' (b) ' || CASE WHEN first THEN 'nothing' ELSE 'Not mentioned in the conversation' END || '. ' ELSE query END AS query,
  CASE WHEN category <> 5 THEN answer WHEN first THEN 'a' ELSE 'b' END AS answer, adversarial_answer, category FROM q""")
def nrm9(spark, d):
    q = table(spark, d, "orders").select(
        F.concat(F.lit("q_"), "o_orderkey").alias("qid"),
        F.concat(F.lit("What about "), "o_orderpriority", F.lit("?")).alias("query"),
        F.col("o_orderstatus").alias("answer"),
        F.lit("nothing").alias("adversarial_answer"),
        (F.col("o_custkey") % 5 + 1).cast("int").alias("category"),
    )
    return N.rewrite_by_category(q)


@query("nrm10_evidence_session", """
SELECT l_orderkey AS task_id, l_linenumber AS n, l_partkey AS part,
       CASE WHEN l_linenumber = 1 THEN 40 ELSE greatest(l_linenumber, CAST(l_quantity AS INTEGER)) END AS session
FROM lineitem""")
def nrm10(spark, d):
    evidence = F.when(F.col("l_linenumber") == 1, F.array().cast("array<string>")).otherwise(
        F.array(
            F.concat(F.lit("D"), "l_linenumber", F.lit(":3")),
            F.concat(F.lit("D"), F.col("l_quantity").cast("int"), F.lit(":12")),
        )
    )
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"),
        N.evidence_session(evidence, F.lit(40)).alias("session"),
    )


@query("nrm11_split_documents", f"""WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
SELECT doc_id, i - 1 AS position, {sql_strip("'Document ' || i || ': ' || t")} AS text FROM l""")
def nrm11(spark, d):
    numbered = F.transform(
        F.split("text", "\n"), lambda t, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(": "), t)
    )
    contexts = table(spark, d, "documents").select("doc_id", F.array_join(numbered, "\n").alias("context"))
    return contexts.select("doc_id", F.posexplode(split_documents(F.col("context"))).alias("position", "text"))


@query("nrm12_dedupe_documents", """WITH f AS (
  SELECT text, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text)
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index, copies FROM f""")
def nrm12(spark, d):
    out = N.dedupe_documents(table(spark, d, "documents"), "doc_id", F.col("text"))
    return out.select("doc_id", "doc_index", "copies")


@query("nrm13_mix_distractors", """WITH f AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text),
ix AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index FROM f),
t AS (SELECT count(*) AS n FROM ix),
need AS (SELECT DISTINCT b.item_id AS qid, ix.doc_index FROM benchmark b JOIN ix ON ix.doc_id IN (b.item_id, b.item_id + 7)),
draws AS (SELECT DISTINCT b.item_id AS qid, CAST('0x' || left(md5('42|' || b.item_id || '|' || i), 15) AS BIGINT) % t.n AS doc_index
  FROM benchmark b, t, (SELECT unnest(generate_series(0, 80)) AS i)),
free AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CAST('0x' || left(md5('42|' || qid || '|' || doc_index), 15) AS BIGINT)) AS r
  FROM draws d WHERE NOT EXISTS (SELECT 1 FROM need n WHERE n.qid = d.qid AND n.doc_index = d.doc_index)),
room AS (SELECT item_id AS qid, 20 - (SELECT count(*) FROM need n WHERE n.qid = item_id) AS room FROM benchmark),
kept AS (SELECT qid, doc_index, TRUE AS supporting FROM need
  UNION ALL SELECT qid, doc_index, FALSE FROM free JOIN room USING (qid) WHERE r <= room)
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY CAST('0x' || left(md5('43|' || qid || '|' || doc_index), 15) AS BIGINT)) - 1 AS position,
  doc_index, supporting FROM kept""")
def nrm13(spark, d):
    docs = N.dedupe_documents(
        table(spark, d, "documents").withColumn("title", F.concat(F.lit("t"), "doc_id")), "doc_id", F.col("text")
    ).select("doc_index", "title", "text")
    needs = table(spark, d, "benchmark").select(
        F.col("item_id").alias("qid"), F.explode(F.array("item_id", F.col("item_id") + 7)).alias("n")
    ).select("qid", F.concat(F.lit("t"), "n").alias("title"))
    return N.mix_distractors(needs, docs, 20, 42).select("qid", "position", "doc_index", "supporting")


@query("nrm14_spread_positions", """
SELECT event_id, i, CASE WHEN user_id <= event_id THEN user_id + (i * (event_id - user_id)) // 4 ELSE event_id END AS position
FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS i)""")
def nrm14(spark, d):
    spread = N.spread_positions(F.col("user_id").cast("int"), F.col("event_id").cast("int"), 5)
    return table(spark, d, "events").select("event_id", F.posexplode(spread).alias("i", "position"))


@query("nrm15_merge_samples", """WITH s AS (
  SELECT conv_id, max(turn) + 1 AS n_chunks FROM conversations GROUP BY conv_id),
r AS (SELECT *, row_number() OVER (ORDER BY conv_id) - 1 AS r FROM s),
b AS (SELECT *, r // 5 AS batch FROM r)
SELECT batch, 'c' || conv_id AS task_id,
  'batch_' || batch || '_c' || min(conv_id) OVER (PARTITION BY batch) || '_to_c' || max(conv_id) OVER (PARTITION BY batch) AS merged_id,
  CAST(coalesce(sum(n_chunks) OVER (PARTITION BY batch ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
FROM b""")
def nrm15(spark, d):
    s = table(spark, d, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("n_chunks"))
    return N.merge_samples(s.withColumn("task_id", F.concat(F.lit("c"), "conv_id")), "conv_id", 5)


@query("nrm16_filter_long", """
SELECT source, lang, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS n_chars FROM documents
GROUP BY source, lang HAVING sum(length(text)) + count(*) - 1 > 20000""")
def nrm16(spark, d):
    return N.filter_long(table(spark, d, "documents"), ["source", "lang"], "text", 20000)


@query("nrm17_filter_categories", """WITH kept AS (SELECT c_custkey, o_orderkey, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
SELECT DISTINCT c_custkey AS task_id, NULL::BIGINT AS qid, NULL::VARCHAR AS category FROM kept
UNION ALL SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def nrm17(spark, d):
    samples = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"))
    questions = table(spark, d, "orders").select(
        F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("qid"), F.col("o_orderpriority").alias("category")
    )
    kept, asked = N.filter_categories(samples, questions, ["1-URGENT", "2-HIGH"])
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in (("qid", "long"), ("category", "string"))]
    return kept.select("task_id", *empty).unionByName(asked)


@query("nrm18_index_by_id", """
SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
       arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def nrm18(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    return N.index_by_id(e, ["user_id"], "event_id")


@query("nrm19_detect_layout", """SELECT doc_id, lang AS action, source AS "Mind", 'Mind' AS layout FROM documents""")
def nrm19(spark, d):
    named = table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("action"), F.col("source").alias("Mind")
    )
    return named.withColumn("layout", F.lit(N.detect_layout(named.columns)))


@query("nrm20_unify_fields", f"""WITH {SQL_NARRATIVE}
SELECT corpus, ord, action, dialogue, environment, location AS inner_thought FROM narrative""")
def nrm20(spark, d):
    n = narrative(spark, d).select(
        "corpus", "ord", "action", "dialogue", F.col("environment").alias("Environment"), F.col("location").alias("Mind")
    )
    return N.unify_fields(n)


@query("nrm21_attach_source_prompt", """WITH q AS (
  SELECT o_custkey AS task_id, o_orderkey AS ord, CASE WHEN o_orderstatus = 'O' THEN '' ELSE o_orderpriority END AS category FROM orders),
s AS (SELECT task_id, coalesce(arg_min(category, ord) FILTER (WHERE category <> ''), 'none') AS data_source FROM q GROUP BY task_id),
p AS (SELECT DISTINCT o_orderpriority AS data_source, 'answer for ' || o_orderpriority AS query_prompt, FALSE AS including_core
      FROM orders WHERE o_orderpriority LIKE '%U%')
SELECT s.task_id, s.data_source, p.query_prompt, coalesce(p.including_core, TRUE) AS including_core
FROM s LEFT JOIN p USING (data_source)""")
def nrm21(spark, d):
    o = table(spark, d, "orders")
    q = o.select(
        F.col("o_custkey").alias("task_id"), F.col("o_orderkey").alias("ord"),
        F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderpriority")).alias("category"),
    )
    prompts = o.where(F.contains("o_orderpriority", F.lit("U"))).select(
        F.col("o_orderpriority").alias("data_source"),
        F.concat(F.lit("answer for "), "o_orderpriority").alias("query_prompt"),
        F.lit(False).alias("including_core"),
    ).distinct()
    return N.attach_source_prompt(q, prompts, "none")


@query("nrm22_order_questions", """WITH q AS (
  SELECT p_partkey, 'size' AS qid, p_size AS position FROM part
  UNION ALL SELECT p_partkey, 'key', CAST(p_partkey % 50 AS INTEGER) FROM part
  UNION ALL SELECT p_partkey, 'name', CAST(length(p_name) AS INTEGER) FROM part)
SELECT p_partkey, string_agg(qid, ',' ORDER BY position, qid) AS qids FROM q GROUP BY p_partkey""")
def nrm22(spark, d):
    def q(qid, position):
        return F.struct(F.lit(qid).alias("qid"), position.cast("int").alias("position"))

    nested = table(spark, d, "part").select(
        "p_partkey",
        F.array(q("size", F.col("p_size")), q("key", F.col("p_partkey") % 50), q("name", F.length("p_name")))
        .alias("questions"),
    )
    ids = F.transform(N.ordered_questions(F.col("questions")), lambda x: x["qid"])
    return nested.select("p_partkey", F.array_join(ids, ",").alias("qids"))


@query("nrm23_first_answer", """
SELECT event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS answer FROM events""")
def nrm23(spark, d):
    answers = F.when(F.col("event_type") == "view", F.array().cast("array<string>")).otherwise(
        F.array("event_type", F.col("value").cast("string"))
    )
    return table(spark, d, "events").select("event_id", N.first_answer(answers).alias("answer"))


@query("nrm24_prefix_date", """
SELECT o_orderkey, '[' || strftime(o_orderdate, '%Y-%m-%d') || '] ' || o_orderpriority AS query FROM orders""")
def nrm24(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", prefix_date(F.col("o_orderpriority"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("query")
    )
