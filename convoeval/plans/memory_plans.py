"""Memory items, edits, ledgers kept as titled values."""

from pyspark.sql import functions as F

from convoeval.operators import memory as M
from convoeval.plans.registry import query, table
from convoeval.plans.views import SQL_EDITS, SQL_EVENT_LEDGER, event_ledger, memory_edits, sql_strip


def memory_texts(spark, d):
    """Memory texts: the lines of a conversation turn as stamped items, some broken."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda l, i: F.when(i % 3 == 2, l).otherwise(
            F.concat(F.lit("  [m"), (i + 1).cast("string"), F.lit("][mentioned at 2024-01-02] "), l,
                     F.when(i % 2 == 0, " [a, b]").otherwise(""))
        ),
    )
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(lines, "\n").alias("memory"))


_ITEMS = """l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations),
items AS (SELECT conv_id, turn, CAST(i AS INTEGER) AS line_no, 'm' || (i + 1) AS memory_id, '2024-01-02' AS mentioned_at,
  trim(t) AS content, CASE WHEN i % 2 = 0 THEN 'a, b' ELSE '' END AS links FROM l WHERE i % 3 <> 2 AND trim(t) <> '')"""


@query("mem1_parse_items", f"WITH {_ITEMS} SELECT * FROM items")
def mem1(spark, d):
    return M.parse_items(memory_texts(spark, d), ["conv_id", "turn"], "memory")


@query("mem1_parse_items_multiline", rf"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS t,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations),
b AS (SELECT conv_id, turn, i, CASE WHEN i % 6 = 1 THEN t || chr(10) || coalesce(lead(t) OVER (PARTITION BY conv_id, turn ORDER BY i), '') ELSE t END AS body FROM l)
SELECT conv_id, turn, i::INT AS item, 'm' || (i + 1) AS memory_id, '2024-01-02' AS mentioned_at, {sql_strip('body')} AS content
FROM b WHERE i % 3 <> 2 AND {sql_strip('body')} <> ''""")
def mem1_multiline(spark, d):
    items = M.parse_items_multiline(memory_texts(spark, d), ["conv_id", "turn"], "memory")
    number = F.substring("memory_id", 2, 9).cast("int") - 1
    return items.select("conv_id", "turn", number.alias("item"), "memory_id", "mentioned_at", "content")


@query("mem2_format_items", f"""WITH {_ITEMS}
SELECT conv_id, turn, string_agg('[' || memory_id || '][mentioned at 2024-01-02] ' || content || ' [' || links || ']', chr(10) ORDER BY line_no) AS text
FROM items GROUP BY ALL""")
def mem2(spark, d):
    items = M.parse_items(memory_texts(spark, d), ["conv_id", "turn"], "memory")
    return M.format_items(items, ["conv_id", "turn"], "line_no")


@query("mem3_stamp_lines", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS line_no, left(md5(doc_id || '|' || i), 8) AS memory_id, '2024-03-01' AS mentioned_at,
       trim(t) AS content, '' AS links FROM l WHERE trim(t) <> ''""")
def mem3(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit("2024-03-01").alias("day"))
    return M.stamp_lines(docs, ["doc_id"], "text", "day")


@query("mem4_parse_sections", """SELECT event_id, event_type || chr(10) || 'k' AS activity, props AS reasoning,
  CASE WHEN event_id % 2 = 0 THEN 'perhaps ' || event_type ELSE '' END AS theory_of_mind FROM events""")
def mem4(spark, d):
    text = F.concat(
        F.lit("intro\n**REASONING PROCESS:**\n  "), "props", F.lit("\n\n**Activity Items: **\n"), "event_type",
        F.lit("\n**Other**\n k \n**INFERENCE ITEMS:**\n"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("perhaps "), "event_type")).otherwise(""),
    )
    s = table(spark, d, "events").select("event_id", M.sections(text, M.SECTION_HEADERS).alias("s"))
    return s.select("event_id", *[F.col("s")[n].alias(n) for n in M.SECTION_HEADERS.values()])


@query("mem5_parse_suggestions", """SELECT event_id, 'profile' AS category, event_type || chr(10) || props AS suggestion FROM events
UNION ALL SELECT event_id, 'event', props FROM events WHERE event_type <> 'view'""")
def mem5(spark, d):
    text = F.concat(
        F.lit("**Category: profile**\n- Suggestion: "), "event_type", F.lit("\nnote\n  - Suggestion: "), "props",
        F.lit("\n**Category: unknown**\n- Suggestion: lost\n**Category: event**\n- Suggestion:"),
        F.when(F.col("event_type") != "view", F.col("props")).otherwise(""),
    )
    s = table(spark, d, "events").select("event_id", F.explode(M.parse_suggestions(text, ["profile", "event"])).alias("s"))
    return s.select("event_id", "s.category", "s.suggestion")


@query("mem6_parse_operations", """SELECT event_id, 0 AS i, 'ADD' AS operation, 't9' AS target_id, event_type AS content FROM events
UNION ALL SELECT event_id, 1, 'DELETE', 'm' || user_id, NULL FROM events WHERE event_type <> 'click'""")
def mem6(spark, d):
    text = F.concat(
        F.lit("start\n**OPERATION:** ADD\n- Memory Item Content: "), "event_type",
        F.lit("\n**OPERATION:** MERGE\n- Target Memory ID: t9"),
        F.when(F.col("event_type") != "click", F.concat(F.lit("\n**OPERATION:** DELETE\n - Target Memory ID: m"), "user_id")).otherwise(""),
    )
    ops = table(spark, d, "events").select("event_id", F.posexplode(M.parse_operations(text)).alias("i", "o"))
    return ops.select("event_id", "i", "o.*")


@query("mem7_apply_operations", f"""WITH {SQL_EDITS},
del AS (SELECT key, target_id, max(seq) AS cut FROM edits WHERE operation = 'DELETE' GROUP BY ALL),
alive AS (SELECT e.key, e.target_id AS memory_id, e.seq, e.content, e.mentioned_at,
            row_number() OVER (PARTITION BY e.key, e.target_id ORDER BY e.seq) AS r
          FROM edits e LEFT JOIN del d ON d.key = e.key AND d.target_id = e.target_id
          WHERE e.operation = 'ADD' AND e.seq > coalesce(d.cut, -1))
SELECT a.key, a.memory_id, a.seq, coalesce(CASE WHEN r = 1 THEN (
    SELECT arg_max(u.content, u.seq) FROM edits u WHERE u.operation = 'UPDATE' AND u.key = a.key
      AND u.target_id = a.memory_id AND u.seq > a.seq) END, a.content) AS content, a.mentioned_at, '' AS links
FROM alive a""")
def mem7(spark, d):
    return M.apply_operations(memory_edits(spark, d))


@query("mem7_executed_counts", f"""WITH {SQL_EDITS}
SELECT key, operation, count(*) AS n FROM edits GROUP BY ALL""")
def mem7_counts(spark, d):
    return M.executed_counts(memory_edits(spark, d))


@query("mem8_kv_replay", f"""WITH {SQL_EDITS},
l AS (SELECT target_id AS title, arg_max(operation, seq) AS op, max(seq) AS seq FROM edits WHERE operation <> 'TOUCH' GROUP BY ALL)
SELECT title, 'v' || seq AS content FROM l WHERE op <> 'DELETE'""")
def mem8(spark, d):
    ops = memory_edits(spark, d).where("operation <> 'TOUCH'").withColumnRenamed("target_id", "title")
    return M.kv_replay(ops, ["title"])


_KV = f"""WITH {SQL_EVENT_LEDGER},
kv AS (SELECT strftime(date, '%Y-%m-%d') || '_' || scene || '_Amount' AS title, round(sum(amount), 2) AS value FROM event_ledger GROUP BY date, scene
UNION ALL SELECT strftime(date, '%Y-%m-%d') || '_' || scene || '_Count', CAST(count(*) AS DOUBLE) FROM event_ledger GROUP BY date, scene
UNION ALL SELECT strftime(date, '%Y-%m-%d') || '_LargestSingleTransactionAmount', max(amount) FROM event_ledger GROUP BY date
UNION ALL SELECT strftime(date, '%Y-%m-%d') || '_TotalAmount', round(sum(amount), 2) FROM event_ledger GROUP BY date
UNION ALL SELECT 'GlobalTotalAmount', round(sum(amount), 2) FROM event_ledger)"""


@query("ret12_memory_get", f"{_KV} SELECT title, value FROM kv WHERE title IN (SELECT strftime(o_orderdate, '2024-%m-%d') || '_TotalAmount' FROM orders)")
def ret12(spark, d):
    day = F.date_format("o_orderdate", "MM-dd")
    titles = table(spark, d, "orders").select(
        F.concat(F.lit("2024-"), day, F.lit("_TotalAmount")).alias("title")
    ).distinct()
    return M.memory_get(M.running_ledger(event_ledger(spark, d), []), titles)


@query("ret13_memory_list", f"{_KV} SELECT title, value FROM kv WHERE contains(title, '_purchase_')")
def ret13(spark, d):
    return M.memory_list(M.running_ledger(event_ledger(spark, d), []), "_purchase_")


@query("mem9_category_store", f"""WITH {SQL_EDITS},
old AS (SELECT key, CASE WHEN seq % 3 = 0 THEN 'activity' WHEN seq % 3 = 1 THEN 'profile' ELSE 'event' END AS category, seq, content FROM edits WHERE operation = 'ADD'),
new AS (SELECT key, CASE WHEN seq % 4 = 0 THEN 'activity' WHEN seq % 4 = 1 THEN 'profile' WHEN seq % 4 = 2 THEN 'event' ELSE 'hobby' END AS category, seq, content FROM edits WHERE operation = 'UPDATE' AND key % 2 = 0)
SELECT key AS character, category, seq, content FROM new WHERE category <> 'hobby'
UNION ALL SELECT key, category, seq, content FROM old WHERE category = 'activity'
  OR NOT EXISTS (SELECT 1 FROM new WHERE new.key = old.key AND new.category = old.category)""")
def mem9(spark, d):
    e = memory_edits(spark, d).withColumnRenamed("key", "character")
    three = F.when(F.col("seq") % 3 == 0, "activity").when(F.col("seq") % 3 == 1, "profile").otherwise("event")
    four = (
        F.when(F.col("seq") % 4 == 0, "activity").when(F.col("seq") % 4 == 1, "profile")
        .when(F.col("seq") % 4 == 2, "event").otherwise("hobby")
    )
    old = e.where("operation = 'ADD'").select("character", three.alias("category"), "seq", "content")
    new = e.where("operation = 'UPDATE' AND character % 2 = 0").select("character", four.alias("category"), "seq", "content")
    return M.category_store(old, new, M.CATEGORIES, ["activity"])


@query("mem10_running_ledger", f"{_KV} SELECT title, value FROM kv")
def mem10(spark, d):
    return M.running_ledger(event_ledger(spark, d), [])


_CALLS = """c AS (SELECT user_id AS task_id, CASE WHEN event_type IN ('view', 'click') THEN 'qa_stage' ELSE 'memory_stage' END AS stage,
    event_type AS tool, 1 AS n FROM events
  UNION ALL SELECT user_id, CASE WHEN event_type IN ('view', 'click') THEN 'qa_stage' ELSE 'memory_stage' END, 'retrieve',
    CAST(json_extract_string(props, '$.k') AS INTEGER) FROM events)"""


@query("mem13_tool_call_stats", f"WITH {_CALLS} SELECT task_id, stage, tool, CAST(sum(n) AS BIGINT) AS calls FROM c GROUP BY ALL")
def mem13(spark, d):
    counts = F.create_map(
        "event_type", F.lit(1), F.lit("retrieve"), F.get_json_object("props", "$.k").cast("int")
    )
    outputs = table(spark, d, "events").select(
        F.col("user_id").alias("task_id"),
        F.col("event_type").isin("view", "click").cast("int").alias("is_final"),
        counts.alias("tool_counts"),
    )
    return M.tool_call_stats(outputs)


@query("mem14_memory_stats", """WITH a AS (SELECT l_orderkey AS task_id, count(*) AS num_abstracts FROM lineitem GROUP BY 1),
p AS (SELECT o_orderkey AS task_id, count(*) AS num_pages FROM orders GROUP BY 1)
SELECT coalesce(a.task_id, p.task_id) AS task_id, coalesce(num_abstracts, 0) AS num_abstracts, coalesce(num_pages, 0) AS num_pages
FROM a FULL JOIN p ON a.task_id = p.task_id""")
def mem14(spark, d):
    return M.memory_stats(
        table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id")),
        table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id")),
    )
