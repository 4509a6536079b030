"""Session text: rendering, parsing, packing, chunking."""

from pyspark.sql import functions as F

from convoeval.functions import text as X
from convoeval.operators import chunking as C
from convoeval.operators import joins as J
from convoeval.operators import normalise as N
from convoeval.operators import routing
from convoeval.plans.registry import query, table
from convoeval.plans.views import (
    NARRATIVE_FIELDS, SQL_NARRATIVE, SQL_SPACE, narrative, sql_collapse, sql_strip,
)


def rendered(spark, d):
    """Every conversation as a rendered session chunk."""
    t = table(spark, d, "conversations")
    date = F.concat(F.lit("2024-01-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"), F.lit(" (day)"))
    line = N.speaker_line("role", F.col("role"), F.col("text"), F.col("turn"))
    head = N.session_head(F.lit("user"), F.lit("assistant"), date)
    return N.render_sessions(t, ["conv_id"], "turn", line, head)


_RENDERED = """rendered AS (
  SELECT conv_id, 'Below is a conversation between user and assistant.' || chr(10) || chr(10) || 'DATE: 2024-01-'
    || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') || ' (day)' || chr(10) || 'CONVERSATION:' || chr(10)
    || string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ' said, "' || text || '"' || chr(10), '' ORDER BY turn)
    || chr(10) || chr(10) AS text
  FROM conversations GROUP BY conv_id)"""


@query("txt1_render_session", f"WITH {_RENDERED} SELECT conv_id, text FROM rendered")
def txt1(spark, d):
    return rendered(spark, d)


@query("txt1_render_styles", """WITH l AS (
  SELECT conv_id, turn, role || ' said, "' || text || '"' || CASE WHEN turn % 2 = 0 THEN ' and shared a picture' ELSE '' END AS quoted,
    CASE WHEN turn % 2 = 0 THEN 'Speaker 1' ELSE 'Speaker 2' END || ' said, "' || text || '"' AS alternating,
    role || ': ' || text AS plain FROM conversations)
SELECT * FROM l""")
def txt1_styles(spark, d):
    caption = F.when(F.col("turn") % 2 == 0, "a picture")
    at = [F.col("role"), F.col("text"), F.col("turn")]
    return table(spark, d, "conversations").select(
        "conv_id", "turn", N.speaker_line("quoted", *at, caption).alias("quoted"),
        N.speaker_line("alternating", *at).alias("alternating"), N.speaker_line("plain", *at).alias("plain"),
    )


@query("txt2_parse_turns", f"""WITH l AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role,
    array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> ''), chr(10)) AS content,
    '2024-01-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') AS date FROM conversations)
SELECT conv_id, turn, date, role,
  CASE WHEN contains(content, chr(10)) THEN '"' || content || '"' ELSE content END AS content
FROM l WHERE content <> ''""")
def txt2(spark, d):
    return N.parse_turns(rendered(spark, d), ["conv_id"]).withColumn("turn", F.col("turn").cast("long"))


@query("txt3_flatten_haystack", """
SELECT conv_id, turn, '[' || CASE WHEN conv_id % 4 = 0 THEN 'Unknown' ELSE '2024-02-' || lpad(CAST(conv_id % 28 + 1 AS VARCHAR), 2, '0') END
       || '] ' || role || ': ' || text AS line FROM conversations""")
def txt3(spark, d):
    day = F.concat(F.lit("2024-02-"), F.lpad((F.col("conv_id") % 28 + 1).cast("string"), 2, "0"))
    date = F.coalesce(F.when(F.col("conv_id") % 4 != 0, day), F.lit("Unknown"))
    line = F.concat(F.lit("["), date, F.lit("] "), N.speaker_line("plain", F.col("role"), F.col("text"), F.col("turn")))
    return table(spark, d, "conversations").select("conv_id", "turn", line.alias("line"))


_FOLD = """list_reduce(string_split(text, chr(10)), lambda a, l:
    CASE WHEN split_part(a, chr(1), -1) = '' THEN
           CASE WHEN contains(a, chr(1)) THEN left(a, length(a) - length(split_part(a, chr(1), -1))) || l ELSE l END
         WHEN length(split_part(a, chr(1), -1)) + length(l) + 1 <= 1000 THEN a || chr(10) || l
         ELSE a || chr(1) || l END)"""


@query("txt4_pack_lines", f"""WITH p AS (SELECT doc_id, string_split({_FOLD}, chr(1)) AS c FROM documents),
e AS (SELECT doc_id, unnest(c) AS piece, generate_subscripts(c, 1) AS i FROM p)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position, piece FROM e WHERE piece <> ''""")
def txt4(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.posexplode_outer(X.pack_lines(F.col("text"), 1000)).alias("position", "piece")
    ).where("position IS NOT NULL")


@query("txt5_split_words", f"""WITH RECURSIVE w AS (
  SELECT doc_id, text AS rest, -1 AS position, CAST('' AS VARCHAR) AS piece, length(text) <= 5000 AS whole FROM documents
  UNION ALL
  SELECT doc_id, CASE WHEN whole THEN '' ELSE regexp_replace(substr(rest, cut + 1), '^{SQL_SPACE}+', '') END, position + 1,
    CASE WHEN whole THEN rest ELSE {sql_strip('left(rest, cut)')} END, whole
  FROM (SELECT *, CASE WHEN whole OR length(rest) <= 5000 THEN length(rest)
          WHEN contains(substr(rest, 4801, 200), ' ') THEN 5000 - instr(reverse(substr(rest, 4801, 200)), ' ')
          ELSE 5000 END AS cut FROM w WHERE rest <> ''))
SELECT doc_id, position, piece FROM w WHERE position >= 0""")
def txt5(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.posexplode_outer(X.split_words(F.col("text"), 5000, 200)).alias("position", "piece")
    ).where("position IS NOT NULL")


@query("txt6_keep_ends", """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS c FROM documents)
SELECT doc_id, array_to_string(CASE WHEN len(c) > 6 THEN c[1:3] || c[-3:] ELSE c END, '|') AS kept FROM l""")
def txt6(spark, d):
    kept = X.keep_ends(F.split("text", "\n"), 6)
    return table(spark, d, "documents").select("doc_id", F.array_join(kept, "|").alias("kept"))


@query("txt7_join_chunks", """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)),
  lambda l, i: CASE WHEN i = 1 THEN 'Below is a conversation between a and b.' || chr(10) || l ELSE l END), chr(10) || chr(10)) AS context
FROM documents""")
def txt7(spark, d):
    headed = F.transform(
        F.split("text", "\n"), lambda l: F.concat(F.lit("Below is a conversation between a and b.\n"), l)
    )
    chunks = table(spark, d, "documents").select("doc_id", headed.alias("chunks"))
    return chunks.select("doc_id", X.join_chunks(F.col("chunks")).alias("context"))


def _sql_tokens_estimate(text):
    flat = f"({sql_collapse(text)})"
    n = lambda p: f"length(regexp_replace({flat}, '[^{p}]', '', 'g'))"
    symbols = f"length(regexp_replace({flat}, '[a-zA-Z0-9 ]', '', 'g'))"
    digits = rf"length(regexp_replace({flat}, '[^\p{{Nd}}]', '', 'g'))"
    raw = (
        f"CAST({n('a-zA-Z')} AS DOUBLE) / 4.0 + {n(chr(92) + 'x{4e00}-' + chr(92) + 'x{9fff}')} / 2.0 "
        f"+ {digits} / 3.0 + {symbols} / 2.0 + {n(' ')} / 1.5"
    )
    return f"CASE WHEN length({text}) = 0 THEN 0 ELSE greatest(1, CAST(floor(({raw}) * CAST(1.1 AS DOUBLE)) AS INTEGER)) END"


@query("txt8_estimate_tokens", f"SELECT page_id, {_sql_tokens_estimate('html')} AS tokens FROM pages")
def txt8(spark, d):
    return table(spark, d, "pages").select("page_id", X.estimate_tokens(F.col("html")).alias("tokens"))


@query("txt9_record_text", f"""WITH {SQL_NARRATIVE}
SELECT corpus, ord, concat_ws(' | ', '[' || timestamp || '] ' || location,
  concat_ws(' ', action, dialogue, environment)) AS record FROM narrative""")
def txt9(spark, d):
    r = X.record_text(F.col("timestamp"), F.col("location"), [F.col(f) for f in NARRATIVE_FIELDS])
    return narrative(spark, d).select("corpus", "ord", r.alias("record"))


@query("txt10_boundary_strength", f"""WITH {SQL_NARRATIVE},
b AS (SELECT corpus, ord, location, CAST(timestamp AS TIMESTAMP) AS ts,
        length(action) + coalesce(length(dialogue), 0) + coalesce(length(environment), 0) AS len FROM narrative),
p AS (SELECT *, lag(ts) OVER w AS pts, lag(location) OVER w AS ploc, lag(len) OVER w AS plen,
        avg(len) OVER (PARTITION BY corpus) AS mean FROM b WINDOW w AS (PARTITION BY corpus ORDER BY ord)),
g AS (SELECT *, abs(epoch(ts) - epoch(pts)) AS gap, abs(len - plen) * 1.0 / plen AS change, len / mean AS ratio FROM p),
s AS (SELECT corpus, ord, CASE WHEN plen IS NULL THEN 0.0 ELSE
  (CASE WHEN gap > 604800 THEN 0.6 WHEN gap > 86400 THEN 0.4 WHEN gap > 21600 THEN 0.2 ELSE 0.1 END)
  + (CASE WHEN location <> ploc THEN 0.3 ELSE 0.0 END)
  + (CASE WHEN change > 0.5 THEN 0.2 WHEN change > 0.3 THEN 0.15 ELSE 0.05 END)
  + (CASE WHEN ratio > 3.0 OR ratio < 0.3 THEN 0.15 ELSE 0.0 END) END AS strength FROM g)
SELECT corpus, ord, CAST(round(strength, 6) AS DOUBLE) AS strength, strength >= 0.5 AS boundary FROM s""")
def txt10(spark, d):
    marked = C.with_boundaries(narrative(spark, d), "corpus", "ord", NARRATIVE_FIELDS)
    return marked.select("corpus", "ord", "strength", "boundary")


def _sql_est(text):
    flat = f"trim(regexp_replace({text}, '{SQL_SPACE}+', ' ', 'g'))"
    return _sql_tokens_estimate(flat)


@query("txt11_semantic_chunks", f"""WITH RECURSIVE {SQL_NARRATIVE},
b AS (SELECT corpus, ord, location, timestamp, CAST(timestamp AS TIMESTAMP) AS ts,
        length(action) + coalesce(length(dialogue), 0) + coalesce(length(environment), 0) AS len,
        concat_ws(' | ', '[' || timestamp || '] ' || location, concat_ws(' ', action, dialogue, environment)) AS record FROM narrative),
p AS (SELECT *, lag(ts) OVER w AS pts, lag(location) OVER w AS ploc, lag(len) OVER w AS plen, row_number() OVER w - 1 AS i,
        avg(len) OVER (PARTITION BY corpus) AS mean, count(*) OVER (PARTITION BY corpus) AS n FROM b WINDOW w AS (PARTITION BY corpus ORDER BY ord)),
r AS MATERIALIZED (SELECT *, plen IS NOT NULL AND
  (CASE WHEN abs(epoch(ts) - epoch(pts)) > 604800 THEN 60 WHEN abs(epoch(ts) - epoch(pts)) > 86400 THEN 40 WHEN abs(epoch(ts) - epoch(pts)) > 21600 THEN 20 ELSE 10 END)
  + (CASE WHEN location <> ploc THEN 30 ELSE 0 END)
  + (CASE WHEN abs(len - plen) * 1.0 / plen > 0.5 THEN 20 WHEN abs(len - plen) * 1.0 / plen > 0.3 THEN 15 ELSE 5 END)
  + (CASE WHEN len / mean > 3.0 OR len / mean < 0.3 THEN 15 ELSE 0 END) >= 50 AS boundary FROM p),
f AS (
  SELECT corpus, i, 0 AS chunk_id, record AS text, i AS first_i, 1 AS record_count, timestamp AS start_time, timestamp AS end_time, n,
    [location] AS locs FROM r WHERE i = 0
  UNION ALL
  SELECT f.corpus, r.i, CASE WHEN c.cut THEN chunk_id + 1 ELSE chunk_id END, CASE WHEN c.cut THEN r.record ELSE f.text || chr(10) || r.record END,
    CASE WHEN c.cut THEN r.i ELSE first_i END, CASE WHEN c.cut THEN 1 ELSE record_count + 1 END,
    CASE WHEN c.cut THEN r.timestamp ELSE f.start_time END, r.timestamp, f.n,
    CASE WHEN c.cut THEN [r.location] WHEN list_contains(f.locs, r.location) THEN f.locs ELSE list_append(f.locs, r.location) END
  FROM f JOIN r ON r.corpus = f.corpus AND r.i = f.i + 1,
  LATERAL (SELECT {_sql_est("f.text || chr(10) || r.record")} AS size) s,
  LATERAL (SELECT s.size > 200 OR (s.size >= 100 AND r.boundary) AS cut) c),
last AS (SELECT *, row_number() OVER (PARTITION BY corpus, chunk_id ORDER BY i DESC) AS k FROM f)
SELECT corpus, chunk_id, text, record_count, start_time, end_time, array_to_string(locs, ',') AS locations, first_i AS start_id, i AS end_id,
  {_sql_est("text")} AS token_count FROM last WHERE k = 1""")
def txt11(spark, d):
    chunks = C.chunk_narrative(narrative(spark, d), "corpus", "ord", NARRATIVE_FIELDS, 100, 200)
    return chunks.withColumn("locations", F.array_join("locations", ","))


@query("txt12_chunk_stats", f"""WITH c AS (
  SELECT source AS corpus, lang, {_sql_tokens_estimate('text')} AS n FROM documents)
SELECT corpus, count(*) AS n_chunks, round(avg(n), 6) AS mean_tokens, min(n) AS min_tokens, max(n) AS max_tokens,
  median(n) AS median_tokens, count(*) FILTER (WHERE n < 3000) AS n_0, count(*) FILTER (WHERE n >= 3000 AND n < 4000) AS n_1,
  count(*) FILTER (WHERE n >= 4000 AND n < 5000) AS n_2, count(*) FILTER (WHERE n >= 5000 AND n < 6000) AS n_3,
  count(*) FILTER (WHERE n >= 6000) AS n_4, count(DISTINCT lang) AS n_places
FROM c GROUP BY corpus""")
def txt12(spark, d):
    chunks = table(spark, d, "documents").select(
        F.col("source").alias("corpus"), F.array("lang").alias("locations"),
        X.estimate_tokens(F.col("text")).alias("token_count"),
    )
    return C.chunk_stats(chunks, "corpus")


@query("txt13_fit_context", """SELECT doc_id,
  CASE WHEN length(text) > 300 THEN '...[Earlier memory truncated]...' || chr(10) || chr(10) || substr(text, length(text) - 299) ELSE text END AS tail,
  CASE WHEN length(text) > 300 THEN left(text, 300) || chr(10) || '...[Later turns truncated]...' ELSE text END AS head
FROM documents""")
def txt13(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.keep_tail(t, 300).alias("tail"), X.keep_head(t, 300).alias("head"))


@query("txt14_concat_context", """
SELECT conv_id AS task_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text
FROM conversations GROUP BY conv_id""")
def txt14(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("position"), "text")
    return J.task_context(c, part_rows=4)


@query("txt15_strip_query_prefix", f"""WITH q AS (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '[2024-01-01] ' || text ELSE text END AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(q, ']') THEN {sql_strip("substr(q, instr(q, ']') + 1)")} ELSE q END AS query FROM q""")
def txt15(spark, d):
    q = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("[2024-01-01] "), "text")).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_query_prefix(q).alias("query"))


_LABELLED = """ch AS (SELECT source AS task_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position,
  CASE WHEN doc_id % 20 IN (3, 4) THEN replace(text, chr(10), chr(10) || 'Label: 7 ') ELSE text END AS text FROM documents)"""


def labelled_chunks(spark, d):
    docs = table(spark, d, "documents")
    text = F.when(
        (F.col("doc_id") % 20).isin(3, 4), F.replace("text", F.lit("\n"), F.lit("\nLabel: 7 "))
    ).otherwise(F.col("text"))
    return docs.select(F.col("source").alias("task_id"), F.col("doc_id").alias("position"), text.alias("text"))


@query("txt16_detect_task_type", f"""WITH {_LABELLED},
s AS (SELECT task_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS n_chars,
  CAST(sum(CASE WHEN position < 10 THEN len(regexp_extract_all(text, '\\nLabel:\\s*\\d+')) ELSE 0 END) AS BIGINT) AS n_labels
  FROM ch GROUP BY task_id)
SELECT *, CASE WHEN n_labels >= 50 THEN 'icl' WHEN n_chunks >= 100 THEN 'long' WHEN n_chars > 50000 THEN 'long' ELSE 'short' END AS task_type FROM s""")
def txt16(spark, d):
    return routing.task_types(labelled_chunks(spark, d), icl_labels=50)


@query("txt17_route_split", f"""WITH {_LABELLED},
src AS (SELECT d.source AS task_id, d.doc_id AS position,
  CASE WHEN doc_id % 20 IN (3, 4) THEN replace(d.text, chr(10), chr(10) || 'Label: 7 ') ELSE d.text END AS text FROM documents d),
s AS (SELECT task_id, count(*) AS n_chunks, sum(length(text)) AS n_chars,
  sum(CASE WHEN position < 10 THEN len(regexp_extract_all(text, '\\nLabel:\\s*\\d+')) ELSE 0 END) AS n_labels FROM ch GROUP BY task_id),
k AS (SELECT task_id, n_labels < 50 AND (n_chunks >= 100 OR n_chars > 50000) AS is_long FROM s),
p AS (SELECT task_id, position, CASE WHEN is_long AND length(text) >= 2000 THEN list_filter(string_split({_FOLD}, chr(1)), lambda x: x <> '')
  ELSE [text] END AS c FROM src JOIN k USING (task_id))
SELECT task_id, position, generate_subscripts(c, 1) - 1 AS piece_no, unnest(c) AS piece FROM p""")
def txt17(spark, d):
    chunks = labelled_chunks(spark, d)
    routed = routing.route_split(chunks, routing.task_types(chunks, icl_labels=50))
    return routed.select("task_id", "position", "piece_no", "piece")


@query("txt18_shorten_prompts", f"""WITH e AS (SELECT doc_id, text, {_sql_tokens_estimate('text')} AS n FROM documents)
SELECT doc_id, CASE WHEN n > 200 THEN right(text, 800) ELSE text END AS from_left,
  CASE WHEN n > 200 THEN left(text, 800) ELSE text END AS from_right,
  CASE WHEN n > 200 THEN left(text, 400) || right(text, 400) ELSE text END AS from_middle FROM e""")
def txt18(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", *[X.shorten_prompt(t, 200, s).alias(f"from_{s}") for s in ("left", "right", "middle")]
    )


@query("txt18_filter_prompts", f"SELECT doc_id FROM documents WHERE {_sql_tokens_estimate('text')} <= 200")
def txt18_filter(spark, d):
    return table(spark, d, "documents").where(X.estimate_tokens(F.col("text")) <= 200).select("doc_id")
