"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoeval.llm import (
    decontaminate, filter_audit, html_text, licenses, line_dedup, near_dup, pieces, secrets, source_audit, token_counts, toxicity, vector_dup, warc,
)

#: A public SentencePiece model; only its path is known here.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def bpe_path() -> str:
    """The public byte-level BPE of the token counts."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, line, i, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
common AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.keeper AS gone FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


@query("op3_warc", """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d""")
def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    whole = warc.round_trip(table(spark, folder, "pages"), payloads=False, segment_bytes=1 << 15, chunk_bytes=1 << 13)
    return whole.select("page_id", F.col("payload_length").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
                        "record_type", F.col("refers_to").cast("long").alias("refers_to"))


@query("op5_decontamination", r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_LICENSE_VALUES = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(licenses.NOTICES))
_PHRASE_VALUES = ", ".join(f"('{label}', '{text}')" for text, label in licenses.PHRASES)


@query("op4_license_scan", rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM d),
phrase(label, words) AS (SELECT label, string_split(p, ' ') FROM (VALUES {_PHRASE_VALUES}) v(label, p)),
place AS (SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM w WHERE list_contains(w, 'license') OR list_contains(w, 'cc')), phrase
  WHERE list_slice(w, i, i + len(words) - 1) = words),
base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM place GROUP BY doc_id),
notice(id, label, words, size) AS (SELECT id, label, list_distinct(string_split(p, ' ')), len(string_split(p, ' ')) FROM (VALUES {_LICENSE_VALUES}) v(id, label, p)),
block AS (SELECT doc_id, label, words, list_slice(w, i * size + 1, (i + 2) * size) AS tokens FROM (
  SELECT doc_id, label, words, size, w, unnest(generate_series(0, (len(w) - 1) // size)) AS i FROM w, notice WHERE len(list_intersect(w, words)) >= ceil(0.9 * len(words) - 1e-9))),
near AS (SELECT doc_id, label, len(list_intersect(tokens, words)) / len(words) AS share FROM block WHERE len(list_intersect(tokens, words)) >= ceil(0.9 * len(words) - 1e-9)),
lab AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM place UNION SELECT doc_id, label FROM near) GROUP BY doc_id),
blab AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM place) GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(blab.labels, '') AS base_labels,
  coalesce(lab.labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce((SELECT max(share) FROM near n WHERE n.doc_id = w.doc_id), 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN lab USING (doc_id) LEFT JOIN blab USING (doc_id)""")
def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def _secret_sql() -> str:
    parts = []
    for i, r in enumerate(secrets.RULES):
        rx = r.pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {i} AS place, '{r.kind}' AS kind, {r.least} AS least, coalesce(text, '') AS text,
          regexp_extract_all(coalesce(text, ''), '{rx}', 0) AS m, regexp_extract_all(coalesce(text, ''), '{rx}', {r.group}) AS g FROM documents""")
    # RE2 finds no places; each match is looked for behind the end of the match before it
    return f"""
WITH RECURSIVE hits AS (SELECT row_number() OVER () AS h, * FROM ({' UNION ALL '.join(parts)}) WHERE len(m) > 0),
step AS (
  SELECT h, 1 AS i, strpos(text, m[1]) - 1 AS s, strpos(text, m[1]) - 1 + length(m[1]) AS e FROM hits
  UNION ALL
  SELECT h, i + 1, step.e + strpos(substr(text, step.e + 1), m[i + 1]) - 1, step.e + strpos(substr(text, step.e + 1), m[i + 1]) - 1 + length(m[i + 1])
  FROM step JOIN hits USING (h) WHERE i < len(m)),
spans AS (SELECT doc_id, kind, place, s, kind || ':' || s || ':' || e AS span FROM step JOIN hits USING (h) WHERE length(g[i]) >= least)
SELECT d.doc_id, count(s) FILTER (WHERE kind = 'assign') AS n_assign, count(s) FILTER (WHERE kind = 'access') AS n_access, count(s) FILTER (WHERE kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, place) FILTER (WHERE place < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, place), '') AS spans
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


@query("op8_secret_scan", None)
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, folder, "documents"))
    base = [r.kind for r in secrets.BASE]

    def joined(array):
        return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in base],
        F.sha2(joined(F.filter("findings", lambda x: x["place"] < len(base))), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


ORACLES["op8_secret_scan"] = _secret_sql()


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    scored = toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op2_minhash_near_dedup", r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = w.doc_id) AS component_id,
  w.doc_id = (SELECT min(b) FROM reach WHERE reach.a = w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id""")
def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), percent=85)


@query("op10_embedding_near_dedup", """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, (SELECT min(b) FROM reach WHERE a = vec_id) AS component_id,
  vec_id = (SELECT min(b) FROM reach WHERE a = vec_id) AS kept FROM embeddings""")
def op10_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dup.vector_duplicates(table(spark, folder, "embeddings"))


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, folder, "documents").select("doc_id", "text"), PIECES).drop("text")


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages"))


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, folder, "documents").select("doc_id", "text"), bpe_path())
    return counted.drop("text")


_ORDERS = ", ".join(f"('{''.join(o)}')" for o in permutations("ABCDE"))


@query("op12_filter_audit", rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
m AS (SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > first] AS f
  FROM w LEFT JOIN labels USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m GROUP BY part, f),
s AS (SELECT o AS filter_order, i AS step, ascii(substr(o, i, 1)) - 64 AS own, list_transform(string_split(substr(o, 1, i - 1), ''), lambda x: ascii(x) - 64) AS before
  FROM (SELECT o, unnest(generate_series(1, 5)) AS i FROM (VALUES {_ORDERS}) v(o))),
g AS (SELECT part, filter_order, step, own, n, good, toxic, f[own] AS fails, len(list_filter(before, lambda x: x > 0 AND f[x])) > 0 AS gone,
    len(list_filter(f, lambda x: x)) = 1 AS single FROM c, s),
r AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND fails), 0) AS redundant, coalesce(sum(n) FILTER (WHERE fails AND single), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0) AS toxic_lost
  FROM g GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r""")
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(table(spark, folder, "documents")), table(spark, folder, "labels"), list("ABCDE"))


@query("op13_source_audit", r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS c FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, c, 1 + (1000000000::HUGEINT * (c + 1)) // (sum(c) OVER (PARTITION BY lang, source) + v) AS p,
    1 + (1000000000::HUGEINT * (sum(c) OVER (PARTITION BY lang, term) + 1)) // (sum(c) OVER (PARTITION BY lang) + v) AS q FROM t JOIN v USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""")
def op13_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.divergence(table(spark, folder, "documents"))
