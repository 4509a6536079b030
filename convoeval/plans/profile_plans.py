"""Profiles of narratives."""

from pyspark.sql import functions as F

from convoeval.operators import profiling as P
from convoeval.plans.registry import ORACLES, query, table
from convoeval.plans.views import NARRATIVE_FIELDS, SQL_NARRATIVE, narrative

_N = f"WITH {SQL_NARRATIVE}"
_FIELD = "SELECT corpus, '{0}' AS field, {0} AS v FROM narrative"
_LONG = " UNION ALL ".join(_FIELD.format(f) for f in NARRATIVE_FIELDS)


@query("pro1_completeness", f"""{_N} SELECT corpus, field, count(v) AS n, round(count(v) * 100.0 / count(*), 1) AS percent
FROM ({_LONG}) GROUP BY corpus, field""")
def pro1(spark, d):
    return P.completeness(narrative(spark, d), "corpus", NARRATIVE_FIELDS)


_SPAN = """SELECT corpus, count(*) AS n_records, min(CAST(timestamp AS TIMESTAMP)) AS first, max(CAST(timestamp AS TIMESTAMP)) AS last,
  round(floor((epoch(max(CAST(timestamp AS TIMESTAMP))) - epoch(min(CAST(timestamp AS TIMESTAMP)))) / 86400) / 365.25, 1) AS years,
  count(DISTINCT location) AS n_places"""


@query("pro2_time_span", f"{_N} {_SPAN} FROM narrative GROUP BY corpus")
def pro2(spark, d):
    return P.time_span(narrative(spark, d), "corpus")


_GAPS = f"""{_N}, g AS (SELECT corpus, (epoch(CAST(timestamp AS TIMESTAMP)) - epoch(lag(CAST(timestamp AS TIMESTAMP)) OVER (PARTITION BY corpus ORDER BY ord))) / 60 AS m FROM narrative)"""


@query("pro3_gap_stats", f"""{_GAPS} SELECT corpus, count(m) AS n_gaps, round(avg(m), 4) AS mean, round(min(m), 4) AS min,
  round(max(m), 4) AS max, round(median(m), 4) AS median FROM g WHERE m IS NOT NULL GROUP BY corpus""")
def pro3(spark, d):
    return P.gap_stats(P.gaps(narrative(spark, d), "corpus", "ord"), "corpus", "ord")


@query("pro4_gap_buckets", f"""{_GAPS} SELECT corpus, CASE WHEN m <= 1 THEN '<=1m' WHEN m <= 5 THEN '1-5m' WHEN m <= 30 THEN '5-30m'
  WHEN m <= 60 THEN '30-60m' WHEN m <= 1440 THEN '1-24h' WHEN m <= 10080 THEN '1-7d' ELSE '>7d' END AS bucket, count(*) AS n
FROM g WHERE m IS NOT NULL GROUP BY ALL""")
def pro4(spark, d):
    return P.gap_buckets(P.gaps(narrative(spark, d), "corpus", "ord"), "corpus")


@query("pro5_length_stats", f"""{_N} SELECT corpus, field, round(avg(length(v)), 4) AS mean, min(length(v)) AS min, max(length(v)) AS max,
  count(*) AS n_filled, median(length(v)) AS median FROM ({_LONG}) WHERE v <> '' GROUP BY ALL""")
def pro5(spark, d):
    return P.length_stats(narrative(spark, d), "corpus", NARRATIVE_FIELDS)


@query("pro6_place_stats", """WITH c AS (SELECT c_mktsegment AS corpus, 'n' || c_nationkey AS location, count(*) AS n,
  CAST(min(c_custkey) AS VARCHAR) AS first_seen FROM customer GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, location) AS rank FROM c) WHERE rank <= 20""")
def pro6(spark, d):
    rows = table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("corpus"), F.concat(F.lit("n"), "c_nationkey").alias("location"),
        F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("timestamp"),
    )
    return P.place_stats(rows, "corpus", "ord")


@query("pro7_category_combos", """WITH c AS (SELECT source AS corpus, lang || ' , ' || CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'mind' END AS category FROM documents),
s AS (SELECT corpus, category, array_to_string(list_sort(list_distinct(list_transform(string_split(category, ','), lambda x: trim(x)))), ', ') AS combination FROM c)
SELECT corpus, combination, count(*) AS n, count(DISTINCT category) AS n_spellings FROM s GROUP BY ALL""")
def pro7(spark, d):
    second = F.when(F.col("doc_id") % 2 == 0, "en").otherwise("mind")
    rows = table(spark, d, "documents").select(
        F.col("source").alias("corpus"), F.concat("lang", F.lit(" , "), second).alias("category")
    )
    return P.category_combos(rows, "corpus")


@query("pro8_temporal_patterns", f"""{_N}, t AS (SELECT corpus, CAST(timestamp AS TIMESTAMP) AS ts FROM narrative)
SELECT corpus, 'hour' AS unit, hour(ts) AS value, count(*) AS n FROM t GROUP BY ALL
UNION ALL SELECT corpus, 'weekday', isodow(ts) - 1, count(*) FROM t GROUP BY ALL
UNION ALL SELECT corpus, 'month', month(ts), count(*) FROM t GROUP BY ALL
UNION ALL SELECT corpus, 'year', year(ts), count(*) FROM t GROUP BY ALL""")
def pro8(spark, d):
    return P.temporal_patterns(narrative(spark, d), "corpus")


@query("pro9_cooccurrence", f"""{_N}, f AS (SELECT corpus, list_filter(['action', CASE WHEN dialogue IS NOT NULL THEN 'dialogue' END,
  CASE WHEN environment IS NOT NULL THEN 'environment' END], lambda x: x IS NOT NULL) AS c FROM narrative)
SELECT corpus, array_to_string(c, ' + ') AS combination, count(*) AS n FROM f WHERE len(c) > 1 GROUP BY ALL""")
def pro9(spark, d):
    return P.cooccurrence(narrative(spark, d), "corpus", NARRATIVE_FIELDS)


@query("pro10_compare_corpora", f"""{_N} {_SPAN},
  round(avg(length(action) + coalesce(length(dialogue), 0) + coalesce(length(environment), 0)), 4) AS mean_length
FROM narrative GROUP BY corpus""")
def pro10(spark, d):
    return P.compare_corpora(narrative(spark, d), "corpus", NARRATIVE_FIELDS)


def _section(name: str, of: str, item: str, value: str) -> str:
    return f"SELECT corpus, '{name}' AS section, {item} AS item, CAST({value} AS VARCHAR) AS value FROM ({of})"


_PLACES = f"""{_N}, c AS (SELECT corpus, location, count(*) AS n FROM narrative WHERE location IS NOT NULL GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, location) AS rank FROM c) WHERE rank <= 20"""


@query("pro11_profile_report", " UNION ALL ".join([
    _section("completeness", ORACLES["pro1_completeness"], "field", "percent"),
    *[_section("span", ORACLES["pro2_time_span"], f"'{c}'", f'"{c}"') for c in ("n_records", "first", "last", "years", "n_places")],
    *[_section("gaps", ORACLES["pro3_gap_stats"], f"'{c}'", f'"{c}"') for c in ("n_gaps", "mean", "median", "min", "max")],
    _section("gap_buckets", ORACLES["pro4_gap_buckets"], "bucket", "n"), _section("lengths", ORACLES["pro5_length_stats"], "field", "mean"),
    _section("places", _PLACES, "location", "n"), _section("times", ORACLES["pro8_temporal_patterns"], "unit || '_' || value", "n"),
    _section("cooccurrence", ORACLES["pro9_cooccurrence"], "combination", "n"),
]))
def pro11(spark, d):
    return P.profile_report(narrative(spark, d), "corpus", "ord", NARRATIVE_FIELDS)
