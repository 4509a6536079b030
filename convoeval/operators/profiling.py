"""Profiles of event narratives, per corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoeval.functions.text import strip
from convoeval.operators.chunking import TIME_FORMAT
from convoeval.operators.ordered import exact_medians, id_bucket, top_per_key, with_previous


def rounded(value: Column, digits: int) -> Column:
    """``value`` times a power of ten, rounded half away from zero and divided again, as SQL rounds a double.

    ``F.round`` rounds the shortest decimal text of a double, which may be half way where its multiple lies below.
    """
    scaled = value * F.lit(10.0**digits)
    return F.signum(scaled) * F.round(F.abs(scaled)) / F.lit(10.0**digits)


def plain_text(value: Column) -> Column:
    """A double of at most four decimals as text without an exponent."""
    return F.when(value.isNotNull(), F.regexp_replace(F.format_string("%.4f", value), r"(\.\d+?)0+$", "$1"))


def parsed_time(column: str = "timestamp") -> Column:
    return F.try_to_timestamp(F.col(column), F.lit(TIME_FORMAT))


def completeness(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Non-null count and percent per field, all fields in one pass."""
    wide = df.groupBy(key).agg(F.count("*").alias("_n"), *[F.count(f).alias(f) for f in fields])
    long = wide.unpivot([key, "_n"], fields, "field", "n")
    return long.select(key, "field", "n", rounded(F.col("n") * 100.0 / F.col("_n"), 1).alias("percent"))


def time_span(df: DataFrame, key: str) -> DataFrame:
    """First and last time, years between (whole days over 365.25), distinct places."""
    ts = parsed_time()
    place = F.nullif(F.col("location"), F.lit(""))
    out = df.groupBy(key).agg(
        F.count("*").alias("n_records"), F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.countDistinct(place).alias("n_places"),
    )
    days = F.floor((F.unix_timestamp("last") - F.unix_timestamp("first")) / 86400)
    return out.select(
        key, "n_records", "first", "last", F.coalesce(rounded(days / 365.25, 1), F.lit(0.0)).alias("years"), "n_places"
    )


def gaps(df: DataFrame, key: str, order: str, bucket_rows: int = 1 << 20) -> DataFrame:
    """Minutes between consecutive records with a time, in file order; may be negative.

    ``stretch`` is 0 in a corpus of up to ``bucket_rows`` records; only larger ones are cut.
    """
    timed = df.select(key, order, F.unix_timestamp(parsed_time()).alias("sec")).where("sec IS NOT NULL")
    large = timed.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > bucket_rows)  # few
    timed = timed.join(large, key, "left").withColumn("stretch", F.when(F.col("_n").isNotNull(), id_bucket(order, bucket_rows)).otherwise(0)).drop("_n")
    rows = with_previous(timed, [key], order, ["sec"], F.col("stretch"))
    return rows.where("prev_sec IS NOT NULL").select(key, order, "stretch", ((F.col("sec") - F.col("prev_sec")) / 60).alias("minutes"))


def gap_stats(gap_rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Count, mean, extremes and median. Gaps are added up one after the other in file order, stretch by stretch:
    a mean that lies half way between two rounded values does not depend on the partitions."""
    run = Window.partitionBy(key, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = gap_rows.withColumn("_run", F.sum("minutes").over(run)).groupBy(key, "stretch").agg(
        F.count("*").alias("n"), F.max_by("_run", order).alias("s"), F.min("minutes").alias("low"), F.max("minutes").alias("high"))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("stretch", "s"))), F.lit(0.0), lambda a, x: a + x["s"])
    stats = parts.groupBy(key).agg(
        F.sum("n").alias("n_gaps"), rounded(total / F.sum("n"), 4).alias("mean"),
        rounded(F.min("low"), 4).alias("min"), rounded(F.max("high"), 4).alias("max"),
    )
    medians = exact_medians(gap_rows, [key], "minutes").withColumn("median", rounded(F.col("median"), 4))
    return stats.join(medians, key)


# Upper edges of the gap histogram, in minutes.
GAP_EDGES = [(1, "<=1m"), (5, "1-5m"), (30, "5-30m"), (60, "30-60m"), (1440, "1-24h"), (10080, "1-7d")]


def gap_buckets(gap_rows: DataFrame, key: str) -> DataFrame:
    bucket = F.lit(">7d")
    for edge, name in reversed(GAP_EDGES):
        bucket = F.when(F.col("minutes") <= edge, name).otherwise(bucket)
    return gap_rows.groupBy(key, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def length_stats(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Length of non-empty texts per field."""
    filled = [F.when(F.col(f) != "", F.length(f)).alias(f) for f in fields]
    long = df.select(key, *filled).unpivot([key], fields, "field", "len").where("len IS NOT NULL")
    stats = long.groupBy(key, "field").agg(
        rounded(F.avg("len"), 4).alias("mean"), F.min("len").alias("min"), F.max("len").alias("max"),
        F.count("*").alias("n_filled"),
    )
    return stats.join(exact_medians(long, [key, "field"], "len"), [key, "field"])


def place_stats(df: DataFrame, key: str, order: str, top: int = 20) -> DataFrame:
    """Most frequent places with their first time in file order."""
    placed = df.where(F.coalesce("location", F.lit("")) != "")
    has_time = F.when(F.coalesce("timestamp", F.lit("")) != "", F.col(order))
    counts = placed.groupBy(key, "location").agg(
        F.count("*").alias("n"), F.min_by("timestamp", has_time).alias("first_seen")
    )
    return top_per_key(counts, [key], [F.desc("n"), F.asc("location")], top)


def category_combos(df: DataFrame, key: str, column: str = "category") -> DataFrame:
    """Frequency of comma lists as sorted distinct combinations."""
    parts = F.array_sort(F.array_distinct(F.transform(F.split(column, ","), strip)))
    named = df.where(F.coalesce(column, F.lit("")) != "")
    return named.groupBy(key, F.array_join(parts, ", ").alias("combination")).agg(
        F.count("*").alias("n"), F.countDistinct(column).alias("n_spellings")
    )


def temporal_patterns(df: DataFrame, key: str) -> DataFrame:
    """Hour, weekday (0 is Monday), month and year histograms in one pass.

    Records are first combined to (day, hour), then expanded to the four histograms.
    """
    ts = parsed_time()
    fine = (
        df.select(key, F.to_date(ts).alias("day"), F.hour(ts).alias("hour")).where("day IS NOT NULL")
        .groupBy(key, "day", "hour").agg(F.count("*").alias("n"))
    )
    units = F.array(
        F.struct(F.lit("hour").alias("unit"), F.col("hour").alias("value")),
        F.struct(F.lit("weekday").alias("unit"), F.weekday("day").alias("value")),
        F.struct(F.lit("month").alias("unit"), F.month("day").alias("value")),
        F.struct(F.lit("year").alias("unit"), F.year("day").alias("value")),
    )
    long = fine.select(key, "n", F.explode(units).alias("u"))
    return long.groupBy(key, "u.unit", "u.value").agg(F.sum("n").alias("n"))


def cooccurrence(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Combinations of more than one filled field."""
    filled = F.array_compact(F.array(*[F.when(strip(F.col(f)) != "", F.lit(f)) for f in sorted(fields)]))
    rows = df.select(key, filled.alias("f")).where(F.size("f") > 1)
    return rows.groupBy(key, F.array_join("f", " + ").alias("combination")).agg(F.count("*").alias("n"))


def compare_corpora(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row per corpus: records, span, places, mean content length."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.length(f), F.lit(0)) for f in fields])
    means = df.groupBy(key).agg(rounded(F.avg(total), 4).alias("mean_length"))
    return time_span(df, key).join(means, key)


def profile_report(df: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """All profiles of a corpus in long form: section, item, value."""
    g = gaps(df, key, order)

    def long(section: str, rows: DataFrame, item: Column, value: Column) -> DataFrame:
        if rows.select(value).dtypes[0][1] == "double":
            value = plain_text(value)
        return rows.select(key, F.lit(section).alias("section"), item.alias("item"), value.cast("string").alias("value"))

    span = time_span(df, key)
    stats = gap_stats(g, key, order)
    parts = [
        long("completeness", completeness(df, key, fields), F.col("field"), F.col("percent")),
        *[long("span", span, F.lit(c), F.col(c)) for c in ("n_records", "first", "last", "years", "n_places")],
        *[long("gaps", stats, F.lit(c), F.col(c)) for c in ("n_gaps", "mean", "median", "min", "max")],
        long("gap_buckets", gap_buckets(g, key), F.col("bucket"), F.col("n")),
        long("lengths", length_stats(df, key, fields), F.col("field"), F.col("mean")),
        long("places", place_stats(df, key, order), F.col("location"), F.col("n")),
        long("times", temporal_patterns(df, key), F.concat_ws("_", "unit", "value"), F.col("n")),
        long("cooccurrence", cooccurrence(df, key, fields), F.col("combination"), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, parts)
