"""Running sums, previous-row values, ranks and medians for keys of any size.

A window over a hot key, or over no key at all, runs in one task. The helpers
here cut the order into buckets first: each bucket is worked on alone, one small
row per bucket carries the state over to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoeval.functions.draws import DRAW_BITS
from convoeval.session import cut_lineage

BUCKET_ROWS = 1 << 20


def id_bucket(order: str | Column, width: int = BUCKET_ROWS) -> Column:
    """Bucket of a dense integer order column."""
    order = F.col(order) if isinstance(order, str) else order
    return F.floor(order / F.lit(width)).cast("long")


def draw_bucket(order: Column, bits: int = 12) -> Column:
    """Bucket of a uniform draw used as order: its leading bits."""
    return F.shiftright(order, DRAW_BITS - bits).cast("long")


def _known(bucket: Column) -> Column:
    """The bucket as a column that cannot be NULL, so that joining on it adds no
    filter that works the bucket out again below."""
    return F.coalesce(bucket, F.lit(0).cast("long"))


def prefix_sums(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, **sums: Column
) -> DataFrame:
    """Adds inclusive running sums named by ``sums`` over ``order`` within ``keys``."""
    df = df.withColumn("_bucket", _known(bucket))
    group = [*keys, "_bucket"]
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group).agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    offsets = totals.select(
        *group, *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums]
    )
    part = df.withColumns({f"_s_{k}": F.sum(v).over(inside) for k, v in sums.items()})
    out = part.join(offsets, group)
    out = out.withColumns({k: F.col(f"_s_{k}") + F.col(f"_o_{k}") for k in sums})
    return out.drop("_bucket", *[f"_s_{k}" for k in sums], *[f"_o_{k}" for k in sums])


def numbered(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "row"
) -> DataFrame:
    """Adds a 1-based row number over ``order`` within ``keys``."""
    return prefix_sums(df, keys, order, bucket, **{name: F.lit(1).cast("long")})


def range_buckets(df: DataFrame, order: str, name: str = "_bucket") -> DataFrame:
    """``df`` cut along ``order`` at sampled splitters, with the number of the stretch, and written.

    For an order column of any type and distribution; equal values stay together. It is written
    because the stretches are read several times and must not be drawn anew.
    """
    return cut_lineage(df.repartitionByRange(F.col(order)).withColumn(name, F.spark_partition_id().cast("long")))


def numbered_by_range(df: DataFrame, order: str, name: str = "row") -> DataFrame:
    """Adds a 1-based row number over ``order``, a column of any type with unique values."""
    return numbered(range_buckets(df, order, "_stretch"), [], [order], F.col("_stretch"), name).drop("_stretch")


def with_previous(
    df: DataFrame, keys: list[str], order: str, columns: list[str], bucket: Column
) -> DataFrame:
    """Adds ``prev_<c>`` from the row before within ``keys``."""
    df = df.withColumn("_bucket", _known(bucket))
    group = [*keys, "_bucket"]
    inside = Window.partitionBy(*group).orderBy(order)
    over = Window.partitionBy(*keys).orderBy("_bucket")
    packed = F.struct(*columns)
    last = df.groupBy(*group).agg(F.max_by(packed, F.col(order)).alias("_last"))
    carried = last.select(*group, F.lag("_last").over(over).alias("_carry"))
    out = df.withColumns(
        {"_in": F.lag(packed).over(inside), "_first": F.row_number().over(inside) == 1}
    ).join(carried, group)
    prev = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_in"))
    out = out.withColumn("_prev", prev)
    out = out.withColumns({f"prev_{c}": F.col(f"_prev.{c}") for c in columns})
    return out.drop("_bucket", "_in", "_first", "_carry", "_prev")


def value_bucket(value: Column) -> Column:
    """Order-preserving bucket of a number: sixteen per power of two."""
    return F.floor(F.signum(value) * F.log2(F.abs(value) + 1) * 16).cast("long")


def exact_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact median of ``value`` per key, without one task holding a key.

    Equal values are counted first, combined on the map side, and the counts are
    written once because the steps below read them three times.
    """
    v = F.col(value).cast("double")
    return counted_medians(cut_lineage(df.where(v.isNotNull()).groupBy(*keys, v.alias("_v")).agg(F.count("*").alias("_n"))), keys)


def counted_medians(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Exact median per key of ``hist(keys, _v, _n)``: values with their counts, read several times.

    The counts are summed up along the values, bucket by bucket, and the middle ones are read off.
    """
    ranked = prefix_sums(hist, keys, ["_v"], value_bucket(F.col("_v")), _last=F.col("_n"))
    totals = hist.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    lo, hi = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    middle = ranked.join(totals, keys).where((F.col("_last") >= lo) & (F.col("_last") - F.col("_n") < hi))
    return middle.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best ``k`` rows per key; Spark cuts each map side to ``k`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def joined_text(
    df: DataFrame,
    keys: list[str],
    order: str,
    text: Column,
    separator: str = "",
    part_rows: int = 10_000,
    position: Column | None = None,
) -> DataFrame:
    """Texts of a key in order, as one row ``(keys, text)``.

    Stretches of ``part_rows`` positions are joined first, each on its own, so a
    long key is put together from few pieces. The text does not depend on them.
    """
    part = id_bucket(position if position is not None else F.col(order), part_rows)
    lines = df.select(*keys, part.alias("part"), F.col(order).alias("_o"), text.alias("_t"))
    grouped = lines.groupBy(*keys, "part").agg(
        F.array_sort(F.collect_list(F.struct("_o", "_t"))).alias("_l")
    )
    pieces = grouped.select(*keys, "part", F.array_join(F.col("_l._t"), separator).alias("text"))
    whole = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("_l"))
    return whole.select(*keys, F.array_join(F.col("_l.text"), separator).alias("text"))
