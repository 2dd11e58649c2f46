"""Distributions, coverage, Pareto and ranking over appearances.

Shared shape: a frame with one row per appearance, a carrier (who), a value (what
is counted) and an episode. Missing values are null or blank. All counts are
bigint, all percentages double rounded half away from zero. Denominators of empty
frames count as one, so empty frames give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import blank_to_null

UNKNOWN = "Unknown / no data"


def pct(a: Column, b: Column, scale: int = 2) -> Column:
    return F.round(a * F.lit(100.0) / F.greatest(b, F.lit(1)), scale)


def carrier_stats(df: DataFrame, value: str, carrier: str, appearance: str) -> DataFrame:
    """Per value: distinct carriers and summed appearances with their shares; an unknown row if a carrier has no value at all."""
    d = df.select(blank_to_null(F.col(value)).alias("value"), F.col(carrier).alias("c"), F.col(appearance).alias("n"))
    known = d.where("value IS NOT NULL").groupBy("value").agg(F.count_distinct("c").alias("persons"), F.sum("n").alias("appearances"))
    per = d.groupBy("c").agg(F.count("value").alias("k"), F.sum(F.when(F.col("value").isNull(), F.col("n"))).alias("blank"))
    lost = per.agg(F.sum(F.when(F.col("k") == 0, 1).otherwise(0)).alias("persons"), F.coalesce(F.sum("blank"), F.lit(0)).alias("appearances"))
    lost = lost.where("persons > 0").select(F.lit(UNKNOWN).alias("value"), "persons", "appearances")
    total = d.agg(F.count_distinct("c").alias("tp"), F.sum("n").alias("ta"))
    return known.unionByName(lost).crossJoin(total).select(  # the totals are one row
        "value", "persons", F.col("appearances").cast("long").alias("appearances"), pct(F.col("persons"), F.col("tp")).alias("pct_persons"), pct(F.col("appearances"), F.col("ta")).alias("pct_appearances")
    )


def episode_stats(df: DataFrame, value: str, episode: str, carrier: str) -> DataFrame:
    """Per value: rows per episode among the episodes that have it, and the share of episodes without it."""
    d = df.select(blank_to_null(F.col(value)).alias("value"), F.col(episode).alias("e"), F.col(carrier).alias("c"))
    total = d.agg(F.count_distinct("e").alias("te"))
    d = d.where("value IS NOT NULL")
    per = d.groupBy("value", "e").agg(F.count("*").alias("n"))
    s = per.groupBy("value").agg(
        F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.round(F.avg("n"), 4).alias("mean_rows"),
        F.round(F.stddev_pop("n"), 4).alias("std_rows"), F.median("n").alias("median_rows"), F.count("*").alias("k"), F.sum("n").alias("total_rows"),
    )
    who = d.groupBy("value").agg(F.count_distinct("c").alias("persons"))
    return s.join(who, "value").crossJoin(total).select(
        "value", "min_rows", "max_rows", "mean_rows", "std_rows", "median_rows", pct(F.col("te") - F.col("k"), F.col("te")).alias("pct_without"), "total_rows", "persons"
    )


def frequency_distribution(df: DataFrame, carrier: str) -> DataFrame:
    """How many carriers have how many rows."""
    return df.groupBy(carrier).agg(F.count("*").alias("frequency")).groupBy("frequency").agg(F.count("*").alias("carriers"))


def running(df: DataFrame, order: list, value: str) -> DataFrame:
    """``running`` sum of ``value`` in the given order, its share of the total, and the rank.

    The order is total over the whole frame. Rows are sorted by range partitions
    and written once; sums of the partitions are then added to the sums inside
    them, so no task holds all rows.
    """
    from ..session import materialize

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = materialize(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = part.groupBy("_p").agg(F.sum(value).alias("_s"), F.count("*").alias("_n"))
    w, every = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # as many rows as partitions
    base = sums.select("_p", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_b"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_r"), F.sum("_s").over(every).alias("_t"))
    inner = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = part.withColumn("running", F.sum(value).over(inner)).withColumn("rank", F.count("*").over(inner)).join(F.broadcast(base), "_p")
    out = out.withColumn("running", F.col("running") + F.col("_b")).withColumn("rank", F.col("rank") + F.col("_r"))
    return out.withColumn("cumulative_pct", pct(F.col("running"), F.col("_t"))).drop("_p", "_b", "_r", "_t")


def pareto(df: DataFrame, carrier: str) -> DataFrame:
    """Carriers by rows, most first, with the running share."""
    c = df.groupBy(F.col(carrier).alias("carrier")).agg(F.count("*").alias("n"))
    return running(c, [F.desc("n"), F.asc("carrier")], "n").select("carrier", "n", "rank", "running", "cumulative_pct")


def pareto_buckets(df: DataFrame, carrier: str) -> DataFrame:
    """Frequencies, highest first, with the running share of rows."""
    b = frequency_distribution(df, carrier).withColumn("bucket_rows", F.col("frequency") * F.col("carriers"))
    return running(b, [F.desc("frequency")], "bucket_rows").select("frequency", "carriers", "bucket_rows", "running", "cumulative_pct")


def best_by(df: DataFrame, key: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """Of each key the row that comes first in the order, by a partial minimum: no group is collected."""
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[F.col(c) for c in keep])
    return df.groupBy(*key).agg(F.min(rank).alias("_s")).select(*key, *[F.col(f"_s.{c}") for c in keep])


def coverage(df: DataFrame, by: list[str], matched: Column, scale: int = 1) -> DataFrame:
    """Rows, matched rows and their share per group; no group columns give one row."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.sum(F.coalesce(matched, F.lit(False)).cast("long")).alias("matched")).withColumn(
        "pct_matched", pct(F.col("matched"), F.col("rows"), scale)
    )


def top_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group with their rank; Catalyst keeps n rows per task before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).where(F.col("rank") <= n)


def specialization(df: DataFrame, carrier: str, group: str, least: int) -> DataFrame:
    """Per carrier with enough rows: the group with most of them and its share."""
    g = df.groupBy(F.col(carrier).alias("carrier"), F.col(group).alias("grp")).agg(F.count("*").alias("n"))
    t = g.groupBy("carrier").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("o"), "grp")).alias("s"))
    return t.where(F.col("total") >= least).select("carrier", F.col("s.grp").alias("dominant"), "total", pct(-F.col("s.o"), F.col("total")).alias("share_pct"))


def top_n_other(df: DataFrame, value: str, count: str, n: int, other: str = "Other", unknown: str = UNKNOWN) -> DataFrame:
    """The n largest values, the rest as one row, the unknown row always last.

    The largest n come from a top-k, which every task prepares; no window runs over
    all values.
    """
    known = F.coalesce(F.col(value) != unknown, F.lit(True))
    top = df.where(known).orderBy(F.desc(count), F.asc(value)).limit(n)
    top = top.select(F.col(value).alias("_v"), F.row_number().over(Window.orderBy(F.desc(count), F.asc(value))).alias("_r"))  # n rows
    r = df.join(F.broadcast(top), F.col(value).eqNullSafe(F.col("_v")), "left")
    label = F.when(~known, F.lit(unknown)).when(F.col("_r").isNotNull(), F.col(value)).otherwise(F.lit(other))
    place = F.when(~known, F.lit(n + 2)).otherwise(F.coalesce("_r", F.lit(n + 1)))
    return r.groupBy(label.alias(value)).agg(F.sum(count).alias(count), F.min(place).cast("long").alias("place"))


def combinations(df: DataFrame, carrier: str, value: str) -> DataFrame:
    """How many carriers have exactly which set of values; ``value`` is bounded by what one carrier can have."""
    s = df.groupBy(carrier).agg(F.array_join(F.array_sort(F.collect_set(value)), "|").alias("combination"))
    return s.groupBy("combination").agg(F.count("*").alias("carriers"))
