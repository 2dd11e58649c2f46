"""Event logs: folds, windows by count, catalogues, histories. The same plans serve batch and micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .reshape import ordinal


def latest_per_key(df: DataFrame, key: list[str], seq: str, keep: list[str]) -> DataFrame:
    """Last writer wins: of each key the row with the greatest sequence; one row per key and task is shuffled."""
    return df.groupBy(*key).agg(F.max(F.struct(F.col(seq), *[c for c in keep if c != seq])).alias("_s")).select(*key, *[F.col(f"_s.{c}") for c in keep])


def since(df: DataFrame, seq: str, after: int) -> DataFrame:
    """Events after a sequence number; the predicate reaches the scan and prunes row groups by their statistics."""
    return df.where(F.col(seq) > after)


def chunk_catalog(df: DataFrame, seq: str, chunk: Column, time: str) -> DataFrame:
    """(chunk, first_seq, last_seq, events, opened, closed) of each chunk."""
    return df.groupBy(chunk.alias("chunk")).agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count("*").alias("events"), F.min(time).alias("opened"), F.max(time).alias("closed"))


def ordinal_windows(df: DataFrame, key: list[str], seq: str, size: int, flags: dict[str, Column]) -> DataFrame:
    """Tumbling windows of ``size`` events per key: events, the sum of each flag, first and last sequence."""
    d = ordinal(df, key, [seq], "window_no").withColumn("window_no", F.floor(F.col("window_no") / size).cast("long"))
    return d.groupBy(*key, "window_no").agg(F.count("*").alias("calls"), *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(k) for k, c in flags.items()], F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"))


def upsert_history(df: DataFrame, key: list[str], seq: str, time: str, doc: str) -> DataFrame:
    """Per key: first time, distinct times in order, number of versions, latest document."""
    return df.groupBy(*key).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count_distinct(time).alias("versions"), F.max(F.struct(seq, doc)).alias("_s")).select(
        *key, "first_seen", "last_seen", "versions", F.col(f"_s.{doc}").alias(doc)
    )


def pending_until_ready(waiting: DataFrame, ready: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """Events released when their key is ready: (…, released_at) is the later of both sequences; others wait (null)."""
    r = ready.groupBy(key).agg(F.min(seq).alias("_ready"))
    return waiting.join(r, key, "left").withColumn("released_at", F.when(F.col("_ready").isNotNull(), F.greatest(seq, "_ready"))).drop("_ready")


def monotone_flag(df: DataFrame, key: str, seq: str, flag: Column) -> DataFrame:
    """(key, since): the first sequence at which the flag was set; it stays set."""
    return df.where(flag).groupBy(key).agg(F.min(seq).alias("since"))


def emit_once(discovered: DataFrame, normalized: DataFrame, seq: str) -> DataFrame:
    """Discovered events that have not been normalized."""
    return discovered.join(normalized.select(seq).distinct(), seq, "left_anti")


def adaptive_delay(windows: DataFrame, key: list[str], bad: Column, k: int = 1, start: float = 1.0, up: float = 1.05, down: float = 0.99) -> DataFrame:
    """The delay after each window: times ``up`` after each run of ``k`` windows with backoff, times ``down`` after each run of ``k`` quiet ones.

    A run begins anew when it has had its effect or the kind of window changes.
    The product over a key's windows is a running sum of logarithms, so the fold
    is a window function and no row-by-row state.
    """
    by = Window.partitionBy(*key).orderBy("window_no")
    d = windows.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    d = d.withColumn("_island", F.row_number().over(by) - F.row_number().over(Window.partitionBy(*key, "_bad").orderBy("window_no")))
    d = d.withColumn("_run", F.row_number().over(Window.partitionBy(*key, "_bad", "_island").orderBy("window_no")))
    step = F.when(F.col("_run") % k != 0, F.lit(1.0)).when(F.col("_bad"), F.lit(up)).otherwise(F.lit(down))
    total = F.sum(F.log(step)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("delay", F.round(F.lit(start) * F.exp(total), 6)).drop("_bad", "_island", "_run")
