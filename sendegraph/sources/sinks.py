"""Writers: atomic replacement, event logs in chunks, quarantine, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), spark.sparkContext._jvm.org.apache.hadoop.fs.Path


def write_atomic(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Replace ``path`` as a whole: written beside it, then renamed; readers see the old or the new, never a half."""
    fs, make = _fs(df.sparkSession, path)
    tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    df.write.format(fmt).options(**options).save(tmp)
    old = f"{tmp}.old"
    if fs.exists(make(path)):
        fs.rename(make(path), make(old))
    if not fs.rename(make(tmp), make(path)):
        fs.rename(make(old), make(path))
        raise OSError(f"could not put {path} in place")
    fs.delete(make(old), True)


def write_events(df: DataFrame, path: str, seq: str = "sequence_num", per_chunk: int = 50_000) -> None:
    """Append events as JSON lines in chunks of at most ``per_chunk``, sorted, one folder a chunk."""
    d = df.withColumn("chunk", F.floor(F.col(seq) / per_chunk).cast("long"))
    d.repartitionByRange("chunk", seq).sortWithinPartitions("chunk", seq).write.mode("append").partitionBy("chunk").option("maxRecordsPerFile", per_chunk).json(path)


def write_by_class(df: DataFrame, path: str, cls: str, relevant: str) -> None:
    """One folder for each class and relevance; large classes are spread over tasks."""
    df.write.mode("overwrite").partitionBy(cls, relevant).json(path)


def split_damaged(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) lines: those that are JSON objects, and the rest."""
    ok = F.coalesce(F.try_parse_json(F.col(text)).isNotNull() & F.trim(text).startswith("{"), F.lit(False))
    return lines.where(ok), lines.where(~ok & (F.trim(text) != ""))


def number_events(df: DataFrame, order: list[str], start: int = 0) -> DataFrame:
    """``sequence_num`` without gaps in the given order, from sizes of range partitions; no task holds all rows."""
    from ..session import materialize

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    p = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    p = p.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1))
    s = p.groupBy("_p").agg(F.count("*").alias("_n"))
    s = s.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"))  # as many rows as partitions
    return p.join(F.broadcast(s), "_p").withColumn("sequence_num", F.col("_b") + F.col("_i") + start).drop("_p", "_i", "_m", "_b")


def retained(snapshots: DataFrame, name: str = "name", time: str = "time", zipped: str = "zipped", plain: int = 3, zips: int = 7) -> DataFrame:
    """Snapshots to keep: the newest plain ones, the newest zip of each day, and the newest other zips."""
    day = F.to_date(time)
    d = snapshots.withColumn("_first", F.row_number().over(Window.partitionBy(zipped, day).orderBy(F.desc(time), name)) == 1)
    protected = F.col(zipped) & F.col("_first")
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(zipped, protected).orderBy(F.desc(time), name)))
    return d.where(protected | (~F.col(zipped) & (F.col("_r") <= plain)) | (F.col(zipped) & ~protected & (F.col("_r") <= zips))).drop("_first", "_r")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of each file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
