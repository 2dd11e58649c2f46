"""Quality gates, inventories and signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gates(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(gate, failures): rows that break each check, and keys that occur more than once; all checks in one pass."""
    one = df.agg(*[F.coalesce(F.sum((~F.coalesce(c, F.lit(False))).cast("long")), F.lit(0)).alias(k) for k, c in checks.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.col(k).alias("failures")) for k in checks]))
    dup = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("failures")).select(F.lit(f"unique {key}").alias("gate"), "failures")
    return one.select(pairs.alias("x")).select("x.gate", "x.failures").unionByName(dup)


def inventory(frames: dict[str, DataFrame]) -> DataFrame:
    """(source, rows, columns, first_columns) of each source."""
    out = None
    for name, df in frames.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("source"), "rows", F.lit(len(df.columns)).cast("long").alias("columns"), F.lit(", ".join(sorted(df.columns)[:8])).alias("first_columns"))
        out = row if out is None else out.unionByName(row)
    return out


def signature(df: DataFrame) -> DataFrame:
    """(rows, signature): the same for the same rows in any order of rows and columns."""
    h = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("signature"))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames have the same signature."""
    return signature(a).first() == signature(b).first()
