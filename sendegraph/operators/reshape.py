"""Matrices, pivots, long and wide forms, tolerant projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def ensure_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns in order; those that are absent are blank."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that there are."""
    return df.select(*[c for c in columns if c in df.columns])


def suffixed(df: DataFrame, suffix: str, keep: list[str] = ()) -> DataFrame:
    """All columns but ``keep`` with the suffix of their source."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{c}_{suffix}") for c in df.columns])


def population(df: DataFrame) -> DataFrame:
    """(column, filled, share): how much of each column is filled, in one pass."""
    aggs = [F.sum((F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).cast("long")).alias(c) for c in df.columns]
    one = df.agg(F.count("*").alias("_n"), *aggs)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(F.col(c), F.lit(0)).alias("filled")) for c in df.columns]))
    return one.select("_n", pairs.alias("x")).select("x.column_name", "x.filled", F.round(F.col("x.filled") / F.greatest("_n", F.lit(1)), 4).alias("share"))


def top_columns(df: DataFrame, always: list[str], most: int) -> DataFrame:
    """The columns to keep: ``always`` and the best filled others, in the order of the table."""
    filled = {r["column_name"]: r["filled"] for r in population(df).collect()}  # as many rows as columns
    rest = sorted((c for c in df.columns if c not in always), key=lambda c: (-filled[c], df.columns.index(c)))
    keep = set(always) | set(rest[: max(0, most - len(always))])
    return df.select(*[c for c in df.columns if c in keep])


def ordinal(df: DataFrame, group: list[str], order: list, name: str = "ordinal") -> DataFrame:
    """The place of each row in its group, from 0.

    Groups are cut where range partitions of (group, order) end: rows are numbered
    inside each part and the sizes of the parts before it are added, so a group
    that holds a third of the table is spread over many tasks. Null is a group.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = materialize(df.repartitionByRange(n, *group, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = part.groupBy("_p", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as partitions
    base = sizes.select(F.col("_p").alias("_q"), *[F.col(g).alias(f"_g_{g}") for g in group], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    inner = part.withColumn("_i", F.row_number().over(Window.partitionBy("_p", *group).orderBy(*order)))
    same = F.col("_p") == F.col("_q")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return inner.join(base, same).select(*df.columns, (F.col("_b") + F.col("_i") - 1).cast("long").alias(name))


def wide(df: DataFrame, key: str, ordinal_col: str, fields: list[str], width: int | None = None) -> DataFrame:
    """Long to wide: ``field_i`` for the ordinals below ``width``; without one, for all there are, at least one, by one aggregate."""
    if width is None:
        width = int(df.agg(F.coalesce(F.max(ordinal_col), F.lit(0))).first()[0]) + 1
    return df.groupBy(key).agg(*[F.max(F.when(F.col(ordinal_col) == i, F.col(f))).alias(f"{f}_{i}") for i in range(width) for f in fields])


def long(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Wide to long: one row for each filled cell."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(key, cells.alias("x")).select(key, "x.field", "x.value").where("value IS NOT NULL AND trim(value) <> ''")


def occurrence(df: DataFrame, person: str, episode: str) -> DataFrame:
    """The occurrence matrix in long form: distinct (person, episode)."""
    return df.select(F.col(person).alias("person"), F.col(episode).alias("episode")).where("person IS NOT NULL AND episode IS NOT NULL").distinct()


def cooccurrence(occ: DataFrame) -> DataFrame:
    """The product of the matrix with itself: (a, b, n), the diagonal being each one's own count.

    Meant for a choice of persons; for all of them use the blocked operator.
    """
    x, y = occ.select(F.col("person").alias("a"), "episode"), occ.select(F.col("person").alias("b"), "episode")
    return x.join(y, "episode").groupBy("a", "b").agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, rows: str, cols: str, values: list[str], carrier: str) -> DataFrame:
    """Distinct carriers per (row, column); the columns are given, absent cells are 0."""
    return df.groupBy(rows).agg(*[F.count_distinct(F.when(F.col(cols) == v, F.col(carrier))).alias(f"n_{v}") for v in values])


def chunks(c: Column) -> Column:
    """The parts of a label between commas, semicolons, bars, slashes and hyphens."""
    return F.filter(F.transform(F.split(c, r"[,;|/\\-]+"), lambda x: F.trim(x)), lambda x: x != "")


def append_wide(base: DataFrame, wide_rows: DataFrame, key: str) -> DataFrame:
    """Base rows with the columns of a wide table; columns of the same names from an earlier run are replaced, so it may be run again."""
    new = [c for c in wide_rows.columns if c != key]
    return base.drop(*new).join(wide_rows, key, "left")


def in_order_of(df: DataFrame, key: str, order: DataFrame, place: str) -> DataFrame:
    """``position`` of each row by another table's places (key, place), rows without one at the end in order of the key."""
    from .stats import running

    d = df.join(order.groupBy(key).agg(F.min(place).alias("_place")), key, "left").withColumn("_one", F.lit(1))
    return running(d, [F.asc_nulls_last("_place"), F.asc(key)], "_one").withColumnRenamed("rank", "position").drop("_place", "_one", "running", "cumulative_pct")


def overwrite(df: DataFrame, column: str, mask: Column, value: Column) -> DataFrame:
    """The column replaced where the mask is true; null is not true."""
    return df.withColumn(column, F.when(F.coalesce(mask, F.lit(False)), value).otherwise(F.col(column)))


def enabled(catalogue: DataFrame, flag: str, kind: str, derived: str = "derived") -> DataFrame:
    """Rows of a catalogue that are not switched off (``0``) and not of the derived kind; null is switched on."""
    return catalogue.where((F.coalesce(F.trim(F.col(flag).cast("string")), F.lit("")) != "0") & (F.coalesce(kind, F.lit("")) != derived))


def schema_mapping(spark, frames: dict[str, DataFrame], wanted: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """(source, source_column, canonical, strategy): the first wanted column that a source has, for each canonical name; ``a.b`` needs a only."""
    rows = []
    for source, df in frames.items():
        for canonical, options in wanted.items():
            for column, strategy in options:
                if column.split(".")[0] in df.columns:
                    rows.append((source, column, canonical, strategy))
                    break
    return spark.createDataFrame(rows, "source string, source_column string, canonical string, strategy string")


def allowed(asked: str | list[str] | None, known: list[str]) -> list[str]:
    """The mention types asked for, in the known order; none asked for means all; an unknown one is an error."""
    got = [x.strip().lower() for x in (asked.split(",") if isinstance(asked, str) else asked or [])]
    got = [x for x in got if x]
    wrong = sorted(set(got) - set(known))
    if wrong:
        raise ValueError(f"unknown types: {', '.join(wrong)}")
    return [x for x in known if not got or x in got]
