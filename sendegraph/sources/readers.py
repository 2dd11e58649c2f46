"""Readers: tolerant CSV, JSON objects by key, event logs, text dumps, cached pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or [])


def read_csv(spark: SparkSession, path: str, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """The named columns of a CSV with a header; absent files give no rows, absent columns blanks, and null is blank for text."""
    types = types or {}
    schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in columns)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    out = []
    for c in columns:
        v = F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string")
        out.append((F.coalesce(v, F.lit("")) if c not in types else F.expr(f"try_cast(`{c}` AS {types[c]})") if c in df.columns else F.lit(None).cast(types[c])).alias(c))
    return df.select(*out)


def read_json_objects(spark: SparkSession, path: str, first_file_wins: bool = True) -> DataFrame:
    """(key, value, file): the entries of files that each hold one JSON object; of a key in several files the first name wins.

    Files whose name begins with ``not_relevant_`` are skipped, those that hold no object give nothing.
    """
    schema = "key string, value string, file string"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    t = spark.read.text(path, wholetext=True).select("value", F.try_element_at(F.split(F.input_file_name(), "/"), F.lit(-1)).alias("file"))
    t = t.where(~F.col("file").startswith("not_relevant_"))
    obj = F.from_json("value", T.MapType(T.StringType(), T.StringType()))
    out = t.select("file", F.explode(obj).alias("key", "value")).select("key", "value", "file")
    if not first_file_wins:
        return out
    return out.groupBy("key").agg(F.min(F.struct("file", "value")).alias("s")).select("key", "s.value", "s.file")


def read_events(spark: SparkSession, path: str, stop_at_damage: bool = False) -> DataFrame:
    """(sequence_num, event_type, timestamp_utc, recorded_at, payload, file, line): JSON lines of an event log.

    Damaged lines are skipped, or end their file with ``stop_at_damage``. The
    payload stays JSON text.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line")).where(F.trim("value") != "")
    schema = "sequence_num long, event_type string, timestamp_utc string, recorded_at string, payload string"
    obj = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    ev = lines.withColumn("e", obj).withColumn("ok", F.col("e").isNotNull() & F.col("e._bad").isNull() & F.trim("value").startswith("{"))
    if stop_at_damage:
        w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
        ev = ev.withColumn("ok", F.min(F.col("ok").cast("int")).over(w) == 1)
    return ev.where("ok").select("e.sequence_num", "e.event_type", "e.timestamp_utc", "e.recorded_at", "e.payload", "file", "line")


def split_blocks(df: DataFrame, key: str, text: str, marker: str = r"--- EPISODE [0-9]+ *-*", end: str = "=" * 50) -> DataFrame:
    """(key, block_no, block): text between markers, up to the end line or the next marker; blank blocks and what stands before are dropped."""
    parts = F.slice(F.split(F.col(text), marker), 2, 1_000_000_000)
    d = df.select(key, F.posexplode(parts).alias("pos", "raw"))
    d = d.select(key, "pos", F.trim(F.split("raw", end)[0], F.lit(" \n\r\t")).alias("block")).where("block <> ''")
    return d.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("pos")) - 1).cast("long").alias("block_no"), "block")


def page_sessions(df: DataFrame, doc: str, page: str, text: str, pattern: str = r"Seite (\d+) von (\d+)") -> DataFrame:
    """(doc, session, pages, first_page, block): pages into episodes: page 1 opens one; pages without a mark join the open one."""
    no = F.try_element_at(F.regexp_extract_all(F.col(text), F.lit(pattern), 1), F.lit(-1))
    w = Window.partitionBy(doc).orderBy(page)
    d = df.withColumn("_s", F.sum(F.when(no == "1", 1).otherwise(0)).over(w))
    return d.groupBy(doc, F.col("_s").cast("long").alias("session")).agg(
        F.count("*").alias("pages"), F.min(page).alias("first_page"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))), lambda x: x.t), "\n").alias("block"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html, file): cached HTML pages; the address is that of their canonical link, else of ``og:url``."""
    t = spark.read.text(path, wholetext=True).select(F.col("value").alias("html"), F.input_file_name().alias("file"))
    g = lambda p: F.nullif(F.regexp_extract("html", p, 1), F.lit(""))
    return t.select(F.coalesce(g(r'rel="canonical"\s+href="([^"]+)"'), g(r'property="og:url"\s+content="([^"]+)"')).alias("url"), "html", "file")


def links(html: Column) -> Column:
    """The distinct targets of a page's links."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'href="([^"]+)"'), 1))


def bindings(payload: Column, *names: str) -> Column:
    """The rows of a SPARQL result in JSON as an array of maps."""
    row = T.MapType(T.StringType(), T.StructType([T.StructField("value", T.StringType())]))
    rows = F.from_json(F.get_json_object(payload, "$.results.bindings"), T.ArrayType(row))
    return F.transform(rows, lambda r: F.create_map(*[x for n in names for x in (F.lit(n), r[n]["value"])]))


def seeds(df: DataFrame, id_: str) -> DataFrame:
    """Rows with a usable id: neither blank nor a word for nothing."""
    return df.where(F.col(id_).isNotNull() & ~F.upper(F.trim(id_)).isin("", "NONE", "NULL", "NAN"))
