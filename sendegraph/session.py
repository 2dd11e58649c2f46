"""Session factory and the shared scratch area that cuts lineage.

Iterative operators write their state with :func:`materialize` to a folder that
every executor can reach, so a lost executor costs one recomputed task and never
the whole chain of rounds.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "sendegraph", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the defaults above; ``conf`` wins over them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **(conf or {})}.items():
        b = b.config(k, v)
    return b.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once an application, so that they need no copy of their own.

    The archive lies in the shared scratch folder like all other intermediate files.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root, buf = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    target = sc._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/sendegraph-{sc.applicationId}/code/sendegraph.zip")
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(target, True)
    out.write(buf.getvalue())
    out.close()
    fs.deleteOnExit(target)
    sc.addPyFile(target.toString())


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session. Only a local master may do
    without it: there, and nowhere else, a temporary folder is made.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="sendegraph-")
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage, gives Catalyst true sizes for its join choice, and lets the
    result be read several times with column pruning. The files go when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    ship_package(spark)
    path = f"{scratch_dir(spark)}/sendegraph-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
