"""Session settings and written intermediates."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of so many rows at most, counted, may be broadcast.
BROADCAST_ROWS = 1_000_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build(name: str = "tidewatch", **settings: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, ANSI arithmetic, adaptive execution."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | settings
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a session of one machine may do without and get a folder of its own (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidewatch-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: later stages start from files, not from lineage. The shuffle files of the
    write are removed when it ends, not only when the driver collects its garbage."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    conf, was = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spent(df: DataFrame) -> None:
    """Delete the files of a table that `cut` wrote and that nothing reads any more. Other tables are left alone."""
    top = re.escape(f"{shared_dir(df.sparkSession)}/tables/".split(":", 1)[-1].replace("//", "/"))
    jvm = df.sparkSession.sparkContext._jvm
    for found in {m[1] for f in df.inputFiles() if (m := re.match(rf"((?:\w+:/*)?{top}[0-9a-f]{{32}})/", f))}:
        path = jvm.org.apache.hadoop.fs.Path(found)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark df for broadcast when its counted rows are within the bound, else leave it to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
