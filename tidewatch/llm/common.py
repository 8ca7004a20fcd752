"""Helpers shared by the corpus operators: table access, written intermediates, text batches."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import cut, spent  # noqa: F401

#: A word: a run of characters that are neither the space nor tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Small tables (one row per group, partition or model term) may be broadcast up to this many rows.
BROADCAST_ROWS = 1_000_000


#: Rows and bytes of whole texts that cross to Python at once, where the session leaves Spark's default.
ARROW_ROWS, ARROW_BYTES = 1_000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. Texts are long: the session's Arrow batches are kept small, so that executors need little memory."""
    for key, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        if not spark.sparkContext.getConf().contains(f"spark.sql.execution.arrow.{key}"):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcast when its counted rows are within the bound, else leave it to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def runs(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Cut a batch into index ranges of about `chars` characters, so that long texts stay within memory."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= chars:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet (names are compared as Spark does, whatever their case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def lean(keep: str = "") -> None:
    """Called at the start of a Python task, and at the end of some: a worker process is used again by later stages, and what an
    earlier one remembered (but for the module `keep`), or gave back to the C library alone, would stay beside the JVM
    for the rest of the job."""
    for module, forget in (("tokens", "release"), ("ngram_join", "forget"), ("substrings", "forget")):
        if module != keep and (loaded := sys.modules.get(f"{__package__}.{module}")):
            getattr(loaded, forget)()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever signs their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
