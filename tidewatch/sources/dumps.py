"""Plain-text database dumps (COPY blocks): reading one table's rows in as many tasks as the file has splits, and writing such blocks.

A dump is an ordered text, so what a line means depends on lines before it: the columns stand in the block's header, and the block ends at
a line `\\.`. Two slim results carry that to all splits: the first header of the table in each file, with its place, and the first end line after it.
A place is (start of the split, row in its task); rows between the two places are the table's. Compressed files have one split: one task reads each.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of lines that one file of a dump holds, about.
FILE_BYTES = 64 << 20
#: Escapes of the format, in both directions.
ESCAPES = (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ("\\b", "\b"), ("\\f", "\f"), ("\\v", "\v"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, place, line. The same files under the same settings are always split alike, so places can be compared between reads."""
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("place"), F.col("value").alias("line"))


def block(spark: SparkSession, path: str, table: str) -> DataFrame:
    """file, names (columns), cells of the lines of the table's first block in each file; cells are as they stand in the file."""
    rows = lines(spark, path)
    heads = rows.filter(F.col("line").startswith(f"COPY {table} (")).groupBy("file").agg(F.min_by("line", "place").alias("head"), F.min("place").alias("first"))
    ends = rows.filter(F.rtrim("line") == "\\.").select("file", F.col("place").alias("end"))
    last = heads.join(ends, "file", "left").groupBy("file", "head", "first").agg(F.min(F.when(F.col("end") > F.col("first"), F.col("end"))).alias("last"))
    names = F.transform(F.split(F.regexp_extract("head", r"\((.*)\)", 1), ","), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    inside = rows.join(F.broadcast(last), "file").filter((F.col("place") > F.col("first")) & (F.col("last").isNull() | (F.col("place") < F.col("last"))))  # a row per file
    return inside.select("file", names.alias("names"), F.split("line", "\t").alias("cells"))


def is_short(names: Column, cells: Column) -> Column:
    """A line with too few cells: a piece of a text that was broken over lines, or a damaged row."""
    return F.size(cells) < F.size(names)


def copy_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of the table as maps from column to value: \\N is null, escapes are undone. Short lines are no rows (see copy_counts)."""
    rows = block(spark, path, table).filter(~is_short(F.col("names"), F.col("cells")))
    values = F.transform(F.slice("cells", F.lit(1), F.size("names")), lambda c: F.when(c != F.lit("\\N"), unescape(c)))
    return rows.select(F.map_from_arrays("names", values).alias("row"))


def copy_counts(spark: SparkSession, path: str, table: str) -> DataFrame:
    """rows and short lines of the table: what a share is a share of."""
    short = is_short(F.col("names"), F.col("cells"))
    return block(spark, path, table).agg(F.count_if(~short).alias("rows"), F.count_if(short).alias("short"))


def unescape(c: Column) -> Column:
    """Undo the escapes in one pass: a doubled backslash first becomes a mark no text holds. Of other escapes the backslash goes (octal
    digits stay), and one at the end stands for itself."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    for a, b in ESCAPES:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.replace(F.regexp_replace(out, r"(?s)\\(.)", "$1"), F.lit("\u0000"), F.lit("\\"))


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for a, b in ESCAPES:
        out = F.replace(out, F.lit(b), F.lit(a))
    return F.coalesce(out, F.lit("\\N"))


def copy_lines(rows: DataFrame, order: str) -> DataFrame:
    """at (the order) and line of each row."""
    return rows.select(F.col(order).alias("at"), F.concat_ws("\t", *[escape(F.col(c).cast("string")) for c in rows.columns]).alias("line"))


def write_blocks(lines: DataFrame, columns: list[str], path: str, table: str, files: int | None = None) -> None:
    """lines (at, line) as COPY blocks, a file per range of `at`, each with its header and end. files: as many as there are FILE_BYTES of
    lines, four at least, so no task gets a larger share as the table grows. Lines are moved once."""
    if files is None:
        files = max(4, ceil((lines.agg(F.sum(F.octet_length("line"))).first()[0] or 0) / FILE_BYTES))
    head, end = f"COPY {table} ({', '.join(columns)}) FROM stdin;", "\\."

    def block(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.record_batch({"value": [head]})
        for part in parts:
            yield pa.record_batch({"value": part.column("line")})
        yield pa.record_batch({"value": [end]})

    lines.repartitionByRange(files, "at").sortWithinPartitions("at").select("line").mapInArrow(block, "value string").write.text(path)
