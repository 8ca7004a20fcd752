"""Contiguous shards of near equal bytes from a global prefix sum.

Rows stand in the order (text checksum, size, doc_id), so equal texts are neighbours. A range partitioning deals
that order out evenly, whatever a group of copies weighs; it is written once, each partition's bytes and rows are
totalled, the totals are summed over the partitions (a table of one row per partition), and a row's place is its
partition's start plus its place inside. Shards are cut at equal byte targets: a row belongs to the shard that
holds its middle byte. The result depends on the order alone, not on where the ranges were cut.

Defined cases: null text has no bytes and checksum 0; rows tie only where checksum, size and doc_id are the same, and
those are interchangeable; a very long text is one row and may fill a shard alone; copies of one text stand together
but for groups that a cut falls into; more shards than rows leaves shards empty; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, partitions

SHARDS = 24
#: Bytes that each row costs besides its text.
ROW_BYTES = 8


def shards(docs: DataFrame, n: int = SHARDS, row_bytes: int = ROW_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard, gapless) for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    order = ["text_crc32", "size", "doc_id"]
    slim = docs.select("doc_id", (F.octet_length(text) + row_bytes).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = cut(slim.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    by = Window.orderBy("part")
    starts = totals.select("part", (F.sum("bytes").over(by) - F.col("bytes")).alias("bytes0"), (F.sum("rows").over(by) - F.col("rows")).alias("rows0"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.select("*", F.sum("size").over(inside).alias("to"), F.row_number().over(Window.partitionBy("part").orderBy(*order)).alias("nth")).join(F.broadcast(starts), "part")
    rows = rows.select("doc_id", "size", "text_crc32", (F.col("rows0") + F.col("nth") - 1).alias("at"), F.expr(f"cast((2 * (bytes0 + to) - size) * {n} div (2 * total) as int)").alias("shard"))
    first = rows.groupBy("shard").agg(F.min("at").alias("first"))
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
