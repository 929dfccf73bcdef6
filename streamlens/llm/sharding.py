"""Contiguous, size-balanced shards from a global byte prefix sum. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_text, shared_table

SHARDS = 16


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal every row to one of `shards` contiguous runs of the id order, cut at equal byte targets.

    Rows are ordered by (doc_id, text_crc32, size), nulls first. A range partitioning gives each task a run of that order;
    only the per-partition totals (one row a partition) are prefix-summed globally, then broadcast back, and each
    partition adds its own running sum. A row belongs to the shard in which the middle of its bytes lies, so two
    shards differ by about one row's size. Rows tied on the whole order are dealt out by a row number, so even an id that
    a third of all rows share spreads over partitions.

    Returns doc_id, size (UTF-8 bytes + 1; a null text has none), text_crc32 (null text: that of the empty text), law,
    shard, slot (gapless from 0 in each shard, in id order), grown_shard (null: this law is not stable under growth).
    A null doc_id is a row like any other, repeated rows are dealt one by one, an empty table gives no rows, other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = id_text(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size", "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    placed = shared_table(ranged.withColumn("part", F.spark_partition_id()), "shards")

    so_far = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(so_far), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.partitionBy()).alias("total"),
    )
    # One row a partition of the range exchange: bounded by the number of partitions, not by the data.
    run = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = placed.withColumns({"end_here": F.sum("size").over(run), "row_here": F.row_number().over(W.partitionBy("part").orderBy(*order))})
    ranked = summed.join(F.broadcast(before), "part").select(
        "doc_id", "size", "text_crc32",
        F.expr(f"cast(({shards} * (2 * (bytes_before + end_here) - size)) div (2 * total) as int)").alias("shard"),
        (F.col("rows_before") + F.col("row_here") - 1).alias("rank"),
    )
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first_rank"))
    return ranked.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first_rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
