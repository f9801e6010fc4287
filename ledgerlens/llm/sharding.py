"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows are range-partitioned by id; each partition reports its total and its row count; the running sums of those
few totals shift every partition's local prefix sums to global ones, and the byte line is cut at equal targets. A row
belongs to the shard in which the middle of its bytes falls, so no shard misses its target by more than one row.

Defined cases: a null text counts as empty; null ids come first; rows with equal ids keep a fixed order by their place
in the input, which also lets one id that holds many rows be spread over partitions; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut, table, text_or_empty

SHARDS = 40
ROW_OVERHEAD = 16


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, shard, slot of every row of docs."""
    text = text_or_empty(text_col)
    sized = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range bounds are sampled anew on each run, so the dealt rows are stored before two branches read them.
    dealt = cut(sized.repartitionByRange(parts, "doc_id", "place").withColumn("part", F.spark_partition_id()))

    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("rows_before"),
    )
    grand = totals.agg(F.sum("part_bytes").alias("all_bytes"))

    local = Window.partitionBy("part").orderBy("doc_id", "place")
    placed = (
        dealt.withColumn("local_end", F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("local_row", F.row_number().over(local))
        .join(F.broadcast(offsets), "part")  # one row for each shuffle partition
        .crossJoin(F.broadcast(grand))  # one row
        .withColumn("middle2", 2 * (F.col("bytes_before") + F.col("local_end")) - F.col("size"))
        .withColumn("shard", F.least(F.expr(f"(middle2 * {shards}) div (2 * all_bytes)"), F.lit(shards - 1)).cast("int"))
        .withColumn("global_row", F.col("rows_before") + F.col("local_row") - 1)
    )
    starts = placed.groupBy("shard").agg(F.min("global_row").alias("shard_start"))
    return placed.join(F.broadcast(starts), "shard").select(  # one row for each shard
        "doc_id", "size", "text_crc32", "shard", (F.col("global_row") - F.col("shard_start")).cast("long").alias("slot")
    )


def op2_byte_prefix_shards(spark, sf_dir):
    return balanced_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
