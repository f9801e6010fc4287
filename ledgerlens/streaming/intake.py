"""Request intake end to end: a stream of raw messages to tables of requests and rejects, each message once, across restarts.

Every micro-batch writes into folders named by its number, so a batch that runs again after a failure replaces what it had written. It
compares with the stored inbox of earlier batches only, so it finds the same messages new again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.ops import new_messages
from ledgerlens.sources.requests import normalize_requests, parse_messages

INBOX = "source_system string, message_id string, status string, batch_no long"


def prepare(spark: SparkSession, out: str) -> None:
    """An empty inbox, unless there is one."""
    nothing = spark.createDataFrame([], INBOX).drop("batch_no")
    nothing.write.mode("ignore").parquet(f"{out}/inbox/batch_no=-1")


def intake_batch(out: str):
    """A foreachBatch function: new requests to out/requests, what is no JSON object to out/rejects, their messages to out/inbox."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        good, bad = parse_messages(batch)
        inbox = spark.read.schema(INBOX).parquet(f"{out}/inbox").filter(F.col("batch_no") < number)
        at = f"batch_no={number}"
        new_messages(normalize_requests(good), inbox).write.mode("overwrite").parquet(f"{out}/requests/{at}")
        bad.select("value").write.mode("overwrite").parquet(f"{out}/rejects/{at}")
        # Last, and from what was stored: a batch counts as taken in once its requests are.
        taken = spark.read.parquet(f"{out}/requests/{at}").select("source_system", "message_id", F.lit("PROCESSED").alias("status"))
        taken.write.mode("overwrite").parquet(f"{out}/inbox/{at}")

    return step


def run_intake(spark: SparkSession, source: str, out: str, files_a_batch: int = 1000) -> None:
    """Takes in all files of source that no earlier run has, and ends."""
    prepare(spark, out)
    raw = spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(source)
    query = raw.writeStream.foreachBatch(intake_batch(out)).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
