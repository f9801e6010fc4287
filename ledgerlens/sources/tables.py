"""Result tables partitioned by date and changed in place: only the partitions that a change touches are written anew.

Every rewrite is staged in the shared folder first and then replaces whole date partitions, so it may read the table that it writes. A
rerun after a failure gives the same table: rows are replaced by key, and a job remembers the last change that it has taken.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.storage import stored

#: Files of one date partition; a large date is written by so many tasks.
FILES_A_DATE = 8


def write_dates(rows: DataFrame, path: str, keys: list[str], date_column: str = "created_date", files: int = FILES_A_DATE) -> None:
    """Writes rows as Parquet by date; dates without rows keep theirs."""
    dealt = rows.repartition(F.col(date_column), F.pmod(F.hash(*keys), F.lit(files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(date_column).parquet(path)


def rewrite_dates(table: DataFrame, path: str, touched: DataFrame, build: Callable[[DataFrame], DataFrame], keys: list[str], date_column: str = "created_date") -> None:
    """Replaces the partitions of touched's dates by build(their rows). Dates come to the driver, one a day at most, so that the scan
    names its partitions."""
    dates = [r[0] for r in touched.select(date_column).distinct().collect()]
    if dates:
        write_dates(stored(build(table.filter(F.col(date_column).isin(dates)))), path, keys, date_column)


def upsert_rows(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], date_column: str = "created_date") -> None:
    """Adds rows, in place of those with equal keys and date. Of several new ones with equal keys the largest row stays."""
    table = spark.read.parquet(path)
    others = [c for c in table.columns if c not in keys and c != date_column]
    by = [*keys, date_column]
    new = stored(rows.groupBy(*by).agg(F.max(F.struct(*others)).alias("r")).select(*by, "r.*").select(*table.columns))
    rewrite_dates(table, path, new, lambda old: old.join(new.select(*by), by, "left_anti").unionByName(new), keys, date_column)


def apply_changes(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """jobs after changes (change_no, job_id, status, result, finished_at, failed) with numbers above the job's last_change.

    Of each column the last given value holds; a failure adds one retry. Changes of unknown jobs do nothing."""
    fresh = changes.join(jobs.select("job_id", "last_change"), "job_id").filter("change_no > last_change")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("change_no"))).alias(f"c_{c}")
    folded = fresh.groupBy("job_id").agg(*[last(c) for c in ("status", "result", "finished_at")], F.count_if("failed").alias("c_failed"), F.max("change_no").alias("c_last"))
    joined = jobs.join(folded, "job_id", "left")
    made = {c: F.coalesce(f"c_{c}", c) for c in ("status", "result", "finished_at")}
    made["retry_count"] = (F.col("retry_count") + F.coalesce("c_failed", F.lit(0))).cast(dict(jobs.dtypes)["retry_count"])
    made["last_change"] = F.coalesce("c_last", "last_change")
    return joined.select(*[made[c].alias(c) if c in made else F.col(c) for c in jobs.columns])


def update_job_table(spark: SparkSession, path: str, changes: DataFrame, date_column: str = "created_date") -> None:
    """Applies changes to the stored job table. Which dates hold the changed jobs is read from their ids and dates alone."""
    jobs, changes = spark.read.parquet(path), stored(changes)
    touched = jobs.select("job_id", date_column).join(changes.select("job_id"), "job_id", "left_semi")
    rewrite_dates(jobs, path, touched, lambda old: apply_changes(old, changes), ["job_id"], date_column)


def drop_dates(spark: SparkSession, path: str, dates: list[datetime.date], date_column: str = "created_date") -> None:
    """Removes whole date partitions; those that aren't there are passed over."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for day in dates:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{date_column}={day}")
        folder.getFileSystem(conf).delete(folder, True)


def expire_rows(spark: SparkSession, path: str, today: datetime.date, keep_days: Column, keys: list[str], date_column: str = "created_date", least: int = 30, most: int = 90) -> None:
    """Removes rows older than keep_days, which is held between least and most (null: most).

    Dates older than most go as folders and dates up to least days old stay, both without a look at their rows; of the dates between, those
    with some expired rows are written anew and those with nothing else go. Rows without a date stay. A rerun changes nothing more.
    """
    day = lambda n: F.lit(today - datetime.timedelta(days=n))
    table, at = spark.read.parquet(path), F.col(date_column)
    expired = F.date_diff(F.lit(today), at) > F.least(F.lit(most), F.greatest(F.lit(least), F.coalesce(keep_days, F.lit(most))))
    old = [r[0] for r in table.filter(at < day(most)).select(date_column).distinct().collect()]
    aged = table.filter((at >= day(most)) & (at < day(least))).groupBy(date_column).agg(F.count_if(expired).alias("gone"), F.count("*").alias("rows"))
    found = stored(aged.filter("gone > 0"))
    rewrite_dates(table, path, found.filter("gone < rows"), lambda rows: rows.filter(~expired), keys, date_column)
    drop_dates(spark, path, [*old, *(r[0] for r in found.filter("gone = rows").select(date_column).collect())], date_column)
