"""Tables changed in place, envelopes of any size, streams with restarts and timers."""

import datetime
import json

from pyspark.sql import functions as F

from ledgerlens.sources import files as S
from ledgerlens.sources import tables as TB
from ledgerlens.streaming import intake, retry_timers

D = datetime.date
JOB = "job_id long, status string, result string, finished_at date, retry_count long, last_change long, created_date date"
CHANGE = "change_no long, job_id long, status string, result string, finished_at date, failed boolean"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_job_changes_apply_once(spark, tmp_path):
    path = f"{tmp_path}/jobs"
    TB.write_dates(spark.createDataFrame([(i, "NEW", None, None, 0, 0, D(2024, 1, 1 + i % 2)) for i in range(4)], JOB), path, ["job_id"])
    untouched = {f.name for f in (tmp_path / "jobs" / "created_date=2024-01-02").iterdir()}
    changes = spark.createDataFrame([(1, 0, "FAILED", "NG", None, True), (2, 0, "DONE", None, D(2024, 2, 1), True), (1, 99, "X", None, None, True), (3, 2, None, None, None, None)], CHANGE)
    for _ in range(2):
        TB.update_job_table(spark, path, changes)
    back = spark.read.parquet(path)
    assert rows(back.filter("job_id = 0"), "status", "result", "finished_at", "retry_count", "last_change") == [("DONE", "NG", D(2024, 2, 1), 2, 2)]
    assert rows(back.filter("job_id <> 0"), "job_id", "status", "retry_count", "last_change") == [(1, "NEW", 0, 0), (2, "NEW", 0, 3), (3, "NEW", 0, 0)]
    assert {f.name for f in (tmp_path / "jobs" / "created_date=2024-01-02").iterdir()} == untouched
    TB.update_job_table(spark, path, changes.filter("false"))
    TB.update_job_table(spark, path, spark.createDataFrame([(2, 0, "LATE", None, None, False), (3, 0, None, "OK", None, False)], CHANGE))
    assert rows(spark.read.parquet(path).filter("job_id = 0"), "status", "result", "last_change") == [("DONE", "OK", 3)]


def test_upsert_replaces_by_key(spark, tmp_path):
    path, schema = f"{tmp_path}/t", "k long, v string, created_date date"
    TB.write_dates(spark.createDataFrame([(1, "a", D(2024, 1, 1)), (2, "b", D(2024, 1, 1)), (1, "c", D(2024, 1, 2))], schema), path, ["k"])
    new = spark.createDataFrame([(1, "y", D(2024, 1, 1)), (1, "z", D(2024, 1, 1)), (5, None, D(2024, 1, 3))], schema)
    for _ in range(2):
        TB.upsert_rows(spark, path, new, ["k"])
    assert sorted(map(str, rows(spark.read.parquet(path), "k", "v", "created_date"))) == sorted(map(str, [(1, "z", D(2024, 1, 1)), (2, "b", D(2024, 1, 1)), (1, "c", D(2024, 1, 2)), (5, None, D(2024, 1, 3))]))


def test_envelopes_of_any_size(spark, tmp_path):
    jobs = spark.createDataFrame([(1, 'a "quoted"\nname'), (2, None), (3, "none")], "job_id long, name string")
    docs = spark.range(5000).select(F.lit(1).cast("long").alias("job_id"), (4999 - F.col("id")).alias("document_index"), F.concat(F.lit("},{ "), F.col("id").cast("string")).alias("number"))
    docs = docs.unionByName(spark.createDataFrame([(2, 7, "x"), (9, 0, "no job")], "job_id long, document_index long, number string"))
    S.write_envelopes(jobs, docs, f"{tmp_path}/e")
    lines = [json.loads(line) for f in sorted((tmp_path / "e").glob("part-*")) for line in f.read_text().split("\n") if line.strip()]
    by_job = {e["summary"]["job_id"]: e for e in lines}
    assert len(lines) == 3 and by_job[1]["summary"]["name"] == 'a "quoted"\nname' and by_job[3]["documents"] == []
    assert [d["document_index"] for d in by_job[1]["documents"]] == list(range(5000)) and by_job[1]["documents"][0]["number"] == "},{ 4999"
    assert by_job[2] == {"schema_version": "1.1", "summary": {"job_id": 2}, "documents": [{"document_index": 7, "number": "x"}]}


def test_truth_rows(spark, tmp_path):
    (tmp_path / "t").mkdir()
    lines = [{"file_name": "a", "fields": {"n": "old"}}, {"file": "a", "n": {"value": 5.5, "currency": "IDR"}, "d": None}, {"document_name": "b", "fields": {"n": 7}}, {"n": "no name"}]
    (tmp_path / "t" / "t.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nbroken\n")
    assert sorted(map(tuple, S.truth_rows(spark, f"{tmp_path}/t").collect()), key=str) == [("a", "d", None, None), ("a", "n", "5.5", "IDR"), ("b", "n", "7", None)]


def test_intake_survives_a_batch_run_twice(spark, tmp_path):
    out = f"{tmp_path}/out"
    intake.prepare(spark, out)
    message = lambda i: (json.dumps({"QUEUE_ID": f"L{i}", "DOC_TYPE": "INV"}),)
    step = intake.intake_batch(out)
    first = spark.createDataFrame([message(1), message(1), message(2), ("broken",)], "value string")
    step(first, 0)
    step(first, 0)
    step(spark.createDataFrame([message(2), message(3), (None,)], "value string"), 1)
    assert rows(spark.read.parquet(f"{out}/requests"), "message_id", "batch_no") == [("MSG-L1", 0), ("MSG-L2", 0), ("MSG-L3", 1)]
    assert spark.read.parquet(f"{out}/rejects").count() == 2


def test_retries_fall_due_in_event_time(spark, tmp_path):
    out, source = f"{tmp_path}/out", f"{tmp_path}/in"
    key, store = retry_timers.STATE_STORE
    spark.conf.set(key, store)

    def run(*failures):
        spark.createDataFrame([(j, datetime.datetime(2024, 1, 1, 0, 0, s)) for j, s in failures], "job_id long, at timestamp").coalesce(1).write.mode("append").parquet(source)
        read = spark.readStream.schema("job_id long, at timestamp").parquet(source).withWatermark("at", "0 seconds")
        failed = retry_timers.only(read, F.col("job_id") > 0, "at").select("job_id", F.unix_millis("at").alias("at_ms"), "at")
        retry_timers.due_retries(failed, max_attempts=3).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return [(r.job_id, r.attempt, r.status, r.due_ms - 1704067200000) for r in spark.read.parquet(out).orderBy("job_id", "attempt").collect()]

    assert run((1, 0), (2, 0), (2, 0), (2, 5)) == [(2, 3, "DLQ", 5000)]
    assert run((0, 31)) == [(1, 1, "RETRY", 30000), (2, 1, "RETRY", 30000), (2, 3, "DLQ", 5000)]
    assert run((1, 40), (0, 59)) == [(1, 1, "RETRY", 30000), (2, 1, "RETRY", 30000), (2, 3, "DLQ", 5000)]
