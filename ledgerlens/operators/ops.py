"""Operations data: inbox, outbox, retries, lookups, duplicates, drift and monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import measures as M

MAX_ATTEMPTS = 5


def new_messages(batch: DataFrame, inbox: DataFrame) -> DataFrame:
    """Messages whose (source_system, message_id) isn't processed yet, each once."""
    done = inbox.filter("status = 'PROCESSED'").select("source_system", "message_id").distinct()
    return batch.join(done, ["source_system", "message_id"], "left_anti").dropDuplicates(["source_system", "message_id"])


def retry_schedule(failures: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Failed jobs (attempts so far): retried after a doubling delay, or sent to the dead-letter queue with an NG result."""
    again = F.col("attempts") < max_attempts
    return (
        failures.withColumn("status", F.when(again, "RETRY").otherwise("DLQ"))
        .withColumn("delay_seconds", F.when(again, M.backoff_seconds(F.col("attempts") + 1)))
        .withColumn("available_at", F.when(again, F.timestamp_seconds(F.unix_timestamp(now) + F.col("delay_seconds"))))
        .withColumn("result", F.when(~again, "NG"))
    )


def outbox_due(events: DataFrame, now: Column, stale_seconds: int = 60, limit: int = 10) -> DataFrame:
    """The oldest due events: waiting or failed ones that are available, and locked ones whose lock is stale."""
    stale = F.unix_timestamp("locked_at") < F.unix_timestamp(now) - stale_seconds
    ready = F.col("status").isin("PENDING", "FAILED") | ((F.col("status") == "PROCESSING") & stale)
    return events.filter(ready & (F.col("available_at") <= now)).orderBy("available_at", "event_id").limit(limit)


def outbox_outcome(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Claimed events after publishing (sent true or false): published, failed with a delay up to an hour, or dead."""
    attempt = F.col("attempt_count") + 1
    return (
        events.withColumn("new_status", F.when(F.col("sent"), "PUBLISHED").when(attempt >= max_attempts, "DLQ").otherwise("FAILED"))
        .withColumn("new_attempts", F.when(F.col("sent"), F.col("attempt_count")).otherwise(attempt))
        .withColumn("delay_seconds", F.when(~F.col("sent"), M.backoff_seconds(attempt, 3600)))
    )


def update_jobs(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Jobs with the given statuses, results and finish times; failures count one more retry."""
    c = changes.select("job_id", F.col("status").alias("c_status"), F.col("result").alias("c_result"), F.col("finished_at").alias("c_finished"), F.col("failed").alias("c_failed"))
    return jobs.join(c, "job_id", "left").select(
        "job_id", F.coalesce("c_status", "status").alias("status"), F.coalesce("c_result", "result").alias("result"), F.coalesce("c_finished", "finished_at").alias("finished_at"), (F.col("retry_count") + F.coalesce(F.col("c_failed").cast("int"), F.lit(0))).alias("retry_count")
    )


def enqueue_outbox(results: DataFrame) -> DataFrame:
    """One result event per job, named by its queue id, with its payload and size."""
    payload = F.to_json(F.struct(*results.columns))
    return results.select("job_id", F.lit("RESULT").alias("event_type"), F.concat(F.lit("out-"), "queue_id").alias("message_id"), payload.alias("payload"), F.octet_length(payload).alias("payload_bytes"), F.lit("PENDING").alias("status"))


def job_detail(jobs: DataFrame, documents: DataFrame, detections: DataFrame) -> DataFrame:
    """Jobs with aggregates of their children; children never multiply each other."""
    d = documents.groupBy("job_id").agg(F.count("*").alias("n_documents"), F.sum("amount").alias("amount"))
    e = detections.groupBy("job_id").agg(F.count("*").alias("n_detections"), F.max("confidence").alias("best"))
    return jobs.join(d, "job_id", "left").join(e, "job_id", "left").na.fill(0, ["n_documents", "n_detections"])


def duplicate_invoices(invoices: DataFrame, months: int = 6) -> DataFrame:
    """Each invoice with the newest earlier one of the same number, vendor and amount within the months before it; of one day the largest id.

    One row per key and day holds that day's count and largest id; a window by key, ordered by day, then looks back over days, so a
    key with many invoices makes no pairs. Null numbers, vendors or amounts match nothing.
    """
    key = ["number", "vendor", "amount"]
    days = invoices.dropna(subset=[*key, "day"]).groupBy(*key, "day").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_id"))
    by_day = Window.partitionBy(*key).orderBy("day")
    counted = days.withColumn("upto", F.sum("n").over(by_day)).withColumn("seen", F.struct(F.lag("last_id").over(by_day).alias("id"), F.lag("day").over(by_day).alias("day")))
    # rows before the first permitted day: a month's shift isn't a fixed number of days, so that day joins the order as a mark
    marks = counted.select(*key, F.add_months("day", -months).alias("at"), F.lit(0).alias("kind"), F.col("day").alias("of"), F.lit(0).cast("long").alias("n"))
    rows = counted.select(*key, F.col("day").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("date").alias("of"), "n")
    along = Window.partitionBy(*key).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = marks.unionByName(rows).withColumn("too_old", F.sum("n").over(along)).filter("kind = 0").select(*key, F.col("of").alias("day"), "too_old")
    found = counted.join(before, [*key, "day"]).withColumn("n_matches", F.col("upto") - F.col("n") - F.col("too_old")).filter("n_matches > 0")
    return invoices.join(found.select(*key, "day", F.col("seen.id").alias("matched_id"), F.col("seen.day").alias("matched_day"), "n_matches"), [*key, "day"]).select("doc_id", "matched_id", "matched_day", "n_matches")


def duplicate_report(invoices: DataFrame, months: int = 6) -> DataFrame:
    """Every invoice (doc_id, pv_no, number, vendor, amount, day) with the verdict of the duplicate check, the matched document, its PV and date,
    and a reason. Invoices without a number, vendor, amount or day can't be checked."""
    matched = invoices.select(F.col("doc_id").alias("matched_id"), F.col("pv_no").alias("matched_pv"))
    found = duplicate_invoices(invoices, months).join(matched, "matched_id")
    whole = F.col("number").isNotNull() & F.col("vendor").isNotNull() & F.col("amount").isNotNull() & F.col("day").isNotNull()
    same = F.concat(F.lit("Same number, vendor and amount as "), F.coalesce("matched_pv", F.lit("a document without PV")), F.lit(" of "), F.col("matched_day").cast("string"), F.lit("."))
    joined = invoices.join(found, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("matched_id").isNotNull(), "DUPLICATE").when(whole, "UNIQUE").otherwise("NOT_APPLICABLE").alias("result"),
        "matched_id", "matched_pv", "matched_day",
        F.when(F.col("matched_id").isNotNull(), same).when(whole, F.lit(f"No equal invoice within {months} months.")).otherwise("Number, vendor, amount or date is missing.").alias("reason"),
    )


def job_children(jobs: DataFrame, finals: DataFrame, ocr: DataFrame, detections: DataFrame, audit: DataFrame) -> DataFrame:
    """Jobs with their final result (the last by time), pages read and their mean confidence, detections and their best one, and audit rows with
    the last action. Each child is one row a job before it is joined, so children never multiply each other."""
    f = finals.groupBy("job_id").agg(F.max_by("result", "finished_at").alias("final_result"))
    o = ocr.groupBy("job_id").agg(F.count("*").alias("n_pages"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))
    d = detections.groupBy("job_id").agg(F.count("*").alias("n_detections"), F.max("confidence").alias("best"))
    a = audit.groupBy("job_id").agg(F.count("*").alias("n_audit"), F.max_by("action", "at").alias("last_action"))
    joined = jobs.join(f, "job_id", "left").join(o, "job_id", "left").join(d, "job_id", "left").join(a, "job_id", "left")
    return joined.na.fill(0, ["n_pages", "n_detections", "n_audit"])


def queue_depth(jobs: DataFrame) -> DataFrame:
    """Jobs (created_at, finished_at) that wait at the end of each hour in which one came or went. Hours are counted first, so the running
    sum that follows goes over one row an hour of the calendar, however many jobs there are."""
    moves = F.array(F.struct(F.col("created_at").alias("at"), F.lit(1).alias("step")), F.struct(F.col("finished_at").alias("at"), F.lit(-1).alias("step")))
    by_hour = jobs.select(F.inline(moves)).filter("at is not null").groupBy(F.date_trunc("hour", "at").alias("hour")).agg(F.count_if(F.col("step") == 1).alias("came"), F.count_if(F.col("step") == -1).alias("went"))
    return by_hour.withColumn("depth", F.sum(F.col("came") - F.col("went")).over(Window.orderBy("hour")))


def message_counters(messages: DataFrame) -> DataFrame:
    """Messages (source_system, message_id, return_code, attempts) by source and return code: how many, how many came again, retries, and those
    given up. A message that came again is counted under the code of its last arrival (at)."""
    each = messages.groupBy("source_system", "message_id").agg(F.count("*").alias("arrivals"), F.max_by("return_code", "at").alias("return_code"), F.max("attempts").alias("attempts"))
    return each.groupBy("source_system", "return_code").agg(
        F.count("*").alias("messages"), F.sum(F.col("arrivals") - 1).alias("duplicates"), F.sum("attempts").alias("retries"), F.count_if(F.col("attempts") >= MAX_ATTEMPTS).alias("given_up")
    )


def latency_by_hour(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.date_trunc("hour", "finished_at").alias("hour")).agg(F.count("*").alias("jobs"), F.count_if(F.col("result") == "OK").alias("ok"), *[F.percentile("duration_ms", p).alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def rule_impact(failures: DataFrame, documents: DataFrame, scenarios: DataFrame) -> DataFrame:
    """How many documents pass if one rule is ignored. scenarios: scenario, ignored_rule (null: none).

    A document fails a scenario unless all its failures are of the ignored rule, so one count of failing documents, and one per rule
    of documents that fail it alone, answer every scenario.
    """
    rules = failures.select("doc_id", "rule_id").groupBy("doc_id").agg(F.min("rule_id").alias("least"), F.max("rule_id").alias("most"))
    alone = rules.filter("least = most").groupBy(F.col("least").alias("ignored_rule")).agg(F.count("*").alias("spared"))
    totals = documents.agg(F.count("*").alias("docs")).join(rules.agg(F.count("*").alias("failing")))  # one row each
    spared = scenarios.join(alone, "ignored_rule", "left").join(F.broadcast(totals)).withColumn("ng", F.col("failing") - F.coalesce("spared", F.lit(0)))
    return spared.select("scenario", "ng", (F.col("docs") - F.col("ng")).alias("ok"))


def delivery_mode(payload_bytes: Column, limit: int = 262_144) -> Column:
    """How a result travels: whole, partly by reference, or by reference."""
    return F.when(payload_bytes <= limit // 2, "INLINE").when(payload_bytes <= limit, "HYBRID").otherwise("REFERENCE")


def masked(text: Column, extract: int = 80) -> Column:
    """E-mail addresses and long digit runs hidden, the rest cut to an extract of so many characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "<email>"), r"[0-9]{6,}", "<number>"), 1, extract)
