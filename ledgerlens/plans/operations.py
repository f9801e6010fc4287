"""Queries over requests, messages, jobs and monitoring data."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions import fixed_values as V
from ledgerlens.functions import measures as M
from ledgerlens.functions import text as T
from ledgerlens.operators import ops as P
from ledgerlens.plans import fixtures as fx
from ledgerlens.plans import verification as ver
from ledgerlens.sources import requests as R
from ledgerlens.storage import shared_dir
from ledgerlens.streaming import streams


def now():
    """The moment that the queries call now."""
    return F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")


def _messages(spark, sf):
    """Every third order as a batch message, every third as a legacy one, the rest broken."""
    k = F.col("o_orderkey")
    items = fx.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = fx.read(spark, sf, "orders").join(items, "o_orderkey").join(fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    docs = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.struct(F.format_string("D%d", i).alias("document_id"), F.lit("INV").alias("document_type"), F.format_string("http://files/x/%d/%d.pdf?sig=1", k, i).alias("attachment_url")))
    batch = F.to_json(F.struct(F.concat(F.lit("Q"), k).alias("queue_no"), F.concat(F.lit("PV"), k).alias("pv_no"), F.lit("NORMAL").alias("transaction_type"), F.col("c_name").alias("vendor_name"), F.format_string("%.2f", "o_totalprice").alias("total_amount"), docs.alias("documents")))
    legacy = F.to_json(F.struct(F.concat(F.lit("L"), k).alias("QUEUE_ID"), F.concat(F.lit("DOC"), k).alias("DOC_NO"), F.lit("DN").alias("DOC_TYPE"), F.lit("1").alias("DOC_SEQ"), F.lit("REIMBURSEMENT_TOLL").alias("TRANS_TYPE_CD"), F.concat(k, F.lit(".PNG")).alias("FILE_NM"), F.concat(F.lit("/in/"), k).alias("PATH_FILE")))
    return o.select(k.alias("k"), F.when(k % 3 == 0, batch).when(k % 3 == 1, legacy).otherwise(F.concat(F.lit('{"queue_no": '), k)).alias("value"))


def request_documents(spark, sf):
    good, _ = R.parse_messages(_messages(spark, sf))
    return R.request_documents(R.normalize_requests(good)).select("queue_id", "external_document_id", "document_index", "document_type", "file_name", "mime_type")


def idempotency_keys(spark, sf):
    good, _ = R.parse_messages(_messages(spark, sf))
    return R.normalize_requests(good).select("queue_id", "message_id", "source_system", "idempotency_key", "transaction_type", "total_amount")


def bad_requests(spark, sf):
    return R.parse_messages(_messages(spark, sf))[1].select("k", "value")


def _events(spark, sf):
    return fx.read(spark, sf, "events").select(F.col("event_type").alias("source_system"), F.col("user_id").alias("message_id"), "event_id", "ts", "props")


def inbox_new(spark, sf):
    e = _events(spark, sf)
    old = e.filter("ts < timestamp_ntz '2024-01-11'").withColumn("status", F.lit("PROCESSED"))
    return P.new_messages(e.filter("ts >= timestamp_ntz '2024-01-11'"), old).select("source_system", "message_id")


def stream_inbox_dedup(spark, sf):
    """The dedup stream run over all stored events."""
    name = f"inbox_{uuid.uuid4().hex}"
    source = spark.readStream.schema(fx.read(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")
    deduped = streams.inbox_dedup(source.select(F.col("event_type").alias("source_system"), F.col("user_id").alias("message_id"), "ts"), delay="60 days").select("source_system", "message_id")
    shared = shared_dir(spark)
    query = deduped.writeStream.format("parquet").option("path", f"{shared}/{name}/out").option("checkpointLocation", f"{shared}/{name}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("source_system string, message_id long").parquet(f"{shared}/{name}/out")


def retry_schedule(spark, sf):
    e = _events(spark, sf).filter("source_system = 'error'").select(F.col("message_id").alias("job_id"), (F.col("event_id") % 7).cast("int").alias("attempts")).dropDuplicates(["job_id", "attempts"])
    return P.retry_schedule(e, now().cast("timestamp")).select("job_id", "attempts", "status", "delay_seconds", "result")


def _outbox(spark, sf):
    k = F.col("event_id")
    return _events(spark, sf).select("event_id", F.get(F.array(*[F.lit(s) for s in ("PENDING", "FAILED", "PROCESSING", "PUBLISHED", "DLQ")]), (k % 5).cast("int")).alias("status"), F.col("ts").alias("available_at"), F.col("ts").alias("locked_at"), (k % 6).cast("int").alias("attempt_count"), (k % 3 == 0).alias("sent"))


def outbox_due(spark, sf):
    return P.outbox_due(_outbox(spark, sf), now()).select("event_id", "status", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss").alias("available_at"))


def outbox_outcome(spark, sf):
    return P.outbox_outcome(_outbox(spark, sf)).groupBy("new_status", "new_attempts").agg(F.count("*").alias("n"), F.max("delay_seconds").alias("delay_seconds"))


def _jobs(spark, sf):
    k = F.col("o_orderkey")
    states = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "PROCESSING").otherwise("FAILED")
    finished = F.to_timestamp_ntz(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd "), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:00")))
    return fx.read(spark, sf, "orders").select(k.alias("job_id"), F.concat(F.lit("Q"), k).alias("queue_id"), "o_custkey", states.alias("status"), F.when(k % 4 != 0, "OK").otherwise("NG").alias("result"), finished.alias("finished_at"), (1000 + k * 37 % 9000).alias("duration_ms"), (k % 3).cast("int").alias("retry_count"), "o_totalprice", "o_orderdate")


def job_latest(spark, sf):
    return _jobs(spark, sf).orderBy(F.desc("o_orderdate"), F.desc("job_id")).limit(20).select("job_id", "status")


def job_status(spark, sf):
    """Lookup of one job by its queue id."""
    return _jobs(spark, sf).filter("queue_id = 'Q100'").select("queue_id", "status", "result", F.date_format("finished_at", "yyyy-MM-dd HH").alias("finished"))


def job_detail(spark, sf):
    docs = fx.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_extendedprice").alias("amount"))
    dets = fx.detections(spark, sf).select(F.col("doc_id").alias("job_id"), "confidence")
    return P.job_detail(_jobs(spark, sf).select("job_id", "status"), docs, dets).select("job_id", "status", "n_documents", F.round("amount", 2).alias("amount"), "n_detections", "best")


def job_update(spark, sf):
    j = _jobs(spark, sf)
    changes = j.filter("job_id % 5 = 0").select("job_id", F.lit("FAILED").alias("status"), F.lit("NG").alias("result"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), (F.col("job_id") % 2 == 0).alias("failed"))
    return P.update_jobs(j, changes).groupBy("status", "result", "retry_count").agg(F.count("*").alias("n"))


def outbox_enqueue(spark, sf):
    return P.enqueue_outbox(_jobs(spark, sf).select("job_id", "queue_id", "status")).select("job_id", "message_id", "payload", "payload_bytes")


def duplicate_invoices(spark, sf):
    o = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("number"), F.col("o_custkey").alias("vendor"), F.floor(F.col("o_totalprice") / 50000).cast("long").alias("amount"), F.to_date("o_orderdate").alias("day"))
    return P.duplicate_invoices(o).select("doc_id", "matched_id", F.col("matched_day").cast("string").alias("matched_day"), "n_matches")


def ops_counters(spark, sf):
    return _jobs(spark, sf).groupBy("status").agg(F.count("*").alias("jobs"), F.count_if(F.col("result") == "OK").alias("ok"), F.sum("retry_count").alias("retries"))


def hourly_latency(spark, sf):
    return P.latency_by_hour(_jobs(spark, sf)).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "jobs", "ok", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), F.round("p99", 4).alias("p99"))


def top_failed_rules(spark, sf):
    return ver._failures(spark, sf).groupBy("rule_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule_id").limit(5)


def review_rates(spark, sf):
    """False OK and false NG against human labels."""
    labels = fx.read(spark, sf, "labels").join(fx.read(spark, sf, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    said = F.col("n_chars") >= 500
    return labels.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(said & (F.col("quality") == 0)).alias("false_ok"), F.count_if(~said & (F.col("quality") == 1)).alias("false_ng"))


def drift_cube(spark, sf):
    e = fx.read(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return e.cube("event_type", "day").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value")).select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("day", F.lit("all")).alias("day"), "n", "mean_value")


def header_breakdown(spark, sf):
    """Counts by category and verdict, as columns."""
    j = _jobs(spark, sf).withColumn("category", F.when(F.col("job_id") % 5 == 0, "second").otherwise("main"))
    return j.groupBy("o_custkey").agg(*[F.count_if((F.col("category") == c) & (F.col("result") == r)).alias(f"{c}_{r.lower()}") for c in ("main", "second") for r in ("OK", "NG")])


def stage_timings(spark, sf):
    k = F.col("job_id")
    m = F.create_map(F.lit("render"), k % 300, F.lit("detect"), k % 50, F.lit("ocr"), 500 + k % 1500)
    return _jobs(spark, sf).select(F.explode(m).alias("stage", "ms")).groupBy("stage").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.max("ms").alias("longest_ms"))


def error_classes(spark, sf):
    """Failures by class with whether they are worth a retry."""
    classes = spark.createDataFrame([(0, "INTERNAL_ERROR", True), (1, "TIMEOUT_ERROR", True), (2, "DOCUMENT_ERROR", False), (3, "VALIDATION_ERROR", False), (4, "DLQ_ERROR", False)], "code long, return_code string, retryable boolean")
    return _jobs(spark, sf).filter("status = 'FAILED'").withColumn("code", F.col("job_id") % 5).join(F.broadcast(classes), "code").groupBy("return_code", "retryable").agg(F.count("*").alias("n"))


def rule_impact(spark, sf):
    scenarios = spark.createDataFrame([("base", None), ("no_stamp", "INV-STAMP-R005"), ("no_amount_match", "INV-R009")], "scenario string, ignored_rule string")
    return P.rule_impact(ver._failures(spark, sf), ver._documents(spark, sf), scenarios)


def delivery_modes(spark, sf):
    d = fx.read(spark, sf, "documents").select(F.octet_length("text").alias("b"))
    return d.select(P.delivery_mode(F.col("b"), 4000).alias("mode"), "b").groupBy("mode").agg(F.count("*").alias("n"), F.max("b").alias("largest"))


def model_attach(spark, sf):
    models = spark.createDataFrame([("signature", "v1", False), ("signature", "v2", True), ("stamp", "v7", True)], "object_type string, version string, is_active boolean")
    return fx.detections(spark, sf).join(F.broadcast(models.filter("is_active")), "object_type", "left").groupBy("object_type", "version").agg(F.count("*").alias("n"))


def masked_extract(spark, sf):
    return fx.read(spark, sf, "documents").select("doc_id", F.md5(P.masked(F.col("text"))).alias("extract_md5"))


def remark_priority(spark, sf):
    """The most important failed rule of each invoice, by a fixed order of rules."""
    rank = F.array_position(F.array(*[F.lit(r) for r in ("INV-R002", "INV-R001", "INV-R009", "INV-STAMP-R005")]), F.col("rule_id"))
    w = Window.partitionBy("doc_id").orderBy(F.when(rank == 0, 99).otherwise(rank), "rule_order")
    return ver._failures(spark, sf).withColumn("seat", F.row_number().over(w)).filter("seat = 1").groupBy("rule_id").agg(F.count("*").alias("n"))


def audit_log(spark, sf):
    """One audit row per change of a job, with what was before and after."""
    j = _jobs(spark, sf)
    return j.select("job_id", F.lit("worker").alias("actor"), F.explode(F.array(F.lit("JOB_ACCEPTED"), F.concat(F.lit("JOB_"), "status"))).alias("action")).groupBy("actor", "action").agg(F.count("*").alias("n"))


def retention(spark, sf):
    """Dead letters kept: those of the last 20 days before the end of the month."""
    return _outbox(spark, sf).filter("status = 'DLQ' and available_at >= timestamp_ntz '2024-01-31' - interval 20 days").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


def field_confidence_blend(spark, sf):
    k = F.col("job_id")
    return _jobs(spark, sf).select("job_id", F.round(M.field_blend(k % 100, k % 90, k % 80, k % 70), 4).alias("confidence"))


def largest_amount(spark, sf):
    """Without labels: the largest amount in the text of each invoice."""
    pages = fx.invoices(spark, sf).select("doc_id", F.concat_ws(" ", *[F.concat(F.lit("Rp "), F.format_number(c, 2)) for c in ("tax", "total", "discount")]).alias("t"))
    found = F.transform(F.regexp_extract_all("t", F.lit(V.CURRENCY_AMOUNT), F.lit(2)), T.parse_money)
    return pages.select("doc_id", F.array_max(found).cast("double").alias("amount"))


QUERIES = {f.__name__: f for f in (
    request_documents, idempotency_keys, bad_requests, inbox_new, stream_inbox_dedup, retry_schedule, outbox_due, outbox_outcome, job_latest, job_status, job_detail, job_update, outbox_enqueue,
    duplicate_invoices, ops_counters, hourly_latency, top_failed_rules, review_rates, drift_cube, header_breakdown, stage_timings, error_classes, rule_impact, delivery_modes, model_attach,
    masked_extract, remark_priority, audit_log, retention, field_confidence_blend, largest_amount,
)}

_M = "SELECT o_orderkey AS k, o_totalprice, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey"
_J = "SELECT o_orderkey AS job_id, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'FAILED' END AS status, CASE WHEN o_orderkey % 4 <> 0 THEN 'OK' ELSE 'NG' END AS result, CAST(1000 + o_orderkey * 37 % 9000 AS BIGINT) AS duration_ms, CAST(o_orderkey % 3 AS INTEGER) AS retry_count, o_orderdate, strftime(o_orderdate, '%Y-%m-%d ') || lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') AS hour FROM orders"
_O = "SELECT event_id, ['PENDING','FAILED','PROCESSING','PUBLISHED','DLQ'][event_id % 5 + 1] AS status, ts, CAST(event_id % 6 AS INTEGER) AS attempt_count, event_id % 3 = 0 AS sent FROM events"
_F = f"SELECT doc_id, r.id AS rule_id, r.o AS o FROM ({ver._RULES})"

ORACLES = {
    "request_documents": f"""SELECT 'Q' || k AS queue_id, 'D' || i AS external_document_id, CAST(i - 1 AS INTEGER) AS document_index, 'INV' AS document_type, i || '.pdf' AS file_name, 'application/pdf' AS mime_type FROM (SELECT k, unnest(range(1, n + 1)) AS i FROM ({_M}) WHERE k % 3 = 0)
  UNION ALL SELECT 'L' || k, 'DOC-001', 0, 'DN', k || '.PNG', 'image/png' FROM ({_M}) WHERE k % 3 = 1""",
    "idempotency_keys": f"""SELECT 'Q' || k AS queue_id, 'MSG-Q' || k AS message_id, 'ELVIS' AS source_system, sha256('Q' || k || '|' || array_to_string(list_transform(range(1, n + 1), lambda i: 'D' || i || '|http://files/x/' || k || '/' || i || '.pdf?sig=1'), '|')) AS idempotency_key, 'NORMAL' AS transaction_type, o_totalprice AS total_amount FROM ({_M}) WHERE k % 3 = 0
  UNION ALL SELECT 'L' || k, 'MSG-L' || k, 'VISION', sha256('DOC' || k || '|DN|1|' || k || '.PNG|/in/' || k), 'REIMBURSEMENT_TOLL', NULL FROM ({_M}) WHERE k % 3 = 1""",
    "bad_requests": f"SELECT k, '{{\"queue_no\": ' || k AS value FROM ({_M}) WHERE k % 3 = 2",
    "inbox_new": "SELECT DISTINCT event_type AS source_system, user_id AS message_id FROM events e WHERE ts >= TIMESTAMP '2024-01-11' AND NOT EXISTS (SELECT 1 FROM events o WHERE o.ts < TIMESTAMP '2024-01-11' AND o.event_type = e.event_type AND o.user_id = e.user_id)",
    "stream_inbox_dedup": "SELECT DISTINCT event_type AS source_system, user_id AS message_id FROM events",
    "retry_schedule": "SELECT DISTINCT user_id AS job_id, CAST(event_id % 7 AS INTEGER) AS attempts, CASE WHEN event_id % 7 < 5 THEN 'RETRY' ELSE 'DLQ' END AS status, CASE WHEN event_id % 7 < 5 THEN CAST(30 * power(2, event_id % 7) AS BIGINT) END AS delay_seconds, CASE WHEN event_id % 7 >= 5 THEN 'NG' END AS result FROM events WHERE event_type = 'error'",
    "outbox_due": f"SELECT event_id, status, strftime(ts, '%Y-%m-%d %H:%M:%S') AS available_at FROM ({_O}) WHERE (status IN ('PENDING', 'FAILED') OR (status = 'PROCESSING' AND epoch(date_trunc('second', ts)) < epoch(TIMESTAMP '2024-01-15') - 60)) AND ts <= TIMESTAMP '2024-01-15' ORDER BY ts, event_id LIMIT 10",
    "outbox_outcome": f"SELECT CASE WHEN sent THEN 'PUBLISHED' WHEN attempt_count + 1 >= 5 THEN 'DLQ' ELSE 'FAILED' END AS new_status, CAST(CASE WHEN sent THEN attempt_count ELSE attempt_count + 1 END AS INTEGER) AS new_attempts, count(*) AS n, max(CASE WHEN NOT sent THEN CAST(least(3600, 30 * power(2, attempt_count)) AS BIGINT) END) AS delay_seconds FROM ({_O}) GROUP BY 1, 2",
    "job_latest": f"SELECT job_id, status FROM ({_J}) ORDER BY o_orderdate DESC, job_id DESC LIMIT 20",
    "job_status": f"SELECT 'Q' || job_id AS queue_id, status, result, hour AS finished FROM ({_J}) WHERE job_id = 100",
    "job_detail": fx.duck(f"SELECT j.job_id, status, coalesce(n, 0) AS n_documents, round(amount, 2) AS amount, coalesce(d.m, 0) AS n_detections, best FROM ({_J}) j LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS amount FROM lineitem GROUP BY 1) ON l_orderkey = job_id LEFT JOIN (SELECT doc_id, count(*) AS m, max(confidence) AS best FROM fx_detections GROUP BY 1) d ON d.doc_id = job_id"),
    "job_update": f"SELECT CASE WHEN job_id % 5 = 0 THEN 'FAILED' ELSE status END AS status, CASE WHEN job_id % 5 = 0 THEN 'NG' ELSE result END AS result, CAST(retry_count + CASE WHEN job_id % 10 = 0 THEN 1 ELSE 0 END AS INTEGER) AS retry_count, count(*) AS n FROM ({_J}) GROUP BY 1, 2, 3",
    "outbox_enqueue": f"SELECT job_id, 'out-Q' || job_id AS message_id, p AS payload, CAST(strlen(p) AS INTEGER) AS payload_bytes FROM (SELECT job_id, '{{\"job_id\":' || job_id || ',\"queue_id\":\"Q' || job_id || '\",\"status\":\"' || status || '\"}}' AS p FROM ({_J}))",
    "duplicate_invoices": "SELECT doc_id, arg_max(e_id, (e_day, e_id)) AS matched_id, CAST(max(e_day) AS VARCHAR) AS matched_day, count(*) AS n_matches FROM (SELECT a.o_orderkey AS doc_id, b.o_orderkey AS e_id, CAST(b.o_orderdate AS DATE) AS e_day FROM orders a JOIN orders b USING (o_custkey, o_orderpriority) WHERE floor(a.o_totalprice / 50000) = floor(b.o_totalprice / 50000) AND CAST(b.o_orderdate AS DATE) < CAST(a.o_orderdate AS DATE) AND CAST(b.o_orderdate AS DATE) >= CAST(CAST(a.o_orderdate AS DATE) - INTERVAL 6 MONTH AS DATE)) GROUP BY 1",
    "ops_counters": f"SELECT status, count(*) AS jobs, count(*) FILTER (result = 'OK') AS ok, CAST(sum(retry_count) AS BIGINT) AS retries FROM ({_J}) GROUP BY 1",
    "hourly_latency": f"SELECT hour, count(*) AS jobs, count(*) FILTER (result = 'OK') AS ok, round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.95), 4) AS p95, round(quantile_cont(duration_ms, 0.99), 4) AS p99 FROM ({_J}) GROUP BY 1",
    "top_failed_rules": fx.duck(f"SELECT rule_id, count(*) AS n FROM ({_F}) GROUP BY 1 ORDER BY n DESC, rule_id LIMIT 5"),
    "review_rates": "SELECT lang, count(*) AS n, count(*) FILTER (n_chars >= 500 AND quality = 0) AS false_ok, count(*) FILTER (n_chars < 500 AND quality = 1) AS false_ng FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "drift_cube": "SELECT coalesce(event_type, 'all') AS event_type, coalesce(day, 'all') AS day, count(*) AS n, round(avg(value), 6) AS mean_value FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY CUBE (event_type, day)",
    "header_breakdown": f"SELECT o_custkey, count(*) FILTER (job_id % 5 <> 0 AND result = 'OK') AS main_ok, count(*) FILTER (job_id % 5 <> 0 AND result = 'NG') AS main_ng, count(*) FILTER (job_id % 5 = 0 AND result = 'OK') AS second_ok, count(*) FILTER (job_id % 5 = 0 AND result = 'NG') AS second_ng FROM ({_J}) GROUP BY 1",
    "stage_timings": f"SELECT stage, count(*) AS n, CAST(sum(ms) AS BIGINT) AS total_ms, max(ms) AS longest_ms FROM (SELECT 'render' AS stage, job_id % 300 AS ms FROM ({_J}) UNION ALL SELECT 'detect', job_id % 50 FROM ({_J}) UNION ALL SELECT 'ocr', 500 + job_id % 1500 FROM ({_J})) GROUP BY 1",
    "error_classes": f"SELECT ['INTERNAL_ERROR','TIMEOUT_ERROR','DOCUMENT_ERROR','VALIDATION_ERROR','DLQ_ERROR'][job_id % 5 + 1] AS return_code, job_id % 5 < 2 AS retryable, count(*) AS n FROM ({_J}) WHERE status = 'FAILED' GROUP BY 1, 2",
    "rule_impact": fx.duck(f"SELECT scenario, count(DISTINCT doc_id) FILTER (ignored IS NULL OR rule_id <> ignored) AS ng, (SELECT count(*) FROM fx_invoices) - count(DISTINCT doc_id) FILTER (ignored IS NULL OR rule_id <> ignored) AS ok FROM ({_F}), (VALUES ('base', NULL), ('no_stamp', 'INV-STAMP-R005'), ('no_amount_match', 'INV-R009')) s(scenario, ignored) GROUP BY 1"),
    "delivery_modes": "SELECT CASE WHEN b <= 2000 THEN 'INLINE' WHEN b <= 4000 THEN 'HYBRID' ELSE 'REFERENCE' END AS mode, count(*) AS n, CAST(max(b) AS INTEGER) AS largest FROM (SELECT strlen(text) AS b FROM documents) GROUP BY 1",
    "model_attach": fx.duck("SELECT object_type, CASE object_type WHEN 'signature' THEN 'v2' WHEN 'stamp' THEN 'v7' END AS version, count(*) AS n FROM fx_detections GROUP BY 1, 2"),
    "masked_extract": "SELECT doc_id, md5(substr(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '<email>', 'g'), '[0-9]{6,}', '<number>', 'g'), 1, 80)) AS extract_md5 FROM documents",
    "remark_priority": fx.duck(f"SELECT rule_id, count(*) AS n FROM (SELECT rule_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE rule_id WHEN 'INV-R002' THEN 1 WHEN 'INV-R001' THEN 2 WHEN 'INV-R009' THEN 3 WHEN 'INV-STAMP-R005' THEN 4 ELSE 99 END, o) AS k FROM ({_F})) WHERE k = 1 GROUP BY 1"),
    "audit_log": f"SELECT 'worker' AS actor, 'JOB_ACCEPTED' AS action, count(*) AS n FROM ({_J}) UNION ALL SELECT 'worker', 'JOB_' || status, count(*) FROM ({_J}) GROUP BY 2",
    "retention": f"SELECT count(*) AS n, min(event_id) AS first_id FROM ({_O}) WHERE status = 'DLQ' AND ts >= TIMESTAMP '2024-01-11'",
    "field_confidence_blend": f"SELECT job_id, round(CAST(job_id % 100 AS DOUBLE) * 0.45::DOUBLE + CAST(job_id % 90 AS DOUBLE) * 0.25::DOUBLE + CAST(job_id % 80 AS DOUBLE) * 0.2::DOUBLE + CAST(job_id % 70 AS DOUBLE) * 0.1::DOUBLE, 4) AS confidence FROM ({_J})",
    "largest_amount": fx.duck("SELECT doc_id, CAST(greatest(tax, total, discount) AS DOUBLE) AS amount FROM fx_invoices"),
}
