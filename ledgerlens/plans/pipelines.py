"""Queries that write tables, files or streams, and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions import measures as M
from ledgerlens.operators import ops as P
from ledgerlens.plans import fixtures as fx
from ledgerlens.plans import operations as op
from ledgerlens.sources import files as S
from ledgerlens.sources import tables as TB
from ledgerlens.storage import shared_dir
from ledgerlens.streaming import intake, retry_timers


def _place(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _year(column):
    return F.trunc(column, "year")


def _job_changes(spark, sf):
    """Each line item of an order from 1997 on changes its job: open lines state no status, N flags no result, R flags a failure."""
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_partkey", "l_extendedprice")
    late = fx.read(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz '1997-01-01'").select(F.col("o_orderkey").alias("l_orderkey"))
    return fx.read(spark, sf, "lineitem").join(late, "l_orderkey").select(
        F.row_number().over(order).cast("long").alias("change_no"),
        F.col("l_orderkey").alias("job_id"),
        F.when(F.col("l_linestatus") == "F", F.when(F.col("l_returnflag") == "R", "FAILED").otherwise("COMPLETED")).alias("status"),
        F.when(F.col("l_returnflag") == "A", "OK").when(F.col("l_returnflag") == "R", "NG").alias("result"),
        F.when(F.col("l_linestatus") == "F", F.to_date("l_shipdate")).alias("finished_at"),
        (F.col("l_returnflag") == "R").alias("failed"),
    )


def jobs_updated(spark, sf):
    """The job table after two rounds of changes, the first of which runs a second time at the end."""
    path = _place(spark, "jobs")
    jobs = fx.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.lit("PROCESSING").alias("status"), F.lit(None).cast("string").alias("result"), F.lit(None).cast("date").alias("finished_at"),
        F.lit(0).cast("long").alias("retry_count"), F.lit(0).cast("long").alias("last_change"), _year("o_orderdate").alias("created_date"),
    )
    TB.write_dates(jobs, path, ["job_id"])
    changes = _job_changes(spark, sf)
    early, late = changes.filter("change_no <= 2"), changes.filter("change_no > 2")
    for changed in (early, late, early):
        TB.update_job_table(spark, path, changed)
    return spark.read.parquet(path).select("job_id", "status", "result", F.col("finished_at").cast("string").alias("finished_at"), "retry_count", "last_change")


def results_upserted(spark, sf):
    """Final rows by date: later orders of a customer and year replace earlier ones; written twice, with the same outcome."""
    path = _place(spark, "results")
    orders = fx.read(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("amount"), _year("o_orderdate").alias("created_date"))
    first = orders.groupBy("job_id", "created_date").agg(F.min(F.struct("day", "doc_id", "amount")).alias("r")).select("job_id", "r.*", "created_date")
    S.write_results({"final": first.filter("created_date < '1999-01-01'")}, path)
    for _ in range(2):
        TB.upsert_rows(spark, f"{path}/final", orders.filter("created_date >= '1997-01-01'"), ["job_id"])
    return spark.read.parquet(f"{path}/final").select("job_id", F.year("created_date").alias("year"), "doc_id", F.round("amount", 2).alias("amount"))


def envelope_files(spark, sf):
    """One envelope a customer with its orders, written and read back."""
    path = _place(spark, "envelopes")
    orders = fx.read(spark, sf, "orders")
    docs = orders.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("document_index"), F.concat(F.lit("INV/"), "o_orderkey").alias("document_number"), F.col("o_totalprice").alias("amount"))
    jobs = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), "c_name")
    S.write_envelopes(jobs, docs, path)
    back = spark.read.schema("schema_version string, summary struct<job_id:long,c_name:string>, documents array<struct<document_index:long,document_number:string,amount:double>>").json(path)
    numbers = F.array_join(F.transform("documents", lambda d: d["document_number"]), ",")
    return back.select("summary.*", F.size("documents").alias("n_documents"), F.md5(numbers).alias("numbers_md5"), F.round(F.aggregate("documents", F.lit(0.0), lambda a, d: a + d["amount"]), 2).alias("amount"))


def truth_load(spark, sf):
    """Labels as JSON lines: nested or flat, values or objects, under each of three names; a second file corrects some."""
    path = _place(spark, "truth")
    o = fx.read(spark, sf, "orders")
    name, amount = F.concat(F.lit("f"), "o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    target = F.when(F.col("o_orderpriority") < "3", F.concat(F.lit('{"value":'), amount, F.lit(',"currency":"IDR"}'))).otherwise(quoted(amount.cast("string")))
    day = F.when(F.col("o_orderstatus") == "P", F.lit("null")).otherwise(quoted(F.date_format("o_orderdate", "yyyy-MM-dd")))
    fields = F.concat(F.lit('"transaction_amount":'), target, F.lit(',"transaction_date":'), day)
    key = F.when(F.col("o_orderpriority") < "2", "file_name").when(F.col("o_orderpriority") < "3", "file").otherwise("document_name")
    line = F.concat(F.lit("{"), quoted(key), F.lit(":"), quoted(name), F.lit(","), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit('"fields":{'), fields, F.lit("}"))).otherwise(fields), F.lit("}"))
    o.select(line.alias("value")).write.text(f"{path}/part=1")
    o.filter("o_totalprice < 50000").select(F.concat(F.lit('{"file_name":'), quoted(name), F.lit(',"document_number":"N-'), "o_custkey", F.lit('"}'))).write.text(f"{path}/part=2")
    return S.truth_rows(spark, path)


def audit_appended(spark, sf):
    """Audit rows of two runs, appended and read back."""
    path = _place(spark, "audit")
    jobs = op._jobs(spark, sf).select("job_id", "status", "result", F.lit("worker").alias("actor"), F.col("finished_at").alias("at"))
    none = F.struct(F.lit(None).cast("string").alias("status"))
    S.append_audit(jobs.withColumn("action", F.lit("JOB_ACCEPTED")).withColumn("before", none).withColumn("after", F.struct(F.lit("PENDING").alias("status"))), path)
    S.append_audit(jobs.withColumn("action", F.concat(F.lit("JOB_"), "status")).withColumn("before", F.struct(F.lit("PENDING").alias("status"))).withColumn("after", F.struct("status", "result")), path)
    return spark.read.parquet(path).select("job_id", "actor", "action", "before", "after")


def stream_intake(spark, sf):
    """Raw messages taken in by a stream that is stopped and started again: messages sent twice count once, broken ones are kept apart."""
    source, out = _place(spark, "messages"), _place(spark, "intake")
    sent = op._messages(spark, sf)
    sent.filter("k % 2 = 0").select("value").write.text(f"{source}/run=1")
    intake.run_intake(spark, f"{source}/run=*", out)
    sent.filter("k % 2 = 1 or k % 5 = 0").select("value").write.text(f"{source}/run=2")
    intake.run_intake(spark, f"{source}/run=*", out)
    good = spark.read.parquet(f"{out}/requests").select("source_system", "message_id", F.lit("request").alias("kind"))
    bad = spark.read.parquet(f"{out}/rejects").select(F.lit(None).cast("string").alias("source_system"), F.col("value").alias("message_id"), F.lit("reject").alias("kind"))
    return good.unionByName(bad)


def stream_retries(spark, sf):
    """Errors of users as failed jobs: retries when they fall due, dead letters from the fifth on. Other events only move time on."""
    out = _place(spark, "retries")
    events = fx.read(spark, sf, "events")
    read = spark.readStream.schema(events.schema).parquet(f"{sf}/event[s].parquet")
    timed = read.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 seconds")
    failures = retry_timers.only(timed, F.col("event_type") == "error", "ts").select(F.col("user_id").alias("job_id"), F.unix_millis("ts").alias("at_ms"), "ts")
    key, store = retry_timers.STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        query = retry_timers.due_retries(failures).writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(retry_timers.OUTPUT).parquet(f"{out}/rows")


def duplicate_report(spark, sf):
    """Orders of one priority, customer and price class as invoices of equal number; every priority named high has no PV."""
    o = fx.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderpriority") != "2-HIGH", F.concat(F.lit("PV"), "o_orderkey")).alias("pv_no"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("number"),
        F.col("o_custkey").alias("vendor"), F.floor(F.col("o_totalprice") / 50000).cast("long").alias("amount"), F.to_date("o_orderdate").alias("day"),
    )
    return P.duplicate_report(o).select("doc_id", "result", "matched_id", "matched_pv", F.col("matched_day").cast("string").alias("matched_day"), "reason")


def job_children(spark, sf):
    """Jobs with four kinds of children."""
    jobs = op._jobs(spark, sf)
    items = fx.read(spark, sf, "lineitem")
    finals = items.select(F.col("l_orderkey").alias("job_id"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("result"), F.struct("l_shipdate", "l_partkey", "l_extendedprice").alias("finished_at"))
    ocr = items.select(F.col("l_orderkey").alias("job_id"), F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("confidence"))
    found = fx.detections(spark, sf).select(F.col("doc_id").alias("job_id"), "confidence")
    audit = jobs.select("job_id", F.explode(F.array(F.struct(F.lit("JOB_ACCEPTED").alias("action"), F.lit(1).alias("at")), F.struct(F.concat(F.lit("JOB_"), "status").alias("action"), F.lit(2).alias("at")))).alias("a")).select("job_id", "a.*")
    return P.job_children(jobs.select("job_id", "status"), finals, ocr, found, audit)


def queue_depth(spark, sf):
    """Waiting orders by hour: they come with their order and go with their first shipment."""
    gone = fx.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("finished_at"))
    jobs = fx.read(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at")).join(gone, "o_orderkey", "left")
    return P.queue_depth(jobs).select(F.date_format("hour", "yyyy-MM-dd HH").alias("hour"), "came", "went", "depth")


def message_counters(spark, sf):
    """Events as messages of their type and user."""
    e = fx.read(spark, sf, "events")
    code = F.when(F.col("value") < 5, "INTERNAL_ERROR").when(F.col("value") < 10, "PARTIAL_SUCCESS").otherwise("SUCCESS")
    return P.message_counters(e.select(F.col("event_type").alias("source_system"), F.col("user_id").alias("message_id"), code.alias("return_code"), F.struct("ts", "event_id").alias("at"), F.floor(F.col("value") / 10).cast("long").alias("attempts")))


def quad_boxes(spark, sf):
    """Boxes of detections given as corners in turn."""
    b = lambda i: F.get("box", F.lit(i))
    quad = F.array(F.array(b(2), b(1)), F.array(b(2), b(3)), F.array(b(0), b(3)), F.array(b(0), b(1)))
    return fx.detections(spark, sf).select("det_id", M.quad_box(quad).alias("q")).select("det_id", *[F.round(F.get("q", F.lit(i)), 6).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


QUERIES = {f.__name__: f for f in (jobs_updated, results_upserted, envelope_files, truth_load, audit_appended, stream_intake, stream_retries, duplicate_report, job_children, quad_boxes, queue_depth, message_counters)}

ORACLES = {
    "jobs_updated": """WITH changes AS (SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_extendedprice) AS no,
  CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'COMPLETED' END END AS status, CASE l_returnflag WHEN 'A' THEN 'OK' WHEN 'R' THEN 'NG' END AS result,
  CASE WHEN l_linestatus = 'F' THEN CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS finished_at, l_returnflag = 'R' AS failed FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderdate >= TIMESTAMP '1997-01-01')
SELECT o_orderkey AS job_id, coalesce(arg_max(status, no) FILTER (status IS NOT NULL), 'PROCESSING') AS status, arg_max(result, no) FILTER (result IS NOT NULL) AS result,
  arg_max(finished_at, no) FILTER (finished_at IS NOT NULL) AS finished_at, count(*) FILTER (failed) AS retry_count, coalesce(max(no), 0) AS last_change FROM orders LEFT JOIN changes ON job_id = o_orderkey GROUP BY o_orderkey""",
    "results_upserted": """SELECT job_id, year, CASE WHEN year >= 1997 THEN late.doc_id ELSE early.doc_id END AS doc_id, round(CASE WHEN year >= 1997 THEN late.amount ELSE early.amount END, 2) AS amount FROM (
  SELECT o_custkey AS job_id, year(o_orderdate) AS year, min({'day': CAST(o_orderdate AS DATE), 'doc_id': o_orderkey, 'amount': o_totalprice}) AS early, max({'day': CAST(o_orderdate AS DATE), 'doc_id': o_orderkey, 'amount': o_totalprice}) AS late FROM orders GROUP BY ALL)""",
    "envelope_files": """SELECT c_custkey AS job_id, c_name, CAST(count(o_orderkey) AS INTEGER) AS n_documents, md5(coalesce(string_agg('INV/' || o_orderkey, ',' ORDER BY o_orderkey), '')) AS numbers_md5, round(coalesce(sum(o_totalprice), 0), 2) AS amount
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
    "truth_load": """SELECT 'f' || o_orderkey AS file_name, 'transaction_amount' AS field, CASE WHEN o_orderpriority < '3' THEN CAST(o_totalprice AS VARCHAR) ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS expected, CASE WHEN o_orderpriority < '3' THEN 'IDR' END AS expected_currency FROM orders WHERE o_totalprice >= 50000
  UNION ALL SELECT 'f' || o_orderkey, 'transaction_date', CASE WHEN o_orderstatus <> 'P' THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END, NULL FROM orders WHERE o_totalprice >= 50000
  UNION ALL SELECT 'f' || o_orderkey, 'document_number', 'N-' || o_custkey, NULL FROM orders WHERE o_totalprice < 50000""",
    "audit_appended": f"""SELECT job_id, 'worker' AS actor, 'JOB_ACCEPTED' AS action, '{{}}' AS before, '{{"status":"PENDING"}}' AS after FROM ({op._J})
  UNION ALL SELECT job_id, 'worker', 'JOB_' || status, '{{"status":"PENDING"}}', '{{"status":"' || status || '","result":"' || result || '"}}' FROM ({op._J})""",
    "stream_intake": f"""SELECT 'ELVIS' AS source_system, 'MSG-Q' || k AS message_id, 'request' AS kind FROM ({op._M}) WHERE k % 3 = 0 UNION ALL SELECT 'VISION', 'MSG-L' || k, 'request' FROM ({op._M}) WHERE k % 3 = 1
  UNION ALL SELECT NULL, '{{"queue_no": ' || k, 'reject' FROM ({op._M}), range(1, 3) r(run) WHERE k % 3 = 2 AND (run = 1 AND k % 2 = 0 OR run = 2 AND (k % 2 = 1 OR k % 5 = 0))""",
    "stream_retries": """SELECT user_id AS job_id, CAST(n AS INTEGER) AS attempt, CASE WHEN n >= 5 THEN 'DLQ' ELSE 'RETRY' END AS status, CAST(CASE WHEN n >= 5 THEN ms ELSE ms + 30000 * power(2, n - 1) END AS BIGINT) AS due_ms FROM (
  SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE event_type = 'error') WHERE n >= 5 OR ms + 30000 * power(2, n - 1) < (SELECT epoch_us(max(ts)) // 1000 FROM events)""",
    "duplicate_report": """WITH i AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderpriority <> '2-HIGH' THEN 'PV' || o_orderkey END AS pv, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS number, o_custkey AS vendor, floor(o_totalprice / 50000) AS amount, CAST(o_orderdate AS DATE) AS day FROM orders),
m AS (SELECT a.doc_id, arg_max(b.doc_id, (b.day, b.doc_id)) AS matched_id, arg_max(coalesce(b.pv, ''), (b.day, b.doc_id)) AS pv, max(b.day) AS matched_day FROM i a JOIN i b USING (number, vendor, amount) WHERE b.day < a.day AND b.day >= CAST(a.day - INTERVAL 6 MONTH AS DATE) GROUP BY 1)
SELECT i.doc_id, CASE WHEN matched_id IS NOT NULL THEN 'DUPLICATE' WHEN number IS NOT NULL THEN 'UNIQUE' ELSE 'NOT_APPLICABLE' END AS result, matched_id, nullif(m.pv, '') AS matched_pv, CAST(matched_day AS VARCHAR) AS matched_day,
  CASE WHEN matched_id IS NOT NULL THEN 'Same number, vendor and amount as ' || coalesce(nullif(m.pv, ''), 'a document without PV') || ' of ' || matched_day || '.' WHEN number IS NOT NULL THEN 'No equal invoice within 6 months.' ELSE 'Number, vendor, amount or date is missing.' END AS reason FROM i LEFT JOIN m ON m.doc_id = i.doc_id""",
    "job_children": fx.duck(f"""SELECT j.job_id, status, final_result, coalesce(n_pages, 0) AS n_pages, mean_confidence, coalesce(n_detections, 0) AS n_detections, best, CAST(2 AS BIGINT) AS n_audit, 'JOB_' || status AS last_action FROM ({op._J}) j
  LEFT JOIN (SELECT l_orderkey, arg_max(l_returnflag || '-' || l_linestatus, (l_shipdate, l_partkey, l_extendedprice)) AS final_result, count(*) AS n_pages, round(avg(CASE WHEN l_tax > 0 THEN l_quantity END), 4) AS mean_confidence FROM lineitem GROUP BY 1) l ON l_orderkey = j.job_id
  LEFT JOIN (SELECT doc_id, count(*) AS n_detections, max(confidence) AS best FROM fx_detections GROUP BY 1) d ON d.doc_id = j.job_id"""),
    "quad_boxes": fx.duck("SELECT det_id, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM fx_detections"),
    "queue_depth": """WITH moves AS (SELECT o_orderdate AS moment, 1 AS step FROM orders UNION ALL SELECT min(l_shipdate), -1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey),
hours AS (SELECT date_trunc('hour', moment) AS h, count(*) FILTER (step = 1) AS came, count(*) FILTER (step = -1) AS went FROM moves GROUP BY 1)
SELECT strftime(h, '%Y-%m-%d %H') AS hour, came, went, CAST(sum(came - went) OVER (ORDER BY h) AS BIGINT) AS depth FROM hours""",
    "message_counters": """WITH each AS (SELECT event_type AS source_system, user_id, count(*) AS arrivals, arg_max(CASE WHEN value < 5 THEN 'INTERNAL_ERROR' WHEN value < 10 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END, (ts, event_id)) AS return_code, max(CAST(floor(value / 10) AS BIGINT)) AS attempts FROM events GROUP BY ALL)
SELECT source_system, return_code, count(*) AS messages, CAST(sum(arrivals - 1) AS BIGINT) AS duplicates, CAST(sum(attempts) AS BIGINT) AS retries, count(*) FILTER (attempts >= 5) AS given_up FROM each GROUP BY ALL""",
}
