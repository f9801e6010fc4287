"""Queries over envelope headers, model quality by group, blended field confidences and retention."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ledgerlens.operators import monitoring as N
from ledgerlens.plans import fixtures as fx
from ledgerlens.plans import pipelines as pl
from ledgerlens.plans import verification as ver
from ledgerlens.sources import tables as TB

#: Causes of failures and the rules that stand for them.
CAUSES = {
    "missing_materai": "INV-R004", "invalid_stamp_colour": "DN-R003", "missing_vendor_stamp": "INV-STAMP-R005", "duplicate_document": None,
    "transaction_period": "INV-R011", "missing_signature": "INV-R006", "amount_mismatch": "INV-R009",
}
JOB_CHECKS = ["duplicate_document", "transaction_period"]
TODAY = datetime.date(2024, 3, 20)


def envelope_header(spark, sf):
    """Headers of customers' jobs: orders of the upper priorities are main invoices, the others delivery notes."""
    kinds = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderpriority")
    main = F.col("o_orderpriority") < "3"
    docs = ver._verdicts(spark, sf).select("doc_id", "o_custkey", "result").join(kinds, "doc_id").select(
        F.col("o_custkey").alias("job_id"), F.col("doc_id").alias("document_index"), F.concat(F.lit("DOC-"), "doc_id").alias("document_id"), F.concat("doc_id", F.lit(".pdf")).alias("document_name"),
        F.when(main, "INVOICE").otherwise("DELIVERY NOTE").alias("document_type"), F.when(main, "main").otherwise("second").alias("category"), "result",
    )
    cause = F.create_map(*[F.lit(x) for c, r in CAUSES.items() if r for x in (r, c)])
    failures = ver._failures(spark, sf).withColumn("cause", F.try_element_at(cause, "rule_id")).withColumnRenamed("doc_id", "document_index")
    out = N.envelope_header(docs, failures.join(docs.select("job_id", "document_index"), "document_index"), list(CAUSES), JOB_CHECKS)
    listed = F.array_join(F.transform("failed_documents", lambda d: F.concat(d["document_id"], F.lit("="), F.array_join(d["reason"], "/"))), ";")
    return out.withColumns({"validation_summary": F.to_json("validation_summary"), "failed_validation_summary": F.to_json("failed_validation_summary"), "failed_documents": listed})


def model_quality(spark, sf):
    """Model quality by region and priority: line items are fields, image detections stand for objects and barcodes, labels for reviews."""
    nation = fx.read(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("source"))
    vendor = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nation, "c_nationkey")
    kinds = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("document_type"))
    docs = ver._verdicts(spark, sf).select("doc_id", "o_custkey", "result", "confidence").join(vendor, "o_custkey").join(kinds, "doc_id")
    fields = fx.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") != "R", "FOUND").otherwise("NOT_FOUND").alias("status"))
    found = fx.detections(spark, sf)
    barcodes = found.filter("object_type = 'barcode'").select("doc_id", (F.col("confidence") >= 20).alias("decoded"))
    reviews = fx.read(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "OK").otherwise("NG").alias("truth"))
    return N.model_quality(docs, fields, found, barcodes, reviews, ["materai", "stamp", "signature"], ("source", "document_type"))


def blended_fields(spark, sf):
    """Line items of an order as candidates of three fields on pages of their ship mode's length; orders give the pages' text confidence."""
    i = fx.read(spark, sf, "lineitem")
    candidates = i.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2 + 1).alias("page_number"), F.concat(F.lit("field_"), "l_returnflag").alias("field_name"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("value"),
        (F.col("l_quantity") / 50).alias("pattern_confidence"), F.when(F.col("l_linestatus") == "F", F.col("l_discount") * 10).alias("layout_confidence"), (F.col("l_tax") > 0.03).alias("format_valid"),
    )
    pages = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit(0.9).alias("c")), F.struct(F.lit(2).alias("n"), F.when(F.col("o_orderstatus") != "P", 0.6).alias("c")))).alias("p")).select("doc_id", F.col("p.n").alias("page_number"), F.col("p.c").alias("average_confidence"))
    return N.blended_fields(candidates, pages)


def dead_letters_kept(spark, sf):
    """Error events as dead letters by date, each to be kept for 30 days and one more for each unit of its value, 90 at most; expired twice."""
    path = pl._place(spark, "dead_letters")
    letters = fx.read(spark, sf, "events").filter("event_type = 'error'").select("event_id", "user_id", "value", F.to_date("ts").alias("created_date"))
    TB.write_dates(letters, path, ["event_id"])
    for _ in range(2):
        TB.expire_rows(spark, path, TODAY, 30 + F.floor("value").cast("int"), ["event_id"])
    return spark.read.parquet(path).select("event_id", "user_id", F.col("created_date").cast("string").alias("created_date"))


QUERIES = {f.__name__: f for f in (envelope_header, model_quality, blended_fields, dead_letters_kept)}

_CAUSE = "CASE " + " ".join(f"WHEN id = '{r}' THEN '{c}'" for c, r in CAUSES.items() if r) + " END"
_COUNTS = " || ',' || ".join(f"'\"{c}\":' || coalesce(n_{c}, 0)" for c in CAUSES)

ORACLES = {
    "envelope_header": fx.duck(f"""SELECT * FROM (WITH fails AS (SELECT doc_id, r.id AS id, r.o AS o, r.n AS name FROM ({ver._RULES})),
docs AS (SELECT v.doc_id, v.job_id, v.result, o_orderpriority < '3' AS main, CASE WHEN o_orderpriority < '3' THEN 'invoice' ELSE 'delivery_note' END AS kind FROM ({ver._VERDICTS}) v JOIN orders ON o_orderkey = v.doc_id),
named AS (SELECT *, kind || CASE WHEN count(*) OVER k > 1 THEN '_' || row_number() OVER (PARTITION BY job_id, kind ORDER BY doc_id) ELSE '' END AS key FROM docs WINDOW k AS (PARTITION BY job_id, kind)),
told AS (SELECT n.*, reasons FROM named n LEFT JOIN (SELECT doc_id, list(name ORDER BY o) AS reasons FROM fails GROUP BY 1) f ON f.doc_id = n.doc_id),
counts AS (SELECT job_id, {", ".join(f"count(*) FILTER (cause = '{c}') AS n_{c}" for c in CAUSES)} FROM (SELECT job_id, {_CAUSE} AS cause FROM fails JOIN docs USING (doc_id)) GROUP BY 1),
jobs AS (SELECT job_id, count(*) AS total_documents, count(*) FILTER (result = 'OK') AS ok_documents, count(*) FILTER (result = 'NG') AS ng_documents, count(*) FILTER (main) AS main_document, count(*) FILTER (NOT main) AS second_document,
  count(*) FILTER (main AND result = 'OK') AS main_document_ok, count(*) FILTER (main AND result = 'NG') AS main_document_ng, count(*) FILTER (NOT main AND result = 'OK') AS second_document_ok, count(*) FILTER (NOT main AND result = 'NG') AS second_document_ng,
  string_agg('"' || key || '":"' || result || '"', ',' ORDER BY doc_id) AS own, coalesce(string_agg('DOC-' || doc_id || '=' || coalesce(array_to_string(reasons, '/'), ''), ';' ORDER BY doc_id) FILTER (result = 'NG'), '') AS failed_documents,
  coalesce(string_agg(' ' || key || ' failed' || coalesce(' because of: ' || array_to_string(reasons, ', '), '') || '.', '' ORDER BY doc_id) FILTER (result = 'NG'), '') AS why FROM told GROUP BY 1)
SELECT j.* EXCLUDE (own, why), '{{' || own || ',"duplicate_document":"' || CASE WHEN n_duplicate_document > 0 THEN 'NG' ELSE 'OK' END || '","transaction_period":"' || CASE WHEN n_transaction_period > 0 THEN 'NG' ELSE 'OK' END || '"}}' AS validation_summary,
  '{{' || {_COUNTS} || '}}' AS failed_validation_summary, CASE WHEN ng_documents > 0 THEN 'AI Verification completed with validation failures on ' || ng_documents || ' of ' || total_documents || ' submitted documents.' || why ELSE 'AI Verification completed. All ' || total_documents || ' submitted documents passed.' END AS ai_note
FROM jobs j LEFT JOIN counts c ON c.job_id = j.job_id)"""),
    "model_quality": fx.duck(f"""SELECT source, document_type, count(*) AS documents, round(avg(confidence), 6) AS mean_confidence, round(sum(found) / sum(fields), 6) AS field_success_rate, CAST(coalesce(sum(materai), 0) AS BIGINT) AS materai_count, CAST(coalesce(sum(stamp), 0) AS BIGINT) AS stamp_count, CAST(coalesce(sum(signature), 0) AS BIGINT) AS signature_count,
  round(sum(decoded) / sum(barcodes), 6) AS decoded_rate, count(truth) AS reviewed, round(count(*) FILTER (result = 'OK' AND truth = 'NG') / nullif(count(truth) FILTER (result = 'OK'), 0), 6) AS false_ok_rate, round(count(*) FILTER (result = 'NG' AND truth = 'OK') / nullif(count(truth) FILTER (result = 'NG'), 0), 6) AS false_ng_rate
  FROM (SELECT v.*, n_regionkey AS source, o_orderpriority AS document_type FROM ({ver._VERDICTS}) v JOIN orders ON o_orderkey = v.doc_id JOIN customer ON c_custkey = v.job_id JOIN nation ON n_nationkey = c_nationkey) d
  LEFT JOIN (SELECT l_orderkey, count(*) AS fields, count(*) FILTER (l_returnflag <> 'R') AS found FROM lineitem GROUP BY 1) f ON f.l_orderkey = d.doc_id
  LEFT JOIN (SELECT doc_id AS of, count(*) FILTER (object_type = 'materai') AS materai, count(*) FILTER (object_type = 'stamp') AS stamp, count(*) FILTER (object_type = 'signature') AS signature, nullif(count(*) FILTER (object_type = 'barcode'), 0) AS barcodes, CASE WHEN count(*) FILTER (object_type = 'barcode') > 0 THEN count(*) FILTER (object_type = 'barcode' AND confidence >= 20) END AS decoded FROM fx_detections GROUP BY 1) e ON e.of = d.doc_id
  LEFT JOIN (SELECT doc_id AS reviewed_id, min(CASE WHEN quality = 1 THEN 'OK' ELSE 'NG' END) AS truth FROM labels GROUP BY 1) r ON r.reviewed_id = d.doc_id GROUP BY 1, 2"""),
    "blended_fields": """SELECT doc_id, field_name, b.value AS value, CAST(b.page AS INTEGER) AS page_number, b.confidence AS confidence, n AS n_candidates FROM (SELECT doc_id, field_name, count(*) AS n, min({'k': -confidence, 'page': page, 'value': value, 'confidence': confidence}) AS b FROM (
  SELECT l_orderkey AS doc_id, 'field_' || l_returnflag AS field_name, l_linenumber % 2 + 1 AS page, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS value,
  round(coalesce(CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN o_orderkey IS NOT NULL THEN 0.9::DOUBLE END WHEN o_orderstatus <> 'P' THEN 0.6::DOUBLE END, 0) * 0.45::DOUBLE + l_quantity / 50 * 0.25::DOUBLE + coalesce(CASE WHEN l_linestatus = 'F' THEN l_discount * 10 END, 0) * 0.2::DOUBLE + CASE WHEN l_tax > 0.03::DOUBLE THEN 1 ELSE 0 END * 0.1::DOUBLE, 6) AS confidence
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1, 2)""",
    "dead_letters_kept": f"SELECT event_id, user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS created_date FROM events WHERE event_type = 'error' AND DATE '{TODAY}' - CAST(ts AS DATE) <= least(90, greatest(30, 30 + CAST(floor(value) AS INTEGER)))",
}
