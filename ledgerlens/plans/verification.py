"""Queries for rules, scores, verdicts, rollups and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import fixed_values as V
from ledgerlens.functions import measures as M
from ledgerlens.operators import evaluate as E
from ledgerlens.operators import verify as O
from ledgerlens.plans import fixtures as fx

CONFIG = {"stamp_duty_threshold": 250000.0, "amount_tolerance": 1000.0, "require_signature": True}


def _documents(spark, sf):
    """Invoices with the flags and the voucher data that rules look at."""
    k = F.col("doc_id")
    inv = fx.invoices(spark, sf)
    names = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("expected_vendor"))
    return inv.join(names, "o_custkey", "left").select(
        "doc_id",
        "o_custkey",
        F.when(k % 19 != 0, F.concat(F.lit("INV/"), k)).alias("invoice_number"),
        F.when(k % 3 != 0, "VERIFIED").otherwise("FALLBACK_UNVERIFIED").alias("verification_status"),
        F.when(k % 23 != 0, F.col("total").cast("double")).alias("amount"),
        F.lit(None).cast("string").alias("billing_number"),
        (k % 4 != 0).alias("has_stamp"),
        (k % 5 != 0).alias("has_signature"),
        (k % 6 == 0).alias("has_materai"),
        F.lit(False).alias("barcode_decoded"),
        F.when(k % 7 == 0, False).when(k % 7 == 1, F.lit(None).cast("boolean")).otherwise(True).alias("is_colored"),
        F.when(k % 9 == 4, F.col("o_totalprice")).otherwise(F.col("total").cast("double")).alias("expected_amount"),
        F.when(k % 8 == 0, "PT Other").otherwise(F.concat(F.lit("PT. "), "expected_vendor", F.lit(" Tbk"))).alias("vendor_name"),
        "expected_vendor",
        F.col("day").alias("document_date"),
        F.when(k % 5 == 2, F.to_date(F.lit("1998-03-15"))).otherwise(F.col("day")).alias("request_date"),
        F.when(k % 2 == 0, "REIMBURSEMENT_TOLL").otherwise("NORMAL").alias("transaction_type"),
    )


def _config(spark):
    return spark.range(1).select(*[F.lit(v).alias(c) for c, v in CONFIG.items()])


def _failures(spark, sf):
    return O.invoice_rule_failures(_documents(spark, sf), _config(spark))


def rule_failures(spark, sf):
    return _failures(spark, sf).select("doc_id", "rule_order", "rule_id", "rule_name", "message")


def rule_remarks(spark, sf):
    return O.remarks(_documents(spark, sf), _failures(spark, sf)).select("doc_id", "remark", "n_failed")


def document_summary(spark, sf):
    return O.remarks(_documents(spark, sf), _failures(spark, sf), first=3).select("doc_id", "reason", F.col("remark").alias("first_messages"))


def voucher_compare(spark, sf):
    """Amount differences between documents and vouchers beyond the tolerance."""
    d = _documents(spark, sf).filter(F.abs(F.col("expected_amount") - F.col("amount")) > CONFIG["amount_tolerance"])
    return d.select("doc_id", F.round(F.col("expected_amount") - F.col("amount"), 2).alias("difference"))


def period_rule(spark, sf):
    return _failures(spark, sf).filter("rule_id = 'INV-R011'").select("doc_id")


def note_rules(spark, sf):
    notes = O.note_counts(fx.detections(spark, sf)).withColumn("is_colored", F.col("doc_id") % 3 != 0)
    return O.note_rule_failures(notes).select("doc_id", "rule_id", "message")


def _verdicts(spark, sf):
    k = F.col("doc_id")
    docs = _documents(spark, sf).withColumn("confidence", F.round(F.lit(60.0) + k % 40, 2)).withColumn("processing_result", F.when(k % 29 == 0, "INTERNAL_ERROR").otherwise("SUCCESS"))
    return O.verdicts(docs, _failures(spark, sf), 70.0)


def job_rollup(spark, sf):
    """Verdicts of a customer's invoices as one job."""
    return O.job_rollup(_verdicts(spark, sf).withColumnRenamed("o_custkey", "job_id"))


def envelope_summary(spark, sf):
    return O.envelope_summary(_verdicts(spark, sf).withColumnRenamed("o_custkey", "job_id").withColumn("n_pages", F.col("doc_id") % 4 + 1))


def detections_per_type(spark, sf):
    return O.detections_per_type(fx.detections(spark, sf)).select("doc_id", "object_type", "confidence", "result")


def visual_verification(spark, sf):
    d = fx.detections(spark, sf)
    return O.visual_verification(d, d)


def note_counts(spark, sf):
    return O.note_counts(fx.detections(spark, sf))


def document_barcode(spark, sf):
    pages = fx.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number")).agg(F.max("l_partkey").alias("p"))
    pages = pages.select("doc_id", "page_number", (F.col("p") % 5 == 0).alias("barcode_decoded"), (F.col("p") % 2 == 0).alias("barcode_found"), F.col("p").cast("string").alias("barcode_value"))
    return O.document_barcode(pages)


def _scored(spark, sf):
    k = F.col("o_orderkey")
    unit = lambda m, base: F.when(k % m != 0, F.round(base + (k % 10) / 100, 2))
    docs = fx.read(spark, sf, "orders").select(
        k.alias("doc_id"), unit(5, F.lit(0.8)).alias("number_conf"), F.lit(None).cast("double").alias("billing_conf"), unit(7, F.lit(0.7)).alias("amount_conf"), unit(3, F.lit(0.85)).alias("date_conf"),
        F.lit(0.5).alias("average_conf"), (k % 11 != 0).alias("has_number"), F.lit(True).alias("has_amount"), (k % 4 != 0).alias("has_date"), F.when(k % 6 != 0, (k % 100).cast("double")).alias("detection_conf"),
        F.lit(None).cast("double").alias("barcode_conf"), F.when(k % 9 != 0, (k % 50 + 50).cast("double")).alias("quality"),
    )
    return O.confidence_score(docs)


def confidence_score(spark, sf):
    return _scored(spark, sf).select("doc_id", F.round("ocr_score", 4).alias("ocr_score"), F.round("field_score", 4).alias("field_score"), "confidence", "level")


def confidence_breakdown(spark, sf):
    """How many documents of each level, and the mean parts."""
    return _scored(spark, sf).groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("ocr_score"), 4).alias("ocr"), F.round(F.avg("field_score"), 4).alias("field"), F.min("confidence").alias("least"))


def document_text(spark, sf):
    """Conversation turns as pages of a document."""
    pages = fx.read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.col("text").alias("raw_text"))
    return O.document_text(pages).select("doc_id", F.md5("text").alias("text_md5"), "n_pages")


def document_colored(spark, sf):
    pages = fx.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 9 != 0).alias("is_colored"))
    return O.document_is_colored(pages)


def job_progress(spark, sf):
    e = fx.read(spark, sf, "events").select((F.col("user_id") % 50).alias("job_id"), F.lit(190).cast("long").alias("total"), (F.col("event_type") == "error").alias("failed"))
    return O.job_progress(e)


def partial_success(spark, sf):
    o = fx.read(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("doc_id"), "o_orderstatus")
    good = o.filter("o_orderstatus <> 'P'").select("job_id", "doc_id", F.lit("OK").alias("result"), F.lit("SUCCESS").alias("processing_result"), F.lit(90.0).alias("confidence"))
    bad = o.filter("o_orderstatus = 'P'").withColumn("message", F.lit("render failed"))
    return O.job_rollup(O.assemble_partial(good, bad))


def page_failures(spark, sf):
    p = fx.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number")).agg(F.min("l_suppkey").alias("s"))
    return O.page_failures(p.withColumn("error", F.when(F.col("s") % 7 == 0, F.concat(F.lit("page "), "page_number", F.lit(" failed")))))


def merge_page_text(spark, sf):
    """Whole texts as the native layer where they have several lines or over 500 characters, their capitals as the visual layer where they have a digit or are short."""
    n = F.length("text")
    p = fx.read(spark, sf, "documents").filter("text is not null").select("doc_id", F.lit(1).alias("page_number"), "text", n.alias("n"))
    native = p.filter(F.contains("text", F.lit("\n")) | (F.col("n") > 500)).select("doc_id", "page_number", F.col("text").alias("native_text"), (F.col("n") >= 300).alias("usable"))
    visual = p.filter(F.col("text").rlike("[0-9]") | (F.col("n") <= 500)).select("doc_id", "page_number", F.concat(F.lit("seen "), "text").alias("visual_text"), F.lit("nemotron").alias("engine"))
    return O.merge_page_text(native, visual).select("doc_id", "page_number", F.md5("text").alias("text_md5"), "engine_name")


def page_notes(spark, sf):
    d = fx.detections(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"))
    k = F.col("doc_id")
    docs = fx.read(spark, sf, "documents").select("doc_id", "text").join(d, "doc_id", "left")
    return docs.select("doc_id", O.page_note(F.when(k % 2 == 0, F.col("text")), F.coalesce("n", F.lit(0)), k % 3 == 0, k % 3 == 1, k % 5 != 0).alias("note"))


def page_renumber(spark, sf):
    """Page numbers within a document from batch-local ones: earlier batches' sizes are added."""
    from pyspark.sql import Window

    p = fx.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("batch")).groupBy("doc_id", "batch").agg(F.count("*").alias("pages"))
    w = Window.partitionBy("doc_id").orderBy("batch")
    return p.select("doc_id", "batch", "pages", (F.sum("pages").over(w) - F.col("pages") + 1).alias("first_page"))


def box_projection(spark, sf):
    d = fx.detections(spark, sf).select("det_id", F.transform("box", lambda v: F.floor(v * 1000).cast("long")).alias("pixel"))
    out = O.box_projection(d, F.lit(1240), F.lit(1754))
    return out.select("det_id", *[F.get("normalized", F.lit(i)).alias(f"n{i}") for i in range(4)])


def field_entries(spark, sf):
    f = fx.invoices(spark, sf).select("doc_id", F.col("total").cast("double").alias("value_num"), (F.col("doc_id") % 120).cast("double").alias("confidence"))
    return O.field_entries(f.withColumn("value_num", F.when(F.col("doc_id") % 2 == 0, F.col("value_num")))).select("doc_id", "data_type", "confidence")


def _truth(spark, sf):
    k = F.col("o_orderkey")
    o = fx.read(spark, sf, "orders")
    name = F.concat(F.lit("f"), k)
    number, amount, day = F.concat(F.lit("inv-"), k), F.format_number("o_totalprice", 2), F.date_format("o_orderdate", "yyyy-MM-dd")
    row = lambda f, v, c: F.struct(F.lit(f).alias("field"), v.alias("expected"), c.alias("expected_currency"))
    none = F.lit(None).cast("string")
    expected = o.select(name.alias("file_name"), F.explode(F.array(row("document_number", number, none), row("transaction_amount", amount, F.lit("IDR")), row("transaction_date", F.when(k % 5 != 0, day), none))).alias("r")).select("file_name", "r.*")
    got = lambda f, v, c, s: F.struct(F.lit(f).alias("field"), v.alias("actual"), c.alias("actual_currency"), s.alias("status"))
    found = F.lit("FOUND")
    wrong = lambda v: F.when(k % 11 == 0, none).when(k % 7 == 0, F.concat(v, F.lit("9"))).otherwise(v)
    actual = o.select(name.alias("file_name"), F.explode(F.array(got("document_number", wrong(F.upper(number)), none, found), got("transaction_amount", wrong(F.replace(amount, F.lit(","))), F.when(k % 13 == 0, "USD").otherwise("idr"), found), got("transaction_date", F.when(k % 10 != 0, day), none, F.when(k % 10 == 0, "NOT_FOUND").otherwise("FOUND")))).alias("r")).select("file_name", "r.*")
    return E.compare_fields(expected, actual)


def field_metrics(spark, sf):
    return E.field_metrics(_truth(spark, sf))


def mismatches(spark, sf):
    return _truth(spark, sf).filter("not match").groupBy("field", "reason").agg(F.count("*").alias("n"))


def field_gate(spark, sf):
    return E.field_gate(E.field_metrics(_truth(spark, sf)), V.CORE_FIELDS)


def throughput(spark, sf):
    k = F.col("o_orderkey")
    return E.throughput(fx.read(spark, sf, "orders").select((F.lit(1000) + k * 37 % 9000).alias("duration_ms"), (k % 4 + 1).alias("n_pages"), F.when(F.col("o_orderstatus") == "P", "failed").alias("error")))


def labelled_images(spark, sf):
    """Images with and without labels."""
    images, labels = fx.detections(spark, sf).select("doc_id").distinct(), fx.targets(spark, sf).filter("doc_id % 3 <> 0").select("doc_id").distinct()
    return images.join(labels, "doc_id", "left_semi").withColumn("state", F.lit("evaluated")).unionByName(images.join(labels, "doc_id", "left_anti").withColumn("state", F.lit("skipped"))).groupBy("state").agg(F.count("*").alias("n"))


def iou_matches(spark, sf):
    return E.match_detections(fx.detections(spark, sf), fx.targets(spark, sf)).select("det_id", "object_type", "hit")


def detection_ap50(spark, sf):
    t = fx.targets(spark, sf)
    return E.detection_metrics(E.match_detections(fx.detections(spark, sf), t), t)


def detection_gate(spark, sf):
    return E.detection_gate(detection_ap50(spark, sf), 0.2)


def class_map_check(spark, sf):
    required = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("signature", "stamp", "materai", "seal")])).alias("label"))
    return E.class_map_check(required, fx.detections(spark, sf).select(F.col("object_type").alias("label")).distinct())


def iou_pairs(spark, sf):
    """Overlaps of at least a half between detections and targets of one image and class."""
    d, t = fx.detections(spark, sf), fx.targets(spark, sf).withColumnRenamed("box", "t_box")
    return d.join(t, ["doc_id", "object_type"]).withColumn("iou", M.iou(F.col("box"), F.col("t_box"))).filter("iou >= 0.5").select("det_id", "target_id", F.round("iou", 6).alias("iou"))


_RULES = """SELECT doc_id, unnest(list_filter([
 CASE WHEN k19 THEN {'o': 1, 'id': 'INV-R001', 'n': 'Invoice number required', 'm': 'Invoice number not found.'} END,
 CASE WHEN NOT k19 AND doc_id % 3 = 0 THEN {'o': 2, 'id': 'INV-R012', 'n': 'Invoice number requires verified OCR evidence', 'm': 'Invoice number is a deterministic fallback and requires model verification.'} END,
 CASE WHEN amount IS NULL THEN {'o': 3, 'id': 'INV-R002', 'n': 'Amount required', 'm': 'Amount not found.'} END,
 CASE WHEN amount >= 250000 AND doc_id % 6 <> 0 THEN {'o': 5, 'id': 'INV-R004', 'n': 'Materai required above threshold', 'm': 'Above Rp. 5.000.000. Missing Stamp Duty.'} END,
 CASE WHEN doc_id % 4 = 0 THEN {'o': 6, 'id': 'INV-STAMP-R005', 'n': 'Company stamp required', 'm': 'Missing company stamp.'} END,
 CASE WHEN doc_id % 5 = 0 THEN {'o': 7, 'id': 'INV-R006', 'n': 'Signature required', 'm': 'Missing signature.'} END,
 CASE WHEN doc_id % 7 = 0 THEN {'o': 9, 'id': 'DOC-R001', 'n': 'Colored document required', 'm': 'Document is monochrome.'} END,
 CASE WHEN doc_id % 9 = 4 AND abs(o_totalprice - amount) > 1000 THEN {'o': 10, 'id': 'INV-R009', 'n': 'Amount must match PV amount', 'm': 'Document amount does not match PV amount.'} END,
 CASE WHEN doc_id % 8 = 0 THEN {'o': 11, 'id': 'INV-R010', 'n': 'Vendor must match PV vendor', 'm': 'Document vendor does not match PV vendor.'} END,
 CASE WHEN doc_id % 5 = 2 AND (day < CASE WHEN doc_id % 2 = 0 THEN DATE '1998-01-01' ELSE DATE '1997-09-01' END OR day > DATE '1998-03-15') THEN {'o': 12, 'id': 'INV-R011', 'n': 'Transaction date within permitted period', 'm': 'Document date is outside the permitted transaction period.'} END
 ], lambda x: x IS NOT NULL)) AS r FROM (SELECT *, doc_id % 19 = 0 AS k19, CASE WHEN doc_id % 23 <> 0 THEN CAST(total AS DOUBLE) END AS amount FROM fx_invoices)"""
_VERDICTS = f"""SELECT i.doc_id, o_custkey AS job_id, CAST(60 + i.doc_id % 40 AS DOUBLE) AS confidence, i.doc_id % 29 = 0 AS err, CASE WHEN f.doc_id IS NULL AND 60 + i.doc_id % 40 >= 70 THEN 'OK' ELSE 'NG' END AS result
 FROM fx_invoices i LEFT JOIN (SELECT DISTINCT doc_id FROM ({_RULES})) f ON f.doc_id = i.doc_id"""
_SCORED = """SELECT doc_id, ocr AS ocr_score, fld AS field_score, round(ocr * 0.3::DOUBLE + fld * 0.2::DOUBLE + coalesce(det, 0) * 0.3::DOUBLE + 100 * 0.1::DOUBLE + coalesce(q, 100) * 0.1::DOUBLE, 2) AS confidence FROM (
 SELECT doc_id, coalesce(list_avg([x FOR x IN [n, a, d] IF x IS NOT NULL]), 50.0) AS ocr, coalesce(list_avg([x FOR x IN [CASE WHEN doc_id % 11 <> 0 THEN coalesce(n, 50) END, coalesce(a, 50), CASE WHEN doc_id % 4 <> 0 THEN coalesce(d, 50) END] IF x IS NOT NULL]), 0) AS fld,
 CASE WHEN doc_id % 6 <> 0 THEN CAST(doc_id % 100 AS DOUBLE) END AS det, CASE WHEN doc_id % 9 <> 0 THEN CAST(doc_id % 50 + 50 AS DOUBLE) END AS q FROM (
 SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(80 + o_orderkey % 10 AS DOUBLE) END AS n, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(70 + o_orderkey % 10 AS DOUBLE) END AS a, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(85 + o_orderkey % 10 AS DOUBLE) END AS d FROM orders))"""
_LEVEL = "CASE WHEN confidence >= 95 THEN 'Very High' WHEN confidence >= 85 THEN 'High' WHEN confidence >= 60 THEN 'Medium' ELSE 'Low' END"
_TRUTH = """SELECT k, field, expected, actual, CASE WHEN expected IS NULL AND actual IS NULL THEN nf ELSE coalesce(upper(expected) = upper(actual), false) AND cur END AS match FROM (
 SELECT o_orderkey AS k, 'document_number' AS field, 'inv-' || o_orderkey AS expected, CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'INV-' || o_orderkey || '9' ELSE 'INV-' || o_orderkey END AS actual, false AS nf, true AS cur FROM orders
 UNION ALL SELECT o_orderkey, 'transaction_amount', CAST(o_totalprice AS VARCHAR), CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '-1' ELSE CAST(o_totalprice AS VARCHAR) END, false, o_orderkey % 13 <> 0 FROM orders
 UNION ALL SELECT o_orderkey, 'transaction_date', CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END, CASE WHEN o_orderkey % 10 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END, o_orderkey % 10 = 0, true FROM orders)"""
_METRICS = f"SELECT field, count(*) AS evaluated, count(*) FILTER (match) AS exact_matches FROM ({_TRUTH}) GROUP BY field"
_ROLL = "count(*) AS documents, count(*) FILTER (result = 'OK') AS ok, count(*) FILTER (result = 'NG') AS ng, count(*) FILTER (err) AS errors, min(confidence) AS confidence, CASE WHEN count(*) FILTER (result = 'OK') = count(*) AND count(*) FILTER (err) = 0 THEN 'OK' ELSE 'NG' END AS overall, CASE WHEN count(*) FILTER (err) = 0 THEN 'SUCCESS' ELSE 'PARTIAL_SUCCESS' END AS return_code"
_IOU = """SELECT det_id, target_id, i / (greatest(0, d.x2 - d.x1) * greatest(0, d.y2 - d.y1) + greatest(0, t.x2 - t.x1) * greatest(0, t.y2 - t.y1) - i) AS iou FROM (SELECT d.det_id, t.target_id, d, t,
 greatest(0, least(d.x2, t.x2) - greatest(d.x1, t.x1)) * greatest(0, least(d.y2, t.y2) - greatest(d.y1, t.y1)) AS i FROM fx_detections d JOIN fx_targets t ON d.doc_id = t.doc_id AND d.object_type = t.object_type)"""

QUERIES = {f.__name__: f for f in (
    rule_failures, rule_remarks, document_summary, voucher_compare, period_rule, note_rules, job_rollup, envelope_summary, detections_per_type, visual_verification, note_counts,
    document_barcode, confidence_score, confidence_breakdown, document_text, document_colored, job_progress, partial_success, page_failures, merge_page_text, page_notes, page_renumber,
    box_projection, field_entries, field_metrics, mismatches, field_gate, throughput, labelled_images, iou_matches, detection_ap50, detection_gate, class_map_check, iou_pairs,
)}

ORACLES = {
    "rule_failures": fx.duck(f"SELECT doc_id, CAST(r.o AS INTEGER) AS rule_order, r.id AS rule_id, r.n AS rule_name, r.m AS message FROM ({_RULES})"),
    "rule_remarks": fx.duck(f"SELECT i.doc_id, coalesce(remark, 'Verification passed.') AS remark, CAST(coalesce(n, 0) AS INTEGER) AS n_failed FROM fx_invoices i LEFT JOIN (SELECT doc_id, string_agg(r.m, '; ' ORDER BY r.o) AS remark, count(*) AS n FROM ({_RULES}) GROUP BY 1) f ON f.doc_id = i.doc_id"),
    "document_summary": fx.duck(f"SELECT i.doc_id, coalesce(reason, 'Verification passed.') AS reason, coalesce(m, 'Verification passed.') AS first_messages FROM fx_invoices i LEFT JOIN (SELECT doc_id, string_agg(r.n, '; ' ORDER BY r.o) AS reason, string_agg(r.m, '; ' ORDER BY r.o) AS m FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r.o) AS k FROM ({_RULES})) WHERE k <= 3 GROUP BY 1) f ON f.doc_id = i.doc_id"),
    "voucher_compare": fx.duck("SELECT doc_id, round(o_totalprice - CAST(total AS DOUBLE), 2) AS difference FROM fx_invoices WHERE doc_id % 23 <> 0 AND doc_id % 9 = 4 AND abs(o_totalprice - CAST(total AS DOUBLE)) > 1000"),
    "period_rule": fx.duck("SELECT doc_id FROM fx_invoices WHERE doc_id % 5 = 2 AND (day < CASE WHEN doc_id % 2 = 0 THEN DATE '1998-01-01' ELSE DATE '1997-09-01' END OR day > DATE '1998-03-15')"),
    "note_rules": fx.duck("""SELECT doc_id, unnest(list_filter([CASE WHEN s < 2 THEN 'DN-R001' END, CASE WHEN t < 2 THEN 'DN-R002' END, CASE WHEN doc_id % 3 = 0 THEN 'DOC-R001' END], lambda x: x IS NOT NULL)) AS rule_id,
 unnest(list_filter([CASE WHEN s < 2 THEN 'Required signature count is not met (' || s || '/2).' END, CASE WHEN t < 2 THEN 'Required company stamp count is not met (' || t || '/2).' END, CASE WHEN doc_id % 3 = 0 THEN 'Document is monochrome.' END], lambda x: x IS NOT NULL)) AS message
 FROM (SELECT doc_id, count(*) FILTER (confidence >= 25 AND object_type = 'signature') AS s, count(*) FILTER (confidence >= 25 AND object_type = 'stamp') AS t FROM fx_detections GROUP BY 1)"""),
    "job_rollup": fx.duck(f"SELECT job_id, {_ROLL} FROM ({_VERDICTS}) GROUP BY job_id"),
    "envelope_summary": fx.duck(f"SELECT job_id, count(*) AS total_documents, count(*) FILTER (result = 'OK') AS ok_documents, count(*) FILTER (result = 'NG') AS ng_documents, CAST(sum(doc_id % 4 + 1) AS BIGINT) AS total_pages, count(*) FILTER (result = 'OK') || ' OK, ' || count(*) FILTER (result = 'NG') || ' NG document(s)' AS note FROM ({_VERDICTS}) GROUP BY job_id"),
    "detections_per_type": fx.duck("SELECT doc_id, object_type, max(confidence) AS confidence, CASE WHEN bool_or(confidence >= 25) THEN 'OK' ELSE 'NG' END AS result FROM fx_detections GROUP BY 1, 2"),
    "visual_verification": fx.duck("SELECT d.doc_id, t AS object_type, CASE WHEN n > 0 THEN 'OK' ELSE 'NG' END AS result, coalesce(n, 0) AS count, round(CASE WHEN best > 1 THEN best / 100 ELSE best END, 4) AS confidence FROM (SELECT DISTINCT doc_id, unnest(['signature','stamp','materai']) AS t FROM (SELECT DISTINCT doc_id FROM fx_detections)) d LEFT JOIN (SELECT doc_id, object_type, count(*) AS n, max(confidence) AS best FROM fx_detections GROUP BY 1, 2) f ON f.doc_id = d.doc_id AND f.object_type = t"),
    "note_counts": fx.duck("SELECT doc_id, count(*) FILTER (confidence >= 25 AND object_type = 'signature') AS signatures, count(*) FILTER (confidence >= 25 AND object_type = 'stamp') AS stamps FROM fx_detections GROUP BY 1"),
    "document_barcode": "SELECT doc_id, CAST(p AS VARCHAR) AS barcode_value, p % 5 = 0 AS barcode_decoded, p % 2 = 0 AS barcode_found FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN p % 5 = 0 THEN 0 WHEN p % 2 = 0 THEN 1 ELSE 2 END, n) AS k FROM (SELECT l_orderkey AS doc_id, l_linenumber AS n, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2)) WHERE k = 1",
    "confidence_score": f"SELECT doc_id, round(ocr_score, 4) AS ocr_score, round(field_score, 4) AS field_score, confidence, {_LEVEL} AS level FROM ({_SCORED})",
    "confidence_breakdown": f"SELECT {_LEVEL} AS level, count(*) AS n, round(avg(ocr_score), 4) AS ocr, round(avg(field_score), 4) AS field, min(confidence) AS least FROM ({_SCORED}) GROUP BY 1",
    "document_text": "SELECT conv_id AS doc_id, md5(coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (trim(text) <> ''), '')) AS text_md5, count(*) AS n_pages FROM conversations GROUP BY 1",
    "document_colored": "SELECT l_orderkey AS doc_id, bool_and(l_partkey % 9 <> 0) AS is_colored FROM lineitem GROUP BY 1",
    "job_progress": "SELECT job_id, CAST(190 AS BIGINT) AS total, c AS completed, f AS failed, CASE WHEN c < 190 THEN 'RUNNING' WHEN f = 190 THEN 'FAILED' WHEN f > 0 THEN 'PARTIAL_SUCCESS' ELSE 'SUCCEEDED' END AS status FROM (SELECT user_id % 50 AS job_id, count(*) AS c, count(*) FILTER (event_type = 'error') AS f FROM events GROUP BY 1)",
    "partial_success": f"SELECT job_id, {_ROLL} FROM (SELECT o_custkey AS job_id, CASE WHEN o_orderstatus = 'P' THEN 'NG' ELSE 'OK' END AS result, o_orderstatus = 'P' AS err, CASE WHEN o_orderstatus <> 'P' THEN CAST(90 AS DOUBLE) END AS confidence FROM orders) GROUP BY job_id",
    "page_failures": "SELECT doc_id, CASE WHEN bool_or(s % 7 = 0) THEN 'FAILED' ELSE 'COMPLETED' END AS status, 'page ' || min(n) FILTER (s % 7 = 0) || ' failed' AS error, count(*) AS n_pages FROM (SELECT l_orderkey AS doc_id, l_linenumber AS n, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1",
    "merge_page_text": """SELECT doc_id, 1::INTEGER AS page_number, md5(CASE WHEN nat AND vis THEN t || chr(10) || v WHEN nat THEN t WHEN vis THEN v END) AS text_md5, CASE WHEN nat AND vis THEN 'pymupdf+nemotron' WHEN nat THEN 'pymupdf' WHEN vis THEN 'nemotron' END AS engine_name FROM (
 SELECT doc_id, text AS t, 'seen ' || text AS v, there AND length(text) >= 300 AS nat, regexp_matches(text, '[0-9]') OR length(text) <= 500 AS vis, there FROM (SELECT *, contains(text, chr(10)) OR length(text) > 500 AS there FROM documents WHERE text IS NOT NULL)) WHERE there OR vis""",
    "page_notes": fx.duck("SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 AND coalesce(text, '') <> '' THEN 'OCR text found' ELSE 'OCR text not found' END || '; ' || coalesce(n, 0) || ' detection(s); ' || CASE d.doc_id % 3 WHEN 0 THEN 'barcode decoded' WHEN 1 THEN 'barcode found' ELSE 'barcode not found' END || '; ' || CASE WHEN d.doc_id % 5 <> 0 THEN 'color evidence found' ELSE 'color evidence not found' END || '.' AS note FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM fx_detections GROUP BY 1) f ON f.doc_id = d.doc_id"),
    "page_renumber": "SELECT doc_id, batch, pages, CAST(sum(pages) OVER (PARTITION BY doc_id ORDER BY batch) - pages + 1 AS BIGINT) AS first_page FROM (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS batch, count(*) AS pages FROM lineitem GROUP BY 1, 2)",
    "box_projection": fx.duck("SELECT det_id, round(floor(x1 * 1000) / 1240, 6) AS n0, round(floor(y1 * 1000) / 1754, 6) AS n1, round(floor(x2 * 1000) / 1240, 6) AS n2, round(floor(y2 * 1000) / 1754, 6) AS n3 FROM fx_detections"),
    "field_entries": fx.duck("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'number' ELSE 'string' END AS data_type, round(CASE WHEN doc_id % 120 > 1 THEN (doc_id % 120) / 100.0::DOUBLE ELSE CAST(doc_id % 120 AS DOUBLE) END, 4) AS confidence FROM fx_invoices"),
    "field_metrics": f"SELECT *, round(CAST(exact_matches AS DOUBLE) / evaluated, 4) AS exact_match_rate FROM ({_METRICS})",
    "mismatches": f"SELECT field, CASE WHEN expected IS NULL AND actual IS NOT NULL THEN 'unexpected_prediction' WHEN expected IS NOT NULL AND actual IS NULL THEN 'missing_prediction' ELSE 'mismatched' END AS reason, count(*) AS n FROM ({_TRUTH}) WHERE NOT match GROUP BY 1, 2",
    "field_gate": f"SELECT count(*) FILTER (bad) = 0 AS passed, coalesce(string_agg(field, ',' ORDER BY field) FILTER (bad), '') AS failed_fields, CAST(0.85 AS DOUBLE) AS threshold FROM (SELECT field, CAST(exact_matches AS DOUBLE) / evaluated < 0.85 AS bad FROM ({_METRICS}))",
    "throughput": "SELECT count(*) AS files, round(sum(d) / 1000, 3) AS duration_seconds, round(count(*) / (sum(d) / 1000) * 3600, 2) AS documents_per_hour, round(sum(p) / (sum(d) / 1000) * 60, 2) AS pages_per_minute, count(*) FILTER (o_orderstatus = 'P') AS failed_documents FROM (SELECT CAST(1000 + o_orderkey * 37 % 9000 AS DOUBLE) AS d, o_orderkey % 4 + 1 AS p, o_orderstatus FROM orders)",
    "labelled_images": fx.duck("SELECT CASE WHEN t.doc_id IS NULL THEN 'skipped' ELSE 'evaluated' END AS state, count(*) AS n FROM (SELECT DISTINCT doc_id FROM fx_detections) d LEFT JOIN (SELECT DISTINCT doc_id FROM fx_targets WHERE doc_id % 3 <> 0) t ON t.doc_id = d.doc_id GROUP BY 1"),
    "class_map_check": fx.duck("SELECT label, count(o) AS n FROM (SELECT unnest(['signature','stamp','materai','seal']) AS label) LEFT JOIN (SELECT DISTINCT object_type AS o FROM fx_detections) ON o = label GROUP BY 1 HAVING count(o) <> 1"),
    "iou_pairs": fx.duck(f"SELECT det_id, target_id, round(iou, 6) AS iou FROM ({_IOU}) WHERE iou >= 0.5"),
}
