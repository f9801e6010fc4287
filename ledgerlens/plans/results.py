"""Queries over document texts with tokens, result envelopes, confidence components, validation counts, drift and thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import results as R
from ledgerlens.operators import verify as O
from ledgerlens.plans import evaluation as ev
from ledgerlens.plans import fixtures as fx
from ledgerlens.plans import verification as ver


def _turns(spark, sf):
    """Conversation turns as pages: their words are tokens, users' pages have no confidence, texts without a full stop an error."""
    t = fx.read(spark, sf, "conversations")
    return t.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), F.col("text").alias("raw_text"), F.split("text", " ").alias("tokens"),
        F.when(F.col("role") != "user", (F.length("text") % 100) / 100).alias("average_confidence"), F.when(~F.contains("text", F.lit(".")), F.concat(F.lit("page "), "turn")).alias("error"),
    )


def document_tokens(spark, sf):
    """Text, tokens numbered through, mean confidence and first error of conversations."""
    out = R.document_ocr(_turns(spark, sf))
    words = F.array_join(F.transform("tokens", lambda t: F.concat_ws("/", t["page_number"], t["reading_order"], t["token"])), " ")
    return out.select("doc_id", F.md5("text").alias("text_md5"), F.md5(words).alias("tokens_md5"), F.size("tokens").alias("n_tokens"), "average_confidence", "error", "n_pages")


def merged_tokens(spark, sf):
    """Tokens of both layers: a native layer where texts have several lines, a visual one where they have digits."""
    d = fx.read(spark, sf, "documents").filter("text is not null").select("doc_id", F.lit(1).alias("page_number"), "text")
    native = d.filter(F.contains("text", F.lit("\n"))).select("doc_id", "page_number", F.split("text", " ").alias("native_tokens"), (F.length("text") >= 300).alias("usable"))
    visual = d.filter(F.col("text").rlike("[0-9]")).select("doc_id", "page_number", F.split("text", "\n").alias("visual_tokens"), F.lit(0.75).alias("average_confidence"))
    return R.merge_page_tokens(native, visual).select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", "|")).alias("tokens_md5"), "average_confidence")


def document_names(spark, sf):
    """Orders as results of their customer's job; requests name those in a later status, some by an empty name."""
    o = fx.read(spark, sf, "orders")
    results = o.select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").cast("int").alias("document_index"), F.when(F.col("o_orderpriority") < "3", F.concat(F.lit("EXT-"), "o_orderkey")).when(F.col("o_orderpriority") < "4", "").alias("external_document_id"))
    requested = o.filter("o_orderstatus <> 'F'").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").cast("int").alias("document_index"), F.when(F.col("o_orderstatus") == "O", F.concat("o_orderkey", F.lit(".pdf"))).otherwise("").alias("file_name"))
    return R.attach_request(results, requested).select("job_id", "document_index", "document_id", "document_name")


def _envelopes(spark, sf):
    """One envelope a customer with its orders as documents and their line items as pages."""
    page = F.struct(
        F.col("rank").alias("page_number"), F.when(F.col("l_linestatus") == "F", "COMPLETED").alias("processing_status"),
        F.struct(F.when(F.col("l_returnflag") == "A", "SUCCESS").otherwise("FAILED").alias("status"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("part "), "l_partkey")).alias("raw_text"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity") + 0.5).alias("average_confidence")).alias("ocr"),
        F.when(F.col("l_tax") > 0.05, F.array(F.struct(F.lit("stamp").alias("label"), F.col("l_discount").alias("confidence")))).alias("detections"),
    )
    docs = ev._items(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.first("o_totalprice").alias("price"), F.first("o_orderstatus").alias("state"))
    owner = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("job_id"))
    one = F.struct(
        "l_orderkey", F.concat(F.lit("Scan"), "l_orderkey", F.lit(".PDF")).alias("document_name"), F.when(F.col("state") != "P", F.struct(F.col("price").cast("long").alias("file_size_bytes"))).alias("file_information"),
        F.when(F.col("state") == "F", "FAILED").when(F.col("state") == "O", "COMPLETED").alias("processing_status"), F.when(F.col("state") == "O", F.struct(F.lit(87.5).alias("total"))).alias("confidence"), "pages",
    )
    return docs.join(owner, "l_orderkey").groupBy("job_id").agg(F.array_sort(F.collect_list(one)).alias("documents"))


def display_documents(spark, sf):
    envelopes = _envelopes(spark, sf).select("job_id", F.to_json(F.struct("documents", F.struct((F.col("job_id") % 1000).alias("duration_ms")).alias("processing"))).alias("envelope"))
    return R.display_documents(envelopes).drop("pages")


def display_pages(spark, sf):
    envelopes = _envelopes(spark, sf).select("job_id", F.to_json(F.struct("documents")).alias("envelope"))
    shown = R.display_pages(R.display_documents(envelopes))
    return shown.select("job_id", "document_index", "page_number", "status", "ocr_status", "raw_text", "avg_confidence", F.size("detections").alias("n_detections"), F.round(F.get("detections", F.lit(0))["confidence"], 4).alias("first_confidence"))


def job_results(spark, sf):
    """Looked-up results; those of building and household customers have their pages at the root."""
    legacy = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD").alias("legacy"))
    body = lambda *c: F.to_json(F.struct(*c))
    root = F.flatten(F.transform("documents", lambda d: d["pages"])).alias("pages")
    finals = _envelopes(spark, sf).join(legacy, "job_id").select(F.concat(F.lit("Q"), "job_id").alias("queue_id"), F.when(F.col("legacy"), body(root)).otherwise(body("documents", F.struct(F.size("documents").alias("n")).alias("summary"))).alias("internal_result_json"))
    return R.job_result(finals).select("queue_id", F.size("pages").alias("n_pages"), F.size("documents").alias("n_documents"), "summary")


def confidence_components(spark, sf):
    """Display components of orders, with image detections of equal number."""
    o = fx.read(spark, sf, "orders")
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    docs = o.select(
        F.col("o_orderkey").alias("doc_id"), F.when(level > 1, F.round(F.col("o_totalprice") / 10000, 1)).alias("number_conf"), F.when(F.col("o_orderstatus") != "P", F.lit(80.0)).alias("amount_conf"), F.lit(None).cast("double").alias("billing_conf"),
        (level > 1).alias("has_number"), (F.col("o_orderstatus") != "P").alias("has_amount"), (F.col("o_orderstatus") == "F").alias("barcode_decoded"), (F.col("o_orderstatus") == "O").alias("barcode_found"),
        *[F.when(level == i, F.lit(10.0 * i)).alias(c) for i, c in enumerate(("resolution_score", "blur_score", "brightness_score", "page_readability_score"), 1)],
    )
    coarse = fx.detections(spark, sf).withColumn("confidence", F.floor(F.col("confidence") / 8) * 8.0)  # means of these are never halfway between cents
    return R.confidence_components(docs, coarse)


def validation_counts(spark, sf):
    """Rules that applied to each invoice, passed and failed, with the failed ones' names and advice."""
    docs = ver._documents(spark, sf)
    advice = {"INV-R004": "Upload an invoice with a valid Materai.", "INV-R006": "Ensure the vendor signature is clearly visible.", "INV-R011": "Verify the reimbursement transaction date."}
    checked = F.lit(8) + F.col("is_colored").isNotNull().cast("int") + F.col("request_date").isNotNull().cast("int")
    out = R.validation_counts(docs, ver._failures(spark, sf), checked, advice)
    return out.select("doc_id", "passed_validation", "failed_validation", F.array_join("failed_items", "; ").alias("failed_items"), F.coalesce(F.array_join("recommendation", " "), F.lit("")).alias("recommendation"))


def drift(spark, sf):
    """Share of finished orders by vendor nation, priority and month, each against the month before of the same set."""
    nation = fx.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("vendor"))
    o = fx.read(spark, sf, "orders").join(nation, "o_custkey").withColumnRenamed("o_orderpriority", "document_type").join(fx.read(spark, sf, "nation").select(F.col("n_nationkey").alias("vendor"), F.col("n_regionkey").alias("source")), "vendor")
    return R.drift(o, F.date_format("o_orderdate", "yyyy-MM"), ("vendor", "document_type", "source"), F.col("o_orderstatus") == "F")


def threshold_impact(spark, sf):
    """Verdicts under a thousand stamp-duty thresholds."""
    scenarios = spark.range(1000).select(F.col("id").alias("scenario"), (F.col("id") * 520.5).alias("threshold"))
    return R.threshold_impact(ver._documents(spark, sf), ver._failures(spark, sf), "INV-R004", "amount", ~F.coalesce("has_materai", F.lit(False)), scenarios)


def page_entries(spark, sf):
    """Invoice fields on the page of their line item, with image detections of the same document, as contents of pages."""
    items = ev._items(spark, sf)
    fields = items.select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("amount_"), "l_returnflag", "rank").alias("field_name"), F.col("l_extendedprice").cast("string").alias("value"), F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).alias("value_num"), F.col("l_quantity").alias("confidence"), F.least("rank", F.lit(3)).alias("page_number"), F.lit("IDR").alias("currency"))
    detections = fx.detections(spark, sf).select("det_id", "doc_id", F.lit(1).alias("page_number"), "object_type")
    pages = items.select(F.col("l_orderkey").alias("doc_id"), F.col("rank").alias("page_number"))
    out = R.page_contents(pages, R.full_field_entries(fields), detections)
    names = F.array_join(F.transform("extracted_fields", lambda f: F.concat_ws(":", f["field_name"], f["data_type"], f["confidence"].cast("decimal(9,4)"), f["status"], f["currency"])), ",")
    return out.select("doc_id", "page_number", names.alias("fields"), F.array_join(F.transform("detections", lambda d: d["object_type"]), ",").alias("objects"))


def late_rules(spark, sf):
    """Invoices below the confidence threshold and delivery notes whose stamps lack colour."""
    invoices = O.confidence_rule_failures(ver._verdicts(spark, sf).select("doc_id", "confidence"), 70.0)
    stamps = fx.detections(spark, sf).filter("object_type = 'stamp'").select("doc_id", (F.col("confidence") / 100).alias("color_ratio"))
    return invoices.unionByName(O.stamp_color_failures(stamps, 0.15)).select("doc_id", "rule_id", "message")


QUERIES = {f.__name__: f for f in (document_tokens, merged_tokens, document_names, display_documents, display_pages, job_results, confidence_components, validation_counts, drift, threshold_impact, page_entries, late_rules)}
# The operations module has queries of these names on other inputs.
QUERIES["confidence_parts"] = QUERIES.pop("confidence_components")
QUERIES["drift_shift"] = QUERIES.pop("drift")

_DOCS = f"WITH {ev._ITEMS}, owned AS (SELECT c.*, o_custkey AS job_id, dense_rank() OVER (PARTITION BY o_custkey ORDER BY l_orderkey) - 1 AS document_index FROM chosen c JOIN orders ON o_orderkey = l_orderkey)"

ORACLES = {
    "document_tokens": """WITH words AS (SELECT conv_id, turn, text, role, unnest(string_split(text, ' ')) AS w, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM conversations),
numbered AS (SELECT conv_id, turn || '/' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, i) || '/' || w AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text, i) AS n FROM words),
listed AS (SELECT conv_id, md5(string_agg(t, ' ' ORDER BY n)) AS tokens_md5, count(*) AS n_tokens FROM numbered GROUP BY 1)
SELECT c.conv_id AS doc_id, md5(coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (text <> ''), '')) AS text_md5, any_value(tokens_md5) AS tokens_md5, CAST(any_value(n_tokens) AS INTEGER) AS n_tokens,
  round(avg(CASE WHEN role <> 'user' THEN length(text) % 100 / 100 END), 6) AS average_confidence, 'page ' || min(turn) FILTER (NOT contains(text, '.')) AS error, CAST(count(*) AS INTEGER) AS n_pages FROM conversations c JOIN listed l ON l.conv_id = c.conv_id GROUP BY 1""",
    "merged_tokens": """SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, '|')) AS tokens_md5, CAST(CASE WHEN vis THEN 0.75 END AS DOUBLE) AS average_confidence FROM (
  SELECT doc_id, nat, vis, CASE WHEN nat AND long AND vis THEN list_concat(string_split(text, ' '), string_split(text, chr(10))) WHEN nat AND long THEN string_split(text, ' ') WHEN vis THEN string_split(text, chr(10)) END AS t
  FROM (SELECT *, contains(text, chr(10)) AS nat, length(text) >= 300 AS long, regexp_matches(text, '[0-9]') AS vis FROM documents WHERE text IS NOT NULL)) WHERE nat OR vis""",
    "document_names": """SELECT o_custkey AS job_id, CAST(o_orderkey AS INTEGER) AS document_index, CASE WHEN o_orderpriority < '3' THEN 'EXT-' || o_orderkey ELSE 'DOC-' || CASE WHEN o_orderkey < 999 THEN lpad(CAST(o_orderkey + 1 AS VARCHAR), 3, '0') ELSE CAST(o_orderkey + 1 AS VARCHAR) END END AS document_id,
  CASE WHEN o_orderstatus = 'O' THEN o_orderkey || '.pdf' WHEN o_orderpriority < '3' THEN 'EXT-' || o_orderkey ELSE 'document-' || (o_orderkey + 1) END AS document_name FROM orders""",
    "display_documents": f"""{_DOCS} SELECT job_id, CAST(document_index AS INTEGER) AS document_index, CASE any_value(state) WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'COMPLETED' ELSE 'FAILED' END AS status, job_id % 1000 AS processing_time_ms, 'Scan' || l_orderkey || '.PDF' AS file_name, '.pdf' AS extension,
  round(CASE WHEN any_value(state) <> 'P' THEN CAST(floor(any_value(o_totalprice)) AS DOUBLE) ELSE 0 END / 1024, 1) AS size_kb, CAST(count(*) AS INTEGER) AS page_count, CASE WHEN any_value(state) = 'O' THEN 87.5::DOUBLE END AS total_confidence,
  bool_or(l_returnflag = 'A') AS has_ocr, bool_or(l_tax > 0.05) AS has_detection FROM owned GROUP BY job_id, document_index, l_orderkey""",
    "display_pages": f"""{_DOCS} SELECT job_id, CAST(document_index AS INTEGER) AS document_index, CAST(rank AS INTEGER) AS page_number, CASE WHEN l_linestatus = 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS status, CASE WHEN l_returnflag = 'A' THEN 'SUCCESS' ELSE 'FAILED' END AS ocr_status,
  CASE WHEN l_returnflag = 'N' THEN '(empty)' ELSE 'part ' || l_partkey END AS raw_text, CASE WHEN l_returnflag <> 'R' THEN round((l_quantity + 0.5), 1) ELSE 0 END AS avg_confidence, CASE WHEN l_tax > 0.05 THEN 1 ELSE 0 END AS n_detections, CASE WHEN l_tax > 0.05 THEN round(l_discount * 100, 4) END AS first_confidence FROM owned""",
    "job_results": f"""{_DOCS}, c AS (SELECT c_custkey, c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AS legacy FROM customer)
SELECT 'Q' || job_id AS queue_id, CAST(CASE WHEN any_value(legacy) THEN count(*) ELSE count(*) FILTER (document_index = 0) END AS INTEGER) AS n_pages, CAST(CASE WHEN NOT any_value(legacy) THEN max(document_index) + 1 END AS INTEGER) AS n_documents,
  CASE WHEN NOT any_value(legacy) THEN '{{"n":' || (max(document_index) + 1) || '}}' END AS summary FROM owned JOIN c ON c_custkey = job_id GROUP BY job_id""",
    "confidence_parts": fx.duck("""SELECT o_orderkey AS doc_id, round(coalesce(CASE WHEN lv > 1 AND o_orderstatus <> 'P' THEN (round(o_totalprice / 10000, 1) + 80) / 2 WHEN lv > 1 THEN round(o_totalprice / 10000, 1) WHEN o_orderstatus <> 'P' THEN 80 END, 0), 2) AS ocr_field, CASE WHEN lv > 1 AND o_orderstatus <> 'P' THEN 100.0::DOUBLE ELSE 30.0::DOUBLE END AS field_validation,
  round(coalesce(c, 0), 2) AS object_detection, CASE o_orderstatus WHEN 'F' THEN 100.0::DOUBLE WHEN 'O' THEN 70.0::DOUBLE ELSE 0.0::DOUBLE END AS barcode, round(CASE WHEN lv <= 4 THEN (300 + 10.0 * lv) / 4 ELSE 100 END, 2)::DOUBLE AS document_quality
  FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS lv FROM orders) LEFT JOIN (SELECT doc_id, avg(floor(confidence / 8) * 8) AS c FROM fx_detections GROUP BY 1) d ON d.doc_id = o_orderkey"""),
    "validation_counts": fx.duck(f"""SELECT i.doc_id, CAST(8 + CASE WHEN i.doc_id % 7 <> 1 THEN 1 ELSE 0 END + CASE WHEN r.has THEN 1 ELSE 0 END - coalesce(n, 0) AS INTEGER) AS passed_validation, CAST(coalesce(n, 0) AS INTEGER) AS failed_validation, coalesce(items, '') AS failed_items, coalesce(advice, '') AS recommendation
  FROM fx_invoices i JOIN (SELECT doc_id, true AS has FROM fx_invoices) r ON r.doc_id = i.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(r.n, '; ' ORDER BY r.o) AS items,
  string_agg(CASE r.id WHEN 'INV-R004' THEN 'Upload an invoice with a valid Materai.' WHEN 'INV-R006' THEN 'Ensure the vendor signature is clearly visible.' WHEN 'INV-R011' THEN 'Verify the reimbursement transaction date.' END, ' ' ORDER BY r.o) AS advice FROM ({ver._RULES}) GROUP BY 1) f ON f.doc_id = i.doc_id"""),
    "drift_shift": """WITH o AS (SELECT CAST(c_nationkey AS VARCHAR) AS vendor, o_orderpriority AS document_type, CAST(n_regionkey AS VARCHAR) AS source, strftime(o_orderdate, '%Y-%m') AS period, o_orderstatus = 'F' AS good FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
sets AS (SELECT CASE WHEN grouping(vendor) = 0 THEN 'vendor' WHEN grouping(document_type) = 0 THEN 'document_type' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS dimension, coalesce(vendor, document_type, source, 'all') AS value, period, count(*) AS n, count(*) FILTER (good) AS good
  FROM o GROUP BY GROUPING SETS ((vendor, period), (document_type, period), (source, period), (period)))
SELECT dimension, value, period, CAST(n AS BIGINT) AS n, CAST(good AS BIGINT) AS good, round(good / n, 6) AS rate, round(lag(good / n) OVER w, 6) AS baseline, round(good / n - lag(good / n) OVER w, 6) AS shift FROM sets WINDOW w AS (PARTITION BY dimension, value ORDER BY period)""",
    "threshold_impact": fx.duck(f"""SELECT s AS scenario, t AS threshold, CAST(count(*) FILTER (NOT other AND NOT (exposed AND a >= t)) AS BIGINT) AS ok, CAST(count(*) FILTER (other OR (exposed AND a >= t)) AS BIGINT) AS ng FROM (
  SELECT i.doc_id, CASE WHEN i.doc_id % 23 <> 0 THEN CAST(total AS DOUBLE) END AS a, i.doc_id % 6 <> 0 AND i.doc_id % 23 <> 0 AS exposed, f.doc_id IS NOT NULL AS other FROM fx_invoices i LEFT JOIN (SELECT DISTINCT doc_id FROM ({ver._RULES}) WHERE r.id <> 'INV-R004') f ON f.doc_id = i.doc_id), (SELECT range AS s, range * 520.5::DOUBLE AS t FROM range(1000)) GROUP BY 1, 2"""),
    "page_entries": fx.duck(f"""SELECT p.l_orderkey AS doc_id, CAST(p.rank AS INTEGER) AS page_number, coalesce(fields, '') AS fields, CASE WHEN p.rank = 1 THEN coalesce(objects, '') ELSE '' END AS objects FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rank FROM lineitem JOIN orders ON o_orderkey = l_orderkey) p
  LEFT JOIN (SELECT l_orderkey, least(rank, 3) AS page, string_agg(name || ':' || kind || ':' || CAST(CAST(CASE WHEN l_quantity > 1 THEN round(l_quantity / 100, 4) ELSE l_quantity END AS DECIMAL(9,4)) AS VARCHAR) || ':FOUND:IDR', ',' ORDER BY name) AS fields FROM (SELECT *, 'amount_' || l_returnflag || rank AS name, CASE WHEN l_linestatus = 'F' THEN 'number' ELSE 'string' END AS kind
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rank FROM lineitem JOIN orders ON o_orderkey = l_orderkey)) GROUP BY 1, 2) f ON f.l_orderkey = p.l_orderkey AND f.page = p.rank
  LEFT JOIN (SELECT doc_id, string_agg(object_type, ',' ORDER BY det_id) AS objects FROM fx_detections GROUP BY 1) d ON d.doc_id = p.l_orderkey"""),
    "late_rules": fx.duck("""SELECT doc_id, 'INV-R008' AS rule_id, 'AI confidence below threshold. Manual verification required.' AS message FROM fx_invoices WHERE 60 + doc_id % 40 < 70
  UNION ALL SELECT doc_id, 'DN-R003', 'Company stamp is detected but color requirement is not met.' FROM fx_detections WHERE object_type = 'stamp' GROUP BY doc_id HAVING max(confidence) < 15"""),
}
