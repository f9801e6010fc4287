"""Rules, scores and verdicts of documents, and their rollups to jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import fixed_values as V
from ledgerlens.functions import measures as M

#: Defaults of the rule configuration; a one-row table with some of these columns overrides them.
RULE_CONFIG = {
    "require_invoice_number": True, "require_amount": True, "require_billing_number": False, "stamp_duty_threshold": 5_000_000.0, "require_materai": True,
    "require_signature": False, "require_stamp": True, "require_barcode": False, "require_colored": True, "signature_count": 2, "stamp_count": 2,
    "amount_tolerance": 0.0, "confidence_threshold": 85.0,
}


def with_config(documents: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """documents with cfg_* columns: the defaults, overridden by config, which must hold one row; several stop the query."""
    given = config.columns if config is not None else []
    kinds = dict(config.dtypes) if given else {}
    one = lambda c: F.when(F.count("*") <= 1, F.first(c)).otherwise(F.raise_error(F.lit("several rule configurations")).cast(kinds[c]))
    only = lambda c: F.coalesce(one(c), F.lit(RULE_CONFIG.get(c)))
    out = documents.crossJoin(F.broadcast(config.agg(*[only(c).alias(f"cfg_{c}") for c in given]))) if given else documents  # one row
    return out.withColumns({f"cfg_{c}": F.lit(v) for c, v in RULE_CONFIG.items() if c not in given})


def _rule(order: int, rule_id: str, name: str, message: Column, failed: Column) -> Column:
    row = F.struct(F.lit(order).alias("rule_order"), F.lit(rule_id).alias("rule_id"), F.lit(name).alias("rule_name"), message.alias("message"))
    return F.when(F.coalesce(failed, F.lit(False)), row)


def vendor_key(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\b(pt|cv|tbk|persero)\b", ""), "[^a-z0-9]", "")


def invoice_rule_failures(documents: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """One row per failed rule. documents: doc_id, invoice_number, verification_status, amount, billing_number, has_stamp, has_signature,
    has_materai, barcode_decoded, is_colored, expected_amount, vendor_name, expected_vendor, document_date, request_date, transaction_type."""
    c, cfg = F.col, lambda n: F.col(f"cfg_{n}")
    text = F.lit
    flag = lambda n: ~F.coalesce(c(n), F.lit(False))
    months = F.when(F.upper("transaction_type") == "REIMBURSEMENT_TOLL", 2).otherwise(6)
    first_day = F.trunc(F.add_months("request_date", -months), "MM")
    missing = c("invoice_number").isNull() | (c("invoice_number") == "")
    # Ids, names and messages of the rules.
    rules = [
        _rule(1, "INV-R001", "Invoice number required", text("Invoice number not found."), cfg("require_invoice_number") & missing),
        _rule(2, "INV-R012", "Invoice number requires verified OCR evidence", text("Invoice number is a deterministic fallback and requires model verification."), cfg("require_invoice_number") & ~missing & ~c("verification_status").eqNullSafe("VERIFIED")),
        _rule(3, "INV-R002", "Amount required", text("Amount not found."), cfg("require_amount") & c("amount").isNull()),
        _rule(4, "INV-R003", "Billing number required", text("Billing number not found."), cfg("require_billing_number") & (c("billing_number").isNull() | (c("billing_number") == ""))),
        _rule(5, "INV-R004", "Materai required above threshold", text("Above Rp. 5.000.000. Missing Stamp Duty."), cfg("require_materai") & (c("amount") >= cfg("stamp_duty_threshold")) & flag("has_materai")),
        _rule(6, "INV-STAMP-R005", "Company stamp required", text("Missing company stamp."), cfg("require_stamp") & flag("has_stamp")),
        _rule(7, "INV-R006", "Signature required", text("Missing signature."), cfg("require_signature") & flag("has_signature")),
        _rule(8, "INV-R007", "Decoded barcode required", text("Barcode was not decoded."), cfg("require_barcode") & flag("barcode_decoded")),
        _rule(9, "DOC-R001", "Colored document required", text("Document is monochrome."), cfg("require_colored") & (c("is_colored") == F.lit(False))),
        _rule(10, "INV-R009", "Amount must match PV amount", text("Document amount does not match PV amount."), F.abs(c("expected_amount") - c("amount")) > cfg("amount_tolerance")),
        _rule(11, "INV-R010", "Vendor must match PV vendor", text("Document vendor does not match PV vendor."), (F.trim("expected_vendor") != "") & (c("vendor_name") != "") & (vendor_key(c("expected_vendor")) != vendor_key(c("vendor_name")))),
        _rule(12, "INV-R011", "Transaction date within permitted period", text("Document date is outside the permitted transaction period."), (c("document_date") < first_day) | (c("document_date") > c("request_date"))),
    ]
    return with_config(documents, config).select("doc_id", F.inline(F.array_compact(F.array(*rules))))


def note_rule_failures(notes: DataFrame, config: DataFrame | None = None) -> DataFrame:
    """Delivery notes: doc_id, signatures, stamps, is_colored."""
    c, cfg = F.col, lambda n: F.col(f"cfg_{n}")
    count = lambda what, have, need: F.concat(F.lit(f"Required {what} count is not met ("), have, F.lit("/"), need, F.lit(")."))
    # Ids, names and messages of the rules.
    rules = [
        _rule(1, "DN-R001", "Delivery Note signature count", count("signature", c("signatures"), cfg("signature_count")), c("signatures") < cfg("signature_count")),
        _rule(2, "DN-R002", "Delivery Note stamp count", count("company stamp", c("stamps"), cfg("stamp_count")), c("stamps") < cfg("stamp_count")),
        _rule(3, "DOC-R001", "Colored document required", F.lit("Document is monochrome."), cfg("require_colored") & (c("is_colored") == F.lit(False))),
    ]
    return with_config(notes, config).select("doc_id", F.inline(F.array_compact(F.array(*rules))))


def remarks(documents: DataFrame, failures: DataFrame, first: int | None = None) -> DataFrame:
    """The messages of failed rules in rule order (all, or the first few), or that verification passed; and the failed names."""
    ordered = F.array_sort(F.collect_list(F.struct("rule_order", "message", "rule_name")))
    listed = failures.groupBy("doc_id").agg(ordered.alias("failed"))
    cut = F.slice("failed", 1, first) if first else F.col("failed")
    joined = documents.select("doc_id").join(listed, "doc_id", "left")
    return joined.select(
        "doc_id",
        F.coalesce(F.array_join(F.transform(cut, lambda f: f["message"]), "; "), F.lit("Verification passed.")).alias("remark"),
        F.coalesce(F.array_join(F.transform(F.slice("failed", 1, 3), lambda f: f["rule_name"]), "; "), F.lit("Verification passed.")).alias("reason"),
        F.coalesce(F.size("failed"), F.lit(0)).alias("n_failed"),
    )


def confidence_rule_failures(documents: DataFrame, threshold: float = RULE_CONFIG["confidence_threshold"]) -> DataFrame:
    """Documents (doc_id, confidence) below the threshold; without a confidence too."""
    rule = _rule(13, "INV-R008", "Confidence below threshold", F.lit("AI confidence below threshold. Manual verification required."), ~F.coalesce(F.col("confidence") >= threshold, F.lit(False)))
    return documents.select("doc_id", F.inline(F.array_compact(F.array(rule))))


def stamp_color_failures(stamps: DataFrame, least_ratio: float) -> DataFrame:
    """Delivery notes with stamps (doc_id, color_ratio) none of which is coloured enough. Notes without a stamp fail another rule."""
    best = stamps.groupBy("doc_id").agg(F.max("color_ratio").alias("best"))
    rule = _rule(4, "DN-R003", "Stamp color required", F.lit("Company stamp is detected but color requirement is not met."), ~F.coalesce(F.col("best") >= least_ratio, F.lit(False)))
    return best.select("doc_id", F.inline(F.array_compact(F.array(rule))))


def verdicts(documents: DataFrame, failures: DataFrame, threshold: float = 85.0) -> DataFrame:
    """doc_id, confidence, result: OK if no rule failed and the confidence reaches the threshold."""
    bad = failures.select("doc_id").distinct().withColumn("bad", F.lit(True))
    ok = F.col("bad").isNull() & F.coalesce(F.col("confidence") >= threshold, F.lit(False))
    return documents.join(bad, "doc_id", "left").withColumn("result", F.when(ok, "OK").otherwise("NG")).drop("bad")


def detections_per_type(detections: DataFrame, threshold: float = 0.25) -> DataFrame:
    """The best detection of each type of a document, OK if any of the type is."""
    best = F.max_by(F.struct("confidence", "box"), F.struct(F.coalesce("confidence", F.lit(0.0)), -F.col("det_id")))
    return detections.groupBy("doc_id", "object_type").agg(
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("confidence"),
        F.when(F.bool_or(M.detection_result(F.col("confidence"), threshold) == "OK"), "OK").otherwise("NG").alias("result"),
        best["box"].alias("box"),
    )


def visual_verification(documents: DataFrame, detections: DataFrame) -> DataFrame:
    """Signature, stamp and materai of every document, also where there is none."""
    kinds = F.explode(F.array(*[F.lit(k) for k in ("signature", "stamp", "materai")])).alias("object_type")
    wanted = documents.select("doc_id").distinct().select("doc_id", kinds)
    found = detections.groupBy("doc_id", "object_type").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))
    return wanted.join(found, ["doc_id", "object_type"], "left").select(
        "doc_id", "object_type", F.when(F.col("n") > 0, "OK").otherwise("NG").alias("result"), F.coalesce("n", F.lit(0)).alias("count"), M.to_unit(F.col("best")).alias("confidence")
    )


def note_counts(detections: DataFrame, threshold: float = 0.25) -> DataFrame:
    good = M.detection_result(F.col("confidence"), threshold) == "OK"
    count = lambda kind: F.count_if(good & (F.col("object_type") == kind))
    return detections.groupBy("doc_id").agg(count("signature").alias("signatures"), count("stamp").alias("stamps"))


def document_barcode(pages: DataFrame) -> DataFrame:
    """Of the pages' barcodes the first decoded one, else the first found, else none."""
    rank = F.when(F.col("barcode_decoded"), 0).when(F.col("barcode_found"), 1).otherwise(2)
    return pages.groupBy("doc_id").agg(F.min_by(F.struct("barcode_value", "barcode_decoded", "barcode_found"), F.struct(rank, F.col("page_number"))).alias("b")).select("doc_id", "b.*")


def confidence_score(documents: DataFrame, barcode_required: bool = False, zero_quality_is_full: bool = False) -> DataFrame:
    """documents with confidence: weighted means of text, field, detection, barcode and quality scores, 0 to 100.

    Columns: number_conf, billing_conf, amount_conf, date_conf, average_conf, has_number, has_amount, has_date, detection_conf,
    barcode_conf, quality. A null quality counts as 100; so does 0 only with zero_quality_is_full.
    """
    p = lambda n: M.to_percent(F.col(n))
    text = F.coalesce(M.mean_of(p("number_conf"), p("billing_conf"), p("amount_conf"), p("date_conf")), p("average_conf"), F.lit(0.0))
    part = lambda has, conf: F.when(F.col(has), F.coalesce(p(conf), F.lit(50.0)))
    field = F.coalesce(M.mean_of(part("has_number", "number_conf"), part("has_amount", "amount_conf"), part("has_date", "date_conf")), F.lit(0.0))
    barcode = F.coalesce(F.col("barcode_conf"), F.lit(0.0)) if barcode_required else F.lit(100.0)
    quality = F.coalesce(F.nullif(F.col("quality"), F.lit(0.0)) if zero_quality_is_full else F.col("quality"), F.lit(100.0))
    w = V.CONFIDENCE_WEIGHTS
    total = text * w["ocr"] + field * w["field"] + F.coalesce("detection_conf", F.lit(0.0)) * w["detection"] + barcode * w["barcode"] + quality * w["quality"]
    return documents.withColumn("ocr_score", text).withColumn("field_score", field).withColumn("confidence", F.round(total, 2)).withColumn("level", M.confidence_level(F.col("confidence")))


def job_rollup(documents: DataFrame) -> DataFrame:
    """Per job: OK, NG and error counts; OK only if every document is and none failed; confidence is the least one."""
    error = F.coalesce(F.col("processing_result").isin("INTERNAL_ERROR", "DOCUMENT_ERROR"), F.lit(False))
    counted = documents.groupBy("job_id").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("result") == "OK").alias("ok"),
        F.count_if(F.col("result") == "NG").alias("ng"),
        F.count_if(error).alias("errors"),
        F.min("confidence").alias("confidence"),
    )
    return counted.withColumn("overall", F.when((F.col("ok") == F.col("documents")) & (F.col("errors") == 0), "OK").otherwise("NG")).withColumn(
        "return_code", F.when(F.col("errors") == 0, "SUCCESS").otherwise("PARTIAL_SUCCESS")
    )


def envelope_summary(documents: DataFrame) -> DataFrame:
    ok = F.col("result").isin("OK", "SUCCESS")
    counted = documents.groupBy("job_id").agg(F.count("*").alias("total_documents"), F.count_if(ok).alias("ok_documents"), F.count_if(~ok).alias("ng_documents"), F.sum("n_pages").alias("total_pages"))
    return counted.withColumn("note", F.concat(F.col("ok_documents"), F.lit(" OK, "), F.col("ng_documents"), F.lit(" NG document(s)")))


def document_text(pages: DataFrame) -> DataFrame:
    """Page texts in page order, empty pages dropped."""
    ordered = F.array_sort(F.collect_list(F.when(F.trim("raw_text") != "", F.struct("page_number", "raw_text"))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: p["raw_text"]), "\n").alias("text"), F.count("*").alias("n_pages"))


def document_is_colored(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.coalesce(F.every(F.coalesce("is_colored", F.lit(False))), F.lit(False)).alias("is_colored"))


def job_progress(events: DataFrame) -> DataFrame:
    """Document events (job_id, total, failed) as the state of their jobs."""
    counted = events.groupBy("job_id").agg(F.max("total").alias("total"), F.count("*").alias("completed"), F.count_if("failed").alias("failed"))
    done = F.col("completed") >= F.col("total")
    state = F.when(~done, "RUNNING").when(F.col("failed") == F.col("total"), "FAILED").when(F.col("failed") > 0, "PARTIAL_SUCCESS").otherwise("SUCCEEDED")
    return counted.withColumn("status", state)


def assemble_partial(good: DataFrame, failures: DataFrame) -> DataFrame:
    """Results and, as NG rows with an error, the documents that failed."""
    bad = failures.select("job_id", "doc_id", F.lit("NG").alias("result"), F.lit("INTERNAL_ERROR").alias("processing_result"), F.col("message").alias("error"))
    return good.unionByName(bad, allowMissingColumns=True)


def page_failures(pages: DataFrame) -> DataFrame:
    """A document fails if any page's recognition did; its error is that of the first such page."""
    return pages.groupBy("doc_id").agg(
        F.when(F.bool_or(F.col("error").isNotNull()), "FAILED").otherwise("COMPLETED").alias("status"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page_number"))).alias("error"), F.count("*").alias("n_pages")
    )


def merge_page_text(native: DataFrame, visual: DataFrame) -> DataFrame:
    """Usable native text, with visual text after it where that was needed; else visual text."""
    usable, has = F.coalesce(F.col("usable"), F.lit(False)), F.trim(F.coalesce("visual_text", F.lit(""))) != ""
    joined = native.join(visual, ["doc_id", "page_number"], "full")
    return joined.select(
        "doc_id",
        "page_number",
        F.when(usable & has, F.concat_ws("\n", "native_text", "visual_text")).when(usable, F.col("native_text")).otherwise(F.col("visual_text")).alias("text"),
        F.when(usable & has, F.concat(F.lit("pymupdf+"), "engine")).when(usable, "pymupdf").otherwise(F.col("engine")).alias("engine_name"),
    )


def page_note(text: Column, n_detections: Column, decoded: Column, found: Column, colored: Column) -> Column:
    barcode = F.when(decoded, "barcode decoded").when(found, "barcode found").otherwise("barcode not found")
    seen = F.when(F.coalesce(text, F.lit("")) != "", "OCR text found").otherwise("OCR text not found")
    color = F.when(colored, "color evidence found").otherwise("color evidence not found")
    return F.concat(F.concat_ws("; ", seen, F.concat(n_detections, F.lit(" detection(s)")), barcode, color), F.lit("."))


def box_projection(detections: DataFrame, width: Column, height: Column) -> DataFrame:
    """Pixel boxes and their shares of the page, six decimals."""
    side = lambda i: width if i % 2 == 0 else height
    return detections.withColumn("normalized", F.array(*[F.round(F.get("pixel", F.lit(i)) / side(i), 6) for i in range(4)]))


def field_entries(fields: DataFrame) -> DataFrame:
    """Resolved fields as result entries."""
    return fields.withColumn("data_type", F.when(F.col("value_num").isNotNull(), "number").otherwise("string")).withColumn("confidence", M.to_unit(F.col("confidence")))
