"""Shapes of results: document text with tokens, job results and display rows of envelopes, request data, confidence components, and how
verdicts and volumes move with thresholds and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import measures as M
from ledgerlens.storage import cut

PAGE = ["doc_id", "page_number"]


def merge_page_tokens(native: DataFrame, visual: DataFrame) -> DataFrame:
    """Pages (tokens array<string or struct>, usable; average_confidence, engine) of both layers: usable native tokens, the visual ones after
    them where there are any; else the visual layer's. A native layer alone has no confidence."""
    has = F.size(F.coalesce("visual_tokens", F.array().cast(dict(visual.dtypes)["visual_tokens"]))) > 0
    usable = F.coalesce(F.col("usable"), F.lit(False))
    joined = native.join(visual, PAGE, "full")
    return joined.select(
        *PAGE,
        F.when(usable & has, F.concat("native_tokens", "visual_tokens")).when(usable, F.col("native_tokens")).otherwise(F.col("visual_tokens")).alias("tokens"),
        F.when(has | ~usable, F.col("average_confidence")).alias("average_confidence"),
    )


def document_ocr(pages: DataFrame) -> DataFrame:
    """Per document: texts and tokens of its pages in page order, tokens numbered through (page_number, reading_order, token), the mean of
    the pages' confidences that there are, and the first page's error."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "raw_text", "tokens")))
    grouped = pages.groupBy("doc_id").agg(ordered.alias("p"), F.avg("average_confidence").alias("average_confidence"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page_number"))).alias("error"))
    texts = F.filter(F.transform("p", lambda x: x["raw_text"]), lambda t: F.coalesce(t != "", F.lit(False)))
    listed = F.flatten(F.transform("p", lambda x: F.transform(F.coalesce(x["tokens"], F.array().cast(dict(pages.dtypes)["tokens"])), lambda t: F.struct(x["page_number"].alias("page_number"), t.alias("token")))))
    numbered = F.transform(listed, lambda t, i: F.struct(t["page_number"].alias("page_number"), (i + 1).alias("reading_order"), t["token"].alias("token")))
    return grouped.select("doc_id", F.array_join(texts, "\n").alias("text"), numbered.alias("tokens"), F.round("average_confidence", 6).alias("average_confidence"), "error", F.size("p").alias("n_pages"))


def attach_request(results: DataFrame, requested: DataFrame) -> DataFrame:
    """Document results named by their request (job_id, document_index): its file name, else their external id, else their number."""
    named = requested.select("job_id", "document_index", F.col("file_name").alias("requested_name"))
    ident = F.nullif(F.col("external_document_id"), F.lit(""))
    number = F.col("document_index") + 1
    joined = results.join(named, ["job_id", "document_index"], "left")
    return joined.withColumn("document_id", F.coalesce(ident, F.format_string("DOC-%03d", number))).withColumn(
        "document_name", F.coalesce(F.nullif(F.col("requested_name"), F.lit("")), ident, F.concat(F.lit("document-"), number))
    ).drop("requested_name")


#: Below pages and documents everything keeps its JSON text: which keys they hold differs.
RESULT = "pages array<string>, documents array<string>, summary string"


def job_result(finals: DataFrame) -> DataFrame:
    """Final results (queue_id, internal_result_json): the pages of the root, else of the first document, and the documents if there are any."""
    parsed = finals.withColumn("r", F.from_json("internal_result_json", RESULT))
    first = F.from_json(F.get_json_object(F.get("r.documents", F.lit(0)), "$.pages"), "array<string>")
    some = lambda a: F.when(F.size(a) > 0, a)
    kept = [c for c in finals.columns if c != "internal_result_json"]
    return parsed.select(*kept, F.coalesce(some(F.col("r.pages")), first, F.array().cast("array<string>")).alias("pages"), some(F.col("r.documents")).alias("documents"), F.when(F.size("r.documents") > 0, F.col("r.summary")).alias("summary"))


DETECTION = "struct<label:string,confidence:double,page_number:int,bounding_box:struct<pixel_xyxy:array<double>>>"
DISPLAY = (
    "documents array<struct<document_name:string,file_information:struct<file_name:string,file_size_bytes:long,file_extension:string,content_type:string>,processing_status:string,processing_result:string,processing_time_ms:long,page_count:int,"
    f"pages:array<struct<page_number:int,page_index:int,processing_status:string,processing_result:string,ocr:struct<status:string,engine:string,raw_text:string,average_confidence:double,error:string>,detections:array<{DETECTION}>>>,"
    "confidence:struct<total:double>>>, processing struct<duration_ms:long>"
)


def _unit(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c > 1, c / 100).otherwise(c))))


def display_documents(envelopes: DataFrame) -> DataFrame:
    """One row per document of envelopes (job_id, envelope): header, page count, whether it has text and detections; pages stay nested."""
    listed = envelopes.select("job_id", F.from_json("envelope", DISPLAY).alias("e")).select("job_id", "e.processing", F.posexplode("e.documents").alias("document_index", "d"))
    info, size = F.col("d.file_information"), F.coalesce("d.file_information.file_size_bytes", F.lit(0))
    name = F.coalesce(F.nullif(info["file_name"], F.lit("")), "d.document_name", F.lit(""))
    pages = F.coalesce("d.pages", F.array().cast(listed.select("d.pages").schema[0].dataType))
    return listed.select(
        "job_id",
        "document_index",
        F.coalesce("d.processing_status", "d.processing_result", F.lit("FAILED")).alias("status"),
        F.coalesce("d.processing_time_ms", "processing.duration_ms", F.lit(0)).alias("processing_time_ms"),
        name.alias("file_name"),
        F.coalesce(F.nullif(info["file_extension"], F.lit("")), F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))).alias("extension"),
        F.round(size / 1024, 1).alias("size_kb"),
        F.coalesce("d.page_count", F.size(pages)).alias("page_count"),
        F.col("d.confidence.total").alias("total_confidence"),
        F.coalesce(F.exists(pages, lambda p: p["ocr"]["status"] == "SUCCESS"), F.lit(False)).alias("has_ocr"),
        F.coalesce(F.exists(pages, lambda p: F.size(p["detections"]) > 0), F.lit(False)).alias("has_detection"),
        pages.alias("pages"),
    )


def display_pages(documents: DataFrame) -> DataFrame:
    """One row per page of display_documents: text or a mark for none, confidence in percent (none: 0), detections in percent."""
    rows = documents.select("job_id", "document_index", F.posexplode("pages").alias("pos", "p"))
    number = F.coalesce("p.page_number", F.col("pos") + 1)
    shown = lambda d: F.struct(F.coalesce(d["label"], F.lit("?")).alias("label"), (F.coalesce(_unit(d["confidence"]), F.lit(0.0)) * 100).alias("confidence"), F.coalesce(d["page_number"], number).alias("page_number"), d["bounding_box"]["pixel_xyxy"].alias("bbox"))
    return rows.select(
        "job_id", "document_index", number.alias("page_number"),
        F.coalesce("p.processing_status", "p.processing_result", F.lit("FAILED")).alias("status"),
        F.coalesce("p.ocr.status", F.lit("FAILED")).alias("ocr_status"),
        F.coalesce("p.ocr.engine", F.lit("?")).alias("engine"),
        F.coalesce(F.nullif(F.col("p.ocr.raw_text"), F.lit("")), F.lit("(empty)")).alias("raw_text"),
        F.coalesce(F.round(_unit(F.col("p.ocr.average_confidence")) * 100, 1), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.transform("p.detections", shown), F.array().cast("array<struct<label:string,confidence:double,page_number:int,bbox:array<double>>>")).alias("detections"),
    )


def confidence_components(documents: DataFrame, detections: DataFrame) -> DataFrame:
    """Display components of documents (doc_id, number_conf, amount_conf, billing_conf, has_number, has_amount, barcode_decoded, barcode_found and
    four quality scores, null: 100): field mean, completeness 100 or 30, detection mean, barcode 100, 70 or 0, quality mean."""
    found = detections.groupBy("doc_id").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("detection"))
    quality = sum((F.coalesce(c, F.lit(100.0)) for c in ("resolution_score", "blur_score", "brightness_score", "page_readability_score")), F.lit(0.0)) / 4
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return documents.join(found, "doc_id", "left").select(
        "doc_id",
        F.round(F.coalesce(M.mean_of(*[F.col(c) for c in ("number_conf", "amount_conf", "billing_conf")]), F.lit(0.0)), 2).alias("ocr_field"),
        F.when(yes("has_number") & yes("has_amount"), 100.0).otherwise(30.0).alias("field_validation"),
        F.round(F.coalesce("detection", F.lit(0.0)), 2).alias("object_detection"),
        F.when(yes("barcode_decoded"), 100.0).when(yes("barcode_found"), 70.0).otherwise(0.0).alias("barcode"),
        F.round(quality, 2).alias("document_quality"),
    )


def validation_counts(documents: DataFrame, failures: DataFrame, checked: Column, recommendations: dict[str, str]) -> DataFrame:
    """Per document: how many rules applied (checked), passed and failed, the failed rules' names in rule order, and what to do about them."""
    advice = F.create_map(*[F.lit(x) for pair in recommendations.items() for x in pair])
    named = F.array_sort(F.collect_list(F.struct("rule_order", "rule_id", "rule_name")))
    failed = failures.groupBy("doc_id").agg(named.alias("f"))
    joined = documents.select("doc_id", checked.cast("int").alias("total_validation")).join(failed, "doc_id", "left")
    n = F.coalesce(F.size("f"), F.lit(0))
    return joined.select(
        "doc_id", "total_validation", (F.col("total_validation") - n).alias("passed_validation"), n.alias("failed_validation"),
        F.coalesce(F.transform("f", lambda r: r["rule_name"]), F.array().cast("array<string>")).alias("failed_items"),
        F.array_compact(F.array_distinct(F.transform("f", lambda r: F.try_element_at(advice, r["rule_id"])))).alias("recommendation"),
    )


def drift(results: DataFrame, period: Column, dimensions: tuple[str, ...], good: Column) -> DataFrame:
    """For every dimension alone and for all rows: rows and share of good ones by period, against the period before of the same set.

    One aggregation by all dimensions and period comes first; the sets are made of its few rows."""
    fine = results.groupBy(*dimensions, period.alias("period")).agg(F.count("*").alias("n"), F.count_if(good).alias("good"))
    sets = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions], F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("value")))
    cells = fine.select("period", "n", "good", F.inline(sets)).groupBy("dimension", "value", "period").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    before = Window.partitionBy("dimension", "value").orderBy("period")
    rate = F.col("good") / F.col("n")
    return cells.withColumn("rate", F.round(rate, 6)).withColumn("baseline", F.round(F.lag(rate).over(before), 6)).withColumn("shift", F.round(rate - F.lag(rate).over(before), 6))


def counts_below(values: DataFrame, value: str, thresholds: DataFrame) -> DataFrame:
    """thresholds (threshold and more) with the number of values below each: both are sorted together once, by range partitions, and each
    partition's count is carried on to the later ones. Null values are below none."""
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = [c for c in thresholds.columns if c != "threshold"]
    asked = thresholds.select(F.col("threshold").cast("double").alias("v"), F.lit(0).alias("kind"), F.struct(*keep).alias("ask"))
    given = values.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")).withColumn("kind", F.lit(1))
    rows = asked.unionByName(given, allowMissingColumns=True).withColumn("n", F.coalesce("n", F.lit(0)))
    dealt = cut(rows.repartitionByRange(parts, "v", "kind").withColumn("part", F.spark_partition_id()))
    offsets = dealt.groupBy("part").agg(F.sum("n").alias("own")).withColumn("before", F.coalesce(F.sum("own").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    local = F.sum("n").over(Window.partitionBy("part").orderBy("v", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("upto", local).filter("kind = 0").join(F.broadcast(offsets), "part").select(F.col("v").alias("threshold"), "ask.*", (F.col("upto") + F.col("before")).alias("below"))


def threshold_impact(documents: DataFrame, failures: DataFrame, rule_id: str, margin: str, fails: Column, scenarios: DataFrame) -> DataFrame:
    """How many documents pass under each threshold of one rule, which fails where margin reaches the threshold and fails (a condition)
    holds. scenarios: scenario, threshold. No scenario passes over the documents: those that fail no other rule are counted by margin once."""
    others = failures.filter(F.col("rule_id") != rule_id).select("doc_id").distinct()
    free = documents.join(others, "doc_id", "left_anti").select(margin, F.coalesce(fails & F.col(margin).isNotNull(), F.lit(False)).alias("exposed"))
    totals = documents.agg(F.count("*").alias("docs")).crossJoin(free.agg(F.count_if(~F.col("exposed")).alias("safe")))  # one row each
    spared = counts_below(free.filter("exposed"), margin, scenarios)
    return spared.crossJoin(F.broadcast(totals)).select("scenario", "threshold", (F.col("safe") + F.col("below")).alias("ok"), (F.col("docs") - F.col("safe") - F.col("below")).alias("ng"))


#: The columns of a field entry beyond those that are computed, with their type and what stands where a field lacks them.
ENTRY_COLUMNS = {
    "raw_value": ("string", None), "status": ("string", "FOUND"), "source_text": ("string", None), "source_label": ("string", None), "source_block_id": ("string", None), "candidate_id": ("string", None),
    "source_bbox": ("array<double>", None), "extraction_method": ("string", None), "reason_code": ("string", None), "reasoning_engine": ("string", None), "verification_status": ("string", None),
    "independent_evidence_count": ("int", None), "confidence_source": ("string", None), "confidence_calibrated": ("boolean", None), "manual_review_required": ("boolean", False),
    "amount_role": ("string", None), "currency": ("string", None), "validation": ("string", None), "candidate_count": ("int", None), "alternatives": ("array<string>", None),
}


def full_field_entries(fields: DataFrame) -> DataFrame:
    """doc_id and the 26 columns of a field entry, from resolved fields (doc_id, field_name, value, value_num, confidence, page_number and any of
    ENTRY_COLUMNS)."""
    page = F.coalesce("page_number", F.lit(1))
    rest = [F.coalesce(*([F.col(c).cast(kind)] if c in fields.columns else []), F.lit(default).cast(kind)).alias(c) for c, (kind, default) in ENTRY_COLUMNS.items() if c != "alternatives"]
    alternatives = F.coalesce(*([F.col("alternatives").cast("array<string>")] if "alternatives" in fields.columns else []), F.array().cast("array<string>"))
    return fields.select(
        "doc_id", "field_name", "value", F.when(F.col("value_num").isNotNull(), "number").otherwise("string").alias("data_type"), M.to_unit(F.col("confidence")).alias("confidence"),
        (page - 1).alias("source_page_index"), page.alias("source_page_number"), *rest, alternatives.alias("alternatives"),
    )


def page_contents(pages: DataFrame, entries: DataFrame, detections: DataFrame) -> DataFrame:
    """Pages (doc_id, page_number) with the field entries and detections that stand on them, in order of name and id."""
    own = entries.groupBy("doc_id", F.col("source_page_number").alias("page_number")).agg(F.array_sort(F.collect_list(F.struct("field_name", *[c for c in entries.columns if c not in ("doc_id", "field_name")]))).alias("extracted_fields"))
    seen = detections.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("det_id", *[c for c in detections.columns if c not in ("doc_id", "page_number", "det_id")]))).alias("detections"))
    joined = pages.join(own, PAGE, "left").join(seen, PAGE, "left")
    empty = lambda c: F.coalesce(c, F.array().cast(dict(joined.dtypes)[c])).alias(c)
    return joined.select(*pages.columns, empty("extracted_fields"), empty("detections"))
