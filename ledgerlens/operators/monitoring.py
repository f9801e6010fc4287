"""Headers of result envelopes, quality of the models by group, and blended confidences of fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import measures as M

DOCUMENT = ["job_id", "document_index"]


def envelope_header(documents: DataFrame, failures: DataFrame, causes: list[str], job_checks: list[str]) -> DataFrame:
    """One row a job: document counts by category and verdict, each document's verdict, the failed documents with their reasons, failures by
    cause, and a note.

    documents: job_id, document_index, document_id, document_name, document_type, category (main or second), result. failures: job_id,
    document_index, rule_order, rule_name, cause (null: none of causes). job_checks are causes of which the verdicts speak as checks of the
    whole job. Types that occur several times are numbered by document_index. A job's documents came in one message, which bounds the lists.
    """
    alike = Window.partitionBy("job_id", "document_type")
    several = F.count("*").over(alike) > 1
    seat = F.row_number().over(alike.orderBy("document_index"))
    kind = F.lower(F.regexp_replace(F.coalesce("document_type", F.lit("document")), "[^A-Za-z0-9]+", "_"))
    named = documents.withColumn("key", F.when(several, F.concat_ws("_", kind, seat)).otherwise(kind))
    reasons = failures.groupBy(*DOCUMENT).agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_order", "rule_name"))), lambda r: r["rule_name"]).alias("reason"))
    docs = named.join(reasons, DOCUMENT, "left").withColumn("reason", F.coalesce("reason", F.array().cast("array<string>")))
    ok, main = F.col("result") == "OK", F.col("category") == "main"
    failed = F.when(~ok, F.struct("document_index", "document_id", "document_type", "document_name", "key", "reason"))
    jobs = docs.groupBy("job_id").agg(
        F.count("*").alias("total_documents"), F.count_if(ok).alias("ok_documents"), F.count_if(~ok).alias("ng_documents"),
        F.count_if(main).alias("main_document"), F.count_if(~main).alias("second_document"),
        *[F.count_if(m & r).alias(f"{c}_document_{v}") for c, m in (("main", main), ("second", ~main)) for v, r in (("ok", ok), ("ng", ~ok))],
        F.array_sort(F.collect_list(F.struct("document_index", "key", "result"))).alias("verdicts"), F.array_sort(F.collect_list(failed)).alias("failed"),
    )
    counts = failures.groupBy("job_id").agg(*[F.count_if(F.col("cause") == c).alias(f"n_{c}") for c in causes])
    n = {c: F.coalesce(f"n_{c}", F.lit(0)) for c in causes}
    checks = F.create_map(*[x for c in job_checks for x in (F.lit(c), F.when(n[c] > 0, "NG").otherwise("OK"))]) if job_checks else F.create_map().cast("map<string,string>")
    own = F.map_from_entries(F.transform("verdicts", lambda d: F.struct(d["key"], d["result"])))
    why = F.array_join(F.transform("failed", lambda d: F.concat(F.lit(" "), d["key"], F.when(F.size(d["reason"]) > 0, F.concat(F.lit(" failed because of: "), F.array_join(d["reason"], ", "))).otherwise(" failed"), F.lit("."))), "")
    some = F.concat(F.lit("AI Verification completed with validation failures on "), "ng_documents", F.lit(" of "), "total_documents", F.lit(" submitted documents."), why)
    return jobs.join(counts, "job_id", "left").select(
        *[c for c in jobs.columns if c not in ("verdicts", "failed")],
        F.map_concat(own, checks).alias("validation_summary"),
        F.transform("failed", lambda d: F.struct(d["document_id"], d["document_type"], d["document_name"], d["reason"])).alias("failed_documents"),
        F.create_map(*[x for c in causes for x in (F.lit(c), n[c])]).alias("failed_validation_summary"),
        F.when(F.col("ng_documents") > 0, some).otherwise(F.concat(F.lit("AI Verification completed. All "), "total_documents", F.lit(" submitted documents passed."))).alias("ai_note"),
    )


def model_quality(documents: DataFrame, fields: DataFrame, detections: DataFrame, barcodes: DataFrame, reviews: DataFrame, classes: list[str], dimensions: tuple[str, ...]) -> DataFrame:
    """By the dimensions of documents (doc_id, result, confidence): how many, mean text confidence, share of fields found, detections of each
    class, share of barcodes decoded, and how often reviewers (doc_id, truth) disagree with a verdict OK or NG.

    Every child is one row a document before it meets the documents, so children never multiply each other; a document reviewed several times
    counts once, as NG if anyone said so. Shares of nothing are null.
    """
    f = fields.groupBy("doc_id").agg(F.count("*").alias("fields"), F.count_if(F.col("status") == "FOUND").alias("found"))
    d = detections.groupBy("doc_id").agg(*[F.count_if(F.col("object_type") == c).alias(f"n_{c}") for c in classes])
    b = barcodes.groupBy("doc_id").agg(F.count("*").alias("barcodes"), F.count_if("decoded").alias("decoded"))
    r = reviews.groupBy("doc_id").agg(F.min("truth").alias("truth"))  # NG sorts before OK
    joined = documents
    for child in (f, d, b, r):
        joined = joined.join(child, "doc_id", "left")
    said = lambda v, t=None: F.count_if((F.col("result") == v) & (F.col("truth").isNotNull() if t is None else F.col("truth") == t))
    share = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return joined.groupBy(*dimensions).agg(
        F.count("*").alias("documents"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), share(F.sum("found"), F.sum("fields")).alias("field_success_rate"),
        *[total(f"n_{c}").alias(f"{c}_count") for c in classes], share(F.sum("decoded"), F.sum("barcodes")).alias("decoded_rate"),
        F.count("truth").alias("reviewed"), share(said("OK", "NG"), said("OK")).alias("false_ok_rate"), share(said("NG", "OK"), said("NG")).alias("false_ng_rate"),
    )


def blended_fields(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """The best candidate of each field by blended confidence; of equal ones the first page's, then the smallest value.

    candidates: doc_id, page_number, field_name, value, pattern_confidence, layout_confidence, format_valid. pages: doc_id, page_number,
    average_confidence. A field is one group of a document's candidates. Null scores count as 0.
    """
    joined = candidates.join(pages.select("doc_id", "page_number", "average_confidence"), ["doc_id", "page_number"], "left")
    blend = M.field_blend(F.col("average_confidence"), F.col("pattern_confidence"), F.col("layout_confidence"), F.col("format_valid").cast("double"))
    scored = joined.withColumn("confidence", F.round(blend, 6))
    best = F.min(F.struct((-F.col("confidence")).alias("k"), "page_number", "value", "confidence"))
    return scored.groupBy("doc_id", "field_name").agg(best.alias("b"), F.count("*").alias("n_candidates")).select("doc_id", "field_name", "b.value", "b.page_number", "b.confidence", "n_candidates")
