"""Verification requests: JSON messages in two formats to one job row and its document rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import text as T

FILE = "file_url string, attachment_url string, file_name string, mime_type string, checksum_sha256 string"
DOCUMENT = f"struct<document_id:string,document_index:int,document_type:string,document_category:string,attachment_url:string,file_url:string,file_name:string,mime_type:string,file:struct<{FILE.replace(' string', ':string')}>>"
MESSAGE = (
    "QUEUE_ID string, DOC_NO string, DOC_TYPE string, DOC_SEQ string, TRANS_TYPE_CD string, FILE_NM string, AI_SCAN_APP string, PATH_FILE string, PV_YEAR string, "
    "queue_no string, message_id string, correlation_id string, source_system string, pv_no string, pv_year string, transaction_type string, vendor_code string, vendor_name string, "
    f"total_amount string, created_datetime string, business_context map<string,string>, documents array<{DOCUMENT}>"
)


def parse_messages(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(requests, rejects): parsed messages, and those that aren't JSON objects."""
    parsed = raw.withColumn("m", F.when(F.ltrim(column).startswith("{"), F.from_json(column, MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))).withColumn(
        "broken", F.col("m").isNull() | F.try_parse_json(column).isNull()
    )
    return parsed.filter("not broken").drop("broken"), parsed.filter("broken").drop("broken", "m")


def normalize_requests(parsed: DataFrame) -> DataFrame:
    """One row per message: ids, context lifted from the root where the context lacks it, documents in one shape."""
    m = lambda n: F.col(f"m.{n}")
    first = F.get(m("documents"), 0)
    batch = F.coalesce(F.size(m("documents")) > 0, F.lit(False)) & (first["file"].isNotNull() | first["document_id"].isNotNull())
    context = lambda n: F.coalesce(F.try_element_at(m("business_context"), F.lit(n)), m(n))
    legacy_key = T.idempotency_key(F.coalesce(m("DOC_NO"), F.lit("")), m("DOC_TYPE"), F.coalesce(m("DOC_SEQ"), F.lit("0")), m("FILE_NM"), m("PATH_FILE"))
    queue = F.when(batch, F.coalesce(m("queue_no"), m("QUEUE_ID"))).otherwise(m("QUEUE_ID"))

    def one(d, i):
        url = F.coalesce(d["file"]["file_url"], d["file"]["attachment_url"], d["file_url"], d["attachment_url"], F.lit(""))
        name = F.coalesce(d["file"]["file_name"], d["file_name"], T.name_from_url(url))
        return F.struct(
            F.coalesce(d["document_id"], F.format_string("DOC-%03d", i + 1)).alias("external_document_id"), F.coalesce(d["document_index"], i).alias("document_index"), F.coalesce(d["document_type"], F.lit("")).alias("document_type"),
            F.coalesce(d["document_category"], F.lit("MAIN_DOCUMENT")).alias("document_category"), name.alias("file_name"), url.alias("file_url"), F.coalesce(d["file"]["mime_type"], d["mime_type"], T.mime_from_name(name)).alias("mime_type"),
        )

    single = F.array(
        F.struct(
            F.lit("DOC-001").alias("external_document_id"), F.lit(0).alias("document_index"), F.coalesce(m("DOC_TYPE"), F.lit("")).alias("document_type"), F.lit("MAIN_DOCUMENT").alias("document_category"),
            F.coalesce(m("FILE_NM"), F.lit("")).alias("file_name"), F.coalesce(m("PATH_FILE"), F.lit("")).alias("file_url"), T.mime_from_name(F.coalesce(m("FILE_NM"), F.lit(""))).alias("mime_type"),
        )
    )
    out = parsed.withColumn("is_batch", batch).withColumn("docs", F.when(batch, F.transform(m("documents"), one)).otherwise(single))
    parts = F.array_join(F.concat(F.array(F.coalesce(F.col("queue_id"), F.lit(""))), F.flatten(F.transform("docs", lambda d: F.array(d["external_document_id"], d["file_url"])))), "|")
    # A message without a queue id gets one derived from its key, so that repeats are recognised.
    return (
        out.withColumn("queue_id", F.coalesce(queue, F.concat(F.lit("Q-"), F.substring(legacy_key, 1, 12))))
        .withColumn("idempotency_key", F.when(F.col("is_batch"), F.sha2(parts, 256)).otherwise(legacy_key))
        .select(
            "queue_id",
            F.coalesce(m("message_id"), F.concat(F.lit("MSG-"), "queue_id")).alias("message_id"),
            F.when(F.col("is_batch"), F.coalesce(m("correlation_id"), "queue_id")).otherwise(F.col("queue_id")).alias("correlation_id"),
            F.when(F.col("is_batch"), F.coalesce(m("source_system"), F.lit("ELVIS"))).otherwise(F.coalesce(m("AI_SCAN_APP"), F.lit("VISION"))).alias("source_system"),
            "idempotency_key",
            F.when(F.col("is_batch"), m("pv_no")).otherwise(m("DOC_NO")).alias("business_entity_id"),
            F.when(F.col("is_batch"), context("transaction_type")).otherwise(m("TRANS_TYPE_CD")).alias("transaction_type"),
            context("vendor_name").alias("vendor_name"),
            context("total_amount").try_cast("double").alias("total_amount"),
            "docs",
        )
    )


def request_documents(requests: DataFrame) -> DataFrame:
    return requests.select("queue_id", F.posexplode_outer("docs").alias("pos", "d")).select("queue_id", "d.*")
