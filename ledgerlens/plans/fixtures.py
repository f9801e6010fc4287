"""Document-verification inputs derived from the star-schema tables, in Spark, and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NET = "decimal(18,2)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, subtotal, discount, tax, total of every order with line items; every tenth total is off by 1000."""
    price, share, tax = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_discount").cast("decimal(4,2)"), F.col("l_tax").cast("decimal(4,2)")
    parts = (
        read(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("doc_id"))
        .agg(F.round(F.sum(price), 2).cast(NET).alias("subtotal"), F.round(F.sum(price * share), 2).cast(NET).alias("discount"), F.round(F.sum(price * (1 - share) * tax), 2).cast(NET).alias("tax"))
    )
    wrong = F.when(F.col("doc_id") % 10 == 0, 1000).otherwise(0)
    return parts.withColumn("total", (F.col("subtotal") - F.col("discount") + F.col("tax") + wrong).cast(NET))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with the order's date, customer and status: what each invoice text states."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey", "o_orderstatus", F.to_date("o_orderdate").alias("day"), "o_totalprice")
    return amounts(spark, sf_dir).join(orders, "doc_id")


def invoice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_number, raw_text: one rendered invoice page per order."""
    rupiah = lambda c: F.concat(F.lit("Rp "), F.format_number(F.col(c), 2))
    key = F.col("doc_id")
    lines = F.array(
        F.concat(F.lit("Invoice No: INV/"), key, F.lit("/"), F.year("day")),
        F.concat(F.when(key % 17 == 0, "Due Date: ").otherwise("Invoice Date: "), F.date_format("day", "dd/MM/yyyy")),
        F.concat(F.lit("Subtotal: "), rupiah("subtotal")),
        F.concat(F.lit("Discount: "), rupiah("discount")),
        F.concat(F.lit("PPN: "), rupiah("tax")),
        F.concat(F.lit("Grand Total: "), rupiah("total")),
        F.when(key % 13 == 0, F.concat(F.lit("Grand Total: Rp "), F.format_number(F.col("total") + 500, 2))),
    )
    return invoices(spark, sf_dir).select("doc_id", F.lit(1).alias("page_number"), F.array_join(F.array_compact(lines), "\n").alias("raw_text"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (image), object_type, confidence 0 to 100 and box from embeddings."""
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    x1, y1 = F.abs(e(0)), F.abs(e(1))
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("det_id"),
        F.floor(F.col("vec_id") / 8).cast("long").alias("doc_id"),
        F.get(F.array(*[F.lit(c) for c in ("signature", "stamp", "materai", "barcode")]), F.pmod("label", F.lit(4))).alias("object_type"),
        F.round(F.least(F.abs(e(4)) * 300, F.lit(100.0)), 2).alias("confidence"),
        F.array(x1, y1, x1 + 0.1 + F.abs(e(2)), y1 + 0.1 + F.abs(e(3))).alias("box"),
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth boxes: every second detection, moved a little, or far for every tenth."""
    dx = F.when(F.col("det_id") % 10 == 0, 0.5).otherwise(0.02)
    box = F.array(F.get("box", F.lit(0)) + dx, F.get("box", F.lit(1)), F.get("box", F.lit(2)) + dx, F.get("box", F.lit(3)))
    return detections(spark, sf_dir).filter("det_id % 2 = 0").select(F.col("det_id").alias("target_id"), "doc_id", "object_type", box.alias("box"))


DUCK = {
    "fx_amounts": """SELECT doc_id, subtotal, discount, tax, CAST(subtotal - discount + tax + CASE WHEN doc_id % 10 = 0 THEN 1000 ELSE 0 END AS DECIMAL(18,2)) AS total FROM (
  SELECT l_orderkey AS doc_id, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2))), 2) AS DECIMAL(18,2)) AS subtotal,
  CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS discount,
  CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * CAST(l_tax AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS tax FROM lineitem GROUP BY 1)""",
    "fx_invoices": """SELECT a.*, o_custkey, o_orderstatus, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM fx_amounts a JOIN orders ON o_orderkey = doc_id""",
    "fx_detections": """SELECT vec_id AS det_id, CAST(vec_id // 8 AS BIGINT) AS doc_id, ['signature','stamp','materai','barcode'][label % 4 + 1] AS object_type,
  round(least(abs(CAST(embedding[5] AS DOUBLE)) * 300, 100.0), 2) AS confidence,
  abs(CAST(embedding[1] AS DOUBLE)) AS x1, abs(CAST(embedding[2] AS DOUBLE)) AS y1,
  abs(CAST(embedding[1] AS DOUBLE)) + 0.1 + abs(CAST(embedding[3] AS DOUBLE)) AS x2, abs(CAST(embedding[2] AS DOUBLE)) + 0.1 + abs(CAST(embedding[4] AS DOUBLE)) AS y2 FROM embeddings""",
    "fx_targets": """SELECT det_id AS target_id, doc_id, object_type, x1 + dx AS x1, y1, x2 + dx AS x2, y2 FROM (SELECT *, CASE WHEN det_id % 10 = 0 THEN 0.5 ELSE 0.02 END AS dx FROM fx_detections) WHERE det_id % 2 = 0""",
    "fx_winners": """SELECT doc_id, 'document_number' AS field_name, 'INV/' || doc_id || '/' || year(day) AS value, 'FOUND' AS status, 1.0 AS confidence FROM fx_invoices
  UNION ALL SELECT doc_id, 'transaction_date', CAST(day AS VARCHAR), 'FOUND', 0.9 FROM fx_invoices WHERE doc_id % 17 <> 0
  UNION ALL SELECT doc_id, 'transaction_amount',
    CAST(CASE WHEN doc_id % 13 = 0 AND doc_id % 10 <> 0 THEN total + 500 ELSE total END AS VARCHAR),
    CASE WHEN doc_id % 13 = 0 THEN 'AMBIGUOUS' ELSE 'FOUND' END,
    CASE WHEN doc_id % 13 = 0 THEN 0.5 WHEN doc_id % 10 = 0 THEN 1.0 ELSE 0.995 END FROM fx_invoices""",
}
_NEEDS = {"fx_invoices": ["fx_amounts"], "fx_targets": ["fx_detections"], "fx_winners": ["fx_amounts", "fx_invoices"]}


def duck(body: str) -> str:
    """body with the common table expressions that it names before it."""
    wanted: list[str] = []
    for name in DUCK:
        if name in body:
            wanted += [n for n in [*_NEEDS.get(name, []), name] if n not in wanted]
    return ("WITH " + ",\n".join(f"{n} AS ({DUCK[n]})" for n in wanted) + "\n" if wanted else "") + body
