"""Queries over rendered invoices: candidates, winners, reconciliation, audit, grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import measures as M
from ledgerlens.functions import text as T
from ledgerlens.operators import extract as X
from ledgerlens.operators import resolve as R
from ledgerlens.plans import fixtures as fx
from ledgerlens.storage import cut, stored

D = "double"


def _lines(spark, sf):
    return X.page_lines(fx.invoice_pages(spark, sf))


def _raw(spark, sf):
    return X.all_candidates(_lines(spark, sf))


def _once(spark, sf):
    """Reconciled candidates, to be read once."""
    return R.reconcile(R.dedup_candidates(_raw(spark, sf)))


def _clean(spark, sf):
    """Reconciled candidates, stored for queries that read them several times."""
    return stored(_once(spark, sf))


def invoice_fields(spark, sf):
    """The winner of each field of each invoice."""
    return R.winners(_once(spark, sf)).select("doc_id", "field_name", "value", "status", F.round("confidence", 4).alias("confidence"))


def invoice_lines_roles(spark, sf):
    """How many lines have each amount or date role."""
    lines = _lines(spark, sf)
    role = F.coalesce(T.amount_role(F.col("line"))["role"], T.date_role(F.col("line"))["role"], F.lit("none"))
    return lines.withColumn("role", role).groupBy("role").agg(F.count("*").alias("n_lines"))


def candidate_dedup(spark, sf):
    """Candidates left per field after removal of weaker copies."""
    return R.dedup_candidates(_raw(spark, sf)).groupBy("field_name", F.coalesce("amount_role", F.lit("-")).alias("amount_role")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def top_alternatives(spark, sf):
    """The ranked amounts of ambiguous invoices."""
    pool = _clean(spark, sf)
    unsure = R.winners(pool).filter("status = 'AMBIGUOUS'").select("doc_id", "field_name")
    return R.alternatives(pool).join(unsure, ["doc_id", "field_name"], "left_semi").select("doc_id", "rank", F.col("value").cast(D).alias("value"))


def payable_reconciliation(spark, sf):
    """Expected payable amount from its parts."""
    amounts = X.all_candidates(_lines(spark, sf), amounts_only=True)
    return R.expected_payable(R.dedup_candidates(amounts)).select("doc_id", "currency", F.round("expected", 2).alias("expected"), "validation")


def invoice_financials(spark, sf):
    pool = _clean(spark, sf)
    f = R.financials(pool, R.winners(pool))
    return f.select("doc_id", "subtotal", "final_total", F.get("taxes", F.lit(0)).alias("tax"), F.get("discounts", F.lit(0)).alias("discount"), "currency", "reconciliation")


def candidate_audit(spark, sf):
    pool = _clean(spark, sf)
    return R.candidate_audit(pool, R.winners(pool)).groupBy("field_name", "selection_status").agg(F.count("*").alias("n"))


def candidate_ids(spark, sf):
    """The ids of number candidates. Ids, order and copies are settled within a field, and reconciliation is of amounts only, so no other field is extracted."""
    numbers = _raw(spark, sf).filter("field_name = 'document_number'")
    return R.candidate_ids(R.dedup_candidates(numbers)).select("doc_id", "candidate_id", "value")


def apply_decisions(spark, sf):
    """A decision picks the first amount candidate of every third invoice (the subtotal: refused) and the second otherwise ambiguous total."""
    pool = R.candidate_ids(_clean(spark, sf))
    picks = pool.filter("field_name = 'transaction_amount' and amount_role in ('final_total', 'subtotal') and doc_id % 3 = 0")
    decisions = picks.select("doc_id", F.col("ordinal").alias("decision_no"), "field_name", "candidate_id", F.lit("SELECT").alias("action"))
    out = R.apply_decisions(R.winners(pool), pool, decisions).filter("field_name = 'transaction_amount'")
    return out.select("doc_id", F.col("value").cast(D).alias("value"), F.round("score", 4).alias("score"), "status", "overrides", "rejected")


def fallback_fields(spark, sf):
    docs = fx.invoices(spark, sf).select("doc_id")
    return R.fallback_fields(docs, R.winners(_once(spark, sf))).groupBy("field_name", "status", "reason_code", "manual_review_required").agg(F.count("*").alias("n"))


def document_numbers(spark, sf):
    """Numbers by pattern from lines without a label:value form."""
    base = fx.invoices(spark, sf).select("doc_id", F.lit(1).alias("page_number"), F.concat(F.lit("Invoice # INV-"), "doc_id", F.lit(" issued\nDO-"), "doc_id", F.lit("/X\nsettled 25% today")).alias("raw_text"))
    return X.document_number_candidates(X.line_facts(X.page_lines(base))).select("doc_id", "line_no", F.col("value_str").alias("number"))


def neighbour_context(spark, sf):
    """A value on the line after its label."""
    base = fx.invoices(spark, sf).select("doc_id", F.lit(1).alias("page_number"), F.concat(F.lit("Amount Due\nRp "), F.format_number("total", 2), F.lit("\nthank you")).alias("raw_text"))
    found = X.context_candidates(X.line_facts(X.page_lines(base))).filter("label_distance = 1 and source_label = 'amount due'")
    return found.select("doc_id", F.col("value_num").cast(D).alias("amount"), "score", "label_relation", "candidate_only")


def split_financials(spark, sf):
    """Labels and values in separate blocks of one column."""
    base = fx.invoices(spark, sf).select("doc_id", F.lit(1).alias("page_number"), F.concat(F.lit("Subtotal\nRp "), F.format_number("subtotal", 2), F.lit("\nGrand Total\nRp "), F.format_number(F.col("total") + 7, 2)).alias("raw_text"))
    return X.split_financials(X.line_facts(X.page_lines(base))).select("doc_id", "amount_role", F.col("value_num").cast(D).alias("amount"))


def adjacent_pairs(spark, sf):
    """Pairs of neighbouring boxes of an image that stand in one row or one below the other."""
    d = fx.detections(spark, sf)
    lines = d.select("doc_id", F.lit(1).alias("page_number"), F.col("det_id").alias("line_no"), F.col("det_id").cast("string").alias("line"), F.transform("box", lambda x: x * 100).alias("bbox"), F.col("det_id").cast("string").alias("block_id"))
    return X.adjacent_pairs(lines).select("doc_id", F.col("line").alias("first"), F.col("next_line").alias("second"))


def row_rebuild(spark, sf):
    """Word boxes of an image as text rows."""
    d = fx.detections(spark, sf).select("doc_id", F.lit(1).alias("page_number"), F.col("det_id").cast("string").alias("text"), F.transform("box", lambda x: x * 100).alias("bbox"))
    return X.rebuild_rows(d).select("doc_id", "row_no", "line")


def text_usability(spark, sf):
    docs = fx.read(spark, sf, "documents")
    return docs.select("doc_id", T.text_usable(F.col("text")).alias("usable"))


def visual_ocr_needed(spark, sf):
    won = stored(R.winners(_once(spark, sf)).select("doc_id", "field_name", "status", "amount_role"))
    pages = stored(R.unsettled(fx.invoice_pages(spark, sf), won))
    return R.needs_visual_ocr(pages, X.label_hits(X.page_lines(pages)), won).select("doc_id", "page_number")


def evidence_grounding(spark, sf):
    """Benchmark passages that stand in documents."""
    passages = fx.read(spark, sf, "benchmark").select(F.col("item_id").alias("passage_id"), "text")
    return R.containment(passages, fx.read(spark, sf, "documents").select("doc_id", "text"))


def grounded_values(spark, sf):
    """Proposed totals and dates, the due ones among them refused."""
    pages = fx.invoice_pages(spark, sf)
    day = F.date_format("day", "dd/MM/yyyy")
    money = F.concat(F.lit("Rp "), F.format_number("total", 2))
    base = fx.invoices(spark, sf).withColumn("p", F.explode(F.array(F.struct(F.lit("transaction_amount").alias("field_name"), money.alias("raw_value"), F.concat(F.lit("Grand Total: "), money).alias("evidence_quote")), F.struct(F.lit("transaction_date").alias("field_name"), day.alias("raw_value"), F.concat(F.when(F.col("doc_id") % 17 == 0, "Due Date: ").otherwise("Invoice Date: "), day).alias("evidence_quote")))))
    found = R.grounded(pages, base.select("doc_id", F.lit(1).alias("page_number"), "p.*"))
    return found.groupBy("field_name").agg(F.count("*").alias("n"), F.min("value").alias("least"))


def quality_scores(spark, sf):
    """Image quality from statistics that stand in the order table."""
    o = fx.read(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 70).cast(D).alias("lap"), (F.col("o_custkey") % 256).cast(D).alias("gray"), (F.lit(600) + F.col("o_orderkey") % 1400).alias("w"), (F.lit(800) + F.col("o_custkey") % 1200).alias("h"), (F.col("o_orderkey") % 50).alias("colored"), (F.lit(1000) + F.col("o_custkey") % 1000).alias("visible"))
    return o.select("doc_id", *[c.alias(n) for n, c in M.quality_scores(*[F.col(c) for c in ("lap", "gray", "w", "h", "colored", "visible")]).items()])


QUERIES = {f.__name__: f for f in (
    invoice_fields, invoice_lines_roles, candidate_dedup, top_alternatives, payable_reconciliation, invoice_financials, candidate_audit, candidate_ids, apply_decisions,
    fallback_fields, document_numbers, neighbour_context, split_financials, adjacent_pairs, row_rebuild, text_usability, visual_ocr_needed, evidence_grounding, grounded_values, quality_scores,
)}

ORACLES = {
    "invoice_fields": fx.duck("SELECT doc_id, field_name, value, status, CAST(confidence AS DOUBLE) AS confidence FROM fx_winners"),
    "invoice_lines_roles": fx.duck("""SELECT role, sum(n)::BIGINT AS n_lines FROM (
  SELECT 'none' AS role, count(*) AS n FROM fx_invoices UNION ALL SELECT 'subtotal', count(*) FROM fx_invoices UNION ALL SELECT 'discount', count(*) FROM fx_invoices
  UNION ALL SELECT 'tax', count(*) FROM fx_invoices UNION ALL SELECT 'final_total', count(*) + count(*) FILTER (doc_id % 13 = 0) FROM fx_invoices
  UNION ALL SELECT CASE WHEN doc_id % 17 = 0 THEN 'due_date' ELSE 'issue_date' END, count(*) FROM fx_invoices GROUP BY 1) GROUP BY role"""),
    "candidate_dedup": fx.duck("""SELECT field_name, amount_role, sum(n)::BIGINT AS n, max(d)::BIGINT AS n_docs FROM (
  SELECT 'document_number' AS field_name, '-' AS amount_role, count(*) AS n, count(*) AS d FROM fx_invoices UNION ALL SELECT 'transaction_date', '-', count(*), count(*) FROM fx_invoices
  UNION ALL SELECT 'transaction_amount', unnest(['subtotal','discount','tax']), count(*), count(*) FROM fx_invoices
  UNION ALL SELECT 'transaction_amount', 'final_total', count(*) + count(*) FILTER (doc_id % 13 = 0), count(*) FROM fx_invoices) GROUP BY ALL"""),
    "top_alternatives": fx.duck("""SELECT doc_id, CAST(r AS INTEGER) AS rank, CAST(CASE WHEN (r = 1) = (doc_id % 10 <> 0) THEN total + 500 ELSE total END AS DOUBLE) AS value FROM fx_invoices, range(1, 3) t(r) WHERE doc_id % 13 = 0"""),
    "payable_reconciliation": fx.duck("SELECT doc_id, 'IDR' AS currency, round(CAST(subtotal - discount + tax AS DOUBLE), 2) AS expected, 'RECONCILED_NET_TOTAL' AS validation FROM fx_invoices"),
    "invoice_financials": fx.duck("""SELECT doc_id, CAST(subtotal AS DOUBLE) AS subtotal, CAST(CASE WHEN doc_id % 13 = 0 AND doc_id % 10 <> 0 THEN total + 500 ELSE total END AS DOUBLE) AS final_total,
  CAST(tax AS DOUBLE) AS tax, CAST(discount AS DOUBLE) AS discount, 'IDR' AS currency, CASE WHEN doc_id % 13 = 0 OR doc_id % 10 = 0 THEN 'UNRECONCILED' ELSE 'RECONCILED_NET_TOTAL' END AS reconciliation FROM fx_invoices"""),
    "candidate_audit": fx.duck("""SELECT field_name, selection_status, sum(n)::BIGINT AS n FROM (
  SELECT 'document_number' AS field_name, 'SELECTED' AS selection_status, count(*) AS n FROM fx_invoices
  UNION ALL SELECT 'transaction_date', CASE WHEN doc_id % 17 = 0 THEN 'NOT_SELECTED' ELSE 'SELECTED' END, count(*) FROM fx_invoices GROUP BY 2
  UNION ALL SELECT 'transaction_amount', 'SELECTED', count(*) FROM fx_invoices UNION ALL SELECT 'transaction_amount', 'NOT_SELECTED', 3 * count(*) + count(*) FILTER (doc_id % 13 = 0) FROM fx_invoices) GROUP BY ALL"""),
    "candidate_ids": fx.duck("SELECT doc_id, 'document_number-1' AS candidate_id, 'INV/' || doc_id || '/' || year(day) AS value FROM fx_invoices"),
    "apply_decisions": fx.duck("""SELECT doc_id, CAST(CASE WHEN doc_id % 13 = 0 AND (doc_id % 10 <> 0 OR doc_id % 3 = 0) THEN total + 500 ELSE total END AS DOUBLE) AS value,
  CAST(CASE WHEN doc_id % 13 = 0 OR doc_id % 10 = 0 THEN 1.0 ELSE 0.995 END AS DOUBLE) AS score,
  CASE WHEN doc_id % 3 <> 0 AND doc_id % 13 = 0 THEN 'AMBIGUOUS' ELSE 'FOUND' END AS status, doc_id % 3 = 0 AND doc_id % 13 = 0 AND doc_id % 10 = 0 AS overrides,
  CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS rejected FROM fx_invoices"""),
    "fallback_fields": fx.duck("""SELECT f AS field_name, coalesce(w.status, 'NOT_FOUND') AS status, CASE WHEN w.value IS NULL THEN 'REASONING_REQUIRED' ELSE 'DETERMINISTIC_FALLBACK' END AS reason_code, w.value IS NOT NULL AS manual_review_required, count(*) AS n
  FROM (SELECT doc_id, unnest(['document_number','transaction_amount','transaction_date']) AS f FROM fx_invoices) d LEFT JOIN fx_winners w ON w.doc_id = d.doc_id AND w.field_name = d.f GROUP BY ALL"""),
    "document_numbers": fx.duck("SELECT doc_id, 1::INTEGER AS line_no, 'INV-' || doc_id AS number FROM fx_invoices"),
    "neighbour_context": fx.duck("SELECT doc_id, CAST(total AS DOUBLE) AS amount, CAST(0.96 AS DOUBLE) AS score, 'after_label' AS label_relation, false AS candidate_only FROM fx_invoices"),
    "split_financials": fx.duck("SELECT doc_id, 'subtotal' AS amount_role, CAST(subtotal AS DOUBLE) AS amount FROM fx_invoices UNION ALL SELECT doc_id, 'final_total', CAST(total + 7 AS DOUBLE) FROM fx_invoices WHERE total + 7 <> subtotal"),
    "adjacent_pairs": fx.duck("""SELECT doc_id, CAST(det_id AS VARCHAR) AS first, CAST(nid AS VARCHAR) AS second FROM (SELECT doc_id, det_id, x1*100 AS a1, y1*100 AS a2, x2*100 AS a3, y2*100 AS a4, lead(det_id) OVER w AS nid, lead(x1*100) OVER w AS b1, lead(y1*100) OVER w AS b2, lead(x2*100) OVER w AS b3, lead(y2*100) OVER w AS b4 FROM fx_detections WINDOW w AS (PARTITION BY doc_id ORDER BY det_id)) WHERE nid IS NOT NULL AND (
  (abs(((a2 + a4) - (b2 + b4)) / 2) <= greatest(20, (a4 - a2) * 1.5) AND b1 >= a1) OR (b2 >= a4 AND abs(((a1 + a3) - (b1 + b3)) / 2) <= greatest(80, (a3 - a1) * 1.5)))"""),
    "text_usability": """SELECT doc_id, length(s) >= 40 AND length(regexp_replace(s, '\\p{C}', '', 'g')) >= 0.98 * length(s) AND length(regexp_replace(s, '[^\\p{L}\\p{N}]', '', 'g')) >= 0.35 * length(s) AND NOT contains(s, chr(65533)) AS usable
  FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\s\\x0b\\x{85}\\p{Z}]+', '', 'g') AS s FROM documents)""",
    "visual_ocr_needed": fx.duck("SELECT doc_id, 1::INTEGER AS page_number FROM fx_invoices WHERE doc_id % 13 = 0 OR doc_id % 17 = 0"),
    "evidence_grounding": """SELECT DISTINCT item_id AS passage_id, doc_id FROM (SELECT item_id, regexp_replace(lower(text), '[^0-9a-z]+', '', 'g') AS p FROM benchmark) b JOIN (SELECT doc_id, regexp_replace(lower(text), '[^0-9a-z]+', '', 'g') AS t FROM documents) d ON p <> '' AND contains(t, p)""",
    "grounded_values": fx.duck("""SELECT 'transaction_amount' AS field_name, count(*) AS n, min(CAST(total AS VARCHAR)) AS least FROM fx_invoices UNION ALL SELECT 'transaction_date', count(*), min(CAST(day AS VARCHAR)) FROM fx_invoices WHERE doc_id % 17 <> 0"""),
    "quality_scores": """SELECT doc_id, round(blur, 2) AS blur_score, round(bright, 2) AS brightness_score, round(res, 2) AS resolution_score, CAST(round(CAST(least(100.0::DOUBLE, blur * 0.5::DOUBLE + bright * 0.3::DOUBLE + res * 0.2::DOUBLE) AS DECIMAL(18,9)), 2) AS DOUBLE) AS page_readability_score, round(ratio, 4) AS colored_pixel_ratio, ratio >= 0.01 AS is_colored FROM (
  SELECT o_orderkey AS doc_id, least(100.0::DOUBLE, greatest(0.0::DOUBLE, CAST(o_orderkey % 70 AS DOUBLE) * 2)) AS blur, 100 - abs(128 - CAST(o_custkey % 256 AS DOUBLE)) / 1.28::DOUBLE AS bright,
  least(100.0::DOUBLE, CAST((600 + o_orderkey % 1400) * (800 + o_custkey % 1200) AS DOUBLE) / 2073600 * 100) AS res, CAST(o_orderkey % 50 AS DOUBLE) / (1000 + o_custkey % 1000) AS ratio FROM orders)""",
}
