"""Envelope headers, model quality, blended fields, retention."""

import datetime

from pyspark.sql import functions as F

from ledgerlens.operators import monitoring as N
from ledgerlens.sources import tables as TB

D = datetime.date
DOCS = "job_id long, document_index int, document_id string, document_name string, document_type string, category string, result string"
FAILS = "job_id long, document_index int, rule_order int, rule_name string, cause string"


def test_envelope_header(spark):
    docs = [(1, 0, "A", "a.pdf", "INVOICE", "main", "OK"), (1, 1, "B", "b.pdf", "Delivery Note", "second", "NG"), (1, 2, "C", None, "Delivery Note", "second", "NG"), (2, 0, "D", "d", None, None, "OK")]
    fails = [(1, 1, 6, "Stamp", "stamp"), (1, 1, 2, "Amount", None), (1, 1, 9, "Period", "period"), (3, 0, 1, "Amount", "stamp")]
    rows = {r.job_id: r for r in N.envelope_header(spark.createDataFrame(docs, DOCS), spark.createDataFrame(fails, FAILS), ["stamp", "period", "never"], ["period", "never"]).collect()}
    one, two = rows[1], rows[2]
    assert set(rows) == {1, 2}
    assert (one.total_documents, one.ok_documents, one.ng_documents, one.main_document_ok, one.main_document_ng, one.second_document_ok, one.second_document_ng) == (3, 1, 2, 1, 0, 0, 2)
    assert one.validation_summary == {"invoice": "OK", "delivery_note_1": "NG", "delivery_note_2": "NG", "period": "NG", "never": "OK"}
    assert [(d.document_id, d.document_name, d.reason) for d in one.failed_documents] == [("B", "b.pdf", ["Amount", "Stamp", "Period"]), ("C", None, [])]
    assert one.failed_validation_summary == {"stamp": 1, "period": 1, "never": 0}
    assert one.ai_note == "AI Verification completed with validation failures on 2 of 3 submitted documents. delivery_note_1 failed because of: Amount, Stamp, Period. delivery_note_2 failed."
    assert (two.validation_summary, two.failed_documents, two.failed_validation_summary) == ({"document": "OK", "period": "OK", "never": "OK"}, [], {"stamp": 0, "period": 0, "never": 0})
    assert two.ai_note == "AI Verification completed. All 1 submitted documents passed."
    assert N.envelope_header(spark.createDataFrame([], DOCS), spark.createDataFrame([], FAILS), ["stamp"], []).count() == 0


def test_model_quality(spark):
    docs = spark.createDataFrame([(1, "OK", 80.0, "x"), (2, "OK", None, "x"), (3, "NG", 60.0, "x"), (4, "NG", 10.0, None)], "doc_id long, result string, confidence double, vendor string")
    fields = spark.createDataFrame([(1, "FOUND"), (1, None), (2, "FOUND"), (9, "FOUND")], "doc_id long, status string")
    seen = spark.createDataFrame([(1, "stamp"), (1, "stamp"), (3, "barcode")], "doc_id long, object_type string")
    barcodes = spark.createDataFrame([(3, True), (3, None)], "doc_id long, decoded boolean")
    reviews = spark.createDataFrame([(1, "OK"), (1, "NG"), (2, "OK"), (3, "OK"), (7, "NG")], "doc_id long, truth string")
    got = {r.vendor: r for r in N.model_quality(docs, fields, seen, barcodes, reviews, ["stamp", "materai"], ("vendor",)).collect()}
    x = got["x"]
    assert (x.documents, x.mean_confidence, x.field_success_rate, x.stamp_count, x.materai_count, x.decoded_rate) == (3, 70.0, 0.666667, 2, 0, 0.5)
    assert (x.reviewed, x.false_ok_rate, x.false_ng_rate) == (3, 0.5, 1.0)
    bare = got[None]
    assert (bare.documents, bare.field_success_rate, bare.stamp_count, bare.decoded_rate, bare.reviewed, bare.false_ok_rate, bare.false_ng_rate) == (1, None, 0, None, 0, None, None)


def test_blended_fields(spark):
    schema = "doc_id long, page_number int, field_name string, value string, pattern_confidence double, layout_confidence double, format_valid boolean"
    rows = [(1, 1, "n", "low", 0.2, 0.5, True), (1, 2, "n", "b", 1.0, None, True), (1, 2, "n", "a", 1.0, None, True), (1, 3, "n", "c", 1.0, 0.0, True), (2, 1, "n", None, None, None, None)]
    pages = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.8), (1, 3, 0.8), (1, 4, 1.0)], "doc_id long, page_number int, average_confidence double")
    got = {(r.doc_id, r.field_name): (r.value, r.page_number, r.confidence, r.n_candidates) for r in N.blended_fields(spark.createDataFrame(rows, schema), pages).collect()}
    assert got == {(1, "n"): ("a", 2, 0.71, 4), (2, "n"): (None, 1, 0.0, 1)}


def test_expiry_by_date(spark, tmp_path):
    """Of 200 days with rows of six terms exactly the unexpired rows stay; young dates' files aren't touched, emptied dates are gone."""
    today, path = D(2024, 7, 1), f"{tmp_path}/letters"
    days = [today - datetime.timedelta(days=n) for n in [0, 1, 29, 30, 31, 45, 46, 60, 89, 90, 91, 120, 200]]
    terms = [0, 30, 45, 90, 500, None]
    rows = [(f"{d}-{t}", t, d) for d in days for t in terms] + [("short", 31, D(2024, 5, 20)), ("undated", 1, None)]
    TB.write_dates(spark.createDataFrame(rows, "k string, term int, created_date date"), path, ["k"])
    young = {f.name for d in (days[0], days[3]) for f in (tmp_path / "letters" / f"created_date={d}").iterdir()}
    want = sorted(k for k, t, d in rows if d is None or (today - d).days <= min(90, max(30, 90 if t is None else t)))
    for _ in range(2):
        TB.expire_rows(spark, path, today, F.col("term"), ["k"])
        assert sorted(r.k for r in spark.read.parquet(path).select("k").collect()) == want
    left = {p.name for p in (tmp_path / "letters").iterdir() if p.is_dir()}
    assert {f"created_date={d}" for d in (days[10], days[11], days[12], D(2024, 5, 20))} & left == set()
    assert {f.name for d in (days[0], days[3]) for f in (tmp_path / "letters" / f"created_date={d}").iterdir()} == young
