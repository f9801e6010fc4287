"""Tokens, display rows, looked-up results, thresholds, layouts."""

import json


from ledgerlens.operators import extract as X
from ledgerlens.operators import resolve as W
from ledgerlens.operators import results as R
from ledgerlens.operators import verify as O
from ledgerlens.storage import stored

PAGES = f"doc_id long, page_number int, raw_text string, tokens_json {X.TOKENS}"


def word(text, x, y, space="pdf_points", wide=40.0, block=None):
    return (text, [float(x), float(y), x + wide, y + 10.0], space, block)


def lines_of(spark, *pages):
    return [(r.page_number, r.line_no, r.line, r.block_id) for r in X.token_lines(spark.createDataFrame([(1, i + 1, *p) for i, p in enumerate(pages)], PAGES)).orderBy("page_number", "line_no").collect()]


def test_lines_from_tokens(spark):
    native = [word("Total:", 0, 20), word("b", 50, 1), word("a", 0, 0), word("9", 50, 22)]
    blocks = [word("000 x\n\n 0y ", 0, 0, None), word("", 0, 0, None), word("z", 0, 50, None, block="k7")]
    mixed = [word("Total:", 0, 20), ("no box", None, "pdf_points", None)]
    assert lines_of(spark, ("text", native), ("text", blocks), ("text", mixed), (" first \n\nsecond", None), ("only text", []), (None, None)) == [
        (1, 1, "a b", "pdf-row-1"), (1, 2, "Total: 9", "pdf-row-2"), (2, 1, "000 x", "b1"), (2, 2, "0y", "b1"), (2, 3, "z", "k7"),
        (3, 1, "Total:", "b1"), (3, 2, "no box", "b2"), (4, 1, "first", "line-1"), (4, 2, "second", "line-3"), (5, 1, "only text", "line-1"),
    ]


def test_layout_producers(spark):
    """A block right of or below its label is its value, one far away isn't; words of a PDF feed no split amounts."""
    column = lambda space: [word("Subtotal", 0, 0, space), word("Rp 900", 300, 30, space)]
    cases = {
        1: [word("Grand Total", 0, 0, None), word("Rp 5.000", 100, 0, None)],
        2: [word("Invoice Number", 0, 0, None), word("FX/77", 0, 12, None)],
        3: [word("Grand Total", 0, 0, None), word("Rp 7.000", 500, 200, None)],
        4: column(None),
        5: column("pdf_points"),
    }
    pages = spark.createDataFrame([(i, 1, None, tokens) for i, tokens in cases.items()], PAGES)
    raw = stored(X.all_candidates(X.token_lines(pages), X.page_tokens(pages)))
    won = {(r.doc_id, r.field_name): (r.value, r.status) for r in W.resolved(raw).collect()}
    assert won[1, "transaction_amount"] == ("5000.00", "FOUND") and won[2, "document_number"] == ("FX/77", "FOUND")
    methods = {(r.doc_id, r.extraction_method) for r in raw.collect()}
    assert (3, "spatial_label_value") not in methods and (4, "split_financial") in methods and (5, "split_financial") not in methods


def test_document_ocr(spark):
    pages = [(1, 2, "b", ["x"], None, "late"), (1, 1, "a", ["y", "z"], 0.5, None), (1, 3, None, None, 1.0, "later"), (2, 1, "", [], None, None)]
    rows = {r.doc_id: r for r in R.document_ocr(spark.createDataFrame(pages, "doc_id long, page_number int, raw_text string, tokens array<string>, average_confidence double, error string")).collect()}
    assert (rows[1].text, rows[1].average_confidence, rows[1].error, rows[1].n_pages) == ("a\nb", 0.75, "late", 3)
    assert [tuple(t) for t in rows[1].tokens] == [(1, 1, "y"), (1, 2, "z"), (2, 3, "x")]
    assert (rows[2].text, rows[2].tokens, rows[2].average_confidence) == ("", [], None)


def test_display_and_job_result(spark):
    body = {"documents": [{"document_name": "A.Pdf", "pages": [{"ocr": {"status": "SUCCESS", "average_confidence": 91}, "detections": [{}]}, {"page_number": 9}]}, {"file_information": {"file_name": "b", "file_size_bytes": 1536}}], "processing": {"duration_ms": 7}}
    docs = R.display_documents(spark.createDataFrame([(1, json.dumps(body)), (2, "{}"), (3, None)], "job_id long, envelope string"))
    rows = [(r.file_name, r.extension, r.size_kb, r.page_count, r.has_ocr, r.has_detection, r.status, r.processing_time_ms) for r in docs.orderBy("document_index").collect()]
    assert rows == [("A.Pdf", ".pdf", 0.0, 2, True, True, "FAILED", 7), ("b", "", 1.5, 0, False, False, "FAILED", 7)]
    assert [(r.page_number, r.raw_text, r.avg_confidence, len(r.detections)) for r in R.display_pages(docs).orderBy("page_number").collect()] == [(1, "(empty)", 91.0, 1), (9, "(empty)", 0.0, 0)]
    finals = [("root", {"pages": [1, 2], "documents": [{"pages": [3]}]}), ("first", {"documents": [{"pages": [3]}, {"pages": [4, 5]}], "summary": {"n": 2}}), ("none", {}), ("bare", {"documents": [{}]})]
    out = {r.queue_id: (r.pages, r.documents is not None, r.summary) for r in R.job_result(spark.createDataFrame([(q, json.dumps(b)) for q, b in finals], "queue_id string, internal_result_json string")).collect()}
    assert out == {"root": (["1", "2"], True, None), "first": (["3"], True, '{"n":2}'), "none": ([], False, None), "bare": ([], True, None)}


def test_counts_below_thresholds(spark):
    values = spark.createDataFrame([(v,) for v in (1.0, 1.0, 2.5, None, 9.0)], "v double")
    asked = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 9.5), ("d", -1.0), ("e", 9.0)], "scenario string, threshold double")
    assert {r.scenario: r.below for r in R.counts_below(values, "v", asked).collect()} == {"a": 0, "b": 2, "c": 4, "d": 0, "e": 3}


def test_rule_configuration_is_one_row(spark):
    docs = spark.createDataFrame([(1, 50.0), (2, None), (3, 70.0)], "doc_id long, confidence double")
    assert sorted(r.doc_id for r in O.confidence_rule_failures(docs, 70.0).collect()) == [1, 2]
    one = spark.createDataFrame([(3,)], "signature_count int")
    assert O.with_config(docs, one).first().cfg_signature_count == 3
    assert O.with_config(docs, one.filter("false")).first().cfg_signature_count == 2
    try:
        O.with_config(docs, one.union(one)).collect()
    except Exception as e:  # noqa: BLE001
        assert "several rule configurations" in str(e)
    else:
        raise AssertionError("two configurations must stop the query")


def test_stamp_colour(spark):
    stamps = spark.createDataFrame([(1, 0.1), (1, 0.9), (2, 0.1), (3, None)], "doc_id long, color_ratio double")
    assert sorted(r.doc_id for r in O.stamp_color_failures(stamps, 0.15).collect()) == [2, 3]
