"""Text functions against values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import measures as M
from ledgerlens.functions import text as T
from ledgerlens.operators import extract as X


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("out")).orderBy("i").select("out").collect()]


def test_money_separators(spark):
    given = ["1.234", "1.23", "1.234.567,89", "1,234,567.8", "12,5", "1,234", "0", "abc", None, "1.234.56"]
    found = column(spark, given, T.parse_money)
    assert [None if v is None else float(v) for v in found] == [1234.0, 1.23, 1234567.89, 1234567.8, 12.5, 1234.0, 0.0, None, None, 1234.56]


def test_money_prefers_currency_and_skips_percent(spark):
    given = ["PPN 11% Rp 1.100", "qty 3 price 5000", "11%", "USD 12.50 or IDR 20"]
    assert [None if v is None else float(v) for v in column(spark, given, T.money)] == [1100.0, 5000.0, None, 20.0]
    assert float(column(spark, given[3:], lambda c: T.money(c, first=True))[0]) == 12.5


def test_currency_codes(spark):
    assert column(spark, ["Rp. 5", "$ 5", "5 EUR", "¥ 3", "none 5"], T.currency) == ["IDR", "USD", "EUR", "JPY", None]


@pytest.mark.parametrize(
    ("text", "day"),
    [("Date: 31/01/2024", "2024-01-31"), ("2024-2-3", "2024-02-03"), ("1 Agustus 2026", "2026-08-01"), ("Mar 5, 2024", "2024-03-05"), ("3-Jan-99", "1999-01-03"), ("01.02.68", "2068-02-01"), ("32/01/2024", None), ("nothing", None)],
)
def test_dates(spark, text, day):
    assert column(spark, [text], T.parse_date) == [None if day is None else datetime.date.fromisoformat(day)]


def test_labels(spark):
    assert column(spark, ["lnv0ice", "Inv0ice  N0:", "GRAND-T0TAL"], T.norm_label)[1:] == ["invoice no", "grand total"]
    fields = column(spark, ["Invoice No", "Grand Total", "Tgl", "Colour", "Supplier name"], lambda c: T.label_field(c)["field"])
    assert fields == ["document_number", "transaction_amount", "transaction_date", None, "vendor_name"]
    roles = column(spark, ["Sub Total", "Total PPN", "Total", "Amount Due:", "due date"], lambda c: T.amount_role(c)["role"])
    assert roles == ["subtotal", "tax", "final_total", "final_total", None]
    assert column(spark, ["Jatuh tempo 1", "Tanggal Faktur", "date"], lambda c: T.date_role(c)["role"]) == ["due_date", "issue_date", "generic_date"]


def test_document_numbers(spark):
    given = ["No. INV / 12 - 3", "12/03/2024", "Rp 500", "25%", "ref: AB-99x and 7", "plain"]
    assert column(spark, given, T.parse_document_number) == ["INV/12-3", None, None, None, "AB-99x and 7", None]


def test_scales_and_levels(spark):
    values = [0.5, 1.0, 97.0, 85.0, 60.0, 1.5, None]
    assert column(spark, values, M.to_percent, "double") == [50.0, 100.0, 97.0, 85.0, 60.0, 1.5, None]
    assert column(spark, values, M.confidence_level, "double") == ["Low", "Low", "Very High", "High", "Medium", "Low", None]
    assert column(spark, [1, 2, 5, 9], lambda c: M.backoff_seconds(c, 3600), "int") == [30, 60, 480, 3600]


def test_names_and_keys(spark):
    assert column(spark, ["a.PDF", "b.jpeg", "c"], T.mime_from_name) == ["application/pdf", "image/jpeg", "application/octet-stream"]
    assert column(spark, ["http://h/x/y.pdf?a=1", "http://h/"], T.name_from_url)[0] == "y.pdf"
    a, b = column(spark, ["x", None], lambda c: T.idempotency_key(c, F.lit(1)))
    assert a != b and len(b) == 64


def test_known_phrases_equal_a_plain_loop(spark):
    """One search finds at every word all phrases that stand there, also those with which longer ones begin."""
    lines = ["grand total payable", "invoice no inv no invoice serial number", "totals", "xinvoice no", "sub total invoice date", "", "nomor nota invoice amount"]
    found = spark.createDataFrame([(x,) for x in lines], "n string").select("n", T.known_phrases(F.col("n"))["phrase"].alias("p")).collect()
    for row in found:
        assert sorted(row.p) == sorted(p for p in T._KNOWN if f" {p} " in f" {row.n} "), row.n


def test_pages_are_spread_over_all_cores(spark):
    """Pages in one small partition feed every core with lines."""
    pages = spark.createDataFrame([(i, 1, "Invoice No: A1") for i in range(200)], "doc_id long, page_number int, raw_text string").coalesce(1)
    lines = X.page_lines(pages)
    assert lines.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert lines.count() == 200
