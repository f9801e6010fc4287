"""The shortcuts of amounts, currencies and dates against the full patterns, applied by Python."""

import re

from pyspark.sql import functions as F

from ledgerlens.functions import fixed_values as V
from ledgerlens.functions import text as T
from ledgerlens.operators import extract as X
from ledgerlens.storage import stored

TEXTS = [
    "Subtotal: Rp 1,234.56", "Total Rp. 12", "idr.  5", "Rp 5%", "Rp 5 %", "Rp 1,000.00 %", "Rp 10 IDR 20", "12 items USD 5", "US$5", "a$7.5", "$ 1,000.00 and 3", "$ 3 and EUR 4.50",
    "Total 100 usd", "100usd", "Date: 28/02/2000", "INV/85405/2000", "Rp\n 5", "Rp   5", "Rp 1234567890123", "Rp 1,23.45", "Rp 12,345", "€5.00", "5 %, Rp 6", "B 5", "kg 5", "", "no digits", "Rp 5 ٥",
    "Rp.5.5", "xRp 5", "CHF 5", "R$ 9", "3CHF", "HK$1 then 2", "Rp 7.", "Rp 7,", "5 total %",
]


def _expected(text: str, first: bool):
    amounts = [re.search(r"[0-9][0-9.,]*+", m[0])[0] for m in re.finditer(V.CURRENCY_AMOUNT, text, re.ASCII)]
    bare = [m[1] for m in re.finditer(V.BARE_AMOUNT, text, re.ASCII)]
    return (amounts[0] if first else amounts[-1]) if amounts else (bare[-1] if bare else None)


def test_shortcuts_find_the_amounts_of_the_full_patterns(spark):
    c = F.col("text")
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string").select(
        c, T.money_raw(c, first=True).alias("first"), T.money_raw(c).alias("last"), T.has_currency_amount(c).alias("has"), T.currency(c).isNotNull().alias("coded"),
        F.regexp_extract(c, T._LEADING_AMOUNT, 1).alias("leading"), F.regexp_extract(c, T._ONLY_AMOUNT, 1).alias("only"),
    ).collect()
    for r in rows:
        has = re.search(V.CURRENCY_SIGN_AMOUNT, r["text"], re.ASCII) is not None
        assert (r["first"], r["last"], r["has"], r["coded"]) == (_expected(r["text"], True), _expected(r["text"], False), has, has), r
        assert r["leading"] in ("", r["first"]) and r["only"] in ("", r["last"]), r
    found = {r["text"]: r["leading"] for r in rows}
    assert found["Subtotal: Rp 1,234.56"] == "1,234.56" and found["$ 3 and EUR 4.50"] == "3"  # the shortcut is taken


def test_every_currency_passes_the_guard_of_the_search():
    signs = re.search(r"\(Rp.*?\\\$\)\\s", V.CURRENCY_SIGN_AMOUNT)[0][1:-3].replace("\\.?", "").replace("\\", "").split("|")
    codes = re.findall(r"\(([A-Z|]+)\)\)$", V.CURRENCY_SIGN_AMOUNT)[0].split("|")
    assert len(signs) > 30 and len(codes) > 20
    for text in [f"{s} 5" for s in signs] + [f"{s}.\t5" for s in ("Rp", "IDR")] + [f"5{c.lower()}" for c in codes] + [f"5. {c}" for c in codes]:
        assert re.search(T._NEAR_CURRENCY, text, re.ASCII) and re.search(V.CURRENCY_SIGN_AMOUNT, text, re.ASCII), text


def test_dates_with_and_without_words_and_none(spark):
    c = F.col("text")
    texts = {"Date: 28/02/2000": "2000-02-28", "12 Agustus 1999": "1999-08-12", "March 3, 21": None, "3 Mar 1970": "1970-03-03", "01.02.69": "1969-02-01", "nothing": None, "99/99/2000": None, "tempo": None}
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(c, T.parse_date(c).cast("string").alias("d"), T.date_role(c)["role"].alias("role"))
    rows = {r["text"]: (r["d"], r["role"]) for r in got.collect()}
    assert {t: rows[t][0] for t in texts if t != "March 3, 21"} == {t: d for t, d in texts.items() if t != "March 3, 21"}
    assert rows["Date: 28/02/2000"][1] == "generic_date" and rows["tempo"][1] is None and rows["nothing"][1] is None


def test_an_amount_beside_its_label_leaves_neighbours_alone(spark):
    pages = spark.createDataFrame([(1, 1, "Rp 1.00\nGrand Total Rp 5.00\nRp 2.00"), (2, 1, "Rp 1.00\nGrand Total 5 %\nRp 2.00"), (3, 1, "Amount due\nRp 2.00")], "doc_id int, page_number int, raw_text string")
    pairs = X.context_pairs(X.line_facts(X.page_lines(pages)))
    got = {(r["doc_id"], r["relation"], r["distance"]) for r in pairs.collect()}
    assert {g for g in got if g[0] == 1} == {(1, "same_line", 0)}
    assert {(2, "before_label", 1), (2, "after_label", 1), (3, "after_label", 1)} <= got


def test_lines_of_one_form_are_read_as_each_line_by_itself(spark):
    """Digits in dates, misread words, phrases and long amounts; more runs of digits than are numbered; texts that aren't parts of their line."""
    labels = ["Invoice No", "Inv0ice N0", "T0tal Payable", "Grand Total", "Subtotal", "PPh 23", "PPh 99", "Invoice Date", "Amount Due", "Vendor", "Total 5", "K 5"]
    values = ["Rp 1,234.56", "Rp 7,234.99", "INV/12/2000", "INV/75/2001", "A / 12", "28/02/2000", "31/02/2000", "12 Agustus 1999", "5 %", "IDR 99999999999999999", "1 2 3 4 5 6 7 8 9 10 11", "PT Maju 5", "33 333", "é5 6"]
    texts = [f"{a}{s}{v}\n{a}\n{v}" for a in labels for v in values for s in (": ", " = ", " ")]
    pages = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string").select("doc_id", F.lit(1).alias("page_number"), "raw_text")
    lines = stored(X.page_lines(pages))
    facts = stored(X.line_facts(lines))
    found = [producer(facts) for producer in (X.label_value_candidates, X.financial_row_candidates, X.context_candidates, X.document_number_candidates, X.date_candidates)]
    want = sorted(str(r) for part in found for r in part.collect())
    assert sorted(map(str, X.all_candidates(lines).collect())) == want and len(want) > 500


def test_prefixes_of_months_and_phrases_with_digits_are_told():
    months = {m for m in re.findall("[a-z]{3,}", V.DATE_TOKEN) if m not in ("uary", "ruary", "tember", "ober", "ember", "ust", "il")}
    assert all(re.search(X._TELLING_DIGITS, f"0 {m}") for m in months if m not in ("rch",)) and "pph 21" in T.DIGIT_PHRASES
    assert all(re.search(X._TELLING_DIGITS, t) for t in ("PPh 00", "t0tal", "00/00/0000", "0000-0-0", "000,000,000,000.00")) and not re.search(X._TELLING_DIGITS, "Rp 000,000.00")


def test_each_amount_of_a_document_counts_once_when_its_total_is_reconciled(spark):
    from ledgerlens.operators import resolve as R

    text = "Subtotal: Rp 100\nSubtotal: Rp 100\nPPN: Rp 11\nGrand Total: Rp 111"
    pages = spark.createDataFrame([(1, 1, text), (1, 2, text), (2, 1, "Subtotal: $100\nTax base: Rp 5\nGrand Total: $100")], "doc_id long, page_number int, raw_text string")
    pool = stored(R.dedup_candidates(X.all_candidates(X.page_lines(pages))))
    parts = R.expected_payable(pool).withColumnRenamed("validation", "how").collect()
    assert {(r.doc_id, r.currency, r.expected) for r in parts} == {(1, "IDR", 111.0), (2, "USD", 100.0), (2, "IDR", None)}
    totals = R.reconcile(pool).filter("amount_role = 'final_total'").collect()
    assert totals and all((r.score, r.validation) == (0.995, "RECONCILED_NET_TOTAL") for r in totals)


def test_headings_are_lines_that_norm_turns_into_invoice(spark):
    texts = ["INVOICE", " -- Invoice --", "é invoice é", "invoice 1", "K invoice", "İ invoice", "İNVOICE", "an invoice", "INV OICE", "invoice\n"]
    rows = spark.createDataFrame([(t,) for t in texts], "line string").select((T.norm(F.col("line")) == "invoice").alias("want"), F.col("line").rlike(X._INVOICE_ALONE).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows] and sum(r.got for r in rows) == 4


def test_pages_whose_core_fields_are_sure_need_no_look_at_their_labels(spark):
    from ledgerlens.operators import resolve as R

    names = ["document_number", "transaction_amount", "transaction_date"]
    won = [(1, n, "FOUND", "final_total") for n in names] + [(2, n, "FOUND", "subtotal") for n in names] + [(3, n, "AMBIGUOUS", "final_total") for n in names] + [(4, "vendor_name", "FOUND", None)] + [(5, n, "FOUND", "final_total") for n in names[:2]]
    pages = spark.createDataFrame([(i, 1) for i in (*range(1, 7), None)], "doc_id long, page_number int")
    left = R.unsettled(pages, spark.createDataFrame(won, "doc_id long, field_name string, status string, amount_role string"))
    assert {r.doc_id for r in left.collect()} == {2, 3, 4, 5, 6, None}


def test_without_lines_that_look_at_neighbours_no_windows_over_lines_are_planned(spark):
    pages = lambda *texts: X.page_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string").select("doc_id", F.lit(1).alias("page_number"), "raw_text"))
    plan = lambda lines: X.all_candidates(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert "lag(" not in plan(pages("Invoice No: A-1\nGrand Total: Rp 5")) and "lag(" in plan(pages("Amount Due\nRp 5"))
