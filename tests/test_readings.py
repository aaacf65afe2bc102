"""Several reads of scanned documents: hand-written pages."""

from __future__ import annotations

from ledgerloom.operators import readings
from pyspark.sql import functions as F

PAGES = "doc_id long, reader int, page_no long, text string"


def report(total: str, second: str, n: int = 2) -> str:
    return f"Capital One\n ELM COURT LLC\nDoe Jane - 1000000001\n 2A  100.00  150.00\nRoe Max - 1000000002\n 3B  50.00  {second}\nCAPITAL ONE TOTALS FOR ALL SUB ACCOUNTS {n} SUB ACCOUNTS\n x 1.00 {total}"


def test_reads_agree_or_are_held_back(spark):
    rows = [(1, r, 1, report(t, s)) for r, (t, s) in enumerate((("200.00", "50.00"), ("200.00", "56.00"), ("900.00", "50.00")), 1)]
    rows += [(2, r, 1, report("200.00", s)) for r, s in enumerate(("50.00", "51.00", "52.00"), 1)]
    # Only one reader sees the total; a wrong count; one reader alone; nothing but a letter.
    rows += [(3, 1, 1, report("200.00", "50.00")), (3, 2, 1, report("210.00", "50.00"))]
    rows += [(4, r, 1, report("200.00", "50.00", 3)) for r in (1, 2)]
    rows += [(5, 1, 1, report("200.00", "50.00")), (6, 1, 1, "a letter"), (6, 2, 1, None), (None, 1, 1, "x"), (7, None, 1, "x")]
    # The first reader knows no bank: the second's counts, as do the rows of both others.
    rows += [(8, 1, 1, "C@p"), (8, 2, 1, report("200.00", "50.00")), (8, 3, 1, report("200.00", "50.00"))]
    buildings = spark.createDataFrame([(41, "Elm Court LLC", None)], "building_id long, name string, address string")
    checked, accepted = readings.verify(spark.createDataFrame(rows, PAGES), buildings)
    got = {r["doc_id"]: r for r in checked.collect()}
    assert {d: r["status"] for d, r in got.items()} == {1: "accepted", 2: "quarantined", 3: "quarantined", 4: "quarantined", 5: "quarantined", 6: "quarantined", 8: "accepted"}
    assert (got[1]["grand"], got[1]["accepted_total"], got[1]["reads"]) == (20000, 20000, 3)
    assert (got[2]["flagged"], got[2]["accepted_count"], got[2]["row_consensus"]) == (1, 1, False)
    assert got[3]["grand"] is None and got[3]["row_consensus"] and not got[3]["sum_ties"]
    assert got[4]["sum_ties"] and not got[4]["count_ties"]
    assert got[5]["flagged"] == 2 and got[6]["error"] == "bank not identified"
    decision, posted = readings.decided(checked, accepted, F.lit(None).cast("date"))
    said = {r["doc_id"]: (r["decision"], r["message"]) for r in decision.collect()}
    assert said[1] == said[8] == ("posted", None) and said[6] == ("errored", "bank not identified")
    assert said[4] == ("quarantined", "gate failed: count mismatch")
    rows = {(r["doc_id"], r["account_id"]): r for r in posted.collect()}
    assert set(rows) == {(d, a) for d in (1, 8) for a in ("1000000001", "1000000002")}
    second = rows[1, "1000000002"]
    assert (second["value"], second["confirmed_by"], second["tenant"], second["unit"], second["building_id"]) == (5000, "1,3", "Roe Max", "3B", 41)


def test_an_account_shown_twice_is_two_rows(spark):
    """Printed totals and counts have both; the readers differ on the second alone."""
    text = "Capital One\n ELM COURT LLC\nDoe Jane - 1000000001\n 2A  100.00  150.00\nRoe Max - 1000000001\n 3B  50.00  {}\nCAPITAL ONE TOTALS FOR ALL SUB ACCOUNTS 2 SUB ACCOUNTS\n x 1.00 200.00"
    rows = [(1, r, 1, text.format(b)) for r, b in enumerate(("50.00", "56.00", "50.00"), 1)]
    buildings = spark.createDataFrame([(41, "Elm Court LLC", None)], "building_id long, name string, address string")
    checked, accepted = readings.verify(spark.createDataFrame(rows, PAGES), buildings)
    assert [(r["status"], r["accepted_total"], r["accepted_count"], r["flagged"]) for r in checked.collect()] == [("accepted", 20000, 2, 0)]
    assert sorted((r["account_id"], r["value"], r["n_agree"], r["tenant"], r["unit"]) for r in accepted.collect()) == [("1000000001", 5000, 2, "Roe Max", "3B"), ("1000000001", 15000, 3, "Doe Jane", "2A")]


def test_no_reads(spark):
    buildings = spark.createDataFrame([], "building_id long, name string, address string")
    checked, accepted = readings.verify(spark.createDataFrame([], PAGES), buildings)
    assert checked.count() == 0 and accepted.count() == 0
