"""Scanned text: rows that reach over pages, used-up lines, unread boxes, the driver of all banks."""

from __future__ import annotations

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.operators import scalars
from ledgerloom.sources import scans

PAGES = "doc_id long, page_no long, text string"


def cents(s: str) -> int:
    digits = re.sub(r"[^0-9.]", "", s)
    return (-1 if s.startswith(("-", "(")) or s.endswith("-") else 1) * int(digits.split(".")[0] or 0) * 100 + (-1 if s.startswith(("-", "(")) or s.endswith("-") else 1) * int((digits.split(".")[1] + "00")[:2])


def moneys(line: str) -> list[int]:
    return [cents(m) for m in re.findall(money.MONEY, line)]


def brute_accounts(lines: list[str]) -> list[tuple]:
    out, i = [], 0
    while i < len(lines):
        m = re.search(scans.ACCOUNT, lines[i])
        if m and "TOTALS" not in lines[i]:
            unit = initial = balance = opened = None
            closed = False
            for j in range(i + 1, min(i + 3, len(lines))):
                closed |= "CLOSED" in lines[j].upper()
                if found := moneys(lines[j]):
                    unit, initial, balance = lines[j].split()[0], found[0], 0 if closed else found[-1]
                    if o := re.search(scans.OPENED, "\n".join(lines[j : j + 2])):
                        opened = datetime.date(2000 + int(o[3]), int(o[1]), int(o[2]))
                    name = re.sub(r"\s+", " ", lines[i][: m.start()]).strip(" -")
                    i = j
                    break
            else:
                name = re.sub(r"\s+", " ", lines[i][: m.start()]).strip(" -")
            out.append((m[1], name, unit, initial, balance, closed, opened))
        i += 1
    return out


def brute_sections(lines: list[str]) -> list[tuple]:
    out, head = [], None
    for i, x in enumerate(lines):
        if m := re.search(scans.SECTION, x):
            head = m[1]
        elif m := re.match(scans.TENANT, x):
            u = re.match(scans.UNIT, lines[i + 1]) if i + 1 < len(lines) else None
            out.append((m[1], m[2].strip(), cents(m[3]), u[1] if u else None, head))
    return out


def brute_running(lines: list[str]) -> tuple:
    b = [found[-1] for x in lines if re.match(scans.BALANCE_LINE, x) and (found := moneys(x))]
    steps = [y - x for x, y in zip(b, b[1:])]
    two = len(b) > 1
    return (b[0], b[-1] if two else None, sum(s for s in steps if s > 0) if two else None, -sum(s for s in steps if s < 0) if two else None) if b else None


def random_lines(rng: random.Random, n: int) -> list[str]:
    kinds = [
        lambda: f"NAME {rng.randrange(99)} - 1000{rng.randrange(10**6):06d}",
        lambda: f"NAME 1000{rng.randrange(10**6):06d} pays 7.{rng.randrange(10, 99)}",
        lambda: f"CLOSED 1000{rng.randrange(10**6):06d}",
        lambda: f"4B  1,2{rng.randrange(10, 99)}.50  {rng.randrange(9)}.00",
        lambda: f"  OPEN 0{rng.randrange(1, 9)}/1{rng.randrange(9)}/2{rng.randrange(9)}",
        lambda: f"Building Number  Nr {rng.randrange(9)} ",
        lambda: f"{rng.randrange(10**8, 10**9)}  TENANT {rng.randrange(9)}   {rng.randrange(10, 99)}.00 3",
        lambda: f" {rng.randrange(1, 99)}A  1.00",
        lambda: f"0{rng.randrange(1, 9)}/1{rng.randrange(9)} paid 5.00 {rng.randrange(100, 999)}.00",
        lambda: "1000123456 TOTALS",
        lambda: "",
        lambda: "note",
    ]
    return [rng.choice(kinds)() for _ in range(n)]


def in_pages(doc_id: int, lines: list[str], rng: random.Random | None) -> list[tuple]:
    if rng is None:
        return [(doc_id, 1, "\n".join(lines))]
    cuts = sorted(rng.sample(range(1, len(lines)), min(len(lines) - 1, rng.randint(0, len(lines)))))
    return [(doc_id, k + 1, "\n".join(lines[a:b])) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lines)], strict=True))]


@pytest.fixture(scope="module")
def split(spark):
    """Documents of one line to 1,000, on one page or cut anywhere, and one of many one-line pages."""
    rng = random.Random(7)
    docs = {i: random_lines(rng, rng.choice((1, 2, 5, 30, 60))) for i in range(60)} | {100: random_lines(rng, 1000), 101: random_lines(rng, 1000)}
    docs[102] = [f"N 1000{i:06d} 3.00" for i in range(700)]  # every line could use up the next
    rows = [p for i, x in docs.items() for p in in_pages(i, x, None if i % 3 == 0 or i == 100 else rng)]
    rows += [(200, k + 1, x) for k, x in enumerate(random_lines(rng, 300))]
    docs[200] = [x for i, _, x in rows if i == 200]
    return docs, spark.createDataFrame(rows, PAGES).repartition(7)


def bag(rows):
    return sorted(rows, key=str)


def test_rows_do_not_depend_on_where_pages_end(split):
    docs, pages = split
    got = scans.subaccounts(pages).collect()
    assert bag(tuple(r) for r in got) == bag((i, *r) for i, x in docs.items() for r in brute_accounts(x))
    got = scans.sections(pages).select("doc_id", "account", "tenant", "balance", "unit", "section").collect()
    assert bag(tuple(r) for r in got) == bag((i, *r) for i, x in docs.items() for r in brute_sections(x))
    got = scans.running(pages).collect()
    assert bag(tuple(r) for r in got) == bag((i, *r) for i, x in docs.items() if (r := brute_running(x)))
    assert len(docs[102]) / 2 == scans.subaccounts(pages.where("doc_id = 102")).count()


def test_small_blocks_give_the_same_rows(split, monkeypatch):
    docs, pages = split
    monkeypatch.setattr(scans, "BLOCK", 3)
    some = pages.where("doc_id % 10 < 3")
    got = scans.subaccounts(some).collect()
    assert bag(tuple(r) for r in got) == bag((i, *r) for i, x in docs.items() if i % 10 < 3 for r in brute_accounts(x))


def test_rows_by_merge_joins(split, spark):
    """As on tables that no join broadcasts: no join's condition may need both sides' lines."""
    docs, pages = split
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = scans.subaccounts(pages).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert bag(tuple(r) for r in got) == bag((i, *r) for i, x in docs.items() for r in brute_accounts(x))


def test_no_plan_gathers_text(split):
    _, pages = split
    for frame in (scans.subaccounts(pages), scans.sections(pages), scans.running(pages)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"collect_list\([^)]*(text|line)", plan)


def test_an_unread_box_falls_back_to_running_balances(spark):
    text = "SANTANDER\n01/01/2024 TO 01/31/2024\nBeginning Balance 10.00\nDeposits/Credits 5.00\nWithdrawals/Debits 1.00\n01/05/2024 x 5.00 15.00\n1/9 y 1.00 14.00"
    rows = [(1, 1, text), (2, 1, text + "\nEnding Balance 14.00"), (3, 1, "Beginning Balance 10.00"), (4, 1, "nothing")]
    got = {r["doc_id"]: r for r in scans.activity(spark.createDataFrame(rows, PAGES), scans.LABELS["santander"]).collect()}
    assert (got[1]["opening"], got[1]["closing"], got[1]["delta"], got[1]["checksum_ok"]) == (1000, 1400, None, False)
    assert (got[2]["closing"], got[2]["delta"], got[2]["checksum_ok"], got[2]["agrees"]) == (1400, 0, True, True)
    assert (got[3]["opening"], got[3]["closing"], got[3]["run_credit"], got[3]["credit"]) == (1000, None, None, None)
    assert (got[4]["opening"], got[4]["run_opening"], got[4]["checksum_ok"]) == (None, None, False)


def test_an_amount_may_stand_on_the_next_page(spark):
    rows = [(1, 1, "Landlord Totals For All Buildings"), (1, 2, ""), (1, 3, " 5.00 6.00"), (2, 1, "Security Dep. 7.00"), (3, 1, "x")]
    assert bag(tuple(r) for r in scans.section_totals(spark.createDataFrame(rows, PAGES)).collect()) == [(1, 500, 600), (2, 700, None)]


def test_driver_reads_again_only_what_it_must(spark):
    rows = [
        (1, 1, "M&T\nACCOUNT NUMBER 1234567\nBeginning Balance 1.00\nDEPOSITS & CREDITS 0.00\nLESS CHECKS & DEBITS 0.00\nLESS SERVICE CHARGES .25\nENDING BALANCE .75"), (1, 2, "BEGINNING BALANCE 9.00"),
        (2, 1, "smudge"), (2, 2, "Flagstar Account Number XX991\nStatement Ending 02/29/2024\nBeginning Balance 2.00"),
        (3, 1, "smudge"), (4, 2, "no first page"),
        (5, 1, "Apple Bank\nAccount number 998877\nBeginning balance 3.00\nTotal additions 1.00\nTotal subtractions 0.00\nEnding balance 4.00"),
        (6, 1, "Capital One"), (6, 2, "A B 1000000001"), (6, 3, "7 1.00 2.00\nTOTALS FOR ALL SUB ACCOUNTS 1 SUB ACCOUNTS\n2.00"),
    ]
    heads, tenants = scans.extract(spark.createDataFrame(rows, PAGES))
    got = {r["doc_id"]: r for r in heads.collect()}
    assert [(i, got[i]["bank"], got[i]["pages"]) for i in sorted(got)] == [(1, "mt", 1), (2, "flagstar", 2), (3, None, None), (4, None, None), (5, "apple", 1), (6, "capital_one", 3)]
    assert got[1]["checksum_ok"] and got[1]["service"] == 25 and got[1]["master_account"] == "1234567"
    assert got[2]["period_end"] == datetime.date(2024, 2, 29) and got[2]["opening"] == 200
    assert got[3]["error"] == got[4]["error"] == "unrecognized bank format"
    assert (got[5]["kind"], got[5]["checksum_ok"]) == ("master", True)
    assert (got[6]["accounts"], got[6]["reported"], got[6]["grand"], got[6]["checksum_ok"]) == (1, 1, 200, True)
    assert [(r["doc_id"], r["account"], r["balance"]) for r in tenants.collect()] == [(6, "1000000001", 200)]


def test_the_second_read_is_pruned_at_run_time(spark, tmp_path):
    rows = [(i, k, ("M&T" if i % 50 else "Capital One") + " x" * 200) for i in range(400) for k in range(1, 5)]
    spark.createDataFrame(rows, PAGES).write.parquet(str(tmp_path / "p"))
    names = {"spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        heads, _ = scans.extract(spark.read.parquet(str(tmp_path / "p")))
        assert "might_contain" in heads._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# --- values and labels ---


def test_written_amounts(spark):
    rows = [("12.34.56", 1234, None), ("1.5", 150, 150), ("-", None, None), (".", 0, None), ("1..5", None, None), ("1.", 100, 100), ("", None, 0), ("-$2,500.5", -250050, -250050), ("(3)", -300, None), ("- 7", -700, -700)]
    got = spark.createDataFrame([(t,) for t, *_ in rows], "t string").select("t", money.to_cents(F.col("t")).alias("a"), money.input_cents(F.col("t")).alias("b")).collect()
    assert [tuple(r) for r in got] == rows


def test_labels_of_buildings(spark):
    buildings = spark.createDataFrame([(1, "109-20 71st Road"), (2, "5501 Ave"), (3, "8760 Ave"), (4, "70-11 108th Street"), (5, "Park")], "building_id long, name string")
    overrides = spark.createDataFrame([(2, "GRAND", 2), (1, "grand manor", 3), (1, "grand manor", 5), (3, "LLC", 1), (4, "", 4)], "ordinal long, word string, building_id long")
    want = {"The GRAND Manor LLC": (0, "3,5"), "xgrandx": (0, "2"), "10920 71ST": (1, "1"), "5501/8760": (2, "2,3"), "70-11 108TH ST": (1, "4"), "1092": (2, "1"), "55": (None, ""), "70-11 108TH ST 4F": (3, "4"), "": (None, "")}
    got = scalars.match_label(spark.createDataFrame([(k,) for k in want], "label string"), buildings, overrides)
    assert {r["label"]: (r["tier"], r["buildings"]) for r in got.collect()} == want
