"""What must not grow with the tables: patterns worked out once for a text, lines that meet
their document before they are cut, readers of versions that move no row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.functions.money import money_tokens, to_cents
from ledgerloom.plans.versions import Store
from ledgerloom.sources import scans, statements


def optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_an_amount_is_worked_out_once(spark):
    texts = spark.createDataFrame([("x 1,234.50- $(2.00) (.05) -7.10",), ("92,233,720,368,547,759.00 1.00",), ("99999999999999999999.00",), (None,)], "s string")
    assert optimized(texts.select(to_cents(F.regexp_extract("s", "(.*)", 1)).alias("c"))).count("regexp_extract") == 1
    got = [r["m"] for r in texts.select(money_tokens(F.col("s")).alias("m")).collect()]
    # beyond a long an amount cannot be read; it does not stop the job
    assert got == [[-123450, 200, -5, -710], [None, 100], [None], None]


def test_scanned_pages_are_aggregated_by_fields(spark):
    pages = spark.createDataFrame([(1, 1, "CAPITAL ONE\n OAK  HOLDINGS LLC\n01/01/2024 TO 01/31/2024"), (1, 2, "02/01/2024 TO 02/28/2024\nMASTER ACCOUNT NUMBER: 00123456\nELM LLC"), (2, 1, "SANTANDER\n12/34 OAK LLC #1\nOAK LLC"), (3, 1, None)], "doc_id long, page_no long, text string")
    out, _ = scans.extract(pages)
    got = {r["doc_id"]: (r["bank"], r["pages"], r["master_account"], r["entity"], str(r["period_end"])) for r in out.collect()}
    assert got == {1: ("capital_one", 2, "00123456", "OAK HOLDINGS LLC", "2024-01-31"), 2: ("santander", 1, None, "12/34 OAK LLC #1", "None"), 3: (None, None, None, None, "None")}
    # lines are cut, and looked at for accounts and amounts, once for both sides of the blocks' join
    assert "posexplode(transform(sequence" not in optimized(scans.subaccounts(pages))


def test_lines_meet_their_document_before_they_are_cut(spark):
    pages = spark.createDataFrame([(1, 1, "x")], "doc_id long, page_no int, text string")
    for layout in statements.LAYOUTS:
        above = optimized(statements.parse(pages, layout)).split("Generate")[0]
        assert "Join" not in above and "filter(" not in above


def test_no_text_is_sent_to_detect_or_to_find_a_header(spark):
    pages = spark.createDataFrame([(1, 1, "ESCROW ACCOUNT"), (1, 2, "HARBOR NATIONAL BANK"), (2, 2, "ESCROW ACCOUNT"), (3, 1, None)], "doc_id long, page_no int, text string")
    found = statements.detect(pages)
    assert {r["doc_id"]: (r["layout"], r["n_parsers"]) for r in found.collect()} == {1: ("escrow-columnar", 1), 2: (None, 0), 3: (None, 0)}
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    # the aggregate of the header's fields has no text below it before the exchange
    head = optimized(statements.header(pages, statements.LAYOUTS[0]))
    assert "RLIKE(text" not in head.split("RepartitionByExpression")[0] and "RepartitionByExpression" in head


def test_readers_of_versions_move_no_row(spark):
    store = Store.temporary(spark, {"t": "a long"})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for i in range(2):
            frames = lambda i=i: {"t": spark.range(i * 10, i * 10 + 10).toDF("a")}
            store.append(f"b{i}", frames(), store.version(), frames)
        rows = store.read("t")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(r["a"] for r in rows.collect()) == list(range(20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
