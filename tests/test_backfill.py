"""Backfills that stop and go on, journals without numbers, seeds, kept findings, listings, the clock."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.operators import backfill as bf
from ledgerloom.operators import custody
from ledgerloom.operators import ingest as ing
from ledgerloom.operators.gates import last_outcome
from ledgerloom.plans.domain import Domain
from ledgerloom.plans.versions import Store
from ledgerloom.streaming import deadlines as clock
from test_versions import BAD, LONG, files_of

DAY = datetime.date


def bag(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_the_last_line_of_a_path_is_the_last_in_the_files(spark, tmp_path):
    """One file of many blocks, no numbers in the lines, the last one torn."""
    rng = random.Random(3)
    lines, last = [], {}
    for k in range(3000):
        path, status = f"p{rng.randrange(200)}", rng.choice(("posted", "errored", "quarantined"))
        lines.append('{"path": "%s", "status": "%s", "message": "%s"}' % (path, status, "x" * rng.randrange(60)))
        last[path] = status
    (tmp_path / "journal.jsonl").write_text("\n".join(lines) + '\n\nnot json\n{"path": "p1", "sta')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        journal = bf.read_lines(spark, str(tmp_path / "journal.jsonl"))
        assert journal.rdd.getNumPartitions() > 3
        assert {r["path"]: r["status"] for r in last_outcome(journal).collect()} == last
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_backfill_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    store, journal = Store(spark, str(tmp_path / "s"), ing.TABLES), bf.Journal(spark, str(tmp_path / "j"))
    files, pages, accounts = files_of(spark, LONG, BAD, LONG)
    files = files.withColumn("path", F.concat(F.lit("/root/"), F.when(F.col("doc_id") == 2, "lost").otherwise("b7"), F.lit("/"), "filename"))
    routes = spark.createDataFrame([("b7", 7)], "dir string, account_id long")
    run = lambda **kw: {r["path"]: r["status"] for r in bf.backfill(store, journal, files, pages, accounts, routes, **kw).collect()}
    with monkeypatch.context() as m:
        m.setattr(journal, "append", lambda rows: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):  # landed, but not in the journal
            run()
    assert journal.runs() == [] and store.read("documents").count() == 1
    assert run() == {"/root/b7/0.pdf": "posted", "/root/b7/1.pdf": "quarantined", "/root/lost/2.pdf": "errored"}
    assert run(retry=False) == {}
    assert run() == {"/root/b7/1.pdf": "quarantined", "/root/lost/2.pdf": "errored"}
    routes = spark.createDataFrame([("b7", 7), ("lost", 7)], "dir string, account_id long")
    assert run() == {"/root/b7/1.pdf": "quarantined", "/root/lost/2.pdf": "duplicate"}
    assert store.read("documents").count() == 1 and len(journal.runs()) == 3
    assert {r["path"]: r["status"] for r in last_outcome(journal.lines()).collect()} == {"/root/b7/0.pdf": "posted", "/root/b7/1.pdf": "quarantined", "/root/lost/2.pdf": "duplicate"}


def test_seeds(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), bf.SEEDS, bf.KEYS, buckets=2)
    b = spark.createDataFrame([("Oak", "1 St", "", "b1", "6", "2020-01-02", 0), ("Oak", "2 St", "", "b2", "7", "", 1), ("Elm", "3 St", "Q", "", "x", "", 2)], "name string, address string, borough string, bbl string, unit_count string, acquired_on string, at long")
    a = spark.createDataFrame([(" OAK ", "B", "1234", "escrow", "YES", "", 0), ("oak", "C", "1234", "escrow", "no", "", 1), ("Ash", "B", "1", "escrow", "", "", 2)], "building_name string, bank_name string, account_last4 string, account_type string, is_interest_bearing string, opened_on string, at long")
    one = bf.seed(store, b, a, "one")
    assert (one["buildings"]["inserted"], one["accounts"]["inserted"], one["accounts"]["unresolved"]) == (2, 1, ["Ash"])
    two = bf.seed(store, b, a, "two")
    assert two["buildings"]["changed"] == two["accounts"]["changed"] == 0 and store.version() == 2
    assert bag(store.read("buildings")) == [("Elm", "3 St", "Q", None, None, None, False), ("Oak", "1 St", None, "b1", 6, DAY(2020, 1, 2), True)]
    assert bag(store.read("accounts").select("building", "bank_name", "interest_bearing")) == [("Oak", "B", True)]
    assert bag(store.read("audit").select("table_name", "inserted", "skipped")) == [("accounts", 1, 1), ("buildings", 2, 1)]


def test_kept_findings_equal_a_full_run_after_random_edits(spark, tmp_path):
    d = Domain(spark, "/root/testdata/sf0.001")
    store, today = Store(spark, str(tmp_path / "s"), bf.KEPT, bf.KEPT_KEYS, buckets=4), F.lit("2001-08-01").cast("date")
    rows = [r.asDict() for r in d.custody.where("custody_id % 5 = 0").collect()]
    schema, rng, old = d.custody.schema, random.Random(4), []
    frame = lambda xs: spark.createDataFrame([tuple(x[c] for c in schema.names) for x in xs], schema)
    for step in range(3):
        new = [dict(r) for r in rows if rng.random() > 0.1]
        for r in new if step else []:
            if rng.random() < 0.4:
                r |= rng.choice(({"refunded_on": DAY(2001, 7, 1)}, {"in_master": rng.choice((0, r["amount"]))}, {"building_id": (r["building_id"] + 1) % 25}, {"sent_on": None}, {"bank_balance": None}))
        key = lambda x: str(sorted(x.items(), key=str))
        was, now = {key(x): x for x in old}, {key(x): x for x in new}
        before, after = [x for k, x in was.items() if k not in now], [x for k, x in now.items() if k not in was]
        bf.maintain(store, frame(before), frame(after), today, f"s{step}")
        old = new
        whole = custody.all_findings(frame(new), today).select("signature", "custody_id", "kind", "severity", "building_id", "amount", "detail")
        assert bag(store.read("findings").where("status = 'open'").drop("status")) == bag(whole.select("signature", "custody_id", "kind", "severity", "building_id", "amount", "detail"))
        totals = frame(new).groupBy("building_id").agg(F.count("*"), F.sum("amount"), F.sum(F.coalesce("bank_balance", F.lit(0))))
        assert [t for t in bag(store.read("totals")) if t[1]] == bag(totals)
    assert store.read("findings").where("status = 'closed'").count() > 10
    version = store.version()
    bf.maintain(store, frame(before), frame(after), today, "s2")  # the same changes again
    assert store.version() == version and [t for t in bag(store.read("totals")) if t[1]] == bag(totals)


def test_images_of_a_change_in_one_pass(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "custody_id long, amount long")
    old, new = table([(1, 5), (1, 5), (2, None), (3, 1), (None, 7)]), table([(1, 5), (2, None), (3, 2), (3, 2), (4, 9)])
    before, after = bf.images(old, new)
    assert bag(before) == bag(old.exceptAll(new)) and bag(after) == bag(new.exceptAll(old))
    columns = "custody_id long, building_id long, unit string, tenant string, kind string, amount long, received_on date, sent_on date, cleared_on date, in_master long, sub_last4 string, sub_opened_on date, stage string, vacate_on date, bank_closed_on date, returned_on date, returned_amount long, refunded_on date, external_ref string"
    spark.createDataFrame([], columns).write.parquet(str(tmp_path / "c"))
    found = custody.all_findings(spark.read.parquet(str(tmp_path / "c")), F.lit("2001-08-01").cast("date"))
    assert found._jdf.queryExecution().analyzed().toString().count("Relation") == 1


def test_pages_follow_each_other_and_are_heaps(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice((None, *(DAY(2024, 1, k) for k in range(1, 9))))) for i in range(130)]
    table = spark.createDataFrame(rows, "k long, at date").repartition(4)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or DAY.min, r[0]), reverse=True)
    got, last = [], None
    while True:
        page = bf.page_after(table, "at", "k", last, 30)
        assert "TakeOrderedAndProject" in page._jdf.queryExecution().toString()
        some = page.collect()
        if not some:
            break
        got += [tuple(r) for r in some]
        last = (some[-1]["at"], some[-1]["k"])
    assert got == want
    assert [r["k"] for r in bf.newest(table, "at", "k", 5).collect()] == [r[0] for r in want[:5]]


def test_words_for_sizes_and_actors(spark):
    sizes = [(5, "5 B"), (1023, "1023 B"), (1024, "1 KB"), (1536, "2 KB"), (1 << 20, "1.0 MB"), (5_500_000, "5.2 MB")]
    got = spark.createDataFrame(sizes, "n long, s string").select(tx.human(F.col("n")).alias("a"), "s").collect()
    assert all(r["a"] == r["s"] for r in got)
    claims = spark.createDataFrame([('{"email": "a@b", "sub": "7"}',), ('{"email": "", "sub": "7"}',), (None,)], "c string")
    assert [r[0] for r in claims.select(tx.actor(F.col("c"))).collect()][:2] == ["a@b", "7"] and claims.select(tx.actor(F.col("c"))).collect()[2][0]


def test_stages_come_once_also_after_a_restart(spark, tmp_path):
    name, store = clock.STATE_STORE
    old = spark.conf.get(name)
    at = lambda d: datetime.datetime(2024, 3, d, 12)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    keys = lambda i, d, now: (i, "keys", DAY(2024, 3, d), None, at(now))
    tick = lambda d: (None, "tick", None, None, at(d))
    days = [
        [keys(1, 1, 1), keys(2, 1, 1), keys(3, 1, 1)],
        [tick(9), (2, "refund", None, -500, at(9))],
        [tick(12)],
        [tick(13), keys(4, 2, 13), (2, "refund", None, 500, at(13)), keys(5, 9, 13)],
        [tick(14)],
        [tick(20), (3, "refund", None, 1, at(20))],
        [tick(30)],
        [tick(31)],
    ]
    seen = []
    try:
        spark.conf.set(name, store)
        for rows in days:  # every day the stream is started anew from its checkpoint
            spark.createDataFrame(rows, clock.EVENT).coalesce(1).write.mode("append").parquet(src)
            q = clock.stages(spark.readStream.schema(clock.EVENT).parquet(src)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(out)
            q.awaitTermination(180)
            seen.append({(r["lease_id"], r["stage"]) for r in spark.read.schema(clock.OUT).parquet(out).collect()} if len(seen) else set())
        got = [(r["lease_id"], r["stage"]) for r in spark.read.parquet(out).collect()]
    finally:
        spark.conf.set(name, old)
    assert len(got) == len(set(got))
    by = {k: {x for i, x in got if i == k} for k in range(1, 6)}
    every = {"day7", "day10", "day14", "overdue"}
    assert by[1] == by[2] == by[4] == by[5] == every
    assert "overdue" not in by[3] and {"day7", "day10"} <= by[3]
    assert not any(i == 2 for i, _ in seen[2])  # refunded
    assert {(4, "day7"), (4, "day10"), (2, "day7"), (2, "day10")} <= seen[4] and not any(i == 5 for i, _ in seen[4])


def test_edits_take_one_join_and_read_an_amount_once(spark):
    from ledgerloom.operators import edits

    stored = spark.createDataFrame([(1, 7, "1A", "Ann", 500, 0, "x")], "custody_id long, building_id long, unit string, tenant string, amount long, in_master long, stage string")
    drafts = spark.createDataFrame([(1, 7, "1B", "Ann", "6.00", "", 0), (2, 7, "2A", "Bo", "1.00", "2.00", 0), (3, 7, "3A", "Cy", "1.00", "", 0)], "custody_id long, building_id long, unit string, tenant string, amount string, in_master string, ordinal int")
    after, _ = edits.applied(stored, drafts)
    assert sorted(map(tuple, after.collect())) == [(1, 7, "1B", "Ann", 600, 0, "x"), (3, 7, "3A", "Cy", 100, 0, None)]
    plan = after._jdf.queryExecution().optimizedPlan().toString()
    assert sum(x.strip(" :+-").startswith("Join") for x in plan.splitlines()) == 1
    assert not [x for x in plan.splitlines() if x.strip(" :+-").startswith("Filter") and "regexp_replace" in x]
