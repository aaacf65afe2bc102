"""Versioned tables and the ingest of statements: killed between the steps, repeated, raced."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ingest as ing
from ledgerloom.operators import sinks
from ledgerloom.plans.versions import Store, content_id

from test_flows import ESCROW

DAY = datetime.date
TABLES = {"money": "k long, unit string, amount long, note string", "audit": "action string, n long"}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), TABLES, {"money": ("k", "unit")}, buckets=4)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def batch(spark, *values):
    return spark.createDataFrame([(*v, i) for i, v in enumerate(values)], "k long, unit string, amount long, note string, at long")


def put(store, new, name, **kw):
    return store.merge("money", new, name, "at", {"amount": F.col("amount")}, {"note": F.col("note")}, **kw)


def test_last_row_of_a_key_wins_and_its_first_seeds(spark, store):
    assert put(store, batch(spark, (1, "a", 5, "x"), (1, "a", 6, "y"), (2, None, 7, "z"), (2, None, 8, "w"), (None, None, 1, "n")), "b1") == {"inserted": 3, "updated": 2, "changed": 3}
    assert rows(store.read("money")) == rows(spark.createDataFrame([(1, "a", 6, "x"), (2, None, 8, "z"), (None, None, 1, "n")], TABLES["money"]))
    assert put(store, batch(spark, (1, "a", 9, "q"), (3, "c", 1, "r")), "b2") == {"inserted": 1, "updated": 1, "changed": 2}
    assert (1, "a", 9, "x") in rows(store.read("money")) and (1, "a", 6, "x") in rows(store.read("money", 1))
    assert store.version() == 2


def test_a_second_run_changes_nothing_and_makes_no_version(spark, store):
    new = batch(spark, *((k, "u", k, "n") for k in range(50)))
    put(store, new, "b1")
    before = {r["folder"] for r in store.live("money").collect()}
    assert put(store, new, "b2") == {"inserted": 0, "updated": 50, "changed": 0}
    assert store.version() == 1 and {r["folder"] for r in store.live("money").collect()} == before
    put(store, batch(spark, (7, "u", -1, "n")), "b3")
    after = store.live("money").collect()
    assert store.version() == 2 and len({r["bucket"] for r in after if r["folder"] not in before}) == 1  # one bucket rewritten


def test_counts_land_in_the_same_version(spark, store):
    put(store, batch(spark, (1, "a", 5, "x")), "b1", beside=lambda n: {"audit": spark.createDataFrame([("load", n["inserted"])], TABLES["audit"])})
    assert rows(store.read("audit")) == [("load", 1)] and store.version() == 1


def test_a_writer_who_comes_second_looks_again(spark, store, monkeypatch):
    put(store, batch(spark, (1, "a", 5, "x")), "b1")
    whole, raced = store.name, []

    def name(base, *args):
        if not raced:
            raced.append(1)
            other = Store(spark, store.path, TABLES, store.keys, buckets=4)
            put(other, batch(spark, (1, "a", 6, "x"), (2, "b", 1, "x")), "other")
        return whole(base, *args)

    monkeypatch.setattr(store, "name", name)
    put(store, batch(spark, (2, "b", 2, "y"), (3, "c", 3, "y")), "mine")
    assert rows(store.read("money")) == [(1, "a", 6, "x"), (2, "b", 2, "x"), (3, "c", 3, "y")] and store.version() == 3


def test_folding_keeps_the_tables_and_refuses_stale_numbers(spark, store):
    for k in range(4):
        put(store, batch(spark, (k % 2, "u", k, "n")), f"b{k}", beside=lambda n: {"audit": spark.createDataFrame([("load", n["changed"])], TABLES["audit"])})
    before = rows(store.read("money")), rows(store.read("audit"))
    assert store.fold() == 4 and store.version() == 4
    assert (rows(store.read("money")), rows(store.read("audit"))) == before
    assert store.has("b0") and not store.name(1, "stale", []) and store.version() == 4
    put(store, batch(spark, (9, "u", 9, "n")), "b9")
    assert store.version() == 5 and len(rows(store.read("money"))) == 3
    with pytest.raises(ValueError):
        store.read("money", 2)


def test_sweep_takes_only_what_no_version_names(spark, store):
    put(store, batch(spark, (1, "a", 5, "x")), "b1")
    store.stage("money", batch(spark, (2, "b", 5, "x")).drop("at"))
    assert rows(store.read("money")) == [(1, "a", 5, "x")]
    assert store.sweep() == 0 and store.sweep(older_than_ms=-10_000) == 1 and store.sweep(older_than_ms=-10_000) == 0
    assert rows(store.read("money")) == [(1, "a", 5, "x")]


def test_upsert_and_partial_merge_of_repeated_keys(spark):
    stored = spark.createDataFrame([(1, "a", 10), (4, "d", 40)], "k long, s string, balance long")
    new = spark.createDataFrame([(1, "a", 11, 0), (1, "a", 12, 1), (2, "b", 20, 2), (2, "b", 21, 3), (3, "c", None, 4), (4, "d", None, 5), (4, "d", 41, 6)], "k long, s string, balance long, at long")
    assert rows(sinks.upsert(new, stored, ["k"], "at")) == [(1, "a", 12), (2, "b", 21), (3, "c", None), (4, "d", 41)]
    got = sinks.merge_columns(new, stored, ["k"], ["balance"], {"s": F.concat("_s", F.col("_balance").cast("string"))}, "at", required=["balance"])
    assert rows(got) == [(1, "a", 12), (2, "b20", 21), (4, "d", 41)]


def test_content_ids_ignore_order(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "c string")
    assert content_id(a, "c") == content_id(a.orderBy(F.desc("c")).repartition(3), "c") != content_id(a.distinct(), "c")


# --- ingest ---


def files_of(spark, *texts, account=7):
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id long, page_no int, text string")
    files = pages.select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("filename"), F.concat(F.lit("in/"), "doc_id").alias("path"), F.lit(account).cast("long").alias("account_id"), F.octet_length("text").cast("long").alias("byte_size"), F.sha2("text", 256).alias("sha256"))
    accounts = spark.createDataFrame([(7, 70, "1234"), (8, 80, "9999")], "account_id long, building_id long, last4 string")
    return files, pages, accounts


LONG = ESCROW + "\n" + "x" * 100
BAD = LONG.replace("Ending Balance  $1,750.00", "Ending Balance  $1,751.00")


def outcome(frame):
    return {r["doc_id"]: (r["status"], r["reason"]) for r in frame.collect()}


def test_a_batch_lands_whole_and_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ing.TABLES)
    files, pages, accounts = files_of(spark, LONG, BAD, LONG, " ", "no bank" + "z" * 200, LONG.replace("1234", "5555"), LONG.replace("Ending", "Final"), LONG.replace("Beginning Balance", "Starting"))
    want = {0: ("posted", None), 1: ("quarantined", "checksum"), 2: ("duplicate", "content seen before"), 3: ("quarantined", "no text layer"), 4: ("errored", "no layout matches"), 5: ("quarantined", "another account"), 6: ("errored", "could not locate closing balance"), 7: ("errored", "could not locate opening balance")}
    for _ in range(2):
        out = ing.ingest(store, files, pages, accounts)
        assert outcome(out) == want
        assert store.version() == 1
    said = {r["doc_id"]: (r["message"], r["hints"]) for r in out.collect()}
    assert said[0][0] == "2024-03-01..2024-03-31  2 txns  closing $1,750.00" and said[1][0].startswith("off by -$1.00") and "whole_dollars" in said[1][1]
    assert [store.read(t).count() for t in ("documents", "pages", "statements", "transactions", "audit")] == [1, 1, 1, 2, 1]
    t = store.read("transactions").orderBy("line_no").collect()
    assert [(r["amount"], r["check_no"], r["posted_on"]) for r in t] == [(125000, None, DAY(2024, 3, 5)), (-50000, "1007", DAY(2024, 3, 9))]
    assert outcome(ing.ingest(store, files, pages, accounts, run="again"))[0] == ("duplicate", "content seen before") and store.read("transactions").count() == 2


def test_a_copy_under_a_wrong_account_does_not_keep_the_right_one_out(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), ing.TABLES)
    files, pages, accounts = files_of(spark, LONG, LONG, LONG)
    files = files.withColumn("account_id", F.when(F.col("doc_id") == 0, 8).otherwise(7).cast("long"))
    assert outcome(ing.ingest(store, files, pages, accounts)) == {0: ("quarantined", "another account"), 1: ("posted", None), 2: ("duplicate", "content seen before")}


@pytest.mark.parametrize("step", ["stage", "name", "after"])
def test_a_killed_ingest_leaves_nothing_half_and_is_repeated(spark, tmp_path, monkeypatch, step):
    store = Store(spark, str(tmp_path / "s"), ing.TABLES)
    files, pages, accounts = files_of(spark, LONG, BAD)
    done = []

    def dying(real):
        def call(*args):
            if step == "stage" and len(done) < 3:
                done.append(1)
                return real(*args)
            if step == "after":
                real(*args)
            raise KeyboardInterrupt

        return call

    with monkeypatch.context() as m:
        m.setattr(store, "stage" if step == "stage" else "name", dying(getattr(store, "stage" if step == "stage" else "name")))
        with pytest.raises(KeyboardInterrupt):
            ing.ingest(store, files, pages, accounts)
    landed = 1 if step == "after" else 0
    assert [store.read(t).count() for t in ("documents", "transactions")] == [landed, 2 * landed]
    assert outcome(ing.ingest(store, files, pages, accounts)) == {0: ("posted", None), 1: ("quarantined", "checksum")}
    assert [store.read(t).count() for t in ("documents", "pages", "transactions")] == [1, 1, 2] and store.version() == 1
    assert store.sweep(older_than_ms=-10_000) == (0 if step == "after" else {"stage": 3, "name": 6}[step])
    assert store.read("transactions").count() == 2


def test_two_ingests_at_once_post_a_document_once(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), ing.TABLES)
    files, pages, accounts = files_of(spark, LONG)
    whole, raced = store.name, []

    def name(*args):
        if not raced:
            raced.append(1)
            ing.ingest(Store(spark, store.path, ing.TABLES), files.withColumn("filename", F.lit("other.pdf")), pages, accounts)
        return whole(*args)

    monkeypatch.setattr(store, "name", name)
    assert outcome(ing.ingest(store, files, pages, accounts)) == {0: ("duplicate", "content seen before")}
    assert store.read("documents").count() == 1 and store.read("transactions").count() == 2
