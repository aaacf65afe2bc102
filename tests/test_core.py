"""The reconciliation queries against their SQL on the smallest tables, and small cases."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from ledgerloom import registry
from ledgerloom.functions import text as tx
from ledgerloom.operators import detectors, gates, matching

TABLES = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    return round(v, 6) if isinstance(v, float) else v if isinstance(v, (bool, int, str)) else str(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{TABLES}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, TABLES)
    want = duck.execute(registry.oracle_sql()[name])
    assert table_of(got.columns, got.collect()) == table_of([d[0] for d in want.description], want.fetchall())


def test_every_query_of_the_engine_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(__spark_entry__.queries())


def test_name_similarity(spark):
    rows = spark.createDataFrame([("Rivera M.", "rivera m"), ("", None), ("abc", "xyz")], "a string, b string")
    assert [r[0] for r in rows.select(tx.name_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 1.0, 0.0]


def test_ingest_decision_takes_the_first_reason(spark):
    rows = spark.createDataFrame(
        [(1, True, True, 0, False, None, None, 5), (2, False, False, 1, True, "1", "2", 5), (3, False, False, 1, True, None, "2", 5), (4, False, False, 1, True, None, None, 0)],
        "id int, seen boolean, scanned boolean, n_parsers int, parsed boolean, account_last4 string, expected_last4 string, delta long",
    )
    got = {r["id"]: (r["status"], r["reason"]) for r in gates.ingest_decision(rows).collect()}
    assert got == {1: ("duplicate", "content seen before"), 2: ("quarantined", "another account"), 3: ("quarantined", "checksum"), 4: ("posted", None)}


def test_without_keeps_each_row_once(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    gone = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert sorted(str(r["k"]) for r in matching.without(rows, gone, "k").collect()) == ["2", "2", "None"]


def test_transfers_of_a_common_amount_are_paired_in_runs_of_days(spark):
    import datetime
    import random

    import pandas as pd

    rng = random.Random(6)
    start, days = datetime.date(2020, 1, 1), [60 * k + rng.randrange(9) for k in range(12) for _ in range(9)]
    rows = [(i, rng.randrange(3), rng.choice((-500, 500)), start + datetime.timedelta(days=d), "escrow") for i, d in enumerate(days)]
    rows += [(1000, 1, -700, start, "escrow"), (1001, 2, 700, start + datetime.timedelta(days=5), "escrow")]
    txns = spark.createDataFrame(rows, "txn_id long, building_id long, amount long, posted_on date, account_type string")
    whole = pd.DataFrame(rows, columns=txns.columns).assign(window=5, run=0, size=lambda x: x["amount"].abs())
    want = pd.concat(detectors.pair_transfers((), g) for _, g in whole.groupby("size"))
    assert len(want) > 12
    for most in (1, 25, 4096):
        assert sorted(map(tuple, detectors.transfer_pairs(txns, 5, most).collect())) == sorted(want.itertuples(index=False, name=None))
    assert max(r["count"] for r in detectors.transfer_runs(txns, 5, 1).groupBy("size", "run").count().collect()) <= 9


def test_parts_of_a_long_run_are_paired_as_one(spark):
    """A common amount on every day, of few buildings, with too few credits on many days."""
    import datetime
    import random

    import pandas as pd

    rng = random.Random(8)
    start = datetime.date(2020, 1, 1)
    rows = []
    for day in range(120):
        share = rng.choice((0.2, 0.5, 0.8))
        rows += [(len(rows) + k, rng.randrange(3), 500 if rng.random() < share else -500, start + datetime.timedelta(days=day), "escrow") for k in range(rng.randrange(1, 9))]
    rows += [(9000, 1, -700, start, "escrow"), (9001, 2, 700, start, "escrow")]
    txns = spark.createDataFrame(rows, "txn_id long, building_id long, amount long, posted_on date, account_type string")
    whole = pd.DataFrame(rows, columns=txns.columns).assign(window=5, run=0, size=lambda x: x["amount"].abs())
    want = sorted(x for _, g in whole.groupby("size") for x in detectors.pair_transfers((), g).itertuples(index=False, name=None))
    # the rule itself, one debit after another
    plain, used = [], set()
    by_day = sorted(rows, key=lambda r: (r[3], r[0]))
    for d in (r for r in by_day if r[2] < 0):
        c = next((c for c in by_day if c[2] == -d[2] and c[1] != d[1] and c[0] not in used and abs((c[3] - d[3]).days) <= 5), None)
        if c:
            used.add(c[0])
            plain.append((d[1], d[0], c[1], c[0], d[2]))
    assert want == sorted(plain) and len(want) > 100
    for part in (20, 100):
        assert sorted(map(tuple, detectors.transfer_pairs(txns, 5, 4096, part).collect())) == want
