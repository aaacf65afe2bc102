"""Periodic runs against a search over all periods and places."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import periodic_runs
from ledgerloom.llm.base import U64, Words

from .test_operators import SCHEMA, bag, fixture_rows, words


def brute_runs(u: list) -> list[tuple[int, int, int]]:
    """(start, length, period), by the definition."""
    n, out = len(u), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if u[i] != u[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and u[j] == u[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text) -> tuple:
    u = words(text)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if u and h % 10 == 0:
        g = h // 10
        a = g % len(u)
        p = 1 + (len(u) - a) // (3 + g % 8)
        u = [u[i] if i < a else u[a + (i - a) % p] for i in range(len(u))]
    runs = brute_runs(u)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *head, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(u) if i not in gone)).hexdigest())


@pytest.fixture(scope="module")
def periodic_rows():
    rng = random.Random(12)
    rows = [(r[0], r[1] if not r[1] or len(r[1]) < 20_000 else r[1][:9000], *r[2:]) for r in fixture_rows()]
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 14))]
            parts += unit * rng.randint(1, 9) + unit[: rng.randrange(len(unit))]
            if rng.random() < 0.4:
                parts += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))]
        rows.append((1000 + i, rng.choice((" ", "\n", "\t ")).join(parts), "en", "s", 1, "x", "y"))
    for k, n in enumerate((23, 24, 25, 300)):  # one word over and over, and just too few
        rows.append((2000 + k, "same " * n, "en", "s", 1, "x", "y"))
    return rows


def test_query_equals_brute_force(spark, periodic_rows, tmp_path):
    spark.createDataFrame(periodic_rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic_runs.op12_periodic_runs(spark, str(tmp_path))
    want = [brute_row(r[0], r[1]) for r in periodic_rows]
    assert sum(r[1] for r in want) > 100 and any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in want)
    assert bag(got) == bag_of(want)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}


def bag_of(rows):
    from collections import Counter

    return Counter(rows)


def test_operator_returns_runs_and_texts(spark, periodic_rows):
    rows = [*periodic_rows, (None, None, None, None, None, None, None)]
    got = periodic_runs.collapse_runs(spark.createDataFrame(rows, SCHEMA))
    want = []
    for r in rows:
        u = words(r[1])
        runs = brute_runs(u)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((r[0], len(u), str(runs), b" ".join(w for i, w in enumerate(u) if i not in gone).decode()))
    assert bag_of((r["doc_id"], r["n_words"], str([tuple(x) for x in r["runs"]]), r["text"]) for r in got.collect()) == bag_of(want)
    assert periodic_runs.collapse_runs(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("pairs", [7, 64])
def test_small_chunks_give_the_same_runs(periodic_rows, monkeypatch, pairs):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    data = b"".join((r[1] or "").encode() for r in periodic_rows[-40:])
    at = np.cumsum([0, *(len((r[1] or "").encode()) for r in periodic_rows[-40:])])
    w = Words(np.frombuffer(data, np.uint8), at)
    row, start, stop, q = periodic_runs.verified_runs(w, np.arange(len(w)))
    got = [(r, s - w.row_at[r], e - s, p) for r, s, e, p in zip(row.tolist(), start.tolist(), stop.tolist(), q.tolist(), strict=True)]
    want = [(i, *x) for i, r in enumerate(periodic_rows[-40:]) for x in brute_runs(words(r[1]))]
    assert got == want


def test_words_whose_hashes_collide_are_told_apart(monkeypatch):
    text = ("a b c d e f g h " * 4 + "k l m n o p q r s t u v w x y z " * 2).strip().encode()
    w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    w._hash = np.full(len(w), 7, U64)  # every word has the same hash
    row, start, stop, q = periodic_runs.verified_runs(w, np.arange(len(w)))
    assert list(zip(start.tolist(), (stop - start).tolist(), q.tolist(), strict=True)) == brute_runs(text.split())


def test_sequences_that_cancel_in_powers_of_two():
    tm = [bin(i).count("1") % 2 for i in range(1 << 13)]  # Thue-Morse: no three repeats at all
    values = np.array([11, 12], U64)[tm]
    assert len(periodic_runs.runs_of(values, np.array([0, len(values)]))[0]) == 0


def test_long_text_of_one_period(spark):
    text = " ".join(f"w{i % 997}" for i in range(200_000))
    rows = spark.createDataFrame([(1, text, "en", "s", 1, "x", "y")], SCHEMA)
    got = periodic_runs.collapse_runs(rows).select("runs", F.size(F.split("text", " ")).alias("n")).first()
    assert [tuple(r) for r in got["runs"]] == [(0, 200_000, 997)] and got["n"] == 997
