"""Ranked search against scores of every document and against its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import types as T

from ledgerloom.llm import lexical_search as ls

from .test_operators import SCHEMA, bag, fixture_rows

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.StringType())])


def terms(text) -> list[bytes]:
    raw = (text or "").encode()
    return TERM.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in raw))


def brute(docs, items) -> Counter:
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    whole = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in items:
        ranked = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // max(whole, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in set(terms(text)) if t in b)
            if score > 0:
                ranked.append((-score, i is None, i, score))
        ranked.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out.update((item, k + 1, r[2], r[3]) for k, r in enumerate(ranked[:10]))
    return out


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(13)
    rows = fixture_rows()
    vocabulary = [f"t{k}" for k in range(300)] + ["Äb", "日本", "x" * 70, "Zed"]
    odds = [1 / (k + 1) for k in range(len(vocabulary))]
    for i in range(400):
        words = rng.choices(vocabulary, odds, k=rng.choice((3, 20, 20, 90)))
        rows.append((rng.choice((500 + i, 7, None)), rng.choice((" ", "--", "\n")).join(words), "en", "s", 1, "x", "y"))
    rows += [rows[-1]] * 15  # more equal scores than places
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(30)]
    texts += [None, "", "...", "unknownterm", "the T1 t1 t2", rows[10][1], rows[12][1], rows[5][1], "x" * 70, "äb ÄB Äb"]
    return rows, [(k if k != 3 else None, t, "z") for k, t in enumerate(texts)] + [(1, texts[0], "z"), (1, texts[0], "z")]


def check(spark, rows, items):
    got = ls.rank(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(items, ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert bag(got) == brute([(r[0], r[1]) for r in rows], [(i, t) for i, t, _ in items])


def test_rank_equals_brute_force(spark, searched):
    check(spark, *searched)


@pytest.mark.parametrize("sizes", [(1, 1 << 20, 1 << 18), (37, 4000, 50)])
def test_shards_and_blocks_of_any_size(spark, searched, monkeypatch, sizes):
    monkeypatch.setattr(ls, "ROWS", sizes[0])
    monkeypatch.setattr(ls, "BYTES", sizes[1])
    monkeypatch.setattr(ls, "TERMS", sizes[2])
    rows, items = searched
    check(spark, rows[-120:] if sizes[0] == 1 else rows, items)


def test_empty_tables(spark, searched):
    rows, items = searched
    assert ls.rank(spark.createDataFrame([], SCHEMA), spark.createDataFrame(items, ITEMS)).count() == 0
    assert ls.rank(spark.createDataFrame(rows[:20], SCHEMA), spark.createDataFrame([], ITEMS)).count() == 0


def test_equal_hashes_are_told_apart(searched, monkeypatch):
    from ledgerloom.llm import base

    monkeypatch.setattr(base, "hash_spans", lambda data, starts, ends: np.full(len(starts), 9, np.uint64))
    rows, items = searched
    v = ls.Vocabulary([terms(t) for _, t, _ in items])
    raw = np.frombuffer((rows[-30][1] + " nothing " + rows[-40][1]).encode(), np.uint8)
    w = ls.terms(raw, np.array([0, len(raw)]))
    word, number = v.find(w)
    known = list(dict.fromkeys(t for _, x, _ in items for t in dict.fromkeys(terms(x))))
    assert sorted((int(i), known[k]) for i, k in zip(word, number, strict=True)) == [(i, t) for i, t in enumerate(terms(raw.tobytes().decode())) if t in known]


def test_numbers_survive_their_bytes():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 1 << b, 50) for b in (1, 7, 8, 14, 31, 62)])
    assert (ls.from_bytes(ls.to_bytes(v)) == v).all() and len(ls.from_bytes(ls.to_bytes(v[:0]))) == 0


def test_measure_beyond_64_bits():
    assert ls.measure(np.array([3, 5 * 10**7]), 10**11, 10**13).tolist() == [12, 10 + 45 * 10**6]


def test_query_equals_its_sql(spark):
    tables = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet')")
    want = con.execute(ls.SQL).fetchall()
    assert want and bag(ls.op13_lexical_search(spark, tables)) == Counter(want)
