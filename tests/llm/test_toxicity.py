"""The network's gradients, its windows, and its scores on labels it has not seen."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity as tx
from ledgerloom.llm.base import table
from ledgerloom.llm.spans import terms

from .test_operators import SCHEMA, fixture_rows

TABLES = "/root/testdata/sf0.1"


def test_gradients_are_those_of_finite_differences():
    rng = np.random.default_rng(3)
    net = tx.Network(rng, np.float64)
    x = rng.standard_normal((tx.WINDOW, 5, tx.INPUTS))
    has = np.arange(tx.WINDOW)[:, None] < np.array([tx.WINDOW, 7, 1, 0, 20])
    y = np.array([1.0, 0, 1, 0, 1])
    _, grads = net.gradients(x, has, y)
    assert set(grads) == set(net.weights)
    for name, w in net.weights.items():
        for i in rng.choice(w.size, min(w.size, 6), replace=False):
            at = np.unravel_index(i, w.shape)
            old, losses = w[at], []
            for step in (1e-5, -1e-5):
                w[at] = old + step
                losses.append(net.gradients(x, has, y)[0])
            w[at] = old
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grads[name][at], rel=1e-4, abs=1e-8), name


def test_windows_overlap_by_half_and_hold_every_term():
    sizes = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    row_at = np.append(0, np.cumsum(sizes))
    row, first, size = tx.windows(row_at)
    assert sorted(set(row.tolist())) == list(range(len(sizes)))
    for r, n in enumerate(sizes.tolist()):
        own = [(f - row_at[r], k) for f, k in zip(first[row == r].tolist(), size[row == r].tolist(), strict=True)]
        assert [f for f, _ in own] == list(range(0, tx.STRIDE * len(own), tx.STRIDE))
        assert {i for f, k in own for i in range(f, f + k)} == set(range(n))
        assert all(k == tx.WINDOW for _, k in own[:-1])


def test_scoring_windows_together_or_alone_is_the_same():
    rng = np.random.default_rng(4)
    net = tx.Network(rng)
    x = np.vstack([rng.standard_normal((90, tx.INPUTS)), np.zeros((1, tx.INPUTS))]).astype(np.float32)
    first, size = np.array([0, 16, 80, 90, 5]), np.array([32, 32, 10, 0, 1])
    together = net.logits(x, first, size)
    for k in range(len(first)):
        assert net.logits(x, first[k : k + 1], size[k : k + 1])[0] == pytest.approx(together[k], abs=1e-5)


def test_inflected_words_share_the_slots_of_their_stem():
    raw = np.frombuffer(b"Stemming stems st", np.uint8)
    got = tx.slots(terms(raw, np.array([0, len(raw)])))
    assert got[1, 0] == got[1, 1] and got[2, 0] == got[2, 1] and got[3, 0] != got[3, 1]
    assert (got[1:, 2] == tx.SLOTS).all() and (got[0] < tx.SLOTS).all()


@pytest.fixture(scope="module")
def model(spark):
    return tx.learn(table(spark, TABLES, "documents"), table(spark, TABLES, "labels"))


def test_held_out_labels_are_found_in_every_language(spark, model):
    labels, docs = table(spark, TABLES, "labels"), table(spark, TABLES, "documents")
    scored = tx.score(docs, model).select("*", (F.col("score") >= tx.THRESHOLD).cast("int").alias("predicted"))
    rows = scored.where(tx.held_out(F.col("doc_id"))).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").select("lang", "toxic", "predicted", "score").collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert len(toxic) > 80 and len(clean) > 600
    for lang in {r["lang"] for r in toxic}:
        own = [r["predicted"] for r in toxic if r["lang"] == lang]
        assert sum(own) >= 0.85 * len(own), lang
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.fixture
def small(spark, monkeypatch):
    """Tables to learn from in few steps: what is learned does not matter."""
    monkeypatch.setattr(tx, "STEPS", 40)
    tables = "/root/testdata/sf0.001"
    return table(spark, tables, "documents"), table(spark, tables, "labels")


def test_columns_and_folds(spark, small):
    scored = tx.op11_toxicity(spark, "/root/testdata/sf0.001")
    assert dict(scored.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = scored.collect()
    assert len(rows) == small[0].count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_held_out_labels_sources_and_partitions_change_nothing(spark, small):
    docs, labels = small
    other = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one = tx.score(docs, tx.learn(docs, labels)).collect()
    moved = docs.withColumn("source", F.lit("x")).withColumn("lang", F.lit("y")).repartition(7)
    two = tx.score(moved, tx.learn(moved, other)).collect()
    assert sorted((r["doc_id"], round(r["score"], 5)) for r in one) == sorted((r["doc_id"], round(r["score"], 5)) for r in two)


def test_edge_cases(spark, small):
    docs = spark.createDataFrame(fixture_rows(), SCHEMA)
    model = tx.learn(*small)
    rows = tx.score(docs, model).collect()
    assert len(rows) == len(fixture_rows()) and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[1] == by_id[2] == by_id[3]  # null, empty, white space only
    assert tx.score(docs.limit(0), model).count() == 0
    none = tx.learn(small[0], small[1].where("toxic = 0"))
    assert {r["score"] for r in tx.score(docs, none).collect()} == {none.share} and none.share < 0.3
    assert tx.learn(small[0], small[1].limit(0)).share == 0.5
    twice = small[1].union(small[1]).union(small[1].selectExpr("cast(null as long)", "1", "1")).union(small[1].selectExpr("doc_id", "quality", "cast(null as int)"))
    assert tx.learn(small[0], twice).scores is not None


def test_a_very_long_text_is_read_to_its_end(spark, model):
    rows = table(spark, TABLES, "documents").join(table(spark, TABLES, "labels"), "doc_id").where("length(text) between 500 and 3000").orderBy("doc_id").select("toxic", "text").collect()
    score = lambda *t: model.scores(tx.pa.array(t)).tolist()
    clean = min((r["text"] for r in rows if not r["toxic"]), key=lambda t: score(t)[0])
    worst = max((r["text"] for r in rows if r["toxic"]), key=lambda t: score(t)[0])
    long = (clean + " ") * (1_000_000 // len(clean))
    a, b = score(long, long + worst)
    assert a < 0.05 and b > a
