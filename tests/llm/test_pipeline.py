"""The stages of the corpus pipeline, each against brute force on its own input."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import pytest

from ledgerloom.llm import quality_rules

from .test_operators import SCHEMA, bag, covered, fixture_rows, line_brute, sha, words


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """The stages as the pipeline runs them: each is written and read again."""
    top = tmp_path_factory.mktemp("stages")
    spark.createDataFrame(fixture_rows(), SCHEMA).write.parquet(f"{top}/documents.parquet")
    frames = [spark.read.parquet(f"{top}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        path = f"{top}/{name.replace(' ', '_')}"
        stage(spark, frames[-1], str(top)).write.parquet(path)
        frames.append(spark.read.parquet(path))
    return frames


def rows_of(frame) -> list[tuple]:
    return [tuple(r) for r in frame.select(*corpus_pipeline.COLUMNS).collect()]


def test_stages_return_the_columns_of_documents(written):
    for frame in written[1:-1]:
        assert frame.columns == list(corpus_pipeline.COLUMNS)


def test_rules_stage(written):
    kept = quality_rules.apply_policy(quality_rules.settled(quality_rules.ledger(written[0], carry=corpus_pipeline.COLUMNS[1:]))).where("kept")
    assert bag(kept.select("doc_id", "text")) == bag(written[1].select("doc_id", "text"))
    assert written[1].count()


def test_lines_stage(written):
    before = rows_of(written[1])
    want = Counter((k[0], k[3]) for k in line_brute(before).elements())
    got = Counter((r[0], sha(r[1].encode())) for r in rows_of(written[2]))
    assert got - want == Counter()
    # only documents without a word may be missing
    assert sum(want.values()) - sum(got.values()) == sum(1 for k in line_brute(before).elements() if k[1] == k[2])


def test_near_stage(written):
    sets = {}
    for r in rows_of(written[2]):
        if r[0] is None:
            continue
        u = [w.lower() for w in words(r[1])]
        sets[r[0]] = {tuple(u[i : i + 5]) for i in range(len(u) - 4)} if len(u) >= 5 else {tuple(u)}
    assert [r for r in rows_of(written[3]) if r[0] is None] == [r for r in rows_of(written[2]) if r[0] is None] != []
    kept = {r[0] for r in rows_of(written[3])} - {None}
    linked = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert not any(a in kept and b in kept for a, b in linked)
    assert all(any(b == gone for _, b in linked) for gone in set(sets) - kept)


def test_substring_stage(written):
    before = rows_of(written[3])
    units = [words(r[1]) for r in before]
    want = {r[0]: [w for w, g in zip(u, gone, strict=True) if not g] for r, u, gone in zip(before, units, covered(units, 35), strict=True)}
    got = {r[0]: words(r[1]) for r in rows_of(written[4])}
    assert got == {k: v for k, v in want.items() if v}


def test_packing_stage_holds_every_document(written):
    ids = {r[0] for r in written[4].select("doc_id").collect()}
    assert ids == {r[0] for r in written[5].select("doc_id").collect()}


def test_run_gives_what_the_stages_give(spark, written, tmp_path):
    spark.createDataFrame(fixture_rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert bag(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32")) == bag(written[5].select("doc_id", "piece", "start", "length", "ids_crc32"))


def test_stages_take_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0


def test_stages_take_nulls_everywhere(spark):
    rows = [(None, None, None, None, None, None, None), (1, None, None, None, None, None, None), (2, "word", None, None, None, None, None), (None, "a few words here", None, None, None, None, None)]
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, spark.createDataFrame(rows, SCHEMA), "")
        assert {r[0] for r in got.select("doc_id").collect()} <= {None, 1, 2}


def test_packing_stage_is_gapless_and_whole(written):
    """The pieces of each document follow each other, and sequences have no gap or overlap."""
    rows = written[5].collect()
    parts, places = {}, {}
    for r in rows:
        parts.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in [x for d, x in parts.items() if d is not None]:
        at = 0
        for n, (piece, start, length) in enumerate(sorted(held)):
            assert (piece, start) == (n, at) and 0 < length <= 4096
            at += length
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
