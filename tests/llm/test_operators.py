"""The corpus operators against brute force on small tables.

The fixture holds null ids and texts, empty texts, ties, repeated rows, one very long
text, copies, near copies and shared passages, with two extra columns of clashing names.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ledgerloom.llm.base import durable
from ledgerloom.llm import bpe, hilbert_ann, line_dedup, minhash, packing, quality_classifier, quality_rules, sharding, substring_dedup, suffix_dedup, superkmers

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("bucket", T.StringType()), ("label", T.StringType()))])


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode())


def fixture_rows() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 9))) for _ in range(600)]

    def prose(n: int, per_line: int = 12) -> str:
        out = [rng.choice(vocabulary) for _ in range(n)]
        return "\n".join(" ".join(out[i : i + per_line]) for i in range(0, n, per_line))

    passage, base = prose(60, 60), prose(150)
    texts: list[str | None] = [None, "", "   \n\t ", "one", "one two three", base, base, base.replace(vocabulary[0], "zzz", 1)]
    texts += [prose(90) + "\n" + passage + "\n" + prose(40) for _ in range(4)]
    texts += [passage + " " + passage, "a b c " * 60, "x" * 900, "ÄÖ Üß\x0bé 日本語 テキスト <|endoftext|> ``quote'' it's 12,5   nbsp  wide", "Hello   WORLD hello\r\n\r\nworld"]
    texts += [prose(rng.randint(5, 300)) for _ in range(25)]
    changed = base.split()
    for i in (3, 90):
        changed[i] = "changed"
    texts += [" ".join(changed), base.upper(), prose(9000)]
    texts += ["# | <b> & $ % * " * 20 + prose(60), "ONLY CAPITALS HERE " * 30]
    rows = [(i + 1, t, ("en", "de")[i % 2], ("hot", "a", "hot", None)[i % 4], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    return rows + [rows[20], rows[21], (None, prose(50), None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return fixture_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return durable(spark.createDataFrame(rows, SCHEMA).repartition(5))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(frame) -> Counter:
    return Counter(tuple(r) for r in frame.collect())


def covered(units: list[list], k: int) -> list[list[bool]]:
    count = Counter(tuple(u[i : i + k]) for u in units for i in range(len(u) - k + 1))
    out = []
    for u in units:
        gone = [False] * len(u)
        for i in range(len(u) - k + 1):
            if count[tuple(u[i : i + k])] > 1:
                gone[i : i + k] = [True] * k
        out.append(gone)
    return out


def test_substring_dedup(docs, rows, empty):
    units = [words(r[1]) for r in rows]
    want = Counter()
    for r, u, gone in zip(rows, units, covered(units, 35), strict=True):
        want[(r[0], len(u), sum(gone), sha(b" ".join(w for w, g in zip(u, gone, strict=True) if not g)))] += 1
    got = substring_dedup.remove_repeats(docs)
    assert bag(got.select("doc_id", "n_words", "n_removed", F.sha2("text", 256))) == want
    assert {"bucket", "label"} <= set(got.columns)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_cut_keeps_the_bytes_of_untouched_texts(docs):
    got = substring_dedup.remove_repeats(docs, cut=True)
    same = got.where("n_removed = 0").select("doc_id", "text")
    assert bag(same) - bag(docs.select("doc_id", "text")) == Counter()


def test_suffix_dedup(docs, rows, empty):
    units = [list((r[1] or "").encode()) for r in rows]
    want = Counter()
    for r, u, gone in zip(rows, units, covered(units, 200), strict=True):
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        want[(r[0], len(u), sum(gone), spans, sha(bytes(b for b, g in zip(u, gone, strict=True) if not g)))] += 1
    got = suffix_dedup.remove_repeats(docs)
    assert bag(got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.fixture(scope="module")
def headed(spark):
    """Texts of their own words around one passage that is shorter than a window."""
    rng = random.Random(11)
    passage = " ".join(f"head{i}" for i in range(20))
    rows = [(i, " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(40)), passage, *(f"w{rng.randrange(10**6)}" for _ in range(40))])) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows[:20]]
    return rows, durable(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))


@pytest.mark.parametrize(("by_words", "k", "m", "operator"), [(True, 35, 4, substring_dedup), (False, 200, 24, suffix_dedup)])
def test_frequent_grams_do_not_gather_in_a_bucket(headed, monkeypatch, by_words, k, m, operator):
    rows, docs = headed
    monkeypatch.setattr(superkmers, "BUCKET_BYTES", 2 * k * (8 if by_words else 1) * 50)
    frequent = superkmers.frequent_grams(docs, "text", k, m, by_words)
    # the passage's grams and no others (of bytes the lowest quarter), with those cut from one of its words
    assert 5 < len(frequent) <= (17 if by_words else 140)

    def largest(grams):
        blocks = superkmers.blocks(docs.select(F.col("doc_id").alias("_k1"), F.lit(0).alias("_k2"), "text"), k, m, by_words, 64, k, grams)
        strings = defaultdict(set)
        for bucket, block in blocks.collect():
            strings[bucket].update(superkmers.unpack_block(block)[0])
        return max(map(len, strings.values())) / sum(map(len, strings.values()))

    assert largest(frequent) < 0.06 < 0.12 < largest(frequent[:0])
    units = [words(t) if by_words else list(t.encode()) for _, t in rows]
    want = Counter((r[0], len(u), sum(gone)) for r, u, gone in zip(rows, units, covered(units, k), strict=True))
    assert bag(operator.remove_repeats(docs).select("doc_id", "n_words" if by_words else "n_bytes", "n_removed")) == want
    assert superkmers.frequent_grams(docs.where("false"), "text", k, m, by_words).tolist() == []


def test_collection_transform_of_small_strings():
    rng = random.Random(3)
    for _ in range(20):
        strings = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))).encode() for _ in range(rng.randint(1, 6))]
        at = np.append(0, np.cumsum([len(s) for s in strings]))
        bwt, lcp, place = suffix_dedup.collection(np.frombuffer(b"".join(strings), np.uint8), at, 200)
        ordered = sorted(s[j:] for s in strings for j in range(len(s) + 1))
        assert len(bwt) == len(ordered)
        common = [0] + [next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(ordered, ordered[1:], strict=False)]
        assert lcp.tolist() == common
        assert all(ordered[p] == s for p, s in zip(place.tolist(), strings, strict=True))


@pytest.mark.parametrize("name", [64, 4])
def test_near_duplicates(docs, rows, empty, monkeypatch, name):
    """Also where different sets share a name of four bits."""
    monkeypatch.setattr(minhash, "NAME", name)
    sets = []
    for r in rows:
        u = [w.lower() for w in words(r[1])]
        sets.append({tuple(u[i : i + 4]) for i in range(len(u) - 3)} if len(u) >= 4 else {tuple(u)} if u else set())
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    usable = [i for i, r in enumerate(rows) if r[0] is not None and sets[i]]
    for x, i in enumerate(usable):
        for j in usable[:x]:
            common = len(sets[i] & sets[j])
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[a] = b
    least: dict[int, int] = {}
    for i in usable:
        least[find(i)] = min(least.get(find(i), 1 << 60), rows[i][0])
    want = Counter()
    for i, r in enumerate(rows):
        c = least[find(i)] if i in usable else r[0]
        want[(r[0], len(sets[i]), c, r[0] == c)] += 1
    assert bag(minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")) == want
    assert minhash.near_duplicates(empty).count() == 0


def test_no_near_pair_within_the_guaranteed_distance_is_missed():
    """Each chunk with one component left out finds every pair within REACH."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        sig = rng.integers(0, 1 << 16, minhash.SIZE)
        other = sig.copy()
        other[rng.choice(minhash.SIZE, minhash.REACH, replace=False)] += 1
        wrong = (sig != other).reshape(minhash.CHUNKS, minhash.WIDTH).sum(1)
        assert wrong.min() <= minhash.ERRORS


def test_bitmaps_bound_how_far_sets_are_apart(spark):
    """Of any two lengths, and near enough to tell long pages of one template apart."""
    shared = [f"w{i}" for i in range(3200)]
    rows = [(n, " ".join(shared + [f"own{n}x{i}" for i in range(800)])) for n in range(6)]
    rows += [(10 + n, " ".join(shared[:cut])) for n, cut in enumerate((3, 900, 1020, 1030, 2040, 2060, 3000))]
    sets = [{tuple(t.split()[i : i + 4]) for i in range(max(len(t.split()) - 3, 1))} for _, t in rows]
    signed = {r["doc_id"]: bytes(r["bits"]) for r in minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    bits = [signed[d] for d, _ in rows]
    assert [8 * len(b) for b in bits] == minhash.widths(np.array([len(s) for s in sets])).tolist()
    p, q = np.triu_indices(len(rows), 1)
    apart = np.array([len(sets[i] ^ sets[j]) for i, j in zip(p, q, strict=True)])
    got = minhash.bit_distances(bits, p, q)
    assert (got <= apart).all() and ((apart - got) % 2 == 0).all()
    pages = (p < 6) & (q < 6)
    allowed = 2 * 3997 - 2 * -(-80 * 2 * 3997 // 180)
    assert pages.sum() == 15 and (got[pages] > allowed).all()


def line_brute(rows, percent: int = 80) -> Counter:
    lines = []
    for n, r in enumerate(rows):
        for i, line in enumerate((r[1] or "").split("\n")):
            if u := words(line):
                lines.append((r[0] if r[0] is not None else -1, i, frozenset(w.lower() for w in u), n))
    gone = defaultdict(set)
    for a in lines:
        for b in lines:
            if (b[0], b[1]) < (a[0], a[1]):
                common = len(a[2] & b[2])
                if 100 * common >= percent * (len(a[2]) + len(b[2]) - common):
                    gone[a[3]].add(a[1])
                    break
    out = Counter()
    for n, r in enumerate(rows):
        parts = (r[1] or "").split("\n")
        kept = "\n".join(x for i, x in enumerate(parts) if i not in gone[n])
        out[(r[0], sum(1 for x in parts if words(x)), len(gone[n]), sha(kept.encode()))] += 1
    return out


def test_line_dedup(docs, rows, empty):
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256))
    assert bag(got) == line_brute(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_in_large_groups(spark):
    """More lines share a word than SMALL, so that they meet in two steps."""
    rng = random.Random(9)
    core = [f"w{i}" for i in range(12)]
    rows = []
    for d in range(1, 60):
        line = [rng.choice(core[:2]) if rng.random() < 0.1 else w for w in core]
        line[rng.randrange(12)] = f"v{rng.randrange(6)}"
        line[rng.randrange(12)] = f"u{rng.randrange(9)}"
        rows.append((d, " ".join(line) + "\n" + " ".join(rng.sample(core, 7))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_lines_removed", F.sha2("text", 256))
    assert bag(got) == line_brute(rows)


def test_bpe(docs, rows, empty):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tk.no_truncation()
    tk.no_padding()
    want = Counter()
    for r in rows:
        ids = tk.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], len(ids), sha(" ".join(map(str, ids)).encode()), sha(tk.decode(ids, skip_special_tokens=False).encode()))] += 1
    assert bag(_written(docs, bpe.op6_bpe).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == want
    assert _written(empty, bpe.op6_bpe).count() == 0


def _written(docs, query):
    """A query over a folder that holds this table as documents."""
    import tempfile

    d = tempfile.mkdtemp(prefix="tables-")
    docs.write.parquet(f"{d}/documents.parquet")
    return query(docs.sparkSession, d)


def test_packing(docs, rows, empty):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tk.no_truncation()
    tk.no_padding()
    want, lengths = Counter(), []
    for r in rows:
        ids = np.array([*tk.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[(r[0], n, at, len(part), zlib.crc32(part.tobytes()))] += 1
            lengths.append(len(part))
    got = _written(docs, packing.op8_packing)
    assert bag(got.select("doc_id", "piece", "start", "length", "ids_crc32")) == want
    sequences = defaultdict(list)
    for r in got.collect():
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) <= -(-sum(lengths) // 4096) + 1
    assert _written(empty, packing.op8_packing).count() == 0


def test_the_program_covers_any_histogram():
    rng = random.Random(2)
    for _ in range(15):
        histogram = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 20))}
        plan, made, bound = packing.solve(histogram, 64)
        held: Counter = Counter()
        for content, count in plan:
            assert sum(x * n for x, n in content.items()) <= 64
            for x, n in content.items():
                held[x] += n * count
        assert held == Counter(histogram)
        assert bound <= sum(n for _, n in plan) <= 1.5 * bound + 1
        assert made <= sum(n for _, n in plan)


def test_the_program_makes_most_sequences_and_meets_its_bound():
    rng = np.random.default_rng(6)
    drawn = np.minimum(np.exp(rng.normal(6.3, 1.1, 20_000)).astype(int) + 1, 4096)
    histogram = {int(x): int(n) for x, n in zip(*np.unique(drawn, return_counts=True), strict=True)}
    plan, made, bound = packing.solve(histogram)
    sequences = sum(n for _, n in plan)
    assert made >= 0.5 * sequences
    assert sum(n for c, n in plan if sum(c.values()) > 1) >= 0.8 * sequences
    assert bound <= sequences <= 1.002 * bound + 1


def test_long_words_are_encoded_alike_and_in_linear_time():
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    cache = bpe.cached(public_tokenizers.path("word_bpe_49k.json"), "ids")
    (parts,) = cache.batch([word])
    raw = b"".join(cache.chunks[0][p] for p in parts)
    assert np.frombuffer(raw, "<u4").tolist() == tk.encode(word, add_special_tokens=False).ids


def test_sharding(docs, rows, empty):
    got = sharding.shard_documents(docs, sharding.Tree.of(24)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    slots, of = defaultdict(list), {}
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert of.setdefault(r["doc_id"], (r["shard"], r["grown_shard"])) == (r["shard"], r["grown_shard"])
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, sharding.Tree.of(24)).count() == 0


def test_one_more_shard_takes_rows_only_into_itself_at_every_count(spark):
    ids = spark.range(3000).select(F.col("id").alias("doc_id"))
    counts = [1, 2, 7, 8, 9, 16, 23, 24, 25, 31, 32, 33]
    pairs = [(n, m) for n in counts for m in (n, n + 1)]
    rows = ids.select(*[sharding.shard_of(F.col("doc_id"), sharding.Tree.of(m)).alias(f"s{n}_{m}") for n, m in pairs]).collect()
    for n in counts:
        assert all(r[f"s{n}_{n + 1}"] in (r[f"s{n}_{n}"], n) and 0 <= r[f"s{n}_{n}"] < n for r in rows)
        assert any(r[f"s{n}_{n + 1}"] == n for r in rows)


def test_weights_move_rows_only_between_changed_subtrees(spark):
    ids = spark.range(4000).select(F.col("id").alias("doc_id"))
    tree = sharding.Tree.of(24)
    heavier = tree.weighted(5, 2.0)
    moved = ids.select(sharding.shard_of(F.col("doc_id"), tree).alias("a"), sharding.shard_of(F.col("doc_id"), heavier).alias("b")).where("a <> b").groupBy("a", "b").count().collect()
    assert moved
    # shard 5 lies in region 0 (shards 0-7), rack 4-7: inside other regions nothing moves
    assert all(r["a"] // 8 != r["b"] // 8 or r["a"] // 8 == 0 for r in moved)
    assert all(r["b"] // 8 == 0 for r in moved)


def test_ann(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 64)).astype(np.float32)
    x[40:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 64), (1040, [float("nan")] * 64), (1060, [None] + [1.0] * 63)]
    import tempfile

    d = tempfile.mkdtemp(prefix="tables-")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    got = defaultdict(list)
    for r in hilbert_ann.op5_hilbert_ann(spark, d).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - exact[q, v]) < 1e-9 and v != q for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        best = sorted((-exact[q, v], v) for v in range(600) if v != q)[:20]
        hits += len({v for _, v in best} & {v for _, v, _ in found})
    assert hits / (20 * len(got)) >= 0.9
    none = tempfile.mkdtemp(prefix="tables-")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{none}/embeddings.parquet")
    assert hilbert_ann.op5_hilbert_ann(spark, none).count() == 0


def test_quality_rules(docs, rows, empty):
    want = Counter()
    for r in rows:
        text = r[1] or ""
        u = words(text)
        windows = Counter(tuple(u[i : i + 3]) for i in range(len(u) - 2))
        repeat = {i + o for i in range(len(u) - 2) if windows[tuple(u[i : i + 3])] > 1 for o in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        want[(r[0], len(u), sum(len(w.decode()) for w in u), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), len(u) < 50 or 100 * len(repeat) > 50 * len(u))] += 1
    got = quality_rules.apply_policy(quality_rules.settled(quality_rules.ledger(docs)))
    assert bag(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
    assert got.where("base_failed and kept").isEmpty()
    assert quality_rules.ledger(empty).count() == 0


def test_ablations_agree_with_the_ledger(docs):
    ledger = quality_rules.ledger(docs).select("failed").collect()
    for r in quality_rules.ablations(quality_rules.ledger(docs)).collect():
        bit = quality_rules.mask_of([r["rule"]])
        mask = next(p.mask for p in quality_rules.POLICIES if p.version == r["policy"])
        assert r["n_failed"] == sum(bool(x["failed"] & bit) for x in ledger)
        assert r["n_only"] == sum(x["failed"] & mask == bit for x in ledger)


def test_classifier_on_held_out_labels(spark):
    """Fitted on half of the labels; the other half and the toxic documents judge it."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    got = quality_classifier.classify(docs, labels.where(half)).join(labels.where(~half), "doc_id").toDF("doc_id", "evidence", "host_rate", "path_rate", "quality", "toxic", "kept", "y", "t").collect()
    right = sum((r["quality"] >= 0.5) == (r["y"] == 1) for r in got) / len(got)
    assert right >= 0.85
    assert sum(r["toxic"] == (r["t"] == 1) for r in got) / len(got) >= 0.95


def test_classifier_edge_cases(docs, rows, empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_classifier.classify(docs, none).count() == len(rows)
    assert quality_classifier.classify(empty, none).count() == 0


def test_toxic_documents_are_found_in_every_language(spark):
    """Recall by language on labels that took no part in fitting, and false alarms."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = quality_classifier.classify(docs, labels.where(half)).select("doc_id", F.col("toxic").cast("int").alias("found"))
    judged = found.join(labels.where(~half), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    for r in judged.groupBy("lang").agg(F.avg(F.when(F.col("toxic") == 1, F.col("found"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("found"))).alias("wrong")).collect():
        assert r["recall"] >= 0.8 and r["wrong"] <= 0.05, r


def test_classifier_on_hosts_and_paths_of_urls(spark):
    """Rates of sparse sites against the shrinkage computed by hand."""
    rng = random.Random(8)
    rows = []
    for i in range(300):
        host, path = rng.randrange(12), rng.randrange(1, 40)  # most paths have one document
        rows.append((i, None if i % 50 == 7 else f"https://h{host}.example/p{path}/x?q={i}", ("# $ % & " if host % 3 == 0 else "") * 20 + "some plain words here " * rng.randint(1, 9)))
    docs = spark.createDataFrame(rows, "doc_id long, url string, text string")
    labels = spark.createDataFrame([(i, int("#" not in t), 0) for i, _, t in rows[:120]], "doc_id long, quality int, toxic int")
    site = {i: (None, None) if u is None else (u.split("/")[2], "/" + "/".join(u.split("?")[0].split("/")[3:])) for i, u, _ in rows}
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels, host="parse_url(url, 'HOST')", path="parse_url(url, 'PATH')").collect()}
    assert len(got) == len(rows)
    p = {i: 1 / (1 + np.exp(-r["evidence"])) for i, r in got.items()}

    def rates(of: dict, parent: dict) -> dict:
        groups = defaultdict(list)
        for i, key in of.items():
            groups[key].append(i)
        mean = {k: np.mean([p[i] for i in g]) for k, g in groups.items()}
        m = np.mean(list(mean.values()))
        v = np.mean([(mean[k] - parent[g[0]]) ** 2 - np.var([p[i] for i in g]) / len(g) for k, g in groups.items()])
        strength = min(max(m * (1 - m) / max(v, 1e-6) - 1, 1.0), 1e4)
        return {i: (len(g) * mean[k] + strength * parent[i]) / (len(g) + strength) for k, g in groups.items() for i in g}

    hosts = rates({i: s[0] for i, s in site.items()}, dict.fromkeys(site, np.mean(list(p.values()))))
    paths = rates(site, hosts)
    assert all(abs(r["host_rate"] - hosts[i]) < 1e-6 and abs(r["path_rate"] - paths[i]) < 1e-6 for i, r in got.items())


def test_ann_of_mixed_lengths_doubles_and_one_direction(spark):
    """Each length is searched apart; scores are exact for doubles; vectors of one direction
    share their keys and are still searched."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8))
    x[100:200] = np.outer(np.arange(1, 101) * 1e40, x[100])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [1.0] * 9)] + [(1000 + i, [float(i), 2.0, -1.0]) for i in range(4)]
    got = hilbert_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id % 50 = 0", k=5).collect()
    exact = x @ x.T
    for q in range(0, 300, 50):
        best = sorted((-exact[q, v], v) for v in range(300) if v != q)[:5]
        found = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [v for _, v, _ in found] == [v for _, v in best]
        assert all(abs(s - exact[q, v]) <= 1e-12 * abs(exact[q, v]) for _, v, s in found)
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 1000] == [(1001, 5.0), (1002, 5.0), (1003, 5.0)]
    assert not [r for r in got if r["query_id"] == 900]


@pytest.mark.parametrize("kind", ["isotropic", "clustered"])
def test_ann_measures_its_window(spark, monkeypatch, kind):
    """Ranges and slices far smaller than the table: the window follows the data."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 24))
    if kind == "clustered":
        x = x[rng.integers(0, 60, 3000)] + 0.2 * x
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for name, value in (("SAMPLE", 500), ("RANGE_ROWS", 20), ("PROBES", 40)):
        monkeypatch.setattr(hilbert_ann, name, value)
    got = {(r["query_id"], r["vec_id"]) for r in hilbert_ann.nearest(docs, "vec_id % 20 = 0", k=10).collect()}
    exact = x @ x.T
    np.fill_diagonal(exact, -np.inf)
    hits = sum((q, int(v)) in got for q in range(0, 3000, 20) for v in np.argsort(-exact[q])[:10])
    assert len(got) == 1500 and hits >= 0.9 * 1500


def test_ann_recall_with_narrow_windows(spark):
    """Windows far narrower than the ranges, and queries at the ends of ranges."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(3000, 6)) @ rng.normal(size=(6, 32))).astype(np.float32)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    held = hilbert_ann.RANGE_ROWS
    hilbert_ann.RANGE_ROWS = 400
    try:
        got = {(r["query_id"], r["vec_id"]) for r in hilbert_ann.nearest(docs, "vec_id % 50 = 0", k=10, window=100).collect()}
    finally:
        hilbert_ann.RANGE_ROWS = held
    exact = x.astype(np.float64) @ x.astype(np.float64).T
    np.fill_diagonal(exact, -np.inf)
    hits = sum((q, int(v)) in got for q in range(0, 3000, 50) for v in np.argsort(-exact[q])[:10])
    assert hits >= 0.9 * 600


def other_rows() -> list[tuple]:
    """One id with different texts, Thue-Morse words (equal under any polynomial modulo
    2**64), and passages that repeat."""
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7))) for _ in range(n))
    a, b = prose(120), prose(120)
    near = lambda t: t + " extra words"
    tm = "a"
    for _ in range(11):
        tm += tm.translate(str.maketrans("ab", "ba"))
    flipped = tm.translate(str.maketrans("ab", "ba"))
    lead, tail = prose(20), prose(20)
    odd = [f"{lead} {w} {tail}" for w in (tm, flipped)]
    rows = [(5, a), (5, b), (7, near(a)), (8, near(b)), (20, odd[0]), (21, odd[1]), (22, tm + " x y z"), (23, flipped + " x y z"), (30, "\n".join([a, b, a]))]
    return rows + [(40 + i, f"{prose(8)} {a[: 500 + i]} {prose(8)}") for i in range(4)]


CLASHES = ("spans", "_k1", "_k2", "key", "key1", "gone", "kept", "n_words", "n_removed", "n_lines", "n_bytes", "node", "words", "bucket", "slot", "label")


@pytest.fixture(scope="module")
def others(spark):
    frame = spark.createDataFrame(other_rows(), "doc_id long, text string")
    return durable(frame.select("*", *[F.lit(c).alias(c) for c in CLASHES]))


def test_columns_of_any_name_are_carried(others):
    for frame, own in ((substring_dedup.remove_repeats(others, k=10), {"n_words", "n_removed"}), (suffix_dedup.remove_repeats(others), {"kept", "n_bytes", "n_removed"}), (line_dedup.dedup_lines(others), {"n_lines"})):
        got = frame.collect()
        assert len(got) == len(other_rows())
        assert all(r[c] == c for r in got for c in CLASHES if c not in own)
        assert not any(isinstance(r[c], str) for r in got for c in own)
    assert minhash.near_duplicates(others).count() == len(other_rows())
    assert sharding.shard_documents(others, sharding.Tree.of(24)).count() == len(other_rows())
    assert packing.token_pieces(others).count() >= len(other_rows())
    assert bpe.encode_decode(others).count() == len(other_rows())
    assert quality_rules.ledger(others).count() == len(other_rows())


@pytest.mark.parametrize("k", [10, 35])
def test_substring_dedup_compares_bytes(others, k):
    rows = other_rows()
    units = [words(r[1]) for r in rows]
    want = Counter((r[0], len(u), sum(gone), sha(b" ".join(w for w, g in zip(u, gone, strict=True) if not g))) for r, u, gone in zip(rows, units, covered(units, k), strict=True))
    assert bag(substring_dedup.remove_repeats(others, k=k).select("doc_id", "n_words", "n_removed", F.sha2("text", 256))) == want


@pytest.mark.parametrize("k", [40, 200, 300])
def test_suffix_dedup_of_any_width(others, k):
    rows = other_rows()
    units = [list(r[1].encode()) for r in rows]
    want = Counter((r[0], sum(gone), sha(bytes(b for b, g in zip(u, gone, strict=True) if not g))) for r, u, gone in zip(rows, units, covered(units, k), strict=True))
    assert bag(suffix_dedup.remove_repeats(others, k=k).select("doc_id", "n_removed", F.sha2("kept", 256))) == want


def test_near_duplicates_of_rows_that_share_an_id(others):
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(others).collect()}
    assert {(5, 5), (7, 5), (8, 5), (22, 22), (23, 23)} <= got


@pytest.mark.parametrize("percent", [50, 60, 70, 80, 90, 100])
@pytest.mark.parametrize("hot", [1 << 17, 2])
def test_line_dedup_at_any_threshold(spark, others, monkeypatch, percent, hot):
    """With frequent words keyed alone, or together with the words after them."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "HOTTER", 2)
    rng = random.Random(percent)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = [(d, "\n".join(" ".join(rng.sample(vocabulary[: rng.choice((8, 30))], rng.randint(1, 8))) for _ in range(4))) for d in range(40)]
    rows += [(100, "aa bb cc"), (101, "aa bb cc dd")] + other_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs, percent).select("doc_id", "n_lines", "n_lines_removed", F.sha2("text", 256))
    assert bag(got) == line_brute(rows, percent)


def test_near_duplicates_with_keys_in_blocks(spark, monkeypatch):
    """Families just above and below the threshold, their keys dealt by blocks of two nodes and
    a hub's pairs to parts of two."""
    monkeypatch.setattr(minhash, "BLOCK", 2)
    monkeypatch.setattr(minhash, "PART", 2)
    rng = random.Random(31)
    rows = []
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(200)]
        for n in range(9):
            text = list(base)
            for i in rng.sample(range(200), 4 + n):
                text[i] = f"x{rng.randrange(10**6)}"
            rows.append((family * 100 + n, " ".join(text)))
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(197)} for d, t in rows}
    root = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == root
