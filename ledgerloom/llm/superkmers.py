"""Super-k-mer partitioning: windows of k tokens meet in buckets of their minimisers.

Every window of k tokens has a minimiser, the smallest hash of the m-grams in it.
Consecutive windows with one minimiser form a super-k-mer, which travels as one packed
string: its text is sent once, not once for each window.  Equal windows have equal
minimisers, so they meet in one bucket, and windows are never compared across buckets.

A task merges equal super-k-mers before the shuffle and sends one compressed block to
each bucket: the distinct strings, and for each occurrence its row and first token.
Copies therefore cost a few bytes each, and a passage with very many copies reaches
its bucket as one string from each task.

The number of buckets follows the bytes of text, so that a bucket's strings stay near
BUCKET_BYTES whatever the input.  An m-gram that stands in very many places would gather
all their surroundings in one bucket; grams that occur more often than a bucket can hold
are therefore counted first and stand behind all others in the order.  A window on the
edge of a common passage then takes a gram of what surrounds the passage, and only
windows of nothing but frequent grams, which are the passage itself, keep one of them.
The order is the same for every window, so equal windows still meet.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BYTE_MUL, WORD_MUL, U64, Words, free_name, mix, powers, rolled, row_key, shuffle_partitions, slices, sliding_min, text_bytes, texts

#: Bytes of strings that a bucket is planned to hold, and how many times the text they are.
BUCKET_BYTES, SPREAD = 4 << 20, 3.2
#: Text bytes of a slice; bytes of strings that a task packs at once.
SLICE, FLUSH = 1 << 20, 24 << 20
#: Grams that a task counts at once; times that one must occur among them to be reported.
COUNTED, REPORTED = 1 << 22, 4
#: Frequent grams that the order knows, the most frequent: 8 bytes each go to every task.
FREQUENT = 1 << 16


def tokens_of(column: pa.Array, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, token values, token starts, token ends and first token of each row."""
    data, at = texts(column)
    if words:
        w = Words(data, at)
        return data, w.hashes if len(w) else np.zeros(0, U64), w.starts, w.ends, w.row_at
    n = np.arange(len(data) + 1)
    return data, data.astype(U64) + U64(1), n[:-1], n[1:], at


def gram_hashes(values: np.ndarray, m: int, words: bool) -> np.ndarray:
    """Hashes below 2**63 of every m consecutive tokens."""
    return mix(rolled(values, m, WORD_MUL if words else BYTE_MUL)) >> U64(1)


def frequent_grams(docs: DataFrame, text_col: str, k: int, m: int, words: bool) -> np.ndarray:
    """Sorted hashes of the grams that occur too often for one bucket, at most FREQUENT.
    Every word gram is counted, and every byte gram whose hash is in the lowest quarter,
    where nearly all minimisers are.  A gram that no task meets REPORTED times among
    COUNTED others is left out, as are grams less frequent than the FREQUENT first: what
    is left out costs the balance of buckets and changes no result."""
    below = U64(1 << 63 if words else 1 << 61)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counts() -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = n >= REPORTED
            return pa.RecordBatch.from_arrays([pa.array(gram[often].astype(np.int64)), pa.array(n[often].astype(np.int64))], ["gram", "n"])

        for batch in slices(batches, "text", SLICE):
            grams = gram_hashes(tokens_of(batch.column(0), words)[1], m, words)
            held.append(grams[grams < below])
            if sum(map(len, held)) >= COUNTED:
                yield counts()
        if held:
            yield counts()

    least = BUCKET_BYTES // (2 * k * (8 if words else 1))
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") > least).orderBy(F.desc("n"), "gram").limit(FREQUENT).select("gram").collect()
    return np.sort(np.array([r[0] for r in rows], np.int64)).astype(U64)


def runs(values: np.ndarray, row_at: np.ndarray, k: int, m: int, words: bool, most: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of every super-k-mer."""
    none = np.zeros(0, np.int64)
    if len(values) < k:
        return none, none, none.astype(U64)
    grams = gram_hashes(values, m, words)
    if len(frequent):
        grams[frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams] |= U64(1 << 63)
    least = sliding_min(grams, k - m + 1)
    n = len(least)
    row_end = np.repeat(row_at[1:], np.diff(row_at))[:n]
    valid = np.arange(n) + k <= row_end
    if not valid.any():
        return none, none, none.astype(U64)
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(begins)
    stops = valid.copy()
    stops[:-1] &= ~valid[1:] | begins[1:]
    size = np.flatnonzero(stops) + 1 - first
    if (size > most).any():  # text that repeats itself: cut long runs, the bucket stays the same
        parts = -(-size // most)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        whole = np.repeat(size, parts)
        first = np.repeat(first, parts) + nth * most
        size = np.minimum(most, whole - nth * most)
    return first, size, least[first]


def pack_block(strings: list[bytes], marks: np.ndarray, string: np.ndarray, k1: np.ndarray, k2: np.ndarray, first: np.ndarray) -> bytes:
    """Distinct strings with a mark each, and (string, row key, first token) of each occurrence."""
    lengths = np.fromiter(map(len, strings), np.int32, len(strings))
    body = b"".join([struct.pack("<ii", len(strings), len(string)), lengths.tobytes(), marks.astype(np.uint32).tobytes(), string.astype(np.int32).tobytes(), first.astype(np.int32).tobytes(), k2.astype(np.int32).tobytes(), k1.astype(np.int64).tobytes(), *strings])
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(body)


def unpack_block(blob: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(blob)
    n, o = struct.unpack_from("<ii", body)
    at = 8
    out = []
    for count, kind in ((n, np.int32), (n, np.uint32), (o, np.int32), (o, np.int32), (o, np.int32), (o, np.int64)):
        out.append(np.frombuffer(body, kind, count, at))
        at += out[-1].nbytes
    stops = (at + np.cumsum(out[0], dtype=np.int64)).tolist()
    return [body[a:b] for a, b in zip([at, *stops[:-1]], stops, strict=True)], out[1], out[2], out[3], out[4], out[5]


def blocks(keyed: DataFrame, k: int, m: int, words: bool, buckets: int, most: int, frequent: np.ndarray) -> DataFrame:
    """(bucket, block) rows of a frame (_k1, _k2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            strings = [s for part in held for s in part[0]]
            cols = [np.concatenate([part[i] for part in held]) for i in range(1, 6)]
            held.clear()
            order = np.argsort(cols[0], kind="stable")
            bucket, marks, k1, k2, first = (c[order] for c in cols)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ids, out = [], []
            order = order.tolist()
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)], strict=True):
                have: dict[bytes, int] = {}
                of = np.fromiter((have.setdefault(strings[i], len(have)) for i in order[a:b]), np.int64, b - a)
                mark = np.zeros(len(have), np.int64)
                mark[of] = marks[a:b]
                ids.append(int(bucket[a]))
                out.append(pack_block(list(have), mark, of, k1[a:b], k2[a:b], first[a:b]))
                if len(out) >= 64:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(out, pa.binary())], ["bucket", "block"])
                    ids, out = [], []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(out, pa.binary())], ["bucket", "block"])

        for batch in slices(batches, "text", SLICE):
            data, values, starts, ends, row_at = tokens_of(batch.column(2), words)
            first, n, least = runs(values, row_at, k, m, words, most, frequent)
            if not len(first):
                continue
            row = np.searchsorted(row_at, first, "right") - 1
            raw = data.tobytes()
            strings = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first + n + k - 2].tolist(), strict=True)]
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False)[row] for i in (0, 1))
            held.append((strings, ((least >> U64(32)) % U64(buckets)).astype(np.int64), (least & U64(0xFFFFFFFF)).astype(np.int64), k1, k2, first - row_at[row]))
            size += sum(map(len, strings))
            if size >= FLUSH:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return keyed.mapInArrow(run, "bucket int, block binary")


class Bucket:
    """The distinct strings of a bucket, how often each occurs, and where."""

    def __init__(self, column: pa.ChunkedArray):
        have: dict[bytes, int] = {}
        parts: list[tuple] = []
        marks: list[int] = []
        for blob in column.to_pylist():
            strings, mark, of, first, k2, k1 = unpack_block(blob)
            ids = np.fromiter((have.setdefault(s, len(have)) for s in strings), np.int64, len(strings))
            if len(have) > len(marks):
                new = ids >= len(marks)
                marks.extend(mark[new].tolist())
            parts.append((ids[of], k1, k2, first))
        self.strings = list(have)
        self.marks = np.array(marks, np.int64)
        self.of, self.k1, self.k2, self.first = (np.concatenate([p[i] for p in parts]) for i in range(4))
        self.count = np.bincount(self.of, minlength=len(self.strings))

    def joined(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and bounds of some of the strings."""
        parts = [self.strings[i] for i in which.tolist()]
        at = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=at[1:])
        return np.frombuffer(b"".join(parts), np.uint8), at

    def spans(self, string: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row keys and token spans of every occurrence of spans inside strings."""
        order = np.argsort(self.of, kind="stable")
        at = np.searchsorted(self.of[order], np.arange(len(self.strings) + 1))
        n = (at[1:] - at[:-1])[string]
        which = order[np.repeat(at[string], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        base = self.first[which].astype(np.int64)
        return self.k1[which], self.k2[which], base + np.repeat(start, n), base + np.repeat(stop, n)


def run_spans(flag: np.ndarray, owner: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows of one owner at consecutive places: owner, first token, stop token."""
    i = np.flatnonzero(flag)
    if not len(i):
        return i, i, i
    o, a = owner[i], at[i]
    new = np.ones(len(i), bool)
    new[1:] = (o[1:] != o[:-1]) | (a[1:] != a[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    return o[first], a[first], a[last] + k


def repeated_spans(docs: DataFrame, k: int, m: int, words: bool, find: Callable[[Bucket, int], tuple[np.ndarray, np.ndarray, np.ndarray]], id_col: str, text_col: str, most: int) -> DataFrame:
    """_k1, _k2, spans: for each row that has any, the token spans (start << 32 | stop)
    covered by windows of k tokens that occur again.  ``find`` gives (string, start,
    stop) of the repeated stretches of a bucket's strings."""
    k1, k2 = row_key(id_col, text_col)
    keyed = docs.select(k1, k2, F.col(text_col).alias("text"))
    buckets = max(4 * shuffle_partitions(docs), int(text_bytes(docs, text_col) * SPREAD / BUCKET_BYTES))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        bucket = Bucket(table.column("block"))
        a, b, start, stop = bucket.spans(*find(bucket, k))
        return pa.table({"_k1": pa.array(a, pa.int64()), "_k2": pa.array(b.astype(np.int32), pa.int32()), "span": pa.array((start << 32) | stop, pa.int64())})

    frequent = frequent_grams(docs, text_col, k, m, words)
    found = blocks(keyed, k, m, words, buckets, most, frequent).groupBy("bucket").applyInArrow(count, "_k1 long, _k2 int, span long")
    return found.groupBy("_k1", "_k2").agg(F.collect_list("span").alias("spans"))


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with their spans (null: none) as one more column, the last."""
    k1, k2 = row_key(id_col, text_col)
    a, b, last = (free_name(docs, c) for c in ("key1", "key2", "spans"))
    found = spans.select(F.col("_k1").alias(a), F.col("_k2").alias(b), F.col("spans").alias(last))
    return docs.select("*", k1.alias(a), k2.alias(b)).join(found, [a, b], "left").select(*(f"`{c}`" for c in docs.columns), last)


def span_mask(spans: np.ndarray, n: int) -> np.ndarray:
    """Which of n tokens lie in any span."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, spans >> 32, 1)
    np.add.at(step, spans & 0xFFFFFFFF, -1)
    return np.cumsum(step[:-1]) > 0


__all__ = ["Bucket", "powers", "repeated_spans", "run_spans", "span_mask", "with_spans"]
