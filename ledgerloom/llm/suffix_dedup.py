"""Exact byte-level dedup by column-wise construction of the collection BWT and its
longest common prefixes.

Texts are UTF-8 bytes.  Every byte covered by a string of ``k`` bytes that also starts
anywhere else, the same document included, is removed; strings never cross documents
and are judged on the input.

Spark deals stretches of text to buckets by the minimisers of their k-byte windows
(see ``superkmers``), so equal windows meet and no bucket holds a whole collection.  A
bucket's strings are then the documents of one collection, all inserted at once, from
their last symbol to their first: round j inserts the suffix of length j of every
string that has one.  With B[p] the symbol before the suffix at place p, the suffix cX
goes to the place after all suffixes of smaller first symbol and as many of symbol c
as B holds before X.  The two sequences, transform and common prefixes, lie in
sequential files; a round reads them from front to back and writes them anew with the
round's symbols put in.  The common prefix of cX and its neighbour cY is one more than the
least common prefix between X and Y; prefixes are kept up to ``k``.  The files are nameless
scratch of one task, which no other task or retry needs, and are gone when it closes them.

Only suspects are inserted: equal strings of a bucket first become one with a count; a
string is left out if no other string of the bucket has its minimiser and its own windows
differ; and of the others only the stretches whose windows' rolling hashes occur again.
A hash that collides only adds a suspect; the transform decides.

Edge cases: a null text is empty; a text shorter than k loses nothing; repeated rows
remove each other's bytes; a very long text travels as many strings; an empty table gives no
rows; extra columns are carried on, whatever their names, but for those that carry the
result's own.  Cuts may split a character: ``kept`` is binary.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import BYTE_MUL, U64, rolled, slices, table
from .superkmers import Bucket, repeated_spans, run_spans, span_mask, with_spans

WINDOW, GRAM = 200, 24
#: A byte that UTF-8 never has: no symbol known before this suffix.
OPEN = 0xFF


class Sequence:
    """One of the sequences, which only grows: a round reads one file from front to back
    and writes the other anew, and the two change places."""

    def __init__(self, kind: type, values: np.ndarray):
        self.kind, self.file, self.spare = kind, tempfile.TemporaryFile(), tempfile.TemporaryFile()
        self.write(values)

    def read(self) -> np.ndarray:
        out = np.empty(self.size, self.kind)
        self.file.seek(0)
        self.file.readinto(out)
        return out

    def write(self, values: np.ndarray) -> None:
        self.size = len(values)
        self.spare.seek(0)
        self.spare.write(values.astype(self.kind, copy=False))
        self.file, self.spare = self.spare, self.file

    def close(self) -> None:
        self.file.close()
        self.spare.close()


def collection(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BWT, common prefixes with the entry before (up to k) and the place of every
    whole string, for the strings data[at[i]:at[i + 1]].  Ends sort first, by string."""
    n = len(at) - 1
    size = np.diff(at)
    of_prefix = np.min_scalar_type(k)
    files = Sequence(np.uint8, np.full(n, OPEN)), Sequence(of_prefix, np.zeros(n))
    place = np.arange(n)
    by_size = np.argsort(-size, kind="stable")
    going = n
    for j in range(1, int(size.max(initial=0)) + 1):
        while size[by_size[going - 1]] < j:
            going -= 1
        active = by_size[:going]
        active = active[np.argsort(place[active])]
        p = place[active]
        c = data[at[active + 1] - j]
        bwt, lcp = (f.read() for f in files)
        bwt[p] = c
        # Places of known symbols in the order of the suffixes that they begin.
        order = np.argsort(bwt, kind="stable")
        total = len(bwt) - int((bwt == OPEN).sum())
        order = order[:total]
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(total)
        r = rank[p]
        # One more than the least common prefix on the way from the last equal symbol, and to the next.
        prev, follow = np.maximum(r - 1, 0), np.minimum(r + 1, total - 1)
        has_prev, has_next = (r > 0) & (bwt[order[prev]] == c), (r + 1 < total) & (bwt[order[follow]] == c)
        back, ahead = np.zeros((2, going), of_prefix)
        for has, lo, hi, to in ((has_prev, order[prev], p, back), (has_next, p, order[follow], ahead)):
            if has.any():
                spans = np.empty(2 * int(has.sum()), np.int64)
                spans[0::2], spans[1::2] = lo[has] + 1, hi[has] + 1
                least = np.minimum.reduceat(np.append(lcp, lcp[:1]), spans)[0::2]
                to[has] = np.minimum(least.astype(np.int64) + 1, k)
        new = n + r
        kept = np.ones(len(bwt) + going, bool)
        kept[new] = False
        old = np.flatnonzero(kept)
        longer = np.full(len(kept), OPEN, np.uint8)
        longer[old] = bwt
        prefix = np.empty(len(kept), of_prefix)
        prefix[old] = lcp
        prefix[new] = back
        after = new[has_next] + 1  # its neighbour's prefix is now with the new suffix
        prefix[after] = ahead[has_next]
        for f, values in zip(files, (longer, prefix), strict=True):
            f.write(values)
        place = old[place]
        place[active] = new
    bwt, lcp = (f.read() for f in files)
    for f in files:
        f.close()
    return bwt, lcp, place


def repeats_itself(string: bytes, k: int, m: int) -> bool:
    """Whether two windows of a string may be equal.  All windows hold the m bytes before
    the last one's start, and equal windows at a distance bring them again at that distance."""
    n = len(string) - k + 1
    return n > k - m + 1 or string.find(string[n - 1 : n - 1 + m], n) >= 0


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(x) for x in parts], dtype=np.int64))


def suspects(parts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows whose hash occurs again: (part, first byte, stop byte)."""
    data, at = joined(parts)
    hashes = rolled(data.astype(U64) + U64(1), k, BYTE_MUL)
    row = np.repeat(np.arange(len(parts)), np.diff(at))
    whole = np.flatnonzero(row[: len(hashes)] == row[k - 1 :])
    hashes = hashes[whole]
    order = np.argsort(hashes)
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    flag = np.zeros(len(whole), bool)
    flag[order[same]] = flag[order[same + 1]] = True
    return run_spans(flag, row[whole], whole - at[row[whole]], k)


def matched(parts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that occur again in the collection of parts: (part, first byte, stop byte)."""
    data, at = joined(parts)
    bwt, lcp, place = collection(data, at, k)
    n = len(parts)
    order = np.argsort(bwt, kind="stable")
    match = lcp >= k
    match[:-1] |= lcp[1:] >= k
    # Read every string from its first byte on, following the BWT backwards.
    windows = np.diff(at) - k + 1
    by_size = np.argsort(-windows, kind="stable")
    owners, offsets = [], []
    going, where = n, place[by_size]
    for i in range(int(windows.max())):
        while windows[by_size[going - 1]] <= i:
            going -= 1
        hit = np.flatnonzero(match[where[:going]])
        owners.append(by_size[hit])
        offsets.append(np.full(len(hit), i))
        where = order[where[:going] - n]
    owner, offset = np.concatenate(owners), np.concatenate(offsets)
    sort = np.lexsort((offset, owner))
    return run_spans(np.ones(len(owner), bool), owner[sort], offset[sort], k)


def repeated_bytes(bucket: Bucket, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of bytes covered by repeated windows: (string, first byte, stop byte)."""
    lengths = np.fromiter(map(len, bucket.strings), np.int64, len(bucket.strings))
    again = np.flatnonzero(bucket.count > 1)
    found = [(again, np.zeros(len(again), np.int64), lengths[again])]
    _, inverse, count = np.unique(bucket.marks, return_inverse=True, return_counts=True)
    chosen = count[inverse] > 1
    for i in np.flatnonzero(~chosen).tolist():
        chosen[i] = repeats_itself(bucket.strings[i], k, m)
    which = np.flatnonzero(chosen)
    if len(which):
        string, first, stop = suspects([bucket.strings[i] for i in which.tolist()], k)
        string = which[string]
        # Equal stretches are one part; a part of several stretches repeats.
        have: dict[bytes, int] = {}
        of = np.fromiter((have.setdefault(bucket.strings[s][a:b], len(have)) for s, a, b in zip(string.tolist(), first.tolist(), stop.tolist(), strict=True)), np.int64, len(string))
        several = np.bincount(of, minlength=len(have))[of] > 1
        found.append((string[several], first[several], stop[several]))
        parts = list(have)
        p, a, b = suspects(parts, k) if parts else (of, of, of)
        if len(p):
            q, c, d = matched([parts[i][x:y] for i, x, y in zip(p.tolist(), a.tolist(), b.tolist(), strict=True)], k)
            part, lo, hi = p[q], a[q] + c, a[q] + d
            order = np.argsort(of, kind="stable")
            at = np.searchsorted(of[order], np.arange(len(parts) + 1))
            n = (at[1:] - at[:-1])[part]
            each = order[np.repeat(at[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            found.append((string[each], first[each] + np.repeat(lo, n), first[each] + np.repeat(hi, n)))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The other columns of ``docs`` with kept (binary), n_bytes, n_removed and n_spans."""
    docs = docs.drop(*(c for c in ("kept", "n_bytes", "n_removed", "n_spans") if c not in (id_col, text_col)))
    spans = repeated_spans(docs, k, m, False, partial(repeated_bytes, m=m), id_col, text_col, most=k)
    rows = with_spans(docs, spans, id_col, text_col)
    place = rows.columns.index(text_col)
    names = [c for c in rows.columns[:-1] if c != text_col]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 2 << 20):
            kept, counts = [], []
            for text, span in zip(batch.column(place).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                text = text or b""
                if not span.is_valid:
                    kept.append(text)
                    counts.append((len(text), 0, 0))
                    continue
                gone = span_mask(span.values.to_numpy(zero_copy_only=False), len(text))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                counts.append((len(text), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())))
            rest = [c for i, c in enumerate(batch.columns[:-1]) if i != place]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(kept, pa.binary()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3))], [*names, "kept", "n_bytes", "n_removed", "n_spans"])

    return rows.mapInArrow(run, schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable] = {"op4_suffix_dedup": op4_suffix_dedup}
ORACLE: dict[str, str] = {}
