"""Line dedup by an exact set-similarity join.

A line is a newline-separated part of a text that has a word; its set is its distinct
words, A-Z lower-cased.  A line is removed if an earlier line, by document id and line
number, has a Jaccard similarity of at least ``percent`` / 100 with it.

Words are ordered by rarity, then hash: rarity is the count of the word's cell in a
table of CELLS counters over all documents, which is the same size for any input.  Two
sets of the threshold share a word among the first n - ceil(t * n) + 1 of each (the
prefix), so lines meet in the groups of their prefix words.  There three filters drop
pairs before any leaves the task: length (t * n <= m), position (what follows the
shared word in both sets can still reach the overlap that t asks for) and bitmap (each
word flips one of 64 bits, of 128 in sets over WIDE words, so the bits in which two lines
differ are at most the words in which they do).  The others are verified on the full sets.

A word that is frequent in the corpus is too coarse a key.  Sets that share any word in
their prefixes also share their first l words in common within prefixes that are l - 1
words longer; so a word above HOT occurrences is keyed together with the next one, two or
three words of its set, by its count alone, and both lines of a pair do the same.

Equal sets are found apart, by hash, and only their earliest line goes on.  Within a
group a line names the earliest and the closest line that pass the filters with it.
Where neither is confirmed for a line, though more passed, the word sets of the groups
concerned are sent to them and compared there.  So the result is exact, and only named
partners ever leave a task as pairs.  Lines
travel between tasks as compressed columns, one block for each task and bucket; word sets
travel only for lines of a pair (and those that a fixed-size bitmap of them lets through).

Edge cases: a null or empty text has no lines; lines without words are kept and not
counted; lines of one number in rows of one id are neither earlier, so repeated rows keep
what one row keeps; rows without an id come before all others, by a hash of their text;
a very long line is one set as any other; an empty table gives no rows; extra columns are
carried on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import U64, Words, discard, durable, free_name, lower_ascii, mix, shuffle_partitions, slices, table, text_bytes, texts

PERCENT = 80
#: Counters of the rarity table, and the parts in which tasks send theirs.
CELLS, PARTS = 1 << 18, 64
#: Occurrences from which a word is a key only with the next words, and the step to one more of them.
HOT, HOTTER, DEEPEST = 1 << 17, 1 << 7, 4
#: Words above which a set has 128 bits.
WIDE = 48
#: Pairs compared at once.
CHUNK = 1 << 18
#: Bits of the table of lines whose sets are wanted.
WANTED = 1 << 25
#: Bytes planned for a bucket, and bytes of postings that a task packs at once.
BUCKET_BYTES, FLUSH = 4 << 20, 24 << 20
SETS = (("k1", np.int64), ("line", np.int32), ("s1", np.uint64), ("s2", np.uint64))
PREFIXES = (("token", np.uint32), ("n", np.uint32), ("pos", np.uint32), ("k1", np.int64), ("line", np.int32), ("s1", np.uint64), ("b1", np.uint64), ("b2", np.uint64))


def line_key(id_col: str, text_col: str) -> Column:
    """The place of a document in the order of lines."""
    return F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)) - F.pmod(F.xxhash64(text_col), F.lit(1 << 40)))


def line_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, line number in the row and hash of every word."""
    data, at = texts(column)
    w = Words(lower_ascii(data), at)
    newline = np.cumsum(data == 10)
    before = np.append(0, newline)[at[:-1]]  # newlines before each row
    row = w.rows()
    return row, (newline[w.starts] if len(w) else np.zeros(0, np.int64)) - before[row], w.hashes if len(w) else np.zeros(0, U64)


def cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(40)).astype(np.int64) % CELLS


def rarity(docs: DataFrame, text_col: str) -> np.ndarray:
    """The counters over all documents; PARTS rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in slices(batches, "text", 4 << 20):
            total += np.bincount(cell(line_words(batch.column(0))[2]), minlength=CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([p.astype(np.int32).tobytes() for p in np.split(total, PARTS)], pa.binary())], ["part", "counts"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int64 if len(b) == 8 * CELLS // PARTS else np.int32).astype(np.int64) for b in rows.column("counts").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect()
    out = np.zeros(CELLS, np.int64)
    for r in rows:
        out[r["part"] * (CELLS // PARTS) : (r["part"] + 1) * (CELLS // PARTS)] = np.frombuffer(r["counts"], np.int64)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rarity of each cell in 20 bits; counts that are nearly equal may be equal here."""
    return (np.log2(counts + 1.0) * (1 << 14)).astype(np.int64)


def line_sets(column: pa.Array, rank_of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words of all lines, each line's distinct and by rarity, with the lines' starts,
    rows and numbers."""
    row, line, h = line_words(column)
    if not len(h):
        none = np.zeros(0, np.int64)
        return h, none, none, none
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (line[1:] != line[:-1])
    ident = np.cumsum(new) - 1
    # One number sorts by line and by rarity; hashes only decide between equal ones.
    rank = (ident.astype(U64) << U64(36)) | (rank_of[cell(h)].astype(U64) << U64(16)) | (h >> U64(48))
    order = np.argsort(rank, kind="stable")
    ordered = rank[order]
    tied = ordered[1:] == ordered[:-1]
    if (h[order[1:]][tied] != h[order[:-1]][tied]).any():
        order = np.lexsort((h, rank))
    h, i = h[order], ident[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (i[1:] != i[:-1])
    h, i = h[keep], i[keep]
    first = np.flatnonzero(new)
    return h, np.searchsorted(i, np.arange(len(first))), row[first], line[first]


def set_hashes(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set."""
    n = np.diff(np.append(start, len(h))).astype(U64)
    return mix(np.add.reduceat(mix(h), start) + n), mix(np.add.reduceat(mix(h ^ U64(0xA0761D6478BD642F)), start))


def bitmaps(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parity of the words at each of 64 bits, or of 128 for sets above WIDE words."""
    at = mix(h ^ U64(77))
    bit, high = U64(1) << (at & U64(63)), (at & U64(64)) != 0
    high &= np.repeat(n > WIDE, n)
    return np.bitwise_xor.reduceat(np.where(high, U64(0), bit), start), np.bitwise_xor.reduceat(np.where(high, bit, U64(0)), start)


def pack(columns: list[np.ndarray], fields: tuple) -> bytes:
    import zstandard

    body = [np.int64(len(columns[0])).tobytes()]
    for c, (name, kind) in zip(columns, fields, strict=True):
        body.append((np.diff(c, prepend=0) if name == "k1" else c).astype(kind).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(body))


def unpack(blobs: list[bytes], fields: tuple) -> dict[str, np.ndarray]:
    import zstandard

    parts: dict[str, list[np.ndarray]] = {name: [] for name, _ in fields}
    for b in blobs:
        raw = zstandard.ZstdDecompressor().decompress(b)
        n, at = int(np.frombuffer(raw, np.int64, 1)[0]), 8
        for name, kind in fields:
            col = np.frombuffer(raw, kind, n, at)
            at += col.nbytes
            parts[name].append(np.cumsum(col) if name == "k1" else col)
    return {name: np.concatenate(p) for name, p in parts.items()}


def depths(counts: np.ndarray, percent: int) -> np.ndarray:
    """How many words in common make a key, for each cell of the rarity table."""
    least = -(-percent // (100 - percent)) if percent < 100 else 1  # words in common of the smallest sets that match
    deep = np.ones(len(counts), np.int64)
    at = HOT
    while deep.max() < min(DEEPEST, least) and (counts > at).any():
        deep += counts > at
        at *= HOTTER
    return deep


def prefix_keys(h: np.ndarray, start: np.ndarray, n: np.ndarray, deep: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set, place and key of every prefix word of the sets h[start:start + n]; a word of
    depth l > 1 has a key for each choice of l - 1 later words in the prefix that is l - 1 longer."""
    base = n - -(-percent * n // 100)
    p = base + 1
    pos = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
    which = np.repeat(np.arange(len(n)), p)
    key = h[np.repeat(start, p) + pos]
    depth = deep[cell(key)]
    if depth.max(initial=1) == 1:
        return which, pos, key
    flat = depth == 1
    out = [(which[flat], pos[flat], key[flat])]
    w, first, last, k, d = which[~flat], pos[~flat], pos[~flat], key[~flat], depth[~flat]
    level = 1
    while len(w):
        stop = np.minimum(base[w] + d, n[w])  # places below this may be chosen
        m = np.maximum(stop - last - 1, 0)
        nth = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        w, first, d = np.repeat(w, m), np.repeat(first, m), np.repeat(d, m)
        last = np.repeat(last, m) + 1 + nth
        k = mix(np.repeat(k, m) * U64(3) + h[start[w] + last])
        level += 1
        done = d == level
        out.append((w[done], first[done], k[done]))
        w, first, last, k, d = (x[~done] for x in (w, first, last, k, d))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def postings(keyed: DataFrame, counts: np.ndarray, percent: int, buckets: int) -> DataFrame:
    """(bucket, block): in even buckets the prefixes of sets, in the odd one below 2 *
    buckets the earliest lines of a task's sets, and beyond it the lines that those
    make repeats of, dealt to any bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deep, rank_of = depths(counts, percent), ranks(counts)
        held: dict[tuple, list[list[np.ndarray]]] = {SETS: [], PREFIXES: []}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for fields, parts in held.items():
                if not parts:
                    continue
                cols = [np.concatenate([h[i] for h in parts]) for i in range(len(fields) + 1)]
                parts.clear()
                order = np.argsort(cols[0], kind="stable")
                cols = [c[order] for c in cols]
                cuts = np.flatnonzero(np.diff(cols[0], prepend=-1))
                bounds = list(zip(cuts, [*cuts[1:], len(order)], strict=True))
                for lo in range(0, len(bounds), 64):
                    some = bounds[lo : lo + 64]
                    out = [pack([c[a:b] for c in cols[1:]], fields) for a, b in some]
                    yield pa.RecordBatch.from_arrays([pa.array([int(cols[0][a]) for a, _ in some], pa.int32()), pa.array(out, pa.binary())], ["bucket", "block"])

        for batch in slices(batches, "text", 2 << 20):
            h, start, row, line = line_sets(batch.column(1), rank_of)
            if not len(start):
                continue
            n = np.diff(np.append(start, len(h)))
            s1, s2 = set_hashes(h, start)
            k1 = batch.column(0).to_numpy(zero_copy_only=False)[row]
            order = np.lexsort((line, k1, s2, s1))
            same = np.zeros(len(order), bool)
            same[1:] = (s1[order[1:]] == s1[order[:-1]]) & (s2[order[1:]] == s2[order[:-1]])
            first = order[np.flatnonzero(~same)[np.cumsum(~same) - 1]]
            again = order[(k1[order] != k1[first]) | (line[order] != line[first])]
            one = np.sort(order[~same])
            bucket = (s1 % U64(buckets)).astype(np.int64) * 2 + 1
            for pick, to in ((one, bucket[one]), (again, 2 * buckets + 1 + bucket[again])):
                held[SETS].append([to, k1[pick], line[pick], s1[pick], s2[pick]])
            size += 28 * len(order)
            one = one[n[one] * (100 - percent) >= percent]  # smaller sets match only equal ones
            if len(one):
                b1, b2 = bitmaps(h, start, n)
                which, pos, token = prefix_keys(h, start[one], n[one], deep, percent)
                at = one[which]
                held[PREFIXES].append([(token % U64(buckets)).astype(np.int64) * 2, token >> U64(32), n[at], pos, k1[at], line[at], s1[at], b1[at], b2[at]])
                size += 42 * len(at)
            if size >= FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    return keyed.mapInArrow(run, "bucket int, block binary")


SCHEMA = "kind int, group long, n int, pos int, sa long, ka long, la int, sb long, kb long, lb int, b1 long, b2 long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
TYPES = {"int": pa.int32(), "long": pa.int64()}
#: Kinds of rows: a repeated set's later line (b), a pair to verify (a before b), a line (b) of
#: a group in which some line passes with more than it names, and such a line itself.
AGAIN, PAIR, REST, MORE = 0, 1, 2, 3


def emit(kind: int | np.ndarray, **cols: np.ndarray) -> pa.Table:
    n = len(cols["kb"])
    cols["kind"] = np.broadcast_to(np.asarray(kind, np.int32), n)
    none = np.zeros(n, np.int64)
    out = {}
    for c in SCHEMA.split(", "):
        name, kind_of = c.split()
        x = cols.get(name, none)
        out[name] = pa.array(x.view(np.int64) if x.dtype == U64 else x).cast(TYPES[kind_of])
    return pa.table(out)


def passing(group: np.ndarray, x: dict[str, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (a before b, by k1 and line) of one group that pass the three filters, and the
    bits in which they differ; rows are sorted by group and n."""
    n, p = x["n"].astype(np.int64), x["pos"].astype(np.int64)
    fold = x["b1"] ^ x["b2"]
    spread = np.int64(n.max(initial=0)) + 1
    place = group * spread + n
    lo = np.searchsorted(place, group * spread + -(-percent * n // 100))
    i = np.arange(len(n))
    many = i - lo
    ends = np.cumsum(many)
    at = 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        m = many[at:stop]
        total = int(m.sum())
        big = np.repeat(i[at:stop], m)
        small = np.repeat(lo[at:stop], m) + np.arange(total) - np.repeat(np.cumsum(m) - m, m)
        at = stop
        differ = np.bitwise_count(fold[big] ^ fold[small]).astype(np.int64)
        need = -(-percent * (n[big] + n[small]) // (100 + percent))
        ok = differ <= n[big] + n[small] - 2 * need
        big, small, need, differ = big[ok], small[ok], need[ok], differ[ok]
        wide = n[small] > WIDE
        exact = np.bitwise_count(x["b1"][big] ^ x["b1"][small]).astype(np.int64) + np.bitwise_count(x["b2"][big] ^ x["b2"][small])
        differ = np.where(wide, exact, differ)
        ok = (differ <= n[big] + n[small] - 2 * need) & (np.minimum(n[big] - p[big], n[small] - p[small]) >= need - np.minimum(p[big], p[small]))
        ok &= (x["k1"][big] != x["k1"][small]) | (x["line"][big] != x["line"][small])
        big, small, differ = big[ok], small[ok], differ[ok]
        later = (x["k1"][big] > x["k1"][small]) | (x["k1"][big] == x["k1"][small]) & (x["line"][big] > x["line"][small])
        yield np.where(later, small, big), np.where(later, big, small), differ


def pair_rows(x: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Distinct pairs of lines."""
    order = np.lexsort((x["line"][a], x["k1"][a], x["s1"][a], x["s1"][b]))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (x["s1"][a[1:]] != x["s1"][a[:-1]]) | (x["s1"][b[1:]] != x["s1"][b[:-1]])
    a, b = a[keep], b[keep]
    return emit(PAIR, sa=x["s1"][a], ka=x["k1"][a], la=x["line"][a], sb=x["s1"][b], kb=x["k1"][b], lb=x["line"][b])


def meet(key: tuple, rows: pa.Table, percent: int, buckets: int) -> pa.Table:
    bucket, blobs = key[0].as_py(), rows.column("block").to_pylist()
    if bucket % 2 or bucket >= 2 * buckets:
        x = unpack(blobs, SETS)
        again = np.ones(len(x["k1"]), bool)
        if bucket < 2 * buckets:
            order = np.lexsort((x["line"], x["k1"], x["s2"], x["s1"]))
            x = {c: v[order] for c, v in x.items()}
            same = np.zeros(len(order), bool)
            same[1:] = (x["s1"][1:] == x["s1"][:-1]) & (x["s2"][1:] == x["s2"][:-1])
            first = np.flatnonzero(~same)[np.cumsum(~same) - 1]
            again = (x["k1"] != x["k1"][first]) | (x["line"] != x["line"][first])
        return emit(AGAIN, sb=x["s1"][again], kb=x["k1"][again], lb=x["line"][again])
    x = unpack(blobs, PREFIXES)
    order = np.lexsort((x["line"], x["k1"], x["s1"], x["token"]))
    t, s = x["token"][order], x["s1"][order]
    keep = np.ones(len(order), bool)
    keep[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])  # the earliest line of each set
    order = order[keep]
    t = x["token"][order]
    alone = np.append(t[1:] != t[:-1], True) & np.append(True, t[1:] != t[:-1])
    order = order[~alone]
    order = order[np.lexsort((x["n"][order], x["token"][order]))]
    x = {c: v[order] for c, v in x.items()}
    begins = np.append(True, x["token"][1:] != x["token"][:-1]) if len(order) else np.zeros(0, bool)
    group = np.cumsum(begins) - 1
    # Ranks in the order of lines, so that the earliest partner is the least rank.
    by_line = np.lexsort((x["line"], x["k1"]))
    rank = np.empty(len(order), np.int64)
    rank[by_line] = np.arange(len(order))
    none = np.int64(1 << 62)
    earliest, closest, count = np.full(len(order), none), np.full(len(order), none), np.zeros(len(order), np.int64)
    active = np.zeros(len(order), bool)
    for a, b, differ in passing(group, x, percent):
        np.minimum.at(earliest, b, rank[a])
        np.minimum.at(closest, b, (differ << 40) | rank[a])
        count += np.bincount(b, minlength=len(order))
        active[a] = active[b] = True
    b = np.flatnonzero(count)
    ends = [by_line[earliest[b]], by_line[closest[b] & ((1 << 40) - 1)]]
    named = 1 + (ends[0] != ends[1])
    pairs = pair_rows(x, np.concatenate(ends), np.concatenate([b, b]))
    more = np.zeros(len(order), bool)
    more[b[count[b] > named]] = True
    wanted = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
    wanted[group[more]] = True
    rest = np.flatnonzero(wanted[group] & active) if len(group) else b
    name = (x["token"][rest].astype(np.int64) << 31) | bucket
    return pa.concat_tables([pairs, emit(np.where(more[rest], MORE, REST), group=name, n=x["n"][rest], pos=x["pos"][rest], sb=x["s1"][rest], kb=x["k1"][rest], lb=x["line"][rest], b1=x["b1"][rest], b2=x["b2"][rest])])


def common(ids: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words in common of pairs of sets; ids[at[i]:at[i + 1]] are the sorted words of set i."""
    size = np.diff(at)
    span = np.int64(ids.max(initial=0)) + 1

    def spread(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = size[which]
        pair = np.repeat(np.arange(len(which)), n)
        return pair, pair * span + ids[np.repeat(at[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    pair, x = spread(a)
    _, y = spread(b)
    place = np.minimum(np.searchsorted(y, x), max(len(y) - 1, 0))
    return np.bincount(pair[y[place] == x], minlength=len(a))


def group_rows(rows: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Columns of the rows of some groups by group and n, their order and their groups."""
    x = {new: rows.column(old).to_numpy() for new, old in (("group", "group"), ("n", "n"), ("pos", "pos"), ("k1", "kb"), ("line", "lb"), ("open", "open"))}
    x |= {new: rows.column(old).to_numpy().view(U64) for new, old in (("s1", "sb"), ("b1", "b1"), ("b2", "b2"))}
    order = np.lexsort((x["n"], x["group"]))
    x = {c: v[order] for c, v in x.items()}
    return x, order, np.cumsum(np.append(True, x["group"][1:] != x["group"][:-1])) - 1


def concern(rows: pa.Table, percent: int) -> pa.Table:
    """The rows of open lines, and of lines that pass with one that did not name them."""
    x, order, group = group_rows(rows)
    rank = np.empty(len(order), np.int64)
    by_line = np.lexsort((x["line"], x["k1"]))
    rank[by_line] = np.arange(len(order))
    earliest, closest = np.full((2, len(order)), 1 << 62)
    some = 0
    for a, b, differ in passing(group, x, percent):
        ok = x["open"][b]
        a, b, differ = a[ok], b[ok], differ[ok]
        np.minimum.at(earliest, b, rank[a])
        np.minimum.at(closest, b, (differ << 40) | rank[a])
        some += len(a)
    keep = np.zeros(len(order), bool)
    for a, b, _ in passing(group, x, percent) if some else ():  # again, as the pairs have no bound
        ok = x["open"][b] & (rank[a] != earliest[b]) & (rank[a] != closest[b] & ((1 << 40) - 1))
        keep[a[ok]] = keep[b[ok]] = True
    return rows.take(pa.array(order[keep]))


def meet_again(key: tuple, rows: pa.Table, percent: int) -> pa.Table:
    """The open lines of some groups that a line of the group is like, by their full sets."""
    x, order, group = group_rows(rows)
    words = rows.column("words").take(pa.array(order)).to_pylist()
    at = np.append(0, np.cumsum(x["n"].astype(np.int64)))
    ids = np.unique(np.frombuffer(b"".join(words), U64), return_inverse=True)[1].astype(np.int64)
    owner = np.repeat(np.arange(len(order)), x["n"])
    ids = ids[np.lexsort((ids, owner))]
    like = np.zeros(len(order), bool)
    for a, b, _ in passing(group, x, percent):
        ok = x["open"][b]
        a, b = a[ok], b[ok]
        for lo in range(0, len(a), 4096):
            p, q = a[lo : lo + 4096], b[lo : lo + 4096]
            p, q = p[~like[q]], q[~like[q]]
            both = common(ids, at, p, q)
            like[q[100 * both >= percent * (x["n"][p].astype(np.int64) + x["n"][q] - both)]] = True
    return pa.table({"kb": pa.array(x["k1"][like]), "lb": pa.array(x["line"][like].astype(np.int32)), "sb": pa.array(x["s1"][like].view(np.int64))})


def wanted_bits(k1: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(mix(k1.astype(np.int64).view(U64)) ^ line.astype(np.int64).view(U64)) % U64(WANTED)


def sets_of(docs: DataFrame, lines: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(s, words): hashes of the words of all lines in ``lines`` (k, l), and of a few others:
    a table of WANTED bits, gathered from them, says which lines of a document to send."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(WANTED // 8, np.uint8)
        for b in batches:
            at = wanted_bits(b.column(0).to_numpy(), b.column(1).to_numpy())
            np.bitwise_or.at(bits, (at >> U64(3)).astype(np.int64), (1 << (at & U64(7))).astype(np.uint8))
        words = bits.view(np.int64)
        at = np.flatnonzero(words)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(words[part])], ["at", "bits"])

    found = lines.mapInArrow(mark, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most WANTED / 64 rows
    table_of = np.zeros(WANTED // 64, np.int64)
    table_of[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    bits = table_of.view(np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        even = np.zeros(CELLS, np.int64)
        for batch in slices(batches, "text", 2 << 20):
            data, first, stop, row, number = line_spans(batch.column(1))
            at = wanted_bits(batch.column(0).to_numpy(zero_copy_only=False)[row], number)
            pick = np.flatnonzero((bits[(at >> U64(3)).astype(np.int64)] >> (at & U64(7)).astype(np.uint8)) & 1)
            if not len(pick):
                continue
            h, start, _, _ = line_sets(cut_out(data, first[pick], stop[pick]), even)
            if not len(start):
                continue
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer((8 * np.append(start, len(h))).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(h))])
            yield pa.RecordBatch.from_arrays([pa.array(set_hashes(h, start)[0].view(np.int64)), words.cast(pa.binary())], ["s", "words"])

    return docs.select(line_key(id_col, text_col).alias("k"), F.col(text_col).alias("text")).mapInArrow(run, "s long, words binary")


def line_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, and first byte, stop byte, row and number in the row of every line."""
    data, at = texts(column)
    newline = np.flatnonzero(data == 10)
    row = np.searchsorted(at, newline, "right") - 1
    first = np.concatenate([at[:-1], newline + 1])
    stop = np.concatenate([newline, at[1:]])
    rows = np.append(np.arange(len(at) - 1), row)
    order = np.lexsort((first, rows))
    rows, first = rows[order], first[order]
    stop = np.sort(stop)
    number = np.arange(len(rows)) - np.searchsorted(rows, rows)
    return data, first, stop, rows, number


def cut_out(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Byte spans as an array of their own."""
    size = stop - first
    at = np.append(0, np.cumsum(size))
    index = np.arange(at[-1]) + np.repeat(first - at[:-1], size)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[index]))])


def verified(docs: DataFrame, pairs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The later lines (kb, lb, sb) of the pairs that reach the threshold."""
    sets = sets_of(docs, pairs.select(F.col("ka").alias("k"), F.col("la").alias("l")).union(pairs.select("kb", "lb")), id_col, text_col)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, U64), np.frombuffer(y, U64), assume_unique=True))
                keep.append(100 * both >= percent * ((len(x) + len(y)) // 8 - both))
            yield batch.select(["kb", "lb", "sb"]).filter(pa.array(keep, pa.bool_()))

    one = pairs.select("sa", "sb", "kb", "lb").join(sets.select(F.col("s").alias("sa"), F.col("words").alias("x")), "sa").drop("sa")
    both = one.join(sets.select(F.col("s").alias("sb"), F.col("words").alias("y")), "sb").select("kb", "lb", "sb", "x", "y")
    return both.mapInArrow(compare, "kb long, lb int, sb long").distinct()


def removed_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(kb, lb, sb): document key, number and set hash of the lines to remove."""
    keyed = docs.select(line_key(id_col, text_col).alias("k1"), F.col(text_col).alias("text"))
    counts = rarity(docs, text_col)
    buckets = int(max(4 * shuffle_partitions(docs), text_bytes(docs, text_col) // BUCKET_BYTES))
    found = durable(postings(keyed, counts, percent, buckets).groupBy("bucket").applyInArrow(lambda key, rows: meet(key, rows, percent, buckets), SCHEMA))
    b = ["kb", "lb", "sb"]
    again = found.where(F.col("kind") == AGAIN).select(*b)
    pairs = found.where(F.col("kind") == PAIR).select("sa", "ka", "la", *b).distinct()
    near = durable(verified(docs, pairs, percent, id_col, text_col))
    rest = found.where(F.col("kind") >= REST)
    left = durable(rest.where(F.col("kind") == MORE).select(*b).distinct().join(near, b, "left_anti"))
    if not left.isEmpty():
        concerned = rest.where(F.col("kind") == MORE).select("group", *b).join(left, b, "left_semi").select("group").distinct()
        flagged = rest.join(concerned, "group", "left_semi").join(left.withColumn("open", F.lit(True)), b, "left").select("group", "n", "pos", *b, "b1", "b2", F.coalesce("open", F.lit(False)).alias("open"))
        group = F.pmod(F.xxhash64("group"), F.lit(buckets))
        others = durable(flagged.groupBy(group).applyInArrow(lambda rows: concern(rows, percent), flagged.schema))
        sets = sets_of(docs, others.select("kb", "lb").distinct(), id_col, text_col).dropDuplicates(["s"]).withColumnRenamed("s", "sb")
        more = others.join(sets, "sb").groupBy(group).applyInArrow(lambda key, rows: meet_again(key, rows, percent), "kb long, lb int, sb long")
        near = durable(near.union(more.distinct()), spent=[near])
        discard([others])
    out = durable(again.union(near).distinct(), spent=[near])
    discard([found, left])
    return out


def dedup_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their text without the removed lines, and n_lines
    (lines with a word) and n_lines_removed, in place of columns of those names.  Texts
    that lose nothing stay as they are."""
    docs = docs.drop(*(c for c in ("n_lines", "n_lines_removed") if c not in (id_col, text_col)))
    key, lost = (free_name(docs, c) for c in ("key", "gone"))
    gone = removed_lines(docs, percent, id_col, text_col).groupBy(F.col("kb").alias(key)).agg(F.collect_list(F.struct("lb", "sb")).alias(lost))
    joined = docs.withColumn(key, line_key(id_col, text_col)).join(gone, key, "left").drop(key)
    place = joined.columns.index(text_col)
    names = joined.columns[:-1]
    schema = T.StructType([joined.schema[c] for c in names] + [T.StructField("n_lines", T.LongType()), T.StructField("n_lines_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        even = np.zeros(CELLS, np.int64)
        for batch in slices(batches, text_col, 2 << 20):
            gone_of = dropped(batch.column(place), batch.column(batch.num_columns - 1), even)
            kept, total, many = [], [], []
            for i, text in enumerate(batch.column(place).to_pylist()):
                lines = (text or "").split("\n")
                total.append(sum(1 for x in lines if x.strip(" \t\r\x0b\f")))
                drop = gone_of.get(i, ())
                many.append(len(drop))
                kept.append("\n".join([x for k, x in enumerate(lines) if k not in drop]) if drop else text)
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(many, pa.int64())], [*names, "n_lines", "n_lines_removed"])

    return joined.mapInArrow(run, schema)


def dropped(column: pa.Array, gone: pa.Array, even: np.ndarray) -> dict[int, set[int]]:
    """Numbers of the lines to drop in each row: those named, if they have the set named with
    them (rows of one id name their lines together)."""
    lists = gone.is_valid().to_numpy(zero_copy_only=False)
    if not lists.any():
        return {}
    bounds = gone.offsets.to_numpy()
    size = np.where(lists, np.diff(bounds), 0)
    owner = np.repeat(np.arange(len(size)), size)
    flat = gone.flatten()
    number, want = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False).view(U64)
    data, first, stop, row, line = line_spans(column)
    at = np.searchsorted(row, owner) + number
    ok = at < np.searchsorted(row, owner, "right")
    owner, number, want, at = owner[ok], number[ok], want[ok], at[ok]
    h, start, which, _ = line_sets(cut_out(data, first[at], stop[at]), even)
    have = np.zeros(len(at), U64)
    if len(start):
        have[which] = set_hashes(h, start)[0]
    out: dict[int, set[int]] = {}
    for o, k in zip(owner[have == want].tolist(), number[have == want].tolist(), strict=True):
        out.setdefault(o, set()).add(k)
    return out


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_lines_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable] = {"op9_line_dedup": op9_line_dedup}
ORACLE: dict[str, str] = {}
