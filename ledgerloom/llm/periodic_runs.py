"""Periodic runs of words, found on a harmonic grid.

A run of period q and length at least 3 * q holds a grid point i (a multiple of q) whose
words agree with those q places on for at least max(25 - 2 * q, q + 1) words.  All (period,
grid point) pairs of a batch of documents, n * (1 + 1/2 + 1/3 + ...) for n words, are
made in chunks; prefix hashes of two prime moduli tell at once which pairs agree so far,
and for the first of neighbouring ones a binary search over all of them at a time finds
how far the agreement reaches in both directions.  That is the run: its maximality
follows from the search, its period is the smallest under which the same stretch was
found.  Then the words themselves are compared, byte for byte; a document with a run that
only its hashes show (or with words whose hashes collide) is searched again with numbers
for its words and other hashes.

Runs are a document's own affair: no shuffle, and a task holds a slice of SLICE bytes (or
one text) and PAIRS pairs at a time, whatever periods a text has.

Edge cases: a null or empty text has no words and no runs, one without 24 words no runs;
rows that repeat get equal results; an empty table gives none; other columns are left out.
A null id is taken as one that plants nothing in op12_periodic_runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import U64, Words, cover, mix, slices, table, texts
from .spans import counted, same_spans

#: Least words of a run, and least periods in it.
LEAST, TIMES = 24, 3
SLICE, PAIRS = 2 << 20, 1 << 20
#: Primes below 2**32: products of two residues fit 64 bits, as do sums of 2**32 of them.
PRIMES = (U64(4294967291), U64(4294967279))

RUNS = "array<struct<start: long, length: long, period: long>>"


def modular_powers(base: int, prime: U64, n: int) -> np.ndarray:
    """base**i modulo prime for i below n, by doubling."""
    out = np.ones(1, U64)
    while len(out) < n:
        step = U64(pow(base, len(out), int(prime)))
        out = np.concatenate([out, out[: n - len(out)] * step % prime])
    return out


class Prefixes:
    """Prefix hashes of a sequence of numbers: do equal stretches stand q places apart?"""

    def __init__(self, values: np.ndarray, seed: int):
        self.sums, self.powers = [], []
        for k, prime in enumerate(PRIMES):
            x = mix(values + U64(2 * seed + k)) % prime
            p = modular_powers(int(mix(np.array([0xA5A5 + 2 * seed + k], U64))[0] % prime), prime, len(values) + 1)
            total = np.zeros(len(values) + 1, U64)
            np.cumsum(x * p[:-1] % prime, out=total[1:])
            self.sums.append(total % prime)
            self.powers.append(p)

    def same(self, i: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether the m values from i on agree with those from i + q on."""
        out = np.ones(len(i), bool)
        on = np.arange(len(i))
        for c, p, prime in zip(self.sums, self.powers, PRIMES, strict=True):
            a, b, n = i[on], q[on], m[on]
            left = (c[a + n] + prime - c[a]) % prime * p[b] % prime
            equal = left == (c[a + b + n] + prime - c[a + b]) % prime
            out[on[~equal]] = False
            on = on[equal]
        return out

    def reach(self, i: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, way: int) -> np.ndarray:
        """The most values in low..high that agree from i on (way 1) or before it (way -1)."""
        low, high = low.copy(), high.copy()
        going = np.flatnonzero(low < high)
        while len(going):
            middle = (low[going] + high[going] + 1) // 2
            at = i[going] if way > 0 else i[going] - middle
            equal = self.same(at, q[going], middle)
            low[going[equal]] = middle[equal]
            high[going[~equal]] = middle[~equal] - 1
            going = going[low[going] < high[going]]
        return low


def grid(row_at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """All (row, period, step, grid point) in chunks of about PAIRS, periods of a row whole."""
    n = np.diff(row_at)
    rows = np.flatnonzero(n >= LEAST)
    tops = n[rows] // TIMES
    first = 0
    while first < len(rows):  # rows whose periods fit a chunk, one row at least
        last = first + max(1, int(np.searchsorted(np.cumsum(tops[first:]), PAIRS, "right")))
        row = np.repeat(rows[first:last], tops[first:last])
        period = counted(np.ones(last - first, np.int64), tops[first:last])
        need = np.maximum(LEAST + 1 - 2 * period, period + 1)
        points = np.maximum((n[row] - period - need) // period + 1, 0)
        ends = np.cumsum(points)
        a = 0
        while a < len(row):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
            step = counted(np.zeros(b - a, np.int64), points[a:b])
            q = np.repeat(period[a:b], points[a:b])
            yield np.repeat(row[a:b], points[a:b]), q, step, np.repeat(row_at[row[a:b]], points[a:b]) + step * q
            a = b
        first = last


def runs_of(values: np.ndarray, row_at: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop, period) of every run, by row, start, period; places count over all rows."""
    hashed = Prefixes(values, seed)
    found = []
    for row, q, step, i in grid(row_at):
        hit = np.flatnonzero(hashed.same(i, q, np.maximum(LEAST + 1 - 2 * q, q + 1)))
        if not len(hit):
            continue
        lead = np.ones(len(hit), bool)  # a run's other grid points follow its first one
        lead[1:] = (np.diff(hit) > 1) | (step[hit[1:]] == 0)
        row, q, i = (x[hit[lead]] for x in (row, q, i))
        on = hashed.reach(i, q, np.maximum(LEAST + 1 - 2 * q, q + 1), row_at[row + 1] - i - q, 1)
        back = hashed.reach(i, q, np.zeros(len(i), np.int64), i - row_at[row], -1)
        start, stop = i - back, i + q + on
        long = stop - start >= np.maximum(LEAST, TIMES * q)
        found.append([x[long] for x in (row, start, stop, q)])
    if not found:
        return (np.zeros(0, np.int64),) * 4
    row, start, stop, q = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((q, stop, start))
    row, start, stop, q = (x[order] for x in (row, start, stop, q))
    least = np.ones(len(row), bool)  # of equal stretches the smallest period
    least[1:] = (np.diff(start) > 0) | (np.diff(stop) != 0)
    row, start, stop, q = (x[least] for x in (row, start, stop, q))
    order = np.lexsort((q, start))
    return tuple(x[order] for x in (row, start, stop, q))


def hold(words: Words, source: np.ndarray, start: np.ndarray, stop: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether each stretch really has its period: the words are compared, not their hashes."""
    out = np.ones(len(start), bool)
    size = words.ends - words.starts
    first = 0
    while first < len(start):
        n = (stop - start - q)[first:]
        last = first + max(1, int(np.searchsorted(np.cumsum(n), PAIRS, "right")))
        n = n[: last - first]
        i = counted(start[first:last], n)
        a, b = source[i], source[i + np.repeat(q[first:last], n)]
        differ = np.flatnonzero(a != b)
        a, b = a[differ], b[differ]
        equal = size[a] == size[b]
        equal[equal] = same_spans(words.data, words.starts[a[equal]], words.data, words.starts[b[equal]], size[a[equal]])
        owner = np.repeat(np.arange(first, last), n)
        out[owner[differ[~equal]]] = False
        first = last
    return out


def verified_runs(words: Words, source: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of words ``source`` (an index into ``words`` for each place)."""
    row_at = words.row_at
    found = runs_of(words.hashes[source], row_at)
    wrong = np.unique(found[0][~hold(words, source, *found[1:])])
    parts = [[x[~np.isin(found[0], wrong)] for x in found]]
    for r in wrong.tolist():
        a, b = int(row_at[r]), int(row_at[r + 1])
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(words.data[words.starts[i] : words.ends[i]].tobytes(), len(numbers)) for i in source[a:b].tolist()], U64)
        seed = 1
        while True:
            again = runs_of(ids, np.array([0, b - a]), seed)
            shifted = [again[0] + r, again[1] + a, again[2] + a, again[3]]
            if hold(words, source, *shifted[1:]).all():
                break
            seed += 1
        parts.append(shifted)
    row, start, stop, q = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((q, start))
    return row[order], start[order], stop[order], q[order]


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrange: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period) and the
    collapsed text of every row: the words that no run repeats, joined by one space.
    ``arrange`` may name other words of a document for its places: from its id and number
    of words it makes the index of the word at each place, or None to leave them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, at = texts(batch.column(1))
            words = Words(data, at)
            source = np.arange(len(words))
            ids, bounds = batch.column(0).to_pylist(), words.row_at
            for r, (i, a, n) in enumerate(zip(ids, bounds.tolist(), np.diff(bounds).tolist(), strict=False)):
                if arrange is not None and n and (other := arrange(i, n)) is not None:
                    source[a : bounds[r + 1]] = a + other
            row, start, stop, q = verified_runs(words, source)
            kept = ~cover(start + q, stop, len(words))
            joined = []
            for text, a, b in zip(batch.column(1).cast(pa.binary()).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                own = (text or b"").split()
                if arrange is not None:
                    own = [own[i] for i in (source[a:b][kept[a:b]] - a).tolist()]
                else:
                    own = compress(own, kept[a:b])
                joined.append(b" ".join(own))
            fields = [pa.array(x, pa.int64()) for x in (start - bounds[row], stop - start, q)]
            each = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(ids) + 1)), pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), runs, pa.array(joined, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, text string")


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rewrite: from word a on, a tenth of the documents repeats p words."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(table(spark, sf_dir, "documents"), arrange=planted)
    longer = "aggregate(runs, cast(null as struct<start: long, length: long, period: long>), (a, r) -> if(a is null or r.length * a.period > a.length * r.period, r, a))"
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    best = found.select("doc_id", "runs", "text", F.expr(longer).alias("best"))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable] = {"op12_periodic_runs": op12_periodic_runs}
ORACLE: dict[str, str] = {}
