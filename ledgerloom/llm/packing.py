"""Packing token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fits in one sequence.  The program
asks for the fewest sequences whose configurations cover the length histogram.  It is
solved by multiplicative weights: every length has a price, at first its tokens; a knapsack
dynamic program over all capacities prices the configurations; columns are drawn from
those within EPSILON of the best price, and the price of a length is multiplied up or down
by how much less or more of it than of others they cover.  Prices over the best price of a
whole sequence are a dual solution, which bounds the number of sequences from below; the
prices of the best bound hold.  A round then places columns of best price until half of
what was left is placed, and the next round prices the rest.  A column's share is the least
number of sequences that any of its lengths allows, over SHARE, rounded down to whole
sequences (one at least), so the solution is rounded as it grows and no length is ever
over-covered.  What no nearly full column of nearly best price can hold, a small rest, is packed
best-fit-decreasing over the histogram into the free places of all sequences.

Only the histogram is solved on the driver, at most one row for each length up to
the capacity, whatever the number of documents.  The plan is a table of segments
(length, first rank, sequence base, pieces for each sequence, offset): the pieces of
a length are ranked, in cells so that no task holds all pieces of one length, and a
piece's rank gives its sequence and offset by arithmetic.

Edge cases: a null or empty text is one piece that holds the end id; equal rows get
places of their own, and ties between pieces of one length are broken by id, piece and
checksum; a longer document is cut into full pieces and a rest, however long, and a very long
word is encoded by the trie; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import durable, slices, table
from .bpe import SLICE, cached, default_path

CAPACITY = 4096
END_ID = 1
#: Rounds; steps of the weights in each, columns drawn in a step, their distance from the best
#: price, and the rate of the weights.
ROUNDS, STEPS, DRAWN, EPSILON, RATE = 12, 4, 256, 0.02, 0.5
#: The part of what a column could take that it takes; columns in a row that fail before a round ends.
SHARE, TRIES = 4, 64
#: Seed of the draws among columns of equal price.
SEED = 11
#: Cells in which the pieces of one length are ranked.
CELLS = 64


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = cached(path or default_path(), "ids")
        end = END_ID.to_bytes(4, "little")
        ids_of = cache.chunks[0].__getitem__
        for batch in slices(batches, "text", SLICE):
            rows = []
            for doc, parts in zip(batch.column(0).to_pylist(), cache.batch(batch.column(1).to_pylist()), strict=True):
                raw = b"".join(map(ids_of, parts)) + end
                for n, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, n, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the program, over a histogram ------------------------------------------------


def price(lengths: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: the best value of every capacity."""
    best = np.zeros(capacity + 1)
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(lengths, c, "right"))
        best[c] = max(best[c - 1], (values[:n] + best[c - lengths[:n]]).max()) if n else best[c - 1]
    return best


def column(first: int, lengths: np.ndarray, values: np.ndarray, left: np.ndarray, best: np.ndarray, capacity: int, rng: np.random.Generator) -> tuple[dict[int, int], float]:
    """A configuration of the best price through one length, drawn by what is left of the
    lengths that may come next, long ones sooner, and its price."""
    config = {first: 1}
    c, worth = capacity - int(lengths[first]), float(values[first])
    while c > 0:
        if best[c] - best[c - 1] <= 1e-12:
            c -= 1
            continue
        n = int(np.searchsorted(lengths, c, "right"))
        ok = (values[:n] + best[c - lengths[:n]] >= best[c] - 1e-9) & (left[:n] > 0)
        for i, k in config.items():
            if i < n and left[i] <= k:
                ok[i] = False
        among = np.flatnonzero(ok)
        if not len(among):
            break
        by = np.cumsum(left[among] * lengths[among].astype(float) ** 2)
        i = int(among[np.searchsorted(by, rng.random() * by[-1], "right")])
        config[i] = config.get(i, 0) + 1
        worth += float(values[i])
        c -= int(lengths[i])
    return config, worth


def drawn(weights: np.ndarray, rng: np.random.Generator) -> int:
    by = np.cumsum(weights)
    return int(np.searchsorted(by, rng.random() * by[-1], "right"))


def priced(lengths: np.ndarray, need: np.ndarray, capacity: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """Prices of the best dual bound found, the best value of every capacity, and the bound."""
    values = lengths / capacity
    held: tuple = (None, None, 0.0)
    for step in range(STEPS + 1):
        best = price(lengths, values, capacity)
        bound = float((need * values).sum() / best[capacity])
        if bound > held[2]:
            held = values, best, bound
        if step == STEPS:
            break
        got = np.zeros(len(lengths))
        for _ in range(DRAWN):
            config, worth = column(drawn(need * values, rng), lengths, values, need, best, capacity, rng)
            if worth >= (1 - EPSILON) * best[capacity]:
                for i, k in config.items():
                    got[i] += k
        covered = got / need
        mean = float((covered * need * values).sum() / (need * values).sum())
        if not mean:
            break
        values = values * np.exp(RATE * np.clip(1 - covered / mean, -1, 1))
    return held


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], int, float]:
    """(configuration as {length: count}, sequences) that hold exactly the histogram, how many
    of these the program made before best fit, and its lower bound of the sequences."""
    rng = np.random.default_rng(SEED)
    lengths = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[x] for x in lengths.tolist()], np.int64)
    made: Counter = Counter()
    bound = 0.0
    for nth in range(rounds):
        live = np.flatnonzero(left)
        if not len(live):
            break
        sizes, own = lengths[live], left[live]
        values, best, least = priced(sizes, own, capacity, rng)
        bound = max(bound, least if not nth else 0.0)
        accept = (1 - 1e-9 - (0.0 if nth < rounds // 2 else EPSILON / (1 << (rounds - nth)))) * best[capacity]
        aim = float((own * values).sum()) / 2
        failed = 0
        while failed < TRIES and float((own * values).sum()) > aim:
            config, worth = column(drawn(own * values, rng), sizes, values, own, best, capacity, rng)
            if worth < accept or capacity - sum(int(sizes[i]) * k for i, k in config.items()) > EPSILON * capacity:
                failed += 1
                continue
            failed = 0
            take = max(1, min(int(own[i]) // k for i, k in config.items()) // SHARE)
            made[tuple(sorted((int(sizes[i]), k) for i, k in config.items()))] += take
            for i, k in config.items():
                own[i] -= k * take
        left[live] = own
    plan = [(dict(c), n) for c, n in made.items()]
    rest = {int(x): int(n) for x, n in zip(lengths, left, strict=True) if n}
    return best_fit(rest, capacity, plan), sum(made.values()), bound


def best_fit(histogram: dict[int, int], capacity: int, opened: list[tuple[dict[int, int], int]] = ()) -> list[tuple[dict[int, int], int]]:
    """Best-fit-decreasing where equal sequences are one entry with a count; ``opened`` are
    sequences that hold something already."""
    import bisect

    open_by: dict[int, list[list]] = {}  # free place -> entries [content, count]
    free: list[int] = []

    def put(place: int, content: dict[int, int], count: int) -> None:
        if place not in open_by:
            open_by[place] = []
            bisect.insort(free, place)
        open_by[place].append([content, count])

    for content, count in opened:
        put(capacity - sum(x * n for x, n in content.items()), content, count)
    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            at = bisect.bisect_left(free, length)
            if at == len(free):  # new sequences, each filled with this length as far as it goes
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    put(capacity - each * length, {length: each}, full)
                if rest:
                    put(capacity - rest * length, {length: rest}, 1)
                break
            place = free[at]
            entry = open_by[place][-1]
            each = min(place // length, n)
            count = min(entry[1], n // each)
            entry[1] -= count
            if not entry[1]:
                open_by[place].pop()
                if not open_by[place]:
                    del open_by[place]
                    free.pop(at)
            put(place - each * length, entry[0] | {length: entry[0].get(length, 0) + each}, count)
            n -= each * count
    return [(content, count) for entries in open_by.values() for content, count in entries]


def segments(plan: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Columns length, rank, base, each, offset: the pieces of a length from a rank on
    lie ``each`` to a sequence, from sequence ``base`` on, at ``offset``."""
    rows, used, base = [], Counter(), 0
    for content, count in plan:
        offset = 0
        for length, each in sorted(content.items(), reverse=True):
            rows.append((length, used[length], base, each, offset))
            used[length] += each * count
            offset += each * length
        base += count
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "base", "each", "offset"), cols, strict=True))


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """The pieces with sequence_id and offset.  ``pieces`` is read three times: for the
    histogram, for the cells' counts and for the ranks; hand in a durable one."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    seg = segments(solve(histogram, capacity, rounds)[0])
    keys = seg["length"] * (1 << 44) + seg["rank"]

    order = ["doc_id", "piece", "ids_crc32"]
    cells = pieces.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(CELLS)).cast("int"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.groupBy("length", "_cell").agg(F.count("*").alias("_n")).select("length", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_cell").orderBy(*order))
    # At most capacity * CELLS rows, whatever the input.
    ranked = cells.withColumn("_rank", rank).join(F.broadcast(offsets), ["length", "_cell"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, r = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, length * (1 << 44) + r, "right") - 1
            nth = r - seg["rank"][at]
            each = seg["each"][at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seg["base"][at] + nth // each), pa.array(seg["offset"][at] + nth % each * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(durable(token_pieces(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable] = {"op8_packing": op8_packing}
ORACLE: dict[str, str] = {}
