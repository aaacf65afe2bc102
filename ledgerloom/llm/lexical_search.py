"""Ranked lexical search, document at a time.

A block of items has a bounded vocabulary.  One pass over the documents builds shards of
an index for it: a shard holds some of a task's documents in the order of their ids, and
for each of the vocabulary's terms found in them the documents and frequencies, as gaps
and counts in variable-length bytes.  Sums over the shards give the collection's counts
and with them the terms' weights.  A second pass searches each shard: for an item, the
posting lists of its terms are merged by a heap of their next documents, a document is
scored whole before the next one, and the best stand in a bounded heap keyed by score
and id.  What the tasks found is merged by rank, first within groups of tasks.

Lists that cannot lift a document into the heap by themselves stand aside: sorted by
the most they can add, the first ones whose sum stays below the score to be beaten are
not merged but asked for the candidates of the others, greatest first, as long as the
candidate may still get in.  The score to be beaten is that of the heap's last place, and
until it is full what the tenth-best document of some single list has: never more than
the final tenth score, so no result is lost and ties are kept.

Documents are dealt as their table's files are, so no id or term, however common, meets in
one task.  A shard is bounded by ROWS documents and BYTES of text (one document at
least), a block of items by TERMS of their terms; a larger set of items goes in several
blocks, each with its own pass, one block at a time on the driver.

Edge cases: null texts and those without terms count for nothing; rows that share an id
are documents of their own, a null id ranks after all others of its score; items without
terms or matches have no rows, and every row of the items' table is an item, also where ids
repeat or are null; no documents or no items give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import U64, durable, slices, table, texts
from .spans import same_spans, terms

#: Results of an item; documents and text bytes of a shard; terms of a block of items.
TOP, ROWS, BYTES, TERMS = 10, 4096, 32 << 20, 1 << 18
#: Groups of tasks whose results are merged before all are.
GROUPS = 64

SHARD = "ids array<long>, lengths binary, terms array<int>, n_docs array<int>, docs array<binary>, tfs array<binary>, with_terms long, all_terms long"


# --- Compressed lists of numbers -------------------------------------------------


def to_bytes(values: np.ndarray) -> bytes:
    """Seven bits a byte, low ones first; the high bit says that more follow."""
    v = values.astype(U64)
    more = np.zeros(len(v), np.int64)
    rest = v >> U64(7)
    while rest.any():
        more += rest > 0
        rest >>= U64(7)
    ends = np.cumsum(more + 1)
    out = np.zeros(ends[-1] if len(v) else 0, np.uint8)
    for k in range(int(more.max(initial=0)) + 1):
        has = more >= k
        byte = (v[has] >> U64(7 * k)) & U64(127)
        out[(ends - more - 1)[has] + k] = byte.astype(np.uint8) | np.where(more[has] > k, 128, 0).astype(np.uint8)
    return out.tobytes()


def from_bytes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.append(True, raw[:-1] < 128))
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


# --- The vocabulary of a block of items --------------------------------------------


class Vocabulary:
    """The distinct terms of a block of items, numbered, found by their bytes."""

    def __init__(self, items: list[list[bytes]]):
        known: dict[bytes, int] = {}
        self.items = [[known.setdefault(t, len(known)) for t in dict.fromkeys(item)] for item in items]
        self.size = len(known)
        data = np.frombuffer(b" ".join(known), np.uint8)
        w = terms(data, np.array([0, len(data)]))
        order = np.argsort(w.hashes, kind="stable")
        self.data, self.starts, self.ends = w.data, w.starts[order], w.ends[order]
        self.hashes, self.number = w.hashes[order], order
        self.bits = max(10, self.size.bit_length() + 4)
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self.slot(self.hashes)] = True

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> U64(64 - self.bits)).astype(np.int64)

    def find(self, w) -> tuple[np.ndarray, np.ndarray]:
        """The words of ``w`` that are terms of the vocabulary, and their numbers."""
        maybe = np.flatnonzero(self.filter[self.slot(w.hashes)])
        at = np.searchsorted(self.hashes, w.hashes[maybe])
        word, number = [], []
        while len(maybe):  # once, but for terms whose hashes are equal
            on = at < self.size
            maybe, at = maybe[on], at[on]
            on = self.hashes[at] == w.hashes[maybe]
            maybe, at = maybe[on], at[on]
            size = w.ends[maybe] - w.starts[maybe]
            equal = size == self.ends[at] - self.starts[at]
            equal[equal] = same_spans(w.data, w.starts[maybe[equal]], self.data, self.starts[at[equal]], size[equal])
            word.append(maybe[equal])
            number.append(self.number[at[equal]])
            maybe, at = maybe[~equal], at[~equal] + 1
        if not word:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(word), np.concatenate(number)


def item_terms(text: str | None) -> list[bytes]:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    w = terms(raw, np.array([0, len(raw)]))
    return [w.data[a:b].tobytes() for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """(id, terms) of the items, TERMS of them at a time; partitions come one by one."""
    held, size = [], 0
    for r in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        found = item_terms(r["t"])
        if held and size + len(found) > TERMS:
            yield held
            held, size = [], 0
        held.append((r["i"], found))
        size += len(found)
    if held:
        yield held


# --- The index -------------------------------------------------------------------


def shard_of(ids: list, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray) -> dict:
    """One row of the index; (doc, term) are the places of terms, documents in order of ids."""
    n = len(ids)
    key, tf = np.unique(term * n + doc, return_counts=True)
    owner, place = np.divmod(key, n)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    ends = np.append(first, len(owner))[1:]
    gaps = np.diff(place, prepend=0)
    gaps[first] = place[first]
    return {
        "ids": ids,
        "lengths": to_bytes(lengths),
        "terms": owner[first],
        "n_docs": ends - first,
        "docs": [to_bytes(gaps[a:b]) for a, b in zip(first, ends, strict=True)],
        "tfs": [to_bytes(tf[a:b]) for a, b in zip(first, ends, strict=True)],
        "with_terms": int((lengths > 0).sum()),
        "all_terms": int(lengths.sum()),
    }


def index(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of the index over all documents for the terms of a vocabulary."""
    schema = pa.schema([("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("terms", pa.list_(pa.int32())), ("n_docs", pa.list_(pa.int32())), ("docs", pa.list_(pa.binary())), ("tfs", pa.list_(pa.binary())), ("with_terms", pa.int64()), ("all_terms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, doc, term, size = [], [], [], [], 0

        def shard() -> pa.RecordBatch:
            n = np.concatenate(lengths)
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            row = shard_of([ids[i] for i in order], n[order], rank[np.concatenate(doc)], np.concatenate(term))
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in slices(batches, "text", 2 << 20):
            for part in (batch.slice(i, ROWS) for i in range(0, batch.num_rows, ROWS)):
                data, at = texts(part.column(1))
                if ids and (len(ids) + part.num_rows > ROWS or size + len(data) > BYTES):
                    yield shard()
                    ids, lengths, doc, term, size = [], [], [], [], 0
                w = terms(data, at)
                word, number = vocabulary.find(w)
                doc.append(w.rows()[word] + len(ids))
                term.append(number)
                lengths.append(np.diff(w.row_at))
                ids += part.column(0).to_pylist()
                size += len(data)
        if ids:
            yield shard()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SHARD)


# --- The search ------------------------------------------------------------------


class List:
    """A term's postings in a shard: documents, what each adds, and bounds of that."""

    def __init__(self, docs: np.ndarray, adds: np.ndarray):
        self.docs, self.adds = docs.tolist(), adds.tolist()
        self.most = int(adds.max())
        self.tenth = int(np.partition(adds, -TOP)[-TOP]) if len(adds) >= TOP else 0
        self._of: dict[int, int] | None = None

    @property
    def of(self) -> dict[int, int]:
        if self._of is None:
            self._of = dict(zip(self.docs, self.adds, strict=True))
        return self._of


def added(weight: int, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to the scores of documents."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def measure(n: np.ndarray, docs: int, all_terms: int) -> np.ndarray:
    """m of documents of n terms: 10 + 90 * n * N div L, in wider numbers where 64 bits are too few."""
    if 90 * int(n.max(initial=0)) * docs < 1 << 63:
        return 10 + 90 * n * docs // max(all_terms, 1)
    return np.array([10 + 90 * int(x) * docs // all_terms for x in n], np.int64)


def merged(lists: list[List], order_of: list[int], best: list[tuple[int, int]]) -> None:
    """Puts the documents of the lists into ``best``, a heap of at most TOP (score, -order)."""
    lists = sorted(lists, key=lambda x: x.most)
    below = list(accumulate((x.most for x in lists), initial=0))  # most that the first j lists add
    floor = max(x.tenth for x in lists)
    if len(best) == TOP:
        floor = max(floor, best[0][0])
    aside = 0  # lists[:aside] are only asked
    while aside < len(lists) and below[aside + 1] < floor:
        aside += 1
    heap = [(x.docs[0], j) for j, x in enumerate(lists) if j >= aside]
    heapq.heapify(heap)
    at = [0] * len(lists)
    while heap:
        d = heap[0][0]
        score = 0
        while heap and heap[0][0] == d:
            j = heap[0][1]
            x = lists[j]
            if j < aside:  # stands aside by now
                heapq.heappop(heap)
                continue
            i = at[j]
            score += x.adds[i]
            at[j] = i = i + 1
            if i < len(x.docs):
                heapq.heapreplace(heap, (x.docs[i], j))
            else:
                heapq.heappop(heap)
        if not score:
            continue
        j = aside
        while j and score + below[j] >= floor:
            j -= 1
            score += lists[j].of.get(d, 0)
        if j or score < floor:
            continue
        entry = (score, -order_of[d])
        if len(best) < TOP:
            heapq.heappush(best, entry)
        elif entry > best[0]:
            heapq.heapreplace(best, entry)
        if len(best) == TOP and best[0][0] > floor:
            floor = best[0][0]
            while aside < len(lists) and below[aside + 1] < floor:
                aside += 1


#: Order of a null id: after all others.
LAST = 1 << 64


def search(shards: DataFrame, items: list[list[int]], weights: list[int], docs: int, all_terms: int) -> DataFrame:
    """item (its place in ``items``), doc_id, score: the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, int]]] = [[] for _ in items]
        for row in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).to_pylist()):
            order_of = [LAST if i is None else i for i in row["ids"]]
            m = measure(from_bytes(row["lengths"]), docs, all_terms)
            lists: dict[int, List] = {}
            for t, places, tfs in zip(row["terms"], row["docs"], row["tfs"], strict=True):
                if weights[t] > 0:
                    at = np.cumsum(from_bytes(places))
                    adds = added(weights[t], from_bytes(tfs), m[at])
                    if adds.any():
                        lists[t] = List(at, adds)
            for item, best in zip(items, heaps, strict=True):
                own = [lists[t] for t in item if t in lists]
                if own:
                    merged(own, order_of, best)
        out = [(k, None if -o == LAST else -o, s) for k, best in enumerate(heaps) for s, o in best if s > 0]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int64())], ["item", "doc_id", "score"])

    return shards.drop("with_terms", "all_terms", "n_docs").mapInArrow(run, "item int, doc_id long, score long")


def first_places(found: DataFrame, by: list) -> DataFrame:
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= TOP)


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the TOP best documents of each item."""
    spark = docs.sparkSession
    kind = items.select(F.col(item_col).alias("item_id")).schema["item_id"].dataType
    out = None
    for block in blocks_of(items, item_col, query_col):
        vocabulary = Vocabulary([found for _, found in block])
        shards = durable(index(docs, vocabulary, id_col, text_col))
        stat = shards.agg(F.sum("with_terms").alias("n"), F.sum("all_terms").alias("l")).first()
        n, whole = stat["n"] or 0, stat["l"] or 0
        held = shards.select(F.explode(F.arrays_zip("terms", "n_docs")).alias("t")).groupBy("t.terms").agg(F.sum("t.n_docs").alias("df"))
        weights = [0] * vocabulary.size  # TERMS of them at most
        for r in held.collect():
            weights[r["terms"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["df"] + 1)))
        found = search(shards, vocabulary.items, weights, n, whole).withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        best = first_places(first_places(found, ["item", "_group"]).drop("rank"), ["item"])
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField("item_id", kind)]))
        best = durable(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), spent=[shards])  # a block's items
        out = best if out is None else out.union(best)
    if out is None:
        return items.select(F.col(item_col).alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_TERM}') AS t FROM documents),
c AS (SELECT count(*) AS n, sum(len(t)) AS l FROM d WHERE len(t) > 0),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_FOLD}, '{_TERM}')) AS term FROM benchmark),
p AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM p SEMI JOIN i USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(c.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * f.n * c.n) // CAST(c.l AS BIGINT))))) AS BIGINT) AS score
      FROM i JOIN f USING (term) JOIN w USING (term), c GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

QUERIES: dict[str, Callable] = {"op13_lexical_search": op13_lexical_search}
ORACLE: dict[str, str] = {"op13_lexical_search": SQL}
