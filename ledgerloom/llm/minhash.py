"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A signature has CHUNKS * WIDTH components, each the lowest 16 bits of a least hash
over the document's shingles; two components differ with about 1 - Jaccard.  The
components are split into CHUNKS chunks.  By pigeonhole, two signatures that differ
in fewer than CHUNKS * (ERRORS + 1) components agree in some chunk but for ERRORS
components, so indexing every chunk with each choice of ERRORS components left out
finds every such pair: 14 chunks of 5 with one error guarantee distances up to 27 of
70.  At a Jaccard of 0.8 the distance is 14 on average, with a deviation of 3.3.

Documents with equal shingle sets are one node: equal by two independent 64-bit sums of mixed
shingle hashes, of which the first is the node's name; where sets of different second sums
share a name, each gets a name of its own.
A key with several nodes links each of them to one hub, the node whose keys are the most
shared; a node first meets the hub it has most keys in common with.  Then every key whose
nodes lie in different components is searched: two nodes of different components pass if
their sizes allow the threshold, if a bitmap of their sets (each shingle flips one bit, so
sets differ in at least as many shingles as bitmaps in bits: exact; a bitmap has as many
bits as its set has shingles or more, and is folded onto the other's length) allows it, and
if their signatures are within reach.  In each round a node outside its key's largest
component names its closest such partner, so that copies never expand to pairs; when a
round confirms nothing, all pairs that still pass are confirmed, so no link between
components is lost.  Links count only if the full sets confirm them: each pair travels to
its end of more pairs, whose pairs are dealt to parts of about PART, so no hub's partition
grows with its partners.

A key of more than BLOCK nodes is dealt by blocks of its nodes, every two blocks to a group
of their own, so no group holds more than two blocks of a key.

What may be lost: a pair at a Jaccard of 0.8 is within the guaranteed distance with a
probability of 0.9998 (the distance is binomial), pairs above it more surely.

Edge cases: documents without words (null, empty or white space) have no shingles and
are linked with nothing; a document of fewer words than a shingle has one, its whole
sequence; rows with a null id are left out of linking and keep a null component; rows
that share an id and have words are one document, whatever their texts; a very long text
is one set like any other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import U64, Words, discard, durable, lower_ascii, mix, rolled, row_key, shuffle_partitions, slices, table, texts
from .components import components

CHUNKS, WIDTH, ERRORS = 14, 5, 1
SIZE = CHUNKS * WIDTH
#: Bits of the shortest bitmap, and of a node's name.
BITS, NAME = 1024, 64
#: Bytes of a group of keys (held in a task a few times); nodes of a key that are compared
#: with each other at once; pairs, and bytes of their bitmaps, that a task holds; a hub's
#: pairs that are confirmed in one partition.
GROUP_BYTES, BLOCK, CHUNK, CHUNK_BYTES, PART = 5 << 20, 4096, 1 << 16, 8 << 20, 256
#: The distance that the index guarantees.
REACH = CHUNKS * (ERRORS + 1) - 1
#: Fixed odd multipliers of the hash functions, from a rule.
MULTIPLIERS = mix(np.arange(1, SIZE + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, concatenated, and the rows' bounds."""
    data, at = texts(column)
    w = Words(lower_ascii(data), at)
    rows = len(at) - 1
    if not len(w):
        return np.zeros(0, U64), np.zeros(rows + 1, np.int64)
    hashes, first = w.hashes, w.row_at
    rolling = mix(rolled(hashes, size) + U64(size))
    parts, bounds = [], np.zeros(rows + 1, np.int64)
    for i in range(rows):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= size:
            parts.append(np.unique(rolling[a : b - size + 1]))
        elif b > a:
            parts.append(mix(rolled(hashes[a:b], b - a) + U64(b - a)))
        else:
            parts.append(np.zeros(0, U64))
        bounds[i + 1] = bounds[i] + len(parts[-1])
    return np.concatenate(parts), bounds


def widths(n: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set: the least power of two that is not below its size or BITS."""
    return np.left_shift(1, np.ceil(np.log2(np.maximum(n, BITS))).astype(np.int64))


def bit_distances(bits: list[bytes], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In how many bits the bitmaps of rows ``p`` and ``q`` differ, the longer of the two folded
    onto the other's length: a place of a set's hash is its low bits."""
    size = np.array([len(b) for b in bits], np.int64)
    least = np.minimum(size[p], size[q])
    out = np.zeros(len(p), np.int64)
    for width in np.unique(least).tolist():
        at = np.flatnonzero(least == width)
        rows = np.unique(np.concatenate([p[at], q[at]]))
        folded = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[i], U64).reshape(-1, width // 8), axis=0) for i in rows.tolist()])
        x, y = np.searchsorted(rows, p[at]), np.searchsorted(rows, q[at])
        step = max(CHUNK_BYTES // width, 1)
        for i in range(0, len(at), step):
            out[at[i : i + step]] = np.bitwise_count(folded[x[i : i + step]] ^ folded[y[i : i + step]]).sum(1, dtype=np.int64)
    return out


def signatures(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_k1, _k2, doc_id, n_shingles, node and proof (two hashes of the set), sig and bits (null
    without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets, at = shingle_sets(batch.column(3), size)
            n = np.diff(at)
            full = np.flatnonzero(n)
            sig = np.zeros((len(full), SIZE), np.uint16)
            node, proof = np.zeros(len(n), U64), np.zeros(len(n), U64)
            wide = widths(n[full])
            begins = np.append(0, np.cumsum(wide))
            parity = np.zeros(begins[-1] // 8, np.uint8)
            if len(full):
                starts = at[full]
                count = n[full].astype(U64)
                node[full] = mix(np.add.reduceat(mix(sets), starts) + count) >> U64(64 - NAME)
                proof[full] = mix(np.add.reduceat(mix(sets ^ U64(0xD1B54A32D192ED03)), starts) ^ count)
                for j, mul in enumerate(MULTIPLIERS):
                    sig[:, j] = np.minimum.reduceat(((sets * mul) >> U64(24)), starts).astype(np.uint16)
                bit = (mix(sets ^ U64(0xA0761D6478BD642F)) & np.repeat(wide - 1, n[full]).astype(U64)).astype(np.int64) + np.repeat(begins[:-1], n[full])
                np.bitwise_xor.at(parity, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
            packed: list[list] = [[None] * len(n), [None] * len(n)]
            for j, (i, s) in enumerate(zip(full.tolist(), sig, strict=True)):
                packed[0][i], packed[1][i] = s.tobytes(), parity[begins[j] // 8 : begins[j + 1] // 8].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), *(pa.array(x.view(np.int64)) for x in (node, proof)), *(pa.array(x, pa.binary()) for x in packed)], ["_k1", "_k2", "doc_id", "n_shingles", "node", "proof", "sig", "bits"])

    k1, k2 = row_key(id_col, text_col)
    return docs.select(k1, k2, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "_k1 long, _k2 int, doc_id long, n_shingles long, node long, proof long, sig binary, bits binary")


def index_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): each chunk of a signature with each of its components left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(b.num_rows, CHUNKS, WIDTH).astype(U64)
            node = b.column(0)
            for chunk in range(CHUNKS):
                for out in range(WIDTH):
                    key = np.zeros(b.num_rows, U64)
                    for j in range(WIDTH):
                        if j != out:
                            key = (key << U64(16)) | sig[:, chunk, j]
                    key = mix(key ^ mix(np.full(1, chunk * WIDTH + out + 1, U64)))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), node], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def confirmed(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets have 100 * common >= percent * union.
    ``rows`` has (node, text) for every node of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, p = None, np.zeros(0, U64)
        for batch in slices(batches, "other_text", 2 << 20):
            y, ya = shingle_sets(batch.column(3), size)
            keep = []
            # The pairs of a hub arrive together: its set is made once.
            for i, name in enumerate(batch.column(0).to_pylist()):
                if name != hub:
                    hub, p = name, shingle_sets(batch.column(2).slice(i, 1), size)[0]
                q = y[ya[i] : ya[i + 1]]
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            ends = pa.table([batch.column(0), batch.column(1)], ["hub", "other"]).filter(pa.array(keep))
            yield from ends.to_batches()

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("many"))
    counted = pairs.join(ends.select(F.col("node").alias("a"), F.col("many").alias("many_a")), "a").join(ends.select(F.col("node").alias("b"), F.col("many").alias("many_b")), "b")
    first = F.col("many_a") >= F.col("many_b")
    turned = counted.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.ceil(F.greatest("many_a", "many_b") / PART).cast("int").alias("parts"))
    turned = turned.withColumn("part", F.pmod(F.hash("other"), F.col("parts")))
    hubs = turned.select("hub", "parts").distinct().join(rows.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub")
    hubs = hubs.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "hub_text")
    others = turned.join(rows.select(F.col("node").alias("other"), F.col("text").alias("other_text")), "other")
    sure = others.join(hubs, ["hub", "part"]).select("hub", "other", "hub_text", "other_text").mapInArrow(run, "hub long, other long")
    return sure.select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"))


def cross_pairs(key: tuple, rows: pa.Table, percent: int, every: bool) -> pa.Table:
    """Pairs (a, b) of nodes that share a (key, slot), lie in different components and pass:
    all of them, or the closest of each node outside the largest component of its slot."""
    slot, label, n = (rows.column(c).to_numpy() for c in ("slot", "label", "n"))
    order = np.lexsort((n, slot, rows.column("key").to_numpy()))
    slot, label, n = slot[order], label[order], n[order].astype(np.int64)
    keys, node = rows.column("key").to_numpy()[order], rows.column("node").to_numpy()[order]
    new = np.append(True, (keys[1:] != keys[:-1]) | (slot[1:] != slot[:-1]))
    group = np.cumsum(new) - 1
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(len(order), SIZE)[order]
    bits = rows.column("bits").to_pylist()
    bits = [bits[i] for i in order.tolist()]
    # The commonest label of each group; every cross pair has a node of another one.
    runs = np.lexsort((label, group))
    begins = np.flatnonzero(np.append(True, (np.diff(group[runs]) != 0) | (np.diff(label[runs]) != 0)))
    many = np.diff(np.append(begins, len(runs)))
    by = np.lexsort((many, group[runs[begins]]))
    major = label[runs[begins]][by[np.append(np.flatnonzero(np.diff(group[runs[begins]][by])), len(by) - 1)]][group]
    minor = np.flatnonzero(label != major)
    spread = np.int64(n.max(initial=0)) * 100 // percent + 2
    place = group * spread + n
    lo = np.searchsorted(place, group[minor] * spread + -(-percent * n[minor] // 100))
    hi = np.searchsorted(place, group[minor] * spread + n[minor] * 100 // percent, "right")
    size = hi - lo
    ends = np.cumsum(size)
    closest = np.full(len(minor), 1 << 62)
    out_a, out_b = [], []
    at = 0
    while at < len(minor):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        m = size[at:stop]
        i = np.repeat(np.arange(at, stop), m)
        p = minor[i]
        q = np.repeat(lo[at:stop], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        at = stop
        ok = label[p] != label[q]
        i, p, q = i[ok], p[ok], q[ok]
        need = -(-percent * (n[p] + n[q]) // (100 + percent))
        apart = (sig[p] != sig[q]).sum(1)
        ok = apart <= REACH
        i, p, q, need, apart = i[ok], p[ok], q[ok], need[ok], apart[ok]
        ok = bit_distances(bits, p, q) <= n[p] + n[q] - 2 * need
        i, p, q, apart = i[ok], p[ok], q[ok], apart[ok]
        if every:
            out_a.append(p)
            out_b.append(q)
        else:
            np.minimum.at(closest, i, (apart << 40) | q)
    if not every:
        has = closest < 1 << 62
        out_a, out_b = [minor[has]], [closest[has] & ((1 << 40) - 1)]
    a, b = (node[np.concatenate(x)] if x else np.zeros(0, np.int64) for x in (out_a, out_b))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.table({"a": pa.array(pairs[0]), "b": pa.array(pairs[1])})


def apart_pairs(shared: DataFrame, nodes: DataFrame, labels: DataFrame, percent: int, every: bool, row_bytes: float) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs between components, from the keys whose nodes lie in several, and the
    table of those that they are made from."""
    labelled = shared.join(labels, "node", "left").select("key", "size", "node", F.coalesce("label", "node").alias("label"))
    split = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rest = durable(labelled.join(split, "key", "left_semi"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.hash("node"), blocks)
    slots = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(own, j) * blocks + F.greatest(own, j))
    dealt = rest.select("key", "node", "label", F.explode(slots).alias("slot")).join(nodes.select("node", "n", "sig", "bits"), "node")
    # Keys travel together, as most hold few nodes, in groups that do not grow with the table.
    total = rest.agg(F.sum(blocks)).first()[0] or 0
    group = F.pmod(F.xxhash64("key", "slot"), F.lit(max(shuffle_partitions(shared), math.ceil(total * row_bytes / GROUP_BYTES))))
    return dealt.groupBy(group).applyInArrow(lambda key, rows: cross_pairs(key, rows, percent, every), "a long, b long").distinct(), rest


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    signed = durable(signatures(docs, size, id_col, text_col))
    clash = signed.where("sig is not null").groupBy("node").agg(F.min("proof").alias("lo"), F.max("proof").alias("hi")).where("lo <> hi").select("node", "lo")
    clash = durable(clash)
    if not clash.isEmpty():
        # Sets that share a name: all but the one of the least proof are named anew.
        split = F.when(F.col("lo") != F.col("proof"), F.xxhash64("node", "proof")).otherwise(F.col("node"))
        signed = durable(signed.join(clash, "node", "left").withColumn("node", split).drop("lo"), spent=[signed])
    discard([clash])
    named = signed.where("doc_id is not null and sig is not null")
    # A node is a set of shingles; the row of its least id has its text.
    nodes = durable(named.groupBy("node").agg(F.min(F.struct("_k1", "_k2")).alias("r"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits")).select("node", "r._k1", "r._k2", "n", "sig", "bits"))
    # Rows of one id are one document.
    ids = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a <> hi").select("doc_id", "a")
    twins = named.join(ids, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct()

    # 180 bytes beside the bitmap
    row_bytes = 180 + (nodes.agg(F.avg(F.octet_length("bits"))).first()[0] or 0)
    keys = index_keys(nodes)
    shared = durable(keys.join(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"))
    weight = shared.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", -F.col("node"))).alias("h")).select("key", (-F.col("h.col2")).alias("hub"))
    hubbed = shared.join(hubs, "key").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("keys"))

    def confirm(some: DataFrame) -> DataFrame:
        return confirmed(some, node_texts(docs, nodes, some, id_col, text_col), size, percent)

    # A node first meets the hub it shares most keys with.
    best = hubbed.groupBy("node").agg(F.max(F.struct("keys", -F.col("hub"))).alias("t")).select("node", (-F.col("t.col2")).alias("hub"))
    tested = durable(best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct())
    links = durable(confirm(tested).union(twins))
    labels = components(links)
    every = False
    while True:
        pairs, rest = apart_pairs(shared, nodes, labels, percent, every, row_bytes)
        more = durable(pairs.join(tested, ["a", "b"], "left_anti"), spent=[rest])
        new = durable(confirm(more))
        found = not new.isEmpty()
        if found:
            links = durable(links.union(new), spent=[links, new])
            labels = components(links)
        if every:
            break
        tested = durable(tested.union(more), spent=[tested, more])
        every = not found
    discard([shared, tested, more])
    least = nodes.select("node", F.col("_k1").alias("id")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    member = least.join(least.groupBy("label").agg(F.min("id").alias("_c")), "label").select("node", "_c")
    out = signed.join(member, "node", "left").select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("_c")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def node_texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of the nodes in any pair."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    k1, k2 = row_key(id_col, text_col)
    rows = docs.select(k1, k2, F.col(text_col).alias("text"))
    found = rows.join(nodes.join(wanted, "node", "left_semi").select("node", "_k1", "_k2"), ["_k1", "_k2"])
    return found.dropDuplicates(["node"]).select("node", "text")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op7_minhash": op7_minhash}
ORACLE: dict[str, str] = {}
