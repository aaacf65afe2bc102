"""What the corpus operators share: table access, row keys, durable cuts and
vectorised word segmentation over Arrow buffers.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D.  Those are ASCII
bytes, so segmenting UTF-8 bytes gives the same words as segmenting characters.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Odd multipliers of the rolling hashes (any odd 64-bit numbers do).
BYTE_MUL, WORD_MUL = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only where the driver is the cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame, spent: Iterable[DataFrame] = ()) -> DataFrame:
    """Cut the lineage: write the rows to a table in the shared folder and read it back.
    Then delete the tables of the ``spent`` durable frames, which nothing may read any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    discard(spent)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[out] = path
    return out


_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(frames: Iterable[DataFrame]) -> None:
    for frame in frames:
        path = _tables.pop(frame, None)
        if path:
            sc = frame.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one column-pruned aggregate."""
    return df.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0


def shuffle_partitions(df: DataFrame, least: int = 1) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), least)


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """The id, and a hash of the text that tells rows with one id apart; rows equal in
    both columns get equal results from every operator here, so they may share a key."""
    c, t = F.col(id_col), F.col(text_col)
    return F.coalesce(c.cast("long"), F.lit(-1)).alias("_k1"), F.hash(t, c.isNull(), t.isNull()).alias("_k2")


def free_name(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have yet, in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


# --- Arrow text columns as numpy ------------------------------------------------


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 bounds of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, bounds, data = column.buffers()
    at = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text_col: str, most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``most`` text bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(mul: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """mul**i and mul**-i modulo 2**64, for i below n."""
    have = _powers.get(mul)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(mul, -1, 1 << 64)
        pair = []
        for m in (mul, inverse):
            out = np.full(size, m, U64)
            out[0] = 1
            pair.append(np.multiply.accumulate(out))
        if size > 1 << 24:  # rare: one very long text; not kept
            return pair[0], pair[1]
        have = _powers[mul] = (pair[0], pair[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(values: np.ndarray, mul: int) -> np.ndarray:
    """Cumulative sums of value * mul**i, with a leading zero."""
    up, _ = powers(mul, len(values) + 1)
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def rolled(values: np.ndarray, k: int, mul: int = WORD_MUL) -> np.ndarray:
    """Unmixed rolling hash of every k consecutive values."""
    if len(values) < k:
        return np.zeros(0, U64)
    c = prefix_hash(values, mul)
    _, down = powers(mul, len(values) + 1)
    return (c[k:] - c[:-k]) * down[: len(values) - k + 1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    if len(x) < w:
        return x[:0]
    width = 1
    while width * 2 <= w:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    if width < w:
        x = np.minimum(x[: len(x) - (w - width)], x[w - width :])
    return x


#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64
#: Masks of the low bits of eight bytes, by the number of bytes.
LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], U64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as little-endian numbers (zeros past the end)."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: eight bytes at a time go through ``mix``, which no
    arrangement of the bytes cancels as it does in a polynomial modulo 2**64."""
    size = ends - starts
    view = eights(data)
    out = mix(size.astype(U64) * U64(BYTE_MUL))
    going = np.arange(len(starts))
    at = 0
    while len(going):
        left = np.minimum(size[going] - at, 8)
        out[going] = mix((out[going] ^ (view[starts[going] + at] & LOW_BYTES[left])) * U64(WORD_MUL) + U64(at + 1))
        at += 8
        going = going[size[going] > at]
        if at >= LONG_WORD:
            break
    raw = memoryview(np.ascontiguousarray(data))
    for i in going.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
    return out


class Words:
    """Words of a batch of rows: byte bounds, 64-bit hashes and the first word of each row."""

    def __init__(self, data: np.ndarray, at: np.ndarray, breaks: np.ndarray | None = None):
        self.data, self.at = data, at
        n = len(data)
        word = ~SEPARATOR[data]
        first = np.zeros(n + 1, bool)
        first[at] = True
        if breaks is not None:
            first[breaks] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        self.starts = np.flatnonzero(word & (~before | first[:-1]))
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.ends = np.flatnonzero(word & (~after | first[1:])) + 1
        self.row_at = np.searchsorted(self.starts, at)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.data, self.starts, self.ends)
        return self._hash

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.row_at))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def cover(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Mask of the n places that lie in any half-open span."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, stops, -1)
    return np.cumsum(step[:-1]) > 0
