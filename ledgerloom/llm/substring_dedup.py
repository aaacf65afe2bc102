"""Substring dedup of word windows by super-k-mer partitioning.

A window is ``k`` consecutive words of one document.  Every word covered by a window
whose word sequence also starts anywhere else, the same document included, is
removed; windows are judged on the input.  See ``superkmers`` for the partitioning.
In a bucket windows are sorted by a rolling hash and neighbours of equal hash are
compared word by word, by numbers that stand for the words' bytes, so a collision of
hashes never makes two windows equal.

Edge cases: a null or empty text has no words and stays as it is; a document shorter
than a window loses nothing; rows that repeat, with one id or several, are documents of
their own and remove each other's windows; very long texts travel as many strings; an
empty table gives no rows; extra columns are carried on, whatever their names, but for
n_words and n_removed, which are the result's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import LOW_BYTES, Words, cover, eights, rolled, slices, table
from .superkmers import Bucket, repeated_spans, run_spans, span_mask, with_spans

WINDOW, GRAM = 35, 4


def exact_ids(w: Words, which: np.ndarray) -> np.ndarray:
    """A number for each of some words: equal bytes, equal numbers, and none for others."""
    size = (w.ends - w.starts)[which]
    order = np.lexsort((size, w.hashes[which]))
    word, n = which[order], size[order]
    alike = np.zeros(len(order), bool)
    alike[1:] = (w.hashes[word[1:]] == w.hashes[word[:-1]]) & (n[1:] == n[:-1])
    view = eights(w.data)
    differ = np.zeros(len(order), bool)
    going, at = np.flatnonzero(alike), 0
    while len(going):
        mask = LOW_BYTES[np.minimum(n[going] - at, 8)]
        differ[going] |= ((view[w.starts[word[going]] + at] ^ view[w.starts[word[going - 1]] + at]) & mask) != 0
        at += 8
        going = going[(n[going] > at) & ~differ[going]]
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(~alike)
    if differ.any():  # words of one hash that differ: by their bytes
        have: dict[bytes, int] = {}
        for i in order[np.isin(np.cumsum(~alike), np.cumsum(~alike)[differ])].tolist():
            raw = w.data[w.starts[which[i]] : w.ends[which[i]]].tobytes()
            ids[i] = have.setdefault(raw, len(order) + 1 + len(have))
    return ids


def repeated_windows(bucket: Bucket, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of words covered by repeated windows: (string, first word, stop word)."""
    data, at = bucket.joined(np.arange(len(bucket.strings)))
    w = Words(data, at)
    row = w.rows()
    window = rolled(w.hashes, k)
    whole = np.flatnonzero(row[: len(window)] == row[k - 1 :])
    hashes = window[whole]
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    flag = bucket.count[row[whole]] > 1
    same = np.flatnonzero(ordered[1:] == ordered[:-1])
    a, b = whole[order[same]], whole[order[same + 1]]
    # The words of windows whose hash occurs again are compared exactly.
    words = np.flatnonzero(cover(np.append(a, b), np.append(a, b) + k, len(w)))
    ids = np.zeros(len(w), np.int64)
    ids[words] = exact_ids(w, words)
    equal = np.ones(len(same), bool)
    for i in range(k):
        equal &= ids[a + i] == ids[b + i]
    flag[order[same[equal]]] = True
    flag[order[same[equal] + 1]] = True
    if not equal.all():  # the hash collided: compare every window of those groups with all of its group
        for h in np.unique(ordered[same[~equal]]).tolist():
            group = order[np.searchsorted(ordered, h, "left") : np.searchsorted(ordered, h, "right")]
            seen: dict[bytes, int] = {}
            for g in group.tolist():
                key = ids[whole[g] : whole[g] + k].tobytes()
                if key in seen:
                    flag[g] = flag[seen[key]] = True
                seen.setdefault(key, g)
    return run_spans(flag, row[whole], whole - w.row_at[row[whole]], k)


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = GRAM, id_col: str = "doc_id", text_col: str = "text", cut: bool = False) -> DataFrame:
    """The rows of ``docs`` with their text replaced by what is kept, and n_words and
    n_removed.  Kept words are joined by one space; with ``cut`` a text that loses
    nothing stays byte for byte, and others lose the removed words with the white
    space after them."""
    docs = docs.drop(*(c for c in ("n_words", "n_removed") if c not in (id_col, text_col)))
    spans = repeated_spans(docs, k, m, True, repeated_windows, id_col, text_col, most=1 << 12)
    joined = with_spans(docs, spans, id_col, text_col)
    place = joined.columns.index(text_col)
    names = joined.columns[:-1]
    schema = T.StructType([joined.schema[c] for c in names] + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 2 << 20):
            kept, n_words, n_removed = [], [], []
            for text, span in zip(batch.column(place).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1), strict=True):
                words = (text or b"").split()
                n_words.append(len(words))
                if not span.is_valid:
                    n_removed.append(0)
                    kept.append(text if cut else b" ".join(words))
                    continue
                gone = span_mask(span.values.to_numpy(zero_copy_only=False), len(words))
                n_removed.append(int(gone.sum()))
                if cut:
                    w = Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                    # a word goes with what follows it, up to the next word
                    stops = np.append(w.starts[1:], len(text))
                    inside = np.ones(len(text), bool)
                    for a, b in zip(w.starts[gone].tolist(), stops[gone].tolist(), strict=True):
                        inside[a:b] = False
                    kept.append(np.frombuffer(text, np.uint8)[inside].tobytes())
                else:
                    kept.append(b" ".join(compress(words, ~gone)))
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*names, "n_words", "n_removed"])

    return joined.mapInArrow(run, schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable] = {"op1_substring_dedup": op1_substring_dedup}
ORACLE: dict[str, str] = {}
