"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is read as terms (letters, digits and bytes beyond ASCII, A-Z lower-cased).  Each
term brings its word and the character sequences it begins with, 3 to 8 bytes long, so
that inflected words are known by their stems.  Words and sequences are hashed to SLOTS
slots; a slot's input is its shrunken log-odds among labelled texts, made for a training
text from the other folds only, so that no text is its own evidence.  The network reads
windows of WINDOW terms that overlap by half in both directions, weighs its states by
attention and gives each window a logit.  It is trained in numpy on the driver, by
backpropagation through time on the windows of labelled texts that hold most evidence.
A document's score comes from the largest logit of all its windows and from how many are
toxic against what is usual in clean texts, by a logistic line fitted on the labelled texts.

Learned from are at most TOXIC toxic and CLEAN other labelled documents, those of
smallest id hash whose crc32 remainder is not held out, equal texts once: the only bound.
Counting, window selection and calibration run as Spark jobs over that sample; what
reaches the driver is bounded by it, by SLOTS and by WINDOWS for each text.  Every window
of every document is scored; no score sees labels, language, source or id.

Edge cases: a null or empty text is one window without terms and has a score like any
other; without labels of both kinds every score is the smoothed share of toxic labels; a
labelled id with several texts is learned from by its greatest text, an id labelled twice
is toxic if either label says so; a null id is not held out; rows that repeat are scored
alike; very long texts are cut into windows like others, a slice of SLICE bytes (or one
text) at a time; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOW_BYTES, U64, WORD_MUL, Words, discard, durable, eights, mix, slices, table, texts
from .quality_classifier import fit
from .spans import counted, terms

#: Labelled documents that are learned from, and folds of their evidence.
TOXIC, CLEAN, FOLDS = 2000, 4000, 4
#: Terms of a window, places between windows, windows of a text that are trained on.
WINDOW, STRIDE, WINDOWS = 32, 16, 3
#: Bits of a slot, lengths of the character sequences, weight of the prior of a slot.
SLOT_BITS, LENGTHS, PRIOR = 20, (3, 4, 5, 6, 7, 8), 10.0
SLOTS = 1 << SLOT_BITS
#: Inputs of a term: its word, its sequences, its length; states of a direction; attention.
INPUTS, STATES, ATTENTION = 2 + len(LENGTHS), 8, 8
SLICE, BATCH, STEPS, RATE = 1 << 20, 128, 1000, 0.01
#: Windows that are scored at a time.
CHUNK = 2048
THRESHOLD = 0.3


# --- Inputs ------------------------------------------------------------------------


def slots(w: Words) -> np.ndarray:
    """Slots of the word and of its first characters for each term; SLOTS where it is shorter."""
    size = w.ends - w.starts
    start = eights(w.data)[w.starts]
    shift = U64(64 - SLOT_BITS)
    rows = [w.hashes >> shift]
    for n in LENGTHS:
        h = mix((start & LOW_BYTES[n]) * U64(WORD_MUL) + U64(n)) >> shift
        rows.append(np.where(size >= n, h, U64(SLOTS)))
    return np.stack(rows).astype(np.int64)


def inputs(w: Words, evidence: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """One row of INPUTS for each term, and one of zeros at the end."""
    place = slots(w) if fold is None else slots(w) + fold * (SLOTS + 1)
    out = np.zeros((len(w) + 1, INPUTS), np.float32)
    out[:-1, :-1] = evidence[place].T
    out[:-1, -1] = np.minimum(w.ends - w.starts, 16) / 16
    return out


def windows(row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first term, terms) of all windows: every row has one, however short."""
    n = np.diff(row_at)
    per_row = 1 + np.maximum(-(-(n - WINDOW) // STRIDE), 0)
    row = np.repeat(np.arange(len(n)), per_row)
    first = row_at[row] + STRIDE * counted(np.zeros(len(n), np.int64), per_row)
    return row, first, np.minimum(row_at[row + 1] - first, WINDOW)


def laid_out(first: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers (WINDOW, windows), ``end`` where a window has none, and where it has one."""
    t = np.arange(WINDOW)[:, None]
    has = t < size
    return np.where(has, first + t, end), has


# --- The network -------------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights by name; ``kind`` is the type of all numbers."""

    def __init__(self, rng: np.random.Generator, kind: type = np.float32):
        def drawn(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / math.sqrt(shape[0])).astype(kind)

        h = STATES
        self.weights = {"att": drawn(2 * h, ATTENTION), "att0": np.zeros(ATTENTION, kind), "att1": drawn(ATTENTION), "out": drawn(2 * h), "out0": np.zeros(1, kind)}
        for way in "fb":
            self.weights |= {"x" + way: drawn(INPUTS, 3 * h), "h" + way: drawn(h, 3 * h), "0" + way: np.zeros(3 * h, kind)}

    def states(self, projected: np.ndarray, has: np.ndarray, way: str, out: np.ndarray, kept: list | None = None) -> None:
        """The states of one direction, from the projected inputs, written to ``out``."""
        u, n = self.weights["h" + way], STATES
        h = np.zeros((projected.shape[1], n), projected.dtype)
        whole = has.all(axis=1)
        for t in range(WINDOW) if way == "f" else range(WINDOW - 1, -1, -1):
            g = h @ u
            gate = sigmoid(projected[t, :, : 2 * n] + g[:, : 2 * n])
            r, z = gate[:, :n], gate[:, n:]
            new = np.tanh(projected[t, :, 2 * n :] + r * g[:, 2 * n :])
            if kept is not None:
                kept.append((t, h, r, z, new, g[:, 2 * n :]))
            after = new + z * (h - new)
            h = after if whole[t] else np.where(has[t, :, None], after, h)
            out[t] = h

    def pooled(self, s: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, ...]:
        """(logits, hidden attention, its weights, pooled states)."""
        w = self.weights
        e = np.tanh(s @ w["att"] + w["att0"])
        a = np.where(has, e @ w["att1"], -np.inf)
        a = np.exp(a - np.maximum(a.max(axis=0), -1e30))
        a /= np.maximum(a.sum(axis=0), 1e-30)
        pooled = np.einsum("tb,tbk->bk", a, s)
        return pooled @ w["out"] + w["out0"], e, a, pooled

    def logits(self, x: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logits of windows over the inputs ``x`` (its last row stands for no term)."""
        projected = {way: x @ self.weights["x" + way] + self.weights["0" + way] for way in "fb"}
        out = np.empty(len(first), x.dtype)
        for k in range(0, len(first), CHUNK):
            at, has = laid_out(first[k : k + CHUNK], size[k : k + CHUNK], len(x) - 1)
            s = np.empty((*at.shape, 2 * STATES), x.dtype)
            for i, way in enumerate("fb"):
                self.states(projected[way][at], has, way, s[:, :, i * STATES : (i + 1) * STATES])
            out[k : k + CHUNK] = self.pooled(s, has)[0]
        return out

    def gradients(self, x: np.ndarray, has: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of windows ``x`` (WINDOW, windows, INPUTS) and its gradients."""
        w, n = self.weights, STATES
        kept: dict[str, list] = {"f": [], "b": []}
        s = np.empty((*has.shape, 2 * n), x.dtype)
        for i, way in enumerate("fb"):
            self.states(x @ w["x" + way] + w["0" + way], has, way, s[:, :, i * n : (i + 1) * n], kept[way])
        logit, e, a, pooled = self.pooled(s, has)
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        d = (sigmoid(logit) - y) / len(y)
        out = {"out": pooled.T @ d, "out0": d.sum(keepdims=True)}
        dp = d[:, None] * w["out"]
        da = np.einsum("tbk,bk->tb", s, dp)
        da = a * (da - (a * da).sum(axis=0))
        out["att1"] = np.einsum("tba,tb->a", e, da)
        de = da[:, :, None] * w["att1"] * (1 - e * e)
        out["att"], out["att0"] = np.einsum("tbk,tba->ka", s, de), de.sum(axis=(0, 1))
        ds = a[:, :, None] * dp + de @ w["att"].T
        for i, way in enumerate("fb"):
            u = w["h" + way]
            dx, dh, d0 = np.zeros_like(w["x" + way]), np.zeros_like(u), np.zeros_like(w["0" + way])
            carry = np.zeros((len(y), n), x.dtype)
            for t, h, r, z, new, g in reversed(kept[way]):
                carry = carry + ds[t, :, i * n : (i + 1) * n]
                live = np.where(has[t, :, None], carry, 0)
                dn = live * (1 - z) * (1 - new * new)
                dr = dn * g * r * (1 - r)
                dz = live * (h - new) * z * (1 - z)
                dgx, dgh = np.hstack([dr, dz, dn]), np.hstack([dr, dz, dn * r])
                dx += x[t].T @ dgx
                d0 += dgx.sum(axis=0)
                dh += h.T @ dgh
                carry = carry - live + live * z + dgh @ u.T
            out |= {"x" + way: dx, "h" + way: dh, "0" + way: d0}
        return loss, out

    def train(self, x: np.ndarray, size: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> float:
        """STEPS steps of Adam over shuffled batches; x is (windows, WINDOW, INPUTS).  The mean loss of the last ones."""
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses: list[float] = []
        order = np.zeros(0, np.int64)
        for step in range(STEPS):
            if len(order) < BATCH:
                order = np.append(order, rng.permutation(len(y)))
            b, order = order[:BATCH], order[BATCH:]
            loss, g = self.gradients(np.ascontiguousarray(x[b].transpose(1, 0, 2)), np.arange(WINDOW)[:, None] < size[b], y[b])
            losses.append(loss)
            rate = RATE * (1 - step / STEPS)
            for name, w in self.weights.items():
                first[name] += 0.1 * (g[name] - first[name])
                second[name] += 0.001 * (g[name] ** 2 - second[name])
                w -= rate * (first[name] / (1 - 0.9 ** (step + 1))) / (np.sqrt(second[name] / (1 - 0.999 ** (step + 1))) + 1e-8)
        return float(np.mean(losses[-50:]))


# --- Learning ----------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id and y of the labels that may be learned from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    return usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))


def sample_of(rows: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, y, fold, text of the documents that are learned from: TOXIC + CLEAN at most."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 1").orderBy(*order).limit(TOXIC).union(known.where("y = 0").orderBy(*order).limit(CLEAN))
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    once = found.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"))
    return durable(once.select("doc_id", "y", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold"), "text"))


def evidence_of(sample: DataFrame) -> np.ndarray:
    """Log-odds of the slots: a row of SLOTS + 1 for each left-out fold, and one of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(2 * FOLDS * SLOTS, np.int32)
        for b in slices(batches, "text", SLICE):
            w = terms(*texts(b.column(2)))
            place = slots(w)
            row = np.broadcast_to(w.rows(), place.shape)
            key = np.unique((row * SLOTS + place)[place < SLOTS])
            group = b.column(1).to_numpy() * 2 + b.column(0).to_numpy()
            np.add.at(have, group[key >> SLOT_BITS].astype(np.int64) * SLOTS + (key & (SLOTS - 1)), 1)
        some = np.flatnonzero(have)
        for k in range(0, len(some), 1 << 18):
            at = some[k : k + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array((at % SLOTS).astype(np.int32)), pa.array((at // SLOTS).astype(np.int32)), pa.array(have[at])], ["slot", "group", "n"])

    rows = sample.select("y", "fold", "text").mapInArrow(count, "slot int, group int, n int")
    sums = rows.groupBy("slot").agg(*(F.coalesce(F.sum(F.when(F.col("group") == g, F.col("n"))), F.lit(0)).alias(f"g{g}") for g in range(2 * FOLDS)))
    toxic = sum((F.col(f"g{2 * f + 1}") for f in range(FOLDS)), F.lit(0))
    found = sums.where(toxic >= 2).toArrow()  # SLOTS rows at most
    totals = {(r["fold"], r["y"]): r["n"] for r in sample.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    by = np.array([found.column(f"g{g}").to_numpy() for g in range(2 * FOLDS)], float).reshape(FOLDS, 2, -1)
    size = np.array([[totals.get((f, y), 0) for y in (0, 1)] for f in range(FOLDS)], float)
    out = np.zeros((FOLDS + 1, SLOTS + 1), np.float32)
    for k in range(FOLDS + 1):
        left = [f for f in range(FOLDS) if f != k]
        b, a = by[left].sum(axis=0)
        clean, all_toxic = size[left].sum(axis=0)
        share = (all_toxic + 1) / (all_toxic + clean + 2)
        odds = np.log((a + PRIOR * share) / (b + PRIOR * (1 - share))) - math.log(share / (1 - share))
        out[k, found.column("slot").to_numpy()] = np.maximum(odds, 0) / 4
    return out


def training_windows(sample: DataFrame, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, sizes, labels) of the windows that hold most evidence: one of each toxic text,
    WINDOWS of each other one, in the order of ids."""
    flat = evidence.reshape(-1)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            w = terms(*texts(b.column(3)))
            x = inputs(w, flat, np.repeat(b.column(2).to_numpy().astype(np.int64), np.diff(w.row_at)))
            y = b.column(1).to_numpy()
            row, first, size = windows(w.row_at)
            strong = x[:, :-1].max(axis=1)
            # the most of a window is the most of its two halves
            most = np.array([strong[f : f + n].max(initial=0) for f, n in zip(first.tolist(), size.tolist(), strict=True)])
            order = np.lexsort((first, -most, row))
            nth = np.arange(len(row)) - np.searchsorted(row, row)  # rows come sorted, before and after
            keep = order[nth < np.where(y[row] == 1, 1, WINDOWS)]
            at, _ = laid_out(first[keep], size[keep], len(w))
            cells = x[at.T].reshape(len(keep), -1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row[keep])), b.column(1).take(pa.array(row[keep])), pa.array(first[keep] - w.row_at[row[keep]], pa.int64()), pa.array(size[keep], pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(cells.reshape(-1)), WINDOW * INPUTS).cast(pa.list_(pa.float32()))],
                ["doc_id", "y", "first", "size", "x"],
            )

    got = sample.mapInArrow(chosen, "doc_id long, y int, first long, size long, x array<float>").toArrow()  # WINDOWS for each text
    order = np.lexsort((got.column("first").to_numpy(), got.column("doc_id").to_numpy()))
    x = got.column("x").combine_chunks().flatten().to_numpy().reshape(-1, WINDOW, INPUTS)
    return x[order], got.column("size").to_numpy()[order], got.column("y").to_numpy()[order].astype(np.float32)


def judged(network: Network, w: Words, x: np.ndarray) -> np.ndarray:
    """Of each row the largest logit of its windows, the sum of their probabilities, their number."""
    row, first, size = windows(w.row_at)
    at = np.searchsorted(row, np.arange(len(w.row_at) - 1))
    logit = network.logits(x, first, size).astype(float)
    n = np.bincount(row, minlength=len(at))
    return np.stack([np.maximum.reduceat(logit, at), np.add.reduceat(sigmoid(logit), at), n], axis=1)


def measures(found: np.ndarray, rate: float) -> np.ndarray:
    """The largest logit, and the toxic windows against those that a clean text of as many
    windows has: a text repeated over and over is as toxic as it was."""
    return np.stack([found[:, 0], np.log((found[:, 1] + 0.5) / (found[:, 2] * rate + 0.5))], axis=1)


class Model:
    """The evidence of all learned texts, the network and the calibration; or one score for all."""

    def __init__(self, share: float, evidence: np.ndarray | None = None, network: Network | None = None, rate: float = 0.0, line: np.ndarray | None = None):
        self.share, self.evidence, self.network, self.rate, self.line = share, evidence, network, rate, line

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(column), self.share)
        w = terms(*texts(column))
        z = measures(judged(self.network, w, inputs(w, self.evidence)), self.rate)
        return 1 / (1 + np.exp(-np.clip(z @ self.line[:-1] + self.line[-1], -700, 700)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> Model:
    """A model of the labels that are not held out."""
    known = durable(labelled(labels))
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = count.get(1, 0), count.get(0, 0)
    sample = sample_of(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), known)
    share = (toxic + 1) / (toxic + clean + 2)
    have = {r["y"] for r in sample.select("y").distinct().collect()}
    if have != {0, 1}:
        discard([known, sample])
        return Model(share)
    evidence = evidence_of(sample)
    rng = np.random.default_rng(seed)
    network = Network(rng)
    network.train(*training_windows(sample, evidence[:-1]), rng)
    flat = evidence[:-1].reshape(-1)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            w = terms(*texts(b.column(2)))
            z = judged(network, w, inputs(w, flat, np.repeat(b.column(1).to_numpy().astype(np.int64), np.diff(w.row_at))))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, z.T)], ["y", "a", "b", "c"])

    seen = sample.select("y", "fold", "text").mapInArrow(judge, "y int, a double, b double, c double").orderBy("y", "a", "b", "c").toArrow()
    y = seen.column("y").to_numpy().astype(float)
    found = np.stack([seen.column(c).to_numpy() for c in "abc"], axis=1)
    clean_sum = found[y == 0].sum(axis=0)
    rate = float(clean_sum[1] / clean_sum[2])
    line = fit(measures(found, rate), y)
    line[-1] += math.log(share / (1 - share)) - math.log((y.sum() + 1) / (len(y) - y.sum() + 1))  # as many as among all labels
    discard([known, sample])
    return Model(share, np.ascontiguousarray(evidence[-1]), network, rate, line)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the toxicity of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1)), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scored, "doc_id long, score double")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable] = {"op11_toxicity": op11_toxicity}
ORACLE: dict[str, str] = {}
