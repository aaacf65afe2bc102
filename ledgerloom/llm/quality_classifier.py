"""Quality by hierarchical empirical Bayes.

A document's own evidence is a logistic model over its surface (symbols, capitals,
word lengths, repetition, length).  Documents come from sites: a host and a path below
it.  A host's rate of good documents is shrunk toward the global rate, a path's toward
its host's, both with strengths found from the data: the variance between groups beyond
what the documents within them explain gives the prior's weight (method of moments for a
beta prior).  So a site with few documents stays near its parent and one with many
speaks for itself.  The table documents has no URL: the registered query takes source for
the host and lang for the path, so its second level has as many values as there are
languages; ``classify`` takes any SQL expressions, as of a URL.  A document's posterior adds its path's log-odds against the global
rate to its own evidence.

Sites are aggregates of three sums, combined before any shuffle, so a host that holds a
third of all rows is one row from each task.

Toxicity is a lexicon for each language, learned from that language's labels, and one
for all of them together.  Entries are whole words and stems (the first STEM letters of
words) that stand in LEAST_COUNT toxic documents, are LEAST_ODDS times as frequent among
toxic words as among clean ones, and pass a likelihood-ratio test held against the number
of candidates.  A stem may also stand in clean texts, above all in long ones; so a
logistic model weighs how many entries a document holds against its length.  A document
is toxic by its own language's lexicon or by the common one.

Model and lexicons are fitted on at most LABELLED rows of the labels (those of smallest
id hash), the only bound; every document is scored and counts for its site.

Edge cases: a null or empty text has the evidence of an empty one; null hosts and paths
form groups of their own; without labels of both kinds the model is the global rate;
rows that repeat are scored alike; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Words, durable, slices, table, texts

LABELLED = 5000
#: Toxic documents that hold an entry of a lexicon, and its frequency there against clean ones.
LEAST_COUNT, LEAST_ODDS = 4, 12.0
#: Lengths of a stem in letters, and the name of the lexicon of all languages.
STEM, ALL = (3, 16), "*"
FEATURES = ("symbols", "bars", "marks", "capitals", "word_length", "distinct", "log_words", "digits")
#: Everything but letters and bytes of other scripts ends a word of the lexicon.
LETTERS = r"[^\p{L}]+"


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, vectorised over the bytes of the batch."""
    data, at = texts(column)
    w = Words(data, at)
    size = np.diff(at)
    words = np.diff(w.row_at)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.append(0, np.cumsum(mask))
        return c[at[1:]] - c[at[:-1]]

    symbol = np.isin(data, np.frombuffer(b"#*$%&<>", np.uint8))
    chars = np.maximum(share(data > 32), 1)
    n = np.maximum(words, 1)
    row = w.rows()
    order = np.lexsort((w.hashes, row)) if len(w) else np.zeros(0, np.int64)
    new = np.ones(len(order), bool)
    h, r = (w.hashes[order], row[order]) if len(w) else (order, order)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    distinct = np.bincount(r[new], minlength=len(size)) if len(w) else np.zeros(len(size))
    return np.stack([share(symbol) / n, share(data == 124) / n, share(data == 33) / n, share((data >= 65) & (data <= 90)) / chars, chars / n / 10, distinct / n, np.log1p(words) / 10, share((data >= 48) & (data <= 57)) / chars], axis=1)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the intercept comes last."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    if 0 < y.sum() < len(y):
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            hess = (z.T * (p * (1 - p))) @ z + ridge * np.eye(len(w))
            w += np.linalg.solve(hess, z.T @ (y - p) - ridge * w)
    elif len(y):
        w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    return w


def hits(entries: list[str], text: F.Column) -> F.Column:
    """How many distinct words of a text are entries: stems, or whole words, which end in a blank."""
    stems, whole = [e for e in entries if e[-1] != " "], [e[:-1] for e in entries if e[-1] == " "]
    pattern = "|".join([e + r"\p{L}*+" for e in stems] + [e + r"(?!\p{L})" for e in whole])
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!\p{{L}})(?:{pattern})"), F.lit(0))))


def measures(count: F.Column, text: F.Column) -> list[F.Column]:
    return [F.log1p(count), F.log1p(F.length(text))]


def lexicons(sample: DataFrame, text_col: str) -> dict[str, tuple[list[str], list[float]]]:
    """Entries, and the weights of their measures, of each language that has any and of
    ALL; ``sample`` holds text, language and toxic.  Bounded as the sample is."""
    word = F.array_remove(F.array_distinct(F.split(F.lower(F.col(text_col)), LETTERS)), "")
    first, last = F.lit(STEM[0]), F.least(F.length("w"), F.lit(STEM[1]))
    stems = F.when(last >= first, F.transform(F.sequence(first, F.greatest(last, first)), lambda i: F.substring(F.col("w"), F.lit(1), i))).otherwise(F.array().cast("array<string>"))
    entries = F.explode(F.array_append(stems, F.concat("w", F.lit(" ")))).alias("entry")
    parts = sample.select(text_col, "toxic", F.explode(F.array("language", F.lit(ALL))).alias("language"), F.monotonically_increasing_id().alias("row"))
    words = parts.select("language", "toxic", "row", F.explode(word).alias("w"))
    total = {r["language"]: (r["t"], r["c"]) for r in words.groupBy("language").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect()}
    held = words.where("toxic = 1").select("language", "row", entries).distinct().groupBy("language", "entry").agg(F.count("*").alias("docs")).where(F.col("docs") >= LEAST_COUNT)
    held = durable(held)
    tests = {r["language"]: r["n"] for r in held.groupBy("language").agg(F.count("*").alias("n")).collect()}
    found = words.select("language", "toxic", entries).join(held.drop("docs"), ["language", "entry"], "left_semi").groupBy("language", "entry").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    share = F.lit(0.0)
    for language, (t, c) in total.items():
        share = F.when(F.col("language") == language, F.lit((t + 1) / (t + c + 2))).otherwise(share)
    found = found.withColumn("share", share)
    odds = (F.col("a") / F.col("share")) / ((F.col("b") + 0.5) / (1 - F.col("share")))
    all_of = F.col("a") + F.col("b")
    gain = F.col("a") * F.ln(F.col("a") / all_of / F.col("share")) + F.when(F.col("b") > 0, F.col("b") * F.ln(F.col("b") / all_of / (1 - F.col("share")))).otherwise(0.0)
    # 3: one candidate in e**3 = 20 lexicons passes by chance
    best: dict[str, list[tuple]] = {}
    for r in found.where(odds >= LEAST_ODDS).select("language", "entry", gain.alias("gain")).collect():
        if r["gain"] >= math.log(tests[r["language"]]) + 3:
            best.setdefault(r["language"], []).append((-r["gain"], -len(r["entry"]), r["entry"]))
    out = {}
    for language, ranked in sorted(best.items()):
        taken: list[str] = []
        for _, _, e in sorted(ranked):
            if not any(e.startswith(t) or t.startswith(e) for t in taken):
                taken.append(e)
        rows = parts.where(F.col("language") == language).select(F.array(*measures(hits(taken, F.col(text_col)), F.col(text_col))).alias("x"), F.col("toxic").cast("int").alias("y")).orderBy("y", "x").collect()
        out[language] = taken, fit(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float), 0.1).tolist()
    return out


def is_toxic(lexicon: tuple[list[str], list[float]], text: F.Column) -> F.Column:
    entries, weights = lexicon
    count = hits(entries, text)
    return (count > 0) & (sum((w * m for w, m in zip(weights, measures(count, text), strict=False)), F.lit(weights[-1])) >= 0)


def shrunk(groups: DataFrame, rate: str, parent: str) -> tuple[DataFrame, float]:
    """Adds ``rate``: (n, s, q: count, sum and sum of squares of the evidence) shrunk
    toward ``parent`` by the strength that the groups' own spread supports."""
    mean = F.col("s") / F.col("n")
    within = (F.col("q") / F.col("n") - mean * mean) / F.col("n")
    stat = groups.agg(F.count("*").alias("g"), F.avg(mean).alias("m"), F.avg((mean - F.col(parent)) * (mean - F.col(parent)) - within).alias("v")).first()
    m, v = stat["m"] or 0.5, stat["v"] or 0.0
    strength = min(max(m * (1 - m) / max(v, 1e-6) - 1, 1.0), 1e4)
    return groups.withColumn(rate, (F.col("s") + strength * F.col(parent)) / (F.col("n") + strength)), strength


def logit(p) -> F.Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text", language: str | None = None) -> DataFrame:
    """doc_id, evidence, host_rate, path_rate, quality (posterior), toxic, kept of every
    row; ``host``, ``path`` and ``language`` are SQL expressions over ``docs``, the last by
    default its column lang, where it has one."""
    language = language or ("lang" if "lang" in docs.columns else "''")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.expr(host).cast("string").alias("host"), F.expr(path).cast("string").alias("path"), F.coalesce(F.expr(language).cast("string"), F.lit("")).alias("language"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chosen = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("quality").alias("y"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    sample = durable(rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "language", "text", "y", "toxic"))  # LABELLED rows at most

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(features(b.column(0))), pa.list_(pa.float64()))], ["y", "x"])

    fitted = sample.select("text", F.col("y").cast("int").alias("y")).mapInArrow(measured, "y int, x array<double>").orderBy("y", "x").collect()
    x = np.array([r["x"] for r in fitted]).reshape(-1, len(FEATURES))
    weights = fit(x, np.array([r["y"] for r in fitted], float))
    toxic = F.lit(False)
    for name, lexicon in lexicons(sample, "text").items():
        own = is_toxic(lexicon, F.col("text"))
        toxic = toxic | (own if name == ALL else F.when(F.col("language") == name, own).otherwise(False))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 4 << 20):
            z = features(b.column(3)) @ weights[:-1] + weights[-1]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z), b.column(4)], ["doc_id", "host", "path", "evidence", "toxic"])

    scored = durable(rows.select("doc_id", "host", "path", "text", toxic.alias("toxic")).mapInArrow(score, "doc_id long, host string, path string, evidence double, toxic boolean"))
    p = 1 / (1 + F.exp(-F.col("evidence")))
    sums = [F.count("*").alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("q")]
    whole = scored.agg(F.avg(p).alias("m")).first()["m"]
    rate = float(whole) if whole is not None else 0.5
    paths = durable(scored.groupBy("host", "path").agg(*sums))
    hosts, _ = shrunk(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).withColumn("global", F.lit(rate)), "host_rate", "global")
    below = paths.alias("p").join(hosts.select(F.col("host").alias("h"), "host_rate"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    sites, _ = shrunk(below, "path_rate", "host_rate")
    sites = sites.select(F.col("host").alias("h"), F.col("path").alias("l"), "host_rate", "path_rate")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("l")))
    posterior = 1 / (1 + F.exp(-(F.col("evidence") + logit(F.col("path_rate")) - logit(F.lit(rate)))))
    return joined.select("doc_id", "evidence", "host_rate", "path_rate", posterior.alias("quality"), "toxic").withColumn("kept", (F.col("quality") >= 0.5) & ~F.col("toxic"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable] = {"op2_quality_classifier": op2_quality_classifier}
ORACLE: dict[str, str] = {}
