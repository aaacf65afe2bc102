"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once per document; the ledger holds the measurements and
one long whose bit i says that rule i failed.  A policy is a version, a mask of the
rules that reject, and nothing else: applying one is a bitwise AND, comparing many
never reads a text again, and an ablation (what would each rule alone, or all but
that rule, reject?) is a sum of bit tests over the ledger.

The ledger is a projection: no shuffle, no Python.  Repeated word windows are found
inside the row: a document first compares its number of distinct window hashes
with its number of windows, and only where they differ are the windows themselves
(the words, not their hashes) sorted and compared.

Edge cases: a null text measures like an empty one and fails ``min_words``; equal
rows give equal rows; very long texts stay in their row; an empty table gives an
empty ledger; extra columns are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

#: Fixed values of the contract: word separators and symbol characters.
SEPARATORS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"

#: (name, condition on the measurements that fails a document); bit i is rule i.
RULES: tuple[tuple[str, str], ...] = (
    ("min_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_density", "100 * n_symbols > 10 * n_words"),
    ("dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("word_length_low", "word_chars < 2 * n_words"),
    ("word_length_high", "word_chars > 15 * n_words"),
    ("capitals", "100 * n_capitals > 50 * word_chars"),
)
BASE_RULES = ("min_words", "repeated_windows")


def mask_of(names: tuple[str, ...] | list[str]) -> int:
    order = [n for n, _ in RULES]
    return sum(1 << order.index(n) for n in dict.fromkeys(names))


@dataclass(frozen=True)
class Policy:
    version: str
    mask: int


POLICIES = (
    Policy("base-1", mask_of(BASE_RULES)),
    Policy("strict-1", mask_of([*BASE_RULES, "symbol_density", "dup_lines", "word_length_low", "word_length_high"])),
    Policy("strict-2", mask_of([n for n, _ in RULES])),
)
DEFAULT_POLICY = POLICIES[2]


#: Bits of a packed window that hold its place; the rest hold its hash.
PLACE_BITS = 28


def _with_repeat_words(df: DataFrame) -> DataFrame:
    """Adds _repeat: words in windows of three that are found twice or more in the
    text, the first included.  Reads _w (words) and _n (their number).

    Windows are packed as (hash, place) longs and sorted; neighbours with equal hash
    bits are candidates, few in ordinary text.  Candidates are then compared as words.
    Every step is a column of its own, so that none is evaluated twice.
    """
    low = (1 << PLACE_BITS) - 1
    w = F.col("_w")

    def neighbours(column: str, equal: Callable, spot: Callable) -> Column:
        """Places of the neighbours of a sorted column that are equal: a pair of places
        travels as one long, as distinct longs are found by hashing."""
        c = F.col(column)
        pairs = F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.when(equal(a, b), F.shiftleft(spot(a), PLACE_BITS).bitwiseOR(spot(b))))
        return F.transform(F.array_compact(F.array_distinct(pairs)), lambda x: F.array(F.shiftright(x, PLACE_BITS), x.bitwiseAND(F.lit(low))))

    def packed(x: Column, i: Column) -> Column:
        return F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))

    def window(i: Column) -> Column:
        at = i.cast("int")
        return F.struct(F.concat_ws(" ", F.get(w, at), F.get(w, at + 1), F.get(w, at + 2)).alias("w"), i.alias("i"))

    df = df.select("*", F.when(F.col("_n") >= 4, F.sort_array(F.transform(F.slice(w, 1, F.greatest(F.col("_n") - 2, F.lit(0))), packed))).alias("_h"))
    df = df.select("*", neighbours("_h", lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS), lambda x: x.bitwiseAND(F.lit(low))).alias("_c"))
    df = df.select("*", F.when(F.size("_c") > 0, F.sort_array(F.transform(F.array_distinct(F.flatten("_c")), window))).alias("_e"))
    df = df.select("*", neighbours("_e", lambda a, b: a["w"] == b["w"], lambda x: x["i"]).alias("_q"))
    df = df.select("*", F.when(F.size("_q") > 0, F.sort_array(F.array_distinct(F.flatten("_q")))).alias("_p"))
    gaps = F.zip_with("_p", F.slice("_p", 2, F.size("_p")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return df.select("*", F.coalesce(F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, g: acc + g), F.lit(0)).cast("long").alias("_repeat"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the measurements and ``failed`` (a long, bit i: rule i) of every row."""
    names = [c for c in carry if c != id_col]
    raw = docs.select(F.col(id_col).alias("doc_id"), *names, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    bare = F.btrim("_t", F.lit(SEPARATORS))
    split = raw.select("*", bare.alias("_b"), F.split("_t", "\n").alias("_s"))
    split = split.select("*", F.when(F.col("_b") == "", F.array().cast("array<string>")).otherwise(F.split("_b", r"[\x20\x09-\x0D]+")).alias("_w"), F.filter("_s", lambda s: F.btrim(s, F.lit(SEPARATORS)) != "").alias("_l"))
    counted = split.select("*", F.size("_w").alias("_n"))
    measured = _with_repeat_words(counted).select(
        "doc_id",
        *names,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
    )
    bits = [F.when(F.expr(rule), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, (_, rule) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed)


def settled(rows: DataFrame) -> DataFrame:
    """The ledger behind a one-element explode, which filters are not moved through: the
    measurements are made once, not again inside every condition on them."""
    return rows.withColumn("failed", F.explode(F.array("failed")))


def apply_policy(rows: DataFrame, policy: Policy = DEFAULT_POLICY) -> DataFrame:
    """A ledger with base_failed and kept under the policy; no text is read."""
    base = F.col("failed").bitwiseAND(F.lit(mask_of(BASE_RULES))) != 0
    return rows.withColumns({"base_failed": base, "kept": ~base & (F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0), "policy": F.lit(policy.version)})


def ablations(rows: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """policy, rule, n_failed, n_only: documents that the rule fails, and that no other
    rule of the policy fails.  One aggregate over the ledger: a distinct mask is one row
    after the map-side step, so at most 2**rules rows are shuffled by a task."""
    masks = rows.groupBy("failed").agg(F.count("*").alias("n"))
    listed = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(p.mask).cast("long").alias("mask"), F.lit(n).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for p in policies for i, (n, _) in enumerate(RULES) if p.mask >> i & 1])
    x = masks.select("failed", "n", F.explode(listed).alias("x")).select("failed", "n", "x.*")
    hit = F.col("failed").bitwiseAND(F.col("bit")) != 0
    only = F.col("failed").bitwiseAND(F.col("mask")) == F.col("bit")
    return x.groupBy("policy", "rule").agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(only, F.col("n")).otherwise(0)).alias("n_only"))


CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed"]


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(table(spark, sf_dir, "documents"))).select(*CONTRACT)


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ablations(ledger(table(spark, sf_dir, "documents")))


_LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, t, l, len(w) AS n, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS g FROM w),
k AS (SELECT row_number() OVER () AS r, * FROM g),
u AS (SELECT r, unnest(g) AS x, unnest(range(1, n - 1)) AS i FROM k),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM u),
p AS (SELECT r, count(DISTINCT i + o) AS n_repeat FROM c, (SELECT unnest([0, 1, 2]) AS o) WHERE c >= 2 GROUP BY r),
m AS (SELECT doc_id, n AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, len(l) AS n_lines,
  length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS n_capitals
  FROM k LEFT JOIN p USING (r)),
f AS (SELECT *, (""" + " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(RULES)) + r""")::BIGINT AS failed FROM m)
"""
ORACLE: dict[str, str] = {
    "op10_quality_rules": _LEDGER_SQL + f"SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, (failed & {mask_of(BASE_RULES)}) <> 0 AS base_failed, (failed & {DEFAULT_POLICY.mask}) = 0 AS kept, failed FROM f",
    "quality_ablations": _LEDGER_SQL + " UNION ALL ".join(f"SELECT '{p.version}' AS policy, '{n}' AS rule, (count(*) FILTER (WHERE failed & {1 << i} <> 0))::BIGINT AS n_failed, (count(*) FILTER (WHERE failed & {p.mask} = {1 << i}))::BIGINT AS n_only FROM f" for p in POLICIES for i, (n, _) in enumerate(RULES) if p.mask >> i & 1),
}
QUERIES: dict[str, Callable] = {"op10_quality_rules": op10_quality_rules, "quality_ablations": quality_ablations}
