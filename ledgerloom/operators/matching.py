"""Tiered matching: it proposes and never decides (decided_by stays null)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as tx
from ..plans.domain import Domain, duck
from ..plans.shared import write_once


@dataclass(frozen=True)
class Options:
    days: int = 5
    similarity: float = 0.45
    tolerance: int = 0


def without(rows: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not in ``gone``.  An outer join, as an anti-join would be copied
    into every branch of a union below it, and the plan would grow with each step."""
    marked = gone.select(on, F.lit(True).alias("_gone")).distinct()
    return rows.join(marked, on, "left").where("_gone IS NULL").drop("_gone")


def exact_tier(txns: DataFrame, ledger: DataFrame, leases: DataFrame, o: Options = Options()) -> DataFrame:
    """Transactions with exactly one ledger entry of their building and amount within the
    window; confidence 1 where the check number stands in its note.  Days are part of the
    join's key: a building's usual amount meets itself only in neighbouring ranges of days."""
    g = ledger.join(leases.select("lease_id", "building_id"), "lease_id").select(F.col("building_id").alias("b"), F.col("amount").alias("a"), "entry_date", "ledger_id", "lease_id", "note", F.explode(dates.near_days(F.col("entry_date"), o.days)).alias("r"))
    j = txns.join(g, (txns.building_id == g.b) & (txns.amount == g.a) & (dates.day_range(F.col("posted_on"), o.days) == F.col("r")) & (F.abs(F.datediff("posted_on", "entry_date")) <= o.days))
    # one row for each transaction after the map-side step: a count and its only candidate
    one = j.groupBy("txn_id").agg(F.count("*").alias("n"), F.min(F.struct("ledger_id", "lease_id", F.coalesce(F.contains("note", F.col("check_no")), F.lit(False)).alias("check"))).alias("c"))
    return one.where("n = 1").select("txn_id", F.col("c.ledger_id").alias("ledger_id"), F.col("c.lease_id").alias("lease_id"), F.lit("exact").alias("method"), F.when(F.col("c.check"), 1.0).otherwise(0.95).alias("confidence"))


def fuzzy_tier(txns: DataFrame, leases: DataFrame, exact: DataFrame, o: Options = Options()) -> DataFrame:
    """The most similar tenant among leases of the building and amount; ties to the smaller lease."""
    t = without(txns, exact, "txn_id").select("txn_id", "building_id", "amount", tx.extract_payer(F.col("descriptor")).alias("payer")).where("payer <> ''").withColumn("x", tx.trigrams(F.col("payer")))
    le = leases.select(F.col("building_id").alias("b"), "deposit", "lease_id", tx.trigrams(F.col("tenant")).alias("y"))
    # Amounts are cut into bands of the tolerance's width; a lease stands in its own and both next ones.
    band = F.floor(F.col("deposit") / (o.tolerance + 1))
    near = le.withColumn("band", F.explode(F.array(*[band + i for i in (-1, 0, 1)]))) if o.tolerance else le.withColumn("band", band)
    same = (F.floor(F.abs("amount") / (o.tolerance + 1)) == F.col("band")) & (F.abs(F.abs("amount") - F.col("deposit")) <= o.tolerance)
    j = t.join(near, (t.building_id == near.b) & same).withColumn("score", tx.gram_similarity(F.col("x"), F.col("y"))).where(F.col("score") >= o.similarity)
    best = j.groupBy("txn_id").agg(F.max(F.struct("score", -F.col("lease_id"))).alias("m"))
    return best.select("txn_id", F.lit(None).cast("long").alias("ledger_id"), (-F.col("m.col2")).alias("lease_id"), F.lit("fuzzy").alias("method"), F.round("m.score", 3).alias("confidence"))


def propose(txns: DataFrame, ledger: DataFrame, leases: DataFrame, matched: DataFrame, o: Options = Options()) -> DataFrame:
    """Proposals for transactions that have none yet and a building."""
    todo = without(txns.where("building_id IS NOT NULL"), matched, "txn_id")
    exact = write_once(exact_tier(todo, ledger, leases, o))  # a tier of its own, and what the next one leaves out
    return exact.unionByName(fuzzy_tier(todo, leases, exact, o)).withColumn("decided_by", F.lit(None).cast("string"))


def unmatched(txns: DataFrame, matched: DataFrame, proposals: DataFrame) -> DataFrame:
    left = without(txns.where("building_id IS NOT NULL"), matched.select("txn_id").union(proposals.select("txn_id")), "txn_id")
    return left.select("txn_id", "building_id", "amount", F.lit("low").alias("severity"), F.concat(F.lit("unmatched:"), "txn_id").alias("signature"))


def run_rate(txns: DataFrame, matched: DataFrame, proposals: DataFrame, warn: float = 0.85, least: int = 20) -> DataFrame:
    """This run's automatic rate: proposals over considered, with its warning."""
    todo = without(txns.where("building_id IS NOT NULL"), matched, "txn_id")
    c = todo.join(proposals.select("txn_id", "method"), "txn_id", "left").agg(F.count("*").alias("considered"), F.count(F.when(F.col("method") == "exact", 1)).alias("exact"), F.count(F.when(F.col("method") == "fuzzy", 1)).alias("fuzzy"))
    rate = (F.col("exact") + F.col("fuzzy")) / F.greatest("considered", F.lit(1))
    return c.select("*", F.round(rate, 6).alias("rate"), ((rate > warn) & (F.col("considered") >= least)).alias("warning"))


def sanitized(suggestions: DataFrame, leases: DataFrame, least: float = 0.5) -> DataFrame:
    """Model suggestions (txn_id, lease_id, confidence): unknown leases and low confidence abstain."""
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0))))
    j = suggestions.join(leases.select("lease_id", F.lit(True).alias("known")), "lease_id", "left")
    return j.select("txn_id", F.when(F.col("known"), F.col("lease_id")).alias("lease_id"), c.alias("confidence")).where(F.col("lease_id").isNotNull() & (F.col("confidence") >= least)).withColumn("method", F.lit("model"))


def apply_decisions(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """decided_by set from (txn_id, actor) where it is still null."""
    j = matches.join(decisions.groupBy("txn_id").agg(F.min("actor").alias("actor")), "txn_id", "left")
    return j.select("txn_id", "lease_id", "method", F.coalesce("decided_by", "actor").alias("decided_by"))


def _few(d: Domain) -> DataFrame:
    return d.matches.where("txn_id % 5 = 0")


def _propose(spark, sf_dir):
    d = Domain(spark, sf_dir, prepared=True)
    return propose(d.txns, d.ledger, d.leases, _few(d))


def _unmatched(spark, sf_dir):
    d = Domain(spark, sf_dir, prepared=True)
    return unmatched(d.txns, _few(d), propose(d.txns, d.ledger, d.leases, _few(d)))


def _rate(spark, sf_dir):
    d = Domain(spark, sf_dir, prepared=True)
    return run_rate(d.txns, _few(d), propose(d.txns, d.ledger, d.leases, _few(d)))


def _model(spark, sf_dir):
    d = Domain(spark, sf_dir)
    s = d.txns.select("txn_id", F.when(F.col("txn_id") % 9 != 0, F.floor(F.col("txn_id") / 10)).otherwise(-1).cast("long").alias("lease_id"), F.when(F.col("txn_id") % 4 == 0, float("nan")).otherwise((F.col("txn_id") % 30) / 15.0 - 0.2).alias("confidence"))
    return sanitized(s, d.leases).withColumn("confidence", F.round("confidence", 6))


def _decide(spark, sf_dir):
    d = Domain(spark, sf_dir)
    return apply_decisions(d.matches, d.matches.where("txn_id % 6 = 0").select("txn_id", F.lit("lead").alias("actor")))


QUERIES = {"mat01_proposals": _propose, "mat03_unmatched": _unmatched, "mat04_run_rate": _rate, "mat05_model_suggestions": _model, "snk16_decisions": _decide}
_N, _PAY, _G = tx.sql_name, tx.sql_payer("descriptor"), tx.sql_trigrams
_TODO = "(SELECT t.* FROM {txns} t ANTI JOIN (SELECT txn_id FROM {matches} WHERE txn_id % 5 = 0) m USING (txn_id) WHERE building_id IS NOT NULL)"
_EXACT = f"(SELECT t.txn_id, min(g.ledger_id) AS ledger_id, min(g.lease_id) AS lease_id, 'exact' AS method, CASE WHEN bool_or(coalesce(contains(g.note, t.check_no), false)) THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence FROM {_TODO} t JOIN {{leases}} l ON l.building_id = t.building_id JOIN {{ledger}} g ON g.lease_id = l.lease_id AND g.amount = t.amount AND abs(g.entry_date - t.posted_on) <= 5 GROUP BY 1 HAVING count(*) = 1)"
_FUZZY = f"(SELECT txn_id, NULL::BIGINT AS ledger_id, lease_id, 'fuzzy' AS method, round(s, 3) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY s DESC, lease_id) AS n FROM (SELECT *, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS s FROM (SELECT txn_id, lease_id, {_G('p')} AS x, {_G('q')} AS y FROM (SELECT t.txn_id, l.lease_id, {_PAY} AS p, {_N('l.tenant')} AS q FROM {_TODO} t JOIN {{leases}} l ON l.building_id = t.building_id AND l.deposit = abs(t.amount) ANTI JOIN {_EXACT} e ON e.txn_id = t.txn_id) WHERE p <> '')) WHERE s >= 0.45) WHERE n = 1)"
_PROP = f"(SELECT * FROM {_EXACT} UNION ALL SELECT * FROM {_FUZZY})"
ORACLE = {k: duck(v) for k, v in {
    "mat01_proposals": f"SELECT *, NULL::VARCHAR AS decided_by FROM {_PROP}",
    "mat03_unmatched": f"SELECT txn_id, building_id, amount, 'low' AS severity, 'unmatched:' || txn_id AS signature FROM {_TODO} a ANTI JOIN {_PROP} p USING (txn_id)",
    "mat04_run_rate": f"SELECT *, round((exact + fuzzy) / greatest(considered, 1), 6) AS rate, (exact + fuzzy) / greatest(considered, 1) > 0.85 AND considered >= 20 AS warning FROM (SELECT (SELECT count(*) FROM {_TODO}) AS considered, count(*) FILTER (WHERE method = 'exact') AS exact, count(*) FILTER (WHERE method = 'fuzzy') AS fuzzy FROM {_PROP})",
    "mat05_model_suggestions": "SELECT txn_id, t.l AS lease_id, round(greatest(0, least(1, c)), 6)::DOUBLE AS confidence, 'model' AS method FROM (SELECT txn_id, CASE WHEN txn_id % 9 <> 0 THEN txn_id // 10 ELSE -1 END AS l, CASE WHEN txn_id % 4 = 0 THEN 0 ELSE (txn_id % 30) / 15.0::DOUBLE - 0.2::DOUBLE END AS c FROM {txns}) t WHERE c >= 0.5 AND l IN (SELECT lease_id FROM {leases})",
    "snk16_decisions": "SELECT txn_id, lease_id, method, coalesce(decided_by, CASE WHEN txn_id % 6 = 0 THEN 'lead' END) AS decided_by FROM {matches}",
}.items()}
