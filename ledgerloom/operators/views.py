"""Roll-ups: balances, latest statements, the tie-out, rates and custody summaries.

Every frame is aggregated before it is joined, so a join never multiplies rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.domain import AS_OF, Domain, duck


def lease_balance(leases: DataFrame, ledger: DataFrame) -> DataFrame:
    sums = ledger.groupBy("lease_id").agg(F.sum("amount").alias("s"))
    return leases.join(sums, "lease_id", "left").select("lease_id", "building_id", F.coalesce("s", F.lit(0)).cast("long").alias("balance"))


def latest_statement(statements: DataFrame) -> DataFrame:
    """The latest statement of each building; of equals the larger id. One pass, no sort."""
    top = statements.groupBy("building_id").agg(F.max(F.struct("period_end", "statement_id", "closing", "checksum_ok")).alias("t"))
    return top.select("building_id", F.col("t.statement_id").alias("statement_id"), F.col("t.period_end").alias("period_end"), F.col("t.closing").alias("closing"), F.col("t.checksum_ok").alias("checksum_ok"))


def building_tieout(buildings: DataFrame, leases: DataFrame, ledger: DataFrame, statements: DataFrame) -> DataFrame:
    """Bank against ledger and against the deposits expected of current leases, by building."""
    books = ledger.groupBy("lease_id").agg(F.sum("amount").alias("s")).join(leases.select("lease_id", "building_id"), "lease_id").groupBy("building_id").agg(F.sum("s").alias("ledger_total"))
    expected = leases.groupBy("building_id").agg(F.sum(F.when(F.col("vacated_on").isNull(), F.col("deposit"))).alias("expected_total"))
    bank = latest_statement(statements).select("building_id", F.col("closing").alias("bank_total"), "period_end")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return buildings.join(bank, "building_id", "left").join(books, "building_id", "left").join(expected, "building_id", "left").select(
        "building_id", "name", "period_end", "bank_total", zero("ledger_total").alias("ledger_total"), zero("expected_total").alias("expected_total"),
        (F.col("bank_total") - zero("ledger_total")).alias("ledger_variance"), (F.col("bank_total") - zero("expected_total")).alias("expected_variance"),
    )


def portfolio_totals(tieout: DataFrame) -> DataFrame:
    """Sums over buildings with a statement; the variance is bank less expected."""
    t = tieout.where("bank_total IS NOT NULL")
    return t.agg(F.count("*").alias("buildings"), F.sum("bank_total").alias("bank"), F.sum("expected_total").alias("expected"), F.sum("expected_variance").alias("variance"))


def match_rate(txns: DataFrame, matches: DataFrame) -> DataFrame:
    m = matches.select("txn_id", "decided_by", F.lit(1).alias("hit"))
    j = txns.select("txn_id").join(m, "txn_id", "left")
    return j.agg(F.count("*").alias("transactions"), F.count("hit").alias("matched"), F.count(F.when(F.col("hit").isNotNull() & F.col("decided_by").isNull(), 1)).alias("pending"), F.count("decided_by").alias("approved")).withColumn("rate", F.round(F.col("matched") / F.greatest("transactions", F.lit(1)), 6))


def quarantine(statements: DataFrame) -> DataFrame:
    """Statements whose checksum is not true, null included."""
    return statements.where(~F.col("checksum_ok").eqNullSafe(True)).select("statement_id", "building_id", "period_start", "period_end")


def master_aging(custody: DataFrame, as_of: Column) -> DataFrame:
    since = F.coalesce("cleared_on", "sent_on")
    return custody.where("in_master > 0").select("custody_id", "building_id", "in_master", since.alias("since"), F.datediff(as_of, since).alias("days"))


def custody_summary(custody: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    old = F.datediff(as_of, F.coalesce("cleared_on", "sent_on")) > days
    return custody.groupBy("building_id").agg(
        F.count("*").alias("deposits"), F.sum("amount").alias("received"), F.sum("in_master").alias("in_master"),
        F.sum(F.when(F.nullif(F.col("sub_last4"), F.lit("")).isNotNull(), F.col("amount")).otherwise(0)).alias("in_subaccounts"),
        F.count(F.when((F.col("in_master") > 0) & old, 1)).alias("aged"),
        F.count(F.when(F.col("returned_on").isNotNull() & F.col("refunded_on").isNull(), 1)).alias("returned_unrefunded"),
    )


def balance_recon(custody: DataFrame) -> DataFrame:
    return custody.where("bank_balance IS NOT NULL AND books_balance IS NOT NULL").select("custody_id", "building_id", "bank_balance", "books_balance", (F.col("bank_balance") - F.col("books_balance")).alias("variance"))


#: Stages in which a deposit no longer counts as held in a subaccount.
LEAVING = ("bank_closing", "funds_returned", "posted", "refunded", "closed")


def custody_totals(custody: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """The portfolio header: subaccount money by number or opening day, leaving stages apart."""
    has_sub = F.nullif(F.col("sub_last4"), F.lit("")).isNotNull() | F.col("sub_opened_on").isNotNull()
    held = has_sub & ~F.col("stage").isin(*LEAVING)
    age = F.datediff(as_of, F.coalesce("cleared_on", "sent_on"))
    pooled = F.col("in_master") > 0
    return custody.agg(
        F.count("*").alias("deposits"), F.countDistinct("building_id").alias("buildings"), F.sum("amount").alias("received"), F.sum("in_master").alias("master"),
        F.sum(F.when(held, F.greatest(F.col("amount") - F.col("in_master"), F.lit(0))).otherwise(0)).alias("subaccounts"),
        F.count(F.when(pooled & (age > days), 1)).alias("aged"), F.sum(F.when(pooled & (age > days), F.col("in_master")).otherwise(0)).alias("aged_amount"), F.max(F.when(pooled, age)).alias("oldest"),
    )


def balance_totals(custody: DataFrame) -> DataFrame:
    both = F.col("bank_balance").isNotNull() & F.col("books_balance").isNotNull()
    either = F.col("bank_balance").isNotNull() | F.col("books_balance").isNotNull()
    return custody.agg(F.sum("bank_balance").alias("bank"), F.sum("books_balance").alias("books"), F.sum(F.when(both, F.col("bank_balance") - F.col("books_balance"))).alias("variance"), F.count(F.when(both, 1)).alias("compared"), F.count(F.when(either & ~both, 1)).alias("pending"))


def master_against_bank(custody: DataFrame, bank_total: Column) -> DataFrame:
    return custody.agg(F.sum("in_master").alias("custody_master")).select("custody_master", bank_total.cast("long").alias("bank_master"), (bank_total - F.col("custody_master")).cast("long").alias("variance"))


def continuity(statements: DataFrame, key: str = "building_id") -> DataFrame:
    """Breaks between consecutive statements: a calendar gap, a balance break, or both."""
    w = Window.partitionBy(key).orderBy("period_start", "period_end", "statement_id")
    s = statements.select(key, "period_start", "opening", F.lag("period_end").over(w).alias("prior_end"), F.lag("closing").over(w).alias("prior_closing"))
    gap = F.when(F.col("period_start") != F.date_add("prior_end", 1), F.struct(F.lit("calendar_gap").alias("kind"), F.lit(None).cast("long").alias("amount")))
    off = F.when(F.col("opening") != F.col("prior_closing"), F.struct(F.lit("balance_break").alias("kind"), (F.col("opening") - F.col("prior_closing")).alias("amount")))
    return s.where("prior_end IS NOT NULL").select(key, "prior_end", "period_start", F.explode(F.array_compact(F.array(gap, off))).alias("b")).select(key, "prior_end", "period_start", "b.kind", "b.amount")


def _day() -> Column:
    return F.lit(AS_OF).cast("date")


def _q(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir))


QUERIES = {
    "vw01_lease_balance": _q(lambda d: lease_balance(d.leases, d.ledger)),
    "vw02_latest_statement": _q(lambda d: latest_statement(d.statements)),
    "vw03_building_tieout": _q(lambda d: building_tieout(d.buildings, d.leases, d.ledger, d.statements)),
    "vw05_match_rate": _q(lambda d: match_rate(d.txns, d.matches)),
    "vw06_quarantine": _q(lambda d: quarantine(d.statements)),
    "vw07_master_aging": _q(lambda d: master_aging(d.custody, _day())),
    "vw08_custody_summary": _q(lambda d: custody_summary(d.custody, _day())),
    "vw09_balance_recon": _q(lambda d: balance_recon(d.custody)),
    "agg07_portfolio_totals": _q(lambda d: portfolio_totals(building_tieout(d.buildings, d.leases, d.ledger, d.statements))),
    "agg08_custody_totals": _q(lambda d: custody_totals(d.custody, _day())),
    "agg09_balance_totals": _q(lambda d: balance_totals(d.custody)),
    "agg10_master_against_bank": _q(lambda d: master_against_bank(d.custody, F.lit(1_000_000_000))),
    "win01_continuity": _q(lambda d: continuity(d.statements)),
}
_TIE = """SELECT b.building_id, b.name, s.period_end, s.closing AS bank_total, coalesce(l.t, 0)::BIGINT AS ledger_total, coalesce(e.t, 0)::BIGINT AS expected_total,
 (s.closing - coalesce(l.t, 0))::BIGINT AS ledger_variance, (s.closing - coalesce(e.t, 0))::BIGINT AS expected_variance FROM {buildings} b
 LEFT JOIN (SELECT DISTINCT ON (building_id) * FROM {statements} ORDER BY building_id, period_end DESC, statement_id DESC) s ON s.building_id = b.building_id
 LEFT JOIN (SELECT building_id, sum(amount) AS t FROM {ledger} JOIN {leases} USING (lease_id) GROUP BY 1) l ON l.building_id = b.building_id
 LEFT JOIN (SELECT building_id, sum(deposit) FILTER (WHERE vacated_on IS NULL) AS t FROM {leases} GROUP BY 1) e ON e.building_id = b.building_id"""
_D = f"DATE '{AS_OF}'"
ORACLE = {k: duck(v) for k, v in {
    "vw01_lease_balance": "SELECT lease_id, building_id, coalesce(sum(amount), 0)::BIGINT AS balance FROM {leases} LEFT JOIN {ledger} USING (lease_id) GROUP BY 1, 2",
    "vw02_latest_statement": "SELECT building_id, statement_id, period_end, closing, checksum_ok FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY period_end DESC, statement_id DESC) AS n FROM {statements}) WHERE n = 1",
    "vw03_building_tieout": _TIE,
    "vw05_match_rate": "SELECT count(*) AS transactions, count(m.txn_id) AS matched, count(m.txn_id) FILTER (WHERE decided_by IS NULL) AS pending, count(decided_by) AS approved, round(count(m.txn_id) / greatest(count(*), 1), 6) AS rate FROM {txns} t LEFT JOIN {matches} m USING (txn_id)",
    "vw06_quarantine": "SELECT statement_id, building_id, period_start, period_end FROM {statements} WHERE checksum_ok IS NOT TRUE",
    "vw07_master_aging": f"SELECT custody_id, building_id, in_master, coalesce(cleared_on, sent_on) AS since, ({_D} - coalesce(cleared_on, sent_on))::INT AS days FROM {{custody}} WHERE in_master > 0",
    "vw08_custody_summary": f"SELECT building_id, count(*) AS deposits, sum(amount)::BIGINT AS received, sum(in_master)::BIGINT AS in_master, coalesce(sum(amount) FILTER (WHERE sub_last4 <> ''), 0)::BIGINT AS in_subaccounts, count(*) FILTER (WHERE in_master > 0 AND {_D} - coalesce(cleared_on, sent_on) > 30) AS aged, count(*) FILTER (WHERE returned_on IS NOT NULL AND refunded_on IS NULL) AS returned_unrefunded FROM {{custody}} GROUP BY 1",
    "vw09_balance_recon": "SELECT custody_id, building_id, bank_balance, books_balance, bank_balance - books_balance AS variance FROM {custody} WHERE bank_balance - books_balance IS NOT NULL",
    "agg07_portfolio_totals": f"SELECT count(*) AS buildings, sum(bank_total)::BIGINT AS bank, sum(expected_total)::BIGINT AS expected, (sum(bank_total) - sum(expected_total))::BIGINT AS variance FROM ({_TIE}) WHERE bank_total IS NOT NULL",
    "agg08_custody_totals": f"SELECT count(*) AS deposits, count(DISTINCT building_id) AS buildings, sum(amount)::BIGINT AS received, sum(in_master)::BIGINT AS master, coalesce(sum(greatest(amount - in_master, 0)) FILTER (WHERE (coalesce(sub_last4, '') <> '' OR sub_opened_on IS NOT NULL) AND stage NOT IN {LEAVING}), 0)::BIGINT AS subaccounts, count(*) FILTER (WHERE in_master > 0 AND {_D} - coalesce(cleared_on, sent_on) > 30) AS aged, coalesce(sum(in_master) FILTER (WHERE {_D} - coalesce(cleared_on, sent_on) > 30), 0)::BIGINT AS aged_amount, (max({_D} - coalesce(cleared_on, sent_on)) FILTER (WHERE in_master > 0))::INT AS oldest FROM {{custody}}",
    "agg09_balance_totals": "SELECT sum(bank_balance)::BIGINT AS bank, sum(books_balance)::BIGINT AS books, sum(bank_balance - books_balance)::BIGINT AS variance, count(bank_balance - books_balance) AS compared, count(coalesce(bank_balance, books_balance)) - count(bank_balance - books_balance) AS pending FROM {custody}",
    "agg10_master_against_bank": "SELECT sum(in_master)::BIGINT AS custody_master, 1000000000::BIGINT AS bank_master, (1000000000 - sum(in_master))::BIGINT AS variance FROM {custody}",
    "win01_continuity": """WITH o AS (SELECT a.building_id, a.period_end AS prior_end, a.closing AS c, b.period_start, b.opening, row_number() OVER (PARTITION BY b.statement_id ORDER BY a.period_start DESC) AS n FROM {statements} a JOIN {statements} b ON a.building_id = b.building_id AND a.period_start < b.period_start)
      SELECT building_id, prior_end, period_start, 'calendar_gap' AS kind, NULL::BIGINT AS amount FROM o WHERE n = 1 AND period_start <> prior_end + 1 UNION ALL SELECT building_id, prior_end, period_start, 'balance_break', opening - c FROM o WHERE n = 1 AND opening <> c""",
}.items()}
