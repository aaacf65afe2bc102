"""Gates: nothing lands that does not prove to the cent; failures are kept whole with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.domain import Domain, duck


def checksum(statements: DataFrame, txns: DataFrame, key: str = "statement_id") -> DataFrame:
    """opening + credits + debits - closing of every statement; ok if it is 0."""
    t = txns.groupBy(key).agg(F.sum(F.when(F.col("amount") > 0, F.col("amount")).otherwise(0)).alias("credits"), F.sum(F.when(F.col("amount") < 0, F.col("amount")).otherwise(0)).alias("debits"), F.count("*").alias("n"))
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return statements.join(t, key, "left").select(key, "opening", "closing", z("credits").alias("credits"), z("debits").alias("debits"), z("n").alias("n"), (F.col("opening") + z("credits") + z("debits") - F.col("closing")).alias("delta")).withColumn("ok", F.col("delta") == 0)


def diagnose(checked: DataFrame, txns: DataFrame, key: str = "statement_id") -> DataFrame:
    """Hints for failing statements: a transaction of the delta's size (missed or counted
    twice) or half of it (a sign turned), whole dollars, the closing itself, no transactions."""
    bad = checked.where("NOT ok")
    d = F.abs("delta")
    j = bad.join(txns.select(key, "txn_id", "amount"), key).select(key, F.explode(F.array_compact(F.array(F.when(F.abs("amount") == d, F.concat(F.lit("missed_or_twice:"), "txn_id")), F.when(2 * F.abs("amount") == d, F.concat(F.lit("sign:"), "txn_id"))))).alias("hint"))
    whole = bad.select(key, F.explode(F.array_compact(F.array(F.when(d % 100 == 0, F.lit("whole_dollars")), F.when(d == F.col("closing"), F.lit("closing_misread")), F.when(F.col("n") == 0, F.lit("no_transactions"))))).alias("hint"))
    return j.union(whole)


def ingest_decision(docs: DataFrame) -> DataFrame:
    """One decision for each document, in this order: duplicate, scan without text, unknown or
    ambiguous layout, parse failure, other account, checksum, posted.
    Reads seen, scanned, n_parsers, parsed, account_last4, expected_last4, delta."""
    said = lambda status, reason=None: F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))
    d = (
        F.when(F.col("seen"), said("duplicate", "content seen before"))
        .when(F.col("scanned"), said("quarantined", "no text layer"))
        .when(F.col("n_parsers") == 0, said("errored", "no layout matches"))
        .when(F.col("n_parsers") > 1, said("errored", "layouts are ambiguous"))
        .when(~F.col("parsed"), said("errored", "parse failed"))
        .when(F.col("account_last4").isNotNull() & ~F.col("account_last4").eqNullSafe(F.col("expected_last4")), said("quarantined", "another account"))
        .when(F.col("delta") != 0, said("quarantined", "checksum"))
        .otherwise(said("posted"))
    )
    return docs.withColumn("_d", d).select("*", F.col("_d.status").alias("status"), F.col("_d.reason").alias("reason")).drop("_d")


def csv_anchor(batches: DataFrame, statements: DataFrame, key: str = "building_id") -> DataFrame:
    """Opening of a CSV batch (key, batch_id, period_start, net, seed): the closing of the
    latest passing statement before it, if that ends the day before; else a seed; else none.
    The backward as-of lookup is one window over both, so a key is read once and in order."""
    s = statements.where("checksum_ok").select(key, F.col("period_end").alias("at"), F.struct("period_end", "closing").alias("prior"), F.lit(None).cast("long").alias("batch_id"), F.lit(None).cast("date").alias("period_start"), F.lit(None).cast("long").alias("net"), F.lit(None).cast("long").alias("seed"))
    b = batches.select(key, F.date_sub("period_start", 1).alias("at"), F.lit(None).cast("struct<period_end:date,closing:bigint>").alias("prior"), "batch_id", "period_start", "net", "seed")
    w = Window.partitionBy(key).orderBy("at", F.col("batch_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    j = s.unionByName(b).withColumn("p", F.last("prior", ignorenulls=True).over(w)).where("batch_id IS NOT NULL")
    meets = F.date_add(F.col("p.period_end"), 1) == F.col("period_start")
    opening = F.when(F.col("p").isNotNull(), F.when(meets, F.col("p.closing"))).otherwise(F.col("seed"))
    status = F.when(F.col("p").isNotNull() & ~meets, "quarantined_gap").when(F.col("p").isNull() & F.col("seed").isNull(), "quarantined_no_anchor").otherwise("posted")
    return j.select(key, "batch_id", "period_start", status.alias("status"), opening.alias("opening"), (opening + F.col("net")).alias("closing"))


#: Journal statuses that end a file.
SUCCESS = ("posted", "duplicate")


def last_outcome(journal: DataFrame) -> DataFrame:
    """The last journal line of each path; torn lines (null status) are skipped."""
    return journal.where("status IS NOT NULL").groupBy("path").agg(F.max_by("status", "ordinal").alias("status"), F.max("ordinal").alias("ordinal"))


def backfill_plan(files: DataFrame, journal: DataFrame, routes: DataFrame, retry: bool = False, success: tuple[str, ...] = SUCCESS) -> DataFrame:
    """What a backfill does with each file (path, dir): skip, error or ingest."""
    j = files.join(last_outcome(journal).withColumnRenamed("status", "last"), "path", "left").join(routes, "dir", "left")
    action = F.when(F.col("last").isin(*success), "skip_done").when(F.col("last").isNotNull() & F.lit(not retry), "skip_seen").when(F.col("account_id").isNull(), "error_unroutable").otherwise("ingest")
    return j.select("path", "dir", "last", "account_id", action.alias("action"))


def checksum_input(d: Domain) -> tuple[DataFrame, DataFrame]:
    sid: Column = F.col("building_id") * 100000 + F.year("posted_on") * 12 + F.month("posted_on")
    return d.statements, d.txns.withColumn("statement_id", sid.cast("long"))


def _check(spark, sf_dir):
    return checksum(*checksum_input(Domain(spark, sf_dir)))


def _hints(spark, sf_dir):
    s, t = checksum_input(Domain(spark, sf_dir))
    return diagnose(checksum(s.withColumn("closing", F.when(F.col("statement_id") % 19 == 0, F.col("opening")).otherwise(F.col("closing"))), t), t)


def _anchor(spark, sf_dir):
    d = Domain(spark, sf_dir)
    b = d.statements.select("building_id", (F.col("statement_id") + 1).alias("batch_id"), F.date_add("period_end", 1).alias("period_start"), F.lit(500).cast("long").alias("net"), F.lit(None).cast("long").alias("seed"))
    early = d.buildings.select("building_id", F.col("building_id").alias("batch_id"), F.lit("1990-01-01").cast("date").alias("period_start"), F.lit(7).cast("long").alias("net"), F.when(F.col("building_id") % 2 == 0, F.lit(1000).cast("long")).alias("seed"))
    return csv_anchor(b.union(early), d.statements)


def _backfill(spark, sf_dir):
    d = Domain(spark, sf_dir)
    files = d.customer.select(F.col("c_custkey").alias("path"), F.col("c_nationkey").alias("dir"))
    j = d.journal.withColumn("status", F.when(F.col("status") == "purchase", "posted").otherwise(F.col("status")))
    return backfill_plan(files, j, d.accounts.where("building_id % 4 <> 0").groupBy(F.col("building_id").alias("dir")).agg(F.min("account_id").alias("account_id")))


def _decision(spark, sf_dir):
    d = Domain(spark, sf_dir)
    s, t = checksum_input(d)
    i = F.col("statement_id")
    return ingest_decision(checksum(s, t).select(i, (i % 11 == 0).alias("seen"), (i % 13 == 0).alias("scanned"), (F.when(i % 17 == 0, 0).when(i % 19 == 0, 2).otherwise(1)).alias("n_parsers"), (i % 23 != 0).alias("parsed"), F.when(i % 3 == 0, (i % 5).cast("string")).alias("account_last4"), F.when(i % 9 == 0, (i % 7).cast("string")).otherwise((i % 5).cast("string")).alias("expected_last4"), "delta")).select("statement_id", "status", "reason")


QUERIES = {"gate01_checksum": _check, "gate02_diagnose": _hints, "gate03_ingest_decision": _decision, "gate04_csv_anchor": _anchor, "gate05_backfill_plan": _backfill, "win05_journal": lambda spark, sf_dir: last_outcome(Domain(spark, sf_dir).journal)}
_T = "(SELECT *, building_id * 100000 + year(posted_on) * 12 + month(posted_on) AS statement_id FROM {txns})"
_CK = lambda closing: f"(SELECT s.statement_id, s.opening, {closing} AS closing, coalesce(sum(amount) FILTER (WHERE amount > 0), 0)::BIGINT AS credits, coalesce(sum(amount) FILTER (WHERE amount < 0), 0)::BIGINT AS debits, count(t.txn_id) AS n, (s.opening + coalesce(sum(amount), 0) - {closing})::BIGINT AS delta FROM {{statements}} s LEFT JOIN {_T} t USING (statement_id) GROUP BY s.statement_id, s.opening, s.closing)"
_BAD = f"(SELECT * FROM {_CK('CASE WHEN s.statement_id % 19 = 0 THEN s.opening ELSE s.closing END')} WHERE delta <> 0)"
ORACLE = {k: duck(v) for k, v in {
    "gate01_checksum": f"SELECT *, delta = 0 AS ok FROM {_CK('s.closing')}",
    "gate02_diagnose": f"SELECT statement_id, 'missed_or_twice:' || txn_id AS hint FROM {_BAD} JOIN {_T} USING (statement_id) WHERE abs(amount) = abs(delta) UNION ALL SELECT statement_id, 'sign:' || txn_id FROM {_BAD} JOIN {_T} USING (statement_id) WHERE 2 * abs(amount) = abs(delta) UNION ALL SELECT statement_id, 'whole_dollars' FROM {_BAD} WHERE delta % 100 = 0 UNION ALL SELECT statement_id, 'closing_misread' FROM {_BAD} WHERE abs(delta) = closing UNION ALL SELECT statement_id, 'no_transactions' FROM {_BAD} WHERE n = 0",
    "gate03_ingest_decision": f"SELECT statement_id, split_part(x, '|', 1) AS status, nullif(split_part(x, '|', 2), '') AS reason FROM (SELECT statement_id, CASE WHEN statement_id % 11 = 0 THEN 'duplicate|content seen before' WHEN statement_id % 13 = 0 THEN 'quarantined|no text layer' WHEN statement_id % 17 = 0 THEN 'errored|no layout matches' WHEN statement_id % 19 = 0 THEN 'errored|layouts are ambiguous' WHEN statement_id % 23 = 0 THEN 'errored|parse failed' WHEN statement_id % 9 = 0 AND statement_id % 5 <> statement_id % 7 THEN 'quarantined|another account' WHEN delta <> 0 THEN 'quarantined|checksum' ELSE 'posted|' END AS x FROM {_CK('s.closing')})",
    "gate04_csv_anchor": "WITH b AS (SELECT building_id, statement_id + 1 AS batch_id, period_end + 1 AS period_start, 500 AS net, NULL::BIGINT AS seed FROM {statements} UNION ALL SELECT building_id, building_id, DATE '1990-01-01', 7, CASE WHEN building_id % 2 = 0 THEN 1000 END FROM {buildings}), p AS (SELECT b.*, s.period_end, s.closing AS c FROM b ASOF LEFT JOIN (SELECT * FROM {statements} WHERE checksum_ok) s ON b.building_id = s.building_id AND b.period_start > s.period_end) SELECT building_id, batch_id, period_start, CASE WHEN period_end + 1 <> period_start THEN 'quarantined_gap' WHEN period_end IS NULL AND seed IS NULL THEN 'quarantined_no_anchor' ELSE 'posted' END AS status, CASE WHEN period_end IS NULL THEN seed WHEN period_end + 1 = period_start THEN c END::BIGINT AS opening, (CASE WHEN period_end IS NULL THEN seed WHEN period_end + 1 = period_start THEN c END + net)::BIGINT AS closing FROM p",
    "gate05_backfill_plan": "SELECT c_custkey AS path, c_nationkey AS dir, j.status AS last, a.account_id, CASE WHEN j.status = 'posted' THEN 'skip_done' WHEN j.status IS NOT NULL THEN 'skip_seen' WHEN a.account_id IS NULL THEN 'error_unroutable' ELSE 'ingest' END AS action FROM {customer} LEFT JOIN (SELECT path, arg_max(CASE WHEN status = 'purchase' THEN 'posted' ELSE status END, ordinal) AS status FROM {journal} GROUP BY 1) j ON j.path = c_custkey LEFT JOIN (SELECT building_id, min(account_id) AS account_id FROM {accounts} WHERE building_id % 4 <> 0 GROUP BY 1) a ON a.building_id = c_nationkey",
    "win05_journal": "SELECT path, arg_max(status, ordinal) AS status, max(ordinal) AS ordinal FROM {journal} GROUP BY 1",
}.items()}
