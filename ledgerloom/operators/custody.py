"""Custody lifecycle detectors: projections with conditions, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.domain import AS_OF, Domain, duck
from .detectors import as_json

#: Days after which a state is late.
FLOAT_DAYS, BANK_DAYS, SUB_DAYS, ALLOCATE_DAYS, REFUND_DAYS, VACATED_DAYS = 30, 5, 30, 30, 14, 45
#: Stages in which a vacated deposit should have been closed.
OPEN_STAGES = ("in_subaccount", "active", "subaccount_pending")


def custody_key() -> Column:
    """The trimmed external reference, else building|unit|tenant|kind|received."""
    natural = F.concat_ws("|", F.col("building_id").cast("string"), "unit", "tenant", "kind", F.coalesce(F.col("received_on").cast("string"), F.lit("?")))
    return F.coalesce(F.nullif(F.btrim("external_ref"), F.lit("")), natural)


def has_sub() -> Column:
    return F.nullif(F.col("sub_last4"), F.lit("")).isNotNull() | F.col("sub_opened_on").isNotNull()


def _finding(kind: str, where: Column, severity: Column | str, amount: str | Column = "amount", **detail: str | Column) -> Column:
    """A row's finding as a struct, null where the condition does not hold."""
    return F.when(where, F.struct("custody_id", F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), "building_id", (F.col(amount) if isinstance(amount, str) else amount).cast("long").alias("amount"), F.concat(F.lit(f"{kind}:"), custody_key()).alias("signature"), as_json({"unit": "unit", "tenant": "tenant"} | detail).alias("detail")))


def rules(as_of: Column) -> dict[str, Column]:
    age = lambda d: F.datediff(as_of, d)
    since = F.coalesce("cleared_on", "sent_on")
    pooled, held = age(since), age(F.coalesce("sub_opened_on", "cleared_on", "sent_on"))
    all_rules = (
        ("funds_returned_not_refunded", F.expr("returned_on IS NOT NULL AND refunded_on IS NULL"), F.when(age("returned_on") > REFUND_DAYS, "critical").otherwise("high"), F.coalesce("returned_amount", "amount"), dict(funds_returned_on="returned_on", days_since_return=age("returned_on"), stage="stage")),
        ("master_account_float", (F.col("in_master") > 0) & (pooled > FLOAT_DAYS), F.when(pooled > 3 * FLOAT_DAYS, "critical").otherwise("high"), "in_master", dict(since=since, days_in_master=pooled, threshold_days=F.lit(FLOAT_DAYS))),
        ("deposit_not_sent_to_bank", F.col("sent_on").isNull() & (age("received_on") > BANK_DAYS), "high", "amount", dict(received_on="received_on", days_held=age("received_on"), stage="stage")),
        ("subaccount_not_opened", ~has_sub() & (age("cleared_on") > SUB_DAYS), "high", "amount", dict(bank_cleared_on="cleared_on", days_since_cleared=age("cleared_on"), stage="stage")),
        ("allocation_pending", (F.col("in_master") > 0) & has_sub() & (held.isNull() | (held > ALLOCATE_DAYS)), "medium", "in_master", dict(subaccount_last4="sub_last4", subaccount_opened_on="sub_opened_on", days_pending=held)),
        ("vacated_subaccount_open", F.col("refunded_on").isNull() & F.col("bank_closed_on").isNull() & F.col("stage").isin(*OPEN_STAGES) & (age("vacate_on") > VACATED_DAYS), "medium", "amount", dict(vacate_date="vacate_on", days_since_vacate=age("vacate_on"), stage="stage")),
    )
    return {kind: _finding(kind, where, severity, amount, **detail) for kind, where, severity, amount, detail in all_rules}


def findings(custody: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    return {kind: custody.select(F.inline(F.array_compact(F.array(rule)))) for kind, rule in rules(as_of).items()}


def all_findings(custody: DataFrame, as_of: Column) -> DataFrame:
    """The findings of all rules in one pass over the table."""
    return custody.select(F.inline(F.array_compact(F.array(*rules(as_of).values()))))


def first_by_signature(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """One finding of each signature, those already stored left out."""
    top = rows.groupBy("signature").agg(F.min(F.struct("kind", "severity", "building_id", "amount", "custody_id", "detail")).alias("t")).select("signature", "t.*")
    return top if seen is None else top.join(seen.select("signature"), "signature", "left_anti")


_D = f"DATE '{AS_OF}'"
_KEY = "coalesce(nullif(trim(external_ref), ''), building_id || '|' || unit || '|' || tenant || '|' || kind || '|' || coalesce(received_on::VARCHAR, '?'))"
_SUB = "(coalesce(sub_last4, '') <> '' OR sub_opened_on IS NOT NULL)"


def _f(kind: str, severity: str, where: str, amount: str = "amount", **detail: str) -> str:
    fields = ", ".join(f"'{k}', {v}" for k, v in ({"unit": "unit", "tenant": "tenant"} | detail).items())
    return f"SELECT custody_id, '{kind}' AS kind, {severity} AS severity, building_id, ({amount})::BIGINT AS amount, '{kind}:' || {_KEY} AS signature, json_object({fields})::VARCHAR AS detail FROM {{custody}} WHERE {where}"


_SQL = {
    "funds_returned_not_refunded": _f("funds_returned_not_refunded", f"CASE WHEN {_D} - returned_on > 14 THEN 'critical' ELSE 'high' END", "returned_on IS NOT NULL AND refunded_on IS NULL", "coalesce(returned_amount, amount)", funds_returned_on="returned_on", days_since_return=f"{_D} - returned_on", stage="stage"),
    "master_account_float": _f("master_account_float", f"CASE WHEN {_D} - coalesce(cleared_on, sent_on) > 90 THEN 'critical' ELSE 'high' END", f"in_master > 0 AND {_D} - coalesce(cleared_on, sent_on) > 30", "in_master", since="coalesce(cleared_on, sent_on)", days_in_master=f"{_D} - coalesce(cleared_on, sent_on)", threshold_days="30"),
    "deposit_not_sent_to_bank": _f("deposit_not_sent_to_bank", "'high'", f"sent_on IS NULL AND {_D} - received_on > 5", received_on="received_on", days_held=f"{_D} - received_on", stage="stage"),
    "subaccount_not_opened": _f("subaccount_not_opened", "'high'", f"NOT {_SUB} AND {_D} - cleared_on > 30", bank_cleared_on="cleared_on", days_since_cleared=f"{_D} - cleared_on", stage="stage"),
    "allocation_pending": _f("allocation_pending", "'medium'", f"in_master > 0 AND {_SUB} AND coalesce({_D} - coalesce(sub_opened_on, cleared_on, sent_on), 31) > 30", "in_master", subaccount_last4="sub_last4", subaccount_opened_on="sub_opened_on", days_pending=f"{_D} - coalesce(sub_opened_on, cleared_on, sent_on)"),
    "vacated_subaccount_open": _f("vacated_subaccount_open", "'medium'", f"refunded_on IS NULL AND bank_closed_on IS NULL AND stage IN {OPEN_STAGES} AND {_D} - vacate_on > 45", vacate_date="vacate_on", days_since_vacate=f"{_D} - vacate_on", stage="stage"),
}
_NAMES = {"cus01_master_float": "master_account_float", "cus02_not_sent": "deposit_not_sent_to_bank", "cus03_subaccount_not_opened": "subaccount_not_opened", "cus04_allocation_pending": "allocation_pending", "cus05_not_refunded": "funds_returned_not_refunded", "cus06_vacated_open": "vacated_subaccount_open"}


def _day() -> Column:
    return F.lit(AS_OF).cast("date")


QUERIES = {name: (lambda kind: lambda spark, sf_dir: findings(Domain(spark, sf_dir).custody, _day())[kind])(kind) for name, kind in _NAMES.items()}
QUERIES["snk04_new_findings"] = lambda spark, sf_dir: (lambda c: first_by_signature(all_findings(c, _day()), all_findings(c.where("building_id < 5"), _day())))(Domain(spark, sf_dir).custody)
ORACLE = {name: duck(_SQL[kind]) for name, kind in _NAMES.items()}
_U = " UNION ALL ".join(_SQL.values())
ORACLE["snk04_new_findings"] = duck(f"SELECT signature, kind, severity, building_id, amount, custody_id, detail FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY kind, severity, building_id, amount, custody_id) AS n FROM ({_U})) WHERE n = 1 AND signature NOT IN (SELECT signature FROM ({_U}) WHERE building_id < 5)")
