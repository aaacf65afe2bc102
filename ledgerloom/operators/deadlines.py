"""The refund clock: due days, stages with catch-up, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.domain import AS_OF, Domain, duck

#: Days to refund, and the days after which each stage is reached.
DUE_DAYS = 14
STAGES = (("day7", 7), ("day10", 10), ("day14", 14), ("overdue", 15))


def open_deadlines(leases: DataFrame, ledger: DataFrame) -> DataFrame:
    """Leases with keys returned and no net refund; any non-zero net refund closes one."""
    paid = ledger.where("entry_type = 'refund'").groupBy("lease_id").agg((-F.sum("amount")).alias("paid"))
    j = leases.where("keys_on IS NOT NULL").join(paid, "lease_id", "left").where(F.coalesce("paid", F.lit(0)) == 0)
    return j.select("lease_id", "building_id", "unit", "tenant", "keys_on", F.date_add("keys_on", DUE_DAYS).alias("due_on"), "deposit")


def due_stages(deadlines: DataFrame, sent: DataFrame, as_of: Column) -> DataFrame:
    """Every stage that is reached and not yet sent; late runs catch up."""
    elapsed = F.datediff(as_of, "keys_on")
    stages = F.array(*[F.when(elapsed >= days, F.struct(F.lit(i).alias("ordinal"), F.lit(name).alias("stage"))) for i, (name, days) in enumerate(STAGES)])
    reached = deadlines.select("lease_id", "building_id", "tenant", "unit", "deposit", "due_on", F.datediff("due_on", as_of).alias("days_left"), F.explode(F.array_compact(stages)).alias("s")).select("*", "s.stage", "s.ordinal").drop("s")
    return reached.join(sent.select("lease_id", "stage"), ["lease_id", "stage"], "left_anti")


def message(days_left: Column, unit: Column, tenant: Column) -> Column:
    when = F.when(days_left < 0, F.concat(F.lit("PAST DUE by "), F.abs(days_left).cast("string"), F.lit(" days"))).when(days_left == 0, F.lit("DUE TODAY")).otherwise(F.concat(F.lit("due in "), days_left.cast("string"), F.lit(" days")))
    return F.concat(F.lit("Deposit refund "), when, F.lit(": "), unit, F.lit(" "), tenant)


def record_sent(stages: DataFrame, recipients: DataFrame) -> DataFrame:
    """Notifications to record: stages of buildings that have a recipient."""
    return stages.join(recipients, "building_id").select("lease_id", "stage", "recipient")


def _sent(d: Domain) -> DataFrame:
    return d.leases.where("lease_id % 4 = 0").select("lease_id", F.lit("day7").alias("stage"))


def _stages(spark, sf_dir):
    d = Domain(spark, sf_dir)
    s = due_stages(open_deadlines(d.leases, d.ledger), _sent(d), F.lit(AS_OF).cast("date"))
    return s.select("lease_id", "stage", "due_on", "days_left", message(F.col("days_left"), F.col("unit"), F.col("tenant")).alias("subject"))


def _record(spark, sf_dir):
    d = Domain(spark, sf_dir)
    s = due_stages(open_deadlines(d.leases, d.ledger), _sent(d), F.lit(AS_OF).cast("date"))
    return record_sent(s, d.buildings.where("building_id % 3 <> 0").select("building_id", F.concat(F.lit("b"), "building_id").alias("recipient")))


QUERIES = {"vw04_open_deadlines": lambda spark, sf_dir: (lambda d: open_deadlines(d.leases, d.ledger))(Domain(spark, sf_dir)), "dl02_due_stages": _stages, "dl04_notifications": _record}
_OPEN = "(SELECT lease_id, building_id, unit, tenant, keys_on, keys_on + 14 AS due_on, deposit FROM {leases} l WHERE keys_on IS NOT NULL AND coalesce((SELECT -sum(amount) FROM {ledger} g WHERE g.lease_id = l.lease_id AND entry_type = 'refund'), 0) = 0)"
_ST = f"(SELECT o.*, v.stage, (o.due_on - DATE '{AS_OF}')::INT AS days_left FROM {_OPEN} o JOIN (VALUES ('day7', 7), ('day10', 10), ('day14', 14), ('overdue', 15)) v(stage, n) ON DATE '{AS_OF}' - o.keys_on >= v.n WHERE NOT (v.stage = 'day7' AND o.lease_id % 4 = 0))"
ORACLE = {k: duck(v) for k, v in {
    "vw04_open_deadlines": f"SELECT * FROM {_OPEN}",
    "dl02_due_stages": f"SELECT lease_id, stage, due_on, days_left, 'Deposit refund ' || CASE WHEN days_left < 0 THEN 'PAST DUE by ' || abs(days_left) || ' days' WHEN days_left = 0 THEN 'DUE TODAY' ELSE 'due in ' || days_left || ' days' END || ': ' || unit || ' ' || tenant AS subject FROM {_ST}",
    "dl04_notifications": f"SELECT lease_id, stage, 'b' || building_id AS recipient FROM {_ST} WHERE building_id % 3 <> 0",
}.items()}
