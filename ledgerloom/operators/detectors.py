"""Reconciliation detectors. Each gives findings of one shape (FINDING), so that their
union is a plain append; anti-joins carry the date windows as residual conditions on
equi keys, so none compares all pairs."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as tx
from ..plans.domain import Domain, duck
from ..plans.shared import write_once
from .views import continuity

#: Default windows in days and the payee threshold.
BANK_DAYS, DEPOSIT_DAYS, TRANSFER_DAYS, PAYEE, STALE_DAYS = 45, 30, 5, 0.4, 30
#: Rows of an amount after which transfers are paired in another group, at the next gap.
RUN_ROWS = 4096
#: Rows of a run that are paired in one task, whole days.
PART_ROWS = 1 << 16
#: Groups in which runs travel, for each shuffle partition.
GROUPS = 8
FINDING = ("kind", "severity", "building_id", "lease_id", "txn_id", "amount", "signature", "detail")


def as_json(fields: dict[str, Column | str]) -> Column:
    """The fields as one JSON object, nulls written out."""
    return F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def finding(df: DataFrame, kind: str, severity: str, ref: Column, building: str | None = "building_id", lease: str | None = None, txn: str | None = None, amount: Column | str | None = "amount", **detail: Column | str) -> DataFrame:
    """Rows as findings; ``detail`` is what a reader needs to look at each one."""
    col = lambda c: F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c
    return df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), col(building).cast("long").alias("building_id"), col(lease).cast("long").alias("lease_id"), col(txn).cast("long").alias("txn_id"), col(amount).cast("long").alias("amount"), F.concat(F.lit(f"{kind}:"), ref.cast("string")).alias("signature"), as_json(detail).alias("detail"))


def _refunds(txns: DataFrame) -> DataFrame:
    return txns.where(tx.is_refund(F.col("amount"), F.col("descriptor")))


def _matched_refunds(txns: DataFrame, matches: DataFrame, leases: DataFrame) -> DataFrame:
    first = matches.groupBy("txn_id").agg(F.min("lease_id").alias("lease_id"))
    return _refunds(txns).join(first, "txn_id").join(leases.drop("building_id"), "lease_id")


def unexplained_debit(txns: DataFrame, leases: DataFrame, days: int = BANK_DAYS) -> DataFrame:
    """Days are cut into ranges of the window's length, and a move-out stands in its own
    and both neighbouring ranges: the join key is (building, range), never a whole building."""
    gone = leases.select(F.col("building_id").alias("b"), F.coalesce("keys_on", "vacated_on").alias("gone")).where("gone IS NOT NULL")
    near = gone.select("b", "gone", F.explode(dates.near_days(F.col("gone"), days)).alias("r"))
    t = _refunds(txns.where("account_type = 'escrow'")).withColumn("r0", dates.day_range(F.col("posted_on"), days))
    left = t.join(near, (t.building_id == near.b) & (t.r0 == near.r) & (F.abs(F.datediff("posted_on", "gone")) <= days), "left_anti")
    return finding(left, "unexplained_debit", "critical", F.col("txn_id"), txn="txn_id", posted_on="posted_on", descriptor="descriptor")


def deposit_never_banked(txns: DataFrame, leases: DataFrame, days: int = DEPOSIT_DAYS) -> DataFrame:
    t = txns.where("account_type = 'escrow'").select(F.col("building_id").alias("b"), F.col("amount").alias("a"), "posted_on", F.explode(dates.near_days(F.col("posted_on"), days)).alias("r"))
    anchor = F.coalesce("signed_on", "term_start")
    left = leases.join(t, (leases.building_id == t.b) & (leases.deposit == t.a) & (dates.day_range(anchor, days) == F.col("r")) & (F.abs(F.datediff(anchor, "posted_on")) <= days), "left_anti")
    return finding(left, "deposit_never_banked", "critical", F.col("lease_id"), lease="lease_id", amount="deposit", unit="unit", tenant="tenant", anchor=F.coalesce("signed_on", "term_start"), within_days=F.lit(days))


def refund_payee_mismatch(txns: DataFrame, matches: DataFrame, leases: DataFrame, threshold: float = PAYEE, refunds: DataFrame | None = None) -> DataFrame:
    j = refunds if refunds is not None else _matched_refunds(txns, matches, leases)
    payee = F.coalesce(F.nullif(tx.normalize_name(F.col("counterparty")), F.lit("")), tx.extract_payer(F.col("descriptor")))
    j = j.withColumn("payee", payee).where("payee <> ''").withColumn("similarity", tx.name_similarity(F.col("payee"), F.col("tenant"))).where(F.col("similarity") < threshold)
    return finding(j, "refund_payee_mismatch", "critical", F.col("txn_id"), lease="lease_id", txn="txn_id", payee="payee", tenant_of_record="tenant", similarity=F.round("similarity", 3))


def refund_without_vacate(txns: DataFrame, matches: DataFrame, leases: DataFrame, refunds: DataFrame | None = None) -> DataFrame:
    j = (refunds if refunds is not None else _matched_refunds(txns, matches, leases)).where("vacated_on IS NULL AND keys_on IS NULL")
    return finding(j, "refund_without_vacate", "high", F.col("txn_id"), lease="lease_id", txn="txn_id", tenant="tenant", posted_on="posted_on")


def duplicate_refund(txns: DataFrame, matches: DataFrame, leases: DataFrame, refunds: DataFrame | None = None) -> DataFrame:
    j = (refunds if refunds is not None else _matched_refunds(txns, matches, leases)).groupBy("lease_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.array_sort(F.collect_list(F.struct("posted_on", "txn_id"))).alias("all"))
    j = j.where("n >= 2").join(leases.select("lease_id", "building_id"), "lease_id")
    return finding(j, "duplicate_refund", "high", F.col("lease_id"), lease="lease_id", count="n", transaction_ids=F.transform("all", lambda x: x.txn_id), posted=F.transform("all", lambda x: x.posted_on))


def escrow_to_operating(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """A counterparty's runs of four digits are looked up among the operating accounts."""
    t = txns.where("account_type = 'escrow' AND amount < 0")
    runs = t.where("counterparty IS NOT NULL").select("txn_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("counterparty") - 3, F.lit(1))), lambda i: F.substring("counterparty", i, F.lit(4))))).alias("last4"))
    hit = runs.join(accounts.where("account_type = 'operating'").select("last4").distinct(), "last4").select("txn_id", F.lit(True).alias("hit")).distinct()
    j = t.join(hit, "txn_id", "left").where(F.col("hit") | F.col("descriptor").rlike(tx.TRANSFER))
    return finding(j, "escrow_to_operating", "high", F.col("txn_id"), txn="txn_id", descriptor="descriptor", counterparty="counterparty")


PAIR = "building_id long, txn_id long, to_building long, to_txn long, amount long"


def pair_transfers(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Greedy one-to-one pairing within each (size, run, part): each debit, by day and id, takes
    the first free credit, by day and id, of another building within the window."""
    by = [c for c in ("size", "run", "part") if c in rows]
    rows = rows.sort_values([*by, "posted_on", "txn_id"])
    day = pd.to_datetime(rows["posted_on"]).to_numpy().astype("datetime64[D]").astype("int64")
    group = rows.groupby(by, sort=False).ngroup().to_numpy()
    place = group * (1 << 32) + day  # days of one group never meet another's
    building, txn, amount = (rows[c].to_numpy() for c in ("building_id", "txn_id", "amount"))
    debits, credits = (amount < 0).nonzero()[0], (amount > 0).nonzero()[0]
    window = int(rows["window"].iloc[0]) if len(rows) else 0
    low, high = (place[credits].searchsorted(place[debits] + s * window, side) for s, side in ((-1, "left"), (1, "right")))
    after = list(range(len(credits) + 1))  # the next credit that may be free, with paths cut short

    def free_from(i: int) -> int:
        while after[i] != i:
            after[i] = after[after[i]]
            i = after[i]
        return i

    out = []
    for d, first, stop in zip(debits.tolist(), low.tolist(), high.tolist(), strict=True):
        i = free_from(first)
        while i < stop and building[credits[i]] == building[d]:
            i = free_from(i + 1)
        if i < stop:
            after[i] = i + 1
            c = credits[i]
            out.append((building[d], txn[d], building[c], txn[c], amount[d]))
    return pd.DataFrame(out, columns=["building_id", "txn_id", "to_building", "to_txn", "amount"])


def transfer_runs(txns: DataFrame, days: int = TRANSFER_DAYS, most: int = RUN_ROWS, part: int | None = None) -> DataFrame:
    """Rows of amounts (size) that some debit and some credit of different buildings share
    within the window, in runs: an amount is cut where no row lies within the window of the
    day before, since no pair and no choice reaches over such a gap; runs that start within
    ``most`` rows are one.  With ``part``, a run's days are dealt to parts of about so many rows."""
    t = txns.where("account_type = 'escrow' AND amount <> 0").select("txn_id", "building_id", "amount", "posted_on", F.abs("amount").alias("size"))
    # of the credits of an amount and day all that matters here is whether there are two buildings, or which one
    c = t.where("amount > 0").groupBy(F.col("size").alias("s"), F.col("posted_on").alias("p")).agg(F.min("building_id").alias("lo"), F.max("building_id").alias("hi"))
    c = c.select("s", "p", "lo", "hi", F.explode(dates.near_days(F.col("p"), days)).alias("r"))
    d = t.where("amount < 0").select("size", "building_id", "posted_on").distinct()
    shared = d.join(c, (d.size == c.s) & (dates.day_range(F.col("posted_on"), days) == c.r) & ((d.building_id != c.lo) | (d.building_id != c.hi)) & (F.abs(F.datediff("posted_on", "p")) <= days), "left_semi").select("size").distinct()
    t = t.join(shared, "size")
    by = Window.partitionBy("size").orderBy("posted_on")  # one row a day, however many an amount has
    days_of = t.groupBy("size", "posted_on").agg(F.count("*").alias("n")).withColumn("gap", F.datediff("posted_on", F.lag("posted_on").over(by)) > days)
    before = F.sum("n").over(by) - F.col("n")
    days_of = days_of.withColumn("cut", F.when(F.col("gap"), F.floor(before / most)).otherwise(0)).withColumn("part", F.floor(before / part) if part else F.lit(0))
    runs = days_of.select(F.col("size").alias("s"), F.col("posted_on").alias("p"), F.max("cut").over(by).alias("run"), *(["part"] if part else []))
    return t.join(runs, (t.size == runs.s) & t.posted_on.eqNullSafe(runs.p)).drop("s", "p").withColumn("window", F.lit(days))


def _paired(rows: DataFrame) -> DataFrame:
    """Runs or parts of runs travel together in groups, as most hold few rows."""
    by = [c for c in ("size", "run", "part") if c in rows.columns]
    group = F.pmod(F.xxhash64(*by), F.lit(GROUPS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return rows.groupBy(group).applyInPandas(pair_transfers, PAIR)


def transfer_pairs(txns: DataFrame, days: int = TRANSFER_DAYS, most: int = RUN_ROWS, part: int = PART_ROWS) -> DataFrame:
    """Debits paired with credits of equal amount elsewhere, as if one by one.

    A run of more than about ``part`` rows is paired in parts of whole days, at once: each
    part's debits choose among the credits within the window, then whatever credit an earlier
    part has chosen is taken from the later ones, and the parts for which that makes a
    difference choose again.  Earlier debits come first in the one-by-one order too, so the
    first part is final at once, and every round makes at least one more part final; when
    nothing changes, the choices are those of one task.  Mostly a few rounds do, since choices
    part ways only where credits are short.  A part holds at least a day of its amount."""
    rows = transfer_runs(txns, days, most, part)
    rows = write_once(rows)
    long = write_once(rows.groupBy("size", "run").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("size", "run"))
    short = _paired(rows.join(long, ["size", "run"], "left_anti").drop("part"))
    if long.isEmpty():
        return short
    own = rows.join(long, ["size", "run"], "left_semi")
    days_of = own.where("amount < 0").select("size", "run", F.col("part").alias("to_part"), "posted_on").distinct()
    reach = days_of.select("size", "run", "to_part", F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda i: F.date_add("posted_on", i))).alias("posted_on")).distinct()
    credits = own.where("amount > 0").drop("part").join(reach, ["size", "run", "posted_on"]).withColumnRenamed("to_part", "part")
    seen = write_once(own.where("amount < 0").unionByName(credits))
    place = seen.where("amount < 0").select("txn_id", "size", "run", "part")
    chosen = write_once(_paired(seen).join(place, "txn_id"))
    taken = None
    while True:
        c = chosen.select(F.col("to_txn").alias("txn_id"), F.col("part").alias("by_part"))
        now = write_once(seen.where("amount > 0").join(c.groupBy("txn_id").agg(F.min("by_part").alias("by_part")), "txn_id").where("by_part < part").select("size", "run", "part", "txn_id"))
        if taken is None:
            changed = now
        else:
            changed = now.join(taken, now.columns, "left_anti").union(taken.join(now, now.columns, "left_anti"))
        changed = write_once(changed.select("size", "run", "part").distinct())
        if changed.isEmpty():
            return short.unionByName(chosen.select(*short.columns))
        again = seen.join(changed, ["size", "run", "part"], "left_semi").join(now, ["size", "run", "part", "txn_id"], "left_anti")
        kept = chosen.join(changed, ["size", "run", "part"], "left_anti")
        chosen = write_once(kept.unionByName(_paired(again).join(place, "txn_id")))
        taken = now


def inter_building_transfer(txns: DataFrame, days: int = TRANSFER_DAYS) -> DataFrame:
    return finding(transfer_pairs(txns, days), "inter_building_transfer", "high", F.concat_ws(":", "txn_id", "to_txn"), txn="txn_id", from_building="building_id", to_building="to_building", debit_txn="txn_id", credit_txn="to_txn", amount_cents=-F.col("amount"))


def interest_not_allocated(txns: DataFrame, leases: DataFrame, ledger: DataFrame) -> DataFrame:
    given = ledger.where("entry_type = 'interest_credit'").join(leases.select("lease_id", "building_id"), "lease_id").groupBy("building_id").agg(F.sum("amount").alias("given"))
    t = txns.where(tx.is_interest(F.col("amount"), F.col("descriptor")) & (F.col("account_type") == "escrow"))
    j = t.join(given, "building_id", "left").where(F.coalesce("given", F.lit(0)) <= 0)
    return finding(j, "interest_not_allocated", "medium", F.col("txn_id"), txn="txn_id", posted_on="posted_on", bank_interest_cents="amount", allocated_cents=F.coalesce("given", F.lit(0)))


def deposit_exceeds_month(leases: DataFrame) -> DataFrame:
    return finding(leases.where("deposit > rent"), "deposit_exceeds_one_month", "medium", F.col("lease_id"), lease="lease_id", amount=F.col("deposit") - F.col("rent"), deposit_cents="deposit", monthly_rent_cents="rent")


def stale_credit(leases: DataFrame, ledger: DataFrame, statements: DataFrame, days: int = STALE_DAYS) -> DataFrame:
    sums = ledger.groupBy("lease_id").agg(F.sum("amount").alias("amount")).where("amount > 0")
    last = statements.agg(F.max("period_end").alias("last"))
    j = leases.withColumn("gone", F.coalesce("keys_on", "vacated_on")).where("gone IS NOT NULL").join(sums, "lease_id").join(F.broadcast(last), F.abs(F.datediff("last", "gone")) > days)  # one row
    return finding(j, "stale_credit", "medium", F.col("lease_id"), lease="lease_id", tenant="tenant", gone_on="gone", held_cents="amount", as_of="last")


def missing_statement(statements: DataFrame) -> DataFrame:
    c = continuity(statements)
    return finding(c, "missing_statement_period", "medium", F.concat_ws(":", "building_id", "kind", "period_start"), break_kind="kind", prior_end="prior_end", next_start="period_start")


def interest_account(buildings: DataFrame, accounts: DataFrame) -> DataFrame:
    a = accounts.where("account_type = 'escrow'").groupBy("building_id").agg(F.bool_or("interest_bearing").alias("any"), F.array_sort(F.collect_list("last4")).alias("held"))
    j = buildings.where("interest_required").join(a, "building_id").where("NOT any")
    return finding(j, "interest_account_noncompliant", "high", F.col("building_id"), amount=None, name="name", accounts="held")


def all_findings(d: Domain) -> DataFrame:
    """All detectors in order; statements with a failing checksum are left out."""
    good = d.statements.where("checksum_ok")
    refunds = write_once(_matched_refunds(d.txns, d.matches, d.leases))  # three detectors read it
    parts = [
        unexplained_debit(d.txns, d.leases), deposit_never_banked(d.txns, d.leases), refund_payee_mismatch(d.txns, d.matches, d.leases, refunds=refunds), refund_without_vacate(d.txns, d.matches, d.leases, refunds),
        duplicate_refund(d.txns, d.matches, d.leases, refunds), escrow_to_operating(d.txns, d.accounts), inter_building_transfer(d.txns), interest_not_allocated(d.txns, d.leases, d.ledger),
        deposit_exceeds_month(d.leases), stale_credit(d.leases, d.ledger, good), missing_statement(good), interest_account(d.buildings, d.accounts),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Severities from the worst.
SEVERITIES = ("critical", "high", "medium", "low")


def counts(findings: DataFrame) -> DataFrame:
    """Findings by kind and by severity in one pass."""
    return findings.groupingSets([["kind"], ["severity"]], "kind", "severity").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def by_kind(findings: DataFrame) -> DataFrame:
    """Per kind: findings, their amount and the worst severity."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return findings.groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.min(rank).alias("r")).select("kind", "n", "amount", F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("r").cast("int")).alias("severity"))


def _q(f, prepared: bool = False):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir, prepared))


QUERIES = {
    "det01_unexplained_debit": _q(lambda d: unexplained_debit(d.txns, d.leases)),
    "det02_deposit_never_banked": _q(lambda d: deposit_never_banked(d.txns, d.leases)),
    "det03_refund_payee_mismatch": _q(lambda d: refund_payee_mismatch(d.txns, d.matches, d.leases), True),
    "det04_refund_without_vacate": _q(lambda d: refund_without_vacate(d.txns, d.matches, d.leases)),
    "det05_duplicate_refund": _q(lambda d: duplicate_refund(d.txns, d.matches, d.leases), True),
    "det06_escrow_to_operating": _q(lambda d: escrow_to_operating(d.txns, d.accounts)),
    "det07_inter_building_transfer": _q(lambda d: inter_building_transfer(d.txns), True),
    "det08_interest_not_allocated": _q(lambda d: interest_not_allocated(d.txns, d.leases, d.ledger)),
    "det09_deposit_exceeds_month": _q(lambda d: deposit_exceeds_month(d.leases)),
    "det10_stale_credit": _q(lambda d: stale_credit(d.leases, d.ledger, d.statements.where("checksum_ok"))),
    "det11_missing_statement": _q(lambda d: missing_statement(d.statements.where("checksum_ok"))),
    "det12_interest_account": _q(lambda d: interest_account(d.buildings, d.accounts)),
    "agg11_finding_counts": _q(lambda d: counts(all_findings(d)), True),
    "agg12_findings_by_kind": _q(lambda d: by_kind(all_findings(d)), True),
}


def _f(kind: str, severity: str, ref: str, body: str, building: str = "building_id", lease: str = "NULL", txn: str = "NULL", amount: str = "amount", detail: str = "") -> str:
    return f"SELECT '{kind}' AS kind, '{severity}' AS severity, ({building})::BIGINT AS building_id, ({lease})::BIGINT AS lease_id, ({txn})::BIGINT AS txn_id, ({amount})::BIGINT AS amount, '{kind}:' || ({ref})::VARCHAR AS signature, json_object({detail})::VARCHAR AS detail FROM {body}"


def _d(**fields: str) -> str:
    return ", ".join(f"'{k}', {v}" for k, v in fields.items())


_REF = "t.amount < 0 AND regexp_matches(t.descriptor, 'refund|check\\s*paid|return|disburse', 'i')"
_MR = "{txns} t JOIN {matches} m USING (txn_id) JOIN {leases} l ON l.lease_id = m.lease_id WHERE " + _REF
_NORM, _PAY, _GRAM = tx.sql_name, tx.sql_payer("t.descriptor"), tx.sql_trigrams
#: Refunds first, then their matches; trigrams of every distinct name once.
_NAMED = f"(WITH r AS MATERIALIZED (SELECT * FROM {{txns}} t WHERE {_REF}), k AS MATERIALIZED (SELECT m.txn_id, m.lease_id FROM {{matches}} m SEMI JOIN r USING (txn_id)) SELECT t.txn_id, t.building_id, l.lease_id, l.tenant, t.amount, coalesce(nullif({_NORM('t.counterparty')}, ''), {_PAY}) AS p, {_NORM('l.tenant')} AS q FROM r t JOIN k USING (txn_id) JOIN {{leases}} l ON l.lease_id = k.lease_id) WHERE p <> ''"
_GRAMS = f"(SELECT w, {_GRAM('w')} AS x FROM (SELECT p AS w FROM {_NAMED} UNION SELECT q FROM {_NAMED}))"
_CONT = "(SELECT b.building_id, b.period_start, b.opening, a.period_end AS pe, a.closing AS pc FROM (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY period_start, period_end, statement_id) AS n FROM {statements} WHERE checksum_ok) a JOIN (SELECT *, row_number() OVER (PARTITION BY building_id ORDER BY period_start, period_end, statement_id) AS n FROM {statements} WHERE checksum_ok) b ON a.building_id = b.building_id AND b.n = a.n + 1)"
_SQL = {
    "det01_unexplained_debit": _f("unexplained_debit", "critical", "txn_id", "{txns} t WHERE account_type = 'escrow' AND " + _REF + " AND NOT EXISTS (SELECT 1 FROM {leases} l WHERE l.building_id = t.building_id AND abs(coalesce(l.keys_on, l.vacated_on) - t.posted_on) <= 45)", txn="txn_id", detail=_d(posted_on="posted_on", descriptor="descriptor")),
    "det02_deposit_never_banked": _f("deposit_never_banked", "critical", "lease_id", "{leases} l WHERE NOT EXISTS (SELECT 1 FROM {txns} t WHERE t.account_type = 'escrow' AND t.building_id = l.building_id AND t.amount = l.deposit AND abs(coalesce(l.signed_on, l.term_start) - t.posted_on) <= 30)", lease="lease_id", amount="deposit", detail=_d(unit="unit", tenant="tenant", anchor="coalesce(signed_on, term_start)", within_days="30")),
    "det03_refund_payee_mismatch": _f("refund_payee_mismatch", "critical", "txn_id", f"(SELECT r.*, n / (len(a.x) + len(b.x) - n) AS s FROM (SELECT * FROM {_NAMED}) r JOIN {_GRAMS} a ON a.w = r.p JOIN {_GRAMS} b ON b.w = r.q, LATERAL (SELECT len(list_intersect(a.x, b.x)) AS n)) WHERE s < 0.4", lease="lease_id", txn="txn_id", detail=_d(payee="p", tenant_of_record="tenant", similarity="round(s, 3)")),
    "det04_refund_without_vacate": _f("refund_without_vacate", "high", "txn_id", _MR + " AND l.vacated_on IS NULL AND l.keys_on IS NULL", building="t.building_id", lease="l.lease_id", txn="txn_id", detail=_d(tenant="l.tenant", posted_on="posted_on")),
    "det05_duplicate_refund": _f("duplicate_refund", "high", "lease_id", "(SELECT l.lease_id, l.building_id, sum(t.amount) AS amount, count(*) AS n, list(t.txn_id ORDER BY t.posted_on, t.txn_id) AS ids, list(t.posted_on ORDER BY t.posted_on, t.txn_id) AS days FROM " + _MR + " GROUP BY 1, 2 HAVING count(*) >= 2)", lease="lease_id", detail=_d(count="n", transaction_ids="ids", posted="days")),
    "det06_escrow_to_operating": _f("escrow_to_operating", "high", "txn_id", "{txns} t WHERE account_type = 'escrow' AND amount < 0 AND (regexp_matches(descriptor, 'transfer|xfer|to\\s+oper|to\\s+dda|to\\s+checking', 'i') OR EXISTS (SELECT 1 FROM {accounts} a WHERE a.account_type = 'operating' AND contains(t.counterparty, a.last4)))", txn="txn_id", detail=_d(descriptor="descriptor", counterparty="counterparty")),
    "det07_inter_building_transfer": _f("inter_building_transfer", "high", "txn_id || ':' || c", "(SELECT t.txn_id, t.building_id, t.amount, c.txn_id AS c, c.building_id AS b, row_number() OVER (PARTITION BY t.txn_id ORDER BY c.posted_on, c.txn_id) AS n FROM {txns} t JOIN {txns} c ON c.amount = -t.amount AND c.building_id <> t.building_id AND abs(c.posted_on - t.posted_on) <= 5 WHERE t.amount < 0 AND t.account_type = 'escrow' AND c.account_type = 'escrow') WHERE n = 1", txn="txn_id", detail=_d(from_building="building_id", to_building="b", debit_txn="txn_id", credit_txn="c", amount_cents="-amount")),
    "det08_interest_not_allocated": _f("interest_not_allocated", "medium", "txn_id", "{txns} t WHERE account_type = 'escrow' AND amount > 0 AND regexp_matches(descriptor, 'interest', 'i') AND coalesce((SELECT sum(g.amount) FROM {ledger} g JOIN {leases} l USING (lease_id) WHERE l.building_id = t.building_id AND g.entry_type = 'interest_credit'), 0) <= 0", txn="txn_id", detail=_d(posted_on="posted_on", bank_interest_cents="amount", allocated_cents="0")),
    "det09_deposit_exceeds_month": _f("deposit_exceeds_one_month", "medium", "lease_id", "{leases} WHERE deposit > rent", lease="lease_id", amount="deposit - rent", detail=_d(deposit_cents="deposit", monthly_rent_cents="rent")),
    "det10_stale_credit": _f("stale_credit", "medium", "lease_id", "(SELECT l.lease_id, l.building_id, l.tenant, coalesce(l.keys_on, l.vacated_on) AS gone, sum(g.amount)::BIGINT AS amount FROM {leases} l JOIN {ledger} g USING (lease_id) WHERE abs((SELECT max(period_end) FROM {statements} WHERE checksum_ok) - coalesce(l.keys_on, l.vacated_on)) > 30 GROUP BY ALL HAVING sum(g.amount) > 0)", lease="lease_id", detail=_d(tenant="tenant", gone_on="gone", held_cents="amount", as_of="(SELECT max(period_end) FROM {statements} WHERE checksum_ok)")),
    "det11_missing_statement": _f("missing_statement_period", "medium", "building_id || ':calendar_gap:' || period_start", _CONT + " WHERE period_start <> pe + 1", amount="NULL", detail=_d(break_kind="'calendar_gap'", prior_end="pe", next_start="period_start")) + " UNION ALL " + _f("missing_statement_period", "medium", "building_id || ':balance_break:' || period_start", _CONT + " WHERE opening <> pc", amount="opening - pc", detail=_d(break_kind="'balance_break'", prior_end="pe", next_start="period_start")),
    "det12_interest_account": _f("interest_account_noncompliant", "high", "building_id", "(SELECT b.building_id, b.name, a.held FROM {buildings} b JOIN (SELECT building_id, list(last4 ORDER BY last4) AS held FROM {accounts} WHERE account_type = 'escrow' GROUP BY 1 HAVING NOT bool_or(interest_bearing)) a ON a.building_id = b.building_id WHERE interest_required)", amount="NULL", detail=_d(name="name", accounts="held")),
}
_ALL = "(" + " UNION ALL ".join(_SQL.values()) + ")"
_SQL |= {
    "agg11_finding_counts": f"SELECT kind, severity, count(*) AS n, sum(amount)::BIGINT AS amount FROM {_ALL} GROUP BY GROUPING SETS ((kind), (severity))",
    "agg12_findings_by_kind": f"SELECT kind, count(*) AS n, sum(amount)::BIGINT AS amount, arg_min(severity, list_position({list(SEVERITIES)}, severity)) AS severity FROM {_ALL} GROUP BY 1",
}
ORACLE = {k: duck(v) for k, v in _SQL.items()}
