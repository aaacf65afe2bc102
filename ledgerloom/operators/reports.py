"""Reports: small ordered frames over the roll-ups.  An order is a column, so that it holds
wherever the rows go; orders over many rows are ranks within a building."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.domain import AS_OF, Domain, duck
from ..plans.shared import write_once
from . import custody, deadlines, detectors, gates, views

#: Extraction methods whose figures a machine read.
MACHINE_READ = ("text_layer", "csv")


def tieout_report(tieout: DataFrame) -> DataFrame:
    """The tie-out by expected variance, those without a statement last, with the running
    total of banked money.  One row a building."""
    w = Window.orderBy(F.col("expected_variance").asc_nulls_last(), "building_id")
    running = F.sum(F.coalesce("bank_total", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return tieout.select(F.row_number().over(w).alias("place"), "building_id", "bank_total", "expected_variance", running.alias("running_bank"))


def findings_report(findings: DataFrame) -> DataFrame:
    """Findings by kind: the worst severities first, then the most findings."""
    rank = F.array_position(F.array(*map(F.lit, detectors.SEVERITIES)), F.col("severity"))
    w = Window.orderBy(rank, F.desc("n"), "kind")  # one row a kind
    return detectors.by_kind(findings).select(F.row_number().over(w).alias("place"), "kind", "severity", "n", "amount")


def extraction_mix(statements: DataFrame) -> DataFrame:
    """How the figures of passing statements were read."""
    return statements.where("checksum_ok").groupBy("method").agg(F.count("*").alias("n")).withColumn("class", F.when(F.col("method").isin(*MACHINE_READ), "machine-read").otherwise("model-read"))


def aging_report(custody_rows: DataFrame, as_of: Column) -> DataFrame:
    """Pooled money of each building, the oldest first, days unknown last."""
    w = Window.partitionBy("building_id").orderBy(F.col("days").desc_nulls_last(), "custody_id")
    return views.master_aging(custody_rows, as_of).select("building_id", F.row_number().over(w).alias("place"), "custody_id", "days", "in_master")


def recon_report(custody_rows: DataFrame) -> DataFrame:
    """Bank against books, every deposit that has either; the least variance first, unknown last."""
    w = Window.partitionBy("building_id").orderBy(F.col("variance").asc_nulls_last(), "custody_id")
    rows = custody_rows.where("bank_balance IS NOT NULL OR books_balance IS NOT NULL").withColumn("variance", F.col("bank_balance") - F.col("books_balance"))
    return rows.select("building_id", F.row_number().over(w).alias("place"), "custody_id", "variance")


def needs_attention(journal: DataFrame, success: tuple[str, ...] = gates.SUCCESS) -> DataFrame:
    """Files whose last outcome is no success."""
    return gates.last_outcome(journal).where(~F.col("status").isin(*success))


def status_counts(journal: DataFrame) -> DataFrame:
    return gates.last_outcome(journal).groupBy("status").agg(F.count("*").alias("files"))


def open_findings(findings: DataFrame, statuses: DataFrame, severities: tuple[str, ...] = ("critical", "high")) -> DataFrame:
    """Findings of some severities that nobody has resolved; no stored status is open."""
    j = findings.join(statuses, "signature", "left").withColumn("status", F.coalesce("status", F.lit("open")))
    return j.where(F.col("severity").isin(*severities) & (F.col("status") != "resolved")).select("signature", "severity", "status")


#: The moves between the statuses of a finding.
MOVES = {"open": ("investigating", "resolved", "escalated"), "investigating": ("resolved", "escalated"), "escalated": ("resolved",), "resolved": ()}


def triage(findings: DataFrame, moves: DataFrame) -> DataFrame:
    """Status of each (signature, status) after the asked moves (signature, to) that are allowed."""
    allowed = F.create_map(*[x for k, v in MOVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    j = findings.join(moves.groupBy("signature").agg(F.min("to").alias("to")), "signature", "left")
    ok = F.coalesce(F.array_contains(F.element_at(allowed, F.col("status")), F.col("to")), F.lit(False))
    return j.select("signature", F.when(ok, F.col("to")).otherwise(F.col("status")).alias("status"), (F.col("to").isNotNull() & ~ok).alias("refused"))


#: The domains of coded columns.
DOMAINS = {"kind": ("initial", "additional"), "stage": ("received", "sent_to_bank", "bank_cleared", "in_master", "subaccount_pending", "in_subaccount", "active", "vacated", "bank_closing", "funds_returned", "posted", "refunded", "closed")}


def domain_violations(rows: DataFrame, key: str, domains: dict[str, tuple[str, ...]] = DOMAINS) -> DataFrame:
    """(key, column, value) of coded values outside their domain; nulls pass."""
    bad = F.array_compact(F.array(*[F.when(~F.col(c).isin(*v), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c, v in domains.items()]))
    return rows.select(key, F.explode(bad).alias("b")).select(key, "b.column", "b.value")


def summary(tieout: DataFrame, latest: DataFrame, statements: DataFrame, findings: DataFrame, match_rate: DataFrame, deadlines: DataFrame) -> DataFrame:
    """The report's other frames as rows (section, key, n, amount): the portfolio over buildings
    with a statement and those without, how passing statements were read, findings by severity
    and by kind, the match rate, open deadlines.  ``latest`` has each building's last statement,
    ``statements`` have their method; aggregates of a few rows each."""
    row = lambda df, section, key, n, amount=None: df.select(F.lit(section).alias("section"), (F.lit(key) if isinstance(key, str) else key).alias("key"), n.cast("long").alias("n"), (F.lit(None) if amount is None else amount).cast("long").alias("amount"))
    has = F.col("bank_total").isNotNull()
    t = tieout.agg(F.count("*").alias("all"), F.count(F.when(has, 1)).alias("with"), *[F.sum(F.when(has, F.col(c))).alias(a) for a, c in (("bank", "bank_total"), ("expected", "expected_total"), ("variance", "expected_variance"))])
    one = F.lit(1)
    parts = [
        row(t, "portfolio", "buildings", F.col("all")),
        row(t, "portfolio", "reconciled", F.col("with")),
        row(t, "portfolio", "without a statement", F.col("all") - F.col("with")),
        *[row(t, "portfolio", k, F.col("with"), F.col(k)) for k in ("bank", "expected", "variance")],
        row(latest.agg(F.count(F.when(~F.col("checksum_ok"), one)).alias("bad")), "portfolio", "checksum failed", F.col("bad")),
        row(extraction_mix(statements), "provenance", F.concat_ws(", ", "method", "class"), F.col("n")),
        row(detectors.counts(findings), "findings", F.coalesce("kind", "severity"), F.col("n"), F.col("amount")),
        *[row(match_rate, "matching", k, F.col(k)) for k in ("transactions", "matched", "approved")],
        row(deadlines.agg(F.count("*").alias("open")), "deadlines", "open", F.col("open")),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_report(tieout: DataFrame, findings: DataFrame, path: str, rest: DataFrame | None = None) -> None:
    """The tie-out and the findings as a Markdown file and a JSON one.  Both frames have one
    row a building or a kind, so they are rendered on the driver, and Spark writes them."""
    spark = tieout.sparkSession
    buildings = [r.asDict() for r in tieout.orderBy("place").collect()]
    kinds = [r.asDict() for r in findings.orderBy("place").collect()]
    table = lambda rows: [] if not rows else ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join("" if v is None else str(v) for v in r.values()) + " |" for r in rows)]
    sections: dict[str, list[dict]] = {}
    for r in rest.collect() if rest is not None else []:  # a few rows a section
        sections.setdefault(r["section"], []).append({"key": r["key"], "n": r["n"], "amount": r["amount"]})
    more = [line for name, rows in sections.items() for line in (f"## {name.capitalize()}", "", *table(rows), "")]
    text = "\n".join(["# Reconciliation", "", *more, "## Tie-out by building", "", *table(buildings), "", "## Findings", "", *table(kinds), ""])
    for name, body in (("markdown", text), ("json", json.dumps({"buildings": buildings, "findings": kinds} | sections, default=str))):
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")


def continuity_report(statements: DataFrame, buildings: DataFrame, recorded: DataFrame) -> DataFrame:
    """Breaks in the series of passing statements, with the building's name, how many statements
    the series has, what is wrong in words, and whether ``recorded`` (signature) lacks it, so
    that a run which writes stores each break once, whoever found it first."""
    good = statements.where("checksum_ok")
    length = good.groupBy("building_id").agg(F.count("*").alias("statements"))
    first, last = F.date_add("prior_end", 1), F.date_sub("period_start", 1)
    between = lambda what, a, b: F.concat(F.lit(what), a.cast("string"), F.lit(" to "), b.cast("string"))
    said = F.when(F.col("kind") == "balance_break", "opening is not the prior closing").when(last >= first, between("no statement for ", first, last)).otherwise(between("periods overlap, ", F.col("period_start"), F.col("prior_end")))
    signature = F.concat_ws(":", F.lit("missing_statement_period"), "building_id", "kind", "period_start")
    rows = views.continuity(good).withColumns({"signature": signature, "message": said})
    stored = recorded.select("signature", F.lit(True).alias("_stored")).distinct()
    j = rows.join(length, "building_id").join(buildings.select("building_id", "name"), "building_id", "left").join(stored, "signature", "left")
    return j.select("building_id", "name", "statements", "prior_end", "period_start", "kind", "amount", "message", "signature", F.col("_stored").isNull().alias("is_new"))


def _day() -> Column:
    return F.lit(AS_OF).cast("date")


def _tie(d: Domain) -> DataFrame:
    return tieout_report(views.building_tieout(d.buildings, d.leases, d.ledger, d.statements))


def _custody_findings(d: Domain) -> DataFrame:
    return custody.first_by_signature(custody.all_findings(d.custody, _day()))


def _status(d: Domain) -> DataFrame:
    f = _custody_findings(d)
    return f.where("building_id % 3 = 0").select("signature", F.when(F.col("building_id") % 2 == 0, "resolved").otherwise("investigating").alias("status"))


def _triage(d: Domain) -> DataFrame:
    f = _custody_findings(d)
    now = f.select("signature", "building_id", F.element_at(F.array(*map(F.lit, MOVES)), (F.col("building_id") % 4 + 1).cast("int")).alias("status"))
    return triage(now, now.where("building_id % 5 <> 0").select("signature", F.when(F.col("building_id") % 3 == 0, "investigating").otherwise("resolved").alias("to")))


def _mix(d: Domain) -> DataFrame:
    methods = F.array(*map(F.lit, ("text_layer", "csv", "ocr", "vision")))
    return extraction_mix(d.statements.withColumn("method", F.element_at(methods, (F.col("statement_id") % 4 + 1).cast("int"))))


def _summary(d: Domain) -> DataFrame:
    methods = F.array(*map(F.lit, ("text_layer", "csv", "ocr", "vision")))
    read = d.statements.withColumn("method", F.element_at(methods, (F.col("statement_id") % 4 + 1).cast("int")))
    tie = write_once(views.building_tieout(d.buildings, d.leases, d.ledger, d.statements))
    rate = write_once(views.match_rate(d.txns, d.matches))
    return summary(tie, views.latest_statement(d.statements), read, detectors.all_findings(d), rate, deadlines.open_deadlines(d.leases, d.ledger))


def _domains(d: Domain) -> DataFrame:
    i = F.col("custody_id")
    return domain_violations(d.custody.select("custody_id", F.when(i % 100 == 0, "half").otherwise(F.col("kind")).alias("kind"), F.when(i % 150 == 0, "lost").when(i % 151 == 0, F.lit(None)).otherwise(F.col("stage")).alias("stage")), "custody_id")


def _q(f, prepared: bool = False):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir, prepared))


QUERIES = {
    "rpt01_tieout": _q(_tie, True), "rpt02_findings": _q(lambda d: findings_report(detectors.all_findings(d)), True), "agg13_extraction_mix": _q(_mix), "rpt04_aging": _q(lambda d: aging_report(d.custody, _day())), "rpt05_recon": _q(lambda d: recon_report(d.custody)),
    "rpt07_needs_attention": _q(lambda d: needs_attention(d.journal, ("purchase", "view"))), "agg21_status_counts": _q(lambda d: status_counts(d.journal)), "flt09_open_findings": _q(lambda d: open_findings(_custody_findings(d), _status(d))), "snk16_triage": _q(_triage), "int03_domains": _q(_domains),
    "rpt02_summary": _q(_summary, True),
    "rpt03_continuity": _q(lambda d: continuity_report(d.statements, d.buildings, detectors.missing_statement(d.statements.where("checksum_ok AND building_id % 2 = 0")))),
}
_PLACE = lambda sql, order, cols, by="": f"SELECT row_number() OVER ({by} ORDER BY {order}) AS place, {cols} FROM ({sql})"
_TIE = views._TIE
_SIG = "(SELECT signature, kind, severity, building_id FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY kind, severity, building_id, amount) AS n FROM (" + " UNION ALL ".join(custody._SQL.values()) + ")) WHERE n = 1)"
_KIND = detectors._SQL["agg12_findings_by_kind"]
_LAST = "(SELECT path, arg_max(status, ordinal) AS status, max(ordinal) AS ordinal FROM {journal} GROUP BY 1)"
_NOW = "CASE building_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'investigating' WHEN 2 THEN 'escalated' ELSE 'resolved' END"
_TO = "CASE WHEN building_id % 5 <> 0 THEN CASE WHEN building_id % 3 = 0 THEN 'investigating' ELSE 'resolved' END END"
_OK = "(now = 'open' AND \"to\" IS NOT NULL OR now IN ('investigating', 'escalated') AND coalesce(\"to\", '') = 'resolved')"
ORACLE = {k: duck(v) for k, v in {
    "rpt01_tieout": f"SELECT row_number() OVER w AS place, building_id, bank_total, expected_variance, (sum(coalesce(bank_total, 0)) OVER (w ROWS UNBOUNDED PRECEDING))::BIGINT AS running_bank FROM ({_TIE}) WINDOW w AS (ORDER BY expected_variance ASC NULLS LAST, building_id)",
    "rpt02_findings": _PLACE(_KIND, f"list_position({list(detectors.SEVERITIES)}, severity), n DESC, kind", "kind, severity, n, amount"),
    "agg13_extraction_mix": "SELECT CASE statement_id % 4 WHEN 0 THEN 'text_layer' WHEN 1 THEN 'csv' WHEN 2 THEN 'ocr' ELSE 'vision' END AS method, count(*) AS n, CASE WHEN min(statement_id % 4) < 2 THEN 'machine-read' ELSE 'model-read' END AS class FROM {statements} WHERE checksum_ok GROUP BY 1",
    "rpt02_summary": f"""WITH t AS MATERIALIZED (SELECT * FROM ({_TIE})), h AS (SELECT * FROM t WHERE bank_total IS NOT NULL), f AS MATERIALIZED ({detectors._ALL[1:-1]}), r AS (SELECT count(*) AS transactions, count(m.txn_id) AS matched, count(decided_by) AS approved FROM {{txns}} t LEFT JOIN {{matches}} m USING (txn_id))
SELECT 'portfolio' AS section, 'buildings' AS key, count(*) AS n, NULL::BIGINT AS amount FROM t UNION ALL SELECT 'portfolio', 'reconciled', count(*), NULL FROM h UNION ALL SELECT 'portfolio', 'without a statement', (SELECT count(*) FROM t) - count(*), NULL FROM h
UNION ALL SELECT 'portfolio', 'bank', count(*), sum(bank_total)::BIGINT FROM h UNION ALL SELECT 'portfolio', 'expected', count(*), sum(expected_total)::BIGINT FROM h UNION ALL SELECT 'portfolio', 'variance', count(*), (sum(bank_total) - sum(expected_total))::BIGINT FROM h
UNION ALL SELECT 'portfolio', 'checksum failed', count(*), NULL FROM (SELECT DISTINCT ON (building_id) checksum_ok FROM {{statements}} ORDER BY building_id, period_end DESC, statement_id DESC) WHERE NOT checksum_ok
UNION ALL SELECT 'provenance', CASE statement_id % 4 WHEN 0 THEN 'text_layer, machine-read' WHEN 1 THEN 'csv, machine-read' WHEN 2 THEN 'ocr, model-read' ELSE 'vision, model-read' END, count(*), NULL FROM {{statements}} WHERE checksum_ok GROUP BY 2
UNION ALL SELECT 'findings', kind, count(*), sum(amount)::BIGINT FROM f GROUP BY 2 UNION ALL SELECT 'findings', severity, count(*), sum(amount)::BIGINT FROM f GROUP BY 2
UNION ALL SELECT 'matching', 'transactions', transactions, NULL FROM r UNION ALL SELECT 'matching', 'matched', matched, NULL FROM r UNION ALL SELECT 'matching', 'approved', approved, NULL FROM r
UNION ALL SELECT 'deadlines', 'open', count(*), NULL FROM {{leases}} l WHERE keys_on IS NOT NULL AND coalesce((SELECT -sum(amount) FROM {{ledger}} g WHERE g.lease_id = l.lease_id AND entry_type = 'refund'), 0) = 0""",
    "rpt03_continuity": """WITH g AS (SELECT *, count(*) OVER (PARTITION BY building_id) AS statements, lag(period_end) OVER w AS prior_end, lag(closing) OVER w AS c FROM {statements} WHERE checksum_ok WINDOW w AS (PARTITION BY building_id ORDER BY period_start)),
      k AS (SELECT *, 'calendar_gap' AS kind, NULL::BIGINT AS amount, CASE WHEN period_start > prior_end + 1 THEN 'no statement for ' || (prior_end + 1) || ' to ' || (period_start - 1) ELSE 'periods overlap, ' || period_start || ' to ' || prior_end END AS message FROM g WHERE period_start <> prior_end + 1 UNION ALL SELECT *, 'balance_break', opening - c, 'opening is not the prior closing' FROM g WHERE opening <> c)
      SELECT k.building_id, b.name, statements, prior_end, period_start, kind, amount, message, 'missing_statement_period:' || k.building_id || ':' || kind || ':' || period_start AS signature, k.building_id % 2 <> 0 AS is_new FROM k LEFT JOIN {buildings} b USING (building_id)""",
    "rpt04_aging": _PLACE(f"SELECT *, DATE '{AS_OF}' - coalesce(cleared_on, sent_on) AS days FROM {{custody}} WHERE in_master > 0", "days DESC NULLS LAST, custody_id", "building_id, custody_id, days, in_master", "PARTITION BY building_id"),
    "rpt05_recon": _PLACE("SELECT *, bank_balance - books_balance AS variance FROM {custody} WHERE bank_balance IS NOT NULL OR books_balance IS NOT NULL", "variance ASC NULLS LAST, custody_id", "building_id, custody_id, variance", "PARTITION BY building_id"),
    "rpt07_needs_attention": f"SELECT * FROM {_LAST} WHERE status NOT IN ('purchase', 'view')",
    "agg21_status_counts": f"SELECT status, count(*) AS files FROM {_LAST} GROUP BY 1",
    "flt09_open_findings": f"SELECT signature, severity, CASE WHEN building_id % 3 = 0 THEN 'investigating' ELSE 'open' END AS status FROM {_SIG} WHERE severity IN ('critical', 'high') AND NOT (building_id % 6 = 0)",
    "snk16_triage": f"SELECT signature, CASE WHEN {_OK} THEN \"to\" ELSE now END AS status, \"to\" IS NOT NULL AND NOT {_OK} AS refused FROM (SELECT signature, {_NOW} AS now, {_TO} AS \"to\" FROM {_SIG})",
    "int03_domains": "SELECT custody_id, 'kind' AS \"column\", 'half' AS value FROM {custody} WHERE custody_id % 100 = 0 UNION ALL SELECT custody_id, 'stage', 'lost' FROM {custody} WHERE custody_id % 150 = 0",
}.items()}
