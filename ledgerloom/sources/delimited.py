"""Delimited files and journals: columns are mapped by name, values are read as text and
every row keeps its problem or its notes instead of stopping the load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as tx
from ..functions.money import format_cents, to_cents
from ..plans.domain import Domain, duck


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Text columns by header name, blank lines left out, values trimmed."""
    return spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_tree(spark: SparkSession, path: str, extensions: tuple[str, ...]) -> DataFrame:
    """Files below a folder with one of the extensions, in any case, dot entries left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions) & ~F.col("path").rlike(r"/\.[^/]*(/|$)")).orderBy("path")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal lines (path, status, ordinal); torn lines are left out."""
    rows = spark.read.schema("path string, status string, ordinal long, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt_record IS NULL AND path IS NOT NULL").drop("_corrupt_record")


def text_of(rows: DataFrame, name: str | None) -> Column:
    return F.btrim(F.coalesce(F.col(name).cast("string"), F.lit(""))) if name else F.lit("")


def optional_cents(text: Column, blank: int | None = 0) -> Column:
    """Cents where a value may be missing: as 0, or as null (then also for what is pending)."""
    t = F.lower(F.btrim(F.coalesce(text, F.lit(""))))
    none = [x for x in dates.NO_DATE if blank is None or x not in ("pending", "tbd")]
    return F.when(t.isin(*none), F.lit(blank).cast("long")).otherwise(to_cents(text))


def bank_rows(rows: DataFrame, columns: dict[str, str], iso: bool = False) -> DataFrame:
    """Transactions of a bank's export; rows without a date or an amount are none."""
    c = {k: text_of(rows, columns.get(k)) for k in ("date", "amount", "debit", "credit", "description", "check")}
    day = F.try_to_date(c["date"], "yyyy-MM-dd") if iso else dates.us_date(c["date"])
    both = (c["debit"] != "") & (c["credit"] != "")
    pair = F.when(~both, F.when(c["credit"] != "", F.abs(to_cents(c["credit"]))).when(c["debit"] != "", -F.abs(to_cents(c["debit"]))))
    amount = to_cents(c["amount"]) if "amount" in columns else pair
    given = c["amount"] != "" if "amount" in columns else F.concat(c["debit"], c["credit"]) != ""
    problem = F.when(day.isNull(), "unparseable date")
    if "amount" not in columns:
        problem = F.when(both, "debit and credit in one row").otherwise(problem)
    keep = [x for x in rows.columns if x not in columns.values()]
    return rows.where((c["date"] != "") & given).select(*keep, day.alias("posted_on"), amount.alias("amount"), F.regexp_replace(c["description"], r"\s{2,}", " ").alias("descriptor"), F.nullif(c["check"], F.lit("")).alias("check_no"), problem.alias("problem"))


def period(transactions: DataFrame, key: str) -> DataFrame:
    return transactions.groupBy(key).agg(F.min("posted_on").alias("period_start"), F.max("posted_on").alias("period_end"))


def _first(*cases: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), m) for c, m in cases])


def lease_rows(rows: DataFrame, m: dict[str, str]) -> DataFrame:
    """A rent roll's rows: the record, its problem (then it is no record) and notes."""
    t = lambda k: text_of(rows, m.get(k))
    day = lambda k: dates.opt_date(t(k))
    rent, deposit = to_cents(t("rent")), to_cents(t("deposit"))
    problem = _first(((t("building") == "") | (t("unit") == "") | (t("tenant") == ""), "missing building, unit, or tenant"), (day("term_start").isNull(), "missing term start"), (F.coalesce(rent, F.lit(0)) <= 0, "monthly rent must be positive"), (F.coalesce(deposit, F.lit(0)) <= 0, "expected deposit must be positive"))
    notes = F.array_compact(F.array(F.when(deposit > rent, "deposit exceeds one month rent"), F.when(day("keys_on") < day("vacated_on"), "keys returned before vacate date")))
    keep = [x for x in rows.columns if x not in m.values()]
    return rows.select(*keep, t("building").alias("building"), t("unit").alias("unit"), t("tenant").alias("tenant"), day("term_start").alias("term_start"), day("vacated_on").alias("vacated_on"), day("keys_on").alias("keys_on"), rent.alias("rent"), deposit.alias("deposit"), tx.truthy(t("stabilized")).alias("stabilized"), problem.alias("problem"), F.when(problem.isNull(), F.concat_ws("; ", notes)).otherwise("").alias("notes"))


#: Further columns of a custody tracker: days and texts.
TRACKED_DAYS = ("cleared_on", "sub_opened_on", "allocated_on", "balance_as_of", "vacate_on", "bank_closed_on", "returned_on", "refunded_on")
TRACKED_TEXTS = ("external_ref", "sub_last4", "employee", "next_action", "final_status")


def custody_rows(rows: DataFrame, m: dict[str, str]) -> DataFrame:
    """A custody tracker's rows, as above.  Days, texts and amounts that the mapping lacks or the
    file leaves blank are null; an amount that cannot be read is a problem."""
    t = lambda k: text_of(rows, m.get(k))
    day = lambda k: dates.opt_date(t(k))
    amount, pooled = to_cents(t("amount")), optional_cents(t("in_master"))
    balances = {k: optional_cents(t(k), None) for k in ("bank_balance", "books_balance")}
    paid = {k: F.when(t(k) != "", optional_cents(t(k))) for k in ("returned_amount", "refunded_amount")}
    unread = [(v.isNull() & ~F.lower(t(k)).isin(*(dates.NO_DATE if k in balances else ("",))), f"{k} cannot be read") for k, v in (balances | paid).items()]
    problem = _first(((t("building") == "") | (t("unit") == "") | (t("tenant") == ""), "missing building, unit, or tenant"), (F.coalesce(amount, F.lit(0)) <= 0, "deposit amount must be positive"), (pooled.isNull(), "in_master cannot be read"), (pooled < 0, "in-master amount cannot be negative"), *unread)
    notes = F.array_compact(F.array(F.when(pooled > amount, "in-master exceeds the deposit"), F.when(day("sent_on") < day("received_on"), "sent to bank before received")))
    keep = [x for x in rows.columns if x not in m.values()]
    return rows.select(*keep, t("building").alias("building"), t("unit").alias("unit"), t("tenant").alias("tenant"), tx.norm_kind(t("kind")).alias("kind"), amount.alias("amount"), day("received_on").alias("received_on"), day("sent_on").alias("sent_on"), pooled.alias("in_master"), tx.norm_stage(t("stage")).alias("stage"), *[v.alias(k) for k, v in balances.items()], *[day(k).alias(k) for k in TRACKED_DAYS], *[F.nullif(t(k), F.lit("")).alias(k) for k in TRACKED_TEXTS], *[v.alias(k) for k, v in paid.items()], problem.alias("problem"), F.when(problem.isNull(), F.concat_ws("; ", notes)).otherwise("").alias("notes"))


def resolved(rows: DataFrame, buildings: DataFrame, column: str = "building") -> DataFrame:
    """building_id of each row by lower-cased name, else by lot number: one table of keys, two probes."""
    keys = buildings.select(F.explode(F.array_distinct(F.array(F.lower("name"), F.col("bbl")))).alias("k"), "building_id").groupBy("k").agg(F.max("building_id").alias("i"))
    a, b = (keys.select(F.col("k").alias(f"_{s}"), F.col("i").alias(f"_i{s}")) for s in "ab")
    j = rows.join(a, F.lower(column) == F.col("_a"), "left").join(b, F.col(column) == F.col("_b"), "left")
    return j.withColumn("building_id", F.coalesce("_ia", "_ib")).drop("_a", "_b", "_ia", "_ib")


def _bank(d: Domain) -> DataFrame:
    """Exports of three kinds of row, written from the domain."""
    i = F.col("txn_id")
    day = F.when(i % 13 == 0, F.lit(" ")).when(i % 11 == 0, "soon").otherwise(F.date_format("posted_on", "M/d/yyyy"))
    shown = lambda on: F.when(on, format_cents(F.abs("amount"))).otherwise("")
    raw = d.txns.select("txn_id", day.alias("Date"), shown((F.col("amount") < 0) | (i % 17 == 0)).alias("Debit"), shown((F.col("amount") > 0) & (i % 19 != 0)).alias("Credit"), F.concat(F.lit(" "), F.replace("descriptor", F.lit(" "), F.lit("   "))).alias("Memo"))
    return bank_rows(raw, {"date": "Date", "debit": "Debit", "credit": "Credit", "description": "Memo"}).drop("check_no")


def _leases(d: Domain) -> DataFrame:
    i = F.col("lease_id")
    day = lambda c, f: F.coalesce(F.date_format(c, f), F.lit("n/a"))
    raw = d.leases.join(d.buildings.select("building_id", "name", "bbl"), "building_id").select("lease_id", F.when(i % 2 == 0, F.initcap("name")).when(i % 5 == 0, F.lit("nowhere")).otherwise(F.col("bbl")).alias("Bldg"), F.when(i % 41 == 0, "").otherwise(F.col("unit")).alias("Unit"), F.col("tenant").alias("Tenant"), F.when(i % 43 == 0, "TBD").otherwise(day("term_start", "M/d/yyyy")).alias("Start"), day("vacated_on", "yyyy-MM-dd").alias("Out"), F.coalesce(F.date_format(F.date_sub("keys_on", 20), "M-d-yyyy"), F.lit("-")).alias("Keys"), F.when(i % 47 == 0, "0").otherwise(format_cents(F.col("rent"))).alias("Rent"), format_cents(F.col("deposit")).alias("Deposit"), F.when(F.col("stabilized"), "RS").otherwise("no").alias("RS"))
    out = lease_rows(raw, {"building": "Bldg", "unit": "Unit", "tenant": "Tenant", "term_start": "Start", "vacated_on": "Out", "keys_on": "Keys", "rent": "Rent", "deposit": "Deposit", "stabilized": "RS"})
    return resolved(out, d.buildings).select("lease_id", "building_id", "unit", "term_start", "vacated_on", "keys_on", "rent", "deposit", "stabilized", "problem", "notes")


def _custody(d: Domain) -> DataFrame:
    i = F.col("custody_id")
    raw = d.custody.select("custody_id", F.col("building_id").cast("string").alias("B"), F.col("unit").alias("U"), F.col("tenant").alias("T"), F.when(F.col("kind") == "additional", "Top-up").otherwise("first").alias("K"), F.when(i % 31 == 0, "(5.00)").otherwise(format_cents(F.col("amount"))).alias("A"), F.date_format("received_on", "M/d/yyyy").alias("R"), F.coalesce(F.date_format(F.date_sub("sent_on", 2), "yyyy-MM-dd"), F.lit("pending")).alias("S"), F.when(i % 29 == 0, "-1.00").when(F.col("in_master") == 0, "n/a").otherwise(format_cents(F.col("in_master") + 1)).alias("M"), F.when(F.col("stage") == "in_master", " In Master Account").otherwise(F.upper("stage")).alias("G"), F.coalesce(format_cents(F.col("bank_balance")), F.lit("tbd")).alias("X"), F.coalesce(format_cents(F.col("books_balance")), F.lit("-")).alias("Y"), F.coalesce(format_cents(F.col("returned_amount")), F.lit("")).alias("Z"), *[F.coalesce(F.date_format(k, "M/d/yyyy"), F.lit("n/a")).alias(f"D_{k}") for k in TRACKED_DAYS if k in d.custody.columns], "external_ref", "sub_last4")
    return custody_rows(raw, {"building": "B", "unit": "U", "tenant": "T", "kind": "K", "amount": "A", "received_on": "R", "sent_on": "S", "in_master": "M", "stage": "G", "bank_balance": "X", "books_balance": "Y", "returned_amount": "Z", "external_ref": "external_ref", "sub_last4": "sub_last4"} | {k: f"D_{k}" for k in TRACKED_DAYS if k in d.custody.columns}).drop("unit", "tenant", "building")


def _q(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir))


QUERIES = {"src05_bank_csv": _q(_bank), "src06_rent_roll": _q(_leases), "src07_custody_tracker": _q(_custody), "agg20_csv_period": _q(lambda d: period(_bank(d).where("problem IS NULL").join(d.txns.select("txn_id", "building_id"), "txn_id"), "building_id"))}
_BANK = "(SELECT txn_id, building_id, CASE WHEN txn_id % 11 <> 0 THEN posted_on END AS posted_on, CASE WHEN amount < 0 THEN amount WHEN txn_id % 17 = 0 AND txn_id % 19 = 0 THEN -amount WHEN txn_id % 17 <> 0 THEN amount END AS amount, regexp_replace(descriptor, '\\s+', ' ', 'g') AS descriptor, CASE WHEN amount > 0 AND txn_id % 17 = 0 AND txn_id % 19 <> 0 THEN 'debit and credit in one row' WHEN txn_id % 11 = 0 THEN 'unparseable date' END AS problem FROM {txns} WHERE txn_id % 13 <> 0 AND (amount < 0 OR txn_id % 17 = 0 OR txn_id % 19 <> 0))"
_P = "CASE WHEN lease_id % 41 = 0 THEN 'missing building, unit, or tenant' WHEN lease_id % 43 = 0 THEN 'missing term start' WHEN lease_id % 47 = 0 THEN 'monthly rent must be positive' END"
_PC = "CASE WHEN custody_id % 31 = 0 THEN 'deposit amount must be positive' WHEN custody_id % 29 = 0 THEN 'in-master amount cannot be negative' END"
ORACLE = {k: duck(v) for k, v in {
    "src05_bank_csv": f"SELECT txn_id, posted_on, amount, descriptor, problem FROM {_BANK}",
    "agg20_csv_period": f"SELECT building_id, min(posted_on) AS period_start, max(posted_on) AS period_end FROM {_BANK} WHERE problem IS NULL GROUP BY 1",
    "src06_rent_roll": f"SELECT lease_id, CASE WHEN lease_id % 2 = 0 OR lease_id % 5 <> 0 THEN building_id END AS building_id, CASE WHEN lease_id % 41 = 0 THEN '' ELSE unit END AS unit, CASE WHEN lease_id % 43 <> 0 THEN term_start END AS term_start, vacated_on, keys_on - 20 AS keys_on, CASE WHEN lease_id % 47 = 0 THEN 0 ELSE rent END AS rent, deposit, stabilized, {_P} AS problem, CASE WHEN {_P} IS NULL THEN concat_ws('; ', CASE WHEN deposit > rent THEN 'deposit exceeds one month rent' END, CASE WHEN keys_on - 20 < vacated_on THEN 'keys returned before vacate date' END) ELSE '' END AS notes FROM {{leases}}",
    "src07_custody_tracker": f"SELECT custody_id, kind, CASE WHEN custody_id % 31 = 0 THEN -500 ELSE amount END AS amount, received_on, sent_on - 2 AS sent_on, CASE WHEN custody_id % 29 = 0 THEN -100 WHEN in_master = 0 THEN 0 ELSE in_master + 1 END AS in_master, stage, bank_balance, books_balance, cleared_on, sub_opened_on, NULL::DATE AS allocated_on, NULL::DATE AS balance_as_of, vacate_on, bank_closed_on, returned_on, refunded_on, nullif(trim(external_ref), '') AS external_ref, nullif(sub_last4, '') AS sub_last4, NULL::VARCHAR AS employee, NULL::VARCHAR AS next_action, NULL::VARCHAR AS final_status, returned_amount, NULL::BIGINT AS refunded_amount, {_PC} AS problem, CASE WHEN {_PC} IS NULL THEN concat_ws('; ', CASE WHEN in_master > 0 THEN 'in-master exceeds the deposit' END, CASE WHEN sent_on - 2 < received_on THEN 'sent to bank before received' END) ELSE '' END AS notes FROM {{custody}}",
}.items()}
