"""A backfill over a tree of files that can be stopped anywhere and run again, seeds, and
findings that are kept up to date by changes.

The journal is lines of JSON in files that are only added to.  Which line of a path is the
last follows from where it stands: file, start of the block that a task read, and the line's
number in the task; no line carries a number of its own, and a torn one is skipped.

Edge cases: a path that is in the journal twice has its last line; a file whose folder is in
no route is an error, never guessed; a crash after a batch has landed and before its
outcomes are written makes its documents duplicates in the next run, which is a success.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.domain import AS_OF, Domain, duck
from ..plans.shared import write_once
from ..plans.versions import Store
from . import custody as cus
from . import deadlines
from .gates import backfill_plan
from .ingest import ingest

LINE = "path string, status string, message string, at timestamp"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Journal lines (path, status, message, at, ordinal) in the order of their files."""
    m = F.col("_metadata")
    rows = spark.read.option("recursiveFileLookup", True).text(path).select("value", F.struct(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("line")).alias("ordinal"))
    parsed = rows.select(F.from_json("value", LINE).alias("r"), "ordinal")
    return parsed.select("r.*", "ordinal").where("path IS NOT NULL AND status IS NOT NULL")


class Journal:
    """A folder of journal files, one subfolder for each run that wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._at)) if self._fs.exists(self._at) else []

    def lines(self) -> DataFrame:
        if self.runs():
            return read_lines(self.spark, self.path)
        return self.spark.createDataFrame([], f"{LINE}, ordinal struct<file: string, block: long, line: long>")

    def append(self, outcomes: DataFrame) -> None:
        """One line for each outcome (path, status, message), after all that is there."""
        last = max((int(n[4:]) for n in self.runs() if n.startswith("run-")), default=0)
        outcomes.select("path", "status", "message", F.current_timestamp().alias("at")).write.json(f"{self.path}/run-{last + 1:06d}")


def folder_of(path: Column) -> Column:
    """The name of the folder that a file lies in."""
    return F.coalesce(F.get(F.reverse(F.split(path, r"[\\/]")), 1), F.lit(""))


def backfill(store: Store, journal: Journal, files: DataFrame, pages: DataFrame, accounts: DataFrame, routes: DataFrame, retry: bool = True, actor: str = "backfill") -> DataFrame:
    """Outcomes (path, status, message) of the files (doc_id, filename, path, byte_size,
    sha256) that were decided in this run: those that have landed before, or with ``retry``
    off have been seen before, are left alone; ``routes`` maps folders to accounts."""
    past = journal.lines()
    named = files.drop("account_id").withColumn("dir", folder_of(F.col("path")))
    plan = backfill_plan(named.select("path", "dir"), past, routes, retry).select("path", "account_id", "action")
    todo = named.join(plan.where("action = 'ingest'"), "path").select("doc_id", "filename", "path", "account_id", "byte_size", "sha256")
    out = ingest(store, todo, pages.join(todo.select("doc_id"), "doc_id", "left_semi"), accounts, actor, run=str(len(journal.runs())))
    done = todo.select("doc_id", "path").join(out, "doc_id").select("path", "status", F.coalesce("message", F.lit("")).alias("message"))
    lost = plan.where("action = 'error_unroutable'").select("path", F.lit("errored").alias("status"), F.lit("no account for this folder").alias("message"))
    decided = done.unionByName(lost)
    if not decided.isEmpty():
        journal.append(decided)
        return read_lines(journal.spark, f"{journal.path}/{journal.runs()[-1]}").select("path", "status", "message")
    return decided


# --- seeds ---------------------------------------------------------------------------

SEEDS = {
    "buildings": "name string, address string, borough string, bbl string, unit_count int, acquired_on date, interest_required boolean",
    "accounts": "building string, bank_name string, last4 string, account_type string, interest_bearing boolean, opened_on date",
    "audit": "action string, table_name string, inserted long, skipped long, unresolved array<string>",
}
KEYS = {"buildings": ("name",), "accounts": ("building", "last4", "account_type")}
#: Fixed value: units from which a building owes interest.
INTEREST_UNITS = 6


def seed(store: Store, buildings: DataFrame, accounts: DataFrame, batch: str) -> dict[str, dict]:
    """Buildings by exact name and accounts by building, number and type, where they are not
    there yet; accounts of unknown buildings are reported.  Rows are CSV text by column name;
    of rows with one key the first counts (by ``at``, the line's number)."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    day = lambda c: F.try_to_date(blank(c), "yyyy-MM-dd")
    b = buildings.select("name", "address", blank("borough").alias("borough"), blank("bbl").alias("bbl"), F.col("unit_count").try_cast("int").alias("unit_count"), day("acquired_on").alias("acquired_on"), "at").withColumn("interest_required", F.coalesce(F.col("unit_count") >= INTEREST_UNITS, F.lit(False)))
    n_buildings, n_accounts = b.count(), 0
    audit = lambda table, n, total, lost: {"audit": store.spark.createDataFrame([("seed", table, n["inserted"], total - n["inserted"], lost)], SEEDS["audit"])}
    new = {c: F.col(c) for c in b.columns if c not in ("name", "at")}
    out = {"buildings": store.merge("buildings", b, f"{batch}-buildings", "at", {}, new, lambda n: audit("buildings", n, n_buildings, []))}
    known = store.read("buildings").groupBy(F.lower(F.trim("name")).alias("k")).agg(F.min("name").alias("building"))
    j = accounts.withColumn("k", F.lower(F.trim("building_name"))).join(known, "k", "left")
    lost = [r["building_name"] for r in j.where("building IS NULL").select("building_name").distinct().orderBy("building_name").collect()]  # names of a file edited by hand
    a = j.where("building IS NOT NULL").select("building", "bank_name", F.col("account_last4").alias("last4"), "account_type", tx.truthy(F.col("is_interest_bearing"), True).alias("interest_bearing"), day("opened_on").alias("opened_on"), "at")
    n_accounts = a.count()
    new = {c: F.col(c) for c in ("bank_name", "interest_bearing", "opened_on")}
    out["accounts"] = store.merge("accounts", a, f"{batch}-accounts", "at", {}, new, lambda n: audit("accounts", n, n_accounts, lost)) | {"unresolved": lost}
    return out


def _seeded(d: Domain) -> DataFrame:
    """Buildings and accounts seeded twice; of the second run nothing is new."""
    store = Store.temporary(d.spark, SEEDS, KEYS, buckets=4)
    b = d.buildings.select("name", F.lit("a").alias("address"), F.lit(" ").alias("borough"), "bbl", F.col("unit_count").cast("string").alias("unit_count"), F.lit("2001-02-30").alias("acquired_on"), F.col("building_id").alias("at"))
    a = d.accounts.join(d.buildings.select("building_id", "name"), "building_id").select(F.when(F.col("building_id") % 5 == 0, "nobody").otherwise(F.concat(F.lit(" "), F.lower("name"))).alias("building_name"), "bank_name", F.col("last4").alias("account_last4"), "account_type", F.when(F.col("interest_bearing"), "Yes").otherwise("n").alias("is_interest_bearing"), F.lit("").alias("opened_on"), F.col("account_id").alias("at"))
    for run in ("one", "two"):
        seed(store, b, a.union(a), run)
    n = store.read("accounts").groupBy("building").agg(F.count("*").alias("accounts"), F.sum(F.col("interest_bearing").cast("long")).alias("bearing"))
    return store.read("buildings").join(n, F.col("name") == F.col("building"), "left").select("name", "bbl", "unit_count", "interest_required", F.coalesce("accounts", F.lit(0)).alias("accounts"), F.coalesce("bearing", F.lit(0)).alias("bearing"))


# --- findings and totals kept up to date ------------------------------------------------

KEPT = {
    "findings": "signature string, custody_id long, kind string, severity string, building_id long, amount long, detail string, status string",
    "totals": "building_id long, deposits long, held long, bank long",
}
KEPT_KEYS = {"findings": ("signature", "custody_id"), "totals": ("building_id",)}


def maintain(store: Store, before: DataFrame, after: DataFrame, as_of: Column, batch: str) -> dict[str, dict[str, int]]:
    """Bring lifecycle findings and building totals up to date from the changed rows of the
    custody table alone: their images before (none for inserts) and after (none for deletes).

    Findings of a changed row are made again: those that hold are open, those that were open and
    hold no more are closed.  Totals take the difference of the images' sums."""
    found = cus.all_findings(after, as_of).withColumn("status", F.lit("open"))
    touched = before.select("custody_id").union(after.select("custody_id")).distinct()
    gone = store.read("findings").where("status = 'open'").join(touched, "custody_id", "left_semi").join(found.select("signature", "custody_id"), ["signature", "custody_id"], "left_anti").withColumn("status", F.lit("closed"))
    rows = write_once(found.unionByName(gone).withColumn("_at", F.xxhash64("severity", "building_id", "amount", "detail")))  # the merge reads it twice
    columns = ("kind", "severity", "building_id", "amount", "detail", "status")
    out = {"findings": store.merge("findings", rows, f"{batch}-findings", "_at", {c: F.col(c) for c in columns})}
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    image = lambda df, sign: df.select("building_id", F.lit(sign).alias("n"), *[(sign * z(F.col(c))).alias(c) for c in ("amount", "bank_balance")])
    delta = image(before, -1).union(image(after, 1)).groupBy("building_id").agg(F.sum("n").alias("deposits"), F.sum("amount").alias("held"), F.sum("bank_balance").alias("bank"))
    old = store.read("totals").select("building_id", *[F.col(c).alias(f"_{c}") for c in ("deposits", "held", "bank")])
    now = delta.join(old, delta["building_id"].eqNullSafe(old["building_id"]), "left").select(delta["building_id"], *[(z(F.col(f"_{c}")) + F.col(c)).alias(c) for c in ("deposits", "held", "bank")], F.lit(0).alias("_at"))
    out["totals"] = store.merge("totals", now, f"{batch}-totals", "_at", {c: F.col(c) for c in ("deposits", "held", "bank")})
    return out


def images(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``old`` that are not in ``new`` and those of ``new`` that are not in ``old``,
    each as often as it is there more often: one shuffle and one table for both."""
    names = [F.col(c) for c in new.columns]
    both = old.withColumn("_n", F.lit(-1)).unionByName(new.withColumn("_n", F.lit(1))).repartition("custody_id")
    differ = write_once(both.groupBy(*names).agg(F.sum("_n").alias("_n")).where("_n <> 0"))
    side = lambda sign: differ.where(sign * F.col("_n") > 0).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), sign * F.col("_n")))).drop("_n")
    return side(-1), side(1)


def _moved(c: DataFrame, step: int) -> DataFrame:
    """The custody table after some days' edits: rows that go, are refunded, or are pooled."""
    i = F.col("custody_id")
    return c.where(i % (11 + step) != 0).withColumn("refunded_on", F.when(i % (5 + step) == 0, F.lit(AS_OF).cast("date")).otherwise(F.col("refunded_on"))).withColumn("in_master", F.when(i % (7 + step) == 0, F.col("amount")).otherwise(F.col("in_master")))


def _kept(d: Domain) -> DataFrame:
    """Open findings and totals after two rounds of edits, each brought in by its changes only."""
    store = Store.temporary(d.spark, KEPT, KEPT_KEYS, buckets=8)
    state = d.custody.limit(0)
    for k, after in enumerate((d.custody, _moved(d.custody, 0), _moved(d.custody, 2))):
        maintain(store, *images(state, after), F.lit(AS_OF).cast("date"), f"day{k}")
        state = after
    f = store.read("findings").where("status = 'open'").groupBy("building_id", "kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    return f.join(store.read("totals"), "building_id")


# --- lookups and listings ---------------------------------------------------------------

#: Rows that the listing of uploads and a page of custody show.
NEWEST, PAGE = 100, 50


def newest(rows: DataFrame, at: str, key: str, most: int = NEWEST) -> DataFrame:
    """The newest rows; of one time those of the greater key.  A heap in each task."""
    return rows.orderBy(F.desc(at), F.desc(key)).limit(most)


def page_after(rows: DataFrame, at: str, key: str, last: tuple | None, most: int = PAGE) -> DataFrame:
    """The next page in the order of ``newest``, after the (at, key) that ended the one before,
    without counting over what earlier pages have shown.  Rows without a time come last."""
    if last is not None:
        a, k = (F.lit(x) for x in last)
        rows = rows.where((F.col(at).isNull() & (F.lit(last[0] is not None) | (F.col(key) < k))) | ((F.col(at) < a) | ((F.col(at) == a) & (F.col(key) < k)))) if last[0] is not None else rows.where(F.col(at).isNull() & (F.col(key) < k))
    return rows.orderBy(F.desc_nulls_last(at), F.desc(key)).limit(most)


def embedded(txns: DataFrame, accounts: DataFrame, buildings: DataFrame) -> DataFrame:
    """Transactions with their account's and building's names; those without an account stay."""
    a = accounts.select("account_id", F.col("building_id").alias("home"), "bank_name", "last4")
    b = buildings.select(F.col("building_id").alias("home"), F.col("name").alias("building"))
    return txns.join(a, "account_id", "left").join(b, "home", "left")


def _embedded(d: Domain) -> DataFrame:
    per = d.accounts.groupBy("building_id").agg(F.min("account_id").alias("account_id"))
    t = d.txns.join(per, "building_id", "left").select("txn_id", "amount", F.when(F.col("txn_id") % 3 != 0, F.col("account_id")).alias("account_id"))
    return embedded(t, d.accounts, d.buildings).select("txn_id", "amount", "account_id", "bank_name", "last4", "building")


def _paged(d: Domain) -> DataFrame:
    """The second page of the custody listing, with the buildings' names."""
    c = d.custody.select("custody_id", "building_id", "tenant", "received_on", "amount")
    end = page_after(c, "received_on", "custody_id", None).orderBy("received_on", "custody_id").first()
    two = page_after(c, "received_on", "custody_id", (end["received_on"], end["custody_id"]))
    return two.join(d.buildings.select("building_id", "name"), "building_id", "left")


def urgent_first(stages: DataFrame) -> DataFrame:
    """Due stages in the order in which they are sent, most urgent first, then by lease and
    stage; ``place`` counts within a day."""
    within = Window.partitionBy("days_left").orderBy("lease_id", "ordinal")
    return stages.withColumn("place", F.row_number().over(within)).orderBy("days_left", "lease_id", "ordinal")


def _urgent(d: Domain) -> DataFrame:
    none = d.leases.limit(0).select("lease_id", F.lit("").alias("stage"))
    return urgent_first(deadlines.due_stages(deadlines.open_deadlines(d.leases, d.ledger), none, F.lit(AS_OF).cast("date")))


def _q(f, prepared: bool = False):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir, prepared))


QUERIES = {
    "snk08_seeds": _q(_seeded),
    "inc01_kept_findings": _q(_kept, True),
    "jn06_embedded": _q(_embedded),
    "srt03_urgent_first": _q(lambda d: _urgent(d).select("place", "lease_id", "stage", "days_left")),
    "srt09_newest": _q(lambda d: newest(d.leases.select("lease_id", "tenant", "signed_on"), "signed_on", "lease_id")),
    "srt10_page": _q(_paged),
}
_MOVED = "(SELECT * REPLACE (CASE WHEN custody_id % 7 = 0 THEN DATE '{day}' ELSE refunded_on END AS refunded_on, CASE WHEN custody_id % 9 = 0 THEN amount ELSE in_master END AS in_master) FROM {custody} WHERE custody_id % 13 <> 0)".replace("{day}", AS_OF)
ORACLE = {k: duck(v) for k, v in {
    "snk08_seeds": "SELECT name, bbl, unit_count::INT AS unit_count, interest_required, coalesce(n, 0) AS accounts, coalesce(y, 0) AS bearing FROM {buildings} b LEFT JOIN (SELECT building_id, count(*) AS n, sum(interest_bearing::INT)::BIGINT AS y FROM (SELECT building_id, last4, account_type, arg_min(interest_bearing, account_id) AS interest_bearing FROM {accounts} WHERE building_id % 5 <> 0 GROUP BY ALL) GROUP BY 1) a USING (building_id)",
    "inc01_kept_findings": f"SELECT f.building_id, kind, count(*) AS n, sum(amount)::BIGINT AS amount, any_value(deposits) AS deposits, any_value(held) AS held, any_value(bank) AS bank FROM ({' UNION ALL '.join(cus._SQL.values()).replace('{custody}', _MOVED)}) f JOIN (SELECT building_id, count(*) AS deposits, sum(amount)::BIGINT AS held, sum(coalesce(bank_balance, 0))::BIGINT AS bank FROM {_MOVED} GROUP BY 1) t ON t.building_id = f.building_id GROUP BY ALL",
    "jn06_embedded": "SELECT txn_id, amount, x.account_id, bank_name, last4, b.name AS building FROM (SELECT txn_id, amount, CASE WHEN txn_id % 3 <> 0 THEN (SELECT min(account_id) FROM {accounts} a WHERE a.building_id = t.building_id) END AS account_id FROM {txns} t) x LEFT JOIN {accounts} a ON a.account_id = x.account_id LEFT JOIN {buildings} b ON b.building_id = a.building_id",
    "srt03_urgent_first": f"SELECT row_number() OVER (PARTITION BY days_left ORDER BY lease_id, n)::INT AS place, lease_id, stage, days_left FROM (SELECT lease_id, v.stage, v.n, (keys_on + 14 - DATE '{AS_OF}')::INT AS days_left FROM {{leases}} l JOIN (VALUES ('day7', 7), ('day10', 10), ('day14', 14), ('overdue', 15)) v(stage, n) ON DATE '{AS_OF}' - keys_on >= v.n WHERE coalesce((SELECT -sum(amount) FROM {{ledger}} g WHERE g.lease_id = l.lease_id AND entry_type = 'refund'), 0) = 0)",
    "srt09_newest": f"SELECT lease_id, tenant, signed_on FROM {{leases}} ORDER BY signed_on DESC, lease_id DESC LIMIT {NEWEST}",
    "srt10_page": f"SELECT custody_id, c.building_id, tenant, received_on, amount, name FROM {{custody}} c LEFT JOIN {{buildings}} b USING (building_id) ORDER BY received_on DESC, custody_id DESC LIMIT {PAGE} OFFSET {PAGE}",
}.items()}
