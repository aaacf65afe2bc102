"""What a write adds or changes, as frames: appends that leave out what is stored, upserts,
partial merges and the images of a change.  ``publish`` writes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.domain import Domain, duck
from ..plans.versions import Store


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equal keys, null with null."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def insert_absent(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored, one for each key (the least row)."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    have = stored.select(*keys).distinct()
    return one.join(have, same(one, have, keys), "left_anti").select(*new.columns)


def by_content(new: DataFrame, stored: DataFrame, content: str, order: str) -> DataFrame:
    """Adds sha256 and status: a duplicate if its content is stored or an earlier row of the batch has it."""
    hashed = new.withColumn("sha256", F.sha2(F.col(content), 256))
    first = hashed.groupBy("sha256").agg(F.min(order).alias("_first")).join(stored.select("sha256", F.lit(True).alias("_stored")).distinct(), "sha256", "left")
    j = hashed.join(first, "sha256", "left")
    return j.withColumn("status", F.when(F.col("_stored") | (F.col(order) != F.col("_first")), "duplicate").otherwise("new")).drop("_first", "_stored")


def last_of(new: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row for each key: the last by ``order`` (without one the greatest), without it."""
    rest = [c for c in new.columns if c not in keys and c != order]
    row = F.struct(*rest or [F.lit(0).alias("_")])
    one = new.groupBy(*keys).agg((F.max_by(row, order) if order else F.max(row)).alias("_r"))
    return one.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in new.columns if c != order])


def upsert(new: DataFrame, stored: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """The table after the write: stored rows, those of a key in ``new`` replaced by its last
    row by ``order``, and new ones."""
    one = last_of(new, keys, order)
    return stored.join(one.select(*keys), same(stored, one, keys), "left_anti").unionByName(one)


def merge_columns(new: DataFrame, stored: DataFrame, keys: list[str], columns: list[str], seed: dict[str, Column], order: str, required: list[str] = ()) -> DataFrame:
    """The table after a partial merge: ``columns`` of stored rows come from the last row of
    their key by ``order``; a key that is not stored seeds a row, whose other columns come
    from ``seed`` (expressions over the key's first row, its columns with ``_`` before their
    names).  Rows that lack a ``required`` value are skipped."""
    for c in required:
        new = new.where(F.col(c).isNotNull())
    rest = [c for c in new.columns if c not in keys and c != order]
    row = F.struct(*rest)
    n = new.groupBy(*[F.col(c).alias(f"_{c}") for c in keys]).agg(F.min_by(row, order).alias("_first"), F.max_by(row, order).alias("_last")).select(*[f"_{c}" for c in keys], *[F.col(f"_first.{c}").alias(f"_{c}") for c in rest], "_last")
    j = stored.join(n, reduce(lambda x, y: x & y, [stored[k].eqNullSafe(n[f"_{k}"]) for k in keys]), "full_outer").withColumn("_seeded", F.coalesce(*[F.col(k) for k in keys]).isNull())
    hit = F.col("_last").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(c), F.col(f"_{c}"))
        if c in columns:
            return F.when(hit, F.col(f"_last.{c}")).otherwise(F.col(c))
        return F.when(F.col("_seeded"), seed[c]).otherwise(F.col(c)) if c in seed else F.col(c)

    return j.select(*[value(c).alias(c) for c in stored.columns])


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, action, before, after): the JSON images of rows that differ."""
    image = lambda df, n: df.select(F.col(key), F.to_json(F.struct(*sorted(df.columns))).alias(n))
    j = image(before, "before").join(image(after, "after"), key, "full_outer")
    return j.where(~F.col("before").eqNullSafe(F.col("after"))).select(key, F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE").otherwise("UPDATE").alias("action"), "before", "after")


#: What may be uploaded.
EXTENSIONS, MOST_BYTES = ("pdf", "csv", "xlsx", "xls", "docx", "txt", "png", "jpg", "jpeg"), 50 << 20


def upload_check(files: DataFrame) -> DataFrame:
    """(name, bytes) with the name that is stored and why a file is refused."""
    extension = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    return files.select("name", "bytes", F.regexp_replace("name", r"[^A-Za-z0-9._-]+", "_").alias("stored_as"), F.when(~extension.isin(*EXTENSIONS), "type").when(F.col("bytes") > MOST_BYTES, "size").alias("refused"))


def publish(frames: dict[str, DataFrame], path: str) -> None:
    """Write all frames below one staging folder, then name it in one last append, so that a
    reader who follows ``_published`` sees all of a batch or none."""
    import uuid

    batch = uuid.uuid4().hex
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{batch}/{name}")
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").json(f"{path}/_published")


def published(spark, path: str, name: str) -> DataFrame:
    """The rows of one table over all published batches."""
    batches = [r["batch"] for r in spark.read.schema("batch string").json(f"{path}/_published").collect()]  # one row a batch
    return spark.read.parquet(*[f"{path}/{b}/{name}" for b in batches])


def _custody(d: Domain) -> DataFrame:
    return d.custody.select("custody_id", "building_id", F.trim("external_ref").alias("external_ref"), "tenant", "stage", "amount", "bank_balance", "sub_last4").where("external_ref <> ''")


def _read_twice(d: Domain) -> DataFrame:
    """Balances as a statement's readers list them: some twice, the second time corrected,
    some unread, and accounts that the office does not know."""
    c = _custody(d).where("custody_id % 3 = 0")
    one = c.select("building_id", "external_ref", F.when(F.col("custody_id") % 5 != 0, F.col("amount") + 1).alias("bank_balance"), F.lit(1).alias("at"))
    two = c.where("custody_id % 2 = 0").select("building_id", "external_ref", F.when(F.col("custody_id") % 4 != 0, F.col("amount") + 2).alias("bank_balance"), F.lit(2).alias("at"))
    new = d.buildings.select("building_id", F.concat(F.lit("N"), "bbl").alias("external_ref"), F.lit(500).cast("long").alias("bank_balance"), F.lit(1).alias("at"))
    again = new.where("building_id % 2 = 0").select("building_id", "external_ref", F.lit(501).cast("long"), F.lit(2))
    return one.union(two).union(new).union(again).withColumn("sub_last4", F.substring("external_ref", -4, 4))


def _merge(d: Domain) -> DataFrame:
    seed = {"tenant": F.lit("(unnamed subaccount)"), "stage": F.lit("in_subaccount"), "amount": F.col("_bank_balance")}
    return merge_columns(_read_twice(d), _custody(d), ["building_id", "external_ref"], ["bank_balance", "sub_last4"], seed, "at", ["bank_balance"])


CUSTODY = {"custody": "custody_id long, building_id long, external_ref string, tenant string, stage string, amount long, bank_balance long, sub_last4 string", "audit": "action string, inserted long, updated long, changed long"}


def post_balances(store: Store, balances: DataFrame, batch: str) -> dict[str, int]:
    """Bank balances (building_id, external_ref, bank_balance, at) merged into the store's
    custody: stored rows take only the balance, unknown accounts seed a row; rows without an
    account or balance are skipped and counted, and the counts land in the same version."""
    seen = balances.withColumn("external_ref", F.trim("external_ref"))
    good = seen.where((F.col("external_ref") != "") & F.col("bank_balance").isNotNull())
    update = {"bank_balance": F.col("bank_balance"), "sub_last4": F.substring("external_ref", -4, 4)}
    seed = {"tenant": F.lit("(unnamed subaccount)"), "stage": F.lit("in_subaccount"), "amount": F.col("bank_balance")}
    audit = lambda n: {"audit": store.spark.createDataFrame([("post_bank_balances", n["inserted"], n["updated"], n["changed"])], CUSTODY["audit"])}
    return store.merge("custody", good, batch, "at", update, seed, audit)


def load_custody(store: Store, records: DataFrame, batch: str) -> dict[str, int]:
    """Tracker records (the table's columns and ``at``): every column of a stored row is
    replaced by its key's last record."""
    update = {c: F.col(c) for c in records.columns if c not in ("at", "building_id", "external_ref", "custody_id")}
    audit = lambda n: {"audit": store.spark.createDataFrame([("load_custody", n["inserted"], n["updated"], n["changed"])], CUSTODY["audit"])}
    return store.merge("custody", records, batch, "at", update, {"custody_id": F.col("custody_id")}, audit)


def _versions(d: Domain) -> DataFrame:
    """The tracker loaded, balances posted, the same again: the table of the last version, and
    in how many versions it took."""
    store = Store.temporary(d.spark, CUSTODY, {"custody": ("building_id", "external_ref")}, buckets=8)
    load_custody(store, _custody(d).withColumn("at", F.col("custody_id")), "load")
    for run in ("post", "again"):
        post_balances(store, _read_twice(d), run)
    totals = store.read("audit").agg(F.sum("inserted").alias("i"), F.sum("updated").alias("u")).first()
    return store.read("custody").select("*", F.lit(totals["i"]).alias("n_inserted"), F.lit(totals["u"]).alias("n_updated"), F.lit(store.version()).alias("versions"))


def _changes(d: Domain) -> DataFrame:
    c = d.custody.select("custody_id", "stage", "amount")
    after = c.where("custody_id % 5 <> 0").withColumn("amount", F.when(F.col("custody_id") % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount"))).union(d.buildings.select((-F.col("building_id") - 1).alias("custody_id"), F.lit("received"), F.lit(1).cast("long")))
    return changes(c, after, "custody_id").select("custody_id", "action", F.get_json_object("before", "$.amount").cast("long").alias("amount_before"), F.get_json_object("after", "$.amount").cast("long").alias("amount_after"))


def _absent(d: Domain) -> DataFrame:
    keys = ["building_id", "unit", "tenant", "term_start"]
    return insert_absent(d.leases.select(*keys, "lease_id"), d.leases.where("lease_id % 3 = 0").select(*keys), keys)


def _upsert(d: Domain) -> DataFrame:
    c = _custody(d).select("custody_id", "building_id", "external_ref", "amount", "stage")
    new = c.where("custody_id % 4 = 0").withColumn("stage", F.lit("closed")).withColumn("amount", F.col("amount") * 2).withColumn("at", F.lit(1))
    again = new.where("custody_id % 8 = 0").withColumn("amount", -F.col("amount")).withColumn("at", F.lit(2))
    return upsert(new.union(again), c, ["building_id", "external_ref"], "at")


def _content(d: Domain) -> DataFrame:
    docs = d.custody.select(F.col("custody_id").alias("doc_id"), F.concat_ws("|", "building_id", "unit", "kind").alias("content"))
    return by_content(docs, docs.where("doc_id % 50 = 0").select(F.sha2("content", 256).alias("sha256")), "content", "doc_id").select("doc_id", "sha256", "status")


def _uploads(d: Domain) -> DataFrame:
    i = F.col("custody_id")
    return upload_check(d.custody.select(F.concat("tenant", F.lit(" "), i.cast("string"), F.element_at(F.array(*map(F.lit, (".pdf", ".exe", ".CSV", "."))), (i % 4 + 1).cast("int"))).alias("name"), (i * 100_000).alias("bytes")))


def _q(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir))


QUERIES = {"snk02_content_dedup": _q(_content), "snk05_insert_absent": _q(_absent), "snk06_upsert": _q(_upsert), "snk07_merge_balances": _q(_merge), "snk14_versions": _q(_versions), "snk15_changes": _q(_changes), "snk17_uploads": _q(_uploads)}
_C = "(SELECT custody_id, building_id, trim(external_ref) AS external_ref, tenant, stage, amount, bank_balance, sub_last4 FROM {custody} WHERE trim(external_ref) <> '')"
_BANK = "CASE WHEN custody_id % 6 = 0 AND custody_id % 4 <> 0 THEN amount + 2 WHEN custody_id % 3 = 0 AND custody_id % 5 <> 0 THEN amount + 1 ELSE bank_balance END"
_AFTER = f"SELECT custody_id, building_id, external_ref, tenant, stage, amount, {_BANK} AS bank_balance, CASE WHEN custody_id % 3 = 0 AND (custody_id % 5 <> 0 OR custody_id % 2 = 0 AND custody_id % 4 <> 0) THEN right(external_ref, 4) ELSE sub_last4 END AS sub_last4 FROM {_C} UNION ALL SELECT NULL, building_id, 'N' || bbl, '(unnamed subaccount)', 'in_subaccount', 500, 500 + (building_id + 1) % 2, right('N' || bbl, 4) FROM {{buildings}}"
ORACLE = {k: duck(v) for k, v in {
    "snk02_content_dedup": "SELECT doc_id, sha256(c) AS sha256, CASE WHEN c IN (SELECT building_id || '|' || unit || '|' || kind FROM {custody} WHERE custody_id % 50 = 0) OR row_number() OVER (PARTITION BY c ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'new' END AS status FROM (SELECT custody_id AS doc_id, building_id || '|' || unit || '|' || kind AS c FROM {custody})",
    "snk05_insert_absent": "SELECT building_id, unit, tenant, term_start, min(lease_id) AS lease_id FROM {leases} GROUP BY ALL HAVING count(*) FILTER (WHERE lease_id % 3 = 0) = 0",
    "snk06_upsert": f"SELECT custody_id, building_id, external_ref, CASE WHEN custody_id % 8 = 0 THEN amount * -2 WHEN custody_id % 4 = 0 THEN amount * 2 ELSE amount END AS amount, CASE WHEN custody_id % 4 = 0 THEN 'closed' ELSE stage END AS stage FROM {_C}",
    "snk07_merge_balances": _AFTER,
    "snk14_versions": f"SELECT x.*, n_inserted, n_updated, 2 AS versions FROM ({_AFTER}) x, (SELECT count(*) + (SELECT count(*) FROM {{buildings}}) AS n_inserted, count(*) FILTER (WHERE custody_id % 3 = 0 AND custody_id % 5 <> 0) + count(*) FILTER (WHERE custody_id % 6 = 0 AND custody_id % 4 <> 0) + (SELECT count(*) FROM {{buildings}} WHERE building_id % 2 = 0) AS n_updated FROM {_C})",
    "snk15_changes": "SELECT custody_id, CASE WHEN custody_id % 5 = 0 THEN 'DELETE' ELSE 'UPDATE' END AS action, amount AS amount_before, CASE WHEN custody_id % 5 <> 0 THEN amount + 1 END AS amount_after FROM {custody} WHERE custody_id % 5 = 0 OR custody_id % 7 = 0 UNION ALL SELECT -building_id - 1, 'INSERT', NULL, 1 FROM {buildings}",
    "snk17_uploads": "SELECT name, bytes, regexp_replace(name, '[^A-Za-z0-9._-]+', '_', 'g') AS stored_as, CASE WHEN i % 4 IN (1, 3) THEN 'type' WHEN bytes > 52428800 THEN 'size' END AS refused FROM (SELECT custody_id AS i, tenant || ' ' || custody_id || CASE custody_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.exe' WHEN 2 THEN '.CSV' ELSE '.' END AS name, custody_id * 100000 AS bytes FROM {custody})",
}.items()}
