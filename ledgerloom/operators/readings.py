"""Scanned documents read several times: what the readers agree on, and what becomes of it.

``reads`` has (doc_id, reader, page_no, text), readers numbered from 1; doc_id is not negative.
Every read goes through the extract driver as a document of its own; rows, printed totals and
counts, and activity boxes then count only as far as two readers give the same value.

A document's bank is that of its first reader who tells one; it is by tenant if that bank
reports by account, or if any of its reads has the building sections of a landlord's detail.
A read without them gives no rows, and so no votes.  Its report date and its labels are those
of the first reader who has any: the buildings of its sections, else the entity.

Edge cases: a document whose bank no reader tells is an error; one without rows has none
accepted and ties with no printed total but zero; an account that a read shows several times
is as many rows, as printed totals and counts have them all: each is voted on with those of
the same number, from the top, in the other reads; rows without an account are left out, as
are pages with a null doc_id, reader or page number; null texts are empty pages; an empty
table gives no rows.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.domain import Domain, duck
from ..plans.shared import write_once
from ..sources import scans
from .consensus import BOX, agreed, balance_decision, box_gate, tenant_gate
from .scalars import resolve_documents

#: A read's id is its document's times this, and its reader, who is below it.
READERS = 16
#: What is printed and must be read alike.
PRINTED = ("grand", "grand_alt", "reported")


def first(column: str, wanted: Column | None = None) -> Column:
    """The value of the first reader who has one."""
    has = F.col(column).isNotNull() if wanted is None else wanted
    return F.min_by(column, F.when(has, F.col("reader"))).alias(column)


def split(frame: DataFrame) -> DataFrame:
    """The document and the reader in place of the read's id."""
    return frame.withColumn("reader", (F.col("doc_id") % READERS).cast("int")).withColumn("doc_id", F.floor(F.col("doc_id") / READERS))


def verify(reads: DataFrame, buildings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per document: bank, per_tenant, the gates and their status, buildings and report date;
    and the accepted rows (doc_id, account_id, value, n_agree, confirmed_by, tenant, unit)."""
    known = reads.where("doc_id IS NOT NULL AND reader IS NOT NULL AND page_no IS NOT NULL")
    pages = known.select((F.col("doc_id") * READERS + F.col("reader")).cast("long").alias("doc_id"), "page_no", F.coalesce("text", F.lit("")).alias("text"))
    heads, rows = scans.extract(pages)
    heads = write_once(split(heads.join(scans.first_page(pages).select("doc_id", "as_of"), "doc_id", "left")))
    rows = write_once(split(rows).where("account IS NOT NULL"))
    label = F.min_by(F.struct("entity"), F.when(F.col("entity").isNotNull(), F.col("reader"))).alias("e")
    docs = heads.groupBy("doc_id").agg(F.countDistinct("reader").alias("reads"), first("bank"), F.max(F.col("kind") == "landlord_detail").alias("_detail"), first("as_of"), label)
    tenants = (F.col("bank") == "capital_one") | ((F.col("bank") == "apple") & F.coalesce("_detail", F.lit(False)))
    docs = docs.select("doc_id", "reads", "bank", F.coalesce(tenants, F.lit(False)).alias("per_tenant"), F.col("as_of").alias("report_date"), F.col("e.entity").alias("entity"))

    nth = F.row_number().over(Window.partitionBy("doc_id", "reader", "account").orderBy(*scans.PLACE))
    votes = write_once(rows.select("doc_id", "reader", F.struct(F.col("account").alias("account"), nth.alias("nth")).alias("account_id"), F.col("balance").alias("value"), "tenant", "unit"))
    shown = F.explode(F.create_map(*[x for f in PRINTED for x in (F.lit(f), F.col(f).cast("long"))])).alias("field", "value")
    said = agreed(heads.select("doc_id", "reader", shown), ["doc_id", "field"])
    printed = said.groupBy("doc_id").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in PRINTED])
    gates = tenant_gate(votes, printed).drop("status")
    boxes = box_gate(heads.select("doc_id", "reader", *BOX)).select("doc_id", F.col("status").alias("_box"))

    sections = rows.where("section IS NOT NULL").groupBy("doc_id", "section").agg(F.min("reader").alias("reader"))
    least = sections.groupBy("doc_id").agg(F.min("reader").alias("reader"))
    named = sections.join(least, ["doc_id", "reader"]).select("doc_id", F.col("section").alias("label"))
    rest = docs.join(least, "doc_id", "left_anti").where("entity IS NOT NULL").select("doc_id", F.col("entity").alias("label"))
    sites = resolve_documents(named.union(rest), buildings)

    no, none = F.lit(False), F.lit(0).cast("long")
    j = docs.join(gates, "doc_id", "left").join(printed, "doc_id", "left").join(boxes, "doc_id", "left").join(sites, "doc_id", "left")
    # A document without rows has no votes, so its gates are made here.
    ties = F.coalesce(F.col("sum_ties"), F.coalesce(F.col("grand") == 0, no) | F.coalesce(F.col("grand_alt") == 0, no))
    counts = F.coalesce(F.col("count_ties"), F.coalesce(F.col("reported") == 0, F.lit(True)))
    j = j.select("doc_id", "reads", "bank", "per_tenant", *PRINTED, *[F.coalesce(c, none).alias(c) for c in ("accepted_total", "accepted_count", "flagged")], F.coalesce("row_consensus", F.lit(True)).alias("row_consensus"), ties.alias("sum_ties"), counts.alias("count_ties"), "_box", F.coalesce("n_buildings", none).alias("n_buildings"), F.coalesce("buildings", F.lit("")).alias("buildings"), "report_date")
    whole = F.col("row_consensus") & F.col("sum_ties") & F.col("count_ties")
    status = F.when(F.col("bank").isNull(), "quarantined").when(F.col("per_tenant"), F.when(whole, "accepted").otherwise("quarantined")).otherwise(F.col("_box"))
    error = F.when(F.col("bank").isNull(), "bank not identified")
    about = votes.groupBy("doc_id", "account_id").agg(first("tenant"), first("unit"))
    accepted = agreed(votes, ["doc_id", "account_id"]).where("value IS NOT NULL").join(about, ["doc_id", "account_id"]).withColumn("account_id", F.col("account_id.account"))
    return j.withColumn("status", status).withColumn("error", error).drop("_box"), accepted


def decided(verified: DataFrame, accepted: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The decision on each document, and the balances of those that are posted, with the one
    building that their labels name."""
    kind = F.when(F.col("per_tenant"), "per_tenant").otherwise("activity")
    decision = balance_decision(verified.withColumn("kind", kind), as_of)
    posted = decision.where("decision = 'posted'").join(verified.select("doc_id", F.col("buildings").try_cast("long").alias("building_id")), "doc_id")
    return decision, accepted.join(posted.select("doc_id", "building_id", "as_of"), "doc_id")


# --- three reads of made reports ------------------------------------------------------


def _reads(d: Domain) -> DataFrame:
    """Three reads of reports by account, letters and statements.  The readers differ on the
    balances of every 11th lease, all three on every 22nd in a fifth of the buildings; the
    second misreads every third total; every fourth total and every sixth count is printed
    wrongly."""
    b, i, far = F.col("building_id"), F.col("lease_id"), F.lit(1 << 40)
    day = F.when(b % 2 == 0, "\n report date: 7-31-01").otherwise("")
    head = F.concat(F.when(b % 3 == 0, "C@P!T@L").otherwise("Capital One"), day, F.lit("\n OAK "), b.cast("string"), F.lit(" HOLDINGS LLC"))
    page = d.buildings.select((b * 4).alias("doc_id"), F.lit(1).cast("long").alias("page_no"), head.alias("text"))
    letter = d.buildings.select((b * 4 + 1).alias("doc_id"), F.lit(1).cast("long").alias("page_no"), F.lit("some letter").alias("text"))
    statement = scans._activity(d).withColumn("doc_id", F.col("doc_id") * 4 + 2)
    sums = d.leases.groupBy("building_id").agg(F.count("*").alias("n"), F.sum(F.when(i % 3 == 0, 0).otherwise(F.col("deposit") + 1)).alias("t"))
    out = []
    wrong = {1: F.lit(0), 2: F.when(i % 11 == 0, 700).otherwise(0), 3: F.when((i % 22 == 0) & (b % 5 == 2), 900).otherwise(0)}
    for reader, more in wrong.items():
        seen = d.leases.withColumn("deposit", F.col("deposit") + more)
        total = F.col("t") + F.when(b % 4 == 0, 1).otherwise(0) + (F.when(b % 3 == 1, 5).otherwise(0) if reader == 2 else 0)
        count = F.col("n") + F.when(b % 6 == 5, 1).otherwise(0)
        last = sums.select((b * 4).alias("doc_id"), far.alias("page_no"), F.concat(F.lit("CAPITAL ONE TOTALS FOR ALL SUB ACCOUNTS "), count, F.lit(" SUB ACCOUNTS\n x 1.00 "), scans._shown(total)).alias("text"))
        body = scans._subaccounts(SimpleNamespace(leases=seen)).withColumn("doc_id", F.col("doc_id") * 4)
        out += [f.select("doc_id", F.lit(reader).alias("reader"), "page_no", "text") for f in (page, letter, statement, body, last)]
    all_reads = out[0]
    for f in out[1:]:
        all_reads = all_reads.union(f)
    return all_reads


def _named(d: Domain) -> DataFrame:
    """Every seventh building is not known by name."""
    b = F.col("building_id")
    return d.buildings.where(b % 7 != 3).select("building_id", F.concat(F.lit("Oak "), b.cast("string"), F.lit(" Holdings LLC")).alias("name"), F.lit(None).cast("string").alias("address"))


def _verified(d: Domain) -> DataFrame:
    return verify(write_once(_reads(d)), _named(d))[0].drop("report_date", "buildings")


def _decided(d: Domain) -> DataFrame:
    return decided(*verify(write_once(_reads(d)), _named(d)), F.lit(None).cast("date"))[0]


def _posted(d: Domain) -> DataFrame:
    return decided(*verify(write_once(_reads(d)), _named(d)), F.lit(None).cast("date"))[1]


def _q(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir, True))


QUERIES = {"agg19_printed_totals": _q(_verified), "gate09_read_decision": _q(_decided), "gate09_read_balances": _q(_posted)}
_LOST = "(lease_id % 22 = 0 AND lease_id % 3 <> 0 AND building_id % 5 = 2)"
_CAP = f"""(SELECT *, flagged = 0 AS row_consensus, accepted_total = grand AS sum_ties, accepted_count = reported AS count_ties FROM (SELECT building_id AS b, building_id * 4 AS doc_id, sum(v)::BIGINT + CASE WHEN building_id % 4 = 0 THEN 1 ELSE 0 END AS grand, count(*) + CASE WHEN building_id % 6 = 5 THEN 1 ELSE 0 END AS reported, coalesce(sum(v) FILTER (WHERE NOT {_LOST}), 0)::BIGINT AS accepted_total, count(*) FILTER (WHERE NOT {_LOST}) AS accepted_count, count(*) FILTER (WHERE {_LOST}) AS flagged, CASE WHEN building_id % 7 = 3 THEN 0 ELSE 1 END AS n_buildings FROM (SELECT *, CASE WHEN lease_id % 3 = 0 THEN 0 ELSE deposit + 1 END AS v FROM {{leases}}) GROUP BY building_id))"""
_OK = "row_consensus AND sum_ties AND count_ties"
_BOXED = "CASE WHEN statement_id % 4 = 1 OR (statement_id % 4 IN (0, 3) AND statement_id % 10 <> 0) THEN 'accepted' ELSE 'quarantined' END"
_SHORT = "opening >= 100 AND closing >= 100"
_SAYS = "nullif(concat_ws('; ', CASE WHEN NOT row_consensus THEN 'no row consensus' END, CASE WHEN NOT sum_ties THEN 'sum' END, CASE WHEN NOT count_ties THEN 'count mismatch' END), '')"
_AS_OF = "CASE WHEN b % 2 = 0 THEN DATE '2001-07-31' END"
ORACLE = {k: duck(v) for k, v in {
    "agg19_printed_totals": f"""SELECT doc_id, 3 AS reads, 'capital_one' AS bank, true AS per_tenant, grand, NULL::BIGINT AS grand_alt, reported, accepted_total, accepted_count, flagged, row_consensus, sum_ties, count_ties, n_buildings, CASE WHEN {_OK} THEN 'accepted' ELSE 'quarantined' END AS status, NULL AS error FROM {_CAP}
UNION ALL SELECT building_id * 4 + 1, 3, NULL, false, NULL, NULL, NULL, 0, 0, 0, true, false, true, 0, 'quarantined', 'bank not identified' FROM {{buildings}}
UNION ALL SELECT statement_id * 4 + 2, 3, 'santander', false, NULL, NULL, NULL, 0, 0, 0, true, false, true, 0, {_BOXED}, NULL FROM {{statements}} WHERE {_SHORT}""",
    "gate09_read_decision": f"""SELECT doc_id, CASE WHEN NOT ({_OK}) THEN 'quarantined' WHEN n_buildings = 0 THEN 'quarantined' ELSE 'posted' END AS decision, CASE WHEN NOT ({_OK}) THEN 'gate failed: ' || {_SAYS} WHEN n_buildings = 0 THEN 'building unresolved' END AS message, CASE WHEN {_OK} AND n_buildings = 1 THEN {_AS_OF} END AS as_of FROM {_CAP}
UNION ALL SELECT building_id * 4 + 1, 'errored', 'bank not identified', NULL FROM {{buildings}}
UNION ALL SELECT statement_id * 4 + 2, 'skipped', 'not per tenant', NULL FROM {{statements}} WHERE {_SHORT}""",
    "gate09_read_balances": f"""SELECT c.doc_id, '1000' || lpad(lease_id::VARCHAR, 6, '0') AS account_id, CASE WHEN lease_id % 3 = 0 THEN 0 ELSE deposit + 1 END AS value, CASE WHEN lease_id % 3 = 0 OR lease_id % 11 <> 0 THEN 3 ELSE 2 END AS n_agree, CASE WHEN lease_id % 3 = 0 OR lease_id % 11 <> 0 THEN '1,2,3' ELSE '1,3' END AS confirmed_by, replace(tenant, '#', ' ') AS tenant, unit, l.building_id, {_AS_OF} AS as_of FROM {_CAP} c JOIN {{leases}} l ON l.building_id = c.b WHERE {_OK} AND n_buildings = 1""",
}.items()}
