"""The readers' consensus: a value counts if at least two readers gave it, and a document
only if every row does and what it prints ties to the cent.  Readers lie in rows, not in
columns, so one more reader is more rows and every step is a grouped aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.domain import Domain, duck

#: Fixed value: readers that must agree.
LEAST = 2


def agreed(votes: DataFrame, keys: list[str], least: int = LEAST) -> DataFrame:
    """For each key the value that most readers gave, of equals the one given first; null
    where fewer than ``least`` gave it.  ``votes`` has the keys, reader and value."""
    given = votes.groupBy(*keys, "value").agg(F.when(F.col("value").isNull(), 0).otherwise(F.count("*")).alias("n"), F.array_sort(F.collect_set("reader")).alias("readers"))
    best = given.groupBy(*keys).agg(F.max(F.struct("n", -F.element_at("readers", 1), "value", "readers")).alias("b"))
    ok = F.col("b.n") >= least
    return best.select(*keys, F.when(ok, F.col("b.value")).alias("value"), F.when(ok, F.col("b.n")).otherwise(0).cast("long").alias("n_agree"), F.when(ok, F.concat_ws(",", F.col("b.readers"))).alias("confirmed_by"))


def first_seen(votes: DataFrame, keys: list[str], column: str) -> DataFrame:
    """What the first reader of a key said, even if that is null."""
    return votes.groupBy(*keys).agg(F.min_by(F.struct(column), "reader").alias("f")).select(*keys, F.col(f"f.{column}").alias(column))


def tenant_gate(votes: DataFrame, printed: DataFrame) -> DataFrame:
    """Per document: the accepted rows, their sum and the gates; ``printed`` (doc_id, grand,
    grand_alt, reported) has the agreed printed totals and count, null where none is printed."""
    rows = agreed(votes, ["doc_id", "account_id"]).groupBy("doc_id").agg(F.coalesce(F.sum("value"), F.lit(0)).alias("accepted_total"), F.count("value").alias("accepted_count"), F.count(F.when(F.col("value").isNull(), 1)).alias("flagged"))
    no = F.lit(False)
    sums = F.coalesce(F.col("accepted_total") == F.col("grand"), no) | F.coalesce(F.col("accepted_total") == F.col("grand_alt"), no)
    gates = rows.join(printed, "doc_id", "left").select("doc_id", "accepted_total", "accepted_count", "flagged", (F.col("flagged") == 0).alias("row_consensus"), sums.alias("sum_ties"), F.coalesce(F.col("accepted_count") == F.col("reported"), F.lit(True)).alias("count_ties"))
    return gates.withColumn("status", F.when(F.col("row_consensus") & F.col("sum_ties") & F.col("count_ties"), "accepted").otherwise("quarantined"))


#: The fields of an activity box.
BOX = ("opening", "closing", "credit", "debit")


def box_gate(boxes: DataFrame) -> DataFrame:
    """Per document: the four fields as agreed, and whether opening + credit - debit = closing."""
    long = boxes.select("doc_id", "reader", F.explode(F.create_map(*[x for f in BOX for x in (F.lit(f), F.col(f))])).alias("field", "value"))
    field = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    wide = agreed(long, ["doc_id", "field"]).groupBy("doc_id").agg(*[field(f).alias(f) for f in BOX])
    whole = F.greatest(*[F.col(f).isNull().cast("int") for f in BOX]) == 0
    ties = F.coalesce(F.col("opening") + F.abs("credit") - F.abs("debit") - F.col("closing") == 0, F.lit(False))
    return wide.select("doc_id", *BOX, whole.alias("box_consensus"), ties.alias("box_ties"), F.when(whole & ties, "accepted").otherwise("quarantined").alias("status"))


def balance_decision(gated: DataFrame, as_of: Column) -> DataFrame:
    """What becomes of a balance file: errored, skipped, quarantined or posted.  Reads error,
    kind, status, row_consensus, sum_ties, count_ties, n_buildings and report_date."""
    why = F.concat_ws("; ", F.when(~F.col("row_consensus"), "no row consensus"), F.when(~F.col("sum_ties"), "sum"), F.when(~F.col("count_ties"), "count mismatch"))
    said = lambda d, m=None: F.struct(F.lit(d).alias("decision"), (m if isinstance(m, Column) else F.lit(m)).cast("string").alias("message"))
    d = (
        F.when(F.col("error").isNotNull(), said("errored", F.col("error")))
        .when(F.coalesce(F.col("kind"), F.lit("")) != "per_tenant", said("skipped", "not per tenant"))
        .when(F.col("status") != "accepted", said("quarantined", F.concat(F.lit("gate failed: "), F.coalesce(F.nullif(why, F.lit("")), F.lit("quarantined")))))
        .when(F.col("n_buildings") == 0, said("quarantined", "building unresolved"))
        .when(F.col("n_buildings") > 1, said("quarantined", "building ambiguous"))
        .otherwise(said("posted"))
    )
    return gated.withColumn("_d", d).select("doc_id", "_d.decision", "_d.message", F.when(F.col("_d.decision") == "posted", F.coalesce(as_of, F.col("report_date"))).alias("as_of"))


def _decision(d: Domain) -> DataFrame:
    i = F.col("doc_id")
    g = tenant_gate(d.votes, d.printed)
    g = g.select("*", F.when(i % 9 == 4, "unreadable").alias("error"), F.when(i % 7 == 3, "activity").otherwise("per_tenant").alias("kind"), (i % 3).alias("n_buildings"), F.when(i % 2 == 0, F.lit("2001-07-31").cast("date")).alias("report_date"))
    return balance_decision(g, F.lit(None).cast("date"))


def _rows(d: Domain) -> DataFrame:
    """Accepted rows with the account they belong to."""
    rows = agreed(d.votes, ["doc_id", "account_id"]).where("value IS NOT NULL").join(first_seen(d.votes, ["doc_id", "account_id"], "unit"), ["doc_id", "account_id"])
    accounts = d.accounts.where("account_type = 'escrow'").groupBy(F.col("building_id").alias("doc_id")).agg(F.min("last4").alias("last4"))
    return rows.join(accounts, "doc_id", "left").select("doc_id", "account_id", "unit", "value", "last4")


def _q(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir))


QUERIES = {
    "agg18_consensus": _q(lambda d: agreed(d.votes, ["doc_id", "account_id"])),
    "gate07_tenant_consensus": _q(lambda d: tenant_gate(d.votes, d.printed)),
    "gate08_box_consensus": _q(lambda d: box_gate(d.boxes)),
    "gate09_balance_decision": _q(_decision),
    "jn21_gated_rows": _q(_rows),
}
_TOP = lambda keys, votes: f"(SELECT {keys}, CASE WHEN n >= 2 THEN value END AS value, CASE WHEN n >= 2 THEN n ELSE 0 END AS n_agree, CASE WHEN n >= 2 THEN readers END AS confirmed_by FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, f) AS r FROM (SELECT {keys}, value, count(value) AS n, min(reader) AS f, string_agg(reader::VARCHAR, ',' ORDER BY reader) AS readers FROM {votes} GROUP BY ALL)) WHERE r = 1)"
_VOTES = _TOP("doc_id, account_id", "{votes}")
_GATE = f"(SELECT *, CASE WHEN row_consensus AND sum_ties AND count_ties THEN 'accepted' ELSE 'quarantined' END AS status FROM (SELECT v.doc_id, accepted_total, accepted_count, flagged, flagged = 0 AS row_consensus, coalesce(accepted_total = grand, false) OR coalesce(accepted_total = grand_alt, false) AS sum_ties, reported IS NULL OR accepted_count = reported AS count_ties FROM (SELECT doc_id, coalesce(sum(value), 0)::BIGINT AS accepted_total, count(value) AS accepted_count, count(*) - count(value) AS flagged FROM {_VOTES} GROUP BY 1) v LEFT JOIN {{printed}} p ON p.doc_id = v.doc_id))"
_LONG = "(" + " UNION ALL ".join(f"SELECT doc_id, reader, '{f}' AS field, {f} AS value FROM {{boxes}}" for f in BOX) + ")"
_WHY = "nullif(concat_ws('; ', CASE WHEN NOT row_consensus THEN 'no row consensus' END, CASE WHEN NOT sum_ties THEN 'sum' END, CASE WHEN NOT count_ties THEN 'count mismatch' END), '')"
_WORD = f"CASE WHEN doc_id % 9 = 4 THEN 'errored|unreadable' WHEN doc_id % 7 = 3 THEN 'skipped|not per tenant' WHEN status <> 'accepted' THEN 'quarantined|gate failed: ' || coalesce({_WHY}, 'quarantined') WHEN doc_id % 3 = 0 THEN 'quarantined|building unresolved' WHEN doc_id % 3 > 1 THEN 'quarantined|building ambiguous' ELSE 'posted|' END"
ORACLE = {k: duck(v) for k, v in {
    "agg18_consensus": f"SELECT * FROM {_VOTES}",
    "gate07_tenant_consensus": f"SELECT * FROM {_GATE}",
    "gate08_box_consensus": f"SELECT *, CASE WHEN box_consensus AND box_ties THEN 'accepted' ELSE 'quarantined' END AS status FROM (SELECT *, opening IS NOT NULL AND closing IS NOT NULL AND credit IS NOT NULL AND debit IS NOT NULL AS box_consensus, coalesce(opening + abs(credit) - abs(debit) = closing, false) AS box_ties FROM (SELECT doc_id, {', '.join(f'''max(value) FILTER (WHERE field = '{f}') AS {f}''' for f in BOX)} FROM {_TOP('doc_id, field', _LONG)} GROUP BY 1))",
    "gate09_balance_decision": f"SELECT doc_id, split_part(w, '|', 1) AS decision, nullif(split_part(w, '|', 2), '') AS message, CASE WHEN w = 'posted|' AND doc_id % 2 = 0 THEN DATE '2001-07-31' END AS as_of FROM (SELECT doc_id, {_WORD} AS w FROM {_GATE})",
    "jn21_gated_rows": f"SELECT v.doc_id, v.account_id, m.unit, v.value, a.last4 FROM {_VOTES} v JOIN (SELECT doc_id, account_id, unit FROM {{votes}} WHERE reader = 1) m ON m.doc_id = v.doc_id AND m.account_id = v.account_id LEFT JOIN (SELECT building_id, min(last4) AS last4 FROM {{accounts}} WHERE account_type = 'escrow' GROUP BY 1) a ON a.building_id = v.doc_id WHERE v.value IS NOT NULL",
}.items()}
