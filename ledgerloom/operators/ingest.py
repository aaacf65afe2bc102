"""Statements from page text to stored rows: parse, gate, decide, and land whole.

``decide`` reads every flag of the ingest decision from the documents themselves; ``ingest``
stores what is posted as one version (documents, pages, statements, transactions, audit
and the batch's outcomes), so a reader never sees a statement without its rows.  Ids are
the content's hash: a repeated batch finds its outcomes, a repeated document is a duplicate,
and after a crash the same call simply runs again.

Within a batch a document is a duplicate only of an earlier one (by doc_id) of equal content
that is posted itself: a copy filed under a wrong account does not keep the right one out.

Edge cases: a document without pages counts as a scan; null texts are empty pages; a null
hash equals no other; an account that is not known is not held against the statement's
number; an empty batch makes no version.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import format_cents
from ..plans.domain import Domain, duck
from ..plans.shared import write_once
from ..plans.versions import Store, content_id
from ..sources import statements as source
from .gates import checksum, diagnose, ingest_decision

TABLES = {
    "documents": "document_id string, sha256 string, filename string, kind string, building_id long, account_id long, storage_path string, byte_size long, page_count int, uploaded_by string",
    "pages": "document_id string, page_no int, raw_text string",
    "statements": "statement_id string, document_id string, account_id long, period_start date, period_end date, opening long, closing long, extract_method string, extract_version string, checksum_ok boolean, checksum_delta long",
    "transactions": "statement_id string, account_id long, posted_on date, amount long, descriptor string, check_no string, page_no int, line_no int",
    "audit": "actor string, action string, table_name string, row_id string, after string",
    "outcomes": "batch string, doc_id long, filename string, sha256 string, status string, reason string, message string, hints array<string>",
}


def parsed(pages: DataFrame, layouts: tuple[source.Layout, ...] = source.LAYOUTS) -> tuple[DataFrame, DataFrame]:
    """Headers (doc_id, layout, n_parsers, scanned, version, period, balances, account, problem)
    of every document and the rows of those with one layout, each written once."""
    found = write_once(source.detect(pages, layouts))
    heads, rows = [], []
    for layout in layouts:
        own = pages.join(found.where(F.col("layout") == layout.id).select("doc_id"), "doc_id", "left_semi")
        heads.append(source.header(own, layout).withColumn("version", F.lit(f"{layout.id}@{layout.version}")))
        rows.append(source.parse(own, layout))
    h = write_once(found.join(reduce(DataFrame.unionByName, heads), "doc_id", "left"))
    return h, write_once(reduce(DataFrame.unionByName, rows))


def decide(files: DataFrame, heads: DataFrame, rows: DataFrame, accounts: DataFrame, stored: DataFrame) -> DataFrame:
    """Of every file (doc_id, filename, account_id, sha256) its decision, with what led to it;
    ``stored`` has the sha256 of documents that are in already."""
    checked = checksum(heads.where("opening IS NOT NULL AND closing IS NOT NULL").withColumnRenamed("doc_id", "statement_id"), rows.withColumnRenamed("doc_id", "statement_id")).withColumnRenamed("statement_id", "doc_id")
    bad_rows = rows.where(F.col("problem").isNotNull()).groupBy("doc_id").agg(F.min_by("problem", F.struct("page_no", "line_no")).alias("row_problem"))
    known = accounts.select("account_id", "building_id", F.col("last4").alias("account_last4"))
    have = stored.select("sha256", F.lit(True).alias("seen")).where("sha256 IS NOT NULL").distinct()
    j = files.join(heads.withColumnRenamed("account_last4", "expected_last4"), "doc_id", "left").join(checked.select("doc_id", "delta", "n", "credits", "debits"), "doc_id", "left").join(bad_rows, "doc_id", "left").join(known, "account_id", "left").join(have, "sha256", "left")
    j = j.withColumn("problem", F.coalesce("problem", "row_problem")).withColumn("parsed", F.col("problem").isNull())
    j = j.withColumn("scanned", F.coalesce("scanned", F.lit(True))).withColumn("n_parsers", F.coalesce("n_parsers", F.lit(0))).withColumn("seen", F.coalesce("seen", F.lit(False)))
    first = ingest_decision(j)
    # of equal contents the first that is posted; those after it are its duplicates
    posted = first.where("status = 'posted' AND sha256 IS NOT NULL").groupBy("sha256").agg(F.min("doc_id").alias("_posted"))
    out = first.join(posted, "sha256", "left")
    again = F.coalesce(F.col("_posted") < F.col("doc_id"), F.lit(False))
    reason = F.when(again, "content seen before").when(F.col("reason") == "parse failed", F.coalesce("problem", "reason")).otherwise(F.col("reason"))
    return out.withColumn("status", F.when(again, "duplicate").otherwise(F.col("status"))).withColumn("reason", reason).drop("_posted", "row_problem")


def frames(decided: DataFrame, rows: DataFrame, pages: DataFrame, batch: str, actor: str) -> dict[str, DataFrame]:
    """The tables' new rows."""
    d = write_once(decided)
    posted = d.where("status = 'posted'").withColumn("document_id", F.col("sha256"))
    failing = d.where("reason = 'checksum'").select(F.col("doc_id").alias("statement_id"), "closing", "n", "delta").withColumn("ok", F.lit(False))
    keyed = rows.select(F.col("doc_id").alias("statement_id"), F.concat_ws(":", "page_no", "line_no").alias("txn_id"), "amount")
    hints = diagnose(failing, keyed).groupBy(F.col("statement_id").alias("doc_id")).agg(F.array_sort(F.collect_set("hint")).alias("hints"))
    count = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))
    link = posted.select("doc_id", "document_id", "account_id")
    message = F.when(F.col("status") == "posted", F.concat(F.col("period_start"), F.lit(".."), F.col("period_end"), F.lit("  "), F.col("n"), F.lit(" txns  closing "), format_cents(F.col("closing"))))
    message = message.when(F.col("status") == "duplicate", F.concat(F.lit("already ingested as "), F.col("sha256"))).when(F.col("reason") == "another account", F.concat(F.lit("account mismatch: file shows ...."), F.col("expected_last4"), F.lit(", target is ...."), F.col("account_last4"))).when(F.col("reason") == "checksum", F.concat(F.lit("off by "), format_cents(F.col("delta")))).otherwise(F.col("reason"))
    after = F.to_json(F.struct("sha256", F.col("period_end").cast("string").alias("period_end"), "closing"))
    return {
        "documents": posted.join(count, "doc_id", "left").select("document_id", "sha256", "filename", F.lit("bank_statement_pdf").alias("kind"), "building_id", "account_id", F.col("path").alias("storage_path"), "byte_size", "page_count", F.lit(actor).alias("uploaded_by")),
        "pages": pages.join(link, "doc_id").select("document_id", F.col("page_no").cast("int").alias("page_no"), F.col("text").alias("raw_text")),
        "statements": posted.select(F.col("document_id").alias("statement_id"), "document_id", "account_id", "period_start", "period_end", "opening", "closing", F.lit("pdftotext").alias("extract_method"), F.col("version").alias("extract_version"), F.lit(True).alias("checksum_ok"), F.lit(0).cast("long").alias("checksum_delta")),
        "transactions": rows.join(link, "doc_id").select(F.col("document_id").alias("statement_id"), "account_id", "posted_on", "amount", "descriptor", "check_no", F.col("page_no").cast("int").alias("page_no"), F.col("line_no").cast("int").alias("line_no")),
        "audit": posted.select(F.lit(actor).alias("actor"), F.lit("ingest_pdftotext").alias("action"), F.lit("statements").alias("table_name"), F.col("document_id").alias("row_id"), after.alias("after")),
        "outcomes": d.join(hints, "doc_id", "left").select(F.lit(batch).alias("batch"), "doc_id", "filename", "sha256", "status", "reason", message.alias("message"), F.coalesce("hints", F.array().cast("array<string>")).alias("hints")),
    }


def ingest(store: Store, files: DataFrame, pages: DataFrame, accounts: DataFrame, actor: str = "ingest", run: str = "") -> DataFrame:
    """Outcomes of a batch of files (doc_id, filename, path, account_id, byte_size, sha256)
    with their pages (doc_id, page_no, text), after what is posted has landed as one version.
    The same batch again finds its outcomes; with another ``run``, documents that did not
    land before are tried again."""
    batch = content_id(files.select(F.to_json(F.struct("doc_id", "filename", "account_id", "sha256", F.lit(run).alias("run"))).alias("c")), "c")
    if not store.has(batch) and not files.isEmpty():
        heads, rows = parsed(pages)

        def made() -> dict[str, DataFrame]:
            return frames(decide(files, heads, rows, accounts, store.read("documents")), rows, pages, batch, actor)

        base = store.version()
        store.append(batch, made(), base, made)
    return store.read("outcomes").where(F.col("batch") == batch).drop("batch")


def _files(d: Domain) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every statement as a document, some filed twice; buildings whose pages have no text, no
    bank's words, those of both banks, or no closing; and statements filed under the next
    building's account in two months of a year."""
    b = F.floor(F.col("doc_id") / 100000)
    both = [source.rendered(d, x).where(b % 2 == k) for k, x in enumerate(source.LAYOUTS)]
    words = F.when(b == 7, F.lit("")).when(b == 8, F.regexp_replace("text", "^[^\n]+", "SOME OTHER BANK")).when(b == 9, F.concat(F.lit("ESCROW ACCOUNT "), F.col("text"))).when(b == 11, F.regexp_replace("text", "Closing Balance", "Final Balance")).otherwise(F.col("text"))
    pages = reduce(DataFrame.unionByName, both).select("doc_id", "page_no", words.alias("text"))
    pages = write_once(pages.union(pages.where(b % 5 == 0).select(F.col("doc_id") + 1_000_000_000, "page_no", "text")))
    place = F.floor(F.col("doc_id") % 1_000_000_000 / 100000)
    routed = F.when(F.col("doc_id") % 100000 % 6 == 0, (place + 1) % 25).otherwise(place)
    files = pages.select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("filename"), F.concat(F.lit("in/"), routed, F.lit("/"), "doc_id", F.lit(".pdf")).alias("path"), routed.alias("account_id"), F.octet_length("text").cast("long").alias("byte_size"), F.sha2(F.when(place.isin(7), F.col("doc_id").cast("string")).otherwise(F.col("text")), 256).alias("sha256"))
    accounts = d.buildings.select(F.col("building_id").alias("account_id"), "building_id", F.lpad(F.col("building_id").cast("string"), 4, "0").alias("last4"))
    return files, pages, accounts


def _ingested(d: Domain) -> DataFrame:
    """A batch lands, the same one again adds nothing; outcomes beside what is stored."""
    files, pages, accounts = _files(d)
    store = Store.temporary(d.spark, TABLES)
    ingest(store, files, pages, accounts)
    out = ingest(store, files, pages, accounts)
    n = lambda name, key: store.read(name).groupBy(F.col(key).alias("sha256")).agg(F.count("*").alias(f"n_{name}"), *([F.sum("amount").alias("amount")] if name == "transactions" else []))
    landed = store.read("statements").select(F.col("statement_id").alias("sha256"), "period_end", "closing").join(n("pages", "document_id"), "sha256", "left").join(n("transactions", "statement_id"), "sha256", "left").join(n("audit", "row_id"), "sha256", "left")
    mine = out.where("status = 'posted'").select("doc_id", "sha256").join(landed, "sha256", "left").drop("sha256")
    return out.select("doc_id", "status", "reason").join(mine, "doc_id", "left")


QUERIES = {"snk01_ingest": lambda spark, sf_dir: _ingested(Domain(spark, sf_dir, True))}
_FIRST = """CASE WHEN b = 7 THEN 'quarantined|no text layer' WHEN b = 8 THEN 'errored|no layout matches' WHEN b = 9 THEN 'errored|layouts are ambiguous' WHEN b = 11 THEN 'errored|could not locate closing balance'
 WHEN m % 6 = 0 THEN 'quarantined|another account' WHEN NOT ok THEN 'quarantined|checksum' ELSE 'posted|' END"""
ORACLE = {"snk01_ingest": duck(f"""WITH s AS (SELECT statement_id AS doc_id, building_id AS b, statement_id % 100000 AS m, period_end, closing, checksum_ok AS ok FROM {{statements}} WHERE opening >= 0 AND closing >= 0),
t AS (SELECT building_id * 100000 + year(posted_on) * 12 + month(posted_on) AS doc_id, count(*) AS n, sum(amount)::BIGINT AS amount FROM {{txns}} GROUP BY 1),
x AS (SELECT s.*, n, amount, {_FIRST} AS x FROM s JOIN t USING (doc_id)),
y AS (SELECT doc_id, x, period_end, closing, n, amount FROM x UNION ALL SELECT doc_id + 1000000000, CASE WHEN x = 'posted|' THEN 'duplicate|content seen before' ELSE x END, period_end, closing, n, amount FROM x WHERE b % 5 = 0)
SELECT doc_id, split_part(x, '|', 1) AS status, nullif(split_part(x, '|', 2), '') AS reason, CASE WHEN x = 'posted|' THEN period_end END AS period_end, CASE WHEN x = 'posted|' THEN closing END AS closing, CASE WHEN x = 'posted|' THEN 1 END AS n_pages, CASE WHEN x = 'posted|' THEN n END AS n_transactions, CASE WHEN x = 'posted|' THEN amount END AS amount, CASE WHEN x = 'posted|' THEN 1 END AS n_audit FROM y""")}
