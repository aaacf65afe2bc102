"""Statements as text: pages (doc_id, page_no, text) become header fields and transactions.

A layout is a row of configuration.  Pages are split to lines, a layout's header row is
found with one aggregate, and the cells of every line are cut by expressions, so a corpus
of statements is parsed by scans and one join on the document."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.money import to_cents
from ..plans.domain import Domain, duck
from ..plans.shared import write_once


@dataclass(frozen=True)
class Layout:
    """A bank's format.  Patterns of header fields have the value as their first group;
    ``columns`` are header words by offset, else ``line`` reads a row; ``parts`` has the numbers of
    its groups: date, desc, amount (or debit and credit), check; ``iso`` dates are yyyy-mm-dd,
    in rows and in the period."""

    id: str
    version: str
    detect: str
    period: str
    opening: str
    closing: str
    last4: str
    columns: dict[str, str] = field(default_factory=dict)
    line: str = ""
    ignore: tuple[str, ...] = ()
    parts: dict[str, int] = field(default_factory=lambda: {"date": 1, "desc": 2, "amount": 3})
    iso: bool = False


_DAY = r"(\d{2}/\d{2}/\d{4})"
#: The words by which the two formats are known and their fields found.
LAYOUTS = (
    Layout(
        id="escrow-columnar", version="0.2.0", detect=r"(?i)TENANT SECURITY|ESCROW ACCOUNT|SECURITY DEPOSIT ACCOUNT",
        period=rf"(?i)Statement Period:?\s+{_DAY}\s*(?:-|to|through)\s*{_DAY}", opening=r"(?i)(?:Beginning|Opening|Previous)\s+Balance\s+\$?([\d,]+\.\d{2})",
        closing=r"(?i)(?:Ending|Closing|New)\s+Balance\s+\$?([\d,]+\.\d{2})", last4=r"(?i)Account(?:\s+(?:No|Number|#))?\.?:?\s+[\dX*\-]*?(\d{4})\b",
        columns={"date": r"(?i)\bDate\b", "desc": r"(?i)\bDescription\b", "check": r"(?i)\bCheck\b", "debit": r"(?i)\bDebit\b|\bWithdrawal", "credit": r"(?i)\bCredit\b|\bDeposit\b", "balance": r"(?i)\bBalance\b"},
        ignore=(r"(?i)^\s*(?:Beginning|Opening|Ending|Closing|Previous|New)\s+Balance", r"(?i)^\s*Total\s+", r"(?i)^\s*Page\s+\d+", r"^[\s\-=_]+$"),
    ),
    Layout(
        id="harbor-trailing-minus", version="0.1.0", detect=r"(?i)HARBOR NATIONAL BANK",
        period=rf"(?i)Statement Period:\s+{_DAY}\s+through\s+{_DAY}", opening=r"(?i)Opening Balance:\s+\$?([\d,]+\.\d{2})", closing=r"(?i)Closing Balance:\s+\$?([\d,]+\.\d{2})",
        last4=r"(?i)Account No:\s+[*\dX]*?(\d{4})\b", line=r"^\s*(\d{2}/\d{2})\s+(.+?)\s{2,}([\d,]+\.\d{2}-?)\s+([\d,]+\.\d{2})\s*$",
        ignore=(r"(?i)Opening Balance|Closing Balance", r"(?i)^\s*Date\s+Description", r"^[\s\-=_]+$", r"(?i)^\s*Page\s+\d+"),
    ),
)
#: A page with fewer characters than this, white space apart, has no text layer; what may be missing.
SCANNED, OPTIONAL = 100, ("check",)


def detect(pages: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Per document: its layout if exactly one matches page 1, how many do, and whether it
    is a scan without text."""
    chars = F.length(F.regexp_replace("text", r"\s", ""))
    # a page is read where it lies: flags and counts are aggregated, not texts
    own = lambda x: F.coalesce(F.max(F.when(F.col("page_no") == 1, F.coalesce("text", F.lit("")).rlike(x.detect))), F.lit("").rlike(x.detect))
    docs = pages.groupBy("doc_id").agg(*[own(x).alias(f"_{i}") for i, x in enumerate(layouts)], F.sum(chars).alias("chars"), F.count("*").alias("pages"))
    hits = F.array_compact(F.array(*[F.when(F.col(f"_{i}"), x.id) for i, x in enumerate(layouts)]))
    return docs.select("doc_id", F.when(F.size(hits) == 1, hits[0]).alias("layout"), F.size(hits).alias("n_parsers"), (F.col("chars") / F.col("pages") < SCANNED).alias("scanned"))


def lines(pages: DataFrame, *more: str) -> DataFrame:
    return pages.select("doc_id", "page_no", *more, F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", "page_no", *more, (F.col("at") + 1).alias("line_no"), "line")


#: Fixed value: a row's date.
ROW_DATE = r"^\d{1,2}/\d{1,2}(/\d{2,4})?$"


def _found(text: str, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def header(pages: DataFrame, layout: Layout) -> DataFrame:
    """Per document: period, balances in cents, account, and the first field that is missing.
    Fields are read page by page, the first page that has one decides: no document is gathered,
    and what is sent and sorted by document is fields, not texts."""
    top = lambda pattern, group=1: F.when(F.col("page_no") == 1, _found("text", pattern, group))
    found = pages.select("doc_id", "page_no", "text", _found("text", layout.opening).alias("_opening"), _found("text", layout.closing).alias("_closing"), top(layout.period).alias("since"), top(layout.period, 2).alias("until"), top(layout.last4).alias("account_last4"))
    balance = lambda c, pattern: F.when(F.col(c).isNotNull() | F.col("text").rlike(pattern), F.struct("page_no", F.col(c).alias("value")))
    fields = found.select("doc_id", balance("_opening", layout.opening).alias("opening"), balance("_closing", layout.closing).alias("closing"), "since", "until", "account_last4").repartition("doc_id")
    first = lambda c: F.min_by(f"{c}.value", f"{c}.page_no")
    docs = fields.groupBy("doc_id").agg(first("opening").alias("opening"), first("closing").alias("closing"), *[F.max(c).alias(c) for c in ("since", "until", "account_last4")])
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd" if layout.iso else "MM/dd/yyyy")
    parts = docs.select("doc_id", day("since").alias("period_start"), day("until").alias("period_end"), to_cents(F.col("opening")).alias("opening"), to_cents(F.col("closing")).alias("closing"), "account_last4")
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"could not locate {what}")) for c, what in (("period_end", "statement period"), ("opening", "opening balance"), ("closing", "closing balance"), ("account_last4", "account number"))])
    return parts.withColumn("problem", missing)


def _readable(pages: DataFrame, layout: Layout) -> DataFrame:
    """(doc_id, _year): a statement whose header has a problem has no rows."""
    return header(pages, layout).where("problem IS NULL").select("doc_id", F.year("period_end").alias("_year"))


def _transactions(rows: DataFrame, iso: bool = False) -> DataFrame:
    """Dates without a year take that of the period's end."""
    day = F.try_to_date("date", "yyyy-MM-dd") if iso else dates.us_date(F.col("date"), F.col("_year"))
    return rows.select("doc_id", "page_no", "line_no", day.alias("posted_on"), "amount", F.regexp_replace(F.btrim("desc"), r"\s{2,}", " ").alias("descriptor"), F.nullif("check", F.lit("")).alias("check_no"), "problem")


def fixed_width(pages: DataFrame, layout: Layout) -> DataFrame:
    """Transactions of a columnar layout: the header row gives each column's offset, a column
    runs to where the next begins, the first from the line's start.  Offsets are worked out once
    for a document and meet its pages before these are cut to lines; ``pages`` is read three
    times."""
    starts = F.array_compact(F.array(*[F.when(F.regexp_instr("line", F.lit(p)) > 0, F.struct(F.regexp_instr("line", F.lit(p)).alias("start"), F.lit(k).alias("key"))) for k, p in layout.columns.items()]))
    top = lines(pages.where("page_no = 1"))
    for key, pattern in layout.columns.items():
        if key not in OPTIONAL:
            top = top.where(F.col("line").rlike(pattern))
    heads = top.groupBy("doc_id").agg(F.min_by(F.array_sort(starts), "line_no").alias("s"))
    cells = ("date", "desc", "check", "debit", "credit")
    place = F.transform("s", lambda c, i: F.struct(c.key.alias("key"), F.when(i == 0, 1).otherwise(c.start).alias("lo"), F.coalesce(F.get("s", i + 1).start, F.lit(1 << 20)).alias("hi")))
    of = lambda k: F.get(F.filter("s", lambda c: c.key == k), F.lit(0))
    heads = heads.select("doc_id", place.alias("s")).select("doc_id", *[of(k).alias(f"_{k}") for k in cells])
    heads = heads.select("doc_id", *[x for k in cells for x in (F.col(f"_{k}.lo").alias(f"_{k}_lo"), (F.col(f"_{k}.hi") - F.col(f"_{k}.lo")).alias(f"_{k}_n"))]).join(_readable(pages, layout), "doc_id")
    rows = lines(pages.join(heads, "doc_id"), *[c for c in heads.columns if c != "doc_id"]).where(F.btrim("line") != "")
    for pattern in layout.ignore:
        rows = rows.where(~F.col("line").rlike(pattern))
    cell = lambda k: F.coalesce(F.btrim(F.substring("line", F.col(f"_{k}_lo"), F.col(f"_{k}_n"))), F.lit(""))
    cut = rows.select("doc_id", "page_no", "line_no", "_year", *[cell(k).alias(k) for k in cells]).where(F.col("date").rlike(ROW_DATE) & (F.concat("debit", "credit") != ""))
    both = (F.col("debit") != "") & (F.col("credit") != "")
    written = F.abs(to_cents(F.when(F.col("debit") != "", F.col("debit")).otherwise(F.col("credit"))))
    amount = F.when(~both, F.when(F.col("debit") != "", -written).otherwise(written))
    return _transactions(cut.select("doc_id", "page_no", "line_no", "_year", "date", "desc", "check", amount.alias("amount"), F.when(both, "debit and credit in one row").alias("problem")))


def by_pattern(pages: DataFrame, layout: Layout) -> DataFrame:
    """Transactions of a layout whose lines one pattern reads: the amount carries its sign, or
    stands in one of two columns; a line with neither is no transaction."""
    rows = lines(pages.join(_readable(pages, layout), "doc_id"), "_year").where(F.col("line").rlike(layout.line))
    for pattern in layout.ignore:
        rows = rows.where(~F.col("line").rlike(pattern))
    part = {k: F.btrim(F.regexp_extract("line", layout.line, i)) for k, i in layout.parts.items()}
    both, problem = F.lit(False), F.lit(None).cast("string")
    if "amount" in part:
        amount = to_cents(part["amount"])
    else:
        both = (part["debit"] != "") & (part["credit"] != "")
        amount = F.when(~both, F.when(part["credit"] != "", F.abs(to_cents(part["credit"]))).otherwise(-F.abs(to_cents(part["debit"]))))
        rows = rows.where(F.concat(part["debit"], part["credit"]) != "")
        problem = F.when(both, "debit and credit in one row")
    return _transactions(rows.select("doc_id", "page_no", "line_no", "_year", part["date"].alias("date"), part["desc"].alias("desc"), part.get("check", F.lit("")).alias("check"), amount.alias("amount"), problem.alias("problem")), layout.iso)


def parse(pages: DataFrame, layout: Layout) -> DataFrame:
    return fixed_width(pages, layout) if layout.columns else by_pattern(pages, layout)


def listing(spark, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    return spark.createDataFrame([(x.id, x.version) for x in layouts], "id string, version string")


def rendered(d: Domain, layout: Layout) -> DataFrame:
    """Statements written as pages of a layout, from the domain's statements and transactions:
    what the queries below parse back."""
    sid = F.col("building_id") * 100000 + F.year("posted_on") * 12 + F.month("posted_on")
    money = lambda c: F.format_number(F.abs(c) / F.lit(100).cast("decimal(3,0)"), 2)
    t = d.txns.select(sid.cast("long").alias("doc_id"), "txn_id", "posted_on", "amount", "descriptor")
    if layout.columns:
        one = F.concat(F.rpad(F.date_format("posted_on", "MM/dd/yyyy"), 12, " "), F.rpad("descriptor", 40, " "), F.lit(" " * 8), F.lpad(F.when(F.col("amount") < 0, money(F.col("amount"))).otherwise(""), 16, " "), F.lpad(F.when(F.col("amount") >= 0, money(F.col("amount"))).otherwise(""), 16, " "), F.lpad(F.lit("1.00"), 16, " "))
        words = f"{'Date':<12}{'Description':<40}{'Check':<8}{'Debit':<16}{'Credit':<16}Balance"
        title, opening, closing, account = "TENANT SECURITY ESCROW", "Beginning Balance  $", "Ending Balance  $", "Account Number: XXXX-"
    else:
        one = F.concat(F.lit(" "), F.date_format("posted_on", "MM/dd"), F.lit("  "), "descriptor", F.lit("    "), money(F.col("amount")), F.when(F.col("amount") < 0, "-").otherwise(""), F.lit("   1.00"))
        words = "Date   Description"
        title, opening, closing, account = "HARBOR NATIONAL BANK", "Opening Balance: $", "Closing Balance: $", "Account No: ****"
    body = t.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("posted_on", "txn_id", one.alias("line"))))["line"], "\n").alias("body"))
    s = d.statements.withColumnRenamed("statement_id", "doc_id").join(body, "doc_id").where("opening >= 0 AND closing >= 0")
    day = lambda c: F.date_format(c, "MM/dd/yyyy")
    head = F.concat_ws("\n", F.lit(title), F.concat(F.lit("Statement Period: "), day("period_start"), F.lit(" through "), day("period_end")), F.concat(F.lit(account), F.lpad(F.col("building_id").cast("string"), 4, "0")), F.concat(F.lit(opening), money(F.col("opening"))), F.lit("=" * 40), F.lit(words))
    return s.select("doc_id", F.lit(1).alias("page_no"), F.concat_ws("\n", head, F.col("body"), F.lit(""), F.concat(F.lit(closing), money(F.col("closing"))), F.lit("Page 1")).alias("text"))


def _q(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir, True))


def _read(layout: Layout):
    return _q(lambda d: parse(write_once(rendered(d, layout)), layout).select("doc_id", "line_no", "posted_on", "amount", "descriptor", "problem"))


def _mixed(d: Domain) -> DataFrame:
    """Documents of both formats, of neither, of both at once, and scans."""
    i = F.col("doc_id")
    text = F.when(i % 5 == 0, F.lit("page")).when(i % 5 == 1, F.concat(F.lit("HARBOR NATIONAL BANK "), F.repeat(F.lit("x"), F.lit(100)))).when(i % 5 == 2, F.concat(F.lit("escrow account of harbor national bank"), F.repeat(F.lit("y "), F.lit(80)))).when(i % 5 == 3, F.concat(F.lit("Escrow Account "), F.repeat(F.lit("z"), F.lit(90)))).otherwise(F.repeat(F.lit("w"), F.lit(200)))
    return detect(d.statements.select(F.col("statement_id").alias("doc_id"), F.lit(1).alias("page_no"), text.alias("text")))


ESCROW, HARBOR = LAYOUTS
QUERIES = {"src01_fixed_width": _read(ESCROW), "src02_by_pattern": _read(HARBOR), "src03_header": _q(lambda d: header(rendered(d, ESCROW), ESCROW)), "src04_detect": _q(_mixed)}
_ROWS = "SELECT doc_id, 6 + row_number() OVER (PARTITION BY doc_id ORDER BY posted_on, txn_id) AS line_no, posted_on, amount, trim(regexp_replace(descriptor, '\\s{2,}', ' ', 'g')) AS descriptor, NULL::VARCHAR AS problem FROM (SELECT t.*, statement_id AS doc_id FROM (SELECT *, building_id * 100000 + year(posted_on) * 12 + month(posted_on) AS sid FROM {txns}) t JOIN {statements} s ON s.statement_id = t.sid WHERE s.opening >= 0 AND s.closing >= 0)"
ORACLE = {k: duck(v) for k, v in {
    "src01_fixed_width": _ROWS,
    "src02_by_pattern": _ROWS,
    "src03_header": "SELECT statement_id AS doc_id, period_start, period_end, opening, closing, lpad(building_id::VARCHAR, 4, '0') AS account_last4, NULL::VARCHAR AS problem FROM {statements} WHERE opening >= 0 AND closing >= 0",
    "src04_detect": "SELECT statement_id AS doc_id, CASE statement_id % 5 WHEN 1 THEN 'harbor-trailing-minus' WHEN 3 THEN 'escrow-columnar' END AS layout, CASE statement_id % 5 WHEN 1 THEN 1 WHEN 3 THEN 1 WHEN 2 THEN 2 ELSE 0 END AS n_parsers, statement_id % 5 = 0 AS scanned FROM {statements}",
}.items()}
