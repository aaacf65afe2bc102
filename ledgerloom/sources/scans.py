"""Text that a reader made of scanned statements: pages (doc_id, page_no, text) become boxes,
running balances and rows for each tenant.  The reader itself is not Spark's work.

Pages are cut to blocks of at most BLOCK lines, and each block is read by expressions over
its lines.  What a row takes from lines beyond its block (the next ones, a section's head far
above, the balance before, whether an earlier row has used the line) is carried by the
blocks' edges: a few values for each block go through a window over the document, and only
blocks with rows in them are joined with what they need.  So a document of any number of
pages is read by as many tasks as its pages, and its text is never gathered.

``extract`` is the driver over all banks: page 1 tells the bank, documents that it does not
tell and those whose rows stand on all pages are read again, the others are not.

Edge cases: a null text is an empty page, a document of no known bank has only its id and the
error; a label cut in two by the end of a page is not found; the amount after a label may stand
on one of the next three pages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.money import MONEY, amount_after, money_tokens, to_cents
from ..plans.domain import Domain, duck
from ..plans.shared import write_once

#: Words by which a bank is known, in the order in which they are tried; a
#: tuple's words must all be there.
BANKS = (
    ("capital_one", ("ESCROW EXPRESS", "CAPITAL ONE")),
    ("mt", ("M&T", "MANUFACTURERS AND TRADERS", "M&T ESCROW")),
    ("flagstar", ("FLAGSTAR", "LEASE SECURITY LANDLORD")),
    ("santander", ("SANTANDER", "SELF-SERVICE CHECKING")),
    ("apple", ("APPLE BANK", "SCARSDALE", "RECREDIT", ("LANDLORD/AGENT", "SECURITY DEP"))),
)
#: Labels of the activity box, in lower case: opening, closing, credits, debits, service.
LABELS = {
    "apple": ("beginning balance", "ending balance", "total additions", "total subtractions", None),
    "mt": ("beginning balance", "ending balance", "deposits & credits", "less checks & debits", "less service charges"),
    "flagstar": ("beginning balance", "ending balance", "credit(s) this period", "debit(s) this period", None),
    "santander": ("beginning balance", "ending balance", "deposits/credits", "withdrawals/debits", None),
}
#: Patterns of a period, a report's date, a line with a running balance, a
#: tenant's account and row, a section's head and the end of all sections.
PERIOD = r"(?i)(\d{2})[-/](\d{2})[-/](\d{2,4})\s*(?:TO|THROUGH|-)\s*(\d{2})[-/](\d{2})[-/](\d{2,4})"
ENDING = r"(?i)Statement Ending\s+(\d{2})/(\d{2})/(\d{4})"
REPORT = r"(?i)Report\s*Date\s*[:\s]*?(\d{1,2})[-/](\d{1,2})[-/](\d{2,4})"
BALANCE_LINE = r"(?i)^\s*(?:\d{1,2}[-/]\d{1,2}(?:[-/]\d{2,4})?\b|Beginning|Ending)"
ACCOUNT = r"\b(1000\d{6})\b"
TENANT = r"^\s*(\d{8,})\s+(.+?)\s+(\d{1,3}(?:,\d{3})*\.\d{2})\b"
SECTION = r"(?i)Building Number\s+(.+?)\s*$"
ALL_SECTIONS, COLUMN_TOTAL = "landlord totals for all buildings", "security dep."
UNIT = r"^\s*(\d{1,4}[A-Z]?|[A-Z]\d{1,3})\b"
OPENED = r"OPEN\s+(\d{2})/(\d{2})/(\d{2})"
ALL_ACCOUNTS = r"(?i)TOTALS FOR ALL SUB ACCOUNTS\s+(\d+)\s+SUB ACCOUNTS"
ENTITY = r"(?m)^\s*([A-Z0-9][A-Z0-9 &/#.'-]{3,}?\s+LLC)\b"
OWNERS = r"(?m)^\s*(\d[\d/ ]*\d[A-Z0-9 &/#.'-]*LLC[^\n]*)"
#: The master account's number by bank, and the labels of the pooled balances.
MASTER = {
    "capital_one": r"(?i)MASTER ACCOUNT (?:NUMBER|NBR)[:\s]*?(\d{6,})",
    "apple": r"(?i)Account number\s*[:\s]*?(\d{6,})",
    "mt": r"ACCOUNT NUMBER\s+(\d{6,})",
    "flagstar": r"(?i)Account Number\s*(X*\d{3,})",
    "santander": r"Account #\s*(\d{6,})",
}
SWEEP, CURRENT, DDA = r"(?i)MASTER ESCROW BALANCE[^:]*:", r"(?i)CURRENT BALANCE:", r"(?i)DEMAND DEPOSIT ACCOUNT BALANCE SHOULD BE"
#: Banks whose rows stand on all pages.
EVERY_PAGE = ("capital_one", "apple")


def _bank(has: Callable[[str], Column]) -> Column:
    """The first bank of whose words, or tuples of words, one is there."""
    out = F.lit(None).cast("string")
    for name, words in reversed(BANKS):
        hit = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [has(p) for p in ((w,) if isinstance(w, str) else w)]) for w in words])
        out = F.when(hit, name).otherwise(out)
    return out


def bank(text: Column) -> Column:
    """The first bank whose words stand in the text."""
    return _bank(lambda word: F.contains(F.upper(text), F.lit(word)))


def _day(text: Column, pattern: str, month: int = 1) -> Column:
    """The day that a pattern's groups spell; a cast, as a formatter throws at every text without one."""
    part = lambda i: F.regexp_extract(text, pattern, month + i)
    year = F.when(F.length(part(2)) == 4, part(2)).when(F.length(part(2)) == 2, F.concat(F.lit("20"), part(2)))
    return F.when(text.rlike(pattern), F.concat_ws("-", year, F.lpad(part(0), 2, "0"), F.lpad(part(1), 2, "0")).try_cast("date"))


def report_date(text: Column) -> Column:
    return _day(text, REPORT)


def first_page(pages: DataFrame) -> DataFrame:
    """doc_id, bank and as_of by page 1 alone: only its rows are read."""
    return pages.where("page_no = 1").select("doc_id", bank(F.col("text")).alias("bank"), report_date(F.col("text")).alias("as_of"))


# --- Blocks of lines and what their edges carry ------------------------------------

#: Most lines of a block, and characters after a label in which an amount may stand.
BLOCK, FAR = 256, 400
KEY = ["doc_id", "page_no", "block"]


def in_order() -> WindowSpec:
    return Window.partitionBy("doc_id").orderBy("page_no", "block")


def before() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def blocks(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, block, lines): the pages' lines, at most BLOCK in an array."""
    cut = pages.select("doc_id", "page_no", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    starts = F.sequence(F.lit(1), F.size("l"), F.lit(BLOCK))
    return cut.select("doc_id", "page_no", F.posexplode(F.transform(starts, lambda i: F.slice("l", i, BLOCK))).alias("block", "lines"))


def following(b: DataFrame, most: int) -> DataFrame:
    """Of each block the first ``most`` lines after it."""
    empty = F.array().cast("array<string>")
    edge = b.select(*KEY, F.slice("lines", 1, most).alias("e"))
    after = F.flatten(F.array(*[F.coalesce(F.lead("e", k).over(in_order()), empty) for k in range(1, most + 1)]))
    return edge.select(*KEY, F.slice(after, 1, most).alias("after"))


def last_of(array: Column) -> Column:
    return F.try_element_at(array, F.lit(-1))


def has_line(pattern: str) -> Column:
    return F.exists("lines", lambda x: x.rlike(pattern))


def reaching(pages: DataFrame, wanted: Column) -> DataFrame:
    """Pages with what is ``wanted``, and FAR characters of the pages after them in ``t``."""
    order = Window.partitionBy("doc_id").orderBy("page_no")
    edge = pages.select("doc_id", "page_no", F.substring("text", 1, FAR).alias("e"))
    after = edge.select("doc_id", "page_no", F.concat_ws("\f", *[F.lead("e", k).over(order) for k in (1, 2, 3)]).alias("after"))
    return pages.where(wanted).join(after, ["doc_id", "page_no"]).withColumn("t", F.concat_ws("\f", "text", "after"))


def by_first_page(value: Column, found: Column) -> Column:
    """The value on the first page where it is found."""
    return F.min_by(value, F.when(found, F.col("page_no")))


# --- Activity ----------------------------------------------------------------------


def running(pages: DataFrame) -> DataFrame:
    """Per document what its running balances say: the first, the last if there are two, and the
    sums of the steps up and down."""
    found = F.array_compact(F.transform("lines", lambda x: F.when(x.rlike(BALANCE_LINE), last_of(money_tokens(x)))))
    b = blocks(pages).where(has_line(BALANCE_LINE)).select(*KEY, found.alias("m")).where(F.size("m") > 0)
    steps = F.zip_with(F.slice("m", 2, F.size("m")), F.slice("m", 1, F.size("m") - 1), lambda x, y: x - y)
    total = lambda way: F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + F.greatest(way * x, F.lit(0).cast("long")))
    e = b.select(*KEY, F.size("m").alias("n"), F.get("m", 0).alias("first"), last_of(F.col("m")).alias("last"), total(F.lit(1)).alias("up"), total(F.lit(-1)).alias("down"))
    e = e.withColumn("step", F.coalesce(F.col("first") - F.lag("last").over(in_order()), F.lit(0)))
    at = F.struct("page_no", "block")
    two = F.sum("n") > 1
    moved = lambda c, way: F.when(two, F.sum(F.col(c) + F.greatest(way * F.col("step"), F.lit(0))))
    return e.groupBy("doc_id").agg(F.min_by("first", at).alias("run_opening"), F.when(two, F.max_by("last", at)).alias("run_closing"), moved("up", 1).alias("run_credit"), moved("down", -1).alias("run_debit"))


BOX = ("opening", "closing", "credit", "debit", "service")


def activity(pages: DataFrame, labels: tuple | None = None) -> DataFrame:
    """The activity box, and beside it what the running balances say.  Only the box decides:
    running balances agree with themselves whatever was misread; they stand in for an opening
    or closing that the box does not show.  Without ``labels`` the pages' column bank names them."""
    own = lambda i: F.lit(labels[i]).cast("string") if labels else reduce(lambda a, x: F.when(F.col("bank") == x[0], F.lit(x[1][i])).otherwise(a), LABELS.items(), F.lit(None).cast("string"))
    named = pages.select("doc_id", "page_no", "text", *[own(i).alias(f"_{n}") for i, n in enumerate(BOX)])
    has = {n: F.coalesce(F.instr(F.lower("text"), F.col(f"_{n}")) > 0, F.lit(False)) for n in BOX}
    period = F.col("text").rlike(PERIOD)
    docs = named.groupBy("doc_id").agg(by_first_page(_day(F.col("text"), PERIOD), period).alias("period_start"), by_first_page(_day(F.col("text"), PERIOD, 4), period).alias("_to"), by_first_page(_day(F.col("text"), ENDING), F.col("text").rlike(ENDING)).alias("_ending"), F.first("_service", True).isNotNull().alias("_serves"))
    near = reaching(named, reduce(lambda a, b: a | b, has.values()))
    box = near.groupBy("doc_id").agg(*[by_first_page(amount_after(F.col("t"), F.col(f"_{n}")), has[n]).alias(f"box_{n}") for n in BOX])
    service = F.when(F.col("_serves"), F.col("box_service")).otherwise(F.lit(0).cast("long"))
    j = docs.join(box, "doc_id", "left").join(running(pages), "doc_id", "left").withColumn("service", service)
    delta = F.col("box_opening") + F.abs("box_credit") - F.abs("box_debit") - F.abs(F.coalesce("service", F.lit(0))) - F.col("box_closing")
    agrees = (F.abs("box_opening") == F.abs("run_opening")) & (F.abs("box_closing") == F.abs("run_closing"))
    return j.select(
        "doc_id", "period_start", F.coalesce("_to", "_ending").alias("period_end"), F.coalesce("box_opening", "run_opening").alias("opening"), F.coalesce("box_closing", "run_closing").alias("closing"), F.abs("box_credit").alias("credit"), F.abs("box_debit").alias("debit"), "service",
        "run_opening", "run_closing", "run_credit", "run_debit", delta.alias("delta"), F.coalesce(delta == 0, F.lit(False)).alias("checksum_ok"), agrees.alias("agrees"),
    )


# --- Rows for each tenant ------------------------------------------------------------


#: Where a row's line stands in its document.
PLACE = ("page_no", "block", "at")


def _lines(b: DataFrame, *more: str) -> DataFrame:
    """The lines of blocks one by one, with what arrays beside them hold for each."""
    return b.select(*[c for c in b.columns if c not in ("lines", *more)], F.posexplode(F.arrays_zip("lines", *more)).alias("at", "_l")).select("*", "_l.*").drop("_l").withColumnRenamed("lines", "line")


def sections(pages: DataFrame, place: bool = False) -> DataFrame:
    """Rows of a report by building: account, tenant and balance on one line, the unit on the
    next, the building from the last section head above; with ``place`` where they stand."""
    head = lambda x: F.nullif(F.regexp_extract(x, SECTION, 1), F.lit(""))
    b = blocks(pages).withColumn("heads", F.array_compact(F.transform("lines", lambda x, i: F.when(head(x).isNotNull(), F.struct(i.alias("i"), head(x).alias("head"))))))
    edge = b.select(*KEY, last_of(F.col("heads"))["head"].alias("head"), F.get("lines", 0).alias("first"))
    edge = edge.select(*KEY, F.last("head", True).over(before()).alias("carried"), F.lead("first").over(in_order()).alias("after"))
    j = b.where(has_line(TENANT)).join(edge, KEY)
    j = _lines(j.withColumn("next", F.concat(F.slice("lines", 2, BLOCK), F.array("after"))), "next").where(F.col("line").rlike(TENANT))
    above = last_of(F.filter("heads", lambda h: h["i"] <= F.col("at")))
    j = j.withColumn("above", above).where((F.col("above")["i"] != F.col("at")) | F.col("above").isNull())
    part = lambda i: F.regexp_extract("line", TENANT, i)
    return j.select("doc_id", part(1).alias("account"), F.btrim(part(2)).alias("tenant"), to_cents(part(3)).alias("balance"), F.nullif(F.regexp_extract("next", UNIT, 1), F.lit("")).alias("unit"), F.coalesce(F.col("above")["head"], F.col("carried")).alias("section"), *(PLACE if place else ()))


def section_totals(pages: DataFrame) -> DataFrame:
    """The two printed grand totals: the first different amounts after the end of all sections;
    where there are none, the amount after the deposit column's label."""
    end, column = (F.col("text").rlike(r"(?iu)\Q" + x + r"\E") for x in (ALL_SECTIONS, COLUMN_TOTAL))
    near = reaching(pages, end | column)
    at = F.instr(F.lower("t"), F.lit(ALL_SECTIONS)) + len(ALL_SECTIONS)
    found = near.groupBy("doc_id").agg(by_first_page(F.array_distinct(money_tokens(F.substring(F.col("t"), at, F.lit(FAR)))), end).alias("f"), by_first_page(amount_after(F.col("t"), F.lit(COLUMN_TOTAL)), column).alias("c"))
    return found.select("doc_id", F.coalesce(F.get("f", 0), "c").alias("grand"), F.get("f", 1).alias("grand_alt")).where("grand IS NOT NULL")


def _entering(b: DataFrame) -> DataFrame:
    """Of each block how many of its first lines an earlier row has used up: blocks map that
    number (0 to 2) to the one they leave (``out``), and most leave the same whatever it was."""
    same = (F.get("out", 0) == F.get("out", 1)) & (F.get("out", 1) == F.get("out", 2))
    e = b.select(*KEY, "out", same.alias("same"))
    e = e.select(*KEY, "out", F.coalesce(F.sum(F.col("same").cast("long")).over(before()), F.lit(0)).alias("g"), F.lag(F.when(F.col("same"), F.get("out", 0))).over(in_order()).alias("s"))
    groups = e.groupBy("doc_id", "g").agg(F.array_sort(F.collect_list(F.struct("page_no", "block", "out", "s"))).alias("m"))  # up to the next that leaves the same
    start = F.struct(F.coalesce(F.get("m", 0)["s"], F.lit(0)).alias("s"), F.array().cast("array<int>").alias("a"))
    states = F.aggregate("m", start, lambda a, x: F.struct(F.get(x["out"], a["s"]).alias("s"), F.array_append(a["a"], a["s"]).alias("a")))["a"]
    return groups.select("doc_id", F.inline(F.zip_with("m", states, lambda x, s: F.struct(x["page_no"].alias("page_no"), x["block"].alias("block"), s.alias("used")))))


def subaccounts(pages: DataFrame, place: bool = False) -> DataFrame:
    """Rows of a report by account: the name before the account's number, money on the first of
    the next two lines that has any, a closed account at 0.  Lines up to the one with the money
    are used up: they start no row of their own.  With ``place`` where the rows stand."""
    b = blocks(pages)
    b = b.join(following(b, 3), KEY).withColumn("all", F.concat("lines", "after"))
    # what every match holds is looked for before the pattern is tried
    pays = lambda i: F.coalesce(F.contains(F.get("all", i), F.lit(".")) & F.get("all", i).rlike(MONEY), F.lit(False))
    uses = lambda x, i: F.when(F.contains(x, F.lit("1000")) & x.rlike(ACCOUNT) & ~F.contains(x, F.lit("TOTALS")), F.when(pays(i + 1), 1).when(pays(i + 2), 2).otherwise(0))
    step = lambda s, k: F.when(s > 0, s - 1).otherwise(F.coalesce(k, F.lit(0)))
    b = write_once(b.select(*KEY, "lines", "after", F.transform("lines", uses).alias("uses"))).withColumn("all", F.concat("lines", "after"))
    b = b.withColumn("out", F.array(*[F.aggregate("uses", F.lit(s), step) for s in range(3)]))
    # no filter on ``uses`` here: it would become the condition of the merge join, which cannot bind both sides' columns
    own = b.join(_entering(b), KEY)
    used = F.aggregate("uses", F.struct(F.col("used").alias("s"), F.array().cast("array<int>").alias("a")), lambda a, k: F.struct(step(a["s"], k).alias("s"), F.array_append(a["a"], a["s"]).alias("a")))["a"]
    after = {f"n{k}": F.slice("all", k + 1, BLOCK) for k in (1, 2, 3)}
    own = own.select(*KEY, "lines", "uses", used.alias("taken"), *[c.alias(n) for n, c in after.items()])
    j = _lines(own, "uses", "taken", *after).where("uses IS NOT NULL AND taken = 0")
    first = F.col("uses") == 1
    has = F.col("uses") > 0
    paid = F.when(first, F.col("n1")).otherwise(F.col("n2"))
    j = j.withColumn("paid", F.when(has, paid)).withColumn("money", money_tokens(F.col("paid")))
    shut = lambda n: F.coalesce(F.col(n).rlike("(?iu)CLOSED"), F.lit(False))
    closed = shut("n1") | (~first & shut("n2"))
    name = F.btrim(F.regexp_replace(F.regexp_extract("line", "^(.*?)" + ACCOUNT, 1), r"\s+", " "), F.lit(" -"))
    open_on = _day(F.concat_ws("\n", "paid", F.when(first, F.col("n2")).otherwise(F.col("n3"))), OPENED)
    return j.select("doc_id", F.regexp_extract("line", ACCOUNT, 1).alias("account"), name.alias("tenant"), F.when(has, F.get(F.split(F.btrim("paid"), r"\s+", 2), 0)).alias("unit"), F.when(has, F.get("money", 0)).alias("initial"), F.when(has, F.when(closed, F.lit(0)).otherwise(F.element_at("money", -1))).alias("balance"), closed.alias("closed"), F.when(has, open_on).alias("open_on"), *(PLACE if place else ()))


def account_totals(pages: DataFrame) -> DataFrame:
    """The printed count of accounts and their total: the last amount on the line after it."""
    near = reaching(pages, F.col("text").rlike(ALL_ACCOUNTS))
    tail = F.substring(F.regexp_extract("t", ALL_ACCOUNTS + r"([\s\S]{0,200})", 2), 1, 200)
    line = F.when(F.contains(tail, F.lit("\n")), F.get(F.split(tail, "\n"), 1)).otherwise(tail)
    first = lambda c: by_first_page(c, F.lit(True))
    return near.groupBy("doc_id").agg(first(F.regexp_extract("t", ALL_ACCOUNTS, 1).try_cast("long")).alias("reported"), first(last_of(money_tokens(line))).alias("grand"))


# --- The driver ----------------------------------------------------------------------


def told(pages: DataFrame) -> DataFrame:
    """(doc_id, bank, whole): by page 1 where it tells, else by all pages, which are then read whole."""
    probe = pages.where("page_no = 1").select("doc_id", bank(F.col("text")).alias("bank"))
    probe = pages.select("doc_id").distinct().join(probe.where("bank IS NOT NULL"), "doc_id", "left")
    unsure = probe.where("bank IS NULL").select("doc_id")
    words = list(dict.fromkeys(p for _, ws in BANKS for w in ws for p in ((w,) if isinstance(w, str) else w)))
    place = {w: f"w{i}" for i, w in enumerate(words)}
    seen = pages.join(unsure, "doc_id", "left_semi").groupBy("doc_id").agg(*[F.max(F.contains(F.upper("text"), F.lit(w))).alias(n) for w, n in place.items()])
    late = seen.select("doc_id", _bank(lambda w: F.coalesce(F.col(place[w]), F.lit(False))).alias("late"))
    return probe.join(late, "doc_id", "left").select("doc_id", F.coalesce("bank", "late").alias("bank"), (F.col("bank").isNull() | F.col("bank").isin(*EVERY_PAGE)).alias("whole"))


def extract(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each document of any bank, and the rows of its tenants with their place.

    ``pages`` is read first for page 1 of all documents, then only for those that need more:
    the joins carry the documents' ids to the second scan, where Spark prunes by them."""
    banks = write_once(told(pages))
    known = banks.where("bank IS NOT NULL")
    read = pages.join(known, "doc_id").where(F.col("whole") | (F.col("page_no") == 1))
    detail = read.where(F.col("bank") == "apple").groupBy("doc_id").agg(F.max(F.col("text").rlike(r"(?i)Building Number")).alias("d")).where("d").select("doc_id")
    detail = write_once(detail)
    by_building = read.join(detail, "doc_id", "left_semi")
    by_account = read.where(F.col("bank") == "capital_one")
    by_activity = read.where(F.col("bank") != "capital_one").join(detail, "doc_id", "left_anti")
    t = F.col("text")
    found = lambda p, i=1: F.nullif(F.regexp_extract(t, p, i), F.lit(""))
    master = reduce(lambda a, x: F.when(F.col("bank") == x[0], F.nullif(F.regexp_extract(t, x[1], 1), F.lit(""))).otherwise(a), MASTER.items(), F.lit(None).cast("string"))
    named = F.contains(t, F.lit("LLC"))
    # each pattern goes over a page once; what it found is aggregated, not the text
    fields = read.select("doc_id", "bank", "page_no", master.alias("master"), F.when(named, found(ENTITY)).alias("entity"), F.when(named & (F.col("bank") == "santander"), found(OWNERS)).alias("owners"), found(PERIOD, 0).alias("period")).repartition("doc_id")
    first = lambda c: by_first_page(F.col(c), F.col(c).isNotNull())
    heads = fields.groupBy("doc_id", "bank").agg(F.count("*").alias("pages"), first("master").alias("master_account"), F.regexp_replace(F.btrim(first("entity")), r"\s+", " ").alias("_entity"), F.btrim(first("owners")).alias("_owners"), first("period").alias("_period"))
    heads = heads.withColumn("_since", _day(F.col("_period"), PERIOD)).withColumn("_until", _day(F.col("_period"), PERIOD, 4)).drop("_period")
    columns = ["doc_id", "account", "tenant", "unit", "balance", "section", "initial", "closed", "open_on", *PLACE]
    rows = sections(by_building, True).unionByName(subaccounts(by_account, True), allowMissingColumns=True).select(*columns)
    sums = rows.groupBy("doc_id").agg(F.count("*").alias("accounts"), F.sum(F.coalesce("balance", F.lit(0))).alias("total"))
    printed = section_totals(by_building).unionByName(account_totals(by_account), allowMissingColumns=True)
    pooled = reaching(by_account, F.contains(F.upper(t), F.lit("BALANCE")) & (t.rlike(SWEEP) | t.rlike(CURRENT) | t.rlike(DDA)))
    after = lambda p: by_first_page(F.get(money_tokens(F.regexp_extract("t", p + r"([\s\S]{0,400})", 1)), 0), t.rlike(p))
    pooled = pooled.groupBy("doc_id").agg(F.coalesce(F.nullif(after(SWEEP), F.lit(0)), after(CURRENT)).alias("sweep"), after(DDA).alias("dda_should_be"))
    act = activity(by_activity)
    act = act.select("doc_id", F.col("period_start").alias("a_since"), F.col("period_end").alias("a_until"), *[c for c in act.columns if c not in ("doc_id", "period_start", "period_end", "delta", "checksum_ok")], F.col("delta").alias("a_delta"), F.col("checksum_ok").alias("a_ok"))
    kinds = detail.withColumn("kind", F.lit("landlord_detail"))
    j = heads.join(kinds, "doc_id", "left").join(sums, "doc_id", "left").join(printed, "doc_id", "left").join(pooled, "doc_id", "left").join(act, "doc_id", "left")
    tenants = (F.col("bank") == "capital_one") | F.col("kind").isNotNull()
    total = F.when(tenants, F.coalesce("total", F.lit(0)))
    ties = F.coalesce(total == F.col("grand"), F.lit(False)) | F.coalesce(total == F.col("grand_alt"), F.lit(False))
    kind = F.when(F.col("bank") == "apple", F.coalesce("kind", F.lit("master")))
    name = F.when(F.col("bank") == "santander", F.coalesce("_owners", "_entity", F.lit(""))).otherwise(F.col("_entity"))
    out = j.select(
        "doc_id", "bank", kind.alias("kind"), "pages", "master_account", name.alias("entity"), F.when(tenants & F.col("kind").isNull(), F.col("_since")).otherwise(F.col("a_since")).alias("period_start"), F.when(tenants & F.col("kind").isNull(), F.col("_until")).otherwise(F.when((F.col("bank") == "flagstar") | F.col("_until").isNotNull(), F.col("a_until"))).alias("period_end"),
        "opening", "closing", "credit", "debit", "service", "run_opening", "run_closing", "agrees", "sweep", "dda_should_be", F.when(tenants, F.coalesce("accounts", F.lit(0))).alias("accounts"), "reported", total.alias("total"), "grand", "grand_alt",
        F.when(tenants, total - F.col("grand")).otherwise(F.col("a_delta")).alias("delta"), F.when(tenants, ties).otherwise(F.coalesce("a_ok", F.lit(False))).alias("checksum_ok"), F.lit(None).cast("string").alias("error"),
    )
    unknown = banks.where("bank IS NULL").select("doc_id", F.lit("unrecognized bank format").alias("error"))
    return out.unionByName(unknown, allowMissingColumns=True), rows


# --- reports written from the domain, which the queries read back -------------------


def _shown(c: Column) -> Column:
    return F.format_number(c / F.lit(100).cast("decimal(3,0)"), 2)


def _paged(rows: DataFrame, *order: str) -> DataFrame:
    """Pages of (doc_id, page_no, line) in order; a page holds a bounded range of leases."""
    text = F.array_join(F.sort_array(F.collect_list(F.struct(*order, "line")))["line"], "\n")
    return rows.groupBy("doc_id", "page_no").agg(text.alias("text"))


#: Lines of leases' numbers to a page of the reports below.
LINES = 1500


def _sections(d: Domain) -> DataFrame:
    b = F.col("building_id")
    row = F.concat(F.lpad(F.col("lease_id").cast("string"), 9, "1"), F.lit("  "), F.replace("tenant", F.lit("#"), F.lit(" ")), F.lit("   "), _shown(F.col("deposit")), F.lit(" 3"))
    rows = d.leases.select((b % 7).alias("doc_id"), "building_id", "lease_id", F.posexplode(F.array(row, F.concat(F.lit(" "), F.substring("unit", 2, 3), F.lit("   1.00")))).alias("nth", "line"))
    heads = d.buildings.select((b % 7).alias("doc_id"), "building_id", F.lit(-1).cast("long").alias("lease_id"), F.lit(0).alias("nth"), F.concat(F.lit("  Building Number  Nr "), b.cast("string"), F.lit(" ")).alias("line"))
    place = 2 + b * 1_000_000 + F.floor(F.greatest(F.col("lease_id") * 2 + F.col("nth") + 1, F.lit(0)) / LINES)
    ends = d.buildings.select((b % 7).alias("doc_id"), F.lit(1 << 40).alias("page_no"), F.lit("Landlord Totals For All Buildings\n 213,598.96 213,598.96\n 213,598.95").alias("text")).distinct()
    return _paged(rows.union(heads).withColumn("page_no", place), "building_id", "lease_id", "nth").union(ends)


def _subaccounts(d: Domain) -> DataFrame:
    i = F.col("lease_id")
    money = F.concat(F.lit(" "), F.col("unit"), F.lit("  "), _shown(F.col("deposit")), F.lit("  "), _shown(F.col("deposit") + 1))
    name = F.concat(F.replace("tenant", F.lit("#"), F.lit("  ")), F.lit(" - 1000"), F.lpad(i.cast("string"), 6, "0"))
    note = F.when(i % 3 == 0, "CLOSED account").when(i % 3 == 1, "note")
    opened = F.when(i % 5 == 0, F.concat(F.lit("  OPEN "), F.date_format("signed_on", "MM/dd/yy")))
    rows = d.leases.select(F.col("building_id").alias("doc_id"), "lease_id", F.posexplode(F.array_compact(F.array(name, note, money, opened))).alias("nth", "line"))
    return _paged(rows.withColumn("page_no", 2 + F.floor((i * 4 + F.col("nth") + 1) / LINES)), "lease_id", "nth")


def _activity(d: Domain, name: str = "santander") -> DataFrame:
    """A page for each statement; of four one has an unread closing, one no activity besides."""
    day = lambda c: F.date_format(c, "MM/dd/yyyy")
    i, labels = F.col("statement_id"), [x.title() if x else None for x in LABELS[name]]
    credit, debit = F.greatest(F.col("closing") - F.col("opening"), F.lit(0)), F.greatest(F.col("opening") - F.col("closing"), F.lit(0))
    words = {"santander": "SANTANDER\nAccount # 77001234\n12/34 OAK HOLDINGS LLC #1", "mt": "M&T BANK\nACCOUNT NUMBER 88001234\n ELM HOLDINGS LLC", "flagstar": "FLAGSTAR\nAccount Number XX1234"}[name]
    moved = F.when(i % 4 != 2, F.concat(day("period_end"), F.lit(" activity 1.00 "), _shown(F.col("closing"))))
    ending = F.when(i % 4 == 1, "Endng Balnce").when(i % 4 == 2, "Endng Balnce").otherwise(F.concat(F.lit(f"{labels[1]} "), _shown(F.col("closing") + F.when(i % 10 == 0, 100).otherwise(0))))
    fees = [F.lit(f"{labels[4]} 0.00")] if labels[4] else []
    text = F.concat_ws("\n", F.lit(words), F.concat(day("period_start"), F.lit(" TO "), day("period_end")), F.concat(F.lit(f"{labels[0]} "), _shown(F.col("opening"))), F.concat(F.lit(f"{labels[2]} "), _shown(credit)), F.concat(F.lit(f"{labels[3]} "), _shown(debit)), *fees, moved, ending)
    return d.statements.where("opening >= 100 AND closing >= 100").select(i.alias("doc_id"), F.lit(1).cast("long").alias("page_no"), text.alias("text"))


def _documents(d: Domain) -> DataFrame:
    """Documents of all five banks: reports by building and by account behind a first page that
    for every third building tells no bank, and a page for each statement."""
    b, far = F.col("building_id"), F.lit(1 << 40)
    owner = F.lit("\nMASTER ACCOUNT NUMBER: 00123456\nMASTER ESCROW BALANCE TODAY: 1,000.00\n OAK HOLDINGS LLC\n01/01/2024 TO 01/31/2024")
    first = d.buildings.select((b + 1000).alias("doc_id"), F.lit(1).cast("long").alias("page_no"), F.concat(F.when(b % 3 == 0, "C@P!T@L").otherwise("Capital One"), owner).alias("text"))
    total = d.leases.groupBy("building_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("lease_id") % 3 == 0, 0).otherwise(F.col("deposit") + 1)).alias("t"))
    last = total.select((b + 1000).alias("doc_id"), far.alias("page_no"), F.concat(F.lit("CAPITAL ONE TOTALS FOR ALL SUB ACCOUNTS "), "n", F.lit(" SUB ACCOUNTS\n x 1.00 "), _shown(F.col("t") + F.when(b % 4 == 0, 1).otherwise(0))).alias("text"))
    capital = first.union(_subaccounts(d).withColumn("doc_id", F.col("doc_id") + 1000)).union(last)
    apple = d.buildings.select((b % 7).alias("doc_id"), F.lit(1).cast("long").alias("page_no"), F.lit("APPLE BANK\nAccount number: 5550001").alias("text")).distinct().union(_sections(d))
    other = d.buildings.select((b + 2000).alias("doc_id"), F.lit(1).cast("long").alias("page_no"), F.lit("some letter").alias("text"))
    masters = [_activity(d, n).where(F.col("doc_id") % 3 == k) for k, n in enumerate(("santander", "mt", "flagstar"))]
    return reduce(DataFrame.unionByName, [capital, apple, other, *masters])


def _extract(d: Domain) -> DataFrame:
    return extract(write_once(_documents(d)))[0].drop("run_opening", "run_closing")


def _heads(d: Domain) -> DataFrame:
    i = F.col("lease_id")
    words = ("Capital One m&t", "Manufacturers and Traders", "Flagstar Santander", "self-service checking", "Landlord/Agent Security Dep", "Landlord/Agent", "")
    date = F.concat(F.lit(" report date: "), F.date_format("signed_on", "M-d-yy"))
    return d.leases.select(i.alias("doc_id"), F.lit(1).alias("page_no"), F.concat(F.element_at(F.array(*map(F.lit, words)), (i % 7 + 1).cast("int")), F.when(i % 2 == 0, date).otherwise("")).alias("text"))


def _q(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir))


QUERIES = {"src17_first_page": _q(lambda d: first_page(_heads(d))), "src18_activity": _q(lambda d: activity(_activity(d), LABELS["santander"]).drop("service")), "src19_subaccounts": _q(lambda d: subaccounts(_subaccounts(d))), "src20_sections": _q(lambda d: sections(_sections(d))), "src20_totals": _q(lambda d: section_totals(_sections(d))), "src22_extract": lambda spark, sf_dir: _extract(Domain(spark, sf_dir, True))}
_END = "CASE WHEN statement_id % 4 IN (0, 3) THEN closing + CASE WHEN statement_id % 10 = 0 THEN 100 ELSE 0 END END"
_UP, _DOWN = (f"(CASE statement_id % 4 WHEN 2 THEN NULL ELSE greatest({x}, 0) + CASE WHEN statement_id % 4 = 1 THEN 0 ELSE greatest({y}, 0) END END)::BIGINT" for x, y in ((("closing - opening"), f"{_END} - closing"), (("opening - closing"), f"closing - {_END}")))
_BOX = f"""statement_id AS doc_id, period_start, period_end, opening, CASE statement_id % 4 WHEN 1 THEN closing WHEN 2 THEN NULL ELSE {_END} END AS closing, greatest(closing - opening, 0) AS credit, greatest(opening - closing, 0) AS debit"""
ORACLE = {k: duck(v) for k, v in {
    "src17_first_page": "SELECT lease_id AS doc_id, CASE lease_id % 7 WHEN 0 THEN 'capital_one' WHEN 1 THEN 'mt' WHEN 2 THEN 'flagstar' WHEN 3 THEN 'santander' WHEN 4 THEN 'apple' END AS bank, CASE WHEN lease_id % 2 = 0 THEN make_date(2000 + year(signed_on) % 100, month(signed_on), day(signed_on)) END AS as_of FROM {leases}",
    "src18_activity": f"SELECT {_BOX}, opening AS run_opening, CASE statement_id % 4 WHEN 1 THEN closing WHEN 2 THEN NULL ELSE {_END} END AS run_closing, {_UP} AS run_credit, {_DOWN} AS run_debit, closing - {_END} AS delta, coalesce(closing = {_END}, false) AS checksum_ok, CASE WHEN statement_id % 4 IN (0, 3) THEN true END AS agrees FROM {{statements}} WHERE opening >= 100 AND closing >= 100",
    "src19_subaccounts": "SELECT building_id AS doc_id, '1000' || lpad(lease_id::VARCHAR, 6, '0') AS account, replace(tenant, '#', ' ') AS tenant, unit, deposit AS initial, CASE WHEN lease_id % 3 = 0 THEN 0 ELSE deposit + 1 END AS balance, lease_id % 3 = 0 AS closed, CASE WHEN lease_id % 5 = 0 THEN make_date(2000 + year(signed_on) % 100, month(signed_on), day(signed_on)) END AS open_on FROM {leases}",
    "src20_sections": "SELECT building_id % 7 AS doc_id, lpad(lease_id::VARCHAR, 9, '1') AS account, replace(tenant, '#', ' ') AS tenant, deposit AS balance, substr(unit, 2, 3) AS unit, 'Nr ' || building_id AS section FROM {leases}",
    "src20_totals": "SELECT DISTINCT building_id % 7 AS doc_id, 21359896 AS grand, 21359895 AS grand_alt FROM {buildings}",
    "src22_extract": f"""WITH lp AS (SELECT building_id, lease_id, deposit, unnest(range(2 + CASE WHEN lease_id % 3 = 2 THEN 0 ELSE 1 END + CASE WHEN lease_id % 5 = 0 THEN 1 ELSE 0 END)) AS nth FROM {{leases}}),
c AS (SELECT building_id, count(DISTINCT (lease_id * 4 + nth + 1) // {LINES}) + 2 AS pages FROM lp GROUP BY 1),
ct AS (SELECT building_id, count(*) AS n, sum(CASE WHEN lease_id % 3 = 0 THEN 0 ELSE deposit + 1 END)::BIGINT AS t FROM {{leases}} GROUP BY 1),
ap AS (SELECT building_id % 7 AS doc_id, count(DISTINCT building_id * 1000000 + (lease_id * 2 + nth + 1) // {LINES}) AS pages FROM (SELECT building_id, lease_id, unnest([0, 1]) AS nth FROM {{leases}} UNION ALL SELECT building_id, -1, 1 FROM {{buildings}}) GROUP BY 1),
am AS (SELECT building_id % 7 AS doc_id, count(*) AS n, sum(deposit)::BIGINT AS t FROM {{leases}} GROUP BY 1)
SELECT building_id + 1000 AS doc_id, 'capital_one' AS bank, NULL AS kind, pages, '00123456' AS master_account, 'OAK HOLDINGS LLC' AS entity, DATE '2024-01-01' AS period_start, DATE '2024-01-31' AS period_end, NULL::BIGINT AS opening, NULL::BIGINT AS closing, NULL::BIGINT AS credit, NULL::BIGINT AS debit, NULL::BIGINT AS service, NULL::BOOLEAN AS agrees, 100000 AS sweep, NULL AS dda_should_be, n AS accounts, n AS reported, t AS total, t + CASE WHEN building_id % 4 = 0 THEN 1 ELSE 0 END AS grand, NULL AS grand_alt, CASE WHEN building_id % 4 = 0 THEN -1 ELSE 0 END AS delta, building_id % 4 <> 0 AS checksum_ok, NULL AS error FROM c JOIN ct USING (building_id)
UNION ALL SELECT doc_id, 'apple', 'landlord_detail', pages + 2, '5550001', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n, NULL, t, 21359896, 21359895, t - 21359896, t IN (21359896, 21359895), NULL FROM ap JOIN am USING (doc_id)
UNION ALL SELECT building_id + 2000, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'unrecognized bank format' FROM {{buildings}}
UNION ALL SELECT doc_id, bank, NULL, 1, CASE bank WHEN 'santander' THEN '77001234' WHEN 'mt' THEN '88001234' ELSE 'XX1234' END, CASE bank WHEN 'santander' THEN '12/34 OAK HOLDINGS LLC #1' WHEN 'mt' THEN 'ELM HOLDINGS LLC' END, period_start, period_end, opening, closing, credit, debit, 0, agrees, NULL, NULL, NULL, NULL, NULL, NULL, NULL, delta, ok, NULL
 FROM (SELECT {_BOX}, CASE statement_id % 3 WHEN 0 THEN 'santander' WHEN 1 THEN 'mt' ELSE 'flagstar' END AS bank, CASE WHEN statement_id % 4 IN (0, 3) THEN true END AS agrees, closing - {_END} AS delta, coalesce(closing = {_END}, false) AS ok FROM {{statements}} WHERE opening >= 100 AND closing >= 100)""",
}.items()}
