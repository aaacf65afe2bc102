"""The scalar functions over written values, as queries: what each reads, beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money
from ..functions import text as tx
from ..plans.domain import Domain, duck
from ..sources.delimited import optional_cents


def _money(d: Domain) -> DataFrame:
    cents = money.to_cents(F.col("s"))
    return d.money.select("id", cents.alias("cents"), money.format_cents(cents).alias("shown"), money.cents_to_input(cents).alias("edit"), optional_cents(F.col("s")).alias("or_zero"), optional_cents(F.col("s"), None).alias("or_null"))


def _inputs(d: Domain) -> DataFrame:
    i = F.col("custody_id")
    typed = F.when(i % 7 == 0, "-").when(i % 7 == 1, " .").when(i % 7 == 2, "-$.5").when(i % 5 == 0, " ").when(i % 5 == 1, F.concat(F.lit("$ "), F.format_number((F.col("amount") / 100).cast("decimal(18,2)"), 2))).when(i % 5 == 2, F.concat(F.lit("-"), F.col("amount").cast("string"))).when(i % 5 == 3, "12a").otherwise(F.concat(F.lit("("), F.col("amount").cast("string"), F.lit(")")))
    return d.custody.select("custody_id", money.input_cents(typed).alias("cents"))


def _dates(d: Domain) -> DataFrame:
    i = F.col("lease_id")
    day = lambda f: F.date_format("signed_on", f)
    text = F.when(i % 6 == 0, day("M/d/yyyy")).when(i % 6 == 1, day("MM-dd-yyyy")).when(i % 6 == 2, day("M.d.yyyy")).when(i % 6 == 3, day("yyyy-MM-dd")).when(i % 6 == 4, "Pending").otherwise("13/45/2001")
    return d.leases.select("lease_id", dates.opt_date(text).alias("day"), dates.us_date(day("M/d"), F.year("signed_on")).alias("in_year"), dates.next_day(F.col("signed_on")).alias("next_day"), dates.days_between(F.col("signed_on"), F.col("vacated_on")).alias("days"), dates.age(F.col("signed_on"), F.lit("2001-08-01").cast("date")).alias("age"))


def _tokens(d: Domain) -> DataFrame:
    line = F.concat(F.lit("Deposit $"), F.format_number((F.col("deposit") / 100).cast("decimal(18,2)"), 2), F.lit(" fee (12.00) no 7 adj 3.10- end .50"))
    found = money.money_tokens(line)
    return d.leases.select("lease_id", F.size(found).cast("long").alias("n"), found[0].alias("first"), found[1].alias("second"), found[2].alias("third"), F.element_at(found, -1).alias("last"), money.amount_after(line, F.lit("adj")).alias("after"))


def _words(d: Domain) -> DataFrame:
    i = F.col("lease_id")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (i % len(xs) + 1).cast("int"))
    return d.leases.select(
        "lease_id", tx.norm_stage(pick(" Pooled ", "allocated", "Bank Closing", "closed-out", "??")).alias("stage"), tx.norm_kind(pick("Top up", "initial", "EXTRA", "")).alias("kind"), tx.truthy(pick("Yes", " 1 ", "RS", "n")).alias("lease_flag"),
        tx.truthy(pick("Yes", " 1 ", "RS", "n"), True).alias("seed_flag"), tx.digits(F.concat(F.lit("70-11 "), i.cast("string"), F.lit("th St"))).alias("digits"), tx.safe_name(F.concat(F.col("tenant"), F.lit(" (a).pdf"))).alias("safe"), tx.normalize_name(F.concat(F.lit("  "), "tenant", F.lit(" -- Jr."))).alias("name"),
    )


def resolve_names(names: DataFrame, buildings: DataFrame) -> DataFrame:
    """``building_id`` of each (label): the only building of that name, in any case, else the
    only one whose name or address has its digits, else null."""
    by_name = buildings.groupBy(F.lower(F.trim("name")).alias("_k")).agg(F.count("*").alias("_n"), F.max("building_id").alias("_a"))
    streams = buildings.select("building_id", F.explode(F.array(tx.digits(F.coalesce("name", F.lit(""))), tx.digits(F.coalesce("address", F.lit(""))))).alias("_d")).where("_d <> ''").groupBy("_d").agg(F.countDistinct("building_id").alias("_m"), F.max("building_id").alias("_b"))
    j = names.withColumn("_key", F.lower(F.trim("label"))).join(by_name, F.col("_key") == F.col("_k"), "left").join(streams, tx.digits(F.col("label")) == F.col("_d"), "left")
    return j.withColumn("building_id", F.coalesce(F.when(F.col("_n") == 1, F.col("_a")), F.when(F.col("_m") == 1, F.col("_b")))).select(*names.columns, "building_id")


def resolve_documents(names: DataFrame, buildings: DataFrame) -> DataFrame:
    """Per document: its buildings and the labels that name none."""
    r = resolve_names(names, buildings)
    return r.groupBy("doc_id").agg(F.countDistinct("building_id").alias("n_buildings"), F.concat_ws(",", F.array_sort(F.collect_set(F.col("building_id").cast("string")))).alias("buildings"), F.concat_ws("; ", F.array_sort(F.collect_set(F.when(F.col("building_id").isNull(), F.col("label"))))).alias("unresolved"))


#: Letters of an override by which labels that may hold it are found.
GRAM = 4


def overridden(labels: DataFrame, overrides: DataFrame) -> DataFrame:
    """(label, buildings) of labels in which an override stands, in any case, inside words and
    over blanks; of several the one of least ``ordinal`` holds, with all its buildings.

    An override is found by its first GRAM letters (all of a shorter one) among the places of a
    label, by one equi join, and then compared whole, so neither side need be small."""
    o = overrides.select("ordinal", F.upper("word").alias("w"), "building_id").where("w <> ''").withColumn("g", F.substring("w", 1, GRAM))
    key = F.upper(F.trim("label"))
    text = labels.select("label", key.alias("k")).distinct()
    places = F.sequence(F.lit(1), F.greatest(F.length("k"), F.lit(1)))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.substring(F.col("k"), i, n)))))
    hit = text.select("label", "k", F.explode(grams).alias("g")).join(o, "g").where(F.contains("k", F.col("w")))
    first = hit.groupBy("label", "ordinal").agg(F.array_sort(F.collect_set("building_id")).alias("ids"))  # an override's buildings
    return first.groupBy("label").agg(F.min_by("ids", "ordinal").alias("ids"))


def match_label(labels: DataFrame, buildings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Buildings of each label, in tiers, of which the first that finds any holds: the first
    override (ordinal, word, building_id) whose text stands in the label; equal digit streams;
    a run of at least three of its digits that begins a building's stream; a building's
    stream that begins its whole one.  Empty overrides are left out."""
    stream = buildings.select("building_id", tx.digits(F.col("name")).alias("s")).where("s <> ''")
    base = labels.select("label").distinct().withColumn("d", tx.digits(F.col("label")))
    runs = base.select("label", F.explode(F.array_distinct(F.regexp_extract_all("label", F.lit(r"(\d{3,})"), F.lit(1)))).alias("run"))
    begins = lambda c, least: F.when(F.length(c) >= least, F.transform(F.sequence(F.lit(least), F.greatest(F.length(c), F.lit(least))), lambda n: F.substring(c, F.lit(1), n)))
    starts = stream.select("building_id", F.explode(begins(F.col("s"), 3)).alias("p"))
    heads = base.select("label", F.explode(begins(F.col("d"), 1)).alias("p"))
    tiers = [
        overridden(base, overrides).select("label", F.lit(0).alias("tier"), F.explode("ids").alias("building_id")),
        base.where("d <> ''").join(stream, F.col("d") == F.col("s")).select("label", F.lit(1).alias("tier"), "building_id"),
        runs.join(starts, F.col("run") == F.col("p")).select("label", F.lit(2).alias("tier"), "building_id"),
        heads.join(stream, F.col("p") == F.col("s")).select("label", F.lit(3).alias("tier"), "building_id"),
    ]
    found = tiers[0].union(tiers[1]).union(tiers[2]).union(tiers[3])
    one = found.groupBy("label", "tier").agg(F.array_sort(F.collect_set("building_id")).alias("ids"))
    return base.select("label").join(one.groupBy("label").agg(F.min(F.struct("tier", "ids")).alias("b")), "label", "left").select("label", F.col("b.tier").alias("tier"), F.concat_ws(",", F.col("b.ids").cast("array<string>")).alias("buildings"))


def _addresses(d: Domain) -> DataFrame:
    return d.buildings.select("building_id", F.concat((F.col("building_id") * 37 + 100).cast("string"), F.lit("-"), (F.col("building_id") % 7 + 10).cast("string"), F.lit(" Street")).alias("name"), F.col("bbl").alias("address"))


def _resolve(d: Domain) -> DataFrame:
    """Labels: the name in capitals, the address, digits of nobody."""
    b = _addresses(d)
    i = F.col("doc_id")
    label = F.when(i % 3 == 0, F.upper(F.concat(F.lit(" "), "name"))).when(i % 3 == 1, F.concat(F.lit("lot "), "address")).otherwise(F.concat(F.lit("none 0"), i.cast("string")))
    named = d.leases.select((F.col("lease_id") % 400).alias("doc_id"), "building_id").distinct().join(b, "building_id").select("doc_id", label.alias("label"))
    return resolve_documents(named, b)


def _labels(d: Domain) -> DataFrame:
    """One label for each building and kind: an override inside a word and over a blank, the
    address without its hyphen, its first run, the address with more behind it, two digits."""
    b = _addresses(d)
    i, n = F.col("building_id"), F.col("building_id") * 37 + 100
    kinds = [
        F.concat(F.lit("The myZebra "), n.cast("string"), F.lit("Court, 99 9")),
        F.replace("name", F.lit("-"), F.lit(" ")),
        F.concat(n.cast("string"), F.lit(" Some St")),
        F.concat("name", F.lit(" "), (i % 3 + 4).cast("string"), F.lit("F")),
        F.concat(F.lit("lot "), F.substring(n.cast("string"), 1, 2)),
    ]
    shown = b.select(F.explode(F.array(*kinds)).alias("label"))
    first = b.select(F.lit(2).cast("long").alias("ordinal"), F.lit("zebra").alias("word"), "building_id").where("building_id < 3")
    own = b.where("building_id % 4 = 0").select((i * 0 + 1).alias("ordinal"), F.concat(F.lit("ZEBRA "), n.cast("string"), F.lit("c")).alias("word"), "building_id")
    return match_label(shown, b, own.union(first))


def _q(f):
    return lambda spark, sf_dir: f(Domain(spark, sf_dir))


QUERIES = {"fn01_money": _q(_money), "fn03_input_money": _q(_inputs), "fn06_money_tokens": _q(_tokens), "fn08_dates": _q(_dates), "fn19_words": _q(_words), "fn16_building_labels": _q(_labels), "fn18_document_buildings": _q(_resolve)}
_A = "(SELECT id, s, CASE WHEN length(replace(b, '.', '')) = 0 THEN CASE WHEN b = '.' THEN 0 END ELSE CASE WHEN regexp_matches(trim(s), '^[-(]') OR regexp_matches(trim(s), '-$') THEN -1 ELSE 1 END * (coalesce(try_cast(split_part(b, '.', 1) AS BIGINT), 0) * 100 + rpad(substr(split_part(b, '.', 2), 1, 2), 2, '0')::BIGINT) END AS cents FROM (SELECT id, s, regexp_replace(s, '[^0-9.]', '', 'g') AS b FROM {money}))"
_SHOW = "CASE WHEN cents < 0 THEN '-' ELSE '' END || '$' || format('{{:,}}', abs(cents) // 100) || '.' || lpad((abs(cents) % 100)::VARCHAR, 2, '0')"
_PICK = lambda *xs: "CASE " + " ".join(f"WHEN lease_id % {len(xs)} = {i} THEN {x}" for i, x in enumerate(xs)) + " END"
ORACLE = {
    "fn01_money": duck("SELECT id, cents, SHOWN AS shown, CASE WHEN cents < 0 THEN '-' ELSE '' END || abs(cents) // 100 || '.' || lpad((abs(cents) % 100)::VARCHAR, 2, '0') AS edit, CASE WHEN trim(s) IN ('', 'n/a', 'na', 'none', '-') THEN 0 ELSE cents END AS or_zero, CASE WHEN trim(s) IN ('', 'n/a', 'na', 'none', '-') THEN NULL ELSE cents END AS or_null FROM " + _A).replace("SHOWN", _SHOW.replace("{{:,}}", "{:,}")),
    "fn03_input_money": duck("SELECT custody_id, CASE WHEN custody_id % 7 IN (0, 1) THEN NULL WHEN custody_id % 7 = 2 THEN -50 WHEN custody_id % 5 = 0 THEN 0 WHEN custody_id % 5 = 1 THEN amount WHEN custody_id % 5 = 2 THEN -amount * 100 END::BIGINT AS cents FROM {custody}"),
    "fn06_money_tokens": duck("SELECT lease_id, 4 AS n, deposit AS first, -1200 AS second, -310 AS third, 50 AS last, -310 AS after FROM {leases}"),
    "fn08_dates": duck("SELECT lease_id, CASE WHEN lease_id % 6 < 4 THEN signed_on END AS day, signed_on AS in_year, signed_on + 1 AS next_day, abs(signed_on - vacated_on) AS days, DATE '2001-08-01' - signed_on AS age FROM {leases}"),
    "fn19_words": duck("SELECT lease_id, " + _PICK("'in_master'", "'in_subaccount'", "'bank_closing'", "'closed'", "'received'") + " AS stage, " + _PICK("'additional'", "'initial'", "'additional'", "'initial'") + " AS kind, lease_id % 4 <> 3 AS lease_flag, lease_id % 4 < 2 AS seed_flag, '7011' || lease_id AS digits, replace(replace(tenant, '#', '_'), ' ', '_') || '_a_.pdf' AS safe, replace(lower(tenant), '#', ' ') || ' jr' AS name FROM {leases}"),
    "fn16_building_labels": duck("""WITH b AS (SELECT building_id AS i, building_id * 37 + 100 AS n, (building_id * 37 + 100) || '-' || (building_id % 7 + 10) || ' Street' AS name FROM {buildings}),
s AS (SELECT i, n, regexp_replace(name, '[^0-9]', '', 'g') AS s, name FROM b),
l AS (SELECT DISTINCT unnest(['The myZebra ' || n || 'Court, 99 9', replace(name, '-', ' '), n || ' Some St', name || ' ' || (i % 3 + 4) || 'F', 'lot ' || left(n::VARCHAR, 2)]) AS label FROM s),
o AS (SELECT 1 AS ordinal, 'ZEBRA ' || n || 'C' AS w, i FROM s WHERE i % 4 = 0 UNION ALL SELECT 2, 'ZEBRA', i FROM s WHERE i < 3),
h AS (SELECT label, ordinal, i FROM l JOIN o ON contains(upper(label), w)),
f AS (SELECT label, 0 AS tier, i FROM h WHERE ordinal = (SELECT min(ordinal) FROM h AS g WHERE g.label = h.label)
 UNION ALL SELECT label, 1, i FROM l JOIN s ON regexp_replace(label, '[^0-9]', '', 'g') = s
 UNION ALL SELECT label, 2, i FROM (SELECT label, unnest(regexp_extract_all(label, '[0-9]{{3,}}')) AS r FROM l) JOIN s ON starts_with(s, r)
 UNION ALL SELECT label, 3, i FROM l JOIN s ON starts_with(regexp_replace(label, '[^0-9]', '', 'g'), s)),
t AS (SELECT *, min(tier) OVER (PARTITION BY label) AS best FROM f)
SELECT l.label, any_value(best) AS tier, coalesce(array_to_string(list_sort(list(DISTINCT i) FILTER (WHERE i IS NOT NULL)), ','), '') AS buildings FROM l LEFT JOIN t ON t.label = l.label AND tier = best GROUP BY l.label""").replace("{{3,}}", "{3,}"),
    "fn18_document_buildings": duck("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE count(DISTINCT building_id) END AS n_buildings, CASE WHEN doc_id % 3 = 2 THEN '' ELSE string_agg(DISTINCT building_id::VARCHAR, ',' ORDER BY building_id::VARCHAR) END AS buildings, CASE WHEN doc_id % 3 = 2 THEN 'none 0' || doc_id ELSE '' END AS unresolved FROM (SELECT DISTINCT lease_id % 400 AS doc_id, building_id FROM {leases}) GROUP BY doc_id"),
}
