"""The reconciliation domain, derived from the driver's tables.

Each frame is one statement of SQL that Spark and DuckDB both read, so that queries and
their oracles start from the same rows; the operators themselves are written twice,
as DataFrame code and as SQL.  Names in braces are other frames or tables.
Money is signed integer cents; ids are unique longs; dates are days.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .shared import write_once

#: The day on which everything with a clock is evaluated.
AS_OF = "2001-08-01"

FRAMES: dict[str, str] = {
    "buildings": """SELECT n_nationkey AS building_id, n_name AS name, 'BBL' || cast(n_nationkey AS string) AS bbl, cast(coalesce(c, 0) AS bigint) AS unit_count,
        coalesce(c, 0) >= 6 AS interest_required
        FROM {nation} LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM {supplier} GROUP BY s_nationkey) s ON s_nationkey = n_nationkey""",
    "accounts": """SELECT s_suppkey AS account_id, s_nationkey AS building_id, 'Bank ' || cast(s_suppkey % 5 AS string) AS bank_name,
        lpad(cast(s_suppkey % 10000 AS string), 4, '0') AS last4, CASE WHEN s_suppkey % 4 = 0 THEN 'operating' ELSE 'escrow' END AS account_type,
        s_suppkey % 3 = 0 AS interest_bearing FROM {supplier}""",
    "leases": """SELECT o_orderkey AS lease_id, c_nationkey AS building_id, 'U' || cast(o_orderkey % 40 AS string) AS unit, c_name AS tenant,
        cast(o_orderdate AS date) AS signed_on, cast(o_orderdate AS date) AS term_start,
        CASE WHEN o_orderstatus = 'F' THEN cast(o_orderdate AS date) + 365 END AS vacated_on,
        CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN cast(o_orderdate AS date) + 372 END AS keys_on,
        cast(round(o_totalprice * 100) AS bigint) AS deposit, cast(round(o_totalprice * 100) AS bigint) - CASE WHEN o_orderkey % 9 = 0 THEN 5000 ELSE 0 END AS rent,
        o_orderkey % 7 = 0 AS stabilized FROM {orders} JOIN {customer} ON c_custkey = o_custkey""",
    "txns": """SELECT lease_id * 10 + 1 AS txn_id, building_id, 'escrow' AS account_type, CASE WHEN lease_id % 10 = 7 THEN deposit - 1 ELSE deposit END AS amount,
        cast(signed_on + cast(lease_id % 40 AS int) AS date) AS posted_on, 'DEPOSIT ' || tenant AS descriptor, CASE WHEN lease_id % 11 = 0 THEN cast(lease_id AS string) END AS check_no, cast(NULL AS string) AS counterparty FROM {leases} WHERE lease_id % 10 <> 8
        UNION ALL SELECT lease_id * 10 + 2, building_id, 'escrow', -deposit, cast(vacated_on + cast(lease_id % 90 AS int) AS date), 'REFUND ' || tenant, cast(NULL AS string), CASE WHEN lease_id % 23 = 0 THEN 'SOMEBODY ELSE' END FROM {leases} WHERE vacated_on IS NOT NULL AND lease_id % 4 <> 0
        UNION ALL SELECT lease_id * 10 + 3, (building_id + 1) % 25, 'escrow', deposit, cast(vacated_on + cast(lease_id % 90 AS int) + 2 AS date), 'TRANSFER IN', cast(NULL AS string), cast(NULL AS string) FROM {leases} WHERE vacated_on IS NOT NULL AND lease_id % 50 = 1
        UNION ALL SELECT lease_id * 10 + 4, building_id, 'escrow', -deposit, cast(vacated_on + cast(lease_id % 90 AS int) + 20 AS date), 'CHECK PAID ' || tenant, cast(NULL AS string), cast(NULL AS string) FROM {leases} WHERE vacated_on IS NOT NULL AND lease_id % 17 = 0
        UNION ALL SELECT lease_id * 10 + 5, building_id, 'escrow', -deposit, cast(signed_on + 200 AS date), 'REFUND ' || tenant, cast(NULL AS string), cast(NULL AS string) FROM {leases} WHERE vacated_on IS NULL AND lease_id % 37 = 0
        UNION ALL SELECT lease_id * 10 + 6, building_id, 'escrow', -250000 - lease_id, cast(signed_on + 60 AS date), 'TRANSFER TO OPERATING', cast(NULL AS string), CASE WHEN lease_id % 2 = 0 THEN 'ACCT 0004' END FROM {leases} WHERE lease_id % 101 = 0
        UNION ALL SELECT lease_id * 10 + 7, building_id, 'escrow', 100 + lease_id % 50, cast(signed_on + 90 AS date), 'INTEREST CREDIT', cast(NULL AS string), cast(NULL AS string) FROM {leases} WHERE lease_id % 97 = 0""",
    "ledger": """SELECT lease_id * 10 + 1 AS ledger_id, lease_id, 'initial_deposit' AS entry_type, deposit AS amount, cast(signed_on + cast(lease_id % 8 AS int) AS date) AS entry_date, CASE WHEN lease_id % 11 = 0 THEN 'check ' || cast(lease_id AS string) END AS note FROM {leases}
        UNION ALL SELECT lease_id * 10 + 2, lease_id, 'refund', -deposit, cast(vacated_on + 10 AS date), cast(NULL AS string) FROM {leases} WHERE vacated_on IS NOT NULL AND lease_id % 5 <> 0
        UNION ALL SELECT lease_id * 10 + 3, lease_id, 'interest_credit', 100, cast(signed_on + 90 AS date), cast(NULL AS string) FROM {leases} WHERE building_id % 5 <> 0 AND lease_id % 10 = 3
        UNION ALL SELECT lease_id * 10 + 4, lease_id, 'additional_deposit', deposit, cast(signed_on + cast(lease_id % 8 AS int) AS date), cast(NULL AS string) FROM {leases} WHERE lease_id % 13 = 0""",
    "matches": """SELECT txn_id, lease_id + CASE WHEN txn_id % 29 = 0 THEN 1 ELSE 0 END AS lease_id, CASE WHEN txn_id % 3 = 0 THEN 'fuzzy' ELSE 'exact' END AS method,
        CASE WHEN txn_id % 2 = 0 THEN cast(NULL AS string) ELSE 'reviewer' END AS decided_by FROM (SELECT txn_id, cast(floor(txn_id / 10) AS bigint) AS lease_id FROM {txns}) t WHERE txn_id % 7 <> 0""",
    "statements": """SELECT building_id * 100000 + m AS statement_id, building_id, period_start, period_end, opening, CASE WHEN (building_id * 31 + m) % 17 = 0 THEN closing + 1 ELSE closing END AS closing, (building_id * 31 + m) % 17 <> 0 AS checksum_ok
        FROM (SELECT building_id, m, period_start, period_end, 100000000 + cast(sum(net) OVER (PARTITION BY building_id ORDER BY m) AS bigint) AS closing, 100000000 + cast(sum(net) OVER (PARTITION BY building_id ORDER BY m) - net AS bigint) AS opening
          FROM (SELECT building_id, year(posted_on) * 12 + month(posted_on) AS m, cast(sum(amount) AS bigint) AS net, min(cast(date_trunc('month', posted_on) AS date)) AS period_start, min(last_day(posted_on)) AS period_end FROM {txns} GROUP BY building_id, year(posted_on) * 12 + month(posted_on)) a) b
        WHERE (building_id + m) % 23 <> 0""",
    "custody": """SELECT lease_id AS custody_id, building_id, unit, tenant, CASE WHEN lease_id % 9 = 0 THEN 'additional' ELSE 'initial' END AS kind, deposit AS amount, signed_on AS received_on,
        CASE WHEN lease_id % 7 <> 0 THEN cast(signed_on + cast(lease_id % 9 AS int) AS date) END AS sent_on,
        CASE WHEN lease_id % 7 <> 0 AND lease_id % 5 <> 0 THEN cast(signed_on + cast(lease_id % 9 AS int) + 3 AS date) END AS cleared_on,
        CASE WHEN lease_id % 6 = 0 THEN deposit ELSE 0 END AS in_master, CASE WHEN lease_id % 4 = 1 THEN lpad(cast(lease_id % 10000 AS string), 4, '0') WHEN lease_id % 4 = 2 THEN '' END AS sub_last4,
        CASE WHEN lease_id % 8 IN (1, 6) THEN cast(signed_on + 20 AS date) END AS sub_opened_on,
        CASE lease_id % 13 WHEN 0 THEN 'received' WHEN 1 THEN 'in_master' WHEN 2 THEN 'subaccount_pending' WHEN 3 THEN 'in_subaccount' WHEN 4 THEN 'active' WHEN 5 THEN 'active' WHEN 6 THEN 'in_subaccount' WHEN 7 THEN 'vacated' WHEN 8 THEN 'bank_closing' WHEN 9 THEN 'funds_returned' WHEN 10 THEN 'funds_returned' WHEN 11 THEN 'refunded' ELSE 'closed' END AS stage,
        vacated_on AS vacate_on, CASE WHEN lease_id % 19 = 0 THEN cast(signed_on + 420 AS date) END AS bank_closed_on,
        CASE WHEN lease_id % 13 IN (9, 10) THEN cast(signed_on + 400 AS date) END AS returned_on, CASE WHEN lease_id % 39 = 9 THEN deposit - 100 END AS returned_amount,
        CASE WHEN lease_id % 26 = 9 THEN cast(signed_on + 405 AS date) END AS refunded_on,
        CASE WHEN lease_id % 3 <> 0 THEN deposit - CASE WHEN lease_id % 10 = 1 THEN 5000 ELSE 0 END END AS bank_balance, CASE WHEN lease_id % 5 <> 0 THEN deposit END AS books_balance,
        CASE WHEN lease_id % 2 = 0 THEN ' R' || cast(lease_id AS string) || ' ' WHEN lease_id % 3 = 0 THEN '  ' END AS external_ref FROM {leases}""",
    "votes": " UNION ALL ".join(
        f"""SELECT building_id AS doc_id, lease_id AS account_id, {reader} AS reader, CASE WHEN lease_id % 7 <> {reader} THEN unit END AS unit,
        CASE WHEN building_id % 3 <> 0 THEN CASE WHEN lease_id % 5 = {reader} THEN NULL ELSE deposit END ELSE CASE (lease_id * {reader}) % 5 WHEN 0 THEN NULL WHEN 1 THEN deposit + {reader} WHEN 2 THEN deposit + {reader} ELSE deposit END END AS value FROM {{leases}}"""
        for reader in (1, 2, 3, 4)
    ),
    "printed": """SELECT building_id AS doc_id, cast(sum(deposit) + CASE WHEN building_id % 5 = 1 THEN 7 ELSE 0 END AS bigint) AS grand, CASE WHEN building_id % 2 = 0 THEN cast(sum(deposit) AS bigint) END AS grand_alt,
        CASE WHEN building_id % 4 <> 0 THEN count(*) + CASE WHEN building_id % 11 = 2 THEN 1 ELSE 0 END END AS reported FROM {leases} GROUP BY building_id""",
    "boxes": " UNION ALL ".join(
        f"""SELECT statement_id AS doc_id, {reader} AS reader, opening, CASE WHEN statement_id % 6 = {reader} THEN NULL ELSE closing END AS closing, CASE WHEN statement_id % 5 = {reader} THEN 1 WHEN closing > opening THEN closing - opening ELSE 0 END AS credit,
        CASE WHEN statement_id % 13 = 0 THEN {reader} WHEN closing < opening THEN opening - closing ELSE 0 END AS debit FROM {{statements}}"""
        for reader in (1, 2, 3)
    ),
    "journal": """SELECT user_id AS path, event_type AS status, event_id AS ordinal, ts FROM {events}""",
    "money": """SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN '$' || a WHEN 1 THEN '(' || a || ')' WHEN 2 THEN a || '-' WHEN 3 THEN '-' || a WHEN 4 THEN '  ' || a || ' ' ELSE CASE WHEN c_custkey % 8 = 5 THEN '12.34.56' WHEN c_custkey % 4 = 1 THEN '.' WHEN c_custkey % 4 = 3 THEN 'n/a' ELSE '' END END AS s
        FROM (SELECT c_custkey, cast(cast(floor(abs(c_acctbal)) AS bigint) AS string) || CASE c_custkey % 4 WHEN 0 THEN '.5' WHEN 1 THEN '.25' WHEN 2 THEN '' ELSE '.999' END AS a FROM {customer}) m""",
}


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


#: Frames that others are derived from, or that take more than a scan to make.
DERIVED = ("leases", "txns", "ledger", "matches", "statements")


class Domain:
    """Frames by name, built when first asked for.  With ``prepared`` the derived ones are
    written once to the shared folder, as Parquet, and read column by column from there."""

    def __init__(self, spark: SparkSession, sf_dir: str, prepared: bool = False):
        self.spark, self.sf_dir, self.prepared = spark, sf_dir, prepared
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            sql = FRAMES.get(name)
            frame = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet") if sql is None else self.spark.sql(sql, **{n: self[n] for n in needs(sql)})
            self._frames[name] = write_once(frame) if self.prepared and name in DERIVED else frame
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]


def duck(sql: str) -> str:
    """A query over the domain as one DuckDB statement: the frames that it needs, then itself."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in needs(text):
            if n in FRAMES and n not in order:
                add(FRAMES[n])
                order.append(n)

    add(sql)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s).replace(" AS string)", " AS varchar)")
    body = plain(sql)
    if not order:
        return body
    ctes = ", ".join(f"{n} AS MATERIALIZED ({plain(FRAMES[n])})" for n in order)
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"


__all__ = ["AS_OF", "FRAMES", "Domain", "duck"]
