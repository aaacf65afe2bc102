"""Money as signed integer cents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: the pattern of an amount in running text; the whole part may be missing.
MONEY = r"(?<![\d.])-?\$?\(?(?:\d{1,3}(?:,\d{3})*|\d+)?\.\d{2}\)?-?"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sign(t: Column) -> Column:
    return F.when(t.startswith("-") | t.startswith("(") | t.endswith("-"), F.lit(-1)).otherwise(F.lit(1))


def to_cents(text: Column, dot_alone: int | None = 0) -> Column:
    """Cents of a written amount; null where it cannot be read.

    A leading ``-`` or ``(`` or a trailing ``-`` makes it negative; everything but digits
    and dots is dropped; the two places after the first dot are the cents, further ones
    are cut, not rounded.  A dot alone is ``dot_alone``; places that are no whole number of
    cents (as in 1..5) cannot be read.
    """

    def read(t: Column, bare: Column) -> Column:
        whole, dot = F.substring_index(bare, ".", 1), F.instr(bare, ".")
        places = F.rpad(F.when(dot > 0, F.substring(bare, dot + 1, F.lit(2))).otherwise(""), 2, "0")
        cents = _bound(places, lambda p: F.when(F.substring(p, 1, 1) != ".", F.regexp_replace(p, r"\.$", "")).when(p == ".0", "0").try_cast("bigint"))
        value = F.when(whole == "", F.lit(0).cast("long")).otherwise(whole.try_cast("bigint")) * 100 + cents
        return F.when(bare == "", F.lit(None).cast("long")).when(bare == ".", F.lit(dot_alone).cast("long")).otherwise(_sign(t) * value)

    return _bound(F.btrim(text), lambda t: _bound(F.regexp_replace(t, "[^0-9.]", ""), lambda bare: read(t, bare)))


#: Fixed value: what may be typed for an amount, signs and separators apart.
TYPED = r"^\d*\.?\d*$"


def input_cents(text: Column) -> Column:
    """An edited amount: blank is 0, only a leading minus is negative, else digits with at most
    one dot; a lone minus or dot cannot be read."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[$,\s]", "")
    body = F.regexp_replace(t, "^-", "")
    return F.when(t == "", F.lit(0).cast("long")).when(body.rlike(TYPED) & ~body.isin("", "."), to_cents(t))


def format_cents(cents: Column, missing: str | None = None) -> Column:
    """-$1,234.56; null as ``missing``."""
    a = F.abs(cents)
    shown = F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.floor(a / F.lit(100)).cast("long"), 0), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))
    return F.coalesce(shown, F.lit(missing)) if missing is not None else shown


def cents_to_input(cents: Column) -> Column:
    """Editable 123.45."""
    a = F.abs(cents)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(a / F.lit(100)).cast("string"), F.lit("."), F.lpad((a % 100).cast("string"), 2, "0"))


def money_tokens(line: Column) -> Column:
    """All amounts in a line, in order: the pattern leaves one dot and two places, so an amount's
    digits are its cents; one beyond a long is null."""
    return F.transform(F.regexp_extract_all(line, F.lit(MONEY), F.lit(0)), lambda x: _sign(x) * F.regexp_replace(x, "[^0-9]", "").try_cast("bigint"))


def amount_after(text: Column, label: Column, near: int = 60, far: int = 400) -> Column:
    """The first amount within ``near`` characters after a label, else within ``far``."""
    at = F.instr(F.lower(text), label) + F.length(label)
    first = lambda n: F.get(money_tokens(F.substring(text, at, F.lit(n))), F.lit(0))
    return F.when(F.instr(F.lower(text), label) > 0, F.coalesce(first(near), first(far)))
