"""Instrument codes and dates as columns; every function is a JVM expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCHANGES = ("sh", "sz", "bj")
WIDE = "".join(chr(0xFF10 + i) for i in range(10)) + "".join(chr(0xFF41 + i) for i in range(26))
NARROW = "0123456789abcdefghijklmnopqrstuvwxyz"
_PREFIX = "^(" + "|".join(EXCHANGES) + ")"
VALID_CODE = _PREFIX + "[0-9]{6}$"
ISO_DAY = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_SPLIT_DAY = r"^[^0-9]*([0-9]{4})[-/.年\s]+([0-9]{1,2})[-/.月\s]+([0-9]{1,2})(?![0-9])"
_SOLID_DAY = r"^[^0-9]*([0-9]{4})([0-9]{2})([0-9]{2})(?:[0-9]{4}|[0-9]{6})?(?![0-9])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal_code(code: Column) -> Column:
    """Exchange prefix and six digits, or null where the text has no such form (null, empty, foreign)."""

    def swapped(s: Column) -> Column:
        return F.when((F.length(s) == 8) & s.rlike("(sh|sz|bj)$"), F.concat(F.right(s, F.lit(2)), F.left(s, F.lit(6)))).otherwise(s)

    def repaired(s: Column) -> Column:
        r = F.translate(s, "oil", "011")
        return F.when(r.rlike(_PREFIX + "|^[0-9]+$"), r).otherwise(s)

    def placed(s: Column) -> Column:
        return F.when(s.rlike(_PREFIX), F.when(s.rlike(VALID_CODE), s)).otherwise(let(F.regexp_replace(s, "[^0-9]", ""), bare))

    def bare(d: Column) -> Column:
        return F.when(
            F.length(d) == 6,
            F.when(d.rlike("^(6|9|51|56|58)"), F.concat(F.lit("sh"), d)).when(d.rlike("^(0|3|15|16|18)"), F.concat(F.lit("sz"), d)).when(d.rlike("^[48]"), F.concat(F.lit("bj"), d)),
        )

    plain = F.regexp_replace(F.translate(F.lower(code), WIDE, NARROW), "[^a-z0-9]", "")
    slow = let(plain, lambda a: let(swapped(a), lambda b: let(repaired(b), placed)))
    return F.when(code.rlike(VALID_CODE), code).otherwise(slow)


def readable_day(text: Column) -> Column:
    """The date a text holds as year, month, day; null where there is none or the day isn't real."""

    def parts(s: Column) -> Column:
        pick = lambda k: F.coalesce(F.nullif(F.regexp_extract(s, _SPLIT_DAY, k), F.lit("")), F.nullif(F.regexp_extract(s, _SOLID_DAY, k), F.lit("")))
        return F.concat_ws("-", pick(1), F.lpad(pick(2), 2, "0"), F.lpad(pick(3), 2, "0"))

    day = F.when(text.rlike(ISO_DAY), text).otherwise(let(F.translate(text, WIDE, NARROW), parts))
    return F.when(F.length(day) == 10, day.try_cast("date"))


def folded(text: Column) -> Column:
    """Text trimmed of any white space or zero-width mark and without regard to letter case; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(text, r"^[\s\p{Z}​﻿]+|[\s\p{Z}​﻿]+$", "")), F.lit(""))
