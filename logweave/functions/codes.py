"""PRI codes: decoding, splitting and naming. All are column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave import schema as S


def _literal_map(codes: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(codes.items())])


def pri_digits(line: Column) -> Column:
    """The digits after a leading ``<``; null when the line has no PRI."""
    return F.when(F.startswith(line, F.lit("<")), F.regexp_extract(line, "^<([0-9]*)", 1))


def pri_value(digits: Column, default: int = S.USER_NOTICE) -> Column:
    """PRI from its digits; ``default`` when absent or out of range, 0 for none."""
    number = F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("bigint"))
    return F.when(number <= S.MAX_PRI, number.cast("int")).otherwise(default)


def after_pri(line: Column, digits: Column) -> Column:
    """The line without its PRI; the closing ``>`` is optional."""
    at = F.length(digits) + 2
    closed = F.substr(line, at, F.lit(1)) == ">"
    return F.when(digits.isNull(), line).otherwise(F.substr(line, at + closed.cast("int")))


def decode_pri(line: Column, default: int = S.USER_NOTICE) -> Column:
    """The PRI at the head of a line."""
    return pri_value(pri_digits(line), default)


def strip_pri(line: Column) -> Column:
    """The line without its PRI head."""
    return after_pri(line, pri_digits(line))


def strip_device_head(line: Column) -> Column:
    """Drop a redundant ``<n>`` of a device line whose PRI came separately."""
    return F.regexp_replace(line, "^<[0-9]*>", "")


def guard_kernel(pri: Column, is_kernel: Column) -> Column:
    """Records of the kernel facility from other sources become user records."""
    foreign = (F.shiftright(pri, 3) == 0) & ~F.coalesce(is_kernel, F.lit(False))
    return F.when(foreign, pri.bitwiseOR(F.lit(8))).otherwise(pri)


def facility_of(pri: Column) -> Column:
    return F.shiftright(pri, 3)


def severity_of(pri: Column) -> Column:
    return pri.bitwiseAND(F.lit(7))


def facility_name(fac: Column) -> Column:
    """Name of a facility; an unknown one is shown as its PRI number."""
    names = {v: k for k, v in S.FACILITY_CODES.items()} | {S.MARK_FACILITY: "mark"}
    return F.coalesce(_literal_map(names)[fac], (fac * 8).cast("string"))


def severity_name(sev: Column) -> Column:
    names = {v: k for k, v in S.SEVERITY_CODES.items()}
    return F.coalesce(_literal_map(names)[sev], sev.cast("string"))


def facility_code(name: Column) -> Column:
    """Facility number of a name or of a PRI-scaled number; null when unknown."""
    number = name.try_cast("int")
    known = _literal_map(S.FACILITY_CODES | S.FACILITY_ALIASES)[F.lower(name)]
    scaled = F.when((number % 8 == 0) & number.between(0, 184), F.shiftright(number, 3))
    return F.when(name.rlike("^[0-9]+$"), scaled).otherwise(known)


def severity_code(name: Column) -> Column:
    """Severity of a name or of a number 0 to 7; null when unknown."""
    number = name.try_cast("int")
    known = _literal_map(S.SEVERITY_CODES | S.SEVERITY_ALIASES)[F.lower(name)]
    return (F.when(name.rlike("^[0-9]+$"), F.when(number.between(0, 7), number))
            .otherwise(known))
