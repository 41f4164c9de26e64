"""Check digits of Brazilian documents and structured patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import PATTERNS


def _digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), "[^0-9]", "")


def _check(d: Column, weights: list[int]) -> Column:
    total = sum((F.substring(d, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))
    rest = total % 11
    return F.when(rest < 2, F.lit(0)).otherwise(11 - rest)


def _valid(c: Column, n: int, shortest: int, first: list[int], second: list[int]) -> Column:
    raw = _digits(c)
    d = F.lpad(raw, n, "0")
    ok = F.length(raw).between(shortest, n) & (F.replace(d, F.substring(d, 1, 1), F.lit("")) != "")
    ones = _check(d, first) == F.substring(d, n - 1, 1).cast("int")
    twos = _check(d, second) == F.substring(d, n, 1).cast("int")
    return F.coalesce(F.when(ok, ones & twos), F.lit(False))


def cpf_valid(c: Column) -> Column:
    """Nine or ten digits are padded with zeros; one repeated digit is not valid."""
    return _valid(c, 11, 9, list(range(10, 1, -1)), list(range(11, 1, -1)))


def cnpj_valid(c: Column) -> Column:
    first = [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return _valid(c, 14, 12, first, [6, *first])


def has_shape(c: Column, kind: str) -> Column:
    return F.coalesce(F.trim(c).rlike(PATTERNS[kind]), F.lit(False))


def is_kind(c: Column, kind: str) -> Column:
    """The pattern's shape, and its check digits where it has them."""
    ok = has_shape(c, kind)
    return ok & (cpf_valid(c) if kind == "CPF" else cnpj_valid(c) if kind == "CNPJ" else F.lit(True))
