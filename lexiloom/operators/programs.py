"""Modular programs over numbered sequences, and their inverses."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def affine(x: str, by: list[str], order: str, a: int, b: int, c: int, modulus: int) -> Column:
    """x + a * previous + b * first + c * index, modulo `modulus`; the first has no previous."""
    w = Window.partitionBy(*by).orderBy(order)
    out = F.col(x) + a * F.coalesce(F.lag(x).over(w), F.lit(0)) + b * F.first(x).over(w) + c * (F.row_number().over(w) - 1)
    return F.pmod(out, F.lit(modulus)).cast("int")


def running(x: str, by: list[str], order: str, sign: int, modulus: int) -> Column:
    """Running sum (sign 1) or negated running sum (sign -1), modulo `modulus`."""
    return F.pmod(sign * F.sum(x).over(Window.partitionBy(*by).orderBy(order)), F.lit(modulus)).cast("int")


def unrun(values: Column, sign: int, modulus: int) -> Column:
    """Inverse of `running`, on an array."""
    return F.transform(values, lambda v, i: F.pmod(sign * (v - F.when(i == 0, 0).otherwise(F.element_at(values, F.greatest(i, F.lit(1))))), F.lit(modulus)).cast("int"))


def unaffine(values: Column, a: int, b: int, c: int, modulus: int) -> Column:
    """Inverse of `affine`, on an array: each entry needs the one before it. 1 + b must have an inverse modulo `modulus`."""
    inverse = pow(1 + b, -1, modulus)
    first = F.pmod(F.element_at(values, 1) * inverse, F.lit(modulus))

    def step(acc: Column, v: Column) -> Column:
        i = F.size(acc)
        before = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.pmod(v - a * before - b * F.element_at(acc, 1) - c * i, F.lit(modulus)).cast("int")))

    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), F.array(first.cast("int")), step)).otherwise(F.array().cast("array<int>"))
