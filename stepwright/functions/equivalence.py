"""Exact equality of answers, with three outcomes: equal, different, undecided (NULL)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_answer


def fraction(c: Column) -> tuple[Column, Column]:
    """Numerator and denominator (decimals of 38 digits) of a plain number or fraction; NULL if it is neither or too long."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\\[dt]?frac\{([-+]?\d+)\}\{(\d+)\}$", "$1/$2")
    plain = t.rlike(r"^[-+]?\d{1,12}(\.\d{1,6})?$")
    quotient = t.rlike(r"^[-+]?\d{1,12}/\d{1,12}$")
    part = lambda i: F.get(F.split(t, "/"), F.lit(i)).try_cast("decimal(38,6)")
    top = F.when(plain, t.try_cast("decimal(38,6)")).when(quotient, part(0))
    bottom = F.when(plain, F.lit(1).cast("decimal(38,6)")).when(quotient, F.when(part(1) != 0, part(1)))
    return top, bottom


def equivalent(prediction: Column, gold: Column) -> Column:
    """False for an empty prediction, True for equal normalized texts, exact comparison of numbers, else NULL."""
    p, g = normalize_answer(prediction), normalize_answer(gold)
    (a, b), (c, d) = fraction(p), fraction(g)
    exact = a.cast("decimal(19,6)") * d.cast("decimal(19,6)") == c.cast("decimal(19,6)") * b.cast("decimal(19,6)")
    return F.when(p == "", False).when(p == g, True).otherwise(exact)
