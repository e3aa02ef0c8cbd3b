"""Polynomials in x and y as text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A term is a number, a monomial, or both; terms are joined by signs.
MONOMIAL = r"(?:x(?:\^\d+)?(?:\*?y(?:\^\d+)?)?|y(?:\^\d+)?(?:\*?x(?:\^\d+)?)?)"
TERM = r"(?:\d+\.?\d*(?:\*?" + MONOMIAL + r")?|" + MONOMIAL + r")"
POLYNOMIAL = r"^[+-]?" + TERM + r"(?:[+-]" + TERM + r")*$"
SIGNED_TERM = r"[+-]?[^+-]+"


def is_polynomial(text: Column) -> Column:
    return text.rlike(POLYNOMIAL)


def signed_terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SIGNED_TERM), F.lit(0))


def exponent(term: Column, variable: str) -> Column:
    power = F.regexp_extract(term, variable + r"\^(\d+)", 1)
    return (
        F.when(~term.contains(variable), 0)
        .when(power == "", 1)
        .otherwise(F.try_to_number(power, F.lit("999999999")).cast("int"))
    )


def coefficient(term: Column) -> Column:
    number = F.regexp_extract(term, r"^[+-]?(\d+\.?\d*)", 1)
    size = F.when(number == "", 1.0).otherwise(F.nullif(number, F.lit("")).cast("double"))
    return F.when(term.startswith("-"), -size).otherwise(size)
