"""Masking of personal data."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mask_name(name: Column) -> Column:
    """First and last character around three stars; a single character is left as it is."""
    return F.regexp_replace(name, "(^.).*(.)$", "$1***$2")


def mask_email(email: Column) -> Column:
    """First character, three stars, then the part from the last at-sign on."""
    return F.regexp_replace(email, "(^.).*(@.*)$", "$1***$2")


def birth_year(birth_date: Column) -> Column:
    """The first day of the year of birth."""
    return F.trunc(birth_date, "year")


def pseudonym(identifier: Column, salt: str) -> Column:
    """A keyed token: the same person joins across tables without showing who it is."""
    return F.sha2(F.concat(F.lit(salt), F.lit("|"), identifier.cast("string")), 256)
