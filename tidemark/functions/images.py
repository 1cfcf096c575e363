"""Partial before/after images of change events, held as ``map<string,string>``.

A map keeps "the key is absent" (no change) apart from "the key is present and null" (set to null).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def image(document: Column, path: str) -> Column:
    """The object at ``path`` of a VARIANT as a map. Numbers keep all their digits; null stays null."""
    return F.try_variant_get(document, path, "map<string,string>")


def present(images: Column, key: str) -> Column:
    """True where the image names the key, even with a null value; false for a missing image."""
    return F.coalesce(F.map_contains_key(images, F.lit(key)), F.lit(False))


def value(images: Column, key: str) -> Column:
    return F.try_element_at(images, F.lit(key))


def value_or(images: Column, key: str, default: Column | str) -> Column:
    """The present value, null included, else the default."""
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.when(present(images, key), value(images, key)).otherwise(fallback)


def money(images: Column, key: str) -> Column:
    """The value as money, so that ``1250.0`` equals ``1250.00``."""
    return value(images, key).try_cast("decimal(18,2)")
