"""JSON inside texts: finding, validity, repair, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An object with up to two levels of nested objects.
OBJECT = r"\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}"


def objects(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(OBJECT), F.lit(0))


def is_valid(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def has_valid(c: Column) -> Column:
    return F.exists(objects(c), is_valid)


def validity_score(c: Column) -> Column:
    """Share of the objects in a text that parse; 0 without any."""
    found = objects(c)
    return F.when(F.size(found) == 0, 0.0).otherwise(F.size(F.filter(found, is_valid)) / F.size(found))


def repair(c: Column) -> Column:
    """Double quotes for single ones, no comma before a closing bracket."""
    return F.regexp_replace(F.replace(c, F.lit("'"), F.lit('"')), r",\s*([}\]])", "$1")


def needs_repair(c: Column) -> Column:
    """No object of the text parses, but the repaired first one does."""
    first = F.get(objects(c), 0)
    return first.isNotNull() & ~has_valid(c) & is_valid(repair(first))


def keys(c: Column) -> Column:
    return F.array_sort(F.json_object_keys(c))
