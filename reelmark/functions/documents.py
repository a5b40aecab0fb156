"""JSON documents whose members aren't known beforehand. A text that isn't an object has no members; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def member_names(document: Column) -> Column:
    """Names of an object's members in the order of the text."""
    return F.json_object_keys(document)


def is_defined(document: Column, name: str) -> Column:
    """There is such a member, be it null."""
    return F.coalesce(F.array_contains(member_names(document), name), F.lit(False))


def member(document: Column, path: str, kind: str) -> Column:
    """The value at a path like $.a.b[0], null where there is none or it is of another kind."""
    return F.try_variant_get(F.try_parse_json(document), path, kind)


def without(document: Column, name: str) -> Column:
    """The document with a member deleted; values of all kinds stay as they are."""
    return F.to_json(F.map_filter(F.from_json(document, "map<string,variant>"), lambda key, value: key != name))
