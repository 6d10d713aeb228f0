"""JSON and nested-document helpers as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlake.functions.timex import col


def json_num(c, path: str) -> Column:
    """Finite number at a JSON path; invalid JSON, text and NaN read as null."""
    value = F.get_json_object(col(c), path).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def json_text(c, path: str) -> Column:
    return F.get_json_object(col(c), path)


def first_json_num(c, keys, low: float | None = None, high: float | None = None) -> Column:
    """First key whose number lies in the range."""
    def checked(key):
        value = json_num(c, f"$.{key}")
        return value if low is None else F.when(value.between(low, high), value)
    return F.coalesce(*[checked(key) for key in keys])


def first_json_label(c, keys, allowed) -> Column:
    """First key whose trimmed, lower-cased text is one of ``allowed``."""
    def checked(key):
        value = F.lower(F.trim(json_text(c, f"$.{key}")))
        return F.when(value.isin(*allowed), value)
    return F.coalesce(*[checked(key) for key in keys])


def allele_map(c) -> Column:
    return F.from_json(col(c), "map<string,double>")


def map_total(m) -> Column:
    return F.aggregate(F.map_values(col(m)), F.lit(0.0), lambda a, v: a + v)


def shared_keys(left, right) -> Column:
    return F.array_sort(F.array_intersect(F.map_keys(col(left)), F.map_keys(col(right))))


def all_keys(left, right) -> Column:
    return F.array_sort(F.array_union(F.map_keys(col(left)), F.map_keys(col(right))))


def distinct_ordered(arr) -> Column:
    return F.array_distinct(col(arr))


def merge_ids(*arrays) -> Column:
    """Sorted union of id arrays; a null array counts as empty."""
    empty = F.array().cast("array<bigint>")
    parts = [F.coalesce(col(a), empty) for a in arrays]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*parts))))


def to_document(*cols) -> Column:
    return F.to_json(F.struct(*[col(c) for c in cols]))


def decode_json(c) -> Column:
    """Variant of a text column that looks like an object or array, else null."""
    text = col(c)
    return F.when(text.startswith("{") | text.startswith("["), F.try_parse_json(text))


def measurements_map(columns) -> Column:
    """map of the measurements a sensor reported."""
    pairs = reduce(lambda a, n: a + [F.lit(n), F.col(n).cast("double")], columns, [])
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
