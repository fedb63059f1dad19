"""JSON documents: look up, merge, drop, test, strip, set.

Flat ones as maps of texts; nested ones as variants, whose values keep their
types. A variant is changed by path: the objects on the way are opened as maps
of variants and closed again, all else stays as it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,string>"


def fields(json: Column) -> Column:
    """A JSON object as a map of its fields' texts; null for anything else."""
    return F.from_json(json, MAP, {"mode": "PERMISSIVE"})


def merged(a: Column, b: Column) -> Column:
    """Fields of both, those of ``b`` where both have one."""
    keep = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.map_concat(keep, b)


def without(doc: Column, *keys: str) -> Column:
    return F.map_filter(doc, lambda k, _: ~k.isin(*keys))


def has_any(doc: Column, *keys: str) -> Column:
    """Whether any of the fields is there."""
    return F.arrays_overlap(F.map_keys(doc), F.array(*map(F.lit, keys)))


def stripped(doc: Column) -> Column:
    """Without null fields."""
    return F.map_filter(doc, lambda _, v: v.isNotNull())


def with_field(doc: Column, key: str, value: Column) -> Column:
    return merged(doc, F.create_map(F.lit(key), value))


def strings(json: Column) -> Column:
    """A JSON array's texts."""
    return F.from_json(json, "array<string>")


def conditions(**named: Column) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in named.items())))


def parsed(json: Column) -> Column:
    """Text as a variant, null where it is no JSON."""
    return F.try_parse_json(json)


def at(doc: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path such as ``$.device.os`` or ``$.items[0].sku``; null where there is none of this type."""
    return F.try_variant_get(doc, path, kind)


def opened(doc: Column) -> Column:
    """An object's fields as a map of variants; null for anything else, a missing value included."""
    is_object = F.schema_of_variant(doc).startswith("OBJECT")
    return F.when(is_object, doc.cast("map<string,variant>"))


def closed(members: Column) -> Column:
    """A map of variants as an object."""
    return F.to_variant_object(members)


def variant(value: Column) -> Column:
    """A column's value as a variant; null stays null."""
    return F.variant_get(F.to_variant_object(F.struct(value.alias("v"))), "$.v", "variant")


def _bound(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.transform(F.array(value), then)[0]


def with_path(doc: Column, path: Sequence[str], value: Column) -> Column:
    """The document with a value at a path of field names, which may be new at its end.

    Where something on the way is no object, or is not there, the document stays
    as it is, as with a missing parent.
    """
    head, rest = path[0], path[1:]

    def put(members: Column) -> Column:
        inner = with_path(members[head], rest, value) if rest else value
        return closed(merged(members, F.create_map(F.lit(head), inner)))

    there = (lambda m: F.map_contains_key(m, head)) if rest else (lambda m: F.lit(True))
    return _bound(opened(doc), lambda m: F.when(m.isNotNull() & there(m), put(m)).otherwise(doc))


def without_path(doc: Column, path: Sequence[str]) -> Column:
    """The document without what stands at a path of field names."""
    head, rest = path[0], path[1:]

    def drop(members: Column) -> Column:
        if not rest:
            return closed(without(members, head))
        return closed(merged(members, F.create_map(F.lit(head), without_path(members[head], rest))))

    return _bound(opened(doc), lambda m: F.when(m.isNotNull() & F.map_contains_key(m, head), drop(m)).otherwise(doc))


def elements(doc: Column, path: str) -> Column:
    """The values of the array at a path, as variants; null if there is none."""
    return F.try_variant_get(doc, path, "array<variant>")


def texts(doc: Column, path: str) -> Column:
    """The texts among the elements of the array at a path."""
    return F.array_compact(F.transform(elements(doc, path), lambda x: F.when(F.schema_of_variant(x) == "STRING", x.try_cast("string"))))
