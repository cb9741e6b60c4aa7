"""Json values, kept as text and read as variants."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(s: Column) -> Column:
    """A variant; null where the text is no Json."""
    return F.try_parse_json(s)


def dumps(v: Column) -> Column:
    return F.to_json(v)


def at(*path: str | int) -> str:
    """Path of a field or element, for get and the as_ functions."""
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f"[{json.dumps(p)}]" for p in path)


def get(v: Column, *path: str | int, default: str | None = None) -> Column:
    x = F.try_variant_get(v, at(*path), "variant")
    return x if default is None else F.coalesce(x, F.parse_json(F.lit(default)))


def _as(v: Column, path: tuple, kind: str, default) -> Column:
    x = F.try_variant_get(v, at(*path), kind)
    return x if default is None else F.coalesce(x, F.lit(default))


def as_int(v: Column, *path: str | int, default: int | None = None) -> Column:
    return _as(v, path, "bigint", default)


def as_float(v: Column, *path: str | int, default: float | None = None) -> Column:
    return _as(v, path, "double", default)


def as_str(v: Column, *path: str | int, default: str | None = None) -> Column:
    return _as(v, path, "string", default)


def as_bool(v: Column, *path: str | int, default: bool | None = None) -> Column:
    return _as(v, path, "boolean", default)


def as_list(v: Column, *path: str | int) -> Column:
    return F.try_variant_get(v, at(*path), "array<variant>")


def as_dict(v: Column, *path: str | int) -> Column:
    return F.try_variant_get(v, at(*path), "map<string,variant>")
