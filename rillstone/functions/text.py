"""Text functions, on code points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parse_bool reads.
TRUE_VALUES = ("on", "true", "yes", "1", "y", "t")
FALSE_VALUES = ("off", "false", "no", "0", "n", "f")


def lower(s: Column) -> Column:
    return F.lower(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def reversed_(s: Column) -> Column:
    return F.reverse(s)


def length(s: Column) -> Column:
    return F.length(s).cast("bigint")


def replace(s: Column, old: str, new: str, count: int = -1) -> Column:
    """All occurrences of old, or the first count of them, replaced by new."""
    if count < 0:
        return F.replace(s, F.lit(old), F.lit(new)) if old else F.concat(F.lit(new), F.array_join(F.split(s, ""), new), F.when(F.length(s) > 0, F.lit(new)).otherwise(F.lit("")))
    if count == 0:
        return s
    parts = F.split(s, _quoted(old), count + 1)
    return F.array_join(parts, new)


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def startswith(s: Column, prefix: str) -> Column:
    return s.startswith(prefix)


def endswith(s: Column, suffix: str) -> Column:
    return s.endswith(suffix)


def swapcase(s: Column) -> Column:
    chars = F.transform(F.split(s, ""), lambda c: F.when(c == F.upper(c), F.lower(c)).otherwise(F.upper(c)))
    return F.array_join(chars, "")


def strip(s: Column, chars: str | None = None) -> Column:
    """Without leading and trailing white space, or any of chars."""
    return F.regexp_replace(s, r"^\s+|\s+$", "") if chars is None else F.btrim(s, F.lit(chars))


def lstrip(s: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(s, r"^\s+", "") if chars is None else F.ltrim(s, F.lit(chars))


def rstrip(s: Column, chars: str | None = None) -> Column:
    return F.regexp_replace(s, r"\s+$", "") if chars is None else F.rtrim(s, F.lit(chars))


def title(s: Column) -> Column:
    """Every run of letters with its first one in upper case and the others in lower case."""
    runs = F.regexp_extract_all(s, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))), "")


def _cut(s: Column, start: int | None, end: int | None) -> Column:
    return s if start is None and end is None else slice_(s, start or 0, end)


def count(s: Column, sub: str, start: int | None = None, end: int | None = None) -> Column:
    """Occurrences of sub that don't overlap, in [start, end)."""
    t = _cut(s, start, end)
    if not sub:
        return (F.length(t) + 1).cast("bigint")
    return ((F.length(t) - F.length(F.replace(t, F.lit(sub), F.lit("")))) / len(sub)).cast("bigint")


def find(s: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    """Lowest index of sub in [start, end), -1 if there is none."""
    at = F.locate(sub, _cut(s, start, end) if start or end is not None else s)
    return F.when(s.isNotNull(), F.when(at > 0, at - 1 + start).otherwise(-1)).cast("bigint")


def rfind(s: Column, sub: str, start: int = 0, end: int | None = None) -> Column:
    """Highest index of sub in [start, end), -1 if there is none."""
    t = _cut(s, start, end) if start or end is not None else s
    at = F.locate(sub[::-1], F.reverse(t))
    return F.when(s.isNotNull(), F.when(at > 0, F.length(t) - at + 1 - len(sub) + start).otherwise(-1)).cast("bigint")


def removeprefix(s: Column, prefix: str) -> Column:
    return F.when(s.startswith(prefix), s.substr(F.lit(len(prefix) + 1), F.length(s))).otherwise(s)


def removesuffix(s: Column, suffix: str) -> Column:
    return F.when(s.endswith(suffix), s.substr(F.lit(1), F.length(s) - len(suffix))).otherwise(s) if suffix else s


def slice_(s: Column, start: int, end: int | None) -> Column:
    """Characters [start, end), negative indices counting from the end."""
    n = F.length(s)
    at = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.least(F.lit(i), n)
    a, b = at(start), n if end is None else at(end)
    return s.substr(a + 1, F.greatest(b - a, F.lit(0)))


def parse_int(s: Column, optional: bool = False) -> Column:
    t = F.trim(s)
    return t.try_cast("bigint") if optional else t.cast("bigint")


def parse_float(s: Column, optional: bool = False) -> Column:
    t = F.trim(s)
    return t.try_cast("double") if optional else t.cast("double")


def parse_bool(s: Column, true_values: Sequence[str] = TRUE_VALUES, false_values: Sequence[str] = FALSE_VALUES, optional: bool = False) -> Column:
    """Truth value of a text in either list, whatever its case; otherwise an error, or null."""
    t = F.lower(s)
    known = F.when(t.isin([x.lower() for x in true_values]), True).when(t.isin([x.lower() for x in false_values]), False)
    return known if optional else known.when(s.isNull(), F.lit(None).cast("boolean")).otherwise(F.raise_error(F.lit("not a truth value")).cast("boolean"))
