"""JSON in one spelling: keys sorted at every level, no spaces, numbers that are not finite as null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# a string in quotes, or what stands between strings
PIECES = r'("(?:[^"\\]|\\.)*"|[^"]+)'


def finite(text: Column) -> Column:
    """JSON text with NaN and infinities, where they stand as values and not inside strings, as null."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.startswith('"'), p).otherwise(F.regexp_replace(p, r"[+-]?\b(?:NaN|Infinity)\b", "null"))), "")


def canonical(text: Column, without: tuple[str, ...] = ()) -> Column:
    """The canonical spelling of a JSON text, less some keys of its top level; null if it is no JSON.

    A parsed value keeps the keys of every object sorted, at any depth.
    """
    value = F.try_parse_json(finite(text))
    if not without:
        return F.to_json(value)
    kept = F.map_filter(F.try_variant_get(value, "$", "map<string,variant>"), lambda k, v: ~k.isin(*without))
    return F.coalesce(F.to_json(F.to_variant_object(kept)), F.to_json(value))


def digest(text: Column, without: tuple[str, ...] = ()) -> Column:
    """sha256 of the canonical spelling."""
    return F.sha2(canonical(text, without), 256)
