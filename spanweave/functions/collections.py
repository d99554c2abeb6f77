"""Arrays, maps and JSON: property bags, scalar metadata, zipped results, lookups with a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scalar_text(df: DataFrame, column: str) -> Column:
    """A column as text: scalars as they print, arrays, maps and structs as JSON; null stays null."""
    nested = df.schema[column].dataType.typeName() in ("array", "map", "struct", "variant")
    return F.to_json(F.col(column)) if nested else F.col(column).cast("string")


def property_bag(df: DataFrame, *drop: str) -> Column:
    """The columns that are not null as a map of texts, without those named in `drop`."""
    names = [c for c in df.columns if c not in drop]
    pairs = F.create_map(*[x for c in names for x in (F.lit(c), scalar_text(df, c))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def lookup(m: Column, key: str, default: str) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def merged(a: Column, b: Column) -> Column:
    """Two maps as one; the second wins where both have a key."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


def zipped_rows(df: DataFrame, *arrays: str) -> DataFrame:
    """Parallel result arrays as one row per position, with `ord` from 0; shorter arrays give nulls."""
    rest = [c for c in df.columns if c not in arrays]
    z = df.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("ord", "z"))
    return z.select(*rest, "ord", *[f"z.{a}" for a in arrays])


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))
