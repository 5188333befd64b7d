"""JSON documents as VARIANT: containment of a literal, equality, walks over all strings."""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """VARIANT of a JSON text; null where it is none, or where an object has a key twice."""
    return F.try_parse_json(text)


def _step(key: str) -> str:
    """One step into an object, whatever the key holds but both kinds of quotes."""
    if "'" in key and '"' in key:
        raise ValueError(f"a key with both kinds of quotes cannot be named: {key}")
    return f"['{key}']" if "'" not in key else f'["{key}"]'


def _kind(v: Column) -> Column:
    """The type's name (OBJECT<..>, ARRAY<..>, STRING, BOOLEAN, VOID for a JSON null, else a number's); null without a value."""
    return F.schema_of_variant(v)


def contains(document: Column, needle: Any) -> Column:
    """Whether a VARIANT contains a literal (what json.loads gives), as JSONB containment has it.

    An object contains one whose every key it has with a value that contains the other's; an array contains one whose
    every element some element of its own contains; scalars contain what equals them; an array also contains a scalar at
    the top, not further down. Order and repetition don't matter. A null document contains nothing.

    Nested objects become paths, so that the document is read once for each leaf of the literal and not for each level.
    """
    top = _contains(document, "$", needle)
    if not isinstance(needle, (dict, list)):
        top = top | F.coalesce(F.exists(F.try_variant_get(document, "$", "array<variant>"), _holds(needle)), F.lit(False))
    return F.coalesce(top, F.lit(False))


def _contains(v: Column, path: str, needle: Any) -> Column:
    at = v if path == "$" else F.try_variant_get(v, path, "variant")
    if isinstance(needle, dict) and needle:
        return reduce(lambda a, b: a & b, [_contains(v, path + _step(key), want) for key, want in needle.items()])
    if isinstance(needle, dict):
        return F.coalesce(_kind(at).startswith("OBJECT"), F.lit(False))
    if isinstance(needle, list) and needle:
        elements = F.try_variant_get(v, path, "array<variant>")
        return reduce(lambda a, b: a & b, [F.coalesce(F.exists(elements, _holds(want)), F.lit(False)) for want in needle])
    if isinstance(needle, list):
        return F.coalesce(_kind(at).startswith("ARRAY"), F.lit(False))
    return _equals(at, needle)


def _holds(want: Any):
    return lambda x: _contains(x, "$", want)


def _equals(v: Column, scalar: Any) -> Column:
    kind = _kind(v)
    if scalar is None:
        same = kind == "VOID"
    elif isinstance(scalar, bool):
        same = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(scalar))
    elif isinstance(scalar, (int, float)):
        same = ~kind.rlike("^(OBJECT|ARRAY|STRING|BOOLEAN|VOID)") & (F.try_variant_get(v, "$", "double") == F.lit(float(scalar)))
    else:
        same = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == F.lit(str(scalar)))
    return F.coalesce(same, F.lit(False))


def contains_json(document: Column, needle: str) -> Column:
    return contains(document, json.loads(needle))


def value_at(document: Column, path: str, kind: str = "string") -> Column:
    """The value at a path of keys and positions ("a.b[0]"), cast; null where there is none or it doesn't fit."""
    return F.try_variant_get(document, "$" if not path else path if path.startswith("$") else f"$.{path}", kind)


def strings(df: DataFrame, key: str, document: str, depth: int = 16) -> DataFrame:
    """(key, path, value): every string in a VARIANT column, however deep, in its place; a level is one explode.

    Documents nested deeper than ``depth`` raise an error rather than lose strings.
    """
    rows = df.select(F.col(key), F.lit("$").alias("path"), F.col(document).alias("v")).where("v is not null")
    found = None
    for level in range(depth + 1):
        here = rows.where(_kind(F.col("v")) == "STRING").select(key, "path", F.try_variant_get("v", "$", "string").alias("value"))
        found = here if found is None else found.unionByName(here)
        nested = rows.where(_kind(F.col("v")).rlike("^(OBJECT|ARRAY)"))
        if level == depth:
            deep = nested.select(key, "path", F.raise_error(F.concat(F.lit(f"documents are nested deeper than {depth}: "), "path")).cast("string").alias("value"))
            return found.unionByName(deep)
        nested.createOrReplaceTempView(view := f"_nested_{level}")
        step = "path || coalesce('.' || e.key, '[' || e.pos || ']')"
        rows = df.sparkSession.sql(f"select {key}, {step} as path, e.value as v from {view}, lateral variant_explode(v) as e")
        df.sparkSession.catalog.dropTempView(view)
    return found


def flattened(df: DataFrame, key: str, document: str, depth: int = 16) -> DataFrame:
    """(key, values): all strings of each document in order of their paths, repeated ones once."""
    rows = strings(df, key, document, depth)
    one = rows.groupBy(key, "value").agg(F.min("path").alias("path"))
    return one.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "value"))), lambda x: x["value"]).alias("values"))  # of one document
