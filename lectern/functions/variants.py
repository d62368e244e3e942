"""Containment of JSON documents, over VARIANT columns.

An object holds another if it has all its keys, with values that hold the other's; an array holds another if each of the other's
elements is held by one of its own, in any order; numbers are equal by value. An array also holds a plain value that is one of its elements,
but only at the outside. An empty object is held by every object, an empty array by every array.
"""

from __future__ import annotations

import json
from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBERS = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def contains(document: Column, wanted: object) -> Column:
    """Whether a VARIANT holds wanted (dictionaries, lists, strings, numbers, booleans, None), compiled to one expression."""
    held = _holds(document, wanted)
    if not isinstance(wanted, (dict, list, tuple)):
        held = held | F.coalesce(_has_element(document, wanted), F.lit(False))
    return F.coalesce(held, F.lit(False))


def _elements(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _has_element(v: Column, wanted: object) -> Column:
    return F.exists(_elements(v), lambda e: F.coalesce(_holds(e, wanted), F.lit(False)))


def _holds(v: Column, wanted: object) -> Column:
    if isinstance(wanted, dict):
        whole = F.schema_of_variant(v).startswith("OBJECT")
        return reduce(and_, (_holds(F.try_variant_get(v, f"$[{json.dumps(str(k))}]", "variant"), x) for k, x in wanted.items()), whole)
    if isinstance(wanted, (list, tuple)):
        return reduce(and_, (_has_element(v, x) for x in wanted), F.schema_of_variant(v).startswith("ARRAY"))
    kind = F.schema_of_variant(v)
    if wanted is None:
        return F.is_variant_null(v)
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == wanted)
    if isinstance(wanted, (int, Decimal)):
        return kind.rlike(_NUMBERS) & (F.try_variant_get(v, "$", "decimal(38,9)") == F.lit(Decimal(wanted)))
    if isinstance(wanted, float):
        return kind.rlike(_NUMBERS) & (F.try_variant_get(v, "$", "double") == wanted)
    if isinstance(wanted, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == wanted)
    raise TypeError(f"{type(wanted).__name__} has no place in JSON")


def contains_sql(document: str, wanted: str, depth: int = 3, outside: bool = True) -> str:
    """SQL for the same where wanted is a VARIANT of the query too, known only when it runs: unrolled to depth levels of nesting, deeper ones raise."""
    plain = (
        f"(schema_of_variant({document}) = schema_of_variant({wanted}) AND to_json({document}) = to_json({wanted})"
        f" OR schema_of_variant({document}) RLIKE '{_NUMBERS}' AND schema_of_variant({wanted}) RLIKE '{_NUMBERS}'"
        f" AND try_variant_get({document}, '$', 'double') = try_variant_get({wanted}, '$', 'double'))"
    )
    if outside:
        plain = f"({plain} OR exists(try_variant_get({document}, '$', 'array<variant>'), x0 -> {contains_sql('x0', wanted, 0, False)}))"
    if depth == 0:
        deep = f"schema_of_variant({wanted}) RLIKE '^(OBJECT|ARRAY)'"
        return f"(CASE WHEN {deep} THEN CAST(raise_error('the filter is nested too deeply') AS BOOLEAN) ELSE {plain} END)"
    k, x, y = f"k{depth}", f"x{depth}", f"y{depth}"
    own, other = f"try_variant_get({document}, '$', 'map<string,variant>')", f"try_variant_get({wanted}, '$', 'map<string,variant>')"
    objects = f"forall(map_keys({other}), {k} -> coalesce({contains_sql(f'{own}[{k}]', f'{other}[{k}]', depth - 1, False)}, false))"
    arrays = f"forall(try_variant_get({wanted}, '$', 'array<variant>'), {y} -> exists(try_variant_get({document}, '$', 'array<variant>'), {x} -> coalesce({contains_sql(x, y, depth - 1, False)}, false)))"
    return (
        f"coalesce(CASE WHEN schema_of_variant({wanted}) LIKE 'OBJECT%' THEN schema_of_variant({document}) LIKE 'OBJECT%' AND {objects}"
        f" WHEN schema_of_variant({wanted}) LIKE 'ARRAY%' THEN schema_of_variant({document}) LIKE 'ARRAY%' AND {arrays} ELSE {plain} END, false)"
    )
