"""Defensive field access on JSON text, parsed once into a VARIANT."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(json: str) -> Column:
    """VARIANT of the text column, null when it is not JSON."""
    return F.expr(f"try_parse_json({json})")


def fields_sql(json: str, names: Iterable[str]) -> str:
    """SQL: a struct with one VARIANT per named top-level field. Of a repeated field the last one
    counts, whatever the session says about repeated keys."""
    return f"from_json({json}, '{', '.join(f'{n} variant' for n in names)}')"


def invalid_sql(json: str) -> str:
    """SQL: the text is not JSON. Objects with repeated keys are JSON."""
    return f"(try_parse_json({json}) is null and json_object_keys({json}) is null)"


def value_text(value: str) -> str:
    """SQL: missing, null, object and array give an empty text; scalars give their text without
    surrounding characters up to U+0020."""
    scalar = f"if(schema_of_variant({value}) rlike '^(OBJECT|ARRAY)', '', try_variant_get({value}, '$', 'string'))"
    return f"coalesce(regexp_replace({scalar}, r'^[\\x00-\\x20]+|[\\x00-\\x20]+$', ''), '')"


def text_sql(v: str, field: str) -> str:
    """:func:`value_text` of a field of a VARIANT."""
    return value_text(f"try_variant_get({v}, '$.{field}', 'variant')")


def bool_sql(v: str, field: str, missing: bool = False) -> str:
    """:func:`value_bool` of a field of a VARIANT."""
    return value_bool(f"try_variant_get({v}, '$.{field}', 'variant')", missing)


def value_bool(value: str, missing: bool = False) -> str:
    """SQL: JSON true, the text "true" or a non-zero number are true; a missing or null field is
    ``missing``; anything else is false."""
    text, kind = f"try_variant_get({value}, '$', 'string')", f"schema_of_variant({value})"
    return (f"coalesce(case when coalesce({kind}, 'VOID') = 'VOID' then {str(missing).lower()} "
            f"when {kind} in ('BOOLEAN', 'STRING') then trim({text}) = 'true' "
            f"when {kind} rlike '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' then try_cast({text} as double) <> 0 "
            f"else false end, false)")


def text_field(v: str, field: str) -> Column:
    return F.expr(text_sql(v, field))


def bool_field(v: str, field: str, missing: bool = False) -> Column:
    return F.expr(bool_sql(v, field, missing))
