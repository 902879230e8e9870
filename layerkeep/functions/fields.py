"""Reading fields of rows: presence, defaults, lists, and accessors bound to one schema.

Absent is null. ``has`` tells presence, ``get`` puts the default for what is
absent, ``get_list`` an empty list where there is no default either. A field id
that is unknown or deleted is absent for all rows; a wrong type or shape raises.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import FailedPrecondition, InvalidArgument
from ..schema import Field, Schema


def default_of(f: Field) -> Column | None:
    if f.default is None:
        return None
    kind = f.spark_type
    if f.is_list:
        return F.array(*[F.lit(x) for x in f.default]).cast(kind)
    return F.lit(f.default).cast(kind)


def member(f: Field, row: str = "row") -> Column:
    return F.col(row).getField(f.name)


def _wanted(schema: Schema, field_id: int, kind: str | None, is_list: bool) -> Field | None:
    f = schema.find(field_id)
    if f and (f.is_list != is_list or kind is not None and f.type != kind):
        raise InvalidArgument(f"field {field_id} is {'a list of ' * f.is_list}{f.type}, not {'a list of ' * is_list}{kind or 'a scalar'}")
    return f


def has(schema: Schema, field_id: int, row: str = "row") -> Column:
    f = schema.find(field_id)
    return member(f, row).isNotNull() if f else F.lit(False)


def get(schema: Schema, field_id: int, kind: str | None = None, row: str = "row") -> Column:
    f = _wanted(schema, field_id, kind, False)
    if f is None:
        return F.lit(None)
    default = default_of(f)
    return member(f, row) if default is None else F.coalesce(member(f, row), default)


def get_list(schema: Schema, field_id: int, kind: str | None = None, row: str = "row") -> Column:
    f = _wanted(schema, field_id, kind, True)
    if f is None:
        return F.array()
    choices = [member(f, row), default_of(f), F.array().cast(f.spark_type)]
    return F.coalesce(*[c for c in choices if c is not None])


@dataclass(frozen=True)
class Accessor:
    """A field resolved once. It reads rows of its own schema only and never falls back to names."""

    schema_version: int
    fingerprint: int
    field: Field

    def column(self, schema: Schema, row: str = "row") -> Column:
        if (schema.version, schema.layout().fingerprint) != (self.schema_version, self.fingerprint):
            raise FailedPrecondition(f"accessor of schema {self.schema_version} meets rows of schema {schema.version}")
        read = get_list if self.field.is_list else get
        return read(schema, self.field.field_id, self.field.type, row)


def accessor(schema: Schema, field_id: int, kind: str | None = None, is_list: bool | None = None) -> Accessor:
    """Raises InvalidArgument for a field that is unknown, deleted, or of another type or shape."""
    f = schema.find(field_id)
    if f is None or kind is not None and f.type != kind or is_list is not None and f.is_list != is_list:
        raise InvalidArgument(f"no such accessor for field {field_id}")
    return Accessor(schema.version, schema.layout().fingerprint, f)


def row_struct(schema: Schema, values: dict[str, Any]) -> Column:
    """A row from columns by field name; fields without a value are absent."""
    unknown = set(values) - {f.name for f in schema.fields}
    if unknown:
        raise InvalidArgument(f"no active fields {sorted(unknown)}")
    parts = [(F.lit(None) if (v := values.get(f.name)) is None else v).cast(f.spark_type).alias(f.name) for f in schema.fields]
    return F.struct(*parts)


def project(old: Schema, new: Schema, row: str = "row") -> Column:
    """A row of ``old`` as a row of ``new``: fields go by id; added ones are absent, deleted ones go."""
    parts = []
    for f in new.fields:
        was = old.find(f.field_id)
        if was and (was.type, was.is_list) != (f.type, f.is_list):
            raise FailedPrecondition(f"field {f.field_id} changed its type")
        parts.append((member(was, row) if was else F.lit(None)).cast(f.spark_type).alias(f.name))
    return F.struct(*parts)


def payload_bytes(schema: Schema, row: str = "row") -> Column:
    """Bytes beyond the fixed slot that a row needs, by each field's encoding."""
    total = F.lit(0).cast("long")
    for f in schema.fields:
        if not f.by_reference:
            continue
        x = member(f, row)
        text = lambda c: F.octet_length(c).cast("long")
        if not f.is_list:
            size = text(x)
        elif f.type != "string":
            size = F.size(x).cast("long") * f.width
        else:
            letters = F.aggregate(x, F.lit(0).cast("long"), lambda n, s: n + text(s))
            each = {"arena": 16, "dictionary": 0, "element_dictionary": 4}[f.encoding]
            size = F.size(x).cast("long") * each + letters
        total = total + F.when(x.isNotNull(), size).otherwise(F.lit(0).cast("long"))
    return total


def bad_rows(schema: Schema, row: str = "row") -> Column:
    """Why a row breaks its schema, or null: a required field is absent, or a list holds null."""
    checks = [F.lit(None).cast("string")]
    for f in schema.fields:
        x = member(f, row)
        if not f.nullable and f.default is None:
            checks.append(F.when(x.isNull(), F.lit(f"required field {f.name} is absent")))
        if f.is_list:
            checks.append(F.when(F.exists(F.coalesce(x, F.array().cast(f.spark_type)), lambda e: e.isNull()), F.lit(f"list field {f.name} holds null")))
    return F.coalesce(*checks) if len(checks) > 1 else checks[0]
