"""Versioned schemas of keyed rows, their Spark types and their storage layout.

A field has an id that is never used again, a name, a type (six scalars and
lists of them), nullability, an encoding and perhaps a default. Deleted fields
keep their ids. A row is a Spark struct with a member for each active field,
named by the field; what is absent is null, and defaults are applied on reading.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from .errors import FailedPrecondition, InvalidArgument, NotFound

#: Type names with their width in bytes and Spark type.
TYPES: dict[str, tuple[int, T.DataType]] = {
    "int8": (1, T.ByteType()),
    "int32": (4, T.IntegerType()),
    "int64": (8, T.LongType()),
    "uint64": (8, T.DecimalType(20, 0)),
    "bool": (1, T.BooleanType()),
    "string": (16, T.StringType()),
}
RANGES = {"int8": (-(2**7), 2**7 - 1), "int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1), "uint64": (0, 2**64 - 1)}
ENCODINGS = ("fixed", "arena", "dictionary", "element_dictionary")
REFERENCE_BYTES = 16


def align_up(value: int, alignment: int) -> int:
    """The next multiple; an alignment of 0 leaves the value."""
    return value if alignment == 0 else -(-value // alignment) * alignment


def legal_encodings(kind: str, is_list: bool) -> tuple[str, ...]:
    if kind not in TYPES:
        raise InvalidArgument(f"unknown field type {kind!r}")
    if not is_list:
        return ("arena", "dictionary") if kind == "string" else ("fixed",)
    return ("arena", "dictionary", "element_dictionary") if kind == "string" else ("arena", "dictionary")


def check_value(kind: str, value: Any, what: str) -> None:
    """One element of a field's type, else InvalidArgument."""
    good = isinstance(value, bool) if kind == "bool" else isinstance(value, str) if kind == "string" else isinstance(value, int) and not isinstance(value, bool)
    if not good or kind in RANGES and not RANGES[kind][0] <= value <= RANGES[kind][1]:
        raise InvalidArgument(f"{what}: {value!r} is no {kind}")


@dataclass(frozen=True)
class Field:
    field_id: int
    name: str
    type: str
    is_list: bool = False
    nullable: bool = True
    encoding: str = ""
    default: Any = None
    deleted: bool = False

    def __post_init__(self):
        legal = legal_encodings(self.type, self.is_list)
        if not self.encoding:
            object.__setattr__(self, "encoding", legal[0])
        if self.encoding not in legal:
            raise InvalidArgument(f"field {self.name}: encoding {self.encoding!r} does not suit {'list of ' * self.is_list}{self.type}")
        if isinstance(self.default, tuple):
            object.__setattr__(self, "default", list(self.default))
        if self.default is not None:
            if self.is_list != isinstance(self.default, list):
                raise InvalidArgument(f"field {self.name}: the default is {'no list' if self.is_list else 'a list'}")
            for x in self.default if self.is_list else [self.default]:
                check_value(self.type, x, f"default of {self.name}")

    @property
    def width(self) -> int:
        return TYPES[self.type][0]

    @property
    def by_reference(self) -> bool:
        return self.is_list or self.type == "string"

    @property
    def spark_type(self) -> T.DataType:
        kind = TYPES[self.type][1]
        return T.ArrayType(kind, containsNull=True) if self.is_list else kind

    def spark_field(self) -> T.StructField:
        """Always nullable to Spark: absent is null, and required fields are checked when rows are made."""
        return T.StructField(self.name, self.spark_type, True, {"field_id": self.field_id, "type": self.type, "encoding": self.encoding})


@dataclass(frozen=True)
class Schema:
    version: int
    fields: tuple[Field, ...] = ()
    deleted: tuple[Field, ...] = ()

    @classmethod
    def of(cls, version: int, *fields: Field) -> Schema:
        out = cls(version)
        for f in fields:
            out = out.add_field(f)
        return replace(out, version=version)

    def add_field(self, new: Field, version: int | None = None) -> Schema:
        """The schema with one more field. Ids are never used again; names may repeat only across deleted fields."""
        if not new.name:
            raise InvalidArgument("a field needs a name")
        if new.deleted:
            raise InvalidArgument("a new field cannot be deleted")
        if any(f.field_id == new.field_id for f in (*self.fields, *self.deleted)):
            raise FailedPrecondition(f"field id {new.field_id} was used before")
        return replace(self, version=self.version if version is None else version, fields=(*self.fields, new))

    def delete_field(self, field_id: int, version: int | None = None) -> Schema:
        gone = self.find(field_id)
        if gone is None:
            raise NotFound(f"no active field {field_id}")
        rest = tuple(f for f in self.fields if f.field_id != field_id)
        return replace(self, version=self.version if version is None else version, fields=rest, deleted=(*self.deleted, replace(gone, deleted=True)))

    def find(self, field_id: int) -> Field | None:
        return next((f for f in self.fields if f.field_id == field_id), None)

    def find_deleted(self, field_id: int) -> Field | None:
        return next((f for f in self.deleted if f.field_id == field_id), None)

    def by_name(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def row_type(self) -> T.StructType:
        """The struct of a row. Spark resolves members by name, so active names must differ here."""
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise InvalidArgument("active fields share a name")
        return T.StructType([f.spark_field() for f in self.fields])

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "fields": [asdict(f) for f in self.fields], "deleted": [asdict(f) for f in self.deleted]}, sort_keys=True)

    @classmethod
    def from_json(cls, raw: str | Mapping) -> Schema:
        got = json.loads(raw) if isinstance(raw, str) else raw
        return cls(got["version"], tuple(Field(**f) for f in got["fields"]), tuple(Field(**f) for f in got["deleted"]))

    def layout(self) -> Layout:
        return Layout.of(self)


@dataclass(frozen=True)
class Slot:
    field: Field
    presence_bit: int
    offset: int


@dataclass(frozen=True)
class Layout:
    """Where a row's fields lie in a fixed slot: for size statistics and to tell schemas apart."""

    version: int
    slots: tuple[Slot, ...]
    presence_bytes: int
    reference_offset: int
    slot_bytes: int
    fingerprint: int = field(default=0)

    @classmethod
    def of(cls, schema: Schema) -> Layout:
        ordered = sorted(schema.fields, key=lambda f: f.field_id)
        presence = align_up(-(-len(ordered) // 8), 8)
        offsets: dict[int, int] = {}
        cursor = presence
        for f in ordered:
            if not f.by_reference:
                offsets[f.field_id] = align_up(cursor, f.width)
                cursor = offsets[f.field_id] + f.width
        references = cursor = align_up(cursor, 8)
        for f in ordered:
            if f.by_reference:
                offsets[f.field_id] = cursor
                cursor += REFERENCE_BYTES
        slots = tuple(Slot(f, bit, offsets[f.field_id]) for bit, f in enumerate(ordered))
        size = align_up(cursor, 8)
        seen = [schema.version, presence, references, size, [[asdict(s.field), s.presence_bit, s.offset] for s in slots]]
        mark = hashlib.sha256(json.dumps(["layerkeep-layout-1", *seen], sort_keys=True).encode()).digest()[:8]
        return cls(schema.version, slots, presence, references, size, int.from_bytes(mark, "little"))

    def offset(self, field_id: int) -> int:
        for s in self.slots:
            if s.field.field_id == field_id:
                return s.offset
        raise NotFound(f"no field {field_id}")
