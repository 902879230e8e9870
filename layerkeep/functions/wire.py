"""The update frame: a whole row as bytes, fields by id, little-endian.

Fixed values of the format: the magic ``KVIU``, unsigned 16-bit version 1 and
flags 0, unsigned 32-bit field count; for each field an unsigned 32-bit id, a
kind byte, an unsigned 32-bit length and that many bytes. Kinds: 0 null, 1 int8,
2 int32, 3 int64, 4 uint64, 5 bool, 6 string, 17 to 22 lists of these. A list is
an unsigned 32-bit count and its elements; a string element is an unsigned
32-bit length and UTF-8.
"""

from __future__ import annotations

import struct
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import FailedPrecondition, InvalidArgument, LayerError
from ..schema import Field, Schema, check_value

MAGIC, VERSION, FLAGS = b"KVIU", 1, 0
KINDS = {0: "null", 1: "int8", 2: "int32", 3: "int64", 4: "uint64", 5: "bool", 6: "string"}
CODES = {name: code for code, name in KINDS.items()}
LIST = 16
NUMBERS = {"int8": "<b", "int32": "<i", "int64": "<q", "uint64": "<Q"}
WIDTHS = {"bool": 1} | {kind: struct.calcsize(x) for kind, x in NUMBERS.items()}


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise InvalidArgument("the frame is truncated")
        self.at += n
        return self.data[self.at - n : self.at]

    def u32(self) -> int:
        return struct.unpack("<I", self.take(4))[0]

    def end(self) -> None:
        if self.at != len(self.data):
            raise InvalidArgument("bytes are left over")


def _text(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise InvalidArgument("a string is no UTF-8") from e


def _scalar(kind: str, raw: bytes) -> Any:
    if kind == "string":
        return _text(raw)
    if kind == "bool":
        if raw not in (b"\0", b"\1"):
            raise InvalidArgument("a bool is neither 0 nor 1")
        return raw == b"\1"
    if len(raw) != struct.calcsize(NUMBERS[kind]):
        raise InvalidArgument(f"a {kind} has {len(raw)} bytes")
    return struct.unpack(NUMBERS[kind], raw)[0]


def _list(kind: str, raw: bytes) -> list:
    r = Reader(raw)
    count = r.u32()
    width = 1 if kind == "bool" else 0 if kind == "string" else struct.calcsize(NUMBERS[kind])
    if count * max(width, 1 if kind == "bool" else 4 if kind == "string" else width) > len(raw):
        raise InvalidArgument("the frame is truncated")
    out = [_scalar(kind, r.take(r.u32() if kind == "string" else width)) for _ in range(count)]
    r.end()
    return out


def decode(data: bytes) -> dict[int, tuple[str, bool, Any]]:
    """Field id to (type, whether a list, value); the type of null is ``null``."""
    if len(data) < 12 or data[:4] != MAGIC:
        raise InvalidArgument("not an update frame")
    r = Reader(data)
    r.take(4)
    version, flags = struct.unpack("<HH", r.take(4))
    if version != VERSION:
        raise InvalidArgument(f"frame version {version}")
    if flags != FLAGS:
        raise InvalidArgument(f"frame flags {flags}")
    out: dict[int, tuple[str, bool, Any]] = {}
    for _ in range(r.u32()):
        field_id, code = r.u32(), r.take(1)[0]
        raw = r.take(r.u32())
        if field_id in out:
            raise InvalidArgument(f"field {field_id} occurs twice")
        kind, is_list = KINDS.get(code & ~LIST), bool(code & LIST)
        if kind is None or code > 22 or is_list and kind == "null":
            raise InvalidArgument(f"unknown kind {code}")
        if kind == "null":
            if raw:
                raise InvalidArgument("a null has bytes")
            out[field_id] = ("null", False, None)
        else:
            out[field_id] = (kind, is_list, _list(kind, raw) if is_list else _scalar(kind, raw))
    r.end()
    return out


def _raw(kind: str, value: Any) -> bytes:
    check_value(kind, value, "wire value")
    return value.encode() if kind == "string" else bytes([value]) if kind == "bool" else struct.pack(NUMBERS[kind], value)


def encode(values: dict[int, tuple[str, bool, Any]]) -> bytes:
    """The frame of fields by id, as ``decode`` returns them."""
    out = [MAGIC, struct.pack("<HHI", VERSION, FLAGS, len(values))]
    for field_id, (kind, is_list, value) in values.items():
        if kind == "null":
            raw = b""
        elif is_list:
            parts = [_raw(kind, x) for x in value]
            raw = struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(p)) + p if kind == "string" else p for p in parts)
        else:
            raw = _raw(kind, value)
        out.append(struct.pack("<IBI", field_id, CODES[kind] + LIST * is_list, len(raw)) + raw)
    return b"".join(out)


def encode_row(schema: Schema, row: dict[str, Any]) -> bytes:
    """The frame of a row by field name; absent fields are left out."""
    present = [f for f in schema.fields if row.get(f.name) is not None]
    return encode({f.field_id: (f.type, f.is_list, [_plain(f, x) for x in row[f.name]] if f.is_list else _plain(f, row[f.name])) for f in present})


def _plain(f: Field, value: Any) -> Any:
    return value if f.type in ("bool", "string") else int(value)


def to_row(schema: Schema, frame: dict[int, tuple[str, bool, Any]]) -> dict[str, Any]:
    """A decoded frame as a row of ``schema``: unknown ids are skipped, an explicit null or another type of a known one is an error."""
    out: dict[str, Any] = {f.name: None for f in schema.fields}
    for field_id, (kind, is_list, value) in frame.items():
        f = schema.find(field_id)
        if f is None:
            continue
        if kind == "null":
            raise InvalidArgument(f"field {f.name} is explicitly null")
        if (kind, is_list) != (f.type, f.is_list):
            raise InvalidArgument(f"field {f.name} is {'a list of ' * f.is_list}{f.type}, the frame has {'a list of ' * is_list}{kind}")
        out[f.name] = value
    for f in schema.fields:
        if out[f.name] is None and not f.nullable and f.default is None:
            raise FailedPrecondition(f"required field {f.name} is absent")
    return out


def arrow_type(f: Field) -> pa.DataType:
    kind = {"int8": pa.int8(), "int32": pa.int32(), "int64": pa.int64(), "uint64": pa.decimal128(20, 0), "bool": pa.bool_(), "string": pa.string()}[f.type]
    return pa.list_(kind) if f.is_list else kind


def _arrow_value(f: Field, value: Any) -> Any:
    from decimal import Decimal

    if value is None or f.type != "uint64":
        return value
    return [Decimal(x) for x in value] if f.is_list else Decimal(value)


def _bytes_at(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    return data[starts[:, None] + np.arange(width)]


def _u32_at(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return _bytes_at(data, starts, 4).view("<u4").ravel().astype(np.int64)


def _spans(schema: Schema, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which frames are plain, and for each field and frame where its value begins, -1 if absent, and its size).

    A plain frame has known fields of the schema's types only, each once, and
    all required ones. The frames are walked in lockstep, a field at a time.
    """
    fields = sorted((f for f in schema.fields if not f.is_list or f.type in NUMBERS), key=lambda f: f.field_id)
    place = {f.name: k for k, f in enumerate(schema.fields)}
    row_of = np.array([place[f.name] for f in fields] + [len(place)])
    ids = np.array([f.field_id for f in fields] + [-1], np.int64)
    codes = np.array([CODES[f.type] + LIST * f.is_list for f in fields] + [-1])
    widths = np.array([0 if f.is_list else WIDTHS.get(f.type, 0) for f in fields] + [0])
    starts = np.full((len(place) + 1, len(begin)), -1, np.int64)  # a last row for unknown fields
    sizes = np.zeros_like(starts)
    plain = np.zeros(len(begin), bool)
    at = np.flatnonzero(end - begin >= 12)
    head = np.frombuffer(MAGIC + struct.pack("<HH", VERSION, FLAGS), np.uint8)
    at = at[(_bytes_at(data, begin[at], 8) == head).all(axis=1)]
    left, here = _u32_at(data, begin[at] + 8), begin[at] + 12
    while len(at):
        plain[at[(left == 0) & (here == end[at])]] = True
        on = (left > 0) & (here + 9 <= end[at])
        at, left, here = at[on], left[on], here[on]
        field_id, code, size, here = _u32_at(data, here), data[here + 4], _u32_at(data, here + 5), here + 9
        k = np.searchsorted(ids[:-1], field_id)
        on = (ids[k] == field_id) & (codes[k] == code) & (here + size <= end[at]) & (starts[row_of[k], at] < 0) & ((widths[k] == 0) | (widths[k] == size))
        at, left, here, k, size = at[on], left[on] - 1, here[on], row_of[k[on]], size[on]
        starts[k, at], sizes[k, at] = here, size
        here = here + size
    for k, f in enumerate(schema.fields):
        own = np.flatnonzero(plain & (starts[k] >= 0))
        if f.is_list:
            own = own[sizes[k, own] >= 4]
            own = own[_u32_at(data, starts[k, own]) * WIDTHS[f.type] == sizes[k, own] - 4] if len(own) else own
        elif f.type == "bool":
            own = own[data[starts[k, own]] <= 1]
        good = np.zeros(len(plain), bool)
        good[own] = True
        plain &= good | (starts[k] < 0) & (f.nullable or f.default is not None)
    return plain, starts, sizes


def _within(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans that lie one behind another."""
    on = sizes > 0
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts[on]] += 1
    inside[starts[on] + sizes[on]] -= 1
    return data[np.cumsum(inside, dtype=np.int8, out=inside)[:-1].astype(bool)]


def _numbers(kind: str, raw: np.ndarray) -> pa.Array:
    """Values of one kind from their bytes."""
    if kind == "bool":
        return pa.array(raw == 1)
    if kind == "uint64":  # as decimals of 16 bytes
        wide = np.zeros((len(raw) // 8, 16), np.uint8)
        wide[:, :8] = raw.reshape(-1, 8)
        return pa.Array.from_buffers(pa.decimal128(20, 0), len(wide), [None, pa.py_buffer(wide.tobytes())])
    return pa.array(raw.view(NUMBERS[kind]))


def _column(f: Field, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One field of plain frames."""
    present = starts >= 0
    if f.is_list:
        counts = np.where(present, sizes - 4, 0)
        offsets = pa.array(np.append(0, np.cumsum(counts // WIDTHS[f.type])), pa.int32())
        return pa.ListArray.from_arrays(offsets, _numbers(f.type, _within(data, starts + 4, counts)), type=arrow_type(f), mask=pa.array(~present))
    if f.type == "string":
        counts = np.where(present, sizes, 0)
        offsets = np.append(0, np.cumsum(counts)).astype(np.int64)
        out = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(_within(data, starts, counts).tobytes())]).cast(pa.string())
    else:
        out = _numbers(f.type, _bytes_at(data, np.where(present, starts, 0), WIDTHS[f.type]).ravel())
    return pc.if_else(pa.array(present), out, pa.scalar(None, arrow_type(f)))


def decode_column(schema: Schema, payload: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(rows, errors) of a column of frames.

    Plain frames are decoded column by column; others (bad ones, unknown fields,
    lists of strings or bools) one at a time, with the same results.
    """
    row_type = pa.struct([pa.field(f.name, arrow_type(f)) for f in schema.fields])
    n, frames = len(payload), payload.cast(pa.large_binary())
    offsets = np.frombuffer(frames.buffers()[1], np.int64)[frames.offset : frames.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(frames.buffers()[2], np.uint8) if n and frames.buffers()[2] else np.zeros(0, np.uint8)
    plain, starts, sizes = _spans(schema, data, offsets[:-1], offsets[1:])
    plain &= payload.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(plain)
    try:
        fast = pa.StructArray.from_arrays([_column(f, data, starts[k, at], sizes[k, at]) for k, f in enumerate(schema.fields)], fields=list(row_type)) if len(at) and schema.fields else pa.array([{}] * len(at), row_type)
    except pa.ArrowInvalid:  # a string is no UTF-8
        at, fast = at[:0], pa.array([], row_type)
    others = np.setdiff1d(np.arange(n), at)
    rows, errors = [], []
    for raw in payload.take(pa.array(others)).to_pylist():
        try:
            got = to_row(schema, decode(raw or b""))
            rows.append({f.name: _arrow_value(f, got[f.name]) for f in schema.fields})
            errors.append(None)
        except LayerError as e:
            rows.append(None)
            errors.append(f"{e.code.value}: {e}")
    order = pa.array(np.argsort(np.concatenate([at, others])))
    both = pa.concat_arrays([fast, pa.array(rows, row_type)]), pa.concat_arrays([pa.nulls(len(at), pa.string()), pa.array(errors, pa.string())])
    return both[0].take(order), both[1].take(order)


def decode_frames(updates: DataFrame, schema: Schema, payload: str = "payload") -> DataFrame:
    """``updates`` with ``row`` (null if bad) and ``error`` (``code: message``, null if good) in place of the payload.

    Decoded in Arrow batches; the frame format has no native reader.
    """
    kept = [c for c in updates.columns if c != payload]
    out_type = T.StructType([*(updates.schema[c] for c in kept), T.StructField("row", schema.row_type()), T.StructField("error", T.StringType())])

    def run(batches):
        for batch in batches:
            rows, errors = decode_column(schema, batch.column(batch.schema.get_field_index(payload)))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, rows, errors], names=[*kept, "row", "error"])

    return updates.mapInArrow(run, out_type)


def encode_rows(rows: DataFrame, schema: Schema, out: str = "payload") -> DataFrame:
    """``rows`` with the frame of ``row`` as ``out``."""
    kept = [c for c in rows.columns if c != "row"]
    out_type = T.StructType([*(rows.schema[c] for c in kept), T.StructField(out, T.BinaryType())])

    def run(batches):
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            frames = [None if r is None else encode_row(schema, r) for r in batch.column(batch.schema.get_field_index("row")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(frames, pa.binary())], names=[*kept, out])

    return rows.mapInArrow(run, out_type).select(*kept, F.col(out))
