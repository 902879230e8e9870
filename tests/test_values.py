"""Hashes, schemas, layouts, frames and positions: what needs no Spark."""

import random

import pyarrow as pa
import pytest

from layerkeep.errors import Code, FailedPrecondition, InvalidArgument, LayerError, NotFound, Status
from layerkeep.functions import hashing, positions, wire
from layerkeep.schema import Field, Schema, align_up
from layerkeep.sources import schema_file
from layerkeep.sources.schema_file import SchemaFile, format_schema, parse

WIDE = (Field(30, "wide", "int64"), Field(10, "tiny", "int8"), Field(20, "name", "string"), Field(40, "tags", "uint64", is_list=True))


def test_hash_has_its_fixed_values():
    assert hashing.stable_hash(0, 0, 1) == 12085254679833835651
    assert hashing.stable_hash(1, 0, 1) == 10858953248184931039
    assert hashing.stable_hash(42, 17, 1) == 13083006257041843452
    assert hashing.shard_for(42, 8, 17) == 4


def test_shard_counts_are_powers_of_two():
    for n in (0, 3, 12, -8):
        with pytest.raises(InvalidArgument):
            hashing.shard_for(1, n)


def test_capacity_and_tag_and_checksum():
    assert [hashing.index_capacity(n) for n in (0, 14, 15, 28, 29)] == [16, 16, 32, 32, 64]
    assert hashing.tag(2**64 - 1) == 127
    assert hashing.fnv1a(b"") == 0xCBF29CE484222325
    assert hashing.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert [align_up(9, 8), align_up(9, 0), align_up(16, 8)] == [16, 9, 16]


def test_layout_offsets():
    layout = Schema.of(42, *WIDE).layout()
    assert (layout.presence_bytes, layout.reference_offset, layout.slot_bytes) == (8, 24, 56)
    assert [layout.offset(i) for i in (10, 30, 20, 40)] == [8, 16, 24, 40]


def test_fingerprint_follows_version_defaults_and_nullability():
    a = Schema.of(42, *WIDE).layout().fingerprint
    assert a == Schema.of(42, *WIDE).layout().fingerprint
    assert len({a, Schema.of(43, *WIDE).layout().fingerprint, Schema.of(42, *WIDE[:3]).layout().fingerprint}) == 3
    one, two = Field(1, "x", "int32"), Field(1, "x", "int32", default=4)
    assert Schema.of(1, one).layout().fingerprint != Schema.of(1, two).layout().fingerprint


def test_schema_evolution():
    s = Schema.of(1, Field(1, "a", "int32"), Field(2, "b", "string"))
    gone = s.delete_field(2, version=2)
    assert gone.find(2) is None and gone.find_deleted(2).name == "b" and gone.layout().slot_bytes < s.layout().slot_bytes
    with pytest.raises(FailedPrecondition):
        gone.add_field(Field(2, "c", "int64"))
    with pytest.raises(FailedPrecondition):
        s.add_field(Field(1, "c", "int64"))
    with pytest.raises(NotFound):
        s.delete_field(9)
    with pytest.raises(InvalidArgument):
        s.add_field(Field(3, "", "int64"))
    assert Schema.from_json(gone.to_json()) == gone


@pytest.mark.parametrize("kind,is_list,encoding,good", [
    ("int32", False, "fixed", True), ("int32", False, "arena", False), ("string", False, "dictionary", True), ("string", False, "fixed", False), ("int64", True, "dictionary", True),
    ("int64", True, "element_dictionary", False), ("string", True, "element_dictionary", True), ("string", True, "list_dictionary", False), ("float", False, "fixed", False),
])
def test_encodings(kind, is_list, encoding, good):
    if good:
        assert Field(1, "x", kind, is_list, encoding=encoding).encoding == encoding
    else:
        with pytest.raises(InvalidArgument):
            Field(1, "x", kind, is_list, encoding=encoding)


def test_defaults_have_their_field_type():
    for kind, is_list, default in (("int8", False, 200), ("bool", False, 1), ("string", False, 3), ("int32", True, 4), ("int32", False, [4]), ("uint64", False, -1)):
        with pytest.raises(InvalidArgument):
            Field(1, "x", kind, is_list, default=default)


def test_positions():
    assert positions.classify((0, 5), (0, 4)) == "stale"
    assert positions.classify((0, 5), (0, 5)) == "idempotent"
    assert positions.classify((0, 5), (0, 6)) == "newer"
    with pytest.raises(FailedPrecondition):
        positions.classify((0, 5), (1, 6))
    with pytest.raises(InvalidArgument):
        positions.classify((0, -1), (0, 6))


FRAME = {1: ("int32", False, -5), 2: ("string", False, "aé"), 3: ("uint64", True, [1, 2**64 - 1]), 4: ("string", True, ["x", ""]), 5: ("bool", True, [True, False]), 6: ("int8", True, []), 7: ("null", False, None)}


def test_frame_round_trip():
    assert wire.decode(wire.encode(FRAME)) == FRAME


@pytest.mark.parametrize("spoil", [
    lambda b: b[:11], lambda b: b"XVIU" + b[4:], lambda b: b[:4] + b"\2\0" + b[6:], lambda b: b[:6] + b"\1\0" + b[8:], lambda b: b[:-1], lambda b: b + b"\0", lambda b: b[:8] + b"\xff" + b[9:],
    lambda b: wire.encode({1: ("bool", False, True)})[:-1] + b"\2", lambda b: b[:16] + b"\x63" + b[17:],
])
def test_bad_frames(spoil):
    with pytest.raises(InvalidArgument):
        wire.decode(spoil(wire.encode(FRAME)))


def test_frame_with_a_field_twice():
    one = wire.encode({1: ("int32", False, 5)})
    with pytest.raises(InvalidArgument):
        wire.decode(one[:8] + b"\2\0\0\0" + one[12:] * 2)


def test_frame_to_row():
    s = Schema.of(1, Field(1, "a", "int32", nullable=False), Field(2, "b", "string"))
    assert wire.to_row(s, {1: ("int32", False, 4), 99: ("null", False, None)}) == {"a": 4, "b": None}
    for frame, error in (({1: ("null", False, None)}, InvalidArgument), ({1: ("string", False, "4")}, InvalidArgument), ({2: ("string", False, "x")}, FailedPrecondition)):
        with pytest.raises(error):
            wire.to_row(s, frame)


def one_by_one(schema, frames):
    """Rows and errors as the plain decoder gives them."""
    for raw in frames:
        try:
            got = wire.to_row(schema, wire.decode(raw or b""))
            yield {f.name: wire._arrow_value(f, got[f.name]) for f in schema.fields}, None
        except LayerError as e:
            yield None, f"{e.code.value}: {e}"


COLUMNS = Schema.of(
    1, Field(9, "a", "int32", nullable=False), Field(2, "b", "string"), Field(3, "c", "uint64", is_list=True), Field(4, "d", "string", is_list=True), Field(5, "e", "bool"), Field(6, "f", "int8"), Field(7, "g", "uint64"),
    Field(8, "h", "int64", is_list=True), Field(1, "i", "int64", nullable=False, default=3),
)


@pytest.mark.parametrize("schema", [COLUMNS, Schema.of(1), Schema.of(1, Field(2, "b", "string")), Schema(1, COLUMNS.fields[:3] + COLUMNS.fields[4:])])
def test_columns_of_frames_equal_single_frames(schema):
    """Good, cut, altered, unknown, repeated and absent fields; slices of a column."""
    rng = random.Random(8)
    value = {"int32": lambda: rng.randrange(-(2**31), 2**31), "int64": lambda: rng.randrange(-(2**63), 2**63), "int8": lambda: rng.randrange(-128, 128), "uint64": lambda: rng.randrange(2**64), "bool": lambda: rng.random() < 0.5, "string": lambda: "aé漢😀"[: rng.randrange(5)] * rng.randrange(3)}
    frames = [None, b"", b"KVIU"]
    for _ in range(3_000):
        fields = [f for f in COLUMNS.fields if rng.random() < (0.95 if f.field_id != 4 else 0.3)]
        rng.shuffle(fields)
        own = {f.field_id: (f.type, f.is_list, [value[f.type]() for _ in range(rng.randrange(4))] if f.is_list else value[f.type]()) for f in fields}
        if rng.random() < 0.1:
            own[77] = ("int8", False, 5)
        raw = bytearray(wire.encode(own))
        for _ in range(rng.choice([0, 0, 1, 2])):
            raw[rng.randrange(len(raw))] = rng.choice([0, 1, 2, 255, rng.randrange(256)])
        if rng.random() < 0.1:
            raw = raw[: rng.randrange(len(raw))] if rng.random() < 0.5 else raw + b"\0"
        frames.append(bytes(raw))
    column = pa.array([b"before", *frames, b"after"], pa.binary())[1:-1]
    rows, errors = wire.decode_column(schema, column)
    want = list(one_by_one(schema, frames))
    assert errors.to_pylist() == [e for _, e in want] and rows.to_pylist() == [r for r, _ in want]
    assert schema is COLUMNS and sum(e is None for _, e in want) > 500 or schema is not COLUMNS
    assert [len(x) for x in wire.decode_column(schema, pa.array([], pa.binary()))] == [0, 0]


def test_status():
    assert Status().ok and Status(Code.OK, "what").code is Code.UNKNOWN
    assert Status.of(NotFound("x")) == Status(Code.NOT_FOUND, "x")
    with pytest.raises(NotFound):
        Status(Code.NOT_FOUND, "x").raise_for_error()


SCHEMA_TEXT = """
schema_version: 11   # of the data
shard_count: 4
hash_seed: 17
primary_key:
  name: "record#id"
  type: uint64
fields:
  - field_id: 1
    name: score
    type: int32
    is_list: false
    nullable: false
    encoding: fixed
  - field_id: 3
    name: tags
    type: string
    is_list: true
    nullable: true
    encoding: element_dictionary
"""


def test_schema_file():
    got = parse(SCHEMA_TEXT)
    assert (got.primary_key, got.shard_count, got.hash_seed, got.hash_version, got.schema.version) == ("record#id", 4, 17, None, 11)
    assert got.schema.fields == (Field(1, "score", "int32", nullable=False), Field(3, "tags", "string", True, encoding="element_dictionary"))
    plain = SchemaFile(got.schema, "id", 8, 0, 1)
    assert parse(format_schema(plain)) == plain


@pytest.mark.parametrize("old,new", [
    ("hash_seed: 17", "colour: red"), ("type: uint64", "type: int64"), ("    encoding: fixed\n", ""), ("    encoding: fixed", "    encoding: arena"), ("is_list: false", "is_list: no"),
    ("schema_version: 11", "schema_version: -1"), ("schema_version: 11   # of the data", ""), ("field_id: 3", "field_id: 1"), ("    nullable: false", "    nullable: false\n    default: 4"),
])
def test_bad_schema_files(old, new):
    with pytest.raises((InvalidArgument, FailedPrecondition)):
        parse(SCHEMA_TEXT.replace(old, new, 1))


def test_schema_file_refuses_what_it_cannot_hold():
    with pytest.raises(InvalidArgument):
        format_schema(SchemaFile(Schema.of(1, Field(1, "x", "int32", default=3)), "id"))
    for bad in ("", "- 1", "a: [", SCHEMA_TEXT + "shard_count: 4\n", SCHEMA_TEXT.replace("fields:", "fields: 3\nx:")):
        with pytest.raises(InvalidArgument):
            schema_file.parse(bad)
