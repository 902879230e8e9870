"""Schema files: YAML documents of a fixed shape.

The file is loaded as YAML whose scalars all stay text, and then held against
``DOCUMENT``, a table of the keys that each mapping may have, which of them it
must have, and how a value's text is read. Anything else is an error. Defaults
and deleted fields have no form in the file. Needs PyYAML.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from ..errors import InvalidArgument
from ..schema import Field, Schema
from .files import Files


@dataclass(frozen=True)
class SchemaFile:
    schema: Schema
    primary_key: str
    shard_count: int | None = None
    hash_seed: int | None = None
    hash_version: int | None = None


def unsigned(text) -> int:
    if isinstance(text, str) and text.isascii() and text.isdigit() and (n := int(text)) < 2**64:
        return n
    raise ValueError("is no unsigned 64-bit number")


def flag(text) -> bool:
    try:
        return {"true": True, "false": False}[text]
    except (KeyError, TypeError):
        raise ValueError("is neither true nor false") from None


def word(text) -> str:
    if isinstance(text, str) and text:
        return text
    raise ValueError("is no text")


def exactly(wanted: str) -> Callable:
    def read(text) -> str:
        if text != wanted:
            raise ValueError(f"is not {wanted}")
        return wanted

    return read


def mapping(required: dict[str, Callable], optional: dict[str, Callable] | None = None) -> Callable:
    known = required | (optional or {})

    def read(node) -> dict:
        if not isinstance(node, dict):
            raise ValueError("is no mapping")
        wrong = [*(f"has the unknown key {k}" for k in node if k not in known), *(f"lacks {k}" for k in required if k not in node)]
        if wrong:
            raise ValueError(", ".join(wrong))
        out = {}
        for k, v in node.items():
            try:
                out[k] = known[k](v)
            except ValueError as e:
                raise ValueError(f"{k}: {v!r} {e}" if isinstance(v, str) else f"{k}: {e}") from None
        return out

    return read


def listing(each: Callable) -> Callable:
    def read(node) -> list:
        if not isinstance(node, list) or not node:
            raise ValueError("is no list of at least one entry")
        return [each(x) for x in node]

    return read


#: The keys of the format.
FIELD = {"field_id": unsigned, "name": word, "type": word, "is_list": flag, "nullable": flag, "encoding": word}
KEY = {"name": word, "type": exactly("uint64")}
SETTINGS = {"shard_count": unsigned, "hash_seed": unsigned, "hash_version": unsigned}
DOCUMENT = mapping({"schema_version": unsigned, "primary_key": mapping(KEY), "fields": listing(mapping(FIELD))}, SETTINGS)


def loaded(text: str):
    """The document with scalars as text; a key that repeats is an error."""
    import yaml

    class Loader(yaml.BaseLoader):
        def construct_mapping(self, node, deep=False):
            names = [k.value for k, _ in node.value]
            if len(set(names)) < len(names):
                raise yaml.constructor.ConstructorError(None, None, "a key occurs twice", node.start_mark)
            return super().construct_mapping(node, deep)

    Loader.add_constructor("tag:yaml.org,2002:map", lambda self, node: self.construct_mapping(node, deep=True))
    try:
        return yaml.load(text, Loader)  # noqa: S506  BaseLoader makes text, lists and mappings only
    except yaml.YAMLError as e:
        raise InvalidArgument(f"the schema file is no YAML document: {e}") from e


def parse(text: str) -> SchemaFile:
    try:
        found = DOCUMENT(loaded(text))
    except ValueError as e:
        if isinstance(e, InvalidArgument):
            raise
        raise InvalidArgument(f"the schema file {e}") from None
    schema = Schema(found["schema_version"])
    for f in found["fields"]:
        schema = schema.add_field(Field(**f))
    return SchemaFile(schema, found["primary_key"]["name"], **{k: found[k] for k in SETTINGS if k in found})


def format_schema(file: SchemaFile) -> str:
    """The file's text; fails on what the format cannot hold."""
    import yaml

    if any(f.default is not None for f in file.schema.fields) or file.schema.deleted:
        raise InvalidArgument("defaults and deleted fields have no form in a schema file")
    settings = {k: v for k in SETTINGS if (v := getattr(file, k)) is not None}
    fields = [{k: getattr(f, k) for k in FIELD} for f in file.schema.fields]
    return yaml.safe_dump({"schema_version": file.schema.version, **settings, "primary_key": {"name": file.primary_key, "type": "uint64"}, "fields": fields}, sort_keys=False)


def read(spark: SparkSession, path: str) -> SchemaFile:
    return parse(Files(spark).read_text(path))


def write(spark: SparkSession, path: str, file: SchemaFile, version: int) -> None:
    """Writes the schema under another version."""
    Files(spark).write_text(path, format_schema(replace(file, schema=replace(file.schema, version=version))))
