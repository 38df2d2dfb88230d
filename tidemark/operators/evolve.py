"""Schema versions of JSON records: registry, compatibility and mixed-version reads."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import running_count, with_running

# Problem names reported by the compatibility check.
READER_FIELD_MISSING_DEFAULT_VALUE = "READER_FIELD_MISSING_DEFAULT_VALUE"
TYPE_MISMATCH = "TYPE_MISMATCH"

# A field may be read as a wider type than it was written with.
WIDER = {"int": {"bigint", "float", "double"}, "bigint": {"float", "double"}, "float": {"double"}}

_CORRUPT = "__corrupt"


class _Required:
    """No default; the one such object also after a trip to an executor."""

    def __reduce__(self):
        return "REQUIRED"


REQUIRED = _Required()


@dataclass(frozen=True)
class Field:
    """A record field; without a default every record must have it."""

    type: str
    default: Any = REQUIRED

    @property
    def required(self) -> bool:
        return self.default is REQUIRED


Schema = Mapping[str, Field]


def problems(writer: Schema, reader: Schema) -> list[tuple[str, str]]:
    """Why a reader cannot read what the writer wrote: ``(field, problem)`` pairs."""
    found = []
    for name, field in reader.items():
        if name not in writer:
            if field.required:
                found.append((name, READER_FIELD_MISSING_DEFAULT_VALUE))
        elif field.type != writer[name].type and field.type not in WIDER.get(writer[name].type, ()):
            found.append((name, TYPE_MISMATCH))
    return found


def incompatible(old: Schema, new: Schema, mode: str = "BACKWARD") -> list[tuple[str, str]]:
    """Problems of moving from ``old`` to ``new``.

    BACKWARD: new readers read old records.  FORWARD: old readers read new records.
    FULL: both.
    """
    if mode not in ("BACKWARD", "FORWARD", "FULL"):
        raise ValueError(f"unknown compatibility mode {mode}")
    found = problems(old, new) if mode != "FORWARD" else []
    return found + (problems(new, old) if mode != "BACKWARD" else [])


def ensure_compatible(old: Schema, new: Schema, mode: str = "BACKWARD") -> None:
    """Guard before a write with a new schema."""
    found = incompatible(old, new, mode)
    if found:
        raise ValueError("incompatible schema: " + ", ".join(f"{p} ({f})" for f, p in found))


def _parsed(messages: DataFrame, schema: Schema, value: str) -> DataFrame:
    """``messages`` with the record ``__r``, its keys, and ``problem``: why it is no record of this schema."""
    ddl = ", ".join([*(f"`{n}` {f.type}" for n, f in schema.items()), f"`{_CORRUPT}` string"])
    parsed = messages.withColumns({
        "__r": F.from_json(value, ddl, {"columnNameOfCorruptRecord": _CORRUPT}), "__keys": F.json_object_keys(value)})
    missing = F.filter(
        F.array(*[F.lit(n) for n, f in schema.items() if f.required]).cast("array<string>"),
        lambda n: ~F.array_contains("__keys", n))
    problem = (
        F.when(F.col(value).isNull(), "tombstone")
        .when(F.col("__keys").isNull() | F.col("__r").getField(_CORRUPT).isNotNull(), "malformed")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))))
    return parsed.withColumn("problem", problem)


def read_as(messages: DataFrame, schema: Schema, value: str = "value") -> DataFrame:
    """Records of any version as the reader's schema.

    Fields the reader does not know are ignored; a field the record lacks takes its
    default.  A field that is present and null stays null.  Messages that are no records
    of the schema are left out here and returned by :func:`unreadable`.
    """
    kept = [c for c in messages.columns if c != value]

    def column(name: str, field: Field):
        read = F.col("__r").getField(name)
        if not field.required:
            read = F.when(F.array_contains("__keys", name), read).otherwise(
                F.lit(field.default).cast(field.type))
        return read.alias(name)

    return _parsed(messages, schema, value).where("problem is null").select(
        *kept, *[column(n, f) for n, f in schema.items()])


def unreadable(messages: DataFrame, schema: Schema, value: str = "value") -> DataFrame:
    """The messages that :func:`read_as` leaves out, with their ``problem``: a tombstone,
    malformed JSON or a value of another type, or required fields that are missing."""
    return _parsed(messages, schema, value).where("problem is not null").select(*messages.columns, "problem")


def record_shape(value: str):
    """Field names and types of a JSON object, ordered by name; null for anything else.

    Types are those of the values, ``null`` where the value is null.  Numbers are ``bigint`` or ``double``.
    """
    kind = lambda v: F.regexp_replace(F.lower(F.schema_of_variant(v)), r"decimal\(\d+,\d+\)", "double")
    fields = F.transform(
        F.map_entries(F.from_json(value, "map<string,variant>")),
        lambda e: F.struct(e["key"].alias("field"), F.regexp_replace(kind(e["value"]), "^void$", "null").alias("type")))
    return F.when(F.json_object_keys(value).isNotNull(), F.array_sort(fields))


def schema_registry(messages: DataFrame, offset: str, value: str = "value") -> DataFrame:
    """Distinct record shapes in order of first use: ``version, fingerprint, fields, first_offset, n``.

    The same fields with the same types always get the same version.  A null value takes the type that
    the field has in other records of the same fields, if there is just one.  ``fields`` is an array of
    ``field type``.  Tombstones and messages that are no objects have no shape.
    """
    shapes = messages.select(F.col(offset), record_shape(value).alias("shape")).where("shape is not null")
    exact = shapes.groupBy("shape").agg(F.min(offset).alias("first_offset"), F.count(F.lit(1)).alias("n"))
    # one row per distinct shape from here on
    named = exact.withColumn("names", F.col("shape.field"))
    typed = named.select("names", F.explode("shape").alias("f")).where("f.type <> 'null'").groupBy("names", "f.field").agg(
        F.min("f.type").alias("type"), F.count_distinct("f.type").alias("types")).where("types = 1")
    known = typed.groupBy("names").agg(F.map_from_entries(F.collect_list(F.struct("field", "type"))).alias("known"))
    filled = named.join(known, "names", "left").withColumn("fields", F.transform("shape", lambda f: F.concat_ws(
        " ", f["field"], F.when(f["type"] == "null", F.coalesce(F.try_element_at("known", f["field"]), f["type"])).otherwise(f["type"]))))
    found = filled.groupBy("fields").agg(F.min("first_offset").alias("first_offset"), F.sum("n").alias("n"))
    ranked = with_running(found, [], ["first_offset"], {"version": running_count()}, dense=False)
    return ranked.select("version", F.sha2(F.array_join("fields", ","), 256).alias("fingerprint"), "fields", "first_offset", "n")


def field_changes(registry: DataFrame, reader: Schema) -> DataFrame:
    """What changes from version to version, judged by :func:`problems`: ``version, field, change, problem``.

    A change is ``added``, ``removed`` or ``retyped``; ``problem`` is null if a reader of the new version
    can read the old one.  Fields with a default in ``reader`` have one in every version.
    """
    now = registry.select("version", F.col("fields").alias("now"))
    before = registry.select((F.col("version") + 1).alias("version"), F.col("fields").alias("before"))

    def schema_of(fields: list[str]) -> Schema:
        typed = dict(f.split(" ", 1) for f in fields)
        return {n: Field(t, reader[n].default if n in reader else REQUIRED) for n, t in typed.items()}

    def judge(batches):
        for batch in batches:
            rows = []
            for version, new, old in zip(*(c.to_pylist() for c in batch.columns)):
                writer, now_schema = schema_of(old), schema_of(new)
                found = dict(problems(writer, now_schema))
                for name in sorted(writer.keys() | now_schema.keys()):
                    change = ("added" if name not in writer else "removed" if name not in now_schema
                              else "retyped" if writer[name].type != now_schema[name].type else None)
                    if change:
                        rows.append((version, name, change, found.get(name)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], type=t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))],
                names=["version", "field", "change", "problem"])

    return now.join(before, "version").select("version", "now", "before").mapInArrow(
        judge, "version bigint, field string, change string, problem string")
