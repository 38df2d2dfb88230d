"""JSON text columns: fields, records, shallow merge and the nested log line."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_MAP = "map<string,string>"


def json_field(text: Column, path: str) -> Column:
    """The value at a JSON path such as ``$.event.parts[0]``, as text."""
    return F.get_json_object(text, path)


def json_records(text: Column) -> Column:
    """A JSON object as a map; nested values keep their JSON text."""
    return F.from_json(text, TEXT_MAP)


def json_concat(left: Column, right: Column) -> Column:
    """Shallow merge of two JSON objects; on a shared key the right one wins.

    Null when either side is not an object.
    """
    lkeys, rkeys = F.json_object_keys(left), F.json_object_keys(right)
    lbody, rbody = _body(left), _body(right)
    spliced = F.concat(
        F.lit("{"), F.concat_ws(",", F.when(lbody != "", lbody), F.when(rbody != "", rbody)), F.lit("}")
    )
    typed = "map<string,variant>"
    kept = F.map_filter(F.from_json(left, typed), lambda k, _: ~F.array_contains(rkeys, k))
    merged = F.to_json(F.map_concat(kept, F.from_json(right, typed)))
    return F.when(F.arrays_overlap(lkeys, rkeys), merged).when(
        lkeys.isNotNull() & rkeys.isNotNull(), spliced
    )


def _body(obj: Column) -> Column:
    inner = F.trim(obj)
    return F.trim(F.substring(inner, F.lit(2), F.length(inner) - 2))


def payload_fields(message: Column, wanted: Sequence[str], root: str = "payload") -> Column:
    """The wanted fields of a message's payload; absent ones are left out of the map."""
    payload = json_records(json_field(message, f"$.{root}"))
    return F.map_filter(payload, lambda k, _: k.isin(list(wanted)))


def known_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Projection to the wanted columns the frame has."""
    return df.select(*[c for c in wanted if c in df.columns])


def split_log_line(line: Column, stamp_chars: int = 24) -> tuple[Column, Column]:
    """Time text and JSON text of a line that starts with a fixed-width time."""
    return F.trim(F.substring(line, 1, stamp_chars)), F.substring(line, stamp_chars + 1, 2**31 - 1)


def flatten_log_lines(
    df: DataFrame, line: str, record: str, fields: Mapping[str, str], stamp: str = "stamp", stamp_chars: int = 24
) -> DataFrame:
    """The time and the wanted fields of nested log lines, each line parsed once.

    ``record`` is the type of a line's JSON object; objects inside it that are declared as
    ``map<string,string>`` keep their values as text.  ``fields`` names the columns and
    gives each as an SQL path into the record, such as ``event.parts[0]``.
    """
    time, body = split_log_line(F.col(line), stamp_chars)
    parsed = df.select(time.alias(stamp), F.from_json(body, record).alias("doc"))
    return parsed.select(stamp, *[F.expr(f"doc.{path}").alias(name) for name, path in fields.items()])
