r"""Chat formatting from heterogeneous layouts, in DataFrame functions only.

A layout is a set of nested field paths.  The hash of the known paths of a table or of a JSON record
selects a declarative mapping that turns it into canonical turns ``(conv_id, turn, role, text)``.
Canonical turns are formatted with a template, and the text a model is trained on (every assistant
text) is given as spans of the formatted text.

Template: ``### role: text </turn>\n`` for each turn.  Inside roles and texts ``\`` becomes ``\\``,
``###`` becomes ``\h`` and ``</turn>`` becomes ``\t``; in roles ``:`` becomes ``\c``.  So no control
string can occur in a role or text, and ``read_back`` restores them exactly.

Null roles and texts are empty.  Turns are ordered by turn, role and text, so ties have one result;
repeated rows are repeated turns; a null conversation id is a conversation of its own.  Records of an
unknown layout are returned by ``unknown_records`` and are in no conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

MARK, END, ROLE_END = "### ", " </turn>\n", ": "
ESCAPES = (("###", "h"), ("</turn>", "t"), (":", "c"))


@dataclass(frozen=True)
class Layout:
    """``turns`` lists ``(role, path)`` for flat records; ``items`` names (list, role field, text field)."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None

    def paths(self) -> frozenset[str]:
        if self.rows:
            return frozenset(self.rows)
        if self.items:
            return frozenset([self.items[0], *(f"{self.items[0]}[].{f}" for f in self.items[1:])])
        return frozenset(p for _, p in self.turns)


LAYOUTS = (
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("prompt and response", (("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", (("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction without input", (("user", "instruction"), ("assistant", "output"))),
    Layout("messages", items=("messages", "role", "content")),
    Layout("shared conversations", items=("conversations", "from", "value")),
)
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN = sorted(set().union(*(x.paths() for x in LAYOUTS)))


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of the known ones among nested field paths; extra fields do not count."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths()): x for x in LAYOUTS}


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested field paths such as ``messages``, ``messages[].role``."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    if not isinstance(schema, T.StructType):
        return []
    out = []
    for f in schema.fields:
        path = f"{at}.{f.name}" if at else f.name
        out += [path, *field_paths(f.dataType, path)]
    return out


def _canonical_role(role: Column) -> Column:
    out = F.coalesce(role, F.lit(""))
    for other, name in ROLES.items():
        out = F.when(role == other, name).otherwise(out)
    return out


def _turns(layout: Layout, field) -> Column:
    """The turns of a record as an array; ``field(path)`` gives a column."""
    if layout.items:
        items, role, text = layout.items
        return F.transform(field(items), lambda m: F.struct(
            _canonical_role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))
    flat = F.array(*(F.struct(F.lit(r).alias("role"), field(p).alias("text")) for r, p in layout.turns))
    optional = F.filter(flat, lambda t: t["text"].isNotNull())
    return F.transform(optional, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def canonical_turns(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Canonical turns of a table, by the fingerprint of its schema; ``ValueError`` for an unknown layout."""
    layout = BY_FINGERPRINT.get(fingerprint(p for p in field_paths(df.schema) if p != conv_id or "turn" in df.columns))
    if layout is None:
        raise ValueError(f"no layout for the fields {sorted(set(field_paths(df.schema)) & set(KNOWN))}")
    if layout.rows:
        ident, turn, role, text = (F.col(c) for c in layout.rows)
        return df.select(
            ident.cast("long").alias("conv_id"), turn.cast("long").alias("turn"),
            _canonical_role(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    turns = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.posexplode(_turns(layout, F.col)))
    return turns.select("conv_id", F.col("pos").cast("long").alias("turn"), "col.role", "col.text")


def record_paths(record: Column) -> Column:
    """The field paths of a JSON record, with those of the first item of each known list."""

    def inside(at: str) -> Column:
        keys = F.json_object_keys(F.get_json_object(record, f"$.{at}[0]"))
        return F.transform(keys, lambda k: F.concat(F.lit(f"{at}[]."), k))

    nested = [inside(x.items[0]) for x in LAYOUTS if x.items]
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(F.json_object_keys(record), none), *(F.coalesce(n, none) for n in nested))


def record_fingerprint(record: Column) -> Column:
    known = F.array(*(F.lit(p) for p in KNOWN))
    return F.sha2(F.array_join(F.array_sort(F.array_intersect(record_paths(record), known)), "\n"), 256)


def _record_schema() -> str:
    flat = sorted({p for x in LAYOUTS for _, p in x.turns})
    lists = sorted({x.items for x in LAYOUTS if x.items})
    return ", ".join(
        [f"`{p}` string" for p in flat]
        + [f"`{i}` array<struct<`{r}`: string, `{t}`: string>>" for i, r, t in lists])


def record_turns(df: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """Canonical turns of JSON records, each by its own fingerprint."""
    parsed = df.select(
        F.col(conv_id).cast("long").alias("conv_id"), record_fingerprint(F.col(record)).alias("layout"),
        F.from_json(record, _record_schema()).alias("r"))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for mark, layout in BY_FINGERPRINT.items():
        if not layout.rows:
            turns = F.when(F.col("layout") == mark, _turns(layout, lambda p: F.col("r")[p])).otherwise(turns)
    out = parsed.select("conv_id", F.posexplode(turns))
    return out.select("conv_id", F.col("pos").cast("long").alias("turn"), "col.role", "col.text")


def unknown_records(df: DataFrame, record: str = "record") -> DataFrame:
    """Records that no layout fits, malformed ones included."""
    known = [m for m, x in BY_FINGERPRINT.items() if not x.rows]
    return df.where(F.col(record).isNull() | ~record_fingerprint(F.col(record)).isin(known))


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control, letter in ESCAPES if role else ESCAPES[:2]:
        out = F.replace(out, F.lit(control), F.lit("\\" + letter))
    return out


def unescape(text: Column) -> Column:
    """Escapes are pairs, so cutting at each double backslash leaves pieces with one-letter escapes only."""

    def plain(piece: Column) -> Column:
        for control, letter in ESCAPES:
            piece = F.replace(piece, F.lit("\\" + letter), F.lit(control))
        return piece

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, and ``loss``, the spans of assistant texts.

    A span is ``(start, size)`` in code points.  One shuffle, by conversation; a conversation is one
    string, so it is the one thing that has to fit into a task.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(MARK), escape(F.col("role"), role=True), F.lit(ROLE_END))
    body = escape(F.col("text"))
    blocks = turns.select(
        "conv_id", "turn", "role", "text", F.concat(head, body, F.lit(END)).alias("block"),
        F.length(head).alias("lead"), F.length(body).alias("size"))
    before = F.coalesce(F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.select(
        "conv_id", "block", F.row_number().over(order).alias("n"),
        F.when(F.col("role") == "assistant", F.struct((before + F.col("lead")).alias("start"), "size")).alias("span"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "block", "span"))).alias("t"))
    return whole.select(
        "conv_id", F.array_join(F.col("t.block"), "").alias("formatted"),
        F.array_compact(F.col("t.span")).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")
    return F.transform(blocks, lambda b: F.struct(
        unescape(F.regexp_extract(b, r"(?s)^### ([^:]*): ", 1)).alias("role"),
        unescape(F.regexp_replace(b, r"(?s)^### [^:]*: ", "")).alias("text")))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(
        loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["size"].cast("int")))), "")
