"""Live as-of join: rows of a stream with the table that the same stream builds, on Spark's keyed state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.aggregates import has_key

#: Rows without a key match nothing; they are spread over so many groups.
KEYLESS = 64


class KnownValues(StatefulProcessor):
    """Keeps the latest non-null value of each column for one key, and gives it to the rows that follow."""

    def __init__(self, order: str, kept: Sequence[str], values: Sequence[str], state: T.StructType):
        self.order, self.kept, self.values, self.state = order, list(kept), list(values), state
        self.result = Row(*self.kept, *self.values)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", self.state)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.known.get()
        known = list(before) if before else [None] * len(self.values)
        for row in sorted(rows, key=lambda r: r[self.order]):
            if row["__is_row"]:
                yield self.result(*[row[c] for c in self.kept], *known)
            else:
                found = [row[v] for v in self.values]
                known = [new if new is not None else old for new, old in zip(found, known)]
        if any(v is not None for v in known) and (not before or tuple(known) != tuple(before)):
            self.known.update(tuple(known))

    def close(self) -> None:
        pass


def live_asof_join(log: DataFrame, is_row: Column, on: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Left join of a stream's rows with the table messages of their key ahead of them, in the order of ``order``.

    Messages for which ``is_row`` holds come out, in append mode, with the latest non-null ``values`` of the other messages of
    their key: those of earlier micro-batches from the key's state, and in the same micro-batch those with a lower ``order``.
    Messages must arrive in ``order`` from one micro-batch to the next.  A table message without a key says
    nothing, a row without one stays without values.  The rows of a key in one micro-batch meet in one task, so the
    source's limit per trigger bounds what a busy key can bring there.
    """
    kept = [c for c in log.columns if c not in values]
    state = log.select(*values).schema
    keyless = F.when(has_key(on), F.lit(-1)).otherwise(F.pmod(F.xxhash64(order), F.lit(KEYLESS)).cast("int"))
    marked = log.withColumns({"__is_row": F.coalesce(is_row, F.lit(False)), "__spread": keyless}).where(
        F.col("__is_row") | has_key(on))
    out = T.StructType([*log.select(*kept).schema.fields, *state.fields])
    return marked.groupBy(*on, "__spread").transformWithState(
        KnownValues(order, kept, values, state), out, outputMode="Append", timeMode="None")
