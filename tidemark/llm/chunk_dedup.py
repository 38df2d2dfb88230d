"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes: each byte's number is added to twice the hash so far, so the top bits depend on the
last ``WINDOW`` bytes alone.  A chunk ends where the top ``BITS`` bits are 0 and no such place lies within
``LEAST_CHUNK`` bytes before; a stretch without one is cut every ``MOST_CHUNK`` bytes.  Inserted text moves
chunks, but does not change those behind it.  From every chunk on, the shortest row of chunks of ``LEAST_RUN`` bytes or
more is compared as a whole, and so are the last such row of a text and every text that is shorter; thus a short phrase
used twice, or phrases from different texts side by side, are left alone.  Rows of chunks with equal digests (112 bits)
are equal; all but the first, by row and place, are removed, without what is part of the first itself.

Of a passage that two texts share the bytes before its first chunk border stay, and at its end what the last row of
chunks inside it does not reach; copies of whole texts go.  A text's last chunk
ends with it.  Rows of chunks are dealt by digest, packed, repeats inside a task combined first.  Null and empty texts keep
nothing.  Rows equal in id and text are one text; other rows with one id are told apart by text hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bucket_count, by_bucket
from tidemark.llm.suffix_dedup import (
    COMBINE, COVERED, ROWS, _batch, _by_row, _covers, _deal, _found, _kinds, _unpack, cut_out, numbered, per_row)
from tidemark.llm.textbytes import BYTE_CODE, U64, Texts, slices

WINDOW, BITS, LEAST_CHUNK, MOST_CHUNK, LEAST_RUN = 8, 3, 4, 4096, 64
GEAR = (BYTE_CODE >> U64(32)).astype(np.uint32)
CHUNK = np.dtype([("g", "<u8"), ("h", "<u4"), ("h2", "<u2"), ("row", "<i8"), ("start", "<u4"), ("size", "<u4")])


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash behind each byte, by doubling the number of bytes it sums over."""
    h, have = GEAR[data], 1
    while have < WINDOW:
        h[have:] += h[:-have] << np.uint32(have)
        have *= 2
    return h


def chunk_ends(texts: Texts) -> np.ndarray:
    """Where chunks end, ends of texts included, in order."""
    n = len(texts.data)
    cuts = np.flatnonzero(gear(texts.data) >> np.uint32(32 - BITS) == 0) + 1 if n else np.zeros(0, dtype=np.int64)
    owner = np.searchsorted(texts.offsets, cuts - 1, side="right") - 1
    cuts = cuts[cuts - texts.offsets[owner] >= WINDOW]  # the window lies inside the text
    far = np.ones(len(cuts), dtype=bool)
    far[1:] = np.diff(cuts) >= LEAST_CHUNK
    ends = np.union1d(cuts[far], texts.offsets[1:][np.diff(texts.offsets) > 0])
    sizes = np.diff(ends, prepend=0)
    long = np.flatnonzero(sizes > MOST_CHUNK)
    forced = [np.arange(ends[k] - sizes[k] + MOST_CHUNK, ends[k], MOST_CHUNK) for k in long]
    return np.union1d(ends, np.concatenate(forced)) if forced else ends


def chunk_rows(texts: Texts, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the rows of chunks that are compared."""
    ends = chunk_ends(texts)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    low, high = texts.offsets[:-1], texts.offsets[1:]
    limit = high[np.searchsorted(texts.offsets, starts, side="right") - 1]
    fits = starts + least <= limit
    reach = ends[np.searchsorted(ends, starts[fits] + least)]
    long = high - low >= least
    tail = starts[np.searchsorted(starts, high[long] - least, side="right") - 1]
    short = (high > low) & ~long
    return np.concatenate([starts[fits], tail, low[short]]), np.concatenate([reach, high[long], high[short]])


def _firsts(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first record of each digest, and the spans of the others."""
    r = r[np.lexsort((r["start"], r["row"], r["h2"], r["h"], r["g"]))]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r["g"][1:] != r["g"][:-1]) | (r["h"][1:] != r["h"][:-1]) | (r["h2"][1:] != r["h2"][:-1])
    first = r[np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))] if len(r) else r
    again = r[(r["row"] != first["row"]) | (r["start"] != first["start"])]
    first = first[(r["row"] != first["row"]) | (r["start"] != first["start"])]
    start, end = again["start"].astype(np.int64), again["start"].astype(np.int64) + again["size"]
    start = np.where(again["row"] == first["row"], np.maximum(start, first["start"].astype(np.int64) + first["size"]), start)
    return r[new], _covers(again["row"][start < end], start[start < end], end[start < end])


def repeated_chunks(docs: DataFrame, text: str, least: int = LEAST_RUN) -> DataFrame:
    """``(row, covered, needed)``: spans of chunks that another row or place has before; nothing is needed."""
    buckets = bucket_count(docs.sparkSession)

    def flush(parts):
        kept, again = _firsts(np.concatenate(parts))
        return _batch([_deal((kept["g"] % U64(buckets)).astype(np.int64), kept, 0), _by_row(again, buckets, 1)])

    def deal(batches):
        parts, held = [], 0
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for texts in slices(batch.column(1)):
                starts, ends = chunk_rows(texts, least)
                owner = np.searchsorted(texts.offsets, starts, side="right") - 1
                g, h = texts.span_hash(starts, ends), texts.span_hash(starts, ends, codes="second")
                r = np.zeros(len(ends), dtype=CHUNK)
                r["g"], r["h"], r["h2"] = g, h >> U64(32), h & U64(0xFFFF)
                r["row"], r["start"], r["size"] = rows[texts.first + owner], starts - texts.offsets[owner], ends - starts
                parts.append(r)
                held += len(r)
                if held >= COMBINE:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    def match(batches):
        covered = []
        for held in _kinds(batches):
            covered += [_unpack(held[1], COVERED), _firsts(_unpack(held[0], CHUNK))[1]]
            if sum(map(len, covered)) > COMBINE:
                yield _found(covered, buckets)
                covered = []
        yield _found(covered, buckets)

    dealt = docs.select("row", text).mapInArrow(deal, ROWS)
    return per_row(by_bucket(dealt).mapInArrow(match, ROWS))


def dedup_chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_run: int = LEAST_RUN) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``; ``kept`` has the remaining bytes."""
    rows = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    found = repeated_chunks(rows, "text", least_run).select("row", "covered")
    return cut_out(rows.join(found, "row", "left"), "covered")

