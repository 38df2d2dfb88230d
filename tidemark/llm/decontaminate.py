"""Benchmark decontamination by winnowing.

Words are compared after lower-casing A-Z.  A window is ``WINDOW`` consecutive words of a benchmark
item; an item with fewer words, but not none, is one window.  Of each ``WINDOW - GRAM + 1`` word grams in
a row the one with the least hash is a fingerprint, so equal windows have equal fingerprints and no
shared window is missed.  Training fingerprints are joined with those of the benchmark; hits are
extended to the whole windows, whose two 64-bit hashes decide.

The benchmark is a stated query set.  It is dealt by window and item hash into blocks of about
``BLOCK`` rows, and each block is sent to all executors and joined with all documents; the number of
blocks follows from a count, so what is sent is bounded and no window is left out.  With a benchmark
of a few million words that is one scan of the documents and no shuffle of them.

Null and empty texts have no words and no windows.  Repeated documents are judged one by one; items with
equal texts are all named.  Null item ids are written as the empty string.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import unused, without, written
from tidemark.llm.textbytes import (
    U64, WORD_BYTE, Texts, depth, grams, grams_at, mix, owners, sliding_min, slices)

WINDOW = 10
GRAM = 4
BLOCK = 2_000_000
SECOND = U64(0x8CB92BA72F3D8DD7)


def _words(texts: Texts):
    starts, ends, counts = texts.spans(WORD_BYTE)
    return texts.span_hash(starts, ends, codes="lower"), counts


def _windows(codes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words and two hashes of all windows of ``size`` words that lie in one text."""
    owner = owners(counts)
    first = np.flatnonzero(owner[:max(0, len(owner) - size + 1)] == owner[size - 1:])
    if not len(first):
        none = np.zeros(0, dtype=U64)
        return first, none, none
    return first, grams(codes, size)[first], grams(mix(codes ^ SECOND), size)[first]


@dataclass
class Block:
    """Benchmark windows: fingerprints, and by size of window the sorted hashes and the items of each."""

    prints: np.ndarray
    sizes: dict[int, tuple[np.ndarray, ...]]
    items: list[str]


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(size, h, h2, print, item)``: the distinct windows of the items."""

    def run(batches):
        for batch in batches:
            ids = np.array(["" if i is None else i for i in batch.column(0).to_pylist()], dtype=object)
            for texts in slices(batch.column(1)):
                codes, counts = _words(texts)
                begin = np.concatenate([[0], np.cumsum(counts)])
                for size in range(1, window + 1):
                    first, h, h2 = _windows(codes, counts, size)
                    owner = np.searchsorted(begin, first, side="right") - 1
                    use = counts[owner] == size if size < window else counts[owner] >= size
                    least = h
                    if size == window and len(first):
                        least = sliding_min(grams(codes, GRAM), window - GRAM + 1)[first]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(int(use.sum()), size, dtype=np.int32))]
                        + [pa.array(x[use].view(np.int64)) for x in (h, h2, least)]
                        + [pa.array(ids[texts.first + owner[use]], type=pa.string())],
                        names=["size", "h", "h2", "print", "item"])

    out = items.select(F.col(item_id).cast("string"), text).mapInArrow(
        run, "size int, h long, h2 long, print long, item string")
    return out.distinct()


def _blocks(windows: DataFrame, limit: int, window: int):
    """The windows in blocks of about ``limit`` rows; the items of a frequent window spread over the blocks."""
    windows = written(windows, "windows")
    n = max(1, -(-windows.count() // limit))
    for k in range(n):
        part = windows.where(F.pmod(F.xxhash64("h", "item"), F.lit(n)) == k).toPandas()
        items, code = np.unique(part["item"].to_numpy(dtype=str), return_inverse=True)
        size, h, h2, least = (part[c].to_numpy() for c in ("size", "h", "h2", "print"))
        h, h2 = h.view(U64), h2.view(U64)
        sizes = {}
        for s in np.unique(size):
            order = np.flatnonzero(size == s)
            order = order[np.lexsort((h2[order], h[order]))]
            a, b = h[order], h2[order]
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            starts = np.concatenate([[0], cuts])
            sizes[int(s)] = (a[starts], b[starts], np.concatenate([starts, [len(a)]]), code[order].astype(np.int32))
        yield n, Block(np.unique(least[size == window].view(U64)), sizes, [str(i) for i in items])


def _among(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values are in an ordered array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _matches(block: Block, codes: np.ndarray, counts: np.ndarray, window: int):
    """``(first word, size, place)`` of each window of the block that the texts have."""
    owner = owners(counts)
    for size, (h, h2, _, _) in block.sizes.items():
        if len(codes) < size:
            continue
        if size == window:
            prints = sliding_min(grams(codes, GRAM), window - GRAM + 1)
            starts = np.concatenate([[0], np.flatnonzero(prints[1:] != prints[:-1]) + 1])
            good = _among(block.prints, prints[starts])
            sizes = np.diff(np.concatenate([starts, [len(prints)]]))
            first = np.flatnonzero(np.repeat(good, sizes))
        else:
            first = np.arange(len(codes) - size + 1)
        first = first[owner[first] == owner[first + size - 1]]
        mine, mine2 = grams_at(codes, first, size), grams_at(mix(codes ^ SECOND), first, size)
        place = np.searchsorted(h, mine)
        for _ in range(1 + int(np.max(np.unique(h, return_counts=True)[1], initial=1))):
            step = (place < len(h)) & (h[np.minimum(place, len(h) - 1)] == mine) & (h2[np.minimum(place, len(h) - 1)] < mine2)
            if not step.any():
                break
            place = place + step
        at = np.minimum(place, len(h) - 1)
        hit = (h[at] == mine) & (h2[at] == mine2)
        yield first[hit], size, at[hit]


def _judge(block: Block, texts: Texts, window: int):
    """Words, hit words, hit runs and named items of each text."""
    codes, counts = _words(texts)
    owner = owners(counts)
    starts, ends = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    named = [np.zeros((0, 2), dtype=np.int64)]
    for first, size, place in _matches(block, codes, counts, window):
        starts.append(first)
        ends.append(first + size)
        pairs = np.unique(np.stack([owner[first], place], axis=1), axis=0)
        row, item = block.sizes[size][2], block.sizes[size][3]
        n = row[pairs[:, 1] + 1] - row[pairs[:, 1]]
        take = np.repeat(row[pairs[:, 1]] - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n) + np.arange(n.sum())
        named.append(np.stack([np.repeat(pairs[:, 0], n), item[take]], axis=1))
    covered = depth(len(codes), np.concatenate(starts), np.concatenate(ends)) > 0
    pairs = np.unique(np.concatenate(named), axis=0)
    cut = np.searchsorted(pairs[:, 0], np.arange(texts.n + 1))
    items = [sorted(block.items[i] for i in pairs[a:b, 1]) for a, b in zip(cut, cut[1:])]
    return counts, covered, items


def _one_block(docs: DataFrame, block: Block, text: str, window: int, hits: bool) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` and ``items``; with ``hits``, hit rows only and a byte per word."""
    sent = docs.sparkSession.sparkContext.broadcast(block)
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields])
    for name, kind in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("items", T.ArrayType(T.StringType()))):
        schema.add(name, kind)
    if hits:
        schema.add("hits", T.BinaryType())

    def run(batches):
        for batch in batches:
            for texts in slices(batch.column(place)):
                counts, covered, items = _judge(sent.value, texts, window)
                begin = np.concatenate([[0], np.cumsum(counts)])
                n_hit = np.diff(np.concatenate([[0], np.cumsum(covered)])[begin])
                rows = batch.slice(texts.first, texts.n)
                columns = [*rows.columns, pa.array(counts), pa.array(n_hit), pa.array(items, type=pa.list_(pa.string()))]
                if hits:
                    marks = [covered[a:b].astype(np.uint8).tobytes() for a, b in zip(begin, begin[1:])]
                    columns.append(pa.array(marks, type=pa.binary()))
                out = pa.RecordBatch.from_arrays(columns, names=schema.names)
                yield out.filter(pa.array(n_hit > 0)) if hits else out

    return docs.mapInArrow(run, schema)


def _merged(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Hit words and items of all blocks for each document that any block hits."""
    one = F.aggregate(
        F.sequence(F.lit(1), F.length(F.col("marks")[0])), F.lit(0).cast("long"),
        lambda n, i: n + F.when(F.exists("marks", lambda m: F.substring(m, i, F.lit(1)) == F.unhex(F.lit("01"))), 1).otherwise(0))
    return marks.groupBy(*keys).agg(
        F.collect_set("hits").alias("marks"), F.flatten(F.collect_set("items")).alias("items")).select(
        *keys, one.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"))


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` and ``items`` (sorted ids as strings of the items that occur).

    Columns of ``docs`` with these names are replaced.  A benchmark of several blocks takes one scan of the
    documents per block; then only rows of hit documents are shuffled.
    """
    docs = without(docs, ["n_words", "n_hit", "items"])
    h, d, found, hit = unused(docs, "h", "d", "found", "hit")
    parts = _blocks(benchmark_windows(items, item_id, item_text, window), block, window)
    n, first = next(parts)
    if n == 1:
        return _one_block(docs, first, text, window, hits=False)
    same = [F.xxhash64(text).alias(h), F.sha2(text, 256).alias(d)]
    keyed = docs.select(text, *same)
    marks = None
    for _, part in [(n, first), *parts]:
        rows = written(_one_block(keyed, part, text, window, hits=True).select(h, d, "hits", "items").distinct(), "hits")
        marks = rows if marks is None else marks.union(rows)
    merged = _merged(marks, [h, d]).withColumnRenamed("items", found).withColumnRenamed("n_hit", hit)
    none = Block(np.zeros(0, dtype=U64), {}, [])
    base = _one_block(docs.select("*", *same), none, text, window, hits=False)
    out = base.join(merged, [h, d], "left")
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns], "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(found, F.array().cast("array<string>")).alias("items"))
