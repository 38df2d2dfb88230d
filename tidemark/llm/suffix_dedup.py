"""Suffix-array deduplication of long repeated strings, one suffix bucket at a time.

A byte is removed if it lies in a string of ``LENGTH`` bytes that also starts earlier: in a row before (by id), or in
the same text.  Strings never cross texts and are judged on the input.

*Buckets.*  Suffixes that tie over ``LENGTH`` bytes must meet in one bucket.  A suffix goes by its anchor: the least
of the hashes of the ``GRAM``-byte strings inside its first ``LENGTH`` bytes, the first of equals.  Neighbouring suffixes
mostly share an anchor, so what is dealt is one record per anchor with the run of suffixes it stands for and a
hash of the run's bytes; records of equal runs in a task are combined before the shuffle.

*Equal runs.*  Every run but the first of equals repeats as a whole.  Only the first of each of several different
runs at one anchor has to be looked at suffix by suffix, and only its bytes are fetched.

*Sorting a bucket.*  The runs of a bucket are laid out so that anchors fall on the same residue modulo ``PERIOD``; then
suffixes that can tie have equal residues and meet the difference cover ``COVER`` at the same offset.  The cover's
suffixes are ranked first, by doubling the compared length ``PERIOD`` at a time.  A suffix is then sorted by its few
bytes up to the next cover position and the rank there, however long the tie is; neighbours in the order are
compared over ``LENGTH`` bytes.  An anchor with very many different runs is dealt by the strings themselves
instead, so no bucket grows with one passage.

Null and empty texts keep nothing and lose nothing.  Rows equal in id and text are one text, with one result each.
Rows with one id and different texts, and null ids, are ordered by id (nulls first) and text hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import bucket_count, by_bucket, ranges, runs, written
from tidemark.llm.textbytes import U64, Texts, _power_tables, mix, owners, slices, sliding_min

LENGTH, GRAM = 100, 50
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Different runs at one anchor beyond which its strings are dealt one by one.
MANY_RUNS = 64
#: Records that a task combines at once.
COMBINE = 1_000_000

RUN = np.dtype([("g", "<u8"), ("h", "<u4"), ("h2", "<u2"), ("row", "<i8"), ("start", "<u4"), ("more", "u1"), ("lead", "u1")])
COVERED = np.dtype([("row", "<i8"), ("start", "<u4"), ("end", "<u4")])
NEEDED = np.dtype([("row", "<i8"), ("g", "<u8"), ("start", "<u4"), ("more", "u1"), ("lead", "u1"), ("many", "u1")])
#: A run of suffixes with its bytes: size bytes of the shared buffer; ``lead`` bytes before the anchor.
PIECE = np.dtype([("tag", "<u8"), ("row", "<i8"), ("start", "<u4"), ("size", "<u2"), ("lead", "u1")])
ROWS = "bucket int, kind int, payload binary, extra binary"


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``docs`` with ``row``: the id where ids tell rows apart, else a number in order of id and text hash."""
    ids = docs.agg(F.count("*").alias("n"), F.countDistinct(doc_id).alias("d")).first()
    if ids.n == ids.d:
        return docs.withColumn("row", F.col(doc_id).cast("long"))
    named = docs.withColumn("_h", F.xxhash64(text)).withColumn("_d", F.sha2(text, 256))
    keys = named.select(F.col(doc_id).alias("_id"), "_h", "_d").distinct()
    order = keys.repartitionByRange("_id", "_h", "_d").sortWithinPartitions("_id", "_h", "_d")
    numbers = written(order.withColumn("row", F.monotonically_increasing_id()), "rows")
    same = named[doc_id].eqNullSafe(numbers["_id"]) & (named["_h"] == numbers["_h"]) & named["_d"].eqNullSafe(numbers["_d"])
    return named.join(numbers, same).select(*docs.columns, "row")


def anchor_runs(texts: Texts) -> tuple[np.ndarray, ...]:
    """``(anchor, first suffix, last suffix, anchor hash)`` of the runs of suffixes of a slice."""
    data, n = texts.data, len(texts.data)
    if n < LENGTH:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(U64)
    sums, (_, inverse) = texts.sums(), _power_tables(n + 1)
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:n - GRAM + 1])
    bits = U64(max(20, int(n).bit_length()))
    place = (U64(1) << bits) - U64(1)
    least = sliding_min((grams & ~place) | np.arange(len(grams), dtype=U64), LENGTH - GRAM + 1) & place
    owner = owners(np.diff(texts.offsets))
    anchor = np.where(owner[:n - LENGTH + 1] == owner[LENGTH - 1:], least.astype(np.int64), -1)
    starts, ends = runs(anchor)
    keep = anchor[starts] >= 0
    first, last = starts[keep], ends[keep] - 1
    return anchor[first], first, last, grams[anchor[first]]


def _batch(parts: list[tuple[np.ndarray, int, list[bytes], list[bytes]]]) -> pa.RecordBatch:
    buckets = np.concatenate([p[0] for p in parts])
    kinds = np.concatenate([np.full(len(p[0]), p[1], dtype=np.int32) for p in parts])
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets.astype(np.int32)), pa.array(kinds), pa.array([x for p in parts for x in p[2]], type=pa.binary()),
         pa.array([x for p in parts for x in p[3]], type=pa.binary())], names=["bucket", "kind", "payload", "extra"])


def _pack(records: np.ndarray) -> bytes:
    """Records byte plane by byte plane, so that the shuffle's compression finds the equal high bytes."""
    return np.ascontiguousarray(records).view(np.uint8).reshape(len(records), records.dtype.itemsize).T.tobytes()


def _unpack(payloads, dtype: np.dtype) -> np.ndarray:
    """The records of several payloads."""
    parts = [np.frombuffer(p, dtype=np.uint8).reshape(dtype.itemsize, -1).T.copy().view(dtype).ravel() for p in payloads]
    return np.concatenate([np.zeros(0, dtype=dtype), *parts])


def _deal(bucket: np.ndarray, records: np.ndarray, kind: int, blobs: list[bytes] | None = None):
    """Records, and their byte strings if any, as one row per bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, records = bucket[order], records[order]
    starts, ends = runs(bucket)
    extra = [b"".join([blobs[k] for k in order[a:b]]) if blobs is not None else b"" for a, b in zip(starts, ends)]
    return bucket[starts], kind, [_pack(records[a:b]) for a, b in zip(starts, ends)], extra


def _by_row(records: np.ndarray, buckets: int, kind: int):
    return _deal((mix(records["row"].view(U64)) % U64(buckets)).astype(np.int64), records, kind)


def _covers(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spans as records, those that touch in one row put together."""
    order = np.lexsort((starts, rows))
    rows, starts, ends = rows[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    if not len(rows):
        return np.zeros(0, dtype=COVERED)
    owner = np.cumsum(np.concatenate([[0], (rows[1:] != rows[:-1]).astype(np.int64)]))
    wide = np.int64(1) << 33
    reach = np.maximum.accumulate(ends + owner * wide) - owner * wide
    fresh = np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] > reach[:-1])])
    at = np.flatnonzero(fresh)
    out = np.zeros(len(at), dtype=COVERED)
    out["row"], out["start"] = rows[at], starts[at]
    out["end"] = reach[np.concatenate([at[1:], [len(rows)]]) - 1]
    return out


def _first_of_equals(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records ordered by run and place; which begin a run, and which repeat it elsewhere."""
    r = r[np.lexsort((r["start"], r["row"], r["h2"], r["h"], r["g"]))]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r["g"][1:] != r["g"][:-1]) | (r["h"][1:] != r["h"][:-1]) | (r["h2"][1:] != r["h2"][:-1])
    first = r[np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))] if len(r) else r
    return r, new, (r["row"] != first["row"]) | (r["start"] != first["start"])


def _repeats(r: np.ndarray) -> np.ndarray:
    return _covers(r["row"], r["start"], r["start"].astype(np.int64) + r["more"] + LENGTH)


def deal_runs(docs: DataFrame, text: str, buckets: int) -> DataFrame:
    """Records of runs by anchor; repeats inside a task go straight to their rows."""

    def flush(parts):
        r, new, repeats = _first_of_equals(np.concatenate(parts))
        kept = r[new]
        return _batch([
            _deal((kept["g"] % U64(buckets)).astype(np.int64), kept, 0), _by_row(_repeats(r[repeats]), buckets, 1)])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for texts in slices(batch.column(1)):
                anchor, first, last, g = anchor_runs(texts)
                owner = np.searchsorted(texts.offsets, first, side="right") - 1
                h = texts.span_hash(first, last + LENGTH)
                r = np.zeros(len(first), dtype=RUN)
                r["g"], r["h"], r["h2"], r["row"] = g, h >> U64(32), h & U64(0xFFFF), rows[texts.first + owner]
                r["start"], r["more"], r["lead"] = first - texts.offsets[owner], last - first, anchor - first
                parts.append(r)
                held += len(r)
                if held >= COMBINE:
                    yield flush(parts)
                    parts, held = [], 0
        if held:
            yield flush(parts)

    return docs.select("row", text).mapInArrow(run, ROWS)


def match_runs(dealt: DataFrame, buckets: int, many_runs: int = MANY_RUNS) -> DataFrame:
    """Repeats of whole runs as covered spans (kind 1), and first runs of anchors with several (kind 2)."""

    def run(batches):
        covered, needed = [], []
        for held in _kinds(batches):
            covered.append(_unpack(held[1], COVERED))
            r, new, repeats = _first_of_equals(_unpack(held[0], RUN))
            covered.append(_repeats(r[repeats]))
            first = r[new]
            starts, ends = runs(first["g"])
            several = np.repeat(ends - starts, ends - starts)
            first, several = first[several > 1], several[several > 1]
            need = np.zeros(len(first), dtype=NEEDED)
            for f in ("row", "g", "start", "more", "lead"):
                need[f] = first[f]
            need["many"] = several > many_runs
            needed.append(need)
            if sum(map(len, covered)) + sum(map(len, needed)) > COMBINE:
                yield _found(covered, buckets, needed)
                covered, needed = [], []
        yield _found(covered, buckets, needed)

    return by_bucket(dealt).mapInArrow(run, ROWS)


def _found(covered: list[np.ndarray], buckets: int, needed: list[np.ndarray] = ()) -> pa.RecordBatch:
    """What a task has found, by the bucket of its row; covered spans put together."""
    c = np.concatenate([np.zeros(0, dtype=COVERED), *covered])
    d = np.concatenate([np.zeros(0, dtype=NEEDED), *needed])
    return _batch([_by_row(_covers(c["row"], c["start"], c["end"]), buckets, 1), _by_row(d, buckets, 2)])


def _kinds(batches):
    """The rows of each bucket in turn, by kind."""
    have, held = None, None
    for batch in batches:
        for bucket, kind, payload, extra in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != have:
                if held:
                    yield held
                have, held = bucket, {0: [], 1: [], 2: [], "extra": []}
            held[kind].append(payload)
            if extra:
                held["extra"].append(extra)
    if held:
        yield held


def per_row(dealt: DataFrame) -> DataFrame:
    """``(row, covered, needed)``: the records of each row."""

    def run(batches):
        for held in _kinds(batches):
            c = _unpack(held[1], COVERED)
            c = _covers(c["row"], c["start"], c["end"])
            d = _unpack(held[2], NEEDED)
            d = d[np.lexsort((d["start"], d["row"]))]
            rows = np.union1d(c["row"], d["row"])
            at = [np.searchsorted(x["row"], rows, side=s) for x in (c, d) for s in ("left", "right")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows)] + [pa.array([x[a:b].tobytes() for a, b in zip(*at[2 * k:2 * k + 2])], type=pa.binary()) for k, x in enumerate((c, d))],
                names=["row", "covered", "needed"])

    return by_bucket(dealt).mapInArrow(run, "row long, covered binary, needed binary")


def fetch_pieces(needed: DataFrame, buckets: int) -> DataFrame:
    """The bytes of needed runs, dealt by anchor; at anchors with many runs, string by string.

    ``needed`` has the columns row, needed and text.
    """

    def flush(pieces, blobs):
        p = np.array(pieces, dtype=PIECE)
        alone = np.flatnonzero(p["size"] == LENGTH)
        order = alone[np.lexsort((p["start"][alone], p["row"][alone], p["tag"][alone]))]
        again = order[1:][p["tag"][order[1:]] == p["tag"][order[:-1]]] if len(order) else order
        again = again[[blobs[k] == blobs[first] for k, first in zip(again, _leaders(p["tag"], order, again))]] if len(again) else again
        keep = np.ones(len(p), dtype=bool)
        keep[again] = False
        gone = p[again]
        kept = np.flatnonzero(keep)
        return _batch([
            _deal((p["tag"][kept] % U64(buckets)).astype(np.int64), p[kept], 0, [blobs[k] for k in kept]),
            _by_row(_covers(gone["row"], gone["start"], gone["start"].astype(np.int64) + LENGTH), buckets, 1)])

    def run(batches):
        pieces, blobs, held = [], [], 0
        for batch in batches:
            for row, records, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = (text or "").encode()
                for _, g, start, more, lead, many in np.frombuffer(records, dtype=NEEDED).tolist():
                    if many:
                        for k in range(start, start + more + 1):
                            blob = data[k:k + LENGTH]
                            tag = int.from_bytes(hashlib.blake2b(blob, digest_size=8).digest(), "little")
                            pieces.append((tag, row, k, LENGTH, 0))
                            blobs.append(blob)
                    else:
                        pieces.append((g, row, start, more + LENGTH, lead))
                        blobs.append(data[start:start + more + LENGTH])
                    held += more + LENGTH
                if held > 8 << 20 or len(pieces) > 200_000:
                    yield flush(pieces, blobs)
                    pieces, blobs, held = [], [], 0
        if pieces:
            yield flush(pieces, blobs)

    return needed.mapInArrow(run, ROWS)


def _leaders(tags: np.ndarray, order: np.ndarray, again: np.ndarray) -> np.ndarray:
    """For each repeated piece, the first piece with its tag."""
    first = order[np.concatenate([[True], tags[order[1:]] != tags[order[:-1]]])]
    return first[np.searchsorted(tags[first], tags[again])]


def _word_at(data: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The ``size`` bytes (8 at most) at each place, as numbers in the order of the bytes."""
    out = np.zeros(len(at), dtype=U64)
    for k in range(int(np.max(size, initial=0))):
        byte = data[at + k].astype(U64)
        out = (out << U64(8)) | np.where(k < size, byte, 0).astype(U64)
    return out


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Ranks of tuples of keys, from 1; equal tuples have equal ranks."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(new) + 1
    return out


def sort_bucket(pieces: np.ndarray, blob: bytes) -> np.ndarray:
    """The strings of a bucket's suffixes that also start earlier, as covered spans."""
    if not len(pieces):
        return np.zeros(0, dtype=COVERED)
    sizes = pieces["size"].astype(np.int64)
    suffixes = sizes - LENGTH + 1
    # Lay the pieces out, each anchor on residue 0, with room so that no comparison runs into the next one.
    room = sizes + 8 + PERIOD
    begin = np.concatenate([[0], np.cumsum(-(-(room + PERIOD) // PERIOD) * PERIOD)])
    base = begin[:-1] + (-pieces["lead"].astype(np.int64)) % PERIOD
    data = np.zeros(int(begin[-1]) + 2 * PERIOD + 8, dtype=np.uint8)
    data[ranges(base, sizes)] = np.frombuffer(blob, dtype=np.uint8)
    # Ranks of the cover's suffixes: first by PERIOD bytes, then by twice as many, until a string is covered.
    limit = int(begin[-1]) + PERIOD
    sample = np.flatnonzero(np.isin(np.arange(limit) % PERIOD, COVER))
    rank = np.zeros(limit + 2 * LENGTH + 2 * PERIOD, dtype=np.int64)
    rank[sample] = _ranks(_word_at(data, sample, 8), _word_at(data, sample + 8, PERIOD - 8))
    known = PERIOD
    while known < LENGTH:
        rank[sample] = _ranks(rank[sample], rank[sample + known])
        known *= 2
    # Suffixes: the bytes before the next cover position, and the rank there.
    owner = np.repeat(np.arange(len(pieces)), suffixes)
    offset = ranges(np.zeros(len(pieces), dtype=np.int64), suffixes)
    at = base[owner] + offset
    gaps = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    gap = gaps[at % PERIOD]
    row, start = pieces["row"][owner], pieces["start"][owner].astype(np.int64) + offset
    order = np.lexsort((start, row, rank[at + gap], _word_at(data, at, gap), at % PERIOD))
    at, row, start = at[order], row[order], start[order]
    same = np.zeros(len(at), dtype=bool)
    for low in range(1, len(at), 1 << 16):
        high = min(len(at), low + (1 << 16))
        equal = np.ones(high - low, dtype=bool)
        for k in range(LENGTH):
            equal &= data[at[low - 1:high - 1] + k] == data[at[low:high] + k]
        same[low:high] = equal
    # Of equal strings the earliest stays.  Longer ties may be split by what follows, so look at the whole group.
    group = np.cumsum(~same) - 1
    order = np.lexsort((start, row, group))
    group, row, start = group[order], row[order], start[order]
    starts, ends = runs(group)
    lead = np.repeat(starts, ends - starts)
    later = (row != row[lead]) | (start != start[lead])
    return _covers(row[later], start[later], start[later] + LENGTH)


def match_pieces(dealt: DataFrame, buckets: int) -> DataFrame:
    """Covered spans by row, from suffixes sorted bucket by bucket."""

    def run(batches):
        covered = []
        for held in _kinds(batches):
            covered += [_unpack(held[1], COVERED), sort_bucket(_unpack(held[0], PIECE), b"".join(held["extra"]))]
            if sum(map(len, covered)) > COMBINE:
                yield _found(covered, buckets)
                covered = []
        yield _found(covered, buckets)

    return by_bucket(dealt).mapInArrow(run, ROWS)


def _kept(data: bytes, least: int, spans: list[bytes | None]) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs, and what is left of a text."""
    c = np.concatenate([np.zeros(0, dtype=COVERED), *(np.frombuffer(s, dtype=COVERED) for s in spans if s)])
    if not len(c):
        return 0, 0, data
    c = _covers(np.zeros(len(c), dtype=np.int64), c["start"], c["end"])
    c = c[c["end"] - c["start"] >= least]
    out, at, gone = [], 0, 0
    for start, end in zip(c["start"].tolist(), c["end"].tolist()):
        out.append(data[at:start])
        gone += end - start
        at = end
    return gone, len(c), b"".join([*out, data[at:]])


def dedup_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", many_runs: int = MANY_RUNS) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)``; ``kept`` has the remaining bytes."""
    buckets = bucket_count(docs.sparkSession)
    rows = numbered(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    found = written(per_row(match_runs(deal_runs(rows, "text", buckets), buckets, many_runs)), "runs")
    placed = rows.repartition("row")
    needed = found.where(F.octet_length("needed") > 0).select("row", "needed").join(placed, "row").select("row", "needed", "text")
    # In order of rows a repeated task combines the same records as the first did.
    needed = needed.sortWithinPartitions("row")
    pieces = match_pieces(fetch_pieces(needed, buckets), buckets)
    more = per_row(pieces).select("row", F.col("covered").alias("more"))
    spans = found.select("row", "covered")
    return cut_out(placed.join(spans, "row", "left").join(more, "row", "left"), "covered", "more")


def cut_out(rows: DataFrame, *spans: str, least: int = 1) -> DataFrame:
    """``rows (doc_id, text, ...)`` without the bytes of the spans, if a run of them has ``least`` bytes."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                out = []
                for text, *covered in zip(*(c.to_pylist() for c in part.columns[1:])):
                    data = (text or "").encode()
                    out.append((len(data), *_kept(data, least, covered)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [pa.array([o[k] for o in out], type=pa.int64()) for k in range(3)]
                    + [pa.array([o[3] for o in out], type=pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return rows.select("doc_id", "text", *spans).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
