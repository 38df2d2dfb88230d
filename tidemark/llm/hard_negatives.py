"""Hard negatives of labelled vectors, found in lists that the anchors of a cluster share.

Anchors are grouped around spherical k-means centres.  For each group the candidates
are sorted once by an upper bound of their inner product with any member: a candidate at
angle ``a`` from the centre scores at most ``|u| |c| cos(max(0, a - w))`` with a member
``u`` that lies within ``w`` of it.  Every member walks that one list, and stops where the
bound falls below what it still needs, so its result is certified to be exact.

Anchors are cut into blocks of bounded size along (label, cluster), candidates into
stripes; a task holds one block and streams its stripe piece by piece, so memory does not
grow with the table.  A candidate whose bound is too low for every group of a block is
not sent there.  Partial results, at most ``positives * negatives`` rows for an anchor and a stripe,
are merged with windows.  A label or a group of copies may hold any share of the rows: blocks and
stripes are cut by count, not by key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import ranges, runs, written

#: Anchors of a block, and candidates of a stripe at most.
BLOCK = 1 << 16
STRIPE = 1 << 22
#: A stripe has at least so many candidates, unless all are fewer.
LEAST_STRIPE = 1 << 12
#: The centres are fitted on at most so many anchors, and there are at most so many.
SAMPLE = 4096
CLUSTERS = 256
#: Candidates and members that are multiplied at a time.
STEP, MEMBERS = 512, 1024
#: Room for rounding in angles and bounds.
SLACK = 1e-6

_ROW = [("row", "<i8"), ("id", "<i8"), ("null", "?"), ("label", "<i8")]


def _record(kind: str, dim: int, slots: int = 0) -> np.dtype:
    """A candidate; with ``slots`` an anchor with its group and what it looks for."""
    anchor = [("cluster", "<i4"), ("angle", "<f8"), ("low", "<f8", (slots,)), ("high", "<f8", (slots,))] if slots else []
    return np.dtype([*_ROW, *anchor, ("q", kind, (dim,))])


def mine_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: float = 256.0, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95,
    block: int = BLOCK, stripe: int = STRIPE, sample: int = SAMPLE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    A component ``x`` becomes ``floor(scale * x)``; scores are exact integer inner products, higher ones
    first, ties by smaller id, null ids last.  Positives of an anchor are its first ``positives`` other rows
    of the same label.  For each, the first ``negatives`` rows of another label come back whose score is
    between ``low_percent`` and ``high_percent`` of the positive's (both included).

    Rows with a null label or vector, or a null or non-finite component, take no part.  Of vectors of
    different lengths the missing components are 0.  A null id is no anchor (``is_anchor`` is null), but may be
    a candidate.  Repeated rows are rows of their own: an anchor's copy is another row of its label, and a
    repeated anchor is answered once for each copy.  Only the three named columns are read, so others may have any
    name.  An empty table has an empty result.  Scores must fit a long; a table of larger numbers is refused.

    Centres are fitted on the ``sample`` anchors with the least hashes; they only decide the order of work.
    """
    spark = rows.sparkSession
    kept = _taking_part(rows, is_anchor, id_col, vector_col, label_col)
    size = kept.agg(
        F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("dim"),
        F.max(F.array_max(F.transform("v", lambda x: F.abs(x * scale)))).alias("most")).first()
    dim, most = max(size.dim or 0, 1), math.floor(size.most or 0) + 1
    if most * most * dim >= 1 << 63:
        raise ValueError("inner products of these vectors do not fit 64 bits")
    kind = next(k for k, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if most < 1 << bits)
    exact = np.float64 if most * most * dim < 1 << 53 else np.int64

    vectors = written(kept.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _quantise(kind, dim, scale), "row long, id long, label long, anchor boolean, q binary"), "vectors")
    anchors = vectors.where("anchor")
    centres = _centres(anchors.orderBy(F.xxhash64("row"), "row").limit(sample).select("q"), kind, size.anchors)
    n_blocks = max(1, -(-size.anchors // block))
    placed = anchors.mapInArrow(_assign(kind, centres), "row long, id long, label long, q binary, cluster int, angle double, norm double")
    if n_blocks > 1:
        placed = placed.repartitionByRange(n_blocks, "label", "cluster", "row")
    placed = written(placed.withColumn("block", F.spark_partition_id() if n_blocks > 1 else F.lit(0)), "anchors")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stripes = max(-(-size.n // stripe), min(-(-size.n // LEAST_STRIPE), -(-parts // n_blocks)), 1)

    def search(asking: DataFrame, slots: int, most_of: int, same: bool) -> DataFrame:
        """The first ``most_of`` rows per anchor and slot, with the scores between ``low`` and ``high``."""
        groups = _groups(asking, same)
        dealt = asking.mapInArrow(_deal_anchors(kind, dim, slots, stripes), "bucket int, kind int, payload binary").union(
            vectors.select("row", "id", "label", "q").mapInArrow(
                _deal_candidates(kind, dim, stripes, centres, groups), "bucket int, kind int, payload binary"))
        near = dealt.repartitionById(min(n_blocks * stripes, parts), "bucket").sortWithinPartitions("bucket", "kind")
        found = near.mapInArrow(
            _walk(_record(kind, dim, slots), _record(kind, dim), centres, slots, most_of, same, exact),
            "row long, slot int, score long, id long")
        order = Window.partitionBy("row", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_of)

    nothing = F.array(F.lit(-math.inf)), F.array(F.lit(math.inf))
    first = search(placed.select("*", nothing[0].alias("low"), nothing[1].alias("high")), 1, positives, True)
    first = written(first.select("row", (F.col("rank") - 1).alias("slot"), F.col("score").alias("positive_score"),
                                 F.col("id").alias("positive_id")), "positives")
    def share(percent: int, rounded) -> Column:
        return rounded(F.col("positive_score").cast("decimal(38,0)") * percent / F.lit(100).cast("decimal(3,0)")).cast("double")

    # of a negative score the bounds cross: nothing lies between them
    low, high = share(low_percent, F.ceil), share(high_percent, F.floor)
    limits = first.select("row", "slot", F.when(low <= high, low).otherwise(F.lit(math.inf)).alias("low"), high.alias("high"))
    wanted = limits.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("slot", "low", "high"))).alias("p"))
    unused = F.array_repeat(F.lit(math.inf), positives - F.size("p"))
    asking = placed.join(wanted, "row").select(
        *placed.columns, F.concat("p.low", unused).alias("low"), F.concat("p.high", unused).alias("high"))
    second = search(asking, positives, negatives, False)
    return second.withColumnRenamed("id", "negative_id").join(first, ["row", "slot"]).join(
        placed.select("row", F.col("id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


def _taking_part(rows: DataFrame, is_anchor: Column, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    whole = isinstance(rows.schema[label_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf))
    return rows.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("id"), (F.col(label_col).cast("long") if whole else F.xxhash64(label_col)).alias("label"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vector_col).cast("array<double>").alias("v"))


def _quantise(kind: str, dim: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            sizes = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.zeros((len(b), dim), dtype=kind)
            at = ranges(np.arange(len(b), dtype=np.int64) * dim, sizes)
            out.reshape(-1)[at] = np.floor(v.flatten().to_numpy(zero_copy_only=False) * scale)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("row", "id", "label", "anchor")] + [pa.array([r.tobytes() for r in out], pa.binary())],
                names=["row", "id", "label", "anchor", "q"])

    return run


def _matrix(column, kind: str) -> np.ndarray:
    """The vectors of a binary column, one per row."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _centres(drawn: DataFrame, kind: str, n_anchors: int) -> np.ndarray:
    """Unit centres of spherical k-means, about as many as members each."""
    parts = [bytes(r.q) for r in drawn.collect()]
    if not parts:
        return np.zeros((1, 1))
    x = _unit(np.frombuffer(b"".join(parts), dtype=kind).reshape(len(parts), -1))
    k = max(1, min(CLUSTERS, math.isqrt(n_anchors), len(x)))
    centres = x[:k].copy()
    for _ in range(8):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def _angles(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The angle of each vector with each centre; that of a zero vector does not matter."""
    return np.arccos(np.clip(_unit(x) @ centres.T, -1.0, 1.0))


def _assign(kind: str, centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column("q"), kind).astype(np.float64)
            angles = _angles(x, centres)
            near = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("row", "id", "label", "q")]
                + [pa.array(near.astype(np.int32)), pa.array(angles[np.arange(len(b)), near]), pa.array(np.linalg.norm(x, axis=1))],
                names=["row", "id", "label", "q", "cluster", "angle", "norm"])

    return run


def _groups(asking: DataFrame, same: bool) -> list[tuple]:
    """Per block and cluster: width, least score per length that a member needs, and the labels that count.

    One row for each cluster of a block of ``BLOCK`` anchors, whatever the number of candidates.
    """
    need = F.when(F.col("norm") > 0, F.array_min("low") / F.col("norm")).otherwise(F.lit(-math.inf))
    found = asking.groupBy("block", "cluster").agg(
        F.max("angle").alias("width"), F.min(need).alias("low"), F.min("label").alias("first"), F.max("label").alias("last")).collect()
    return [(r.block, r.cluster, r.width, r.low, r.first if same else None, r.last if same else None) for r in found]


def _deal_anchors(kind: str, dim: int, slots: int, stripes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            out = _records(b, _record(kind, dim, slots), kind)
            out["cluster"], out["angle"] = b.column("cluster").to_numpy(), b.column("angle").to_numpy()
            for name in ("low", "high"):
                out[name] = b.column(name).flatten().to_numpy(zero_copy_only=False).reshape(len(b), slots)
            blocks = b.column("block").to_numpy()
            for at in np.unique(blocks):
                yield _parcels([int(at) * stripes + s for s in range(stripes)], 0, [out[blocks == at].tobytes()] * stripes)

    return run


def _records(b: pa.RecordBatch, dtype: np.dtype, kind: str) -> np.ndarray:
    out = np.zeros(len(b), dtype=dtype)
    ids = b.column("id")
    out["row"], out["label"] = b.column("row").to_numpy(), b.column("label").to_numpy()
    out["id"] = ids.fill_null((1 << 63) - 1).to_numpy()
    out["null"] = ids.is_null().to_numpy(zero_copy_only=False)
    out["q"] = _matrix(b.column("q"), kind)
    return out


def _parcels(buckets: list[int], kind: int, payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array([kind] * len(buckets), pa.int32()), pa.array(payloads, pa.binary())],
        names=["bucket", "kind", "payload"])


def _bound(norms: np.ndarray, angles: np.ndarray, width: float) -> np.ndarray:
    """The most a unit vector within ``width`` of the centre can score with each candidate."""
    return norms * (np.cos(np.clip(angles - width - SLACK, 0.0, np.pi)) + 1e-9) + SLACK


def _deal_candidates(kind: str, dim: int, stripes: int, centres: np.ndarray, groups: list[tuple]):
    by_block: dict[int, list[tuple]] = {}
    for block, *rest in groups:
        by_block.setdefault(block, []).append(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b) or not by_block:
                continue
            out = _records(b, _record(kind, dim), kind)
            stripe, labels, q = out["row"] % stripes, out["label"], out["q"].astype(np.float64)
            norms, angles = np.linalg.norm(q, axis=1), _angles(q, centres)
            for block, members in by_block.items():
                wanted = np.zeros(len(out), dtype=bool)
                for cluster, width, low, first, last in members:
                    reach = _bound(norms, angles[:, cluster], width) >= low
                    wanted |= reach if first is None else reach & (labels >= first) & (labels <= last)
                for s in range(stripes):
                    mine = out[wanted & (stripe == s)]
                    if len(mine):
                        yield _parcels([block * stripes + s], 1, [mine.tobytes()])

    return run


class _Best:
    """The first ``k`` hits of each slot so far, and the least score that still counts there."""

    def __init__(self, low: np.ndarray, k: int):
        self.k, self.need = k, low.astype(np.float64).copy()
        self.score = np.zeros((len(low), k), dtype=np.int64)
        self.id, self.null = np.zeros_like(self.score), np.zeros((len(low), k), dtype=bool)
        self.n = np.zeros(len(low), dtype=np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        touched = np.unique(slot)
        held = np.repeat(touched, self.n[touched])
        at = ranges(np.zeros(len(touched), dtype=np.int64), self.n[touched])
        slot, score, ids, null = (np.concatenate(x) for x in (
            (slot, held), (score, self.score[held, at]), (ids, self.id[held, at]), (null, self.null[held, at])))
        order = np.lexsort((ids, null, -score, slot))
        starts, ends = runs(slot[order])
        place = ranges(np.zeros(len(starts), dtype=np.int64), ends - starts)
        order, place = order[place < self.k], place[place < self.k]
        s = slot[order]
        self.score[s, place], self.id[s, place], self.null[s, place] = score[order], ids[order], null[order]
        self.n[touched] = np.minimum(ends - starts, self.k)
        full = touched[self.n[touched] == self.k]
        self.need[full] = np.maximum(self.need[full], self.score[full, self.k - 1])


class _Members:
    """A block of anchors that walks the lists of candidates of its clusters."""

    def __init__(self, anchors: np.ndarray, centres: np.ndarray, slots: int, k: int, same: bool, exact):
        anchors = np.sort(anchors, order=["cluster", "angle"])
        self.anchors, self.centres, self.slots, self.same, self.exact = anchors, centres, slots, same, exact
        self.x = anchors["q"].astype(exact)
        self.norm = np.linalg.norm(self.x.astype(np.float64), axis=1)
        self.best = _Best(anchors["low"].reshape(-1), k)
        self.high = anchors["high"]
        self.clusters = [(anchors["cluster"][a], np.arange(a, b)) for a, b in zip(*runs(anchors["cluster"]))]

    def needed(self, members: np.ndarray) -> np.ndarray:
        return self.best.need.reshape(-1, self.slots)[members].min(axis=1)

    def meet(self, candidates: np.ndarray) -> None:
        x = candidates["q"].astype(self.exact)
        floats = x.astype(np.float64)
        norms = np.linalg.norm(floats, axis=1)
        for cluster, members in self.clusters:
            angles = _angles(floats, self.centres[cluster:cluster + 1])[:, 0]
            bound = _bound(norms, angles, self.anchors["angle"][members[-1]])
            order = np.argsort(-bound, kind="stable")
            for low in range(0, len(order), STEP):
                members = members[self.norm[members] * bound[order[low]] + SLACK >= self.needed(members)]
                if not len(members):
                    break
                listed = order[low:low + STEP]
                for a in range(0, len(members), MEMBERS):
                    self.compare(members[a:a + MEMBERS], candidates[listed], x[listed])

    def compare(self, members: np.ndarray, candidates: np.ndarray, x: np.ndarray) -> None:
        scores = self.x[members] @ x.T
        mine = self.anchors[members]
        equal = mine["label"][:, None] == candidates["label"][None]
        hit = (scores >= self.needed(members)[:, None]) & (scores <= self.high[members].max(axis=1)[:, None])
        hit &= equal if self.same else ~equal
        hit &= mine["row"][:, None] != candidates["row"][None]
        i, j = np.nonzero(hit)
        score = scores[i, j].astype(np.int64)
        need = self.best.need.reshape(-1, self.slots)
        for slot in range(self.slots):
            ok = (score >= need[members[i], slot]) & (score <= self.high[members[i], slot])
            if ok.any():
                at = j[ok]
                self.best.add(members[i[ok]] * self.slots + slot, score[ok], candidates["id"][at], candidates["null"][at])

    def results(self) -> pa.RecordBatch:
        slot = np.repeat(np.arange(len(self.best.n)), self.best.n)
        at = ranges(np.zeros(len(self.best.n), dtype=np.int64), self.best.n)
        return pa.RecordBatch.from_arrays([
            pa.array(self.anchors["row"][slot // self.slots]), pa.array((slot % self.slots).astype(np.int32)),
            pa.array(self.best.score[slot, at]), pa.array(self.best.id[slot, at], mask=self.best.null[slot, at])],
            names=["row", "slot", "score", "id"])


def _walk(anchor: np.dtype, candidate: np.dtype, centres: np.ndarray, slots: int, k: int, same: bool, exact):
    """Walk the lists of each bucket; its anchors come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, asked, members = None, [], None
        for batch in batches:
            for bucket, kind, payload in zip(*(batch.column(c) for c in range(3))):
                bucket, payload = bucket.as_py(), payload.as_py()
                if bucket != have:
                    if members is not None:
                        yield members.results()
                    have, asked, members = bucket, [], None
                if kind.as_py() == 0:
                    asked.append(np.frombuffer(payload, dtype=anchor))
                    continue
                if members is None and asked:
                    members = _Members(np.concatenate(asked), centres, slots, k, same, exact)
                if members is not None:
                    members.meet(np.frombuffer(payload, dtype=candidate))
        if members is not None:
            yield members.results()

    return run
