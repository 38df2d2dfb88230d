"""What the operators share: written tables, packed rows, and connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import fresh_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, and safe when executors are lost."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` does not have, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while f"_{name}" in taken:
            name = f"_{name}"
        out.append(f"_{name}")
    return out


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` without columns of these names, whatever the case of their letters."""
    gone = {n.lower() for n in names}
    left = [c for c in df.columns if c.lower() not in gone]
    return df if len(left) == len(df.columns) else df.select(*[f"`{c}`" for c in left])


def vocabulary_path() -> str:
    """The default vocabulary file; the operators take any other path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bucket_count(spark: SparkSession) -> int:
    """Buckets for packed rows: two per shuffle partition, dealt evenly by ``by_bucket``."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


PACKED = "bucket int, payload binary"


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if not len(keys):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def packed(buckets: np.ndarray, *fields: np.ndarray) -> pa.RecordBatch:
    """One row per bucket with its records, field after field, behind their number."""
    order = np.argsort(buckets, kind="stable")
    buckets, fields = buckets[order], [np.ascontiguousarray(f[order]) for f in fields]
    starts, ends = runs(buckets)
    rows = [np.int64(b - a).tobytes() + b"".join([f[a:b].tobytes() for f in fields]) for a, b in zip(starts, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets[starts].astype(np.int32)), pa.array(rows, type=pa.binary())], names=["bucket", "payload"])


def unpack(row: bytes, *kinds: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(row, dtype=np.int64, count=1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(row, dtype=kind, count=n, offset=at))
        at += out[-1].nbytes
    return out


def by_bucket(df: DataFrame) -> DataFrame:
    """Bring the rows of a bucket together, buckets in order."""
    return df.repartitionById(bucket_count(df.sparkSession) // 2, "bucket").sortWithinPartitions("bucket")


def bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The payloads of each bucket in turn, from rows dealt by ``by_bucket``."""
    have, held = None, []
    for batch in batches:
        for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != have and held:
                yield held
                held = []
            have = bucket
            held.append(payload)
    if held:
        yield held


def bucket_fields(batches: Iterator[pa.RecordBatch], *kinds: str) -> Iterator[list[np.ndarray]]:
    """The fields of each bucket in turn, from rows made by ``packed``."""
    for held in bucket_rows(batches):
        parts = [unpack(row, *kinds) for row in held]
        yield [np.concatenate(f) for f in zip(*parts)]


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: each node with the least id that its links reach, itself included.

    ``nodes`` has ``id``; ``edges`` has ``a`` and ``b`` (any direction, repeats, loops; nulls are no edge).
    Alternating large-star and small-star steps halve chains, so rounds grow with the logarithm of
    the longest path.  Every step is a grouped minimum, combined before the shuffle, and a join that
    the adaptive planner can split, so a hub with a third of all edges is no single task.
    """
    forward = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    def mark(df):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b"))).first()

    now = written(forward.distinct(), "edges")
    seen = mark(now)
    while seen[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(
            small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "edges")
        now, before, seen = after, seen, mark(after)
        if seen == before:
            break
    return nodes.join(now.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select(
        "id", F.coalesce("component", "id").alias("component"))
