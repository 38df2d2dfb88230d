"""How the word use of sources diverges, by Gustavson's row accumulation over a term-major index.

Terms are counted per task and sent, packed, to the bucket of their hash, where the index of a
language lists for each kept term the sources that use it.  Each source is a sparse row of terms: going through the
lists of its terms it scatters what each shared term adds into a dense array with one place per peer, so no
pair of postings is ever a row.  A term that a source does not use still has a probability there.  Its baseline
is a function of the other side's count alone, so it is summed over histograms of counts and
corrected where both sides use the term.

Memory of a task: a bucket of the index (buckets are made for the bytes of the input), and one entry per
source of a language, as the result has a row for each pair of them.  A source may hold any share of the
documents: its texts are counted wherever they lie, and its terms are spread over all buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import PACKED, bucket_rows, ranges, runs, written
from tidemark.llm.textbytes import LOWER, owners, slices

#: Parts of the whole that probabilities are counted in.
UNIT = 1_000_000_000
#: Text bytes for each bucket, counted (source, term) pairs that a task holds, and entries it accumulates before it hands them on.
BUCKET_BYTES = 16 << 20
MOST_PAIRS = 1 << 20
MOST_HELD = 1 << 22
#: Bytes of a slice of texts.
SLICE = 1 << 22

#: Bytes of [^\x00-\x40\x5B-\x60\x7B-\x7F].
TERM_BYTE = np.zeros(256, dtype=bool)
TERM_BYTE[65:91] = TERM_BYTE[97:123] = TERM_BYTE[128:] = True

ROWS = "lang string, source string, part string, item string, value long"


def audit_sources(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_docs: int = 3, most_terms: int = 200,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for each pair of language and source that occurs.

    Terms are runs of letters A-Z, a-z and everything beyond ASCII, A-Z lower-cased.  A language keeps the
    ``V`` terms that at least ``least_docs`` of its documents have.  A source (or a whole language) with ``N``
    occurrences of kept terms gives each kept term that occurs ``count >= 0`` times ``p = 1 + UNIT * (count + 1) // (N + V)``;
    the divergence of ``p`` from ``q`` is ``(p - q) ** 2 // q``, summed over terms.

    Part ``pair``: against each other source of the language, over all its kept terms.  Part ``term``: each
    term the source uses more than the language does, the ``most_terms`` highest.  Values fit a long for up to
    5 * 10^8 kept terms of a language.

    Null texts, languages and sources are empty strings.  Sources without terms are compared like any other.  Only the
    three named columns are read, so others may have any name; repeated rows count as often as they occur.  An
    empty table has an empty result.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
                          for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    spark = docs.sparkSession
    groups = written(texts.groupBy("lang", "source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")), "groups")
    n_bytes = groups.agg(F.sum("bytes")).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * parts, -(-n_bytes // BUCKET_BYTES))

    counted = texts.mapInArrow(_count(buckets), PACKED)
    near = counted.repartitionById(max(parts, buckets // 8), "bucket").sortWithinPartitions("bucket")
    index = written(near.mapInArrow(
        _index(least_docs), "lang string, terms long, postings binary, histogram binary"), "index")

    counts = index.select("lang", "histogram").mapInArrow(_histograms, "lang string, source string, n long, terms long")
    counts = written(counts.groupBy("lang", "source", "n").agg(F.sum("terms").alias("terms")), "histogram")
    histograms = counts.groupBy("lang", "source").agg(
        F.sum(F.col("n") * F.col("terms")).alias("total"), F.sort_array(F.collect_list(F.struct("n", "terms"))).alias("counts"))
    known = written(groups.join(histograms, ["lang", "source"], "left").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"),
        F.coalesce("counts", F.array().cast("array<struct<n:bigint,terms:bigint>>")).alias("counts")), "groups")
    kept = index.groupBy("lang").agg(F.sum("terms").alias("kept"))
    langs = written(known.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources")).join(kept, "lang", "left").select(
        "lang", F.coalesce("kept", F.lit(0)).alias("kept"), "sources"), "langs")

    rows = index.select("lang", "postings").join(langs, "lang").mapInArrow(_scatter(most_terms), ROWS).union(
        known.join(langs, "lang").mapInArrow(_baselines, ROWS))
    rows = written(rows, "divergence")
    pairs = rows.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(
        F.sum(F.col("value").cast("decimal(20,0)")).cast("long").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most_terms)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms)


def probability(count: np.ndarray, total) -> np.ndarray:
    """``1 + UNIT * (count + 1) // total`` for counts below ``total``, by long division, so nothing overflows."""
    whole, rest = np.divmod(np.asarray(count, dtype=np.int64) + 1, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Arrow strings that lie one behind the other in ``data``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each string, and the distinct strings."""
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct keys in order, and the sums of their values."""
    order = np.argsort(key, kind="stable")
    starts, _ = runs(key[order])
    if not len(starts):
        return key, *values
    return key[order][starts], *(np.add.reduceat(v[order], starts) for v in values)


class _Counts:
    """Occurrences and documents per (group, term) of the texts that a task has read."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.groups: dict[tuple[str, str], int] = {}
        self.clear()

    def clear(self) -> None:
        self.terms: list[pa.Array] = []
        self.held: list[tuple[np.ndarray, ...]] = []
        self.n = self.n_terms = 0

    def add(self, texts, group: np.ndarray) -> None:
        starts, ends, per_text = texts.spans(TERM_BYTE)
        if not len(starts):
            return
        code, terms = _codes(_strings(LOWER[texts.data[TERM_BYTE[texts.data]]], ends - starts))
        pair, n = np.unique(owners(per_text) * len(terms) + code, return_counts=True)
        key, n, docs = _sums(group[pair // len(terms)] * len(terms) + pair % len(terms), n, np.ones(len(pair), dtype=np.int64))
        self.held.append((key // len(terms), key % len(terms) + self.n_terms, n, docs))
        self.terms.append(terms)
        self.n += len(key)
        self.n_terms += len(terms)

    def parcels(self) -> Iterator[pa.RecordBatch]:
        """What is held, summed up, one row per bucket."""
        if not self.held:
            return
        group, code, n, docs = (np.concatenate(x) for x in zip(*self.held))
        recoded, terms = _codes(pa.concat_arrays(self.terms))
        size = len(terms)
        key, n, docs = _sums(group * size + recoded[code], n, docs)
        group, code = key // size, key % size
        bucket = np.concatenate([t.span_hash(t.offsets[:-1], t.offsets[1:]) for t in slices(terms, SLICE)]) % np.uint64(self.buckets)
        bucket = bucket.astype(np.int64)[code]
        order = np.lexsort((group, code, bucket))
        names = list(self.groups)
        langs, sources = (pa.array([g[k] for g in names], pa.large_string()) for k in (0, 1))
        out = []
        for a, b in zip(*runs(bucket[order])):
            at = order[a:b]
            out.append((int(bucket[at[0]]), _pack(
                lang=_coded(langs, group[at]), source=_coded(sources, group[at]), term=_coded(terms, code[at]),
                n=pa.array(n[at]), docs=pa.array(docs[at]))))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["bucket", "payload"])
        self.clear()


def _coded(values: pa.Array, at: np.ndarray) -> pa.Array:
    """``values`` at the given places, with only the needed ones in the dictionary."""
    used, place = np.unique(at, return_inverse=True)
    return pa.DictionaryArray.from_arrays(pa.array(place.astype(np.int32)), values.take(pa.array(used)))


def _pack(**columns: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_next_batch()


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(buckets)
        for batch in batches:
            names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist())
            group = np.array([counts.groups.setdefault(g, len(counts.groups)) for g in names], dtype=np.int64)
            for texts in slices(batch.column("text"), SLICE):
                counts.add(texts, group[texts.first:texts.first + texts.n])
                if counts.n > MOST_PAIRS:
                    yield from counts.parcels()
        yield from counts.parcels()

    return run


def _plain(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(name).dictionary_decode()


def _index(least_docs: int):
    """Per bucket and language: kept terms in order with the sources that use them, and how many terms have which count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in bucket_rows(batches):
            parts = [_unpack(p) for p in held]
            (lang, langs), (source, sources), (term, terms) = (
                _codes(pa.concat_arrays([_plain(p, name) for p in parts])) for name in ("lang", "source", "term"))
            n, docs = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("n", "docs"))
            key, n, docs = _sums((lang * len(terms) + term) * len(sources) + source, n, docs)
            word, source = key // len(sources), key % len(sources)
            starts, ends = runs(word)
            keep = np.repeat(np.add.reduceat(docs, starts) >= least_docs, ends - starts)
            word, source, n = word[keep], source[keep], n[keep]
            rows = []
            for a, b in zip(*runs(word // len(terms))):
                some = slice(a, b)
                pair, count = np.unique(np.stack([source[some], n[some]]), axis=1, return_counts=True)
                rows.append((
                    langs[int(word[a]) // len(terms)].as_py(), len(np.unique(word[some])),
                    _pack(term=_coded(terms, word[some] % len(terms)), source=_coded(sources, source[some]), n=pa.array(n[some])),
                    _pack(source=_coded(sources, pair[0]), n=pa.array(pair[1]), terms=pa.array(count))))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["lang", "terms", "postings", "histogram"])

    return run


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = _unpack(payload)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(h), pa.string()), _plain(h, "source").cast(pa.string()), h.column("n"), h.column("terms")],
                names=["lang", "source", "n", "terms"])


def _rows(lang: str, source, part: str, item, value: np.ndarray) -> pa.RecordBatch:
    n = len(value)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * n, pa.string()), pa.array(source, pa.string()), pa.array([part] * n, pa.string()),
         pa.array(item, pa.string()), pa.array(value, pa.int64())], names=["lang", "source", "part", "item", "value"])


class _Language:
    """The sources of a language, what tasks have accumulated for their pairs, and their leading terms."""

    def __init__(self, lang: str, kept: int, sources: list[dict], most_terms: int):
        self.lang, self.most_terms = lang, most_terms
        self.names = [s["source"] for s in sources]
        self.number = {s: i for i, s in enumerate(self.names)}
        self.size = np.array([s["total"] for s in sources], dtype=np.int64) + kept
        self.whole = int(self.size.sum() - (len(sources) - 1) * kept)
        self.empty = probability(np.zeros(len(sources), dtype=np.int64), self.size) if kept else np.ones(len(sources), dtype=np.int64)
        self.clear()

    def clear(self) -> None:
        self.peers: dict[int, np.ndarray] = {}
        self.leading: tuple = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object))

    def held(self) -> int:
        return len(self.peers) * len(self.names) + len(self.leading[0])

    def meet(self, postings: pa.RecordBatch) -> None:
        """One block of the index, its terms one behind the other."""
        coded = postings.column("source")
        source = np.array([self.number[s] for s in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]
        term, n = postings.column("term").indices.to_numpy(), postings.column("n").to_numpy()
        starts, ends = runs(term)
        sizes = ends - starts
        of = owners(sizes)
        p = probability(n, self.size[source])
        q = probability(np.add.reduceat(n, starts), self.whole)[of]
        more = np.flatnonzero(p > q)
        self.lead(source[more], divergence(p[more], q[more]), term[more], postings.column("term").dictionary)
        for mine in np.split(np.argsort(source, kind="stable"), np.cumsum(np.bincount(source, minlength=len(self.names)))[:-1]):
            if len(mine):
                self.scatter(int(source[mine[0]]), p[mine], starts[of[mine]], sizes[of[mine]], source, p)

    def scatter(self, own: int, p_own: np.ndarray, starts: np.ndarray, sizes: np.ndarray, source: np.ndarray, p: np.ndarray) -> None:
        """Go through the lists of the source's terms, and add up per peer what they change against the baselines."""
        row = self.peers.setdefault(own, np.zeros(len(self.names), dtype=np.int64))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // MOST_PAIRS)) + 1
        for mine, a, k in zip(np.split(p_own, cuts), np.split(starts, cuts), np.split(sizes, cuts)):
            at = ranges(a, k)
            peer, theirs, ours = source[at], p[at], np.repeat(mine, k)
            without = divergence(ours, self.empty[peer]) + divergence(self.empty[own], theirs)
            np.add.at(row, peer, divergence(ours, theirs) - without + divergence(self.empty[own], self.empty[peer]))

    def lead(self, source: np.ndarray, value: np.ndarray, term: np.ndarray, terms: pa.Array) -> None:
        """Keep the leading terms per source; equal values go by the term's bytes."""
        order = np.lexsort((-value, source))
        source, value, term = source[order], value[order], term[order]
        begins, ends = runs(source)
        last = np.minimum(begins + self.most_terms, ends) - 1  # whoever has no less than the last one that counts
        keep = value >= np.repeat(value[last], ends - begins)
        names = np.array([t.encode() for t in terms.take(pa.array(term[keep])).to_pylist()], dtype=object)
        source, value, names = (np.concatenate(x) for x in zip(self.leading, (source[keep], value[keep], names)))
        place = np.zeros(len(names), dtype=np.int64)
        place[np.argsort(names, kind="stable")] = np.arange(len(names))
        order = np.lexsort((place, -value, source))
        begins, ends = runs(source[order])
        rank = ranges(np.zeros(len(begins), dtype=np.int64), ends - begins)
        order = order[rank < self.most_terms]
        self.leading = source[order], value[order], names[order]

    def results(self) -> Iterator[pa.RecordBatch]:
        for own, row in self.peers.items():
            others = [k for k in range(len(self.names)) if k != own]
            yield _rows(self.lang, [self.names[own]] * len(others), "pair", [self.names[k] for k in others], row[others])
        source, value, names = self.leading
        if len(source):
            yield _rows(self.lang, [self.names[k] for k in source], "term", [t.decode() for t in names], value)
        self.clear()


def _scatter(most_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages: dict[str, _Language] = {}
        for batch in batches:
            for k in range(len(batch)):
                lang, postings, kept, sources = (batch.column(c)[k] for c in range(4))
                name = lang.as_py()
                if name not in languages:
                    languages[name] = _Language(name, kept.as_py(), sources.as_py(), most_terms)
                languages[name].meet(_unpack(postings.as_py()))
                if sum(x.held() for x in languages.values()) > MOST_HELD:
                    for x in languages.values():
                        yield from x.results()
        for x in languages.values():
            yield from x.results()

    return run


def _baselines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each pair would have if no term were shared: every term of one side against an empty count of the other."""
    language = None
    for batch in batches:
        for name, own, total, counts, kept, sources in zip(*(batch.column(c).to_pylist() for c in range(6))):
            if language is None or language.lang != name:
                language = _Language(name, kept, sources, 0)
            me = language.number[own]
            mine, others = language.empty[me], language.empty
            here = divergence(np.full_like(others, mine), others) * kept
            there = np.zeros_like(here)
            for a in range(0, len(counts), 1024):
                some = counts[a:a + 1024]
                terms = np.array([c["terms"] for c in some])[:, None]
                p = probability(np.array([c["n"] for c in some]), total + kept)[:, None]
                here += (terms * (divergence(p, others[None]) - divergence(np.full_like(others, mine), others)[None])).sum(axis=0)
                there += (terms * (divergence(others[None], p) - divergence(others, np.full_like(others, mine))[None])).sum(axis=0)
            peers = [k for k in range(len(others)) if k != me]
            names = [language.names[k] for k in peers]
            yield _rows(name, [own] * len(peers), "pair", names, here[peers])
            yield _rows(name, names, "pair", [own] * len(peers), there[peers])
