"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity, one occurrence per connected group.

A line is what stands between newlines.  Its normal form is its words: runs of letters, digits and
non-ASCII characters, A-Z lower-cased and every digit read as 0.  Lines without words are never removed.
Two lines are linked if their normal forms are equal, or if they agree in a block, the 64-bit SimHashes of their
words differ in at most ``DISTANCE`` bits, and their normal forms have an edit similarity (1 - distance / longer
length) of ``SIMILARITY`` or more.  Of all lines connected by links the first occurrence stays, by document id, text
hash and place.

Blocks follow the pigeonhole rule on words: a line is cut into up to ``MOST_BLOCKS`` runs of words, so one with fewer
changed words than runs has a run that is untouched; its last words are a block too, which words put in or left out
further ahead do not shift, and short lines have one more at either end for the next longer cut.  SimHashes alone cannot do this: an edit similarity of 0.8 lets a fifth of the words change,
which is some 13 of 64 bits, and no block of bits that is long enough to tell lines apart survives that.  They
sort out pairs that share a block by chance before any text is fetched.

Lines that share a block meet in a bucket, which names the groups with near SimHashes; equal groups of other blocks
fall together.  Their texts are brought to each group once, where they are verified and connected at the same time: pairs
that are connected already are passed over, and only edges that connect something leave the task.  A
group of more than ``GRID`` lines is cut into a grid of pairs of parts.

Null and empty texts have no lines to remove.  Rows equal in id and text count as one document.  Columns
other than the text are kept, whatever their names; ``n_lines`` and ``n_removed`` of the input are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import PACKED, bucket_count, bucket_fields, components, packed, ranges, runs, unused, written
from tidemark.llm.textbytes import LOWER, U64, WORD_BYTE, Texts, mix, owners, slices

DISTANCE, SIMILARITY = 18, 0.8
#: Characters of a line that are looked for as a whole in another one.
ANCHOR = 10
MOST_BLOCKS, FEW_WORDS = 8, 24
#: Lines of a group that are compared in one task; half as many are a part of a grid.
GRID = 4096
#: Blocks of lines in a bucket, about.
BUCKET_BLOCKS = 1 << 20
#: Edges of small groups that leave a task at once, about.
EDGES = 1 << 14
#: Characters of lines that are compared with one line at once; fewer lines than ``FEW_LINES`` are compared one by one.
SIDE_BY_SIDE, FEW_LINES = 1 << 18, 4
#: Partners of a line that are judged before it is asked again which ones are left.
STRIDE = 512
#: From this length on, trying few edits costs less than the whole table.
LONG = 20_000
#: Slots of the filter that tells which lines may be wanted.
SLOTS = 1 << 22
#: Bits of a bitmap that Spark makes.
BITMAP = 1 << 15
NOT_NEWLINE = np.ones(256, dtype=bool)
NOT_NEWLINE[10] = False
PLAIN = LOWER.copy()
PLAIN[48:58] = 48
#: The bits of a byte as eight counters of a byte each.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(U64).ravel()
_POWER = U64(0x9E3779B97F4A7C15)
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def simhashes(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each run of word codes, the bits that more than half of the words have."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    sizes = np.diff(np.concatenate([starts, [len(codes)]]))
    pieces = -(-sizes // 255)  # a counter of a byte holds 255 words
    at = np.repeat(starts, pieces) + 255 * ranges(np.zeros(len(starts), dtype=np.int64), pieces)
    of = np.cumsum(pieces) - pieces
    columns = mix(codes).view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.add.reduceat(
        np.add.reduceat(LANES[columns[:, k]], at).view(np.uint8).reshape(-1, 8), of, axis=0, dtype=np.int32) for k in range(8)], axis=1)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(U64).ravel()


def word_blocks(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of each line of words, one line behind the other, and how many each has."""
    n = last - first
    parts = np.clip(np.minimum(n // 2, np.maximum(3, n // 4)), 1, MOST_BLOCKS)
    line, k = owners(parts), ranges(np.zeros(len(n), dtype=np.int64), parts)
    low, high = first[line] + k * n[line] // parts[line], first[line] + (k + 1) * n[line] // parts[line]
    short = n // parts
    split = np.flatnonzero(parts > 1)
    few = split[n[split] < FEW_WORDS]  # words put in or left out may change how a short line is cut
    ends = np.cumsum(parts)
    more = np.concatenate([split, few, few])
    low = np.insert(low, ends[more], np.concatenate([last[split] - short[split], last[few] - short[few] - 1, first[few]]))
    high = np.insert(high, ends[more], np.concatenate([last[split], last[few], first[few] + short[few] + 1]))
    parts = parts + np.bincount(more, minlength=len(n))
    sizes = high - low
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), _POWER), dtype=U64)
    within = ranges(np.zeros(len(low), dtype=np.int64), sizes)
    hashes = np.add.reduceat(mix(codes[ranges(low, sizes)]) * powers[within], np.cumsum(sizes) - sizes) if len(low) else np.zeros(0, dtype=U64)
    return mix(hashes + sizes.astype(U64)), parts


class _Lines:
    """The lines with words of a slice: keys, places of their words, and the bytes in plain form."""

    def __init__(self, texts: Texts):
        self.starts, ends, self.counts = texts.spans(NOT_NEWLINE)
        self.lengths = ends - self.starts
        self.plain = Texts(PLAIN[texts.data], texts.offsets, texts.first)
        self.w_starts, self.w_ends, _ = self.plain.spans(WORD_BYTE)
        self.codes = self.plain.span_hash(self.w_starts, self.w_ends)
        of_line = np.searchsorted(self.starts, self.w_starts, side="right") - 1
        self.first, self.last = runs(of_line)
        self.line = of_line[self.first]
        most = int((self.last - self.first).max(initial=0)) + 1
        powers = np.cumprod(np.full(most, _POWER), dtype=U64)
        in_line = np.arange(len(self.codes)) - np.repeat(self.first, self.last - self.first)
        self.keys = np.zeros(0, dtype=U64)
        if len(self.first):
            self.keys = mix(np.add.reduceat(self.codes * powers[in_line], self.first))

    def raw(self) -> np.ndarray:
        """A hash of the bytes of each line with words, A-Z lower-cased and digits read as 0."""
        ends = self.starts + self.lengths
        return self.plain.span_hash(self.starts[self.line], ends[self.line])

    def normal(self, k: int) -> str:
        words = slice(self.first[k], self.last[k])
        return b" ".join([self.plain.data[a:b].tobytes() for a, b in zip(self.w_starts[words], self.w_ends[words])]).decode()


def line_table(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, h, place, line, sim, raw, blocks)`` of every line with words; ``h`` is the hash of the whole text."""

    def run(batches):
        for batch in batches:
            for texts in slices(batch.column(2)):
                lines = _Lines(texts)
                owner = owners(lines.counts)[lines.line]
                breaks = np.concatenate([[0], np.cumsum(texts.data == 10)])
                place = breaks[lines.starts[lines.line]] - breaks[texts.offsets[owner]]
                rows = texts.first + owner
                blocks, sizes = word_blocks(lines.codes, lines.first, lines.last)
                listed = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(blocks.view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)),
                     pa.array(place.astype(np.int32)), pa.array(lines.keys.view(np.int64)),
                     pa.array(simhashes(lines.codes, lines.first).view(np.int64)), pa.array(lines.raw().view(np.int64)), listed],
                    names=["doc_id", "h", "place", "line", "sim", "raw", "blocks"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text).mapInArrow(
        run, "doc_id long, h long, place int, line long, sim long, raw long, blocks array<long>")


def near_groups(lines: DataFrame) -> DataFrame:
    """``(grp, line, sim)``: lines that share a block and have another one of small SimHash distance there."""
    spark = lines.sparkSession
    n_blocks = lines.agg(F.sum(F.size("blocks"))).first()[0] or 0
    buckets = max(bucket_count(spark), -(-n_blocks // BUCKET_BLOCKS))

    def deal(batches):
        for batch in batches:
            line, sim, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            of = owners(blocks.value_lengths().to_numpy().astype(np.int64))
            key = blocks.flatten().to_numpy().view(U64)
            order = np.lexsort((line[of], key))
            order = order[np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(line[of][order]) != 0)])] if len(order) else order
            key, of = key[order], of[order]
            yield packed((key % U64(buckets)).astype(np.int64), (key >> U64(32)).astype(np.uint32), line[of].view(U64), sim[of].view(U64))

    def meet(batches):
        for key, line, sim in bucket_fields(batches, "<u4", "<u8", "<u8"):
            order = np.lexsort((line, key))
            key, line, sim = key[order], line[order], sim[order]
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (line[1:] != line[:-1])])
            key, line, sim = key[new], line[new], sim[new]
            starts, ends = runs(key)
            out = []
            pairs = starts[ends - starts == 2]
            pairs = pairs[np.bitwise_count(sim[pairs] ^ sim[pairs + 1]) <= DISTANCE]
            both = np.stack([pairs, pairs + 1], axis=1).ravel()
            out.append((np.repeat(_group(mix(line[pairs]) + mix(line[pairs + 1])), 2), line[both], sim[both]))
            for a, b in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
                if b - a <= GRID:
                    near = np.concatenate([
                        (np.bitwise_count(sim[k:min(k + 256, b), None] ^ sim[None, a:b]) <= DISTANCE).sum(axis=1) for k in range(a, b, 256)]) > 1
                    some = np.flatnonzero(near) + a
                    out.append((np.repeat(_group(mix(line[some]).sum(keepdims=True)), len(some)), line[some], sim[some]))
                    continue
                parts = -(-2 * int(b - a) // GRID)
                part = mix(line[a:b]) % U64(parts)
                for i in range(parts):
                    for j in range(i, parts):
                        some = np.flatnonzero((part == i) | (part == j)) + a
                        name = _group(np.array([int(key[a]) << 32 ^ i * parts + j], dtype=U64))
                        out.append((np.repeat(name, len(some)), line[some], sim[some]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*out)], names=["grp", "line", "sim"])

    dealt = lines.select("line", "sim", "blocks").mapInArrow(deal, PACKED)
    near = dealt.repartitionById(max(bucket_count(spark), buckets) // 2, "bucket").sortWithinPartitions("bucket")
    return near.mapInArrow(meet, "grp long, line long, sim long").distinct()


def _group(sums: np.ndarray) -> np.ndarray:
    return mix(sums ^ U64(0x5851F42D4C957F2D))


class _Parts:
    """Which lines of a group are connected, as an array to look at all partners of a line at once, and as a list for single ones."""

    def __init__(self, n: int):
        self.part, self.label = np.arange(n), list(range(n))

    def join(self, a: int, b: int) -> None:
        to = self.label[a]
        moved = np.flatnonzero(self.part == self.label[b])
        self.part[moved] = to
        for k in moved.tolist():
            self.label[k] = to


def slot_bits(wanted: DataFrame) -> np.ndarray:
    """``SLOTS`` bits, eight a byte and the low one first: those at ``raw`` modulo ``SLOTS`` are set.

    Tasks and the shuffle put the bits together, so the driver gets ``SLOTS // BITMAP`` rows at most, whatever is wanted.
    """
    slot = F.pmod("raw", F.lit(SLOTS)) + 1  # Spark counts from 1
    rows = wanted.groupBy(F.bitmap_bucket_number(slot)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot))).collect()
    bits = np.zeros((SLOTS // BITMAP, BITMAP // 8), dtype=np.uint8)
    for bucket, some in rows:
        bits[bucket - 1] = np.frombuffer(some, dtype=np.uint8)
    return bits.ravel()


def line_texts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """``(line, normal)``: the normal forms of the ``wanted (line, raw)`` lines.

    A bitmap of ``SLOTS`` bits, whatever the size of the input, spares most other lines; the join decides.
    Lines are told apart by a hash of their bytes, so only those that may be wanted are cut into words again.
    """
    sent = docs.sparkSession.sparkContext.broadcast(slot_bits(wanted))

    def run(batches):
        marked = np.unpackbits(sent.value, bitorder="little").view(bool)
        for batch in batches:
            for texts in slices(batch.column(0)):
                plain = Texts(PLAIN[texts.data], texts.offsets, texts.first)
                starts, ends, _ = texts.spans(NOT_NEWLINE)
                key, where = np.unique(plain.span_hash(starts, ends), return_index=True)
                maybe = marked[key.view(np.int64) % SLOTS]
                key, where = key[maybe], where[maybe]
                forms = [b" ".join(WORDS.findall(plain.data[a:b].tobytes())).decode() for a, b in zip(starts[where], ends[where])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(forms, type=pa.string())], names=["raw", "normal"])

    found = docs.select(text).mapInArrow(run, "raw long, normal string")
    return found.join(wanted, "raw").select("line", "normal").dropDuplicates(["line"])


def edit_distance(a: str, b: str, enough: float = 0, until: float = float("inf")) -> int:
    """Levenshtein distance: equal ends are cut off, then all of a column is computed at once in the bits of an integer.

    If what is between the ends is no longer than ``enough``, its length is returned, which bounds the distance.
    Once the distance must be over ``until``, a bound from below that is over it is returned.
    """
    low, most = 0, min(len(a), len(b))
    while low < most and a[low] == b[low]:
        low += 1
    high = 0
    while high < most - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low:len(a) - high], b[low:len(b) - high]
    if not a or not b or max(len(a), len(b)) <= enough:
        return max(len(a), len(b))
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    everywhere, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, distance = everywhere, 0, len(a)  # where the column rises and falls from row to row
    left = len(b)
    for c in b:
        same = places.get(c, 0)
        flat = ((((same & up) + up) ^ up) | same | down) & everywhere
        right_up, right_down = down | (everywhere ^ (flat | up)), up & flat
        left -= 1
        if right_up & last:
            distance += 1
            if distance - left > until:  # a column changes it by one at most
                return distance - left
        elif right_down & last:
            distance -= 1
        elif distance - left > until:
            return distance - left
        right_up = (right_up << 1 | 1) & everywhere
        up, down = (right_down << 1 | (everywhere ^ (flat | right_up))) & everywhere, right_up & flat
    return distance


def edit_distances(text: str, others: list[str], until: list[int] | None = None) -> list[int]:
    """The Levenshtein distance of ``text`` to each of ``others``; over its ``until``, maybe a bound from below that is over it.

    The columns of all others lie side by side in one integer, with a free bit behind each.  Now and then those
    whose distance must be too large are left out: a way to the end has to cross the column somewhere.
    """
    found, n = [0] * len(others), len(text)
    ids, sizes = np.arange(len(others)), np.array([len(o) for o in others], dtype=np.int64)
    codes = np.frombuffer("\0".join([*others, ""]).encode("utf-32-le"), dtype=np.uint32).copy()
    codes[np.cumsum(sizes + 1) - 1] = 0xFFFFFFFF
    most = None if until is None else np.array(until)
    alphabet = {c: ord(c) for c in set(text)}

    def layout():
        starts = np.cumsum(sizes + 1) - sizes - 1
        low = np.zeros(len(codes), dtype=bool)
        low[starts] = True
        rest = np.repeat(sizes, sizes + 1) - 1 - ranges(np.zeros(len(sizes), dtype=np.int64), sizes + 1)  # rows below each bit's
        return starts, rest, _number(codes != 0xFFFFFFFF), _number(low), {c: _number(codes == k) for c, k in alphabet.items()}

    starts, rest, everywhere, lows, places = layout()
    up, down = everywhere, 0
    step = max(32, n // 16)
    for j, c in enumerate(text, 1):
        same = places[c]
        flat = ((((same & up) + up) ^ up) | same | down) & everywhere
        right_up, right_down = down | (everywhere ^ (flat | up)), up & flat
        right_up = (right_up << 1 | lows) & everywhere
        up, down = (right_down << 1 | (everywhere ^ (flat | right_up))) & everywhere, right_up & flat
        if most is None or j % step or j == n:
            continue
        ups, downs = _bits(up, len(codes)), _bits(down, len(codes))
        heights = np.cumsum(ups.view(np.int8) - downs.view(np.int8), dtype=np.int64)
        before = np.concatenate([[0], heights[starts[1:] - 1]])
        least = np.minimum.reduceat(heights + np.abs(rest - (n - j)), starts) - before
        least = np.minimum(least, np.abs(sizes - (n - j))) + j
        alive = least <= most
        if 2 * alive.sum() > len(alive):
            continue
        for k, bound in zip(ids[~alive].tolist(), least[~alive].tolist()):
            found[k] = bound
        if not alive.any():
            return found
        stay = np.repeat(alive, sizes + 1)
        ids, sizes, most, codes = ids[alive], sizes[alive], most[alive], codes[stay]
        starts, rest, everywhere, lows, places = layout()
        up, down = _number(ups[stay]), _number(downs[stay])
    rises = _bits(up, len(codes)).view(np.int8) - _bits(down, len(codes)).view(np.int8)
    for k, distance in zip(ids.tolist(), (n + np.add.reduceat(rises, starts, dtype=np.int64)).tolist()):
        found[k] = distance
    return found


def _number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _bits(number: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(number.to_bytes(-(-n // 8), "little"), dtype=np.uint8), bitorder="little", count=n)


def _similar(a: str, b: str) -> bool:
    """Whether the edit similarity is high enough."""
    return _judged(a, b)[0]


def _allowed(longer: int) -> int:
    """The largest distance of linked lines."""
    return int((1 - SIMILARITY) * longer + 1e-9)


def _judged(a: str, b: str) -> tuple[bool, int]:
    """Whether two lines are linked, and a bound of their distance: from above if they are, from below if not.

    Bounds and few edits are tried before the whole table, which ends once lines must be unlike.
    """
    longer = max(len(a), len(b))
    allowed = _allowed(longer)
    if abs(len(a) - len(b)) > allowed:
        return False, abs(len(a) - len(b))
    rough, gaps = anchored(a, b, allowed, 4 * allowed)
    if rough <= 4 * allowed and rough > allowed:
        rough = sum(edit_distance(x, y) for x, y in gaps)
    if rough <= allowed:
        return True, rough
    if longer >= 2000:
        least = max((Counter(a) - Counter(b)).total(), (Counter(b) - Counter(a)).total())
        if least > allowed:
            return False, least
    if longer >= LONG:
        few = few_edits(a, b, min(allowed, 2 * int(longer ** 0.5)))
        if few is not None:
            return True, few
    distance = edit_distance(a, b, allowed, allowed)
    return distance <= allowed, distance


def _judged_many(text: str, others: list[str]) -> list[tuple[bool, int]]:
    """``_judged`` of one line and each of the ``others``, none of them shorter; those that bounds do not settle go side by side."""
    out: list = [None] * len(others)
    blocks, size = [[]], 0
    for k, other in enumerate(others):
        allowed = _allowed(len(other))
        if len(other) >= LONG or len(others) < FEW_LINES or len(other) - len(text) > allowed:
            out[k] = _judged(text, other)
            continue
        rough = anchored(text, other, allowed, allowed)[0]
        if rough <= allowed:
            out[k] = True, rough
            continue
        if size + len(other) > SIDE_BY_SIDE and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append(k)
        size += len(other)
    for block in blocks:
        if 0 < len(block) < FEW_LINES:
            for k in block:
                out[k] = _judged(text, others[k])
        elif block:
            limits = [_allowed(len(others[k])) for k in block]
            for k, most, distance in zip(block, limits, edit_distances(text, [others[k] for k in block], limits)):
                out[k] = distance <= most, distance
    return out


def anchored(a: str, b: str, reach: int, most: int) -> tuple[int, list[tuple[str, str]]]:
    """What lies between pieces of ``a`` that ``b`` has, in order, and its length, an upper bound of the distance.

    The distances of what lies between add up to a closer bound.  It ends once the length is over ``most``.
    """
    at_a = at_b = cost = 0
    gaps = []
    for k in range(0, len(a) - ANCHOR + 1, ANCHOR):
        low = at_b + max(k - at_a - reach, 0)
        found = b.find(a[k:k + ANCHOR], low, at_b + k - at_a + reach + ANCHOR)
        if found >= 0:
            if k > at_a or found > at_b:
                cost += max(k - at_a, found - at_b)
                gaps.append((a[at_a:k], b[at_b:found]))
            at_a, at_b = k + ANCHOR, found + ANCHOR
        elif cost + k + ANCHOR - at_a > most:
            return cost + k + ANCHOR - at_a, gaps
    gaps.append((a[at_a:], b[at_b:]))
    return cost + max(len(a) - at_a, len(b) - at_b), gaps


def few_edits(a: str, b: str, most: int) -> int | None:
    """The Levenshtein distance if it is at most ``most``, else None.

    For each number of edits and each diagonal the furthest place that is reached: about ``most`` squared steps, each
    over the equal characters that follow.
    """
    n, m = len(a), len(b)

    def equal(i: int, j: int) -> int:
        """How many characters from ``i`` and ``j`` on are equal."""
        done, step = 0, 32
        while a[i + done:i + done + step] == b[j + done:j + done + step] and i + done < n and j + done < m:
            done += step
            step *= 2
        low, high = done, min(done + step, n - i, m - j)
        done = min(done, high)
        low = done
        while low < high:  # the first difference lies in the last step
            mid = (low + high + 1) // 2
            if a[i + low:i + mid] == b[j + low:j + mid]:
                low = mid
            else:
                high = mid - 1
        return low

    reach = {0: equal(0, 0)}
    for edits in range(most + 1):
        if reach.get(m - n, -1) >= n:
            return edits
        after = {}
        for k in range(-edits - 1, edits + 2):  # diagonal: place in b less place in a
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            if 0 <= i <= n and 0 <= i + k <= m:
                after[k] = i + equal(i, i + k)
            elif i > n and 0 <= n + k <= m:
                after[k] = n
        reach = after
    return None


def verified_edges(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """``(a, b)``: links that connect what is connected in each of the ``groups (grp, line, sim)``; no more than its lines."""
    return groups.join(texts, "line").select("grp", "line", "sim", "normal").repartition("grp").sortWithinPartitions(
        "grp").mapInArrow(_edge_batches, "a long, b long").distinct()


def _edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of all groups.  Most groups are pairs, so those of many leave the task together."""

    def out():
        return pa.RecordBatch.from_arrays([pa.array([e[x] for e in edges], type=pa.int64()) for x in (0, 1)], names=["a", "b"])

    have, held, edges = None, [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != have and held:
                edges += _edges(held)
                held = []
                if len(edges) >= EDGES:
                    yield out()
                    edges = []
            have = row[0]
            held.append(row[1:])
    edges += _edges(held)
    yield out()


def _edges(held: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The edges of one group of ``(line, sim, normal)``."""
    held.sort(key=lambda r: (len(r[2]), r[0]))
    if len(held) == 2:
        (a, a_sim, a_text), (b, b_sim, b_text) = held
        near = ((a_sim ^ b_sim) & 0xFFFFFFFFFFFFFFFF).bit_count() <= DISTANCE
        return [(a, b)] if near and _similar(a_text, b_text) else []
    sims = np.array([r[1] for r in held], dtype=np.int64).view(U64)
    lengths = [len(r[2]) for r in held]
    sizes = np.array(lengths)
    parts, edges = _Parts(len(held)), []
    # A line that was linked is near the one it was linked to; by the triangle inequality lines far from that
    # one are far from it, so groups of copies are not compared pair by pair.
    root, off, roots, far, whole = list(range(len(held))), [0] * len(held), set(), {}, set()

    def pair_of(k, other):
        return (root[k], root[other]) if root[k] < root[other] else (root[other], root[k])

    def unsettled(k, others):
        """Those that are neither connected with a line nor certainly far from it."""
        mine = parts.label[k]
        return [x for x in others if parts.label[x] != mine
                and far.get(pair_of(k, x), 0) - off[k] - off[x] <= (1 - SIMILARITY) * lengths[x] + 1e-9]

    for k in range(len(held)):
        high = int(np.searchsorted(sizes, sizes[k] / SIMILARITY + 1e-6, side="right"))
        rest = slice(k + 1, high)
        near = np.flatnonzero((np.bitwise_count(sims[rest] ^ sims[k]) <= DISTANCE) & (parts.part[rest] != parts.part[k])) + k + 1
        near = unsettled(k, near.tolist())
        # Where lines linked to the same two were unlike before, the distance of those two is worth knowing in whole.
        again = [p for p in dict.fromkeys(pair_of(k, x) for x in near if off[k] + off[x]) if p in far and p not in whole]
        if again:
            partners = [p[0] + p[1] - root[k] for p in again]
            for p, distance in zip(again, _distances(held[root[k]][2], [held[x][2] for x in partners])):
                far[p] = max(far[p], distance)
                whole.add(p)
            near = unsettled(k, near)
        while near:
            some, near = near[:STRIDE], near[STRIDE:]
            for other, (linked, bound) in zip(some, _judged_many(held[k][2], [held[x][2] for x in some])):
                if parts.label[other] == parts.label[k]:
                    continue
                if not linked:
                    pair = pair_of(k, other)
                    far[pair] = max(far.get(pair, 0), bound - off[k] - off[other])
                    continue
                parts.join(k, other)
                edges.append((held[k][0], held[other][0]))
                if root[other] == other and other not in roots:
                    root[other], off[other] = root[k], off[k] + bound
                    roots.add(root[k])
            near = unsettled(k, near)
    return edges


def _distances(text: str, others: list[str]) -> list[int]:
    """The whole distances, side by side for as many as fit."""
    out, k = [], 0
    while k < len(others):
        high, size = k + 1, len(others[k])
        while high < len(others) and size + len(others[high]) <= SIDE_BY_SIDE:
            size += len(others[high])
            high += 1
        out += edit_distances(text, others[k:high])
        k = high
    return out


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, h, places)`` of the documents that lose lines; ``places`` are line numbers from 0."""
    found = written(line_table(docs, doc_id, text), "lines")
    groups = written(near_groups(found), "near")
    at = F.struct("doc_id", "h", "place")
    distinct = written(found.groupBy("line").agg(F.min(at).alias("first"), F.min("raw").alias("raw"), F.count("*").alias("c")), "distinct")
    wanted = written(distinct.join(groups.select("line").distinct(), "line").select("line", "raw"), "wanted")
    edges = written(verified_edges(groups, line_texts(docs, text, wanted)), "links")
    member = components(edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct(), edges)
    # A line that stands once and is linked with no other one stays, so only the others are grouped.
    grouped = distinct.join(member.withColumnRenamed("id", "line"), "line", "left").where("component is not null or c > 1").select(
        "line", "first", F.coalesce("component", "line").alias("grp"))
    grouped = written(grouped, "groups")
    kept = grouped.groupBy("grp").agg(F.min("first").alias("keep"))
    verdict = grouped.join(kept, "grp").select("line", "keep")
    gone = found.select("doc_id", "h", "place", "line").join(verdict, "line").where(~at.eqNullSafe(F.col("keep")))
    return gone.groupBy("doc_id", "h").agg(F.collect_set("place").alias("places"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with removed lines taken out of the text, and ``n_lines`` and ``n_removed``."""
    doc, h, found, key = unused(docs, "doc", "h", "places", "key")
    gone = removed_lines(docs, doc_id, text).select(F.col("doc_id").alias(doc), F.col("h").alias(h), F.col("places").alias(found))
    keyed = docs.withColumn(key, F.xxhash64(text))
    joined = keyed.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(h)), "left")
    lines = F.split(F.col(text), "\n")
    places = F.coalesce(found, F.array().cast("array<int>"))
    left = F.array_join(F.filter(lines, lambda line, k: ~F.array_contains(places, k)), "\n")
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(
        *(F.when(F.size(places) > 0, left).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in others),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.size(places).cast("long").alias("n_removed"))
