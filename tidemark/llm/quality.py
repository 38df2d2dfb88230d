"""Quality rules as a short-circuit cascade.

Every rule looks at whole texts and rejects or passes each.  On a bounded sample of rows the
cost of each rule and the share it rejects are measured; the rules then run in the order of rejections per second, each only on the texts that all rules before it passed.  The
order changes the cost alone: a text is kept when no rule rejects it, whatever the order.

Null and empty texts have no words and count 0 everywhere; a text without words passes every rule
that needs words and is rejected by ``min_words``.  Repeated rows are judged one by one.  Columns
of the input are kept as they are, and may have any names but those that the operator adds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.shared import without
from tidemark.llm.textbytes import (
    NOT_SPACE, Texts, depth, grams, mix, owners, slices)

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
NOT_NEWLINE = np.ones(256, dtype=bool)
NOT_NEWLINE[10] = False
#: Bytes that begin a code point.
LEADS = (np.arange(256) & 0xC0) != 0x80
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
LETTER = UPPER.copy()
LETTER[97:123] = True
BANG = np.zeros(256, dtype=bool)
BANG[33] = True


def _per_text(texts: Texts, table: np.ndarray) -> np.ndarray:
    """Bytes of each text that are marked in the table."""
    total = np.concatenate([[0], np.cumsum(table[texts.data], dtype=np.int64)])
    return np.diff(total[texts.offsets])


class Counts:
    """The counters of a slice of texts, each computed when a rule first asks for it."""

    def __init__(self, texts: Texts):
        self.texts = texts
        self._have: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in self._have:
            self._have[name] = getattr(self, f"_{name}")()
        return self._have[name]

    def _words(self):
        return self.texts.spans(NOT_SPACE)

    def _n_words(self):
        return self.words[2]

    def _word_chars(self):
        return _per_text(self.texts, NOT_SPACE & LEADS)

    def _n_symbols(self):
        return _per_text(self.texts, SYMBOLS)

    def _n_upper(self):
        return _per_text(self.texts, UPPER)

    def _n_letters(self):
        return _per_text(self.texts, LETTER)

    def _n_bangs(self):
        return _per_text(self.texts, BANG)

    def _lines(self):
        """Lines with a word: the text each is in, and whether an earlier line is equal."""
        starts, ends, counts = self.texts.spans(NOT_NEWLINE)
        words = self.words[0]
        has_word = np.searchsorted(words, ends) > np.searchsorted(words, starts)
        owner = owners(counts)[has_word]
        key = self.texts.span_hash(starts[has_word], ends[has_word]) ^ mix(owner.astype(np.uint64) + np.uint64(1))
        again = np.ones(len(key), dtype=bool)
        again[np.unique(key, return_index=True)[1]] = False
        return owner, again

    def _n_lines(self):
        return np.bincount(self.lines[0], minlength=self.texts.n)

    def _n_dup_lines(self):
        return np.bincount(self.lines[0][self.lines[1]], minlength=self.texts.n)

    def _n_stutters(self):
        """Words equal to the word before."""
        starts, ends, counts = self.words
        owner, code = owners(counts), self.texts.span_hash(starts, ends)
        same = np.flatnonzero((code[1:] == code[:-1]) & (owner[1:] == owner[:-1])) + 1
        return np.bincount(owner[same], minlength=self.texts.n)

    def _n_repeat_words(self):
        """Words inside windows of eight words that the text has twice or more."""
        starts, ends, counts = self.words
        owner = owners(counts)
        key = grams(self.texts.span_hash(starts, ends), 8)
        inside = np.flatnonzero(owner[:len(key)] == owner[7:]) if len(key) else np.zeros(0, dtype=np.int64)
        key = key[inside] ^ mix(owner[inside].astype(np.uint64) + np.uint64(1))
        _, which, times = np.unique(key, return_inverse=True, return_counts=True)
        repeated = inside[times[which] > 1]
        covered = depth(len(starts), repeated, repeated + 8) > 0
        return np.bincount(owner[covered], minlength=self.texts.n)


@dataclass(frozen=True)
class Rule:
    """``rejects`` tells for each text of a slice whether the rule throws it out."""

    name: str
    rejects: Callable[[Counts], np.ndarray]


#: The base rules of the query contract.
BASE = (
    Rule("min_words", lambda c: c.n_words < 20),
    Rule("repeated_words", lambda c: 100 * c.n_repeat_words > 30 * c.n_words),
)
#: Symbols in a tenth of the words, shouting, words or lines said again and again, odd word lengths.
RULES = (
    *BASE,
    Rule("symbols", lambda c: 10 * c.n_symbols > c.n_words),
    Rule("shouting", lambda c: (4 * c.n_bangs > c.n_words) | (2 * c.n_upper > c.n_letters + 20)),
    Rule("repeated_lines", lambda c: 2 * c.n_dup_lines > c.n_lines),
    Rule("stutter", lambda c: 10 * c.n_stutters > 3 * c.n_words),
    Rule("word_length", lambda c: (c.word_chars < 2 * c.n_words) | (c.word_chars > 13 * c.n_words)),
)


def _subset(texts: Texts, which: np.ndarray) -> Texts:
    """A slice of only the chosen texts."""
    sizes = np.diff(texts.offsets)[which]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(texts.offsets[:-1][which] - offsets[:-1], sizes) + np.arange(offsets[-1])
    return Texts(texts.data[take], offsets, 0)


def judge(texts: Texts, rules: tuple[Rule, ...]) -> np.ndarray:
    """For each text, the place of the rule that rejects it, or -1."""
    out = np.full(texts.n, -1, dtype=np.int32)
    alive, counts = np.arange(texts.n), Counts(texts)
    for k, rule in enumerate(rules):
        bad = rule.rejects(counts)
        out[alive[bad]] = k
        if bad.any():
            alive = alive[~bad]
            if not len(alive):
                break
            counts = Counts(_subset(texts, alive))
    return out


def order_rules(df: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, sample_rows: int = 500) -> tuple[Rule, ...]:
    """The rules, most rejections per second first.

    Costs and rejections are measured on at most ``sample_rows`` rows, the first ones that Spark reads.
    A large table gives no more rows than a small one, and no other task is started for them.  Equal
    ratios keep the given order.
    """
    sample = pa.array([r[0] for r in df.select(text).take(sample_rows)], type=pa.string())
    cost, bad = [0.0] * len(rules), [0] * len(rules)
    for texts in slices(sample):
        for k, rule in enumerate(rules):
            began = time.perf_counter()
            bad[k] += int(rule.rejects(Counts(texts)).sum())
            cost[k] += time.perf_counter() - began
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-bad[k] / max(cost[k], 1e-9), k)))


METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_cascade(
    df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES,
    metrics: bool = False, sample_rows: int = 500,
) -> DataFrame:
    """``df`` with ``kept`` and ``rejected_by`` (null if kept: the first rule in cascade order).

    ``metrics`` adds the counters of ``METRICS`` for every text, rejected or not.  One scan, no shuffle.
    Columns of ``df`` with the names of the added ones are replaced by them.
    """
    ordered = order_rules(df, text, rules, sample_rows)
    names = pa.array([r.name for r in ordered])
    added = T.StructType().add("kept", T.BooleanType()).add("rejected_by", T.StringType())
    for m in METRICS if metrics else ():
        added.add(m, T.LongType())
    df = without(df, added.names)
    place = df.columns.index(text)
    schema = T.StructType(list(df.schema.fields) + list(added.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros(0, dtype=np.int32)]
            tallies = {m: [np.zeros(0, dtype=np.int64)] for m in METRICS if metrics}
            for texts in slices(batch.column(place)):
                parts.append(judge(texts, ordered))
                counts = Counts(texts)
                for m in tallies:
                    tallies[m].append(getattr(counts, m))
            verdict = np.concatenate(parts)
            why = names.take(pa.array(verdict, mask=verdict < 0))
            columns = [*batch.columns, pa.array(verdict < 0), why]
            columns += [pa.array(np.concatenate(v).astype(np.int64)) for v in tallies.values()]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(run, schema)

