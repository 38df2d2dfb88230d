"""Licence notices in texts, found through a positional index of rare words.

A template is a notice with the phrases that it cannot do without.  Document frequencies of all
words of the templates are counted over the whole corpus.  A file is looked up by the highest-IDF licence
words it has: for each template the rarest word of its phrases first, and a template is given up at the first
word that is absent.  The places of the rarest word give places of its phrase, and those of the other phrases
are intersected with them by relative position.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import runs
from tidemark.llm.textbytes import WORD_BYTE, Texts, slices

#: How far a word or phrase may stand from its place in the template, in words.
SLACK = 8
#: What a lone phrase counts, between 0 (no licence) and 1 (all words of a notice in place).
PHRASE_SCORE = 0.5

#: Phrases that name a licence by themselves.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)

#: Label, notice as commonly published, and the phrases that must stand in it.
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "SPDX-License-Identifier: MIT", ("spdx license identifier mit",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
     ("permission is hereby granted free of charge", "deal in the software without restriction", "sublicense and or sell copies")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies",
     ("permission to use copy modify", "with or without fee is hereby granted", "appear in all copies")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
            "of conditions and the following disclaimer",
     ("redistribution and use in source and binary forms", "following conditions are met", "must retain the above copyright notice")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("spdx license identifier apache 2 0",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
     ("apache license version 2 0", "you may not use this file except in compliance", "obtain a copy of the license")),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
     ("under the terms of the gnu general public license", "free software foundation", "version 2 of the license")),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
     ("under the terms of the gnu general public license", "free software foundation", "version 3 of the license")),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation",
     ("gnu lesser general public license", "free software foundation")),
    ("agpl-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either "
                 "version 3 of the License",
     ("gnu affero general public license", "version 3 of the license")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at",
     ("subject to the terms of the mozilla public license", "v 2 0", "if a copy of the mpl was not distributed")),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
                  "use, compile, sell, or distribute this software",
     ("free and unencumbered software", "released into the public domain")),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
     ("to the extent possible under law", "waived all copyright")),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License",
     ("creative commons attribution 4 0 international",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
     ("creative commons attribution sharealike 4 0 international",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
     ("creative commons attribution noncommercial 4 0 international",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
)


def words_of(text: str) -> list[str]:
    """The words of a text: A-Z lower-cased, then runs of letters, digits and everything beyond ASCII."""
    low = re.sub("[A-Z]+", lambda m: m.group().lower(), text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@dataclass(frozen=True)
class Template:
    """A notice as word numbers, and its phrases as (place, word numbers); a base phrase has no further words."""

    label: str
    words: np.ndarray
    phrases: list[tuple[int, np.ndarray]]
    base: bool


class Index:
    """The templates over a vocabulary of their words, each word known by its hash."""

    def __init__(self, templates: Sequence[tuple], phrases: Sequence[tuple]):
        texts = [(label, words_of(text), [words_of(p) for p in keys], False) for label, text, keys in templates]
        texts += [(label, words_of(text), [words_of(text)], True) for label, text in phrases]
        self.vocabulary = sorted({w for _, words, _, _ in texts for w in words})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        hashes = np.concatenate([_words(t)[0] for t in slices(pa.array(self.vocabulary, pa.string()))])
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.templates = []
        for label, words, keys, base in texts:
            if not keys or not all(keys):
                raise ValueError(f"the template of {label} has no phrase with words")
            places = [next((i for i in range(len(words)) if words[i:i + len(k)] == k), None) for k in keys]
            if None in places:
                raise ValueError(f"a phrase does not stand in the template of {label}")
            self.templates.append(Template(
                label, np.array([number[w] for w in words]),
                [(at, np.array([number[w] for w in k])) for at, k in zip(places, keys)], base))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, -1 for all others."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at], -1)


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a slice, and where each text's words begin."""
    starts, ends, counts = texts.spans(WORD_BYTE)
    return texts.span_hash(starts, ends, "lower"), np.concatenate([[0], np.cumsum(counts)])


class _Places:
    """Where the vocabulary's words stand in a slice of texts."""

    def __init__(self, texts: Texts, index: Index):
        hashes, self.first = _words(texts)
        self.words = index.numbers(hashes)
        known = np.flatnonzero(self.words >= 0)
        known = known[np.argsort(self.words[known], kind="stable")]
        starts, ends = runs(self.words[known])
        self.postings = {int(self.words[known[a]]): known[a:b] for a, b in zip(starts, ends)}

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1

    def phrase(self, words: np.ndarray, rare: int) -> np.ndarray:
        """The places where ``words`` stand consecutively in one text, looked up by the word at ``rare``."""
        at = self.postings.get(int(words[rare]), np.zeros(0, dtype=np.int64)) - rare
        at = at[(at >= 0) & (at + len(words) <= len(self.words))]
        for k, word in enumerate(words):
            at = at[self.words[at + k] == word]
        return at[self.text_of(at) == self.text_of(at + len(words) - 1)]

    def matches(self, template: Template, rarity: np.ndarray) -> np.ndarray:
        """Where the template begins: its first phrase there, every other one at most ``SLACK`` words off its place."""
        rare = [int(np.argmax(rarity[words])) for _, words in template.phrases]
        by_rarity = sorted(range(len(rare)), key=lambda k: -rarity[template.phrases[k][1][rare[k]]])
        if any(int(template.phrases[k][1][rare[k]]) not in self.postings for k in by_rarity):
            return np.zeros(0, dtype=np.int64)
        seen, near = {}, None
        for k in by_rarity:
            place, words = template.phrases[k]
            begins = self.phrase(words, rare[k]) - place
            if near is not None:  # only what stands within twice the slack of the rarest phrase can be part of a match
                begins = begins[_within(begins, near, 2 * SLACK)]
            if not len(begins):
                return begins
            seen[k] = begins
            near = begins if near is None else near[_within(near, begins, 2 * SLACK)]
        heads = seen[0]
        text = self.text_of(heads + template.phrases[0][0])
        for k, begins in seen.items():
            place = template.phrases[k][0]
            low = np.maximum(heads - SLACK, self.first[text] - place)
            high = np.minimum(heads + SLACK, self.first[text + 1] - 1 - place)
            ok = np.searchsorted(begins, high, side="right") > np.searchsorted(begins, low)
            heads, text = heads[ok], text[ok]
        return heads

    def share(self, template: Template, heads: np.ndarray) -> np.ndarray:
        """The share of the template's words that stand at most ``SLACK`` words off their place."""
        text = self.text_of(heads + template.phrases[0][0])
        around = np.arange(len(template.words))[:, None] + np.arange(-SLACK, SLACK + 1)[None]
        out = np.zeros(len(heads))
        for a in range(0, len(heads), 256):
            at = heads[a:a + 256, None, None] + around
            low, high = self.first[text[a:a + 256]], self.first[text[a:a + 256] + 1]
            inside = (at >= low[:, None, None]) & (at < high[:, None, None])
            equal = self.words[np.clip(at, 0, len(self.words) - 1)] == template.words[None, :, None]
            out[a:a + 256] = (inside & equal).any(axis=2).sum(axis=1) / len(template.words)
        return out


def _within(places: np.ndarray, others: np.ndarray, reach: int) -> np.ndarray:
    """Which of the places have one of the (sorted) others within reach."""
    return np.searchsorted(others, places + reach, side="right") > np.searchsorted(others, places - reach)


def word_rarity(docs: DataFrame, text_col: str, index: Index) -> np.ndarray:
    """The inverse document frequency of each word of the vocabulary, counted over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(len(index.vocabulary), dtype=np.int64), 0
        for batch in batches:
            n += len(batch)
            for texts in slices(batch.column(0)):
                hashes, first = _words(texts)
                words = index.numbers(hashes)
                at = np.flatnonzero(words >= 0)
                text = np.searchsorted(first, at, side="right") - 1
                pair = np.unique(text * len(seen) + words[at])
                seen += np.bincount(pair % len(seen), minlength=len(seen))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(np.arange(len(seen)), -1)), pa.array(np.append(seen, n))], names=["word", "n"])

    found = docs.select(text_col).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word: r.n for r in found}
    frequency = np.array([counts.get(i, 0) for i in range(len(index.vocabulary))])
    return np.log((counts.get(-1, 0) + 1) / (frequency + 1))


MATCH = "struct<label:string,word:bigint,share:double>"


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: Sequence[tuple] = TEMPLATES, phrases: Sequence[tuple] = PHRASES,
) -> DataFrame:
    """``(<id_col>, n_words, n_base, first_word, last_word, base_labels, labels, score, matches)``, one row per row.

    ``n_base`` places where a base phrase stands, with the least and largest of them (null if none) and the sorted
    distinct labels of those phrases.  ``labels`` adds those of matched templates.  A template matches where its first
    phrase stands and every other of its phrases within ``SLACK`` words of its place after it.  ``matches`` lists
    each match: label, word where the template begins (negative if the text begins inside it), and the share of
    its words that stand within ``SLACK`` of their places.  ``score`` is the largest share, at least
    ``PHRASE_SCORE`` if there is a base phrase, 0 without any label.

    A null or empty text has no words and no label.  Texts are processed whole, repeated rows row by row, ids may be null.
    Only the two named columns are read, so others may have any name.  An empty table has an empty result.
    """
    index = Index(templates, phrases)
    rarity = word_rarity(docs, text_col, index)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = ("n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, "
              f"score double, matches array<{MATCH}>")
    return docs.select(id_col, text_col).mapInArrow(_scan(index, rarity), f"`{id_col}` {kind}, {fields}")


def _scan(index: Index, rarity: np.ndarray):
    names = sorted({t.label for t in index.templates})
    number = {label: i for i, label in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                yield _report(batch.column(0).slice(texts.first, texts.n), texts)

    def _report(ids, texts: Texts) -> pa.RecordBatch:
        places = _Places(texts, index)
        first = places.first
        n_base, score = np.zeros(texts.n, dtype=np.int64), np.zeros(texts.n)
        low, high = np.full(texts.n, np.iinfo(np.int64).max), np.full(texts.n, -1)
        has, base_has = np.zeros((texts.n, len(names)), dtype=bool), np.zeros((texts.n, len(names)), dtype=bool)
        found = []
        for template in index.templates:
            heads = places.matches(template, rarity)
            if not len(heads):
                continue
            text = places.text_of(heads + template.phrases[0][0])
            has[text, number[template.label]] = True
            if template.base:
                base_has[text, number[template.label]] = True
                n_base += np.bincount(text, minlength=texts.n)
                np.minimum.at(low, text, heads - first[text])
                np.maximum.at(high, text, heads - first[text])
                np.maximum.at(score, text, PHRASE_SCORE)
            else:
                share = places.share(template, heads)
                np.maximum.at(score, text, share)
                found.append((text, heads - first[text], np.full(len(heads), number[template.label]), share))
        none = np.zeros(0, dtype=np.int64)
        text, word, label, share = (np.concatenate(x) for x in zip(*found)) if found else (none, none, none, np.zeros(0))
        order = np.lexsort((share, label, word, text))
        listed = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(np.bincount(text, minlength=texts.n))]).astype(np.int32)),
            pa.StructArray.from_arrays([
                pa.array([names[k] for k in label[order]], pa.string()), pa.array(word[order]), pa.array(share[order])],
                names=["label", "word", "share"]))

        def labelled(which: np.ndarray):
            return pa.array([[names[k] for k in np.flatnonzero(row)] for row in which], pa.list_(pa.string()))

        absent = n_base == 0
        columns = {
            "n_words": pa.array(np.diff(first)), "n_base": pa.array(n_base), "first_word": pa.array(low, mask=absent),
            "last_word": pa.array(high.astype(np.int64), mask=absent), "base_labels": labelled(base_has),
            "labels": labelled(has), "score": pa.array(score), "matches": listed}
        return pa.RecordBatch.from_arrays([ids, *columns.values()], names=["id", *columns])

    return run
