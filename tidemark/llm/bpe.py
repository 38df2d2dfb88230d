"""Byte-pair encoding by a depth-first walk over the trie of the distinct words, and decoding.

Texts are normalised and cut into words as the vocabulary file's tokenizer does it: special tokens
first, then NFC, lower case letter by letter, and the word pattern.  Every word becomes bytes, the last one
with the end-of-word mark.  In byte-pair encoding the tokens of a prefix are fixed by its last token:
the one vocabulary entry that ends there and may follow the last token of what is before it.  Sorted
distinct words are the trie in depth-first order; the walk keeps one last token per letter of the
path, so a prefix shared by many words is encoded once.

Nothing is shuffled.  A task keeps the words it has met, at most ``WORDS_KEPT``: those of the older half that
are met again move to the newer one, and the others go when that one is full.
Null and empty texts have no tokens.  Other columns and repeated rows pass through unchanged.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.textbytes import SLICE

WORDS_KEPT = 100_000
#: Steps between states that are remembered, those along tokens included.
STEPS_KEPT = 200_000
#: Pairs of tokens of which a task knows whether one may follow the other.
PAIRS_KEPT = 300_000
#: Unicode white space without the four separators that str.split() takes besides.
BLANKS = "\t-\r \x85\xa0  -     　"
#: Fixed values of this kind of vocabulary: the word pattern and the end-of-word mark.
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{BLANKS}\p{{L}}\p{{N}}]+"
WORD_END = "</w>"
#: The same for words with ``{0}``, code points that only the word pattern's library takes for letters or numbers.
YOUNG_PATTERN = (rf"'s|'t|'re|'ve|'m|'ll|'d|(?:(?!{{0}})[\p{{{{L}}}}])+|(?!{{0}})[\p{{{{N}}}}]|"
                 rf"(?:{{0}}|[^{BLANKS}\p{{{{L}}}}\p{{{{N}}}}])+")


#: Letters and numbers that Unicode 16 added, first and last of each run.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3), (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9),
    (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5FA),
)
#: Lower case letters that Python's tables do not know yet.
LOWER_LATER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


def young_letters() -> str:
    """A class of the letters and numbers that ``regex`` knows and the tokenizers' library does not: what came after Unicode 16.

    They are those that neither Python's own tables (Unicode 15.1) nor ``LETTERS_16`` have.
    """
    known = {c for a, b in LETTERS_16 for c in range(a, b + 1)}
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    codes = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn" and ord(c) not in known]
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    ends = [c for k, c in enumerate(codes) if k == len(codes) - 1 or codes[k + 1] != c + 1]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends)) + "]" if codes else "(?!)"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as letters from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _specification(path: str) -> tuple[dict, dict[str, int]]:
    """The model of a vocabulary file, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return spec["model"], {t["content"]: t["id"] for t in spec["added_tokens"]}


def written_tokens(path: str) -> list[str]:
    """How each token is written, by number."""
    model, special = _specification(path)
    out = [""] * (1 + max([*model["vocab"].values(), *special.values()]))
    for s, i in [*model["vocab"].items(), *special.items()]:
        out[i] = s
    return out


class Vocabulary:
    """Merges of a vocabulary file as token numbers; a later merge has a higher number.

    Tables by token are arrays, so a worker keeps little: -1 stands for a token that no merge makes.
    """

    def __init__(self, path: str):
        model, self.special = _specification(path)
        ids, letters = model["vocab"], _byte_letters()
        size = 1 + max([*ids.values(), *self.special.values()])
        self.left, self.right, self.pair = array("i", [-1]) * size, array("i", [-1]) * size, {}
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            whole = ids[a + b]
            self.left[whole], self.right[whole] = ids[a], ids[b]
            self.pair[ids[a] << 32 | ids[b]] = whole
        self.fits: dict[int, bool] = {}
        self.young = young_letters()
        self.packed = np.arange(size, dtype="<u4").tobytes()
        self.next, self.fail, self.inner, self.final = {}, [0], [()], [()]
        kept = []
        for s, i in ids.items():
            ends = s.endswith(WORD_END) and s != WORD_END
            raw = bytes(letters[c] for c in (s[:-len(WORD_END)] if ends else s))
            if self.left[i] < 0 or self.follows(self.left[i], self.right[i], i):
                kept.append((raw, ends, i))
        self.linked = False
        self.link(kept)
        self.linked = True

    def link(self, tokens: list[tuple[bytes, bool, int]]) -> None:
        """States for all beginnings of tokens: the next state by byte, and the tokens that end there, longest first."""
        own: list[list] = [[None, None]]
        for raw, ends, i in tokens:
            state = 0
            for byte in raw:
                key = state << 8 | byte
                if key not in self.next:
                    self.next[key] = len(own)
                    own.append([None, None])
                state = self.next[key]
            own[state][ends] = (len(raw), i)
        size = len(own)
        self.fail, self.inner, self.final = [0] * size, [()] * size, [()] * size
        depth = [0] * size
        for key, state in self.next.items():  # a state comes after the one before it
            depth[state] = depth[key >> 8] + 1
        edges = sorted(((depth[state], key, state) for key, state in self.next.items()))
        for d, key, state in edges:
            if d > 1:
                self.fail[state] = self.step(self.fail[key >> 8], key & 255)
            for chains, k in ((self.inner, 0), (self.final, 1)):
                rest = chains[self.fail[state]]
                chains[state] = ((own[state][k],) + rest) if own[state][k] else rest

    def step(self, state: int, byte: int) -> int:
        """The state of the longest beginning of a token that ends with this byte."""
        key = state << 8 | byte
        to = self.next.get(key)
        if to is None:
            to = self.step(self.fail[state], byte) if state else 0
            if self.linked and len(self.next) < STEPS_KEPT:
                self.next[key] = to
        return to

    def follows(self, a: int, b: int, until: int = 1 << 62) -> bool:
        """Whether token ``b`` may stand after ``a``: no merge before ``until`` joins letters across the border.

        The border is looked at backwards in time.  ``a_gone`` and ``b_gone`` are the merges that took the tokens
        now beside it; of equal merges the one further left comes first.
        """
        a_gone = b_gone = until
        while True:
            joined = self.pair.get(a << 32 | b)
            if joined is not None and joined < until and joined < a_gone and joined <= b_gone:
                return False
            if a > b:
                if self.left[a] < 0:
                    return True
                a_gone, a = a, self.right[a]
            else:
                if self.left[b] < 0:
                    return True
                b_gone, b = b, self.left[b]

    def may_follow(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self.follows(a, b)
        return known

    def last_token(self, end: int, path: list[int], chain: tuple) -> int:
        """The token that ends at ``end``, given the last tokens of all shorter prefixes."""
        for size, token in chain:
            if size == end or self.may_follow(path[end - size], token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, bytes]:
        """The packed tokens of each distinct word: a depth-first walk over their trie."""
        out: dict[bytes, bytes] = {}
        path, states, before, sizes, packed = [-1], [0], b"", {}, self.packed
        for word in sorted(set(words)):
            n = len(word)
            shared, most = 0, min(len(before), n - 1, len(path) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del path[shared + 1:], states[shared + 1:]
            for end in range(shared + 1, n):
                state = self.step(states[-1], word[end - 1])
                states.append(state)
                path.append(self.last_token(end, path, self.inner[state]))
            token, end, tokens = self.last_token(n, path, self.final[self.step(states[-1], word[-1])]), n, []
            while True:
                tokens.append(packed[4 * token:4 * token + 4])
                size = sizes.get(token)
                if size is None:
                    size = sizes[token] = self.size(token)
                end -= size
                if end == 0:
                    break
                token = path[end]
            out[word], before = b"".join(tokens[::-1]), word
        return out

    def size(self, token: int) -> int:
        """Bytes that a token stands for."""
        if self.left[token] >= 0:
            return self.size(self.left[token]) + self.size(self.right[token])
        return 1


class Encoder:
    """Encodes texts; keeps the tokens of the pieces between blanks that it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.special = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.words = regex.compile(WORD_PATTERN)
        self.later = re.compile("[" + "".join(map(chr, LOWER_LATER)) + "]|" + vocabulary.young).search
        self.young, self.young_words = re.compile(vocabulary.young), regex.compile(YOUNG_PATTERN.format(vocabulary.young))
        self.blank = re.compile(f"[{BLANKS}]+")
        self.odd = re.compile("[\x1c-\x1f]")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [p for p in self.blank.split(text) if p] if self.odd.search(text) else text.split()

    def cut(self, piece: str) -> list[str]:
        """The words of a piece."""
        if piece.isascii() or not self.later(piece):
            return self.words.findall(piece)
        return (self.young_words if self.young.search(piece) else self.words).findall(piece.translate(LOWER_LATER))

    def learn(self, pieces: set[str]) -> None:
        cut = {p: [w.encode() for w in self.cut(p)] for p in pieces}
        tokens = self.vocabulary.encode_words(w for ws in cut.values() for w in ws)
        for p, ws in cut.items():
            self.known[p] = b"".join([tokens[w] for w in ws])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The token numbers of each text as little-endian 32-bit integers."""
        parts = []
        for text in texts:
            cut = self.special.split(text) if self.special and "<" in text else [text]
            parts.append([s if k % 2 else self.pieces(s) for k, s in enumerate(cut)])
        new = {p for cut in parts for s in cut if not isinstance(s, str) for p in s}
        if len(self.known) > WORDS_KEPT // 2:
            self.known, self.older = {}, self.known
        if len(self.vocabulary.fits) > PAIRS_KEPT:
            self.vocabulary.fits.clear()
        new -= self.known.keys()
        again = new & self.older.keys()
        self.known.update((p, self.older[p]) for p in again)
        self.learn(new - again)
        look = self.known.__getitem__
        return [b"".join(
            [np.uint32(self.vocabulary.special[s]).tobytes() if isinstance(s, str) else b"".join(map(look, s))
             for s in cut]) for cut in parts]


def _runs(column: pa.Array) -> Iterator[list]:
    """The values of a column, so many at a time that they have about ``SLICE`` bytes."""
    sizes = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(column):
        done = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, done + 2 * SLICE, side="right")))
        yield column.slice(low, high - low).to_pylist()
        low = high


def _spoken(tokens: list[str], coded: bytes | None) -> str:
    """The written tokens of packed numbers, one space between them."""
    return " ".join(map(tokens.__getitem__, np.frombuffer(coded or b"", dtype="<u4").tolist()))


def bpe_encode(df: DataFrame, vocabulary_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with ``ids``: the token numbers of each text as little-endian unsigned 32-bit integers.

    With ``decoded``, also that column, as ``bpe_decode`` makes it: in the same pass, so one worker per task does both
    and the numbers do not travel twice.
    The driver reads the vocabulary file and sends its tables to the executors; their size is the vocabulary's.
    """
    tables = df.sparkSession.sparkContext.broadcast(
        (Vocabulary(vocabulary_path), written_tokens(vocabulary_path) if decoded else []))
    others = [c for c in df.columns if c not in (ids, decoded)]
    place = others.index(text)
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(ids, T.BinaryType())])
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def run(batches):
        vocabulary, tokens = tables.value
        encoder = Encoder(vocabulary)
        for batch in batches:
            low = 0
            for texts in _runs(batch.column(place)):
                part = batch.slice(low, len(texts))
                low += len(texts)
                coded = encoder.encode(["" if t is None else t for t in texts])
                columns = [*part.columns, pa.array(coded, type=pa.binary())]
                if decoded:
                    columns.append(pa.array([_spoken(tokens, c) for c in coded], type=pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(*others).mapInArrow(run, schema)


def bpe_decode(df: DataFrame, vocabulary_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with ``decoded``: the written tokens, one space between them; null ids are no tokens.

    Files of this kind name no decoder, so their library decodes to just that.
    """
    tables = df.sparkSession.sparkContext.broadcast(written_tokens(vocabulary_path))
    others = [c for c in df.columns if c != decoded]
    place = others.index(ids)
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(decoded, T.StringType())])

    def run(batches):
        tokens = tables.value
        for batch in batches:
            low = 0
            for coded in _runs(batch.column(place)):
                part = batch.slice(low, len(coded))
                low += len(coded)
                texts = [_spoken(tokens, c) for c in coded]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, type=pa.string())], names=schema.names)

    return df.select(*others).mapInArrow(run, schema)
