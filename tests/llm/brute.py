"""Plain versions of the operators, one row after the other."""

import hashlib
import re
from collections import Counter


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def groups(nodes, links):
    """The least member of each node's group."""
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def strings(rows, length=100):
    """rows: (id, bytes) in order; kept bytes, removed bytes and removed runs of each."""
    seen, out = set(), []
    for _, data in rows:
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i:i + length]
            if s in seen:
                gone[i:i + length] = b"\x01" * length
            seen.add(s)
        runs = len(re.findall(b"\x01+", bytes(gone)))
        out.append((bytes(b for b, g in zip(data, gone) if not g), sum(gone), runs))
    return out


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    repeated = {p for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for p in range(i, i + 8)}
    n = len(words)
    counts = (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
    failed = n < 20 or 100 * counts[4] > 30 * n
    bad = (10 * counts[2] > n or 4 * text.count("!") > n
           or 2 * len(re.findall("[A-Z]", text)) > len(re.findall("[A-Za-z]", text)) + 20
           or 2 * counts[3] > len(lines) or 10 * sum(a == b for a, b in zip(words, words[1:])) > 3 * n
           or counts[1] < 2 * n or counts[1] > 13 * n)
    return (*counts, failed, not failed and not bad)


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(text, items, window=10):
    words, hit, named = bench_words(text), set(), set()
    for item, body in items:
        w = bench_words(body)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j:j + size] == w[i:i + size]:
                    hit |= set(range(j, j + size))
                    named.add(str(item))
    return len(words), len(hit), sorted(named)


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1)))


def jaccard_groups(rows, percent=80):
    """rows: (id, text) with ids told apart."""
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1:]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    least = groups(ids, links)
    return {i: (len(sets[i]), least[i]) for i in ids}


def normal(line):
    return " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[0-9]", "0", line.translate(LOWER))))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def fuzzy_lines(rows, similarity=0.8):
    """rows: (id, text) with ids told apart, in order; each with its removed lines taken out."""
    forms = {f for _, t in rows for x in t.split("\n") if (f := normal(x))}
    forms = sorted(forms)
    links = [
        (a, b) for k, a in enumerate(forms) for b in forms[k + 1:]
        if abs(len(a) - len(b)) <= (1 - similarity) * max(len(a), len(b))
        and edit_distance(a, b) <= (1 - similarity) * max(len(a), len(b))]
    group, seen, out = groups(forms, links), set(), []
    for _, t in rows:
        kept = []
        for line in t.split("\n"):
            f = normal(line)
            if f and group[f] in seen:
                continue
            if f:
                seen.add(group[f])
            kept.append(line)
        out.append("\n".join(kept))
    return out
