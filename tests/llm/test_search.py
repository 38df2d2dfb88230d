"""Hard negatives, licence scans and the source audit against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence as dv
from tidemark.llm import hard_negatives as hn
from tidemark.llm import license_scan as ls

VECTORS = "vec_id long, embedding array<float>, label int"


def negatives(rows, dim):
    """rows: (id, vector, label) that take part; every anchor against every row."""
    q = [[math.floor(256 * float(np.float32(x))) for x in v] + [0] * (dim - len(v)) for _, v, _ in rows]
    last = math.inf
    out = []
    for a, (aid, _, label) in enumerate(rows):
        if aid is None or aid % 5:
            continue
        score = [sum(x * y for x, y in zip(q[a], c)) for c in q]
        order = sorted((k for k in range(len(rows)) if k != a), key=lambda k: (-score[k], last if rows[k][0] is None else rows[k][0]))
        for p in [k for k in order if rows[k][2] == label][:5]:
            fit = [k for k in order if rows[k][2] != label and 50 * score[p] <= 100 * score[k] <= 95 * score[p]]
            out += [(aid, rows[p][0], r, rows[k][0], score[p], score[k]) for r, k in enumerate(fit[:3], 1)]
    return sorted(out, key=str)


def clustered(seed, n, dim=6, labels=4):
    """Vectors around a few centres, with copies, opposite ones, zeros and repeated ids."""
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = []
    for k in range(n):
        c = rng.choice(centres)
        v = [x + rng.gauss(0, 0.3) for x in c]
        if rows and k % 6 == 0:
            v = list(rng.choice(rows)[1])
        if k % 17 == 0:
            v = [0.0] * dim
        if k % 13 == 0:
            v = [-x for x in v]
        rows.append((k if k % 11 else k // 2, v, rng.randrange(labels) if k % 3 else 0))
    return rows + [rows[5], rows[10], (None, rows[3][1], 1), (None, rows[3][1], 2)]


def mined(frame, **options):
    out = hn.mine_negatives(frame, F.col("vec_id") % 5 == 0, **options)
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"block": 7, "stripe": 40}), (3, {"sample": 3, "block": 30})])
def test_negatives_equal_brute_force(spark, seed, options, monkeypatch):
    monkeypatch.setattr(hn, "LEAST_STRIPE", 32)
    rows = clustered(seed, 150)
    want = negatives(rows, 6)
    assert len(want) > 50 and mined(spark.createDataFrame(rows, VECTORS).repartition(3), **options) == want


def test_negatives_of_odd_rows(spark):
    good = [(0, [1.0, 0.5], 1), (3, [1.0, 0.25], 1), (4, [0.5], 2), (6, [0.75, 0.0], 2), (5, [], 2)]
    bad = [(5, [math.nan, 1.0], 1), (7, [math.inf], 1), (8, None, 1), (9, [1.0, None], 1), (10, [1.0, 1.0], None)]
    frame = spark.createDataFrame(good + bad, VECTORS)
    extra = frame.selectExpr("*", "1 as row", "'q' as q", "2 as block", "3 as anchor", "4 as norm", "5 as cluster")
    want = negatives(good, 2)
    assert want and mined(frame) == want and mined(extra) == want
    assert mined(frame.limit(0)) == [] and mined(frame.where("vec_id = 3")) == []
    named = frame.withColumn("label", F.concat(F.lit("l"), F.col("label")))
    assert mined(named) == want


def test_large_numbers_are_exact_or_refused(spark):
    rows = [(0, [3e6, 1.0], 1), (1, [3e6, 2.0], 1), (2, [2e6, 5.0], 2), (3, [2.5e6, 7.0], 2)]
    assert mined(spark.createDataFrame(rows, VECTORS)) == negatives(rows, 2)
    with pytest.raises(ValueError, match="do not fit"):
        mined(spark.createDataFrame([(0, [1e30], 1)], VECTORS))


def test_lists_end_before_all_candidates_are_compared(monkeypatch):
    """On clustered vectors a member stops long before the end of its list."""
    rng = np.random.default_rng(5)
    centres = hn._unit(rng.normal(size=(20, 32)))
    x = np.floor(256 * hn._unit(centres[rng.integers(20, size=4000)] + 0.05 * rng.normal(size=(4000, 32))))
    anchors = np.zeros(40, dtype=hn._record("<i2", 32, 1))
    angles = hn._angles(x[:40], centres)
    anchors["q"], anchors["row"], anchors["cluster"], anchors["angle"] = x[:40], np.arange(40), angles.argmin(1), angles.min(1)
    anchors["low"], anchors["high"] = -np.inf, np.inf
    candidates = np.zeros(4000, dtype=hn._record("<i2", 32))
    candidates["q"], candidates["row"] = x, np.arange(4000)
    candidates["id"] = candidates["row"]
    compared = []
    real = hn._Members.compare
    monkeypatch.setattr(hn._Members, "compare", lambda self, m, c, x: (compared.append(len(m) * len(c)), real(self, m, c, x))[1])
    monkeypatch.setattr(hn, "STEP", 64)
    members = hn._Members(anchors, centres, 1, 5, True, np.float64)
    members.meet(candidates)
    got = members.results().to_pydict()
    scores = x[:40] @ x.T
    np.fill_diagonal(scores, -np.inf)
    for k, row in enumerate(members.anchors["row"]):
        best = np.lexsort((np.arange(4000), -scores[row]))[:5].tolist()
        assert [i for r, i in zip(got["row"], got["id"]) if r == row] == best
    assert sum(compared) < 0.4 * 40 * 4000


def licences(text, templates=ls.TEMPLATES, phrases=ls.PHRASES):
    """(n_words, n_base, first, last, base labels, labels, score, matches) of one text."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))

    def places(words, key):
        return [i for i in range(len(words) - len(key) + 1) if words[i:i + len(key)] == key]

    base = [(i, label) for label, phrase in phrases for i in places(w, ls.words_of(phrase))]
    matches = []
    for label, notice, keys in templates:
        t = ls.words_of(notice)
        keys = [ls.words_of(k) for k in keys]
        at = [places(t, k)[0] for k in keys]
        for i in places(w, keys[0]):
            o = i - at[0]
            if all(any(abs(j - p - o) <= ls.SLACK for j in places(w, k)) for k, p in zip(keys, at)):
                near = sum(any(0 <= o + k + d < len(w) and w[o + k + d] == x for d in range(-ls.SLACK, ls.SLACK + 1))
                           for k, x in enumerate(t))
                matches.append((o, label, near / len(t)))
    at = [i for i, _ in base]
    score = max([s for _, _, s in matches] + [ls.PHRASE_SCORE] * bool(base), default=0.0)
    return (len(w), len(base), min(at, default=None), max(at, default=None), sorted({x for _, x in base}),
            sorted({x for _, x in base} | {x for _, x, _ in matches}), score, sorted(matches))


def licence_texts(seed):
    rng = random.Random(seed)
    notices = [t for _, t, _ in ls.TEMPLATES] + [p for _, p in ls.PHRASES]
    out = []
    for k in range(60):
        parts = []
        for _ in range(rng.randrange(4)):
            w = rng.choice(notices).split(" ")
            for _ in range(rng.randrange(4)):  # words lost, put in or swapped
                at = rng.randrange(len(w))
                w[at:at + rng.randrange(2)] = [rng.choice(["", "extra", "the license", "w " * 9])] * rng.randrange(2)
            parts += [" ".join(w), rng.choice(["", "\n", "text between them. ", "é " * rng.randrange(12)])]
        rng.shuffle(parts)
        out.append("".join(rng.choice([p, p.upper()]) for p in parts))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_licences_equal_brute_force(spark, seed):
    texts = licence_texts(seed) + ["", None, "CC BY" * 3, "cc-by CC_BY cc by", " ".join(["all rights reserved"] * 700), "word " * 300_000 + "MIT License"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in ls.scan_licenses(frame).collect():
        matches = sorted((m.word, m.label, m.share) for m in r.matches)
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, matches)
        assert got == licences(texts[r.doc_id]), texts[r.doc_id]


def test_licences_of_odd_tables(spark):
    frame = spark.createDataFrame([(None, "MIT License"), (1, None), (1, None), (2, "")], "doc_id long, text string")
    out = ls.scan_licenses(frame.selectExpr("*", "1 as n_words", "2 as labels", "3 as id", "4 as matches"))
    assert sorted((str(r.doc_id), ",".join(r.labels), r.first_word) for r in out.collect()) == [
        ("1", "", None), ("1", "", None), ("2", "", None), ("None", "mit", None)]
    assert ls.scan_licenses(frame.limit(0)).collect() == []
    with pytest.raises(ValueError, match="does not stand"):
        ls.scan_licenses(frame, templates=[("x", "some words", ("other words",))])


def test_rarity_counts_all_documents(spark):
    index = ls.Index([], [("a", "red fish")])
    frame = spark.createDataFrame([("red red fish",), ("RED",), (None,), ("blue",)], "text string").repartition(3)
    got = dict(zip(index.vocabulary, ls.word_rarity(frame, "text", index)))
    assert got == pytest.approx({"red": math.log(5 / 3), "fish": math.log(5 / 2)})


def audit(rows, top=200, least=3):
    """rows: (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(str.maketrans(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) for _, _, t in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for (lang, source, _), ts in zip(rows, terms):
        docs[lang].update(set(ts))
        counts[lang, source].update(ts)
    kept = {lang: [t for t, n in c.items() if n >= least] for lang, c in docs.items()}
    out = []

    def p(count, total, v):
        return 1 + 1_000_000_000 * (count + 1) // (total + v)

    for lang, ts in kept.items():
        v, mine = len(ts), {s: {t: counts[lang, s][t] for t in ts} for g, s in counts if g == lang}
        ps = {s: {t: p(n, sum(c.values()), v) for t, n in c.items()} for s, c in mine.items()}
        whole = {t: sum(c[t] for c in mine.values()) for t in ts}
        q = {t: p(n, sum(whole.values()), v) for t, n in whole.items()}
        for s in mine:
            peers = [(o, sum((ps[s][t] - ps[o][t]) ** 2 // ps[o][t] for t in ts)) for o in mine if o != s]
            lead = [(t, (ps[s][t] - q[t]) ** 2 // q[t]) for t in ts if mine[s][t] and ps[s][t] > q[t]]
            for part, found in (("pair", peers), ("term", lead)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, x, f, k) for k, (x, f) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def uneven(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{chr(97 + k % 26)}{'abcé'[k % 4]}{'x' * (k % 7)}" for k in range(120)] + ["Über", "日本", "𝒳", "A_b", "don't"]
    rows = []
    for k in range(n):
        source = "big" if k % 3 == 0 else f"s{rng.randrange(6)}"
        text = " ".join(rng.choice(words[: 20 + 15 * (k % 8)]) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(["en", "de", "xx"]) if k % 5 else "en", source, text))
    return rows + [("zz", "alone", "one two"), ("zz", "other", ""), (None, None, "a b c"), (None, "s", None), ("", "", "a b c"), ("", "s", "a"), ("en", "none", "123 456")]


TEXTS = "lang string, source string, text string"


@pytest.mark.parametrize("seed, top, pairs", [(1, 200, 1 << 20), (2, 5, 50)])
def test_audit_equals_brute_force(spark, seed, top, pairs, monkeypatch):
    monkeypatch.setattr(dv, "MOST_PAIRS", pairs)
    rows = uneven(seed)
    got = dv.audit_sources(spark.createDataFrame(rows, TEXTS).repartition(4), most_terms=top)
    assert sorted(tuple(r) for r in got.collect()) == audit(rows, top)


def test_audit_of_odd_tables(spark):
    rows = uneven(3, 30) * 2
    frame = spark.createDataFrame(rows, TEXTS)
    extra = frame.selectExpr("*", "1 as bucket", "2 as term", "3 as n", "4 as bytes", "5 as total", "6 as rank", "7 as value")
    assert sorted(tuple(r) for r in dv.audit_sources(extra).collect()) == audit(rows)
    assert dv.audit_sources(frame.limit(0)).collect() == []
    few = [("en", "a", "x y"), ("en", "b", "z")]
    assert sorted(tuple(r) for r in dv.audit_sources(spark.createDataFrame(few, TEXTS)).collect()) == audit(few) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_audit_of_a_very_long_text(spark):
    rows = [("en", "a", "alpha beta " * 400_000), ("en", "a", "alpha"), ("en", "b", "alpha beta"), ("en", "b", "beta x")]
    assert sorted(tuple(r) for r in dv.audit_sources(spark.createDataFrame(rows, TEXTS)).collect()) == audit(rows)


def test_accumulators_are_handed_on_when_many_are_held():
    dense = dv._Language("en", 2, [{"source": s, "total": 4} for s in "abc"], 1)
    block = dv._unpack(dv._pack(
        term=dv._coded(dv.pa.array(["t", "u"], dv.pa.large_string()), np.array([0, 0, 1, 1])),
        source=dv._coded(dv.pa.array(list("abc"), dv.pa.large_string()), np.array([0, 1, 1, 2])), n=dv.pa.array([4, 3, 1, 4])))
    dense.meet(block)
    once = [r for b in dense.results() for r in b.to_pylist() if r["part"] == "pair"]
    dense.meet(block)
    dense.meet(block)
    twice = [r for b in dense.results() for r in b.to_pylist() if r["part"] == "pair"]
    assert [2 * r["value"] for r in once] == [r["value"] for r in twice] and dense.held() == 0


def test_long_division_is_exact():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.randrange(1, 10 ** rng.randrange(1, 15) + 1)
        count = rng.randrange(total)
        assert int(dv.probability(np.array([count]), total)[0]) == 1 + 1_000_000_000 * (count + 1) // total
