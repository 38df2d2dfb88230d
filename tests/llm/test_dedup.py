"""Suffix, chunk and line deduplication and the Jaccard join against plain versions."""

import random

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm.chunk_dedup import GEAR, WINDOW, chunk_ends, dedup_chunks, gear
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm import line_dedup, shared
from tidemark.llm.line_dedup import dedup_lines, edit_distance, edit_distances, few_edits
from tidemark.llm.suffix_dedup import dedup_strings
from tidemark.llm.textbytes import Texts

SCHEMA = "doc_id long, text string"


def words(rng, n, size=9):
    return " ".join("".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, size))) for _ in range(n))


def corpus(seed, n=40):
    """Texts with copies, near copies, shared passages, periods, and odd rows."""
    rng = random.Random(seed)
    shared = [words(rng, 40) for _ in range(3)]
    texts = []
    for k in range(n):
        parts = [words(rng, rng.randrange(1, 40)) for _ in range(rng.randrange(1, 4))]
        if k % 2:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(shared))
        text = "\n".join(parts)
        if texts and k % 5 == 0:
            text = rng.choice(texts)
        if texts and k % 7 == 0:
            w = (rng.choice(texts) or "").split(" ")
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        texts.append(text)
    texts += ["ab" * 300, "a" * 250, "x" + "a" * 150, "", "A", shared[0] + shared[0], "\n \n", "q\0" * 120]
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, many", [(1, 64), (2, 1), (3, 2)])
def test_strings_equal_brute_force(spark, seed, many):
    rows = corpus(seed)
    got = dedup_strings(spark.createDataFrame(rows, SCHEMA).repartition(5), many_runs=many).collect()
    want = brute.strings([(i, t.encode()) for i, t in rows])
    assert {r.doc_id: (bytes(r.kept), r.n_removed, r.n_spans) for r in got} == dict(enumerate(want))


def test_strings_of_odd_rows(spark):
    one = "abcdefghij" * 11 + "end"
    rows = [(1, one), (1, one), (2, None), (None, one), (3, "short"), (3, one + "more")]
    frame = spark.createDataFrame([(i, t, 0, "g") for i, t in rows], "doc_id long, text string, row int, bucket string")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in dedup_strings(frame).collect()), key=str)
    # The null id comes first and keeps its text, but for what repeats inside it.
    inside = brute.strings([(0, one.encode())])[0][1]
    assert got == sorted([
        (1, 113, 113), (1, 113, 113), (2, 0, 0), (None, 113, inside), (3, 5, 0), (3, 117, 113)], key=str)
    assert dedup_strings(frame.limit(0)).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(9)
    part = words(rng, 30_000)
    got = dedup_strings(spark.createDataFrame([(1, part + part), (2, part)], SCHEMA)).collect()
    size = len(part.encode())
    assert {r.doc_id: r.n_removed for r in got} == {1: size, 2: size}


def test_gear_hash_is_a_plain_rolling_hash():
    data = bytes(random.Random(1).randrange(256) for _ in range(200))
    import numpy as np

    rolled, h = [], 0
    for k, byte in enumerate(data):
        h = sum(int(GEAR[data[j]]) << (k - j) for j in range(max(0, k - WINDOW + 1), k + 1)) & 0xFFFFFFFF
        rolled.append(h)
    assert gear(np.frombuffer(data, dtype=np.uint8)).tolist() == rolled


def test_chunks_find_moved_passages_and_leave_the_rest(spark):
    rng = random.Random(4)
    passages = [words(rng, 60) for _ in range(10)]
    rows = [(k, f"{words(rng, 80)} {passages[k % 10]} {words(rng, 50)}") for k in range(30)]
    rows += [(100, None), (101, ""), (102, words(rng, 70))]
    out = {r.doc_id: r for r in dedup_chunks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [k for k in range(30) if out[k].n_removed] == list(range(10, 30))
    for k in range(10, 30):
        assert out[k].n_removed <= len(passages[k % 10].encode()) + 2
        assert out[k].n_bytes == out[k].n_removed + len(out[k].kept)
    assert all(out[k].n_removed == 0 for k in (100, 101, 102))
    copies = dedup_chunks(spark.createDataFrame([(1, rows[0][1]), (2, rows[0][1])], SCHEMA)).collect()
    assert {r.doc_id: len(r.kept) for r in copies}[2] == 0
    assert dedup_chunks(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_passage_of_51_words_is_missed(spark):
    rng = random.Random(11)
    passages = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 10))) for _ in range(51)) for _ in range(300)]
    rows = [(k, f"{words(rng, 30)} {passages[k % 300]} {words(rng, 30)}") for k in range(600)]
    out = {r.doc_id: r.n_removed for r in dedup_chunks(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert all(out[k] == 0 for k in range(300))
    shares = [out[k] / len(passages[k % 300]) for k in range(300, 600)]
    print("missed", sum(s == 0 for s in shares), "mean share removed", sum(shares) / 300, "least", min(shares))
    assert min(shares) > 0.5 and sum(shares) / 300 > 0.85


def test_short_copies_go_and_phrases_side_by_side_stay(spark):
    rng = random.Random(12)
    phrases = [words(rng, 6)[:40] for _ in range(8)]
    rows = [(k, "a short text" if k % 2 else f"text {k // 6}") for k in range(12)]
    rows += [(20 + k, f"{words(rng, 30)} {p} {words(rng, 30)}") for k, p in enumerate(phrases)] + [(50, " ".join(phrases))]
    rows.append((60, "abcdefghijklmnopqrstuvwxyz0123456789" * 10))
    out = {r.doc_id: r for r in dedup_chunks(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [k for k in range(12) if out[k].n_removed == 0] == [0, 1, 6]
    assert all(len(out[k].kept) == 0 for k in range(12) if k not in (0, 1, 6))
    assert all(out[k].n_removed == 0 for k in (*range(20, 28), 50))
    assert len(out[60].kept) >= 64


def test_chunk_ends_cover_every_text():
    import numpy as np

    data = b"a" * 9000 + b"hello world"
    texts = Texts(np.frombuffer(data, dtype=np.uint8), np.array([0, 0, 9000, 9011]), 0)
    ends = chunk_ends(texts).tolist()
    assert ends[-1] == 9011 and 9000 in ends and max(np.diff([0, *ends])) <= 4096


@pytest.mark.parametrize("block", [2, 128])
def test_jaccard_equals_brute_force(spark, block):
    rows = corpus(5, 60)
    rng = random.Random(6)
    base = words(rng, 80).split(" ")
    for k in range(30):  # a group of near copies
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = f"new{k}"
        rows.append((200 + k, " ".join(w)))
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(4), block_nodes=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard_groups(rows)


def test_jaccard_of_odd_rows(spark):
    one = words(random.Random(1), 30)
    rows = [(5, one, 1), (5, one, 2), (3, one, 3), (None, one, 4), (7, None, 5), (8, "", 6), (9, "a b", 7), (2, "A  b", 8)]
    got = jaccard_components(spark.createDataFrame(rows, SCHEMA + ", node int")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == sorted([
        ("5", 3), ("5", 3), ("3", 3), ("None", 3), ("7", 7), ("8", 8), ("9", 2), ("2", 2)])
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def fuzzy_corpus(seed):
    rng = random.Random(seed)
    lines = [words(rng, rng.randrange(8, 60)) for _ in range(25)]
    rows = []
    for k in range(30):
        picked = []
        for line in rng.sample(lines, 3):
            w = line.split(" ")
            if rng.random() < 0.6:  # copies of a line differ in two words at most
                w[rng.randrange(len(w))] = f"w{k}"
            if rng.random() < 0.2:
                rng.shuffle(w)
            picked.append(" ".join(w).upper() if rng.random() < 0.2 else " ".join(w) + rng.choice([".", ",", " -", "!!"]))
        rows.append((k, "\n".join([*picked, "", "--"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_equal_brute_force(spark, seed):
    rows = fuzzy_corpus(seed)
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA + ", line string, n_lines int").repartition(3)
    got = dedup_lines(frame).collect()
    ranked = sorted(rows)
    assert [r.text for r in sorted(got)] == brute.fuzzy_lines(ranked)
    assert {r.line for r in got} == {"x"}
    assert sum(r.n_removed for r in got) == sum(t.count("\n") for _, t in rows) - sum(r.text.count("\n") for r in got if r.text)


def test_lines_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "same line here\nsame line here"), (4, "SAME line, here!"), (4, "SAME line, here!"), (5, "other\n\n--")]
    got = sorted((r.doc_id, r.text or "", r.n_removed) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "same line here", 1), (4, "", 1), (4, "", 1), (5, "other\n\n--", 0)]
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).collect() == []


def test_lines_of_equal_words_in_another_order_are_told_apart(spark):
    rng = random.Random(3)
    base = [f"{c}{c}{c}" for c in "abcdefghijklmnopqrst"]
    rows = []
    for k in range(4):
        rng.shuffle(base)
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(base[:-2] + base[:-3:-1]))]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r.text for r in sorted(got)] == brute.fuzzy_lines(sorted(rows))


def pairs_of_lines(seed, changed):
    """Two texts for each length: a line, and the same with words replaced; kept if an edit similarity of 0.8 is left."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 10))) for _ in range(3000)]
    out = []
    for n in (8, 10, 12, 20, 40, 60, 100) * 12:
        w = [rng.choice(vocabulary) for _ in range(n)]
        v = list(w)
        for k in rng.sample(range(n), changed):
            v[k] = rng.choice(vocabulary)
        a, b = " ".join(w), " ".join(v)
        if a != b and brute.edit_distance(a, b) <= 0.2 * max(len(a), len(b)):
            out.append((a, b))
    return out


@pytest.mark.parametrize("changed", [1, 2])
def test_changed_words_are_found(spark, changed):
    """Recall against edit similarity alone: nine of ten at least; here all."""
    pairs = pairs_of_lines(changed, changed)
    rows = [(2 * k + i, t) for k, pair in enumerate(pairs) for i, t in enumerate(pair)]
    got = {r.doc_id: r.n_removed for r in dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert len(pairs) > 50 and all(got[2 * k] == 0 for k in range(len(pairs)))
    assert sum(got[2 * k + 1] for k in range(len(pairs))) >= 0.9 * len(pairs)


@pytest.mark.parametrize("grid", [6, 1 << 12])
def test_a_large_group_is_cut_without_losing_links(spark, grid, monkeypatch):
    """Many near copies of one line and many unlike lines share their first words."""
    monkeypatch.setattr(line_dedup, "GRID", grid)
    rng = random.Random(8)
    start, body = "all of them begin like this", words(rng, 20)
    rows = [(k, f"{start} {body} {words(rng, 1)}") for k in range(25)] + [(100 + k, f"{start} {words(rng, 20)}") for k in range(25)]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert [r.text for r in sorted(got)] == brute.fuzzy_lines(rows)
    assert sum(r.n_removed for r in got) == 24


def test_links_leave_a_task_as_a_forest(spark):
    """A thousand near copies: no more edges than lines for each group."""
    rng = random.Random(9)
    body = words(rng, 30)
    rows = [(k, f"{body} {k} x{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzabcd'[k // 100]}") for k in range(1000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    lines = line_dedup.line_table(docs, "doc_id", "text")
    groups = line_dedup.near_groups(lines).persist()
    edges = line_dedup.verified_edges(groups, line_dedup.line_texts(docs, "text", lines.select("line", "raw").distinct()))
    assert groups.count() <= 12 * 1000 and edges.count() <= groups.select("grp").distinct().count() * 999
    assert sum(r.n_removed for r in dedup_lines(docs).collect()) == 999


def test_lines_that_stay_anyway_are_not_grouped(spark, monkeypatch):
    """Only lines that stand twice or are linked are grouped and shuffled once more."""
    tables, rng = {}, random.Random(10)

    def written(df, name):
        tables[name] = out = shared.written(df, name)
        return out

    monkeypatch.setattr(line_dedup, "written", written)
    body, again = words(rng, 30), words(rng, 12)
    rows = [(k, f"{words(rng, 20)}\n{words(rng, 15)}") for k in range(50)]
    rows += [(50, f"{body} one\n{again}"), (51, f"{again}\n{body} two"), (51, f"{again}\n{body} two"), (None, again)]
    got = {(r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    first = (None, again)  # a missing id comes first
    assert got == {*rows[:50], (50, f"{body} one"), (51, ""), first}
    assert tables["distinct"].count() == 103 and tables["groups"].count() == 3


def test_few_rows_reach_the_driver_however_many_lines_are_wanted(spark, monkeypatch):
    frame, got = type(spark.range(0)), []
    real = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: got.append(real(self)) or got[-1])
    odd = [0, -1, 1, line_dedup.SLOTS - 1, -line_dedup.SLOTS, (1 << 63) - 1, -1 << 63]
    many = spark.range(100_000).selectExpr("id as line", "xxhash64(id) as raw").union(spark.createDataFrame(list(enumerate(odd)), "line long, raw long"))
    docs = spark.createDataFrame([(1, "Ab 12\n- -\ncd")], SCHEMA)
    raw = line_dedup.line_table(docs, "doc_id", "text").select("line", "raw")
    found = line_dedup.line_texts(docs, "text", many.union(raw))
    assert sum(map(len, got)) <= 1000
    assert sorted(r.normal for r in real(found)) == ["ab 00", "cd"]
    marked = np.flatnonzero(np.unpackbits(line_dedup.slot_bits(many), bitorder="little"))
    assert marked.tolist() == sorted({r.raw % line_dedup.SLOTS for r in real(many)})
    assert not line_dedup.slot_bits(many.where("false")).any()


def test_edges_of_many_groups_leave_together():
    import pyarrow as pa

    sets = [(g, 2 * g + k, 0, text) for g in range(1000) for k, text in enumerate(["one two three four five", "one two three four fine"])]
    batch = pa.RecordBatch.from_pylist([dict(zip("glst", row)) for row in sets])
    got = list(line_dedup._edge_batches(iter([batch.slice(0, 777), batch.slice(777)])))
    assert len(got) == 1 and [tuple(r.values()) for r in got[0].to_pylist()] == [(2 * g, 2 * g + 1) for g in range(1000)]
    assert [b.num_rows for b in line_dedup._edge_batches(iter([]))] == [0]


def test_few_edits_and_very_long_lines(spark):
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(40)))
        b = list(a)
        for _ in range(rng.randrange(8)):
            b[rng.randrange(len(b) + 1):][:1] = []
            b.insert(rng.randrange(len(b) + 1), rng.choice("abc"))
        most, d = rng.randrange(12), brute.edit_distance(a, "".join(b))
        assert few_edits(a, "".join(b), most) == (d if d <= most else None)
    long = " ".join(words(rng, 1) for _ in range(60_000))
    other = long.replace("a", "b", 40)
    got = dedup_lines(spark.createDataFrame([(1, long), (2, other), (3, words(rng, 9) + "\n" + long)], SCHEMA)).collect()
    assert [r.n_removed for r in sorted(got)] == [0, 1, 1]


@pytest.mark.parametrize("name", ["_key", "_h", "_places", "_doc", "KEY", "line", "sim", "raw", "blocks", "grp", "first", "h", "n_lines"])
def test_line_dedup_keeps_columns_of_any_name(spark, name):
    rows = [(1, "one line of text\none line of text", "kept"), (2, "another", None)]
    frame = spark.createDataFrame(rows, SCHEMA + ", other string").withColumnRenamed("other", name)
    got = sorted(dedup_lines(frame).collect())
    assert [r.n_removed for r in got] == [1, 0]
    if name != "n_lines":
        assert [r[name] for r in got] == ["kept", None]


def test_edit_distance_equals_the_plain_table():
    rng = random.Random(5)
    for _ in range(600):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randrange(12))) for _ in range(2))
        assert edit_distance(a, b) == brute.edit_distance(a, b)
    long = "".join(rng.choice("abcdef") for _ in range(3000))
    assert edit_distance("x" + long + "y", long[1:] + "z") == 3


def test_a_distance_that_must_be_too_large_ends_early():
    rng = random.Random(31)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(2))
        true = edit_distance(a, b)
        for most in range(8):
            got = edit_distance(a, b, until=most)
            assert got == true if true <= most else most < got <= true


def test_distances_side_by_side_equal_the_plain_table():
    rng = random.Random(32)
    for _ in range(150):
        letters = rng.choice(["ab", "abcé ", "abcdef\0𝄞"])
        text, *others = ["".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(rng.randrange(2, 9))]
        others += [text[rng.randrange(5):] + "b", text, ""]
        true = [brute.edit_distance(text, x) for x in others]
        assert edit_distances(text, others) == true
        most = [rng.randrange(50) for _ in others]
        for got, d, m in zip(edit_distances(text, others, most), true, most):
            assert got == d if d <= m else m < got <= d


def linked_in_brute_force(held):
    """The least number that each line of a group is connected with."""
    part = {line: line for line, _, _ in held}
    for a, _, x in held:
        for b, _, y in held:
            if a < b and part[a] != part[b] and brute.edit_distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                low, high = sorted((part[a], part[b]))
                part = {k: low if v == high else v for k, v in part.items()}
    return part


@pytest.mark.parametrize("side_by_side", [1 << 18, 300])
def test_groups_of_copies_and_unlike_lines_equal_brute_force(side_by_side, monkeypatch):
    monkeypatch.setattr(line_dedup, "SIDE_BY_SIDE", side_by_side)
    monkeypatch.setattr(line_dedup, "STRIDE", 7)
    rng = random.Random(33)
    for _ in range(6):
        shared, bodies = words(rng, 8), [words(rng, 8) for _ in range(4)]
        held = []
        for k in range(30):
            w = (rng.choice(bodies) if rng.random() < 0.6 else words(rng, 8)).split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = words(rng, 1)
            held.append((k, 0, " ".join(w) + " " + shared))
        edges = line_dedup._edges(list(held))
        part = {k: k for k, _, _ in held}
        for a, b in edges:
            low, high = sorted((part[a], part[b]))
            assert low != high
            part = {k: low if v == high else v for k, v in part.items()}
        assert part == linked_in_brute_force(held)


def test_unlike_lines_of_a_group_are_not_compared_one_by_one(monkeypatch):
    """Lines that share half their words: no table for each pair of them."""
    calls = []
    monkeypatch.setattr(line_dedup, "edit_distance", lambda *a, f=edit_distance, **b: calls.append(1) or f(*a, **b))
    rng = random.Random(34)
    shared = words(rng, 20)
    lines = [(k, 0, f"{words(rng, 20)} {shared}") for k in range(60)]
    assert line_dedup._edges(lines) == [] and len(calls) < 60
