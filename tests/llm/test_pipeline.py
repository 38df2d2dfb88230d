"""The pipeline against plain versions of its stages, and the registered queries."""

import os
import random

import pytest
import tokenizers

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from check import compare, duck
from tests.llm import brute
from tests.llm.test_dedup import words
from tidemark.llm.queries import ORACLES, QUERIES
from tidemark.llm.shared import vocabulary_path

SF = "/root/testdata/sf0.001"


def documents(items):
    rng = random.Random(12)
    rows = [words(rng, 60) for _ in range(12)]
    w = rows[0].split(" ")
    w[50:52] = ["changed", "words"]
    rows += [" ".join(w), rows[1], "too short", "", None, "SHOUT!! " * 40, words(rng, 30) + "\n" + rows[2]]
    rows.append(words(rng, 25) + " " + items[0] + " " + words(rng, 25))
    return [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(rows)]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(13)
    items = [words(rng, 14), "ab cd"]
    rows = documents(items)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [(i, t) for i, t, *_ in rows if brute.quality(t or "")[6]]
    kept = [(i, new) for (i, t), new in zip(kept, brute.fuzzy_lines([(i, t or "") for i, t in kept]))
            if new == (t or "") or brute.normal(new)]
    assert not {12, 13} & dict(kept).keys()  # a near copy and a copy have no line of their own
    group = brute.jaccard_groups(kept)
    kept = [(i, t) for i, t in kept if group[i][1] == i]
    kept = [(i, t) for i, t in kept if not brute.contamination(t, list(enumerate(items)))[1]]
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in kept}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(want) == len(rows) - 7  # four rejected, a copy and a near copy without a line of their own, a benchmark passage
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(x) for i, x in want.items()}
    assert {r.doc_id: bytes(r.ids) for r in got} == {i: b"".join(n.to_bytes(4, "little") for n in x) for i, x in want.items()}
    assert {r.doc_id: r.decoded_sha256 for r in got} == {
        i: brute.sha(library.decode(x, skip_special_tokens=False).encode()) for i, x in want.items()}


def test_stages_of_empty_tables(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], columns)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.collect() == []
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = out


def test_documents_that_line_dedup_empties_go(spark):
    line = "one line that two documents have in common"
    rows = [(1, line), (2, f"{line}\n--"), (3, f"{line}\nand one of its own"), (4, ""), (5, None), (6, "--")]
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.STAGES[1][1](spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str) == [
        (1, line, 1), (3, "and one of its own", 18), (4, "", 1), (5, None, 1), (6, "--", 1)]


def test_the_driver_gets_few_rows_from_line_dedup(spark, monkeypatch):
    """A thousand lines and a near copy of each."""
    rng = random.Random(22)
    lines = [words(rng, 12) for _ in range(1000)]
    rows = [(k, f"{t}{end}") for k, t in enumerate(lines) for end in ("", " end")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    frame, got = type(docs), []
    real = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: got.append(len(real(self))) or real(self))
    kept = corpus_pipeline.STAGES[1][1](spark, docs, "")
    assert real(kept.selectExpr("count(*) as n", "count(distinct doc_id) as d"))[0] == (1000, 1000)
    assert 0 < sum(got) <= 200


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    rng = random.Random(21)
    base = [words(rng, 60) for _ in range(4)]

    def near(k):
        return base[k] + " " + words(rng, 2)

    rows = [(1, near(0)), (1, near(0)), (1, near(0)), (None, near(1)), (None, near(1)), (None, base[2]), (7, base[2]), (8, near(2)),
            (None, base[3]), (None, base[3]), (1, words(rng, 60)), (None, ""), (3, ""), (3, None), (2, near(0))]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], columns).repartition(3)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.STAGES[2][1](spark, frame, "").collect()]
    assert len(got) == len(set(got)) == 8
    assert [i for i, t in got if t and t.startswith(base[0])] == [1]
    assert [i for i, t in got if t and t.startswith(base[1])] == [None]
    assert [i for i, t in got if t and t.startswith(base[2])] == [7]
    assert [i for i, t in got if t == base[3]] == [None]
    assert (1, rows[10][1]) in got and {(None, ""), (3, ""), (3, None)} <= set(got)


def test_every_operator_is_registered():
    names = queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, name):
    assert compare(spark, duck(SF), name, SF) is None
