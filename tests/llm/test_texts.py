"""Encoding, extraction, decontamination and quality rules against plain versions."""

import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
import tokenizers

from tests.llm import brute
from tidemark.llm.boosting import fit_trees
from tidemark.llm.bpe import Encoder, Vocabulary, bpe_decode, bpe_encode
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.html_extract import extract_text, node_features, parse
from tidemark.llm.quality import METRICS, RULES, Counts, judge, order_rules, quality_cascade
from tidemark.llm.shared import vocabulary_path
from tidemark.llm.stages import bpe_encoding
from tidemark.llm.textbytes import slices, sliding_min

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def library():
    made = tokenizers.Tokenizer.from_file(vocabulary_path())
    made.no_truncation()
    made.no_padding()
    return made


ODD_TEXTS = [
    "Hello World's 123 été  #$  x<|endoftext|>y ÀÉ é ok", "", " \n", "<|startoftext|><|endoftext|>", "a\x00b \x85 İ ß ſt",
    "Σας ΌΣ 'S don'T I'll we've", "<|EndOfText|> 12½²", "x </w> y​z", "日本語 ก็ हिन्दी", "a\x1cb \x1d c", "a" * 500,
    "the thee then theory " * 50, "é ẛ̣", "🙂🙃 👩‍👩‍👧",
]


def fuzz(rng, n):
    plain = ["".join(rng.choice("ab th'inéß1<|. \nQ") for _ in range(rng.randrange(80))) for _ in range(n)]
    known = [c for c in map(chr, range(32, 0x2FFF)) if unicodedata.category(c)[0] not in "C"]
    # Letters that were assigned lately may be letters in one library only, so symbols stay among old letters.
    old = [c for c in known if ord(c) < 0x530]
    return plain + ["".join(rng.choice(old) for _ in range(30)) for _ in range(n)]


def test_every_code_point_is_cut_as_the_library_cuts_it(library):
    encoder = Encoder(Vocabulary(vocabulary_path()))
    codes = [*range(0xD800), *range(0xE000, 0x110000)]
    for low in range(0, len(codes), 20_000):
        text = " ".join(f"k{chr(c)}7{chr(c)}k" for c in codes[low:low + 20_000])
        got = np.frombuffer(encoder.encode([text])[0], dtype="<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, hex(codes[low])


def test_encoding_equals_the_library(library):
    texts = ODD_TEXTS + fuzz(random.Random(3), 400)
    encoder = Encoder(Vocabulary(vocabulary_path()))
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    again = Encoder(encoder.vocabulary).encode(texts[::-1])[::-1]
    assert again == encoder.encode(texts)


def test_encoding_and_decoding_of_rows(spark, library):
    rows = [(k, t, b"x", "w") for k, t in enumerate([*ODD_TEXTS, None, "same", "same"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids binary, decoded string")
    got = bpe_decode(bpe_encode(frame, vocabulary_path()), vocabulary_path()).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe_encode(frame.limit(0), vocabulary_path()).collect() == []


def test_encoding_and_decoding_share_a_worker(spark, capsys):
    """Two steps in Python are two workers per task, which was too much memory in the pipeline."""
    rows = [(k, t, "w") for k, t in enumerate([*ODD_TEXTS, None, "same", "same"])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    apart = bpe_decode(bpe_encode(frame, vocabulary_path()), vocabulary_path()).select("doc_id", "text", "ids", "decoded")
    at_once = bpe_encode(frame, vocabulary_path(), decoded="decoded")
    assert at_once.columns == apart.columns and sorted(at_once.collect()) == sorted(apart.collect())
    stage = bpe_encoding(spark, frame, "")
    stage.explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
    want = {r.doc_id: (len(r.ids) // 4, bytes(r.ids), brute.sha(r.decoded.encode())) for r in apart.collect()}
    assert {r.doc_id: (r.n_tokens, bytes(r.ids), r.decoded_sha256) for r in stage.collect()} == want


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><div id="logo">Site name</div><div class="main-menu"><a href=/>Home</a> <a href=/b>Other</a></div></header>
<div id="cookie-notice">We use cookies to make this work.</div>%s
<div class="sidebar"><p>About me, some words.</p></div><section id="comments"><article class="comment"><p>I like this, thanks.</p></article></section>
<footer>&copy; me</footer></body>"""
PROSE = "This is a long paragraph, with many words and sentences. It goes on, and on. " * 4
ARTICLE = f"""<article><h1>My &quot;title&quot; here</h1><p><b>Bold   start<br><p>{PROSE}</p>
<div class="ad">Buy this now, really.</div><p>{PROSE}&amp; more&nbsp;text.</p><form>Search for it<input name=q></form></article>"""


def test_extraction(spark):
    body = " ".join(PROSE.split())
    want = f'My "title" here Bold start {body} {body} & more text.'
    rows = [(1, "u", PAGE % ARTICLE, "t"), (2, "u", PAGE % ARTICLE.replace("<article>", "<main>").replace("</article>", "</main>"), "t"),
            (3, "u", PAGE % ARTICLE.replace("<article>", '<div class="post-content">').replace("</article>", "</div>"), "t"),
            (4, "u", None, None), (5, None, "", "t"), (6, "u", "<<<>< <p <div", "t"), (1, "u", PAGE % ARTICLE, "t")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract_text(frame).collect()
    assert len(got) == 7
    by_id = {r.page_id: r.text for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == want
    assert by_id[4] == by_id[5] == ""
    assert extract_text(frame.limit(0)).collect() == []


def test_extraction_of_a_very_long_page(spark):
    long = "<article>" + "<p>Some words, in a sentence.</p>" * 20_000 + "</article>"
    got = extract_text(spark.createDataFrame([(1, "u", PAGE % ARTICLE), (2, "u", PAGE % long)], "page_id long, url string, html string"))
    assert {r.page_id: len(r.text) for r in got.collect()}[2] == 20_000 * len("Some words, in a sentence. ") - 1


def test_unclosed_and_deep_markup():
    assert parse("<div>" * 3000 + "x")[-1].own == 1
    assert [n.tag for n in parse("<ul><li>a<li>b</ul><p>c<p>d")] == ["#root", "ul", "li", "li", "p", "p"]
    assert sum(n.own for n in parse("a<!-- <p>hidden --><script>no</script>b<script>open")) == 2


def test_bare_text_of_the_body_is_extracted(spark):
    body = " ".join(PROSE.split())
    bare = [
        f"<html><body>{PROSE}<br>more <b>text</b></body></html>", PROSE, f"<body><nav><a href=/>Home</a> <a href=/b>Other</a></nav><div><p>{PROSE}</p></div>{PROSE}<p>{PROSE}</p>tail, of it.</body>",
        "<body>Article text<br>more</body>"]
    want = [f"{body} more text", body, f"{body} {body} {body} tail, of it.", "Article text more"]
    schema = "page_id long, url string, html string"
    for first in ([], [(-k - 1, "u", PAGE % ARTICLE) for k in range(3)]):  # with and without pages that name their article
        frame = spark.createDataFrame([*first, *((k, "u", h) for k, h in enumerate(bare))], schema).coalesce(1)
        got = {r.page_id: r.text for r in extract_text(frame).collect()}
        sure = bare[:2] if first else bare  # three copies of a page teach the trees little about mixed or tiny pages
        assert [got[k] for k in range(len(sure))] == want[:len(sure)]
    nodes = parse("one <a href=/>two</a><p>in</p> three<div>x</div>")
    assert [(n.tag, n.own, n.links, n.tags) for n in nodes] == [
        ("#root", 0, 0, 2), ("#text", 7, 3, 2), ("p", 2, 0, 1), ("#text", 5, 0, 0), ("div", 1, 0, 1)]
    assert nodes[0].children == [1, 2, 3, 4]


def test_places_among_siblings_are_the_same_at_every_size():
    for n in (10, 49, 50, 120):
        nodes = parse("".join(f"<div>{'x' * k}<p>y</p><p>z</p></div>" for k in range(n)))
        x = node_features(nodes)[nodes[0].children]
        assert np.allclose(x[:, 17], np.arange(n) / n)
        size = np.log(1 + np.arange(n) + 2)
        assert np.allclose(x[1:, 18], size[:-1]) and np.allclose(x[:-1, 19], size[1:]) and x[0, 18] == x[-1, 19] == 0


def test_raw_elements_swallow_nothing_behind_them():
    page = "<script>for(i=0;i<n;i++){} // can't</script><article><p>It's one.</p><p>It's two.</p></article>"
    assert [(n.tag, n.parts) for n in parse(page)] == [
        ("#root", []), ("article", []), ("p", [(0, "It's one.")]), ("p", [(1, "It's two.")])]
    for tag in ("option", "button", "object", "svg", "select", "template", "noscript", "datalist", "head"):
        assert [n.parts for n in parse(f"<p>one</p><{tag} x=1><p>two</p>")][1:] == [[(0, "one")], [(1, "two")]], tag
    for tag in ("script", "style", "textarea", "iframe"):
        assert [n.parts for n in parse(f"<p>one</p><{tag}><p>two</p>")][1:] == [[(0, "one")]], tag


def test_trees_learn_a_rule_and_hold_out():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    trees = fit_trees(x[:2000], y[:2000])
    assert ((trees.score(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95


def leaks(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["É", "Öl", "x"]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 9, 10, 25])))) for k in range(8)]
    items += [(8, items[2][1]), (9, None), (10, "..."), (None, "q1 q2")]
    docs = []
    for k in range(25):
        parts = [rng.choice(vocab) for _ in range(rng.randrange(0, 30))]
        if k % 3 == 0:
            parts[5:5] = rng.choice(items[:8])[1].upper().split(" ")
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(parts)))
    return docs + [(90, None), (91, ""), (91, ""), (92, "Q1! q2"), (93, " ".join(t or "" for _, t in items))], items


@pytest.mark.parametrize("seed, block", [(1, 1_000_000), (1, 7), (2, 40)])
def test_decontamination_equals_brute_force(spark, seed, block):
    docs, items = leaks(seed)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], SCHEMA + ", size int, item string").repartition(3)
    got = decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"), block=block).collect()
    named = [("" if i is None else i, t) for i, t in items]
    want = sorted((i, *map(str, brute.contamination(t, named))) for i, t in docs)
    assert sorted((r.doc_id, str(r.n_words), str(r.n_hit), str(list(r["items"]))) for r in got) == want


def test_decontamination_without_rows(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], SCHEMA)
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontaminate(docs, empty).collect()] == [(2, 0, [])]
    assert decontaminate(docs.limit(0), empty).collect() == []


def test_a_shared_span_of_the_window_is_never_missed(spark):
    rng = random.Random(8)
    item = [f"i{k}" for k in range(60)]
    docs = []
    for k in range(51):
        inside = [f"d{rng.randrange(999)}" for _ in range(20)]
        docs.append((k, " ".join([*inside, *item[k:k + 10], *inside])))
    got = decontaminate(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert all(r.n_hit == 10 for r in got.collect())


QUALITY_TEXTS = [
    "", " \t\n", "one", "word " * 30, "Good text has many different words, " + " ".join(f"plain{k % 17}x{k}" for k in range(60)),
    "A B\n" * 30 + "end", " ".join("%%%" + str(k) for k in range(40)), "STOP!! " * 5 + "NOW!! " * 30, "ab " * 10 + "cd ef gh ij " * 9,
    "é ü ß " * 12 + " ".join(f"wörd{k}" for k in range(40)), "\n".join(["same line of words"] * 9 + [f"other words {k}" for k in range(9)]),
    "x" * 3000, " ".join(f"v{k}" for k in range(20)),
]


def test_quality_equals_brute_force(spark):
    rows = [(k, t, "k") for k, t in enumerate([*QUALITY_TEXTS, *QUALITY_TEXTS[:3], None])]
    frame = spark.createDataFrame(rows, SCHEMA + ", rejected_why string")
    got = quality_cascade(frame, metrics=True).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute.quality(r.text or "")
        assert (*(r[m] for m in METRICS), r.kept) == (*want[:5], want[6]), r.text
        assert (r.rejected_by is None) == r.kept and r.rejected_why == "k"
    assert quality_cascade(frame.limit(0)).collect() == []


def test_the_order_of_rules_changes_no_verdict(spark):
    texts = next(slices(pa.array(QUALITY_TEXTS)))
    want = judge(texts, RULES) < 0
    rng = random.Random(1)
    for _ in range(5):
        assert ((judge(texts, tuple(rng.sample(RULES, len(RULES)))) < 0) == want).all()
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(QUALITY_TEXTS)], SCHEMA)
    assert set(order_rules(frame, "text")) == set(RULES)


def test_slices_hold_whole_texts():
    texts = pa.array(["abc", None, "", "é" * 10, "z"])
    for limit in (1, 5, 100):
        parts = [s.bytes_of(k).decode() for s in slices(texts, limit) for k in range(s.n)]
        assert parts == ["abc", "", "", "é" * 10, "z"]
    sliced = pa.array(["no", "a b", "c"]).slice(1)
    counts = Counts(next(slices(sliced)))
    assert counts.n_words.tolist() == [2, 1]
    assert sliding_min(np.array([5, 3, 4, 1, 2]), 3).tolist() == [3, 1, 1]


@pytest.mark.parametrize("html, text", [
    ("<p>a</p><script>x</script foo><p>b</p>", "a b"), ("<p>a</p><style>x</style/><p>b</p>", "a b"),
    ("<p>a</p><script>'</scripts>'</script\n><p>b</p>", "a b"), ("<head><title>T</title><body><p>a</p>", "a"),
    ("<title>T</title><p>a</p>", "a"), ("<p>T</p><video>no video</video><canvas>c</canvas><label>L</label><p>a</p>", "T a"),
    ("<p>one<!-->two--></p>", "onetwo-->"), ("<p>one<!--->two</p>", "onetwo"), ("<p>one<!-- x --!>two</p>", "onetwo"),
    ("<p>one<!-- <p>x</p> --> two", "one two"),
])
def test_odd_markup(html, text):
    pieces = sorted(part for node in parse(html) for part in node.parts)
    assert " ".join(t for _, t in pieces) == text
