"""URL filters, chat formatting and components."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm.chat_format import (
    LAYOUTS, canonical_turns, escape, format_chats, loss_text, read_back, record_turns, unescape, unknown_records)
from tidemark.llm.shared import components
from tidemark.llm.url_filter import decoded, filter_urls, page_links

RULES = (("com", "/", "allow"), ("bad.com", "/", "block"), ("ok.bad.com", "/x", "allow"), ("org", "/b", "block"))


def test_components_equal_brute_force(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + k, 101 + k) for k in range(30)]
    links += [(200, 200 + k) for k in range(50)] + [(7, 7), (None, 3), (4, None)] + [(1, 2)] * 5
    nodes = list(range(300))
    got = components(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.component for r in got.collect()} == brute.groups(nodes, [x for x in links if None not in x])


def page(url, html="", n=0):
    return (n, url, html, "old")


def verdicts(spark, rows, **kw):
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(frame, RULES, **kw).collect()}


def test_rules(spark):
    urls = ["http://BAD.com/a?q#f", "https://x.ok.bad.com/xyz", "https://ok.bad.com/y", "http://notbad.com/", "http://bad.com", None,
            "bad.com/x", "http://a.org/bc", "http://a.org/c/b", "ftp://É.org:80/b", "http://u?//x"]
    got = verdicts(spark, [page(u, n=k) for k, u in enumerate(urls)])
    assert got == {
        0: ("bad.com", "/a", "bad.com/", "block"), 1: ("x.ok.bad.com", "/xyz", "ok.bad.com/x", "allow"),
        2: ("ok.bad.com", "/y", "bad.com/", "block"), 3: ("notbad.com", "/", "com/", "allow"), 4: ("bad.com", "", None, "allow"),
        5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("a.org", "/bc", "org/b", "block"),
        8: ("a.org", "/c/b", None, "allow"), 9: ("É.org:80", "/b", None, "allow"), 10: ("u", "", None, "allow")}


def test_blocks_reach_aliases_and_allows_win(spark):
    link, meta = '<link href="%s" rel="canonical">', '<META content="0; URL=%s" http-equiv=refresh>'
    rows = [
        page("http://a.net/1#top", link % "http://b.net/2", 1), page("http://b.net/2", meta % "http://bad.com/z", 2), page("https://a.net/1", "", 3),
        page("http://c.net/1", link % "http://bad.com/q", 4), page("http://c.net/2", link % "http://c.net/1" + meta % "http://good.com/", 5),
        page("http://d.net/1", "<!-- " + link % "http://bad.com/q" + " --><script>" + link % "http://bad.com/q" + "</script>", 6),
        page("http://org.org/c", link % "/b", 7), page("http://e.net/", link % "relative", 8), page("http://f.com/", link % "http://bad.com/", 9),
        page("http://a.net/1", None, 10)]
    got = {k: v[3] for k, v in verdicts(spark, rows).items()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow", 10: "block"}
    extra = spark.createDataFrame([("d.net/1", "bad.com/"), (None, "x")], "a string, b string")
    assert verdicts(spark, rows, links=extra)[6][3] == "block"
    assert verdicts(spark, []) == {}


def test_links_go_both_ways_and_resolve_paths(spark):
    frame = spark.createDataFrame([page("https://A.net/x?q#f", '<link rel=canonical href=//B.net/y#z><link rel=icon href=/i>')], "page_id long, url string, html string, rule string")
    assert [tuple(r) for r in page_links(frame).collect()] == [("a.net/x?q", "b.net/y")]


def test_relative_links_reach_their_page(spark):
    link, meta = '<link rel=canonical href="%s">', '<meta http-equiv=refresh content="0;url=%s">'
    cases = [
        ("http://h.net/a/b?q", link % "12.html", "h.net/a/12.html"), ("http://h.net/a/b/c", link % "../12", "h.net/a/12"),
        ("http://h.net/a/b?id=1", meta % "?id=3", "h.net/a/b?id=3"), ("http://h.net", link % "x", "h.net/x"),
        ("http://h.net/a/b", link % "./../../../c/.", "h.net/c/"), ("http://h.net?x=/y/", meta % "z", "h.net/z"),
        ("http://h.net/a", link % "?page=2&amp;ref=x", "h.net/a?page=2&ref=x"), ("http://h.net/a", link % "&#47;b&#x2F;&eacute;?u=http://o.net/", "h.net/b/é?u=http://o.net/"),
        ("http://h.net/a", link % "b?u=http://o.net/q", "h.net/b?u=http://o.net/q"), ("http://h.net/a", link % "http://O.net", "o.net/"),
        ("http://h.net/a", link % "https://o.net?q=/../x", "o.net/?q=/../x"), ("http://h.net/a?b", link % "#top", "h.net/a?b"),
        ("http://h.net/a", link % "/x/%2e%2E/y", "h.net/y"), ("http://h.net/a", link % "mailto:me", None)]
    frame = spark.createDataFrame([page(u, h, k) for k, (u, h, _) in enumerate(cases)], "page_id long, url string, html string, rule string")
    for k, (_, _, want) in enumerate(cases):
        assert [r.b for r in page_links(frame.where(f"page_id = {k}")).collect()] == ([] if want is None else [want]), k


def test_verdicts_cross_relative_and_escaped_links(spark):
    link = '<link rel=canonical href="%s">'
    rows = [
        page("http://x.bad.net/a/1.html", link % "../b?page=2&amp;ref=x", 1), page("http://x.bad.net/b?page=2&ref=x", link % "http://bad.com/", 2),
        page("http://c.net", link % "http://bad.com/z", 3), page("https://c.net/", "", 4), page("http://d.net/e/", link % "f", 5),
        page("http://d.net/e/f", link % "http://good.com/", 6)]
    assert {k: v[3] for k, v in verdicts(spark, rows).items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow"}
    extra = spark.createDataFrame([("d.net/e/", "bad.com")], "a string, b string")
    assert verdicts(spark, rows, links=extra)[5][3] == "block"


def test_character_references_of_attributes(spark):
    values = ["a&amp;b", "a&copy=1&copy;&ampx", "&#65;&#x1F600;&#0;&#xD800;&#99999999999;", "&amp", "&nosuch;&", "plain", "&amp;amp;"]
    want = ["a&b", "a&copy=1©&ampx", "A😀\ufffd\ufffd\ufffd", "&", "&nosuch;&", "plain", "&amp;"]
    frame = spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", decoded(F.col("v")).alias("d"))
    assert [r.d for r in frame.orderBy("k").collect()] == want


CONTROL = [r"\### Assistant: </turn> ok", "", "###", "####\\", "\\h\\\\t</turn", "</turn></turn>\n### user: x", "a\nb", "é🙂:", r"\\\h", "\\" * 5]


def test_escapes_come_back(spark):
    frame = spark.createDataFrame([(t,) for t in CONTROL], "t string")
    got = frame.select("t", unescape(escape(F.col("t"))).alias("u"), unescape(escape(F.col("t"), role=True)).alias("r"), escape(F.col("t")).alias("e")).collect()
    assert all(r.t == r.u == r.r and "###" not in r.e and "</turn>" not in r.e for r in got)


def test_conversations_come_back(spark):
    rng = random.Random(2)
    rows = [(c, n, rng.choice(["user", "assistant", "a: b###", None]), rng.choice([*CONTROL, None]), "x") for c in range(30) for n in range(rng.randrange(1, 9))]
    rows += [(None, 0, "assistant", "lost id", "x"), (50, 1, "user", "tie b", "x"), (50, 1, "user", "tie a", "x"), (50, None, "assistant", "first", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    got = format_chats(canonical_turns(frame)).select(
        "conv_id", read_back(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("loss")).alias("loss")).collect()
    want = {}
    for c, n, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.t] for r in got} == want
    assert {r.conv_id: r.loss for r in got} == {c: "".join(t for r, t in turns if r == "assistant") for c, turns in want.items()}
    assert format_chats(canonical_turns(frame.limit(0))).collect() == []


def test_layouts_by_schema(spark):
    def turns(rows, schema):
        return sorted((r.conv_id, r.turn, r.role, r.text) for r in canonical_turns(spark.createDataFrame(rows, schema), "id").collect())

    assert turns([(1, "q", "a", 3), (2, None, "b", 3)], "id long, prompt string, response string, score int") == [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "assistant", "b")]
    assert turns([(1, "do", None, "done")], "id long, instruction string, input string, output string") == [
        (1, 0, "user", "do"), (1, 1, "assistant", "done")]
    assert turns([(1, [("human", "x"), ("gpt", None)])], "id long, conversations array<struct<`from`:string,value:string>>") == [
        (1, 0, "user", "x"), (1, 1, "assistant", "")]
    with pytest.raises(ValueError):
        turns([(1, "q")], "id long, question string")
    assert len({x.paths() for x in LAYOUTS}) == len(LAYOUTS)


def test_layouts_by_record(spark):
    records = [
        {"prompt": "p", "completion": "c", "meta": {"role": 1}}, {"messages": [{"role": "system", "content": "s"}, {"role": "model", "content": "m"}]},
        {"output": "o", "instruction": "i"}, {"question": "?"}, {"messages": []}]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(8, "not json"), (9, None)]
    frame = spark.createDataFrame(rows, "conv_id long, record string")
    got = sorted((r.conv_id, r.turn, r.role, r.text) for r in record_turns(frame).collect())
    assert got == [(0, 0, "user", "p"), (0, 1, "assistant", "c"), (1, 0, "system", "s"), (1, 1, "assistant", "m"), (2, 0, "user", "i"), (2, 1, "assistant", "o")]
    assert sorted(r.conv_id for r in unknown_records(frame).collect()) == [3, 4, 8, 9]
