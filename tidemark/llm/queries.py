"""The registered queries of the operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm.chat_format import canonical_turns, format_chats, loss_text, read_back, record_turns
from tidemark.llm.chunk_dedup import dedup_chunks
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.divergence import audit_sources
from tidemark.llm.hard_negatives import mine_negatives
from tidemark.llm.html_extract import extract_text
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.license_scan import PHRASE_SCORE, PHRASES, SLACK, TEMPLATES, scan_licenses, words_of
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.quality import quality_cascade
from tidemark.llm.shared import table
from tidemark.llm.stages import bpe_encoding
from tidemark.llm.suffix_dedup import dedup_strings
from tidemark.llm.url_filter import filter_urls

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_suffix_array_dedup", """
    with hexed as (select doc_id, hex(encode(coalesce(text, ''))) as t from documents),
    starts as (select doc_id, i, t[2 * i + 1:2 * i + 200] as s
      from (select doc_id, t, unnest(generate_series(0, len(t) // 2 - 100)) as i from hexed where len(t) >= 200)),
    ranked as (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from starts),
    later as (select doc_id, i from ranked where k > 1),
    marked as (select doc_id, i, i - coalesce(lag(i) over (partition by doc_id order by i), -1000) as step from later),
    spans as (
      select doc_id, min(i) as a, max(i) + 100 as b from (
        select doc_id, i, sum((step > 100)::int) over (partition by doc_id order by i) as run from marked) group by doc_id, run),
    kept as (
      select doc_id, unnest(list_zip(list_prepend(0, list(b order by a)), list_append(list(a order by a), 1000000000000))) as p
      from spans group by doc_id),
    rest as (
      select h.doc_id, string_agg(t[2 * p[1] + 1:least(2 * p[2], len(t))], '' order by p[1]) as r
      from hexed h join kept k on h.doc_id = k.doc_id group by 1),
    sums as (select doc_id, sum(b - a) as n, count(*) as c from spans group by 1)
    select h.doc_id, (len(t) // 2)::bigint as n_bytes, coalesce(n, 0)::bigint as n_removed, coalesce(c, 0)::bigint as n_spans,
      sha256(unhex(coalesce(r, t))) as kept_sha256
    from hexed h left join sums s on h.doc_id = s.doc_id left join rest r on h.doc_id = r.doc_id
""")
def op1_suffix_array_dedup(spark, sf_dir):
    out = dedup_strings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_bpe_encoding")
def op2_bpe_encoding(spark, sf_dir):
    coded = bpe_encoding(spark, table(spark, sf_dir, "documents"), sf_dir)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")


@query("op3_substring_dedup")
def op3_substring_dedup(spark, sf_dir):
    out = dedup_chunks(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_html_extraction")
def op4_html_extraction(spark, sf_dir):
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


_WORDS = r"regexp_extract_all(translate(text, " + _AZ + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op5_decontamination", rf"""
    with d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
    b as (select item_id, {_WORDS} as w from benchmark where text is not null),
    bw as (
      select distinct item_id, least(len(w), 10) as size, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
      from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) as i from b where len(w) > 0)),
    dw as (
      select doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') as g
      from (select doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) as i
            from d, (select distinct size from bw) where len(w) >= size)),
    hit as (select doc_id, i, dw.size, item_id from dw join bw on dw.g = bw.g and dw.size = bw.size),
    words as (
      select doc_id, count(distinct p) as n_hit
      from (select doc_id, unnest(generate_series(i, i + size - 1)) as p from hit) group by 1),
    named as (
      select doc_id, count(*) as n_items, string_agg(item_id::varchar, ',' order by item_id::varchar) as items
      from (select distinct doc_id, item_id from hit) group by 1)
    select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
      sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join words on d.doc_id = words.doc_id left join named on d.doc_id = named.doc_id
""")
def op5_decontamination(spark, sf_dir):
    out = decontaminate(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op6_line_dedup")
def op6_line_dedup(spark, sf_dir):
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op7_quality_rules", r"""
    with base as (
      select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
    lines as (
      select doc_id, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines
      from (select doc_id, unnest(string_split(t, chr(10))) as l from base)
      where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1),
    grams as (
      select doc_id, i, array_to_string(w[i:i + 7], ' ') as g
      from (select doc_id, w, unnest(generate_series(1, len(w) - 7)) as i from base where len(w) >= 8)),
    rep as (
      select doc_id, count(distinct p) as n_repeat_words from (
        select doc_id, unnest(generate_series(i, i + 7)) as p from (
          select doc_id, i, count(*) over (partition by doc_id, g) as c from grams) where c > 1) group by 1),
    counts as (
      select b.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        coalesce(n_lines, 0) as n_lines,
        length(regexp_replace(t, '[^!]', '', 'g')) as n_bangs,
        length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper,
        length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as n_letters,
        len(list_filter(generate_series(2, len(w)), lambda i: w[i] = w[i - 1])) as n_stutters
      from base b left join lines l on b.doc_id = l.doc_id left join rep r on b.doc_id = r.doc_id),
    judged as (
      select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from counts)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      not (base_failed or 10 * n_symbols > n_words or 4 * n_bangs > n_words or 2 * n_upper > n_letters + 20
           or 2 * n_dup_lines > n_lines or 10 * n_stutters > 3 * n_words
           or word_chars < 2 * n_words or word_chars > 13 * n_words) as kept
    from judged
""")
def op7_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_cascade(docs, metrics=True)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "kept")


@query("op8_jaccard_join", r"""
    with recursive d as (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), """ + _AZ + r"""), '[^\x20\x09-\x0D]+') as w from documents),
    s as (
      select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g
      from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from d where len(w) > 0)),
    n as (select doc_id, count(*) as n from s group by 1),
    sets as (select doc_id, md5(string_agg(g, chr(10) order by g)) as k from s group by 1),
    class as (select k, min(doc_id) as rep from sets group by 1),
    rs as (select s.doc_id, g from s join class on s.doc_id = rep),
    pairs as (
      select a.doc_id as a, b.doc_id as b, count(*) as c from rs a join rs b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
    links as (
      select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 80 * (na.n + nb.n - c)
      union select rep, doc_id from sets join class on sets.k = class.k where doc_id <> rep),
    both_ways as (select a, b from links union select b, a from links),
    reach as (
      select distinct a as id, a as r from both_ways
      union select reach.id, both_ways.b from reach join both_ways on reach.r = both_ways.a),
    least as (select id, min(r) as r from reach group by 1)
    select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(least.r, d.doc_id)) as component_id
    from d left join n on d.doc_id = n.doc_id left join least on d.doc_id = least.id
""")
def op8_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


URL_RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


def _fit_sql(host: str, path: str) -> str:
    ordered = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    return "case " + " ".join(
        f"when ({host} = '{h}' or ends_with({host}, '.{h}')) and starts_with({path}, '{p}') then '{h}{p}'"
        for h, p, _ in ordered) + " end"


_BLOCKED = ", ".join(f"'{h}{p}'" for h, p, v in URL_RULES if v == "block")
_HOST = r"translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), " + _AZ + ")"
_PATH = r"regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_KEY = ("case when " + _HOST + " <> '' then " + _HOST
        + r" || regexp_extract({0}, '(?s)^.*?://[^/?#]*([^#]*)', 1) end")


@query("op9_url_filter", rf"""
    with recursive tags as (
      select url, unnest(regexp_extract_all(
        regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) as tag
      from pages),
    named as (
      select url, case
        when regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b')
        then regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
        when regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b')
        then regexp_extract(tag, '(?is)\burl\s*=\s*[''"]?([^"''\s>]+)', 1) end as u from tags),
    targets as (
      select url, case when starts_with(u, '//') then 'http:' || u
        when starts_with(u, '/') then 'http://' || {_HOST.format('url')} || u else u end as u
      from named where u <> ''),
    links as (select {_KEY.format('url')} as a, {_KEY.format('u')} as b from targets),
    both_ways as (
      select a, b from links where a <> b union select b, a from links where a <> b),
    reach as (
      select distinct a as id, a as r from both_ways
      union select reach.id, both_ways.b from reach join both_ways on reach.r = both_ways.a),
    said as (
      select id, min(case when fit in ({_BLOCKED}) then 'block' else 'allow' end) as alias_verdict
      from (select id, {_fit_sql("{h}", "{p}").format(h=_HOST.format("('http://' || r)"), p=_PATH.format("('http://' || r)"))} as fit from reach)
      where fit is not null group by 1),
    parts as (
      select page_id, coalesce({_HOST.format('url')}, '') as host, coalesce({_PATH.format('url')}, '') as path,
             {_KEY.format('url')} as k from pages),
    fits as (select *, {_fit_sql('host', 'path')} as rule from parts)
    select page_id, host, path, rule, case when rule in ({_BLOCKED}) then 'block' when rule is not null then 'allow'
      else coalesce(alias_verdict, 'allow') end as verdict
    from fits left join said on k = id
""")
def op9_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


#: The conversation that the contract adds, as a record of another layout.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def _escaped_sql(text: str, role: bool = False) -> str:
    out = rf"replace(replace(replace({text}, '\', '\\'), '###', '\h'), '</turn>', '\t')"
    return rf"replace({out}, ':', '\c')" if role else out


@query("op10_chat_format", rf"""
    with turns as (
      select conv_id, turn, case role when 'human' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant'
        when 'model' then 'assistant' else coalesce(role, '') end as role, coalesce(text, '') as txt from conversations
      union all select -7, 0, 'user', '{CONTROL_TEXT}' union all select -7, 1, 'assistant', '{CONTROL_TEXT}')
    select conv_id, count(*)::bigint as n_turns,
      sha256(string_agg(role || chr(10) || txt || chr(10), '' order by turn, role, txt)) as turns_sha256,
      coalesce(sum(length(txt)) filter (role = 'assistant'), 0)::bigint as loss_chars,
      sha256(coalesce(string_agg(txt, '' order by turn, role, txt) filter (role = 'assistant'), '')) as loss_sha256,
      sum(4 + length({_escaped_sql('role', True)}) + 2 + length({_escaped_sql('txt')}) + 9)::bigint as formatted_chars
    from turns group by conv_id
""")
def op10_chat_format(spark, sf_dir):
    import json

    record = json.dumps({"messages": [{"role": r, "content": CONTROL_TEXT} for r in ("user", "assistant")]})
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(record).alias("record"))
    turns = canonical_turns(table(spark, sf_dir, "conversations")).unionByName(record_turns(extra))
    chats = format_chats(turns)
    read = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    parts = chats.select("conv_id", "formatted", read.alias("read"), loss_text(F.col("formatted"), F.col("loss")).alias("lossy"))
    return parts.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(F.array_join("read", ""), 256).alias("turns_sha256"),
        F.length("lossy").cast("long").alias("loss_chars"), F.sha2("lossy", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@query("op11_hard_negatives", """
    with v as (
      select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
      where label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    pairs as (
      select a.r, a.vec_id as anchor_id, c.vec_id as id, a.label = c.label as same,
        list_dot_product(a.q, c.q)::bigint as score from v a join v c on a.r <> c.r where a.vec_id % 50 = 0),
    positives as (
      select r, anchor_id, id as positive_id, score as positive_score,
        row_number() over (partition by r order by score desc, id nulls last) as k from pairs where same),
    negatives as (
      select p.r, p.k, p.anchor_id, p.positive_id, p.positive_score, n.id as negative_id, n.score as negative_score,
        row_number() over (partition by p.r, p.k order by n.score desc, n.id nulls last) as k2
      from positives p join pairs n on p.r = n.r and not n.same
        and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
      where p.k <= 5)
    select anchor_id, positive_id, k2::int as rank, negative_id, positive_score, negative_score from negatives where k2 <= 3
""")
def op11_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


def _template_sql() -> str:
    """The templates as rows: phrases with their places, and words with theirs."""
    phrases, words = [], []
    notices = [(label, text, keys, False) for label, text, keys in TEMPLATES]
    for tid, (label, text, keys, base) in enumerate([*notices, *((label, text, (text,), True) for label, text in PHRASES)]):
        w = words_of(text)
        words += [f"({tid}, {i}, '{x}')" for i, x in enumerate(w) if not base]
        for k, key in enumerate(map(words_of, keys)):
            place = next(i for i in range(len(w)) if w[i:i + len(key)] == key)
            phrases.append(f"({tid}, '{label}', {base}, {k}, {place}, {len(keys)}, {key})")
    return (f"phrases(tid, label, base, k, place, n_keys, words) as (values {', '.join(phrases)}), "
            f"notices(tid, place, x) as (values {', '.join(words)})")


@query("op12_license_scan", rf"""
    with {_template_sql()},
    d as (select doc_id, coalesce({_WORDS}, []) as w from documents),
    flat as (select doc_id, unnest(w) as x, unnest(generate_series(0, len(w) - 1)) as i from d where len(w) > 0),
    hits as (
      select f.doc_id, p.*, i from flat f join phrases p on f.x = p.words[1] join d on d.doc_id = f.doc_id
      where d.w[i + 1:i + len(p.words)] = p.words),
    heads as (select doc_id, tid, label, n_keys, i - place as o from hits where k = 0 and not base),
    matches as (
      select h.doc_id, h.tid, h.label, h.o from heads h join hits t
        on h.doc_id = t.doc_id and h.tid = t.tid and abs(t.i - t.place - h.o) <= {SLACK}
      group by h.doc_id, h.tid, h.label, h.o, h.n_keys having count(distinct t.k) = h.n_keys),
    shares as (
      select m.doc_id, m.tid, m.label, m.o, count(distinct n.place)::double / any_value(s.n) as share
      from matches m join (select tid, count(*) as n from notices group by 1) s on s.tid = m.tid
        join notices n on n.tid = m.tid
        join flat f on f.doc_id = m.doc_id and f.x = n.x and abs(f.i - n.place - m.o) <= {SLACK} group by 1, 2, 3, 4),
    base as (
      select doc_id, count(*) as n, min(i) as a, max(i) as b, string_agg(distinct label, ',' order by label) as l
      from hits where base group by 1),
    named as (
      select doc_id, string_agg(distinct label, ',' order by label) as l, max(share) as share
      from (select doc_id, label, share from shares union all select doc_id, label, {PHRASE_SCORE} from hits where base) group by 1)
    select d.doc_id, len(w)::bigint as n_words, coalesce(base.n, 0)::bigint as n_base, a::bigint as first_word,
      b::bigint as last_word, coalesce(base.l, '') as base_labels, coalesce(named.l, '') as labels, coalesce(share, 0)::double as score
    from d left join base on d.doc_id = base.doc_id left join named on d.doc_id = named.doc_id
""")
def op12_license_scan(spark, sf_dir):
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def _p_sql(count: str, total: str) -> str:
    return f"(1 + (1000000000::hugeint * ({count} + 1)) // ({total} + v))"


@query("op13_source_divergence", rf"""
    with d as (
      select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
    groups as (select distinct lang, source from d),
    flat as (select row_number() over () as r, lang, source, w from d),
    words as (select r, lang, source, unnest(w) as t from flat),
    kept as (select lang, t from words group by 1, 2 having count(distinct r) >= 3),
    vs as (select lang, count(*) as v from kept group by 1),
    c as (select lang, source, t, count(*) as n from words join kept using (lang, t) group by 1, 2, 3),
    totals as (
      select lang, source, coalesce(n, 0) as total, coalesce(v, 0) as v
      from groups left join vs using (lang) left join (select lang, source, sum(n) as n from c group by 1, 2) using (lang, source)),
    dense as (
      select lang, source, t, {_p_sql('coalesce(n, 0)', 'total')} as p, coalesce(n, 0) as n
      from totals join kept using (lang) left join c using (lang, source, t)),
    whole as (
      select lang, t, {_p_sql('n', 'total')} as q from (select lang, t, sum(n) as n from c group by 1, 2)
        join (select lang, sum(n) as total from c group by 1) using (lang) join vs using (lang)),
    pairs as (
      select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
      from dense a join dense b on a.lang = b.lang and a.t = b.t and a.source <> b.source group by 1, 2, 3),
    ranked as (
      select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
      from groups a join groups b on a.lang = b.lang and a.source <> b.source
        left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
      union all
      select lang, source, 'term', t, ((p - q) * (p - q) // q)::bigint from dense join whole using (lang, t) where n > 0 and p > q),
    numbered as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from ranked)
    select lang, source, part, item, value, rank from numbered where part = 'pair' or rank <= 200
""")
def op13_source_divergence(spark, sf_dir):
    return audit_sources(table(spark, sf_dir, "documents"))
