"""URL filters with redirect equivalence, in DataFrame functions only.

A rule ``(host, path, verdict)`` fits its host and all subdomains if the URL's path starts with the
rule's path; of the rules that fit, the longest (host and path together) decides.  URLs that redirect
to each other or name each other as canonical are aliases: connected components over those links.
A URL without a rule takes what the rules say about its aliases: ``allow`` if any alias is explicitly
allowed, else ``block`` if any is blocked, else ``allow``.  An explicit rule always stands.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule, have no alias and are
allowed.  Repeated rows are judged alike.  Relative links are resolved against their page's URL; character
references in them are decoded.  An empty path and ``/`` name one resource, and so do paths with dot segments
and without.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import components, unused, without, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` segments; an empty one is ``/``."""
    parts = F.slice(F.split(path, "/", -1), 2, 1 << 30)
    one, two = r"(?i)^(\.|%2e)$", r"(?i)^(\.|%2e){2}$"
    walked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, x: F.when(x.rlike(one), done).when(x.rlike(two), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(
            F.concat(done, F.array(x))))
    ended = F.when(F.element_at(parts, -1).rlike(r"(?i)^(\.|%2e){1,2}$"), F.concat(walked, F.array(F.lit("")))).otherwise(walked)
    dotted = path.rlike(r"(?i)/(\.|%2e){1,2}(/|\z)")
    return F.when(path == "", F.lit("/")).when(dotted, F.concat(F.lit("/"), F.array_join(ended, "/"))).otherwise(path)


def alias_key(url: Column) -> Column:
    """What names a resource: host, path and query; scheme and fragment do not count.  Null if there is no host."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), once(path_of(url), without_dots), query))


def decoded(value: Column) -> Column:
    """An attribute's value with its character references decoded, by the rules for attributes: ``&copy=1`` is none."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    parts = F.regexp_extract_all(
        value, F.lit(r"(?s)(&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[A-Za-z][A-Za-z0-9]*(?:;|(?![=A-Za-z0-9;]))|&|[^&]+)"), F.lit(1))

    def one(x: Column) -> Column:
        hexed = F.when(
            x.rlike("^&#[xX]"), F.regexp_extract(x, "^&#[xX]0*([0-9a-fA-F]*)", 1)).otherwise(
            F.conv(F.regexp_extract(x, "^&#([0-9]*)", 1), 10, 16))
        char = F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")
        valid = hexed.rlike("(?i)^([1-9a-f][0-9a-f]{0,2}|[1-9abcef][0-9a-f]{3}|d[0-7][0-9a-f]{2}|[1-9a-f][0-9a-f]{4}|10[0-9a-f]{4})$")
        return F.when(x.rlike("^&#[0-9xX]"), F.when(valid, char).otherwise(F.lit("\ufffd"))).when(
            x.rlike("^&[A-Za-z]"), F.coalesce(F.element_at(names, F.substring(x, 2, 64)), x)).otherwise(x)

    return F.when(value.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(value)


def resolved(to: Column, url: Column) -> Column:
    """The URL that a link ``to`` on the page ``url`` means."""
    top = F.concat(F.lit("http://"), host_of(url))
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return (
        F.when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), to)
        .when(to.startswith("/"), F.concat(top, to))
        .when(to.startswith("?"), F.concat(top, path, to))
        .when(to.startswith("#"), F.concat(top, path, query))
        .otherwise(F.concat(top, F.regexp_extract(path, r"(?s)^(.*/)", 1), to)))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as ``struct<size, rule, verdict>``, or null; first of equals."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
               F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))
    ]
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.coalesce(*fits, none)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Redirects and canonical links of pages: ``(a, b)`` alias keys.

    They are ``<link rel=canonical href=...>`` and ``<meta http-equiv=refresh content="0;url=...">``
    outside comments and scripts, attributes in any order.
    """
    live = F.regexp_replace(F.col(html), r"(?is)<!--.*?-->|<script\b.*?</script\s*>", "")
    tags = F.regexp_extract_all(live, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    tag = F.col("tag")
    href = F.when(
        tag.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b"),
        F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1),
    ).when(
        tag.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"),
        F.regexp_extract(tag, r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)", 1),
    )
    found = pages.select(F.col(url).alias("url"), F.explode(tags).alias("tag")).select("url", href.alias("to"))
    meant = once(once(F.col("to"), decoded), lambda to: resolved(F.trim(F.translate(to, "\t\n\r", "")), F.col("url")))
    key = once(meant, lambda at: F.when(at.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), alias_key(at)))
    return found.where("to <> ''").select(alias_key(F.col("url")).alias("a"), key.alias("b")).where(
        "a is not null and b is not null")


def alias_verdicts(links: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``(key, alias_verdict)`` for each linked key whose component has a rule."""
    links = written(links.where("a <> b").distinct(), "links")
    nodes = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    member = written(components(nodes, links), "aliases")
    as_url = F.concat(F.lit("http://"), "id")
    said = member.select("component", fitting_rule(host_of(as_url), path_of(as_url), rules)["verdict"].alias("v"))
    decided = said.where("v is not null").groupBy("component").agg(F.min("v").alias("alias_verdict"))
    return member.join(decided, "component").select(F.col("id").alias("key"), "alias_verdict")


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", links: DataFrame | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` (``allow`` or ``block``).

    ``links`` has further alias pairs ``(a, b)`` of keys, such as redirects from a crawl log; by default
    they come from the pages' html.  ``rules`` is a list in the plan, so it belongs in a configuration file.
    """
    if any(v not in ("allow", "block") for _, _, v in rules):
        raise ValueError("a rule allows or blocks")
    if links is None:
        links = page_links(pages, url)
    else:
        links = links.select(*(alias_key(F.concat(F.lit("http://"), c)).alias(c) for c in ("a", "b")))
    aliases = alias_verdicts(links, rules)
    taken = [F.col(f"`{c}`") for c in without(pages, ["host", "path", "rule", "verdict"]).columns]
    own, fit, key, said = unused(pages, "own", "fit", "key", "said")
    aliases = aliases.select(F.col("key").alias(key), F.col("alias_verdict").alias(said))
    at = F.col(url)
    judged = pages.select(
        *taken, host_of(at).alias("host"), path_of(at).alias("path"), alias_key(at).alias(own),
        fitting_rule(host_of(at), path_of(at), rules).alias(fit))
    out = judged.join(aliases, F.col(own) == F.col(key), "left")
    return out.select(
        *taken, "host", "path", F.col(f"{fit}.rule").alias("rule"),
        F.coalesce(f"{fit}.verdict", said, F.lit("allow")).alias("verdict"))
