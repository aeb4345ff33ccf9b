"""URL filter with redirect equivalence.

Rules judge a url by host and path.  Urls that lead to the same page are
aliases: spellings of one normal form (scheme, ``www.``/``m.`` hosts, tracking
parameters, fragment, trailing slash, ``.html``), and urls that a page's
canonical link or refresh redirect names.  Connected components over those
links carry a block to aliases that no rule judges; an explicit allow in the
component takes precedence, and a url's own rule always stands.  Rules judge
link targets as they judge pages, whether or not the target was crawled.

Defined cases: a null url, or one without ``://``, has empty host and path, no
rule and no aliases, and is allowed; relative link targets are resolved against
the page, character references in them decoded and dot segments resolved;
repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import let
from .components import components


@dataclass(frozen=True)
class Rule:
    """``name`` is host and path, as in ``example.net/en/``."""
    action: str
    name: str

    @property
    def host(self) -> str:
        return self.name.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.name.partition("/")[2]


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

HOST = "://([^/?#]*)"
PATH = "://[^/?#]*([^?#]*)"
QUERY = r"://[^?#]*\?([^#]*)"
ALIAS_HOST = r"^(?:www|m|mobile|amp)\.|:(?:80|443)$"
ALIAS_END = r"(?:/index)?(?:\.html?)?/*$"
TRACKING = r"^(?:utm_[^=]*|ref|fbclid|gclid|sessionid)(?:=|$)"
CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"
SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://"
DOTS = r"/\.\.?(?:/|$)"
#: character references as attributes have them: of the names, the old ones also
#: without a semicolon where the value does not go on like a parameter
REFERENCE = ("&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[A-Za-z][A-Za-z0-9]*;|(?:"
             + "|".join(sorted((n for n in html5 if n[-1] != ";"), key=lambda n: (-len(n), n))) + ")(?![A-Za-z0-9=;]))")


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), pattern, 1)


def host(url: Column) -> Column:
    return F.translate(_part(url, HOST), UPPER, LOWER)


def path(url: Column) -> Column:
    return _part(url, PATH)


def rule(h: Column, p: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule's name, null if none fits.  ``rules`` is a
    parameter list, evaluated in the row in order of length."""
    fits = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        on_host = (h == r.host) | h.endswith("." + r.host)
        fits = F.when(on_host & p.startswith(r.path), F.lit(r.name)).otherwise(fits)
    return fits


def _no_dots(p: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    def step(acc, x):
        return F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(
            F.concat(acc, F.array(x)))
    ends = F.when(p.rlike(r"/\.\.?$"), F.concat(p, F.lit("/"))).otherwise(p)
    parts = F.split(ends, "/", -1)
    return F.when(p.rlike(DOTS), F.array_join(F.aggregate(F.slice(parts, 2, F.size(parts)), F.slice(parts, 1, 1), step), "/")
                  ).otherwise(p)


def decoded(value: Column) -> Column:
    """An attribute's value with its character references replaced."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")

    def char(ref):
        number = F.when(ref.rlike("^&#[0-9]"), F.regexp_extract(ref, "([0-9]+)", 1).try_cast("long")).when(
            ref.rlike("^&#"), F.conv(F.regexp_extract(ref, "[xX]([0-9A-Fa-f]+)", 1), 16, 10).try_cast("long"))
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        of_number = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.when(ref.startswith("&#"), F.when(valid, of_number).otherwise(F.lit("\ufffd"))).otherwise(
            F.coalesce(F.try_element_at(names, F.substring(ref, F.lit(2), F.length(ref))), ref))
    refs = F.regexp_extract_all(value, F.lit(REFERENCE), F.lit(0))
    pieces = F.zip_with(F.split(value, REFERENCE, -1), refs, lambda t, r: F.concat(
        F.coalesce(t, F.lit("")), F.when(r.isNull(), F.lit("")).otherwise(char(r))))
    return F.when(value.contains("&"), F.array_join(pieces, "")).otherwise(value)


def alias(url: Column) -> Column:
    """Normal form shared by all spellings of a url; null for no url."""
    params = F.array_sort(F.filter(F.split(_part(url, QUERY), "&", -1),
                                   lambda x: (x != "") & ~x.rlike(TRACKING)))
    query = let(F.array_join(params, "&"), lambda q: F.when(q == "", q).otherwise(F.concat(F.lit("?"), q)))
    form = F.concat(F.regexp_replace(host(url), ALIAS_HOST, ""), F.regexp_replace(_no_dots(path(url)), ALIAS_END, ""), query)
    return F.when(host(url) != "", form)


def _absolute(target: Column, url: Column) -> Column:
    base = F.concat(F.lit("http://"), host(url))
    folder = F.regexp_extract(path(url), "^(.*/)?", 0)
    whole = (F.when(target == "", F.lit(None)).when(target.rlike(SCHEME), target)
             .when(target.startswith("//"), F.concat(F.lit("http:"), target))
             .when(target.startswith("/"), F.concat(base, target))
             .when(target.startswith("?"), F.concat(base, path(url), target))
             .when(target.startswith("#"), url)
             .otherwise(F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), target)))
    return let(whole, lambda w: F.when(path(w).rlike(DOTS), F.concat(
        F.regexp_extract(w, "^[^?#]*?://[^/?#]*", 0), _no_dots(path(w)), F.regexp_extract(w, r"[?#][\s\S]*$", 0))).otherwise(w))


def links(pages: DataFrame) -> DataFrame:
    """(a, b, target): alias forms joined by a canonical link or a refresh
    redirect, and the absolute url of the second."""
    html, url = F.coalesce(F.col("html"), F.lit("")), F.col("url")
    found = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select(
        url, F.explode(F.array(decoded(F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1)),
                               F.regexp_extract(decoded(F.regexp_extract(html, REFRESH, 0)), TARGET, 1))).alias("target"))
    return (found.where("target != ''").select(url, _absolute(F.col("target"), url).alias("target"))
            .select(alias(url).alias("a"), alias(F.col("target")).alias("b"), "target")
            .where("a is not null and b is not null"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, alias, rule and verdict of every page."""
    action = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.action)])
    p = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                     alias(F.col("url")).alias("alias"))
    p = p.withColumn("rule", rule(F.col("host"), F.col("path"), rules)).withColumn("own", action[F.col("rule")])
    link = links(pages)
    member = components(link)
    # the rules speak of link targets too, of which the table may have no page
    aims = link.select(F.col("b").alias("alias"), action[rule(host(F.col("target")), path(F.col("target")), rules)].alias("own"))
    said = p.select("alias", "own").unionByName(aims).where("alias is not null and own is not null").groupBy("alias").agg(
        F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked"))
    # what the rules say of any alias in the component, told to each alias
    said = said.join(member, said["alias"] == member["node"], "left").select(
        F.coalesce("component", "alias").alias("component"), "allowed", "blocked")
    said = said.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked"))
    of = member.join(said, "component").select(F.col("node").alias("alias"), "allowed", "blocked")
    alone = said.join(member, said["component"] == member["node"], "left_anti").select(
        F.col("component").alias("alias"), "allowed", "blocked")
    told = of.unionByName(alone)
    # only pages without a rule of their own need to hear it
    asks = p.where("own is null and alias is not null").join(told, "alias", "left").select(
        *p.columns, F.when(F.col("blocked") & ~F.col("allowed"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    rest = p.where("own is not null or alias is null").withColumn("verdict", F.coalesce("own", F.lit("allow")))
    return asks.unionByName(rest).drop("own")
