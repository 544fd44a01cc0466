"""URL filters with redirect equivalence.

Rules of (host, path prefix) judge urls directly; the longest rule that fits
wins.  Pages name aliases of themselves: canonical links, and redirects by a
refresh header in the html.  Distributed connected components over these edges
make classes of equivalent urls, and decisions spread through them:

* a url that a rule fits has that rule's verdict, whatever its class says;
* any other url is blocked if a rule blocks some url of its class, unless a
  rule explicitly allows some url of the class: explicit allows take
  precedence over blocks that come from elsewhere;
* a url without rule and class is allowed.

Urls are nodes without their fragment.  A target counts by the rules too, even
if no page has its url.  Class verdicts are sums over partial aggregates, and
written before they go back to their urls, and these to the pages, by joins with
plain exchanges on both sides, which Spark splits where a class or a url is hot.

Edge cases: a null url, or one without ``://``, has an empty host and path and
no alias; empty or null html has no edges; links that aren't web addresses, or
name a place in the page itself, are left out; tags inside comments, scripts,
styles and the like are no tags, and neither is one that is never closed; tags may
have any number of attributes, pages any length; repeated rows are judged alike;
an empty table gives an empty result; columns other than id, url and html are ignored.
"""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import discard, saved

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Verdict, host, path prefix.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]

#: The rule list stands in the plan as a literal, hence its bound.
MOST_RULES = 2000


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = _rest(F.coalesce(url, F.lit("")))
    return F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = _rest(F.coalesce(url, F.lit("")))
    return F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (length, host_length, rule, verdict), or null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    table = F.array(
        *[
            F.struct(
                F.lit(len(h) + len(p)).alias("length"),
                F.lit(len(h)).alias("host_length"),
                F.lit(h + p).alias("rule"),
                F.lit(v).alias("verdict"),
                F.lit(h).alias("host"),
                F.lit(p).alias("path"),
            )
            for v, h, p in rules
        ]
    )
    fits = F.filter(
        table,
        lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"])))
        & F.startswith(path, r["path"]),
    )
    return F.array_max(fits)


#: Elements whose content holds no tags of the page, open ones up to the end.
_HIDING = "script|style|template|noscript|title|textarea"

#: What follows a tag's name: only right after an equals sign do quotes enclose a
#: value, which may hold a closing bracket.
_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+"""

#: Comments, hiding elements, tags and declarations.  Each begins at a bracket and,
#: left open, goes on to the end, so one pass over a page takes linear time.
_TOKEN = re.compile(
    rf"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))
        |(?P<hides>{_HIDING})(?=[\s/>])(?:{_ATTRIBUTES})(?:>.*?(?:</(?P=hides)(?=[\s/>])|\Z)|\Z)
        |(?P<tag>link|meta)(?=[\s/>])(?P<attributes>{_ATTRIBUTES})(?P<closed>>|\Z)
        |/?[a-z][^\s/>]*+{_ATTRIBUTES}(?:>|\Z)
        |[!?/][^>]*+(?:>|\Z))""",
    re.IGNORECASE | re.DOTALL | re.VERBOSE,
)

_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?""")

_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")

_REFRESH_URL = re.compile(r"""url\s*+=\s*+(?:"([^"]*+)|'([^']*+)|([^'"]*+))""", re.IGNORECASE)


def _decoded(value: str) -> str:
    """A value with its character references resolved.  Without a semicolon a name
    before an equals sign, or within a longer word, is none."""

    def character(m: re.Match) -> str:
        name = m[0][1:]
        if name[0] != "#" and (name not in html5 or (name[-1] != ";" and value[m.end() : m.end() + 1] == "=")):
            return m[0]
        return unescape(m[0])

    return _REFERENCE.sub(character, value).strip() if "&" in value else value.strip()


def named_targets(page: str) -> list[str]:
    """The canonical links and redirect targets that a page names, as written.

    Tags of any number of attributes, in one forward pass; of attributes of the
    same name the first counts."""
    found = []
    for tag in _TOKEN.finditer(page):
        if not tag["tag"] or not tag["closed"]:
            continue
        own: dict[str, str] = {}
        for name, *values in _ATTRIBUTE.findall(tag["attributes"]):
            own.setdefault(name.lower(), "".join(values))
        if "canonical" in _decoded(own.get("rel", "")).lower().split():
            found.append(_decoded(own.get("href", "")))
        elif _decoded(own.get("http-equiv", "")).lower() == "refresh":
            to = _REFRESH_URL.search(_decoded(own.get("content", "")))
            found.append("".join(part or "" for part in to.groups()).strip() if to else "")
    return [t for t in found if t]


def targets(html: Column) -> Column:
    """``named_targets`` of pages; those without a tag of that kind aren't sent
    to Python."""

    @F.pandas_udf("array<string>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(named_targets)

    return run(F.coalesce(F.when(html.rlike(r"(?i)<(?:link|meta)[\s/>]"), html), F.lit("")))


def _without_dots(path: Column) -> Column:
    """A path from its first slash on, its ``.`` and ``..`` segments carried out."""
    parts = F.split(path, "/", -1)

    def step(done: Column, part: Column) -> Column:
        # The first part is what stands before the first slash: nothing.
        up = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.concat(F.array_join(kept, "/"), F.when(open_end, "/").otherwise(""))


def resolve(target: Column, url: Column) -> Column:
    """A target as an absolute web address, or null."""
    scheme = F.regexp_extract(url, r"\A([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    site = F.regexp_extract(url, r"\A[^:/?#]+://[^/?#]*", 0)
    path = F.regexp_extract(url, r"\A[^:/?#]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_extract(url, r"\A[^:/?#]+://[^/?#]*(/(?:[^?#]*/)?)?", 1)
    absolute = (
        F.when(target.rlike(r"\A(?i)https?://"), target)
        .when(target.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, F.lit(":"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .when(F.startswith(target, F.lit("#")), F.lit(None))
        .when(F.startswith(target, F.lit("?")), F.concat(site, F.when(path == "", "/").otherwise(path), target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )
    head = F.regexp_extract(absolute, r"\A[^:/?#]+://[^/?#]*", 0)
    rest = absolute.substr(F.length(head) + 1, F.length(absolute))
    names = F.regexp_extract(rest, r"\A[^?#]*", 0)
    plain = F.concat(head, _without_dots(names), rest.substr(F.length(names) + 1, F.length(rest)))
    dotted = names.rlike(r"/\.\.?(/|\z)") & (head != "")
    return F.when(site != "", F.when(dotted, plain).otherwise(absolute))


def node_of(url: Column) -> Column:
    """A url without its fragment, its scheme and host in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*\z", "")
    head = F.regexp_extract(bare, r"\A[^:/?#]+://[^/?#]*", 0)
    return F.concat(F.translate(head, _UPPER, _LOWER), bare.substr(F.length(head) + 1, F.length(bare)))


def alias_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(url, target) nodes of every alias that a page names."""
    named = pages.select(F.col(url_col).alias("url"), F.explode(targets(F.col(html_col))).alias("target"))
    edges = named.select(node_of(F.col("url")).alias("url"), node_of(resolve(F.col("target"), F.col("url"))).alias("target"))
    return edges.filter("target is not null and url is not null and url <> target").distinct()


def url_verdicts(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Per row: id, ``host``, ``path``, ``rule`` (the rule that fits, or null),
    ``verdict`` and ``alias_class`` (the least url of its class, or null)."""
    columns = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.col(html_col).cast("string").alias("html"),
    )
    edges = saved(alias_edges(columns, "url", "html"), "url-aliases")
    nodes = connected_components(edges)
    discard(edges)
    ruled = nodes.withColumn("best", best_rule(host_of(F.col("node")), path_of(F.col("node")), rules))
    classes = ruled.groupBy("component").agg(
        F.coalesce(F.max(F.col("best.verdict") == "block"), F.lit(False)).alias("blocks"),
        F.coalesce(F.max(F.col("best.verdict") == "allow"), F.lit(False)).alias("allows"),
    )
    decided = nodes.join(saved(classes, "url-classes"), "component").select(
        "node", F.col("component").alias("alias_class"), (F.col("blocks") & ~F.col("allows")).alias("class_blocks")
    )
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = columns.select("id", "url", host.alias("host"), path.alias("path"), node_of(F.col("url")).alias("node"))
    judged = judged.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    return judged.join(decided, "node", "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("class_blocks"), "block"), F.lit("allow")).alias("verdict"),
        "alias_class",
    )
