"""URL rules that hold for all aliases of a page.

Rules (host, path prefix, allow or block) fit a host and its subdomains; the longest wins. Redirects
and canonical links make URLs equivalent: connected components over these edges, found by
distributed rounds, carry a block from any member to members that no rule fits, unless a rule
explicitly allows a member of the component. A URL's own rule always comes first.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .storage import written

#: Rules that may be broadcast, after counting them.
BROADCAST_RULES = 100_000

TAG = re.compile(r"""<!--.*?(?:-->|$)|<(script|style|textarea|title|template)\b[^>]*>.*?(?:</\1\s*>|$)|<(base|link|meta)\b((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
REFRESH = re.compile(r"""\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?["']?([^"']*)""", re.DOTALL | re.IGNORECASE)
URL = re.compile(r"(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?", re.DOTALL)


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The URL as a node: host in lower case, no fragment; null without ://."""
    scheme = _lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), host_of(url), rest))


def _without_dots(path: str) -> str:
    """RFC 3986, 5.2.4, for a path that starts with / or is empty."""
    out: list[str] = []
    parts = path.split("/")
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "..":
            if len(out) > 1:
                out.pop()
        elif part != ".":
            out.append(part)
            continue
        if last:
            out.append("")
    return "/".join(out)


def resolved(base: str, target: str) -> str | None:
    """A reference made absolute by RFC 3986, 5.2.2; null if it or its base isn't of the kind scheme://."""
    scheme, host, path, query, _ = URL.fullmatch(target).groups()
    if scheme is None:
        base_scheme, base_host, base_path, base_query, _ = URL.fullmatch(base).groups()
        if base_scheme is None or base_host is None:
            return None
        scheme = base_scheme
        if host is None:
            host = base_host
            if not path:
                path, query = base_path, query if query is not None else base_query
            elif not path.startswith("/"):
                path = (base_path.rpartition("/")[0] + "/" if base_path else "/") + path
    return None if host is None else f"{scheme}://{host}{_without_dots(path)}{query or ''}"


def declared(url: str, html: str) -> list[str]:
    """All canonical links and refresh redirects of a page, made absolute by its URL and its first <base href>."""
    base, targets = None, []
    for m in TAG.finditer(html):
        if m[2] is None:
            continue  # comments, scripts and the like
        found: dict[str, str] = {}
        for name, *values in ATTRIBUTE.findall(m[3]):
            found.setdefault(name.lower(), html_lib.unescape("".join(values)))
        tag = m[2].lower()
        if tag == "base" and base is None and "href" in found:
            base = found["href"].strip()
        elif tag == "link" and "canonical" in found.get("rel", "").lower().split():
            targets.append(found.get("href", ""))
        elif tag == "meta" and found.get("http-equiv", "").strip().lower() == "refresh" and (to := REFRESH.match(found.get("content", ""))):
            targets.append(to[1])
    around = (resolved(url, base) or url) if base else url
    absolute = (resolved(around, t.strip()) for t in targets if t.strip())
    return sorted({x for x in absolute if x is not None})


def _declared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(url, dst) for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for dst in declared(url, html)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["src", "dst"])


def declared_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst): all canonical links and refresh redirects that pages state, made absolute.

    Only pages with one of the two words, or with numeric character references that may spell it, are read as HTML.
    """
    url, html = F.col(url_col), F.col(html_col)
    some = pages.select(url.alias("src"), html.alias("html")).filter(F.col("src").isNotNull() & F.col("html").rlike("(?i)canonical|refresh|&#"))
    return some.mapInArrow(_declared, "src string, dst string")


def matched(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, action): the longest rule that fits each distinct (host, path), if any.

    Every host is looked up by its own suffixes, so a rule on a whole domain is an equality join.
    Of rules of equal length, allow comes first, then the lesser text.
    """
    own = hosts.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")
    )
    probes = own.filter("host <> ''").withColumn("suffix", F.explode(suffixes))
    known = rules.filter("host is not null and path is not null and action in ('allow', 'block')").select(
        _lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "action"
    ).distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_RULES else known
    fits = probes.join(known, F.col("suffix") == F.col("rule_host")).filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.min(F.struct((-F.length(rule)).alias("short"), F.col("action"), rule.alias("rule"))).alias("best")
    return fits.groupBy("host", "path").agg(best).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def judged(
    pages: DataFrame,
    rules: DataFrame,
    edges: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """One row per row of pages: id, host, path, rule (null if none fits), verdict.

    rules has host, path and action (allow or block; others are left out). edges (src, dst) adds redirects known
    from a crawl to those that the pages' html states. The verdict is the URL's own rule's. Else it
    is block if an alias is blocked by a rule and none is allowed by one, and allow in all other
    cases: no rule, no alias, or no URL. Null URLs have an empty host and path and no rule. Repeated
    rows get equal verdicts, empty tables an empty result; other columns are ignored.
    """
    url = F.col(url_col)
    own = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    known = edges.select("src", "dst") if edges is not None else None
    if html_col is not None:
        stated = declared_edges(pages, url_col, html_col)
        known = stated if known is None else known.union(stated)
    best = matched(own, rules)
    if known is not None:
        links = written(known.select(node_of(F.col("src")).alias("a"), node_of(F.col("dst")).alias("b")).filter("a is not null and b is not null and a <> b"), "url-edges")
    if known is None or links.isEmpty():
        parts = None
    else:
        roots = connected_components(links, "a", "b")
        both = links.select(F.col("a").alias("n")).union(links.select("b")).distinct()
        parts = written(both.join(roots, F.col("n") == F.col("vertex"), "left").select("n", F.coalesce("root", "n").alias("component")), "url-components")
        # A component's members are judged as URLs of their own, crawled or not.
        members = parts.select("component", host_of(F.col("n")).alias("host"), path_of(F.col("n")).alias("path"))
        ruled = members.join(matched(members, rules), ["host", "path"])
        spread = ruled.groupBy(F.col("component").alias("c")).agg(F.max((F.col("action") == "allow").cast("int")).alias("allowed"))
        blocked = spread.filter("allowed = 0").select("c")
        blocked_nodes = parts.join(blocked, F.col("component") == F.col("c")).select(F.col("n").alias("bn"), F.lit(True).alias("alias_blocked"))
    out = own.join(best.withColumnsRenamed({"host": "h", "path": "p"}), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    if parts is None:
        spread_block = F.lit(False)
    else:
        out = out.join(blocked_nodes, F.col("node") == F.col("bn"), "left")
        spread_block = F.coalesce("alias_blocked", F.lit(False))
    verdict = F.coalesce("action", F.when(spread_block, F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"))
