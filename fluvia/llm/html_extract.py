"""Main text of web pages by wrappers: union-free regular expressions over token streams.

Pages of a host share templates. All of them are read as streams of block tags and texts, in which
tandem repeats become repeated groups. Pages of one stream are summed up where they are read (which
texts are equal in all of them); the distinct streams of a host are then aligned one after another,
in classes and then class by class, and what differs becomes a text slot or an optional group. The
wrapper tells, for every place of the template, what is fixed text of the template and what is a
field: a text is fixed if all pages that have its place agree on it and are not copies of one page.
Neighbours of one structure are one repeated group, whose texts are fixed only if all of them are.
Each page is aligned with its host's wrapper.
"""

from __future__ import annotations

import html as html_lib
import json
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written
from .url_filter import host_of

#: Distinct streams of a host that are aligned in one class.
CLASS_STREAMS = 64
#: Bytes of streams that a task sums up before it passes them on.
SUMMED_BYTES = 8 << 20
#: Cells of an alignment table; longer parts are cut at anchors first.
CELLS = 1 << 18
#: Bytes of wrappers that may be broadcast, after summing them.
BROADCAST_BYTES = 32 << 20

# Element names and words of class or id attributes.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics tspan".split()
)
#: Elements whose end may be left out; only their start is a token.
OPEN_ENDED = frozenset("p li dt dd tr td th thead tbody tfoot option optgroup colgroup caption".split())
RAW = "script|style|noscript|template|textarea|iframe|object|canvas|title|desc|metadata|annotation|annotation-xml"
VOID = frozenset("area base col embed hr input link meta param source track".split())
NEVER_MAIN = frozenset("head nav header footer aside form button select menu dialog fieldset".split())
MAIN = frozenset("article main".split())
SIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert adverts advertisement "
    "banner promo promotion sponsor sponsored notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe "
    "signup login search share sharing social related recommended comment comments disqus reply replies widget toolbar pagination copyright".split()
)
MAIN_WORDS = frozenset("article articlebody post entry story content maincontent main".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())

TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<({RAW})\b[^>]*?(?:/>|>.*?(?:</\1\s*>|$))|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACES = re.compile(r"\s+")


@lru_cache(4096)
def _tag(name: str, attributes: str) -> tuple[str, int]:
    """A start tag's token and its region: 0 as around it, 1 main, 2 side, 3 side whatever lies in it."""
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    label = f"{found.get('class', '')} {found.get('id', '')}".lower().strip()
    words = set(re.split(r"[^a-z0-9]+", label))
    token = f"<{name}.{label}>" if label else f"<{name}>"
    role = found.get("role", "").lower()
    style = found.get("style", "").replace(" ", "").lower()
    if name in NEVER_MAIN or "hidden" in found or "display:none" in style or role in SIDE_ROLES:
        return token, 3
    if name in MAIN or role in ("main", "article") or found.get("itemprop") == "articleBody":
        return token, 1
    if name not in ("body", "html") and words & SIDE_WORDS:
        return token, 2
    return token, 1 if words & MAIN_WORDS and name not in ("body", "html") else 0


def _block(parts: list[str]) -> str:
    text = "".join(parts)
    return SPACES.sub(" ", html_lib.unescape(text) if "&" in text else text).strip()


def tokens(page: str) -> tuple[list[str], list[list[str]], list[int]]:
    """The page as tokens: tags, and '#' for a text; the texts' blocks; and the region of each text.

    Inline tags leave no token; a text's region is that of the innermost element that has one, but
    nothing in an element of region 3 is main.
    """
    out: list[str] = []
    blocks: list[list[str]] = []
    regions: list[int] = []
    stack: list[tuple[str, int]] = []
    opened: Counter = Counter()
    parts: list[str] = []

    def flush() -> None:
        if parts and (text := _block(parts)):
            if out and out[-1] == "#":
                blocks[-1].append(text)
            else:
                out.append("#")
                blocks.append([text])
                regions.append(stack[-1][1] if stack else 0)
        parts.clear()

    for m in TOKEN.finditer(page):
        if (text := m[5]) is not None:
            parts.append(text)
            continue
        name = m[3]
        if name is None:
            continue  # comments, declarations, scripts and the like
        name = name.lower()
        if name in INLINE:
            if name == "br":
                parts.append(" ")
            continue
        flush()
        if m[2]:
            if name in OPEN_ENDED:
                # A text after the end isn't one with the text before it.
                continue
            out.append(f"</{name}>")
            if opened[name]:  # an end tag that ends nothing costs nothing
                while stack:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
            continue
        token, region = _tag(name, m[4] or "")
        around = stack[-1][1] if stack else 0
        out.append(token)
        if name not in VOID and not (m[4] or "").endswith("/"):
            if name not in OPEN_ENDED:
                stack.append((name, 3 if around == 3 else region or around))
                opened[name] += 1
    flush()
    return out, blocks, regions


def _periods(items: list, groups: set | None) -> Iterator[int]:
    """Lengths, from 2 on, of bodies that stand twice in a row somewhere in the items as they are then, or that groups has."""
    numbers: dict = {}
    codes, known = None, {len(body) for body in groups or ()}
    period = 2
    while period <= max(len(items) // 2, max(known, default=0)):
        if codes is None:
            codes = np.fromiter((numbers.setdefault(x, len(numbers)) for x in items), np.int32, len(items))
        some = period in known
        if not some and 2 * period <= len(codes):
            same = codes[:-period] == codes[period:]
            if np.count_nonzero(same) >= period:
                apart = np.flatnonzero(~same)
                some = bool((np.diff(np.concatenate([[-1], apart, [len(same)]])) > period).any())
        if some:
            items = yield period
            codes = None
        period += 1


def _collapsed(stream: list, groups: set | None = None) -> tuple[list, list[int]]:
    """The stream with tandem repeats as groups ('+', body), and where each item starts in it."""
    items, starts = stream, list(range(len(stream)))
    periods = _periods(items, groups)
    period = next(periods, None)
    while period is not None:
        out: list = []
        at: list[int] = []
        i, n, changed = 0, len(items), False
        while i < n:
            body = items[i : i + period]
            j = i + period
            while j + period <= n and items[j : j + period] == body:
                j += period
            at.append(starts[i])
            if len(body) == period and (j > i + period or (groups is not None and tuple(body) in groups)) and any(x[0] == "<" for x in body):
                out.append(("+", tuple(body)))
                i, changed = j, True
            else:
                out.append(items[i])
                i += 1
        if changed:
            # Neighbouring groups of one body are one group.
            kept = [k for k, x in enumerate(out) if not (k and x == out[k - 1] and isinstance(x, tuple))]
            out, at = [out[k] for k in kept], [at[k] for k in kept]
            items, starts = out, at
        try:
            period = periods.send(items)
        except StopIteration:
            period = None
    return items, starts


def collapsed(stream: list, groups: set | None = None) -> list:
    """The stream with tandem repeats as groups ('+', body); with groups, single bodies of these as well."""
    return _collapsed(stream, groups)[0]


def bodies(items: list) -> set:
    return {x[1] for x in items if isinstance(x, tuple)}


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of the pairs, given in order of their first, whose second rises as well."""
    ends: list[int] = []  # the least last second of a run of each length
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1], last[at : at + 1] = [j], [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _anchors(x: list, y: list) -> tuple[list[tuple[int, int]], bool]:
    """Places of equal items, rising in both: of items that stand once in each; without any, of items' k-th
    occurrences, which are then final (True)."""
    in_x, in_y = Counter(x), Counter(y)
    at = {item: j for j, item in enumerate(y) if in_y[item] == 1}
    pairs = _rising([(i, at[item]) for i, item in enumerate(x) if in_x[item] == 1 and item in at])
    if pairs:
        return pairs, False
    times: Counter = Counter()
    place: dict[tuple, int] = {}
    for j, item in enumerate(y):
        place[item, times[item]] = j
        times[item] += 1
    times.clear()
    pairs = []
    for i, item in enumerate(x):
        if (j := place.get((item, times[item]))) is not None:
            pairs.append((i, j))
        times[item] += 1
    return _rising(pairs), True


def _common(x: list, y: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below, item = best[i], best[i + 1], x[i]
        for j in range(len(y) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if item == y[j] else max(below[j], row[j + 1])
    out = []
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(a: list, b: list, cells: int = CELLS) -> list[tuple[int | None, int | None]]:
    """An alignment of two item lists, as pairs of places in order.

    Equal heads and tails go together. What is between is aligned to a longest common subsequence if its table has at
    most `cells` cells; else it is cut at items that stand once on both sides, and each part is aligned
    likewise. So memory is bounded, and time grows with the lists' length but for the tables.
    """
    found: list[tuple[int, int]] = []
    parts = [(0, len(a), 0, len(b))]
    while parts:
        i, m, j, n = parts.pop()
        while i < m and j < n and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            found.append((m, n))
        if i == m or j == n:
            continue
        x, y = a[i:m], b[j:n]
        if len(x) * len(y) <= cells:
            found += [(i + p, j + q) for p, q in _common(x, y)]
            continue
        anchors, final = _anchors(x, y)
        anchors = [(i + p, j + q) for p, q in anchors]
        found += anchors
        if not final:
            edges = [(i - 1, j - 1), *anchors, (m, n)]
            parts += [(p + 1, r, q + 1, s) for (p, q), (r, s) in pairwise(edges)]
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    for p, q in [*sorted(found), (len(a), len(b))]:
        out += [(k, None) for k in range(i, p)] + [(None, k) for k in range(j, q)]
        if p < len(a) and q < len(b):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


class Wrapper:
    """items: tokens, '#' slots and ('+', body) groups. For each whether it's optional, the digest of its
    texts if all pages that have it agree on them (else it's a field), and the least and greatest digest
    of these pages, which differ unless all are copies of one."""

    def __init__(self) -> None:
        self.items: list = []
        self.optional: list[bool] = []
        self.fixed: list[bytes | None] = []
        self.low: list[bytes] = []
        self.high: list[bytes] = []
        self.groups: set = set()
        self.empty = True
        self.places: dict[tuple, tuple[list[int], list[int | None]]] = {}

    def learn(self, other: Wrapper) -> None:
        """Align one more wrapper with this one: differences become slots and optional items."""
        if self.empty:
            self.items, self.fixed, self.optional = list(other.items), list(other.fixed), list(other.optional)
            self.low, self.high, self.empty = list(other.low), list(other.high), other.empty
        elif not other.empty:
            new: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for i, j in aligned(self.items, other.items):
                one, k = (self, i) if i is not None else (other, j)
                same = i is not None and j is not None
                new[0].append(one.items[k])
                new[1].append((self.fixed[i] if self.fixed[i] == other.fixed[j] else None) if same else one.fixed[k])
                new[2].append(not same or self.optional[i] or other.optional[j])
                new[3].append(min(self.low[i], other.low[j]) if same else one.low[k])
                new[4].append(max(self.high[i], other.high[j]) if same else one.high[k])
            self.items, self.fixed, self.optional, self.low, self.high = new

    def place(self, items: list) -> tuple[list[int], list[int | None]]:
        """The items of a page with this wrapper's groups: where each starts, and its place in the wrapper."""
        key = tuple(items)
        if (known := self.places.get(key)) is None:
            own, starts = _collapsed(items, self.groups)
            places: list[int | None] = [None] * len(own)
            for i, j in aligned(self.items, own):
                if i is not None and j is not None:
                    places[j] = i
            known = starts, places
            if len(self.places) < 2000:
                self.places[key] = known
        return known

    def is_fixed(self, place: int | None, own: bytes | None) -> bool:
        """Whether texts of this digest at a place are the template's."""
        return place is not None and own is not None and self.low[place] < self.high[place] and self.fixed[place] == own

    def expression(self) -> str:
        """The wrapper as a regular expression over tokens, for people."""
        def shown(x: object) -> str:
            return "( " + " ".join(map(shown, x[1])) + " )+" if isinstance(x, tuple) else "#PCDATA" if x == "#" else x

        return " ".join(f"( {shown(x)} )?" if o else shown(x) for x, o in zip(self.items, self.optional, strict=True))


def _spans(stream: list[str], items: list) -> list[tuple[int, int]]:
    """The run of tokens of the stream that each item stands for."""

    def eat(body: tuple | list, at: int) -> int:
        for x in body:
            at = eat_group(x[1], at) if isinstance(x, tuple) else at + 1
        return at

    def fits(body: tuple, at: int) -> int | None:
        for x in body:
            if isinstance(x, tuple):
                if (end := fits(x[1], at)) is None:
                    return None
                at = eat_group(x[1], at)
            elif at < len(stream) and stream[at] == x:
                at += 1
            else:
                return None
        return at

    def eat_group(body: tuple, at: int) -> int:
        at = fits(body, at)
        while (end := fits(body, at)) is not None:
            at = end
        return at

    out, at = [], 0
    for x in items:
        end = eat_group(x[1], at) if isinstance(x, tuple) else at + 1
        out.append((at, end))
        at = end
    return out


def _by_item(stream: list[str], items: list) -> list[tuple[int, int]]:
    """Of each item the run of its texts."""
    out, k = [], 0
    for a, b in _spans(stream, items):
        n = stream[a:b].count("#")
        out.append((k, k + n))
        k += n
    return out


def _digest(texts: list[list[str]]) -> bytes:
    return blake2b("\2".join("\1".join(t) for t in texts).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _has_text(item: object) -> bool:
    return any(map(_has_text, item[1])) if isinstance(item, tuple) else item == "#"


def _together(digests: list[bytes | None]) -> bytes | None:
    """The digest of the texts of several items; None if there are none, or some item's differ between pages."""
    if len(digests) == 1:
        return digests[0]
    return blake2b(b"".join(digests), digest_size=16).digest() if digests and None not in digests else None


#: Of pages of one stream: the digests of texts that are equal in all, the least and the greatest page digest.
Summed = tuple[list, bytes, bytes]


def summed(stream: list[str], blocks: list[list[str]], regions: list[int]) -> tuple[tuple, Summed]:
    """A page as its collapsed stream and what is known of it. Its digest is that of its texts outside side
    regions, so copies with other advertisements or links around them are one page."""
    items = collapsed(stream)
    fixed = [_digest(blocks[a:b]) if b > a else None for a, b in _by_item(stream, items)]
    own = _digest([t for t, r in zip(blocks, regions, strict=True) if r < 2])
    return tuple(items), (fixed, own, own)


def both(x: Summed, y: Summed) -> Summed:
    return [a if a == b else None for a, b in zip(x[0], y[0], strict=True)], min(x[1], y[1]), max(x[2], y[2])


def regrouped(items: tuple, known: Summed, groups: set) -> Wrapper:
    """Pages of one stream as a wrapper, with the groups of their host."""
    wrapper = Wrapper()
    fixed, low, high = known
    wrapper.items, starts = _collapsed(list(items), groups)
    wrapper.fixed = [_together([fixed[k] for k in range(a, b) if _has_text(items[k])]) for a, b in pairwise([*starts, len(items)])]
    n = len(wrapper.items)
    wrapper.optional, wrapper.low, wrapper.high, wrapper.empty = [False] * n, [low] * n, [high] * n, False
    return wrapper


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of some pages of one host."""
    known: dict[tuple, Summed] = {}
    for page in pages:
        items, own = summed(*tokens(page))
        if items:
            known[items] = both(known[items], own) if items in known else own
    groups = {x for items in known for x in bodies(list(items))}
    wrapper = Wrapper()
    for items in sorted(known, key=repr):
        wrapper.learn(regrouped(items, known[items], groups))
    wrapper.groups = groups
    return wrapper


def extract(page: str, wrapper: Wrapper) -> str:
    """The main text of a page: its blocks in order, one a line.

    The template's fixed texts and side regions go. Of what is left, only the main regions stay if they hold
    at least half of it, so a teaser with a telltale name doesn't stand for the page.
    """
    stream, blocks, regions = tokens(page)
    items = collapsed(stream)
    by_item = _by_item(stream, items)
    starts, places = wrapper.place(items)
    fields: list[int] = []
    for (s, e), i in zip(pairwise([*starts, len(items)]), places, strict=True):
        a, b = by_item[s][0], by_item[e - 1][1]
        own = _together([_digest(blocks[x:y]) for x, y in by_item[s:e] if y > x]) if i is not None and b > a and wrapper.fixed[i] is not None else None
        if b > a and not wrapper.is_fixed(i, own):
            fields += (k for k in range(a, b) if regions[k] < 2)
    size = [sum(len(text) for k in fields if regions[k] == region for text in blocks[k]) for region in (0, 1)]
    if size[1] >= size[0]:
        fields = [k for k in fields if regions[k] == 1]
    return "\n".join(text for k in fields for text in blocks[k])


def _frozen(x: object) -> object:
    return tuple(map(_frozen, x)) if isinstance(x, list) else x


SUMMED = pa.schema([("h", pa.string()), ("stream", pa.string()), ("fixed", pa.list_(pa.binary())), ("low", pa.binary()), ("high", pa.binary()), ("bodies", pa.list_(pa.string()))])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str], Summed] = {}
    groups: dict[str, list[str]] = {}
    size = 0

    def passed_on() -> pa.RecordBatch:
        rows = [{"h": h, "stream": t, "fixed": f, "low": a, "high": b, "bodies": groups[t]} for (h, t), (f, a, b) in known.items()]
        known.clear()
        groups.clear()
        return pa.RecordBatch.from_pylist(rows, schema=SUMMED)

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            items, own = summed(*tokens(page or ""))
            if not items:
                continue
            text = json.dumps(items)
            key = (host, text)
            if key in known:
                known[key] = both(known[key], own)
            else:
                known[key] = own
                groups[text] = [json.dumps(x) for x in bodies(list(items))]
                size += 2 * len(text) + 64 * len(items)
            if size > SUMMED_BYTES:
                yield passed_on()
                size = 0
    if known:
        yield passed_on()


def _class_wrapper(key: tuple, table: pa.Table) -> pa.Table:
    known: dict[str, Summed] = {}
    columns = [table[c].to_pylist() for c in ("stream", "fixed", "low", "high")]
    for text, *own in zip(*columns, strict=True):
        known[text] = both(known[text], tuple(own)) if text in known else tuple(own)
    wrapper = Wrapper()
    groups = {_frozen(json.loads(x)) for x in table["groups"][0].as_py() or ()}
    for text in sorted(known):
        wrapper.learn(regrouped(_frozen(json.loads(text)), known[text], groups))
    wrapper.groups = groups
    return pa.table({"h": pa.array([key[0].as_py()]), "c": pa.array([key[1].as_py()], pa.int64()), "wrapper": pa.array([pickle.dumps(wrapper)], pa.binary())})


def _host_wrapper(key: tuple, table: pa.Table) -> pa.Table:
    parts = sorted(zip(table["c"].to_pylist(), table["wrapper"].to_pylist(), strict=True))
    wrapper = Wrapper()
    for _, data in parts:
        part = pickle.loads(data)
        wrapper.learn(part)
        wrapper.groups = part.groups
    return pa.table({"h": pa.array([key[0].as_py()]), "wrapper": pa.array([pickle.dumps(wrapper)], pa.binary())})


@lru_cache(512)
def _wrapper(data: bytes | None) -> Wrapper:
    return pickle.loads(data) if data else Wrapper()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page or "", _wrapper(data)) for page, data in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def wrappers(pages: DataFrame) -> DataFrame:
    """(h, wrapper) of every host of (id, url, html) rows, from all its pages.

    No page is shuffled: tasks sum up the pages of a stream. The distinct streams of a host are dealt by
    their hash into classes of some CLASS_STREAMS, and the wrappers of its classes are aligned in turn,
    so the wrapper doesn't depend on the order or the partitions of rows.
    """
    schema = "h string, stream string, fixed array<binary>, low binary, high binary, bodies array<string>"
    sums = written(pages.select(host_of(F.col("url")).alias("h"), "html").mapInArrow(_sums, schema), "html-streams")
    count = sums.select("h", F.xxhash64("stream").alias("x")).distinct().groupBy("h").agg((F.floor((F.count("*") - 1) / CLASS_STREAMS) + 1).alias("classes"))
    groups = sums.select("h", F.explode("bodies").alias("body")).distinct().groupBy("h").agg(F.sort_array(F.collect_list("body")).alias("groups"))
    host = count.join(groups, "h", "left").withColumnRenamed("h", "of")
    dealt = sums.join(host, F.col("h") == F.col("of")).withColumn("c", F.pmod(F.xxhash64("stream"), F.col("classes")))
    one = dealt.select("h", "c", "stream", "fixed", "low", "high", "groups").groupBy("h", "c").applyInArrow(_class_wrapper, "h string, c long, wrapper binary")
    return one.groupBy("h").applyInArrow(_host_wrapper, "h string, wrapper binary")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url and the main text.

    Null html counts as empty, and pages without text give an empty one. Pages without a URL share a
    wrapper of their own. Nothing is cut from very long pages; repeated rows give equal texts and an
    empty table an empty result; other columns are ignored.
    """
    own = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    known = written(wrappers(own), "html-wrappers")
    size = known.agg(F.coalesce(F.sum(F.octet_length("wrapper")), F.lit(0))).first()[0]
    known = F.broadcast(known) if size <= BROADCAST_BYTES else known
    joined = own.join(known, host_of(F.col("url")) == F.col("h"), "left").select("id", "url", "html", "wrapper")
    kind = own.schema["id"].dataType.simpleString()
    return joined.mapInArrow(_extract, f"id {kind}, url string, text string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
