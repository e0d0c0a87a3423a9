"""Main text of web pages by differencing each page with its nearest neighbour by URL.

A page becomes text lines (its blocks). Pages are put in order of host and URL path; a page's partner
is the nearest one of another path before or after it, of the same host, whose path shares more
segments. All variants of a path have the same partner. If a host has one path only, its pages are told
apart by the query instead.
The two pages' lines are aligned by their longest common subsequence, and shared lines, which are the
site's and not the page's, are deleted.

Markup is used where differencing cannot know better: lines in navigation, footers, adverts, forms
and the like go even if they differ from page to page, and if a page marks its article, only lines in
it are kept, shared or not (two articles may quote the same passage)."""
from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from ..session import stored
from .neighbours import neighbour_pass

# Elements by what they mean in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre
    section select summary table tbody td tfoot th thead tr ul""".split())
OUTSIDE = frozenset("""aside audio button canvas dialog footer form head iframe map menu nav noscript object
    select svg template video""".split())
# A class or id says what a part of a page is if all its words are of one of these lists or name a frame.
SIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
    consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice notices pagination
    popup promo promoted related respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget
    widgets""".split())
BODY_WORDS = frozenset("article content entry main post story".split())
FRAMES = frozenset("""area bar body bottom box button buttons col column container form global icons inner item items left
    link links list outer page panel primary right row secondary section site slot text top unit wrap wrapper""".split())
SIDE_FRAMES = FRAMES | BODY_WORDS | frozenset("articles head header posts stories title".split())
# Elements that hold parts of a page; only these are the main text by class or id, or a side part by id.
CONTAINERS = frozenset("dd div dl figure li ol section table tbody td tr ul".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
                 r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
TELLING = re.compile(r"class|id|role|itemprop|hidden|style", re.I)     # attributes that are looked at
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
WORD = re.compile(r"[a-z0-9]+")

NO_MARKS = (False,) * 5
SIDE, PLAIN, BODY, ARTICLE = 0, 1, 2, 3       # what a line is by markup, from worst to best


def _named(names: str, words: frozenset[str], frames: frozenset[str]) -> bool:
    """Whether a whole class or id of these says one of `words`: `cookie-notice` and `siteFooter` do,
    `related-work` and `has-sidebar` do not."""
    for name in names.split():
        parts = WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        if not words.isdisjoint(parts) and all(w in words or w in frames or w.isdigit() for w in parts):
            return True
    return False


@lru_cache(1 << 12)
def _marks(attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """What attributes say: side by class, side by id, body by either, main text, hidden."""
    if not TELLING.search(attributes):
        return False, False, False, False, False
    found: dict[str, str] = {}
    for name, *value in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), "".join(value))
    classes, own = found.get("class", ""), found.get("id", "")
    return (_named(classes, SIDE_WORDS, SIDE_FRAMES), _named(own, SIDE_WORDS, SIDE_FRAMES),
            _named(f"{classes} {own}", BODY_WORDS, FRAMES),
            "main" in found.get("role", "").lower().split() or "articlebody" in found.get("itemprop", "").lower().split(),
            "hidden" in found or bool(UNSEEN.search(found.get("style", ""))))


def lines(page: str) -> list[tuple[str, int]]:
    """(text, kind) of every block of a page, in order. White space inside a block is one space."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    side, depth = "", 0                       # the element being left out, and how often it is open
    article = body = 0                        # open elements that hold the main text
    opened: list[tuple[str, int]] = []        # ... by name and kind
    seen_article = False
    at = 0

    def flush():
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                out.append((line, SIDE if depth else ARTICLE if article else BODY if body else PLAIN))
            text.clear()

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        block = name in BLOCKS or name in OUTSIDE
        if block:
            flush()
        elif name == "br":
            text.append(" ")
        if closing:
            if depth and name == side:
                flush()
                depth -= 1
            for k in range(len(opened) - 1, -1, -1):
                if opened[k][0] == name:
                    flush()
                    if opened[k][1] == ARTICLE:
                        article -= 1
                    elif opened[k][1] == BODY:
                        body -= 1
                    del opened[k]
                    break
            continue
        if name in RAW:                       # its content is no markup and no text
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID or attributes.endswith("/"):
            continue
        side_class, side_id, body_name, marked, hidden = _marks(attributes) if attributes else NO_MARKS
        main = name in ("article", "main") or marked
        # inside an article the id of a section is an anchor named by its heading
        by_name = side_class or side_id and name in CONTAINERS and not (name == "section" and article)
        apart = (name in OUTSIDE or by_name and name not in ("html", "body") or name == "header" and not article or hidden)
        if depth:
            if (main and not apart and not seen_article) or (side == "p" and block):
                flush()                       # what was left open ends here
                depth = 0
            elif name == side:
                depth += 1
                continue
            else:
                continue
        if apart:
            flush()
            side, depth = name, 1
            continue
        kind = ARTICLE if main else BODY if body_name and name in CONTAINERS else PLAIN
        if kind == ARTICLE:
            article, seen_article = article + 1, True
        elif kind == BODY:
            body += 1
        if kind != PLAIN or any(o[0] == name for o in opened):
            opened.append((name, kind))
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Places in `a` of a longest common subsequence of two lists of line hashes."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    shared = set(range(head)) | set(range(len(a) - tail, len(a)))
    where: dict[int, list[int]] = {}
    for k in range(len(b) - tail - 1, head - 1, -1):
        where.setdefault(b[k], []).append(k)
    ends: list[int] = []                      # least last place in b of a run of each length
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for k in where.get(a[i], ()):
            n = bisect_left(ends, k)
            link = (i, links[n - 1] if n else None)
            ends[n:n + 1] = [k]
            links[n:n + 1] = [link]
    link = links[-1] if links else None
    while link is not None:
        shared.add(link[0])
        link = link[1]
    return shared


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) without scheme, query, fragment, extension and closing slash."""
    rest = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", (url or "").strip())
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    return host.lower(), re.sub(r"\.[a-zA-Z]{2,5}$", "", path.rstrip("/"))


TRACKING = re.compile(r"(?:utm_\w*|fbclid|gclid|msclkid|mc_[ce]id|_ga|phpsessid|jsessionid)(?:=|$)", re.I)


def split_query(url: str | None) -> str:
    """The query in order of its parts, without those that only track visitors."""
    query = (url or "").strip().partition("#")[0].partition("?")[2]
    return "&".join(sorted(x for x in re.split("[&;]", query) if x and not TRACKING.match(x)))


def _near(a: str, b: str) -> int:
    same = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        same += 1
    return same


def main_text(page: list[tuple[str, int]], hashes: list[int], partner: list[int] | None) -> str:
    """The page's main text, given the line hashes of its partner."""
    shared = common_lines(hashes, partner) if partner is not None else set()
    best = max((kind for _, kind in page), default=SIDE)
    kept = [text for k, (text, kind) in enumerate(page)
            if kind == best != SIDE and (kind == ARTICLE or k not in shared)]
    return "\n\n".join(kept)


COLUMNS = ["page_id", "url", "host", "path", "hashes", "kinds", "texts"]


def _parse(pages: DataFrame) -> DataFrame:
    """Pages as lines: hashes of all, kinds, and the texts of those that may be kept."""
    kinds = {f.name: f.dataType for f in pages.schema}
    schema = T.StructType([
        T.StructField("_key", T.StringType()), T.StructField("_part", T.IntegerType()), T.StructField("_side", T.IntegerType()),
        T.StructField("page_id", kinds["page_id"]), *(T.StructField(n, T.StringType()) for n in ("url", "host", "path")),
        T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("kinds", T.ArrayType(T.ByteType())),
        T.StructField("texts", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, part, side, page_id, url, page in pdf.itertuples(index=False, name=None):
                url = url if isinstance(url, str) else None
                found = lines(page) if isinstance(page, str) else []
                best = max((kind for _, kind in found), default=SIDE)
                rows.append((key, part, side, None if page_id != page_id else page_id, url, *split_url(url),
                             [xxhash.xxh64_intdigest(t) - (1 << 63) for t, _ in found], [k for _, k in found],
                             [t if k == best != SIDE and side == 1 else None for t, k in found]))
            out = pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype=object) for k, n in enumerate(schema.names)})
            yield out

    return pages.select("_key", "_part", "_side", "page_id", "url", "html").mapInPandas(run, schema)


SPAN = "prefix string, low string, high string, earlier string, later string, variants long, queries long"


def _spans(groups: DataFrame, parts: int, outer: int) -> DataFrame:
    """`SPAN` of (prefix, low, high, variants, queries): last key of the group before and first key of
    the one after, if they agree in the first `outer` parts of the prefix."""
    columns = ["prefix", "low", "high", "variants", "queries"]
    schema = T.StructType.fromDDL(SPAN)

    def visit(before, row, after):
        own = row[0].split("\0")[:outer]
        near = [None if x is None or x[0].split("\0")[:outer] != own else x[k] for x, k in ((before, 2), (after, 1))]
        return row[0], row[1], row[2], *near, row[3], row[4]

    return stored(neighbour_pass(groups, F.col("prefix"), columns, visit, schema, parts), "spans")


def _variants(keys: DataFrame, parts: int) -> DataFrame | None:
    """Pins for paths with several rows: their neighbours by path, or where the host has no other path
    those by query. `keys` has _key, of host, path, query and page_id."""
    begin = lambda c, n: F.concat(F.substring_index(c, "\0", n), F.lit("\0"))
    by_query = stored(keys.groupBy(begin("_key", 3).alias("prefix")).agg(
        F.min("_key").alias("low"), F.max("_key").alias("high"), F.count("*").alias("variants")).withColumn("queries", F.lit(1).cast("long")), "queries")
    by_path = by_query.groupBy(begin("prefix", 2).alias("prefix")).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("variants").alias("variants"), F.count("*").alias("queries"))
    if by_path.where("variants > 1").isEmpty():
        return None
    paths = _spans(stored(by_path, "paths"), parts, 1).where("variants > 1")
    found = paths.where("earlier IS NOT NULL OR later IS NOT NULL")
    alone = paths.where("earlier IS NULL AND later IS NULL AND queries > 1 AND variants > queries")
    inside = by_query.withColumn("path", begin("prefix", 2)).join(alone.select(F.col("prefix").alias("path")), "path", "left_semi")
    if not alone.isEmpty():
        found = found.unionByName(_spans(stored(inside.drop("path"), "inside"), parts, 2).where("variants > 1"))
    return found.select("prefix", "low", "high", "earlier", "later")


def extract(pages: DataFrame, parts: int) -> DataFrame:
    """(page_id, url, text, n_chars) of every page row.

    Null or empty html gives an empty text. Pages of one host and path are each other's variants and
    never partners, unless the host has no other path and their queries and lines differ; pages without
    a URL have no partner. All variants are differenced with the same pages: the last row of the path
    (or query) before and the first of the one after. Repeated rows are pages of their own."""
    kind = pages.schema["page_id"].dataType
    result = T.StructType([T.StructField("page_id", T.StringType()), T.StructField("url", T.StringType()),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def visit(before, row, after):
        page_id, url, host, path, hashes, kinds, texts = row
        partner, best = None, -1
        for other in (before, after):
            if not host or other is None or other[2] != host:
                continue
            if other[3] == path and (split_query(other[1]) == split_query(url) or list(other[4]) == list(hashes)):
                continue
            near = _near(path, other[3])
            if near > best:
                partner, best = list(other[4]), near
        text = main_text(list(zip(texts, kinds)), list(hashes), partner)
        return page_id, url, text, len(text)

    @F.pandas_udf("string")
    def order_key(urls: pd.Series) -> pd.Series:
        urls = [u if isinstance(u, str) else None for u in urls]
        return pd.Series(["\0".join(x.replace("\0", " ") for x in (*split_url(u), split_query(u))) for u in urls], dtype=object)

    source = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")    # pandas would make ids beside a null floats
    key = F.concat_ws("\0", order_key("url"), F.coalesce(F.lpad("page_id", 20, "0"), F.lit("")))
    pins = _variants(source.select(key.alias("_key")), parts)
    found = neighbour_pass(source, key, COLUMNS, visit, result, parts, prepare=_parse, pins=pins)
    return found.withColumn("page_id", F.col("page_id").cast(kind))
