"""Main text of web pages by consensus host paths.

1. Each page is cut into elements; every container (an element that holds blocks
   of text) is scored by the text of its blocks less what stands in links, and
   half of that goes on to the container around it. The page votes for the
   generalised path of its best container: tags with their class names, digits
   generalised.
2. Spark counts the votes by host and path; none is cut off.
3. Each page's own containers meet the votes that other pages of the host gave
   their paths. The page takes the path of most ``score * sqrt(votes)`` (its own
   best where no other page voted for any of its paths), so a teaser on the
   majority's path does not stand for an article on another voted path.
4. The path is widened to the article or main element around it; without one, to
   the containers around it as long as what they add is less text than is held
   and little of it stands in links. So title, lead and smaller sections beside
   the best container stay.

Boilerplate elements (menus, adverts, forms ..., by tag or class name) never
score and are left out of the text. Containers of comments, replies and responses
go by name wherever they stand, sections included. Names that articles use as well
(discussion, related, legal ...), and any other name in the id of a section, count
only where over SOFT_SHARE of the element's text stands in links or it holds a form
control, and never on headings. Headers inside an article stay if they hold a
heading, banners if they are named as an image. Hidden elements are text like any
other. Character references are decoded, white space in a block becomes one space,
blocks are joined by a line feed.

A page is parsed once in each of the two passes, in time and memory linear in its
length: paths are the nodes of a tree (each path once, whatever its elements), and
a path is known to other pages by a 64-bit hash of its steps.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrec.llm.common import materialize, ship

# Fixed sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template svg annotation annotation-xml".split())
MATH = frozenset("math semantics menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split())
INLINE = MATH | frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
HEAD_ONLY = frozenset("head base link meta title".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article section div main table td th ul ol dl blockquote body html form aside nav header footer".split())
CONTAINERS = frozenset("body div article section main td center".split())  # text right in them counts for them
BOILER_TAGS = frozenset("nav footer aside form button select menu dialog object canvas audio video".split())
COMMENT_NAMES = frozenset("comment comments commentary disqus reply replies respond response responses".split())
# words beside them that make the name of such a container (alone they name nothing)
COMMENT_PARTS = frozenset("all area block body bottom box card container content count entry feed footer form group header holder id inner item items label layout list main meta module nested new node number "
                          "outer page panel part post public reader readers region respondents root row section single site slot text thread threads title top user users view widget wrap wrapper".split())
HEADER_NAMES = frozenset("header masthead".split())  # of an article's own header too
IMAGE_NAMES = frozenset("figure hero image images img photo picture".split())  # a banner of that kind is no advert
ARTICLE_NAMES = frozenset("article entry post story".split())
BOILER_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
                         "aside widget footer cookie cookies consent popup modal newsletter subscribe subscription signup login share sharing "
                         "recommended pagination pager toolbar copyright".split())
SOFT_NAMES = frozenset("discussion related legal notice notices social".split()) | COMMENT_NAMES
SOFT_SHARE = 0.3  # of an element's text in links, that makes it boilerplate by a soft name
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("form button select input textarea".split())
LINK_SHARE = 0.2  # of what an element adds around the best container, at most
GOOD_NAMES = frozenset("article content main post entry story body text".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "node", "boiler", "block", "container", "around", "article", "soft")

    def __init__(self, tag, node, boiler, block, container, around, article, soft):
        self.tag, self.node, self.boiler = tag, node, boiler
        self.block = block  # whether it is a block
        self.container = container  # node that its text counts for
        self.around = None if block else around  # the block that an inline element is in
        self.article = article  # whether it is in an article
        self.soft = soft  # number of the nearest element around that is boilerplate by its content only, or -1


class Page:
    """The paths of a page as a tree, and its blocks in order."""

    def __init__(self):
        self.up, self.step, self.hash, self.depth = [0], [""], [PATH_ROOT], [0]  # of each path; 0 is the page itself
        self.known: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, int, str, int]] = []  # container, own path, text, characters in links

    def node(self, up: int, step: str) -> int:
        found = self.known.get((up, step))
        if found is None:
            found = self.known[up, step] = len(self.up)
            self.up.append(up)
            self.step.append(step)
            self.hash.append(path_hash(step, self.hash[up]))
            self.depth.append(self.depth[up] + 1)
        return found

    def scores(self) -> dict[int, float]:
        """Score of each container."""
        out: dict[int, float] = {}
        for node, _, text, linked in self.blocks:
            worth = max(0.0, len(text) - 2.0 * linked)
            out[node] = out.get(node, 0.0) + worth
            out[self.up[node]] = out.get(self.up[node], 0.0) + worth / 2
        return {n: v * (1.5 if set(_NAME.split(self.step[n])) & GOOD_NAMES else 1.0) for n, v in out.items() if v > 0}

    def best(self, scores: dict[int, float]) -> int | None:
        """The best container: the deeper, then the one of the smaller hash, on a tie."""
        return min(scores, key=lambda n: (-scores[n], -self.depth[n], self.hash[n])) if scores else None

    def widened(self, node: int) -> int:
        """The path of the article around ``node``."""
        for tag in ("article", "main"):
            n = node
            while n:
                if self.step[n].split(".")[0] == tag:
                    return n
                n = self.up[n]
        chars, links = [0] * len(self.up), [0] * len(self.up)
        for at, _, text, linked in self.blocks:
            chars[at] += len(text)
            links[at] += linked
        for n in range(len(self.up) - 1, 0, -1):  # a path comes after the one around it
            chars[self.up[n]] += chars[n]
            links[self.up[n]] += links[n]
        first, up = node, self.up[node]
        while up:
            added = chars[up] - chars[node]
            if added and (added >= chars[node] or links[up] - links[first] > LINK_SHARE * added):
                break
            if added:
                node = up
            up = self.up[up]
        return node

    def text(self, node: int) -> str:
        """Blocks inside elements on the path."""
        inside = [n == node for n in range(len(self.up))]
        for n in range(1, len(self.up)):
            inside[n] = inside[n] or inside[self.up[n]]
        return "\n".join(t for _, own, t, _ in self.blocks if inside[own])


PATH_ROOT = 0


def path_hash(step: str, up: int = PATH_ROOT) -> int:
    """Hash of a path (signed 64-bit) from its last step and the hash of the path around it."""
    h = xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), up & ((1 << 64) - 1))
    return h - (1 << 64) if h >> 63 else h


def _attributes(attrs: str, names) -> list[tuple[str, str]]:
    """``(name, value)`` of the asked attributes, the first of each name."""
    out = {}
    for m in _ATTR.finditer(attrs):
        if (name := m[1].lower()) in names:
            out.setdefault(name, m[2] or m[3] or m[4] or "")
    return list(out.items())


HARD, SOFT, HEADER = 1, 2, 3


def _kind(tag: str, attrs: str) -> int:
    """HARD: boilerplate; SOFT: if its text speaks for it; HEADER: unless it stands in
    an article and holds a heading; 0: none."""
    if tag in BOILER_TAGS:
        return HARD
    kind = HEADER if tag == "header" else 0
    if "=" not in attrs or tag in ("html", "body"):
        return kind
    for name, value in _attributes(attrs, ("class", "id", "role")):
        words = {n.lower() for n in _NAME.split(value) if n}
        if tag in HEADINGS:
            if words & BOILER_NAMES and name != "id":
                return HARD
            continue
        if words & COMMENT_NAMES and words <= COMMENT_NAMES | COMMENT_PARTS and not (tag == "article" and words & ARTICLE_NAMES):
            return HARD
        if tag in ("article", "main"):
            continue
        named = words & BOILER_NAMES or "banner" in words and not words & IMAGE_NAMES
        if (named or words & HEADER_NAMES) and name == "id" and tag == "section":
            kind = kind or SOFT
        elif named:
            return HARD
        elif words & HEADER_NAMES:
            kind = HEADER
        elif words & SOFT_NAMES:
            kind = kind or SOFT
    return kind


def _step(tag: str, attrs: str) -> str:
    found = _attributes(attrs, ("class",)) if "class" in attrs.lower() else None
    if not found:
        return tag
    names = sorted({_DIGITS.sub("0", n.lower()).replace("/", "|") for n in found[0][1].split()})
    return ".".join([tag, *names])


def parse(html: str) -> Page:
    """The page's blocks of text outside boilerplate."""
    page = Page()
    root = Element("", 0, False, True, 0, None, False, -1)
    here, depth = root, [root]
    at_tag: dict[str, list[int]] = {}  # places in ``depth`` of the open elements of each tag
    scopes = [0]  # places of those that end a search
    words, linked, links = [], 0, 0
    owner, found = root, []
    softs = []  # [around, characters, in links, form controls, header kind, headings] of the elements to be judged by content

    def flush():
        nonlocal words, linked
        if words:
            text = " ".join("".join(words).split())
            if text and not owner.boiler:
                if owner.soft >= 0:
                    softs[owner.soft][1] += len(text)
                    softs[owner.soft][2] += linked
                found.append((owner.container, owner.node, text, linked, owner.soft))
        words, linked = [], 0

    def add(raw: str):
        nonlocal owner, linked
        around = here.around or here
        if around is not owner:
            flush()
            owner = around
        if here.boiler:  # an inline element of that kind
            return
        text = unescape(raw) if "&" in raw else raw
        words.append(text)
        if links:
            linked += len(text)

    def close_to(i: int):
        nonlocal here, links
        if any(e.block for e in depth[i:]):
            flush()
        for e in reversed(depth[i:]):
            at_tag[e.tag].pop()
            links -= e.tag == "a"
        while scopes[-1] >= i:
            scopes.pop()
        del depth[i:]
        here = depth[-1]

    def close_open(tags) -> None:
        i = max((at_tag[t][-1] for t in tags if at_tag.get(t)), default=0)
        if i and i >= scopes[-1]:
            close_to(i)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            add(html[at:])
            break
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        name = m[2] or m[6]
        if name is None or not (m[4] or m[8]):  # comment, declaration, or a tag that the page's end cuts off
            continue
        tag, attrs = name.lower(), m[3] or m[7] or ""
        if here.soft >= 0:
            if tag in CONTROLS:
                softs[here.soft][3] += 1
            elif tag in HEADINGS:
                softs[here.soft][5] += 1
        if m[1] or m[5]:
            if at_tag.get(tag):
                close_to(at_tag[tag][-1])
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID or attrs.endswith("/") and tag not in SCOPE:
            if tag == "hr":
                flush()
            continue
        if tag in CLOSES_P:
            close_open(("p",))
        if tag in CLOSES:
            close_open(CLOSES[tag])
        block, around = tag not in INLINE, here.around or here
        node = page.node(here.node, _step(tag, attrs)) if block else here.node
        if block:
            flush()
        boiler = here.boiler or tag in HEAD_ONLY
        kind, soft = 0 if boiler else _kind(tag, attrs), here.soft
        if kind == HEADER and not here.article:
            kind = HARD
        if kind in (SOFT, HEADER):
            softs.append([soft, 0, 0, 0, kind == HEADER, 0])
            soft = len(softs) - 1
        article = here.article or tag in ("article", "main") or "class" in attrs and bool(ARTICLE_NAMES & set(_NAME.split(page.step[node])))
        container = node if tag in CONTAINERS or not block else around.node
        here = Element(tag, node, boiler or kind == HARD, block, container, around, article, soft)
        at_tag.setdefault(tag, []).append(len(depth))
        if tag in SCOPE:
            scopes.append(len(depth))
        depth.append(here)
        if tag == "a":
            links += 1
    flush()
    for around, chars, in_links, controls, _, headings in reversed(softs):  # one comes after the one around it
        if around >= 0:
            for i, x in ((1, chars), (2, in_links), (3, controls), (5, headings)):
                softs[around][i] += x
    bad = []
    for around, chars, in_links, controls, header, headings in softs:
        own = not headings if header else bool(controls) or in_links > SOFT_SHARE * chars
        bad.append(own or around >= 0 and bad[around])
    page.blocks = [b[:4] for b in found if b[4] < 0 or not bad[b[4]]]
    return page


def hash_of(path: str) -> int:
    """Hash of a written path (``/html/body/div.content``)."""
    h = PATH_ROOT
    for step in path.split("/")[1:]:
        h = path_hash(step, h)
    return h


def extract(html: str, paths: list[int | str]) -> str:
    """Text of the article around the first of the paths (written, or their hashes)
    that has text on the page, else around its own best."""
    page = parse(html)
    held = {page.hash[0]: 0}
    for container, _, _, _ in page.blocks:
        while container and page.hash[container] not in held:
            held[page.hash[container]] = container
            container = page.up[container]
    for p in paths:
        node = held.get(hash_of(p) if isinstance(p, str) else p)
        if node is not None and page.blocks:
            return page.text(page.widened(node))
    own = page.best(page.scores())
    return page.text(page.widened(own)) if own is not None else ""


def host(url: Column) -> Column:
    """Lower-case host of a URL, empty where there is none."""
    name = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(name)


def candidates(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, key, path, depth, score, best)``: the containers of each page with a
    score above 0 (the hashes of their paths), ``key`` the hash of its HTML; ``best`` is
    1 on the one it votes for."""
    ship(pages)
    schema = pa.schema([("host", pa.string()), ("key", pa.int64()), ("path", pa.int64()), ("depth", pa.int32()), ("score", pa.float64()), ("best", pa.int32())])

    def score(batches):
        for batch in batches:
            out = []
            for h, k, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                page = parse(html.as_py() or "")
                scores = page.scores()
                best = page.best(scores)
                out += [(h, k, page.hash[n], page.depth[n], s, int(n == best)) for n, s in scores.items()]
            yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    keyed = pages.select(host(F.col(url)).alias("host"), F.xxhash64(html).alias("key"), F.col(html).alias("html"))
    return keyed.mapInArrow(score, "host string, key bigint, path bigint, depth int, score double, best int")


def winners(found: DataFrame) -> DataFrame:
    """``(_host, _key, _path)`` of the pages of ``candidates`` that have a path
    other pages of the host voted for; the deeper, then the smaller hash, on a tie."""
    votes = found.filter("best = 1").groupBy("host", "path").agg(F.count("*").alias("votes"))
    others = F.col("votes") - F.col("best")
    voted = found.join(votes, ["host", "path"]).filter(others > 0)
    order = F.struct((-F.col("score") * F.sqrt(others)).alias("w"), (-F.col("depth")).alias("d"), F.col("path"))
    return voted.groupBy(F.col("host").alias("_host"), F.col("key").alias("_key")).agg(F.min(order).getField("path").alias("_path"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """All rows and columns of ``pages`` with ``text`` (replaced if it is there).

    A null or empty page, or one without text outside boilerplate, has an empty
    text. Pages without a host vote together. Repeated rows have the same text each and
    vote each. Pages of any length or depth are read whole. An empty table stays empty.
    """
    best = winners(materialize(candidates(pages, url, html)))
    ship(pages)

    @F.pandas_udf("string")
    def run(page: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([extract(h or "", [] if p is None else [int(p)]) for h, p in zip(page, path)], dtype=object)

    keyed = pages.withColumn("_h", host(F.col(url))).withColumn("_k", F.xxhash64(html))
    joined = keyed.join(best, (F.col("_h") == F.col("_host")) & (F.col("_k") == F.col("_key")), "left")
    return joined.withColumn("text", run(F.col(html), F.col("_path").cast("string"))).drop("_h", "_k", "_host", "_key", "_path")
