"""HTML extraction with a site style tree (Yi, Liu and Li, 2003).

Pages of a host are merged into one tree: elements with the same path of tags and
classes are one node.  Over the m pages that have a node, two entropies are
taken, to the base m: of the layouts of its children (its presentation), and, for
the text it holds itself, of how each feature is spread over pages (one minus the
mean; a feature that all pages share tells nothing).  Features are the words of a
short block and a longer block as a whole.  A node's composite importance is

    (1 - decay**l) * presentation + decay**l * (mean importance of its children and its text)

with l its number of layouts, from the deepest nodes up.  Few pages prove little:
``prior`` pages of full importance are added to each node's own.  What elements
say of themselves weighs in too: those whose tag, role, class or id marks them as
navigation, advertising, forms, notices, comments and the like are nodes apart
from others, and their importance is multiplied by ``marked``.

A branch is removed if its importance is below ``importance`` (within an article,
``inside``, and there only branches that structure a page; marked ones go
anywhere).  An unmarked branch that holds more than ``share`` of its pages' text
stays.  Where a page has an ``article`` or ``main``, only their text counts
(``article`` turns that off, so that the tree alone decides what stands beside).

Text is put together by blocks: character references are decoded, runs of white
space become one blank, blocks are parted by an empty line.

Defined results: null, empty and text-free pages have an empty text; very long
pages are read whole; unclosed and crossing tags are taken as browsers do,
roughly; elements nested deeper than ``depth`` belong to the node they stand in;
pages without a host share the empty one; repeated rows count as pages of their
own and get equal texts; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Tables, mapped, plain_unions, slices, written
from netloom.llm.urls import host_of

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text, up to their own end tag.
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element: what they end, and what stops the search for it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
NOISE_TAGS = frozenset("head nav aside footer form script style noscript template button select input textarea dialog menu iframe svg".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promotions"
    " sidebar sidebars side menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager toc topbar toolbar footer foot masthead"
    " cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login paywall"
    " share sharing social related recommended recommendations comments comment commentlist discussion reply replies respond disqus"
    " search searchform widget widgets skip copyright disclaimer tracking".split()
)
#: Words that stand beside those in names of such elements.
FILLER_WORDS = frozenset("area bar block box button buttons container content footer form group header icons inner item items link links list module panel post posts section title toggle wrap wrapper".split())
#: Elements that an id made of their content does not tell about.
NAMED_BY_CONTENT = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
ROOTS = frozenset(("article", "main"))
#: Elements within an article whose branches the style tree judges.
STRUCTURE = frozenset("div section aside nav header footer form ul ol dl table figure details center".split())


@dataclass(frozen=True)
class Settings:
    decay: float = 0.9
    #: Pages of full importance that each node has besides its own.
    prior: float = 4.0
    #: What the importance of an element is multiplied by that says itself that it is not the page's matter.
    marked: float = 0.35
    #: Importance (0 to 1) under which a branch is removed, beside an article and within one.
    importance: float = 0.4
    inside: float = 0.05
    #: A branch with more of its pages' text than this stays.
    share: float = 0.3
    #: Blocks of more words are one feature.
    short: int = 12
    #: Levels of the tree.
    depth: int = 32
    #: Whether only an article's text counts where a page has one.
    article: bool = True
    #: Low nodes up to this number are sent to every task; more are joined by host.
    broadcast_rows: int = 200_000


@dataclass
class Element:
    tag: str
    path: str
    node: int
    depth: int
    #: In a marked branch; in a low one; in an article.
    marked: bool
    noise: bool
    inside: bool
    layout: list[str] = field(default_factory=list)
    #: Nodes of children that hold text; 0 for a text of its own.
    kids: list[int] = field(default_factory=list)
    features: list[int] = field(default_factory=list)
    chars: int = 0


def hashed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t") else {}


def marks_noise(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element says itself that it is not the page's matter; ``inside``: within an article."""
    if tag in NOISE_TAGS or tag == "header" and not inside:
        return True
    if not attrs:
        return False
    if attrs.get("role", "").lower() in NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if inside:
        # A name counts as a whole: all its words tell of noise, or only say what kind of box it is.
        names = attrs.get("class", "").lower().split() + ([] if tag in NAMED_BY_CONTENT else attrs.get("id", "").lower().split())
        lists = [WORD.findall(n) for n in names]
        return any(w and any(x in NOISE_WORDS for x in w) and all(x in NOISE_WORDS or x in FILLER_WORDS for x in w) for w in lists)
    words = WORD.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())
    return any(w in NOISE_WORDS for w in words) or "header" in words


class Page:
    """One pass over a page: blocks of text, and the elements that hold text, for the style tree."""

    def __init__(self, source: str, low: dict[int, bool] | None = None, gather: bool = False, s: Settings = Settings()) -> None:
        self.low, self.gather, self.s = low or {}, gather, s
        self.blocks: list[tuple[bool, str]] = []  # (within an article, text)
        self.seen: list[tuple[Element, int]] = []  # with the parent's node
        self.stack = [Element("", "", 0, 0, False, False, False)]
        self.buffer: list[str] = []
        self.read(source)

    def flush(self) -> None:
        if not self.buffer:
            return
        words = "".join(self.buffer).split()
        self.buffer.clear()
        if not words:
            return
        top, text = self.stack[-1], " ".join(words)
        if self.gather:
            top.chars += len(text)
            top.kids.append(0)
            top.features += map(hashed, words) if len(words) <= self.s.short else [hashed(text)]
        if not top.noise:
            self.blocks.append((top.inside, text))

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        top = self.stack[-1]
        marked = marks_noise(tag, attrs, top.inside)
        style = tag + "".join(sorted("." + re.sub(r"\d+", "0", c) for c in attrs.get("class", "").split())) + "!" * marked
        deep = top.depth >= self.s.depth and not marked
        path = top.path if deep else f"{top.path}/{style}"
        node = top.node if deep else hashed(path) if self.gather or not top.noise else 0
        noise = top.noise
        if not noise and node in self.low:
            noise = marked or (self.low[node] and tag in STRUCTURE if top.inside else tag not in ("html", "body"))
        marked = marked or top.marked
        e = Element(tag, path, node, top.depth + (not deep), marked, noise, not marked and (top.inside or tag in ROOTS or attrs.get("role", "").lower() == "main"))
        if self.gather and not deep:
            top.layout.append(style)
        self.stack.append(e)

    def pop(self) -> None:
        e = self.stack.pop()
        if not self.gather or not e.chars:
            return
        above = self.stack[-1]
        above.chars += e.chars
        if e.node == above.node:  # nested too deep: a part of the node above
            above.kids += e.kids
            above.features += e.features
            return
        above.kids.append(e.node)
        self.seen.append((e, above.node))

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.pop()

    def start(self, tag: str, raw: str) -> None:
        if tag in ("html", "body") and any(e.tag == tag for e in self.stack):
            return
        if tag in BLOCK or tag in ENDS:
            self.flush()
            # A block ends an open paragraph (and what is open in it).
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth].tag == "p":
                    if tag in BLOCK:
                        self.pop_to(depth)
                    break
                if self.stack[depth].tag in BLOCK:
                    break
            if tag in ENDS:
                ended, stops = ENDS[tag]
                lowest = 0
                for depth in range(len(self.stack) - 1, 0, -1):
                    if self.stack[depth].tag in stops:
                        break
                    if self.stack[depth].tag in ended:
                        lowest = depth
                if lowest:
                    self.pop_to(lowest)
        if tag in VOID:
            if tag == "br":
                self.buffer.append(" ")
            return
        self.push(tag, attributes(raw))

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.stack[depth].tag == tag:
                self.flush_if_block(depth)
                self.pop_to(depth)
                return
            if tag not in BLOCK and self.stack[depth].tag in BLOCK:
                return

    def flush_if_block(self, depth: int) -> None:
        if any(e.tag in BLOCK for e in self.stack[depth:]):
            self.flush()

    def read(self, source: str) -> None:
        at = 0
        while m := MARKUP.search(source, at):
            if m.start() > at:
                self.buffer.append(html.unescape(source[at : m.start()]))
            at = m.end()
            if m[1] is not None:
                self.buffer.append(m[1])
                continue
            if m[3] is None:
                continue
            tag = m[3].lower()
            if m[2]:
                self.end(tag)
                continue
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I)
                at = close.search(source, at).end() if not m[4].rstrip().endswith("/") else at
                continue
            self.start(tag, m[4])
        if at < len(source):
            self.buffer.append(html.unescape(source[at:]))
        self.flush()
        self.pop_to(1)

    def text(self) -> str:
        inside = [t for root, t in self.blocks if root] if self.s.article else []
        return "\n\n".join(inside or [t for _, t in self.blocks])


def style_rows(batch: list[tuple[str, str]], s: Settings) -> Counter:
    """Counts over pages for the style tree: (host, node, depth, kind, feature) of each page's elements that hold text.

    Kinds: ``p`` pages with the node (the feature is its parent), ``x`` the same of
    marked nodes, ``s`` layouts of its children, ``c`` features of its own text, ``w`` parts of it that a child is (0:
    its own text) and ``t`` parts of the page's text that it holds, both in millionths.
    """
    out: Counter = Counter()
    for host, source in batch:
        page = Page(source, gather=True, s=s)
        nodes: dict[int, list[Element]] = defaultdict(list)
        for e, above in page.seen:
            if e.node not in nodes:
                out[host, e.node, e.depth, "p", above] += 1
                if e.path.endswith("!"):
                    out[host, e.node, e.depth, "x", 0] += 1
            nodes[e.node].append(e)
        whole = max(page.stack[0].chars, 1)
        for node, elements in nodes.items():
            key = host, node, elements[0].depth
            out[*key, "s", hashed("|".join(" ".join(e.layout) for e in elements))] += 1
            for f in {f for e in elements for f in e.features}:
                out[*key, "c", f] += 1
            parts: Counter = Counter()
            for e in elements:
                for kid in e.kids:
                    parts[kid] += 1e6 / len(e.kids) / len(elements)
            for kid, part in parts.items():
                out[*key, "w", kid] += round(part)
            out[*key, "t", 0] += round(1e6 * sum(e.chars for e in elements) / whole)
    return out


def importances(pages: DataFrame, s: Settings, tables: Tables) -> DataFrame:
    """(host, node, pages, share, marked, importance) of every node of every host's style tree.

    Counts are summed in the tasks before they are sent.  The tree is worked off
    from its deepest level up, one written table for each, so no host's tree needs to
    fit into a task.
    """
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = style_rows(list(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)), s)
            keys = list(found)
            kinds = pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64()
            yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], kind) for i, kind in enumerate(kinds)), pa.array(list(found.values()), pa.int64())], ["host", "node", "depth", "kind", "feature", "n"])

    counts = mapped(rows, run, "host string, node long, depth int, kind string, feature long, n long").groupBy("host", "node", "depth", "kind", "feature").agg(F.sum("n").alias("n"))
    counts = tables.write(counts, "style-counts")
    # Per node: sums that both entropies follow from, so that no window over a node's features is needed.
    n, log, of = F.col("n"), F.log(F.col("n").cast("double")), lambda kind: F.col("kind") == kind
    sums = counts.groupBy("host", "node", "depth").agg(
        F.sum(F.when(of("p"), n)).alias("pages"),
        F.sum(F.when(of("s"), n * log)).alias("layouts"),
        F.count(F.when(of("s"), 1)).alias("l"),
        F.avg(F.when(of("c"), log)).alias("spread"),
        F.coalesce(F.sum(F.when(of("w") & (F.col("feature") == 0), n)), F.lit(0)).alias("text"),
        F.sum(F.when(of("t"), n)).alias("share"),
        (F.count(F.when(of("x"), 1)) > 0).alias("marked"),
    )
    m, base = F.col("pages"), F.log(F.col("pages").cast("double"))
    presentation = F.when(m > 1, 1 - F.col("layouts") / (m * base)).otherwise(1.0)
    content = F.when(m > 1, 1 - F.coalesce("spread", F.lit(0.0)) / base).otherwise(1.0)
    decay = F.pow(F.lit(s.decay), F.col("l"))
    own = (1 - decay) * presentation + decay * F.col("text") / (1e6 * m) * content
    nodes, seen = tables.counted(sums.select("host", "node", "depth", "pages", (F.col("share") / (1e6 * m)).alias("share"), "marked", decay.alias("decay"), own.alias("own")), "style-nodes", F.max("depth").alias("depth"))
    links = counts.filter(of("w") & (F.col("feature") != 0)).select("host", "node", F.col("feature").alias("child"), (n / 1e6).alias("part"))
    level: DataFrame | None = None
    levels: list[DataFrame] = []
    for depth in range(seen["depth"] or 0, 0, -1):
        here = nodes.filter(F.col("depth") == depth)
        if level is None:
            whole = here.withColumn("below", F.lit(0.0))
        else:
            children = level.select("host", F.col("node").alias("child"), F.col("importance").alias("of"))
            below = links.join(children, ["host", "child"]).groupBy("host", "node").agg(F.sum(F.col("part") * F.col("of")).alias("below"))
            whole = here.join(below, ["host", "node"], "left").withColumn("below", F.coalesce("below", F.lit(0.0)) / F.col("pages"))
        whole = whole.select("host", "node", "pages", "share", "marked", (F.col("own") + F.col("decay") * F.col("below")).alias("importance"))
        level = tables.write(whole, "style-level")
        levels.append(level)
    if not levels:
        return nodes.select("host", "node", "pages", "share", "marked", F.lit(0.0).alias("importance"))
    return functools.reduce(DataFrame.union, levels)


def low_nodes(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(host, node, inside) of every branch of low importance; ``inside``: also within an article."""
    tables = Tables(pages.sparkSession)
    with plain_unions(pages.sparkSession):
        found = importances(pages, s, tables)
        shown = (F.col("pages") * F.col("importance") + s.prior) / (F.col("pages") + s.prior)
        shown = F.round(shown * F.when(F.col("marked"), s.marked).otherwise(1.0), 9)
        low = found.filter(F.col("marked") | (F.col("share") <= s.share)).select("host", "node", shown.alias("shown")).filter(F.col("shown") < max(s.importance, s.inside))
        low = tables.write(low.select("host", "node", (F.col("shown") < s.inside).alias("inside")), "low-nodes")
    tables.drop("style-counts", "style-nodes", "style-level")
    return low


def extracted(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    low = low_nodes(pages, s)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    known: dict[str, dict[int, bool]] = {}
    sent = None
    if low.limit(s.broadcast_rows + 1).count() <= s.broadcast_rows:
        for r in low.toLocalIterator():
            known.setdefault(r["host"], {})[r["node"]] = r["inside"]
        sent = pages.sparkSession.sparkContext.broadcast(known)
        rows = rows.withColumn("low", F.lit(None).cast("array<struct<node: long, inside: boolean>>"))
    else:  # a written table, so that a host with very many pages can be split
        rows = rows.join(written(low.groupBy("host").agg(F.collect_list(F.struct("node", "inside")).alias("low")), "low-of-host"), "host", "left")
    rows = rows.select("page_id", "url", "host", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = []
            for host, source, nodes in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True):
                texts.append(Page(source, sent.value.get(host) if sent else {x["node"]: x["inside"] for x in nodes or ()}, s=s).text())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(rows, run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
