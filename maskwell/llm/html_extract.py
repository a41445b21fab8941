"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.textvec import blocks
from maskwell.shipping import map_arrow
from maskwell.sources.tables import read_table

#: Paths are selected whose score reaches this share of the scores' standard deviation.
THRESHOLD = 0.5
#: What multiplies a path's ratio: a name that speaks against an article; an article element, or a first-order heading in the same container, that speaks for one.
AGAINST, FOR = 0.1, 10.0
#: Lengths of a path's steps: elements of running text and containers named like an article's, plain containers and lists with a class or id, other containers with one.
FLOW_STEP, PLAIN_STEP, NAMED_STEP = 0.25, 0.75, 2.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|itemprop|data-ad)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|$|/)""", re.I)
_CLASS = re.compile(r"""(?:^|\s)class\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Elements by their kind in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video xmp noframes noembed".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINER = frozenset("address article aside body center details div footer header html main section".split())
#: Elements that HTML itself defines as something other than an article's text.
NEVER = frozenset("head nav footer aside form button select option datalist label fieldset dialog menu search".split())
#: Class, id or role words that speak against an article.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertorial|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|modals?|overlays?"
    r"|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side|widgets?|rail|footers?|foot|masthead|topbar|toolbar|comments?|commentlist|replies|respond|disqus|discussion"
    r"|share|sharing|social|related|recommended|recommendations|newsletter|subscribe|subscription|signup|login|search|pagination|pager|copyright|legal|disclaimer|skip|complementary|contentinfo|hidden)(?=$|[\s_-])",
    re.I,
)
#: Words in the names of containers that belong to an article.
OWN = re.compile(r"(?:^|[\s_-])(?:article|entry|post|story|content|headline|title|lead|intro|standfirst|main|text|prose)(?=$|[\s_-])", re.I)
#: Names of a page's own header, and beginnings of names that describe a page's layout instead of an element's role.
HEADER_NAMES = frozenset("header headers site-header page-header main-header global-header top-header siteheader pageheader".split())
LAYOUT = ("has-", "with-", "no-", "without-", "layout-", "theme-", "is-")
_CLOSES_P = BLOCK - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption"}
_IMPLIED = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}
_FENCE = frozenset(("table", "article", "main", "body"))
_PUNCT = re.compile(r"[.,;:!?、。，！？…]")


class Path:
    """A tag path: its step's length, whether it is a container's, whether a name on it speaks against an article and whether it is in one, and what its blocks
    add up to."""

    __slots__ = ("parent", "step", "container", "against", "article", "blocks", "chars", "marks", "links", "below")

    def __init__(self, parent: Path | None, step: float, container: bool, against: bool, article: bool):
        self.parent, self.step, self.container, self.against, self.article = parent, step, container, against, article
        self.blocks = self.chars = self.marks = self.links = 0
        self.below: dict[str, Path] = {}

    @property
    def ratio(self) -> float:
        """Text per block, with punctuation per block and the share of text outside links fused into it."""
        if not self.blocks:
            return 0.0
        out = self.chars / self.blocks * (1 + self.marks / self.blocks) * (1 - self.links / max(1, self.chars))
        return out * (AGAINST if self.against else 1.0) * (FOR if self.article else 1.0)


class _Node:
    """An open element: its path, the element that holds its text as a block, the nearest block around it and fence below which end tags don't reach."""

    __slots__ = ("name", "parent", "path", "depth", "out", "link", "holder", "block", "fence", "article")

    def __init__(self, name: str, parent: _Node | None, path: Path, out: bool, link: bool):
        self.name, self.parent, self.path, self.out, self.link = name, parent, path, out, link
        self.depth = parent.depth + 1 if parent else 0
        is_block = name in BLOCK or parent is None or parent.out != out
        self.holder = self if is_block or parent.parent is None else parent.holder
        self.block = self.depth if name in BLOCK or parent is None else parent.block
        self.fence = self.depth if name in _FENCE or parent is None else parent.fence
        self.article = path.article


def _describe(name: str, attrs: str, parent: _Node) -> tuple[bool, bool, bool, float]:
    """(left out, a name against it, an article, length of the step to it) of an element."""
    out = name in NEVER or name == "header" and not parent.article
    against, article, named, own = False, name in ("article", "main"), False, False
    if attrs:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'")
            if key in ("hidden", "data-ad") or key == "aria-hidden" and value.lower() == "true":
                out = True
            elif key == "style":
                out = out or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
            elif key == "itemprop" or key == "role" and value.lower() in ("main", "article"):
                article = article or value.lower() in ("articlebody", "main", "article")
            elif key in ("class", "id", "role"):
                named = named or key != "role" and bool(value)
                own = own or OWN.search(value) is not None
                if name not in ("html", "body", "article", "main"):
                    against = against or any(w in HEADER_NAMES or not w.startswith(LAYOUT) and NAMED.search(w) for w in value.lower().split())
    if name in CONTAINER:
        step = NAMED_STEP if named or name in ("body", "html", "aside", "footer") else PLAIN_STEP
    else:
        step = PLAIN_STEP if named and name in ("ul", "ol", "table", "span", "dl") else FLOW_STEP
    return out, against, article, FLOW_STEP if own and not against else step


class _Reader:
    """One pass over a page. Open elements are also kept by name, so no tag walks up the page."""

    def __init__(self, page: str):
        self.root = self.node = _Node("", None, Path(None, 0.0, True, False, False), False, False)
        self.open: dict[str, list[_Node]] = {}
        self.found: list[tuple[Path, str]] = []
        self.titled: list[Path] = []
        self.parts: list[str] = []
        self.link_chars, self.holder = 0, self.root
        self.read(page)
        for path in self.titled:
            while not path.container:
                path = path.parent
            path.article = True

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text and not self.holder.out:
                path = self.holder.path
                path.blocks += 1
                path.chars += len(text)
                path.marks += len(_PUNCT.findall(text))
                path.links += min(self.link_chars, len(text))
                self.found.append((path, text))
                if self.holder.name == "h1":
                    self.titled.append(path)
            self.parts, self.link_chars = [], 0

    def add(self, raw: str) -> None:
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if self.parts and self.node.out != self.holder.out:
            self.flush()
        if not self.parts:
            self.holder = self.node.holder
        self.parts.append(text)
        if self.node.link:
            self.link_chars += len(text)

    def enter(self, name: str, attrs: str) -> None:
        out, against, article, step = _describe(name, attrs, self.node)
        out = out or self.node.out
        if out != self.node.out:
            self.flush()
        label = f"{name}{'!' if against else ''}{'+' if article else ''}{step}"
        if attrs and (m := _CLASS.search(attrs)):
            label += "." + m[1].strip("\"'").lower()
        above = self.node.path
        path = above.below.get(label)
        if path is None:
            path = above.below[label] = Path(above, step, name in CONTAINER, above.against or against, above.article or article)
        self.node = _Node(name, self.node, path, out, self.node.link or name == "a")
        self.open.setdefault(name, []).append(self.node)

    def leave(self, target: _Node) -> None:
        """Close an element and all that is open inside it; a block ends the text so far."""
        if self.node.block >= target.depth or target.out != target.parent.out:
            self.flush()
        while self.node.depth >= target.depth:
            self.open[self.node.name].pop()
            self.node = self.node.parent

    def innermost(self, names) -> _Node | None:
        return max((self.open[n][-1] for n in names if self.open.get(n)), key=lambda n: n.depth, default=None)

    def read(self, page: str) -> None:
        position, size = 0, len(page)
        while position < size:
            token = _TOKEN.search(page, position)
            if token is None:
                self.add(page[position:])
                break
            self.add(page[position : token.start()])
            position = token.end()
            name = token[2] or token[5]
            if not name:
                continue
            name, attrs = name.lower(), token[3] if token[2] else token[6]
            if token[1] or token[4]:
                target = self.innermost((name,))
                if target is not None and (name in BLOCK or target.depth > self.node.fence):
                    self.leave(target)
                continue
            if name in RAW and not attrs.endswith("/"):
                end = _raw_end(name).search(page, position)
                position = end.end() if end else size
                continue
            if name in VOID:
                if name in BLOCK:
                    self.flush()
                elif name == "br" and self.parts:
                    self.add(" ")
                continue
            if name in _CLOSES_P and (p := self.innermost(("p",))) is not None and p.depth == self.node.block:
                self.leave(p)
            if name in _IMPLIED and (old := self.innermost(_IMPLIED[name])) is not None:
                around = self.innermost(_SCOPE[name])
                if around is None or around.depth <= old.depth:
                    self.leave(old)
            if name in BLOCK:
                self.flush()
            if not (attrs.endswith("/") and name not in BLOCK):
                self.enter(name, attrs)
        self.flush()


def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I)


def path_scores(root: Path) -> dict[int, float]:
    """Score of each path with text, by its identity.

    Two paths are as far apart as the steps from one to the other through the tag tree are long. Smoothing: a path has the largest ratio around, which fades
    with exp(-distance). Fusing: that is multiplied by the square root of the share of the page's text around, which fades likewise, and by what the
    path's text has outside links where that is less than half. Both sums need one walk up and one walk down the tree.
    """
    order, stack = [], [root]
    while stack:
        path = stack.pop()
        order.append(path)
        for below in path.below.values():
            below.article = below.article or path.article
            stack.append(below)
    peak = {id(p): p.ratio for p in order}
    mass = {id(p): p.chars * (AGAINST if p.against else 1.0) for p in order}
    for p in reversed(order):
        if p.parent is not None:
            fade = math.exp(-p.step)
            peak[id(p.parent)] = max(peak[id(p.parent)], fade * peak[id(p)])
            mass[id(p.parent)] += fade * mass[id(p)]
    for p in order:
        if p.parent is not None:
            fade = math.exp(-p.step)
            peak[id(p)] = max(peak[id(p)], fade * peak[id(p.parent)])
            # What the parent has through this path came from here.
            mass[id(p)] += fade * (mass[id(p.parent)] - fade * mass[id(p)])
    total = sum(p.chars * (AGAINST if p.against else 1.0) for p in order) or 1.0
    out = {}
    for p in order:
        if p.blocks:
            linked = p.links / max(1, p.chars)
            out[id(p)] = peak[id(p)] * math.sqrt(min(1.0, mass[id(p)] / total)) * (AGAINST if p.against else 1.0) * (1 - linked if linked > 0.5 else 1.0)
    return out


def threshold_of(scores: list[float]) -> float:
    mean = sum(scores) / len(scores)
    return min(THRESHOLD * math.sqrt(sum((x - mean) ** 2 for x in scores) / len(scores)), max(scores))


def extract(page: str | None) -> str:
    """The text of the blocks on the page's content paths, joined by newlines.

    1. Per root-to-leaf tag path: text and punctuation for each block on it, and the share of text in links. A name that speaks against an
       article, or an element or a first-order heading that speaks for one, multiplies the ratio; what HTML defines as menus, forms, footers and the like is no text here.
    2. The ratios are smoothed over the tree of the page's paths and fused with the share of the page's text around them (:func:`path_scores`).
    3. Paths whose score reaches a share of the scores' standard deviation are the content; their blocks are the result.
    """
    if not page:
        return ""
    reader = _Reader(page)
    scores = path_scores(reader.root.path)
    if not scores:
        return ""
    limit = threshold_of(list(scores.values()))
    return "\n".join(text for path, text in reader.found if scores[id(path)] >= limit and scores[id(path)] > 0)


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to the page_id and url of every row.

    A null or empty page has an empty text, and so has one without text outside menus, forms and the like. Pages cut off anywhere, unclosed and
    crossed elements are read as far as they go. Paths that tie with the threshold are content. Repeated rows, null ids and null addresses are rows like others; other
    columns are not read. An empty table gives an empty result. Rows are independent: no shuffle, time in proportion to the page's length however deep it
    is, and memory for one page and its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in blocks(batches, "html"):
            raw = data.tobytes()
            texts = [extract(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace")) for i in range(rows.num_rows)]
            arrays = [rows.column(0), rows.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html")), run, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(read_table(spark, sf_dir, "pages"))
