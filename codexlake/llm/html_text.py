"""Main-text extraction with a site style tree.

The DOMs of a host's pages are merged along their element paths (tags and class
names from the top down). Each path of the merged tree has the styles seen
there (the sequence of child elements) and the contents (the text of the
branch). The entropy of each over the pages that have the path, to the base of
their number, is the node's presentation and content importance: a menu that is
the same on all pages has an entropy near 0, an article's text one near 1.
Importance is drawn towards 1 where few pages have the path, and lowered by a
prior. The prior is strong for elements whose kind is not the article (menus,
footers, forms ...), for adverts and reader comments, which differ from page to
page like articles do, and for what lies beside the article where a page marks
one. It is weak for other telling names inside the article: a "notice" or
"discussion" there goes if pages share it and stays if its content is the
page's own. Branches of low importance are cut from each page. Without any name
a branch of the article must be all but constant over many pages to go, as
articles that were copied with small changes share headings.

The tree of a host is never built in one task: pages yield (path, style,
content) rows, and two levels of counting give the entropies. A page is parsed
without recursion into flat lists; hashes stand for paths and texts, and those
of branches are differences of prefix sums, so depth costs nothing.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from codexlake.sources.scratch import written

#: Fixed word lists: elements by their role in HTML, and names that sites give to what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math textarea select canvas audio video title".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CUT_TAGS = frozenset("nav aside footer form menu dialog button search head input fieldset".split()) | RAW
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
CUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sidebar sidebars aside nav navbar navigation navi menu menus header masthead topbar footer bottombar cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus respond reply replies discussion share sharing social related recommended recommendations breadcrumb breadcrumbs crumbs promo promotion sponsor sponsored widget widgets toolbar pagination pager paging copyright disclaimer skip form".split()
)
#: Names of what differs from page to page like articles do, wherever it lies: reader comments, adverts, teasers of other pages.
OTHER_ARTICLES = frozenset("comment comments commentlist disqus reply replies related recommended teaser sponsored sponsor promo ad ads adv advert adverts advertisement advertising adsense".split())
#: Parts of names that say nothing about the content, so the part before them does.
VAGUE = frozenset("container wrapper wrap box area block list links link bar inner outer content section item items button buttons panel zone slot unit top bottom left right main group row col column region holder module post posts article articles story stories news media icon icons tool tools to".split())
#: Elements that an opening tag of the key closes, and where that search ends.
CLOSES_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "option"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(>|\Z)|[^<]++|<", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
#: How much a node's kind or name tells: nothing, something, or that it is no article.
PLAIN, HINTED, APART = 0, 1, 2
#: Importance below which a branch goes, outside marked articles or hinted at, and inside without a hint; the weight of
#: content; the pages that the start value 1 counts for; what is left of the importance of branches apart, and of hinted
#: ones outside and inside articles.
LEAST, LEAST_IN_ARTICLE, CONTENT_WEIGHT, PRIOR_PAGES, NAMED, HINT, HINT_INSIDE = 0.3, 0.05, 0.9, 2, 0.2, 0.25, 0.5
#: Elements that carry nested ones of their kind, and those that can be empty.
NESTED, FOREIGN = frozenset("svg math object template noscript".split()), frozenset("svg math".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Unimportant branches that every task may hold, eight bytes each.
MAX_HELD = 500_000
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1


def _names(tag: str, attributes: dict[str, str]) -> list[str]:
    """What the class names and the id are about: of each the last part that isn't vague. The id of a heading is an anchor."""
    out = []
    for key in ("class",) if tag in HEADINGS else ("class", "id"):
        for name in attributes.get(key, "").split():
            parts = [p.lower() for p in NAME_PARTS.findall(name)]
            while len(parts) > 1 and parts[-1] in VAGUE:
                parts.pop()
            out += parts[-1:]
    return out


def _told(tag: str, attributes: dict[str, str], names: list[str], in_article: bool) -> int:
    """What the element tells about itself."""
    if tag in CUT_TAGS or attributes.get("role", "").lower() in CUT_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return APART
    if tag in ("html", "body", "main"):
        return PLAIN
    if any(p in OTHER_ARTICLES for p in names):
        return APART
    if tag == "article":
        return PLAIN
    return HINTED if (tag == "header" and not in_article) or any(p in CUT_NAMES and not (in_article and p == "header") for p in names) else PLAIN


class Page:
    """A parsed page: nodes in document order, parents before children, and segments of text in document order."""

    def __init__(self):
        self.tag, self.parent, self.path = ["#page"], [0], [0]
        self.told, self.marked, self.in_article = [PLAIN], [False], [False]
        self.beside: list[bool] = []  # not in the article but above it: text straight below such a node is not shown
        self.style, self.first, self.end = [0], [0], [0]
        self.owner: list[int] = []  # of each segment its node
        self.text: list[str | None] = []  # None where a line breaks

    def off(self) -> list[bool]:
        """Nodes that go by what they tell alone: those apart, and hints outside the article."""
        return [t == APART or t == HINTED and not a for t, a in zip(self.told, self.in_article)]

    def say(self, node: int, text: str | None) -> None:
        self.owner.append(node)
        self.text.append(text)


def parse(html: str) -> Page:
    """The page. Missing end tags are implied as browsers do it for paragraphs, list items and tables."""
    page = Page()
    open_, places, blocks = [0], {"#page": [0]}, [0]  # open nodes, and at which depths a tag or a block is open
    soft: list[int] = []  # open nodes whose names count only if no article lies inside

    def depth(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(to: int) -> None:
        while len(open_) > to:
            node = open_.pop()
            tag = page.tag[node]
            places[tag].pop()
            if tag in BLOCKS:
                blocks.pop()
            if tag in BLOCKS or page.marked[node]:
                page.say(node, None)
            if soft and soft[-1] == node:
                soft.pop()
            page.end[node] = len(page.text)

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        if m[2] is None:
            if not html.startswith(("<!", "<?"), m.start()):
                page.say(open_[-1], m[0])
            continue
        if not m[4]:
            break  # cut off inside a tag
        tag = m[2].lower()
        if m[1]:
            place = depth(tag)
            if tag not in VOID and place > 0 and (tag in BLOCKS or place > blocks[-1]):  # else a stray end tag
                close(place)
            continue
        if tag in CLOSES_P and (p := depth("p")) > depth("td", "th", "button", "object"):
            close(p)
        if tag in SIBLINGS and (p := depth(*SIBLINGS[tag])) > depth(*FENCES[tag]):
            close(p)
        above = open_[-1]
        if tag in VOID:
            page.say(above, " ")
            if tag == "hr":
                page.say(above, None)
            continue
        found = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(m[3])}
        label = ".".join([tag, *sorted(found.get("class", "").split())])
        if tag in RAW:
            page.style[above] = (page.style[above] * BASE + xxhash.xxh64_intdigest(label)) & MASK
            if not (tag in FOREIGN and m[3].endswith("/")):
                at = _raw_end(html, tag, at)
            continue
        names, in_article = _names(tag, found), page.in_article[above]
        told = _told(tag, found, names, in_article)
        marked = not told and (tag in ("article", "main") or found.get("role", "").lower() in ("main", "article"))
        if marked and not in_article:  # layout wrappers with telling names, as in "has-sidebar"
            for node in soft:
                page.told[node] = PLAIN
            soft.clear()
        label += "!" * told + "*" * marked
        node = len(page.tag)
        page.style[above] = (page.style[above] * BASE + xxhash.xxh64_intdigest(label)) & MASK
        page.tag.append(tag)
        page.parent.append(above)
        page.path.append(xxhash.xxh64_intdigest(label, page.path[above]))
        page.told.append(told)
        page.marked.append(marked)
        page.in_article.append(marked or in_article)
        page.style.append(0)
        page.first.append(len(page.text))
        page.end.append(len(page.text))
        if tag in BLOCKS or marked:
            page.say(node, None)
        if not m[3].endswith("/") or tag in BLOCKS:
            if tag in BLOCKS:
                blocks.append(len(open_))
            places.setdefault(tag, []).append(len(open_))
            open_.append(node)
            if told == HINTED:
                soft.append(node)
    close(0)
    _find_article(page)
    return page


def _raw_end(html: str, tag: str, at: int) -> int:
    """The place behind the end tag of an element whose content isn't shown; elements of its kind inside some kinds are passed over."""
    open_ = 1
    for m in re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*(>|\Z)", re.IGNORECASE).finditer(html, at):
        if m[1]:
            open_ -= 1
        elif tag in NESTED and not m[0].endswith("/>"):
            open_ += 1
        if not open_:
            return m.end()
    return len(html)


def _find_article(page: Page) -> None:
    """Marked articles with text become the article, those inside a main element before it. What lies beside them counts as apart."""
    n = len(page.tag)
    cut, root, inner = [False] * n, [-1] * n, [False] * n
    for i in range(1, n):
        above = page.parent[i]
        cut[i] = cut[above] or page.told[i] == APART or page.told[i] == HINTED and root[above] < 0
        if not cut[i]:
            root[i] = root[above] if root[above] >= 0 else i if page.marked[i] else -1
            inner[i] = root[i] >= 0 and page.tag[root[i]] != "article" and (page.tag[i] == "article" or inner[above])
    page.in_article, page.beside = [False] * n, [False] * n
    for shown in (inner, [r >= 0 for r in root]):
        if not any(shown[i] and not cut[i] and t and not t.isspace() for i, t in zip(page.owner, page.text)):
            continue
        page.in_article, above_it = shown, [False] * n
        for i in range(n - 1, 0, -1):
            above_it[page.parent[i]] = above_it[page.parent[i]] or above_it[i] or shown[i]
        page.beside = [a and not s for a, s in zip(above_it, shown)]
        for i in range(1, n):
            if not (shown[i] or above_it[i]):
                page.told[i] = APART
        return


def branch_keys(page: Page, host: str) -> np.ndarray:
    """int64: of each node its path's key in the merged tree of the host; 0 where a node is never cut by itself."""
    name = host.encode()
    fixed = [tag in ("#page", "html", "body") or marked and not told for tag, marked, told in zip(page.tag, page.marked, page.told)]
    keys = [0 if f else xxhash.xxh64_intdigest(name, path ^ told) for path, told, f in zip(page.path, page.told, fixed)]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def _is_in(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys are in ``held``, which is sorted."""
    return held[np.minimum(np.searchsorted(held, keys), len(held) - 1)] == keys if len(held) else np.zeros(len(keys), dtype=bool)


def _text(page: Page, low: np.ndarray) -> str:
    """The blocks outside the branches of ``low`` nodes, joined by line feeds."""
    cut = low.tolist()
    for i in range(1, len(cut)):
        cut[i] = cut[i] or cut[page.parent[i]]
    out: list[list[str]] = [[]]
    for node, text in zip(page.owner, page.text):
        if text is None and not cut[node]:
            out.append([])
        elif text and not cut[node] and not page.beside[node]:
            out[-1].append(text)
    lines = [" ".join(unescape("".join(b)).split()) for b in out]
    return "\n".join(x for x in lines if x)


def extract(html: str) -> str:
    """The main text of a page without its site: branches go by what they tell about themselves."""
    page = parse(html)
    return _text(page, np.array(page.off()))


def _sums(page: Page, wanted: list[bool]) -> tuple[np.ndarray, int]:
    """Of each node a hash of the wanted segments' words inside its branch, in order, and that of the whole page."""
    hashes = [xxhash.xxh64_intdigest(" ".join(t.split())) if w and t and not t.isspace() else 0 for t, w in zip(page.text, wanted)]
    h = np.array(hashes, dtype=np.uint64)
    count = np.r_[0, np.cumsum(h != 0)]
    up, down = (np.cumprod(np.r_[np.uint64(1), np.full(int(count[-1]), base, dtype=np.uint64)]) for base in (BASE, INVERSE))
    total = np.r_[np.uint64(0), np.cumsum(h * up[count[:-1]])]
    first, end = np.array(page.first), np.array(page.end)
    return (total[end] - total[first]) * down[count[first]], int(total[-1])


def _style_rows(batches):
    names = ("key", "page", "style", "content", "told", "in_article")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())

    def pack(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for batch in batches:
        rows: list[tuple] = []
        for host, html in zip(batch.column("host"), batch.column("html")):
            page = parse(html.as_py() or "")
            keys = branch_keys(page, host.as_py())
            under = page.off()
            for i in range(1, len(under)):
                under[i] = under[i] or under[page.parent[i]]
            everything, _ = _sums(page, [True] * len(page.text))
            unnamed, whole = _sums(page, [not under[i] for i in page.owner])
            content = np.where(under, everything, unnamed)
            found: dict[int, list] = {}
            for i in np.flatnonzero(keys).tolist():
                row = found.setdefault(int(keys[i]), [0, 0, page.told[i], page.in_article[i]])
                row[0] = (row[0] * BASE + page.style[i]) & MASK
                row[1] = (row[1] * BASE + int(content[i])) & MASK
            rows += [(k, signed(whole), signed(s), signed(c), told, in_article) for k, (s, c, told, in_article) in found.items()]
            if len(rows) > 50_000:
                yield pack(rows)
                rows = []
        yield pack(rows)


def _slim(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def node_importance(pages: DataFrame) -> DataFrame:
    """key, n_pages, presentation, content, told, in_article, own, importance of the paths of all hosts' merged trees.

    ``key`` is that of branch_keys(); a path that tells something on some pages
    only has several. ``own`` is the importance before the prior. Pages whose
    text outside the branches that tell their kind is the same count once.
    Marked articles, html and body have no row, as they are never cut.
    """
    schema = "key long, page long, style long, content long, told int, in_article boolean"
    rows = _slim(pages).select("host", "html").mapInArrow(_style_rows, schema).distinct()
    by_style = F.grouping("content") == 1
    counts = rows.groupingSets([["key", "style"], ["key", "content"]], "key", "style", "content")
    counts = counts.agg(by_style.alias("by_style"), F.count("*").alias("n"), F.max("told").alias("told"), F.bool_or("in_article").alias("in_article"))
    w = F.col("n") * F.log("n")
    sums = counts.groupBy("key").agg(
        F.sum(F.when(F.col("by_style"), F.col("n"))).alias("n_pages"),
        F.max("told").alias("told"),
        F.bool_or("in_article").alias("in_article"),
        F.sum(F.when(F.col("by_style"), w)).alias("style"),
        F.sum(F.when(~F.col("by_style"), w)).alias("content"),
    )
    n = F.col("n_pages")
    entropy = lambda w: F.when(n > 1, (F.log(n) - F.col(w) / n) / F.log(n)).otherwise(1.0)
    own = (1 - CONTENT_WEIGHT) * F.col("presentation") + CONTENT_WEIGHT * F.col("content")
    t = sums.select("key", "n_pages", entropy("style").alias("presentation"), entropy("content").alias("content"), "told", "in_article")
    prior = F.when(F.col("told") == APART, NAMED).when(F.col("told") == HINTED, F.when(F.col("in_article"), HINT_INSIDE).otherwise(HINT)).otherwise(1.0)
    return t.withColumn("own", (n * own + PRIOR_PAGES) / (n + PRIOR_PAGES)).withColumn("importance", prior * F.col("own"))


def least_importance() -> Column:
    """What a branch of node_importance() needs to stay."""
    return F.when(F.col("in_article") & (F.col("told") == PLAIN), LEAST_IN_ARTICLE).otherwise(LEAST)


def low_branches(importance: DataFrame) -> DataFrame:
    """key: the branches to cut."""
    return importance.where(F.col("importance") < least_importance()).select("key")


def decisions(importance: DataFrame) -> DataFrame:
    """told, in_article, branches, low, by_entropy: how many branches go, and how many of these would without the prior."""
    low = F.col("importance") < least_importance()
    return importance.groupBy("told", "in_article").agg(F.count("*").alias("branches"), F.count_if(low).alias("low"), F.count_if(low & (F.col("own") < LEAST)).alias("by_entropy"))


def _page_keys(batches):
    for batch in batches:
        keys = [np.unique(branch_keys(parse(h.as_py() or ""), host.as_py())) for host, h in zip(batch.column("host"), batch.column("html"))]
        n = [len(k) for k in keys]
        rows = pa.array(np.repeat(np.arange(len(n)), n), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("page_id").take(rows), batch.column("page").take(rows), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *keys]))], names=["page_id", "page", "key"])


def _extract(held: np.ndarray | None):
    """``held``: all low branches, or None if each row brings those of its page."""

    def run(batches):
        for batch in batches:
            text = []
            own = batch.column("low") if held is None else [None] * batch.num_rows
            for html, host, low in zip(batch.column("html"), batch.column("host"), own):
                page = parse(html.as_py() or "")
                low = held if held is not None else np.sort(np.array(low.as_py() or (), dtype=np.int64))
                text.append(_text(page, _is_in(branch_keys(page, host.as_py()), low)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def cut_branches(pages: DataFrame, low: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the pages without the branches ``low`` (key).

    Up to MAX_HELD keys are held by every task. More are joined with the
    distinct paths of each page, and a page meets its own ones only.
    """
    low = written(low.select("key").distinct(), "branches")
    schema = "page_id long, url string, text string, n_chars long"
    slim = _slim(pages)
    if low.count() <= MAX_HELD:
        held = np.array(sorted(r["key"] for r in low.collect()), dtype=np.int64)
        return slim.mapInArrow(_extract(held), schema)
    keyed = slim.withColumn("page", F.xxhash64("url", "html"))
    found = keyed.select("page_id", "page", "host", "html").mapInArrow(_page_keys, "page_id long, page long, key long").join(low, "key")
    found = found.groupBy("page_id", "page").agg(F.collect_set("key").alias("low")).alias("f")
    k = keyed.alias("k")
    joined = k.join(found, F.col("k.page_id").eqNullSafe(F.col("f.page_id")) & (F.col("k.page") == F.col("f.page")), "left")
    return joined.select("k.page_id", "k.url", "k.html", "k.host", "f.low").mapInArrow(_extract(None), schema)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row per row of ``pages``.

    A null or empty page has an empty text. Pages whose url is null or names
    no host share the empty host. Truncated and unbalanced markup is read as
    far as it goes, at any depth. Repeated rows repeat; an empty table gives an
    empty result; other columns are ignored.
    """
    return cut_branches(pages, low_branches(node_importance(pages)))
