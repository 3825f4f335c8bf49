import math
import random
from collections import Counter

import pytest
from brute import rows_of
from hypothesis import given, strategies as st
from pyspark.sql import functions as F

from codexlake.llm import html_text as op

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- ad -->
<div class="ad">Buy</div><article><h1>Title &amp; more</h1><p><b>First  para<br>graph.<p>Second&nbsp;one &eacute; &#x41;</p><ul><li>x<li>y</ul>
<form>Search</form><aside>side</aside><div id="comments"><p>A reader says</p></div><table><tr><td>c1</td><td>c2</td></tr></table></article>
<footer>&copy; 2024</footer></body></html>"""


def test_page():
    assert op.extract(PAGE) == "Title & more\nFirst para graph.\nSecond one é A\nx\ny\nc1\nc2"


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain < text & more", "plain < text & more"),
        ("<p>one<p>two", "one\ntwo"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<main><h1>H</h1><p>x</p><div class='related-posts'>no</div></main><p>outside</p>", "H\nx"),
        ("<article><p>cut off in a ta", "cut off in a ta"),
        ("<article><p>cut off<a href='x", "cut off"),
        ("<article><p>a</p><script>never closed", "a"),
        ("<p>x</b></i>y</p>", "xy"),
        ("<div class='has-sidebar'><article><p>kept</p></article></div>", "kept"),
        ("<article><div class='entry-header'><h1>T</h1></div><p>a</p></article><div class='comments'><article class='comment'><p>no</p></article></div>", "T\na"),
        ("<body><div id='comments'><article><p>no</p></article></div><main><p>yes</p></main></body>", "yes"),
        ("<article><header><h1>In</h1></header><p>b</p></article>", "In\nb"),
    ],
)
def test_shapes(html, text):
    assert op.extract(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("<article><h2 id='Social_history'>History</h2><section class='discussion'><p>Own</p></section><p class='notice'>Note</p><div class='share-price'>12</div></article>", "History\nOwn\nNote\n12"),
        ("<h2 id='comments'>On comments</h2><div class='share-price'>12</div><p>a</p>", "On comments\n12\na"),
        ("<p>a <label>name</label> b</p><form><label>no</label></form>", "a name b"),
        ("<p>a<svg/>b</p><p>c<math />d</p>", "ab\ncd"),
        ("<p>a<svg><g><svg><text>x</text></svg><text>y</text></g></svg>b</p>", "ab"),
        ("<p>a<script>if (1 < 2) '<script>'</script>b</p>", "ab"),
        ("<p>a<svg><path/>never closed", "a"),
        ("<article><p>a</p><div class='comments'><p>no</p></div><div class='ad-container'>no</div><footer>no</footer></article>", "a"),
        ("<body><div class='cookie-bar'>no</div><div class='site-footer'>no</div><div id='navBar'>no</div><p>yes</p></body>", "yes"),
    ],
)
def test_names_and_foreign_elements(spark, html, text):
    assert op.extract(html) == text
    assert op.main_text(frame(spark, [(1, "http://h.example/", html)])).first().text == text


def test_entropy_decides_what_names_only_hint_at(spark):
    """Inside the article, hinting names are drawn at random over blocks that all pages share and blocks of the page's own."""
    rng = random.Random(6)
    names = ["notice", "discussion", "share", "banner", "x7", "q2"]
    for _ in range(3):
        shared, own = rng.sample(names, 3), rng.sample(names, 3)
        page = lambda i: "".join(f"<div class='{n}'>All the same {n}</div>" for n in shared) + "".join(f"<div class='{n} w{k}'>Own {n} of {i}</div>" for k, n in enumerate(own))
        pages = frame(spark, [(i, f"http://h.example/{i}", f"<body><article><p>Text {i}</p>{page(i)}</article></body>") for i in range(30)])
        kept = [n for n in shared if n in ("x7", "q2")]  # 30 pages don't tell a shared block without a hint from a common heading
        want = [(i, "\n".join([f"Text {i}", *(f"All the same {n}" for n in kept), *(f"Own {n} of {i}" for n in own)])) for i in range(30)]
        assert rows_of(op.main_text(pages), "page_id", "text") == sorted(want, key=repr)
        found = {(r.told, r.in_article): (r.low, r.by_entropy) for r in op.decisions(op.node_importance(pages)).collect()}
        assert found[op.HINTED, True][0] == 3 - len(kept) and found.get((op.PLAIN, True), (0, 0))[0] == 0


@given(st.text(alphabet="<>/pabdiv nav=\"'!-&;article", max_size=80))
def test_never_fails(html):
    op.extract(html)


def test_style_tree_finds_unnamed_templates(spark):
    """No element names its purpose: what all pages of the host share goes, the rest stays."""
    rows = [(i, f"http://h.example/{i}", f"<body><div class='x1'>Home Products About</div><div class='x2'><p>Own text {i} of page {i}</p></div><div class='x3'>All rights reserved</div></body>") for i in range(12)]
    rows += [(100, "http://single.example/", "<body><div>Home</div><p>Text</p></body>"), (101, None, None), (102, "http://h.example/e", "")]
    rows += [(200 + i, "http://copy.example/a", "<body><div class='x2'><p>The same page</p></div></body>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("low", F.lit(1))
    want = [(i, f"Own text {i} of page {i}") for i in range(12)] + [(100, "Home\nText"), (101, ""), (102, "")] + [(200 + i, "The same page") for i in range(8)]
    assert rows_of(op.main_text(pages), "page_id", "text") == sorted(want, key=repr)
    assert op.main_text(pages.limit(0)).collect() == []


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_template_inside_the_article(spark):
    """Under meaningless names the tree alone finds what all articles of the host share; emptying it changes the texts."""
    page = "<body><div class='q7'>Site</div><article><h1>Title {0}</h1><div class='k3'>Share this text</div><p>Words {0} of {0}</p><div class='z9'><b>Read on</b></div></article></body>"
    pages = frame(spark, [(i, f"http://h.example/{i}", page.format(i)) for i in range(60)])
    assert rows_of(op.main_text(pages), "page_id", "text") == sorted([(i, f"Title {i}\nWords {i} of {i}") for i in range(60)], key=repr)
    none = op.cut_branches(pages, op.low_branches(op.node_importance(pages)).limit(0))
    assert rows_of(none, "page_id", "text") == sorted([(i, f"Site\nTitle {i}\nShare this text\nWords {i} of {i}\nRead on") for i in range(60)], key=repr)


def test_copies_with_small_changes_keep_their_heading(spark):
    rows = [(i, f"http://h.example/{i}", f"<article><h1>{'The same' if i % 10 else f'Own {i}'}</h1><p>Text {i}</p></article>") for i in range(100)]
    got = dict(rows_of(op.main_text(frame(spark, rows)), "page_id", "text"))
    assert got == {i: f"{'The same' if i % 10 else f'Own {i}'}\nText {i}" for i in range(100)}


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "x", "<b>" * 50_000 + "x", "<article>" * 3_000 + "x", "<i><div>" + "<b>" * 30_000 + "</i>" * 30_000 + "x", "<li>" * 20_000 + "x", "<td>" * 20_000 + "x", "<p>" * 20_000 + "x", "<div class='has-sidebar'>" * 20_000 + "<article>x"])
def test_any_depth(spark, html):
    assert op.extract(html).endswith("x") or "has-sidebar" in html
    assert op.main_text(frame(spark, [(1, "http://h.example/", html)])).first().text in ("x", op.extract(html))


class Node:
    def __init__(self, tag, children):
        self.tag, self.children = tag, children

    def html(self):
        return f"<{self.tag.replace('.', ' class=')}>" + "".join(c if isinstance(c, str) else c.html() for c in self.children) + f"</{self.tag.split('.')[0]}>"


def random_site(rng, n):
    """Bodies of blocks: constant ones, own ones, ones of few variants, menus, nested ones, and articles on some sites."""
    marked, word = rng.random() < 0.5, lambda: f"w{rng.randrange(10**6)}"
    fixed = {f"div.c{k}": [rng.choice(["const", "own", "variants"]), [word() for _ in range(3)]] for k in range(4)}

    def block(name):
        kind, words = fixed[name]
        text = {"const": words[0], "own": word(), "variants": rng.choice(words)}[kind]
        inside = [Node("p", [text])] + ([Node("ul", [Node("li", [word()])])] if rng.random() < 0.3 else [])
        return Node(name, inside)

    for _ in range(n):
        main = [block(k) for k in fixed if rng.random() < 0.9] + [Node("p", [word()])]
        body = [Node("nav", [Node("p", [word()])])] + ([Node("article", main), block("div.c0")] if marked else main)
        yield Node("body", body)


def plain_texts(site):
    """The method in memory: entropies over strings and tuples."""
    trees, seen = [], set()
    for body in site:
        has_article = any(c.tag == "article" for c in body.children)
        nodes = []

        def walk(node, path, under, inside):
            label = node.tag + "!" * (node.tag == "nav")
            path = f"{path}/{label}"
            inside = inside or node.tag == "article"
            named = node.tag == "nav" or has_article and not inside and node.tag != "body"
            under = under or named
            at = len(nodes)
            nodes.append(None)
            texts = {True: [], False: []}
            for c in node.children:
                if isinstance(c, str):
                    texts[under].append(c)
                else:
                    for k, v in walk(c, path, under, inside).items():
                        texts[k] += v
            style = tuple(c.tag + "!" * (c.tag == "nav") + "*" * (c.tag == "article") for c in node.children if not isinstance(c, str))
            own = texts[False] if not under else texts[True] + texts[False]
            nodes[at] = (node, path + "?" * named, named, inside, style, tuple(own))
            return texts

        whole = tuple(walk(body, "", False, False)[False])
        trees.append((body, nodes, whole))
    rows = set()
    for _, nodes, whole in trees:
        merged = {}
        for node, path, named, inside, style, content in nodes:
            if node.tag not in ("body", "article"):
                s, c, *_ = merged.get(path, ((), (), None))
                merged[path] = (s + (style,), c + (content,), named, inside)
        rows |= {(path, whole, *v) for path, v in merged.items()}
    by_path = {}
    for path, _, style, content, named, inside in rows:
        by_path.setdefault(path, []).append((style, content, named, inside))
    low = set()
    for path, found in by_path.items():
        n = len(found)

        def entropy(values):
            return -sum(k / n * math.log(k / n) for k in Counter(values).values()) / math.log(n) if n > 1 else 1.0

        own = (1 - op.CONTENT_WEIGHT) * entropy([f[0] for f in found]) + op.CONTENT_WEIGHT * entropy([f[1] for f in found])
        named, inside = found[0][2:]
        value = (op.NAMED if named else 1) * (n * own + op.PRIOR_PAGES) / (n + op.PRIOR_PAGES)
        if value < (op.LEAST_IN_ARTICLE if inside and not named else op.LEAST):
            low.add(path)
    for _, nodes, _ in trees:
        path_of = {id(node): path for node, path, *_ in nodes}

        def text(node):
            if path_of[id(node)] in low:
                return []
            return [t for c in node.children for t in ([c] if isinstance(c, str) else text(c))]

        yield "\n".join(text(nodes[0][0]))


@pytest.mark.parametrize("seed", range(3))
def test_against_the_method_in_memory(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows, want, cut = [], [], 0
    for h in range(5):
        site = list(random_site(rng, rng.choice([3, 8, 60, 150])))
        for body, text in zip(site, plain_texts(site)):
            rows.append((len(rows), f"https://host{h}.example/{len(rows)}", body.html()))
            want.append((len(want), text))
            cut += text != op.extract(body.html())
    pages = frame(spark, rows).repartition(4)
    assert rows_of(op.main_text(pages), "page_id", "text") == sorted(want, key=repr)
    assert cut
    monkeypatch.setattr(op, "MAX_HELD", 0)  # as with more branches than a task may hold
    assert rows_of(op.main_text(pages), "page_id", "text") == sorted(want, key=repr)
