import html
import math
import os
import random
import re

import pytest

from voxloom.llm import html_text as h

CASES = {
    "<article><h1>A &amp; b</h1><p><b>one<br><p> two\n\t three&nbsp;x</p></article><footer>f</footer>": "A & b\none\ntwo three x",
    "<nav>a<article><header><h1>H</h1></header><p>x < y & z<aside>s</aside><form>f</form>w</article>": "H\nx < y & z\nw",
    "<main>t<script>var a='</main>';</script><style>p{}</style><div class='user-comments'>c</div>u</main>v": "t\nu",
    "plain <i>text</i>": "plain text",
    "": "",
    "<p>a<!-- x": "a",
    "<div hidden>q</div><div style='display: none'>r</div><p title='a>b'>s</p>": "s",
    "<body><p>1<table><tr><td>a<td>b<tr><td>c</table><ul><li>i<li>j</ul>": "1\na b\nc\ni\nj",
    "<div><a href=x>all of it a link</a></div><p>and text": "and text",
    "<section id=comments><article><p>nice</article></section><p>body": "body",
    "&lt;b&gt; &#233;&#x20AC; &unknown; <": "<b> é€ &unknown; <",
}


@pytest.mark.parametrize("page", CASES)
def test_one_page(page):
    assert h.main_text(page) == CASES[page]


def test_long_and_damaged_pages():
    assert len(h.main_text("<article>" + "<p>para <b>x" * 20_000)) == 20_000 * 7 - 1
    assert h.main_text("<" * 1000) == "<" * 1000
    assert h.main_text("<div>" * 300 + "deep") == "deep"


def site(n):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(12))
    rows = []
    for i in range(n):
        body = "\n".join(f"<p>{prose()}</p>" for _ in range(rng.randint(1, 4)))
        rows.append((i, "http://u@Host.example/a", f"<body><div class=top><p>Same words on every page</p><p>always</p></div><div class='text'>{body}</div><div class=end>Terms apply</div></body>"))
    return rows


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_style_tree_removes_what_every_page_has(spark, broadcast_rows):
    rows = site(12)
    other = [(100, "http://other/x", "<div class=top><p>Same words on every page</p></div>"), (101, None, None), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, 7) for r in rows + other], "page_id long, url string, html string, low int").repartition(3)
    got = {}
    for r in h.extract_text(df, broadcast_rows=broadcast_rows).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
        assert r["n_chars"] == len(r["text"])
    want = {i: "\n".join(x[3:-4] for x in p.split("<div class='text'>")[1].split("</div>")[0].split("\n")) for i, _, p in rows}
    assert all(got[i] == [t] for i, t in want.items() if i) and got[0] == [want[0]] * 2
    assert got[100] == ["Same words on every page"] and got[101] == [""]
    assert h.extract_text(df.limit(0)).count() == 0


def test_importance_against_a_plain_count(spark):
    rows = site(9)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    counts = [tuple(r) for r in h.style_counts(df).collect()]
    low = {r["node"] for r in h.low_branches(spark.createDataFrame(counts, "host string, node long, kind int, feature long, n long")).collect()}
    want = set()
    for node in {c[1] for c in counts}:
        texts = [n for _, v, k, _, n in counts if v == node and k == 1]
        looks = [n for _, v, k, _, n in counts if v == node and k == 0]
        m = sum(looks) if texts else 0
        if m >= 4:
            content = 1 - sum(n * math.log(n) for n in texts) / sum(texts) / math.log(m)
            look = -sum(n / sum(looks) * math.log(n / sum(looks)) for n in looks) / math.log(m) if looks else 0
            if 0.1 * look + 0.9 * content < 0.4:
                want.add(node)
    assert low == want and want


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_tables_pages_against_a_pattern(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in h.extract_text(df).collect()}
    for r in df.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert got[r["page_id"]] == "\n".join(x for x in lines if x)


def test_a_header_by_name_stays_in_an_article():
    page = "<article><header class='entry-header'><h1>Title</h1></header><div class=post-header>by</div><div class='share header'>s</div><nav class=header>n</nav><p>text</article>"
    assert h.main_text(page) == "Title\nby\ntext"
    assert h.main_text("<div class=header>h</div><p>text here") == "text here"


def test_copies_of_a_page_do_not_make_its_text_noise(spark):
    page = lambda k: f"<html><body><div class=post><p>text number {k} of many words</p></div></body></html>"
    rows = [(i, f"http://copies.org/{i}", page(0 if i < 30 else i)) for i in range(40)]
    got = h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    assert len(got) == 40 and all(r["text"].startswith("text number") for r in got)


MORE = {
    "<div class='post share'><p>the story</p></div>": "the story",
    "<article class='search'><p>found text</p></article>": "found text",
    "<main><p>short</p><section class='notice-board'><p>a longer text than the rest</p></section></main>": "short\na longer text than the rest",
    "<main><p>a longer text than the notice</p><section class='notice-board'><p>short</p></section></main>": "a longer text than the notice",
    "<div class='page-with-sidebar'><article><p>kept</p></article></div>": "kept",
    "<p>x &am<b>p;</b> y": "x &amp; y",
    "<article><div class='ad'>buy</div><p>t</p></article>": "t",
}


@pytest.mark.parametrize("page", MORE)
def test_names_are_a_hint(page):
    assert h.main_text(page) == MORE[page]


def plain_tree(pages, gamma=0.9, threshold=0.4, min_pages=4):
    """Unimportant nodes of one host by the formulas, over nested lists ``(name, text or children)`` of each page."""
    looks, texts = {}, {}
    for page in pages:
        seen = set()

        def walk(node, path):
            names = [c[0] for c in node if not isinstance(c, str)]
            seen.add(("look", path, " ".join(x for i, x in enumerate(names) if i == 0 or names[i - 1] != x)))
            for c in node:
                if isinstance(c, str):
                    seen.add(("text", path, c))
                else:
                    walk(c[1], (*path, c[0]))

        walk(page, ())
        for kind, path, value in seen:
            of = (looks if kind == "look" else texts).setdefault(path, {})
            of[value] = of.get(value, 0) + 1
    low = set()
    for path, of in texts.items():
        m = sum(looks[path].values())
        if m < min_pages:
            continue
        entropy = -sum(n / m * math.log(n / m) for n in looks[path].values()) / math.log(m)
        content = 1 - sum(n * math.log(n) for n in of.values()) / sum(of.values()) / math.log(m)
        if (1 - gamma) * entropy + gamma * content < threshold:
            low.add(path)
    return low


@pytest.mark.parametrize("around", ["div.text", "article", "div.post.share", "section.search.story", "article.notice"])
def test_extraction_against_a_plain_style_tree(spark, around):
    rng = random.Random(around)
    prose = lambda: " ".join(f"w{rng.randint(0, 400)}" for _ in range(9))
    trees = []
    for i in range(14):
        inner = [("h2", [prose()]), *[("p", [prose()]) for _ in range(rng.randint(1, 3))], ("div.tip", [("p", ["Read more of this every day"])])]
        trees.append([("div.top", [("p", ["Same words on every page"])]), (around, inner), ("div.end", [("p", ["Terms apply" if i % 5 else prose()])])])

    def html_of(node):
        tag, *names = node[0].split(".")
        return f"<{tag}" + (f' class="{" ".join(names)}"' if names else "") + ">" + "".join(c if isinstance(c, str) else html_of(c) for c in node[1]) + f"</{tag}>"

    def texts_of(node, path):
        for c in node:
            yield from [(path, c)] if isinstance(c, str) else texts_of(c[1], (*path, c[0]))

    name = lambda x: ".".join([x.split(".")[0], *sorted(x.split(".")[1:])])
    ordered = lambda node: [c if isinstance(c, str) else (name(c[0]), ordered(c[1])) for c in node]
    rows = [(i, f"http://a.example/{i}", "".join(map(html_of, t))) for i, t in enumerate(trees)]
    low = plain_tree([ordered(t) for t in trees])
    assert any(p[-2:] == ("div.tip", "p") for p in low)
    want = {}
    for i, t in enumerate(trees):
        found = list(texts_of(ordered(t), ()))
        if around.startswith("article"):
            found = [x for x in found if x[0][0] == name(around)]
        want[i] = "\n".join(text for path, text in found if path not in low)
    got = {r["page_id"]: r["text"] for r in h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert got == want


def test_an_article_on_every_page_stays(spark):
    rows = [(i, f"http://a.example/{i}", f"<div><p>beside {i}</p></div><article><h1>Same</h1><p>the same article</p></article>") for i in range(9)]
    got = h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Same\nthe same article"}
