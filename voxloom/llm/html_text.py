"""HTML extraction by a site style tree.

Pages of one host are merged into a tree of style nodes (path of tag, class and id from the root). A node's
importance joins how varied its presentation is over the pages (entropy of the sequences of its children) and
how varied the content below it is (one less the mean entropy of its texts over the pages: what stands on every
page says nothing). Branches of low importance are removed from each page of the host, also within articles; a page
whose article would go altogether keeps it, as an article printed on many pages is no less one.

The tree alone takes an advert that changes from page to page for content, so names are looked at, too: ``nav``,
``footer``, ``aside``, ``form`` and the like, and classes, ids and roles that say advert, menu, comment and so on, are
left out of the tree; ``article`` and ``main`` say where the text is, whatever else they are called. A class that
says both (``post share``) leaves it to the tree. A name of several words one of which is a noise word
(``notice-board``) counts only where the element has at most half of the page's (or its article's) text.

Pages are parsed twice and not shuffled: the first pass emits counts of (host, node, feature), combined before
they are shuffled, the second gets each host's list of unimportant nodes, by broadcast if there are at most
``broadcast_rows`` of them, else by a join on host that Spark splits where a host is hot.

Defined results: null html is an empty page with empty text; a null url has the host ''; repeated rows are
pages of their own and get a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, worker

#: HTML's elements by what they mean here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes noscript template svg math select object".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br td th".split())
CELLS = {"td", "th", "br"}
NOISE_TAGS = set("nav footer header aside form button head menu dialog fieldset".split())
NOISE_NAMES = set(
    "ad ads adbox advert advertisement adverts advertising banner banners breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright dialog disqus disclaimer footer gdpr header "
    "login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion related replies reply respond search share sharing "
    "sidebar signup skip social sponsor sponsored subscribe tagcloud tags toolbar topbar widget widgets complementary contentinfo".split()
)
TEXT_NAMES = set("article entry post story".split())
WHOLE = {"article", "main"}
CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}), "option": ("option", {"select"})}
MARK = re.compile(r"""<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z))""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NOISE, OPEN, MAIN, MAYBE = 0, 1, 2, 3


@lru_cache(1 << 14)
def _element(tag: str, attrs: str) -> tuple[str, int, bool]:
    """Style name, what the element's names say, and whether that is but a header, which an article overrules."""
    found = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)} if attrs else {}
    names = re.sub(r"\d+", "0", f"{found.get('class', '')} {found.get('id', '')}".lower()).split()
    style = ".".join([tag, *sorted(set(names))])
    words = {w for n in [*names, *found.get("role", "").lower().split()] for w in [n, *re.split(r"[-_0]+", n)]}
    hidden = re.search(r"(^|\s)hidden(\s|=|/|$)", re.sub(r"""=\s*("[^"]*"|'[^']*')""", "= ", attrs)) or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden") == "true"
    said = {*names, *found.get("role", "").lower().split()}
    both = bool(said & TEXT_NAMES)
    names = words & NOISE_NAMES if tag not in ("html", "body", *WHOLE) and not both else set()
    if hidden or names or tag in NOISE_TAGS:
        clear = hidden or tag in NOISE_TAGS or said & NOISE_NAMES or names <= {"header"}
        return style, NOISE if clear else MAYBE, not hidden and names <= {"header"} and (tag == "header" or tag not in NOISE_TAGS)
    return style, MAIN if tag in WHOLE or "main" in found.get("role", "") else OPEN, False


def blocks(page: str):
    """Blocks of text in page order, ``(what, path, text, of which in links)``; and the children of each open node, ``(path, names)``."""
    out: list = []
    children: dict[tuple, list[str]] = {}
    stack: list[tuple[str, int, tuple, tuple]] = []  # tag, what it is, path, elements around it that may be noise
    what, path, doubts, parts, linked, in_link = OPEN, (), (), [], 0, 0
    n_doubts = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((what, path, text, min(linked, len(text)), doubts))
            parts, linked = [], 0

    def pop_to(k: int) -> None:
        nonlocal what, path, doubts
        flush()
        del stack[k:]
        what, path, doubts = stack[-1][1:] if stack else (OPEN, (), ())

    while at < n:
        m = MARK.search(page, at)
        end = m.start() if m else n
        if end > at and what != NOISE:
            parts.append(unescape(page[at:end]))
            linked += in_link and end - at
        if not m:
            break
        at, tag = m.end(), m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag in INLINE:
                if tag in CELLS and what != NOISE:
                    parts.append(" ")
                continue
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if k is not None:
                pop_to(k)
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else n
            continue
        if tag in INLINE or tag in VOID:
            if tag == "a":
                in_link = 1
            elif tag in CELLS and what != NOISE:
                parts.append(" ")
            elif tag == "hr":
                flush()
            continue
        for k in range(len(stack) - 1, -1, -1):  # elements that this one closes
            open_tag = stack[k][0]
            if open_tag == "p" or tag in CLOSES and open_tag in CLOSES[tag][0].split():
                pop_to(k)
                break
            if open_tag in (CLOSES[tag][1] if tag in CLOSES else ()) or open_tag in WHOLE:
                break
        style, means, header = _element(tag, m[3].strip())
        flush()
        if what == NOISE:
            overruled = means == MAIN and not any(s[1] == NOISE and not _overruled(s[0]) for s in stack)
            means = MAIN if overruled else NOISE
        else:
            if means == MAYBE:
                n_doubts += 1
                doubts, means = (*doubts, n_doubts), what
            elif what == MAIN:
                means = NOISE if means == NOISE and not header else MAIN
            if means != NOISE:
                children.setdefault(path, []).append(style)
                children.setdefault((*path, style), [])
        what, path = means, (*path, style)
        stack.append((tag, what, path, doubts))
    flush()
    return _settled(out), children


def _settled(found: list) -> list:
    """Blocks without the elements that were in doubt and have at most half of the text around them."""
    total, of = {OPEN: 0, MAIN: 0}, {}
    for what, _, text, _, doubts in found:
        total[what] += len(text)
        for d in doubts:
            size = of.setdefault(d, {OPEN: 0, MAIN: 0})
            size[what] += len(text)
    noise = set()
    for d, size in of.items():
        has, around = (size[MAIN], total[MAIN]) if size[MAIN] else (size[OPEN], total[OPEN] + total[MAIN])
        if 2 * has <= around:
            noise.add(d)
    return [x[:4] for x in found if not noise.intersection(x[4])]


def _overruled(tag: str) -> bool:
    """An article within these is one all the same: their end was left out."""
    return tag in ("nav", "header", "footer", "head", "menu")


def _path_key(path: tuple) -> int:
    import xxhash

    return xxhash.xxh64_intdigest("/".join(path).encode(), 1) - 2**63


def host_of(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][\w+.-]*://([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def style_counts(pages: DataFrame) -> DataFrame:
    """``host, node, kind, feature, n``: pages of a host by children (0) or texts (1) of a node that names don't make noise.
    Pages of one html count once for a host."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        kinds = pa.schema([("host", pa.string()), ("node", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64()), ("page", pa.int64())])
        digest = lambda s: xxhash.xxh64_intdigest(s.encode(), 2) - 2**63
        for b in batches:
            rows = set()
            for url, page in zip(b["url"].to_pylist(), b["html"].to_pylist(), strict=True):
                found, children = blocks(page or "")
                only = MAIN if any(x[0] == MAIN for x in found) else OPEN  # what the text is taken from
                host, k = host_of(url), digest(page or "")
                for path, names in children.items():
                    rows.add((host, _path_key(path), 0, digest(" ".join(x for i, x in enumerate(names) if names[i - 1 : i] != [x])), k))
                for what, path, text, _ in found:
                    if what == only:
                        rows.add((host, _path_key(path), 1, digest(text), k))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    rows = pages.select("url", "html").mapInArrow(worker(run), "host string, node long, kind int, feature long, page long").distinct()
    return rows.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("n"))


def low_branches(counts: DataFrame, *, threshold: float = 0.4, min_pages: int = 4, gamma: float = 0.9) -> DataFrame:
    """``host, node`` of low importance, among nodes with text of their own that stand on at least ``min_pages`` pages.

    A branch goes where all its nodes with text are unimportant, so those are what is listed."""
    by = F.sum(F.when(F.col("kind") == 1, F.col("n")))
    stats = counts.groupBy("host", "node").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log("n"))).alias("look"), F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("m"),
        (F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))) / by).alias("content"),
    )
    log_m = F.log("m")
    look = F.coalesce(1 - F.col("look") / F.col("m") / log_m, F.lit(0.0))
    content = 1 - F.col("content") / log_m
    importance = (1 - gamma) * look + gamma * content
    return stats.filter((F.col("m") >= min_pages) & F.col("content").isNotNull()).filter(importance < threshold).select("host", "node")


def main_text(page: str | None, low: set[int] = frozenset()) -> str:
    """Text of one page, without the branches ``low`` of its host."""
    found, _ = blocks(page or "")
    main = [(path, t) for what, path, t, _ in found if what == MAIN]
    if main:
        stay = [t for path, t in main if not (low and _path_key(path) in low)]
        return "\n".join(stay or [t for _, t in main])
    return "\n".join(t for what, path, t, linked in found if what == OPEN and 2 * linked < len(t) and not (low and _path_key(path) in low))


def extract_text(pages: DataFrame, *, threshold: float = 0.4, min_pages: int = 4, broadcast_rows: int = 50_000) -> DataFrame:
    """Per page: ``page_id, url, text, n_chars``."""
    work = Workspace(pages.sparkSession, "html")
    pages = pages.select("page_id", "url", "html")
    low = work.keep(low_branches(style_counts(pages), threshold=threshold, min_pages=min_pages), "low")
    host = F.lower(F.regexp_replace(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), "^.*@", ""))
    n = low.count()
    rows = pages.withColumn("host", host)
    if n:
        lists = low.groupBy("host").agg(F.collect_list("node").alias("low"))
        rows = rows.join(F.broadcast(lists) if n <= broadcast_rows else lists, "host", "left")
    else:
        rows = rows.withColumn("low", F.expr("cast(null as array<bigint>)"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            low = b["low"].to_pylist()
            texts = [main_text(page, frozenset(x or ())) for page, x in zip(b["html"].to_pylist(), low, strict=True)]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "low").mapInArrow(worker(run), "page_id long, url string, text string, n_chars long")
