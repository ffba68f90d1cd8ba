"""Main text of web pages by composite text density.

Every node of the page's tree gets its characters per tag, adjusted for how much of it is links; the sum of
its children's densities says where the text lies. The node with the largest sum is the content, the least
density on its path to the body is the threshold, and other subtrees that reach it give their own
largest-sum node. Elements that are never article text (menus, forms, scripts, adverts, comments, ...) leave
the tree first. Content inside an article or main element is widened to the whole of the outermost one, to the
articles beside it and to the title before it; the threshold pass runs on every page.
"""

from __future__ import annotations

import re
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from wearcast.llm.arrow import as_text, by_slice

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle "
    "mspace mpadded menclose mmultiscripts semantics annotation annotation-xml".split())
RAW = frozenset("script style textarea title noscript template iframe svg object canvas select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these closes an open element of the listed names.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
#: How far such a close may reach.
SCOPE = frozenset("ul ol dl table html body".split())

# What is never article text.
DROP_TAGS = frozenset("nav footer aside button dialog menu head label legend annotation annotation-xml".split()) | RAW
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner cookie "
    "cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup sidebar widget related "
    "recommended share sharing social menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar "
    "comment comments commentlist disqus respond reply replies pagination pager login skip".split())
ARTICLE = ("article", "main")
OUTER_NAMES = DROP_NAMES | {"header"}
COMMENT_NAMES = frozenset("comment comments reply replies related teaser".split())
#: First or last parts of class names that tell what a page has or is about, not what the element is.
STATES = frozenset("has no not non with without hide show category cat tag open closed enabled disabled".split())
GONE, NAMED, REMARKS, FORM = 1, 2, 3, 4
#: An element of such a name stays if it holds more than this share of a page's text and the page has no article;
#: a form (some systems wrap whole pages in one) only if that text has paragraphs or headings, too.
MOST = {NAMED: 0.5, REMARKS: 0.9, FORM: 0.5}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.S)
OPEN_COMMENT = re.compile(r"<!--.*()()()", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _matches(value: str, names: frozenset[str]) -> bool:
    """Whether a class name or id in ``value`` is one of ``names``, or its first or last part is.

    Names that tell a state or subject of the page ('no-sidebar', 'category-promo', 'comment-status-open') don't count.
    """
    for whole in value.split():
        parts = [x.lower() for x in NAME.findall(whole)]
        if parts and (parts[0] in names or parts[-1] in names) and (
                len(parts) == 1 or not (parts[0] in STATES or parts[-1] in STATES or "status" in parts)):
            return True
    return False


def _dropped(tag: str, attributes: str, in_article: bool) -> int:
    """GONE: not article text, whatever it holds; NAMED, REMARKS, FORM: unless it holds the main text.

    Headings have ids made from their words and paragraphs classes about their subject: of a heading no name counts,
    of a paragraph only one that is a word of the lists as a whole.
    """
    if tag in DROP_TAGS:
        return GONE
    if tag == "header":
        return 0 if in_article else GONE
    if tag == "form":
        return FORM
    if not attributes.strip(" /") or tag in ("html", "body"):
        return 0
    values = []
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            values.append(value)
        elif (name == "role" and value.lower() in DROP_ROLES) or name == "hidden" or (
                name == "aria-hidden" and value.lower() == "true") or (
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return GONE
    if tag in HEADINGS:
        return 0
    if tag == "p":
        values = [x for v in values for x in v.split() if x.lower() in OUTER_NAMES]
    if any(_matches(v, COMMENT_NAMES) for v in values):
        return REMARKS
    if tag in ARTICLE or not any(_matches(v, DROP_NAMES if in_article else OUTER_NAMES) for v in values):
        return 0
    return NAMED


class Tree:
    """Nodes in page order; a node's number is above its parent's, so sums run backwards without recursion."""

    def __init__(self, page: str):
        self.tag, self.parent, self.texts = ["body"], [-1], []  # texts: (node, text)
        named: dict[int, int] = {}  # nodes that go by their name or as forms
        ids: dict[int, str] = {}  # ids of those
        stack, articles = [0], [False]
        gone = 0  # place on the stack of the element whose content is left out
        at, length = 0, len(page)
        closes = page.rfind(">")  # behind it only an open comment is markup
        while at < length:
            m = (TOKEN if at <= closes else OPEN_COMMENT).search(page, at)
            end = m.start() if m else length
            if end > at and not gone:
                self.texts.append((stack[-1], unescape(page[at:end]) if "&" in page[at:end] else page[at:end]))
            if not m:
                break
            at = m.end()
            closing, tag, attributes = m.group(1), m.group(2), m.group(3)
            if not tag:
                continue
            tag = tag.lower()
            if tag in RAW and not closing:
                # A slash ends drawings only; elsewhere it means nothing, unless no end tag follows at all.
                slash = attributes.endswith("/")
                if not (slash and tag == "svg"):
                    stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    at = stop.end() if stop else at if slash else length
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[k]] == tag:
                        gone = 0 if k <= gone else gone
                        del stack[k:], articles[k:]
                        break
                continue
            if tag in ("html", "body"):
                continue
            if tag in CLOSES or tag not in INLINE:
                # An open paragraph ends where a block begins; list items, rows and cells end their like.
                for k in range(len(stack) - 1, 0, -1):
                    name = self.tag[stack[k]]
                    if name in CLOSES.get(tag, ()) or (name == "p" and tag not in CLOSES):
                        gone = 0 if k <= gone else gone
                        del stack[k:], articles[k:]
                        break
                    if name in SCOPE or (name not in INLINE and tag not in CLOSES):
                        break
            if gone and tag in VOID:
                continue
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            if tag in VOID:
                if tag == "br" and not gone:
                    self.texts.append((node, " "))
                continue
            if attributes.endswith("/") and tag not in ("p", "div"):
                continue
            stack.append(node)
            articles.append(articles[-1] or tag in ARTICLE)
            kind = 0 if gone else _dropped(tag, attributes, articles[-2])
            if kind == GONE:
                gone = len(stack) - 1
            elif kind:
                named[node] = kind
                if kind != FORM and (tag == "section" or articles[-2]):
                    ids[node] = next((v.strip("\"'") for x, v in ATTRIBUTE.findall(attributes) if x.lower() == "id"), "")
        self.count = len(self.tag)
        self._spare_titled(named, ids)
        self.left_out = self._leave_out(named)
        if named:
            self.texts = [x for x in self.texts if not self.left_out[x[0]]]

    def _spare_titled(self, named: dict[int, int], ids: dict[int, str]) -> None:
        """Sections whose id is made from their own heading, and that hold more prose than links, aren't furniture by
        that id ('related-work', 'navigation'); single words for readers' comments stay so."""
        live = {i for i, x in ids.items() if x and x.lower() not in COMMENT_NAMES}
        if not live:
            return
        at = {i: [0, 0, ""] for i in live}  # characters, those in links, first heading
        for node, text in self.texts:
            words, link, heading, i = "".join(text.split()), False, False, node
            while i >= 0 and words:
                link, heading = link or self.tag[i] == "a", heading or self.tag[i] in HEADINGS
                if i in live:
                    at[i][0] += len(words)
                    at[i][1] += len(words) * link
                    if heading and not at[i][2]:
                        at[i][2] = text
                i = self.parent[i]
        for i, (chars, links, title) in at.items():
            made = "-".join(re.findall(r"\w+", title.lower()))
            if made and made == "-".join(re.findall(r"[^\W_]+", ids[i].lower())) and 3 * links <= chars and chars > 2 * len(title):
                del named[i]

    def _leave_out(self, named: dict[int, int]) -> list[bool]:
        """Which nodes go with the ``named`` elements: all below these but an article and the page's main text."""
        n, parent = self.count, self.parent
        out = [False] * n
        if not named:
            return out
        chars, longest = [0] * n, [0] * n  # longest: characters of the longest article or main element at or below
        for node, text in self.texts:
            chars[node] += len("".join(text.split()))
        prose = [c > 0 and tag in ("p", *HEADINGS) for c, tag in zip(chars, self.tag, strict=True)]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            prose[p] = prose[p] or prose[i]
            if self.tag[i] in ARTICLE and i not in named:
                longest[i] = max(longest[i], chars[i])
            longest[p] = max(longest[p], longest[i])
            chars[p] += chars[i]
        for i in range(1, n):
            if out[parent[i]]:
                out[i] = True
            elif i in named:
                # Short articles inside are teasers or comments beside a longer one elsewhere.
                out[i] = 2 * longest[i] < longest[0] if longest[0] else (
                    chars[i] <= MOST[named[i]] * chars[0] or (named[i] == FORM and not prose[i]))
        return out

    def densities(self) -> tuple[list[float], list[float]]:
        """(composite density, sum of the children's densities) of every node."""
        n = self.count
        chars, links, link_tags = [0] * n, [0] * n, [0] * n
        tags = [0 if out and tag in VOID else 1 for out, tag in zip(self.left_out, self.tag, strict=True)]
        for node, text in self.texts:
            chars[node] += len(text.split()) and len(" ".join(text.split()))
        for i in range(n - 1, -1, -1):
            if self.tag[i] == "a":
                links[i], link_tags[i] = chars[i], tags[i]
            if i:
                p = self.parent[i]
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i]
                link_tags[p] += link_tags[i]
        share = links[0] / max(chars[0], 1)
        density, total = [0.0] * n, [0.0] * n
        for i in range(n - 1, -1, -1):
            c, lc, t, lt = chars[i], links[i], tags[i], link_tags[i]
            if c:
                base = log(c / max(c - lc, 1) * lc + share * c + e)
                # Without any link on the page the base is 1 and plain density remains.
                factor = log(c / max(lc, 1) * t / max(lt, 1)) / log(base) if base > 1 else 1.0
                density[i] = c / t * max(factor, 0.0)
            if i:
                total[self.parent[i]] += density[i]
        return density, total


def _widen(tree: Tree, kept: list[bool]) -> None:
    """Adds to each kept node its outermost article or main element, that one's fellow articles and title."""
    n, parent = tree.count, tree.parent
    outer = [-1] * n  # the outermost article or main element at or above a node
    for i in range(1, n):
        outer[i] = outer[parent[i]] if outer[parent[i]] >= 0 else i if tree.tag[i] in ARTICLE else -1
    roots = {outer[i] for i in range(n) if kept[i] and outer[i] >= 0}
    if not roots:
        return
    chars, links = [0] * n, [0] * n
    for node, text in tree.texts:
        chars[node] += len("".join(text.split()))
    titled, children = [False] * n, [[] for _ in range(n)]
    for i in range(n - 1, 0, -1):
        p = parent[i]
        links[i] = chars[i] if tree.tag[i] == "a" else links[i]
        titled[i] = titled[i] or (tree.tag[i] == "h1" and chars[i] > 0)
        chars[p], links[p], titled[p] = chars[p] + chars[i], links[p] + links[i], titled[p] or titled[i]
        children[p].append(i)
    prose = lambda i: 2 * links[i] <= chars[i]
    # Articles beside a kept one are parts of the same page, however short.
    homes = {parent[i] for i in roots if tree.tag[i] == "article"}
    roots |= {i for h in homes for i in children[h] if tree.tag[i] == "article" and prose(i)}
    for i in roots:
        kept[i] = True
    if any(titled[i] for i in roots):
        return
    # A title before the article belongs to it, and so does what stands between them.
    path = set(roots)
    for i in roots:
        while i > 0:
            i = parent[i]
            path.add(i)
    for p in path - roots:
        held = children[p][::-1]
        if not any(i in path for i in held):
            continue
        first = next(k for k, i in enumerate(held) if i in path)
        title = next((k for k, i in enumerate(held[:first]) if titled[i]), first)
        for i in held[title:first]:
            kept[i] = kept[i] or titled[i] or prose(i)


def _content(tree: Tree) -> list[bool]:
    """Which nodes belong to the main text."""
    n = tree.count
    density, total = tree.densities()
    best = list(range(n))  # of each subtree the node with the largest sum
    for i in range(n - 1, 0, -1):
        p = tree.parent[i]
        if total[best[i]] > total[best[p]]:
            best[p] = best[i]
    kept, reached = [False] * n, [False] * n
    threshold, i = density[best[0]], best[0]
    while i >= 0:
        threshold = min(threshold, density[i])
        i = tree.parent[i]
    for i in range(n):
        if i == 0 or (reached[tree.parent[i]] and density[i] >= threshold):
            reached[i] = True
            kept[best[i]] = True
    _widen(tree, kept)
    for i in range(1, n):
        kept[i] = kept[i] or kept[tree.parent[i]]
    return kept


def main_text(page: str) -> str:
    """The article's blocks in page order, one per line; white space inside a block is one space."""
    tree = Tree(page)
    kept = _content(tree)
    block_of = [0] * tree.count
    for i in range(1, tree.count):
        block_of[i] = block_of[tree.parent[i]] if tree.tag[i] in INLINE else i
    lines: list[str] = []
    held: list[str] = []
    last = -1
    for node, text in tree.texts:
        if block_of[node] != last:
            lines.append("".join(held))
            held, last = [], block_of[node]
        if kept[node]:
            held.append(text)
    lines.append("".join(held))
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(``keep``, text, n_chars): the main text of every page, from its whole source.

    A null or empty page, and one without text, gives ''. Pages are worked on one by one, whatever their keys, so
    repeated rows give repeated results; an empty table gives none; a page of any length is read whole, in one task.
    Broken markup never fails (open elements end with the page, stray end tags are ignored).
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) if x else "" for x in as_text(batch.column(batch.num_columns - 1)).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
            names=[*keep, "text", "n_chars"])

    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in keep)
    return pages.select(*keep, html).mapInArrow(by_slice(work, html), f"{fields}text string, n_chars long")


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
