"""HTML extraction: flat text blocks, described by word counts and link densities of themselves and their neighbours, and
classified by a decision tree that is trained on a small labelled table.

A page is read once, tag by tag. Block-level tags end a block; character references are decoded, white space inside a block
(line breaks included) becomes one space. Besides its own and its neighbours' words and link density, a block knows

* whether a tag, role or attribute makes it page furniture, and whether class or id words only suggest it: those of ads, comments
  and teasers (``others``), and all the rest (``named``);
* the share of the page's prose that stands in the container so named: a wrapper that holds the article is no menu;
* whether it stands in an article, else what share of the page's prose does;
* the words of its run, the blocks around it up to the next links or furniture, next to those of the page's longest run.

The tree is grown on blocks of small pages, LAYOUTS, whose labels were written by hand, block by block, and on the same pages
without class and id and without article tags. So no flag decides alone: named furniture that holds most of the prose stays,
and text far from the page's longest run goes where no tag says what it is. An article or main tag outweighs class words of
furniture around it; an article that those words call a comment or a teaser of another page stays furniture.

Text that stands in the article stays: formulas, drawings' labels, what stands in for media. Form controls go, but do not
end a block.

A page is read in time linear in its length. Quoted attribute values may hold ``<`` and ``>``; once a quote is never closed,
later tags of that page end at their first ``>`` if a ``<`` stands in their quotes.

Edge cases: null html is an empty page with an empty text; a cut-off tag at the end is dropped; unclosed elements end with
their container; pages of any length are read whole; a block with fewer words or links on both sides than the tree's cuts
is decided by the same cuts, so equal blocks with equal neighbours tie; repeated rows give repeated results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, table

# HTML vocabulary.
UNREAD = "script style title noscript template iframe select textarea button option datalist".split()
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption hr pre blockquote figcaption summary legend html body div section article aside nav header footer main form fieldset ul ol dl table thead tbody tfoot figure details dialog address menu search head center hgroup label input".split())
CONTAINERS = frozenset("body div section article aside nav header footer main form fieldset ul ol dl table figure details dialog address menu search head blockquote hgroup".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu search dialog head fieldset".split())
FURNITURE_WORDS = frozenset("nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus replies respond breadcrumb breadcrumbs pagination pager toolbar widget form search skip copyright hidden".split())
#: Furniture that is itself made of articles.
OTHERS_WORDS = frozenset("comment comments commentlist disqus replies respond related recommended sponsor sponsored promo promotion ad ads advert adverts advertisement advertising".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_WORDS = frozenset("article content post entry story main".split())

_COMMENTS_AND_UNREAD = rf"<!--.*?(?:-->|\Z)|<({'|'.join(UNREAD)})(?=[\s/>])[^>]*>(?:(?<=/>)|.*?(?:</\1\s*>|\Z))"
#: A tag whose quoted values hold no ``<``: the search for its end goes no further than the next tag.
_PLAIN_TAG = r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^<"]*+"|'[^<']*+')*+)>"""
_QUOTED_TAG = r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
_NO_TAG = r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?/][^>]*+>"""
_TOKEN = re.compile(_COMMENTS_AND_UNREAD + _PLAIN_TAG + _QUOTED_TAG + _NO_TAG, re.S | re.I)
#: Without the second form, whose failure reads to the end of the page.
_SIMPLE = re.compile(_COMMENTS_AND_UNREAD + _PLAIN_TAG + r"|(\b\B)(\b\B)(\b\B)" + _NO_TAG, re.S | re.I)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
#: Names that say what a page has or lacks, not what the element is.
_LAYOUT = re.compile(r"(?<!\S)(?:has|have|with|without|no|is|not)[-_]\S*")
#: What a class word may make of a container that an article in it outweighs, and that only main outweighs.
NAMED = ("named", "others")
FURNITURE = ("furniture", *NAMED)


def tokens(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether it ends, attributes) of all markup in order; the tag is '' for comments and what is unread."""
    at, end, pattern = 0, html.rfind(">") + 1, _TOKEN
    while m := pattern.search(html, at, end):
        tag = m[3] or m[6] or m[9]
        if m[9] and pattern is _TOKEN and ('"' in m[10] or "'" in m[10]):
            pattern = _SIMPLE
        yield m.start(), m.end(), (tag or "").lower(), bool(m[2] or m[5] or m[8]), m[4] or m[7] or m[10] or ""
        at = m.end()
        if at == end:
            break
    at = max(at, end)
    comment, cut = html.find("<!--", at), html.rfind("<")
    if comment >= 0:
        yield comment, len(html), "", False, ""
    elif cut >= at and (cut + 1 == len(html) or html[cut + 1] in "/!?" or html[cut + 1].isascii() and html[cut + 1].isalpha()):
        yield cut, len(html), "", False, ""


class Block(NamedTuple):
    text: str
    words: int
    link_density: float
    furniture: bool = False
    others: bool = False
    named: bool = False
    article: bool = False
    heading: bool = False
    group: int = -1  # number of the outermost container named as furniture


def role_of(tag: str, attributes: str) -> str:
    """'furniture', 'others' or 'named' (furniture by class words only), 'article' or '' for an element, by its tag and attributes."""
    furniture, article, named = tag in FURNITURE_TAGS, tag in ARTICLE_TAGS, set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "role":
            furniture |= value in FURNITURE_ROLES
            article |= value in ("main", "article")
        elif name == "style":
            furniture |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            furniture = True
        elif name in ("class", "id") and tag not in ("body", "html"):
            words = _WORDS.findall(_LAYOUT.sub(" ", value))
            named |= FURNITURE_WORDS.intersection(words)
            article |= not ARTICLE_WORDS.isdisjoint(words)
    if tag in ARTICLE_TAGS:
        named = named & OTHERS_WORDS if tag == "article" else set()
    return "furniture" if furniture else "others" if named & OTHERS_WORDS else "named" if named else "article" if article else ""


def blocks(html: str) -> list[Block]:
    """The page's text blocks, in order."""
    out: list[Block] = []
    open_: list[tuple[str, str, dict[str, int]]] = []  # containers, with their roles and the counts that they set aside
    inside = {"furniture": 0, "others": 0, "named": 0, "article": 0, "": 0}
    text: list[str] = []
    linked: list[str] = []
    link = heading = spans = groups = 0
    local, group = "", -1
    depth: dict[str, int] = {}

    def close() -> None:
        whole = " ".join(unescape("".join(text)).split())
        if whole:
            n = len(whole.split())
            is_a = lambda role: bool(inside[role]) or local == role
            own = group if inside["others"] or inside["named"] else -2 - len(out) if local in NAMED else -1
            out.append(Block(whole, n, min(1.0, len(unescape(" ".join(linked)).split()) / n), is_a("furniture"), is_a("others"), is_a("named"), bool(inside["article"]), bool(heading), own))
        text.clear()
        linked.clear()

    def leave() -> str:
        tag, role, aside = open_.pop()
        inside[role] -= 1
        depth[tag] -= 1
        inside.update(aside)
        return tag

    def say(s: str) -> None:
        if spans:
            return
        text.append(s)
        if link:
            linked.append(s)

    at = 0
    for start, end, tag, ends, attributes in tokens(html):
        if start > at:
            say(html[at:start])
        at = end
        if not tag:
            if html[start : start + 6].lower() == "<title":
                close()
            continue
        if tag == "br":
            say(" ")
        elif tag == "a":
            link = 0 if ends else 1
        elif tag in BLOCKS:
            close()
            heading = link = spans = 0
            local = ""
            if tag in CONTAINERS:
                if ends:
                    if depth.get(tag):
                        while leave() != tag:
                            pass
                else:
                    if tag == "body":  # a head that was not closed ends here
                        while open_:
                            leave()
                    role = role_of(tag, attributes)
                    outweighed = NAMED if tag == "main" else NAMED[:1] if tag == "article" and role == "article" else ()
                    open_.append((tag, role, {k: inside[k] for k in outweighed}))
                    inside.update(dict.fromkeys(outweighed, 0))
                    if role in NAMED and not (inside["others"] or inside["named"]):
                        group = groups = groups + 1
                    inside[role] += 1
                    depth[tag] = depth.get(tag, 0) + 1
            elif not ends:
                heading = tag[0] == "h" and tag[1:].isdigit()
                local = role_of(tag, attributes) if attributes else ""
        elif spans or attributes:  # an inline element of furniture hides its own text only
            if ends:
                spans = max(0, spans - 1)
            elif spans or role_of(tag, attributes) in FURNITURE:
                spans += not attributes.endswith("/") and tag not in ("img", "wbr", "input", "source", "embed")
    if at < len(html):
        say(html[at:])
    close()
    return out


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """What the tree sees of each block, as FEATURES names it."""
    prose = [b.words if b.link_density < 0.5 and not b.furniture else 0 for b in found]
    total = max(1, sum(prose))
    in_group: dict[int, int] = {}
    for b, n in zip(found, prose):
        in_group[b.group] = in_group.get(b.group, 0) + n
    in_article = sum(n for b, n in zip(found, prose) if b.article and not b.others)
    runs, longest, at = [0] * len(found), 1, 0
    for end in range(1, len(found) + 1):
        if end == len(found) or not prose[end] or not prose[at] or found[end][4:7] != found[at][4:7]:
            words = sum(prose[at:end])
            runs[at:end] = [words] * (end - at)
            longest, at = max(longest, words), end
    none = Block("", 0, 0.0)
    return [
        (b.words, b.link_density, before.words, before.link_density, after.words, after.link_density, b.furniture, b.others, b.named, b.article, b.heading,
         0.0 if b.group == -1 else in_group[b.group] / total, 0.0 if b.article else in_article / total, run / longest)
        for before, b, after, run in zip([none, *found], found, [*found[1:], none], runs)
    ]


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "furniture", "others", "named", "article", "heading", "share", "outside", "run")

#: Labelled pages. ``name[...]`` is an element by tag, .class or #id; a number is a block of so many words, + for main text, - for
#: none, ~ for none that only its names tell; a: all of it is a link; /n: the last n words are.
LAYOUTS = (
    "nav[-a1 -a1 -a2 -a1] .ad[-8] article[h1+9 +60 +90 +4 +70 li+3 li+2 +40] footer[-12]", "nav[-a1 -a2] .ad[-7] article[h1+12 +20] footer[-11]",
    "nav[-a1 -a1 -a1 -a2 -a1] .ad[-9] article[h1+3 +6] footer[-9]", "nav[-a2 -a1] .ad[-12] article[h1+1 +1 +2] footer[-8]",
    "header[-3 nav[-a1 -a1 -a1]] .cookie-notice[-17 -a1] #main[h1+5 +40 +25 .ad~2 +55 li+1 li+1 +30] .comments[~9 ~40] form[-1 -2] aside[-6 -a4] footer[-a1 -a2 -5] -1",
    "header[-1 nav[-a1]] .cookie-notice[-13] #main[h1+2 +5 .ad~2 +3 li+1 li+1 +1] .comments[~9] form[-1] aside[-2] footer[-1] -1",
    "-a1 -1 -a2 h1+2 +40 h2+2 +45 +3 +38 li+2 li+2 li+1 +50 -a1 -1 -a2", "-a1 -a1 -a2 -6 -a1 -a3 h1+6 +50 +70 +40 -a4 -a5 -9 -a1", "-a1 -a1 +60 +80 +2 +70 -a5 -a6 -a7 -5 -a1",
    "-a2 -a2 h1+6 +80 +70 -a6 +60 +90 +40 -a3 -a3", "-a20 -a22 -a18 +90 +60 -a25", "+40 -a60", "-a3 -4 -a2 +45", "-a2 -3 -a2 +30", "+30 +3 +30", "+40 +2", "+1", "+9", "+25", "+70/30", "-a3 -a2 -1 -a4",
    "header[-2 -a1 -a1] .content[h1+6 +80 +50/5 +60 .related[h3~2 ~a6 ~a7 ~a5] +45 +70] .sidebar[-3 -a4 -a5 -12] .footer[-a1 -a1 ~8]",
    ".page-header[+60]", ".content-sidebar-wrap[.content[+60]]", "article[.share-price[+60]]", "article[section#form[+60]]", ".press-notice[+60]", "article[section#copyright[+60]]", "article[.menu[+60]]",
    ".nav-wrap[h1+5 +70 +30 +80]", ".widget-area[+45 +60] footer[-9]", "nav[-a1 -a2] .overlay[h1+4 +70 +3 +20 li+2] footer[-12]", "article[h1+8 .search-story[+50 +60 +3] +40]", ".header[-2] .sidebar-left[.content[h1+3 +30 +4 +60]]",
    "article[h1+7 +60 +70 .share[~a1 ~a1 ~1] +50 .newsletter[~12 ~2] +80 .related[~3 ~a8 ~a7] .comments[~30 ~25 ~60]]", "article[h1+6 +50 +40] .comments[~60 ~80 ~75 ~90]", ".post[h1+6 +50 +40] .comments[~60 ~80 ~75 ~90]",
    "article[h1+6 +50 .sidebar[~20 ~a3 ~25] +60 +40 .banner[~6] +30]", ".comments[~60 ~50 ~40] .sidebar[~60]", ".comments[article[~40]] article.comment[~40] .sidebar[~40]", "article.comment[~40 ~3] .comments[~40]", ".ad[~40]", ".comments[~60]",
    "nav[-a1 -a2] main[h1+4 +12 +8 +15 +9 .promo[~10]] aside[-40 -30] footer[-20]", "article[h1+5 +3 +2 +4 +3 +2 +30]", "article[+40/20 +a6 +30/25 +50 +a2]", "article[+1]", "article[+a3]",
    "dialog[-40 -10] article[+60 +50] aside[-70] footer[-30]", "main[+30] aside[-60 -50] menu[-a2 -3]", "article[header[-6 -4] +60 +70 footer[-9] aside[-30 -a3]]", "aside[-60] nav[-20] form[-30] footer[-40]",
    ".sidebar[article[+40] ~41]", ".page.sidebar-right[article[+40 +30]]", ".comments-open[main[+40]] .ad[~1]", "article.post.social-share[+40]", ".menu[~3 ~2] .content[+30 +25 +6] .menu[~a2 ~5]", ".popup[~25 ~4] +80 +60 +90 .subscribe[~14]",
)

_PART = re.compile(r"(\])|((?:[a-z0-9]*)(?:[.#][\w-]+)*)\[|([a-z]+[0-9]?)?((?:\.[\w-]+)?)([+~-])(a?)(\d+)(?:/(\d+))?")


def layout_page(layout: str, names: bool = True, articles: bool = True, scale: float = 1.0) -> str:
    """The HTML of a labelled page; each block's first word is its label. Without ``names`` no class or id is written, without ``articles`` no article tag."""
    out, open_ = [], []

    def attributes(words: str) -> str:
        ids = [w[1:] for w in re.findall(r"#[\w-]+", words)]
        classes = [w[1:] for w in re.findall(r"\.[\w-]+", words)]
        return (f' id="{ids[0]}"' if ids else "") + (f' class="{" ".join(classes)}"' if classes else "") if names else ""

    for end, element, tag, local, label, link, n, linked in _PART.findall(layout):
        if end:
            out.append(f"</{open_.pop()}>")
        elif element:
            of = re.match("[a-z0-9]*", element)[0] or "div"
            open_.append("div" if of in ARTICLE_TAGS and not articles else of)
            out.append(f"<{open_[-1]}{attributes(element[len(re.match('[a-z0-9]*', element)[0]):])}>")
        else:
            size = int(n) if int(n) < 15 else max(15, int(int(n) * scale))
            words = [label, *["word"] * (size - 1)]
            k = len(words) if link else int(int(linked) * size / int(n)) if linked else 0
            said = " ".join(words[: size - k]) + (" <a href=x>" + " ".join(words[size - k :]) + "</a>" if k else "")
            out.append(f"<{tag or 'p'}{attributes(local)}>{said}</{tag or 'p'}>")
    return "".join(out)


def labelled_rows() -> list[tuple[float, ...]]:
    """The tree's table: the features of every block of LAYOUTS, and 1 for main text. Blocks that only names tell count where there are names."""
    rows = []
    for names, articles in ((True, True), (False, True), (False, False)):
        for layout in LAYOUTS:
            for scale in (1.0, 0.6, 1.7):
                found = blocks(layout_page(layout, names, articles, scale))
                for b, row in zip(found, features(found)):
                    known = b.text[0] == "+" or names or b.text[0] == "-" and (articles or b.furniture or b.link_density == 1)
                    if known:
                        rows.append((*row, int(b.text[0] == "+")))
    return rows + neighbour_rows()


#: Neighbours of a block, as words and link density: none, a word, short, partly linked, a link, a list of links, a linked teaser, a paragraph, a long one.
NEIGHBOURS = ((0, 0.0), (1, 0.0), (4, 0.0), (5, 0.5), (2, 1.0), (8, 1.0), (25, 0.9), (12, 0.0), (90, 0.1))
#: Main text or not, for a short block outside of articles, by the neighbour before (rows) and after (columns).
SHORT = ("111000011", "011000011", "011000011", "000000011", "000000011", "000000011", "000000011", "111111111", "111111111")
#: Blocks as words, link density, heading, and main text or not outside of articles; None goes by the neighbours.
OWN = ((1, 0.0, 0, None), (3, 0.0, 1, None), (6, 0.0, 0, None), (7, 0.2, 0, 1), (12, 0.0, 1, 1), (60, 0.4, 0, 1), (2, 1.0, 0, 0), (6, 0.7, 1, 0), (10, 0.8, 0, 0), (70, 0.9, 0, 0))


def neighbour_rows() -> list[tuple[float, ...]]:
    """Rows of OWN between NEIGHBOURS, on pages without any flag, in the page's longest run; in an article, in any run, all are main text."""
    around = [(words, density, *before, *after, heading, int(SHORT[b][a]) if main is None else main) for b, before in enumerate(NEIGHBOURS) for a, after in enumerate(NEIGHBOURS) for words, density, heading, main in OWN]
    bare = [(*row[:6], 0, 0, 0, 0, row[6], 0.0, 0.0, float(row[1] < 0.5), row[7]) for row in around]
    return bare + [(*row[:6], 0, 0, 0, 1, row[6], 0.0, 0.0, run * (row[1] < 0.5), 1) for row in around for run in (0.01, 0.3, 1.0)]


def grow(rows: list[tuple[float, ...]], depth: int = 12) -> tuple | bool:
    """A tree of (feature, cut, below, above) by Gini impurity; leaves say whether a block is main text."""
    good = sum(r[-1] for r in rows)
    if depth == 0 or good in (0, len(rows)):
        return 2 * good > len(rows)
    best: tuple | None = None
    for f in range(len(rows[0]) - 1):
        order = sorted((r[f], r[-1]) for r in rows)
        left = 0
        for i in range(1, len(order)):
            left += order[i - 1][1]
            if order[i][0] > order[i - 1][0]:
                n, right = len(order), good - left
                impurity = left * (i - left) / i + right * (n - i - right) / (n - i)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, (order[i][0] + order[i - 1][0]) / 2)
    if best is None:
        return 2 * good > len(rows)
    _, f, cut = best
    return (f, cut, grow([r for r in rows if r[f] < cut], depth - 1), grow([r for r in rows if r[f] >= cut], depth - 1))


_TREE: list[tuple | bool] = []


def tree() -> tuple | bool:
    if not _TREE:
        _TREE.append(grow(labelled_rows()))
    return _TREE[0]


def decided(node: tuple | bool, row: tuple[float, ...]) -> bool:
    while isinstance(node, tuple):
        node = node[2] if row[node[0]] < node[1] else node[3]
    return node


def main_blocks(found: list[Block], grown: tuple | bool | None = None) -> list[Block]:
    grown = tree() if grown is None else grown
    return [b for b, row in zip(found, features(found)) if decided(grown, row)]


def extract(html: str | None) -> str:
    return "\n".join(b.text for b in main_blocks(blocks(html or "")))


def page_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_blocks): the main text of every page, and how many blocks the page has."""

    grown = tree()  # on the driver, once

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, sizes = [], []
        for html in batch.column(2).to_pylist():
            found = blocks(html or "")
            texts.append("\n".join(b.text for b in main_blocks(found, grown)))
            sizes.append(len(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], names=["page_id", "url", "text", "n_blocks"])

    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return arrow_pass(own, each, "page_id long, url string, text string, n_blocks long")


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
