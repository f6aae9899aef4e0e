"""Main text of HTML pages by flat text blocks and a decision tree.

A page is cut into a flat list of text blocks.  Each block has its word count
and link density, those of its neighbours, and whether it lies in an element
whose name or class speaks for or against main text.  A decision tree
(CART, trained here on the small labelled table below) tells main blocks
from the rest.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmend.llm.common import bounded_batches, text_of

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "inside", "heading")

# Element names and class words, as web pages use them.
_RAW = {"script", "style"}
_DROPPED = {"head", "title", "noscript", "template", "svg", "canvas", "select", "textarea", "button", "iframe", "object", "option", "annotation", "annotation-xml"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
           "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
           "math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mrow", "mfrac", "msup", "msub", "msubsup", "msqrt", "mroot", "mover", "munder",
           "munderover", "mstyle", "mpadded", "mphantom", "mspace"}
_ASIDE = {"nav", "footer", "aside", "form", "dialog", "menu"}
_INSIDE = {"article", "main"}
_ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo recommended "
    "related replies reply share sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_NUMERAL = re.compile(r"&#([0-9]{8,})")
_WORDS = re.compile(r"[a-z]+")
_END = {name: re.compile(rf"</{name}\b", re.I) for name in _RAW}


def _attributes(page: str, at: int, loose: bool) -> tuple[int, dict[str, str]] | None:
    """End of the tag whose name ends at ``at``, and its attributes; the first of a name counts.

    A quoted value is consumed whole.  ``None`` if the page ends before the tag does.  ``loose`` reads no quotes, so the
    tag ends at the next ``>``.
    """
    found: dict[str, str] = {}
    while True:
        at = _GAP.match(page, at).end()
        if at == len(page):
            return None
        if page[at] == ">":
            return at + 1, found
        key = _KEY.match(page, at)
        at = key.end()
        value, equals = "", _EQUALS.match(page, at)
        if equals:
            at = equals.end()
            quote = page[at:at + 1]
            if quote in ('"', "'") and quote and not loose:
                end = page.find(quote, at + 1)
                if end < 0:
                    return None
                value, at = page[at + 1:end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0].strip("\"'"), bare.end()
        found.setdefault(key[0].lower(), value)


def _decoded(text: str) -> str:
    """Character references decoded; numerals beyond all code points, of any length, give U+FFFD."""
    return html.unescape(_NUMERAL.sub(lambda m: f"&#{m[1].lstrip('0')[:8] or 0}", text))


def blocks(page: str) -> list[tuple[str, list[float], int | None]]:
    """``(text, own features, label)`` of the text blocks of a page, in order.

    Block elements bound a block, ``br`` is white space, inline elements are
    nothing.  Character references are decoded and white space becomes one
    space.  Unclosed elements end with what holds them; a tag that never ends
    is text.  The page is read once, in time linear in its length, however
    deep or broken it is.  ``label`` is the nearest ``data-main`` attribute, which only the labelled table has.
    """
    out: list[tuple[str, list[float], int | None]] = []
    stack: list[tuple[str, bool, bool, bool, int | None]] = []  # name, aside, inside, dropped, label
    opened: Counter[str] = Counter()  # elements on the stack by name
    asides = insides = drops = 0
    parts: list[str] = []
    linked = total = 0
    in_link = False
    heading = False
    loose = False  # after a quote that never ends, tags end at the next ">"

    def flush():
        nonlocal linked, total
        text = " ".join(_decoded("".join(parts)).split())
        parts.clear()
        if text:
            words = len(text.split(" "))
            out.append((text, [words, linked / total if total else 0.0, asides > 0, insides > 0, heading], stack[-1][4] if stack else None))
        linked = total = 0

    def add(text):
        nonlocal linked, total
        if text and not drops:
            parts.append(text)
            n = len(text.split())
            total += n
            linked += n * in_link

    def close():
        nonlocal asides, insides, drops
        name, aside, inside, dropped, _ = stack.pop()
        opened[name] -= 1
        asides, insides, drops = asides - aside, insides - inside, drops - dropped
        return name

    begin = at = 0  # text not added yet, place to search from
    while True:
        at = page.find("<", at)
        if at < 0:
            add(page[begin:])
            break
        if page.startswith("<!--", at):
            add(page[begin:at])
            end = page.find("-->", at + 4)
            begin = at = end + 3 if end >= 0 else len(page)
            continue
        tag = _NAME.match(page, at)
        if tag is None and page[at + 1:at + 2] not in ("!", "?"):
            at += 1
            continue
        end = page.find(">", at)
        if end < 0:  # no tag ends any more
            add(page[begin:])
            break
        add(page[begin:at])
        if tag is None:
            begin = at = end + 1
            continue
        attributes: dict[str, str] = {}
        name, closing = tag[2].lower(), bool(tag[1])
        if end > tag.end():
            read = _attributes(page, tag.end(), loose)
            if read is None:
                loose = True
                read = _attributes(page, tag.end(), loose)
            begin, attributes = read
        else:
            begin = end + 1
        at = begin
        if name in _RAW:
            if not closing:
                last = _END[name].search(page, at)
                end = page.find(">", last.end()) if last else -1
                begin = at = end + 1 if end >= 0 else len(page)
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            in_link = not closing
            continue
        if name in _INLINE or name in _VOID and name != "hr":
            continue
        flush()
        in_link = False
        heading = len(name) == 2 and name[0] == "h" and name[1].isdigit() and not closing
        if closing:
            if opened[name] > 0:
                while close() != name:
                    pass
            continue
        if name == "hr":
            continue
        while stack and (stack[-1][0] == "p" or stack[-1][0] == name == "li"
                         or stack[-1][0] == "head" and name == "body"):
            close()
        words = set(_WORDS.findall(" ".join(attributes.get(a, "") for a in ("class", "id", "role")).lower()))
        if name in ("html", "body", "main"):
            aside = False
        elif name == "article":
            aside = bool(words & {"comment", "comments", "ad", "advert", "sponsored"})
        else:
            told = words & _ASIDE_WORDS
            aside = name in _ASIDE or name == "header" and not insides or bool(told - {"header"} if insides else told)
        hidden = "hidden" in attributes or attributes.get("aria-hidden") == "true"
        label = int(attributes["data-main"]) if attributes.get("data-main") in ("0", "1") else stack[-1][4] if stack else None
        inside, dropped = name in _INSIDE, name in _DROPPED or hidden
        stack.append((name, aside, inside, dropped, label))
        opened[name] += 1
        asides, insides, drops = asides + aside, insides + inside, drops + dropped
    flush()
    return out


def features(found: list[tuple[str, list[float], int | None]]) -> np.ndarray:
    """Rows of ``FEATURES``: a block's own and its neighbours' word counts and link densities, and its place."""
    own = np.array([f for _, f, _ in found], np.float64).reshape(-1, 5)
    edge = np.zeros((1, 2))
    before, after = np.r_[edge, own[:-1, :2]], np.r_[own[1:, :2], edge]
    return np.c_[own[:, :2], before[:len(own)], after[:len(own)], own[:, 2:]]


# -- the small labelled table: blocks of invented pages, data-main says whether a block is main text --

_LOREM = ("Rain fell over the harbour all morning while the crews waited for the tide to turn. By noon the first boats left, and those on "
          "shore went back to mending nets and telling stories of the winter before.")
_LEAD = "The council will meet again on Friday to hear what the fishermen think of the new pier and of its price, nobody expects quick answers."
_LABELLED = (
    f'<nav data-main=0><ul><li><a>Home</a><li><a>News</a><li><a>Sport</a><li><a>About us</a></ul></nav><div class=ad data-main=0>Buy two, pay for one this '
    f'week only.</div><article data-main=1><h1>Boats return</h1><p>{_LOREM}<p>Yes.<p>{_LOREM} {_LOREM}<p>No one spoke.</article>'
    f'<footer data-main=0>&copy; 2020 The Harbour. All rights reserved.</footer>',
    f'<header data-main=0><div>The Daily Page</div><a>Sign in</a></header><div class=breadcrumbs data-main=0><a>Home</a> / <a>Town</a></div><main data-main=1>'
    f'<h1>A quiet town</h1><p>Short lead.</p><p>{_LOREM}</p><ul><li>One point made here</li><li>Another point</li></ul><p>{_LOREM}</p>'
    f'<aside data-main=0>See also: <a>A louder town nearby</a></aside><p>The end.</p></main><div id=comments data-main=0><p>Great piece, I liked all of '
    f'it very much.</p><p>{_LOREM}</p></div><footer data-main=0><a>Imprint</a> <a>Privacy</a></footer>',
    f'<div id=cookie-notice data-main=0>We use cookies to make this page better for all of you. <a>Read more</a></div><div class=menu data-main=0><a>One</a> '
    f'<a>Two</a></div><div class=text data-main=1><h2>Plain page</h2><p>{_LOREM}</p><p>{_LOREM}</p></div><div data-main=0><a>Next</a> | <a>Previous</a></div>'
    f'<div class="sidebar" data-main=0><h3>Popular</h3><p>Five things that you did not know about nets and boats</p></div>',
    f'<p data-main=0><a>Home</a> <a>Contact</a> <a>Help</a></p><h1 data-main=1>No containers here</h1><p data-main=1>{_LOREM}</p><p data-main=1>{_LOREM} '
    f'<a>More about it</a>.</p><p data-main=0><a>Imprint</a> <a>Terms of use</a></p>',
    f'<article data-main=1><h1>With a form</h1><p>{_LOREM}</p><form data-main=0><p>Your address</p><p>Send me news about everything once in a while</p></form>'
    f'<p>Then <a>a link alone</a></p><p><a>Only a link in the text</a></p><p>{_LOREM}</p><div class="share" data-main=0>Share this page with your friends</div>'
    f'<div class="ad-box" data-main=0>{_LOREM}</div></article><nav data-main=0><p>{_LOREM}</p><a>Back to top</a></nav>',
    f'<div data-main=0>Monday edition</div><div data-main=0>Mild, some rain</div><div data-main=1>{_LOREM}</div><div data-main=1>Yes.</div><div data-main=1>'
    f'{_LOREM} {_LOREM}</div><div data-main=0>Printed daily</div><div data-main=0>Page 4</div>',
    f'<div data-main=0>Sport</div><div data-main=1>{_LOREM}</div><div data-main=1>No.</div><div data-main=1>{_LOREM} {_LOREM}</div><div data-main=1>{_LOREM}'
    f'</div><div data-main=0>Letters</div><div data-main=0>Write to the editor</div>',
    f'<div data-main=0><a>Harbour and fishing</a> <a>Town and country</a> <a>Weather by the hour</a> <a>Tides of the week</a> <a>Letters to us</a> <a>All '
    f'about the boats</a> <a>Sport on Saturday</a> <a>Older stories here</a></div><div data-main=1>{_LOREM} <a>The first report</a></div><div data-main=1>'
    f'{_LOREM}</div><div data-main=0><a>{_LOREM}</a></div><div data-main=0><a>Ten things that nobody told you about boats and the people who row them out '
    f'at night</a> <a>Why the tide is late this year and what it means for all of us on shore</a></div>',
    f'<table><tr><td data-main=0><a>Front page and the day in pictures</a> <a>Markets and money</a> <a>Culture and books</a> <a>Travel by train</a> <a>Food and '
    f'drink at home</a> <a>Science and the sea</a></td><td data-main=1><p>{_LOREM}</p><p>{_LOREM} {_LOREM}</p><p>It ended there.</p><p>{_LOREM}</p></td></tr><tr>'
    f'<td data-main=0>Made by hand</td><td data-main=0><a>Imprint</a></td></tr></table>',
    f'<div data-main=0><a>Home</a> | <a>Contact</a></div><div data-main=1>{_LEAD}</div><div data-main=1>{_LOREM}</div><div data-main=1>{_LEAD}</div><div '
    f'data-main=0>Printed daily</div><div data-main=0><a>Terms of use</a></div>',
    f'<div data-main=1>{_LEAD}</div><div data-main=1>{_LEAD}</div><div data-main=0><a>Up</a></div>',
    f'<article data-main=1><h1>Short</h1><p>Yes.</p><p>No.</p></article>',
    f'<main data-main=1><p>One line only.</p><p>{_LOREM}</p><p>And <a>a link</a>.</p></main>',
    f'<article data-main=1><h2>Two in all</h2><p>{_LOREM}</p><p><a>{_LOREM}</a></p><p>Of.</p></article>',
    f'<p data-main=1>{_LOREM}</p><p data-main=1>{_LOREM} {_LOREM}</p>',
    f'<div data-main=0><a>Home</a> <a>News</a></div><p data-main=1>{_LOREM}</p><p data-main=1>{_LOREM}</p>',
    f'<article data-main=1><h1>A list of links</h1><p>Of.</p><ul><li><a>First source of this</a></li><li><a>Second source</a></li></ul><p>It was.</p></article>'
    f'<div class="newsletter" data-main=0><p>{_LOREM}</p></div><footer data-main=0><p>{_LOREM}</p></footer>',
)


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    found = [blocks(p) for p in _LABELLED]
    return np.concatenate([features(f) for f in found]), np.array([label for f in found for _, _, label in f])


def grow_tree(x: np.ndarray, y: np.ndarray, least: int = 1, depth: int = 8) -> tuple:
    """A CART tree by Gini impurity: ``(feature, cut, low, high)`` or the share of main blocks."""
    p = float(y.mean())
    if depth == 0 or p in (0.0, 1.0):
        return (p,)
    best = (2 * p * (1 - p) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            n, m = low.sum(), (~low).sum()
            if min(n, m) < least:
                continue
            a, b = y[low].mean(), y[~low].mean()
            loss = 2 * a * (1 - a) * n + 2 * b * (1 - b) * m
            if loss < best[0]:
                best = (loss, f, cut)
    if best[1] is None:
        return (p,)
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow_tree(x[low], y[low], least, depth - 1), grow_tree(x[~low], y[~low], least, depth - 1)


def is_main(tree: tuple, row) -> bool:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def main_text(page: str, tree: tuple) -> str:
    """Main blocks of a page in order, joined by one space."""
    found = blocks(page)
    return " ".join(b[0] for b, row in zip(found, features(found).tolist()) if is_main(tree, row))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every row of ``pages``.

    Null and empty pages, and pages without main text, have the empty text.
    Repeated rows and null ids or addresses stay; other columns are not read;
    an empty table gives an empty result.
    """
    import pyarrow as pa

    bounded_batches(pages.sparkSession)
    tree = grow_tree(*labelled_table())

    def kernel(batches):
        for b in batches:
            texts = [main_text(p, tree) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), text_of(html_col).alias("html"))
    return src.mapInArrow(kernel, "page_id long, url string, text string, n_chars long")
