"""Main text of web pages: flat text blocks, classified by a decision tree over their neighbourhood."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetlens.llm.arrays import chunks
from streetlens.llm.columns import as_row, row_type

FEATURES = (
    "aside", "article", "elsewhere", "heading", "chrome", "words", "links", "words_before", "links_before", "words_after", "links_after")

#: Elements that hold no running text; their content is skipped.
_SKIPPED = "script|style|noscript|template|title|svg|math|iframe|object|canvas|audio|video|textarea"
_ATTRIBUTES = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
#: Elements that end an unclosed button or select.
_ENDS = (
    "address|article|aside|blockquote|body|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|"
    "html|legend|li|main|menu|nav|ol|p|pre|search|section|summary|table|tbody|td|tfoot|th|thead|tr|ul")
#: A skipped element of another language may be empty ("/>"). A button or select without an end before the next of
#: its name ends with the block it stands in.
_PARTS = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:svg|math|iframe)(?=[\s/>]){_ATTRIBUTES}/>"
    rf"|<(?P<skip>{_SKIPPED})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</(?P=skip)\s*>|\Z)"
    rf"|<(?P<control>button|select)(?=[\s/>]){_ATTRIBUTES}>"
    rf"(?:(?:(?!<(?P=control)[\s/>]).)*?</(?P=control)\s*>|.*?(?=</?(?:{_ENDS}|(?P=control))[\s/>]|\Z))"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>?"
    r"|(?P<text>[^<]+|<)", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NOT_SHOWN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)

#: Elements that end a block of text; all others are part of the line they stand in.
_BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead tr ul").split())
_CONTAINER = frozenset((
    "article aside details dialog div dl fieldset figure footer form header main menu nav ol section table ul search").split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ASIDE_TAGS = frozenset(("nav", "footer", "aside", "form", "menu", "fieldset", "dialog", "search"))
#: Words of class, id or role that mark what is not part of the article.
_ASIDE_WORDS = frozenset((
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar rail footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert newsletter "
    "subscribe subscription signup login signin paywall popup modal overlay dialog search searchbox share sharing social related "
    "recommended recommendations comment comments commentlist disqus reply replies respond widget pagination pager copyright legal "
    "complementary contentinfo skip hidden").split())
_READERS = frozenset(("comment", "comments", "commentlist", "disqus", "replies", "respond", "related", "recommended"))
#: Words behind a mark that only name its form: ``ad-slot`` is an ad, ``header-image`` is no header.
_FORMS = frozenset((
    "area bar block box btn button buttons card cards container content form group holder icon icons inner item items label link links "
    "list module outer overlay panel post posts region row section slot stories story unit widget wrap wrapper").split())
#: Words before a mark that speak of the page around it: ``has-sidebar`` is no sidebar.
_STATES = frozenset(("has", "is", "no", "non", "not", "with", "without"))
#: Marks of elements inside a line; other words of the list may well name a part of a sentence.
_INLINE_WORDS = frozenset("ad ads advert advertisement hidden promo share sharing social sponsor sponsored".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Phrases by which a page speaks to its reader.
_CHROME = re.compile(
    r"\b(?:log ?in|sign (?:in|up)|subscribe|cookies?|share (?:this|on|via)|follow us|read more|all rights reserved|terms of (?:use|service)"
    r"|privacy policy|advertisement|sponsored|newsletter|leave a (?:comment|reply)|back to top|skip to)\b|©", re.I)


def mark(name: str) -> str:
    """What one name of a class, id or role says an element is: its last word, without words for its form."""
    words = [w.lower().rstrip("0123456789") for w in re.split(r"[_-]+|(?<=[a-z0-9])(?=[A-Z])", name)]
    words = [w for w in words if w]
    if not words or words[0] in _STATES:
        return ""
    while len(words) > 1 and words[-1] in _FORMS:
        words.pop()
    return words[-1]


def hints(attributes: str) -> set[str]:
    """The marks of class, id, role and label, and ``hidden`` for what is not shown."""
    words: set[str] = set()
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "aria-label"):
            words.update(mark(part) for part in value.split())
        elif name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and _NOT_SHOWN.search(value):
            words.add("hidden")
    return words


class Block:
    __slots__ = ("article", "aside", "heading", "linked", "text", "words")

    def __init__(self, text: str, linked: int, aside: bool, article: bool, heading: bool):
        self.text, self.linked, self.aside, self.article, self.heading = text, linked, aside, article, heading
        self.words = text.count(" ") + 1


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order: decoded, white space as one space, trimmed, none empty.

    Each knows how many of its words are in links, and whether it stands in an article and aside of it. Hints of
    class, id, role and style are looked at on every element but ``main``; a marked element inside a line is left out.
    """
    found: list[Block] = []
    parts: list[str] = []
    linked = 0
    in_link = heading = own_mark = False
    # element inside a line that is left out: its name, its open namesakes and the blocks opened in it
    muted, namesakes, inner = "", 0, 0
    # open containers: name, aside by element, aside by hint, reader comments or the like, article
    stack: list[tuple[str, bool, bool, bool, bool]] = [("", False, False, False, False)]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                _, by_tag, by_hint, readers, article = stack[-1]
                found.append(Block(text, linked, by_tag or by_hint or readers or own_mark, article, heading))
        linked = 0

    for part in _PARTS.finditer(page):
        text = part["text"]
        if text is not None:
            if muted:
                continue
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text.split())
            continue
        tag = part["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        closes, attributes = part["close"], part["attributes"]
        if muted:
            if tag == muted:
                namesakes += -1 if closes else 1
            elif tag in _BLOCK and tag != "hr":
                inner += -1 if closes else 1
            if namesakes and inner >= 0:
                continue
            # ended, or the block that it stands in has
            ended, muted = tag == muted, ""
            if ended:
                continue
        if tag == "a":
            in_link = not closes
        if tag == "br":
            parts.append(" ")
        elif tag not in _BLOCK:
            if not closes and attributes and tag not in _VOID and not attributes.endswith("/") and hints(attributes) & _INLINE_WORDS:
                muted, namesakes, inner = tag, 1, 0
                in_link = False
        else:
            flush()
            own_mark = False
            if tag in _HEADINGS:
                heading = not closes
            if tag in _CONTAINER:
                if closes:
                    if any(entry[0] == tag for entry in stack):
                        while stack[-1][0] != tag:
                            stack.pop()
                        stack.pop()
                elif not attributes.endswith("/"):
                    words = hints(attributes) if tag != "main" else set()
                    _, by_tag, by_hint, readers, article = stack[-1]
                    own = bool(words & _ASIDE_WORDS)
                    readers = readers or bool(words & _READERS)
                    if tag in ("article", "main"):
                        # the article of a page may stand in a wrapper that only names what is beside it
                        article, by_hint = True, own
                    by_tag = by_tag or tag in _ASIDE_TAGS or tag == "header" and not article
                    own_header = tag == "header" and article and not words & (_ASIDE_WORDS - {"header"})
                    by_hint = by_hint or own and not own_header
                    stack.append((tag, by_tag, by_hint, readers, article))
            elif not closes and attributes and tag not in ("body", "html"):
                own_mark = bool(hints(attributes) & _ASIDE_WORDS)
    flush()
    return found


def features(page: list[Block]) -> np.ndarray:
    """One row per block: where it stands, its words and share of words in links, and those of its neighbours."""
    n = len(page)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    words = np.array([b.words for b in page], float)
    links = np.array([min(b.linked, b.words) for b in page]) / words
    article = np.array([b.article for b in page])
    aside = np.array([b.aside for b in page])
    out[:, 0], out[:, 1] = aside, article
    out[:, 2] = ~article & bool((article & ~aside).any())
    out[:, 3] = [b.heading for b in page]
    out[:, 4] = [bool(_CHROME.search(b.text)) for b in page]
    out[:, 5], out[:, 6] = words, links
    out[1:, 7], out[1:, 8] = words[:-1], links[:-1]
    out[:-1, 9], out[:-1, 10] = words[1:], links[1:]
    return out


def labelled_pages() -> list[str]:
    """The small labelled table: pages made by rule, whose blocks are of the word ``main`` or ``other``."""
    def other(n: int) -> str:
        return " ".join(["other"] * n)

    def main(n: int) -> str:
        return " ".join(["main"] * n)

    def menu(n: int) -> str:
        return "".join(f'<li><a href="/{i}">{other(1 + i % 3)}</a></li>' for i in range(n))

    pages = []
    for size in (1, 3, 8, 20, 60, 200):
        for beside in (1, 3, 9, 30, 120, 300):
            body = f"<h1>{main(4)}</h1>" + "".join(f"<p>{main(size + i)}</p>" for i in (0, 7, 2, 31, 1))
            top = f'<nav><ul>{menu(beside)}</ul></nav><header>{other(beside)}</header><div class="ad">{other(beside)}</div><nav><p>{other(size)}</p></nav>'
            end = (
                f'<aside>{other(beside)}</aside><form>{other(beside)}</form><div class="comments"><p>{other(size)}</p></div>'
                f'<div class="cookie">{other(beside)}</div><footer>{other(beside)}</footer><footer><p>{other(size)}</p></footer>')
            inner = f'<div class="share">{other(beside)}</div>'
            pages.append(f"{top}<article>{body}{inner}</article><p>{other(beside)}</p>{end}")
            pages.append(f"{top}<main><div>{body}</div>{inner}<p>{main(3)} <a>{main(2)}</a></p></main>{end}")
            pages.append(f"{top}<article><p><a>{main(2)}</a></p><p>{main(size)}</p>{body}<p><a>{main(3)}</a></p><p>{main(3)}</p><ul><li><a>{main(size)}</a></li></ul></article>")
            pages.append(f"<article><p>{main(size)}</p><p><a>{main(3)}</a></p><p>{main(2)}</p></article>")
            pages += [f"<article><p>{main(size)}</p></article>", f"<main>{main(size)} <a>{main(1)}</a></main>"] * 2
            # an article may speak of what pages say
            speech = "".join(f"<p>{main(n)} cookies</p>" for n in (size, 2, beside, 1, size + 3))
            pages += [f"{top}<article>{speech}{body}{speech}</article>{end}", f"<main><h1>{main(2)} cookies</h1>{speech}</main>"] * 2
            if size >= 20:
                # pages that mark nothing: only the flow of long blocks tells
                plain = "".join(f"<p>{main(size + i)}</p>" for i in (0, 20, 9, 33))
                between = "".join(f"<p>{main(n)}</p><p>{main(size + n)}</p>" for n in (2, 4, 6, 9, 12))
                flow = f"<h1>{main(5)}</h1>{plain}{between}"
                links = f"<ul>{menu(1 + beside % 20)}</ul>"
                pages.append(f"{links}<div>{flow}</div>{links}<p>{other(3)}</p>")
                pages.append(f"{top}{links}<div>{flow}</div>{end}")
                pages.append(f"<div>{flow}</div><footer>{other(beside)}</footer>")
                pages.append(f"{links}<div>{flow}</div>")
                # short lines before and behind the flow, side by side or with a phrase of the page's own
                lines = "".join(f"<p>{other(1 + (beside + 5 * i) % 12)}</p>" for i in range(4))
                pages += [f"{lines}<div>{flow}</div>{lines}", f"{lines}<div>{plain}{between}</div>{lines}"]
                spoken = f"<p>{other(1 + beside % 4)} cookies</p>"
                pages.append(f"{spoken}<div>{flow}{spoken}{plain}<p>{main(size)} cookies {main(size)}</p></div>{spoken}")
                said = f"<p>{main(size)} cookies {main(size)}</p>"
                pages.append(f"<div>{said}{plain}{said}{said}<p>{main(3)}</p>{said}</div>")
    return pages


def grow(x: np.ndarray, y: np.ndarray, depth: int, least: int = 2) -> list:
    """Decision tree by Gini impurity, as nested lists: [feature, limit, at most, above] or a share of ones."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return [share]
    best = None
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        values, ones = x[order, feature], np.cumsum(y[order])
        cut = np.flatnonzero(values[1:] > values[:-1]) + 1
        cut = cut[(cut >= least) & (cut <= len(y) - least)]
        if not len(cut):
            continue
        left, right = ones[cut - 1], ones[-1] - ones[cut - 1]
        impurity = left * (cut - left) / cut + right * (len(y) - cut - right) / (len(y) - cut)
        i = int(np.argmin(impurity))
        if best is None or impurity[i] < best[0] - 1e-9:
            best = impurity[i], feature, float(values[cut[i] - 1] + values[cut[i]]) / 2
    if best is None:
        return [share]
    _, feature, limit = best
    low = x[:, feature] <= limit
    return [feature, limit, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)]


def apply(tree: list, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    out = np.empty(len(x))
    low = x[:, tree[0]] <= tree[1]
    out[low], out[~low] = apply(tree[2], x[low]), apply(tree[3], x[~low])
    return out


def trained_tree(depth: int = 10) -> list:
    pages = [blocks(page) for page in labelled_pages()]
    x = np.concatenate([features(page) for page in pages])
    y = np.array([b.text.startswith("main") for page in pages for b in page], float)
    return grow(x, y, depth)


def extractor(tree: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            pages = [blocks(page or "") for page in batch.column("html").to_pylist()]
            sizes = np.array([len(page) for page in pages])
            kept = apply(tree, np.concatenate([features(page) for page in pages])) >= 0.5
            ends = np.cumsum(sizes)
            texts = [
                "\n".join(b.text for b, main in zip(page, kept[end - size:end], strict=True) if main)
                for page, size, end in zip(pages, sizes, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["row", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, keep: list[str] | None = None, tree: list | None = None) -> DataFrame:
    """Main text of every whole page: the struct ``row`` with the columns ``keep`` beside ``text`` and ``n_chars``.

    ``keep`` defaults to ``page_id`` and ``url``. A page is cut into flat blocks; each is kept or left out by a
    decision tree over its place, word count and link density and those of the blocks before and after it.
    Kept blocks are joined by a newline; nothing is shortened. A null or empty page and one without main text
    give an empty text. Unclosed elements, comments and scripts end with the page. Repeated rows are
    extracted each. ``tree`` takes a tree grown from other labelled blocks. No shuffle.
    """
    rows = pages.select(as_row(keep or ["page_id", "url"]), "html")
    kind = row_type(rows)
    return rows.mapInArrow(extractor(tree or trained_tree()), f"row {kind}, text string, n_chars bigint")
