"""Main text of web pages: flat text blocks, classified by a decision tree on shallow features of block and neighbours.

A page is cut at block-level tags into blocks of text.  A block's features are its word count and link density, those
of the blocks before and after it, the share of its words that notices and adverts are made of, whether it or the block
before it is a heading, and what its open elements say: a container for something else (navigation, footer, advert,
comments), perhaps one (a name with other words in it, as ``side-effects``, or what follows a heading like "Responses"), the
article, or neither, which on a page with an article is outside it.  Words of names and notices so decide together with
length, links and neighbours.  The tree is grown from the small labelled table below whenever it is needed.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import cache, lru_cache
from itertools import pairwise

import numpy as np
from pyspark.sql import DataFrame

#: Elements whose content is never text of the page.
_SILENT = frozenset("script style noscript template svg math iframe object embed canvas audio video select textarea button datalist head title map".split())
#: Of these, the ones whose content has no tags.
_RAW = frozenset("script style textarea title iframe noscript".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
_ASIDE = frozenset("nav footer aside form menu dialog header".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end an open one of the same name.
_ROWS = frozenset("li h1 h2 h3 h4 h5 h6 td th dt dd tr option".split())
#: Words in class names and ids, which are read as runs of words: what says that a container holds something else,
#: what does so outside articles only, what reverses it, what says that it holds the text, and what goes with that.
_BESIDE_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert comment comments commentlist respond disqus replies reply
    sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer related recommended recommendations share sharing social newsletter subscribe subscription signup login popup modal overlay
    widget toolbar pagination pager""".split()
)
_HEADER_WORDS = frozenset("header masthead".split())
#: Of the first, those that other words may turn into something else, and words that leave them what they are.
_EITHER_WORDS = frozenset("banner promo promotion cookie cookies notice alert side menu related recommended recommendations share sharing social modal overlay widget".split())
_PLAIN_WORDS = frozenset(
    """box wrap wrapper container inner outer list item items bar top bottom left right main section block area content text panel header col column row primary secondary site page global
    link links button buttons icon icons media post posts article articles story stories news group grid card cards title heading body info warning success danger error dismissible toggle mobile
    desktop sticky fixed small large image images unit slot zone tools policy settings accept dialog""".split()
)
_NOT_WORDS = frozenset("no non not has with without hide".split())
_CONTENT_WORDS = frozenset("article entry post story".split())
_TEXT_WORDS = frozenset("body content text main inner wrapper container full single copy page section area header title box".split())
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Whole blocks after which the rest of their container is comments or links to other pages.
_ENDING = re.compile(
    r"\W*\d*\W*(?:(?:reader |user )?comments?|responses?|replies|(?:leave|post|add|write) (?:a |your )?(?:comment|reply)|commentaires?|kommentare?|comentarios?"
    r"|(?:related|similar|recommended|more) (?:articles?|posts?|stories|news|reading)|you (?:may|might) also like)\W*\d*\W*",
    re.I,
)
#: Of these, the ones that may as well head a part of the text.
_PERHAPS_ENDING = re.compile(r"\W*(?:responses?|replies)\W*", re.I)
#: What notices, imprints, adverts and links to share a page say.
_NOTICE = re.compile(
    r"©|\(c\) ?\d{4}|\bcopyright\b|\ball rights reserved\b|\b(?:uses?|accept(?: all)?|of|our) cookies\b|\bprivacy policy\b|\bterms of (?:use|service)\b|\bnewsletter\b|\bsign (?:in|up)\b|\blog ?in\b"
    r"|\badvertisements?\b|\bsponsored\b|\bsubscribe\b|\bshare (?:this|on|via|with)\b|\b(?:share|tweet|print|e?mail)\Z|\bfollow us\b|\b(?:buy|shop|order) now\b|\bwerbung\b|\banzeige\b|\bpublicité\b|\bpublicidad\b",
    re.I,
)
#: A text that has none of these, in lower case, has none of the above.
_NOTICE_SIGNS = ("©", "(c)", "copyright", "all rights", " cookies", "privacy policy", "terms of", "newsletter", "sign in", "sign up", "log in", "login", "advertisement", "sponsored", "subscribe", "share", "tweet", "print", "mail", "follow us", "buy now", "shop now", "order now", "werbung", "anzeige", "publici")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: A tag with a quote that is never closed.
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words that an article must have for the rest of the page to be outside it.
ARTICLE_WORDS = 8

#: Features of a block; among equally good splits the tree takes the first of ``PREFERENCE``.
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "article", "outside", "notice", "heading", "perhaps", "titled")
PREFERENCE = (6, 7, 8, 9, 11, 1, 0, 10, 12, 3, 5, 2, 4)
#: The labelled table: pages as runs of blocks of (place, words, link density, heading, 1 for main text or 0) and, where it
#: is not 0, the share of notices' words.  Places: a - in a container for something else, t - in the article's text, o -
#: outside the page's article, n - a notice in none of them, with three such words, w - perhaps in something else, v - the same
#: in the article's text, and "-" none of these.  A block's neighbours on its page give the other features.
LABELLED_PAGES = [
    # an article with short and linked paragraphs, link lists, quotes; menus, related stories, comments, imprint around it
    [("a", 2, 1.0, 0, 0), ("a", 1, 1.0, 0, 0), ("a", 3, 1.0, 0, 0), ("t", 8, 0.0, 1, 1), ("t", 35, 0.0, 0, 1), ("t", 120, 0.02, 0, 1), ("t", 3, 1.0, 0, 1), ("t", 4, 1.0, 0, 1), ("t", 60, 0.4, 0, 1), ("t", 1, 0.0, 0, 1), ("a", 8, 0.0, 0, 0), ("a", 40, 0.0, 0, 0)],
    [("a", 12, 0.1, 0, 0), ("o", 5, 1.0, 0, 0), ("o", 3, 1.0, 0, 0), ("t", 6, 0.0, 1, 1), ("t", 15, 0.3, 0, 1), ("t", 2, 0.0, 1, 1), ("t", 200, 0.1, 0, 1), ("t", 6, 1.0, 0, 1), ("o", 45, 0.0, 0, 0), ("o", 30, 0.0, 0, 0), ("o", 2, 0.0, 1, 0), ("o", 9, 0.0, 0, 0), ("n", 7, 0.0, 0, 0)],
    [("o", 4, 0.0, 0, 0), ("t", 10, 0.2, 0, 1), ("a", 25, 0.0, 0, 0), ("t", 50, 0.0, 0, 1), ("a", 60, 0.1, 0, 0), ("t", 9, 0.0, 0, 1), ("o", 120, 0.0, 0, 0), ("o", 70, 0.1, 0, 0)],
    [("n", 20, 0.1, 0, 0), ("t", 12, 0.0, 0, 1), ("t", 5, 0.4, 0, 1), ("a", 4, 0.0, 1, 0), ("a", 90, 0.0, 0, 0), ("a", 5, 0.0, 1, 0)],
    # the title stands before the article
    [("a", 1, 1.0, 0, 0), ("t", 7, 0.0, 1, 1), ("t", 4, 0.0, 0, 1), ("t", 80, 0.0, 0, 1), ("o", 1, 0.0, 0, 0)],
    # no containers at all: long blocks, short ones between them, menus and link lists, an imprint
    [("-", 2, 1.0, 0, 0), ("-", 3, 1.0, 0, 0), ("-", 8, 0.0, 1, 1), ("-", 70, 0.05, 0, 1), ("-", 45, 0.0, 0, 1), ("-", 5, 0.0, 0, 1), ("-", 40, 0.0, 0, 1), ("-", 4, 0.8, 0, 0), ("-", 5, 1.0, 0, 0), ("n", 12, 0.0, 0, 0)],
    [("-", 6, 0.6, 0, 0), ("-", 4, 1.0, 0, 0), ("-", 6, 0.0, 1, 1), ("-", 12, 0.0, 0, 1), ("-", 60, 0.0, 0, 1), ("-", 22, 0.0, 0, 1), ("-", 25, 0.2, 0, 1), ("-", 30, 0.1, 0, 1), ("-", 15, 0.9, 0, 0), ("-", 12, 1.0, 0, 0)],
    [("-", 1, 1.0, 0, 0), ("-", 2, 1.0, 0, 0), ("-", 4, 0.0, 0, 0), ("-", 3, 1.0, 0, 0), ("-", 2, 0.0, 1, 1), ("-", 40, 0.0, 0, 1), ("-", 30, 0.7, 0, 0), ("-", 25, 0.6, 0, 0), ("n", 45, 0.2, 0, 0)],
    [("-", 2, 1.0, 0, 0), ("-", 18, 0.0, 0, 1), ("-", 2, 1.0, 0, 0), ("-", 4, 0.0, 0, 0), ("-", 2, 1.0, 0, 0)],
    # short pages
    [("-", 2, 0.0, 0, 1)], [("-", 4, 0.0, 1, 1), ("-", 5, 0.0, 0, 1)], [("-", 12, 0.0, 0, 1), ("n", 5, 0.0, 0, 0)], [("t", 2, 0.0, 0, 1)], [("t", 2, 1.0, 0, 1)], [("-", 2, 1.0, 0, 0)], [("n", 4, 0.0, 0, 0)],
    [("a", 3, 1.0, 0, 0), ("-", 6, 0.0, 0, 1), ("a", 5, 0.0, 0, 0)],
    # notices, adverts and links to share inside an article, and paragraphs about such things
    [("t", 7, 0.0, 1, 1), ("t", 90, 0.0, 0, 1), ("t", 1, 0.0, 0, 0, 1.0), ("t", 60, 0.02, 0, 1, 0.03), ("t", 5, 1.0, 0, 0, 0.4), ("t", 6, 0.0, 0, 0, 0.33), ("t", 70, 0.0, 0, 1), ("t", 4, 1.0, 0, 0, 0.5), ("t", 9, 0.2, 0, 0, 0.25), ("t", 2, 0.0, 1, 1, 0.5), ("t", 80, 0.0, 0, 1, 0.02), ("t", 7, 0.0, 0, 0, 0.3)],
    [("t", 5, 0.0, 1, 1, 0.2), ("t", 110, 0.0, 0, 1, 0.01), ("t", 12, 0.0, 0, 1, 0.083), ("t", 3, 0.0, 0, 0, 0.67), ("t", 40, 0.1, 0, 1), ("t", 14, 0.1, 0, 0, 0.2), ("t", 200, 0.0, 0, 1, 0.02), ("t", 2, 1.0, 0, 0, 0.5), ("t", 8, 0.0, 0, 1), ("t", 6, 1.0, 0, 1)],
    [("t", 6, 0.0, 1, 1), ("t", 30, 0.0, 0, 1), ("t", 2, 1.0, 0, 0, 1.0), ("t", 4, 1.0, 0, 0, 0.25), ("t", 50, 0.3, 0, 1), ("t", 25, 0.04, 0, 1, 0.04), ("t", 8, 0.0, 0, 0, 0.25), ("o", 12, 0.2, 0, 0, 0.25)],
    [("t", 9, 0.0, 1, 1), ("t", 120, 0.0, 0, 1), ("t", 1, 0.0, 0, 0, 1.0), ("t", 130, 0.0, 0, 1), ("t", 12, 0.0, 0, 1, 0.083), ("t", 6, 0.0, 0, 0, 0.33), ("t", 150, 0.02, 0, 1), ("t", 15, 0.0, 0, 1, 0.067), ("t", 7, 0.0, 0, 0, 0.43), ("t", 11, 0.0, 0, 1, 0.09), ("t", 20, 0.0, 0, 0, 0.15)],
    [("t", 6, 0.0, 1, 1), ("t", 2, 0.0, 1, 1), ("t", 6, 1.0, 0, 1), ("t", 4, 0.0, 0, 1), ("t", 5, 0.8, 0, 1), ("t", 140, 0.0, 0, 1), ("t", 3, 0.0, 0, 0, 0.33)],
    # the same without an article
    [("-", 6, 0.0, 1, 1), ("-", 200, 0.0, 0, 1, 0.005), ("-", 2, 0.0, 1, 1, 0.5), ("-", 120, 0.0, 0, 1, 0.02), ("-", 60, 0.1, 0, 1, 0.017), ("-", 30, 0.1, 0, 0, 0.1), ("n", 6, 0.0, 0, 0)],
    [("-", 2, 1.0, 0, 0, 0.5), ("-", 8, 0.0, 1, 1), ("-", 50, 0.0, 0, 1, 0.02), ("-", 45, 0.0, 0, 1, 0.022), ("-", 3, 0.0, 1, 0, 0.33), ("-", 12, 0.0, 0, 0, 0.17), ("n", 45, 0.1, 0, 0)],
    [("-", 4, 0.0, 1, 1, 0.25), ("-", 70, 0.0, 0, 1, 0.03), ("-", 90, 0.02, 0, 1, 0.01), ("-", 1, 0.0, 0, 0, 1.0), ("-", 40, 0.0, 0, 1), ("-", 2, 0.0, 1, 0, 0.5), ("-", 8, 0.1, 0, 0, 0.25)],
    # containers with doubtful names: parts of the text, and boxes of links and teasers
    [("-", 5, 0.0, 1, 1), ("-", 60, 0.0, 0, 1), ("w", 2, 0.0, 1, 1), ("w", 90, 0.0, 0, 1), ("w", 80, 0.05, 0, 1), ("w", 30, 0.0, 0, 1), ("-", 70, 0.0, 0, 1)],
    [("-", 6, 0.0, 1, 1), ("-", 80, 0.0, 0, 1), ("w", 3, 1.0, 0, 0), ("w", 5, 0.8, 0, 0), ("w", 2, 0.0, 1, 0), ("w", 10, 0.0, 0, 0), ("w", 4, 1.0, 0, 0)],
    [("w", 2, 1.0, 0, 0), ("w", 3, 1.0, 0, 0), ("-", 7, 0.0, 1, 1), ("-", 40, 0.0, 0, 1), ("w", 90, 0.0, 0, 1), ("w", 30, 0.7, 0, 0), ("w", 12, 0.5, 0, 0)],
    [("t", 8, 0.0, 1, 1), ("t", 70, 0.0, 0, 1), ("v", 2, 0.0, 1, 1), ("v", 90, 0.0, 0, 1), ("v", 4, 1.0, 0, 0), ("v", 5, 0.9, 0, 0), ("t", 30, 0.0, 0, 1)],
    # under a heading like "Responses": readers' comments behind their names, and a part of the text
    [("-", 7, 0.0, 1, 1), ("-", 100, 0.0, 0, 1), ("w", 1, 0.0, 1, 0), ("w", 3, 0.0, 0, 0), ("w", 40, 0.0, 0, 0), ("w", 2, 0.0, 0, 0), ("w", 60, 0.0, 0, 0), ("w", 3, 0.0, 0, 0), ("w", 25, 0.0, 0, 0)],
    [("-", 6, 0.0, 1, 1), ("-", 80, 0.0, 0, 1), ("w", 1, 0.0, 1, 0), ("w", 5, 0.2, 0, 0), ("w", 90, 0.0, 0, 0), ("w", 4, 0.2, 0, 0), ("w", 30, 0.0, 0, 0)],
    [("-", 7, 0.0, 1, 1), ("-", 100, 0.0, 0, 1), ("w", 1, 0.0, 1, 1), ("w", 100, 0.0, 0, 1), ("w", 100, 0.0, 0, 1)],
    [("t", 7, 0.0, 1, 1), ("t", 100, 0.0, 0, 1), ("v", 1, 0.0, 1, 1), ("v", 60, 0.0, 0, 1), ("v", 45, 0.1, 0, 1), ("o", 4, 0.0, 0, 0)],
]


def _rows(blocks: list[tuple]) -> list[tuple]:
    """Features of a page's blocks of (words, link density, aside, article, outside, notice, heading, perhaps)."""
    sizes = [(0, 0.0), *[b[:2] for b in blocks], (0, 0.0)]
    return [(*b[:2], *sizes[i], *sizes[i + 2], *b[2:], i > 0 and blocks[i - 1][6]) for i, b in enumerate(blocks)]


def labelled(pages=None) -> np.ndarray:
    """Features and label of each block of ``pages`` (the labelled table)."""
    rows = []
    for page in LABELLED_PAGES if pages is None else pages:
        shares = [b[5] if len(b) > 5 else min(1.0, 3 / b[1]) if b[0] == "n" else 0.0 for b in page]
        found = _rows([(b[1], b[2], b[0] == "a", b[0] in "tv", b[0] == "o", share, b[3], b[0] in "wv") for b, share in zip(page, shares, strict=True)])
        rows += [(*features, block[4]) for features, block in zip(found, page, strict=True)]
    return np.array(rows, dtype=float)


def grow(rows: np.ndarray, deep: int = 12):
    """A decision tree by Gini impurity: (feature, limit, tree up to it, tree beyond it), or a label."""
    labels = rows[:, -1]
    if deep == 0 or labels.min() == labels.max():
        return int(labels.mean() >= 0.5)
    best = None
    for feature in PREFERENCE:
        values = np.unique(rows[:, feature])
        for limit in (values[1:] + values[:-1]) / 2:
            low = rows[:, feature] <= limit
            impurity = sum(n * p * (1 - p) for n, p in ((low.sum(), labels[low].mean()), ((~low).sum(), labels[~low].mean())))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, limit, low)
    if best is None:
        return int(labels.mean() >= 0.5)
    _, feature, limit, low = best
    return feature, float(limit), grow(rows[low], deep - 1), grow(rows[~low], deep - 1)


@cache
def _tree():
    return grow(labelled())


def is_main(features, tree=None) -> bool:
    node = _tree() if tree is None else tree
    while isinstance(node, tuple):
        feature, limit, low, high = node
        node = low if features[feature] <= limit else high
    return bool(node)


@lru_cache(maxsize=4096)
def _named(value: str) -> tuple[bool, bool, bool, bool]:
    """What a class list or id says: something else, something else but an article's own header, the article's text, perhaps
    something else."""
    beside = header = content = perhaps = False
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        plain = [w for before, w in pairwise(["", *words]) if before not in _NOT_WORDS]
        hits = _BESIDE_WORDS.intersection(plain)
        sure = not hits <= _EITHER_WORDS or _BESIDE_WORDS | _PLAIN_WORDS >= set(words)
        beside |= bool(hits) and sure
        perhaps |= bool(hits) and not sure
        header |= not _HEADER_WORDS.isdisjoint(plain)
        own = set(words)
        content |= bool(own & _CONTENT_WORDS) and own <= _CONTENT_WORDS | _TEXT_WORDS
    return beside or header, beside, content, perhaps


def _signs(name: str, attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether an element holds something beside the text, whether it holds an article, and whether perhaps the former;
    ``inside``: it is in an article."""
    perhaps = False
    beside, content = name in _ASIDE and not (name == "header" and inside), name == "article"
    for attribute, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        value, attribute = "".join(values), attribute.lower()
        if attribute == "hidden" or attribute == "aria-hidden" and value == "true" or attribute == "role" and value.lower() in _ROLES:
            beside = True
        elif attribute in ("class", "id"):
            anywhere, own, text, doubtful = _named(value)
            if name not in ("html", "body", "main"):
                beside |= own if inside or name == "article" else anywhere
                perhaps |= doubtful
            content |= text and name not in ("html", "body", *_HEADINGS, "p", "li")
    # An article in an article is a comment on it.
    return beside or name == "article" and inside, content, perhaps


def blocks(page: str) -> list[tuple[str, int, float, bool, bool, bool, bool, bool]]:
    """(text, words, link density, beside the text, in an article, in the main part, heading, perhaps beside) of the page's
    blocks, in order."""
    out, parts, words, linked = [], [], 0, 0
    open_: list[tuple[str, bool, bool, bool]] = []  # block-level and silent elements: name, beside, article, perhaps
    count: Counter[str] = Counter()
    beside = article = silent = heading = perhaps = 0
    link = ending = doubt = -1  # how many elements were open where a link, or what surely or perhaps are comments, began

    def flush():
        nonlocal words, linked, ending, doubt
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            n = len(text.split(" "))
            if ending < 0 and n <= 6 and _ENDING.fullmatch(text):
                # The container is what holds the heading's own element.
                if _PERHAPS_ENDING.fullmatch(text):
                    doubt = max(len(open_) - 1, 0)
                else:
                    ending = max(len(open_) - 1, 0)
            out.append((text, n, min(1.0, linked / max(words, 1)), beside > 0 or ending >= 0, article > 0, count["main"] > 0, heading > 0, perhaps > 0 or doubt >= 0))
        words = linked = 0

    def leave(i: int):
        nonlocal beside, article, silent, heading, perhaps, link, ending, doubt
        for name, b, c, d in open_[i:]:
            count[name] -= 1
            perhaps -= d
            beside, article, silent, heading = beside - b, article - c, silent - (name in _SILENT), heading - (name in _HEADINGS)
        del open_[i:]
        link = link if i >= link else -1
        ending = ending if i >= ending else -1
        doubt = doubt if i >= doubt else -1

    def add(text: str):
        nonlocal words, linked
        if text and not silent:
            parts.append(text)
            n = len(text.split())
            words += n
            linked += n if link >= 0 else 0

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        add(page[at:start])
        m = _TAG.match(page, start) or _LOOSE_TAG.match(page, start)
        if not m:
            add("<")
            at = start + 1
            continue
        at = m.end()
        closing, name, attributes = m[1], (m[2] or "").lower(), m[3]
        if not name:
            continue
        if name == "a":
            link = -1 if closing else len(open_)
        if name == "br":
            add(" ")
        if name in _INLINE and name not in _SILENT:
            continue
        if name not in _SILENT:
            flush()
        if closing:
            if count[name]:
                # All that is looked at goes, so every element is looked at once.
                leave(next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name))
            continue
        if name in _VOID or attributes and attributes.endswith("/") and name in _SILENT:
            continue
        if open_ and (open_[-1][0] == "p" and name not in _SILENT or name in _ROWS and open_[-1][0] == name):
            leave(len(open_) - 1)
        b, c, d = _signs(name, attributes, article > 0)
        open_.append((name, b, c, d))
        count[name] += 1
        perhaps += d
        beside, article, silent, heading = beside + b, article + c, silent + (name in _SILENT), heading + (name in _HEADINGS)
        if name in _RAW:
            close = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
            at = close.end()
            leave(len(open_) - 1)
    flush()
    return out


def _notice_share(text: str, words: int, article: bool) -> float:
    """The notices' phrases a word; outside articles 1 for what has neither a letter nor a digit."""
    if not article and not any(map(str.isalnum, text)):
        return 1.0
    low = text.lower()
    if not any(sign in low for sign in _NOTICE_SIGNS):
        return 0.0
    return min(1.0, sum(1 for _ in _NOTICE.finditer(text)) / words)


def main_text(page: str | None) -> str:
    """The page's main blocks, joined by empty lines.

    Where no article is marked, the main part is taken for one.  A heading right before the article is its title.
    """
    found = blocks(page or "")
    own = [a and not aside for *_, aside, a, _, _, _ in found]
    if sum(n for (_, n, *_), yes in zip(found, own, strict=True) if yes) < ARTICLE_WORDS:
        own = [(a or m) and not aside for *_, aside, a, m, _, _ in found]
    marked = sum(n for (_, n, *_), yes in zip(found, own, strict=True) if yes) >= ARTICLE_WORDS
    if True in own:
        first = own.index(True)
        if first and found[first - 1][6] and not found[first - 1][3] and found[first - 1][2] < 0.5:
            own[first - 1] = True
    rows = _rows(
        [
            (n, links, aside, yes, marked and not (yes or aside), 0.0 if aside else _notice_share(text, n, yes), heading, perhaps and not aside)
            for (text, n, links, aside, _, _, heading, perhaps), yes in zip(found, own, strict=True)
        ]
    )
    kept = [is_main(r) for r in rows]
    if True not in kept:
        # A page of a few short blocks without any link: what stands beside nothing is its text.
        kept = [not r[6] and r[9] < 0.1 and r[1] < 0.5 for r in rows]
    return "\n\n".join(text for (text, *_), yes in zip(found, kept, strict=True) if yes)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` (main text of the whole page, empty if there is none), ``n_chars`` (code points).

    Every page is read by itself: no rows are exchanged, repeated ones come out each.  A null page is an empty one; null
    keys stay.  Broken markup is read as it comes: what is open ends with what holds it, an unended tag with the page.
    Very long or deeply nested pages are read in time proportional to their length.  An empty table gives no rows;
    other columns, whatever their names, are not read.
    """
    rows = pages.selectExpr(f"`{key}` AS page_id", f"`{url}` AS url", f"`{page}` AS html")
    schema = rows.drop("html").schema.add("text", "string").add("n_chars", "long")

    def extract(batches):
        for batch in batches:
            texts = [main_text(p if isinstance(p, str) else None) for p in batch["html"]]
            yield batch.drop(columns="html").assign(text=texts, n_chars=[len(t) for t in texts])

    return rows.mapInPandas(extract, schema)
