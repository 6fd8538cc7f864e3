"""Leaf blocks of a web page: runs of text between block-level tags, with what stands above them.

One pass over the page, in time and memory linear in its length: what stands above a block is a set
that it shares with its neighbours, and a tag that is never closed ends where the next begins."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container
from html import unescape
from typing import NamedTuple

_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)(>|(?=<)|\Z)?|<[!?][^>]*+(?:>|\Z)""", re.S)
_TAG_END = re.compile("[<>]")
_NAMES = re.compile(r"""(?:^|(?<=\s))(class|id|role|hidden|aria-hidden|style)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""", re.I)
_PART = re.compile(r"[a-z]+")

# fixed values: elements of HTML by how they take part in a page's text
BLOCK_TAGS = frozenset("""address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table
tbody td tfoot th thead tr ul""".split())
#: Their content is no text of the page, and no markup is read inside.
RAW_TAGS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in ("script", "style", "iframe", "textarea", "title")}
VOID_TAGS = frozenset("hr br img input meta link area base col embed source track wbr".split())
SIDE_TAGS = frozenset("nav header footer aside form menu dialog button select fieldset".split())
_CLOSES_P = BLOCK_TAGS - {"button", "label", "body", "html", "head"}
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HIDDEN = "~hidden"


class Place(NamedTuple):
    """An open element, with the sets of all that stands above its text."""

    tag: str
    above: frozenset[str]  # tags
    names: frozenset[str]  # words of classes, ids and roles
    article: bool  # inside an article
    side: bool  # inside a side element of that article


_TOP = Place("", frozenset(), frozenset(), False, False)


class Block(NamedTuple):
    text: str
    place: Place
    linked: int  # characters inside links


def leaf_blocks(html: str | None, names: Container[str] | None = None) -> list[Block]:
    """Blocks in page order; character references are decoded, white space is one space. Unclosed and misnested
    tags are taken as browsers take the usual cases; a null page has none. With ``names`` given, only those are
    noted, so that a page cannot make the sets grow."""
    if not html:
        return []
    blocks, stack, parts, linked = [], [_TOP], [], 0
    open_: Counter = Counter()
    inside_link, at, size = False, 0, len(html)

    def end_block():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                blocks.append(Block(text, stack[-1], min(linked, len(text))))
            parts.clear()
        linked = 0

    def pop_one():
        open_[stack.pop().tag] -= 1

    while at < size:
        m = _MARKUP.search(html, at)
        if m is None:
            parts.append(html[at:])
            linked += inside_link * (size - at)
            break
        if m.start() > at:
            parts.append(html[at:m.start()])
            linked += inside_link * (m.start() - at)
        at = m.end()
        if not m[2]:
            continue
        if m[4] is None:  # a quote that is never closed: the tag ends at the next sign of one
            end = _TAG_END.search(html, at)
            at = size if end is None else end.start() + (end[0] == ">")
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK_TAGS:
                end_block()
                if open_[tag]:
                    while stack[-1].tag != tag:
                        pop_one()
                    pop_one()
            elif tag == "a":
                inside_link = False
        elif tag in RAW_TAGS:
            if not m[3].rstrip().endswith("/"):
                end = RAW_TAGS[tag].search(html, at)
                at = end.end() if end else size
        elif tag == "br":
            parts.append(" ")
        elif tag == "a":
            inside_link = True
        elif tag in BLOCK_TAGS:
            end_block()
            inside_link = False
            if tag in _CLOSES_P and stack[-1].tag == "p":
                pop_one()
            for sibling in _SIBLINGS.get(tag, ()):
                if stack[-1].tag == sibling:
                    pop_one()
            if tag not in VOID_TAGS:
                stack.append(_below(stack[-1], tag, [n for n in _names(m[3]) if names is None or n in names] if m[3] else []))
                open_[tag] += 1
    end_block()
    return blocks


def _below(top: Place, tag: str, names: list[str]) -> Place:
    article = top.article or tag == "article"
    return Place(tag, top.above if tag in top.above else top.above | {tag}, top.names if top.names.issuperset(names) else top.names.union(names),
                 article, article and (top.side or tag in SIDE_TAGS))


def page_names(html: str | None) -> set[str]:
    """All words of classes, ids and roles of a page's block elements."""
    return {n for m in _MARKUP.finditer(html or "") if m[2] and not m[1] and m[2].lower() in BLOCK_TAGS for n in _names(m[3])}


def _names(attributes: str) -> list[str]:
    found = []
    for name, value in _NAMES.findall(attributes):
        name = name.lower()
        if name in ("hidden", "aria-hidden", "style"):
            if name == "hidden" or "true" in value.lower() or re.search(r"display\s*:\s*none", value, re.I):
                found.append(HIDDEN)
        else:
            found += _PART.findall(value.lower())
    return found
