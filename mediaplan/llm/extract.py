"""Main text of web pages: a linear-chain CRF labels the leaf blocks of each page.

Labelled pages for training are (a) pages of the table that mark their article, about ``SAMPLE_PAGES`` drawn
by a hash of the id, and (b) pages put together from those pages' own blocks and the layouts below,
which have what the table may lack: sidebars, notices, forms, comments, articles without an
article tag. The model is fitted on the driver from that bounded sample and decodes every page in tasks."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import HIDDEN, Block, leaf_blocks, page_names
from .crf import ChainCRF, fit
from .text import free_name, with_fields

SAMPLE_PAGES = 300
LAYOUT_PAGES = 400
#: A longer page is fitted as chains of this many blocks.
FIT_BLOCKS = 200

# fixed values: names that page builders give to parts of a page
MAIN_NAMES = ["content", "article body", "post", "entry content", "main", "story", "text", "post body"]
SIDE_NAMES = ["ad", "ads banner", "advert", "sidebar", "widget", "menu", "nav", "navbar", "breadcrumb", "footer", "header", "cookie notice", "notice",
              "consent", "popup", "promo", "sponsored", "related", "share", "social", "newsletter", "subscribe", "comments", "comment", "comment list", "reply",
              "discussion", "login form", "search", "toolbar", "copyright", "tags", "pagination", "masthead", "modal"]
_SIDE_WORDS = frozenset(w for name in SIDE_NAMES for w in name.split())


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features of each block of a page."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        size, count = len(b.text), b.text.count(" ") + 1
        ends = b.text[-1]
        own = ["any", f"tag:{b.place.tag}", f"size:{min(8, size.bit_length())}", f"words:{min(7, count.bit_length())}",
               f"links:{4 * b.linked // size}", f"end:{ends if ends in '.!?:;,' else 'w' if ends.isalnum() else 'o'}",
               f"place:{4 * i // n}", f"commas:{min(2, b.text.count(','))}"]
        if b.text[0] in "©" or "©" in b.text or "·" in b.text or "|" in b.text:
            own.append("sign")
        own += [f"above:{t}" for t in b.place.above]
        own += [f"name:{t}" for t in b.place.names]
        out.append(own)
    return out


def _marked(blocks: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article; None if it does not."""
    if not any(b.place.article for b in blocks):
        return None
    return [int(b.place.article and not b.place.side and _SIDE_WORDS.isdisjoint(b.place.names)) for b in blocks]


_MARK = ""


def _layout(pool_main: list[str], pool_side: list[str], draw: random.Random) -> str:
    """A page of one of many layouts; words of the main text carry a mark."""
    def main_text(most=None):
        words = draw.choice(pool_main).split()
        if draw.random() < 0.3:
            words = words[:draw.randint(1, 12)]
        return _MARK + " ".join(words[:most]).replace("<", "&lt;")

    def side_text(long=False):
        words = draw.choice(pool_main if long else pool_side).split()
        return " ".join(words[:draw.randint(1, 60 if long else 14)]).replace("<", "&lt;")

    def links(k):
        return "".join(f'<li><a href="/{i}">{side_text()}</a></li>' for i in range(k))

    def side():
        name = draw.choice(SIDE_NAMES)
        kind = draw.randrange(8)
        attr = f'{draw.choice(["class", "class", "id"])}="{name}"'
        return [lambda: f"<nav><ul>{links(draw.randint(2, 8))}</ul></nav>",
                lambda: f"<aside><h3>{side_text()}</h3><p>{side_text(True)}</p><ul>{links(3)}</ul></aside>",
                lambda: f"<div {attr}>{side_text()}</div>", lambda: f"<div {attr}><p>{side_text(True)}</p></div>",
                lambda: f"<form {attr}><label>{side_text()}</label><button>{side_text()}</button></form>",
                lambda: f'<section class="{draw.choice(["comments", "comment list", "discussion", "responses comments"])}"><h2>{side_text()}</h2>' + "".join(
                    f'<div class="comment"><p>{side_text(True)}</p></div>' for _ in range(draw.randint(1, 4))) + "</section>",
                lambda: f"<section {attr}><h2>{side_text()}</h2><p>{side_text(True)}</p></section>",
                lambda: f"<ul {attr}>{links(draw.randint(2, 6))}</ul>"][kind]()

    body = [f"<h1>{main_text(12)}</h1>"] if draw.random() < 0.8 else []
    for _ in range(draw.randint(1, 9)):
        kind = draw.randrange(10)
        body.append(f"<h2>{main_text(8)}</h2>" if kind == 0 else f"<ul><li>{main_text(15)}</li><li>{main_text(15)}</li></ul>" if kind == 1
                    else f"<blockquote>{main_text()}</blockquote>" if kind == 2 else f"<p>{main_text()}</p>")
    for _ in range(draw.choice([0, 0, 1, 2])):
        body.insert(draw.randint(0, len(body)), side())
    name = draw.choice(MAIN_NAMES)
    inner = "".join(body)
    wrap = [f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f"<main>{inner}</main>", f'<div class="{name}">{inner}</div>',
            f'<div id="{name}"><div>{inner}</div></div>', f"<article class='{name}'>{inner}</article>"][draw.randrange(6)]
    before = (["<header><h2>" + side_text() + "</h2></header>"] if draw.random() < 0.4 else []) + [side() for _ in range(draw.randint(0, 3))]
    after = [side() for _ in range(draw.randint(0, 3))] + ([f"<footer>&copy; {side_text()} &middot; {side_text()}</footer>"] if draw.random() < 0.8 else [])
    return "<html><body>" + "".join(before) + wrap + "".join(after) + "</body></html>"


def names_to_note(pages: list[str]) -> set[str]:
    """Words of names that two of the pages have, and the fixed ones: a page of its own names adds nothing to a model."""
    uses = Counter(n for html in pages for n in page_names(html))
    return {n for n, k in uses.items() if k > 1} | _SIDE_WORDS | {w for name in MAIN_NAMES for w in name.split()} | {HIDDEN}


def training_chains(pages: list[str], layouts: int = LAYOUT_PAGES, seed: int = 7) -> list:
    draw = random.Random(seed)
    chains, main, side = [], ["A plain sentence, written to be read.", "It says a few things and then it ends."], ["Home", "About us", "Read more"]
    known = names_to_note(pages)
    for html in pages:
        blocks = leaf_blocks(html, known)
        labels = _marked(blocks)
        if labels is None:
            continue
        main += [b.text for b, y in zip(blocks, labels) if y]
        side += [b.text for b, y in zip(blocks, labels) if not y]
        own = features(blocks)
        chains += [(own[i:i + FIT_BLOCKS], labels[i:i + FIT_BLOCKS]) for i in range(0, len(own), FIT_BLOCKS)]
    for _ in range(layouts):
        blocks = leaf_blocks(_layout(main, side, draw), known)
        labels = [int(_MARK in b.text) for b in blocks]
        clean = [b._replace(text=b.text.replace(_MARK, "") or "-", linked=min(b.linked, len(b.text.replace(_MARK, "") or "-"))) for b in blocks]
        chains.append((features(clean), labels))
    return chains


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES, layouts: int = LAYOUT_PAGES) -> ChainCRF:
    """Fit on about ``sample_pages`` pages drawn by a hash, and on ``layouts`` built pages."""
    filled = pages.filter("html IS NOT NULL").select("page_id", "html")
    n = filled.count()
    share = min(1.0, sample_pages / max(1, n))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "page_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = [r["html"] for r in filled.filter(draw < share).select("html").toLocalIterator()]
    return fit(training_chains(sorted(drawn), layouts))


def main_text(html: str | None, model: ChainCRF) -> str:
    blocks = leaf_blocks(html, model.names)
    return "\n".join(b.text for b, y in zip(blocks, model.decode(features(blocks))) if y)


def extract(pages: DataFrame, model: ChainCRF | None = None, keep_html: bool = False) -> DataFrame:
    """All columns of ``pages`` (html only if ``keep_html``), then text and n_chars.

    Null and empty pages and pages without main blocks have an empty text; repeated rows are decoded one
    by one; own columns with the new names are replaced; an empty table gives no rows."""
    model = model or train(pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    out = pages.drop("text", "n_chars")
    plain = [c for c in out.columns if c != "html" or keep_html]
    body = free_name(out, "_html")
    out = out.select(*[F.col(f"`{c}`") for c in plain], F.col("html").alias(body))

    def label(batches):
        model = shared.value
        for batch in batches:
            texts = [main_text(h, model) for h in batch.column(body).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(plain)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [*plain, "text", "n_chars"])

    return out.mapInArrow(label, with_fields(out.drop(body), "text string, n_chars long"))
