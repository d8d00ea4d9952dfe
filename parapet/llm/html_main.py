"""Main text of web pages: boosted trees judge the blocks, the tree of blocks settles them.

Every block of a page (``dom.read_page``) gets features of its element, attribute words, depth,
subtree density and siblings. Gradient-boosted trees, trained on generated pages whose main text is
known by construction, give the odds that the block belongs to it. The best consistent choice over
the tree of blocks is then taken: nothing is kept below a dropped block.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.llm.boosting import Trees, fit_trees
from parapet.llm.common import slices
from parapet.llm.dom import HINT_NO, KIND_NO, Page, read_page

TRAINING_PAGES = 1500


# --- features ------------------------------------------------------------------------------
def _bits(values: np.ndarray, n: int) -> np.ndarray:
    return (values[:, None] >> np.arange(n)) & 1


def block_features(pages: list[Page]) -> np.ndarray:
    """One row per block of ``pages``, in order."""
    shift = np.cumsum([0, *(len(p.kind) for p in pages)])
    total = shift[-1]
    column = lambda name: np.array([v for p in pages for v in getattr(p, name)], np.int64)
    base = np.repeat(shift[:-1], np.diff(shift))
    parent, end = column("parent"), column("end") + base
    root = parent < 0
    up = np.where(root, np.arange(total), parent + base)
    kind, hints = column("kind"), column("hints")

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[end] - sums[:-1]

    chars, linked, stops = (below(column(n)) for n in ("chars", "linked", "stops"))
    blocks = end - np.arange(total)
    paragraphs = below((kind == KIND_NO["par"]).astype(np.int64))
    items = below((kind == KIND_NO["item"]).astype(np.int64))
    children = np.bincount(up[~root], minlength=total)
    order = np.arange(total) - up  # place after the parent's start
    text = chars + 1.0
    shape = np.stack([
        column("depth"), np.log1p(chars), linked / text, np.log1p(chars / blocks), stops / text,
        np.log1p(blocks), paragraphs / blocks, items / blocks, children, children[up],
        chars / (chars[up] + 1.0), order / np.maximum(blocks[up], 1), linked[up] / (chars[up] + 1.0),
        np.log1p(chars[up] / np.maximum(children[up], 1)),
    ], axis=1)
    return np.hstack([
        shape, kind[:, None] == np.arange(len(KIND_NO)), kind[up][:, None] == np.arange(len(KIND_NO)),
        _bits(hints, len(HINT_NO)), _bits(column("above"), len(HINT_NO)),
        _bits(column("inside"), 6),
    ]).astype(np.float32)


# --- training pages ------------------------------------------------------------------------
_MARK = "⁠"  # stands in the text of blocks that belong to the main text


def _words(rnd: random.Random, low: int, high: int, mark: bool) -> str:
    letters = "abcdefghijklmnopqrstuvwxyzéäñ"
    out = []
    for _ in range(rnd.randint(low, high)):
        word = "".join(rnd.choices(letters, k=rnd.randint(1, 11)))
        out.append(word + rnd.choice(["", "", "", "", "", ",", "."]))
    return (_MARK if mark else "") + " ".join(out)


def _links(rnd: random.Random, n: int, wrap: str = "li") -> str:
    item = [f'<{wrap}><a href="/x">{_words(rnd, 1, 4, False)}</a></{wrap}>' for _ in range(n)]
    return f"<ul>{''.join(item)}</ul>" if wrap == "li" else "".join(item)


def _article(rnd: random.Random) -> str:
    parts = [f"<h1>{_words(rnd, 1, 12, True)}</h1>"] if rnd.random() < 0.85 else []
    if parts and rnd.random() < 0.1:
        parts = [f"<header>{parts[0]}</header>"]
    for _ in range(rnd.choice([1, 1, 2, 3, 5, 8, 12])):
        roll = rnd.random()
        long = rnd.choice([1, 2, 8, 40, 90, 200])
        if roll < 0.66:
            inner = _words(rnd, 1, long, True)
            if rnd.random() < 0.25:
                inner += f' <a href="/y">{_words(rnd, 1, 4, False)}</a> {_words(rnd, 1, 9, False)}'
            open_bold = "<b>" if rnd.random() < 0.2 else ""
            parts.append(f"<p>{open_bold}{inner}" + rnd.choice(["</p>", "</p>", "<br>", ""]))
        elif roll < 0.76:
            level = rnd.randint(2, 4)
            parts.append(f"<h{level}>{_words(rnd, 1, 7, True)}</h{level}>")
        elif roll < 0.84:
            rows = "".join(f"<li>{_words(rnd, 1, 20, True)}</li>" for _ in range(rnd.randint(1, 6)))
            parts.append(f"<ul>{rows}</ul>")
        elif roll < 0.90:
            parts.append(f"<blockquote><p>{_words(rnd, 2, 40, True)}</p></blockquote>")
        elif roll < 0.94:
            rows = "".join(
                f"<tr><td>{_words(rnd, 1, 3, True)}</td><td>{_words(rnd, 1, 5, True)}</td></tr>"
                for _ in range(rnd.randint(1, 4)))
            parts.append(f"<table>{rows}</table>")
        elif roll < 0.97:
            parts.append(f"<pre>{_words(rnd, 2, 30, True)}</pre>")
        else:
            parts.append(f"<div>{_words(rnd, 5, 60, True)}</div>")
    for _ in range(rnd.choice([0, 0, 0, 1, 1, 2])):  # foreign blocks within the article
        parts.insert(rnd.randint(0, len(parts)), _foreign(rnd))
    body = "".join(parts)
    if rnd.random() < 0.3:
        body = f"<{rnd.choice(['div', 'section'])}>{body}</div>"
    return body


def _foreign(rnd: random.Random) -> str:
    """A block that is not main text."""
    say = lambda low=1, high=30: _words(rnd, low, high, False)
    para = lambda: "".join(f"<p>{say()}</p>" for _ in range(rnd.randint(1, 4)))
    fill = lambda: rnd.choice([say, para, lambda: _links(rnd, rnd.randint(1, 8))])()
    names = {
        "advert": "ad ads advert advertisement sponsored ad-slot promo adbox banner-ad",
        "nav": "nav menu navbar breadcrumbs pagination main-menu site-nav toc",
        "side": "sidebar widget related related-posts trending recommended side-bar popular",
        "talk": "comments comment-list disqus_thread reader-comments replies discussion responses",
        "notice": "cookie-banner cookie-notice notice consent gdpr alert popup modal overlay",
        "foot": "footer site-footer copyright legal colophon",
        "head": "header site-header masthead topbar logo",
        "form": "search newsletter subscribe login signup-form",
        "share": "share social-share follow-us sharing",
    }
    roll = rnd.random()
    if roll < 0.3:
        tag = rnd.choice(["nav", "footer", "aside", "header", "form", "dialog"])
        if tag == "form":
            return f"<form><label>{say(1, 4)}</label><input name=q><button>{say(1, 2)}</button></form>"
        return f"<{tag}>{_links(rnd, rnd.randint(2, 9)) if tag == 'nav' else fill()}</{tag}>"
    if roll < 0.36:
        return f"<div>{_links(rnd, rnd.randint(3, 9), rnd.choice(['li', 'span']))}</div>"
    kind = rnd.choice(list(names))
    name, attribute = rnd.choice(names[kind].split()), rnd.choice(["class", "class", "id"])
    tag = rnd.choice(["div", "div", "section", "ul" if kind == "nav" else "aside"])
    if kind == "talk":
        rows = [f'<div class="comment"><b>{say(1, 2)}</b><p>{say(3, 60)}</p></div>'
                for _ in range(rnd.randint(1, 5))]
        if rnd.random() < 0.4:
            rows = [f"<article>{r}</article>" for r in rows]
        if rnd.random() < 0.4:
            rows = [f"<p>{say(3, 60)}</p>", f"<h3>{say(1, 3)}</h3>"]
        return f'<section {attribute}="{name}"><h2>{say(1, 3)}</h2>{"".join(rows)}</section>'
    return f'<{tag} {attribute}="{name}">{fill()}</{tag}>'


def training_page(rnd: random.Random) -> str:
    """A page in which marked text, and no other, is main text."""
    opened = rnd.choice(["article", "article", "article", "main", "main", 'div class="content"',
                         'div id="main-content"', 'div class="post-body"', "div",
                         'section class="story"', 'div class="entry"', 'div class="article-text"'])
    story = f"<{opened}>{_article(rnd)}</{opened.split()[0]}>"
    if rnd.random() < 0.25:
        story = f'<div class="{rnd.choice(["wrapper", "page", "container", "row"])}">{story}'
        story += (_foreign(rnd) if rnd.random() < 0.5 else "") + "</div>"
    before = [_foreign(rnd) for _ in range(rnd.choice([0, 1, 2, 2, 3]))]
    after = [_foreign(rnd) for _ in range(rnd.choice([0, 1, 1, 2, 3]))]
    body = "".join([*before, story, *after])
    return f"<html><head><title>t</title></head><body>{body}</body></html>"


def _labels(page: Page) -> np.ndarray:
    """Blocks that hold marked text, or have one that does below."""
    own = np.zeros(len(page.kind), np.int64)
    for block, piece in page.pieces:
        if piece is not None and _MARK in piece:
            own[block] = 1
    sums = np.concatenate([[0], np.cumsum(own)])
    return (sums[np.array(page.end)] > sums[:-1]).astype(np.float64)


@cache
def block_model(n: int = TRAINING_PAGES, seed: int = 5) -> Trees:
    """Trees trained on ``n`` generated pages."""
    rnd = random.Random(seed)
    pages = [read_page(training_page(rnd)) for _ in range(n)]
    return fit_trees(block_features(pages), np.concatenate([_labels(p) for p in pages]))


# --- decoding ------------------------------------------------------------------------------
def consistent_choice(page: Page, odds: list[float]) -> list[bool]:
    """The choice of highest total log-odds in which kept blocks have kept parents."""
    gain = list(odds)
    gain[0] = 0.0  # the root stands
    for i in range(len(gain) - 1, 0, -1):  # children come after their parents
        if gain[i] > 0:
            gain[page.parent[i]] += gain[i]
    keep = [True] * len(gain)
    for i in range(1, len(gain)):
        keep[i] = gain[i] > 0 and keep[page.parent[i]]
    return keep


def main_texts(sources: list[str | None], model: Trees) -> list[str]:
    """Main text of each page; empty for null and empty pages."""
    pages = [read_page(source or "") for source in sources]
    odds = model.margin(block_features(pages)) if pages else []
    out, at = [], 0
    for page in pages:
        part = list(odds[at : at + len(page.kind)])
        at += len(part)
        out.append(page.text(consistent_choice(page, part)))
    return out


def _extracted(model: Trees):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = main_texts(batch.column(2).to_pylist(), model)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            arrays = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, training_pages: int = TRAINING_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Whole pages are read. Null, empty and text-free pages give an empty text; ids and urls pass
    through as they are, also null or repeated. Other columns are not read.
    """
    model = block_model(training_pages)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(
        _extracted(model), f"page_id {kind}, url string, text string, n_chars long"
    )
