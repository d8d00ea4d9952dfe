"""A lenient HTML reader that lists a page's blocks with what is needed to judge them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Element names by kind, and words of class, id and role by what they hint at.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea iframe".split())  # all but their end tag is text
UNREAD = set("noscript template svg select".split())  # elements in which nothing is read
KINDS = {
    "root": "html body #root", "story": "article main", "box": "section div center hgroup details",
    "par": "p", "title": "h1 h2 h3 h4 h5 h6", "list": "ul ol dl menu", "item": "li dt dd summary",
    "nav": "nav", "header": "header", "footer": "footer address", "aside": "aside dialog",
    "form": "form fieldset legend button label", "quote": "blockquote pre figure figcaption",
    "table": "table thead tbody tfoot caption tr td th",
}
HINTS = {
    "good": "article content main post entry story body text prose paragraph",
    "nav": "nav navbar navigation menu breadcrumb pagination pager toc sitemap skip links",
    "head": "header masthead topbar logo branding tagline",
    "foot": "footer copyright legal colophon imprint credits",
    "side": "sidebar aside rail widget related recommended trending popular teaser readnext also",
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promoted promotion "
    "banner adbox adslot",
    "talk": "comment comments commentlist reply replies disqus discussion respond reviews feedback",
    "form": "form search login signin signup subscribe subscription newsletter register",
    "notice": "cookie cookies consent gdpr privacy notice alert popup modal overlay toast paywall "
    "message warning disclaimer",
    "share": "share sharing social follow facebook twitter",
}
KIND_OF = {name: kind for kind, names in KINDS.items() for name in names.split()}
KIND_NO = {kind: i for i, kind in enumerate([*KINDS, "inline"])}
HINT_NO = {hint: i for i, hint in enumerate([*HINTS, "hidden"])}
_HINT_OF = {word: 1 << HINT_NO[h] for h, words in HINTS.items() for word in words.split()}
_LONG = [(w, bit) for w, bit in _HINT_OF.items() if len(w) >= 6]
_SPECIAL = {k: 1 << i for i, k in enumerate(["story", "nav", "header", "footer", "aside", "form"])}

_TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|</?[A-Za-z][^<]*\Z",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"(class|id|role|aria-label|aria-hidden|style|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?",
    re.I,
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_hints: dict[str, int] = {}


def hint_bits(attributes: str) -> int:
    """What the words of an element's attributes hint at, as a bit per hint."""
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return 0
    if attributes not in _hints:
        bits = 0
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                bits |= 1 << HINT_NO["hidden"]
            elif name == "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                    bits |= 1 << HINT_NO["hidden"]
            else:
                for word in map(str.lower, _WORD.findall(value)):
                    bits |= _HINT_OF.get(word, 0)
                    for stem, bit in _LONG:
                        if word.startswith(stem):
                            bits |= bit
        if len(_hints) > 50_000:
            _hints.clear()
        _hints[attributes] = bits
    return _hints[attributes]


@dataclass
class Page:
    """Blocks in page order. ``pieces`` are (block, text), or (block, None) where a block breaks."""

    kind: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    hints: list[int] = field(default_factory=list)
    above: list[int] = field(default_factory=list)  # hints of the ancestors
    inside: list[int] = field(default_factory=list)  # special elements among the ancestors
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    stops: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str | None]] = field(default_factory=list)

    def open(self, name: str, hints: int, parent: int) -> int:
        kind = KIND_OF.get(name, "inline")
        self.kind.append(KIND_NO[kind])
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.end.append(0)
        self.hints.append(hints)
        self.above.append(self.above[parent] | self.hints[parent] if parent >= 0 else 0)
        self.inside.append((self.inside[parent] if parent >= 0 else 0) | _SPECIAL.get(kind, 0))
        self.chars.append(0)
        self.linked.append(0)
        self.stops.append(0)
        return len(self.kind) - 1

    def text(self, keep: list[bool]) -> str:
        """The kept blocks' text: one line each, white space folded, references decoded."""
        lines, line = [], []
        for block, piece in self.pieces:
            if piece is None:
                if line:
                    lines.append(" ".join(html.unescape("".join(line)).split()))
                    line = []
            elif keep[block]:
                line.append(piece)
        if line:
            lines.append(" ".join(html.unescape("".join(line)).split()))
        return "\n".join(filter(None, lines))


_GOOD_ONLY = 1 << HINT_NO["good"]
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
              "td": ("td", "th"), "th": ("td", "th")}


def _after_raw(source: str, at: int, name: str) -> int:
    """Where the page goes on after the content of a raw element, which starts at ``at``."""
    over = re.compile(rf"</{re.escape(name)}[\s/>]|\Z", re.I).search(source, at)
    tail = source.find(">", over.start())
    return len(source) if tail < 0 else tail + 1


def _self_closed(attributes: str) -> bool:
    """Whether a tag ends in a slash that is not part of an unquoted value."""
    return attributes.endswith("/") and not re.search(r"=[^\s\"']+\Z", attributes)


def _after_unread(source: str, at: int, name: str, around: set[str]) -> int:
    """Where the page goes on after the content of an unread element.

    It ends at its end tag or else where a block ``around`` it does. A block's start tag ends an
    image or a choice too, which cannot hold one but in foreign objects.
    """
    inner, foreign, blocks = 0, 0, dict.fromkeys(around, 0)
    while match := _TAG.search(source, at):
        at, tag, ends = match.end(), (match[2] or "").lower(), bool(match[1])
        if tag == name:
            if ends and not inner:
                return at
            inner += -1 if ends else not _self_closed(match[3])
        elif tag in RAW and not ends:
            if not (name == "svg" and _self_closed(match[3])):
                at = _after_raw(source, at, tag)
        elif tag == "foreignobject":
            foreign = max(0, foreign + (-1 if ends else not _self_closed(match[3])))
        elif tag in KIND_OF and not ends and name in ("svg", "select") and not foreign:
            return match.start()
        elif tag in blocks:
            if ends and not blocks[tag]:
                return match.start()
            blocks[tag] += -1 if ends else 1
    return len(source)


def read_page(source: str) -> Page:
    """The blocks of a page. Unclosed and misplaced tags are mended as browsers commonly do."""
    page, at, links = Page(), 0, 0
    stack = [("#root", page.open("#root", 0, -1))]  # names of open elements with their block

    def close(depth: int) -> None:
        nonlocal links
        for name, block in stack[depth:]:
            links -= name == "a"
            if name in KIND_OF:
                page.pieces.append((block, None))
        for i in {b for _, b in stack[depth:]} - {b for _, b in stack[:depth]}:
            page.end[i] = len(page.kind)
        del stack[depth:]

    def put(piece: str) -> None:
        if piece:
            block = stack[-1][1]
            page.pieces.append((block, piece))
            n = len(piece) if not piece.isspace() else 0
            page.chars[block] += n
            page.linked[block] += n if links else 0
            page.stops[block] += piece.count(".") + piece.count(",")

    while match := _TAG.search(source, at):
        put(source[at : match.start()])
        at = match.end()
        name = (match[2] or "").lower()
        if not name:
            continue
        if match[1]:
            kind = KIND_OF.get(name)
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name or kind == "title" == KIND_OF.get(stack[i][0]):
                    close(i)
                    break
                if stack[i][0] in KIND_OF and name not in KIND_OF:
                    break  # an inline end tag does not reach out of its block
            continue
        if name in RAW:
            at = _after_raw(source, at, name)
            continue
        if name in UNREAD:
            if name != "svg" or not _self_closed(match[3]):
                around = {n for n, _ in stack if n in KIND_OF}
                at = _after_unread(source, at, name, around)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                put(" ")
            if name == "hr":
                page.pieces.append((stack[-1][1], None))
            continue
        block = name in KIND_OF
        if block:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or stack[i][0] in _CLOSED_BY.get(name, ()):
                    close(i)
                elif KIND_OF.get(stack[i][0]) not in (None, "par"):
                    break
        hints = hint_bits(match[3])
        inner = stack[-1][1]
        if block or hints & ~_GOOD_ONLY:
            inner = page.open(name, hints, inner)
        if block:
            page.pieces.append((inner, None))
        if match[3].endswith("/") and not block:
            continue
        links += name == "a"
        stack.append((name, inner))
    put(source[at:])
    close(0)
    page.end = [e or len(page.kind) for e in page.end]
    return page
