"""Marked-up text as bytes: its encoding, its leaf text tags, and new texts in their places.

A scanner over tags, comments, CDATA sections and the text between them, for XML as for tag soup.  What
is replaced is replaced between two byte offsets, so every other byte stays as it is.
"""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass, field
from html import unescape
from html.entities import html5

HEADINGS = {f"h{n}" for n in range(1, 7)}
TEXT = HEADINGS | {"p", "td", "th", "blockquote", "div", "li"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: An opening tag of the key closes an open tag of the value.
_CLOSES = {"li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"td", "th", "p"}} | {t: {"p"} for t in HEADINGS | {"p", "blockquote", "div", "ul", "ol", "table"}}

#: Comments, CDATA, declarations and instructions, end tags, start tags.  Nothing is tried twice, and it is only
#: searched up to the last ">", so no text is slow.
_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)
    |<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)
    |<![^>\[]*+(?:\[[^\]]{0,4096}+\][^>]*+)?>
    |<\?[^>]*+>
    |</(?P<end>[a-zA-Z][^\s/>]*+)?[^>]*+>
    |<(?P<start>[a-zA-Z][^\s/>]*+)(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^>"'\s][^>\s]*+)?+|["'])*+(?P<close>(?<=/))?>""",
    re.DOTALL | re.VERBOSE,
)
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style")}
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|([a-zA-Z][a-zA-Z0-9]*));")
_DECLARED = re.compile(rb"""\s*<\?xml[^>]*?\sencoding\s*=\s*["']([A-Za-z][A-Za-z0-9._-]*)["']""")
_META = re.compile(rb"""<meta\s[^>]*?charset\s*=\s*["']?\s*([A-Za-z][A-Za-z0-9._-]*)""", re.IGNORECASE)
_MARKS = [(codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF32_LE, "utf-32-le"), (codecs.BOM_UTF32_BE, "utf-32-be"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")]


@dataclass(slots=True)
class Leaf:
    """A text tag, and where its content starts and ends."""

    tag: str
    start: int
    end: int = -1
    holds_none: bool = True
    pieces: list[str] = field(default_factory=list)

    @property
    def kind(self) -> str:
        return "heading" if self.tag in HEADINGS else "list_item" if self.tag == "li" else "paragraph"

    @property
    def text(self) -> str:
        return " ".join(re.split(r"\s+", "".join(self.pieces))).strip()


def encoding(content: bytes) -> tuple[str, int]:
    """The codec of ``content`` by its mark, its declaration or its first bytes, else UTF-8; and the length of the mark."""
    for mark, codec in _MARKS:
        if content.startswith(mark):
            return codec, len(mark)
    for start, codec in ((b"<\0?\0", "utf-16-le"), (b"\0<\0?", "utf-16-be")):
        if content.startswith(start):
            return codec, 0
    named = _DECLARED.match(content[:1024]) or _META.search(content[:1024])
    name = named[1].decode() if named else "utf-8"
    # what could be read as ASCII so far is in no encoding of wider units, whatever it says
    return ("utf-8" if re.match(r"(?i)utf-?(16|32)|ucs", name) else name), 0


def decoded(content: bytes) -> tuple[str, str, int]:
    """Text, codec and length of the mark; an error where the bytes are not in their encoding."""
    codec, mark = encoding(content)
    try:
        return content[mark:].decode(codec), codec, mark
    except (UnicodeDecodeError, LookupError):
        raise ValueError(f"not in its encoding: {codec}") from None


def unescape_closed(text: str) -> str:
    """``text`` with its references read, but only those that end in a semicolon: one that is cut off stays as it is."""
    return _REFERENCE.sub(lambda m: html5.get(f"{m[1]};", m[0]) if m[1] else unescape(m[0]), text)


def leaves(text: str, closed: bool = False) -> list[Leaf]:
    """The text tags that hold no other text tag and are not blank, in document order.

    References are read as browsers do, or with ``closed`` only where they end in a semicolon, as in XML.
    """
    read = unescape_closed if closed else unescape
    found: list[Leaf] = []
    stack: list[tuple[str, Leaf | None]] = []
    texts: list[Leaf] = []  # the open text tags; only the innermost can be a leaf
    counts: dict[str, int] = {}

    def close(at: int) -> None:
        tag, leaf = stack.pop()
        counts[tag] -= 1
        if leaf is not None:
            leaf.end = at
            texts.pop()

    at, stop, last = 0, len(text), text.rfind(">") + 1
    while at < stop:
        token = _TOKEN.search(text, at, last)
        here = token.start() if token else unfinished.start() if (unfinished := _UNFINISHED.search(text, max(at, last))) else stop
        if here > at and texts and texts[-1].holds_none:
            texts[-1].pieces.append(read(text[at:here]))
        if not token:
            break
        at = token.end()
        if token["start"]:
            tag = token["start"].lower()
            if tag in _VOID:
                continue
            if stack and stack[-1][0] in _CLOSES.get(tag, ()):
                close(here)
            leaf = None
            if tag in TEXT:
                if texts:
                    texts[-1].holds_none = False
                leaf = Leaf(tag, at)
                texts.append(leaf)
                found.append(leaf)
            stack.append((tag, leaf))
            counts[tag] = counts.get(tag, 0) + 1
            if token["close"] is not None:
                close(at)
            elif tag in _RAW_END:
                # scripts and styles are no markup: on to their end
                ended = _RAW_END[tag].search(text, at)
                at = ended.start() if ended else stop
        elif token["end"]:
            tag = token["end"].lower()
            if counts.get(tag):
                while stack[-1][0] != tag:
                    close(here)
                close(here)
        elif token["cdata"] is not None and texts and texts[-1].holds_none:
            texts[-1].pieces.append(token["cdata"])
    while stack:
        close(stop)
    return [leaf for leaf in found if leaf.holds_none and "".join(leaf.pieces).strip()]


def _escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _fitting(text: str, texts: list[str]) -> list[Leaf]:
    found = leaves(text)
    if len(found) != len(texts):
        raise ValueError(f"{len(texts)} texts for {len(found)} blocks")
    return found


def replaced(text: str, texts: list[str]) -> str:
    """``text`` with the content of its n-th leaf replaced by the n-th of ``texts``, which must be as many."""
    out, last = [], 0
    for leaf, new in zip(_fitting(text, texts), texts):
        out += [text[last : leaf.start], _escaped(new)]
        last = leaf.end
    return "".join(out) + text[last:]


def replaced_bytes(content: bytes, texts: list[str]) -> bytes:
    """The same in the encoding of ``content``; a character that it lacks becomes a reference, bytes outside the leaves stay."""
    text, codec, mark = decoded(content)
    if text.encode(codec) != content[mark:]:
        raise ValueError(f"encoding cannot be kept: {codec}")
    out, last, at, place = [content[:mark]], mark, 0, mark
    for leaf, new in zip(_fitting(text, texts), texts):
        # byte offsets by the bytes of the characters on the way
        start = place + len(text[at : leaf.start].encode(codec))
        place = start + len(text[leaf.start : leaf.end].encode(codec))
        at = leaf.end
        out += [content[last:start], _escaped(new).encode(codec, "xmlcharrefreplace")]
        last = place
    return b"".join(out) + content[last:]
