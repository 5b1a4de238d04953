"""The blocks of a raw mail, with transfer encodings and HTML undone. A small helper called inside Arrow batches."""

from __future__ import annotations

import binascii
import codecs
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

_GAP = re.compile(r"\n(?:[^\S\n]*\n)+")
_FIELD = re.compile(r"(?im)^content-(type|transfer-encoding)[ \t]*:[ \t]*([^\n]*(?:\n[ \t]+[^\n]+)*)")
_BOUNDARY = re.compile(r'(?i)boundary[ \t]*=[ \t]*"?([^";\s]+)')
_CHARSET = re.compile(r'(?i)charset[ \t]*=[ \t]*"?([^";\s]+)')
_HEAD_LINE = re.compile(r"[A-Za-z][A-Za-z0-9-]*[ \t]*:|[ \t]+\S")
_TAG = re.compile(r"<[^<>]*>")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")


class Unit(NamedTuple):
    block: int  # number of the block in the mail, of a base64 part that of its first block
    kind: str  # head (of the mail or a part), body, or base64 (a decoded part)
    text: str


class _Part:
    """What the head of a part says about its body."""

    def __init__(self, head: str = "") -> None:
        self.html, self.encoding, self.charset = False, "", "utf-8"
        for name, value in _FIELD.findall(head):
            if name.lower() == "type":
                self.html = value.lower().startswith("text/html")
                if m := _CHARSET.search(value):
                    self.charset = m[1]
            else:
                self.encoding = value.strip().lower()
        try:
            codecs.lookup(self.charset)
        except LookupError:
            self.charset = "utf-8"

    def decoded(self, raw: str) -> str:
        """raw without its transfer encoding, HTML tags and entities."""
        if self.encoding == "base64":
            kept = _NOT_BASE64.sub("", raw)
            kept = kept[: len(kept) - 1] if len(kept) % 4 == 1 else kept
            raw = binascii.a2b_base64(kept + "=" * (-len(kept) % 4)).decode(self.charset, "replace")
        elif self.encoding == "quoted-printable" and "=" in raw:
            try:
                data = raw.encode(self.charset)
            except UnicodeEncodeError:
                data = raw.encode("utf-8")
            raw = binascii.a2b_qp(data).decode(self.charset, "replace")
        if self.html:
            raw = _TAG.sub(" ", raw)
            raw = html.unescape(raw) if "&" in raw else raw
        return raw


def blocks(text: str) -> list[str]:
    """The pieces of text between lines that are empty or hold only white space; further blank lines make no blocks."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return [b.strip("\n") for b in _GAP.split("\n" + text + "\n") if b and not b.isspace()]


def units(text: str) -> Iterator[Unit]:
    """The blocks of a mail one after another, decoded. A base64 part is one unit, whatever blank lines stray into it. A boundary line
    or part head inside a block splits it; a part that is never closed ends with the mail. Text without any mail header
    is read as one whose first block is the header.
    """
    bounds: set[str] = set()
    part, held, held_at = _Part(), [], 0
    multipart = False
    for k, block in enumerate(blocks(text)):
        if k == 0:
            part = _Part(block)
            bounds.update(_BOUNDARY.findall(block))
            multipart = bool(bounds)
            yield Unit(0, "head", block)
            continue
        pieces: list[tuple[str, str]] = []
        if multipart and "--" in block:
            body: list[str] = []
            lines = block.split("\n")
            i = 0
            while i < len(lines):
                mark = lines[i].strip()
                if mark.startswith("--") and (mark[2:] in bounds or (mark.endswith("--") and mark[2:-2] in bounds)):
                    if body:
                        pieces.append(("body", "\n".join(body)))
                        body = []
                    head = []
                    i += 1
                    while i < len(lines) and _HEAD_LINE.match(lines[i]):
                        head.append(lines[i])
                        i += 1
                    pieces.append(("head", "\n".join(head)))
                    continue
                body.append(lines[i])
                i += 1
            if body:
                pieces.append(("body", "\n".join(body)))
        elif multipart and _FIELD.match(block.lstrip("\n")) and all(_HEAD_LINE.match(x) for x in block.strip("\n").split("\n")):
            pieces.append(("head", block.strip("\n")))
        else:
            pieces.append(("body", block))
        for kind, piece in pieces:
            if kind == "head":
                if held:
                    yield Unit(held_at, "base64", part.decoded("".join(held)))
                    held = []
                part = _Part(piece)
                bounds.update(_BOUNDARY.findall(piece))
                yield Unit(k, "head", piece)
            elif part.encoding == "base64":
                held_at = held_at if held else k
                held.append(piece)
            else:
                yield Unit(k, "body", part.decoded(piece))
    if held:
        yield Unit(held_at, "base64", part.decoded("".join(held)))
