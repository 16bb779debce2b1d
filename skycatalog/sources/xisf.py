"""XISF headers: prologue and the XML region only.

Outcomes: 'ok', or EMPTY_FILE, TRUNCATED_HEADER, BAD_SIGNATURE, MALFORMED_XML.  The XML is read tolerantly: only the balance of tags and
the form of attributes count; FITSKeyword and Property elements are taken wherever they stand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from skycatalog.sources.fits import HeaderError, Read

PROLOGUE, SIGNATURE, MAX_XML = 16, b"XISF0100", 16 * 1024 * 1024
# Named entities.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
ENTITY = re.compile(r"&(#x[0-9A-Fa-f]+|#[0-9]+|[A-Za-z]+);")
ATTRIBUTE = re.compile(r"\s+([^\s=\"'<>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
NAME = re.compile(r"[^\s/>]+")


@dataclass
class XisfHeader:
    status: str = "ok"
    error_code: str | None = None
    error_message: str | None = None
    keywords: dict[str, str] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)
    header_bytes: int = 0


def _entity(m: re.Match) -> str:
    e = m[1]
    if e.startswith("#"):
        n = int(e[2:], 16) if e[1] in "xX" else int(e[1:])
        return chr(n) if n < 0x110000 else m[0]
    return ENTITIES.get(e, m[0])


def _tags(xml: str):
    """Inner texts of the tags; comments, instructions and declarations are passed over."""
    at = 0
    while (start := xml.find("<", at)) >= 0:
        for opening, closing in (("<!--", "-->"), ("<?", "?>"), ("<![CDATA[", "]]>")):
            if xml.startswith(opening, start):
                end = xml.find(closing, start + len(opening))
                if end < 0:
                    raise HeaderError("MALFORMED_XML", f"{opening} without end")
                at = end + len(closing)
                break
        else:
            quote, i = "", start + 1
            while i < len(xml):
                c = xml[i]
                if quote:
                    quote = "" if c == quote else quote
                elif c in "\"'":
                    quote = c
                elif c == ">":
                    break
                i += 1
            if i >= len(xml):
                raise HeaderError("MALFORMED_XML", "tag without end")
            at = i + 1
            if xml[start + 1] != "!":
                yield xml[start + 1 : i]


def _attributes(text: str) -> dict[str, str]:
    out, at = {}, 0
    while m := ATTRIBUTE.match(text, at):
        out[m[1]] = ENTITY.sub(_entity, m[2] if m[2] is not None else m[3])
        at = m.end()
    if text[at:].strip():
        raise HeaderError("MALFORMED_XML", "bad attribute")
    return out


def parse_xml(xml: str) -> tuple[dict[str, str], dict[str, str]]:
    keywords: dict[str, str] = {}
    properties: dict[str, str] = {}
    path: list[str] = []
    seen = False
    for tag in _tags(xml):
        seen = True
        if tag.startswith("/"):
            if not path or path.pop() != tag[1:].strip():
                raise HeaderError("MALFORMED_XML", "closing tag does not match")
            continue
        empty = tag.endswith("/")
        body = tag[:-1] if empty else tag
        m = NAME.match(body)
        if not m:
            raise HeaderError("MALFORMED_XML", "tag without name")
        attributes = _attributes(body[m.end() :])
        if m[0] == "FITSKeyword" and "name" in attributes and "value" in attributes:
            keywords[attributes["name"]] = attributes["value"]
        elif m[0] == "Property" and "id" in attributes and "value" in attributes:
            properties[attributes["id"]] = attributes["value"]
        if not empty:
            path.append(m[0])
    if path or not seen:
        raise HeaderError("MALFORMED_XML", "unclosed element" if path else "no element")
    return keywords, properties


def parse_header(read: Read) -> XisfHeader:
    try:
        head = read(0, PROLOGUE)
        if not head:
            raise HeaderError("EMPTY_FILE", "no bytes")
        if len(head) < len(SIGNATURE):
            raise HeaderError("TRUNCATED_HEADER", "short signature")
        if head[:8] != SIGNATURE:
            raise HeaderError("BAD_SIGNATURE", "no XISF signature")
        if len(head) < PROLOGUE:
            raise HeaderError("TRUNCATED_HEADER", "short prologue")
        size = int.from_bytes(head[8:12], "little")
        if size > MAX_XML:
            raise HeaderError("TRUNCATED_HEADER", f"header of {size} bytes")
        xml = read(PROLOGUE, size)
        if len(xml) < size:
            raise HeaderError("TRUNCATED_HEADER", "short XML region")
        keywords, properties = parse_xml(xml.decode("utf-8", "replace").rstrip("\0"))
        return XisfHeader(keywords=keywords, properties=properties, header_bytes=PROLOGUE + size)
    except HeaderError as e:
        return XisfHeader(status="error", error_code=e.code, error_message=str(e))


def parse_bytes(data: bytes) -> XisfHeader:
    return parse_header(lambda offset, length: data[offset : offset + length])


def write_header(keywords: dict[str, str], properties: dict[str, str] | None = None) -> bytes:
    """A unit with the given keywords, for tests and synthetic files."""
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    body = "".join(f'<FITSKeyword name="{esc(k)}" value="{esc(v)}" comment=""/>' for k, v in keywords.items())
    body += "".join(f'<Property id="{esc(k)}" type="String" value="{esc(v)}"/>' for k, v in (properties or {}).items())
    xml = f'<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0"><Image>{body}</Image></xisf>'.encode()
    return SIGNATURE + len(xml).to_bytes(4, "little") + b"\0" * 4 + xml
