"""Structure of raw mails: parts with their places in the text, and decoded running text.  Tolerates truncation."""

from __future__ import annotations

import base64
import html
import quopri
import re
from typing import NamedTuple

BLANK = re.compile(r"\r?\n[ \t]*\r?\n|\A\r?\n")
FIELD = re.compile(r"^(content-type|content-transfer-encoding)[ \t]*:((?:[^\n]*)(?:\n[ \t][^\n]*)*)", re.I | re.M)
BOUNDARY = re.compile(r'boundary[ \t]*=[ \t]*(?:"([^"]+)"|([^\s;]+))', re.I)
HEADER_LINE = re.compile(r"[!-9;-~]+[ \t]*:")


class Part(NamedTuple):
    kind: str
    encoding: str
    charset: str
    start: int
    end: int


def parts(raw: str, start: int = 0, end: int | None = None, depth: int = 0) -> list[Part]:
    """Leaf parts of a mail or of an enclosed one, bodies as offsets into `raw`."""
    end = len(raw) if end is None else end
    if HEADER_LINE.match(raw, start, end):
        m = BLANK.search(raw, start, end)
        head_end, body = (m.start(), m.end()) if m else (end, end)
    else:  # no header fields: an empty line or the body itself comes first
        head_end = start
        body = start + 2 if raw.startswith("\r\n", start) else start + 1 if raw.startswith("\n", start) else start
    kind, encoding, charset, bound = "text/plain", "", "", None
    for f in FIELD.finditer(raw, start, head_end):
        value = f[2].strip()
        if f[1].lower() == "content-type":
            kind = re.split(r"[;\s]", value, maxsplit=1)[0].lower() or kind
            b = BOUNDARY.search(value)
            bound = (b[1] or b[2]) if b else None
            c = re.search(r"charset[ \t]*=[ \t]*\"?([\w\-]+)", value, re.I)
            charset = c[1].lower() if c else ""
        else:
            encoding = value.split(";")[0].strip().lower()
    if kind.startswith("multipart/") and bound and depth < 20:
        found, at = [], None
        for m in re.finditer(rf"^--{re.escape(bound)}(--)?[ \t]*\r?$", raw[body:end], re.M):
            if at is not None:
                found += parts(raw, at, body + m.start(), depth + 1)
            at = None if m[1] else min(end, body + m.end() + 1)
        if at is not None:
            found += parts(raw, at, end, depth + 1)
        return found
    if kind == "message/rfc822" and depth < 20:
        return parts(raw, body, end, depth + 1)
    return [Part(kind, encoding, charset, body, end)]


def decode(raw: str, part: Part) -> str:
    """Body of a part as text, its transfer encoding undone as far as it is intact."""
    body = raw[part.start : part.end]
    if part.encoding not in ("base64", "quoted-printable"):
        return body
    if part.encoding == "base64":
        letters = re.sub(r"[^A-Za-z0-9+/]", "", body)
        letters = letters[: len(letters) - (len(letters) % 4 == 1)]  # a lone letter is cut off text
        data = base64.b64decode(letters + "=" * (-len(letters) % 4))
    else:
        data = quopri.decodestring(body.encode("utf-8", "replace"))
    try:
        return data.decode(part.charset or "utf-8")
    except (LookupError, UnicodeDecodeError):
        return data.decode("utf-8", "replace")


ENCODED = re.compile(r"^content-transfer-encoding[ \t]*:[ \t]*(?:base64|quoted-printable)", re.I | re.M)
INLINE = re.compile(r"</?(?:a|b|i|u|em|strong|span|font|small|big|code|mark|s|sub|sup|wbr)(?:\s[^<>]*)?/?>", re.I)
TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*|!--.*?--)>", re.S)


def running_text(raw: str) -> str:
    """The whole mail with transfer-encoded text parts decoded and markup taken out."""
    text = raw
    if ENCODED.search(raw):
        pieces, at = [], 0
        for p in parts(raw):
            if p.encoding in ("base64", "quoted-printable"):
                pieces.append(raw[at : p.start])
                pieces.append(decode(raw, p) if p.kind.startswith("text/") else " ")
                at = p.end
        pieces.append(raw[at:])
        text = "\n".join(pieces)
    if "</" in text or "<br" in text:
        text = TAG.sub(" ", INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    return text
