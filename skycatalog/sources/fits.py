"""FITS headers: a bounded reader, and a writer for tests and synthetic files.

The reader takes blocks of 36 cards until END and never reads data.  Outcomes: 'ok', or one of EMPTY_FILE, NOT_FITS, INVALID_CARD,
BAD_CONTINUE, TRUNCATED_HEADER, MISSING_END.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

BLOCK, CARD, MAX_BLOCKS = 2880, 80, 1000
KEYWORD = re.compile(r"[A-Z0-9_-]*\Z")
NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[EeDd][+-]?\d+)?\Z")
TAIL = re.compile(r"\s*(?:/.*)?\Z", re.S)
COMMENTARY = ("COMMENT", "HISTORY", "")

Read = Callable[[int, int], bytes]
Value = str | float | bool | None


class HeaderError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Header:
    status: str = "ok"
    error_code: str | None = None
    error_message: str | None = None
    keywords: dict[str, Value] = field(default_factory=dict)
    card_count: int = 0
    header_bytes: int = 0


def _string(text: str, code: str) -> tuple[str, str]:
    """(value with doubled quotes resolved, what follows the closing quote) of text that starts with a quote."""
    out, i = [], 1
    while True:
        j = text.find("'", i)
        if j < 0:
            raise HeaderError(code, "string without closing quote")
        out.append(text[i:j])
        if text.startswith("''", j):
            out.append("'")
            i = j + 2
            continue
        return "".join(out), text[j + 1 :]


def _value(text: str) -> tuple[Value, bool]:
    """(value, string ends with the continuation mark) of a value field."""
    t = text.lstrip(" ")
    if not t or t.startswith("/"):
        return None, False
    if t.startswith("'"):
        s, rest = _string(t, "INVALID_CARD")
        if not TAIL.match(rest):
            raise HeaderError("INVALID_CARD", "text after the closing quote")
        return (s, True) if s.endswith("&") else (s.rstrip(" "), False)
    token = t.split("/", 1)[0].strip()
    if token in ("T", "F"):
        return token == "T", False
    if NUMBER.match(token):
        number = float(re.sub("[Dd]", "E", token, count=1))
        if not math.isfinite(number):
            raise HeaderError("INVALID_CARD", f"number out of range: {token[:20]}")
        return number, False
    raise HeaderError("INVALID_CARD", f"no FITS value: {token[:20]}")


class _Scanner:
    """Keyword map built card by card; an open string waits for its continuation."""

    def __init__(self) -> None:
        self.keywords: dict[str, Value] = {}
        self.cards = 0
        self.open: tuple[str, str] | None = None

    def card(self, raw: bytes) -> bool:
        """Takes one card; True at END."""
        first = self.cards == 0
        if any(b < 0x20 or b > 0x7E for b in raw):
            raise HeaderError("NOT_FITS" if first else "INVALID_CARD", "byte outside printable ASCII")
        text = raw.decode("ascii")
        name = text[:8].rstrip(" ")
        if first:
            if name != "SIMPLE" or text[8:10] != "= " or text[10:].split("/", 1)[0].strip() != "T":
                raise HeaderError("NOT_FITS", "first card is not SIMPLE = T")
        self.cards += 1
        if name == "CONTINUE" and text[8:10] != "= ":
            self._go_on(text[8:])
            return False
        self._close()
        if name == "END":
            return True
        if not KEYWORD.match(name):
            raise HeaderError("INVALID_CARD", f"bad keyword: {name}")
        if name in COMMENTARY or text[8:10] != "= ":
            return False
        value, more = _value(text[10:])
        if more:
            self.open = (name, value)
        else:
            self.keywords.pop(name, None)
            self.keywords[name] = value
        return False

    def _go_on(self, text: str) -> None:
        if self.open is None:
            raise HeaderError("BAD_CONTINUE", "CONTINUE without an open string")
        t = text.lstrip(" ")
        if not t.startswith("'"):
            raise HeaderError("BAD_CONTINUE", "CONTINUE without a string")
        s, rest = _string(t, "BAD_CONTINUE")
        if not TAIL.match(rest):
            raise HeaderError("BAD_CONTINUE", "text after the closing quote")
        name, so_far = self.open
        joined = so_far[:-1] + s
        if s.endswith("&"):
            self.open = (name, joined)
        else:
            self.open = None
            self.keywords.pop(name, None)
            self.keywords[name] = joined.rstrip(" ")

    def _close(self) -> None:
        """No continuation came: the mark is part of the string."""
        if self.open is not None:
            name, s = self.open
            self.open = None
            self.keywords.pop(name, None)
            self.keywords[name] = s


def parse_header(read: Read) -> Header:
    """Header of a file given as `read(offset, length)`; reads whole blocks up to the one with END and nothing after."""
    scan = _Scanner()
    try:
        for block in range(MAX_BLOCKS):
            chunk = read(block * BLOCK, BLOCK)
            if not chunk:
                raise HeaderError("EMPTY_FILE" if block == 0 else "MISSING_END", "no bytes" if block == 0 else "end of file before END")
            if len(chunk) < BLOCK:
                raise HeaderError("TRUNCATED_HEADER", f"block of {len(chunk)} bytes")
            for at in range(0, BLOCK, CARD):
                if scan.card(chunk[at : at + CARD]):
                    return Header(keywords=scan.keywords, card_count=scan.cards, header_bytes=(block + 1) * BLOCK)
        raise HeaderError("MISSING_END", f"no END in {MAX_BLOCKS} blocks")
    except HeaderError as e:
        return Header(status="error", error_code=e.code, error_message=str(e))


def parse_bytes(data: bytes) -> Header:
    return parse_header(lambda offset, length: data[offset : offset + length])


def header_end(data: bytes, most: int = 512 * 1024) -> int | None:
    """Bytes of the header up to the end of the block of its END card, NULL if there is none within `most`."""
    for at in range(0, min(len(data), most) - 2, CARD):
        if data[at : at + 8].rstrip(b" ") == b"END":
            return -(-(at + CARD) // BLOCK) * BLOCK
    return None


# ---- writer ----------------------------------------------------------------------------------------------------------------

CHUNK = 60


def _text_cards(keyword: str, text: str) -> list[str]:
    quoted = text.replace("'", "''")
    if len(quoted) <= 68:
        return [f"{keyword:<8}= '{quoted:<8}'"]
    pieces, at = [], 0
    while at < len(text):
        pieces.append(text[at : at + CHUNK])
        at += CHUNK
    out = []
    for i, p in enumerate(pieces):
        mark = "&" if i < len(pieces) - 1 else ""
        head = f"{keyword:<8}= " if i == 0 else "CONTINUE  "
        out.append(f"{head}'{p.replace(chr(39), chr(39) * 2)}{mark}'")
    return out


def write_header(cards: list[tuple[str, Value]]) -> bytes:
    """A header with SIMPLE first and END last, padded to whole blocks; long strings are continued."""
    lines = ["SIMPLE  =                    T"]
    for keyword, value in cards:
        if isinstance(value, bool):
            lines.append(f"{keyword:<8}= {'T' if value else 'F':>20}")
        elif value is None:
            lines.append(f"{keyword:<8}= ")
        elif isinstance(value, (int, float)):
            lines.append(f"{keyword:<8}= {value!r:>20}")
        else:
            lines += _text_cards(keyword, value)
    lines.append("END")
    body = "".join(f"{line:<80}"[:80] for line in lines).encode("ascii", "replace")
    return body + b" " * (-len(body) % BLOCK)


def corrupt(data: bytes) -> bytes:
    """A damaged file: cut to 512 bytes, the first eight overwritten."""
    return b"X" * 8 + data[8:512]
