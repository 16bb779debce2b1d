"""Camera RAW headers: TIFF directories, or the TIFF blocks inside a CR3 box tree; only a bounded prefix is read.

Outcomes: 'ok' (fields may be NULL), or EMPTY_FILE, TRUNCATED_HEADER, UNRECOGNIZED_RAW.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

from skycatalog.sources.fits import HeaderError

PREFIX = 1 << 20
# The tags that are read, and the one that points to the EXIF directory.
TAGS = {271: "Make", 272: "Model", 33434: "ExposureTime", 34855: "ISO", 36867: "DateTimeOriginal", 36881: "OffsetTimeOriginal"}
EXIF_POINTER = 34665
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
CANON_UUID = bytes.fromhex("85c0b687820f11e08111f4ce462b6a48")
MAX_DIRECTORIES = 32


@dataclass
class RawHeader:
    status: str = "ok"
    error_code: str | None = None
    error_message: str | None = None
    tags: dict[str, object] = field(default_factory=dict)


def _take(data: bytes, at: int, n: int) -> bytes:
    if at < 0 or at + n > len(data):
        raise HeaderError("TRUNCATED_HEADER", "tag beyond the bytes read")
    return data[at : at + n]


def _tag_value(data: bytes, order: str, kind: int, count: int, where: int):
    size = SIZES.get(kind, 0) * count
    at = where if size <= 4 else struct.unpack(order + "I", _take(data, where, 4))[0]
    body = _take(data, at, size)
    if kind == 2:
        return body.split(b"\0")[0].decode("latin-1").strip()
    if kind in (5, 10):
        pairs = struct.unpack(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", body)
        values = [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
    elif kind in FORMATS:
        values = list(struct.unpack(f"{order}{count}{FORMATS[kind]}", body))
    else:
        return f"<{count} bytes>"
    values = [None if isinstance(v, float) and not math.isfinite(v) else v for v in values]
    return values[0] if len(values) == 1 else values


def read_tiff(data: bytes) -> dict[str, object]:
    """Known tags of all directories of a TIFF block; the first value of a tag counts."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise HeaderError("UNRECOGNIZED_RAW", "no TIFF byte order")
    _take(data, 0, 8)
    tags: dict[str, object] = {}
    todo, done = [struct.unpack(order + "I", data[4:8])[0]], set()
    while todo and len(done) < MAX_DIRECTORIES:
        at = todo.pop(0)
        if not at or at in done:
            continue
        done.add(at)
        n = struct.unpack(order + "H", _take(data, at, 2))[0]
        for i in range(n):
            tag, kind, count = struct.unpack(order + "HHI", _take(data, at + 2 + 12 * i, 8))
            where = at + 2 + 12 * i + 8
            if tag == EXIF_POINTER:
                todo.append(struct.unpack(order + "I", _take(data, where, 4))[0])
            elif tag in TAGS and TAGS[tag] not in tags:
                tags[TAGS[tag]] = _tag_value(data, order, kind, count, where)
        following = at + 2 + 12 * n
        if following + 4 <= len(data):
            todo.append(struct.unpack(order + "I", data[following : following + 4])[0])
    return tags


def _boxes(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if size < 8:
            return
        yield kind, at + 8, min(at + size, end)
        at += size


def looks_like_cr3(data: bytes) -> bool:
    return data[4:8] == b"ftyp" and data[8:12] == b"crx "


def cr3_tiff_blocks(data: bytes) -> list[bytes]:
    """TIFF blocks in the camera maker's box of the movie box, in their order."""
    out = []
    for kind, a, b in _boxes(data, 0, len(data)):
        if kind != b"moov":
            continue
        for inner, c, d in _boxes(data, a, b):
            if inner == b"uuid" and data[c : c + 16] == CANON_UUID:
                out += [data[e:f] for k, e, f in _boxes(data, c + 16, d) if k[:3] == b"CMT" and k[3:4].isdigit() and k[3:4] != b"0"]
    return out


def parse_bytes(data: bytes) -> RawHeader:
    try:
        if not data:
            raise HeaderError("EMPTY_FILE", "no bytes")
        data = data[:PREFIX]
        tags: dict[str, object] = {}
        if looks_like_cr3(data):
            for block in cr3_tiff_blocks(data):
                tags = {**read_tiff(block), **tags}
        else:
            tags = read_tiff(data)
        return RawHeader(tags=tags)
    except HeaderError as e:
        return RawHeader(status="error", error_code=e.code, error_message=str(e))


def write_tiff(tags: dict[str, object]) -> bytes:
    """A little-endian TIFF with the given tags, EXIF tags in their own directory; for tests and synthetic files."""
    ids = {v: k for k, v in TAGS.items()}
    main = [(ids[k], v) for k, v in tags.items() if ids[k] < 1000]
    exif = [(ids[k], v) for k, v in tags.items() if ids[k] >= 1000]

    def entry(tag: int, v: object) -> tuple[int, int, int, bytes]:
        if isinstance(v, str):
            b = v.encode("latin-1", "replace") + b"\0"
            return tag, 2, len(b), b
        if isinstance(v, float):
            return tag, 5, 1, struct.pack("<II", round(v * 1_000_000), 1_000_000)
        return tag, 4, 1, struct.pack("<I", int(v))

    def directory(entries: list[tuple[int, int, int, bytes]], start: int) -> bytes:
        heap, fields, heap_at = b"", b"", start + 2 + 12 * len(entries) + 4
        for tag, kind, count, body in sorted(entries):
            if len(body) <= 4:
                value = body.ljust(4, b"\0")
            else:
                value = struct.pack("<I", heap_at + len(heap))
                heap += body + b"\0" * (len(body) % 2)
            fields += struct.pack("<HHI", tag, kind, count) + value
        return struct.pack("<H", len(entries)) + fields + struct.pack("<I", 0) + heap

    first = [entry(t, v) for t, v in main]
    size = len(directory([*first, (EXIF_POINTER, 4, 1, b"\0" * 4)], 8))
    head = directory([*first, (EXIF_POINTER, 4, 1, struct.pack("<I", 8 + size))], 8)
    return b"II*\0" + struct.pack("<I", 8) + head + directory([entry(t, v) for t, v in exif], 8 + size)
