"""Header grammars: golden cases, bounds of reading, round trips."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skycatalog.sources import fits, raw, xisf


def header(*cards, end=True):
    lines = ["SIMPLE  =                    T", *cards] + (["END"] if end else [])
    body = "".join(f"{c:<80}" for c in lines).encode("latin-1")
    return body + b" " * (-len(body) % fits.BLOCK)


def code(data):
    return fits.parse_bytes(data).error_code


def test_values():
    h = fits.parse_bytes(header("EXPTIME =                300.0 / s", "GAIN    =                  100", "OBJECT  = 'M 31    '", "NAME    = 'O''Neil'", "FLAG    =                    F", "NONE    =", "NOTE    = / only a comment", "BIG     =             1.5D+03", "COMMENT = not a value", "HIERARCH ESO X = 1", "OBJECT  = 'M 42'"))
    assert h.status == "ok" and h.header_bytes == 2880 and h.card_count == 13
    assert h.keywords == {"SIMPLE": True, "EXPTIME": 300.0, "GAIN": 100.0, "OBJECT": "M 42", "NAME": "O'Neil", "FLAG": False, "NONE": None, "NOTE": None, "BIG": 1500.0}


def test_continue():
    h = fits.parse_bytes(header("LONG    = 'abc&'", "CONTINUE  'def&' / more", "CONTINUE  'ghi'", "OPEN    = 'x&'", "NEXT    = 1"))
    assert h.keywords["LONG"] == "abcdefghi" and h.keywords["OPEN"] == "x&"
    pad = ["COMMENT x"] * 33
    h = fits.parse_bytes(header(*pad, "LONG    = 'abc&'", "CONTINUE  'def'"))  # the chain crosses a block
    assert h.keywords["LONG"] == "abcdef" and h.header_bytes == 5760


@pytest.mark.parametrize(
    "data, expected",
    [
        (header()[:2000], "TRUNCATED_HEADER"),
        (header(end=False), "MISSING_END"),
        (header("exptime = 1"), "INVALID_CARD"),
        (header("EXP TIME= 1"), "INVALID_CARD"),
        (header("EXPTIME = three hundred"), "INVALID_CARD"),
        (header("EXPTIME =                1E999"), "INVALID_CARD"),
        (header("C       = (1,2)"), "INVALID_CARD"),
        (header("A       = 'open"), "INVALID_CARD"),
        (header("A       = 'x' junk"), "INVALID_CARD"),
        (header("A       = 'x&'", "CONTINUE  'open"), "BAD_CONTINUE"),
        (header("A       = 'x'", "CONTINUE  'y'"), "BAD_CONTINUE"),
        (header("A       = 'caf\xe9'"), "INVALID_CARD"),
        (b"", "EMPTY_FILE"),
        (header().replace(b"                   T", b"                   F", 1), "NOT_FITS"),
        (b"\xff" + header()[1:], "NOT_FITS"),
        (fits.corrupt(header()), "TRUNCATED_HEADER"),
    ],
)
def test_malformed(data, expected):
    assert code(data) == expected


def test_bytes_after_end_do_not_count():
    data = bytearray(header())
    data[200] = 0xFF
    assert fits.parse_bytes(bytes(data)).status == "ok"


def test_reads_no_further_than_the_header():
    data, seen = header(*["COMMENT x"] * 40) + b"D" * 100_000, []

    def read(offset, length):
        seen.append((offset, length))
        return data[offset : offset + length]

    h = fits.parse_header(read)
    assert h.header_bytes == 5760 and seen == [(0, 2880), (2880, 2880)]
    assert fits.header_end(data) == 5760 and fits.header_end(b" " * 800) is None
    assert fits.parse_header(lambda o, n: header(end=False) if o == 0 else b"COMMENT ".ljust(80) * 36).error_code == "MISSING_END"  # bounded


VALUE = st.one_of(st.booleans(), st.none(), st.integers(-(10**9), 10**9), st.floats(-1e6, 1e6).map(lambda x: round(x, 4)), st.text(st.characters(min_codepoint=32, max_codepoint=126, exclude_characters="&"), max_size=200).map(str.rstrip))


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.from_regex(r"[A-Z][A-Z0-9_-]{0,7}", fullmatch=True).filter(lambda k: k not in ("SIMPLE", "END", "COMMENT", "HISTORY", "CONTINUE")), VALUE, max_size=30))
def test_fits_round_trip(cards):
    h = fits.parse_bytes(fits.write_header(list(cards.items())))
    assert h.status == "ok", h.error_message
    got = {k: v for k, v in h.keywords.items() if k != "SIMPLE"}
    assert got == {k: float(v) if isinstance(v, int) and not isinstance(v, bool) else v for k, v in cards.items()}


def test_xisf():
    h = xisf.parse_bytes(xisf.write_header({"OBJECT": "M 31 <&\"", "EXPTIME": "300"}, {"Observation:Object:Name": "M 31"}) + b"DATA")
    assert h.keywords == {"OBJECT": 'M 31 <&"', "EXPTIME": "300"} and h.properties == {"Observation:Object:Name": "M 31"}
    unit = lambda xml: xisf.SIGNATURE + len(xml).to_bytes(4, "little") + b"\0" * 4 + xml
    err = lambda data: xisf.parse_bytes(data).error_code
    assert err(b"") == "EMPTY_FILE" and err(b"XISF") == "TRUNCATED_HEADER" and err(b"XISF0101" + b"\0" * 8) == "BAD_SIGNATURE" and err(b"XISF0100\0\0") == "TRUNCATED_HEADER"
    assert err(xisf.SIGNATURE + (1 << 30).to_bytes(4, "little") + b"\0" * 4) == "TRUNCATED_HEADER"
    assert err(unit(b"<xisf><a></xisf>")) == "MALFORMED_XML" and err(unit(b"<xisf a=1/>")) == "MALFORMED_XML" and err(unit(b"<xisf")) == "MALFORMED_XML"
    ok = xisf.parse_bytes(unit(b'<?xml version="1.0"?><!DOCTYPE x><!-- <a> --><xisf><b t="a > b"/><FITSKeyword name="K" value="&#65;&#x42;"/></xisf>'))
    assert ok.status == "ok" and ok.keywords == {"K": "AB"}


def test_raw():
    tags = {"Make": "Canon", "Model": "Canon EOS 6D", "ExposureTime": 0.005, "ISO": 800, "DateTimeOriginal": "2026:04:05 22:11:03", "OffsetTimeOriginal": "+02:00"}
    data = raw.write_tiff(tags)
    h = raw.parse_bytes(data)
    assert h.status == "ok" and h.tags == tags
    assert raw.parse_bytes(b"").error_code == "EMPTY_FILE" and raw.parse_bytes(b"garbage!" * 10).error_code == "UNRECOGNIZED_RAW" and raw.parse_bytes(data[:60]).error_code == "TRUNCATED_HEADER"
    box = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
    cr3 = box(b"ftyp", b"crx " + b"\0" * 8) + box(b"moov", box(b"uuid", raw.CANON_UUID + box(b"CMT1", data) + box(b"CMTX", b"")))
    assert raw.looks_like_cr3(cr3) and raw.parse_bytes(cr3).tags["ISO"] == 800
    assert raw.parse_bytes(box(b"ftyp", b"crx ")).tags == {}
