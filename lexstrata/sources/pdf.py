"""Text of PDF files: the literal strings of the file and of its inflated streams."""

from __future__ import annotations

import re
import zlib

_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}
_ESCAPE = re.compile(r"\\([0-7]{1,3}|.)", re.S)
_PART = re.compile(rb"\\.|[()]", re.S)
_STREAM = re.compile(rb"stream\r?\n?(.*?)endstream", re.S)
#: Bytes before a stream that may hold its dictionary.
DICTIONARY = 400
#: Greatest size of one inflated stream; what is longer isn't read.
INFLATED = 1 << 28


def _plain(literal: bytes) -> str:
    one = lambda m: chr(int(m[1], 8) & 255) if m[1][0] in "01234567" else _ESCAPES.get(m[1], m[1])
    return _ESCAPE.sub(one, literal.decode("latin-1"))


def literals(data: bytes) -> list[str]:
    """Strings in brackets, inner brackets kept, escapes decoded; an open one ends with the data."""
    out, depth, start = [], 0, 0
    for m in _PART.finditer(data):
        mark = m[0]
        if mark == b"(":
            depth += 1
            start = m.end() if depth == 1 else start
        elif mark == b")" and depth:
            depth -= 1
            if not depth:
                out.append(_plain(data[start : m.start()]))
    if depth:
        out.append(_plain(data[start:]))
    return out


def _inflated(data: bytes) -> bytes:
    for bits in (zlib.MAX_WBITS, -zlib.MAX_WBITS):
        try:
            return zlib.decompressobj(bits).decompress(data, INFLATED)
        except zlib.error:
            continue
    return b""


def pdf_text(data: bytes) -> str:
    """One line of text; '' for what isn't a PDF. Strings are taken as Latin-1 unless their bytes are UTF-8."""
    if not data.startswith(b"%PDF"):
        return ""
    found = literals(data)
    for m in _STREAM.finditer(data):
        body = m[1].removesuffix(b"\n").removesuffix(b"\r")
        found += literals(_inflated(body) if b"/Fl" in data[max(0, m.start() - DICTIONARY) : m.start()] else body)
    text = ""
    for t in filter(None, found):
        text += t if not text or text[-1] in " \n" else f" {t}"
    text = re.sub(r"[\x00-\x08\x0b-\x1f]", "", text)
    try:
        text = text.encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        pass
    return re.sub(r"[ \t\n]+", " ", text).strip()
