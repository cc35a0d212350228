"""Text of PDF files: a small decoder for what papers mostly are. It reads plain and compressed objects (object streams
too), pages in tree order, Flate streams, literal and hexadecimal strings, and simple one-byte fonts, as Latin-1. It does
not read encrypted files, scanned pages, or fonts with their own code tables."""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream|stream\r?\n(.*?)endstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|[^\s\[\]()<>]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _stream(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    raw = found[1] if found[1] is not None else found[2]
    if b"/FlateDecode" not in body[: found.start()]:
        return raw
    try:
        return zlib.decompressobj().decompress(raw)
    except zlib.error:
        return b""


def _objects(raw: bytes) -> dict[int, bytes]:
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(raw)}
    for body in list(found.values()):
        first = re.search(rb"/First\s+(\d+)", body)
        if b"/ObjStm" in body and first:
            data, start = _stream(body), int(first[1])
            numbers = [int(x) for x in re.findall(rb"\d+", data[:start])]
            places = [*numbers[1::2], len(data) - start]
            for k, number in enumerate(numbers[::2]):
                found.setdefault(number, data[start + places[k] : start + places[k + 1]])
    return found


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        raw = re.sub(rb"\\([nrtbf])", lambda m: _ESCAPES[m[1]], token[1:-1])
        raw = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), raw)
        raw = re.sub(rb"\\(\r\n|\r|\n)", b"", raw)
        raw = re.sub(rb"\\(.)", rb"\1", raw, flags=re.S)
    return raw.decode("utf-16-be" if raw[:2] == b"\xfe\xff" else "latin-1", "ignore").lstrip("\ufeff")


def _text(content: bytes) -> str:
    """Text of a page's operators: strings in order, a new line where the position moves down."""
    out, strings, numbers = [], [], []
    for m in _TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"(<":
            strings.append(_string(token))
        elif re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            numbers.append(float(token))
            if strings and numbers[-1] < -200:  # inside a TJ array, a wide gap is a space
                strings.append(" ")
        elif token not in (b"[", b"]"):
            if token in (b"'", b'"', b"T*") or token in (b"Td", b"TD") and numbers and numbers[-1] != 0 or token == b"ET":
                out.append("\n")
            if token in (b"Tj", b"TJ", b"'", b'"'):
                out.append("".join(strings))
            strings, numbers = [], []
    lines = (re.sub(r"[ \t]+", " ", x).strip() for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def _references(body: bytes, name: bytes) -> list[int]:
    one = re.search(rb"/" + name + rb"\s+(\d+)\s+\d+\s+R", body)
    many = re.search(rb"/" + name + rb"\s*\[([^\]]*)\]", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", many[1])] if many else [int(one[1])] if one else []


def read(raw: bytes) -> tuple[str, list[str]]:
    """The title that the file names and the text of each page; nothing for what is no PDF."""
    if b"%PDF-" not in raw[:1024] or b"/Encrypt" in raw:
        return "", []
    objects = _objects(raw)
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
    pages, stack, seen = [], _references(root, b"Pages")[::-1], set()
    while stack:
        number = stack.pop()
        body = objects.get(number, b"")
        if number in seen:
            continue
        seen.add(number)
        kids = _references(body, b"Kids")
        if kids:
            stack += kids[::-1]
        elif re.search(rb"/Type\s*/Page\b", body):
            pages.append(_text(b"\n".join(_stream(objects.get(k, b"")) for k in _references(body, b"Contents"))))
    title = re.search(rb"/Title\s*(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)", b"\n".join(objects.values()))
    return _string(title[1]) if title else "", pages
