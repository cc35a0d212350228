"""The PDF decoder and landed pages on awkward input."""

import zlib

from strandline.sources import pdf, readers


def document(content: bytes, packed: bool = False, extra: bytes = b"") -> bytes:
    """A file of one page; its page objects in an object stream if `packed`."""
    body = zlib.compress(content)
    stream = b"5 0 obj<</Filter /FlateDecode /Length %d>>stream\n%s\nendstream endobj\n" % (len(body), body)
    objects = [(1, b"<</Type /Catalog /Pages 2 0 R>>"), (2, b"<</Type/Pages/Kids[3 0 R]>>"), (3, b"<</Type/Page/Parent 2 0 R/Contents 5 0 R>>")]
    if not packed:
        return b"%PDF-1.4\n" + b"".join(b"%d 0 obj%s endobj\n" % o for o in objects) + stream + extra
    head, data = b"", b""
    for number, o in objects:
        head += b"%d %d " % (number, len(data))
        data += o + b" "
    inner = zlib.compress(head + data)
    return b"%%PDF-1.5\n9 0 obj<</Type /ObjStm /N 3 /First %d /Filter /FlateDecode>>stream\n%s\nendstream endobj\n" % (len(head), inner) + stream + extra


CONTENT = rb"BT 0 700 Td (One \(two\) \101) Tj 0 -12 Td [(wi) 30 (de) -400 (gap)] TJ T* <48 69> Tj (esc\n\\) ' ET"


def test_pdf_text():
    want = "One (two) A\nwide gap\nHi\nesc\n\\"
    for packed in (False, True):
        assert pdf.read(document(CONTENT, packed))[1] == [want]
    assert pdf.read(document(CONTENT, extra=b"8 0 obj<</Title <FEFF00C900740065>>>endobj"))[0] == "Éte"


def test_pdf_that_is_none():
    assert pdf.read(b"") == ("", []) and pdf.read(b"hello") == ("", []) and pdf.read(document(CONTENT, extra=b"/Encrypt 1 0 R")) == ("", [])
    broken = document(CONTENT)
    assert pdf.read(broken[: len(broken) // 2])[1] in ([], [""])
    loop = b"%PDF-1.4\n1 0 obj<</Type /Catalog /Pages 2 0 R>>endobj 2 0 obj<</Type /Pages /Kids [2 0 R]>>endobj"
    assert pdf.read(loop) == ("", [])


def test_pdf_pages(spark):
    rows = [("a.pdf", document(CONTENT)), ("b.txt", b"no"), ("c.pdf", None)]
    got = readers.pdf_pages(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [(r.path, r.page, r.text.split("\n")[0]) for r in got] == [("a.pdf", 0, "One (two) A")]


def test_landed_pages(spark):
    pages = spark.createDataFrame([("http://a/x#1", "<p>hi</p>"), ("http://a/y", "z" * 50)], "url string, html string")
    wanted = spark.createDataFrame([("http://a/x#2",), ("http://a/y",), ("http://a/none",), (None,)], "url string")
    got = {r.url: (r.html, r.text) for r in readers.landed_pages(wanted, pages, most=10).collect()}
    assert got == {"http://a/x#2": ("<p>hi</p>", "hi"), "http://a/y": ("z" * 10, "z" * 10), "http://a/none": (None, None), None: (None, None)}
