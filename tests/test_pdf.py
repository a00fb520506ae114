"""PDF files: what is printed is read back, and files of other makers are understood or said to be broken."""

import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from folioflow.sources import pdf as P
from folioflow.sources.pdf_syntax import File, Font, Reader

SHAPE = f"doc string, page_no int, width_pt double, height_pt double, width int, height int, rgb binary, items {P.LAYER}"


def made(objects, trailer="/Root 1 0 R", version=b"%PDF-1.4\n"):
    """A file of the given objects with a plain table of cross-references."""
    out, where = bytearray(version), {}
    for n, body in objects.items():
        where[n] = len(out)
        out += b"%d 0 obj\n" % n + (body if isinstance(body, bytes) else body.encode("latin-1")) + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    out += b"xref\n0 %d\n0000000000 65535 f \n" % size
    for n in range(1, size):
        out += b"%010d 00000 n \n" % where[n] if n in where else b"0000000000 00000 f \n"
    return bytes(out) + f"trailer\n<< /Size {size} {trailer} >>\nstartxref\n{start}\n%%EOF".encode()


def stream(data, head=""):
    data = data.encode("latin-1") if isinstance(data, str) else data
    return f"<< /Length {len(data)} {head} >>\nstream\n".encode() + data + b"\nendstream"


def one_page(content, resources="/Font << /F 5 0 R >>", page="", **more):
    font = "<< /Type /Font /Subtype /Type1 /BaseFont /Any /FirstChar 32 /Widths [250 500 500] >>"
    return {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] /Resources << {resources} >> >>",
            3: f"<< /Type /Page /Parent 2 0 R /Contents 4 0 R {page} >>", 4: stream(content), 5: font} | {int(k[1:]): v for k, v in more.items()}


def items(raw):
    f = File(raw)
    return [list(f.text(p)) for p in f.pages()]


def strings(raw):
    return [[i[3] for i in page] for page in items(raw)]


def test_literals_and_names():
    assert Reader(rb"(a\(b\)(c)\053\n\q\
d)").next() == b"a(b)(c)+\nqd"
    assert Reader(b"<48 65 6>").next() == b"He`"
    assert Reader(b"[1 -2.5 /A#20B true null (x) 3 0 R % gone\n << /K [ ] >>]").next() == [1, -2.5, "A B", True, None, b"x", 3, {"K": []}]
    with pytest.raises(ValueError):
        Reader(b"[" * 5000).next()


def test_positions_spacing_and_gaps():
    content = "BT /F 10 Tf 2 Tc 3 Tw 20 50 Td (! \") Tj 0 -12 TD [(!) -300 (\") 100 (!)] TJ T* (!) Tj ET q 2 0 0 2 5 5 cm BT /F 4 Tf 1 0 0 1 1 2 Tm (!) Tj ET Q"
    (a, b, c, d), = items(made(one_page(content)))
    assert a[0] == [10, 0, 0, 10, 20, 50] and a[3] == '! "' and a[1] == pytest.approx(5 + 2 + 2.5 + 2 + 3 + 5 + 2)
    assert b[0][4:] == [20, 38] and b[3] == '! "!' and b[1] == pytest.approx(3 * 7 + 3 - 1)
    assert c[0][4:] == [20, 26]
    assert d[0] == [8, 0, 0, 8, 7, 9] and d[1] == pytest.approx((4 * 0.5 + 2) * 2)


def test_encodings():
    fonts = one_page("BT /F 9 Tf (\x01A\x80) Tj /G 9 Tf <000100020003> Tj ET", "/Font << /F 6 0 R /G 7 0 R >>", o6="<< /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /fi 65 /uni4E2D] >> >>",
                     o7="<< /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [8 0 R] /ToUnicode 9 0 R >>", o8="<< /DW 1000 /W [1 [300] 2 3 400] >>",
                     o9=stream("1 beginbfchar <0001> <D83DDE00> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"))
    assert strings(made(fonts)) == [["/fi中€", "😀ab"]]
    assert items(made(fonts))[0][1][1] == pytest.approx(9 * 1.1)


def test_forms_rings_and_inline_images():
    content = "BI /W 1 /H 1 ID \x00(\xff EI BT /F 9 Tf (a) Tj ET /X Do"
    form = stream("BT /F 9 Tf (in) Tj ET /X Do", "/Subtype /Form /Matrix [1 0 0 1 7 0] /Resources << /Font << /F 5 0 R >> /XObject << /X 6 0 R >> >>")
    said = strings(made(one_page(content, "/Font << /F 5 0 R >> /XObject << /X 6 0 R >>", o6=form)))[0]
    assert said[:2] == ["a", "in"] and set(said[1:]) == {"in"} and len(said) < 60
    ring = one_page("")
    ring[2] = "<< /Type /Pages /Kids [3 0 R 2 0 R] /Count 1 >>"
    assert len(list(File(made(ring)).pages())) == 1


@pytest.mark.parametrize("turn, at, size", [(0, (20, 50), (200, 100)), (90, (50, 20), (100, 200)), (180, (180, 50), (200, 100)), (270, (50, 180), (100, 200)), (-90, (50, 180), (100, 200))])
def test_turned_pages(turn, at, size):
    f = File(made(one_page("", page=f"/Rotate {turn}")))
    w, h, (a, b, c, d, e, g) = f.frame(next(f.pages()))
    assert (w, h) == size and (20 * a + 50 * c + e, 20 * b + 50 * d + g) == at


def test_compressed_objects_and_later_versions():
    base = one_page("BT /F 9 Tf (old) Tj ET")
    inner = [base[n] for n in (1, 2, 3, 5)]
    starts = [sum(len(i) + 1 for i in inner[:k]) for k in range(4)]
    head = " ".join(f"{n} {s}" for n, s in zip((1, 2, 3, 5), starts)) + " "
    out, where = bytearray(b"%PDF-1.5\n"), {}
    for n, body in ((4, base[4]), (7, stream(zlib.compress((head + " ".join(inner)).encode()), f"/Type /ObjStm /N 4 /First {len(head)} /Filter /FlateDecode"))):
        where[n] = len(out)
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    rows = [(0, 0, 0), (2, 7, 0), (2, 7, 1), (2, 7, 2), (1, where[4], 0), (2, 7, 3), (0, 0, 0), (1, where[7], 0), (1, len(out), 0)]
    plain = [bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in rows]
    up = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(r, before)) for r, before in zip(plain, [bytes(4), *plain]))
    start = len(out)
    out += b"8 0 obj\n" + stream(zlib.compress(up), "/Type /XRef /Size 9 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >>") + b"\nendobj\n"
    first = bytes(out) + f"startxref\n{start}\n%%EOF\n".encode()
    assert strings(first) == [["old"]]
    changed = b"4 0 obj\n" + stream("BT /F 9 Tf (new) Tj ET") + b"\nendobj\n"
    second = first + changed + f"xref\n4 1\n{len(first):010d} 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Prev {start} >>\nstartxref\n{len(first) + len(changed)}\n%%EOF".encode()
    assert strings(second) == [["new"]]


def test_broken_references_are_searched():
    raw = made(one_page("BT /F 9 Tf (found) Tj ET"))
    assert strings(raw.replace(b"startxref\n", b"startxref\n9")) == [["found"]]
    assert strings(b"junk before\n" + raw[: raw.index(b"xref\n0")]) == [["found"]]


def test_awkward_files_are_rows(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"not a PDF")
    (tmp_path / "b.pdf").write_bytes(made(one_page(""), "/Root 1 0 R /Encrypt 5 0 R"))
    (tmp_path / "c.PDF").write_bytes(made(one_page("BT /F 9 Tf (fine) Tj ET")))
    bad = one_page("")
    bad[4] = stream("zz", "/Filter /LZWDecode")
    (tmp_path / "d.pdf").write_bytes(made(bad))
    (tmp_path / "e.txt").write_bytes(b"no PDF")
    rows = {os.path.basename(r.path): r for r in P.read_pdfs(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"a.pdf", "b.pdf", "c.PDF", "d.pdf"}
    assert rows["a.pdf"].page_no is None and "catalogue" in rows["a.pdf"].error and "encrypted" in rows["b.pdf"].error
    assert rows["c.PDF"].error is None and rows["c.PDF"].items[0].str == "fine"
    assert rows["d.pdf"].page_no == 1 and "LZWDecode" in rows["d.pdf"].error and rows["d.pdf"].items is None


def test_round_trip(spark, tmp_path):
    text = "Grüße 中文 😀 (a\\b)"
    pixels = bytes(range(200)) * 3
    rows = [(d, n, None if n % 2 else 300.25, None if n % 2 else 99.5, 20, 10, pixels if n % 3 else None, [(1.5, 20.0, 12.0, None, text), (5.0, 6.0, 10.0, 44.0, "x"), (5.0, 6.0, 10.0, 44.0, "")]) for d in ("x", "x+2", "_x", "a/b", "", "é" * 200, None) for n in range(1, 6)]
    rows += [("x", 5, 50.0, 60.0, None, None, None, None), ("x", None, 70.0, 80.0, None, None, None, [])]
    folder = f"file://{tmp_path}/out"
    files = {(r.doc, r.volume): r for r in P.write_pdfs(spark.createDataFrame(rows, SHAPE).withColumn("volume", F.lit("clash")), folder, scale=2.0, most=2).collect()}
    assert sum(r.pages for r in files.values()) == len(rows) and len({r.path for r in files.values()}) == len(files) == 7 * 3
    assert sorted(os.listdir(tmp_path / "out")) == sorted(os.path.basename(r.path) for r in files.values())
    assert all(os.path.getsize(r.path) == r.bytes for r in files.values())
    pages = P.read_pdfs(spark, folder).collect()
    assert len(pages) == len(rows) and not any(r.error for r in pages)
    sizes = {(r.width_pt, r.height_pt) for r in pages}
    assert sizes == {(10.0, 5.0), (300.25, 99.5), (50.0, 60.0), (70.0, 80.0)}
    assert {tuple(i.str for i in r["items"]) for r in pages} == {(text, "x"), ()}
    boxes = P.text_layer(P.read_pdfs(spark, folder)).where("no = 2").select("x", "base_y", "w", "font_height").distinct().collect()
    assert [tuple(b) for b in boxes] == [(5.0, 6.0, 44.0, 10.0)]
    images = P.read_pdf_images(spark, folder).collect()
    assert len(images) == 7 * 4 and all(bytes(i.rgb) == pixels and not i.error for i in images)
    again = {(r.doc, r.volume): r for r in P.write_pdfs(spark.createDataFrame(rows[::-1], SHAPE), folder, scale=2.0, most=2).collect()}
    assert {k: r.sha256 for k, r in again.items()} == {k: r.sha256 for k, r in files.items()}


def test_nothing_and_no_size(spark, tmp_path):
    assert P.write_pdfs(spark.createDataFrame([], SHAPE), f"file://{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="has no size"):
        P.write_pdfs(spark.createDataFrame([("x", 1, None, None, None, None, None, None)], SHAPE), f"file://{tmp_path}/no")
    assert Font(File(made(one_page(""))), {}).width == 500


def test_plain_pages_are_read_in_few_steps(spark, tmp_path, monkeypatch):
    from folioflow.sources import pdf_syntax as X

    items = [{"x": 10.0 * i, "y": 30.0 + 12 * i, "size": 8.0 + i, "width": None if i % 2 else 31.7, "text": t} for i, t in enumerate(("item 3", "字 wide", "𝄞", "plain"))]
    where, folder = P.fs.FileSystem.from_uri(str(tmp_path))
    book = P.Volume(where, folder, "book", 0)
    for k in range(64):
        book.page(600.0 + k, 500.0, None, items)
    raw, steps, step = open(book.close()["path"], "rb").read(), [0], X.Reader.next

    def counted(self, depth=0):
        steps[0] += 1
        return step(self, depth)

    monkeypatch.setattr(X.Reader, "next", counted)
    read = lambda: [(f.frame(p), list(f.text(p))) for f in [X.File(raw)] for p in f.pages()]
    found = read()
    assert steps[0] < 64 * 20
    assert [[i[3] for i in texts] for _, texts in found] == [[i["text"] for i in items]] * 64
    never = re.compile(rb"(?!)")
    monkeypatch.setattr(X, "SHOWN", never)
    monkeypatch.setattr(X, "PAIRS", never)
    monkeypatch.setattr(X, "ENTRY", never)
    assert read() == found  # token by token


@pytest.mark.parametrize("body", [
    b"BT /F 9 Tf 1 0 0 1 5 6 Tm <0001> Tj <0002>Tj ET", b"q 2 0 0 2 1 1 cm BT /F 9 Tf 50 Tz 0 1 -1 0 5 6 Tm <00010002> Tj <0001> Tj ET Q BT <0002> Tj ET",
    b"BT 3 Tw 1 Tc 2 Ts /F 9 Tf .5 0 0 1 5. 6 Tm <00010002> Tj T* <0001> Tj ET", b"BT /G 9 Tf 1 0 0 1 5 6 Tm <0001> Tj /F -4 Tf 1 0 0 1 +5 -6 Tm <00010009> Tj(x)' ET",
    b"BT 1 /F 9 Tf 1 0 0 1 5 6 Tm <0001> Tj % /F 9 Tf 1 0 0 1 5 6 Tm <0001> Tj\n/F 9 Tf 1 0 0 1 7 6 Tm <0001>Tjx /F 9 Tf 1 0 0 1 8 6 Tm <000> Tj ET",
])
def test_plain_text_is_as_token_by_token(tmp_path, monkeypatch, body):
    from folioflow.sources import pdf_syntax as X

    where, folder = P.fs.FileSystem.from_uri(str(tmp_path))
    book = P.Volume(where, folder, "book", 0)
    book.page(600.0, 500.0, None, [{"x": 1.0, "y": 2.0, "size": 3.0, "width": None, "text": "a字"}])
    file = X.File(open(book.close()["path"], "rb").read())
    resources = file.get(next(file.pages())["Resources"])
    read = lambda: list(file._shown(body, resources, [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], 0))
    found = read()
    monkeypatch.setattr(X, "SHOWN", re.compile(rb"(?!)"))
    assert found == read() and found


def test_repeated_texts_are_coded_once(tmp_path, monkeypatch):
    where, folder = P.fs.FileSystem.from_uri(str(tmp_path))
    coded, code = [], P.Volume._codes
    monkeypatch.setattr(P.Volume, "_codes", lambda self, text: (coded.append(text), code(self, text))[1])
    book, texts = P.Volume(where, folder, "book", 0), ["item 1", "字", "x" * 500, "item 1"]
    for _ in range(5):
        book.page(100.0, 100.0, None, [{"x": 1.0, "y": 2.0, "size": 3.0, "width": None, "text": t} for t in texts])
    file = File(open(book.close()["path"], "rb").read())
    assert [[t for *_, t in file.text(p)] for p in file.pages()] == [texts] * 5
    assert coded.count("item 1") == 1 and coded.count("字") == 1
