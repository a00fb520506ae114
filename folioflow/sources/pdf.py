"""PDF files from pages, and pages, text layers and images from PDF files."""

from __future__ import annotations

import hashlib
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.geometry import page_size
from ..functions.text import clean_pdf_text
from ..operators.ocr import glyph_box
from ..operators.pages import kept, lists, tasks
from .pdf_syntax import File

FILES = "doc string, volume long, path string, pages long, bytes long, sha256 string"
LAYER = "array<struct<x:double,y:double,size:double,width:double,text:string>>"
PAGES = "path string, page_no int, width_pt double, height_pt double, view array<double>, items array<struct<transform:array<double>,width:double,height:double,str:string>>, error string"
IMAGES = "path string, page_no int, name string, width int, height int, rgb binary, error string"
#: Objects of a file before its pages: catalogue, page tree, font, its descendant and its character map; and objects of a page.
HEAD, EACH = 5, 3
#: Codes of a font and entries of one block of a character map.
CODES, BLOCK = 65_535, 100
#: Characters and number of the texts whose codes a file on its way holds.
SHORT, TEXTS = 64, 4096


@lru_cache(1 << 16)
def _n(v: float) -> str:
    return str(int(v)) if v == int(v) else f"{v:.12f}".rstrip("0")


class Volume:
    """One file on its way: objects are written as they come, only their offsets and the characters met are held."""

    def __init__(self, files: fs.FileSystem, folder: str, doc: str, volume: int):
        self.files, self.doc, self.volume = files, doc, volume
        self.path = f"{folder}/{file_name(doc, volume)}"
        self.waiting = f"{folder}/_waiting-{uuid.uuid4().hex}"
        self.out, self.at, self.sha, self.where, self.code, self.digits, self.texts, self.pages = files.open_output_stream(self.waiting), 0, hashlib.sha256(), {}, {}, {}, {}, 0
        self._put(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.sha.update(raw)
        self.at += len(raw)

    def _object(self, number: int, head: str, stream: bytes | None = None) -> None:
        self.where[number] = self.at
        body = b"" if stream is None else b"stream\n" + stream + b"\nendstream\n"
        self._put(b"".join((f"{number} 0 obj\n{head}\n".encode(), body, b"endobj\n")))

    def _codes(self, text: str) -> str:
        for c in text:
            if c not in self.code:
                if len(self.code) == CODES:
                    raise ValueError(f"{self.path} has more than {CODES} different characters")
                self.code[c] = len(self.code) + 1
                self.digits[c] = f"{len(self.code):04X}"
        return "".join([self.digits[c] for c in text])

    def _said(self, text: str) -> tuple[float, str]:
        """Advance of a text at size 1 and its codes; those of short texts, which pages repeat, are held."""
        found = self.texts.get(text)
        if found is None:
            found = (500 * len(text) if text.isascii() else sum(map(_width, text))) / 1000, self._codes(text)
            if len(text) <= SHORT and len(self.texts) < TEXTS:
                self.texts[text] = found
        return found

    def page(self, w: float, h: float, image: tuple[int, int, bytes] | None, items: list[dict]) -> None:
        """A page of ``w`` x ``h`` points: an image over all of it and its text, unseen, above that."""
        number, body = HEAD + 1 + EACH * self.pages, []
        if image is not None:
            body.append(f"q {_n(w)} 0 0 {_n(h)} 0 0 cm /I Do Q")
        texts = [i for i in items if i is not None and i["text"]]
        if texts:
            body.append("BT 3 Tr")
            for i in texts:
                size, width, (natural, codes) = i["size"], i["width"], self._said(i["text"])
                natural *= size
                wide = 100.0 if width is None or not natural else 100 * width / natural
                body.append(f"/F {_n(size)} Tf {_n(wide)} Tz 1 0 0 1 {_n(i['x'])} {_n(h - i['y'])} Tm <{codes}> Tj")
            body.append("ET")
        packed = zlib.compress("\n".join(body).encode())
        picture = f"/XObject << /I {number + 2} 0 R >> " if image is not None else ""
        self._object(number, f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {_n(w)} {_n(h)}] /Contents {number + 1} 0 R /Resources << /Font << /F 3 0 R >> {picture}>> >>")
        self._object(number + 1, f"<< /Length {len(packed)} /Filter /FlateDecode >>", packed)
        if image is not None:
            self._object(number + 2, f"<< /Type /XObject /Subtype /Image /Width {image[0]} /Height {image[1]} /ColorSpace /DeviceRGB /BitsPerComponent 8 /Filter /FlateDecode /Length {len(image[2])} >>", image[2])
        self.pages += 1

    def close(self) -> dict:
        """Font, page tree and cross-references; then the file takes its name."""
        entries = [f"<{code:04X}> <{c.encode('utf-16-be', 'surrogatepass').hex().upper()}>" for c, code in self.code.items()]
        blocks = [f"{len(b)} beginbfchar\n" + "\n".join(b) + "\nendbfchar" for b in (entries[i : i + BLOCK] for i in range(0, len(entries), BLOCK))]
        cmap = zlib.compress(("/CIDInit /ProcSet findresource begin 12 dict begin begincmap /CMapName /T def /CMapType 2 def\n1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + "\n".join(blocks) + "\nendcmap end end").encode())
        wide = " ".join(f"{code} [1000]" for c, code in self.code.items() if _width(c) == 1000)
        self._object(1, "<< /Type /Catalog /Pages 2 0 R >>")
        self._object(2, f"<< /Type /Pages /Count {self.pages} /Kids [" + " ".join(f"{HEAD + 1 + EACH * i} 0 R" for i in range(self.pages)) + "] >>")
        self._object(3, "<< /Type /Font /Subtype /Type0 /BaseFont /TextLayer /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>")
        self._object(4, f"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /TextLayer /CIDSystemInfo << /Registry (Adobe) /Ordering (Identity) /Supplement 0 >> /DW 500 /W [{wide}] >>")
        self._object(5, f"<< /Length {len(cmap)} /Filter /FlateDecode >>", cmap)
        start, size = self.at, HEAD + 1 + EACH * self.pages
        self._put(f"xref\n0 {size}\n".encode())
        self._put(b"".join(b"%010d 00000 n \n" % self.where[n] if n in self.where else b"0000000000 65535 f \n" for n in range(size)))
        self._put(f"trailer\n<< /Size {size} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())
        self.out.close()
        if self.files.get_file_info(self.path).type != fs.FileType.NotFound:  # of an earlier attempt at the same pages
            self.files.delete_file(self.path)
        self.files.move(self.waiting, self.path)
        return {"doc": self.doc, "volume": self.volume, "path": self.path, "pages": self.pages, "bytes": self.at, "sha256": self.sha.hexdigest()}


def file_name(doc: str, volume: int) -> str:
    """Different for different PDFs and volumes, and never one that readers take for hidden; a plus sign stands in no quoted name."""
    name = quote(doc, safe="")
    if name[:1] in ("_", ".", ""):
        name = f"+{name}"
    if len(name) > 180:
        name = f"+{hashlib.sha256(doc.encode()).hexdigest()}"
    return f"{name}.pdf" if volume == 0 else f"{name}+{volume + 1}.pdf"


def _width(c: str) -> int:
    """Thousandths of the size that a character of the text layer takes."""
    return 1000 if unicodedata.east_asian_width(c) in "WF" else 500


def write_pdfs(pages: DataFrame, folder: str, scale: float | None = None, most: int = 500) -> DataFrame:
    """Pages as PDF files under ``folder`` (which all executors share); a row for each file: ``FILES``.

    ``pages``: ``doc`` (one of its values is one PDF), ``page_no`` (from 1), ``width_pt`` and ``height_pt`` or null, ``width``,
    ``height`` and ``rgb`` of the page's image or null, and ``items``: pieces of text (``LAYER``, x and y of the start of the
    baseline from the top left corner, an advance or null for the font's own). Sizes are as given, else pixels by ``scale``,
    else pixels at 72 dpi. Images are kept without loss; text is a layer that can be searched but is not painted, since no font is at hand.

    Images are compressed where the pages lie; then each file is written by one task, page by page, in the order of
    ``page_no``, so a task holds a page and the offsets of a file. A PDF of more than ``most`` pages goes on in further volumes, cut by page
    number, so that one large PDF is many tasks. A file gets its name when it is whole; a repeated task writes the same
    bytes again. A null ``doc`` is named ``null``, null page numbers come first; pages of one number are ordered by their
    contents; an empty table writes nothing. Pages without any size are an error.
    """
    number = lambda c: F.col(c).cast("double")
    size = page_size(number("width"), number("height"), number("width_pt"), number("height_pt"), F.lit(scale).cast("double"))
    slim = pages.select(
        F.coalesce(F.col("doc").cast("string"), F.lit("null")).alias("doc"), F.coalesce(F.col("page_no"), F.lit(0)).cast("long").alias("page_no"),
        size["w_pt"].alias("w"), size["h_pt"].alias("h"), "width", "height", "rgb", F.coalesce(F.col("items").cast(LAYER), F.array().cast(LAYER)).alias("items"),
    )
    shape = f"doc string, page_no long, w double, h double, width int, height int, packed binary, items {LAYER}"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            small = []
            for rgb, w, h in zip(*(b.column(c) for c in ("rgb", "width", "height")), strict=True):
                pixels = rgb.as_buffer()
                if len(pixels) != 3 * w.as_py() * h.as_py():
                    raise ValueError("an image has not three bytes a pixel")
                small.append(zlib.compress(pixels))
            named = dict(zip(b.schema.names, b.columns, strict=True)) | {"rgb": pa.array(small, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(named.values()), names=["packed" if c == "rgb" else c for c in named])

    images = slim.where("rgb IS NOT NULL").mapInArrow(packed, shape)
    bare = slim.where("rgb IS NULL").select("doc", "page_no", "w", "h", "width", "height", F.lit(None).cast("binary").alias("packed"), "items")
    volumes = images.unionByName(bare).withColumn("volume", F.greatest(F.floor((F.col("page_no") - 1) / most), F.lit(0)).cast("long"))
    spark, made = pages.sparkSession, _arrow(FILES)
    ordered = volumes.repartition(tasks(spark), "doc", "volume").sortWithinPartitions("doc", "volume", "page_no", F.md5("packed"), F.hash("items"), "w", "h")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = path = out = None
        done = []
        for b in batches:
            for r in _rows(b):
                if where is None:
                    where, path = fs.FileSystem.from_uri(folder)
                    where.create_dir(path, recursive=True)
                if out is None or (out.doc, out.volume) != (r["doc"], r["volume"]):
                    done += [out.close()] if out is not None else []
                    out = Volume(where, path, r["doc"], r["volume"])
                if not (r["w"] and r["h"] and r["w"] > 0 and r["h"] > 0):
                    raise ValueError(f"page {r['page_no']} of {r['doc']} has no size")
                out.page(r["w"], r["h"], None if r["packed"] is None else (r["width"], r["height"], r["packed"]), r["items"])
        done += [out.close()] if out is not None else []
        yield pa.RecordBatch.from_pylist(done, schema=made)

    return kept(ordered.mapInArrow(files, FILES))


def _opened(spark: SparkSession, path: str, files: DataFrame | None) -> DataFrame:
    if files is not None:
        return files.select("path").repartition(tasks(spark), "path")
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_pdfs(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """Pages of all PDF files under ``path`` with their text layers: ``PAGES``.

    ``files`` (``path``, as ``write_pdfs`` gives it) names those to read: tasks open them, so the driver lists no folder and small
    files share a task.

    Sizes and ``view`` (user space to points from the top left corner) count a page's crop and rotation. An item is what one
    operator shows, with its matrix, advance and height. A task holds one file and gives its pages one by one. A file that cannot be
    read is one row without a page number, a page whose contents cannot be read a page without items, and both say their ``error``. Spark passes over files of no bytes.
    """

    schema = _arrow(PAGES)

    def layer(file: File, page: dict) -> tuple:
        return *file.frame(page), list(file.text(page))

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for name, raw in _files(batches, path) for row in _guarded(name, raw, layer, 4))
        yield from _layers(rows, schema, 5_000)

    return _opened(spark, path, files).mapInArrow(pages, PAGES)


def read_pdf_images(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """Images of the pages of all PDF files under ``path``, or of ``files`` there (``IMAGES``): those of 8 bits a channel stored without loss; others are an ``error``."""

    schema = _arrow(IMAGES)

    def found(name: str, raw: bytes) -> Iterator[tuple]:
        for path, no, held, error in _guarded(name, raw, lambda file, page: (list(file.images(page)),), 1):
            yield from ((path, no, *i, None) for i in held or ())
            if error:
                yield path, no, None, None, None, None, error

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for name, raw in _files(batches, path) for row in found(name, raw))
        yield from _held(rows, schema, lambda row: len(row[5] or b"") + 100, 8 << 20)

    return _opened(spark, path, files).mapInArrow(images, IMAGES)


def _files(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[tuple[str, bytes]]:
    for b in batches:
        if "content" not in b.schema.names:
            where, _ = fs.FileSystem.from_uri(folder)
            for name in b.column("path").to_pylist():
                with where.open_input_stream(name) as file:
                    yield name, file.read()
            continue
        for name, raw in zip(b.column("path"), b.column("content"), strict=True):
            yield name.as_py(), raw.as_py()


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    """Rows of ``write_pdfs``' pages, whose items are taken out of their columns at once."""
    flat, starts = b["items"].flatten(), np.cumsum(b["items"].value_lengths().to_numpy(zero_copy_only=False)).tolist()
    names = [f.name for f in flat.type]
    items = [dict(zip(names, i)) for i in zip(*(lists(flat.field(k)) for k in range(len(names))), strict=True)]
    if flat.null_count:
        items = [i if known else None for i, known in zip(items, flat.is_valid().to_pylist(), strict=True)]
    rest = [c for c in b.schema.names if c != "items"]
    for start, end, *row in zip([0, *starts[:-1]], starts, *(lists(b[c]) for c in rest), strict=True):
        yield dict(zip(rest, row)) | {"items": items[start:end]}


def _layers(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of ``PAGES`` in batches of about ``most`` items, as columns; a page's items are tuples."""
    kind = schema.field("items").type
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        path, no, w, h, view, items, error = zip(*held, strict=True)
        flat = [i for of in items if of is not None for i in of]
        transform, *others = zip(*flat, strict=True) if flat else [()] * 4
        turns = pa.array([v for t in transform for v in t], pa.float64())
        fields = [pa.ListArray.from_arrays(pa.array(range(0, 6 * len(flat) + 1, 6), pa.int32()), turns, type=kind.value_type[0].type)]
        fields += [pa.array(c, f.type) for c, f in zip(others, list(kind.value_type)[1:], strict=True)]
        ends = np.cumsum([0, *(len(i or ()) for i in items)])
        mask = pa.array([i is None for i in items])
        listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)), type=kind, mask=mask)
        return pa.RecordBatch.from_arrays([listed if f.name == "items" else pa.array(c, f.type) for f, c in zip(schema, (path, no, w, h, view, items, error), strict=True)], schema=schema)

    total = 0
    for row in rows:
        held.append(row)
        total += 1 + len(row[5] or ())
        if total >= most:
            yield batch()
            held, total = [], 0
    if held:
        yield batch()


def _held(rows: Iterator[tuple], schema: pa.Schema, size, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows of together about ``most`` by ``size``."""
    held, total = [], 0
    for row in rows:
        held.append(dict(zip(schema.names, row, strict=True)))
        total += size(row)
        if total >= most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _guarded(name: str, raw: bytes, work, n: int) -> Iterator[tuple]:
    """Path, page number, the ``n`` results of ``work`` and the error of each page of a file."""
    try:
        file = File(raw)
        pages = file.pages()
    except Exception as e:  # whatever is wrong with a stranger's file belongs into its row
        yield name, None, *[None] * n, f"{type(e).__name__}: {e}"
        return
    no = 0
    while True:
        try:
            page = next(pages)
        except StopIteration:
            return
        except Exception as e:
            yield name, None, *[None] * n, f"{type(e).__name__}: {e}"
            return
        no += 1
        try:
            yield name, no, *work(file, page), None
        except Exception as e:
            yield name, no, *[None] * n, f"{type(e).__name__}: {e}"


def text_layer(pages: DataFrame, digits: int = 6) -> DataFrame:
    """The items of ``read_pdfs`` as boxes from the top left corner, with all other columns of the pages and their place ``no``.

    Advances are rounded to ``digits`` places, as files hold them as decimal factors.
    """
    rest = [c for c in pages.columns if c not in ("items", "view", "error")]
    each = pages.where("items IS NOT NULL").select(*rest, "view", F.posexplode("items").alias("no", "i"))
    boxes = glyph_box(F.col("view"), F.col("i.transform"), F.round("i.width", digits), F.col("i.height"), F.col("i.str"))
    return each.select(*rest, (F.col("no") + 1).alias("no"), *[c.alias(k) for k, c in boxes.items()]).where(clean_pdf_text(F.col("raw")) != "")
