"""Documents from files: text, Word and (where a parser is installed) PDF, batch or stream, and directory listings."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import extension
from marlstone.session import small_batches

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
UNSUPPORTED = "Unsupported file format"
#: Upload rules: media types, and bytes that a file must stay below.
MEDIA_TYPES = ("application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "text/plain")
MOST_BYTES = 10 * 1024 * 1024


def docx_paragraphs(content: bytes) -> list[str]:
    """A Word file's body paragraphs in order, tables left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for p in body.findall(f"{_W}p"):
        parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda _: "\t", f"{_W}br": lambda _: "\n"}
        out.append("".join(parts[e.tag](e) for e in p.iter() if e.tag in parts))
    return out


def docx_text(content: bytes) -> str:
    """Paragraphs that aren't blank, unstripped, one a line."""
    return "\n".join(p for p in docx_paragraphs(content) if p.strip())


def docx_lines(content: bytes) -> str:
    """All paragraphs, blank ones too, each with a line's end."""
    return "".join(p + "\n" for p in docx_paragraphs(content))


def docx_of(paragraphs: list[str]) -> bytes:
    """A minimal Word file of these paragraphs."""
    ElementTree.register_namespace("w", _W[1:-1])
    root = ElementTree.Element(f"{_W}document")
    body = ElementTree.SubElement(root, f"{_W}body")
    for p in paragraphs:
        t = ElementTree.SubElement(ElementTree.SubElement(ElementTree.SubElement(body, f"{_W}p"), f"{_W}r"), f"{_W}t")
        t.text = p
        t.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
    out = io.BytesIO()
    types = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    rels = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", types)
        z.writestr("_rels/.rels", rels)
        z.writestr("word/document.xml", ElementTree.tostring(root, encoding="UTF-8", xml_declaration=True))
    return out.getvalue()


_PDF_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[A-Za-z'\"*]+|\[|\]", re.DOTALL)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")
    plain = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PDF_ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.DOTALL)
    return plain.decode("cp1252", "replace")


def _simple_pdf_pages(content: bytes) -> list[str]:
    """Pages of a PDF of plain or deflated streams and one-byte fonts: each move to another line starts one."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", content, re.DOTALL)}
    if b"/Encrypt" in content or b"/ObjStm" in content or b"/Type0" in content:
        raise ValueError("this PDF needs a PDF parser, and none is installed")

    def kids(number: int) -> Iterator[bytes]:
        body = objects.get(number, b"")
        listed = re.search(rb"/Kids\s*\[(.*?)\]", body, re.DOTALL)
        if listed is None:
            yield body
        for k in re.findall(rb"(\d+)\s+\d+\s+R", listed[1]) if listed else ():
            yield from kids(int(k))

    def text(number: int) -> str:
        stream = re.search(rb"stream\r?\n(.*?)\r?\nendstream", objects[number], re.DOTALL)[1]
        if b"/FlateDecode" in objects[number]:
            stream = zlib.decompressobj().decompress(stream)  # a checksum's last byte may look like a line's end
        lines, held, begun = [""], [], False
        for token in _PDF_TOKEN.findall(stream):
            if token[:1] in b"(<":
                held.append(_pdf_string(token))
            elif token in (b"Tj", b"TJ", b"'", b'"'):
                lines += [""] * (token in (b"'", b'"'))
                lines[-1] += "".join(held)
                held, begun = [], True
            elif begun and token in (b"T*", b"Td", b"TD", b"Tm"):
                lines.append("")
        return "\n".join(lines)

    root = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", content)
    if root is None:
        raise ValueError("no pages")
    return ["".join(text(int(k)) for k in re.findall(rb"(\d+)\s+\d+\s+R", re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)[1])) for page in kids(int(root[1]))]


def pdf_pages(content: bytes) -> list[str]:
    """A PDF's pages, by a PDF parser where one is installed, else those of a simple file."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return _simple_pdf_pages(content)
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def pdf_of(pages: list[str]) -> bytes:
    """A minimal PDF of these pages, each of lines in a one-byte font."""
    said = lambda line: line.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r")
    streams = [zlib.compress(b"BT /F1 10 Tf 50 800 Td " + b" T* ".join(b"(" + said(x) + b") Tj" for x in page.split("\n")) + b" ET") for page in pages]
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * k) for k in range(len(pages))) + b"] /Count %d >>" % len(pages), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for k, stream in enumerate(streams):
        objects.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * k))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream")
    out, places = io.BytesIO(b"%PDF-1.4\n"), []
    out.seek(0, io.SEEK_END)
    for k, body in enumerate(objects, 1):
        places.append(out.tell())
        out.write(b"%d 0 obj\n" % k + body + b"\nendobj\n")
    start = out.tell()
    out.write(b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places))
    out.write(b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))
    return out.getvalue()


def _text(content: bytes) -> list[str]:
    return [content.decode("utf-8")]


#: What reads a file into its units (PDF: pages; others: one), by extension.
LOADERS: dict[str, Callable[[bytes], list[str]]] = {"txt": _text, "pdf": pdf_pages, "docx": lambda c: [docx_text(c)], "doc": lambda c: [docx_text(c)]}


def listing(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Files below path, with content; the columns Spark's binaryFile has."""
    reader = (spark.readStream if stream else spark.read).format("binaryFile").option("recursiveFileLookup", "true")
    if stream:
        reader = reader.schema("path string, modificationTime timestamp, length bigint, content binary")
    return reader.load(path)


#: Fixed value: what a review says of a Word file without text.
EMPTY = "文档内容为空"
#: Columns of what a file is read into.
UNITS = ("path", "filename", "file_type", "page", "content", "status", "error", "upload_time")
#: Characters of units that a task hands back at once, and one unit at least.
CHARS = 1 << 20


def load(files: DataFrame, loaders: dict[str, Callable[[bytes], list[str]]] | None = None, need_text: bool = False) -> DataFrame:
    """Units of files (path, content): path, filename, file_type, page (from 0), content, status, error, upload_time (text of the file's time).

    A file of an unknown type or one that can't be read gives one row with status
    'failed'; with need_text, as a review asks, so does one whose units are all blank.
    """
    known = loaders or LOADERS
    named = files.withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("file_type", extension(F.col("filename")))
    stamp = F.col("modificationTime").cast("double").cast("string") if "modificationTime" in files.columns else F.lit(None).cast("string")
    named = named.select("path", "filename", "file_type", "content", stamp.alias("upload_time"))

    def units(path: str | None, name: str | None, kind: str | None, content: bytes | None, at: str | None) -> list[tuple]:
        try:
            if kind not in known:
                raise ValueError(UNSUPPORTED)
            texts = known[kind](content)
            if need_text and not any(t.strip() for t in texts):
                raise ValueError(EMPTY)
            return [(path, name, kind, page, text, "indexed", None, at) for page, text in enumerate(texts)]
        except Exception as e:
            return [(path, name, kind, 0, None, "failed", str(e), at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file's content as Python's own at a time, and few units: the batch that comes in is all that is held besides."""
        shape = pa.schema([(name, pa.int32() if name == "page" else pa.string()) for name in UNITS])
        rows, chars = [], 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                for unit in units(*(x.as_py() for x in row)):
                    rows.append(unit)
                    chars += sum(len(x) for x in unit if isinstance(x, str))
                    if chars >= CHARS:
                        yield pa.RecordBatch.from_arrays(list(map(list, zip(*rows, strict=True))), schema=shape)
                        rows, chars = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays(list(map(list, zip(*rows, strict=True))), schema=shape)

    return small_batches(named).mapInArrow(run, ", ".join(f"{name} {'int' if name == 'page' else 'string'}" for name in UNITS))


def whole_text(units: DataFrame, separator: str = "") -> DataFrame:
    """Each file's pages put together in order."""
    pages = F.array_sort(F.collect_list(F.struct("page", "content")))
    return units.groupBy("path", "filename").agg(F.array_join(F.transform(pages, lambda p: p["content"]), separator).alias("content"))


def directory_sizes(files: DataFrame) -> DataFrame:
    """Files and bytes of every directory (its name, and folder, its whole path), its own files only."""
    parts = F.split("path", "/", -1)
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    sized = files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").cast("bigint").alias("bytes"))
    return sized.select(F.element_at(F.split("folder", "/", -1), -1).alias("directory"), "folder", "files", "bytes")


def uploadable(files: DataFrame, media: str = "media_type", size: str = "length") -> DataFrame:
    return files.where(F.col(media).isin(*MEDIA_TYPES) & (F.col(size) < MOST_BYTES))


def reviewable(files: DataFrame, name: str = "filename") -> DataFrame:
    """Word files, by an ending in lower case."""
    return files.where(F.col(name).endswith(".docx") | F.col(name).endswith(".doc"))
