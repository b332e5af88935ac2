"""Office packages: bounded ZIP containers of XML parts, read to rows of cells, paragraphs and slides.

``spark.read.format("binaryFile")`` gives (path, content); each function works
on such rows in Arrow-batched Python, a package at a time.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from veridelta.operators.documents import shift_formula

MOST_PARTS, PART_BYTES = 5000, 64 << 20
#: Lists of parts of at most so many bytes, which many packages share, are parsed once.
SHARED_BYTES = 4096
#: Rows are handed on so many at a time.
ROWS_AT_ONCE = 10_000
TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}


def _parsed(raw: bytes) -> ET.Element:
    root = ET.fromstring(raw)
    for e in root.iter():
        e.tag = e.tag.rpartition("}")[2]
        if any(k[0] == "{" for k in e.keys()):  # noqa: SIM118 (elements aren't mappings)
            e.attrib = {k.rpartition("}")[2] if k.startswith("{") and not k.endswith("relationships}id") else k: v for k, v in e.attrib.items()}
    return root


#: Trees are read only, so packages can share them.
_parsed_once = lru_cache(maxsize=64)(_parsed)


class Package:
    """Parts of a package by name; too many or too large ones are refused before they are unpacked."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        info = self.zip.infolist()
        if len(info) > MOST_PARTS or any(i.file_size > PART_BYTES for i in info):
            raise ValueError("package too large")
        self.names = [i.filename for i in info]

    def tree(self, name: str, shared: bool = False) -> ET.Element | None:
        """The XML of a part, with bare tag names; None without it. Documents that declare entities are refused. ``shared``: other packages may well have the same."""
        if name not in self.names:
            return None
        raw = self.zip.read(name)
        if b"<!DOCTYPE" in raw[:4096]:
            raise ValueError("document type declarations aren't read")
        return _parsed_once(raw) if shared and len(raw) <= SHARED_BYTES else _parsed(raw)

    def relations(self, part: str) -> dict[str, str]:
        folder, _, base = part.rpartition("/")
        root = self.tree(f"{folder}/_rels/{base}.rels", shared=True)
        return {} if root is None else {e.get("Id"): f"{folder}/{e.get('Target')}" for e in root}


def text_of(e: ET.Element, tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter(tag))


def link(e: ET.Element) -> str | None:
    """The relation that an element names."""
    return next((v for k, v in e.attrib.items() if k.endswith("relationships}id")), None)


def cells(p: Package) -> Iterator[tuple]:
    """sheet, ref, value, formula, is_text, is_error of every cell that holds something; a shared formula is that of the cell that has its text, shifted to where it is used."""
    book = p.tree("xl/workbook.xml", shared=True)
    strings = p.tree("xl/sharedStrings.xml")
    shared = [text_of(e) for e in strings] if strings is not None else []
    for s in book.iter("sheet") if book is not None else ():
        target = p.relations("xl/workbook.xml").get(link(s))
        sheet = p.tree(target) if target else None
        shares = [(c.get("r"), f) for c in (sheet.iter("c") if sheet is not None else ()) if (f := c.find("f")) is not None and f.get("t") == "shared"]
        masters = {f.get("si"): (ref, f.text) for ref, f in reversed(shares) if f.text}  # followers may stand before them
        for c in sheet.iter("c") if sheet is not None else ():
            kind, f, v = c.get("t", "n"), c.find("f"), c.find("v")
            value = text_of(c) if kind == "inlineStr" else (v.text or "") if v is not None else ""
            if kind == "s" and value:
                value = shared[int(value)]
            formula = (f.text or "") if f is not None else ""
            if f is not None and f.get("t") == "shared" and not formula and f.get("si") in masters:
                origin, text = masters[f.get("si")]
                formula = shift_formula(text, origin, c.get("r"))
            if value or formula:
                yield s.get("name"), c.get("r"), value, formula, kind in ("s", "str", "inlineStr"), kind == "e"


def layout(p: Package) -> Iterator[tuple]:
    """sheet, kind and place of what a workbook hides or restricts: hidden sheets, rows and columns, protection, validations."""
    book = p.tree("xl/workbook.xml")
    for s in book.iter("sheet") if book is not None else ():
        name, target = s.get("name"), p.relations("xl/workbook.xml").get(link(s))
        if s.get("state", "visible") != "visible":
            yield name, "hidden_sheet", ""
        sheet = p.tree(target) if target else None
        for e in sheet.iter() if sheet is not None else ():
            if e.tag == "row" and e.get("hidden") in ("1", "true"):
                yield name, "hidden_row", e.get("r")
            elif e.tag == "col" and e.get("hidden") in ("1", "true"):
                yield name, "hidden_column", f"{e.get('min')}:{e.get('max')}"
            elif e.tag == "sheetProtection" and e.get("sheet") in ("1", "true"):
                yield name, "protected", ""
            elif e.tag == "dataValidation":
                yield name, "validation", e.get("sqref", "")


def paragraphs(p: Package) -> Iterator[tuple]:
    """section, pos and text of every paragraph that isn't blank, of the body, headers, footers and notes."""
    for part in sorted(n for n in p.names if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|comments)\.xml", n)):
        section = part[5:-4]
        texts = [text_of(e) for e in p.tree(part).iter("p")]
        yield from ((section, i, t) for i, t in enumerate(x for x in texts if x.strip()))


def slides(p: Package) -> Iterator[tuple]:
    """number, hidden and text of every slide, in the order of the presentation."""
    show = p.tree("ppt/presentation.xml")
    links = p.relations("ppt/presentation.xml")
    for n, e in enumerate(show.iter("sldId") if show is not None else (), 1):
        target = links.get(link(e))
        slide = p.tree(target) if target else None
        if slide is not None:
            yield n, slide.get("show") == "0", "\n".join(t for t in map(text_of, slide.iter("p")) if t.strip())


def parts(p: Package) -> Iterator[tuple]:
    """name and class of every part: macro, external_link, embedded_object or plain."""
    for n in p.names:
        yield n, "macro" if n.endswith("vbaProject.bin") else "external_link" if "/externalLinks/" in n else "embedded_object" if "/embeddings/" in n else "plain"


def nodes(data: bytes) -> Iterator[tuple]:
    """depth, tag and text of the elements of an XML text, in order."""

    def walk(e: ET.Element, depth: int) -> Iterator[tuple]:
        yield depth, e.tag.rpartition("}")[2], (e.text or "").strip()
        for c in e:
            yield from walk(c, depth + 1)

    yield from walk(ET.fromstring(data), 0)


def handed_on(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in Arrow batches of at most ``ROWS_AT_ONCE``."""
    to = pa.schema([(n, TYPES[t]) for n, t in map(str.split, schema.split(", "))])
    while part := list(islice(rows, ROWS_AT_ONCE)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), to, strict=True)], schema=to)


def read(files: DataFrame, what: Callable, schema: str, package: bool = True) -> DataFrame:
    """Rows of ``what`` for each file (path, content); a file that can't be read is one row with its error. Files are taken from a batch one by one."""
    whole, none = f"path string, error string, {schema}", (None,) * len(schema.split(", "))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                path, content = path.as_py(), content.as_py()
                try:
                    rows = [(path, "", *r) for r in what(Package(content) if package else content)]
                except (zipfile.BadZipFile, ValueError, ET.ParseError, KeyError) as e:
                    rows = [(path, type(e).__name__, *none)]
                yield from rows

    return files.select("path", "content").mapInArrow(lambda batches: handed_on(each(batches), whole), whole)


CELLS = "sheet string, ref string, value string, formula string, is_text boolean, is_error boolean"
LAYOUT = "sheet string, kind string, at string"
PARAGRAPHS = "section string, pos long, text string"
SLIDES = "number long, hidden boolean, text string"
PARTS = "name string, class string"
NODES = "depth long, tag string, text string"


def zipped(named: dict[str, str]) -> bytes:
    """A package of text parts, the same bytes each time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, t in named.items():
            z.writestr(zipfile.ZipInfo(n), t)
    return out.getvalue()
