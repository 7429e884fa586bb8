"""Facts of OOXML documents, read from a binary scan."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from math import ceil
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from procurelake.functions.batches import pieces
from procurelake.operators.rules import FACTS

TEXT = re.compile(r"<w:t(?:\s[^>]*)?>(.*?)</w:t>", re.DOTALL)
GRAPHIC = re.compile(r"<(?:pic:pic|w:drawing|v:shape|w:pict)[\s>/]")
#: Twentieths of a point in a line, twips in a centimetre; pages are estimated from these when nothing tells them.
LINE, TWIPS_CM = 240, 567
DEFAULT_PT, DEFAULT_LINES, CHAR_FACTOR = 14.0, 1.5, 0.92
POINTS_CM = 72 / 2.54


def _number(value: str | None) -> float | None:
    try:
        return float(value) if value is not None else None
    except ValueError:
        return None


def _scaled(value: str | None, by: float) -> float | None:
    n = _number(value)
    return None if n is None else n / by


#: The namespaces of word processing, of both editions of the format.
WORD_URIS = ("http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://purl.oclc.org/ooxml/wordprocessingml/main")


class _Body:
    """Paragraphs, section and marks of a document's main part, by events: what is held is the open paragraphs' facts.

    Elements are told by their namespace, whatever prefix stands for it; parts that declare none by the usual prefix.  A
    paragraph inside another, as in a text box, is one of its own and leaves the outer as it was.  Characters that
    XML writes as entities stay so in texts, as the rules and the page estimate count them.  A part that breaks off
    gives what came before.
    """

    def __init__(self, xml: bytes):
        self.paragraphs: list[dict] = []
        self.open: list[dict] = []
        self.section: dict[str, str] = {}
        self.marks = {"ins": 0, "del": 0, "vanish": 0, "commentReference": 0}
        self.section_depth = 0
        for uris in (True, False):
            if self._read(xml, uris) or self.paragraphs or not uris:
                return

    def _read(self, xml: bytes, uris: bool) -> bool:
        parser = expat.ParserCreate(namespace_separator=" ") if uris else expat.ParserCreate()
        parser.buffer_text = True
        names = {f"{u} ": "" for u in WORD_URIS} if uris else {"w:": ""}

        def local(name: str) -> str | None:
            return next((name[len(n) :] for n in names if name.startswith(n)), None)

        def start(name: str, attributes: dict[str, str]) -> None:
            if tag := local(name):
                self.start(tag, {k: v for key, v in attributes.items() if (k := local(key))})

        parser.StartElementHandler = start
        parser.EndElementHandler = lambda name: (tag := local(name)) and self.end(tag)
        parser.CharacterDataHandler = self.text
        try:
            parser.Parse(xml, True)
        except expat.ExpatError:
            return False
        return True

    def start(self, tag: str, at: dict[str, str]) -> None:
        if tag in self.marks:
            self.marks[tag] += 1
        if tag == "p":
            found = {"index": len(self.paragraphs), "text": [], "style": None, "outline": False, "fonts": [], "sizes": [], "colors": [], "spacing": {}, "ind": {}, "jc": None, "run": None, "head": 0, "in_text": False}
            self.paragraphs.append(found)
            self.open.append(found)
        elif tag == "sectPr":
            self.section, self.section_depth = {}, 1
        elif self.section_depth and tag in ("pgMar", "pgSz"):
            self.section |= {f"{tag}.{k}": v for k, v in at.items()}
        elif self.open:
            p = self.open[-1]
            if tag == "pPr":
                p["head"] += 1
            elif tag == "r":
                p["run"] = set()
            elif tag == "t":
                p["in_text"] = True
            elif p["head"]:
                if tag == "pStyle":
                    p["style"] = at.get("val") if p["style"] is None else p["style"]
                elif tag == "outlineLvl":
                    p["outline"] = True
                elif tag in ("spacing", "ind") and not p[tag]:
                    p[tag] = at
                elif tag == "jc" and p["jc"] is None:
                    p["jc"] = at.get("val")
            elif p["run"] is not None and tag in ("rFonts", "sz", "color") and tag not in p["run"]:
                p["run"].add(tag)
                into, value = {"rFonts": ("fonts", at.get("eastAsia")), "sz": ("sizes", at.get("val")), "color": ("colors", at.get("val"))}[tag]
                if value:
                    p[into].append(value)

    def end(self, tag: str) -> None:
        if tag == "p" and self.open:
            self.open.pop()
        elif tag == "sectPr":
            self.section_depth = 0
        elif self.open:
            p = self.open[-1]
            if tag == "pPr":
                p["head"] -= 1
            elif tag == "r":
                p["run"] = None
            elif tag == "t":
                p["in_text"] = False

    def text(self, data: str) -> None:
        if self.open and self.open[-1]["in_text"]:
            self.open[-1]["text"].append(escape(data))


def _paragraph(p: dict) -> dict:
    """The facts of one paragraph; what isn't set is null."""
    line, rule = _number(p["spacing"].get("line")), p["spacing"].get("lineRule")
    indent = None
    for name, by in (("firstLineChars", 100), ("hangingChars", -100), ("firstLine", LINE), ("hanging", -LINE)):
        if name in p["ind"]:
            indent = _scaled(p["ind"][name], by)
            break
    return {
        "index": p["index"],
        "text": "".join(p["text"]),
        "style": p["style"],
        "is_heading": p["outline"] or bool(re.search("标题|Heading", p["style"] or "", re.IGNORECASE)),
        "fonts_eastAsia": p["fonts"],
        "sizes_pt": [x / 2 for v in p["sizes"] if (x := _number(v)) is not None],
        "colors": p["colors"],
        "line_rule": None if line is None else "exact" if rule == "exact" else rule or "auto",
        "line_spacing_pt": line / 20 if line is not None and rule == "exact" else None,
        "line_multiple": line / LINE if line is not None and rule != "exact" else None,
        "first_line_indent_chars": indent,
        "alignment": "justify" if p["jc"] == "both" else p["jc"],
        "space_before_pt": _scaled(p["spacing"].get("before"), 20),
        "space_after_pt": _scaled(p["spacing"].get("after"), 20),
    }


def _image(name: str, raw: bytes) -> dict:
    """Colour space and metadata by the bytes of PNG and JPEG files."""
    space = "unknown"
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) > 25:
        space = "gray" if raw[25] in (0, 4) else "rgb"
    elif raw[:2] == b"\xff\xd8":
        m = re.search(rb"\xff[\xc0-\xc3]..\x08....(.)", raw, re.DOTALL)
        if m:
            space = {1: "gray", 3: "rgb", 4: "cmyk"}.get(m[1][0], "unknown")
    return {"name": name, "has_exif": any(mark in raw for mark in (b"Exif\x00", b"http://ns.adobe.com/xap", b"Photoshop 3.0", b"eXIf")), "color_space": space}


def _pages(paragraphs: list[dict], margins: dict, width: float | None, height: float | None) -> int | None:
    """Pages by the density of characters; null without page size or margins.

    Type size, line height and space around paragraphs are means weighted by characters.
    """
    if width is None or height is None or None in margins.values():
        return None
    across, down = (width - margins["left_cm"] - margins["right_cm"]) * POINTS_CM, (height - margins["top_cm"] - margins["bottom_cm"]) * POINTS_CM
    total = sum(len(p["text"]) for p in paragraphs)
    if across <= 0 or down <= 0 or not total:
        return 1 if across > 0 and down > 0 else None
    size = line = gap = 0.0
    for p in paragraphs:
        share = len(p["text"]) / total
        own = sum(p["sizes_pt"]) / len(p["sizes_pt"]) if p["sizes_pt"] else DEFAULT_PT
        size += own * share
        line += (p["line_spacing_pt"] if p["line_spacing_pt"] is not None else own * (p["line_multiple"] or DEFAULT_LINES)) * share
        gap += ((p["space_before_pt"] or 0) + (p["space_after_pt"] or 0)) * share
    if size <= 0 or line <= 0:
        return None
    return max(1, ceil(total / (max(1, int(across / (size * CHAR_FACTOR))) * max(1, int(down / (line + gap))))))


def parse(raw: bytes) -> dict:
    """The facts of one file as a nested row; a part that is missing is null."""
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        names = set(package.namelist())
        read = lambda n: package.read(n).decode("utf-8", "replace") if n in names else ""
        body = _Body(package.read("word/document.xml") if "word/document.xml" in names else b"")
        core, app, settings = (read(n) for n in ("docProps/core.xml", "docProps/app.xml", "word/settings.xml"))
        notes = read("word/comments.xml")
        edges = {n: read(n) for n in sorted(names) if re.fullmatch(r"word/(header|footer)\d*\.xml", n)}
        images = [_image(n, package.read(n)) for n in sorted(names) if n.startswith("word/media/")]
    paragraphs = [_paragraph(p) for p in body.paragraphs]
    inner = lambda xml, tag: (m[1] if (m := re.search(rf"<{tag}(?:\s[^>]*)?>(.*?)</{tag}>", xml, re.DOTALL)) else "")
    cm = lambda name: None if (x := _number(body.section.get(name))) is None else round(x / TWIPS_CM, 2)
    margins = {f"{s}_cm": cm(f"pgMar.{s}") for s in ("top", "bottom", "left", "right")}
    width, height = cm("pgSz.w"), cm("pgSz.h")
    filled = [n for n, xml in edges.items() if "".join(TEXT.findall(xml)).strip() or GRAPHIC.search(xml) or "<w:fldSimple" in xml or "<w:instrText" in xml]
    told = _number(inner(app, "Pages"))
    heads, feet = sum("header" in n for n in filled), sum("footer" in n for n in filled)
    return {
        "text": "\n".join(p["text"] for p in paragraphs),
        "metadata": {"creator": inner(core, "dc:creator"), "lastModifiedBy": inner(core, "cp:lastModifiedBy"), "company": inner(app, "Company")},
        "marks": {
            "revisions": body.marks["ins"] + body.marks["del"],
            "comments": len(re.findall(r"<w:comment[\s>]", notes)) or body.marks["commentReference"],
            "hidden_text": body.marks["vanish"],
            "rsid_count": len(set(re.findall(r'w:rsid\w*(?:\s+w:val)?="([0-9A-Fa-f]{8})"', settings))),
        },
        "images": images,
        "paragraphs": paragraphs,
        "doc": {
            "margins_cm": margins, "page_width_cm": width, "page_height_cm": height, "header_count": heads, "footer_count": feet, "headers_footers": heads + feet,
            "watermark": sum(len(GRAPHIC.findall(xml)) for xml in edges.values()),
            "page_count": int(told) if told else _pages(paragraphs, margins, width, height), "page_count_source": "app_props" if told else "estimated", "page_count_estimated": not told,
        },
    }


def facts(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(doc_id, facts...) of rows with a path and bytes; files that are no OOXML package have null facts."""
    fields = f"doc_id string, {FACTS}"

    kinds = to_arrow_schema(T.StructType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            rows = []
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows.append({"doc_id": path, **parse(bytes(raw))})
                except (zipfile.BadZipFile, TypeError):
                    rows.append({"doc_id": path, **dict.fromkeys(("text", "metadata", "marks", "images", "paragraphs", "doc"))})
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select(F.col(path_col).cast("string"), content_col).mapInArrow(run, fields)


def read_docx_facts(spark: SparkSession, path: str) -> DataFrame:
    """Facts of all files under a path or glob."""
    return facts(spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", F.col("content")))
