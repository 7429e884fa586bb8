"""Sinks: archived finals as partitioned tables, and Markdown as OOXML files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.functions.batches import pieces
from procurelake.sources.base import ingest  # noqa: F401 - the third sink, with a log of its own


def archive_finals(finals: DataFrame, path: str, mode: str = "append") -> None:
    """Write rows with their project metadata, by industry and year; blank ones go under ``unknown`` and 0."""
    tidy = finals.withColumns({"industry": F.coalesce(F.nullif(F.trim("industry"), F.lit("")), F.lit("unknown")), "year": F.coalesce(F.col("year").cast("int"), F.lit(0))})
    tidy.write.mode(mode).partitionBy("industry", "year").parquet(path)


#: Characters that XML can't hold.
UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def blocks(markdown: str) -> list[tuple[str, object]]:
    """(kind, content) of a Markdown text, line by line: h1 to h4, ul, ol, hr, table, p and blank."""
    out: list[tuple[str, object]] = []
    for line in UNWRITABLE.sub("", markdown or "").split("\n"):
        if line.startswith("|"):
            if not out or out[-1][0] != "table":
                out.append(("table", []))
            cells = [c.strip() for c in line.split("|")[1:-1]]
            if not all(re.fullmatch("[-:]+", c) for c in cells):
                out[-1][1].append(cells)
        elif not line.strip():
            out.append(("blank", ""))
        elif m := re.match(r"(#{1,4})\s+(.*)", line):
            out.append((f"h{len(m[1])}", m[2]))
        elif m := re.match(r"(?:([-*+])|\d+\.)\s+(.*)", line):
            out.append(("ul" if m[1] else "ol", m[2]))
        elif re.fullmatch("-{3,}", line.strip()):
            out.append(("hr", ""))
        else:
            out.append(("p", line))
    return out


#: Fixed value: what is bold and what is italic within a line.
MARKED = re.compile(r"\*\*(.+?)\*\*|\*(.+?)\*")


def _run(text: str, props: str = "") -> str:
    return f'<w:r>{f"<w:rPr>{props}</w:rPr>" if props else ""}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>' if text else ""


def _runs(text: str) -> str:
    """Runs with bold for ** and italic for *; stars without a partner stay."""
    out, at = [], 0
    for m in MARKED.finditer(text):
        out.append(_run(text[at : m.start()]))
        out.append(_run(m[1] or m[2], "<w:b/>" if m[1] else "<w:i/>"))
        at = m.end()
    return "".join(out) + _run(text[at:])


def _paragraph(text: str, props: str = "") -> str:
    return f"<w:p>{f'<w:pPr>{props}</w:pPr>' if props else ''}{_runs(text)}</w:p>"


def _table(rows: list[list[str]]) -> str:
    """A bordered table over the page's width whose first row is its head; nothing without rows."""
    if not rows:
        return ""
    borders = "".join(f'<w:{side} w:val="single" w:sz="4" w:space="0" w:color="auto"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
    grid = "<w:gridCol/>" * max(map(len, rows))
    out = [f'<w:tbl><w:tblPr><w:tblW w:w="5000" w:type="pct"/><w:tblBorders>{borders}</w:tblBorders></w:tblPr><w:tblGrid>{grid}</w:tblGrid>']
    for i, row in enumerate(rows):
        style = "" if i else '<w:pStyle w:val="Strong"/>'
        cells = "".join(f'<w:tc><w:tcPr><w:tcW w:w="0" w:type="auto"/></w:tcPr>{_paragraph(c, style)}</w:tc>' for c in row or [""])
        out.append(f"<w:tr>{cells}</w:tr>")
    return "".join(out) + "</w:tbl>"


def _body(markdown: str) -> str:
    out = []
    for kind, content in blocks(markdown):
        if kind == "table":
            out.append(_table(content))
        elif kind == "blank":
            out.append("<w:p/>")
        elif kind == "hr":
            out.append(_paragraph("", '<w:pBdr><w:bottom w:val="single" w:sz="6"/></w:pBdr>'))
        elif kind in ("ul", "ol"):
            out.append(_paragraph(content, f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{1 if kind == "ul" else 2}"/></w:numPr>'))
        elif kind == "p":
            out.append(_paragraph(content))
        else:
            out.append(_paragraph(content, f'<w:pStyle w:val="Heading{kind[1]}"/><w:outlineLvl w:val="{int(kind[1]) - 1}"/>'))
    return "".join(out)


NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def render_docx(markdown: str, title: str = "", author: str = "", header: str = "", footer: str = "") -> bytes:
    """An OOXML package of a Markdown text.  Header and footer, if given, are parts with relationship and content type."""
    edges = [(k, t) for k, t in (("header", header), ("footer", footer)) if t]
    refs = "".join(f'<w:{k}Reference w:type="default" r:id="rId{i}"/>' for i, (k, _) in enumerate(edges, 10))
    section = f'<w:sectPr>{refs}<w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1418" w:bottom="1134" w:left="1134" w:right="1134"/></w:sectPr>'
    main = "application/vnd.openxmlformats-officedocument.wordprocessingml"
    numbering = "".join(
        f'<w:abstractNum w:abstractNumId="{i}"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{f}"/><w:lvlText w:val="{t}"/></w:lvl></w:abstractNum>' for i, f, t in ((1, "bullet", "•"), (2, "decimal", "%1."))
    ) + "".join(f'<w:num w:numId="{i}"><w:abstractNumId w:val="{i}"/></w:num>' for i in (1, 2))
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{i}"><w:name w:val="heading {i}"/><w:rPr><w:b/><w:sz w:val="{36 - 4 * i}"/></w:rPr></w:style>' for i in range(1, 5))
    styles += '<w:style w:type="paragraph" w:styleId="Strong"><w:name w:val="Strong"/><w:rPr><w:b/></w:rPr></w:style>'
    title, author = (escape(UNWRITABLE.sub("", t)) for t in (title, author))
    parts = {
        "word/document.xml": (f"<w:document {NS}><w:body>{_body(markdown)}{section}</w:body></w:document>", f"{main}.document.main+xml"),
        "word/styles.xml": (f"<w:styles {NS}>{styles}</w:styles>", f"{main}.styles+xml"),
        "word/numbering.xml": (f"<w:numbering {NS}>{numbering}</w:numbering>", f"{main}.numbering+xml"),
        "docProps/core.xml": (
            f'<cp:coreProperties xmlns:cp="http://schemas.openxmlformats.org/package/2006/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{title}</dc:title><dc:creator>{author}</dc:creator></cp:coreProperties>',
            "application/vnd.openxmlformats-package.core-properties+xml",
        ),
        "word/settings.xml": (f'<w:settings {NS}><w:defaultTabStop w:val="720"/></w:settings>', f"{main}.settings+xml"),
        "docProps/app.xml": ('<Properties xmlns="http://schemas.openxmlformats.org/officeDocument/2006/extended-properties"><Application>procurelake</Application></Properties>', "application/vnd.openxmlformats-officedocument.extended-properties+xml"),
    }
    for k, text in edges:
        parts[f"word/{k}1.xml"] = (f"<w:{k[0]}{'dr' if k == 'header' else 'tr'} {NS}>{_paragraph(UNWRITABLE.sub("", text), '<w:jc w:val="center"/>')}</w:{k[0]}{'dr' if k == 'header' else 'tr'}>", f"{main}.{k}+xml")
    types = "".join(f'<Override PartName="/{n}" ContentType="{t}"/>' for n, (_, t) in parts.items())
    links = f'<Relationship Id="rId1" Type="{REL}/styles" Target="styles.xml"/><Relationship Id="rId2" Type="{REL}/numbering" Target="numbering.xml"/><Relationship Id="rId3" Type="{REL}/settings" Target="settings.xml"/>'
    links += "".join(f'<Relationship Id="rId{i}" Type="{REL}/{k}" Target="{k}1.xml"/>' for i, (k, _) in enumerate(edges, 10))
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        package.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>')
        package.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="word/document.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/><Relationship Id="rId3" Type="{REL}/extended-properties" Target="docProps/app.xml"/></Relationships>')
        package.writestr("word/_rels/document.xml.rels", f'{HEAD}<Relationships xmlns="{rels}">{links}</Relationships>')
        for name, (xml, _) in parts.items():
            package.writestr(name, HEAD + xml)
    return out.getvalue()


def render(rows: DataFrame, markdown_col: str = "markdown", title_col: str = "title", author_col: str | None = None, header_col: str | None = None, footer_col: str | None = None) -> DataFrame:
    """``rows`` with the bytes of their OOXML package in ``docx``; write them with any binary sink.

    Null texts are empty; without a column, or with a null, there is no author, header or footer.  Characters that XML
    can't hold are left out.
    """
    texts = [(F.col(c).cast("string") if c else F.lit("")).alias(f"__{i}") for i, c in enumerate((markdown_col, title_col, author_col, header_col, footer_col))]
    kept = [c for c in rows.columns if c != "docx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            made = [render_docx(*(x or "" for x in row)) for row in zip(*(c.to_pylist() for c in b.columns[len(kept) :]), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(made, pa.binary())], names=[*kept, "docx"])

    schema = T.StructType([*[rows.schema[c] for c in kept], T.StructField("docx", T.BinaryType())])
    return rows.select(*kept, *texts).mapInArrow(run, schema)
