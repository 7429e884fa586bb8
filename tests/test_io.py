"""Documents in and out, streams, components, running totals."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from procurelake.operators.graph import connected_components
from procurelake.operators.ordering import running_total
from procurelake.plans.audit import audit_docx
from procurelake.sources import sinks
from procurelake.sources.docx import _pages, parse
from procurelake.sources.tables import Settings, json_list
from procurelake.storage import Scratch


def test_docx_round_trip(spark, tmp_path):
    raw = sinks.render_docx("# 标题\n\n正文 **粗** 体\n\n- 一\n- 二\n\n| a | b |\n|---|---|\n| 1 | 2 |\n", "t", "某人", header="页眉")
    facts = parse(raw)
    assert "正文 粗 体" in facts["text"] and facts["paragraphs"][0]["is_heading"]
    assert facts["metadata"]["creator"] == "某人" and facts["doc"]["headers_footers"] == 1
    assert facts["doc"]["margins_cm"]["top_cm"] == 2.5 and facts["doc"]["page_count_estimated"]
    (tmp_path / "a.docx").write_bytes(raw)
    (tmp_path / "b.docx").write_bytes(b"no package")
    found, verdict = audit_docx(spark, str(tmp_path), date(2025, 1, 1), industry="工程")
    v = {r.doc_id[-6:]: r for r in verdict.collect()}
    assert v["a.docx"].verdict == "REJECT" and v["a.docx"].skipped == 0 and v["b.docx"].skipped > 0
    assert {"META.CREATOR", "DOC.NO_HEADER_FOOTER", "PARA.LINE_SPACING"} <= {r.rule_id for r in found.collect()}


def test_page_estimate():
    layout = {"sizes_pt": [14.0], "line_spacing_pt": 30.0, "line_multiple": None, "space_before_pt": 0.0, "space_after_pt": 0.0}
    margins = {"top_cm": 2.5, "bottom_cm": 2.0, "left_cm": 2.0, "right_cm": 2.0}
    pages = lambda n: _pages([{"text": "施" * n, **layout}], margins, 21.0, 29.7)
    assert pages(2000) < 100 < pages(100_000) <= 125 < pages(140_000)
    assert _pages([], margins, 21.0, 29.7) == 1 and _pages([], margins, None, 29.7) is None
    assert parse(sinks.render_docx("字" * 50))["doc"]["page_count"] == 1


def test_archive(spark, tmp_path):
    rows = spark.createDataFrame([("a", "水利", 2024), ("b", " ", None)], "project string, industry string, year int")
    sinks.archive_finals(rows, str(tmp_path / "out"))
    assert {(r.industry, r.year) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("水利", 2024), ("unknown", 0)}


def test_json_arguments(spark):
    df = spark.createDataFrame([('[{"id":"a"}]',), ('{"documents":[{"id":"b"}]}',), ("7",)], "j string")
    assert [r[0][0].id if r[0] else None for r in df.select(json_list(df.j, "struct<id:string>", "documents")).collect()] == ["a", "b", None]


def test_settings(monkeypatch):
    monkeypatch.setenv("PROCURELAKE_TOP_K", "5")
    monkeypatch.setenv("PROCURELAKE_CHUNK_SIZE", "")
    assert Settings.from_env() == Settings(top_k=5)


def test_stream_equals_batch(spark, tmp_path):
    from procurelake.streaming import text as streaming

    rows = spark.createDataFrame([(1, "电话13900001111", "zh", "s", 15), (2, "无", "zh", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows.write.parquet(str(tmp_path / "in"))
    q = streaming.for_each_batch(streaming.read_documents(spark, str(tmp_path / "in")), streaming.masked, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "masked_text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, streaming.masked(rows).select("doc_id", "masked_text").collect()))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, 300 + i) for i in range(50)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100 and all(got[300 + i] == 200 for i in range(50))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_total(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(100)], "id long, n long")
    got, total = running_total(df, [F.col("id")], "n", "start", Scratch(spark, "test"))
    want, at = {}, 0
    for i in range(100):
        want[i], at = at, at + (i * 7) % 5
    assert {r.id: r.start for r in got.collect()} == want and total == at


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_machine_local_folder_on_clusters(monkeypatch):
    from types import SimpleNamespace

    import pytest

    from procurelake import storage

    none = SimpleNamespace(get=lambda *_: None)
    undefined = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isDefined=lambda: False)))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1000]"):
        session = SimpleNamespace(conf=none, sparkContext=SimpleNamespace(master=master, getConf=lambda: none, _jsc=undefined))
        with pytest.raises(RuntimeError, match="checkpoint"):
            storage.shared_dir(session)


def test_docx_blocks_and_marks():
    assert sinks.blocks("# a\n\n- b\n1. c\n---\n| x | y |\n|--|:-|\n| 1 | 2 |\n|--|\n d") == [("h1", "a"), ("blank", ""), ("ul", "b"), ("ol", "c"), ("hr", ""), ("table", [["x", "y"], ["1", "2"]]), ("p", " d")]
    assert sinks.blocks("") == sinks.blocks(None) == [("blank", "")] and sinks.blocks("|--|") == [("table", [])]
    text = lambda s: parse(sinks.render_docx(s))["text"]
    assert text("a*** b.*** c*** d") == "a* b. c** d" and text("**x*") == "*x"
    assert text("x\x01y￾") == "xy"


def test_docx_parts_are_xml():
    import io
    import zipfile
    from xml.dom import minidom

    raw = sinks.render_docx("# a\n| b |\n|--|\n| <c> |\n", "t<", "w\x02", header="h&", footer="f")
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        names = set(package.namelist())
        for name in names:
            minidom.parseString(package.read(name))
    assert {"word/settings.xml", "docProps/app.xml", "word/header1.xml", "word/footer1.xml"} <= names


def test_ingest_again(spark, tmp_path):
    rows = [("k", 1, "a"), ("k", 1, "a"), ("k", None, "b"), (None, 2, None), (" ", 3, "c")]
    docs, place = spark.createDataFrame(rows, "dataset string, doc_id int, content string"), str(tmp_path / "kb")
    for _ in range(2):
        told = sinks.ingest(docs, place)
        assert {tuple(r) for r in told.collect()} == {("k", 1, "DONE"), ("k", None, "DONE"), ("unknown", 2, "DONE"), ("unknown", 3, "DONE")}
        assert spark.read.parquet(place).count() == 4
    sinks.ingest(spark.createDataFrame([("k", 1, "new")], docs.schema), place)
    assert spark.read.parquet(place).count() == 5
    assert sinks.ingest(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_additions_are_logged(spark, tmp_path):
    """The second addition reads the log and candidate files only; a failed one shows; a logged one that wasn't moved is."""
    from procurelake.sources import base

    place, schema = f"file://{tmp_path}/kb", "dataset string, doc_id int, content string"
    make = lambda rows: spark.createDataFrame(rows, schema).coalesce(1)
    base.ingest(make([("a b", 1, "x"), ("a b", 2, "x")]), place)
    base.ingest(make([("a b", 50, "x"), ("c", 1, "x"), ("c", None, "y")]), place)
    assert base.documents(spark, place).count() == 5 and base.log(spark, place).agg(F.sum("n")).first()[0] == 5
    near = lambda *keys: len(base.held_files(spark, place, spark.createDataFrame(keys, "dataset string, id int")))
    assert (near(("a b", 2)), near(("a b", 3)), near(("a b", 60), ("a b", 2)), near(("c", None)), near(("d", 1)), near(("a b", 0), ("c", 1))) == (1, 0, 2, 1, 0, 1)
    bad = make([("a b", 1, "x"), ("c", 7, "z")]).withColumn("content", F.when(F.col("doc_id") == 7, F.raise_error(F.lit("no text")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="no text"):
        base.ingest(bad, place)
    late = make([("a b", 1, "x"), ("c", 8, "z")])
    kept, base._Folder.write = base._Folder.write, lambda self, name, text: (_ for _ in ()).throw(OSError("full")) if '"error"' not in text else kept(self, name, text)
    try:
        told = {tuple(r) for r in base.ingest(late, place, strict=False).collect()}
    finally:
        base._Folder.write = kept
    assert told == {("a b", 1, "DONE"), ("c", 8, "FAIL")}
    assert base.documents(spark, place).count() == 5 and base.log(spark, place).where("error is not null").count() == 2
    moved, base._Folder.move = base._Folder.move, lambda *_: (_ for _ in ()).throw(OSError("lost"))
    try:
        with pytest.raises(OSError, match="lost"):
            base.ingest(late, place)
    finally:
        base._Folder.move = moved
    assert spark.read.parquet(place).count() == 5  # logged, not yet moved
    assert base.documents(spark, place).count() == 6 and {r.run for r in base.ingest(late, place).collect()} == {"DONE"}
    assert base.documents(spark, place).count() == 6


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
BODY = """<{p}:document xmlns:{p}="{uri}" xmlns:v="urn:v"><{p}:body>
<{p}:p><{p}:pPr><{p}:pStyle {p}:val="Heading1"/><{p}:spacing {p}:line="600" {p}:lineRule="exact" {p}:before="40"/><{p}:ind {p}:firstLineChars="200" {p}:firstLine="9"/><{p}:jc {p}:val="both"/><{p}:rPr><{p}:sz {p}:val="99"/></{p}:rPr></{p}:pPr>
<{p}:r><{p}:rPr><{p}:rFonts {p}:ascii="x" {p}:eastAsia="宋体"/><{p}:sz {p}:val="28"/><{p}:color {p}:val="FF0000"/><{p}:vanish/></{p}:rPr><{p}:t>one &amp; </{p}:t></{p}:r>
<{p}:r><v:shape><v:textbox><{p}:txbxContent><{p}:p><{p}:r><{p}:rPr><{p}:sz {p}:val="20"/></{p}:rPr><{p}:t>inner</{p}:t></{p}:r></{p}:p></{p}:txbxContent></v:textbox></v:shape></{p}:r>
<{p}:ins><{p}:r><{p}:rPr><{p}:rFonts {p}:eastAsia="宋体"/></{p}:rPr><{p}:t xml:space="preserve"> two &lt;</{p}:t></{p}:r></{p}:ins></{p}:p>
<{p}:p/><{p}:p><{p}:pPr><{p}:spacing {p}:line="360" {p}:lineRule="atLeast"/><{p}:ind {p}:hanging="480"/></{p}:pPr><{p}:del><{p}:r><{p}:delText>gone</{p}:delText></{p}:r></{p}:del></{p}:p>
<{p}:p><{p}:pPr><{p}:spacing {p}:line="360"/><{p}:outlineLvl {p}:val="0"/><{p}:sectPr><{p}:pgMar {p}:top="1"/></{p}:sectPr></{p}:pPr></{p}:p>
<{p}:sectPr><{p}:pgSz {p}:w="11906" {p}:h="16838"/><{p}:pgMar {p}:top="1417" {p}:bottom="1134" {p}:left="1134" {p}:right="1134"/></{p}:sectPr></{p}:body></{p}:document>"""


def packed(body):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    return out.getvalue()


@pytest.mark.parametrize(("prefix", "uri"), [("w", W), ("ns0", W), ("w", "http://purl.oclc.org/ooxml/wordprocessingml/main")])
def test_paragraphs_by_events(prefix, uri):
    """Nested paragraphs, entities, any prefix and both editions; the last section counts, runs' properties by run."""
    got = parse(packed(BODY.format(p=prefix, uri=uri)))
    outer, inner, empty, least, last = got["paragraphs"]
    assert (outer["text"], inner["text"], empty["text"], [p["index"] for p in got["paragraphs"]]) == ("one &amp;  two &lt;", "inner", "", [0, 1, 2, 3, 4])
    assert (outer["fonts_eastAsia"], outer["sizes_pt"], outer["colors"], inner["sizes_pt"]) == (["宋体", "宋体"], [14.0], ["FF0000"], [10.0])
    assert (outer["is_heading"], outer["style"], outer["alignment"], outer["first_line_indent_chars"], outer["space_before_pt"]) == (True, "Heading1", "justify", 2.0, 2.0)
    shown = lambda p: (p["line_rule"], p["line_spacing_pt"], p["line_multiple"])
    assert [shown(p) for p in (outer, empty, least, last)] == [("exact", 30.0, None), (None, None, None), ("atLeast", None, 1.5), ("auto", None, 1.5)]
    assert least["first_line_indent_chars"] == -2.0 and last["is_heading"] and inner["style"] is None
    assert got["marks"] | {"rsid_count": 0, "comments": 0} == {"revisions": 2, "hidden_text": 1, "rsid_count": 0, "comments": 0}
    assert got["doc"]["margins_cm"] == {"top_cm": 2.5, "bottom_cm": 2.0, "left_cm": 2.0, "right_cm": 2.0} and got["doc"]["page_width_cm"] == 21.0


def test_broken_and_undeclared_parts():
    bare = "<w:document><w:body><w:p><w:r><w:t>a</w:t></w:r></w:p></w:body></w:document>"
    assert parse(packed(bare))["text"] == "a"
    cut = BODY.format(p="w", uri=W)
    assert parse(packed(cut[: cut.index("<w:p/>")]))["text"] == "one &amp;  two &lt;\ninner"
    assert parse(packed(""))["paragraphs"] == [] and parse(packed("no xml"))["text"] == ""
    deep = "<w:p><w:r>" * 3000 + "</w:r></w:p>" * 3000
    assert len(parse(packed(f'<w:document xmlns:w="{W}">{deep}</w:document>'))["paragraphs"]) == 3000


def test_pieces_are_bounded():
    """Batches come in slices of few rows and bytes, in order; one large row is a piece by itself."""
    import pyarrow as pa

    from procurelake.functions.batches import pieces

    texts = ["x" * (5 << 20) if i == 300 else "y" * (i % 7) * 10_000 for i in range(1000)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1001)), pa.array(texts)], names=["i", "t"])
    got = list(pieces(iter([batch, batch.slice(0, 0)])))
    assert [i for b in got for i in b.column("i").to_pylist()] == list(range(1001))
    assert all(b.num_rows <= 128 and (b.nbytes <= 2 << 20 or b.num_rows == 1) for b in got) and len(got) > 10


def test_file_steps_give_pieces(spark, monkeypatch):
    """Files are written and read, and chunks cut and asked, a piece at a time: no step makes Python objects of a whole batch."""
    import pyarrow as pa

    from procurelake.operators import retrieval
    from procurelake.plans import requirements
    from procurelake.sources import docx, sinks

    steps = []
    frame = type(spark.range(1))
    kept = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, schema, *a, **b: steps.append(run) or kept(self, run, schema, *a, **b))
    rows = spark.createDataFrame([("a", "# t\n\nx")], "path string, markdown string").selectExpr("*", "path title")
    assert docx.facts(sinks.render(rows), content_col="docx").first().text == "t\n\nx"
    requirements.ask_chunks(rows.selectExpr("path tender_id", "markdown text"), lambda c: "[]")
    made = [sinks.render_docx("x")] * 1000
    texts = pa.array(["x"] * 1000)
    given = [pa.RecordBatch.from_arrays(a, names=n) for a, n in (([texts] * 8, [*"abcdefgh"]), ([texts, pa.array(made)], ["path", "docx"]), ([texts, texts], ["tender_id", "text"]), ([texts, pa.array([0] * 1000, pa.int32()), texts], ["tender_id", "chunk_no", "chunk"]))]
    assert len(steps) == len(given) and retrieval.cut("x") == ["x"]
    for run, batch in zip(steps, given, strict=True):
        out = list(run(iter([batch])))
        assert sum(b.num_rows for b in out) == 1000 and max(b.num_rows for b in out) <= 128
