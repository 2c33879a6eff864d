"""Readers of zipped documents on hand-made archives and files."""

import zipfile

import pytest

from docweave.sinks import zipped as sinks
from docweave.sources import zipped

W, S, R = sinks.WORD, sinks.SHEET, sinks.RELS


def save(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)


def test_docx(spark, tmp_path):
    para = lambda t, style="": f"<w:p><w:pPr>{f'<w:pStyle w:val=\"{style}\"/>' if style else ''}<w:tabs><w:tab w:pos='1'/></w:tabs></w:pPr>{t}</w:p>"
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    cell = lambda *t: f"<w:tc>{''.join(para(run(x)) for x in t)}</w:tc>"
    body = para(run("The title"), "T") + para(run("One") + "<w:r><w:tab/><w:br/></w:r>" + run(" two &amp; three")) + para("") + para(run("Part"), "H2")
    body += f"<w:tbl><w:tr>{cell('a|b')}{cell('c', 'd')}</w:tr><w:tr>{cell('e')}</w:tr></w:tbl>" + para(run("x"), "other")
    styles = f'<w:styles xmlns:w="{W}"><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style><w:style w:styleId="other"><w:name w:val="Body"/></w:style></w:styles>'
    members = {"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>', "word/styles.xml": styles}
    save(tmp_path / "a.docx", members)
    save(tmp_path / "b.docx", {"word/document.xml": f'<w:document xmlns:w="{W}"><w:body/></w:document>', "word/header1.xml": f'<w:hdr xmlns:w="{W}"><w:pict/><w:pict/></w:hdr>'})
    files = zipped.archives(spark, f"file://{tmp_path}", "*.docx")
    got = [tuple(r)[1:5] for r in zipped.docx_blocks(files).orderBy("path", "block").collect()]
    assert got == [(0, "heading", 1, "The title"), (1, "text", None, "One two & three"), (2, "heading", 2, "Part"), (3, "table", None, "| a\\|b | c d |\n| --- | --- |\n| e |  |"), (4, "text", None, "x")]
    texts = {r["path"][-6:]: r["text"] for r in zipped.docx_markdown(files).collect()}
    assert texts["a.docx"].startswith("# The title\n\nOne two & three\n\n## Part\n\n| a") and texts["b.docx"] == ""
    layout = {r["path"][-6:]: (r["is_complex"], r["counts"]["vml_or_pict"]) for r in zipped.docx_layout(files).collect()}
    assert layout == {"a.docx": (False, 0), "b.docx": (True, 2)}


def test_broken_archives(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(b"no zip")
    save(tmp_path / "y.docx", {"other": "x"})
    files = zipped.archives(spark, f"file://{tmp_path}")
    assert [r["error"].split(":")[0] for r in zipped.docx_blocks(files, lenient=True).orderBy("path").collect()] == ["BadZipFile", "KeyError"]
    with pytest.raises(Exception, match="x.docx|y.docx"):
        zipped.docx_blocks(files).collect()
    none = spark.createDataFrame([("p", None)], "path string, content binary")
    assert zipped.epub_chapters(none, lenient=True).first()["error"] and zipped.xlsx_rows(none.limit(0)).count() == 0


def test_epub(spark, tmp_path):
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><metadata><dc:title xmlns:dc="http://purl.org/dc/elements/1.1/"> The Book </dc:title></metadata><manifest><item id="b" href="../two.xhtml" media-type="application/xhtml+xml"/><item id="a" href="one.xhtml" media-type="application/xhtml+xml"/><item id="i" href="i.png" media-type="image/png"/></manifest><spine><itemref idref="a"/><itemref idref="i"/><itemref idref="gone"/><itemref idref="b"/></spine></package>'
    one = "<html><head><title>The Book</title><style>p{}</style></head><body><nav>menu</nav><h1>Start</h1><p>First &amp; <b>best</b>\nline<br/>more</p><ul><li>x<li>y</ul><script>1<2</script></body></html>"
    save(tmp_path / "a.epub", {"META-INF/container.xml": '<container><rootfiles><rootfile full-path="in/book.opf"/></rootfiles></container>', "in/book.opf": opf, "in/one.xhtml": one, "two.xhtml": "<body><p>Only a paragraph</p><p>" + "long " * 40 + "</p></body>"})
    files = zipped.archives(spark, f"file://{tmp_path}")
    got = [tuple(r)[1:5] for r in zipped.epub_chapters(files).orderBy("chapter").collect()]
    assert got[0] == (0, "The Book", "The Book", "# Start\n\nFirst & best line\nmore\n\n* x\n\n* y")
    assert got[1][:3] == (1, "The Book", "Only a paragraph") and len(got) == 2
    assert zipped.epub_markdown(files).first()["text"].startswith("# The Book\n\n# Start\n\nFirst & best line\nmore\n\n* x\n\n* y\n\n## Only a paragraph\n\nOnly a paragraph\n\nlong")


def test_references_of_a_chapter_end_in_a_semicolon(spark):
    page = "<html><head><title>A &amp;&amp B&copy C &lt; D &#39;&#39 E&</title></head><body><p>x &amp y &amp; z</p></body></html>"
    df = spark.createDataFrame([("p", bytearray(sinks.epub("Pages", [page])))], "path string, content binary")
    row = zipped.epub_chapters(df).first()
    assert (row["title"], row["text"]) == ("A &&amp B&copy C < D '&#39 E&", "x &amp y & z")


def test_xlsx(spark, tmp_path):
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>n</t></is></c><c r="D1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>1.50</v></c><c r="D3" t="b"><v>1</v></c></row><row r="4"><c r="A4" t="str"><v> </v></c></row><row r="9"><c r="B9"><v>7</v></c></row>'
    book = f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="first" r:id="r1"/><sheet name="data" r:id="r2"/></sheets></workbook>'
    rels = '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>'
    shared = f'<sst xmlns="{S}"><si><t>q</t></si><si><r><t>rich </t></r><r><t>text_x000A_</t></r></si></sst>'
    save(tmp_path / "a.xlsx", {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/sharedStrings.xml": shared, "xl/worksheets/s1.xml": f'<worksheet xmlns="{S}"><sheetData/></worksheet>', "xl/worksheets/s2.xml": f'<worksheet xmlns="{S}"><sheetData>{rows}</sheetData></worksheet>'})
    files = zipped.archives(spark, f"file://{tmp_path}")
    for sheet in ("data", 2, "2"):
        got = {r["row"]: r["cells"] for r in zipped.xlsx_rows(files, sheet).collect()}
        assert got == {3: {"q": "rich text\n", "n": "1.50", "q__1": "True"}, 9: {"q": None, "n": None, "q__1": None}}
    assert {r["row"]: r["cells"]["B"] for r in zipped.xlsx_rows(files, "data", blank_heads="letter").collect()} == {3: None, 9: "7"}
    assert zipped.xlsx_rows(files).count() == 0
    assert zipped.xlsx_table(files, "data").columns == ["path", "row", "n", "q", "q__1"]
    for sheet in ("none", 3):
        with pytest.raises(Exception, match="a.xlsx"):
            zipped.xlsx_rows(files, sheet).collect()


def test_cells_come_back_as_they_were(spark):
    texts = ["a\r\nb\x01\x1f", "_x0041_ <&>\"'", " lead\t", "", "x" * 50_000, "_x", "😀￾"]
    df = spark.createDataFrame([("p", bytearray(sinks.xlsx(["t", "n"], [(t, i) for i, t in enumerate(texts)])))], "path string, content binary")
    got = {int(r["cells"]["n"]): r["cells"]["t"] for r in zipped.xlsx_rows(df).collect()}
    assert got == dict(enumerate(texts))
