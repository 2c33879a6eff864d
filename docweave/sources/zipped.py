"""Documents that are zip archives of XML: DOCX, EPUB and XLSX.

Archives come as a table of ``path`` and ``content`` (``archives`` reads files of any file system that Spark reaches); Spark deals them out, and a task reads its archives one after
the other, their XML as a stream, so that of a large sheet or document only the row or paragraph at hand is in memory beside the archive itself.
"""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import column_index, sheet_header

# What in a document's XML says that its layout can't be read in order, and how many text boxes are no obstacle (fixed values).
LAYOUT_MARKS = {
    "floating_pictures": "wp:anchor", "vml_or_pict": "w:pict", "charts": "c:chart", "ole_objects": "oleObject", "alternate_content": "AlternateContent", "text_boxes": "w:txbxContent", "vml_text_boxes": "v:textbox",
}
TEXT_BOXES = 0
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
#: An ampersand that begins no reference: in XHTML these end in a semicolon.
_BARE = re.compile("&(?!(?:#[0-9]+|#x[0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)")


def archives(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``path`` and ``content`` of the files under ``path``, a file a row."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(element: ET.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def _unescaped(text: str) -> str:
    """Characters that XML can't hold, as spreadsheets write them."""
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _rows(archived: DataFrame, read: Callable[[zipfile.ZipFile], Iterator[tuple]], columns: str, lenient: bool) -> DataFrame:
    """What ``read`` yields for each archive, behind its path. An archive that can't be read is an error with its path or, if ``lenient``, a row with ``error``."""
    names = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", columns)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            held: list[tuple] = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as archive:
                        for row in read(archive):
                            held.append((path, *row, None))
                            if len(held) == 1000:
                                yield pd.DataFrame(held, columns=["path", *names, "error"])
                                held = []
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, UnicodeError) as e:
                    if not lenient:
                        raise ValueError(f"{path}: {e}") from e
                    held.append((path, *[None] * len(names), f"{type(e).__name__}: {e}"))
            if held:
                yield pd.DataFrame(held, columns=["path", *names, "error"])

    return archived.select("path", "content").mapInPandas(run, f"path string, {columns}, error string")


# ---- DOCX


def _styles(archive: zipfile.ZipFile) -> dict[str, int]:
    """Heading level by style id: headings 1 to 6, and titles as level 1."""
    found = {}
    if "word/styles.xml" in archive.namelist():
        for style in ET.fromstring(archive.read("word/styles.xml")):
            if _local(style.tag) == "style":
                name = next((_attribute(x, "val") or "" for x in style if _local(x.tag) == "name"), "").strip()
                if m := re.fullmatch(r"heading\s+([1-6])", name, re.IGNORECASE):
                    found[_attribute(style, "styleId") or ""] = int(m[1])
                elif name.lower() in ("title", "subtitle"):
                    found[_attribute(style, "styleId") or ""] = 1
    return found


def _text(element: ET.Element) -> str:
    """Text of a paragraph or cell: runs in order, tabs, breaks as line ends; paragraphs on lines of their own."""
    out = []
    for x in element.iter():
        tag = _local(x.tag)
        if tag == "t":
            out.append(x.text or "")
        elif tag == "tab" and _attribute(x, "pos") is None:
            out.append("\t")
        elif tag in ("br", "cr") or tag == "p" and x is not element and out:
            out.append("\n")
    return "".join(out)


def _trimmed(text: str) -> str:
    return " ".join(text.split())


def pipe_table(rows: list[list[str]]) -> str:
    """Markdown of a table, the first row as its head; short rows end in blank cells, line ends and pipes inside cells are kept apart. Empty for no row."""
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda r: "| " + " | ".join([c.replace("|", "\\|").replace("\n", "<br>") for c in r] + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[0]), "| " + " | ".join(["---"] * width) + " |", *map(line, rows[1:])])


def _docx(archive: zipfile.ZipFile) -> Iterator[tuple]:
    styles, n, inside = _styles(archive), 0, []
    with archive.open("word/document.xml") as f:
        for event, x in ET.iterparse(f, ("start", "end")):
            if event == "start":
                inside.append(x)
                continue
            inside.pop()
            if len(inside) != 2 or _local(inside[-1].tag) != "body":
                continue
            kind, level, text = None, None, ""
            if _local(x.tag) == "p":
                text = _trimmed(_text(x))
                style = next((_attribute(s, "val") for s in x.iter() if _local(s.tag) == "pStyle"), None)
                level = styles.get(style)
                kind = "heading" if level else "text"
            elif _local(x.tag) == "tbl":
                rows = [[_trimmed(_text(c)) for c in r if _local(c.tag) == "tc"] for r in x if _local(r.tag) == "tr"]
                kind, text = "table", pipe_table(rows)
            if text:
                yield n, kind, level, text
                n += 1
            inside[-1].remove(x)  # what was read goes


def docx_blocks(archived: DataFrame, lenient: bool = False) -> DataFrame:
    """``path``, ``block`` (from 0), ``kind`` (heading, text or table), ``level`` of headings, ``text``, ``error``: what stands in the body of each document, in order. Blank paragraphs are left out."""
    return _rows(archived, _docx, "block int, kind string, level int, text string", lenient)


def docx_markdown(archived: DataFrame, lenient: bool = False) -> DataFrame:
    """``path``, ``text``, ``error``: each document as Markdown, its blocks between blank lines. A document without blocks is empty."""

    def read(archive: zipfile.ZipFile) -> Iterator[tuple]:
        yield ("\n\n".join("#" * level + " " + text if level else text for _, _, level, text in _docx(archive)),)

    return _rows(archived, read, "text string", lenient)


def docx_layout(archived: DataFrame, lenient: bool = False) -> DataFrame:
    """``path``, ``counts`` (how often each mark of a layout occurs in the document's XML), ``is_complex`` (any mark, or more than ``TEXT_BOXES`` text boxes), ``error``."""

    def read(archive: zipfile.ZipFile) -> Iterator[tuple]:
        counts = dict.fromkeys(LAYOUT_MARKS, 0)
        for name in archive.namelist():
            if name.startswith("word/") and name.endswith(".xml"):
                xml = archive.read(name)
                for key, mark in LAYOUT_MARKS.items():
                    counts[key] += xml.count(mark.encode())
        yield counts, any(n > (TEXT_BOXES if key == "text_boxes" else 0) for key, n in counts.items())

    return _rows(archived, read, "counts map<string,int>, is_complex boolean", lenient)


# ---- EPUB


class _Chapter(HTMLParser):
    """Title and Markdown of a chapter; elements that are no content are passed over with all in them."""

    OUT = ("script", "style", "nav", "header", "footer")
    BLOCKS = ("p", "div", "section", "article", "blockquote", "ul", "ol", "li", "table", "tr", "pre", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "body")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.mark, self.skip, self.in_title, self.title, self.seen_body = "", 0, False, "", False
        self.first: dict[str, str] = {}
        self.tag = ""

    def _close(self) -> None:
        text = re.sub(r"[ \t\r\f\v]+", " ", "".join(self.line))
        text = re.sub(r" ?\n ?", "\n", text).strip()
        if text:
            self.blocks.append(self.mark + text)
            self.first.setdefault(self.tag, text)
        self.line, self.mark = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in self.OUT:
            self.skip += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "br":
            self.line.append("\n")
        elif tag in self.BLOCKS:
            self._close()
            self.tag = tag
            self.mark = "#" * int(tag[1]) + " " if re.fullmatch("h[1-6]", tag) else "* " if tag == "li" else ""

    def handle_startendtag(self, tag, attrs):
        if tag not in self.OUT and tag != "title":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in self.OUT:
            self.skip = max(0, self.skip - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in self.BLOCKS:
            self._close()

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.line.append(data.replace("\n", " ").replace("\r", " "))

    def done(self) -> tuple[str | None, str]:
        self.close()
        self._close()
        heads = [self.first[f"h{i}"] for i in range(1, 7) if f"h{i}" in self.first]
        short = [self.first["p"]] if len(self.first.get("p", "x" * 100)) < 100 else []
        named = [t for t in (" ".join(self.title.split()), *heads[:1], *short) if t]
        return (named[0] if named else None), "\n\n".join(self.blocks)


def _epub(archive: zipfile.ZipFile) -> Iterator[tuple]:
    every = lambda root, tag: [x for x in root.iter() if _local(x.tag) == tag]
    roots = every(ET.fromstring(archive.read("META-INF/container.xml")), "rootfile")
    if not roots or not (package := (roots[0].get("full-path") or "").strip()):
        raise ValueError("the container names no package")
    opf = ET.fromstring(archive.read(package))
    items = {x.get("id"): x for x in every(opf, "item")}
    book = next((t.text.strip() for t in every(opf, "title") if (t.text or "").strip()), None)
    n = 0
    for ref in every(opf, "itemref"):
        item = items.get(ref.get("idref"))
        if item is None or item.get("media-type") != "application/xhtml+xml" or not item.get("href"):
            continue
        chapter = _Chapter()
        page = archive.read(posixpath.normpath(posixpath.join(posixpath.dirname(package), item.get("href")))).decode("utf-8", "ignore")
        chapter.feed(_BARE.sub("&amp;", page))
        title, text = chapter.done()
        yield n, book, title, text
        n += 1


def epub_chapters(archived: DataFrame, lenient: bool = False) -> DataFrame:
    """``path``, ``chapter`` (from 0, in the order of the spine), ``book``, ``title``, ``text`` (Markdown), ``error``.

    A chapter's title is its own, else its first heading from the largest down, else a first paragraph of under 100 characters. Spine entries that are no pages are passed over.
    As XHTML has it, a reference ends in a semicolon; an ampersand without one stands for itself.
    """
    return _rows(archived, _epub, "chapter int, book string, title string, text string", lenient)


def epub_markdown(archived: DataFrame, lenient: bool = False) -> DataFrame:
    """``path``, ``text``, ``error``: the book's title, and its chapters with their titles, unless they are the book's."""

    def read(archive: zipfile.ZipFile) -> Iterator[tuple]:
        parts: list[str] = []
        for n, book, title, text in _epub(archive):
            parts += [f"# {book}"] if book and not n else []
            parts += [f"## {title}"] if title and title != book else []
            parts += [text] if text else []
        yield ("\n\n".join(parts),)

    return _rows(archived, read, "text string", lenient)


# ---- XLSX


def _shared_strings(archive: zipfile.ZipFile) -> list[str]:
    out: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        with archive.open("xl/sharedStrings.xml") as f:
            for _, x in ET.iterparse(f):
                if _local(x.tag) == "si":
                    out.append(_unescaped("".join(t.text or "" for t in x.iter() if _local(t.tag) == "t")))
                    x.clear()
    return out


def _sheet_file(archive: zipfile.ZipFile, sheet: str | int | None) -> str:
    """The member that holds a sheet: by name, by number (from 1), or the first."""
    sheets = [x for x in ET.fromstring(archive.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
    names = [x.get("name") for x in sheets]
    wish = str(sheet if sheet is not None else "").strip()
    if not sheets:
        raise ValueError("no sheet")
    if not wish:
        at = 0
    elif wish.isdigit():
        if not 0 < int(wish) <= len(sheets):
            raise ValueError(f"sheet {wish} of {len(sheets)}")
        at = int(wish) - 1
    elif wish in names:
        at = names.index(wish)
    else:
        raise ValueError(f"no sheet {wish}")
    targets = {x.get("Id"): x.get("Target") for x in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    target = targets[_attribute(sheets[at], "id")]
    return target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))


def _cell(x: ET.Element, shared: list[str]) -> str | None:
    kind = x.get("t", "n")
    if kind == "inlineStr":
        return _unescaped("".join(t.text or "" for t in x.iter() if _local(t.tag) == "t"))
    value = next((v.text for v in x if _local(v.tag) == "v"), None)
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "True" if value == "1" else "False"
    return _unescaped(value) if kind == "str" else value


def xlsx_rows(archived: DataFrame, sheet: str | int | None = None, lenient: bool = False, blank_heads: str = "drop") -> DataFrame:
    """``path``, ``row`` (number in the sheet, from 1), ``cells`` (map from column name to text, null for an empty cell), ``error``: rows of a sheet below its head.

    ``sheet`` is a name or a number from 1; the first by default. Rows without any text are left out. Columns without a head are dropped or, with ``blank_heads="letter"``, named by their letter; repeated
    heads get __1, __2 and so on. Numbers are the text that the sheet has for them.
    """

    def read(archive: zipfile.ZipFile) -> Iterator[tuple]:
        shared, head, number = _shared_strings(archive), None, 0
        with archive.open(_sheet_file(archive, sheet)) as f:
            data = None
            for event, x in ET.iterparse(f, ("start", "end")):
                if event == "start":
                    data = x if _local(x.tag) == "sheetData" else data
                    continue
                if _local(x.tag) != "row":
                    continue
                number = int(x.get("r") or number + 1)
                values: list[str | None] = []
                for c in x:
                    if _local(c.tag) == "c":
                        at = column_index(re.match("[A-Za-z]+", c.get("r"))[0]) if c.get("r") else len(values)
                        values += [None] * (at - len(values)) + [_cell(c, shared)]
                if head is None:
                    named = sheet_header(values)
                    head = [(i, n) for i, n in enumerate(named) if blank_heads == "letter" or (values[i] or "").strip()]
                elif any((v or "").strip() for v in values):
                    yield number, {n: values[i] if i < len(values) else None for i, n in head}
                if data is not None:
                    data.remove(x)

    return _rows(archived, read, "row int, cells map<string,string>", lenient)


def xlsx_table(archived: DataFrame, sheet: str | int | None = None, blank_heads: str = "drop") -> DataFrame:
    """``path``, ``row`` and a text column for each head of the sheets, those of all archives together."""
    rows = xlsx_rows(archived, sheet, blank_heads=blank_heads)
    heads = [r[0] for r in rows.select(F.explode(F.map_keys("cells"))).distinct().orderBy("col").collect()]  # names of columns
    return rows.select("path", "row", *[F.try_element_at("cells", F.lit(h)).alias(h) for h in heads])
