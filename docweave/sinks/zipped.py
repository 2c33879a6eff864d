"""Rows as DOCX, EPUB and XLSX archives, as columns of bytes that Spark stores wherever it stores tables."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame

WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _plain(text: str) -> str:
    """Escaped text; what XML can't hold is a blank."""
    return escape(_UNFIT.sub(" ", text))


def _exact(text: str) -> str:
    """Escaped text of a cell; what XML can't hold, or would change, is written by number."""
    text = re.sub("_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    return escape(re.sub("[\x00-\x08\x0b-\x1f￾￿]", lambda m: f"_x{ord(m[0]):04X}_", text))


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def docx(blocks: list[tuple[int, str]]) -> bytes:
    """A document of (heading level or 0, text)."""
    para = lambda level, t: f'<w:p>{f"<w:pPr><w:pStyle w:val=\'H{level}\'/></w:pPr>" if level else ""}<w:r><w:t xml:space="preserve">{_plain(t)}</w:t></w:r></w:p>'
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="H{i}"><w:name w:val="heading {i}"/></w:style>' for i in range(1, 7))
    return _zip({"word/styles.xml": f'<w:styles xmlns:w="{WORD}">{styles}</w:styles>', "word/document.xml": f'<w:document xmlns:w="{WORD}"><w:body>{"".join(para(*b) for b in blocks)}</w:body></w:document>'})


def xlsx(names: list[str], rows: list[tuple]) -> bytes:
    """A workbook of one sheet; numbers are numbers, all else is text, null is no cell."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{_exact(str(v))}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [tuple(names), *rows])
    return _zip({
        "xl/workbook.xml": f'<workbook xmlns="{SHEET}" xmlns:r="{RELS}"><sheets><sheet name="rows" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SHEET}"><sheetData>{lines}</sheetData></worksheet>',
    })


def epub(title: str, chapters: list[str]) -> bytes:
    """A book of pages of HTML, in order."""
    items = "".join(f'<item id="c{i}" href="text/c{i}.xhtml" media-type="application/xhtml+xml"/>' for i in range(len(chapters)))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(chapters)))
    return _zip({
        "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>',
        "OPS/book.opf": f'<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>{_plain(title)}</dc:title></metadata><manifest>{items}</manifest><spine>{spine}</spine></package>',
        **{f"OPS/text/c{i}.xhtml": c for i, c in enumerate(chapters)},
    })


def archived(rows: DataFrame, write: Callable[[pd.DataFrame], bytes], path: str, many: int = 1) -> DataFrame:
    """``path`` and ``content``: an archive of ``many`` rows at most, as they lie, named by ``path`` of its first row. No shuffle, and no more rows in memory than an archive holds."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made: list[tuple[str, bytes]] = []
            for at in range(0, len(part), many):
                some = part.iloc[at : at + many]
                made.append((str(some[path].iloc[0]), write(some)))
                if len(made) == 256:
                    yield pd.DataFrame(made, columns=["path", "content"])
                    made = []
            if made:
                yield pd.DataFrame(made, columns=["path", "content"])

    return rows.mapInPandas(run, "path string, content binary")
