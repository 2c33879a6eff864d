"""Profiles of documents for rules to read: cleaned text, title, head and signals.

A title is looked for among spans of one to three of the first twenty lines. All that a line is judged by stands in tables
of words and patterns with their points; a span is put in its normal form first, and the span with the most points is taken.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import islice
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import CJK

# What lines look like, and words that speak for and against a title, with their points (fixed values).
_N = "[一二三四五六七八九十百千0-9]+"
ARTICLE, CHAPTER, DATE = f"第{_N}条", f"第{_N}章", r"(?:19|20)\d{2}年\d{1,2}月\d{1,2}日"
STANDARD_CODE = r"(?:ICS|GB/?T?|DL/?T|Q/?GDW|DB\d{2,3}(?:/T)?|AQ(?:/T)?)"
STANDARD_HEAD = r"^(?:备案号[:：]?[A-Za-z0-9\- ]*|ICS[0-9.\- ]*|国家电网(?:公司|有限公司)?企业标准|企业标准|Q/GDW[0-9A-Za-z—\-× ]*)+"
DOC_CODE = f"[{CJK}A-Za-z0-9〔〕\\[\\]（）()]+[〔\\[](?:19|20)\\d{{2}}[〕\\]][A-Za-z0-9一二三四五六七八九十]+号"
ORDER = r"中华人民共和国国务院令|国务院令|.*公告(?:（第\d+号）)?|备案号[:：].*|规章制度编号[:：].*|制度编号[:：].*"
REVISED = r"[（(].{0,20}(?:修订|修正|修订版|修正版).{0,10}[)）]"
ARTIFACT = "[A-Za-z0-9_.:/\\\\-]{1,40}"
ARTIFACTS = "Root Entry|SummaryInformation|DocumentSummaryInformation|ObjectPool|WordDocument|1Table|0Table|Data|CompObj|Normal.dot|Microsoft Office Word|WPS Office|Kingsoft Office|KSOProductBuildVer".split("|")
WEAK_HEADS = "规章制度编号 制度编号 下载时间 发布日期 实施日期 备案号 公司内部文件 内部文件 ICS Q/GDW GB DL/T AQ DB — -".split()
TITLE_WORDS = "条例 办法 规定 规则 规范 导则 标准 通知 通报 公告 公报 意见 方案 报告 批复 决定 细则".split()
AGENCIES = "委员会 人民政府 人民代表大会 人大常委会 公司 供电公司 管理局 司法部 财政部 国务院".split()
#: Points of a line that holds all of some words or matches all of some patterns.
POINTS = (
    (2.0, ("关于",)), (1.0, ("文件",)), (-3.0, ("第", "条")), (-2.5, ("附件|目录|前言",)), (-1.5, ("发布|实施",)), (-1.8, (DATE,)), (-3.0, ("人民代表大会常务委员会", DATE)),
    (-3.0, ("^(?:中华人民共和国国务院令|国务院令|甘肃省人民代表大会常务委员会公告)",)), (-4.0, ("国务院令",)), (-3.5, ("关于印发《", "通知", "条例|办法|规定|规则")), (-4.0, ("企业标准$",)),
    (-4.0, ("公司内部文件|请注意保密",)), (-3.0, ("[。；;]$",)), (-3.0, ("[，,][^，,]*[，,]",)), (-2.0, ("根据|负责|要求|适用于|工作|情况",)), (-1.5, ("《|》",)),
)
#: Points by length: up to so many characters. What a span of one, two and three lines gets besides, and how long it may be.
LENGTHS = ((3, 0.0), (40, 2.5), (70, 1.5), (90, 0.0), (10**9, -2.0))
SPANS = ((0.0, 10**9), (0.8, 60), (1.0, 70))
WEAK = rf"[-—‐\s]*\d+[-—‐\s]*$|{CHAPTER}|{DOC_CODE}$|(?i:{STANDARD_CODE})|{'|'.join(WEAK_HEADS)}"
ORDER_TAIL = r"(?:中华人民共和国国务院令|国务院令|^.*公告（第\d+号）)$"
#: Signals: what is read (title, or all: source name, title and head) and words that say it.
SIGNALS = (
    ("npc_name", "all", "人民代表大会常务委员会|人大常委会|自治区人民代表大会"), ("government_name", "all", "人民政府|国务院|省政府|市政府|县政府"), ("state_grid_name", "all", "国家电网|国网|供电公司|电力公司"),
    ("notice_style", "title", "通知|通报|函|批复|印发"), ("plan_style", "title", "方案|规划|计划|行动方案|工作方案|实施方案"), ("meeting_style", "all", "会议纪要|工作会议|讲话|会议报告|会议材料|座谈会"),
    ("training_style", "all", "培训|课件|讲义|试题|教程"), ("log_template", "title", "日志|台账|日报|记录"), ("book_style", "all", "出版社|ISBN|作者|主编"), ("normative_title", "title", "条例|办法|规定|规则|法"),
)
#: Standards: what their codes begin with, in lower case, and look like.
STANDARD_SIGNALS = (("standard_gb_t", "gb/t", r"GB/T\s*\d"), ("standard_gb", "gb", r"GB\s*\d"), ("standard_dl_t", "dl/t", r"DL/T\s*\d"), ("standard_aq", "aq", r"AQ(?:/T)?\s*\d"), ("standard_db", "db", r"DB\d{2,3}(?:/T)?\s*\d"), ("standard_qgdw", "q/gdw", r"Q/GDW\s*\d"))
LOG_FIELDS = "日期 天气 值班记录 事件监测 保电工作 资源核查 日报填报".split()

# The same, compiled. Lines hold no line feeds, so that what is anchored is matched at their start alone. Most patterns hold Chinese words: a line without a Chinese character is held against the others only.
_HAN, _DIGIT, _NOT_ASCII = (re.compile(p) for p in (f"[{CJK}]", "[0-9]", "[^\x00-\x7f]"))
_ARTIFACT, _ARTICLE, _CHAPTER, _STANDARD_HEAD, _REVISED, _ORDER_TAIL, _WEAK, _CODE = (re.compile(p) for p in (ARTIFACT, ARTICLE, f"{CHAPTER}.*$", STANDARD_HEAD, REVISED, ORDER_TAIL, WEAK, f"(?i:{STANDARD_CODE})"))
_FILING, _ORDER = re.compile(r"备案号[:：][A-Za-z0-9\- ]+"), re.compile(f"(?:{ORDER})$|(?i:{STANDARD_CODE})|国家电网(?:公司|有限公司)企业标准$|企业标准$")
_POINTS = tuple((n, tuple(map(re.compile, patterns))) for n, patterns in POINTS)
_POINTS_OF_MARKS = tuple((n, patterns) for n, patterns in _POINTS if not any(_HAN.search(p.pattern) for p in patterns))
_SIGNALS = tuple((name, scope, tuple(words.split("|"))) for name, scope, words in SIGNALS)
_STANDARD_SIGNALS = tuple((name, begin, re.compile(rf"\b{pattern}", re.IGNORECASE)) for name, begin, pattern in STANDARD_SIGNALS)


def _holds(text: str, words) -> bool:
    return any(w in text for w in words)


def _han(text: str) -> bool:
    return not text.isascii() and bool(_HAN.search(text))


def _digit(text: str) -> bool:
    """Whether any character is a digit of any script, decimal or not."""
    return bool(_DIGIT.search(text)) or not text.isascii() and any(map(str.isdigit, _NOT_ASCII.findall(text)))


def cleaned(text: str | None) -> str:
    """NFKC, single blanks, trimmed lines without what other programs leave behind, at most one blank line at a time. Empty for null."""
    form = unicodedata.normalize("NFKC", text or "").replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ")
    while "  " in form:
        form = form.replace("  ", " ")
    lines = [x for x in map(str.strip, form.splitlines()) if not x or x not in ARTIFACTS and not (len(x) <= 40 and _ARTIFACT.fullmatch(x))]
    return re.sub("\n{3,}", "\n\n", "\n".join(lines)).strip()


def normal_title(line: str) -> str:
    """A title without white space, without a half that repeats the other, a repeated revised form, chapters behind it, and numbers of standards and orders around it."""
    line = "".join(line.split())
    half = line[: len(line) // 2]
    if half + half == line:
        line = half
    if not _han(line):
        return line
    if m := _REVISED.search(line):
        head, rest = line[: m.end()], line[m.end() :]
        if rest in (head, _REVISED.sub("", head)):
            line = head
    line = _CHAPTER.sub("", line)
    short = line[m.end() :] if (m := _STANDARD_HEAD.match(line)) else line
    if len(short) >= 6 and _han(short):
        line = short
    line = line[m.end() :] if (m := _FILING.match(line)) else line
    return _ORDER_TAIL.sub("", line) if line.endswith(("令", "号）")) else line


def weak_line(line: str) -> bool:
    """Whether a line is no title by its looks: very short, a page number, a chapter, a number of a paper or standard."""
    return len(line) <= 2 or bool(_WEAK.match(line)) or line.endswith("企业标准")


def agency_line(line: str) -> bool:
    return (_holds(line, AGENCIES) or "、" in line and not _holds(line, "《》")) and not _holds(line, TITLE_WORDS)


def order_line(line: str) -> bool:
    return bool((_ORDER if _han(line) else _CODE).match(line))


def title_points(line: str) -> float:
    """How much a line in its normal form looks like a title."""
    if weak_line(line):
        return -5.0
    han = _han(line)
    by_length = next((points for most, points in LENGTHS if len(line) <= most), LENGTHS[-1][1])
    points = by_length + 2.0 * han + 0.5 * (not _digit(line)) + 2.5 * (sum(w in line for w in TITLE_WORDS) if han else 0)
    points += sum(n for n, patterns in (_POINTS if han else _POINTS_OF_MARKS) if all(p.search(line) for p in patterns))
    return points - 2.5 * agency_line(line) - 3.0 * order_line(line)


def goes_on(line: str, after: str) -> bool:
    """Whether a title may go on from a line to the one behind it."""
    if not line or not after or weak_line(line) or weak_line(after) or _ARTICLE.match(after):
        return False
    whole = line.endswith(tuple(TITLE_WORDS)) or line.endswith((")", "）")) and _holds(line, TITLE_WORDS)
    if whole and (agency_line(after) or order_line(after) or after.startswith("关于印发《")):
        return False
    return not (line.startswith("关于") and agency_line(after))


def spans_of(lines: list[str]) -> list[tuple[float, int, int, str]]:
    """(points, length, minus place, span) of one to three of the lines, each begun anew; a span goes on as long as its title may."""
    found, bare = [], ["".join(x.split()) for x in lines]
    for i, line in enumerate(lines):
        if _ARTICLE.match(line):
            continue
        span, early = normal_title(bare[i]), max(0.0, 2.5 - 0.25 * i)
        for more, (extra, most) in enumerate(SPANS):
            if more:
                if i + more >= len(lines) or not goes_on(span, lines[i + more]):
                    break
                span = normal_title(span + bare[i + more])
            if len(span) <= most:
                found.append((title_points(span) + early + extra, len(span), -i, span))
    return found


def title_of(text: str, source: str) -> str:
    """The best span of the first twenty lines of a cleaned text that are not blank, or the source's stem where none has points."""
    lines = list(islice((x.strip() for x in text.split("\n") if x.strip()), 20))
    points, *_, span = max(spans_of(lines), default=(0.0, ""))
    return span if points > 0 else PurePosixPath(source.replace("\\", "/")).stem


def signals_of(title: str, head: str, text: str, source: str) -> list[str]:
    """Names of what a document's name, title, head and first 5,000 characters say, sorted."""
    every = f"{source}\n{title}\n{head}"
    han, low = _han(every), every.lower()
    found = {name for name, scope, words in _SIGNALS if _holds(title if scope == "title" else every, words if han else filter(str.isascii, words))}
    standards = {name for name, begin, pattern in _STANDARD_SIGNALS if begin in low and pattern.search(every)}
    found |= standards | ({"standard_style"} if standards else set())
    if text.count("第", 0, 5000) >= 2 and len(_ARTICLE.findall(text[:5000])) >= 2:
        found.add("law_style")
    if han and sum(w in every for w in LOG_FIELDS) >= 3:
        found.add("log_template")
    return sorted(found)


def profiles(docs: DataFrame, source_col: str, text_col: str = "text", title_col: str | None = None, head: int = 1600) -> DataFrame:
    """``docs`` with its text cleaned and, of each, ``filename``, ``title`` (``title_col``'s if it isn't blank), ``head`` (the first characters), ``title_head`` and ``signals`` (sorted names, joined by blanks): the columns that rules take as scopes.

    Null texts and sources are empty. Columns of these names are replaced. No shuffle; of a text the first twenty lines, 5,000 characters and the head are read, as that is what a profile is.
    """
    added = ("filename", "title", "head", "title_head", "signals")
    plain = docs.drop(*[c for c in added if c not in (source_col, title_col, text_col)])
    kept = [c for c in plain.columns if c not in added and c != text_col]
    given_title = F.col(title_col).cast("string") if title_col else F.lit(None).cast("string")
    inputs = plain.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).cast("string").alias("__text"), F.col(source_col).cast("string").alias("__source"), given_title.alias("__title"))
    names = [*kept, text_col, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = []
                for raw, source, title in zip(*(part.column(part.num_columns - i).to_pylist() for i in (3, 2, 1)), strict=True):
                    text, source = cleaned(raw), source or ""
                    title = cleaned(title) or title_of(text, source)
                    rows.append((text, source, title, text[:head], f"{title}\n{text[:head]}".strip(), " ".join(signals_of(title, text[:head], text, source))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], *(pa.array(c, pa.string()) for c in zip(*rows, strict=True))], names)

    schema = StructType([*(plain.schema[c] for c in kept), *(StructField(c, StringType()) for c in (text_col, *added))])
    return inputs.mapInArrow(run, schema)
