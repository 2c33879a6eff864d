"""Readers for question/answer datasets and document tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.numbers import json_items
from ..functions.text import collapse, strip
from ..operators.records import numbered


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines; a bad line is an error if ``strict``, else it comes back in ``_bad`` with null fields."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("x")).select("x.*")


def bad_lines(rows: DataFrame) -> DataFrame:
    """One row: ``lines`` read, and ``bad`` ones among them, of what lenient :func:`jsonl` returned."""
    return rows.agg(F.count("*").alias("lines"), F.count_if(F.col("_bad").isNotNull()).alias("bad"))


def csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header; quotes are doubled inside quotes, which may hold line ends. Every column is text, an empty file has no row."""
    return spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)


def items_json(spark: SparkSession, path: str, item_schema: str) -> DataFrame:
    """JSON documents, each a list, an object with the list ``items``, ``results`` or ``data``, or a single object: a row for each item."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(json_items(F.col("value"), item_schema)).alias("item")).select("item.*")


#: Encodings in the order in which they are tried; the last one reads anything (fixed values).
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk", "latin-1")


def decoded(raw: bytes) -> str:
    """Text of bytes in the first of ``ENCODINGS`` that reads them."""
    for name in ENCODINGS[:-1]:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode(ENCODINGS[-1])


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``text`` of whole files in any of the encodings; each file is one row, so this is for documents, not for large tables."""

    @pandas_udf("string")
    def read(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for contents in parts:
            yield contents.map(lambda b: decoded(bytes(b)))

    return spark.read.format("binaryFile").load(path).select("path", read("content").alias("text"))


def needs_scan(files: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """``files`` with ``needs_scan``: pictures and page formats by their extension, plain text not; others if their first 8 KiB hold a
    zero byte or over 12 % control characters."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    head = F.hex(F.substring(content, 1, 8192))
    n = F.greatest(F.length(head) / 2, F.lit(1))
    pairs = F.regexp_replace(head, "(..)", "$1 ")
    odd = F.size(F.regexp_extract_all(pairs, F.lit("((?:0[1-8BCEF]|1[0-9A-F]|7F) )"), F.lit(1)))
    binary = F.contains(pairs, F.lit("00 ")) | (odd / n > 0.12)
    return files.withColumn("needs_scan", F.when(ext.isin("pdf", "png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp", "gif"), True).when(ext.isin("txt", "md", "csv", "json", "jsonl", "html"), False).otherwise(F.coalesce(binary, F.lit(False))))


def sniffed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A data set by its extension, or by the first that reads it without a bad record: JSON lines, a JSON document, CSV."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ext == "csv":
        return csv(spark, path)
    if ext in ("jsonl", "ndjson"):
        return jsonl(spark, path, schema, strict=True)
    if ext == "json":
        return items_json(spark, path, schema.replace(" ", ": ", 1) if ":" not in schema else schema)
    lines = jsonl(spark, path, schema)
    if lines.where("_bad IS NULL").limit(1).count() and not lines.where("_bad IS NOT NULL").limit(1).count():
        return lines.drop("_bad")
    first = spark.read.text(path).where("trim(value) <> ''").first()
    if first is not None and first["value"].lstrip()[:1] in ("{", "["):
        return items_json(spark, path, schema)
    return csv(spark, path)


def preview(df: DataFrame, rows: int = 5) -> dict:
    """Names of the columns, the first rows (a report: at most 100), and how many there are."""
    return {"columns": df.columns, "rows": [r.asDict() for r in df.limit(min(rows, 100)).collect()], "total": df.count()}


def shared_columns(*tables: DataFrame) -> dict[str, list[str]]:
    """Columns that all tables have, and those that only some have, in order of first sight."""
    seen = list(dict.fromkeys(c for t in tables for c in t.columns))
    common = [c for c in seen if all(c in t.columns for t in tables)]
    return {"shared": common, "partial": [c for c in seen if c not in common]}


#: Names under which the fields of a question/answer table are looked for (fixed values).
ROLES = {
    "question": ("question", "q", "query", "问题", "题干"), "answer": ("answer", "a", "response", "答案", "回答"), "context": ("context", "passage", "text", "上下文", "原文"),
    "ref_answer": ("ref_answer", "reference", "reference_answer", "参考答案"), "id": ("id", "qid", "编号"), "original_filename": ("original_filename", "filename", "文件名"),
}


def resolved_columns(columns: list[str], given: dict[str, str] | None = None) -> dict[str, str]:
    """Column of each role: the given one, else the first of its names in any case; question and answer must be found."""
    low = {c.strip().lower(): c for c in reversed(columns)}
    out = {}
    for role, names in ROLES.items():
        wanted = (given or {}).get(role)
        if wanted is not None and wanted not in columns:
            raise ValueError(f"no column {wanted}")
        found = wanted or next((low[n] for n in names if n in low), None)
        if found is not None:
            out[role] = found
    if missing := {"question", "answer"} - set(out):
        raise ValueError(f"no column for {', '.join(sorted(missing))}")
    return out


def canonical_rows(df: DataFrame, dataset: str, columns: dict[str, str] | None = None, filename: str = "dataset") -> DataFrame:
    """id, group_id, original_filename, context, question, answer, ref_answer of every row with a question and an answer.

    An id that is given becomes ``human:<dataset>:<id>``, others are a digest of file, question and answer; the group is a digest of the context with single blanks.
    """
    found = resolved_columns(df.columns, columns)
    value = lambda role: F.coalesce(strip(F.col(f"`{found[role]}`").cast("string")), F.lit("")) if role in found else F.lit("")
    name = F.when(value("original_filename") == "", filename).otherwise(value("original_filename"))
    rows = df.select(value("id").alias("given"), name.alias("original_filename"), *[value(r).alias(r) for r in ("context", "question", "answer", "ref_answer")])
    rows = rows.where((F.col("question") != "") & (F.col("answer") != ""))
    own = F.sha1(F.concat("original_filename", "question", "answer").cast("binary"))
    ids = F.when(F.col("given") == "", own).otherwise(F.concat(F.lit(f"human:{dataset}:"), "given"))
    group = F.concat(F.lit("sha1:"), F.sha1(collapse(F.col("context")).cast("binary")))
    return rows.select(ids.alias("id"), group.alias("group_id"), "original_filename", "context", "question", "answer", "ref_answer")


def triples(df: DataFrame, order: str, prefix: str, width: int = 6) -> DataFrame:
    """id, context, question, answer of the rows where none of the three is blank; ids are the prefix and the row's number among those, padded with zeros."""
    kept = df.where(F.coalesce(*[F.when(F.coalesce(strip(F.col(c)), F.lit("")) == "", F.lit(False)) for c in ("context", "question", "answer")], F.lit(True)))
    return numbered(kept, order, name="n").select(F.concat(F.lit(prefix), F.lpad(F.col("n").cast("string"), width, "0")).alias("id"), "context", "question", "answer")


def long_answers(df: DataFrame, least: int, most: int, separators: str = "。；;\n", answer: str = "answer") -> DataFrame:
    """Rows whose answer has ``least`` to ``most`` characters and one of the separators."""
    return df.where(F.length(answer).between(least, most) & F.col(answer).rlike(f"[{separators}]"))


def seeded_sample(df: DataFrame, n: int, seed: str, *keys: str) -> DataFrame:
    """``n`` rows, chosen by a hash of seed and keys: the same on every run and for every partitioning."""
    return df.orderBy(F.md5(F.concat_ws("/", F.lit(seed), *[F.col(k).cast("string") for k in keys])), *keys).limit(n)


def multi_document(rows: DataFrame, documents: int = 5, most_chars: int = 2000) -> DataFrame:
    """question_id, question, answer, context of multi-document questions (``documents``: array of is_selected, paragraphs; ``answers``: array).

    Selected documents come first, ``documents`` of them; paragraphs with an answer come before the others, and are taken while they fit in ``most_chars``.
    The answer is the first.
    """
    picked = F.slice(F.concat(F.filter("documents", lambda d: d["is_selected"]), F.filter("documents", lambda d: ~F.coalesce(d["is_selected"], F.lit(False)))), 1, documents)
    every = F.flatten(F.transform(picked, lambda d: d["paragraphs"]))
    has = lambda p: F.exists("answers", lambda a: (a != "") & F.contains(p, a))
    ordered = F.concat(F.filter(every, has), F.filter(every, lambda p: ~has(p)))
    start = F.struct(F.lit(most_chars).alias("left"), F.array().cast("array<string>").alias("taken"))
    step = lambda s, p: F.when(s["left"] >= F.length(p), F.struct((s["left"] - F.length(p)).alias("left"), F.array_append(s["taken"], p).alias("taken"))).otherwise(s)
    context = F.array_join(F.aggregate(ordered, start, step)["taken"], "\n")
    return rows.select("question_id", "question", F.try_element_at("answers", F.lit(1)).alias("answer"), context.alias("context"))


def column_letter(index: int) -> str:
    """Spreadsheet letter of a column (from 0)."""
    out = ""
    while index >= 0:
        index, r = divmod(index, 26)
        out, index = chr(65 + r) + out, index - 1
    return out


def column_index(letter: str) -> int:
    """Column (from 0) of a spreadsheet letter."""
    n = 0
    for c in letter.upper():
        n = n * 26 + ord(c) - 64
    return n - 1


def sheet_header(cells: list[str | None]) -> list[str]:
    """Names of a sheet's columns: blank heads become their letter, repeated ones get __1, __2, ..."""
    out: list[str] = []
    for i, cell in enumerate(cells):
        name = (cell or "").strip() or column_letter(i)
        base, k = name, 0
        while name in out:
            k += 1
            name = f"{base}__{k}"
        out.append(name)
    return out


def taxonomy(lines: list[str]) -> list[tuple[str, str, str]]:
    """(level1, level2, level3) of an indented outline, repeats dropped; levels follow the indents in the order of their width."""
    widths = sorted({len(x) - len(x.lstrip()) for x in lines if x.strip()})
    stack: list[str] = []
    out: dict[tuple[str, str, str], None] = {}
    for x in lines:
        if x.strip():
            level = widths.index(len(x) - len(x.lstrip()))
            stack = [*stack[:level], x.strip()]
            if level == 2 and len(stack) == 3:
                out[tuple(stack)] = None
    return list(out)


SQUAD = "data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,answers:array<struct<text:string,answer_start:int>>>>>>>>"


def squad(spark: SparkSession, path: str) -> DataFrame:
    """Nested reading-comprehension JSON as rows id, context, question, answer (the first)."""
    rows = spark.read.schema(SQUAD).option("multiLine", True).json(path)
    rows = rows.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p")).select("p.context", F.explode("p.qas").alias("q"))
    return rows.select("q.id", "context", "q.question", F.try_element_at("q.answers", F.lit(1))["text"].alias("answer"))


def links(pages: DataFrame, html: str = "html", url: str = "url", host: str | None = None, path: str | None = None) -> DataFrame:
    """Distinct link targets of each page, in order of first sight, made absolute on the page's host; only those of a host and of a path pattern, if given."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit('<a[^>]*href="([^"]*)"'), F.lit(1)))
    rows = pages.select("page_id", F.regexp_extract(url, "^(?:https?://)([^/]*)", 1).alias("host"), F.posexplode(found).alias("pos", "href"))
    out = rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.when(F.col("href").startswith("/"), F.concat(F.lit("https://"), "host", "href")).otherwise(F.col("href")).alias("link"))
    at = F.regexp_extract("link", "^https?://([^/]*)", 1)
    out = out if host is None else out.where((at == host) | at.endswith(f".{host}"))
    return out if path is None else out.where(F.regexp_extract("link", "^https?://[^/]*(/[^?#]*)", 1).rlike(path))


def row_ranges(spec: str) -> list[tuple[int, int]]:
    """'1,3-5,10' as sorted ranges, overlapping and adjacent ones merged."""
    found = []
    for part in filter(None, (p.strip() for p in spec.split(","))):
        low, _, high = part.partition("-")
        a, b = int(low), int(high or low)
        if a < 1 or b < a:
            raise ValueError(f"not a row range: {part}")
        found.append((a, b))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def resolved_ranges(spec: str, total: int) -> list[tuple[int, int]]:
    """:func:`row_ranges` cut to the rows there are; an empty spec is all of them."""
    found = row_ranges(spec) or [(1, total)]
    return [(a, min(b, total)) for a, b in found if a <= total]
