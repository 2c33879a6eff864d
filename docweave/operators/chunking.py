"""Documents to chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.text import slug, strip


def fixed(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts of ``size`` characters: doc id, chunk_index, text. Empty and null texts give no chunk; the text is walked once."""
    parts = F.regexp_extract_all(text_col, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))
    out = docs.select(id_col, F.posexplode(parts).alias("chunk_index", "text"))
    return out.withColumn("chunk_index", F.col("chunk_index").cast("long"))


def overlapped(chunks: DataFrame, overlap: int, id_col: str = "doc_id") -> DataFrame:
    """Each chunk with the last ``overlap`` characters of the one before it (as it was cut) in front."""
    before = F.lag("text").over(Window.partitionBy(id_col).orderBy("chunk_index"))
    return chunks.withColumn("text", F.concat(F.coalesce(F.right(before, F.lit(overlap)), F.lit("")), "text"))


def on_separator(docs: DataFrame, separator: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Parts between a literal separator, trimmed, empty ones dropped."""
    quoted = "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    parts = F.filter(F.transform(F.split(text_col, quoted), lambda x: F.trim(x)), lambda x: x != "")
    out = docs.select(id_col, F.posexplode(parts).alias("chunk_index", "text"))
    return out.withColumn("chunk_index", F.col("chunk_index").cast("long"))


def at_points(docs: DataFrame, points: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces between sorted distinct split points; blank pieces go, the others keep their number."""
    n = F.length(text_col)
    cuts = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(0)), points, F.array(n)), lambda p: (p >= 0) & (p <= n))))
    out = docs.select(id_col, text_col, cuts.alias("cuts")).select(id_col, text_col, "cuts", F.posexplode("cuts").alias("pos", "start"))
    stop = F.try_element_at("cuts", F.col("pos") + 2)
    out = out.where(stop.isNotNull()).select(id_col, (F.col("pos") + 1).cast("long").alias("part"), F.substring(F.col(text_col), F.col("start") + 1, stop - F.col("start")).alias("text"))
    return out.where(F.trim("text") != "")


def noise_lines(docs: DataFrame, most: int = 80, least_count: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Short lines that a document repeats: doc id, line, n."""
    lines = docs.select(id_col, F.explode(F.split(text_col, "\n")).alias("line")).select(id_col, F.trim("line").alias("line"))
    lines = lines.where((F.length("line") > 0) & (F.length("line") <= most))
    return lines.groupBy(id_col, "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


#: Lines that begin a block of their own: numbered chapters, articles, items (fixed values).
STRONG_HEADS = r"(?:第[一二三四五六七八九十百千万0-9]+[章节条款]|（[一二三四五六七八九十]+）|[一二三四五六七八九十]+、|[0-9]+[、.)）]|[A-Za-z][.)])"


def units(docs: DataFrame, least: int = 10, most: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Information units: doc id, unit, text. The first ``most`` sentences of at least ``least`` characters, repeats dropped after that.

    Lines are joined to blocks, which begin at numbered heads; a block is cut after its sentences, one of 120 characters or
    more without any after its commas. Null and blank texts have none; repeated rows repeat theirs.
    """
    t = F.regexp_replace(F.regexp_replace(text_col, "\r\n?", "\n"), "[ \t\u00A0]+", " ")
    marked = F.regexp_replace(F.concat(F.lit("\n"), t), rf"\n[ ]*(?={STRONG_HEADS})", "\u0001")  # heads begin blocks; other lines go on
    blocks = F.filter(F.transform(F.split(marked, "\u0001"), lambda b: F.trim(F.regexp_replace(b, "[ ]*\n+[ ]*", " "))), lambda b: b != "")
    ended = lambda b, marks: F.filter(F.transform(F.regexp_extract_all(b, F.lit(f"([^{marks}]*[{marks}]|[^{marks}]+)"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")

    def cut(b: Column) -> Column:
        parts = ended(b, "。！？!?；;")
        return F.when((F.size(parts) <= 1) & (F.length(b) >= 120), ended(b, "，,；;")).otherwise(parts)

    every = F.filter(F.flatten(F.transform(blocks, cut)), lambda x: F.length(x) >= least)
    out = docs.select(id_col, F.posexplode(F.array_distinct(F.slice(every, 1, most))).alias("unit", "text"))
    return out.withColumn("unit", F.col("unit").cast("long"))


#: A Markdown heading: its marks, and its title without an anchor in braces (fixed values of the format).
HEADING_MARK, HEADING_TITLE = r"^(#{1,6})\s+\S", r"^#{1,6}\s+(.+?)(?:\s*\{#[\w-]+\})?\s*$"


def headings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Markdown sections by line: doc id, section (0 before the first heading), level, title, path of ancestor titles, text."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\r?\n")).alias("pos", "line"))
    mark = F.regexp_extract("line", HEADING_MARK, 1)
    lines = lines.withColumn("level", F.length(mark)).withColumn("title", F.when(F.length(mark) > 0, F.regexp_extract("line", HEADING_TITLE, 1)))
    running = Window.partitionBy(id_col).orderBy("pos")
    lines = lines.withColumn("section", F.count("title").over(running))
    out = lines.groupBy(id_col, "section").agg(
        F.max("level").alias("level"), F.max("title").alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("title").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), "\n").alias("text"),
    )
    order = Window.partitionBy(id_col).orderBy("section")
    for k in range(1, 7):  # the last title of level k with no higher heading since
        out = out.withColumn(f"t{k}", F.last(F.when(F.col("level").between(1, k), F.struct("level", "title")), True).over(order))
    path = F.filter(F.array(*[F.when((F.col(f"t{k}.level") == k) & (F.col("level") > k), F.col(f"t{k}.title")) for k in range(1, 7)]), lambda x: x.isNotNull())
    return out.select(id_col, "section", "level", "title", path.alias("ancestors"), "text")


#: From coarse to fine: paragraphs, lines, sentences, words (fixed values of the splitter's default).
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def pack_spans(text: str, separators: tuple[str, ...], size: int) -> list[str]:
    """Runs of neighbouring pieces of at most ``size`` characters; a longer piece is cut at the next finer separator.

    A run of pieces is a span of the text, so packing moves two ends and copies nothing. Without a separator
    left, or at the empty one, the text is cut every ``size`` characters.
    """
    if len(text) <= size:
        return [text] if text else []
    at = next((i for i, s in enumerate(separators) if not s or s in text), None)
    if at is None or not separators[at]:
        return [text[i : i + size] for i in range(0, len(text), size)]
    mark, finer = separators[at], separators[at + 1 :]
    out, begin, end, start = [], 0, 0, 0
    while start <= len(text):
        stop = text.find(mark, start)
        stop = len(text) if stop < 0 else stop
        if begin < end and stop - begin <= size:
            end = stop
        else:
            out += pack_spans(text[begin:end], finer, size)
            begin, end = start, stop
        start = stop + len(mark)
    return out + pack_spans(text[begin:end], finer, size)


def recursive(docs: DataFrame, size: int = 600, separators: tuple[str, ...] = SEPARATORS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Doc id, chunk_index, text of :func:`pack_spans`. Null and empty texts give no chunk; repeated rows repeat theirs."""
    if size < 1:
        raise ValueError("size must be 1 or more")

    @pandas_udf("array<string>")
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([pack_spans(t or "", separators, size) for t in texts])

    out = docs.select(F.col(id_col), F.posexplode(cut(F.col(text_col))).alias("chunk_index", "text"))
    return out.withColumn("chunk_index", F.col("chunk_index").cast("long"))


#: Where code of a language is cut first, before the general separators (fixed values).
CODE_SEPARATORS = {
    "python": ("\nclass ", "\ndef ", "\n\tdef "), "js": ("\nfunction ", "\nconst ", "\nlet ", "\nvar ", "\nclass "), "java": ("\nclass ", "\npublic ", "\nprotected ", "\nprivate "),
    "go": ("\nfunc ", "\nvar ", "\nconst ", "\ntype "), "rust": ("\nfn ", "\nconst ", "\nlet "), "markdown": ("\n# ", "\n## ", "\n### ", "\n---\n"),
}


def of_code(docs: DataFrame, language: str, size: int = 600, **columns: str) -> DataFrame:
    """:func:`recursive` with the separators of a language of ``CODE_SEPARATORS`` before the general ones; other languages have the general ones alone."""
    return recursive(docs, size, (*CODE_SEPARATORS.get(language, ()), *SEPARATORS), **columns)


def token_windows(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """Windows of ``size`` tokens (an array of any kind), each ``size - overlap`` further, up to the one that reaches the end: doc id, chunk_index, tokens."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    n = F.size(tokens_col)
    last = F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap))).cast("int")
    out = docs.where(n > 0).select(id_col, tokens_col, F.posexplode(F.sequence(F.lit(0), last)).alias("chunk_index", "i"))
    return out.select(id_col, F.col("chunk_index").cast("long").alias("chunk_index"), F.slice(tokens_col, F.col("i") * (size - overlap) + 1, F.lit(size)).alias("tokens"))


def section_chunks(docs: DataFrame, size: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Markdown chunks by section: doc id, chunk_index, level, title_path, part, parts, text.

    A section is one chunk with its heading line, or, where its text is longer than ``size``, several: paragraphs are packed,
    longer ones cut at sentences, still longer ones anywhere; each part repeats the heading and gets what it leaves of ``size``, 40 at least.
    Empty sections give none. What stands before the first heading has the path "Preface". Paths of several parts end in "Part i/n".
    """
    found = headings(docs, id_col, text_col).withColumn("text", strip(F.col("text"))).where("text <> ''")
    line = F.when(F.col("title").isNull(), "").otherwise(F.concat_ws(" ", F.expr("repeat('#', level)"), "title"))
    room = F.when(F.length("text") <= size, F.length("text")).otherwise(F.greatest(F.lit(40), F.lit(size) - F.length("line") - 1)).cast("int")

    @pandas_udf("array<string>")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, rooms in parts:
            yield pd.Series([[p.strip() for p in pack_spans(t, PARAGRAPHS, int(n)) if p.strip()] for t, n in zip(texts, rooms, strict=True)])

    rows = found.withColumn("line", line).withColumn("cuts", cut("text", room)).select("*", F.size("cuts").cast("long").alias("parts"), F.posexplode("cuts").alias("at", "body"))
    path = F.array_append("ancestors", F.coalesce("title", F.lit("Preface")))
    path = F.when(F.col("parts") > 1, F.array_append(path, F.concat(F.lit("Part "), (F.col("at") + 1).cast("string"), F.lit("/"), F.col("parts").cast("string")))).otherwise(path)
    order = Window.partitionBy(id_col).orderBy("section", "at")
    return rows.select(
        id_col, (F.row_number().over(order) - 1).cast("long").alias("chunk_index"), F.coalesce("level", F.lit(0)).alias("level"), F.array_join(path, " > ").alias("title_path"),
        (F.col("at") + 1).cast("long").alias("part"), "parts", F.when(F.col("line") == "", F.col("body")).otherwise(F.concat_ws("\n", "line", "body")).alias("text"),
    )


#: Separators of section parts: paragraphs, then sentences with their marks, then anywhere.
PARAGRAPHS = ("\n\n", ". ", "。", "")


def contents(docs: DataFrame, most: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Table of contents: doc id, place, level, title, link, line (its Markdown), of headings of level ``most`` or higher."""
    rows = headings(docs, id_col, text_col).where(F.col("level").between(1, most))
    link = F.concat(F.lit("#"), slug(F.col("title")))
    line = F.concat(F.expr("repeat('  ', level - 1)"), F.lit("- ["), "title", F.lit("]("), link, F.lit(")"))
    return rows.select(id_col, F.col("section").cast("long").alias("place"), "level", "title", link.alias("link"), line.alias("line"))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Headings with the titles before and after them: doc id, section, level, title, before, after."""
    order = Window.partitionBy(id_col).orderBy("section")
    rows = headings(docs, id_col, text_col).where("title IS NOT NULL")
    return rows.select(id_col, "section", "level", "title", F.lag("title").over(order).alias("before"), F.lead("title").over(order).alias("after"))


def index_paths(chunks: DataFrame, id_col: str = "doc_id", depth: int = 6) -> DataFrame:
    """``chunks`` (chunk_index, title_path) with ``index_path`` ("2/1/3"), ``parent_path`` and ``tree_depth``: at each level the number of the title among its siblings, in order of first sight.

    Numbering is one pass over the distinct paths for each of ``depth`` levels; a longer path keeps the number of its first ``depth`` titles.
    """
    parts = F.transform(F.split(F.coalesce("title_path", F.lit("")), " > "), lambda x: F.trim(x))
    rows = chunks.withColumn("__p", F.slice(F.filter(parts, lambda x: x != ""), 1, depth))
    out = rows.withColumn("__path", F.array().cast("array<string>"))
    for k in range(1, depth + 1):
        prefix = rows.where(F.size("__p") >= k).select(id_col, F.slice("__p", 1, k).alias("__q"), "chunk_index")
        first = prefix.groupBy(id_col, "__q").agg(F.min("chunk_index").alias("__first"))
        place = F.row_number().over(Window.partitionBy(id_col, F.slice("__q", 1, k - 1) if k > 1 else F.lit(0)).orderBy("__first", "__q"))
        number = first.select(F.col(id_col).alias("__d"), F.col("__q").alias("__r"), place.cast("string").alias("__n"))
        out = out.join(number, (F.col(id_col) == F.col("__d")) & (F.slice("__p", 1, k) == F.col("__r")) & (F.size("__p") >= k), "left")
        out = out.withColumn("__path", F.when(F.col("__n").isNotNull(), F.array_append("__path", F.col("__n"))).otherwise(F.col("__path"))).drop("__d", "__r", "__n")
    path = F.array_join("__path", "/")
    parent = F.when(F.size("__path") > 1, F.array_join(F.slice("__path", F.lit(1), F.greatest(F.size("__path") - 1, F.lit(0))), "/")).otherwise("")
    return out.withColumns({"index_path": path, "parent_path": parent, "tree_depth": F.size("__path").cast("long")}).drop("__p", "__path")


def document_tree(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Nodes of the tree of numbered chunks (index_path, title_path): doc id, node, parent, depth, title, n_leaves, first_chunk.

    Every prefix of a path is a node; its title is the part of the title path at its depth.
    """
    ids, titles = F.split("index_path", "/"), F.transform(F.split("title_path", " > "), lambda x: F.trim(x))
    rows = chunks.where(F.coalesce("index_path", F.lit("")) != "").select(id_col, "chunk_index", ids.alias("ids"), titles.alias("titles"))
    rows = rows.select(id_col, "chunk_index", "ids", "titles", F.explode(F.sequence(F.lit(1), F.size("ids"))).alias("depth"))
    upto = lambda n: F.array_join(F.slice("ids", F.lit(1), n), "/")
    rows = rows.select(id_col, "chunk_index", upto(F.col("depth")).alias("node"), F.when(F.col("depth") > 1, upto(F.greatest(F.col("depth") - 1, F.lit(1)))).otherwise("").alias("parent"), F.col("depth").cast("long").alias("depth"), F.try_element_at("titles", F.col("depth")).alias("title"))
    return rows.groupBy(id_col, "node", "parent", "depth").agg(F.min_by("title", "chunk_index").alias("title"), F.count("*").alias("n_leaves"), F.min("chunk_index").alias("first_chunk"))
