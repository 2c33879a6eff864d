"""Regulations and other numbered texts to chunks: noise lines out, hard-wrapped lines joined, cut at headings and items, packed.

Lines are rows; whatever looks at neighbours is a window over one document's lines. Null and empty texts give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import clean_lines, strip

# What lines that begin a part look like (fixed values): headings, rules and articles, Chinese clauses and sections, appendices, fixed titles.
_N = "[一二三四五六七八九十百零0-9]+"
TOP = (r"#{1,6}\s+\S", r"(?i:RULE|ARTICLE|SECTION|CHAPTER)\s+[0-9IVX]+\b", f"第{_N}[条章节编部分]", "[一二三四五六七八九十]+、", r"附件\s*[0-9一二三四五六七八九十]*\s*[:：]?", "(?:总则|附则|目录|前言)$")
SUB = (r"\([a-z0-9]{1,3}\)\s", "[（(][一二三四五六七八九十]+[）)]", r"[0-9]+(?:\.[0-9]+)*\.\s*\S", "[0-9]+、", "[0-9]+[)）]")
END_MARKS = "。！？；.!?;:："
PAGE_MARK = r"^[—\-–\s]*[0-9]{1,4}\s*[—\-–]+$|^[—\-–]+\s*[0-9]{1,4}\s*[—\-–]*$"
DATES = (r"[0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}", r"[0-9]{4}[-/年][0-9]{1,2}")


def begins_part(line: Column) -> Column:
    """Whether a line is a heading, a numbered rule, article or section, or an appendix."""
    return line.rlike("^(?:" + "|".join(TOP) + ")")


def begins_item(line: Column) -> Column:
    """Whether a line begins a numbered item inside a part."""
    return line.rlike("^(?:" + "|".join(SUB) + ")")


def table_line(line: Column) -> Column:
    return line.rlike("[\t|]") | (line.rlike(r"\S\s{3,}\S") & (F.length(line) <= 120))


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, pos, line (trimmed, blank ones too), top, edge (begins a part or item) of every line."""
    rows = docs.where(F.length(text_col) > 0).select(id_col, F.posexplode(F.split(clean_lines(F.col(text_col)), "\n")).alias("pos", "line")).withColumn("line", strip(F.col("line")))
    rows = rows.withColumn("top", begins_part(F.col("line")))
    return rows.withColumn("edge", F.col("top") | begins_item(F.col("line")))


def without_noise(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``lines`` with page numbers, repeated short lines, stray numbers and dates blanked; lines that begin a part or item stay.

    Repeated means six times up to 80 characters, or four times up to 20, blanks not counted.
    """
    key = F.regexp_replace("line", r"\s+", "")
    plain = lines.where(~F.col("edge") & (F.col("line") != "")).groupBy(id_col, key.alias("key")).agg(F.count("*").alias("n"))
    size = F.length("key")
    often = plain.where(((F.col("n") >= 6) & (size <= 80)) | ((F.col("n") >= 4) & (size <= 20))).select(id_col, "key", F.lit(True).alias("often"))
    rows = lines.withColumn("key", key).join(often, [id_col, "key"], "left")
    line, n = F.col("line"), F.length("line")
    day, month = DATES
    odd = F.coalesce("often", F.lit(False)) | line.rlike("^[0-9]{1,2}$") | line.rlike("^[0-9]{1,2}[-/][0-9]{1,2}$") | (line.rlike(day) & (n <= 120)) | (F.regexp_count(line, F.lit(day)) >= 2) | (line.rlike(month) & (n <= 60))
    return rows.withColumn("line", F.when(line.rlike(PAGE_MARK) | (~F.col("edge") & odd), "").otherwise(line)).drop("key", "often")


def joined_lines(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``lines`` without blanks, where hard-wrapped documents have lines joined to the one they go on from: doc id, pos, line, top, edge, apart (a blank line before it).

    A document is hard-wrapped if it has 30 lines, under 8 % blanks, a mean length up to 80, and at most 60 % of its lines end with a mark. A line goes on from the one
    before unless either begins a part or item or looks like a table row, a blank stands between, or the one before ends with a mark.
    """
    full = F.col("line") != ""
    ends = F.col("line").rlike(f"[{END_MARKS}]$")
    sums = lines.groupBy(id_col).agg(F.count_if(full).alias("n"), F.count("*").alias("every"), F.sum(F.length("line")).alias("chars"), F.count_if(ends).alias("marked"))
    n = F.col("n")
    wrapped = (n >= 30) & ((F.col("every") - n) / F.col("every") < 0.08) & (F.col("chars") / n <= 80) & (F.col("marked") / n <= 0.6)
    order = Window.partitionBy(id_col).orderBy("pos")
    rows = lines.withColumn("blank_before", F.lag(~full, 1, True).over(order)).where(full).join(sums.select(id_col, F.coalesce(wrapped, F.lit(False)).alias("wrapped")), id_col)
    before = lambda c, default: F.lag(c, 1, default).over(order)
    rows = rows.withColumns({"tabular": table_line(F.col("line")), "ends": ends})
    new = ~F.col("wrapped") | F.col("blank_before") | F.col("edge") | before("edge", True) | F.col("tabular") | before("tabular", True) | before("ends", True)
    rows = rows.withColumn("group", F.sum(new.cast("int")).over(order))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "")
    return rows.groupBy(id_col, "group").agg(F.min("pos").alias("pos"), whole.alias("line"), F.min_by("top", "pos").alias("top"), F.min_by("edge", "pos").alias("edge"), F.min_by("blank_before", "pos").alias("apart")).drop("group")


def blocks(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc id, part, block, heading (of the part, null before the first), text: a block for each item of a part; headings stand in their column alone."""
    order = Window.partitionBy(id_col).orderBy("pos")
    rows = lines.withColumn("part", F.sum(F.col("top").cast("int")).over(order))
    inside = Window.partitionBy(id_col, "part").orderBy("pos")
    rows = rows.withColumn("heading", F.first(F.when(F.col("top"), F.col("line"))).over(inside))
    rows = rows.withColumn("block", F.sum((F.col("edge") & ~F.col("top")).cast("int")).over(inside))
    body = F.array_compact(F.transform(F.array_sort(F.collect_list(F.when(~F.col("top"), F.struct("pos", "line")))), lambda x: x["line"]))
    return rows.groupBy(id_col, "part", "block").agg(F.first("heading").alias("heading"), F.array_join(body, "\n").alias("text"))


def packed(rows: DataFrame, keys: list[str], pieces: str, heading: str, target: int) -> DataFrame:
    """The first key, ``chunk_index``, ``heading`` and ``text``: pieces of a part joined up to ``target`` characters, in the order of the further keys.

    ``keys``: what is numbered, the part that is packed on its own, and the order inside it. Rows are dealt by the first key and sorted; a task follows them one by one and holds a single chunk, so the work grows as the
    text and a document of any size fits. A part whose pieces are all blank is a chunk with its heading, if it has one.
    """
    owner, part, *order = keys
    kind = rows.schema[owner].dataType
    dealt = rows.select(owner, part, *order, heading, pieces).repartition(owner).sortWithinPartitions(owner, part, *order).select(owner, part, heading, pieces)
    schema = StructType([StructField(owner, kind), StructField("chunk_index", LongType()), StructField("heading", StringType()), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head, held, size, said, index, out = None, None, [], 0, True, 0, []

        def close() -> None:
            nonlocal held, size, said, index
            text = "".join(held).strip()
            held, size = [], 0
            if text:
                out.append((at[0], index, head, text))
                index += 1
                said = True

        def end() -> None:
            nonlocal said, index
            close()
            if not said and head:
                out.append((at[0], index, head, head))
                index += 1

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (arrow, pa.int64(), pa.string(), pa.string()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        arrow = None
        for b in batches:
            arrow = b.column(0).type
            for i in range(b.num_rows):
                o, p, h, some = (b.column(c)[i].as_py() for c in range(4))
                if at != (o, p):
                    if at is not None:
                        end()
                    index = index if at is not None and at[0] == o else 0
                    at, head, said = (o, p), h, False
                for piece in some:
                    if held and size + len(piece) > target:
                        close()
                    held.append(piece)
                    size += len(piece)
                if len(out) >= 1000:
                    yield batch()
                    out.clear()
        if at is not None:
            end()
        if out:
            yield batch()

    return dealt.mapInArrow(run, schema)


def regulation_chunks(docs: DataFrame, target: int = 600, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, chunk_index, heading, text: blocks of a part packed up to ``target`` characters; a block over 1.25 times that is cut at its sentences, and anywhere if one is as long.

    A part of a heading alone is a chunk with that heading as its text. Null and empty texts have none; the lines of rows that repeat an id are taken together.
    """
    most = int(target * 1.25)
    rows = blocks(joined_lines(without_noise(text_lines(docs, id_col, text_col), id_col), id_col), id_col)
    sentences = F.regexp_extract_all("text", F.lit(f"(?s)([^。！？；.!?;\n]*[。！？；.!?;\n]+|[^。！？；.!?;\n]+)"), F.lit(1))
    hard = F.flatten(F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(f"(?s)(.{{1,{most}}})"), F.lit(1))))
    rows = rows.withColumn("pieces", F.when(F.length("text") > most, hard).otherwise(F.array(F.concat("text", F.lit("\n")))))
    return packed(rows, [id_col, "part", "block"], "pieces", "heading", target)
