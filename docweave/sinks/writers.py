"""Writers: records for stores, reports and exports. Each returns the rows it writes where it also says what to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import cut_bytes, without_markdown
from ..operators.consolidation import flattened_variants
from ..operators.records import replace_by_id

#: Heads of the exam table, in order, and the columns they show (fixed values).
EXAM = (
    ("知识类别", "knowledge_category"), ("题目类型", "question_type"), ("题干", "question"), ("相似问向", "similar_questions"), ("答案", "answer"),
    ("答案解释", "answer_explanation"), ("题目难度", "difficulty_level"), ("题目来源-相关文件", "original_filename"), ("题目来源-相关段落", "source"), ("备注", "remark"),
)
#: Names of the scores in a remark, and their columns (fixed values).
REMARKS = (("平均得分", "average_score"), ("忠实度", "faithfulness"), ("可回答性", "answerability"), ("覆盖召回(soft)", "coverage_recall_soft"), ("CoverageSelf", "coverage_self"), ("Coverage", "coverage_score"), ("无监督F1", "unsupervised_f1"))


def remark(items: DataFrame) -> Column:
    """Model, method, number of evidence chunks and the scores there are, with four digits, joined by semicolons. Columns that are missing are left out."""
    there = set(items.columns)
    said = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}: "), c))
    parts = [said(n, F.col(c).cast("string")) for n, c in (("模型", "llm_model"), ("评估", "evaluation_method")) if c in there]
    if "evidence_chunk_ids" in there:
        parts.append(F.when(F.col("evidence_chunk_ids").isNotNull(), F.concat(F.lit("补充证据块: "), F.size("evidence_chunk_ids").cast("string"))))
    parts += [said(n, F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c).cast("double")))) for n, c in REMARKS if c in there]
    return F.concat_ws("；", *parts) if parts else F.lit("")


def exam_rows(items: DataFrame) -> DataFrame:
    """Items under the ten heads of the exam table; nulls and missing columns are empty, similar questions (an array) are joined by " || "."""
    rows = items.withColumn("remark", remark(items))
    if "similar_questions" in items.columns:
        rows = rows.withColumn("similar_questions", F.array_join(F.filter("similar_questions", lambda q: q != ""), " || "))
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit("")
    empty = {"source": "文本内容"}
    return rows.select(*[F.when((value(c) == "") & F.lit(c in empty), empty.get(c, "")).otherwise(value(c)).alias(head) for head, c in EXAM])


def write_exam_csv(items: DataFrame, path: str) -> None:
    exam_rows(items).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def store_rows(items: DataFrame, most_bytes: dict[str, int], id_col: str = "id", variants: str = "variants") -> DataFrame:
    """Rows of a vector store: primaries and variants alike, the text to embed, and texts cut to what their field holds in bytes."""
    flat = flattened_variants(items, variants, key=id_col) if variants in items.columns else items
    flat = flat.withColumn("to_embed", F.concat_ws(" [SEP] ", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit(""))))
    return flat.withColumns({c: cut_bytes(F.col(c), n) for c, n in most_bytes.items() if c in flat.columns})


def chunk_rows(chunks: DataFrame, most: dict[str, int]) -> DataFrame:
    """Chunks with texts cut to so many characters."""
    return chunks.withColumns({c: F.substring(c, 1, n) for c, n in most.items() if c in chunks.columns})


def replace_table(old: DataFrame, new: DataFrame, key: str, path: str) -> None:
    """Writes ``old`` with the rows of ``new`` in place of its own to another path."""
    replace_by_id(old, new, key).write.mode("overwrite").parquet(path)


def export_rows(rows: DataFrame, meta: DataFrame, key: str, drop: tuple[str, ...] = ("vector", "embedding_vector")) -> DataFrame:
    """Rows without their vectors, with the side table as a struct ``meta`` (null without a row)."""
    side = meta.select(key, F.struct(*[c for c in meta.columns if c != key]).alias("meta"))
    return rows.drop(*drop).join(side, key, "left")


def chunk_files(chunks: DataFrame, name: Column, id_col: str = "doc_id") -> DataFrame:
    """``file``, ``text`` of one file for each chunk: the stem of its document and its number, under a line that says which part it is."""
    n = chunks.groupBy(id_col).agg(F.count("*").alias("n"))
    rows = chunks.join(n, id_col)
    place = F.col("chunk_index") + 1
    head = F.format_string("<!-- part %d of %d -->\n\n", place, F.col("n"))
    return rows.select(F.concat(name, F.format_string("_part%03d.md", place)).alias("file"), F.concat(head, "text").alias("text"))


def detail_levels(levels: list[Column], minimal: Column, most_bytes: int) -> Column:
    """The first of the columns, from the fullest down, whose JSON fits in ``most_bytes``; the minimal one if none does."""
    fits = [F.when(F.octet_length(F.to_json(x)) <= most_bytes, F.to_json(x)) for x in levels]
    return F.coalesce(*fits, F.to_json(minimal))


def plain_rows(rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with Markdown taken out of a column."""
    return rows.withColumn(column, without_markdown(F.col(column)))
