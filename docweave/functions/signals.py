"""Column functions that say what a piece of text looks like: sentences, lists, facts, titles, tables, filler."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .text import CJK, WHITE, collapse, given, strip, title_parts

# Words and marks that signal (fixed values).
SENTENCE_MARKS = "。！？!?；;:："
SENTENCE_WORDS = "is are means includes shall must should require requires".split()
FACT_WORDS = "define defines defined include includes included require requires required condition process step standard".split()
FACT_WORDS_ZH = "定义为 是指 包括 包含 适用于 应当 必须 不得 要求 标准 条件 流程 步骤 范围".split()
UNITS = "% 元 万 小时 天 kg km m GB MB".split()
FILLER_WORDS = "图片 图像 图示 截图 附件 二维码 扫描件 占位 见图 见附件 image figure attachment placeholder".split()
STRUCTURE_WORDS = "流程 步骤 条件 材料 范围 规则 标准 要求 对比 分类 组成 清单 目录 适用 定义 process step condition rule standard requirement compare category definition".split()
NUMERALS_ZH = "一二三四五六七八九十"
PART_NAMES_ZH = "章节条部分篇"

#: A list item begins with a bullet, with a number and a mark, or with a Chinese number and a mark, and has something after it.
LIST_ITEM = "(?m)^[ \t]*(?:" + "|".join(("[-*•]", "[0-9]+[.)、]", f"[{NUMERALS_ZH}]+[、.]")) + ")[ \t]*[^ \t\n]"


def any_of(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


#: A boundary between ASCII letters, digits and underscores, and all else. Java's own takes letters of any script for the former, other engines don't.
EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"


def word_of(pattern: str) -> str:
    """Words of a pattern between such boundaries."""
    return f"(?<![0-9A-Za-z_])(?:{pattern})(?![0-9A-Za-z_])"


def lines(text: Column) -> Column:
    """Lines that are not blank, trimmed."""
    return F.filter(F.transform(F.split(text, "\r?\n|\r"), strip), lambda x: x != "")


def has_sentence(text: Column) -> Column:
    return text.rlike(f"[{SENTENCE_MARKS}]") | text.rlike(f"(?i){word_of('|'.join(SENTENCE_WORDS))}")


def has_list(text: Column) -> Column:
    return text.rlike(LIST_ITEM)


def has_facts(text: Column) -> Column:
    """A sentence, a list, a date, an amount with a unit, or a word that states something."""
    date, amount = r"[0-9]{4}[-年/][0-9]{1,2}", rf"(?i)[0-9]+(?:\.[0-9]+)?\s*{any_of(UNITS)}"
    said = f"(?i){word_of('|'.join((*FACT_WORDS, 'applies to')))}"
    return reduce(lambda a, b: a | b, [has_sentence(text), has_list(text), *[text.rlike(p) for p in (date, amount, any_of(FACT_WORDS_ZH), said)]])


def structure(text: Column) -> Column:
    return text.rlike(f"(?i){any_of(STRUCTURE_WORDS)}")


def placeholder(text: Column) -> Column:
    """Nothing, or a short mention of a picture or attachment that states nothing."""
    clean = collapse(text)
    return (clean == "") | (clean.rlike(f"(?i){any_of(FILLER_WORDS)}") & (F.length(clean) <= 160) & ~has_facts(clean))


def title_only(text: Column, path: Column) -> Column:
    """At most two lines that are the last title, or short without a sentence or list, or a numbered heading."""
    clean = collapse(text)
    last = F.coalesce(F.try_element_at(title_parts(path), F.lit(-1)), F.lit(""))
    numbered = rf"^(?:第?[{NUMERALS_ZH}0-9]+[{PART_NAMES_ZH}].{{0,40}}|[0-9.、\s]{{1,12}}\S{{0,40}})$"
    short = (F.length(clean) <= 48) & ~has_sentence(clean) & ~has_list(clean)
    return (clean == "") | ((F.size(lines(text)) <= 2) & (((last != "") & (clean == last)) | short | clean.rlike(numbered)))


def table_rows(text: Column) -> Column:
    """Half of the lines, one at least, look like rows of a table."""
    row = lambda x: x.rlike("[|\t]") | ((F.size(F.split(x, r"\s{2,}|,|，")) >= 3) & ~has_sentence(x))
    return given(lines(text), lambda every: (F.size(every) > 0) & (F.size(F.filter(every, row)) >= F.greatest(F.lit(1), F.floor(F.size(every) / 2))))


def table_fragment(text: Column) -> Column:
    """Looks like rows of a table and states nothing."""
    return table_rows(text) & ~has_facts(text)


def symbol_share(text: Column) -> Column:
    """Share of characters that are neither letters nor blanks; 1 for an empty text."""
    clean = collapse(text)
    odd = F.length(F.regexp_replace(clean, rf"[\p{{L}}{CJK} ]", ""))
    return F.when(clean == "", 1.0).otherwise(odd / F.length(clean))


# ---- all of these at once, by Arrow's regular expressions: they read a text once, whatever the number of words, and bound words by ASCII letters

_SENTENCE = rf"[{SENTENCE_MARKS}]|(?i:\b{any_of(SENTENCE_WORDS)}\b)"
_FACTS = "|".join((
    _SENTENCE, f"(?:{LIST_ITEM})", r"[0-9]{4}[-年/][0-9]{1,2}", rf"(?i:[0-9]+(?:\.[0-9]+)?\s*{any_of(UNITS)})", any_of(FACT_WORDS_ZH), rf"(?i:\b{any_of([*FACT_WORDS, 'applies to'])}\b)",
))
_NUMBERED = rf"^(?:第?[{NUMERALS_ZH}0-9]+[{PART_NAMES_ZH}].{{0,40}}|[0-9.、\s]{{1,12}}\S{{0,40}})$"
MARKS = "facts boolean, lists boolean, structure boolean, filler boolean, title boolean, table boolean, odd double, size int"


def marks_here(text: pa.Array, last: pa.Array) -> pa.StructArray:
    """``MARKS`` of texts that are not null, as the column functions above name them; ``last`` is the last part of a text's title path, or empty."""
    has = lambda x, pattern: pc.match_substring_regex(x, pattern).to_numpy(zero_copy_only=False).astype(bool)
    length = lambda x: pc.utf8_length(x).to_numpy(zero_copy_only=False)
    clean = pc.utf8_trim(pc.replace_substring_regex(text, f"[{WHITE}]+", " "), " ")
    size, facts, lists = length(clean), has(text, _FACTS), has(text, LIST_ITEM)
    blank = size == 0
    odd = np.where(blank, 1.0, length(pc.replace_substring_regex(clean, rf"[\p{{L}}{CJK} ]+", "")) / np.maximum(size, 1))
    filler = blank.copy()
    short = np.flatnonzero(~blank & (size <= 160))  # texts that may be filler or titles are few
    some = clean.take(pa.array(short))
    filler[short] = has(some, f"(?i){any_of(FILLER_WORDS)}") & ~has(some, _FACTS)
    split = pc.split_pattern_regex(text, "\r?\n|\r")
    at, rows = np.repeat(np.arange(len(text)), split.value_lengths().to_numpy(zero_copy_only=False)), pc.replace_substring_regex(split.flatten(), f"^[{WHITE}]+|[{WHITE}]+$", "")
    filled = pc.not_equal(rows, "").to_numpy(zero_copy_only=False).astype(bool)
    parted = pc.count_substring_regex(rows, r"\s{2,}|,|，").to_numpy(zero_copy_only=False) >= 2
    row = filled & (has(rows, "[|\t]") | (parted & ~has(rows, _SENTENCE)))
    n, n_rows = np.bincount(at[filled], minlength=len(text)), np.bincount(at[row], minlength=len(text))
    title = blank.copy()
    few = np.flatnonzero(~blank & (n <= 2))
    some, name = clean.take(pa.array(few)), last.take(pa.array(few))
    named = pc.and_(pc.not_equal(name, ""), pc.equal(some, name)).to_numpy(zero_copy_only=False).astype(bool)
    title[few] = named | ((size[few] <= 48) & ~has(some, _SENTENCE) & ~has(some, LIST_ITEM)) | has(some, _NUMBERED)
    table = (n > 0) & (n_rows >= np.maximum(1, n // 2)) & ~facts
    columns = (facts, lists, has(text, f"(?i){any_of(STRUCTURE_WORDS)}"), filler, title, table, odd, size.astype(np.int32))
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], [f.split()[0] for f in MARKS.split(", ")])


def marks(text: Column, path: Column) -> Column:
    """Struct ``MARKS`` of a text under a title path: has_facts, has_list, structure, placeholder, title_only, table_fragment, symbol_share and the length of the collapsed text. Nulls are empty."""

    @arrow_udf(f"struct<{MARKS.replace(' ', ':').replace(',:', ',')}>")
    def run(texts: pa.Array, lasts: pa.Array) -> pa.Array:
        return marks_here(texts, lasts)

    last = F.coalesce(F.try_element_at(title_parts(path), F.lit(-1)), F.lit(""))
    return run.asNondeterministic()(F.coalesce(text, F.lit("")), last)  # computed once
