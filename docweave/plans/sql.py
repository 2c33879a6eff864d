"""Pieces of SQL that the named queries' SQL shares: the same rules as the column functions, written out."""

from __future__ import annotations

from ..functions import signals as S
from ..functions import text as T

#: Documents cut every n characters.
FIXED = "SELECT doc_id, generate_subscripts(p, 1) - 1 AS chunk_index, unnest(p) AS text FROM (SELECT doc_id, list_transform(range(0, length(text), {n}), lambda i: substr(text, i + 1, {n})) AS p FROM documents WHERE length(text) > 0)"
#: Turns of a user that an assistant answers.
PAIRS = "SELECT conv_id, turn, text AS question, nr AS role2, nt AS answer FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user' AND nr = 'assistant'"


def collapse_sql(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{T.WHITE}]+', ' ', 'g'), ' ')"


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{T.WHITE}]+|[{T.WHITE}]+$', '', 'g')"


def normalised_sql(c: str) -> str:
    return f"trim(regexp_replace({collapse_sql(f'lower({c})')}, '[^\\p{{L}}\\p{{N}}_ ]+', '', 'g'), ' ')"


def metric_tokens_sql(c: str) -> str:
    t = strip_sql(f"coalesce({c}, '')")
    return f"list_filter(CASE WHEN regexp_matches({t}, '[{T.WHITE}]') THEN regexp_split_to_array({t}, '[{T.WHITE}]+') ELSE string_split({t}, '') END, lambda x: x <> '')"


def _grams(s: str, n: int) -> str:
    return f"list_transform(range(1, length({s}) - {n - 2}), lambda i: substr({s}, i, {n}))"


def _tokens(c: str, of_cjk: str) -> str:
    words = "CASE WHEN length(s) >= 2 THEN [s] ELSE [] END"
    return f"flatten(list_transform(regexp_extract_all(lower({c}), '[a-z0-9_]+|[{T.CJK}]+'), lambda s: CASE WHEN regexp_matches(s, '^[a-z0-9_]') THEN {words} ELSE {of_cjk} END))"


def tokens_sql(c: str) -> str:
    return _tokens(c, f"CASE WHEN length(s) = 1 THEN [s] ELSE list_concat({_grams('s', 2)}, {_grams('s', 3)}) END")


def quality_tokens_sql(c: str) -> str:
    return f"list_distinct({_tokens(c, f'CASE WHEN length(s) <= 2 THEN [s] ELSE {_grams(chr(115), 2)} END')})"


def sentences_sql(c: str, least: int) -> str:
    parts = f"list_transform(regexp_extract_all({c}, '[^.!?;。！？；]+[.!?;。！？；]*'), lambda x: {collapse_sql('x')})"
    return f"list_filter({parts}, lambda x: length(x) >= {least})"


def _has(c: str, *patterns: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, '{p}')" for p in patterns) + ")"


def has_sentence_sql(c: str) -> str:
    return _has(c, f"[{S.SENTENCE_MARKS}]", rf"(?i)\b{S.any_of(S.SENTENCE_WORDS)}\b")


def has_facts_sql(c: str) -> str:
    said = rf"(?i)\b(?:{'|'.join(S.FACT_WORDS)}|applies to)\b"
    more = _has(c, S.LIST_ITEM, r"[0-9]{4}[-年/][0-9]{1,2}", rf"(?i)[0-9]+(?:\.[0-9]+)?\s*{S.any_of(S.UNITS)}", S.any_of(S.FACT_WORDS_ZH), said)
    return f"({has_sentence_sql(c)} OR {more})"


def chunk_faults() -> str:
    """Common table expressions after ``a`` (doc_id, chunk_index, text, adjacent), the last one ``s`` with quality and status; chunks without titles."""
    numbered = rf"^(?:第?[{S.NUMERALS_ZH}0-9]+[{S.PART_NAMES_ZH}].{{0,40}}|[0-9.、\s]{{1,12}}\S{{0,40}})$"
    row = rf"(regexp_matches(x, '[|\t]') OR (len(regexp_split_to_array(x, '\s{{2,}}|,|，')) >= 3 AND NOT {has_sentence_sql('x')}))"
    off = lambda c, v: f"- CASE WHEN {c} THEN CAST({v} AS DOUBLE) ELSE 0 END"
    return f"""f AS (SELECT *, {collapse_sql("text")} AS clean, {has_facts_sql("text")} AS facts, {_has("text", S.LIST_ITEM)} AS lists, {_has("text", f"(?i){S.any_of(S.STRUCTURE_WORDS)}")} AS structured,
      list_filter(list_transform(regexp_split_to_array(text, '\r?\n|\r'), lambda x: {strip_sql("x")}), lambda x: x <> '') AS rows_ FROM a),
    g AS (SELECT *, length(clean) AS n, clean = '' OR (len(rows_) <= 2 AND ((length(clean) <= 48 AND NOT {has_sentence_sql("clean")} AND NOT {_has("clean", S.LIST_ITEM)}) OR regexp_matches(clean, '{numbered}'))) AS title_only,
      clean = '' OR ({_has("clean", f"(?i){S.any_of(S.FILLER_WORDS)}")} AND length(clean) <= 160 AND NOT {has_facts_sql("clean")}) AS filler,
      len(rows_) > 0 AND len(list_filter(rows_, lambda x: {row})) >= greatest(1, len(rows_) // 2) AND NOT facts AS tabular,
      CASE WHEN clean = '' THEN 1.0 ELSE length(regexp_replace(clean, '[\\p{{L}}{T.CJK} ]', '', 'g')) / length(clean) END AS odd FROM f),
    s AS (SELECT doc_id, chunk_index, quality, CASE WHEN clean = '' OR filler OR (title_only AND NOT facts) THEN 'drop' WHEN tabular OR quality < 0.52 OR (adjacent >= 0.90 AND NOT facts) THEN 'context_only' ELSE 'usable' END AS status
      FROM (SELECT *, round(greatest(0, least(1, CAST(1.0 AS DOUBLE) {off("n < 80 AND NOT lists", 0.35)} {off("title_only", 0.30)} {off("tabular", 0.25)} {off("filler", 0.25)} {off("adjacent >= 0.84", 0.20)} {off("odd >= 0.48 AND n < 320", 0.15)}
        + CASE WHEN structured OR facts THEN CAST(0.10 AS DOUBLE) ELSE 0 END)), 6) AS quality FROM g))"""


def vector_sql(c: str, size: int = 64) -> str:
    """Unit vector of hashed token counts."""
    places = f"list_transform({tokens_sql(f'coalesce({c}, {chr(39) * 2})')}, lambda t: CAST('0x' || substr(md5(t), 1, 4) AS INT) % {size})"
    counts = f"list_transform(range(0, {size}), lambda d: CAST(len(list_filter({places}, lambda p: p = d)) AS DOUBLE))"
    return counts


def unit_sql(c: str) -> str:
    """A vector of doubles with length one; zero stays zero."""
    return f"list_transform({c}, lambda x: CASE WHEN list_dot_product({c}, {c}) > 0 THEN x / sqrt(list_dot_product({c}, {c})) ELSE 0.0 END)"
