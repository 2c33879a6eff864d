"""Named queries of evidence, coverage, validation, classification, suites, consolidation and writers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions.shared import bound_batches, stored
from ..operators import chunking, classify, consolidation, coverage, evidence, items, planning, scoring, suite
from ..sinks import writers
from ..sources import readers
from ..sources.readers import table
from .named import _pairs, named, unchecked
from .sql import FIXED, PAIRS, collapse_sql, strip_sql, tokens_sql, unit_sql, vector_sql

# ---- evidence: every chunk whose id is divisible by 50 asks for evidence in its document

_TERMS = ("license", "version")


def _chunks(spark, d) -> DataFrame:
    bound_batches(spark)
    title = F.concat_ws(" > ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL").select(F.struct("doc_id", title.alias("title_path")).alias("key"), "text")
    rows = chunking.fixed(docs, 600, "key")
    rows = rows.select("key.doc_id", "chunk_index", F.floor(F.col("chunk_index") / 4).cast("string").alias("parent"), "key.title_path", "text")
    return stored(evidence.with_hashed_vectors(rows, vector="text"), "chunks")


def _questions(chunks: DataFrame) -> DataFrame:
    rows = chunks.withColumn("query_id", F.col("doc_id") * 100000 + F.col("chunk_index")).where("query_id % 50 = 0")
    scope = F.element_at(F.array(*map(F.lit, evidence.SCOPES)), (F.col("doc_id") % 3 + 1).cast("int"))
    return rows.select("query_id", "doc_id", F.col("chunk_index").alias("source_index"), F.col("text").alias("query"), F.array(*map(F.lit, _TERMS)).alias("terms"), "vector", scope.alias("scope"))


_RANK = f"""WITH c AS ({FIXED.format(n=600)}), v AS (SELECT doc_id, chunk_index, text, {vector_sql("text")} AS n FROM c),
    k AS (SELECT v.doc_id, chunk_index, chunk_index // 4 AS parent, coalesce(source, '') || ' > ' || coalesce(lang, '') AS title_path, v.text, {unit_sql("n")} AS u FROM v JOIN documents d ON v.doc_id = d.doc_id),
    q AS (SELECT doc_id * 100000 + chunk_index AS query_id, doc_id, chunk_index AS source_index, parent AS source_parent, text AS query, u AS qu, ['source_primary', 'same_section', 'cross_chunk'][doc_id % 3 + 1] AS scope FROM k WHERE (doc_id * 100000 + chunk_index) % 50 = 0),
    t AS (SELECT doc_id, chunk_index, unnest(list_distinct({tokens_sql("text")})) AS token FROM k), n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1), f AS (SELECT doc_id, token, count(*) AS df FROM t GROUP BY ALL),
    w AS (SELECT query_id, doc_id, unnest(list_distinct(list_concat({tokens_sql("query")}, ['{_TERMS[0]}', '{_TERMS[1]}']))) AS token FROM q),
    i AS (SELECT query_id, w.doc_id, w.token, coalesce(ln((n + 1) / (df + 0.5)) + 1, 1.0) AS idf FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN f ON w.doc_id = f.doc_id AND w.token = f.token),
    z AS (SELECT query_id, sum(idf) AS total FROM i GROUP BY 1),
    o AS (SELECT i.query_id, chunk_index, sum(idf) / any_value(total) AS overlap FROM i JOIN t ON i.doc_id = t.doc_id AND i.token = t.token JOIN z ON i.query_id = z.query_id GROUP BY ALL),
    p AS (SELECT q.query_id, k.chunk_index, round(list_dot_product(qu, u), 9) AS dense, coalesce(overlap, 0) AS overlap, scope, k.parent = source_parent AS same, abs(k.chunk_index - source_index) = 1 AS beside, k.chunk_index = source_index AS own,
      (CAST(contains(lower(title_path || chr(10) || text), '{_TERMS[0]}') AS INT) + CAST(contains(lower(title_path || chr(10) || text), '{_TERMS[1]}') AS INT)) / 2 AS cover, CASE WHEN replace(title_path, ' > ', '') = '' THEN 0 ELSE 1 END AS titles
      FROM q JOIN k ON q.doc_id = k.doc_id LEFT JOIN o ON o.query_id = q.query_id AND o.chunk_index = k.chunk_index),
    l AS (SELECT *, round(least(1, 0.75 * overlap + 0.25 * cover), 9) AS lexical FROM p),
    s AS (SELECT *, round(least(1, CASE WHEN same THEN 0.55 ELSE 0 END + CASE WHEN beside THEN 0.25 ELSE 0 END + 0.20 * titles + CASE WHEN same AND scope <> 'source_primary' THEN 0.15 ELSE 0 END + CASE WHEN scope = 'cross_chunk' AND lexical > 0 THEN 0.08 ELSE 0 END), 9) AS structure FROM l),
    x AS (SELECT *, round(0.68 / (0.68 + 0.24) * greatest(0, least(1, (dense + 1) / 2)) + 0.24 / (0.68 + 0.24) * lexical + 0.08 * structure, 9) AS fused FROM s),
    dr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, chunk_index) AS dense_rank FROM x), lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, dense_rank) AS lexical_rank FROM dr),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, CASE WHEN dense_rank <= 12 THEN dense_rank ELSE 12 + lexical_rank END) AS rank FROM lr WHERE dense_rank <= 12 OR lexical_rank <= 12)"""


@named(f"{_RANK} SELECT query_id, chunk_index, round(dense, 6) AS dense, round(lexical, 6) AS lexical, round(structure, 6) AS structure, round(fused, 6) AS fused, dense_rank, lexical_rank, rank FROM r")
def evidence_rank(spark, d):
    chunks = _chunks(spark, d)
    rows = evidence.ranked(evidence.scored_pairs(chunks, _questions(chunks)))
    return rows.select("query_id", "chunk_index", *[F.round(c, 6).alias(c) for c in ("dense", "lexical", "structure", "fused")], *[F.col(c).cast("long").alias(c) for c in ("dense_rank", "lexical_rank", "rank")])


@named(f"""{_RANK}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS hit FROM r WHERE NOT own)
    SELECT query_id, chunk_index, round(fused, 6) AS fused, hit AS rank FROM h WHERE hit <= 3""")
def hybrid_rank_topk(spark, d):
    """The three best chunks of each question's document beside its source, by dense, lexical and structural scores."""
    chunks = _chunks(spark, d)
    found = evidence.hits(evidence.ranked(evidence.scored_pairs(chunks, _questions(chunks))))
    return found.select("query_id", "chunk_index", F.round("fused", 6).alias("fused"), F.col("hit").cast("long").alias("rank"))


@unchecked
def evidence_select(spark, d):
    """The chunks that the evidence supports under a budget, with their roles; tested against plain Python."""
    chunks = _chunks(spark, d)
    questions = _questions(chunks)
    rank = stored(evidence.ranked(evidence.scored_pairs(chunks, questions)), "ranked")
    return evidence.selected(evidence.hits(rank), evidence.scope_decision(rank, questions, "cross_chunk"), chunks, 2000)


# ---- coverage: units of a conversation's answers against its questions with answers


def _units(spark, d) -> DataFrame:
    bound_batches(spark)
    texts = table(spark, d, "conversations").where("role = 'assistant'").withColumn("key", F.struct("conv_id", "turn"))
    rows = chunking.units(texts, 10, 256, "key", "text").select("key.conv_id", F.concat_ws("/", F.col("key.turn").cast("string"), F.col("unit").cast("string")).alias("unit"), "text")
    return stored(evidence.with_hashed_vectors(rows, vector="text"), "units")


def _asked(spark, d) -> DataFrame:
    p = _pairs(spark, d).withColumn("both", F.concat_ws("\n", "question", "answer"))
    p = evidence.with_hashed_vectors(p, vector="both", question_vector="question", answer_vector="answer")
    return stored(p.select("conv_id", F.col("turn").alias("item"), "answer", "vector", "question_vector", "answer_vector"), "asked")


@unchecked
def coverage_recall(spark, d):
    """Recall of every conversation's units, calibrated by units against the nearest other conversation; tested against plain Python."""
    units, asked = _units(spark, d), _asked(spark, d)
    return coverage.coverage_recall(coverage.best_similarity(units, asked, "conv_id"), coverage.negatives(units, asked, "conv_id"), "conv_id")


@unchecked
def coverage_self(spark, d):
    units, asked = _units(spark, d), _asked(spark, d)
    chance = stored(coverage.negatives(units, asked, "conv_id"), "chance")
    recall = coverage.coverage_recall(coverage.best_similarity(units, asked, "conv_id"), chance, "conv_id")
    return coverage.coverage_self(units, asked, chance, recall, "conv_id")


@named(f"""WITH t AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t ]+', ' ', 'g') AS t FROM conversations WHERE role = 'assistant'),
    b AS (SELECT conv_id, turn, string_split(regexp_replace(chr(10) || t, '\n[ ]*({chunking.STRONG_HEADS})', chr(1) || '\\1', 'g'), chr(1)) AS b FROM t),
    p AS (SELECT conv_id, turn, list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '[ ]*\n+[ ]*', ' ', 'g'), ' ')), lambda x: x <> '') AS b FROM b),
    u AS (SELECT conv_id, turn, flatten(list_transform(b, lambda x: CASE WHEN len(list_filter(regexp_extract_all(x, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+'), lambda y: trim(y, ' ') <> '')) <= 1 AND length(x) >= 120
      THEN regexp_extract_all(x, '[^，,；;]*[，,；;]|[^，,；;]+') ELSE regexp_extract_all(x, '[^。！？!?；;]*[。！？!?；;]|[^。！？!?；;]+') END)) AS u FROM p),
    f AS (SELECT conv_id, turn, list_filter(list_transform(u, lambda x: trim(x, ' ')), lambda x: length(x) >= 10)[1:256] AS u FROM u)
    SELECT conv_id, turn, CAST(len(list_distinct(u)) AS BIGINT) AS n_units, coalesce(list_sum(list_transform(list_distinct(u), lambda x: length(x))), 0)::BIGINT AS n_chars FROM f WHERE len(u) > 0""")
def unit_counts(spark, d):
    texts = table(spark, d, "conversations").where("role = 'assistant'").withColumn("key", F.struct("conv_id", "turn"))
    return chunking.units(texts, 10, 256, "key", "text").groupBy("key.conv_id", "key.turn").agg(F.count("*").alias("n_units"), F.sum(F.length("text")).cast("long").alias("n_chars"))


# ---- items

_AMB = rf"'(?is)^(.*?)\b({'|'.join(items.POINTING_EN)})\b(.*)$'"


def _ambiguous(c: str) -> str:
    verb = f"regexp_extract(lower({strip_sql(f'regexp_extract({c}, {_AMB}, 3)')}), '^([a-z][a-z0-9_-]*)', 1)"
    verbs = ", ".join(f"'{v}'" for v in items.VERBS_EN)
    word = f"lower(regexp_extract({c}, {_AMB}, 2))"
    return rf"({word} <> '' AND CASE WHEN {word} IN ('this', 'that') AND regexp_matches({c}, '(?i)\b(?:this|that)\s+[a-z][a-z0-9_-]{{2,}}\b') THEN {verb} IN ({verbs}) ELSE true END)"


@named(f"""WITH p AS (SELECT conv_id, turn, {strip_sql("coalesce(question, '')")} AS q, {strip_sql("coalesce(answer, '')")} AS a, CASE WHEN turn % 4 = 2 THEN '' ELSE {strip_sql("coalesce(answer, '')")} END AS e FROM ({PAIRS}))
    SELECT conv_id, turn, CASE WHEN q = '' THEN 'missing_question' WHEN e = '' THEN 'missing_answer_explanation' WHEN a = '' THEN 'missing_source_fact_text' WHEN {_ambiguous("q")} THEN 'ambiguous_reference_question'
      WHEN {_ambiguous("a")} THEN 'ambiguous_reference_answer' ELSE 'ok' END AS reason FROM p""")
def item_validate_reason(spark, d):
    """The first reason to refuse a conversation's pair as an item; every other one of the later turns lacks its explanation."""
    rows = _pairs(spark, d).withColumns({"explanation": F.when(F.col("turn") % 4 == 2, "").otherwise(F.col("answer")), "fact": F.col("answer")})
    return items.validated(rows, "en").select("conv_id", "turn", "reason")


@named(f"""WITH p AS (SELECT conv_id, turn, lower({strip_sql("question")}) AS q FROM ({PAIRS}))
    SELECT conv_id, turn, regexp_matches(q, '\\b(?:what|which|list)\\b.{{0,50}}\\b(?:{"|".join(items.VAGUE_EN)})s?\\b.{{0,16}}\\??$') AS shallow FROM p""")
def shallow_questions(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", items.shallow_list(F.col("question"), "en").alias("shallow"))


# ---- rules

RULES = [
    classify.Label("permissive", "legal", "license", "permissive", 3, (classify.Rule(("MIT License", "Apache License"), weight=5), classify.Rule(("released", "license"), "all", 2)), (classify.Rule(("GNU",), weight=4),)),
    classify.Label("copyleft", "legal", "license", "copyleft", 2, (classify.Rule(("GNU General Public",), "exact", 5), classify.Rule((r"version [23]\b",), "regex", 1))),
    classify.Label("contact", "personal", "contact", "address", 1, (classify.Rule((r"[a-z0-9.]+@[a-z0-9.]+", r"\+[0-9]{2}"), "regex", 4),)),
    classify.Label("long", "general", "size", "sentences", 0, (classify.Rule((r"(?:[.!?] [^.!?]+){20}",), "regex", 4),)),
]
_FORM = collapse_sql("lower(coalesce(text, ''))")


@named(f"""WITH f AS (SELECT doc_id, coalesce(text, '') AS t, {_FORM} AS f FROM documents),
    s AS (SELECT doc_id, [
      {{'id': 'permissive', 'p': 3, 'l1': 'legal', 'l3': 'permissive', 's': round(CASE WHEN contains(f, 'mit license') OR contains(f, 'apache license') THEN 5.0 ELSE 0.0 END + CASE WHEN contains(f, 'released') AND contains(f, 'license') THEN 2.0 ELSE 0.0 END - CASE WHEN contains(f, 'gnu') THEN 4.0 ELSE 0.0 END + 0.03, 4)::DOUBLE}},
      {{'id': 'copyleft', 'p': 2, 'l1': 'legal', 'l3': 'copyleft', 's': round(CASE WHEN contains(f, 'gnu general public') THEN 5.0 ELSE 0.0 END + CASE WHEN regexp_matches(t, '(?i)version [23]\\b') THEN 1.0 ELSE 0.0 END + 0.02, 4)::DOUBLE}},
      {{'id': 'contact', 'p': 1, 'l1': 'personal', 'l3': 'address', 's': round(CASE WHEN regexp_matches(t, '(?i)[a-z0-9.]+@[a-z0-9.]+|\\+[0-9]{{2}}') THEN 4.0 ELSE 0.0 END + 0.01, 4)::DOUBLE}},
      {{'id': 'long', 'p': 0, 'l1': 'general', 'l3': 'sentences', 's': CASE WHEN regexp_matches(t, '(?i)(?:[.!?] [^.!?]+){{20}}') THEN CAST(4.0 AS DOUBLE) ELSE 0 END}}] AS l FROM f),
    k AS (SELECT doc_id, x.* FROM (SELECT doc_id, unnest(list_filter(l, lambda x: x.s >= 4)) AS x FROM s)),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, p DESC, id) AS r FROM k) WHERE r = 1),
    o AS (SELECT b.doc_id, max(CASE WHEN k.l1 <> b.l1 THEN k.s END) AS o1, max(CASE WHEN k.l1 = b.l1 AND k.l3 <> b.l3 THEN k.s END) AS o3 FROM b JOIN k ON b.doc_id = k.doc_id GROUP BY 1)
    SELECT s.doc_id, b.id AS label_id, coalesce(l1, '') AS level1, coalesce(l3, '') AS level3, coalesce(b.s, 0.0) AS score, coalesce(round(b.s / (b.s + coalesce(o1, 0) + 1), 4), 0.0) AS route, coalesce(round(b.s / (b.s + coalesce(o3, 0) + 1), 4), 0.0) AS level3_confidence
    FROM s LEFT JOIN b ON s.doc_id = b.doc_id LEFT JOIN o ON s.doc_id = o.doc_id""")
def rule_scores(spark, d):
    """The best label of every document by weighted rules, with its confidences."""
    return classify.classify(table(spark, d, "documents"), RULES).select("doc_id", "label_id", "level1", "level3", "score", "route", "level3_confidence")


@named("""WITH r AS (SELECT source, lang AS truth, CASE WHEN contains(lower(text), ' the ') THEN 'en' WHEN contains(lower(text), ' der ') THEN 'de' WHEN contains(lower(text), ' el ') THEN 'es' WHEN contains(lower(text), ' le ') THEN 'fr' END AS guess FROM documents)
    SELECT source, count(*) AS n, round(avg(CASE WHEN truth = guess THEN 1.0 ELSE 0.0 END), 6) AS accuracy, CAST(0.5 AS DOUBLE) AS mean_confidence FROM r GROUP BY ROLLUP (source)""")
def classifier_evaluation(spark, d):
    """Accuracy by source and over all of a guess at the language from four little words."""
    low = F.lower("text")
    guess = F.when(F.contains(low, F.lit(" the ")), "en").when(F.contains(low, F.lit(" der ")), "de").when(F.contains(low, F.lit(" el ")), "es").when(F.contains(low, F.lit(" le ")), "fr")
    rows = table(spark, d, "documents").select("source", F.col("lang").alias("truth"), guess.alias("guess"), F.lit(0.5).alias("confidence"))
    return classify.evaluation(rows, "truth", "guess", "confidence", "source")


@named("""WITH s AS (SELECT user_id, event_type, sum(abs(value) / (1 + abs(value))) AS s FROM events GROUP BY ALL), n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, event_type, round(least(1, s / n), 6) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, event_type) AS r FROM s) JOIN n USING (user_id) WHERE r = 1""")
def snippet_vote(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", (F.abs("value") / (1 + F.abs("value"))).alias("confidence"))
    return classify.vote(rows, "user_id", "event_type", "confidence")


# ---- suites

_SCORED = """SELECT l.doc_id, coalesce(source, '') AS source, CAST(quality AS DOUBLE) AS answerability, 1.0 - toxic AS faithfulness, CASE WHEN l.doc_id % 3 = 0 THEN n_chars % 100 / 100 END AS coverage_recall, n_chars % 7 / 6 AS coverage_self, n_chars % 5 / 4 AS coverage_score
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def _scored(spark, d) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    return rows.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("quality").cast("double").alias("answerability"), (1.0 - F.col("toxic")).alias("faithfulness"),
        F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") % 100 / 100).alias("coverage_recall"), (F.col("n_chars") % 7 / 6).alias("coverage_self"), (F.col("n_chars") % 5 / 4).alias("coverage_score"),
    )


_GROUPS = f"""WITH i AS ({_SCORED}), g AS (SELECT source, count(*) AS n_items, avg(answerability * faithfulness) AS pp, avg(answerability) AS p, avg(faithfulness) AS f, avg(coverage_self) AS cs, avg(coverage_score) AS cc,
      coalesce(arg_min(coverage_recall, doc_id) FILTER (coverage_recall IS NOT NULL), 0) AS r FROM i GROUP BY 1)"""


@named(f"{_GROUPS} SELECT source, n_items, round(pp, 6) AS p, round(r, 6) AS r, CASE WHEN pp + r > 0 THEN round(2 * pp * r / (pp + r), 6) ELSE 0 END AS f1 FROM g")
def group_f1_scores(spark, d):
    return suite.group_scores(_scored(spark, d), "source", "doc_id", "product")


@named(f"""{_GROUPS}, h AS (SELECT *, round(p, 6) AS p6, round(r, 6) AS r6, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM g)
    SELECT count(*) AS n_groups, round(avg(f), 6) AS faithfulness, round(avg(p6), 6) AS p, round(avg(r6), 6) AS r, round(avg(cs), 6) AS coverage_self, round(avg(cc), 6) AS coverage_score, round(avg(f1), 6) AS f1 FROM h""")
def suite_macro_means(spark, d):
    return suite.suite_scores(_scored(spark, d), "source", "doc_id")


@named("""SELECT 'quality' AS metric, count(quality) AS n, round(avg(quality), 6) AS mean, min(quality)::DOUBLE AS smallest, max(quality)::DOUBLE AS largest FROM labels UNION ALL
    SELECT 'toxic', count(toxic), round(avg(toxic), 6), min(toxic)::DOUBLE, max(toxic)::DOUBLE FROM labels""")
def metric_summary(spark, d):
    return suite.metric_summary(table(spark, d, "labels"), "quality", "toxic")


@named("""WITH m AS (SELECT user_id, event_type, avg(value) FILTER (value > 0) AS m FROM events GROUP BY ALL)
    SELECT e.user_id, e.event_type, round(coalesce(any_value(m), 0), 6) AS score, arg_min(props, (abs(value - m), event_id)) FILTER (value > 0) AS rating FROM events e JOIN m ON e.user_id = m.user_id AND e.event_type = m.event_type GROUP BY ALL""")
def rating_fusion(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("attempt"), F.col("value").alias("score"), F.col("props").alias("rating"))
    return suite.fused_ratings(rows, "user_id", "event_type", in_order=True)


@named("""WITH p AS (SELECT l_orderkey, l_linenumber, round(0.65 * l_discount * 10 + 0.35 * l_tax * 10, 6) AS alignment FROM lineitem)
    SELECT l_orderkey, item, alignment, alignment < 0.7 AS below FROM (SELECT l_orderkey, l_linenumber AS item, alignment, row_number() OVER (PARTITION BY l_orderkey ORDER BY alignment DESC, l_linenumber) AS r FROM p) WHERE r = 1 AND alignment >= 0.7""")
def qa_alignment(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("item"), (F.col("l_discount") * 10).alias("question_similarity"), (F.col("l_tax") * 10).alias("answer_similarity"))
    return suite.aligned(rows, "l_orderkey")


@named("""SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM labels UNION ALL SELECT '__AVERAGE__', round(avg(quality), 6), round(avg(toxic), 6) FROM labels""")
def report_with_average(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))
    return suite.with_summary_row(rows, "doc_id", "quality", "toxic")


# ---- consolidation, records and writers


@named("""WITH f AS (SELECT source, lang, arg_max(n_chars, doc_id) AS n_chars, max(doc_id) AS last_id FROM documents GROUP BY ALL), l AS (SELECT source, lang, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n_chars FROM documents WHERE lang <> 'en')
    SELECT l.source, l.lang, coalesce(l.n_chars, f.n_chars) AS n_chars, last_id FROM l JOIN f ON l.source = f.source AND l.lang = f.lang""")
def consolidated_overlay(spark, d):
    """Rows of the smaller table with what the last row of the same keys has more."""
    docs = table(spark, d, "documents")
    left = docs.where("lang <> 'en'").select("source", "lang", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("n_chars"))
    full = docs.select("source", "lang", "n_chars", F.col("doc_id").alias("last_id"), F.col("doc_id").alias("at"))
    return consolidation.overlaid(left, full, "at", ("source", "lang")).select("source", "lang", "n_chars", "last_id")


@named("""WITH v AS (SELECT l_orderkey, list({'line': l_linenumber, 'quantity': l_quantity} ORDER BY l_linenumber) FILTER (l_quantity >= 20) AS v FROM lineitem GROUP BY 1)
    SELECT o_orderkey, coalesce(len(v), 0)::BIGINT AS n_variants, coalesce(array_to_string(list_transform(v, lambda x: x.line), ','), '') AS lines FROM orders LEFT JOIN v ON o_orderkey = l_orderkey""")
def variants_nested(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))
    rows = consolidation.with_variants(table(spark, d, "orders").select("o_orderkey"), lines, "o_orderkey", "l_orderkey", "line", 20, "quantity")
    return rows.select("o_orderkey", F.size("variants").cast("long").alias("n_variants"), F.array_join(F.transform("variants", lambda v: v["line"].cast("string")), ",").alias("lines"))


@named(f"""SELECT coalesce(role2, '') AS "知识类别", '' AS "题目类型", question AS "题干", '' AS "相似问向", answer AS "答案", '' AS "答案解释", '' AS "题目难度", 'c' || conv_id AS "题目来源-相关文件", '文本内容' AS "题目来源-相关段落", '模型: none；平均得分: ' || printf('%.4f', turn / 8) AS "备注" FROM ({PAIRS})""")
def exam_export(spark, d):
    rows = _pairs(spark, d).select("question", "answer", F.lit("assistant").alias("knowledge_category"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("original_filename"), F.lit("none").alias("llm_model"), (F.col("turn") / 8).alias("average_score"))
    return writers.exam_rows(rows)


@named("""SELECT doc_id, lower(hex(encode(substr(text, 1, k)))) AS full40, length(text) AS n
    FROM (SELECT doc_id, text, list_max(list_filter(range(0, 41), lambda i: strlen(substr(text, 1, i)) <= 40)) AS k FROM documents)""")
def byte_prefixes(spark, d):
    """All texts cut to 40 bytes at a whole character, in hexadecimal."""
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.lower(F.hex(T.cut_bytes(F.col("text"), 40).cast("binary"))).alias("full40"), F.length("text").cast("long").alias("n"))


@named(f"""WITH p AS (SELECT conv_id, turn, {strip_sql("question")} AS q, {strip_sql("answer")} AS a FROM ({PAIRS}))
    SELECT sha1('dataset' || q || a) AS id, 'sha1:' || sha1('') AS group_id, 'dataset' AS original_filename, '' AS context, q AS question, a AS answer, '' AS ref_answer FROM p WHERE q <> '' AND a <> ''""")
def canonical_dataset(spark, d):
    return readers.canonical_rows(_pairs(spark, d).select("question", "answer"), "conversations")


@named("SELECT doc_id, lang FROM documents ORDER BY md5('sample/' || doc_id), doc_id LIMIT 25")
def seeded_sample(spark, d):
    return readers.seeded_sample(table(spark, d, "documents").select("doc_id", "lang"), 25, "sample", "doc_id")


@named("""WITH g AS (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1), q AS (SELECT lang, n * 20 // sum(n) OVER () AS b, n * 20 % sum(n) OVER () AS r FROM g),
    k AS (SELECT lang, b + CAST(row_number() OVER (ORDER BY r DESC, lang) <= 20 - sum(b) OVER () AS INT) AS quota FROM q), e AS (SELECT lang, unnest(range(1, CAST(quota AS BIGINT) + 1)) AS i FROM k)
    SELECT row_number() OVER (ORDER BY md5('plan/' || lang || '/' || i)) AS slot, lang FROM e""")
def question_type_plan(spark, d):
    """Twenty slots shared among the languages in proportion, in a shuffled order."""
    groups = table(spark, d, "documents").where("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n"))
    return planning.typed_plan(planning.largest_remainder(groups, "lang", "n", 20), "lang")


@named("""SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), 0.0) AS k, round(1 / (1 + exp(-greatest(-30, least(30, (value - 5) / 2)))), 6) AS p, round(1 / (1 + 0.01 * pow(greatest(value, 0), 0.8)), 6) AS fluency FROM events""")
def number_functions(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", N.number_or(F.get_json_object("props", "$.k")).alias("k"), F.round(N.sigmoid(F.col("value"), 5.0, 2.0), 6).alias("p"), F.round(N.fluency(F.col("value")), 6).alias("fluency"))


@unchecked
def doc_markdown_split(spark, d):
    """Sections of every document, long ones in parts; tested against plain Python on texts with headings."""
    bound_batches(spark)
    return chunking.section_chunks(table(spark, d, "documents"), 1500)


@unchecked
def reading_scores(spark, d):
    """Longest common run and equality of answers with their questions as references; tested against plain Python."""
    rows = _pairs(spark, d).select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair"), "answer", F.array("question").alias("refs"))
    return scoring.reading_scores(rows, "pair", "answer", "refs")
