"""Named queries over the driver's tables, with the same results in SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.shared import bound_batches
from ..operators import chunking, grounding, language_model, planning, records, retrieval, scoring
from ..sources.readers import links, row_ranges, table
from .sql import FIXED as _FIXED
from .sql import PAIRS as _PAIRS
from .sql import chunk_faults, collapse_sql, metric_tokens_sql, normalised_sql, quality_tokens_sql, sentences_sql, tokens_sql
from ..streaming.status import live_until, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_TOK = tokens_sql("text")


def named(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def unchecked(f):
    """A query that SQL can't express; its tests hold it against plain Python."""
    QUERIES[f.__name__] = f
    return f


# ---- documents to chunks


@named(_FIXED.format(n=600))
def doc_chunk_fixed(spark, d):
    return chunking.fixed(table(spark, d, "documents"), 600)


@named(f"WITH c AS ({_FIXED.format(n=600)}) SELECT doc_id, chunk_index, concat(coalesce(right(lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_index), 100), ''), text) AS text FROM c")
def doc_chunk_overlap(spark, d):
    return chunking.overlapped(chunking.fixed(table(spark, d, "documents"), 600), 100)


@named("SELECT doc_id, generate_subscripts(p, 1) - 1 AS chunk_index, unnest(p) AS text FROM (SELECT doc_id, list_filter(list_transform(string_split(text, '. '), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents)")
def doc_custom_split(spark, d):
    return chunking.on_separator(table(spark, d, "documents"), ". ")


@named("""WITH c AS (SELECT doc_id, text, list_sort(list_distinct(list_filter([0, length(text) // 3, length(text) // 2, length(text)], lambda p: p >= 0 AND p <= length(text)))) AS cuts FROM documents),
    r AS (SELECT doc_id, text, cuts, unnest(range(1, len(cuts))) AS part FROM c)
    SELECT * FROM (SELECT doc_id, part, substr(text, cuts[part] + 1, cuts[part + 1] - cuts[part]) AS text FROM r) WHERE trim(text, ' ') <> ''""")
def doc_manual_split(spark, d):
    n = F.length("text")
    return chunking.at_points(table(spark, d, "documents"), F.array((n / 3).cast("int"), (n / 2).cast("int")))


@named("""SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents)
    WHERE length(line) BETWEEN 1 AND 80 GROUP BY ALL HAVING count(*) >= 4""")
def noise_lines(spark, d):
    return chunking.noise_lines(table(spark, d, "documents"))


@named(f"SELECT doc_id, length(text) AS n_chars, len({sentences_sql('text', 10)}) AS n_sentences FROM documents")
def sentence_counts(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size(T.sentences(F.col("text"), 10)).cast("long").alias("n_sentences"))


@named(f"""WITH c AS ({_FIXED.format(n=600)}) SELECT count(*) AS n_chunks, CAST(count_if(length(text) < 40) AS BIGINT) AS n_short, CAST(count_if(length(text) > 1200) AS BIGINT) AS n_long, round(avg(length(text)), 2) AS mean_length FROM c""")
def chunk_metrics(spark, d):
    n = F.length("text")
    return chunking.fixed(table(spark, d, "documents"), 600).agg(F.count("*").alias("n_chunks"), F.count_if(n < 40).alias("n_short"), F.count_if(n > 1200).alias("n_long"), F.round(F.avg(n), 2).alias("mean_length"))


# ---- text functions


@named("""SELECT doc_id, CASE WHEN (length(text) - length(regexp_replace(text, '[一-鿿]', '', 'g'))) / greatest(length(text), 1) > 0.05 THEN 'zh'
    WHEN (length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))) / greatest(length(text), 1) > 0.05 THEN 'en' ELSE 'unknown' END AS language FROM documents""")
def lang_ratio_detect(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language_of(F.col("text")).alias("language"))


@named(f"SELECT doc_id, len({_TOK}) AS n_tokens, len(list_distinct({_TOK})) AS n_distinct FROM documents")
def lexical_tokens(spark, d):
    t = T.lexical_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@named(f"""WITH t AS (SELECT unnest(list_distinct({_TOK})) AS token FROM documents), n AS (SELECT count(*) AS n FROM documents)
    SELECT token, count(*) AS df, round(ln((any_value(n) + 1) / (count(*) + 0.5)) + 1, 6) AS idf FROM t, n GROUP BY token""")
def token_df_idf(spark, d):
    return retrieval.token_stats(table(spark, d, "documents")).withColumn("idf", F.round("idf", 6))


@named("SELECT doc_id, sha1(concat(source, ':', doc_id)) AS record_id, substr(sha1(text), 1, 12) AS text_key FROM documents")
def identity_hashes(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha1(F.concat("source", F.lit(":"), F.col("doc_id").cast("string")).cast("binary")).alias("record_id"), F.substring(F.sha1(F.col("text").cast("binary")), 1, 12).alias("text_key"))


@named("""WITH r AS (SELECT page_id, regexp_extract(url, '^(?:https?://)([^/]*)', 1) AS host, regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1) AS l FROM pages),
    u AS (SELECT page_id, host, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM r)
    SELECT page_id, generate_subscripts(l, 1) - 1 AS pos, unnest(list_transform(l, lambda x: CASE WHEN starts_with(x, '/') THEN 'https://' || host || x ELSE x END)) AS link FROM u""")
def link_extract(spark, d):
    return links(table(spark, d, "pages"))


# ---- ranking


@named(f"""WITH c AS ({_FIXED.format(n=600)}), k AS (SELECT doc_id * 100000 + chunk_index AS chunk_id, text FROM c),
    t AS (SELECT chunk_id, unnest(list_distinct({_TOK})) AS token FROM k), n AS (SELECT count(*) AS n FROM k),
    w AS (SELECT token, ln((any_value(n) + 1) / (count(*) + 0.5)) + 1 AS idf FROM t, n WHERE token IN ('the', 'ing', 'license') GROUP BY token),
    q AS (SELECT token, coalesce(idf, 1.0) AS idf FROM (SELECT unnest(['the', 'ing', 'license']) AS token) LEFT JOIN w USING (token))
    SELECT chunk_id, round(0.75 * sum(idf) / (SELECT sum(idf) FROM q), 6) AS score FROM t JOIN q USING (token) GROUP BY chunk_id ORDER BY score DESC, chunk_id LIMIT 3""")
def lexical_top_chunks(spark, d):
    chunks = chunking.fixed(table(spark, d, "documents"), 600).select((F.col("doc_id") * 100000 + F.col("chunk_index")).alias("chunk_id"), "text")
    return retrieval.top_k(retrieval.lexical_scores(chunks, "the ing license", id_col="chunk_id"), 3, tie="chunk_id")


@named(f"""WITH t AS (SELECT doc_id, {_TOK} AS tokens FROM documents), s AS (SELECT count(*) AS n, avg(len(tokens)) AS m FROM t),
    tf AS (SELECT doc_id, token, any_value(size) AS size, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS size, unnest(tokens) AS token FROM t) WHERE token IN ('release', 'version', 'mit') GROUP BY ALL),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
    SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * size / m))), 6) AS score FROM tf JOIN df USING (token), s GROUP BY doc_id""")
def bm25_scores(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), "release version MIT")


@named("""WITH q AS (SELECT list_transform(range(0, 64), lambda i: CASE WHEN i % 2 = 0 THEN 0.125 ELSE -0.125 END) AS q)
    SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 10""")
def vector_topk_filtered(spark, d):
    v = table(spark, d, "embeddings").where(F.col("label").isin(1, 2, 3))
    return retrieval.top_k(retrieval.vector_scores(v, [0.125 if i % 2 == 0 else -0.125 for i in range(64)]).select("vec_id", "score"), 10, tie="vec_id")


# every row whose id is divisible by 50 is a query, against all rows


_BEST = "SELECT * FROM (SELECT query_id, {i}, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {i}) AS rank FROM s) WHERE rank <= {k}"


@named(f"""WITH c AS ({_FIXED.format(n=600)}), k AS (SELECT doc_id * 100000 + chunk_index AS chunk_id, text FROM c),
    t AS (SELECT chunk_id, unnest(list_distinct({_TOK})) AS token FROM k), n AS (SELECT count(*) AS n FROM k),
    w AS (SELECT token, ln((any_value(n) + 1) / (count(*) + 0.5)) + 1 AS idf FROM t, n GROUP BY token),
    q AS (SELECT chunk_id AS query_id, token, idf FROM t JOIN w USING (token) WHERE chunk_id % 50 = 0), z AS (SELECT query_id, sum(idf) AS total FROM q GROUP BY 1),
    s AS (SELECT query_id, chunk_id, round(0.75 * sum(idf) / any_value(total), 6) AS score FROM t JOIN q USING (token) JOIN z USING (query_id) GROUP BY ALL)
    {_BEST.format(i="chunk_id", k=3)}""")
def lexical_top_chunks_all(spark, d):
    chunks = chunking.fixed(table(spark, d, "documents"), 600).select((F.col("doc_id") * 100000 + F.col("chunk_index")).alias("chunk_id"), "text")
    return retrieval.lexical_top_each(chunks, chunks.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query")), 3, "chunk_id")


@named(f"""WITH t AS (SELECT doc_id, {_TOK} AS tokens FROM documents), g AS (SELECT count(*) AS n, avg(len(tokens)) AS m FROM t),
    tf AS (SELECT doc_id, token, any_value(size) AS size, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS size, unnest(tokens) AS token FROM t) GROUP BY ALL),
    df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), q AS (SELECT doc_id AS query_id, token FROM tf WHERE doc_id % 50 = 0),
    s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * size / m))), 6) AS score FROM q JOIN tf USING (token) JOIN df USING (token), g GROUP BY ALL)
    {_BEST.format(i="doc_id", k=10)}""")
def bm25_scores_all(spark, d):
    docs = table(spark, d, "documents")
    return retrieval.bm25_top_each(docs, docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query")), 10)


@named(f"""WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)
    {_BEST.format(i="vec_id", k=10)}""")
def vector_topk_all(spark, d):
    v = table(spark, d, "embeddings")
    return retrieval.vector_top_each(v, v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10)


@named("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
    p AS (SELECT a.label, b.label AS other, sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) AS c FROM m a JOIN m b ON a.i = b.i AND a.label <> b.label GROUP BY ALL)
    SELECT label, arg_max(other, c) AS nearest, round(max(c), 6) AS cosine FROM p GROUP BY label""")
def nearest_other_centroid(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))  # a row for each label and dimension
    a, b = m.alias("a"), m.alias("b")
    p = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.label") != F.col("b.label"))).groupBy(F.col("a.label").alias("label"), F.col("b.label").alias("other"))
    p = p.agg((F.sum(F.col("a.x") * F.col("b.x")) / (F.sqrt(F.sum(F.col("a.x") * F.col("a.x"))) * F.sqrt(F.sum(F.col("b.x") * F.col("b.x"))))).alias("c"))
    return p.groupBy("label").agg(F.max_by("other", "c").alias("nearest"), F.round(F.max("c"), 6).alias("cosine"))


# ---- quality of chunks

_ADJ = f"""WITH c AS ({_FIXED.format(n=600)}), t AS (SELECT *, {quality_tokens_sql("text")} AS t FROM c),
    l AS (SELECT *, lag(t) OVER w AS p, lead(t) OVER w AS q FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)),
    j AS (SELECT doc_id, chunk_index, text, round(greatest(
      coalesce(CASE WHEN len(list_distinct(list_concat(t, p))) = 0 THEN 0 ELSE len(list_intersect(t, p)) / len(list_distinct(list_concat(t, p))) END, 0),
      coalesce(CASE WHEN len(list_distinct(list_concat(t, q))) = 0 THEN 0 ELSE len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))) END, 0)), 6) AS similar_, p, q FROM l),
    a AS (SELECT doc_id, chunk_index, text, CASE WHEN p IS NULL AND q IS NULL THEN 0 ELSE similar_ END AS adjacent FROM j)"""


@named(f"{_ADJ} SELECT doc_id, chunk_index, adjacent FROM a")
def adjacent_jaccard(spark, d):
    return scoring.adjacent_similarity(chunking.fixed(table(spark, d, "documents"), 600)).select("doc_id", "chunk_index", "adjacent")


@named(f"{_ADJ}, {chunk_faults()} SELECT doc_id, chunk_index, quality, status FROM s")
def chunk_quality(spark, d):
    bound_batches(spark)
    return scoring.chunk_quality(scoring.adjacent_similarity(chunking.fixed(table(spark, d, "documents"), 600))).select("doc_id", "chunk_index", "quality", "status")


# ---- questions and answers

def _pairs(spark, d) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = table(spark, d, "conversations").withColumns({"nr": F.lead("role").over(w), "nt": F.lead("text").over(w)})
    return rows.where("role = 'user' AND nr = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), F.col("nt").alias("answer"))


@named(f"SELECT conv_id, turn, question, answer FROM ({_PAIRS})")
def qa_pairs_from_turns(spark, d):
    return _pairs(spark, d)


@named(f"SELECT question, answer, min(conv_id) AS first_conv, count(*) AS n FROM ({_PAIRS}) GROUP BY question, answer")
def qa_dedup_exact(spark, d):
    return _pairs(spark, d).groupBy("question", "answer").agg(F.min("conv_id").alias("first_conv"), F.count("*").alias("n"))


@named(f"""WITH w AS (SELECT conv_id, turn, {collapse_sql("question")} = '' AS missing, {normalised_sql("answer")} = {normalised_sql("question")} AS same, {metric_tokens_sql(normalised_sql("answer"))} AS a,
      {metric_tokens_sql(normalised_sql("question"))} AS r, {metric_tokens_sql("answer")} AS t, {metric_tokens_sql("question")} AS s FROM ({_PAIRS})),
    o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(a, r)), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(r, lambda y: y = x))))), 0) AS o FROM w)
    SELECT conv_id, turn, CASE WHEN missing THEN 0 ELSE CAST(same AS INT) END AS exact, CASE WHEN missing THEN 0 WHEN len(a) + len(r) = 0 THEN 1.0 ELSE round(2 * o / (len(a) + len(r)), 6) END AS f1,
    CASE WHEN missing OR len(t) = 0 THEN 0.0 ELSE round(100 * len(list_filter(t, lambda x: list_contains(s, x))) / len(t), 6) END AS bleu, CAST(missing AS INT) AS missing_reference FROM o""")
def em_f1_bleu(spark, d):
    return scoring.answer_scores(_pairs(spark, d), "answer", "question").select("conv_id", "turn", "exact", "f1", "bleu", "missing_reference")


@named(f"""WITH p AS (SELECT conv_id, turn, lower(question) AS q, lower(answer) AS a FROM ({_PAIRS})),
    g AS (SELECT conv_id, turn, q, a, list_transform(range(1, greatest(length(q) - 1, 1)), lambda i: substr(q, i, 3)) AS g FROM p)
    SELECT conv_id, turn, CASE WHEN coalesce(length(q), 0) = 0 OR coalesce(length(a), 0) = 0 THEN 0.0 WHEN len(g) = 0 THEN CAST(contains(a, q) AS DOUBLE)
      ELSE round(len(list_filter(g, lambda x: contains(a, x))) / len(g), 6) END AS recall FROM g""")
def ngram_recall(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", scoring.ngram_recall(F.lower("question"), F.lower("answer")).alias("recall"))


@named("SELECT CAST(0.5 AS DOUBLE) AS threshold, count(*) AS original, CAST(count_if(quality >= 0.5) AS BIGINT) AS filtered, CAST(count(*) - count_if(quality >= 0.5) AS BIGINT) AS removed FROM labels")
def threshold_filter_info(spark, d):
    kept = F.count_if(F.col("quality") >= 0.5)
    return table(spark, d, "labels").agg(F.count("*").alias("original"), kept.alias("filtered"), (F.count("*") - kept).alias("removed")).select(F.lit(0.5).alias("threshold"), "original", "filtered", "removed")


# ---- rules and classification


@named("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_confusion(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@named("""WITH h AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('split' || doc_id), doc_id) AS p, count(*) OVER (PARTITION BY lang) AS n FROM documents),
    z AS (SELECT *, greatest(CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT), CASE WHEN n > 2 THEN 1 ELSE 0 END) AS k FROM h)
    SELECT doc_id, lang, CASE WHEN p <= k THEN 'test' WHEN p <= 2 * k THEN 'dev' ELSE 'train' END AS split FROM z""")
def stratified_split(spark, d):
    return scoring.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang")


# ---- records


@named("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20 OFFSET 20")
def list_filter_page(spark, d):
    o = table(spark, d, "orders").where(records.conjunction([F.col("o_orderstatus").isin("O", "F"), F.col("o_totalprice") >= 100000]))
    return records.page(o.select("o_orderkey", "o_orderstatus", "o_totalprice"), 2, 20, "o_totalprice", "o_orderkey")


@named("SELECT c_custkey, coalesce(n, 0) AS n_orders, coalesce(spent, 0.0) AS spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def left_default_meta(spark, d):
    side = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return records.with_defaults(table(spark, d, "customer").select("c_custkey"), side, "c_custkey", {"n_orders": 0, "spent": 0.0})


@named("""WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN upper(c_mktsegment) END AS c_mktsegment, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0
      UNION ALL SELECT -1, 'NEW', 0.0)
    SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal
    FROM customer o FULL JOIN n ON n.c_custkey = o.c_custkey""")
def upsert_coalesce(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_mktsegment")).alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return records.upsert(old, new.union(spark.createDataFrame([(-1, "NEW", 0.0)], new.schema)), "c_custkey")


@named("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, 'replaced', 0.0 FROM supplier WHERE s_suppkey % 5 = 0")
def replace_by_id(spark, d):
    old = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return records.replace_by_id(old, old.where("s_suppkey % 5 = 0").select("s_suppkey", F.lit("replaced").alias("s_name"), F.lit(0.0).alias("s_acctbal")), "s_suppkey")


@named("""SELECT c_mktsegment, CAST(count_if(o IS NOT NULL) AS BIGINT) AS with_orders, CAST(count_if(o IS NULL) AS BIGINT) AS without FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c_custkey = o GROUP BY 1""")
def semi_anti_ids(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    both = c.join(o, "c_custkey", "left_semi").withColumn("has", F.lit(1)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has", F.lit(0)))
    return both.groupBy("c_mktsegment").agg(F.sum("has").alias("with_orders"), F.sum(1 - F.col("has")).alias("without"))


@named("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS r FROM lineitem) WHERE r <= 2")
def variants_topn(spark, d):
    return records.top_per_key(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", 2, F.desc("l_quantity"), F.col("l_linenumber"))


@named("SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def category_distribution(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("total")))).select("o_orderpriority", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("share"))


@named("SELECT coalesce(l_shipmode, 'OVERALL') AS grp, n, mean_price FROM (SELECT l_returnflag AS l_shipmode, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_price FROM lineitem GROUP BY ROLLUP (l_returnflag))")
def file_rollup_mean(spark, d):
    r = table(spark, d, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"))
    return r.select(F.coalesce("l_returnflag", F.lit("OVERALL")).alias("grp"), "n", "mean_price")


@named("SELECT l_linestatus, round(avg(l_quantity), 6) AS mean, round(quantile_cont(l_quantity, 0.5), 6) AS p50, max(l_quantity) AS largest, count(*) AS n FROM lineitem GROUP BY 1")
def stats_median(spark, d):
    return records.stats(table(spark, d, "lineitem"), "l_quantity", "l_linestatus")


@named("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey BETWEEN 1 AND 6 OR l_orderkey BETWEEN 10 AND 12 OR l_orderkey = 40")
def row_ranges_select(spark, d):
    return table(spark, d, "lineitem").where(records.in_ranges(F.col("l_orderkey"), row_ranges("10-12,1-3, 4-6,2,40"))).select("l_orderkey", "l_linenumber")


# ---- events


@named("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_status(spark, d):
    return records.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").select("user_id", "event_type", "ts")


@named("SELECT user_id, max(ts) AS last_seen FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 1 DAY GROUP BY user_id")
def ttl_expiry(spark, d):
    return live_until(table(spark, d, "events"), datetime.timedelta(days=1), "2024-01-25 00:00:00")


@named("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_window_counts(spark, d):
    return windowed_counts(table(spark, d, "events"))


_WALL = """WITH i AS (SELECT user_id, event_type AS stage, epoch_us(ts) AS a, epoch_us(ts) + 60000000 + CAST(floor(abs(value)) AS BIGINT) % 600 * 1000000 AS b FROM events),
    c AS (SELECT DISTINCT user_id, unnest([a, b]) AS x FROM i), s AS (SELECT user_id, x, lead(x) OVER (PARTITION BY user_id ORDER BY x) AS y FROM c),
    t AS (SELECT DISTINCT s.user_id, x, y, stage FROM s JOIN i ON s.user_id = i.user_id AND a <= x AND b >= y WHERE y IS NOT NULL),
    n AS (SELECT *, count(*) OVER (PARTITION BY user_id, x) AS n FROM t),
    w AS (SELECT user_id, stage, round(sum((y - x) / n) / 1000000, 4) AS seconds FROM n GROUP BY ALL)"""


def _wall(events: DataFrame, gap: str | None = None) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', ts)")
    rows = events.select("user_id", F.col("event_type").alias("stage"), start.alias("a"), (start + 60_000_000 + F.floor(F.abs("value")) % 600 * 1_000_000).alias("b"))
    spent = records.attribute_wall(rows, "user_id", "a", "b", "stage", 3600 * 1_000_000, gap)
    return spent.select("user_id", "stage", F.round(F.col("seconds") / 1_000_000, 4).alias("seconds"))


@named(f"{_WALL} SELECT * FROM w")
def wall_interval_attribution_all(spark, d):
    return _wall(table(spark, d, "events"))


@named(f"""{_WALL}, g AS (SELECT user_id, (max(b) - min(a)) / 1000000 AS whole FROM i GROUP BY 1), u AS (SELECT user_id, sum((y - x) / n) / 1000000 AS used FROM n GROUP BY 1)
    SELECT * FROM w UNION ALL SELECT user_id, 'gap', round(greatest(0, whole - used), 4) FROM g JOIN u USING (user_id)""")
def wall_interval_attribution(spark, d):
    """Every event's time, and what no stage accounts for."""
    return _wall(table(spark, d, "events"), "gap")


@named(f"""WITH c AS ({_FIXED.format(n=600)}), p AS (SELECT doc_id, chunk_index, CAST(chunk_index // 8 + 1 AS VARCHAR) AS a, CAST(chunk_index // 2 % 4 + 1 AS VARCHAR) AS b, 'Part ' || (chunk_index // 8) AS ta, 'Section ' || (chunk_index // 2) AS tb FROM c),
    n AS (SELECT doc_id, chunk_index, a AS node, '' AS parent, 1 AS depth, ta AS title FROM p UNION ALL SELECT doc_id, chunk_index, a || '/' || b, a, 2, tb FROM p)
    SELECT doc_id, node, parent, CAST(depth AS BIGINT) AS depth, title, count(*) AS n_leaves, min(chunk_index) AS first_chunk FROM n GROUP BY ALL""")
def tree_paths(spark, d):
    chunks = chunking.fixed(table(spark, d, "documents"), 600)
    path = F.concat(F.lit("Part "), F.floor(F.col("chunk_index") / 8).cast("string"), F.lit(" > Section "), F.floor(F.col("chunk_index") / 2).cast("string"))
    return chunking.document_tree(chunking.index_paths(chunks.withColumn("title_path", path), depth=2))


# ---- units, models and grounding

_QUAL = ORACLE_SQL["chunk_quality"]
_UNITS = f"""c AS ({_FIXED.format(n=600)}), k AS (SELECT c.doc_id, c.chunk_index, c.chunk_index // 4 AS parent, text, status, length({collapse_sql("text")}) AS n
      FROM c JOIN q ON c.doc_id = q.doc_id AND c.chunk_index = q.chunk_index WHERE status <> 'drop'),
    g AS (SELECT doc_id, parent, min(chunk_index) AS anchor, count(*) AS n_chunks, count_if(status = 'usable') AS n_usable FROM k WHERE n > 0 GROUP BY ALL HAVING count(*) >= 2 AND count_if(status = 'usable') >= 2 AND sum(n) <= 6000),
    u AS (SELECT doc_id, 'section' AS unit_type, anchor, n_chunks, CAST(n_usable AS BIGINT) AS n_usable, CAST(least(3, n_usable) AS BIGINT) AS potential FROM g
      UNION ALL SELECT k.doc_id, 'leaf', chunk_index, 1, 1, 1 FROM k ANTI JOIN g ON k.doc_id = g.doc_id AND k.parent = g.parent WHERE status = 'usable' AND n > 0)"""


def _units(spark, d) -> DataFrame:
    bound_batches(spark)
    chunks = scoring.chunk_quality(scoring.adjacent_similarity(chunking.fixed(table(spark, d, "documents"), 600)))
    return planning.plan_units(chunks.select("doc_id", "chunk_index", F.floor(F.col("chunk_index") / 4).alias("parent"), "text", "status"))


@named(f"WITH q AS ({_QUAL}), {_UNITS} SELECT doc_id, unit_type, anchor, n_chunks, n_usable, potential FROM u")
def unit_plan_counts(spark, d):
    return _units(spark, d)


@named(f"""WITH q AS ({_QUAL}), {_UNITS},
    p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY anchor, unit_type) AS place FROM u) WHERE place <= 5),
    l AS (SELECT doc_id, 5 - count(*) AS spare FROM p GROUP BY doc_id),
    a AS (SELECT doc_id, place, row_number() OVER (PARTITION BY doc_id ORDER BY turn, unit_type = 'leaf', anchor, place) AS k FROM (SELECT *, unnest(range(1, potential)) AS turn FROM p)),
    m AS (SELECT a.doc_id, place, count(*) AS more FROM a JOIN l ON a.doc_id = l.doc_id WHERE k <= spare GROUP BY ALL)
    SELECT p.doc_id, unit_type, anchor, 1 + coalesce(more, 0) AS budget FROM p LEFT JOIN m ON p.doc_id = m.doc_id AND p.place = m.place""")
def unit_budget(spark, d):
    return planning.allocate_budget(_units(spark, d), 5).select("doc_id", "unit_type", "anchor", "budget")


@named("""WITH g AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), q AS (SELECT event_type, n * 1000 // sum(n) OVER () AS base, n * 1000 % sum(n) OVER () AS r FROM g),
    k AS (SELECT *, 1000 - sum(base) OVER () AS spare, row_number() OVER (ORDER BY r DESC, event_type) AS k FROM q)
    SELECT event_type, CAST(base + CAST(k <= spare AS INT) AS BIGINT) AS quota FROM k""")
def largest_remainder_plan(spark, d):
    return planning.largest_remainder(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n", 1000)


@named(f"""WITH t AS (SELECT doc_id, {_TOK} AS w FROM documents), g AS (SELECT doc_id, w[i] AS a, w[i + 1] AS b, count(*) AS tf FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM t) GROUP BY ALL),
    c AS (SELECT a, b, sum(tf) AS c FROM g GROUP BY ALL), p AS (SELECT a, count(*) AS cp FROM (SELECT unnest(w) AS a FROM t) GROUP BY a), v AS (SELECT count(*) AS v FROM p),
    m AS (SELECT c.a, b, log2((c + 1) / (cp + v)) AS lp FROM c JOIN p ON c.a = p.a, v),
    s AS (SELECT doc_id, round(sum(tf * lp) / sum(tf), 6) AS score FROM g JOIN m ON g.a = m.a AND g.b = m.b GROUP BY doc_id)
    SELECT d.doc_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s ON d.doc_id = s.doc_id""")
def ngram_lm_score(spark, d):
    bound_batches(spark)
    return language_model.ngram_scores(table(spark, d, "documents"), 2)


@named(f"""WITH p AS (SELECT conv_id, turn, regexp_replace(lower(coalesce(question, '')), '[^0-9a-z{T.CJK}]', '', 'g') AS u, regexp_replace(lower(coalesce(answer, '')), '[^0-9a-z{T.CJK}]', '', 'g') AS a FROM ({_PAIRS})),
    g AS (SELECT *, CASE WHEN length(a) <= 2 THEN [a] ELSE list_transform(range(1, length(a)), lambda i: substr(a, i, 2)) END AS g,
      CASE WHEN length(u) <= 2 THEN [u] ELSE list_transform(range(1, length(u)), lambda i: substr(u, i, 2)) END AS h FROM p)
    SELECT conv_id, turn, CASE WHEN u = '' OR a = '' THEN 0.0 WHEN contains(u, a) THEN 1.0 ELSE round(len(list_filter(g, lambda x: list_contains(h, x))) / len(g), 6) END AS anchor FROM g""")
def lexical_anchor(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", scoring.lexical_anchor(F.col("question"), F.col("answer")).alias("anchor"))


@named(f"SELECT {normalised_sql('question')} AS question_key, min(conv_id) AS first_conv, count(*) AS n FROM ({_PAIRS}) GROUP BY 1")
def qa_dedup_normalised(spark, d):
    return _pairs(spark, d).groupBy(T.normalised(F.col("question")).alias("question_key")).agg(F.min("conv_id").alias("first_conv"), F.count("*").alias("n"))


@named("SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type = 'error' AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def event_log_filter(spark, d):
    rows = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return rows.where("k >= 50")


def _marks(column: str) -> str:
    for pattern, put in T.MARKS:
        shown = put.replace("{1}", "\\1")
        column = f"regexp_replace({column}, '{pattern}', '{shown}', 'g')"
    return column


@named(f"SELECT doc_id, {_marks('text')} AS plain FROM documents")
def markdown_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", T.without_markdown(F.col("text")).alias("plain"))


# ---- beyond SQL: tested against brute force


@unchecked
def rouge_l(spark, d):
    return scoring.rouge_l(_pairs(spark, d), "answer", "question").select("conv_id", "turn", "rouge_l")


@unchecked
def doc_recursive_split(spark, d):
    bound_batches(spark)
    return chunking.recursive(table(spark, d, "documents"), 600)


@unchecked
def grounding_of_answers(spark, d):
    pairs = _pairs(spark, d).withColumn("pair", F.struct("conv_id", "turn"))
    return grounding.grounding_scores(pairs, "pair", "answer", "question").select("pair.conv_id", "pair.turn", "score", "matched")


from . import more, search  # noqa: E402, F401  register their queries
