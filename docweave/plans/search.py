"""Named queries of the vector index, answer spans, premise excerpts, BLEU, exact quantiles and sessions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.shared import bound_batches, shared_folder
from ..operators import bleu, profile, quantiles, records, spans, tagger, vector_index
from ..sinks import exactly_once
from ..sinks import zipped as zip_sinks
from ..sources import zipped
from ..sources.readers import table
from ..streaming import sessions
from .named import _pairs, named, unchecked
from .sql import PAIRS, collapse_sql, metric_tokens_sql, strip_sql


@unchecked
def vector_topk_index(spark, d):
    """Every vector whose id is divisible by 50 against lists that hold every row."""
    bound_batches(spark)
    vectors = table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = vector_index.build(vectors, shared_folder(spark, "vectors"))
    return vector_index.search(vector_index.calibrated(index, queries, 10), queries, 10)


# ---- a tagger that is trained on the documents: the family of a language, the language, and how long the text is

#: Languages of the test tables and their families.
FAMILIES = {"en": "germanic", "de": "germanic", "fr": "romance", "es": "romance"}


def labelled_documents(spark, d):
    docs = table(spark, d, "documents")
    family = F.create_map(*[F.lit(x) for pair in FAMILIES.items() for x in pair])
    size = F.when(F.length("text") >= 1500, "long").otherwise("short")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    return docs.select("doc_id", "text", F.try_element_at(family, F.col("lang")).alias("level1"), F.col("lang").alias("level2"), size.alias("level3"), held_out.alias("held_out"))


@unchecked
def tagger_labels(spark, d):
    """Every document by a model that learned from all that are not held out."""
    bound_batches(spark)
    docs = labelled_documents(spark, d)
    model = tagger.fit(docs.where(~F.col("held_out")), "doc_id")
    return tagger.tagged(docs.select("doc_id", "text", "held_out"), model).drop("text")


@unchecked
def tagger_votes(spark, d):
    """The same by vote over the snippets of every document."""
    bound_batches(spark)
    docs = labelled_documents(spark, d)
    return tagger.tagged_by_vote(docs, tagger.fit(docs.where(~F.col("held_out")), "doc_id"), "doc_id")


# ---- answer spans, premises, BLEU

#: What the test documents hold besides: addresses and numbers.
SPANS = (*spans.SPAN_PATTERNS, r"[\w.+-]+@[\w-]+\.[\w.]+", r"\d{2,}")
_FOUND = ", ".join(f"regexp_extract_all(t, '{p}')" for p in SPANS)
_POINTS = " + ".join(f"CASE WHEN regexp_matches(s, '{p}') THEN {n} ELSE 0 END" for n, p in spans.LIKELY)


@named(f"""WITH c AS (SELECT doc_id, {collapse_sql("coalesce(text, '')")} AS t FROM documents),
    f AS (SELECT doc_id, t, list_transform(flatten([{_FOUND}]), lambda x: {strip_sql("x")}) AS l FROM c),
    u AS (SELECT doc_id, t, i, l[i] AS s FROM (SELECT doc_id, t, l, unnest(range(1, len(l) + 1)) AS i FROM f) WHERE list_position(l, l[i]) = i AND length(l[i]) BETWEEN 2 AND 30 AND NOT regexp_matches(l[i], '{spans.MARKUP}')),
    r AS (SELECT doc_id, t, s, i, {_POINTS} + CASE WHEN length(s) BETWEEN 2 AND 8 THEN 1 WHEN length(s) > 20 THEN -1 ELSE 0 END AS score FROM u)
    SELECT doc_id, rank, s AS span, instr(t, s) AS place, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, length(s) DESC, i) AS rank FROM r) WHERE rank <= 20""")
def answer_spans(spark, d):
    found = table(spark, d, "documents").select("doc_id", F.posexplode(spans.answer_spans(F.col("text"), SPANS)).alias("i", "x"))
    return found.select("doc_id", (F.col("i") + 1).cast("long").alias("rank"), "x.span", F.col("x.place").cast("long").alias("place"), "x.score")


def _ends(c: str, ends: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '[^{ends}]*[{ends}]|[^{ends}]+$'), lambda x: {strip_sql('x')}), lambda x: x <> '')"


_SIGNED = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+')[1:256])"


@named(f"""WITH p AS (SELECT conv_id, turn, {collapse_sql("coalesce(answer, '')")} AS t, {_SIGNED.format("coalesce(question, '')")} AS told FROM ({PAIRS})),
    s AS (SELECT *, {_ends("t", spans.SENTENCE_ENDS)} AS a, {_ends("t", spans.CLAUSE_ENDS)} AS b FROM p),
    v AS (SELECT conv_id, turn, t, told, list_filter(CASE WHEN len(a) <= 1 AND length(t) >= 160 AND len(b) > 0 THEN b ELSE a END, lambda x: length(x) >= 8)[1:256] AS l FROM s),
    w AS (SELECT conv_id, turn, t, told, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM v),
    u AS (SELECT conv_id, turn, i - 1 AS i, l[i] AS u, CASE WHEN len(told) = 0 THEN 0.0 ELSE len(list_intersect(told, {_SIGNED.format("l[i]")})) / len(told) END AS share FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM w)),
    k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY share DESC, i) AS rank FROM u),
    n AS (SELECT *, sum(length(u) + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS upto, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) AS pos FROM k
      WHERE EXISTS (SELECT 1 FROM k m WHERE m.conv_id = k.conv_id AND m.turn = k.turn AND m.rank <= 2 AND abs(m.i - k.i) <= 1)),
    e AS (SELECT conv_id, turn, string_agg(u, chr(10) ORDER BY i) AS excerpt, string_agg(i, ',' ORDER BY i) AS chosen, round(max(share), 6) AS best FROM n WHERE pos = 1 OR upto <= 360 GROUP BY ALL)
    SELECT w.conv_id, w.turn, coalesce(excerpt, substr(t, 1, 360)) AS excerpt, len(l) AS units, coalesce(chosen, '') AS chosen, coalesce(best, 0.0) AS best FROM w LEFT JOIN e ON w.conv_id = e.conv_id AND w.turn = e.turn""")
def premise_excerpts(spark, d):
    found = _pairs(spark, d).select("conv_id", "turn", spans.premise_excerpt(F.col("answer"), F.col("question"), "en").alias("x"))
    best = F.coalesce(F.try_element_at("x.best", F.lit(1))["score"], F.lit(0.0))
    return found.select("conv_id", "turn", "x.excerpt", F.col("x.units").cast("long").alias("units"), F.array_join("x.chosen", ",").alias("chosen"), F.round(best, 6).alias("best"))


_ORDER_GRAMS = " UNION ALL ".join(f"SELECT conv_id, turn, {n} AS n, {m} AS mine, unnest(list_transform(range(1, len({s}) - {n - 2}), lambda i: {s}[i:i + {n - 1}])) AS g FROM t" for n in bleu.ORDERS for m, s in ((1, "c"), (0, "r")))


@named(f"""WITH t AS (SELECT DISTINCT conv_id, turn, {metric_tokens_sql("answer")} AS c, {metric_tokens_sql("question")} AS r FROM ({PAIRS})),
    g AS ({_ORDER_GRAMS}), h AS (SELECT conv_id, turn, n, sum(least(a, b)) AS hit FROM (SELECT conv_id, turn, n, sum(mine) AS a, sum(1 - mine) AS b FROM g GROUP BY conv_id, turn, n, g) GROUP BY ALL),
    o AS (SELECT t.conv_id, t.turn, len(c) AS size, len(r) AS length, n.n, len(c) - n.n + 1 AS total, coalesce(hit, 0) AS hit FROM t JOIN (SELECT unnest([1, 2, 3, 4]) AS n) n ON true LEFT JOIN h ON t.conv_id = h.conv_id AND t.turn = h.turn AND n.n = h.n),
    z AS (SELECT *, sum(CASE WHEN total > 0 AND hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY n) AS missed FROM o)
    SELECT conv_id, turn, CASE WHEN max(size) = 0 OR max(CASE WHEN n = 1 THEN hit END) = 0 THEN 0.0 ELSE
      round(100 * CASE WHEN max(size) >= max(length) THEN 1.0 ELSE exp(1 - max(length) / max(size)) END * exp(avg(CASE WHEN total > 0 THEN ln(CASE WHEN hit = 0 THEN power(0.5, missed) ELSE hit END / total) END)), 6) END AS bleu FROM z GROUP BY conv_id, turn""")
def bleu_orders(spark, d):
    return bleu.bleu(_pairs(spark, d), ["conv_id", "turn"], "answer", "question")


# ---- quantiles, sessions, writers that write once


@named("SELECT source, q, round(CASE q WHEN 0.5 THEN a WHEN 0.9 THEN b ELSE c END, 6) AS quantile FROM (SELECT source, quantile_cont(length(text), 0.5) AS a, quantile_cont(length(text), 0.9) AS b, quantile_cont(length(text), 0.999) AS c FROM documents GROUP BY source), (SELECT unnest([0.5, 0.9, 0.999]) AS q)")
def length_quantiles(spark, d):
    docs = table(spark, d, "documents").select("source", F.length("text").alias("n"))
    return quantiles.exact_quantiles(docs, "n", [0.5, 0.9, 0.999], "source").withColumn("quantile", F.round("quantile", 6))


@named("""WITH m AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 3 HOURS THEN 1 ELSE 0 END AS first FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM m)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 3 HOURS AS stop, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    return sessions.sessions(table(spark, d, "events"), gap="3 hours")


@named("""SELECT a.event_id AS first_event_id, b.event_id AS then_event_id, a.user_id AS first_user_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 6 HOURS
    WHERE a.event_type = 'click' AND b.event_type = 'purchase'""")
def clicks_followed(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return sessions.followed(events.where("event_type = 'click'"), events.where("event_type = 'purchase'"), within="6 HOURS").select("first_event_id", "then_event_id", "first_user_id")


@unchecked
def progress_told(spark, d):
    """Events as progress of their users, an error as the final one, told six hours apart."""
    rows = table(spark, d, "events")
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return sessions.throttled(rows.select(F.col("user_id").cast("string").alias("task"), ms.alias("at_ms"), F.col("event_id").cast("string").alias("message"), (F.col("event_type") == "error").alias("final")), 6 * 3600 * 1000)


@named("SELECT event_id, user_id, event_type FROM events")
def events_appended_once(spark, d):
    """Events in four batches, one of them written twice."""
    log = exactly_once.AppendLog(spark, shared_folder(spark, "log"))
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    for batch in (0, 1, 1, 2, 3):
        log.append(rows.where(F.pmod(F.coalesce("event_id", F.lit(0)), F.lit(4)) == batch), batch)
    return log.rows()


@named("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def status_swapped(spark, d):
    """The latest event of each user, in a table that is swapped for each event type."""
    status = exactly_once.VersionedTable(spark, shared_folder(spark, "status"))
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    for kind in ("signup", "view", "click", "purchase", "error"):
        some = rows.where(F.col("event_type") == kind)
        status.change(lambda old, some=some: records.latest(some if old is None else old.unionByName(some), "user_id", "ts", "event_id"))
    return status.rows().select("user_id", "event_id", "event_type")


# ---- zipped documents: written in the shared folder, and read back


def _stored(spark, rows, name):
    folder = shared_folder(spark, name)
    rows.write.parquet(folder)
    return spark.read.parquet(folder)


@named(f"SELECT CAST(doc_id AS VARCHAR) AS path, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {collapse_sql('x')}), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM documents WHERE text IS NOT NULL")
def docx_round_trip(spark, d):
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    books = zip_sinks.archived(docs, lambda some: zip_sinks.docx([(0, x) for x in some["text"].iloc[0].split("\n")]), "doc_id")
    return zipped.docx_markdown(_stored(spark, books, "docx")).select("path", "text")


@named("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, CAST(n_chars AS VARCHAR) AS n_chars, text FROM documents")
def xlsx_round_trip(spark, d):
    bound_batches(spark)
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars", "text")
    write = lambda some: zip_sinks.xlsx(list(some.columns), [tuple(None if v is None or v != v else int(v) if hasattr(v, "dtype") else v for v in r) for r in some.itertuples(index=False)])
    return zipped.xlsx_table(_stored(spark, zip_sinks.archived(docs, write, "doc_id", 200), "xlsx")).select("doc_id", "lang", "n_chars", "text")


_TITLE = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("amp", "&")):
    _TITLE = f"replace({_TITLE}, '&{_name};', '{_char}')"


@named(f"SELECT CAST(page_id AS VARCHAR) AS path, {collapse_sql(_TITLE)} AS title FROM pages WHERE html IS NOT NULL AND regexp_matches(html, '<title>')")
def epub_titles(spark, d):
    pages = table(spark, d, "pages").where("html IS NOT NULL").where(F.contains("html", F.lit("<title>"))).select("page_id", "html")
    books = zip_sinks.archived(pages, lambda some: zip_sinks.epub("Pages", list(some["html"])), "page_id")
    return zipped.epub_chapters(_stored(spark, books, "epub")).select("path", "title")


@unchecked
def document_profiles(spark, d):
    """Title, head and signals of every document."""
    docs = table(spark, d, "documents")
    return profile.profiles(docs, "source").select("doc_id", "title", F.length("head").alias("head_chars"), "signals")
