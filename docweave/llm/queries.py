"""The operators of this subpackage as named queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import bound_batches
from . import bpe_automaton, compaction, cover_tree, decontaminate, filter_audit, html_extract, language_id, license_scan, packing, simhash_dedup, token_counts, treap_search, warc_zstd

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of all documents, kept as a table, and their counts before and after three edits: one in the middle, a cut at a third, new text at the end."""
    trees = token_counts.tree_table(_table(spark, sf_dir, "documents"), BYTE_BPE, public_tokenizers.PATTERN)
    n = token_counts.n_chars(F.col("tree"))
    edit = lambda at, remove, put: F.struct(at.cast("int").alias("at"), F.lit(remove).alias("remove"), F.lit(put).alias("put"))
    edits = F.array(edit(n / 2, 0, " edited in 2024, twice"), edit(n / 3, 12, ""), edit(n + 10, 0, "\nThe end."))
    return token_counts.kept_counts(trees, BYTE_BPE, public_tokenizers.PATTERN, edits)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.licenses(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.to_json("matches").alias("matches"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_automaton.encode_digests(_table(spark, sf_dir, "documents"), WORD_BPE)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document through a sharded table that took eight arrivals and was compacted."""
    docs = _table(spark, sf_dir, "documents")
    out = compaction.shard(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(8)))
    return out.select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces_with_crc(_table(spark, sf_dir, "documents"), WORD_BPE)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap_search.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_EVERY = [op1_language_id, op2_token_counts, op3_license_scan, op4_warc, op5_embedding_dedup, op6_simhash_dedup, op7_bpe, op8_sharding, op9_decontamination, op10_html_extraction]
_EVERY += [op11_filter_audit, op12_packing, op13_ranked_search]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _EVERY}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        q AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM q WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, q.payload_digest,
               CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM q LEFT JOIN f ON q.payload_digest = f.payload_digest""",
    "op5_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
        ok AS (
            SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len(e) > 0
            AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(e, e) > 0),
        links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
        reach AS (
            SELECT vec_id AS node, vec_id AS other FROM v
            UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
        comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY 1),
        n AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = vec_id AS kept
        FROM v JOIN comp ON v.vec_id = comp.node LEFT JOIN n ON n.a = v.vec_id""",
    "op8_sharding": "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents",
    "op9_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k
            FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        dw AS (
            SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
        hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.k = win.k AND dw.n = win.n),
        words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
        items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op11_filter_audit": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
                   list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY 1),
        lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
        m AS (
            SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                   CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
                   + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
                   + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(d.doc_id > first_id, false) AS INT) AS mask
            FROM d JOIN firsts USING (t) LEFT JOIN lab ON d.doc_id = lab.doc_id),
        cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
        l AS (SELECT unnest([0, 1, 2, 3, 4]) AS i),
        p AS (SELECT [a.i, b.i, c.i, e.i, f.i] AS o FROM l a, l b, l c, l e, l f WHERE len(list_distinct([a.i, b.i, c.i, e.i, f.i])) = 5),
        s AS (
            SELECT array_to_string(list_transform(o, lambda i: substr('ABCDE', i + 1, 1)), '') AS filter_order, k AS step, 1 << o[k] AS f,
                   list_sum(list_transform(o[1 : k], lambda i: 1 << i)) - (1 << o[k]) AS b FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
        r AS (
            SELECT part, filter_order, step, f, sum(CASE WHEN mask & (b | f) = 0 THEN n ELSE 0 END) AS kept,
                   sum(CASE WHEN mask & b = 0 AND mask & f <> 0 THEN n ELSE 0 END) AS removed,
                   sum(CASE WHEN mask & b <> 0 AND mask & f <> 0 THEN n ELSE 0 END) AS redundant,
                   sum(CASE WHEN mask = f THEN n ELSE 0 END) AS unique_fails,
                   sum(CASE WHEN mask & b = 0 AND mask & f <> 0 THEN good ELSE 0 END) AS good_lost,
                   sum(CASE WHEN mask & b = 0 AND mask & f <> 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM (SELECT *, CAST(s.f AS BIGINT) AS f_, CAST(s.b AS BIGINT) AS b_ FROM cells, s) GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r""",
    "op13_ranked_search": rf"""
        WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents),
        q AS (SELECT item_id, unnest(list_distinct(flatten(list({_TERMS})))) AS term FROM benchmark GROUP BY item_id),
        s AS (SELECT count(*) AS n_all, CAST(sum(len(w)) AS BIGINT) AS l_all FROM d WHERE len(w) > 0),
        tf AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row_number() OVER () AS row, doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, s),
        imp AS (
            SELECT row, doc_id, term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_all) // l_all)))) AS x
            FROM tf JOIN w USING (term), s),
        scores AS (SELECT item_id, row, doc_id, CAST(sum(x) AS BIGINT) AS score FROM q JOIN imp USING (term) GROUP BY 1, 2, 3)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scores WHERE score > 0)
        WHERE rank <= 50""",
}
