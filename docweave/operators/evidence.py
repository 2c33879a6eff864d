"""Evidence for questions: chunks of the question's document, ranked by dense, lexical and structural scores, and chosen under a budget.

``chunks``: doc_id, chunk_index, parent, title_path, text, vector (array<double>). ``queries``: query_id, doc_id,
source_index (the chunk the question came from), query, terms (array of terms that should occur), vector, scope
(source_primary, same_section, cross_chunk). A question is compared with the chunks of its own document only: all joins
are equalities on the document or the query.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..functions.text import jaccard, lexical_tokens, title_parts
from .retrieval import dot

SCOPES = ("source_primary", "same_section", "cross_chunk")
_RANKED = ("dense", "lexical", "structure", "fused")


def _unit_counts(words: pa.Array, size: int) -> pa.Array:
    words = pc.split_pattern(words.cast(pa.large_string()), " ")
    codes = words.flatten().dictionary_encode()  # a word is hashed once a batch
    places = np.array([int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % size if t else size for t in codes.dictionary.to_pylist()], dtype=np.int64)
    at = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    counts = np.bincount(at * (size + 1) + places[codes.indices.to_numpy()], minlength=len(words) * (size + 1)).reshape(len(words), size + 1)[:, :size].astype(np.float64)
    unit = counts / np.sqrt(np.maximum((counts * counts).sum(axis=1), 1.0))[:, None]
    return pa.ListArray.from_arrays(np.arange(len(words) + 1, dtype=np.int32) * size, unit.ravel())


def with_hashed_vectors(rows: DataFrame, size: int = 64, **texts: str) -> DataFrame:
    """``rows`` with vectors of the columns that ``texts`` names: the unit vector of token counts by a hash of the token, a stand-in, equal everywhere, for an embedding model. Zero without tokens."""
    names = [*rows.columns, *texts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                columns = batch.slice(at, 1024).columns
                kept = len(columns) - len(texts)
                yield pa.RecordBatch.from_arrays([*columns[:kept], *(_unit_counts(x, size) for x in columns[kept:])], names)

    words = [F.array_join(lexical_tokens(F.coalesce(c, F.lit(""))), " ") for c in texts.values()]
    schema = StructType([*rows.schema, *(StructField(n, ArrayType(DoubleType())) for n in texts)])
    return rows.select("*", *[w.alias(f"__words{i}") for i, w in enumerate(words)]).mapInArrow(run, schema)


def _lists(column: pa.Array, *names: str) -> tuple:
    """Of a column of arrays of structs: the row of each struct, and its fields."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    inner = column.flatten()
    return np.repeat(np.arange(len(column)), sizes), *[pc.struct_field(inner, [n]) for n in names]


def _overlaps(queries: pa.Array, chunks: pa.Array, step: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """query_id, chunk_index and overlap for rows that are documents, about ``step`` meetings of a query's token with a chunk's at a time."""
    (q_doc, q_id, q_tokens), (c_doc, c_index, c_tokens) = _lists(queries, "query_id", "tokens"), _lists(chunks, "chunk_index", "tokens")
    q_id, c_index = (x.to_numpy(zero_copy_only=False) for x in (q_id, c_index))
    flat = pa.concat_arrays([q_tokens.flatten(), c_tokens.flatten()]).dictionary_encode()
    codes, n = flat.indices.to_numpy().astype(np.int64), max(1, len(flat.dictionary))
    size = lambda tokens: tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    q_row, c_row = np.repeat(np.arange(len(q_id)), size(q_tokens)), np.repeat(np.arange(len(c_index)), size(c_tokens))
    # different tokens of each query and chunk, those of the chunks in order of document and token
    q_row, q_code = np.divmod(np.unique(q_row * n + codes[: len(q_row)]), n)
    c_row, c_code = np.divmod(np.unique(c_row * n + codes[len(codes) - len(c_row) :]), n)
    c_key = c_doc[c_row] * n + c_code
    order = np.argsort(c_key, kind="stable")
    c_row, (keys, first, df) = c_row[order], np.unique(c_key[order], return_index=True, return_counts=True)
    q_key = q_doc[q_row] * n + q_code
    place = np.minimum(np.searchsorted(keys, q_key), max(0, len(keys) - 1))
    known = keys[place] == q_key if len(keys) else np.zeros(len(q_key), bool)
    df, first = (np.where(known, x[place], 0) if len(keys) else np.zeros(len(q_key), np.int64) for x in (df, first))
    idf = np.where(known, np.log((np.bincount(c_doc, minlength=len(queries))[q_doc[q_row]] + 1) / (df + 0.5)) + 1, 1.0)
    total = np.bincount(q_row, idf, len(q_id))
    ends = np.cumsum(np.bincount(q_row, df, len(q_id)))  # meetings by query
    bounds = np.unique(np.searchsorted(ends, np.arange(step, (ends[-1] if len(ends) else 0) + step, step), side="left"))
    for lo, hi in zip([0, *(bounds + 1)], [*(bounds + 1), len(q_id)]):  # queries are whole
        a, b = np.searchsorted(q_row, [lo, hi])
        count = df[a:b]
        if not count.sum():
            continue
        other = c_row[np.repeat(first[a:b] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        pairs, at = np.unique(np.repeat(q_row[a:b], count) * len(c_index) + other, return_inverse=True)
        q, c = np.divmod(pairs, len(c_index))
        yield q_id[q], c_index[c], np.bincount(at, np.repeat(idf[a:b], count)) / total[q]


def lexical_overlap(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id``, ``chunk_index``, ``overlap``: share of the query's idf weight that the chunk's tokens have; pairs without a common token are absent.

    idf is ln((N + 1) / (df + 0.5)) + 1 over the N chunks of the document; tokens that no chunk has weigh 1. Tokens of the terms belong to the query.
    Texts of chunks and queries are shuffled by their document, tokens are not: they meet in a row that is as large as the document.
    """
    terms = F.filter(F.coalesce("terms", F.array().cast("array<string>")), lambda t: t.isNotNull())
    q = queries.groupBy("doc_id").agg(F.collect_list(F.struct("query_id", F.concat(F.array(F.coalesce("query", F.lit(""))), terms).alias("texts"))).alias("q"))
    c = chunks.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_index", F.coalesce("text", F.lit("")).alias("text"))).alias("c"))
    q_tokens = F.transform("q", lambda x: F.struct(x["query_id"].alias("query_id"), F.flatten(F.transform(x["texts"], lexical_tokens)).alias("tokens")))
    c_tokens = F.transform("c", lambda x: F.struct(x["chunk_index"].alias("chunk_index"), lexical_tokens(x["text"]).alias("tokens")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in _overlaps(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "chunk_index", "overlap"])

    return q.join(c, "doc_id").select(q_tokens.alias("q"), c_tokens.alias("c")).mapInArrow(run, "query_id long, chunk_index long, overlap double")


def scored_pairs(chunks: DataFrame, queries: DataFrame, weights: tuple[float, float, float] = (0.68, 0.24, 0.08), semantic: bool = False) -> DataFrame:
    """Every query with every chunk of its document: dense, lexical, structure, fused, coverage of terms, same_parent, adjacent, is_source, and the chunk's ``size`` in a unit's text.

    lexical is 0.75 of the overlap and 0.25 of the terms that title or text contain. structure is 0.55 for the source's
    parent, 0.25 for a neighbour, 0.20 of the titles' Jaccard, 0.15 for the same parent in a wider scope, 0.08 for any lexical
    score across chunks, 1 at most. ``semantic`` ranks by the dense score alone. Nulls are empty texts, zero vectors and the narrow scope. Pairs leave texts and vectors behind before they are shuffled.
    """
    wd, wl, ws = (max(0.0, w) for w in weights)
    wl, ws = (0.0, 0.0) if semantic else (wl, min(0.5, ws))
    wd = wd if wd + wl > 0 else 1.0
    source = chunks.select(F.col("doc_id").alias("sd"), F.col("chunk_index").alias("si"), F.col("parent").alias("source_parent"), title_parts(F.col("title_path")).alias("source_titles"))
    q = queries.select("query_id", "doc_id", "source_index", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.col("vector").alias("qv"), F.coalesce("scope", F.lit(SCOPES[0])).alias("scope"))
    q = q.join(source, (F.col("doc_id") == F.col("sd")) & (F.col("source_index") == F.col("si")), "left").drop("sd", "si")
    sized = chunks.select("doc_id", "chunk_index", "parent", "title_path", "text", "vector", F.length(chunk_in_unit(F.col("title_path"), F.col("text"))).alias("size"))
    rows = q.join(sized, "doc_id")
    target = F.lower(F.concat_ws("\n", F.coalesce("title_path", F.lit("")), F.coalesce("text", F.lit(""))))
    hits = F.size(F.filter("terms", lambda t: (t != "") & F.contains(target, F.lower(t))))
    coverage = F.when(F.size("terms") > 0, hits / F.size("terms")).otherwise(0.0)
    same = F.coalesce((F.col("parent") == F.col("source_parent")) & (F.col("parent").cast("string") != ""), F.lit(False))
    adjacent = F.coalesce(F.abs(F.col("chunk_index") - F.col("source_index")) == 1, F.lit(False))
    rows = rows.withColumns({
        "dense": F.round(F.coalesce(dot(F.col("qv"), F.col("vector")), F.lit(0.0)), 9), "coverage": coverage, "same_parent": same, "adjacent": adjacent,
        "title_overlap": jaccard(F.coalesce("source_titles", F.array().cast("array<string>")), title_parts(F.col("title_path"))), "is_source": F.coalesce(F.col("chunk_index") == F.col("source_index"), F.lit(False)),
        "n_terms": F.size("terms"),
    }).drop("terms", "text", "title_path", "vector", "qv", "source_parent", "source_titles")
    rows = rows.join(lexical_overlap(chunks, queries), ["query_id", "chunk_index"], "left")
    rows = rows.withColumn("lexical", F.round(F.least(F.lit(1.0), 0.75 * F.coalesce("overlap", F.lit(0.0)) + 0.25 * F.col("coverage")), 9))
    value = lambda c, v: F.when(c, v).otherwise(0.0)
    same = F.col("same_parent")
    structure = value(same, 0.55) + value(F.col("adjacent"), 0.25) + 0.20 * F.col("title_overlap") + value(same & F.col("scope").isin(*SCOPES[1:]), 0.15) + value((F.col("scope") == SCOPES[2]) & (F.col("lexical") > 0), 0.08)
    rows = rows.withColumn("structure", F.round(F.least(F.lit(1.0), structure), 9))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("dense") + 1) / 2))
    fused = F.round(wd / (wd + wl) * unit + wl / (wd + wl) * F.col("lexical") + ws * F.col("structure"), 9)
    keep = ("query_id", "doc_id", "source_index", "scope", "chunk_index", "parent", "size", "dense", "lexical", "structure", "coverage", "same_parent", "adjacent", "is_source", "n_terms")
    return rows.select(*keep, fused.alias("fused"))


def ranked(pairs: DataFrame, k: int = 3, rerank: int = 12) -> DataFrame:
    """The pool of each query (the best dense and the best lexical chunks) with dense_rank, lexical_rank, rank, gap_next and gap_last.

    The pool takes max(rerank, k + 3) of each kind, the rank is by the fused score; ties follow the dense rank, and that follows the
    chunk's place. The gaps are those from the first fused score to the second and to the k-th (null for a pool of one, or k = 1).
    """
    depth = max(k, rerank, 1, k + 3)
    by = lambda *order: F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    rows = pairs.withColumn("dense_rank", by(F.desc("dense"), "chunk_index"))
    rows = rows.withColumn("lexical_rank", by(F.desc("lexical"), "dense_rank"))
    rows = rows.where((F.col("dense_rank") <= depth) | (F.col("lexical_rank") <= depth))
    came = F.when(F.col("dense_rank") <= depth, F.col("dense_rank")).otherwise(depth + F.col("lexical_rank"))
    rows = rows.withColumn("rank", by(F.desc("fused"), came))
    whole = Window.partitionBy("query_id")
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("fused"))).over(whole)
    last = F.max(F.when(F.col("rank") == F.least(F.lit(max(1, k)), F.col("pool")), F.col("fused"))).over(whole)
    rows = rows.withColumn("pool", F.count("*").over(whole))
    return rows.withColumns({"gap_next": F.round(at(1) - at(2), 9), "gap_last": F.round(at(1) - last, 9) if k > 1 else F.lit(None).cast("double")}).drop("pool")


def hits(rank: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` best chunks of each query that are not its source."""
    best = Window.partitionBy("query_id").orderBy("rank")
    return rank.where(~F.col("is_source")).withColumn("hit", F.row_number().over(best)).where(F.col("hit") <= k)


def scope_decision(rank: DataFrame, queries: DataFrame, policy: str, k: int = 3) -> DataFrame:
    """``query_id``, ``scope`` that the evidence supports, ``reason``.

    ``policy`` is the widest scope allowed and the query's own scope the widest wanted. A wider scope needs evidence among the first
    max(10, k + 3) ranks: for the section the best chunk of the same parent or beside the source, with a fused score of 0.38 or
    structure of 0.45; across chunks the best chunk of all, with 0.42. Both need lexical evidence (0.08 without terms; with terms a coverage of
    0.34 or 0.18) and a clear first place (a gap of 0.008, or lexical 0.24, or structure 0.45).
    """
    near = F.col("same_parent") | F.col("adjacent")
    words = F.when(F.col("n_terms") == 0, F.col("lexical") >= 0.08).otherwise((F.col("coverage") >= 0.34) | (F.col("lexical") >= 0.18))
    clear = F.col("gap_next").isNull() | (F.col("gap_next") >= 0.008) | (F.col("lexical") >= 0.24) | (F.col("structure") >= 0.45)
    fine = words & clear
    seen = rank.where((F.col("rank") <= max(10, k + 3)) & ~F.col("is_source"))
    seen = seen.select("query_id", "rank", near.alias("near"), (fine & ((F.col("fused") >= 0.38) | (F.col("structure") >= 0.45))).alias("same_ok"), (fine & (F.col("fused") >= 0.42)).alias("cross_ok"))
    best = seen.groupBy("query_id").agg(F.min_by("cross_ok", "rank").alias("cross_ok"), F.min_by(F.when(F.col("near"), F.col("same_ok")), F.when(F.col("near"), F.col("rank"))).alias("same_ok"))
    rows = queries.select("query_id", F.when(F.col("scope").isin(*SCOPES), F.col("scope")).otherwise(SCOPES[0]).alias("hint")).join(best, "query_id", "left")
    wider = F.col("hint") != SCOPES[0]
    across = F.lit(policy == SCOPES[2]) & (F.col("hint") == SCOPES[2]) & F.coalesce("cross_ok", F.lit(False))
    section = wider & F.coalesce("same_ok", F.lit(False))
    narrow = F.lit(policy not in SCOPES[1:])
    scope = F.when(narrow | ~wider, SCOPES[0]).when(across, SCOPES[2]).when(section, SCOPES[1]).otherwise(SCOPES[0])
    reason = F.when(narrow, "policy_source_primary").when(~wider, "hint_source_primary").when(across, "cross_chunk_evidence_approved").when(section, "same_section_evidence_approved").otherwise("evidence_not_confident")
    return rows.select("query_id", scope.alias("scope"), reason.alias("reason"))


def chunk_in_unit(title: Column, text: Column) -> Column:
    """A chunk as it stands in a unit's text: its title path, if it has one, above it."""
    return F.concat_ws("\n", F.nullif(F.coalesce(title, F.lit("")), F.lit("")), F.coalesce(text, F.lit("")))


def selected(found: DataFrame, decisions: DataFrame, chunks: DataFrame, budget: int = 6000) -> DataFrame:
    """``query_id``, ``chunk_index``, ``hit``, ``role`` of the hits that the decided scope admits and the budget holds.

    In rank order a hit is taken if it still fits in what the source chunk leaves of max(1000, ``budget``) characters; one that doesn't is
    skipped. Roles: auto_merged_section_context, if half of the parent's other chunks, and two at least, are hits of the same section;
    same_section_context; related_context. At most k hits of a query are folded in one row.
    """
    size = F.length(chunk_in_unit(F.col("title_path"), F.col("text")))
    source = chunks.select("doc_id", F.col("chunk_index").alias("source_index"), size.alias("source_size"))
    children = chunks.groupBy("doc_id", "parent").agg(F.count("*").alias("children"))
    rows = found.drop("scope").join(decisions, "query_id").join(source, ["doc_id", "source_index"], "left").join(children, ["doc_id", "parent"], "left")
    of_parent = F.count("*").over(Window.partitionBy("query_id", "parent"))
    share = of_parent / F.greatest(F.lit(1), F.col("children") - F.col("same_parent").cast("int"))
    near = F.col("same_parent") | F.col("adjacent")
    role = F.when(F.col("same_parent") & (share >= 0.5) & (of_parent >= 2), "auto_merged_section_context").when(near, "same_section_context").otherwise("related_context")
    rows = rows.withColumn("role", role)
    rows = rows.where((F.col("scope") == SCOPES[2]) | ((F.col("scope") == SCOPES[1]) & near))
    rows = rows.select("query_id", "source_size", F.struct("hit", "chunk_index", "size", "role").alias("x"))
    folded = rows.groupBy("query_id").agg(F.first("source_size").alias("source_size"), F.array_sort(F.collect_list("x")).alias("xs"))
    kind = "array<struct<hit:int,chunk_index:bigint,size:int,role:string>>"
    start = F.struct((F.lit(max(1000, budget)) - F.coalesce("source_size", F.lit(0))).cast("int").alias("left"), F.array().cast(kind).alias("taken"))
    item = lambda x: F.array(F.struct(x["hit"].cast("int").alias("hit"), x["chunk_index"].cast("long").alias("chunk_index"), x["size"].cast("int").alias("size"), x["role"].alias("role")))
    step = lambda s, x: F.when(s["left"] >= x["size"], F.struct((s["left"] - x["size"]).cast("int").alias("left"), F.concat(s["taken"], item(x)).alias("taken"))).otherwise(s)
    taken = folded.select("query_id", F.explode(F.aggregate("xs", start, step)["taken"]).alias("x"))
    return taken.select("query_id", "x.chunk_index", "x.hit", "x.role")


def unit_texts(chosen: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id``, ``unit_text``: the source chunk, then the chosen chunks of its section, then related ones, each under a line that says what it is."""
    body = chunks.select("doc_id", "chunk_index", chunk_in_unit(F.col("title_path"), F.col("text")).alias("body"))
    main = queries.select("query_id", "doc_id", F.col("source_index").alias("chunk_index"), F.lit(0).alias("place"), F.lit(0).alias("hit"))
    more = chosen.join(queries.select("query_id", "doc_id"), "query_id").select("query_id", "doc_id", "chunk_index", F.when(F.col("role") == "related_context", 2).otherwise(1).alias("place"), "hit")
    rows = main.unionByName(more).join(body, ["doc_id", "chunk_index"]).select("query_id", F.struct("place", "hit", "body").alias("x"))
    head = F.create_map(*[F.lit(x) for pair in ((0, "[Main]"), (1, "[Same section]"), (2, "[Related]")) for x in pair])
    parts = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws("\n", head[x["place"]], x["body"]))
    return rows.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("unit_text"))
