"""Ranked lexical search over inverted treaps.

Documents are indexed in blocks, as they lie, and a block has for each term a treap: its documents in search order, the
contribution that the term makes to their scores in heap order, so that the root of a subtree bounds what the term can add anywhere
in it. All terms of a query go down their treaps together: a stretch of documents has a subtree for each
term, the sum of the roots bounds every score in the stretch, and a stretch that cannot enter the k best so far is
left out. The best bound goes first; a stretch is cut in two at the document of its strongest root.

Scores are whole numbers. A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))); in a document of n terms it adds
weight * (10**9 tf div (1000 tf + 20 m)), where m = 50 + 50 n N div L, N counts the documents with a term and L all their terms.
"""

from __future__ import annotations

import heapq
import math
import uuid
from bisect import insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir

#: A block ends at so many documents or postings, whichever comes first.
BLOCK_DOCS = 8192
BLOCK_POSTINGS = 500_000
#: Stretches of so few documents are scored one by one.
SHORT = 12
#: Queries are searched in blocks of about so many, and so many characters: what goes to every worker.
QUERY_ITEMS = 5_000
QUERY_CHARS = 16_000_000

_A, _Z, _LOWER = ord("A"), ord("Z"), ord("a") - ord("A")
_TERM = bytes(c + _LOWER if _A <= c <= _Z else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters, digits and all that is not ASCII; A to Z become small."""
    return text.translate(_TERM).split()


class Treap:
    """Places of a term's documents in rising order; ``worth`` is in heap order over ``left`` and ``right``. Equal worths are ordered by a hash, so that ties stay shallow."""

    __slots__ = ("docs", "left", "right", "root", "worth")

    def __init__(self, docs: list[int], worth: list[int]):
        n = len(docs)
        left, right = [-1] * n, [-1] * n
        spine: list[int] = []
        for i in range(n):
            below, w = -1, worth[i]
            while spine and (worth[j := spine[-1]] < w or worth[j] == w and (docs[j] * 0x9E3779B1 & 0xFFFFFFFF) < (docs[i] * 0x9E3779B1 & 0xFFFFFFFF)):
                below = spine.pop()
            left[i] = below
            if spine:
                right[spine[-1]] = i
            spine.append(i)
        self.docs, self.worth, self.left, self.right, self.root = docs, worth, left, right, spine[0] if spine else -1


class Block:
    """Treaps of a block, and its documents' contributions by term."""

    def __init__(self, ids: list, lengths: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, docs_all: int, terms_all: int):
        self.ids = [(x is None, 0 if x is None else x) for x in ids]
        m = 50 + (50 * lengths.astype(np.int64) * docs_all) // max(terms_all, 1)
        doc = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
        tf = tfs.astype(np.int64)
        worth = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        self.ends, self.terms, self.worth = ends.tolist(), terms.tolist(), worth.tolist()
        self.held: dict[int, dict[int, int]] = {}
        by_term = np.argsort(terms, kind="stable")
        cuts = np.flatnonzero(np.diff(terms[by_term], prepend=-1))
        self.treaps = {}
        for a, b in zip(cuts, np.append(cuts[1:], len(terms))[: len(cuts)], strict=True):
            rows = by_term[a:b]
            rows = rows[worth[rows] > 0]
            if len(rows):
                self.treaps[int(terms[by_term[a]])] = Treap(doc[rows].tolist(), worth[rows].tolist())

    def score(self, doc: int, query: list[int]) -> int:
        held = self.held.get(doc)
        if held is None:
            a, b = self.ends[doc - 1] if doc else 0, self.ends[doc]
            held = self.held[doc] = dict(zip(self.terms[a:b], self.worth[a:b], strict=True))
        return sum([held[t] for t in query if t in held])

    def search(self, query: list[int], k: int, best: list[tuple]) -> int:
        """Puts what belongs to the ``k`` best into ``best``: sorted (-score, id is null, id). Returns how many documents were scored."""
        ids, scored = self.ids, 0
        start = [(t, t.root) for x in query if (t := self.treaps.get(x))]
        queue = [(-sum(t.worth[r] for t, r in start), 0, len(ids), start)] if start else []
        while queue:
            bound, lo, hi, nodes = heapq.heappop(queue)
            if len(best) == k:
                if bound > best[-1][0]:
                    break
                if (bound, *ids[lo]) >= best[-1]:
                    continue
            if hi - lo <= SHORT:
                among = range(lo, hi)
            else:
                strongest, root = max(nodes, key=lambda x: x[0].worth[x[1]])
                cut = strongest.docs[root]
                among = [cut]
                below, above, low, high = [], [], 0, 0
                for t, x in nodes:  # the highest node of each side: a subtree reaches beyond its stretch
                    docs, left, right, y = t.docs, t.left, t.right, x
                    while x >= 0:
                        if (at := docs[x]) >= cut:
                            x = left[x]
                        elif at < lo:
                            x = right[x]
                        else:
                            below.append((t, x))
                            low += t.worth[x]
                            break
                    while y >= 0:
                        if (at := docs[y]) <= cut:
                            y = right[y]
                        elif at >= hi:
                            y = left[y]
                        else:
                            above.append((t, y))
                            high += t.worth[y]
                            break
                if below:
                    heapq.heappush(queue, (-low, lo, cut, below))
                if above:
                    heapq.heappush(queue, (-high, cut + 1, hi, above))
            for doc in among:
                scored += 1
                if score := self.score(doc, query):
                    found = (-score, *ids[doc])
                    if len(best) < k:
                        insort(best, found)
                    elif found < best[-1]:
                        best.pop()
                        insort(best, found)
        return scored


_INDEX = "n_docs long, n_terms long, found array<int>, df array<long>, lengths binary, ends binary, terms binary, tfs binary"


def _index(vocabulary: dict[bytes, int]):
    """Block after block of a task's documents; of their terms those in the vocabulary."""

    def block(kind: pa.DataType, docs: list[tuple]) -> pa.RecordBatch:
        docs.sort(key=lambda d: (d[0] is None, 0 if d[0] is None else d[0]))
        ends = np.cumsum([len(d[2]) for d in docs], dtype=np.int32)
        terms = np.array([t for d in docs for t in d[2]], np.int32)
        tfs = np.array([c for d in docs for c in d[2].values()], np.int32)
        found, df = np.unique(terms, return_counts=True)
        lengths = np.array([d[1] for d in docs], np.int64)
        arrays = [
            pa.array([[d[0] for d in docs]], pa.list_(kind)), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]), pa.array([found.tolist()], pa.list_(pa.int32())),
            pa.array([df.tolist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (lengths, ends, terms, tfs)),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["ids", *(x.split(" ")[0] for x in _INDEX.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, postings, kind = [], 0, None
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = terms_of(text or b"")
                    held = {vocabulary[w]: c for w, c in Counter(words).items() if w in vocabulary}
                    docs.append((i, len(words), held))
                    postings += len(held)
                    if len(docs) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                        yield block(kind, docs)
                        docs, postings = [], 0
        if docs:
            yield block(kind, docs)

    return run


def _search(queries: list[list[int]], weights: np.ndarray, k: int, docs_all: int, terms_all: int):
    """The ``k`` best of a task's blocks for each query; what the blocks before have found bounds the next one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        kind = None
        for batch in batches:
            kind = batch.schema.field("ids").type.value_type
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in ("ids", "lengths", "ends", "terms", "tfs")}
                read = lambda c, t: np.frombuffer(row[c], t)  # noqa: B023, E731
                block = Block(row["ids"], read("lengths", np.int64), read("ends", np.int32), read("terms", np.int32), read("tfs", np.int32), weights, docs_all, terms_all)
                for query, found in zip(queries, best, strict=True):
                    block.search(query, k, found)
        rows = [(q, None if null else i, -score) for q, found in enumerate(best) for score, null, i in found]
        if rows:
            q, i, score = zip(*rows, strict=True)
            pid = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(i, kind), pa.array(score, pa.int64()), pa.array([pid] * len(q), pa.int32())], ["query", "doc", "score", "pid"])

    return run


def _rank_block(docs: DataFrame, items: list, asked: list[set[bytes]], item_kind: str, k: int) -> DataFrame:
    spark, doc_kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*asked)))}
    top = f"{shared_dir(spark).rstrip('/')}/treaps-{uuid.uuid4().hex}"
    docs.mapInArrow(_index(vocabulary), f"ids array<{doc_kind}>, {_INDEX}").write.parquet(top)
    index = spark.read.parquet(top)
    docs_all, terms_all = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    each = index.select(F.explode(F.arrays_zip("found", "df")).alias("x")).groupBy("x.found").agg(F.sum("x.df").alias("df"))
    df = np.full(len(vocabulary), docs_all)
    for t, n in each.collect():  # a row for each term of the queries at most
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * docs_all + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)
    queries = [sorted((vocabulary[t] for t in terms), key=lambda i: -weights[i]) for terms in asked]
    found = index.select("ids", "lengths", "ends", "terms", "tfs").mapInArrow(_search(queries, weights, k, docs_all, terms_all), f"query int, doc {doc_kind}, score long, pid int")
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    some = found.withColumn("rank", F.row_number().over(Window.partitionBy("query", F.col("pid") % 64).orderBy(*order))).where(F.col("rank") <= k)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items)), f"query int, item {item_kind}")
    return ranked.join(F.broadcast(names), "query").select("item", "rank", "doc", "score")


def rank(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """``item_col``, rank, ``id_col``, score: the ``k`` best rows of ``docs`` for each item of ``queries``.

    Only scores above 0 count, so an item may have fewer, and one without terms has none. Equal scores rank by rising id, null ids last. A null text has no
    terms. Rows that repeat an id are documents of their own; rows that repeat an item's id are one item, with the terms of all. Further columns are ignored and may have any name.
    An empty table on either side has no result. Documents are neither collected nor shuffled: each task keeps k of
    them for each query. Queries, which go to every worker, are taken in blocks of a bounded size, each with a pass over the documents. The index lies in the shared folder.
    """
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kept = queries.select(F.col(item_col).alias("item"), F.col(query_col).cast("binary").alias("text")).where("text IS NOT NULL")
    n, size = kept.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / QUERY_ITEMS), math.ceil(size / QUERY_CHARS))
    out, kind = None, kept.schema["item"].dataType.simpleString()
    for b in range(blocks):
        asked: dict = {}
        for item, words in kept.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect():
            asked.setdefault(item, set()).update(terms_of(bytes(words)))
        one = _rank_block(text, list(asked), list(asked.values()), kind, k)
        out = one if out is None else out.unionByName(one)
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
