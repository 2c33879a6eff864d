"""Filter orders, packing and ranked search against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations_with_replacement, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm import filter_audit, packing, queries, treap_search

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "part", "mask", "digest", "copy", "pid", "row", "n", "rest", "rank", "ids", "item", "query", "score", "doc")


def odd_docs(spark, schema=DOCS):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "", 0), (3, "  \n", None, None, None), (4, "12 34 %%", "en", "s", 8), (5, "the same text here", "en", "s", 1), (5, "the same text here", "en", "s", 1), (6, "the same text here", "fr", "t", 1), (None, "the same text here", "en", "s", 1), (7, "word " * 30000, "en", "s", 1), (8, "<|endoftext|> İstanbul ΣΑΣ é ǅ 中文\x1cx y", "en", "t", 1)]
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("clash") for c in CLASH})


# ---- filter orders


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6])
def test_exchanges_visit_every_order_once(n):
    order, seen = list(range(n)), [tuple(range(n))]
    for i in filter_audit.exchanges(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert sorted(seen) == sorted(permutations(range(n)))


def chain(docs, names):
    """Every order applied to masks, document by document."""
    out, credit = {}, Counter()
    for order in permutations(range(len(names))):
        alive = list(docs)
        for k, f in enumerate(order):
            gone = [d for d in alive if d[0] >> f & 1]
            alive = [d for d in alive if not d[0] >> f & 1]
            redundant = sum(d[0] >> f & 1 for d in docs) - len(gone)
            out["".join(names[i] for i in order), k + 1] = (len(alive), len(gone), redundant, sum(d[0] == 1 << f for d in docs), sum(d[1] for d in gone), f)
            credit[f] += len(gone)
    return {k: (*v[:5], credit[v[5]]) for k, v in out.items()}


@pytest.mark.parametrize("names", ["A", "AB", "ABCD", "ABCDE"])
def test_orders_by_brute_force(names):
    rng = random.Random(len(names))
    docs = [(rng.randrange(1 << len(names)), rng.randrange(2)) for _ in range(200)]
    cells = {m: [sum(d[0] == m for d in docs), sum(d[1] for d in docs if d[0] == m)] for m, _ in docs}
    got = {(o, s): tuple(rest) for o, s, *rest in filter_audit.orders(names, cells)}
    assert got == chain(docs, names) and len(got) == math.factorial(len(names)) * len(names)


def brute_masks(rows):
    smallest = {}
    for i, text, *_ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    for i, text, *_ in rows:
        t = text or ""
        words = [w.decode() for w in t.encode().split()]
        fails = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > smallest[t]]
        yield sum(f << b for b, f in enumerate(fails))


def test_audit_of_odd_documents(spark):
    docs = odd_docs(spark).withColumn("part", F.lit(1))
    labels = spark.createDataFrame([(5, 1, 0, "x"), (5, 0, 0, "x"), (6, 0, 1, "x"), (None, 1, 1, "x"), (4, None, 1, "x"), (99, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.audit_documents(docs, labels).collect()
    rows = [tuple(r)[:5] for r in docs.collect()]
    good, toxic = {5}, {6, 4}
    for part in {r[3] or "" for r in rows}:
        own = [(m, r[0]) for m, r in zip(brute_masks(rows), rows, strict=True) if (r[3] or "") == part]
        for kind, name in ((good, "good_lost"), (toxic, "toxic_lost")):
            want = chain([(m, int(i in kind)) for m, i in own], "ABCDE")
            assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r[name], r.shapley) for r in got if r.part == part} == want
    assert len(got) == 600 * len({r[3] or "" for r in rows})
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    assert filter_audit.audit_documents(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0
    with pytest.raises(ValueError):
        filter_audit.audit(docs, "ABCDEFGHIJ")


# ---- packing


def test_knapsack_by_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        size = 16
        prices = np.full(size + 1, -np.inf)
        for length in rng.choice(np.arange(1, size + 1), 4, replace=False):
            prices[length] = rng.random()
        lengths = [x for x in range(1, size + 1) if np.isfinite(prices[x])]
        best = max((sum(prices[x] for x in c) for n in range(size + 1) for c in combinations_with_replacement(lengths, n) if sum(c) <= size), default=0)
        worth, pattern = packing.knapsack(prices, size)
        assert worth == pytest.approx(best) == sum(prices[x] * k for x, k in pattern.items())
        assert sum(x * k for x, k in pattern.items()) <= size


def test_program_reaches_known_optima():
    def value(size, counts):
        h = np.zeros(size, np.int64)
        for length, n in counts.items():
            h[length] = n
        columns, v, bound = packing.generate(h, size, gap=0, rounds=500)
        covered = Counter()
        for pattern, times in columns:
            assert times >= -1e-9 and sum(x * k for x, k in pattern.items()) <= size
            covered.update({x: k * times for x, k in pattern.items()})
        assert all(covered[x] == pytest.approx(n) for x, n in counts.items()) and bound <= v + 1e-6
        return v, bound

    assert value(10, {6: 30, 4: 30}) == (pytest.approx(30), pytest.approx(30))
    # 7 takes a 3 each; of the other 3s three go together: falling lengths alone are worse on the next one
    assert value(10, {7: 4, 3: 7})[0] == pytest.approx(5)
    v, bound = value(16, {7: 12, 6: 12, 5: 24, 4: 12})
    assert bound == pytest.approx(v) and v < sum(t for _, t, _ in packing.falling(np.array([0, 0, 0, 0, 12, 24, 12, 12, *[0] * 8]), 16, whole=True))
    assert packing.generate(np.zeros(8, np.int64), 8) == ([], 0.0, 0.0)


@pytest.mark.parametrize(("seed", "n", "size"), [(0, 1, 8), (1, 50, 16), (2, 3000, 64), (3, 400, 256)])
def test_every_rest_has_a_place(seed, n, size):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.geometric(3 / size, n), size - 1)
    counts = np.bincount(lengths, minlength=size)
    p = packing.plan(counts, np.zeros(size, np.int64), size)
    rank, used = Counter(), defaultdict(list)
    for length in lengths.tolist():
        parts = packing._places(p, length, int(p.first[length]) + rank[length])
        rank[length] += 1
        assert sum(x[1] for x in parts) == length and [x[0] for x in parts] == [sum(y[1] for y in parts[:i]) for i in range(len(parts))]
        for _, k, sequence, offset in parts:
            used[sequence].append((offset, k))
    for parts in used.values():
        at = 0
        for offset, k in sorted(parts):
            assert offset == at
            at += k
        assert at == size or at & (at - 1) == 0
    assert sum(sum(k for _, k in parts) < size for parts in used.values()) <= size.bit_length()


def held_against_library(rows, pieces, size=4096):
    t = Tokenizer.from_file(queries.WORD_BPE)
    t.no_padding()
    t.no_truncation()
    want = Counter()
    found = defaultdict(list)
    for r in pieces:
        found[r.doc_id].append(r)
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want[i] += len(ids)
        raw = np.array(ids, "<u4")
        own = [r for r in found[i] if r.doc_tokens == len(ids)]
        assert own
        for r in own:
            assert r.start + r.length <= len(ids) and r.ids_crc32 == zlib.crc32(raw[r.start : r.start + r.length].tobytes()) or len([1 for j, _ in rows if j == i]) > 1
    assert {i: sum(r.length for r in rs) for i, rs in found.items()} == dict(want)
    used = defaultdict(list)
    for r in pieces:
        used[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in used.values():
        at = 0
        for offset, k in sorted(parts):
            assert offset == at
            at += k
        assert 0 < at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def test_packing_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(3)
    pieces = queries.op12_packing(spark, DATA).collect()
    assert held_against_library([(r.doc_id, r.text) for r in docs.collect()], pieces) == 0
    odd = odd_docs(spark)
    assert held_against_library([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], packing.pieces_with_crc(odd, queries.WORD_BPE).collect()) == 0
    assert packing.pieces_with_crc(odd.limit(0), queries.WORD_BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd, queries.WORD_BPE, size=1000)


def test_packing_returns_the_ids(spark):
    docs = odd_docs(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    packed = packing.pack(docs, queries.WORD_BPE, size=16)
    got = defaultdict(dict)
    for r in packed.with_ids().collect():
        got[r.id][r.start] = list(np.frombuffer(r.ids, "<u4"))
    t = Tokenizer.from_file(queries.WORD_BPE)
    for r in docs.collect():
        assert [x for _, part in sorted(got[r.doc_id].items()) for x in part] == [*t.encode(r.text or "", add_special_tokens=False).ids, 2]


def test_chunks_have_the_library_s_ids():
    t, ours, rng = Tokenizer.from_file(queries.WORD_BPE), packing.Ids(queries.WORD_BPE), random.Random(1)
    letters = ["a", "B", "é", "é", "́", "Σ", "İ", "中", "1", "'s", "'", ".", "--", " ", "\n", " ", " ", "\x1c", "\u0085", "ß", "ǅ", "😀", "<|", "<|endoftext|>", "K"]
    for _ in range(4000):
        text = "".join(rng.choices(letters, k=rng.randrange(1, 14)))
        assert list(np.frombuffer(ours.encode(text.encode()), ours.wide)) == t.encode(text, add_special_tokens=False).ids, repr(text)


# ---- ranked search


def brute_rank(docs, items, k):
    split = lambda t: treap_search.terms_of((t or "").encode())
    rows = [(i, Counter(w := split(t)), len(w)) for i, t in docs]
    n_all, l_all = sum(n > 0 for _, _, n in rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out, asked = {}, defaultdict(set)
    for item, text in items:
        asked[item] |= set(split(text))
    for item, terms in asked.items():
        found = []
        for i, c, n in rows:
            m = 50 + (50 * n * n_all) // max(l_all, 1)
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out |= {(item, r + 1): (None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k])}
    return out


def ranked(df):
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in df.collect()}


def test_terms():
    assert treap_search.terms_of("Ab1-C_d É中文 x.Y".encode()) == [b"ab1", b"c", b"d", "É中文".encode(), b"x", b"y"]


def test_search_by_brute_force(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    want = brute_rank([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert ranked(treap_search.rank(docs.repartition(5), items)) == want == ranked(queries.op13_ranked_search(spark, DATA))


def test_search_of_odd_tables(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, "the same word", "x"), (2, None, "x"), (3, "%%", "x"), (4, "here İstanbul 中文", "x"), (1, "text", "x"), (None, "text 12", "x"), (5, "absent", "x")], "item_id long, text string, rank string")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    for k in (1, 2, 50):
        assert ranked(treap_search.rank(docs, items, k)) == brute_rank(rows, asked, k)
    assert treap_search.rank(docs.limit(0), items).count() == 0 and treap_search.rank(docs, items.limit(0)).count() == 0
    named = treap_search.rank(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), items, 3)
    assert dict(named.dtypes)["doc_id"] == "string" and named.where("doc_id = 'd5'").count() > 0


def test_query_blocks_return_the_same(spark, monkeypatch):
    docs, items = odd_docs(spark), spark.createDataFrame([(i, t) for i, t in enumerate(["the same", "word", "here 12", "text"])], "item_id int, text string")
    want = ranked(treap_search.rank(docs, items))
    monkeypatch.setattr(treap_search, "QUERY_ITEMS", 2)
    assert ranked(treap_search.rank(docs, items)) == want


@pytest.mark.parametrize("copies", [1, 40])
def test_treaps_and_pruning(copies):
    rng = random.Random(copies)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.randrange(5, 60))) for _ in range(2000 // copies)] * copies
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    rows = [(i, Counter(w := t.split()), len(w)) for i, t in docs]
    number = {w: j for j, w in enumerate(words)}
    df = Counter(t for _, c, _ in rows for t in c)
    weights = np.array([math.floor(1000 * math.log((2 * len(rows) + 2) / (2 * df[w] + 1))) for w in words], np.int64)
    l_all = sum(n for _, _, n in rows)
    best, scored = [], 0
    query = [5, 20, 90, 200]
    for part in (rows[:900], rows[900:]):
        ends = np.cumsum([len(c) for _, c, _ in part])
        block = treap_search.Block([i for i, _, _ in part], np.array([n for _, _, n in part]), ends, np.array([number[t] for _, c, _ in part for t in c]), np.array([x for _, c, _ in part for x in c.values()]), weights, len(rows), l_all)
        for treap in block.treaps.values():
            assert treap.docs == sorted(treap.docs)
            for i, w in enumerate(treap.worth):
                assert all(j < 0 or treap.worth[j] <= w for j in (treap.left[i], treap.right[i])) and treap.left[i] < i
        scored += block.search(query, 10, best)
    want = brute_rank(docs, [(0, " ".join(words[q] for q in query))], 10)
    assert [(i, -s) for s, _, i in best] == list(want.values())
    assert scored < len(docs) / 2
