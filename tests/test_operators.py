"""Evidence, coverage, chunk trees, classification, suites, consolidation, readers and writers against plain Python."""

import hashlib
import math
import random
from collections import Counter

import pyarrow as pa
import pytest

from docweave.functions import text as T
from docweave.operators import chunking, classify, consolidation, coverage, evidence, items, planning, records, retrieval, scoring, suite
from docweave.sinks import writers
from docweave.sources import readers
from pyspark.sql import functions as F

CHUNKS = "doc_id long, chunk_index long, parent string, title_path string, text string, vector array<double>"
QUERIES = "query_id long, doc_id long, source_index long, query string, terms array<string>, vector array<double>, scope string"


# ---- evidence


def evidence_tables(spark, seed=3):
    rng = random.Random(seed)
    words = ["red", "fox", "dog", "log", "sun", "sky", "sea"]
    unit = lambda: (lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v])([rng.gauss(0, 1) for _ in range(4)])
    chunks = [(d, i, f"p{i // 3}" if rng.random() < 0.8 else None, f"T{d} > S{i // 3}", " ".join(rng.choice(words) for _ in range(rng.randrange(12))), unit()) for d in (1, 2) for i in range(9)]
    queries = [(q, 1 + q % 2, rng.randrange(9), " ".join(rng.sample(words, 3)), rng.choice([None, ["sun"], ["sky", "none"]]), unit(), rng.choice([*evidence.SCOPES, None])) for q in range(12)]
    return chunks, queries, spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(queries, QUERIES)


def slow_rank(chunks, query, k=3, rerank=12):
    qid, doc, source, text, terms, qv, scope = query
    terms, scope = terms or [], scope or "source_primary"
    mine = [c for c in chunks if c[0] == doc]
    tokens = {c[1]: set(c[4].split()) for c in mine}
    df = Counter(t for ts in tokens.values() for t in ts)
    idf = lambda t: math.log((len(mine) + 1) / (df[t] + 0.5)) + 1 if t in df else 1.0
    wanted = set(text.split()) | {t for x in terms for t in x.split()}
    src = next(c for c in mine if c[1] == source)
    rows = []
    for c in mine:
        dense = sum(a * b for a, b in zip(qv, c[5], strict=True))
        overlap = sum(idf(t) for t in wanted & tokens[c[1]]) / sum(map(idf, wanted))
        cover = sum(t in (c[3] + "\n" + c[4]).lower() for t in terms) / len(terms) if terms else 0
        lexical = min(1, 0.75 * overlap + 0.25 * cover)
        same, beside = c[2] is not None and c[2] == src[2], abs(c[1] - source) == 1
        a, b = set(src[3].split(" > ")), set(c[3].split(" > "))
        structure = min(1, 0.55 * same + 0.25 * beside + 0.2 * len(a & b) / len(a | b) + 0.15 * (same and scope != "source_primary") + 0.08 * (scope == "cross_chunk" and lexical > 0))
        fused = 0.68 / 0.92 * max(0, min(1, (dense + 1) / 2)) + 0.24 / 0.92 * lexical + 0.08 * structure
        rows.append(dict(chunk=c[1], dense=dense, lexical=lexical, structure=structure, fused=fused, cover=cover, same=same, beside=beside, own=c[1] == source, c=c))
    rows.sort(key=lambda r: -r["fused"])
    return rows, src, terms, scope


def slow_select(rows, src, terms, scope, chunks, policy, budget, k=3):
    gap = rows[0]["fused"] - rows[1]["fused"]
    ok = lambda r: (r["lexical"] >= 0.08 if not terms else r["cover"] >= 0.34 or r["lexical"] >= 0.18) and (gap >= 0.008 or r["lexical"] >= 0.24 or r["structure"] >= 0.45)
    others = [r for r in rows[:10] if not r["own"]]
    near = next((r for r in others if r["same"] or r["beside"]), None)
    decided = "source_primary"
    if scope != "source_primary" and policy != "source_primary":
        if policy == scope == "cross_chunk" and ok(others[0]) and others[0]["fused"] >= 0.42:
            decided = "cross_chunk"
        elif near and ok(near) and (near["fused"] >= 0.38 or near["structure"] >= 0.45):
            decided = "same_section"
    hits = [r for r in rows if not r["own"]][:k]
    size = lambda c: len(c[3]) + 1 + len(c[4])
    left, out = max(1000, budget) - size(src), []
    for i, r in enumerate(hits, 1):
        if decided == "source_primary" or decided == "same_section" and not (r["same"] or r["beside"]) or size(r["c"]) > left:
            continue
        left -= size(r["c"])
        n = sum(h["c"][2] == r["c"][2] for h in hits)
        children = sum(c[0] == src[0] and c[2] == r["c"][2] for c in chunks)
        merged = r["same"] and n >= 2 and n / max(1, children - 1) >= 0.5
        out.append((r["chunk"], i, "auto_merged_section_context" if merged else "same_section_context" if r["same"] or r["beside"] else "related_context"))
    return decided, out


def test_evidence_against_plain_python(spark):
    chunks, queries, c, q = evidence_tables(spark)
    rank = evidence.ranked(evidence.scored_pairs(c, q)).cache()
    got = {}
    for r in rank.collect():
        got.setdefault(r["query_id"], []).append(r)
    decisions = evidence.scope_decision(rank, q, "cross_chunk").cache()
    scopes = {r["query_id"]: r["scope"] for r in decisions.collect()}
    chosen = {}
    for r in evidence.selected(evidence.hits(rank), decisions, c, 1000).collect():
        chosen.setdefault(r["query_id"], []).append((r["chunk_index"], r["hit"], r["role"]))
    for query in queries:
        rows, src, terms, scope = slow_rank(chunks, query)
        mine = sorted(got[query[0]], key=lambda r: r["rank"])
        assert [r["chunk_index"] for r in mine] == [r["chunk"] for r in rows]
        for a, b in zip(mine, rows, strict=True):
            assert [a[x] for x in ("dense", "lexical", "structure", "fused")] == pytest.approx([b[x] for x in ("dense", "lexical", "structure", "fused")], abs=1e-7)
        assert mine[0]["gap_next"] == pytest.approx(rows[0]["fused"] - rows[1]["fused"], abs=1e-7)
        decided, want = slow_select(rows, src, terms, scope, chunks, "cross_chunk", 1000)
        assert scopes[query[0]] == decided and sorted(chosen.get(query[0], [])) == sorted(want)
    texts = evidence.unit_texts(evidence.selected(evidence.hits(rank), decisions, c), q, c).collect()
    assert len(texts) == len(queries) and all(r["unit_text"].startswith("[Main]\nT") for r in texts)
    assert evidence.ranked(evidence.scored_pairs(c.limit(0), q)).count() == 0 and evidence.ranked(evidence.scored_pairs(c, q.limit(0))).count() == 0


def test_pairs_of_evidence_are_shuffled_without_texts(spark):
    """Pairs know the size of their chunk in place of its text, title and vector."""
    chunks, _, c, q = evidence_tables(spark)
    pairs = evidence.scored_pairs(c, q)
    assert not {"text", "title_path", "vector"} & set(pairs.columns)
    sizes = {(x[0], x[1]): len(x[3]) + 1 + len(x[4]) for x in chunks}
    assert all(r["size"] == sizes[r["doc_id"], r["chunk_index"]] for r in pairs.collect())


def test_evidence_budget_skips_what_does_not_fit(spark):
    rows = [(1, i, "p", None, text, [1.0]) for i, text in enumerate(["s" * 100, "a" * 950, "b" * 800])]
    q = spark.createDataFrame([(7, 1, 0, "aa", None, [1.0], "same_section")], QUERIES)
    c = spark.createDataFrame(rows, CHUNKS)
    rank = evidence.ranked(evidence.scored_pairs(c, q))
    wide = spark.createDataFrame([(7, "same_section", "x")], "query_id long, scope string, reason string")
    assert [r["chunk_index"] for r in evidence.selected(evidence.hits(rank), wide, c, 1000).collect()] == [2]


def test_lexical_scores_with_terms(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue dog"), (3, None), (4, "北京大学")], "doc_id long, text string")
    idf = math.log(5 / 1.5) + 1
    got = {r["doc_id"]: r["score"] for r in retrieval.lexical_scores(docs, "red zebra", ("Dog",)).collect()}
    total = idf * 2 + 1
    assert got == pytest.approx({1: round(0.75 * idf / total, 6), 2: round(0.75 * idf / total + 0.25, 6)}, abs=1e-6)
    assert {r["doc_id"] for r in retrieval.lexical_scores(docs, "北京").collect()} == {4}


# ---- coverage


def test_coverage_against_plain_python(spark):
    rng = random.Random(1)
    values = [(g, f"u{i}", round(rng.random(), 3)) for g in "ab" for i in range(40)] + [("c", "u", 0.0), ("c", "v", 1.0)]
    negatives = [round(rng.random(), 3) for _ in range(300)] + [0.0] * 9
    best = spark.createDataFrame(values, "g string, unit string, s double")
    got = {r["g"]: (r["recall"], r["n"]) for r in coverage.coverage_recall(best, spark.createDataFrame([(x,) for x in negatives], "s double"), "g").collect()}
    share = lambda s: sum(x <= s for x in negatives) / len(negatives)
    for g, (recall, n) in got.items():
        mine = [math.sqrt(s * share(s)) for k, _, s in values if k == g]
        assert (recall, n) == (pytest.approx(sum(mine) / len(mine), abs=2e-6), len(mine))
    none = coverage.coverage_recall(best, spark.createDataFrame([], "s double"), "g")
    assert {r["recall"] for r in none.collect()} == {0.0}
    assert [r["unit"] for r in coverage.worst_units(best.where("g = 'c'"), "g", 1).collect()] == ["u"]


def test_best_similarity_and_negatives(spark):
    units = spark.createDataFrame([(1, "a", [1.0, 0.0]), (1, "b", [-1.0, 0.0]), (2, "a", [0.6, 0.8]), (3, "a", [0.0, -1.0])], "g long, unit string, vector array<double>")
    answers = spark.createDataFrame([(1, [0.6, 0.8]), (2, [0.0, 1.0])], "g long, vector array<double>")
    assert {(r["g"], r["unit"]): r["s"] for r in coverage.best_similarity(units, answers, "g").collect()} == {(1, "a"): 0.6, (1, "b"): 0.0, (2, "a"): 0.8, (3, "a"): 0.0}
    assert coverage.nearest_other(coverage.centroids(units, "g"), "g").count() == 3
    assert coverage.negatives(units, answers, "g").count() == 4


def test_coverage_self_against_plain_python(spark):
    units = [(1, "a", "red fox", [1.0, 0.0]), (1, "b", "blue sky", [0.0, 1.0]), (1, "c", "sea", [0.6, 0.8])]
    items = [(1, 5, "a fox", [1.0, 0.0], [0.8, 0.6], [0.6, 0.8])]
    chance = [0.1, 0.5, 0.7]
    got = coverage.coverage_self(
        spark.createDataFrame(units, "g long, unit string, text string, vector array<double>"), spark.createDataFrame(items, "g long, item long, answer string, vector array<double>, question_vector array<double>, answer_vector array<double>"),
        spark.createDataFrame([(x,) for x in chance], "s double"), spark.createDataFrame([(1, 0.49)], "g long, recall double"), "g",
    ).first()
    dot = lambda a, b: max(0, sum(x * y for x, y in zip(a, b, strict=True)))
    anchor = {"a": 2 / 3, "b": 0.0, "c": 0.0}  # bigrams of afox: af, fo, ox
    p = [math.sqrt(s * sum(c <= s for c in chance) / 3) for s in (dot(u[3], items[0][3]) for u in units)]
    r = [(dot(u[3], items[0][4]) + max(dot(u[3], items[0][5]), anchor[u[1]]) + x) / 3 for u, x in zip(units, p, strict=True)]
    c = [max(0, x - sum(r) / 3) for x in r]
    own = sum(x * y for x, y in zip(c, p, strict=True)) / sum(c)
    assert (got["self"], got["score"]) == (pytest.approx(own, abs=2e-6), pytest.approx(math.sqrt(0.49 * own), abs=2e-6))


# ---- chunks and trees


def test_section_chunks_and_tree(spark):
    long = "First one. " * 30
    text = f"before\n\n# A\n\nshort\n\n## B {{#b}}\n\n{long}\n\nsecond paragraph\n\n# C\n\n# D\ntail"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "no heads")], "doc_id long, text string")
    rows = chunking.section_chunks(docs, 120).orderBy("doc_id", "chunk_index").collect()
    mine = [r for r in rows if r["doc_id"] == 1]
    assert [r["title_path"] for r in mine if r["parts"] == 1] == ["Preface", "A", "D"] and [r["title_path"] for r in rows if r["doc_id"] == 4] == ["Preface"]
    b = [r for r in mine if r["title_path"].startswith("A > B")]
    assert [r["title_path"] for r in b] == [f"A > B > Part {i}/{len(b)}" for i in range(1, len(b) + 1)] and all(len(r["text"]) <= 120 and r["text"].startswith("## B\n") for r in b)
    letters = lambda s: [c for c in s if c.isalpha()]
    assert letters("".join(r["text"].removeprefix("## B\n") for r in b)) == letters(long + "second paragraph")
    paths = chunking.index_paths(chunking.section_chunks(docs, 120).where("doc_id = 1"))
    assert [(r["title_path"], r["index_path"], r["parent_path"]) for r in paths.orderBy("chunk_index").collect()][:3] == [("Preface", "1", ""), ("A", "2", ""), (f"A > B > Part 1/{len(b)}", "2/1/1", "2/1")]
    tree = {r["node"]: (r["parent"], r["title"], r["n_leaves"]) for r in chunking.document_tree(paths).collect()}
    assert tree["2"] == ("", "A", 1 + len(b)) and tree["2/1"] == ("2", "B", len(b)) and tree["3"] == ("", "D", 1)
    assert [(r["level"], r["link"], r["line"]) for r in chunking.contents(docs, 2).orderBy("place").collect()][:2] == [(1, "#a", "- [A](#a)"), (2, "#b", "  - [B](#b)")]
    assert [(r["title"], r["before"], r["after"]) for r in chunking.neighbours(docs).where("title = 'B'").collect()] == [("B", "A", "C")]


def test_units_and_windows(spark):
    text = "第一条 甲乙丙丁戊己庚。\n续行文字也在这里。\n第二条 子丑寅卯辰巳午未；申酉。短。"
    docs = spark.createDataFrame([(1, text), (2, "x, " * 60), (3, None), (4, "same text here. same text here.")], "doc_id long, text string")
    got = {}
    for r in chunking.units(docs, 5).orderBy("doc_id", "unit").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert got == {1: ["第一条 甲乙丙丁戊己庚。", "续行文字也在这里。", "第二条 子丑寅卯辰巳午未；"], 4: ["same text here. same text here."]}
    tokens = spark.createDataFrame([(1, list(range(10))), (2, [1]), (3, [])], "doc_id long, tokens array<int>")
    assert [(r["doc_id"], list(r["tokens"])) for r in chunking.token_windows(tokens, 4, 1).orderBy("doc_id", "chunk_index").collect()] == [(1, [0, 1, 2, 3]), (1, [3, 4, 5, 6]), (1, [6, 7, 8, 9]), (2, [1])]
    code = spark.createDataFrame([(1, "import os\ndef a():\n  pass\ndef b():\n  pass")], "doc_id long, text string")
    assert [r["text"] for r in chunking.of_code(code, "python", 20).collect()] == ["import os", "a():\n  pass", "b():\n  pass"]


def test_chunk_quality_reasons(spark):
    rows = [(1, 0, "见附件", 0.0, None), (1, 1, "Total", 0.0, None), (1, 2, "The permit is required. " * 9, 0.95, "A > B"), (1, 3, None, 0.0, None), (1, 4, "1234 5678 %% " * 3, 0.0, None)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_index long, text string, adjacent double, title string")
    got = {r["chunk_index"]: (r["status"], r["quality"], list(r["reasons"])) for r in scoring.chunk_quality(df, "title").collect()}
    assert got[0][0] == got[1][0] == got[3][0] == "drop" and got[2] == ("usable", 1.0, ["high_adjacent_duplicate"])
    assert "symbol_digit_ratio_abnormal" in got[4][2] and got[1][2] == ["short_without_structure", "title_only"]


# ---- plans


def test_plans(spark):
    quotas = planning.largest_remainder(spark.createDataFrame([("a", 5), ("b", 3), ("c", 0)], "t string, n long"), "t", "n", 4)
    plan = planning.typed_plan(quotas, "t").cache()
    assert Counter(r["t"] for r in plan.collect()) == {"a": 3, "b": 1} and sorted(r["slot"] for r in plan.collect()) == [1, 2, 3, 4]
    items = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(8)], "i long, t string")
    got = planning.match_plan(plan, items, "t", "i").collect()
    assert sorted(r["i"] for r in got) == [0, 1, 2, 5] and sorted(r["slot"] for r in got) == [1, 2, 3, 4]
    files = spark.createDataFrame([(x,) for x in "abc"], "f string")
    assert [r["limit"] for r in planning.batch_limits(files, "f", 8).orderBy("f").collect()] == [3, 3, 2]
    units = planning.unit_modes(spark.createDataFrame([("leaf",), ("section",), ("leaf",)], "unit_type string"))
    assert {(r["kind"], r["value"]): r["n"] for r in planning.plan_summary(units).collect()} == {("unit_type", "leaf"): 2, ("unit_type", "section"): 1, ("mode", "point"): 2, ("mode", "summary"): 1}


def test_many_groups_get_their_quota(spark):
    rng = random.Random(2)
    weights = {i: rng.randrange(50) for i in range(300)}
    got = {r["k"]: r["quota"] for r in planning.largest_remainder(spark.createDataFrame(list(weights.items()), "k long, w long"), "k", "w", 1000).collect()}
    s = sum(weights.values())
    want = {k: 1000 * w // s for k, w in weights.items()}
    for k in sorted(weights, key=lambda k: (-(1000 * weights[k] % s), k))[: 1000 - sum(want.values())]:
        want[k] += 1
    assert got == want


def test_stratified_split(spark):
    rows = spark.createDataFrame([(i, "a" if i < 80 else "b" if i < 83 else None) for i in range(85)] + [(0, "a")], "k long, l string")
    got = scoring.stratified_split(rows, "k", "l").collect()
    assert len(got) == 86 and len({r["split"] for r in got if r["k"] == 0}) == 1
    n = Counter((r["l"], r["split"]) for r in got if not (r["k"] == 0))
    assert Counter(r["split"] for r in got if r["l"] == "b") == {"test": 1, "dev": 1, "train": 1} and n[(None, "train")] == 2
    first = got[0]["k"]
    assert sum(v for (lab, s), v in n.items() if lab == "a" and s == "test") in (7, 8) and first is not None


# ---- classification


def test_rules(spark):
    R, L = classify.Rule, classify.Label
    labels = [L("x", "A", "B", "C", 5, (R(("ｆｏｘ", "dog"), "all", 5),), (R(("cat",), weight=9),)), L("y", "A", "B", "D", 0, (R(("fox",), weight=4),)), L("z", "E", "F", "G", 0, (R((r"\bF[o0]x\b",), "regex", 4, case_sensitive=True),)), L("w", "H", "I", "J", 0, (R(("elephant",), "fuzzy", 4, threshold=0.7),)), L("n", "N", "N", "N", 9, (R(("fox",), "none", 50),))]
    docs = spark.createDataFrame([(1, "The Fox and the Ｄｏｇ"), (2, "fox dog cat"), (3, "an elefant here"), (4, "nothing"), (5, None), (1, "The Fox and the Ｄｏｇ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in classify.classify(docs, labels, fallback=("none", "", "")).collect()}
    assert [(got[i]["label_id"], got[i]["level1"]) for i in (1, 2, 3, 4, 5)] == [("x", "A"), ("y", "A"), ("w", "H"), (None, "none"), (None, "none")]
    r = got[1]
    assert (r["score"], r["route"], r["level2_confidence"], r["level3_confidence"], r["label_confidence"]) == (5.05, round(5.05 / 10.05, 4), round(5.05 / 6.05, 4), round(5.05 / 10.05, 4), round(5.05 / 10.05, 4))
    assert classify.classify(docs.limit(0), labels).count() == 0 and classify.classify(docs, []).where("label_id IS NOT NULL").count() == 0
    kinds = spark.createDataFrame([("see GB/T 123",), ("GB 5",), ("Q/GDW 11",), ("x",)], "t string")
    assert [r[0] for r in kinds.select(classify.standard_kind(F.col("t"))).collect()] == ["国家标准(推荐)", "国家标准", "企业标准", None]
    ids = classify.label_ids(spark.createDataFrame([("b", "x"), ("a", "y")], "level1 string, level2 string"), "level1", "level2")
    assert {(r["level1"], r["level1_id"], r["level2_id"]) for r in ids.collect()} == {("a", 0, 1), ("b", 1, 0)}
    rows = spark.createDataFrame([("a", ["a", "b"]), ("b", ["a", "b"]), ("c", None)], "t string, r array<string>")
    assert classify.top_accuracy(rows, "t", "r", 2).first()["accuracy"] == 0.666667
    assert [tuple(r) for r in classify.confusions(spark.createDataFrame([("a", "b"), ("a", "b"), ("c", "a"), ("a", "a")], "t string, p string"), "t", "p", 1).collect()] == [("a", "b", 2)]


# ---- suites, records, consolidation


def test_suite_helpers(spark):
    rows = spark.createDataFrame([(1, "", None, False), (2, "llm", 0.4, False), (3, None, None, True)], "id long, method string, average double, filtered boolean")
    new = spark.createDataFrame([(1, "llm", 0.9), (2, "llm", 0.1)], "id long, method string, average double")
    got = {r["id"]: (r["method"], r["average"], r["filtered"]) for r in suite.write_back(rows, new, "id", 0.5).collect()}
    assert got == {1: ("llm", 0.9, True), 2: ("llm", 0.4, False), 3: (None, None, True)}
    assert {r["id"]: r["average"] for r in suite.write_back(rows, new, "id", 0.5, force=True).collect()} == {1: 0.9, 2: 0.1, 3: None}
    maps = spark.createDataFrame([({"a": "0.5", "b": "x", "c": "1"},), ({},)], "m map<string,string>")
    assert [r[0] for r in maps.select(suite.map_average(F.col("m"))).collect()] == [0.75, None]
    assert suite.timing(spark.createDataFrame([(2, 3.0), (0, 1.0)], "n long, s double"), "n", "s").first()["s_each"] == 2.0


def test_records_patch_and_delete(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", True), (None, "c", None)], "id long, v string, is_active boolean")
    ids = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    assert sorted((str(r["id"]), r["v"]) for r in records.patch(old, "id", ids, v="z").collect()) == [("1", "z"), ("2", "b"), ("None", "c")]
    gone = {r["id"]: (r["is_active"], r["review_status"]) for r in records.soft_delete(old, "id", ids).collect()}
    assert gone[1] == gone[9] == (False, "deleted") and gone[2] == (True, None)
    left, backup = records.hard_delete(old, "id", ids)
    assert left.count() == 2 and [r["v"] for r in backup.collect()] == ["a"]
    assert old.where(records.filters({"v": ["a", "b"], "id": ("min", 2), "is_active": None})).count() == 1
    assert old.where(records.contains_anywhere("A", "v")).count() == 1 and old.where(records.tri_state("is_active", "false")).count() == 1
    flags = spark.createDataFrame([("", "{}"), ("llm", None), (None, '{"a":1}'), (None, None)], "m string, s string")
    assert flags.where(records.evaluated("m", "s")).count() == 2
    many = spark.range(1000).selectExpr("(id * 7919) % 1000 AS k")
    assert all(r["k"] + 1 == r["row"] for r in records.numbered(many, "k").collect())
    new = spark.createDataFrame([(1, "n", 5)], "id long, v string, extra int")
    assert [(r["v"], r["extra"]) for r in records.upsert(old, new, "id").where("id = 1").collect()] == [("n", 5)]


def test_consolidation(spark):
    left = spark.createDataFrame([("q", "a", None, 1)], "question string, answer string, note string, n long")
    full = spark.createDataFrame([("q", "a", "old", 1), ("q", "a", "new", 2), ("x", "y", "z", 3)], "question string, answer string, note string, at long")
    assert [tuple(r) for r in consolidation.overlaid(left, full, "at").collect()] == [("q", "a", 1, "new", 2)]
    primary = spark.createDataFrame([("p1",), ("p2",)], "id string")
    variants = spark.createDataFrame([("p1", "v2", 0.9), ("p1", "v1", 0.2)], "variant_of string, id string, score double")
    nested = consolidation.with_variants(primary, variants, "id", "variant_of", "id")
    assert {r["id"]: [v["id"] for v in r["variants"]] for r in nested.collect()} == {"p1": ["v1", "v2"], "p2": []}
    assert {r["id"]: len(r["variants"]) for r in consolidation.with_variants(primary, variants, "id", "variant_of", "id", 0.5).collect()} == {"p1": 1, "p2": 0}
    assert sorted((r["id"], r["variant_of"]) for r in consolidation.flattened_variants(nested).collect()) == [("p1", None), ("p2", None), ("v1", "p1"), ("v2", "p1")]
    facts = spark.createDataFrame([("f", 0.5, 2), ("f", 0.5, 1), ("f", None, 0)], "fact string, confidence double, at long")
    assert [r["at"] for r in consolidation.best_facts(facts, "fact", "confidence", "at").collect()] == [1]
    chunks = spark.createDataFrame([(1, 0, "x [[IMAGE_REF:a]]"), (1, 1, "[[IMAGE_REF:a]] [[IMAGE_REF:b]]")], "doc_id long, chunk_index long, text string")
    from docweave.functions.text import image_refs

    assert sorted(tuple(r) for r in consolidation.marker_places(chunks, image_refs(F.col("text")), "chunk_index").collect()) == [(1, "a", 0), (1, "b", 1)]


# ---- readers and writers


def test_more_readers(spark, tmp_path):
    (tmp_path / "gb.txt").write_bytes("中文".encode("gb18030"))
    (tmp_path / "bom.txt").write_bytes(b"\xef\xbb\xbfabc")
    assert sorted(r["text"] for r in readers.text_files(spark, str(tmp_path / "*.txt")).collect()) == ["abc", "中文"]
    files = spark.createDataFrame([("a.pdf", b"x"), ("b.txt", b"\0"), ("c", b"a\0b"), ("d", b"plain text\n"), ("e", bytes([1, 2, 3]) + b"abc")], "path string, content binary")
    assert {r["path"]: r["needs_scan"] for r in readers.needs_scan(files).collect()} == {"a.pdf": True, "b.txt": False, "c": True, "d": False, "e": True}
    (tmp_path / "data").write_text('{"q": "a"}\n{"q": "b"}\n')
    (tmp_path / "list").write_text('[{"q": "a"},\n {"q": "b"}]')
    (tmp_path / "table").write_text('q,r\n"a,\nb",2\n')
    assert sorted(r["q"] for r in readers.sniffed(spark, str(tmp_path / "data"), "q string").collect()) == ["a", "b"]
    assert sorted(r["q"] for r in readers.sniffed(spark, str(tmp_path / "list"), "q string").collect()) == ["a", "b"]
    assert [tuple(r) for r in readers.sniffed(spark, str(tmp_path / "table"), "q string").collect()] == [("a,\nb", "2")]
    (tmp_path / "s.jsonl").write_text('{"q": "a"}\nbroken\n')
    with pytest.raises(Exception, match=r"(?s).+"):
        readers.jsonl(spark, str(tmp_path / "s.jsonl"), "q string", strict=True).collect()
    assert tuple(readers.bad_lines(readers.jsonl(spark, str(tmp_path / "s.jsonl"), "q string")).first()) == (2, 1)


def test_columns_and_rows(spark):
    assert readers.resolved_columns(["Q", "答案", "x"]) == {"question": "Q", "answer": "答案"}
    with pytest.raises(ValueError):
        readers.resolved_columns(["x"])
    df = spark.createDataFrame([("1", " q ", "a", "c  d"), (None, "q", "a", "c d"), ("2", "", "a", "c")], "id string, question string, answer string, context string")
    rows = readers.canonical_rows(df, "set").collect()
    assert sorted(r["id"][:10] for r in rows)[1] == "human:set:" and len({r["group_id"] for r in rows}) == 1 and len(rows) == 2
    triples = readers.triples(spark.createDataFrame([(i, "c", "q" if i % 2 else " ", "a") for i in range(6)], "n long, context string, question string, answer string"), "n", "t-", 4).collect()
    assert sorted(r["id"] for r in triples) == ["t-0001", "t-0002", "t-0003"]
    multi = [("1", "q", ["yes"], [(False, ["no", "yes here"]), (True, ["chosen", "x" * 50])])]
    kind = "question_id string, question string, answers array<string>, documents array<struct<is_selected:boolean,paragraphs:array<string>>>"
    assert readers.multi_document(spark.createDataFrame(multi, kind), 2, 20).first()["context"] == "yes here\nchosen\nno"
    assert (readers.column_letter(27), readers.column_index("AB"), readers.sheet_header(["a", None, "a", ""])) == ("AB", 27, ["a", "B", "a__1", "D"])
    assert readers.taxonomy(["A", "  B", "    C", "    C", "  D", "    E"]) == [("A", "B", "C"), ("A", "D", "E")]
    assert readers.resolved_ranges("2-9,20", 5) == [(2, 5)] and readers.resolved_ranges("", 3) == [(1, 3)]
    pages = spark.createDataFrame([(1, "http://h.org/x", '<a href="/a/1">x</a><a href="https://o.net/b">y</a>')], "page_id long, url string, html string")
    assert [r["link"] for r in readers.links(pages, host="h.org", path="^/a/").collect()] == ["https://h.org/a/1"]
    assert readers.shared_columns(df, df.drop("id"))["partial"] == ["id"] and readers.preview(df, 1)["total"] == 3
    assert readers.long_answers(spark.createDataFrame([("a。" * 9,), ("a",), ("b" * 20,)], "answer string"), 5, 50).count() == 1


def test_writers(spark, tmp_path):
    items = spark.createDataFrame([("q", "a", ["x", "y"], 0.5, None), (None, "b", None, None, "src")], "question string, answer string, similar_questions array<string>, average_score double, source string")
    rows = writers.exam_rows(items).collect()
    assert [tuple(r)[2:5] for r in rows] == [("q", "x || y", "a"), ("", "", "b")] and rows[0][9] == "平均得分: 0.5000" and [r[8] for r in rows] == ["文本内容", "src"]
    writers.write_exam_csv(items, str(tmp_path / "exam"))
    assert readers.csv(spark, str(tmp_path / "exam")).count() == 2
    store = spark.createDataFrame([("1", "中文字", "a", [("2", "v", "w")])], "id string, question string, answer string, variants array<struct<id:string,question:string,answer:string>>")
    got = {r["id"]: (r["question"], r["to_embed"], r["variant_of"]) for r in writers.store_rows(store, {"question": 7}).collect()}
    assert got == {"1": ("中文", "中文字 [SEP] a", None), "2": ("v", "v [SEP] w", "1")}
    chunks = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "doc_id long, chunk_index long, text string")
    assert [tuple(r) for r in writers.chunk_files(chunks, F.lit("doc")).orderBy("file").collect()][1] == ("doc_part002.md", "<!-- part 2 of 2 -->\n\ny")
    meta = spark.createDataFrame([("a" * 30, "b")], "x string, y string")
    full, small = F.struct("x", "y"), F.struct("y")
    assert [r[0] for r in meta.select(writers.detail_levels([full, small], F.struct(F.lit(1).alias("n")), 20)).collect()] == ['{"y":"b"}']
    assert [r[0] for r in meta.select(writers.detail_levels([full, small], F.struct(F.lit(1).alias("n")), 5)).collect()] == ['{"n":1}']


def test_upsert_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "n", 3)], "id int, v string, w int")
    new = spark.createDataFrame([(1, "x", None), (1, "y", None), (2, None, 5), (2, "z", 5), (None, "m", 1)], "id int, v string, w int")
    got = sorted(map(tuple, records.upsert(old, new, "id").collect()), key=str)
    assert got == sorted([(1, "y", 1), (1, "y", 2), (2, "z", 5), (None, "m", 1), (None, "n", 3)], key=str)


def test_plan_of_judged_items_stays_small(spark):
    four = ["a", "b", "c", "d"]
    df = spark.createDataFrame([("q", "B", "e", "f", "mcq", four)], "q string, answer string, explanation string, fact string, type string, options array<string>")
    plan = items.validated(df, "en", options="options")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000
    objects = df.drop("options").withColumn("options", F.array(*[F.struct(F.lit(x.lower()).alias("label"), F.lit(f"option {x}").alias("text")) for x in "DBCA"]))
    row = items.validated(objects, "en", options="options").first()
    assert row["reason"] == "ok" and row["item"]["options"] == [f"option {x}" for x in "ABCD"] and row["item"]["answer"] == "option B"
    short = objects.withColumn("options", F.slice("options", 1, 3))
    assert items.validated(short, "en", options="options").first()["reason"] == "mcq_invalid_options"


def test_source_labels_by_place(spark):
    rows = [("第一条 x 第二条 y", 3), ("aaaa 第二条 y", 1), ("第一条 x 第二条 y", 7), ("", 1), (None, 1)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string, n int").select(T.source_label(F.col("t"), F.col("n"))).collect()]
    assert got == ["第一条", None, "第二条", None, None]
    facts = [("第一条 甲乙。第二条 丙丁。", "丙丁"), ("第一条 甲乙。第二条 丙丁。", "见第一条 丙丁"), ("甲 第三条 乙", "甲"), ("甲 第三条 乙 第四条", ""), ("甲 第三条 乙 第四条", "无"), ("第一条 甲 第一条 乙", "乙")]
    got = [r[0] for r in spark.createDataFrame(facts, "t string, f string").select(T.source_of_fact(F.col("t"), F.col("f"))).collect()]
    assert got == ["第二条", "第一条", "第三条", None, None, "第一条"]


def test_vectors_and_overlaps_of_whole_batches(spark):
    from docweave.functions.text import lexical_tokens

    rows = spark.createDataFrame([(1, "Red fox red"), (2, None), (3, "北京大学 x1"), (4, "!")], "doc_id long, text string")
    words = {r["doc_id"]: r["t"] for r in rows.select("doc_id", lexical_tokens(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    got = {r["doc_id"]: r["vector"] for r in evidence.with_hashed_vectors(rows, 8, vector="text").collect()}
    for k, ws in words.items():
        counts = [0.0] * 8
        for w in ws:
            counts[int(hashlib.md5(w.encode()).hexdigest()[:4], 16) % 8] += 1
        norm = math.sqrt(sum(x * x for x in counts))
        assert got[k] == [x / norm if norm else 0.0 for x in counts]
    # meetings of tokens are cut into steps, queries stay whole
    docs = pa.array([[{"query_id": 7, "tokens": ["a", "b", "a"]}, {"query_id": 8, "tokens": ["zz"]}, {"query_id": 9, "tokens": ["b"]}], []])
    chunks = pa.array([[{"chunk_index": 0, "tokens": ["a", "b"]}, {"chunk_index": 1, "tokens": ["b"]}], [{"chunk_index": 5, "tokens": ["a"]}]])
    a, b = math.log(3 / 1.5) + 1, math.log(3 / 2.5) + 1
    want = {(7, 0): 1.0, (7, 1): b / (a + b), (9, 0): 1.0, (9, 1): 1.0}
    for step in (1, 2, 100):
        found = {(q, c): o for x in evidence._overlaps(docs, chunks, step) for q, c, o in zip(*x, strict=True)}
        assert found == pytest.approx(want)


def test_compared_pairs_as_columns_do(spark):
    rows = [(1, [0.5, 0.5], [1.0, 0.0, 9.0], "afox", "fox"), (2, None, [1.0], "", "a"), (3, [0.25, None], [2.0, 3.0], "红狐狸ab", "狐狸x"), (4, [1.0], [0.5], "ab", "abab")]
    pairs = spark.createDataFrame(rows, "k long, u array<double>, v array<double>, t string, a string")
    want = pairs.select("k", F.coalesce(retrieval.dot(F.col("u"), F.col("v")), F.lit(0.0)).alias("s"), scoring.lexical_anchor(F.col("t"), F.col("a")).alias("x"))
    got = coverage.compared(pairs, {"s": ("u", "v")}, ("t", "a")).select("k", "s", F.round(F.col("hits") / F.col("grams"), 6).alias("x"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_coverage_takes_no_product_in_interpreted_arrays(spark):
    """Products of 64 components and bigrams of pairs are taken by batch, and pairs are computed once."""
    units = spark.createDataFrame([(1, "a", [1.0])], "g long, unit string, vector array<double>")
    plan = coverage.best_similarity(units, units, "g")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan
