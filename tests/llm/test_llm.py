"""The ten operators and the pipeline against brute force, libraries and hand-made cases."""

import hashlib
import random
import re
import time

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from docweave.llm import bpe_automaton, common, compaction, cover_tree, decontaminate, html_extract, language_id, license_scan, queries, simhash_dedup, token_counts, warc_zstd

DATA = "/root/testdata/sf0.001"
SMALL = language_id.Settings(hidden=6, steps=32, sample_per_language=60, updates=60, batch=64)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def odd_docs(spark):
    """Nulls, empty and odd texts, repeated rows and ids, and columns that clash with inner names."""
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "  \n", None, None, None), (4, "12 34 %%", "en", "s", 8), (5, "the same text here", "en", "s", 1), (5, "the same text here", "en", "s", 1), (6, "The SAME  text\there", "fr", "s", 1), (None, "no id at all", "en", "s", 1), (7, "word " * 30000, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in ("fp", "id", "t", "rep", "node", "component", "score", "lang_pred", "n_words", "hit", "items", "text_col", "u", "v")})


def brute_simhash(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---- shared


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)] + [(5, 5), (7, None)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = [e for e in edges if e[1] is not None and e[0] != e[1]]
    assert got == components({x for e in real for x in e}, real)
    assert common.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- 1


def test_gradient_by_differences():
    net = language_id.Network(["a", "b"], 3, 1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    ids, y = rng.integers(97, 103, (6, 4)), np.array([0, 1, 1, 0])
    ids[4:, 1] = language_id.PAD
    _, grad = net.gradient(ids, y)
    for key in ("fx", "fh", "fb", "fo", "bx", "bh", "bb", "bo", "c"):
        at = np.unravel_index(np.argmax(np.abs(grad[key])), grad[key].shape)
        net.p[key][at] += 1e-2
        up = net.gradient(ids, y)[0]
        net.p[key][at] -= 2e-2
        down = net.gradient(ids, y)[0]
        net.p[key][at] += 1e-2
        assert grad[key][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4), key


def test_language_held_out(spark, docs):
    out = queries.op1_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"] and r["lang_pred"] != "und"]
    assert len(out) == docs.count() and np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_odd(spark):
    got = language_id.identify(odd_docs(spark), SMALL).collect()
    assert len(got) == 9
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    assert language_id.identify(spark.createDataFrame([], DOCS), SMALL).count() == 0
    unlearned = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(unlearned, SMALL).first()["lang_pred"] == "und"


def test_numerals_are_no_letters():
    assert not any(map(language_id.has_letter, ["½ ²", "①", "Ⅷ", "12 %", "", None, "_"])) and all(map(language_id.has_letter, ["ⅷ a", "中", "é"]))
    net = language_id.train([("en", ["some text"]), ("fr", ["un texte"])], SMALL)
    assert [x[0] for x in language_id.predict(net, ["½ ②", None], SMALL)] == ["und", "und"]


def test_pooling_of_stretches(docs):
    """Every byte is labelled once by states that read its surroundings: the same as each stretch alone, and close to one run over the whole text."""
    net = language_id.train([(r["lang"], [r["text"][:64], r["text"][-64:]]) for r in docs.limit(150).collect() if r["lang"] and r["text"]], SMALL)
    texts = [r["text"] for r in docs.orderBy(F.desc("n_chars")).limit(5).collect()] + ["é" * 50, "x", "a" * 96, "b" * 97]
    got = language_id.predict(net, texts, SMALL, columns=7)
    for t, (lang, score) in zip(texts, got, strict=True):
        data, total = t.encode(), np.zeros(len(net.labels))
        for at in range(0, len(data), SMALL.inner):
            window = [data[i] if 0 <= i < len(data) else language_id.PAD for i in range(at - SMALL.context, at + SMALL.inner + SMALL.context)]
            total += net.forward(np.array(window, np.int16)[:, None], SMALL.context)[:, 0]
        assert lang == net.labels[int(np.argmax(total))] and score == pytest.approx(total.max() / total.sum(), abs=1e-5)
        assert total.sum() == pytest.approx(len(data), rel=1e-3)
        whole = net.forward(np.frombuffer(data, np.uint8).astype(np.int16)[:, None])[:, 0]
        assert np.abs(total - whole).max() < 0.03 * len(data) + 1


def test_training_sample_is_bounded(spark):
    rows = [(1, "the same row", "en")] * 500 + [(i, f"text {i} of some length", f"l{i % 210}") for i in range(1000)]
    few = language_id.Settings(sample_per_language=2, windows=3, steps=8)
    got = language_id.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), few)
    assert len({lang for lang, _ in got}) > 200 and max(sum(lang == x for x, _ in got) for lang in ("en", "l3")) <= 2
    assert all(len(w) == 3 and all(len(x) <= 8 for x in w) for _, w in got)


# ---- 2


def test_counts_follow_edits():
    counter = token_counts.Counter(queries.BYTE_BPE, public_tokenizers.PATTERN)
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice("abc  \n\t'sll1 2.,é日") for _ in range(rng.randrange(120)))
        tree = token_counts.CountTree(text, counter, leaf=rng.choice([1, 2, 8]))
        for _ in range(4):
            at, cut, put = rng.randrange(len(text) + 3), rng.choice([0, 1, 9, 60]), "".join(rng.choice("ab '\n1") for _ in range(rng.choice([0, 1, 30])))
            tree.edit(at, cut, put)
            at = min(at, len(text))
            text = text[:at] + put + text[at + cut :]
            assert tree.text == text and tree.total == len(counter.encoding.encode_ordinary(text))


def test_kept_trees_edit_like_new_ones():
    counter, rng = token_counts.Counter(queries.BYTE_BPE, public_tokenizers.PATTERN), random.Random(6)
    for _ in range(200):
        text = "".join(rng.choice("abc  \n'sll1 2.,é日😀") for _ in range(rng.randrange(300)))
        leaf = rng.choice([1, 3, 16])
        tree = token_counts.CountTree.load(token_counts.CountTree(text, counter, leaf).kept(), counter, leaf)
        for _ in range(3):
            at, cut, put = rng.randrange(len(text) + 3), rng.choice([0, 1, 40]), "".join(rng.choice("ab '\n1") for _ in range(rng.choice([0, 2, 400])))
            tree.edit(at, cut, put)
            text = text[: min(at, len(text))] + put + text[min(at, len(text)) + cut :]
            kept = tree.kept()
            assert kept["text"] == text and kept["n_tokens"] == len(counter.encoding.encode_ordinary(text)) and kept["n_chars"] == len(text)
            assert kept["n_pretokens"] == len(counter.pattern.findall(text)) == len(kept["lengths"][1:]) // kept["lengths"][0]
            tree = token_counts.CountTree.load(kept, counter, leaf)


def test_counts_only_touched(spark):
    got = queries.op2_token_counts(spark, DATA).collect()
    assert sum(r["n_recoded"] for r in got) < 0.2 * sum(r["n_pretokens"] for r in got)
    none = F.lit(None).cast("array<struct<at:int,remove:int,put:string>>")
    odd = token_counts.edited_counts(odd_docs(spark), queries.BYTE_BPE, public_tokenizers.PATTERN, none).collect()
    assert len(odd) == 9 and all(r["n_tokens"] == r["n_tokens_edited"] for r in odd)


def test_counts_of_the_query(spark, docs):
    """The query's columns against a new encoding of the edited text."""
    counter = token_counts.Counter(queries.BYTE_BPE, public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op2_token_counts(spark, DATA).collect():
        t = texts[r["doc_id"]]
        n = len(t)
        new = t[: n // 2] + " edited in 2024, twice" + t[n // 2 :]
        new = new[: n // 3] + new[n // 3 + 12 :] + "\nThe end."
        assert (r["n_tokens"], r["n_tokens_edited"], r["n_chars_edited"]) == (len(counter.encoding.encode_ordinary(t)), len(counter.encoding.encode_ordinary(new)), len(new))


def test_trees_are_kept(spark):
    """Trees written as a table take later edits; what an edit doesn't touch is not encoded again."""
    text = "word another third " * 400
    df = spark.createDataFrame([(1, text, "clash"), (2, None, "clash"), (2, None, "clash"), (3, "", "clash")], "doc_id long, text string, edited string")
    trees = common.checkpoint(token_counts.with_trees(df, queries.BYTE_BPE, public_tokenizers.PATTERN))
    edit = F.array(F.struct(F.lit(3000).alias("at"), F.lit(5).alias("remove"), F.lit("NEW").alias("put")), F.lit(None))
    for _ in range(2):
        trees = common.checkpoint(token_counts.edit_trees(trees, edit, queries.BYTE_BPE, public_tokenizers.PATTERN))
        text = text[:3000] + "NEW" + text[3005:]
        rows = {r["doc_id"]: r for r in trees.select("*", token_counts.n_tokens(F.col("tree")).alias("n"), token_counts.tree_text(F.col("tree")).alias("now")).collect()}
        counter = token_counts.Counter(queries.BYTE_BPE, public_tokenizers.PATTERN)
        assert rows[1]["now"] == text and rows[1]["n"] == len(counter.encoding.encode_ordinary(text)) and 0 < rows[1]["n_recoded"] < 10
        assert rows[2]["now"] == rows[3]["now"] == "NEW" * (_ + 1) and rows[1]["edited"] == "clash"
    assert token_counts.with_trees(df.limit(0), queries.BYTE_BPE, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.Counter(queries.BYTE_BPE, r"\s*[\r\n]+|\s+|\S+")


# ---- 3


def brute_licenses(text, scanner):
    """Every template aligned at every place, without an index; the fullest of overlapping reports stay."""
    words = license_scan._data(text).split()
    ids = [scanner.number.get(w, -1) for w in words]
    found = []
    for t, template in enumerate(scanner.templates):
        for shift in range(-len(template), len(ids)):
            m, a, b = scanner.align(template, ids, shift, scanner.bands[t])
            if m / len(template) >= scanner.least and b - a <= len(template) / scanner.least + scanner.bands[t]:
                found.append((scanner.names[t], m / len(template), a, b))
    kept = []
    for x in sorted(set(found), key=lambda x: (x[0], -x[1], x[2], x[3])):
        if not any(x[0] == y[0] and x[2] < y[3] and y[2] < x[3] for y in kept):
            kept.append(x)
    return sorted((x[0], round(x[1], 6)) for x in kept)


def test_licenses_against_brute_force():
    scanner, rng = license_scan.Scanner(license_scan.TEMPLATES), random.Random(2)
    for _ in range(25):
        parts = []
        for _ in range(rng.randrange(4)):
            words = license_scan.TEMPLATES[rng.choice(scanner.names)].split()
            gap = rng.choice([9, 13, 10**6])
            parts += [w if i % gap else rng.choice(["other", w, ""]) for i, w in enumerate(words, 1)] + ["filler", "words"] * rng.randrange(3)
        text = " ".join(parts)
        assert sorted((n, round(c, 6)) for n, c, _, _ in scanner.scan(text)) == brute_licenses(text, scanner), text


def test_no_copy_with_replaced_words_is_lost():
    """Random words replaced, up to what coverage allows; coverage is counted place by place, without the scanner."""
    scanner, rng = license_scan.Scanner(license_scan.TEMPLATES), random.Random(5)
    assert [x[:2] for x in scanner.scan("Released under an MIT License")] == [("mit-notice", 0.8)]
    for _ in range(1500):
        name = rng.choice(scanner.names)
        words = re.sub("[^0-9a-z]+", " ", license_scan.TEMPLATES[name].lower()).split()
        copy = list(words)
        for i in rng.sample(range(len(words)), rng.randint(0, len(words) // 5)):
            copy[i] = rng.choice(["zzz", "of", "the", copy[i - 1]])
        same = sum(a == b for a, b in zip(copy, words, strict=True)) / len(words)
        found = {x[0]: x[1] for x in scanner.scan("some words before " + " ".join(copy) + " and some behind")}
        assert same < 0.8 or found.get(name, 0) >= same - 1e-9, (name, same, found, copy)


def test_licenses_many_and_side_by_side(spark):
    grant = license_scan.TEMPLATES["mit-grant"].split()
    broken = " ".join(w for i, w in enumerate(grant) if i % 11)
    rows = [(1, f"{broken} . " * 150), (2, "Released under the MIT License\n" * 7), (3, "x " * 300_000 + "released under the MIT license"), (1, f"{broken} . " * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("license", "start", "coverage", "x")})
    got = license_scan.licenses(df).collect()
    assert sorted((r["doc_id"], len(r["matches"])) for r in got) == [(1, 150), (1, 150), (2, 7), (3, 1)]
    assert license_scan.licenses(df.limit(0)).count() == 0


def test_licenses(spark):
    grant = license_scan.TEMPLATES["mit-grant"]
    broken = " ".join(w for i, w in enumerate(grant.split()) if i % 11)
    text = f"Préface. {grant}\n\n... Released under the MIT license!"
    rows = [(1, text), (2, broken), (3, "the of the and permission"), (4, None), (5, "")]
    got = {r["doc_id"]: r["matches"] for r in license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(m["license"], m["coverage"]) for m in got[1]] == [("mit-grant", 1.0), ("mit-notice", 1.0)]
    assert text[got[1][0]["start"] : got[1][0]["stop"]] == grant.rstrip(".")
    assert [m["license"] for m in got[2]] == ["mit-grant"] and 0.8 <= got[2][0]["coverage"] < 1
    assert not got[3] and not got[4] and not got[5]


# ---- 4


def test_warc_round_trip(spark):
    big = "<p>é" + "x" * 200
    rows = [(9, "http://a/\r\nb", big), (3, None, big), (3, "u", big), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (None, "u", big), (8, "u", "<p>" + "line\r\n\r\n" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    got = warc_zstd.round_trip(pages).collect()
    digest = hashlib.sha256(big.encode()).hexdigest()
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got if r["payload_digest"] == digest)
    assert kinds == [("3", "response", None), ("3", "response", None), ("9", "revisit", 3), ("None", "revisit", 3)]
    assert {(r["page_id"], r["html"]) for r in got if r["page_id"] in (5, 6, 7, 8)} == {(5, "small"), (6, "small"), (7, ""), (8, rows[-1][2])}
    assert all(r["payload_bytes"] == len(big.encode()) for r in got if r["payload_digest"] == digest)
    assert warc_zstd.round_trip(pages.limit(0)).count() == 0


def test_warc_reader_refuses():
    body = b"<html>" * 30
    raw = warc_zstd.record_bytes(1, "u", body, hashlib.sha256(body).hexdigest(), len(body), None, False)
    assert warc_zstd.parse_record(raw).payload == body
    for bad in (raw[:-1], raw.replace(b"WARC/1.1", b"WARC/9"), raw.replace(b"<html>", b"<htmm>", 1), raw.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc_zstd.BadArchive):
            warc_zstd.parse_record(bad)
    dictionary = warc_zstd.train_dictionary([raw])
    data = warc_zstd.archive_start(dictionary) + warc_zstd.zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True).compress(raw) * 2
    assert len(list(warc_zstd.read_archive(data))) == 2
    for cut in (len(data) - 1, len(data) - 10, 20):
        with pytest.raises((warc_zstd.BadArchive, warc_zstd.zstandard.ZstdError)):
            list(warc_zstd.read_archive(data[:cut]))


# ---- 5


def brute_links(rows, cosine):
    ok = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append(i)
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    return [(i, j) for i in ok for j in ok if i < j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine]


@pytest.mark.parametrize("block_size", [40, 2000])
def test_cover_tree_exact(spark, block_size):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in base[i % 12] + rng.normal(0, 0.05 + 0.03 * (i % 9), 8)], 1 if i % 3 else 2) for i in range(200)]
    rows += [(200, [1.0] * 8, 1), (201, [2.0] * 8, 1), (202, [1.0] * 8, 1), (203, None, 1), (204, [0.0] * 8, 1), (205, [float("nan")] * 8, 1), (206, [1.0] * 8, None), (207, [1.0, None], 1), (208, [], 1), (209, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(0) for c in ("id", "unit", "node", "cell")})
    rows32 = [(a, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for a, v, c in rows]
    links = brute_links(rows32, 0.93)
    want = components([r[0] for r in rows], links)
    count = {r[0]: 0 for r in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in cover_tree.near_duplicates(df, block_size=block_size).collect()}
    assert got == {i: (count[i], want[i], want[i] == i) for i in want}
    assert cover_tree.near_duplicates(df.limit(0)).count() == 0


def test_cover_tree_of_repeated_ids_and_levels(spark):
    """Repeated ids under several vectors, and cells split over several levels."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 6))
    rows = [(i % 350, [float(np.float32(x)) for x in base[i % 60] + rng.normal(0, 0.08, 6)], 1) for i in range(700)]
    links = brute_links(rows, 0.93)
    got = cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block_size=12).collect()
    count = [0] * len(rows)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    comp = components(range(len(rows)), links)
    least = {}
    for i, c in comp.items():
        least[c] = min(least.get(c, 10**9), rows[i][0])
    want = sorted((rows[i][0], count[i], least[comp[i]]) for i in range(len(rows)))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want


def test_dual_traversal_on_clusters():
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(40, 16)), 30, axis=0) + rng.normal(0, 0.1, (1200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    i, j = map(np.concatenate, zip(*cover_tree.dual_pairs(t := cover_tree.CoverTree.of_parts(x, cover_tree.CoverTree(x).parts()), t, 0.93), strict=True))
    want = np.argwhere(np.triu(x @ x.T >= 0.93, 1))
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, want.tolist()))


# ---- 6


def test_simhash_brute(spark, docs):
    rows = {r["doc_id"]: brute_simhash(r["text"]) for r in docs.collect()}
    ids = sorted(rows)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (rows[a] ^ rows[b]).bit_count() <= 2]
    want = components(ids, linked)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op6_simhash_dedup(spark, DATA).collect()}
    assert got == {i: (f"{rows[i]:016x}", want[i]) for i in ids}


def test_simhash_odd(spark):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_dedup.near_duplicates(odd_docs(spark)).collect()]
    assert len(got) == 9
    assert {g[2] for g in got if g[0] in (1, 2, 3)} == {1} and {g[2] for g in got if g[0] in (5, 6)} == {5}
    assert simhash_dedup.near_duplicates(odd_docs(spark).limit(0)).count() == 0


def near_texts(n=2000):
    """Two texts whose fingerprints differ in one or two bits."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a = " ".join(words)
    for i in range(n):
        b = " ".join([*words[:i], "other", *words[i + 1 :]])
        if 0 < (brute_simhash(a) ^ brute_simhash(b)).bit_count() <= 2:
            return a, b
    raise AssertionError("no near text")


def test_simhash_null_ids(spark):
    a, b = near_texts()
    rows = [(None, a), (7, b), (9, b), (None, "one text of no other"), (None, "quite something else here"), (None, "quite something else here"), (4, "a row with an id"), (4, "a row with an id"), (5, "a row with an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash_dedup.near_duplicates(df).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == sorted([("None", "7"), ("7", "7"), ("9", "7"), ("None", "None"), ("None", "None"), ("None", "None"), ("4", "4"), ("4", "4"), ("5", "4")])
    kept = [(r["doc_id"], r["text"]) for r in simhash_dedup.keep_one(df).collect()]
    want = [(7, b), (None, "one text of no other"), (None, "quite something else here"), (4, "a row with an id")]
    assert sorted(kept, key=str) == sorted(want, key=str)
    assert simhash_dedup.keep_one(df.where("false")).count() == 0


def test_simhash_keeps_one_of_equal_ids(spark):
    rows = [(3, "the same text here", "b"), (3, "The same text HERE", "a"), (None, "the same text here", "c"), (None, "alone without id", "x"), (None, "Alone without id", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = [tuple(r) for r in simhash_dedup.keep_one(df).collect()]
    again = [tuple(r) for r in simhash_dedup.keep_one(df.repartition(3, "source")).collect()]
    assert sorted(first, key=str) == sorted(again, key=str) and sorted(str(r[0]) for r in first) == ["3", "None"]


@pytest.mark.parametrize("group_size", [8, 1024])
def test_similar_pairs_exact(spark, group_size):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    prints = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1) for b in base for _ in range(25)})
    df = spark.createDataFrame([(i, simhash_dedup._signed(p)) for i, p in enumerate(prints)], "node long, fp long")
    got = components(range(len(prints)), [(r["u"], r["v"]) for r in simhash_dedup.similar_pairs(df, group_size=group_size).collect()])
    want = components(range(len(prints)), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    assert got == want


def test_distance_table(spark):
    rng = random.Random(9)
    prints = [rng.getrandbits(64) for _ in range(40)]
    # random fingerprints that share the 32 bits of one key: what a key lets through by chance
    prints += [prints[0] & (2**32 - 1) | rng.getrandbits(32) << 32 for _ in range(40)]
    df = spark.createDataFrame([(i, simhash_dedup._signed(p)) for i, p in enumerate(prints)], "node long, fp long").select("node", simhash_dedup.distance_table(F.col("fp")).alias("t"))
    rows = {r["node"]: (r["t"], r["c"]) for r in df.withColumn("c", simhash_dedup.one_bit_coordinates(F.col("t"))).collect()}
    assert all(list(rows[i][0]) == [(p ^ q).bit_count() for q in simhash_dedup.pivots()] for i, p in enumerate(prints))
    assert all(rows[i][1] == simhash_dedup._signed(p ^ simhash_dedup.BASE) for i, p in enumerate(prints))
    table = np.array([rows[i][0] for i in range(len(prints))], np.int8)
    a, b = np.triu_indices(len(prints), 1)
    bound = simhash_dedup.largest_difference(table[a], table[b])
    true = np.array([(prints[i] ^ prints[j]).bit_count() for i, j in zip(a, b, strict=True)])
    assert (bound <= true).all()
    alike = (a >= 40) & (true > 2)
    assert (bound[alike] > 2).mean() > 0.9, (bound[alike] > 2).mean()  # discarded by the largest difference alone


# ---- 7


def test_bpe_equals_library(spark, docs):
    library = Tokenizer.from_file(queries.WORD_BPE)
    library.no_padding()
    library.no_truncation()
    own = bpe_automaton.WordTokenizer(queries.WORD_BPE)
    rng = random.Random(6)
    texts = [r["text"] for r in docs.collect()] + ["", " ", "ttttttt tttt", "don't we'll <|endoftext|>x<|startoftext|>", "ΑΣ Σ İstanbul ﬁ ½ Ⅷ", "é é", "\x1c\x1d a\u0085b", "x" * 5000]
    texts += ["".join(rng.choice("abehinostt  \n'éßΣ中1²_-%<|>") for _ in range(rng.randrange(30))) for _ in range(800)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        ids = own.encode(t)
        assert list(memoryview(ids).cast("I")) == want, t[:80]
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_columns(spark):
    df = odd_docs(spark)
    got = {r["doc_id"]: r for r in bpe_automaton.encode_digests(df, queries.WORD_BPE).collect()}
    assert got[1]["n_tokens"] == got[2]["n_tokens"] == 0 and got[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[7]["n_tokens"] == 30000
    ids = df.withColumn("ids", bpe_automaton.encode_column(F.col("text"), queries.WORD_BPE)).withColumn("back", bpe_automaton.decode_column(F.col("ids"), queries.WORD_BPE))
    assert {r["doc_id"]: r["back"] for r in ids.collect()}[5] == "the</w> same</w> text</w> here</w>"


# ---- 8


def test_compaction_keeps_all(spark, tmp_path):
    df = spark.createDataFrame([(i % 90, None if i % 7 == 0 else "x" * (i % 50)) for i in range(300)], "doc_id long, text string")
    table = compaction.ShardTable(spark, f"file://{tmp_path}/t", fanout=3, target_bytes=1 << 20, base_bytes=1 << 12)
    for k in range(7):
        table.append(df.where(F.col("doc_id") % 7 == k).withColumn("a", F.lit(k)), "a")
    assert table.versions() == list(range(1, 8)) and len(table.runs()) == 7
    before = table.read(df.schema).count()
    assert table.compact() == 2 and len(table.runs()) == 3
    assert max(r.tier for r in table.runs()) >= 1
    got = table.read(df.schema)
    key = lambda rows: sorted((str(r["doc_id"]), str(r["text"])) for r in rows)
    assert before == 300 and key(got.collect()) == key(df.collect())
    assert table.read(df.schema, version=3).count() < 300  # an older version is still whole
    assert table.vacuum() == 0 and len(table.versions()) > 1  # what was written a moment ago may be another writer's
    assert table.vacuum(0) > 0 and key(table.read(df.schema).collect()) == key(df.collect())
    with pytest.raises(compaction.Conflict):
        table.commit([], table.versions()[-1] - 1)


def test_sharding_odd(spark):
    df = odd_docs(spark)
    assert compaction.shard(df, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3))).count() == 9
    assert compaction.shard(df.limit(0), F.lit(1)).count() == 0
    clash = df.withColumns({"__when": F.lit("a"), "when": F.lit("b"), "__run": F.lit("c"), "__tier": F.lit("d"), "arrived": F.lit("e"), "folder": F.lit("f")})
    got = compaction.shard(clash, F.when(F.col("doc_id") > 2, F.concat(F.lit("a/ b%="), "doc_id")), base_bytes=1).collect()
    assert {tuple(r[c] for c in ("__when", "when", "__run", "__tier", "arrived", "folder")) for r in got} == {tuple("abcdef")} and len(got) == 9
    assert len({r["__run_"] for r in got}) > 1 and None not in {r["__run_"] for r in got}


def test_compaction_keeps_every_column(spark, tmp_path):
    table = compaction.ShardTable(spark, f"file://{tmp_path}/mixed", fanout=2, base_bytes=1 << 30)
    for i in range(3):
        table.append(spark.createDataFrame([(i, "a")], "id int, a string").withColumn("w", F.lit(i)), "w")
    table.append(spark.createDataFrame([(3, "a", 1.5)], "id int, a string, c double").withColumn("w", F.lit(3)), "w")
    assert table.compact() and len(table.runs()) == 1
    kept = compaction.united(table.runs())
    assert sorted((r["id"], r["a"], r["c"]) for r in table.read(kept).collect()) == [(0, "a", None), (1, "a", None), (2, "a", None), (3, "a", 1.5)]
    with pytest.raises(ValueError):
        table.append(spark.createDataFrame([(4, 7)], "id int, A int").withColumn("w", F.lit(4)), "w")
    assert table.read(kept).count() == 4


# ---- 9


def brute_hits(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, ids = set(), set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            win = w[k : k + 10]
            for i in range(len(words) - len(win) + 1):
                if words[i : i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    ids.add(str(item))
    return len(words), len(hit), ",".join(sorted(ids))


def test_decontamination_brute(spark):
    items = [(1, "alpha beta"), (10, "one two three four five six seven eight nine ten eleven twelve"), (2, None), (3, "!!"), (4, "x"), (4, "x")]
    texts = ["Alpha,BETA alpha beta", "zero ONE two three four five six seven eight nine ten eleven! thirteen", "alphabeta", None, "", "x x é x", "one two three four five six seven eight nine"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    for block in (16_000_000, 5):
        out = decontaminate.with_hits(df.drop("n_words"), bench, block_chars=block).select("doc_id", "text", "contamination.*").collect()
        for r in out:
            n, hits, ids = brute_hits(r["text"], items)
            assert (r["n_words"], r["n_hit"], r["items_sha256"], r["contaminated"]) == (n, hits, hashlib.sha256(ids.encode()).hexdigest(), hits > 0)
        assert out[1]["text"][out[1]["spans"][0]["start"] : out[1]["spans"][0]["stop"]] == "ONE two three four five six seven eight nine ten eleven"
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(odd_docs(spark), bench).count() == 9


def test_automaton_of_words():
    """About one state for each benchmark word, not ten; items keep to themselves; very long texts and common blocks."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(20_000)]
    m = decontaminate.Matcher([(i, " ".join(words[i * 200 : i * 200 + 200])) for i in range(100)], 10)
    assert m.automaton.get_stats()["nodes_count"] < 1.05 * len(words)
    items = [(1, "a b c d e f g h i j k l"), (2, "k l m n o p q r s t u v"), (3, "a a a a a a a a a a a a a"), (5, "b a")]
    m = decontaminate.Matcher(items, 10)
    for text in ["a b c d e f g h i j k l m n o p q r s t", "zz c d e f g h i j k l zz", "i j k l m n o p q r", "a " * 5000, "a b a", "x " * 200_000 + "b c d e f g h i j k"]:
        n, hit, ids = m.scan(text)
        if len(text) < 20_000:
            assert (n, int(hit.sum()), ",".join(ids)) == brute_hits(text, items), text[:50]
        else:
            assert int(hit.sum()) == 10 and ids == ["1"]
    for _ in range(300):
        items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(16)))) for k in range(4)]
        text = " ".join(rng.choice("abcd") for _ in range(rng.randrange(60)))
        n, hit, ids = decontaminate.Matcher(items, 10).scan(text)
        assert (n, int(hit.sum()), ",".join(ids)) == brute_hits(text, items), (items, text)


# ---- 10


def slow_main_text(page):
    """The scoring rule spelt out: every sum by a walk to the root for every block."""
    root = html_extract.parse(page)
    blocks = [b for b in html_extract._blocks(root) if not b[3]]
    up = lambda n: [] if n is None else [n, *up(n.parent)]
    score, chars, links = {}, {}, {}
    for owner, text, linked, _ in blocks:
        for n in up(owner):
            chars[n], links[n] = chars.get(n, 0) + len(text), links.get(n, 0) + linked
        if owner.tag not in html_extract.HEADINGS and len(text) >= 25:
            points = (1 + sum(text.count(c) for c in ",、，") + min(len(text) // 100, 3)) * (1 - min(linked / len(text), 1))
            first = owner if owner.tag in html_extract.CONTAINERS or owner.parent is None else owner.parent
            for d, n in enumerate(up(first)):
                score[n] = score.get(n, 0) + points / (1 if d == 0 else 2 if d == 1 else 3 * d)
    worth = lambda n: score.get(n, 0) * (1 - min(links[n] / chars[n], 1))
    boxes = [n for n in html_extract._nodes(root) if n in chars and (n.tag in html_extract.CONTAINERS or n.parent is None)]
    top = lambda n: n.tag in ("article", "main")
    scored = [n for n in boxes if worth(n) > 0]
    if not blocks:
        return ""
    if scored:
        best = max(scored, key=lambda n: (worth(n) * (1.25 if top(n) else 1), chars[n]))
        best = next((n for n in reversed(up(best.parent)) if top(n) and worth(n) > 0), best)
    else:
        best = max([n for n in boxes if top(n)] or boxes, key=lambda n: chars[n])
    keep = {best}
    if best.parent is not None and best.tag not in ("article", "main", "body", "html"):
        for n in best.parent.children:
            if n in chars and n is not best:
                density = links[n] / chars[n]
                if worth(n) >= max(10, worth(best) / 5) or density < 0.25 and (n.tag == "p" and chars[n] > 80 or n.tag in html_extract.HEADINGS):
                    keep.add(n)
    return "\n".join(t for owner, t, _, _ in blocks if keep & set(up(owner)))


PIECES = "<p>|</p>|<div>|</div>|<ul>|<li>|</ul>|<table>|<tr>|<td>|</td>|</table>|<b>|</b>|<h2>|</h2>|<a href='x'>|</a>|one, two |<br>|<span>|</span>|<section class='comments'>|</section>|<!-- c -->|<script>x</script>|a < b |&amp; |<article>|</article>|<button>|</button>|long text here, with commas, and more than enough characters to count |" + "a very long paragraph of plain words " * 5


def test_extraction_against_slow_sums(spark):
    rng, pieces = random.Random(4), PIECES.split("|")
    pages = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(800)]
    pages += [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    for page in pages:
        assert html_extract.extract(page) == slow_main_text(page), page


def test_hostile_pages_take_linear_time():
    n = 20_000
    pages = ["<div>" * n + "</b>" * n, "<div>some text, and more of it, " * n, '<a "' * n, "<!a " * n, "<p><table><td>" + "<span>" * n + "</p>" * n, "<div>" + "<b>" * n + "<hr>" * n]
    pages += ["<ul>" + "<b>" * n + "<li>" * n, "<td><button>" + "<span>" * n + "</td>" * n, "<!--" * n, "<a href='x>" * n + "t", "</x " * n, "<script>" * n]
    for page in pages:
        began = time.perf_counter()
        html_extract.extract(page)
        assert time.perf_counter() - began < 5, page[:40]


def test_extraction_of_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x"), (2, "u", ""), (3, "u", "<p>" + "word, " * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("text", "n_chars", "__html")})
    got = html_extract.main_text(df).collect()
    assert sorted((str(r["page_id"]), r["text"][:3], r["n_chars"]) for r in got) == [("1", "", 0), ("1", "", 0), ("2", "", 0), ("3", "wor", 599_999), ("None", "x", 1)]
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_extraction():
    page = """<html><head><title>T</title><script>x</script></head><body><div id="cookie-notice">We use cookies, many of them, all day long, as you may know.</div>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">News</a></ul></nav>
    <div id="content"><h2>Head &amp; line</h2><p>First paragraph, long enough, with commas,
       and   spaces &lt;ok&gt;.<p>Second one, also long enough to count, <a href="x">with a link</a> inside.<br>After break</div>
    <div class="sidebar"><p>Side text, which is long enough to be scored, if it were not in a bar.</p></div>
    <section class="comments"><p>I liked it, a lot, and more, and more, and more words here, for the score.</p></section>
    <form><p>Your mail, please, so we may write to you each and every day.</p></form><footer>&copy; 2024</footer></body></html>"""
    want = "Head & line\nFirst paragraph, long enough, with commas, and spaces <ok>.\nSecond one, also long enough to count, with a link inside.\nAfter break"
    assert html_extract.extract(page) == want
    assert html_extract.extract(None) == html_extract.extract("") == html_extract.extract("<p></p><script>a</script>") == ""
    assert html_extract.extract("just text, no tags") == "just text, no tags"
    assert html_extract.extract("<article><p>cut off &am") == "cut off &am"
    assert html_extract.extract("<div>" * 5000 + "deep") == "deep"


def test_extraction_of_pages(spark):
    got = queries.op10_html_extraction(spark, DATA)
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert all(re.search(r"<article><h1>", pages[r["page_id"]]) is None or r["text"] for r in rows)


# ---- pipeline


def test_pipeline_stages(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontamination", "bpe"]
    rows = docs.limit(120).withColumn("extra", F.lit(1))
    kept = corpus_pipeline.drop_near_duplicates(spark, rows, DATA)
    prints = {r["doc_id"]: brute_simhash(r["text"]) for r in rows.collect()}
    ids = sorted(prints)
    comp = components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {r["doc_id"] for r in kept.collect()} == {i for i in ids if comp[i] == i} and kept.columns == rows.columns
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    few = rows.limit(40)
    clean = corpus_pipeline.drop_benchmark_leaks(spark, few, DATA)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in few.collect() if not brute_hits(r["text"], items)[1]} and clean.columns == rows.columns
    known = corpus_pipeline.identify_language(spark, docs, DATA)
    assert known.columns == docs.columns and known.count() >= 0.95 * docs.count()
    assert corpus_pipeline.identify_language(spark, docs.limit(0), DATA).count() == 0


def test_pipeline_run(spark, tmp_path, docs):
    """The whole of ``run`` over null ids, repeated rows and empty tables; only the last stage's folder stays."""
    some = docs.limit(150)
    odd = some.unionByName(some.limit(5)).unionByName(some.limit(3).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(odd_docs(spark).select(*docs.columns).withColumn("doc_id", F.col("doc_id") + 10**6))
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    odd.write.parquet(str(tmp_path / "a/documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    for folder in "ab":
        spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / folder / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    known = [r for r in corpus_pipeline.identify_language(spark, odd, DATA).collect()]
    prints = {}
    for r in known:  # of equal or near fingerprints the smallest id, null last
        prints.setdefault(brute_simhash(r["text"]), []).append(r["doc_id"])
    comp = components(list(prints), [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    best = {}
    for p, ids in prints.items():
        best.setdefault(comp[p], []).extend(ids)
    texts = {r["doc_id"]: r["text"] for r in known}
    want = [min((i for i in ids if i is not None), default=None) for ids in best.values()]
    want = [i for i in want if not brute_hits(texts[i], items)[1]]
    assert sorted(map(str, want)) == sorted(str(r["doc_id"]) for r in got)
    own = bpe_automaton.WordTokenizer(queries.WORD_BPE)
    assert all(r["n_tokens"] == len(own.encode(texts[r["doc_id"]])) // 4 for r in got if r["doc_id"] is not None)
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0
