"""Token counts that follow edits.

A document is cut in pre-tokens, and runs of them are the leaves of a segment tree whose nodes sum
characters and tokens. The tree is kept as a column of a table (:func:`with_trees`); edits are applied to a
kept tree (:func:`edit_trees`), whose untouched leaves are never counted again. An edit finds its leaves by the
character sums, cuts and encodes anew from the last pre-token that may change to where the new cuts meet the
old ones, and updates the sums above.

What ends two characters or more before an edit stays, because the pattern of the pre-tokens looks at
two characters behind a pre-token at most. That holds for patterns without alternatives that reach over line
ends; others are refused.
"""

from __future__ import annotations

import base64
import uuid

import numpy as np
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, free_name, shared_dir

CACHE_WORDS = 300_000
#: A kept tree: the text, its totals, length and count of each pre-token, how many each leaf has, and the nodes' sums. Numbers are little-endian, as wide as the largest needs.
TREE = "struct<text:string,n_tokens:bigint,n_chars:bigint,n_pretokens:bigint,lengths:binary,counts:binary,sizes:binary,chars:binary,tokens:binary>"


class Counter:
    """Pre-tokens and their token counts for one vocabulary of ranks; built once in each worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if "\\r" in pattern or "\\n" in pattern or "\r" in pattern or "\n" in pattern:
            raise ValueError("a pattern that names line ends may look further than two characters behind a pre-token")
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def count(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            n = len(self.encoding.encode_ordinary(word))
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            if len(word) < 60:
                self.known[word] = n
        return n


def _packed(numbers: list[int] | np.ndarray) -> bytes:
    """Numbers behind a byte that says how wide they are."""
    a = np.asarray(numbers, np.int64)
    width = next(w for w in (1, 2, 4, 8) if not len(a) or int(a.max()) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + a.astype(f"<u{width}").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class _Leaves:
    """A list of leaves of which those of a kept tree are made when they are first looked at."""

    def __init__(self, made: list, make=None):
        self.made, self.make = made, make

    def __len__(self) -> int:
        return len(self.made)

    def __getitem__(self, k: int) -> list:
        if self.made[k] is None:
            self.made[k] = self.make(k)
        return self.made[k]

    def __setitem__(self, k: int, leaf: list) -> None:
        self.made[k] = leaf

    def __iter__(self):
        return (self[k] for k in range(len(self)))


class CountTree:
    """Segment tree over leaves of about ``leaf`` pre-tokens; ``encoded`` counts pre-tokens encoded since it was made or loaded."""

    def __init__(self, text: str, counter: Counter, leaf: int = 64):
        self.counter, self.leaf, self.encoded = counter, leaf, 0
        words = counter.pattern.findall(text)
        self._fill(words, self._count(words))

    @classmethod
    def load(cls, kept: dict, counter: Counter, leaf: int = 64) -> CountTree:
        """The tree that :meth:`kept` described; nothing is encoded or summed, and a leaf's words are cut out when an edit comes to it."""
        tree = cls.__new__(cls)
        tree.counter, tree.leaf, tree.encoded = counter, leaf, 0
        tree.chars, tree.tokens = _unpacked(kept["chars"]).tolist(), _unpacked(kept["tokens"]).tolist()
        tree.size = len(tree.chars) // 2
        text, lengths, counts = kept["text"], _unpacked(kept["lengths"]), _unpacked(kept["counts"])
        stops = np.cumsum(_unpacked(kept["sizes"])).tolist()
        n = len(stops)
        places = np.concatenate([[0], np.cumsum(lengths)])

        def words(k: int) -> list[str]:
            cuts = places[stops[k - 1] if k else 0 : stops[k] + 1].tolist()
            return [text[i:j] for i, j in zip(cuts, cuts[1:])]

        tree.leaves = _Leaves([None] * n, words)
        tree.counts = _Leaves([None] * n, lambda k: counts[stops[k - 1] if k else 0 : stops[k]].tolist())
        tree._origin = (text, lengths, counts, stops, places)
        return tree

    def kept(self) -> dict:
        texts, lengths, counts, sizes = [], [], [], []
        for k, (words, own) in enumerate(zip(self.leaves.made, self.counts.made, strict=True)):
            if words is None:  # as it was loaded
                text, n, c, stops, places = self._origin
                a, b = stops[k - 1] if k else 0, stops[k]
                texts.append(text[int(places[a]) : int(places[b])])
                lengths.append(n[a:b])
                counts.append(c[a:b] if own is None else own)
                sizes.append(b - a)
            else:
                texts += words
                lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
                counts.append(self.counts[k])
                sizes.append(len(words))
        joined = lambda parts: _packed(np.concatenate([np.asarray(x, np.int64) for x in parts]))
        sums = {"chars": _packed(self.chars), "tokens": _packed(self.tokens), "sizes": _packed(sizes)}
        return {"text": "".join(texts), "n_tokens": self.total, "n_chars": self.length, "n_pretokens": sum(sizes), "lengths": joined(lengths), "counts": joined(counts), **sums}

    def _count(self, words: list[str]) -> list[int]:
        known, count = self.counter.known, self.counter.count
        self.encoded += len(words)
        return [known.get(w) or count(w) for w in words]

    def _fill(self, words: list[str], counts: list[int]) -> None:
        starts = range(0, len(words), self.leaf)
        self.leaves = _Leaves([words[i : i + self.leaf] for i in starts] or [[]])
        self.counts = _Leaves([counts[i : i + self.leaf] for i in starts] or [[]])
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for k in range(len(self.leaves)):
            self._sum_leaf(k)
        for k in range(self.size - 1, 0, -1):
            self._sum(k)

    def _sum_leaf(self, k: int) -> None:
        self.chars[self.size + k] = sum(map(len, self.leaves[k]))
        self.tokens[self.size + k] = sum(self.counts[k])

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(w for leaf in self.leaves for w in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` (the last one for the end), and the leaf's first character."""
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if at >= start + self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def edit(self, at: int, delete: int, insert: str) -> None:
        """Replaces ``delete`` characters at ``at`` by ``insert``; places beyond the text mean its end."""
        at = max(0, min(at, self.length))
        delete = max(0, min(delete, self.length - at))
        if not delete and not insert:
            return
        first, start = self._find(max(at - 2, 0))
        # a pre-token stays if the two characters behind it do (white space leaves its last blank to a word)
        while first and start >= at - 1:
            first -= 1
            start -= self.chars[self.size + first]
        keep, offset = 0, start
        for w in self.leaves[first]:
            if offset + len(w) >= at - 1:
                break
            offset += len(w)
            keep += 1
        last, last_start = self._find(min(at + delete, max(self.length - 1, 0)))
        old = [w for k in range(first, last + 1) for w in self.leaves[k]][keep:]
        old_counts = [c for k in range(first, last + 1) for c in self.counts[k]][keep:]
        end = last_start + self.chars[self.size + last]
        tail_at, joined = at - offset, "".join(old)
        new_text = joined[:tail_at] + insert + joined[tail_at + delete :]
        stops, pos = set(), 0  # old cuts behind the edit, as places in the new text
        for w in old:
            pos += len(w)
            if pos >= tail_at + delete + 1:
                stops.add(pos - delete + len(insert))
        more, fresh, place, match = last + 1, [], 0, self.counter.pattern.match
        safe = tail_at + len(insert) + 1
        while True:
            done = False
            while place < len(new_text):
                m = match(new_text, place)
                if m is None:
                    break
                if m.end() + 2 > len(new_text) and more < len(self.leaves):
                    break  # what follows decides where this one ends
                fresh.append(m[0])
                place = m.end()
                if place in stops and place >= safe:
                    done = True
                    break
            if done or more >= len(self.leaves):
                break
            joined = self.leaves[more]
            pos = len(new_text)
            for w in joined:
                pos += len(w)
                stops.add(pos)
            stops.add(len(new_text))
            new_text += "".join(joined)
            old = old + joined
            old_counts = old_counts + self.counts[more]
            end += self.chars[self.size + more]
            more += 1
        same, pos = len(old), 0  # from which old pre-token on the new cuts are the old ones
        for i, w in enumerate(old):
            if pos - delete + len(insert) >= place and pos >= tail_at + delete:
                same = i
                break
            pos += len(w)
        words = self.leaves[first][:keep] + fresh + old[same:]
        self._replace(first, more, words, self.counts[first][:keep] + self._count(fresh) + old_counts[same:])

    def _replace(self, first: int, stop: int, words: list[str], counts: list[int]) -> None:
        """Deals ``words`` and their counts to the leaves first..stop-1 and updates the sums above them."""
        n = stop - first
        if len(words) > 4 * self.leaf * n:  # grown out of its leaves: new leaves over the words, with the counts there are
            around = lambda xs, own: [x for k in range(first) for x in xs[k]] + own + [x for k in range(stop, len(xs)) for x in xs[k]]
            self._fill(around(self.leaves, words), around(self.counts, counts))
            return
        share = -(-len(words) // n) if words else 1
        touched = set()
        for i in range(n):
            self.leaves[first + i] = words[i * share : (i + 1) * share]
            self.counts[first + i] = counts[i * share : (i + 1) * share]
            self._sum_leaf(first + i)
            touched.add((self.size + first + i) // 2)
        while touched and 0 not in touched:
            for k in touched:
                self._sum(k)
            touched = {k // 2 for k in touched if k > 1}


_COUNTERS: dict[tuple[str, str], Counter] = {}


def _counter(path: str, pattern: str) -> Counter:
    return _COUNTERS.get((path, pattern)) or _COUNTERS.setdefault((path, pattern), Counter(path, pattern))


def tree_column(text: Column, path: str, pattern: str, leaf: int = 64) -> Column:
    """Tree of the whole text, as the struct ``TREE``; null is the empty text."""

    def start():
        counter = _counter(path, pattern)
        return lambda texts: [CountTree(t or "", counter, leaf).kept() for t in texts]

    return arrow_column(TREE, start, text, rows=32)


def edited_tree_column(tree: Column, edits: Column, path: str, pattern: str, leaf: int = 64) -> Column:
    """Struct of the ``tree`` after the edits and ``n_recoded``, the pre-tokens that were encoded for them."""

    def start():
        counter = _counter(path, pattern)

        def one(kept: dict, changes: list[dict] | None) -> dict:
            t = CountTree.load(kept, counter, leaf)
            for e in changes or []:
                if e is not None:
                    t.edit(int(e["at"] or 0), int(e["remove"] or 0), e["put"] or "")
            return {"tree": t.kept(), "n_recoded": t.encoded}

        return lambda trees, changes: [one(*x) for x in zip(trees, changes, strict=True)]

    return arrow_column(f"struct<tree:{TREE},n_recoded:bigint>", start, tree, edits, rows=32)


def n_tokens(tree: Column) -> Column:
    """Tokens of a whole text: the root of its tree."""
    return tree["n_tokens"]


def n_chars(tree: Column) -> Column:
    return tree["n_chars"]


def n_pretokens(tree: Column) -> Column:
    return tree["n_pretokens"]


def tree_text(tree: Column) -> Column:
    return tree["text"]


def with_trees(df: DataFrame, path: str, pattern: str, text_col: str = "text", name: str = "tree", leaf: int = 64) -> DataFrame:
    """``df`` with the tree of every row's text in the column ``name``, to be kept as a table. No shuffle.

    Null and empty texts have a tree of one empty leaf. An empty table returns no row; repeated rows repeat theirs. A column of that
    name is replaced.
    """
    return df.withColumn(name, tree_column(F.col(text_col), path, pattern, leaf))


def edit_trees(df: DataFrame, edits: Column, path: str, pattern: str, name: str = "tree", recoded: str = "n_recoded", leaf: int = 64) -> DataFrame:
    """``df`` with the trees of the column ``name`` after ``edits``, and how many pre-tokens that took. No shuffle.

    ``edits``: array of structs (at, remove, put), each for the text that the earlier ones left. Null edits change nothing; places
    beyond the text mean its end; null fields mean 0 and the empty text.
    """
    both = free_name(df.columns, "edited")
    out = df.withColumn(both, edited_tree_column(F.col(name), edits, path, pattern, leaf))
    return out.withColumns({name: F.col(f"{both}.tree"), recoded: F.col(f"{both}.n_recoded")}).drop(both)


def tree_table(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, leaf: int = 64) -> DataFrame:
    """``id_col`` and ``tree`` of every row, written once as Parquet to ``folder`` (a new one in the shared folder by default) and read from there."""
    folder = folder or f"{shared_dir(df.sparkSession).rstrip('/')}/trees-{uuid.uuid4().hex}"
    trees = df.select(F.col(id_col), tree_column(F.col(text_col), path, pattern, leaf).alias("tree"))
    trees.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def kept_counts(trees: DataFrame, path: str, pattern: str, edits: Column, id_col: str = "doc_id", tree_col: str = "tree", leaf: int = 64) -> DataFrame:
    """Counts of kept trees before and after ``edits`` (see :func:`edit_trees`): n_tokens, n_tokens_edited, n_pretokens, n_recoded, n_chars_edited.

    The trees are those of :func:`tree_table`; what the edits don't touch is neither cut nor counted again, and the table stays as it is. Repeated rows return repeated rows, an
    empty table none. No shuffle.
    """

    def start():
        counter = _counter(path, pattern)

        def one(kept: dict, changes: list[dict] | None) -> dict:
            t = CountTree.load(kept, counter, leaf)
            for e in changes or []:
                if e is not None:
                    t.edit(int(e["at"] or 0), int(e["remove"] or 0), e["put"] or "")
            return {"n_tokens_edited": t.total, "n_recoded": t.encoded, "n_chars_edited": t.length}

        return lambda kept, changes: [one(*x) for x in zip(kept, changes, strict=True)]

    found = arrow_column("n_tokens_edited long, n_recoded long, n_chars_edited long", start, F.col(tree_col), edits, rows=64)
    out = trees.select(F.col(id_col).alias("id"), n_tokens(F.col(tree_col)).alias("n_tokens"), n_pretokens(F.col(tree_col)).alias("n_pretokens"), found.alias("counts"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "counts.n_tokens_edited", "n_pretokens", "counts.n_recoded", "counts.n_chars_edited")


def edited_counts(df: DataFrame, path: str, pattern: str, edits: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`kept_counts` of texts whose trees nobody keeps. Null texts are empty. Other columns are ignored."""
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), edits.alias("edits"))
    trees = with_trees(plain, path, pattern).select("id", "tree", "edits")
    return kept_counts(trees, path, pattern, F.col("edits"), "id").withColumnRenamed("id", id_col)
