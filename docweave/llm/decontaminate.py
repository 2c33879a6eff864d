"""Benchmark decontamination with one Aho-Corasick automaton over normalised questions and answers.

Words are maximal runs of characters outside the ASCII separators, with A-Z lower-cased. A window
is ``window`` consecutive words of a benchmark item (a shorter item is one window). The automaton reads word
numbers. Its patterns are the short items, and of the others the blocks of half a window that follow one
another: any window holds one of them whole, so the automaton has about one state for each benchmark
word. It scans every text once; a block that occurs is compared with its item word by word on either side, and what
reaches a window's length is hit. Hit words are mapped back to character offsets of the original text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, checkpoint, free_name

SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: bytes to bytes: A-Z to a-z (before the separators are blanked), the other separators to a space
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c in SEPARATORS else c for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: Characters of benchmark text that are broadcast and compiled at a time; see :func:`with_hits`.
BLOCK_CHARS = 16_000_000
#: Candidate places of a text that are compared at a time.
PLACES = 1_000_000


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


class Matcher:
    """The automaton over (item id, text) pairs."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.window, self.block = window, (window + 1) // 2
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        starts, text = [], [0] * window  # 0 stands around items and is no word
        places: dict[tuple[int, ...], list[int]] = {}
        for item, t in sorted({(str(i), t or "") for i, t in items}):
            words = [self.number.setdefault(w, len(self.number) + 1) for w in _split(t)]
            if not words:
                continue
            self.names.append(item)
            starts.append(len(text))
            step = self.block if len(words) >= window else len(words)
            for at in range(0, len(words) - step + 1, step):
                places.setdefault(tuple(words[at : at + step]), []).append(len(text) + at)
            text += words + [0] * window
        self.text, self.starts = np.array(text, np.int32), np.array(starts, np.int64)
        sizes = np.diff(np.append(self.starts, len(text))) - window
        self.least = np.minimum(sizes, window)  # words of a window of the item
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, at in places.items():
            self.automaton.add_word(words, (len(words), np.array(at, np.int64)))
        self.any = bool(places)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, list[str]]:
        """Number of words, hit mask over the words, sorted ids of the items with occurring windows."""
        words = _split(text)
        n, get, steps, items = len(words), self.number.get, np.zeros(len(words) + 1, np.int64), set()
        if n and self.any:
            numbers = tuple([get(w, 0) for w in words])
            padded = np.full(n + 2 * self.window, -1, np.int32)
            known = np.array(numbers, np.int32)
            padded[self.window : self.window + n] = np.where(known > 0, known, -1)
            waiting, size = [], 0
            for end, (length, places) in self.automaton.iter(numbers):
                waiting.append((end + 1 - length, length, places))
                size += len(places)
                if size >= PLACES:
                    items |= self._compare(padded, waiting, steps)
                    waiting, size = [], 0
            if waiting:
                items |= self._compare(padded, waiting, steps)
        return n, np.cumsum(steps[:-1]) > 0, sorted({self.names[i] for i in items})

    def _compare(self, padded: np.ndarray, found: list[tuple[int, int, np.ndarray]], steps: np.ndarray) -> set[int]:
        """Grows the found blocks on either side; marks in ``steps`` what reaches a window, and returns the items."""
        counts = [len(p) for _, _, p in found]
        here = np.repeat([a for a, _, _ in found], counts) + self.window
        size = np.repeat([s for _, s, _ in found], counts)
        there = np.concatenate([p for _, _, p in found])
        item = np.searchsorted(self.starts, there, "right") - 1
        left, right, go = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64), np.ones(len(here), bool)
        for k in range(1, self.window - self.block + 1):
            go &= padded[here - k] == self.text[there - k]
            left += go
        go[:] = True
        for k in range(self.window - self.block):
            go &= padded[here + size + k] == self.text[there + size + k]
            right += go
        whole = left + size + right >= self.least[item]
        start = (here - left - self.window)[whole]
        np.add.at(steps, start, 1)
        np.add.at(steps, start + (left + size + right)[whole], -1)
        return set(item[whole].tolist())


def spans(text: str | None, hit: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets in the original text of the runs of hit words."""
    data = (text or "").encode("utf-8", "replace")
    at = [m.span() for m in _WORD.finditer(data.translate(_TABLE))]
    chars = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80) if data else np.zeros(0, int)
    edges = np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0]))
    return [(int(chars[at[a][0]]) - 1, int(chars[at[b - 1][1] - 1])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of a bounded size, one at a time on the driver; at least one block."""
    block, size = [], 0
    for item, text in items.toLocalIterator():
        if block and size + len(text or "") > block_chars:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text or "")
    yield block


_MATCHERS: dict[str, Matcher] = {}


def _matcher(key: str, shared, window: int) -> Matcher:
    """The matcher of a broadcast block; a worker keeps the last one."""
    if key not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[key] = Matcher(shared.value, window)
    return _MATCHERS[key]


_FOUND = "struct<n_words:bigint,hit:binary,items:array<string>>"
_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, spans array<struct<start:bigint,stop:bigint>>, contaminated boolean"


def _found(text: Column, shared, window: int, before: Column | None) -> Column:
    """What the automaton of one block finds, added to what the blocks ``before`` found."""
    key, alone = uuid.uuid4().hex, before is None

    def start():
        matcher = _matcher(key, shared, window)

        def one(t: str | None, old: dict | None) -> dict:
            n, hit, items = matcher.scan(t)
            if old is not None:
                items = sorted({*items, *old["items"]})
                if old["hit"]:
                    hit = hit | np.unpackbits(np.frombuffer(old["hit"], np.uint8), count=n).astype(bool)
            return {"n_words": n, "hit": np.packbits(hit).tobytes() if items else b"", "items": items}

        return (lambda texts: [one(t, None) for t in texts]) if alone else (lambda texts, olds: [one(*x) for x in zip(texts, olds, strict=True)])

    return arrow_column(_FOUND, start, text, *([] if alone else [before]))


def _result(text: Column, found: Column) -> Column:
    def start():
        def one(t: str | None, f: dict) -> dict:
            n, items = f["n_words"], f["items"]
            hit = np.unpackbits(np.frombuffer(f["hit"], np.uint8), count=n).astype(bool) if items else np.zeros(n, bool)
            return {
                "n_words": n, "n_hit": int(hit.sum()), "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(), "items": items,
                "spans": [{"start": a, "stop": b} for a, b in spans(t, hit)] if items else [], "contaminated": bool(items),
            }

        return lambda texts, founds: [one(*x) for x in zip(texts, founds, strict=True)]

    return arrow_column(_RESULT, start, text, found)


def with_hits(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = 10, block_chars: int = BLOCK_CHARS, name: str = "contamination") -> DataFrame:
    """``df`` with a struct column ``name``: n_words, n_hit, n_items, items_sha256, items, spans, contaminated.

    ``items_sha256`` is over the item ids, sorted as strings and comma-joined (of the empty string
    if none). Null or empty texts have no words and no hits; null or wordless items have no window;
    repeated items count once by id; an empty benchmark hits nothing; items with a null id are called
    "None". ``spans`` are character offsets in the original text. A column called ``name`` is replaced. No shuffle.

    The benchmark is the small side: up to ``block_chars`` characters it is one broadcast and one automaton, which
    each worker builds once. A larger one is dealt to blocks of that size, each scanned in a pass of its
    own that ends in a checkpoint of the rows, so that no worker ever holds more than one block's automaton.
    """
    sc = df.sparkSession.sparkContext
    keep, found = df.columns, free_name(df.columns, "found")
    out, first = df, True
    for block in _blocks(items.select(item_col, item_text), block_chars):
        if not first:
            out = checkpoint(out)
        column = _found(F.col(text_col), sc.broadcast(block), window, None if first else F.col(found))
        out, first = out.withColumn(found, column), False
    return out.select(*[F.col(c) for c in keep if c.lower() != name.lower()], _result(F.col(text_col), F.col(found)).alias(name))


def contamination(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per row of ``df``: ``id_col`` and the fields of :func:`with_hits`."""
    out = with_hits(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, window=window, name="hits")
    return out.select(F.col("id").alias(id_col), "hits.*")


def drop_contaminated(df: DataFrame, items: DataFrame, text_col: str = "text", window: int = 10) -> DataFrame:
    """Rows of ``df``, with its columns, that hold no window of any item."""
    name = free_name(df.columns, "hits")
    return with_hits(df, items, text_col, window=window, name=name).where(~F.col(f"{name}.contaminated")).drop(name)
