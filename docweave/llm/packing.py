"""Packing documents into training sequences: cutting stock by column generation.

Every document becomes its ids and an end id. Whole multiples of a sequence are cut off first; what is left of each
document is a rest shorter than a sequence. The histogram of rests (a number for each length, so of a size that does not grow with
the corpus) is a cutting-stock problem: which patterns of lengths fill sequences, and how often each is used. Its linear program starts
from patterns of falling lengths, and a knapsack over the current prices of the lengths yields the column that
improves it most, until the bound says that nothing worth it is left. The multiples are rounded down; what remains is
filled with falling lengths once more.

The documents of a length are ranked by where they lie, and a pattern takes a stretch of ranks, so a document finds its
sequence and its place there from its rank alone: no group is gathered. Rests that fit no pattern without loss lie
behind one another in a stream that is cut where a sequence ends; the stream's end is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe_automaton import byte_alphabet
from .common import arrow_column, checkpoint, shared_dir

#: Distinct chunks between white space whose ids a worker keeps; a full table starts anew.
CACHE_CHUNKS = 400_000
#: Rows that become Python objects at a time.
ROWS = 64
#: White space that is no ASCII white space, a letter that becomes two when it is small, and controls, which are left to the library.
ODD = regex.compile("[\\x00-\\x1f\\x7f-\\xa0\\xad\u0130]")


class Ids:
    """Ids of whole texts by the tokenizers library, with the ids of chunks between ASCII white space kept.

    The file's splitter never joins what white space parts, so a text's ids are those of its chunks. A chunk of plain letters and marks is split into words
    here and only they go to the library's model; everything else goes through the library's whole pipeline, and so does a text with a special token in it.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.wide = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.words = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.alphabet = byte_alphabet()
        self.known: dict[bytes, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.wide.itemsize == 2 else "I", ids).tobytes()

    def _keep(self, chunk: bytes, ids: bytes) -> bytes:
        if len(chunk) < 60:
            if len(self.known) >= CACHE_CHUNKS:
                self.known.clear()
            self.known[chunk] = ids
        return ids

    def _word(self, word: str) -> bytes:
        key = word.encode()
        if (ids := self.known.get(key)) is None:
            shown = word if word.isascii() else key.decode("latin-1").translate(self.alphabet)
            ids = self._keep(key, self._bytes([t.id for t in self.tokenizer.model.tokenize(shown)]))
        return ids

    def chunk(self, chunk: bytes) -> bytes:
        """Ids of a chunk whose ASCII letters are small."""
        if chunk.isalpha():
            return self._keep(chunk, self._bytes([t.id for t in self.tokenizer.model.tokenize(chunk.decode())]))
        text = chunk.decode()
        # below this letter nothing is composed or split by NFC, small letters are one character each, and letters are letters in every version of Unicode
        if max(text) < "\u0250" and not ODD.search(text):
            return self._keep(chunk, b"".join(map(self._word, self.words.findall(text.lower()))))
        return self._keep(chunk, self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids))

    def encode(self, text: bytes | None) -> bytes:
        """Ids of a UTF-8 text as little-endian numbers of ``wide``; null is empty."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._bytes(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        get, chunk = self.known.get, self.chunk
        return b"".join([chunk(c) if (ids := get(c)) is None else ids for c in text.lower().split()])


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


# ---- the linear program ----


def falling(counts: np.ndarray, size: int, whole: bool) -> list[tuple[dict[int, int], float, int]]:
    """Patterns of falling lengths that use up a histogram: (length to copies, multiple, the length that ran out).

    ``counts[l]`` rests of length l. With ``whole`` multiples are whole numbers; otherwise every pattern uses up a length.
    """
    left = counts.astype(np.int64 if whole else float).copy()
    out = []
    while len(alive := np.flatnonzero(left)):
        room, pattern = size, {}
        while room and (i := int(np.searchsorted(alive, room, side="right"))):
            length = int(alive[i - 1])
            copies = room // length if not whole else min(room // length, int(left[length]))
            pattern[length] = copies
            room -= copies * length
            alive = alive[: i - 1]
        share = {length: left[length] // k if whole else left[length] / k for length, k in pattern.items()}
        ends = min(share, key=share.__getitem__)
        times = share[ends]
        for length, k in pattern.items():
            left[length] -= k * times
        if not whole:
            left[ends] = 0
            left[left < 1e-9] = 0 if len(pattern) == 1 else left[left < 1e-9]
            np.maximum(left, 0, out=left)
        out.append((pattern, times, ends))
    return out


def knapsack(prices: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """The pattern of the highest price: by dynamic programming over room. ``prices[l]`` is -inf where no rest has length l."""
    behind = np.zeros(size + 1)  # best value of room c at size - c
    taken = np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        value = behind[size - room + 1 :] + prices[1 : room + 1]
        at = int(value.argmax())
        if value[at] > behind[size - room + 1]:
            behind[size - room], taken[room] = value[at], at + 1
        else:
            behind[size - room] = behind[size - room + 1]
    pattern, room = {}, size
    while room:
        length = int(taken[room])
        if length:
            pattern[length] = pattern.get(length, 0) + 1
        room -= length or 1
    return float(behind[0]), pattern


class Basis:
    """A basis of patterns: triangular at the start, then a product of pivots."""

    def __init__(self, columns: list[dict[int, int]], rows: list[int]):
        self.row = {length: i for i, length in enumerate(rows)}
        self.lengths = rows
        self.columns = list(columns)
        self.start = [(np.array([self.row[x] for x in c if x != own], np.int64), np.array([float(k) for x, k in c.items() if x != own]), float(c[own])) for c, own in zip(columns, rows, strict=True)]
        self.pivots: list[tuple[int, np.ndarray]] = []

    def solve(self, right: np.ndarray) -> np.ndarray:
        """x with B x = right."""
        x = right.copy()
        for j in range(len(x)):
            if x[j]:
                rows, values, own = self.start[j]
                x[j] /= own
                x[rows] -= values * x[j]
        for r, step in self.pivots:
            at = x[r] / step[r]
            x -= step * at
            x[r] = at
        return x

    def prices(self) -> np.ndarray:
        """y with y B = 1."""
        y = np.ones(len(self.start))
        for r, step in reversed(self.pivots):
            y[r] = (y[r] - (y @ step - y[r] * step[r])) / step[r]
        for j in range(len(y) - 1, -1, -1):
            rows, values, own = self.start[j]
            y[j] = (y[j] - values @ y[rows]) / own
        return y

    def enter(self, pattern: dict[int, int], x: np.ndarray) -> np.ndarray:
        """Brings a pattern in and takes out the column that falls to zero first; the new multiples."""
        right = np.zeros(len(x))
        for length, k in pattern.items():
            right[self.row[length]] = k
        step = self.solve(right)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        r = int(ratio.argmin())
        if not np.isfinite(ratio[r]):
            raise ArithmeticError("the program is unbounded")
        new = np.maximum(x - step * ratio[r], 0)
        new[r] = ratio[r]
        self.pivots.append((r, step))
        self.columns[r] = pattern
        return new


def generate(counts: np.ndarray, size: int, gap: float = 1e-5, rounds: int = 100) -> tuple[list[tuple[dict[int, int], float]], float, float]:
    """Patterns with their multiples in the linear program, its value, and a lower bound of it.

    Ends when value and bound lie within ``gap`` of one another, when no pattern is worth more than a sequence, or after ``rounds`` columns (the bound then
    says how far it is); each round costs one knapsack. What is not reached is only efficiency: every rest is still placed.
    """
    begun = falling(counts, size, whole=False)
    if not begun:
        return [], 0.0, 0.0
    seen: dict[int, tuple[dict[int, int], float]] = {ends: (p, t) for p, t, ends in begun}
    rest = [int(x) for x in np.flatnonzero(counts) if int(x) not in seen]  # ran out together with another
    rows = [*rest, *(ends for _, _, ends in begun)]
    basis = Basis([*({x: 1} for x in rest), *(p for p, _, _ in begun)], rows)
    x = np.array([*(0.0 for _ in rest), *(t for _, t, _ in begun)])
    bound = float(counts @ np.arange(len(counts))) / size
    for _ in range(rounds):
        value = float(x.sum())
        if value <= bound * (1 + gap):
            break
        y = basis.prices()
        prices = np.full(size + 1, -np.inf)
        prices[rows] = y
        worth, pattern = knapsack(prices, size)
        bound = max(bound, value / max(worth, 1))
        if worth <= 1 + 1e-9:
            break
        x = basis.enter(pattern, x)
    return list(zip(basis.columns, x.tolist(), strict=True)), float(x.sum()), bound


@dataclass
class Plan:
    """Where the rests go. A rest of length l and rank k among its length stands at ``first[l] + k``; ``starts`` are where stretches begin in that order.

    In a stretch of ``copies`` > 0, each sequence from ``base`` on takes so many, the first at ``inner``. With 0 copies the rests lie in the stream
    from ``base`` on. ``ends`` are the stream's cuts, ``stream`` its first sequence, ``full`` the first sequence of whole pieces.
    """

    size: int
    first: np.ndarray
    whole_first: np.ndarray
    starts: np.ndarray
    copies: np.ndarray
    base: np.ndarray
    inner: np.ndarray
    full: int
    stream: int
    ends: np.ndarray
    value: float
    bound: float


def powers(n: int) -> list[int]:
    """Falling powers of two that add up to ``n``."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def plan(counts: np.ndarray, wholes: np.ndarray, size: int, gap: float = 1e-5, rounds: int = 100) -> Plan:
    """Plan for ``counts[l]`` rests of length l (0 counts documents without one) and ``wholes[l]`` whole sequences of documents with such a rest."""
    rests = counts.copy()
    rests[0] = 0
    fractional, value, bound = generate(rests, size, gap, rounds)
    left = rests.copy()
    used: list[tuple[dict[int, int], int]] = []

    def take(pattern: dict[int, int], times: int) -> None:
        times = min(times, *(int(left[x]) // k for x, k in pattern.items()))
        if times > 0 and sum(x * k for x, k in pattern.items()) == size:
            used.append((pattern, times))
            for x, k in pattern.items():
                left[x] -= k * times

    for pattern, times in sorted(fractional, key=lambda p: -p[1]):
        take(pattern, int(times + 1e-6))
    for pattern, times, _ in falling(left.copy(), size, whole=True):
        take(pattern, int(times))
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    done = np.zeros(len(counts), np.int64)
    rows, sequence = [], 0
    for pattern, times in used:
        inner = 0
        for x, k in sorted(pattern.items(), reverse=True):
            rows.append((int(first[x] + done[x]), k, sequence, inner))
            done[x] += k * times
            inner += x * k
        sequence += times
    at = 0
    for x in np.flatnonzero(left)[::-1]:
        rows.append((int(first[x] + done[x]), 0, at, 0))
        at += int(left[x]) * int(x)
    ends = np.cumsum([*powers(at % size)], dtype=np.int64) + at // size * size
    rows.sort()
    starts, copies, base, inner = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    whole_first = np.concatenate([[0], np.cumsum(wholes)])[:-1]
    full = sequence
    return Plan(size, first, whole_first, starts, copies, base, inner, full, full + int(wholes.sum()), ends, value, bound)


def _places(p: Plan, length: int, position: int) -> list[tuple[int, int, int, int]]:
    """(start in the rest, length, sequence, offset) of each part of the rest at ``position``."""
    i = int(np.searchsorted(p.starts, position, side="right")) - 1
    beyond = position - int(p.starts[i])
    if k := int(p.copies[i]):
        return [(0, length, int(p.base[i]) + beyond // k, int(p.inner[i]) + beyond % k * length)]
    out, begun, at = [], 0, int(p.base[i]) + beyond * length
    straight = int(p.ends[-1]) // p.size * p.size if len(p.ends) else None
    while begun < length:
        if straight is None or at < straight:
            sequence, opened = at // p.size, at // p.size * p.size
            closed = opened + p.size
        else:
            j = int(np.searchsorted(p.ends, at, side="right"))
            sequence, opened, closed = straight // p.size + j, int(p.ends[j - 1]) if j else straight, int(p.ends[j])
        n = min(length - begun, closed - at)
        out.append((begun, n, p.stream + sequence, at - opened))
        begun, at = begun + n, at + n
    return out


# ---- in Spark ----

_TOKENISED = "pid int, row long, n long, rest int, rank long, whole_rank long, crcs array<long>, ids binary"
_PLACED = "pid int, row long, n long, start long, length long, crc long, sequence_id long, offset long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}


def _batch(ddl: str, columns: list[list], first: pa.Array | None = None) -> pa.RecordBatch:
    names, kinds = zip(*(x.split(" ") for x in ddl.split(", ")), strict=True)
    arrays = [pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*([first] if first is not None else []), *arrays], ["id", *names] if first is not None else list(names))


def _tokenise(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_of(path)
        pid = TaskContext.get().partitionId()
        end, width, row = ids._bytes([end_id]), ids.wide.itemsize, 0
        ranks: dict[int, list[int]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, rows = batch.slice(at, ROWS), []
                for text in part.column(1).to_pylist():
                    found = ids.encode(text) + end
                    whole, rest = divmod(n := len(found) // width, size)
                    cuts = [found[i : i + size * width] for i in range(0, len(found), size * width)]
                    rank = ranks.setdefault(rest, [0, 0])
                    rows.append((pid, row, n, rest, *rank, [zlib.crc32(np.frombuffer(c, ids.wide).astype("<u4").tobytes()) for c in cuts], found))
                    rank[0] += 1
                    rank[1] += whole
                    row += 1
                yield _batch(_TOKENISED, list(map(list, zip(*rows, strict=True))), part.column(0))

    return run


def _place(p: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, take = [], []
            columns = [batch.column(c).to_pylist() for c in ("pid", "row", "n", "rest", "crcs", "rank", "whole_rank")]
            for at, (pid, row, n, rest, crcs, rank, whole_rank) in enumerate(zip(*columns, strict=True)):
                whole = n // p.size
                first = p.full + int(p.whole_first[rest]) + whole_rank
                rows += [(pid, row, n, i * p.size, p.size, crcs[i], first + i, 0) for i in range(whole)]
                parts = _places(p, rest, int(p.first[rest]) + rank) if rest else []
                rows += [(pid, row, n, whole * p.size + start, length, crcs[-1] if len(parts) == 1 else None, sequence, offset) for start, length, sequence, offset in parts]
                take += [at] * (whole + len(parts))
            if rows:
                yield _batch(_PLACED, list(map(list, zip(*rows, strict=True))), batch.column("id").take(pa.array(take)))

    return run


@dataclass
class Packed:
    """``tokens``: the documents' ids, as written. ``pieces``: id, pid, row, n, start, length, crc, sequence_id, offset, each in one sequence. ``plan``: what it rests on."""

    tokens: DataFrame
    pieces: DataFrame
    plan: Plan
    wide: int

    def with_ids(self) -> DataFrame:
        """The pieces with ``ids``: their own, as little-endian unsigned 32-bit numbers."""
        return self._cut(self.pieces)

    def _cut(self, pieces: DataFrame) -> DataFrame:
        wide = self.wide
        both = pieces.join(self.tokens.select("pid", "row", "ids"), ["pid", "row"])

        def start():
            return lambda ids, starts, lengths: [np.frombuffer(b, f"<u{wide}", n, s * wide).astype("<u4").tobytes() for b, s, n in zip(ids, starts, lengths, strict=True)]

        return both.withColumn("ids", arrow_column("binary", start, F.col("ids"), F.col("start"), F.col("length")))

    def with_crc(self) -> DataFrame:
        """The pieces with ``crc``, the CRC-32 of their ids; only rests that were cut are read again."""
        cut = self._cut(self.pieces.where("crc IS NULL")).withColumn("crc", F.crc32("ids"))
        return self.pieces.where("crc IS NOT NULL").unionByName(cut.drop("ids"))


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2, gap: float = 1e-5, rounds: int = 100) -> Packed:
    """All rows of ``df`` packed into sequences of ``size`` tokens.

    A null text is empty and has the end id alone; a null id is kept; repeated rows are documents of their own; further columns are
    ignored and may have any name; a text of any length is encoded whole and cut into whole sequences and a rest; an empty table has no pieces. Sequences without padding: all that
    a pattern fills, whole pieces, and the stream, whose last sequences are powers of two. ``size`` has to be a power of two.
    The ids are written once as Parquet to the shared folder and stay there for the reader. The driver gets the histogram (``size`` rows).
    """
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    spark = df.sparkSession
    top = f"{shared_dir(spark).rstrip('/')}/packing-{uuid.uuid4().hex}"
    kind = df.schema[id_col].dataType.simpleString()
    plain = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    plain.mapInArrow(_tokenise(path, size, end_id), f"id {kind}, {_TOKENISED}").write.parquet(f"{top}/tokens")
    tokens = spark.read.parquet(f"{top}/tokens")
    each = tokens.groupBy("pid", "rest").agg(F.count("*").alias("docs"), F.sum(F.col("n") - F.col("rest")).alias("in_whole"))
    counts, wholes = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for rest, docs, in_whole in each.groupBy("rest").agg(F.sum("docs"), F.sum("in_whole")).collect():  # at most a row for each length
        counts[rest], wholes[rest] = docs, in_whole // size
    p = plan(counts, wholes, size, gap, rounds)
    before = Window.partitionBy("rest").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = each.select("pid", "rest", sums("docs").alias("docs_before"), (sums("in_whole") / size).cast("long").alias("whole_before"))
    ranked = tokens.select("id", "pid", "row", "n", "rest", "crcs", "rank", "whole_rank").join(offsets, ["pid", "rest"])
    ranked = ranked.select("id", "pid", "row", "n", "rest", "crcs", (F.col("rank") + F.col("docs_before")).alias("rank"), (F.col("whole_rank") + F.col("whole_before")).alias("whole_rank"))
    pieces = checkpoint(ranked.mapInArrow(_place(p), f"id {kind}, {_PLACED}"))
    return Packed(tokens, pieces, p, ids_of(path).wide.itemsize)


def pieces_with_crc(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 4096, end_id: int = 2) -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    out = pack(df, path, id_col, text_col, size, end_id).with_crc()
    col: Column = F.col("id")
    return out.select(col.alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")
