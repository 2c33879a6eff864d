"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens. It starts as one state that every symbol leads back to. Each merge
``a b -> c``, in the order of the file, applies one gadget: the target of the ``a`` arcs is copied
without its ``b`` arc, all ``a`` arcs lead to the copy, and wherever an ``a`` arc leaves, a new arc
``c`` leads to where ``b`` led from the old target. After the last merge the automaton accepts
exactly the correct tokenizations, and since each string has exactly one, every prefix of a word
ends in one known state: encoding follows arcs from position to position and never backtracks.
Decoding emits the labels of the arcs.

States are kept as copies of one another: a state stores its parent and the one arc it lost, and the
time, so that 49,000 merges need 49,000 records. The arcs that a state lost directly become a table
when it is first used; a label that was made later from a lost one is lost with it.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_column

#: Distinct words kept in a worker's table of encoded words, and arcs and states in its tables; a full table starts anew.
CACHE_WORDS = 300_000
CACHE_ARCS = 1_000_000
CACHE_STATES = 60_000
#: Bits of a label in the number of an arc.
LABEL_BITS = 20
_CONTROLS = regex.compile("[\x1c-\x1f]")


def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes, as byte-level vocabularies use them."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Automaton:
    """Compiled merges; states are numbers, 0 is the start."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        if max(vocab.values(), default=0) >> LABEL_BITS:
            raise ValueError(f"a label has more than {LABEL_BITS} bits")
        self.parent = [0]
        self.lost = [(-1, 0)]
        self.spine: dict[int, tuple[tuple[int, int], ...]] = {i: ((i, 1 << 60),) for i in vocab.values()}
        self.target = dict.fromkeys(vocab.values(), 0)
        for time, (a, b) in enumerate(merges):
            self._gadget(vocab[a], vocab[b], vocab[a + b], time)
        self._tables: dict[int, dict[int, int]] = {}
        self.arcs: dict[int, bool] = {}

    def _gadget(self, a: int, b: int, c: int, time: int) -> None:
        after_b = self.target[b]
        self.parent.append(self.target[a])
        self.lost.append((b, time))
        self.target[a] = len(self.parent) - 1
        self.target[c] = after_b
        # c leaves a state only if a did when c was made: c is lost with any label it begins with
        self.spine[c] = ((c, 1 << 60), *((x, min(t, time)) for x, t in self.spine[a]))

    def _table(self, state: int) -> dict[int, int]:
        table, s = {}, state
        while s:
            label, time = self.lost[s]
            table[label] = min(time, table.get(label, time))
            s = self.parent[s]
        if len(self._tables) >= CACHE_STATES:
            self._tables.clear()
        self._tables[state] = table
        return table

    def arc(self, state: int, label: int) -> bool:
        """Whether ``label`` leaves ``state``; it leads to ``target[label]``. Kept in ``arcs``."""
        table = self._tables.get(state)
        if table is None:
            table = self._table(state)
        if len(self.arcs) >= CACHE_ARCS:
            self.arcs.clear()
        there = self.arcs[state << LABEL_BITS | label] = not any(table.get(x, 1 << 61) <= t for x, t in self.spine[label])
        return there


class WordTokenizer:
    """The file's normaliser, splitter, model and (absent) decoder; built once in each worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.automaton = Automaton(vocab, [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]])
        self.label = {i: t for t, i in vocab.items()}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(self.suffix)}
        self.final = {t.removesuffix(self.suffix): i for t, i in vocab.items() if t.endswith(self.suffix)}
        self.longest = max(map(len, self.final))
        # also what a token begins with, without a label: the search stops where no token goes on
        self.inner = {t[:k]: -1 for t in self.inner for k in range(1, len(t))} | self.inner
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.label |= {i: t for t, i in added.items()}
        self.added = {t: i.to_bytes(4, "little") for t, i in added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, added)) + ")")
        self.bytes = {b: c for b, c in byte_alphabet().items()}
        splits = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.words = regex.compile(splits[0])
        self.space = regex.compile(r"\s+")
        self.known: dict[str, bytes] = {}

    def path_of(self, word: str) -> list[int]:
        """Labels of the one accepted path over a word in the byte alphabet."""
        n, inner, target, arcs, arc = len(word), self.inner, self.automaton.target, self.automaton.arcs, self.automaton.arc
        bits, state, back = LABEL_BITS, [-1] * (n + 1), [(0, 0)] * (n + 1)
        state[0] = 0
        for i in range(n):
            if (s := state[i]) < 0:
                continue
            for j in range(i + 1, n):
                label = inner.get(word[i:j])
                if label is None:
                    break
                if label >= 0 and state[j] < 0:
                    there = arcs.get(s << bits | label)
                    if arc(s, label) if there is None else there:
                        state[j], back[j] = target[label], (i, label)
            if state[n] < 0 and n - i <= self.longest and (label := self.final.get(word[i:])) is not None:
                there = arcs.get(s << bits | label)
                if arc(s, label) if there is None else there:
                    state[n], back[n] = 0, (i, label)
        out, j = [], n
        while j:
            j, label = back[j]
            out.append(label)
        return out[::-1]

    def chunk(self, chunk: str) -> bytes:
        """Ids, as little-endian 32-bit numbers, of text without white space."""
        known, parts = self.known, []
        for w in self.words.findall(chunk):
            ids = known.get(w)
            if ids is None:
                ids = array("I", self.path_of(w.encode("utf-8", "replace").decode("latin-1").translate(self.bytes))).tobytes()
                self._keep(w, ids)
            parts.append(ids)
        whole = b"".join(parts)
        if len(parts) != 1:
            self._keep(chunk, whole)
        return whole

    def _keep(self, chunk: str, ids: bytes) -> None:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        if len(chunk) < 60:
            self.known[chunk] = ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as little-endian 32-bit numbers."""
        text = text or ""
        parts: list[bytes] = []
        for piece in self.special.split(text) if "<|" in text else [text]:
            if piece in self.added:
                parts.append(self.added[piece])
                continue
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")
            piece, known = piece.lower(), self.known
            # words never span white space; str.split() also splits at four controls that are none
            for w in self.space.split(piece) if _CONTROLS.search(piece) else piece.split():
                ids = known.get(w)
                parts.append(self.chunk(w) if ids is None else ids)
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """Labels of the arcs that the ids name; the file has no decoder, so a space stands between them."""
        label = self.label
        return " ".join([label[x] for x in array("I", ids)])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def digests(text: Column, path: str) -> Column:
    """Struct n_tokens, ids_sha256, decoded_sha256 of the whole text."""

    def start():
        t, sha = tokenizer(path), hashlib.sha256

        def one(text: str | None) -> dict:
            ids = t.encode(text)
            return {"n_tokens": len(ids) // 4, "ids_sha256": sha(ids).hexdigest(), "decoded_sha256": sha(t.decode(ids).encode()).hexdigest()}

        return lambda texts: list(map(one, texts))

    return arrow_column("n_tokens long, ids_sha256 string, decoded_sha256 string", start, text)


def encode_column(text: Column, path: str) -> Column:
    """Array of token ids of the whole text (empty for null)."""

    def start():
        t = tokenizer(path)
        return lambda texts: [list(array("I", t.encode(x))) for x in texts]

    return arrow_column("array<int>", start, text)


def decode_column(ids: Column, path: str) -> Column:
    """Text that an array of token ids decodes to (empty for null)."""

    def start():
        label = tokenizer(path).label
        return lambda rows: [" ".join([label[i] for i in r or []]) for r in rows]

    return arrow_column("string", start, ids)


def encode_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` of every row.

    Null counts as the empty text, which has no tokens. Any length is encoded whole. Repeated rows
    return repeated rows, an empty table none. Other columns are ignored. No shuffle. ``path`` is a tokenizer file that every
    executor can open.
    """
    out = df.select(F.col(id_col).alias("id"), digests(F.col(text_col), path).alias("digests"))
    return out.select(F.col("id").alias(id_col), "digests.*")
