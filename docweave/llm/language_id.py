"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in both directions, labels every position with a distribution over the
languages, and a document's probabilities are the mean over all its positions. It is written and
trained in numpy by backpropagation through time. Long texts are read in overlapping stretches: each has
``context`` bytes of its neighbours on either side, which move the states but are not labelled, so that every byte of
every text is labelled once, by states that have read what lies around it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_column, free_name

PAD = 256


@dataclass(frozen=True)
class Settings:
    """Production parameters.

    ``sample_per_language`` bounds the training rows: at most so many documents of each language,
    chosen by a hash of id and text, each giving ``windows`` stretches of ``steps`` characters (cut to as many
    bytes) from hashed places of the whole text. ``inner`` and ``context`` are the bytes of a stretch that are labelled, and
    those read before and after them.
    """

    hidden: int = 8
    steps: int = 64
    inner: int = 96
    context: int = 32
    sample_per_language: int = 400
    windows: int = 6
    batch: int = 192
    updates: int = 200
    rate: float = 0.02
    seed: int = 7


class Network:
    """Weights by direction: ``x`` [3H, 257] for bytes (bias included), ``h`` [3H, H], ``b`` [H, 1] of the candidate."""

    def __init__(self, labels: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        c = len(labels)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            x = rng.normal(0, 0.3, (3 * hidden, 257))
            x[:, PAD] = 0
            x[:hidden, PAD] = 40  # the update gate keeps the state where there is no byte
            self.p |= {d + "x": x, d + "h": rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)), d + "b": np.zeros((hidden, 1)), d + "o": rng.normal(0, 0.3, (c, hidden))}
        self.p["c"] = np.zeros((c, 1))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _direction(self, d: str, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States after each position, [T, H, B]; with ``keep`` what the way back needs."""
        h_size, (steps, n) = self.hidden, ids.shape
        x, u, bias = self.p[d + "x"], self.p[d + "h"], self.p[d + "b"]
        states, tape = np.empty((steps, h_size, n), np.float32), []
        h = np.zeros((h_size, n), np.float32)
        a, m = np.empty((3 * h_size, n), np.float32), np.empty((3 * h_size, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(x, ids[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=m)
            gates = a[: 2 * h_size]
            gates += m[: 2 * h_size]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:h_size], gates[h_size:]
            inner = m[2 * h_size :]
            inner += bias
            new = a[2 * h_size :]
            new += r * inner
            np.tanh(new, out=new)
            if keep:
                tape.append((t, h, z.copy(), r.copy(), inner.copy(), new.copy()))
            h = np.subtract(h, new, out=states[t])
            h *= z
            h += new
        return states, tape

    def forward(self, ids: np.ndarray, context: int = 0) -> np.ndarray:
        """Summed position probabilities [C, B] over the positions that hold a byte; ids: [T, B].

        The first and last ``context`` positions are read but not summed.
        """
        first, stop = context, len(ids) - context
        f, _ = self._direction("f", ids[:stop], False)
        b, _ = self._direction("b", ids[first:], False)
        total = np.zeros((len(self.labels), ids.shape[1]), np.float32)
        for t in range(first, stop):
            e = self.p["fo"] @ f[t]
            e += self.p["bo"] @ b[t - first]
            e += self.p["c"]
            np.minimum(e, 60, out=e)
            np.exp(e, out=e)
            e *= (ids[t] != PAD) / e.sum(axis=0)
            total += e
        return total

    def gradient(self, ids: np.ndarray, truth: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the positions, and its gradient by backpropagation through time."""
        p, size = self.p, self.hidden
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        runs = {d: self._direction(d, ids, True) for d in "fb"}
        f, b = runs["f"][0], runs["b"][0]
        logits = np.einsum("ch,thn->tcn", p["fo"], f) + np.einsum("ch,thn->tcn", p["bo"], b) + p["c"]
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        mask = (ids != PAD).astype(np.float32)
        count = max(float(mask.sum()), 1.0)
        cols = np.arange(ids.shape[1])
        loss = -float((np.log(prob[:, truth, cols] + 1e-9) * mask).sum()) / count
        d_logit = prob
        d_logit[:, truth, cols] -= 1
        d_logit *= mask[:, None, :] / count
        grad["c"] += d_logit.sum(axis=(0, 2))[:, None]
        for d in "fb":
            states, tape = runs[d]
            grad[d + "o"] += np.einsum("tcn,thn->ch", d_logit, states)
            above = np.einsum("ch,tcn->thn", p[d + "o"], d_logit)
            d_h = np.zeros_like(states[0])
            u, pre_all = p[d + "h"], np.empty((len(ids), 3 * size, ids.shape[1]), np.float32)
            for t, h, z, r, inner, new in reversed(tape):
                d_h += above[t]
                d_new = d_h * (1 - z) * (1 - new * new)
                pre = pre_all[t]
                pre[:size] = d_h * (h - new) * z * (1 - z)
                pre[size : 2 * size] = d_new * inner * r * (1 - r)
                pre[2 * size :] = d_new
                through = pre.copy()
                through[2 * size :] *= r
                grad[d + "b"] += through[2 * size :].sum(axis=1, keepdims=True)
                grad[d + "h"] += through @ h.T
                d_h = d_h * z + u.T @ through
            flat, rows = ids.ravel(), pre_all.transpose(1, 0, 2).reshape(3 * size, -1)
            for k in range(3 * size):
                grad[d + "x"][k] = np.bincount(flat, rows[k], minlength=257)
            grad[d + "x"][:, PAD] = 0
        return loss, grad


def stretches(texts: list[str | None], inner: int, context: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns [context + inner + context, n] of byte numbers, and the number of columns of each text."""
    width, parts, counts = inner + 2 * context, [], []
    for t in texts:
        data = np.frombuffer((t or "").encode("utf-8", "replace"), np.uint8)
        n = -(-len(data) // inner)
        counts.append(n)
        if n:
            line = np.full(n * inner + 2 * context, PAD, np.int16)
            line[context : context + len(data)] = data
            parts.append(np.lib.stride_tricks.sliding_window_view(line, width)[::inner])
    ids = np.concatenate(parts).T if parts else np.empty((width, 0), np.int16)
    return np.ascontiguousarray(ids), np.array(counts, dtype=np.int64)


def train(rows: list[tuple[str, list[str]]], settings: Settings) -> Network | None:
    """Network from rows of a language and stretches of text, or None without any; the same rows give the same network."""
    rows = sorted((lang, sorted({w for w in windows if w})) for lang, windows in rows if lang is not None)
    rows = [r for r in rows if r[1]]
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    rng, net = np.random.default_rng(settings.seed), Network(labels, settings.hidden, settings.seed)
    windows, truth = [], []
    for lang, pieces in rows:
        for piece in pieces:
            data = piece.encode("utf-8", "replace")[: settings.steps]
            window = np.full(settings.steps, PAD, np.int16)
            window[: len(data)] = np.frombuffer(data, np.uint8)
            windows.append(window)
            truth.append(labels.index(lang))
    x, y = np.array(windows).T, np.array(truth)
    by_label = [np.flatnonzero(y == k) for k in range(len(labels))]
    m, v = ({k: np.zeros_like(w) for k, w in net.p.items()} for _ in range(2))
    for step in range(1, settings.updates + 1):
        pick = np.concatenate([rng.choice(own, -(-settings.batch // len(labels))) for own in by_label])
        _, grad = net.gradient(np.ascontiguousarray(x[:, pick]), y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = settings.rate * min(1.0, 2 * (1 - step / (settings.updates + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (Unicode category L; numerals such as Roman and circled ones are none)."""
    return any(map(str.isalpha, text or ""))


def predict(net: Network | None, texts: list[str | None], settings: Settings, columns: int = 2048) -> list[tuple[str, float]]:
    """(language, pooled probability) of each whole text; ("und", 0) for null and letterless texts."""
    sums = np.zeros((len(net.labels) if net else 0, 0))
    ids, counts = stretches(texts, settings.inner, settings.context)
    if net is not None and ids.shape[1]:
        sums = np.concatenate([net.forward(np.ascontiguousarray(ids[:, i : i + columns]), settings.context) for i in range(0, ids.shape[1], columns)], axis=1).astype(np.float64)
    out, at = [], 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        own, at = sums[:, at : at + n].sum(axis=1), at + n
        if net is None or not has_letter(t):
            out.append(("und", 0.0))
        else:
            k = int(np.argmax(own))
            out.append((net.labels[k], float(min(1.0, own[k] / own.sum()))))
    return out


def _fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def training_rows(df: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, list[str]]]:
    """A bounded sample, (lang, stretches): ``sample_per_language`` documents of each language outside fold 2.

    Rows that repeat an id and a text count as one. The driver gets one row for each language (the network has an output for each) and
    the sample, of which only the stretches leave the executors.
    """
    text = F.col(text_col)
    pool = df.where(F.col(lang_col).isNotNull() & text.isNotNull() & (_fold(id_col) != 2)).select(
        text.alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), text, F.lit(settings.seed)).alias("h")
    )
    sizes = pool.groupBy("lang").agg(F.count("*").alias("n"))
    # about twice the sample by a share of the hashes, then exactly the smallest hashes
    share = {r["lang"]: min(1.0, (2 * settings.sample_per_language + 40) / r["n"]) for r in sizes.collect()}
    if not share:
        return []
    limits = df.sparkSession.createDataFrame([(k, int(v * (1 << 30))) for k, v in share.items()], "lang string, most long")  # a row for each language
    near = pool.join(F.broadcast(limits), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("most"))
    last = F.greatest(F.length("text") - settings.steps + 1, F.lit(1))
    places = [(F.pmod(F.xxhash64("h", F.lit(i)), last) + 1).cast("int") for i in range(settings.windows)]
    near = near.select("lang", "h", F.array(*[F.substring("text", p, F.lit(settings.steps)) for p in places]).alias("windows"))
    picked = near.groupBy("lang", "h").agg(F.min("windows").alias("windows"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    return [(r["lang"], list(r["windows"])) for r in picked.withColumn("rank", rank).where(F.col("rank") <= settings.sample_per_language).collect()]


def prediction_column(text: Column, net: Network | None, settings: Settings) -> Column:
    """Struct lang_pred, score of the whole text."""

    def start():
        def work(texts: list[str | None]) -> list[dict]:
            rows, block, size = [], [], 0
            for t in texts:  # blocks of a MB keep the working arrays small
                block.append(t)
                size += len(t or "")
                if size >= 1_000_000:
                    rows += predict(net, block, settings)
                    block, size = [], 0
            rows += predict(net, block, settings) if block else []
            return [{"lang_pred": k, "score": s} for k, s in rows]

        return work

    return arrow_column("lang_pred string, score double", start, text)


def learn(df: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """The network of the bounded sample of ``df``; None if nothing is labelled."""
    return train(training_rows(df, settings, id_col, text_col, lang_col), settings)


def identify(df: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:  # noqa: B008
    """``id_col``, ``held_out``, ``lang_pred``, ``score`` of every row.

    ``und`` with score 0 where the text is null, empty or without a letter, and everywhere if no row
    could be learned from. Null labels are not learned; null ids count as fold null and are not learned either.
    Repeated rows get equal predictions; an empty table returns no row. Other columns are ignored.
    """
    net = learn(df, settings, id_col, text_col, lang_col)
    out = df.select(F.col(id_col), (F.coalesce(_fold(id_col) == 2, F.lit(False))).alias("held_out"), prediction_column(F.col(text_col), net, settings).alias("language"))
    return out.select(F.col(id_col), "held_out", "language.lang_pred", "language.score")


def accepted(df: DataFrame, settings: Settings = Settings(), margin: float = 0.13, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:  # noqa: B008
    """The rows of ``df``, with its columns, that are clearly in some learned language.

    The pooled probability of the best of n languages has to exceed chance by ``margin`` of what is left:
    1/n + margin (1 - 1/n), that is 0.35 for four. Texts that are null, empty or without a letter go, and every text if nothing could be learned.
    """
    net = learn(df, settings, id_col, text_col, lang_col)
    chance = 1 / max(1, len(net.labels)) if net else 1.0
    name = free_name(df.columns, "language")
    out = df.withColumn(name, prediction_column(F.col(text_col), net, settings))
    return out.where((F.col(f"{name}.lang_pred") != "und") & (F.col(f"{name}.score") >= chance + margin * (1 - chance))).drop(name)
