"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the sum of what its own vector (words of the sample; others share one) and the mean vector of its
character trigrams contribute. Windows of ``WIDTH`` words that overlap by a third cover the whole text; each is read in
both directions, its states are pooled by attention, and the text's score is that of its highest window. Fitting
starts from random windows under their text's label and goes on with each text's highest windows.

Tasks work on the distinct words of a batch: the input products of both directions are made once per word and
gathered per window and step.

Nulls: a null or wordless text has score 0. A null doc_id is learnt from if labelled (which it cannot be) and scored.
Repeated rows are scored one by one. Very long texts are scored in whole, a block at a time, and learnt from in whole
(``rows`` and ``chars`` bound the sample). Texts whose highest windows tie score alike. Without labelled rows every score
is 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docraster.llm.shared import batches_of, fold, hand_back, lean, sample_of_labels
from docraster.llm.words import NOT_ALNUM, Words, blocks_of, mix, words_of

WIDTH, STRIDE, HIDDEN, WORD_DIM, CHAR_DIM = 24, 16, 8, 16, 8
TRIGRAMS, MOST_WORDS, LEAST_COUNT = 1024, 20_000, 5
SAMPLE_ROWS, SAMPLE_CHARS, THRESHOLD = 1_200, 36_000_000, 0.3
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def trigrams(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the chosen words (their ends marked): values, and where each word's begin."""
    size = w.ends[which] - w.starts[which]
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) - np.repeat(first, size) + np.repeat(w.starts[which], size)
    start, end = np.repeat(w.starts[which], size), np.repeat(w.ends[which], size)
    b = _FOLD[w.data].astype(np.uint64)
    before = np.where(at > start, b[np.maximum(at - 1, 0)], 0)
    after = np.where(at + 1 < end, b[np.minimum(at + 1, len(b) - 1)], 0)
    return (mix(before << np.uint64(16) | b[at] << np.uint64(8) | after) % np.uint64(TRIGRAMS)).astype(np.int64), first


@dataclass
class Net:
    words: np.ndarray  # sorted hashes of known words; word i has row i + 2 of "word" (0: padding, 1: unknown)
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, words: np.ndarray, seed: int = 3) -> "Net":
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.standard_normal(s).astype(np.float32) * (0.3 if len(s) == 1 or s[0] > 100 else 1 / np.sqrt(s[0]))
        p = {"word": g(len(words) + 2, WORD_DIM) * 0.3, "char": g(TRIGRAMS, CHAR_DIM) * 0.1}
        for way in "fb":
            p |= {f"x{way}": g(WORD_DIM + CHAR_DIM, 3 * HIDDEN), f"c{way}": np.zeros(3 * HIDDEN, np.float32), f"h{way}": g(HIDDEN, 3 * HIDDEN)}
        p |= {"att": g(2 * HIDDEN, HIDDEN), "att_v": g(HIDDEN), "out": g(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        return cls(words, p)

    def known(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 2, 1)

    def inputs(self, ids: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Input vectors of words (a padding row comes first)."""
        n = np.diff(np.append(first, len(grams)))
        chars = np.add.reduceat(self.p["char"][grams], first, axis=0) / n[:, None] if len(first) else np.zeros((0, CHAR_DIM), np.float32)
        rows = np.concatenate([self.p["word"][ids], chars], 1)
        return np.concatenate([np.concatenate([self.p["word"][:1], np.zeros((1, CHAR_DIM), np.float32)], 1), rows]).astype(np.float32)

    def read(self, x: np.ndarray, way: str, keep: bool = False):
        """x: a function from step to the input products (n, 3H). States of each step, and what the gradient needs."""
        if not keep:
            return self.skim(x, way), None
        u, h, states, memo = self.p[f"h{way}"], None, [], []
        for t in range(WIDTH):
            a = x(t)
            if h is None:
                h = np.zeros((len(a), HIDDEN), np.float32)
            s = h @ u
            zr = sigmoid(a[:, : 2 * HIDDEN] + s[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(a[:, 2 * HIDDEN :] + r * s[:, 2 * HIDDEN :])
            memo.append((h, z, r, n, s[:, 2 * HIDDEN :]))
            h = n + z * (h - n)
            states.append(h)
        return states, memo

    def skim(self, x, way: str) -> list[np.ndarray]:
        """The states alone, with as few passes over the arrays as it takes; sigmoid(x) = (1 + tanh(x / 2)) / 2."""
        gates = 2 * HIDDEN
        half = np.concatenate([np.full(gates, 0.5), np.ones(HIDDEN)]).astype(np.float32)
        u, h, states = self.p[f"h{way}"] * half, None, []
        for t in range(WIDTH):
            a = x(t) * half
            if h is None:
                zr, n = np.tanh(a[:, :gates]), np.tanh(a[:, gates:])
                h = n * (0.5 - 0.5 * zr[:, :HIDDEN])
            else:
                s = h @ u
                zr = s[:, :gates]
                zr += a[:, :gates]
                zr = np.tanh(zr)
                zr += 1
                zr *= 0.5
                n = s[:, gates:]
                n = zr[:, HIDDEN:] * n
                n += a[:, gates:]
                np.tanh(n, out=n)
                h = h - n
                h *= zr[:, :HIDDEN]
                h += n
            states.append(h)
        return states

    def forward(self, table: tuple[np.ndarray, np.ndarray], windows: np.ndarray, keep: bool = False):
        """table: input products of both ways per word; windows: (n, WIDTH) rows of it, 0 where there is no word."""
        forth, memo_f = self.read(lambda t: table[0][windows[:, t]], "f", keep)
        back, memo_b = self.read(lambda t: table[1][windows[:, WIDTH - 1 - t]], "b", keep)
        states = np.stack([np.concatenate([f, b], 1) for f, b in zip(forth, back[::-1])], 1)  # (n, WIDTH, 2H)
        inner = np.tanh(states.reshape(-1, 2 * HIDDEN) @ self.p["att"])
        e = (inner @ self.p["att_v"]).reshape(windows.shape)
        e[windows == 0] = -1e4
        w = np.exp(e - e.max(1, keepdims=True))
        w /= w.sum(1, keepdims=True)
        pooled = np.einsum("nt,nth->nh", w, states)
        logit = pooled @ self.p["out"] + self.p["bias"]
        return logit, (states, inner, w, pooled, memo_f, memo_b)

    def table(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["xf"] + self.p["cf"], x @ self.p["xb"] + self.p["cb"]

    def gradient(self, windows: np.ndarray, ids: np.ndarray, grams: np.ndarray, first: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Log loss of the windows under labels y and its gradient, by back-propagation through time."""
        p, n = self.p, len(windows)
        x = self.inputs(ids, grams, first)
        table = self.table(x)
        logit, (states, inner, w, pooled, memo_f, memo_b) = self.forward(table, windows, True)
        prob = sigmoid(logit)
        loss = float(-np.mean(np.log(np.where(y > 0, prob, 1 - prob) + 1e-7)))
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_logit = (prob - y) / n
        g["bias"][0], g["out"] = d_logit.sum(), pooled.T @ d_logit
        d_pooled = d_logit[:, None] * p["out"]
        d_states = w[:, :, None] * d_pooled[:, None, :]
        d_w = np.einsum("nh,nth->nt", d_pooled, states)
        d_e = (w * (d_w - (w * d_w).sum(1, keepdims=True))).reshape(-1)
        g["att_v"] = inner.T @ d_e
        d_inner = d_e[:, None] * p["att_v"] * (1 - inner**2)
        g["att"] = states.reshape(-1, 2 * HIDDEN).T @ d_inner
        d_states += (d_inner @ p["att"].T).reshape(states.shape)
        d_x = np.zeros_like(x)
        for way, memo, own in (("f", memo_f, d_states[:, :, :HIDDEN]), ("b", memo_b, d_states[:, ::-1, HIDDEN:])):
            u, d_table, d_h = p[f"h{way}"], np.zeros_like(table[0]), np.zeros((n, HIDDEN), np.float32)
            for t in range(WIDTH - 1, -1, -1):
                h, z, r, m, s = memo[t]
                d_h = d_h + own[:, t]
                d_m = d_h * (1 - z) * (1 - m * m)
                d_z = d_h * (h - m) * z * (1 - z)
                d_r = d_m * s * r * (1 - r)
                d_s = np.concatenate([d_z, d_r, d_m * r], 1)
                g[f"h{way}"] += h.T @ d_s
                np.add.at(d_table, windows[:, t if way == "f" else WIDTH - 1 - t], np.concatenate([d_z, d_r, d_m], 1))
                d_h = d_h * z + d_s @ u.T
            g[f"x{way}"] += x.T @ d_table
            g[f"c{way}"] += d_table.sum(0)
            d_x += d_table @ p[f"x{way}"].T
        np.add.at(g["word"], np.append(0, ids), d_x[:, :WORD_DIM])
        times = np.diff(np.append(first, len(grams)))
        np.add.at(g["char"], grams, np.repeat(d_x[1:, WORD_DIM:] / times[:, None], times, axis=0))
        return loss, g


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k in self.p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.01 * (g[k] ** 2 - self.v[k])
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.v[k] / (1 - 0.99**self.n)) + 1e-7)).astype(np.float32)


def windows_of(per_doc: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of each text as rows of the word table (0 beyond its end), and each window's text. Wordless texts have none."""
    n = np.diff(per_doc)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WIDTH) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), count)
    start = per_doc[doc] + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
    at = start[:, None] + np.arange(WIDTH)
    inside = at < per_doc[doc + 1][:, None]
    return np.where(inside, rows[np.minimum(at, len(rows) - 1)] if len(rows) else 0, 0), doc


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over the rows of the texts' distinct words, their texts, and the distinct words' hashes and trigrams."""
    w = words_of(texts, NOT_ALNUM)
    distinct, which, code = np.unique(w.hashes(), return_index=True, return_inverse=True)
    windows, doc = windows_of(w.per_doc, code + 1)
    return windows, doc, distinct, *trigrams(w, which)


def top_windows(net: Net, windows: np.ndarray, ids: np.ndarray, grams: np.ndarray, first: np.ndarray, block: int = 4096) -> np.ndarray:
    table = net.table(net.inputs(ids, grams, first))
    return np.concatenate([net.forward(table, windows[i : i + block])[0] for i in range(0, len(windows), block)]) if len(windows) else np.zeros(0, np.float32)


def fit(sample: list[tuple[str, int]], seed: int = 5, batch: int = 256, warm_steps: int = 160, rounds: int = 3, passes: int = 3, least_steps: int = 50, repeats: int = 32) -> Net | None:
    if len({y for _, y in sample}) < 2:
        return None
    rng = np.random.default_rng(seed)
    texts = pa.array([t for t, _ in sample], pa.string())
    labels = np.array([y for _, y in sample], np.float32)
    w = words_of(texts, NOT_ALNUM)
    known, n = np.unique(w.hashes(), return_counts=True)
    often = np.argsort(-n, kind="stable")[:MOST_WORDS]
    net = Net.fresh(np.sort(known[often][n[often] >= LEAST_COUNT]))
    windows, doc, distinct, grams, first = encoded(texts)
    ids = net.known(distinct)
    adam = Adam(net.p, 0.02)

    def step(rows: np.ndarray) -> None:
        """One step on some windows, and on a few that repeat a word of a clean text, over the words in them only."""
        clean = windows[rng.choice(sides[0], repeats), 0]
        some = np.concatenate([windows[rows], np.repeat(clean[:, None], WIDTH, axis=1)])
        used, code = np.unique(some, return_inverse=True)
        own = used[used > 0] - 1
        begins = np.append(first, len(grams))
        size = begins[own + 1] - begins[own]
        starts = np.cumsum(size) - size
        pick = np.arange(size.sum()) - np.repeat(starts, size) + np.repeat(begins[own], size)
        shift = 0 if used[0] == 0 else 1
        y = np.concatenate([labels[doc[rows]], np.zeros(repeats, np.float32)])
        _, g = net.gradient(code.reshape(some.shape) + shift, ids[own], grams[pick], starts, y)
        adam.step(g)

    sides = [np.flatnonzero(labels[doc] == y) for y in (0, 1)]
    if not all(map(len, sides)):
        return None
    for _ in range(warm_steps):
        step(np.concatenate([rng.choice(s, batch // 2) for s in sides]))
    adam.rate = 0.01
    for _ in range(rounds):
        logit = top_windows(net, windows, ids, grams, first)
        order = np.lexsort((-logit, doc))
        best = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]  # each text's highest window
        rows = np.concatenate([best, rng.choice(sides[0], len(best))])
        parts = max(1, len(rows) // batch)
        for _ in range(max(passes, -(-least_steps // parts))):  # small samples are gone over more often
            for some in np.array_split(rng.permutation(rows), parts):
                step(some)
    return net


def overlapping(text: bytes, block: int) -> Iterator[bytes]:
    """A long text as parts that have the very windows of the whole between them: each but the last ends with its last full
    window, and the next begins where the window after that does."""
    held = b""
    for raw in blocks_of(text, size=block, breaks=NOT_ALNUM):
        w = words_of(pa.array([held.decode("utf-8", "surrogatepass")], pa.string()), NOT_ALNUM)
        full = (len(w.starts) - WIDTH) // STRIDE + 1
        if full > 0:
            yield held[: w.ends[(full - 1) * STRIDE + WIDTH - 1]]
            held = held[w.starts[full * STRIDE] :]
        held += raw
    yield held


def score_texts(net: Net, texts: pa.Array, block: int = 1 << 20) -> np.ndarray:
    """Probability of the highest window of each text; one long text goes a block at a time."""
    if len(texts) == 1 and texts[0].is_valid and texts[0].as_buffer().size > 2 * block:
        raw = texts[0].as_py().encode("utf-8", "surrogatepass")
        return np.array([max(highest(net, pa.array([part.decode("utf-8", "surrogatepass")], pa.string()))[0] for part in overlapping(raw, block))])
    return highest(net, texts)


def highest(net: Net, texts: pa.Array) -> np.ndarray:
    windows, doc, distinct, grams, first = encoded(texts)
    out = np.zeros(len(texts))
    if len(windows):
        np.maximum.at(out, doc, sigmoid(top_windows(net, windows, net.known(distinct), grams, first).astype(np.float64)))
    return out


def score(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id and score of each text."""
    if net is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def task(batches):
        for batch in batches:
            for part in batches_of(batch, size=2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(score_texts(shared.value, part.column("text")))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(task), "doc_id long, score double")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Net | None:
    net = fit(sample_of_labels(docs.sparkSession, labels, docs, "toxic", rows, chars))
    hand_back()
    return net


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns outside the held-out fold (crc32 of doc_id mod 4 is 2) and scores every text."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", fold(4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
