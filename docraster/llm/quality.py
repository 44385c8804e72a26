"""Quality: attention-based multiple-instance learning over a document's passages.

Every passage of ``PASSAGE`` words is encoded (one tanh layer over its shares of byte classes, the lengths of its
words, how far they repeat, and a hashed bag of the words themselves), gated attention weighs the passages, and the
weighted representation is scored by a logistic unit. The weights are learnt from document labels alone, in numpy, on
a bounded sample.

A passage's bytes reach from its first word (or the text's start) to the next passage (or the text's end), so a score
depends on nothing but its own text. Long texts are read in blocks of whole passages.

Nulls: a null or wordless text is one passage of zeros, so it gets a score too. A null doc_id is scored. Repeated rows
are scored one by one; all passages of very long texts count, and are learnt from (``rows`` and ``chars`` bound the
sample). An empty table gives no rows. Without labelled rows of both classes every score is
the share of good ones among the labels, or 0.5. Of a column that is called like the result's, the caller's is lost
unless another name is asked for.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docraster.llm.shared import batches_of, column, fold, hand_back, lean, offsets_of, sample_of_labels
from docraster.llm.words import blocks_of, words_of

PASSAGE, CODE, ATTENTION, BAG = 40, 16, 8, 128
SAMPLE_ROWS, SAMPLE_CHARS, THRESHOLD = 1_500, 45_000_000, 0.7

#: Byte classes; the last stands for all bytes that no other names.
CLASSES = [range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), range(0x80, 0x100), b" ", b"\n\r", b".", b",", b"!?", b";:", b"'\"", b"()[]{}<>", b"|", b"/\\", b"#%&*$@~^+=_`", b"-"]
_CLASS = np.full(256, len(CLASSES), np.uint8)
for _i, _own in enumerate(CLASSES):
    _CLASS[list(_own)] = _i
PLAIN = len(CLASSES) + 1 + 7
FEATURES = PLAIN + BAG


def passages(texts: pa.Array, block: int = 4 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and where each text's passages begin (and the end); texts of more than
    ``block`` bytes are read a block at a time."""
    sizes = np.diff(offsets_of(texts))
    if not (sizes > block).any():
        return short_passages(texts)
    parts, counts, at = [], [], 0
    for i in [*np.flatnonzero(sizes > block).tolist(), len(texts)]:
        if i > at:
            x, bounds = short_passages(texts.slice(at, i - at))
            parts.append(x)
            counts += np.diff(bounds).tolist()
        if i < len(texts):
            own = [short_passages(pa.array([b.decode("utf-8", "surrogatepass")], pa.string()))[0] for b in blocks_of(texts[i].as_py().encode("utf-8", "surrogatepass"), PASSAGE, block)]
            parts += own
            counts.append(sum(map(len, own)))
        at = i + 1
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])


def short_passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    w = words_of(texts)
    n = np.diff(w.per_doc)
    count = np.maximum(1, -(-n // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros((bounds[-1], FEATURES), np.float32)
    if not len(w.starts):
        return out, bounds
    # the passage of each word, and of each byte from its first word on
    doc = np.repeat(np.arange(len(n)), n)
    owner = bounds[doc] + (np.arange(len(doc)) - w.per_doc[doc]) // PASSAGE
    head = np.flatnonzero(np.diff(owner, prepend=-1))
    kept = owner[head]
    # a passage's bytes: from its first word, or its text's start, up to the next passage, or its text's end
    of = doc[head]
    begin = np.where(np.diff(of, prepend=-1) != 0, w.docs[of], w.starts[head])
    end = np.where(np.diff(of, append=-1) != 0, w.docs[of + 1] - 1, np.append(begin[1:], 0))
    edge = np.zeros(len(w.data) + 1, np.int32)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    byte_owner = np.repeat(np.arange(len(head)), end - begin)
    inside = _CLASS[w.data[np.cumsum(edge[:-1]) > 0]].astype(np.int64)
    k = len(CLASSES) + 1
    shares = np.bincount(byte_owner * k + inside, minlength=len(head) * k).reshape(-1, k).astype(np.float32)
    total = shares.sum(1, keepdims=True)
    size = np.diff(np.append(head, len(owner))).astype(np.float32)
    length = (w.ends - w.starts).astype(np.float32)
    hashes = w.hashes()
    mean = np.add.reduceat(length, head) / size
    spread = np.sqrt(np.maximum(np.add.reduceat(length * length, head) / size - mean * mean, 0))
    same = np.zeros(len(owner), np.float32)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    pairs = np.unique(np.stack([owner.astype(np.uint64), hashes], 1).view([("o", np.uint64), ("h", np.uint64)]).ravel())
    distinct = np.bincount(pairs["o"].astype(np.int64), minlength=bounds[-1])[kept] / size
    last = w.data[w.ends - 1]
    ended = np.add.reduceat((_CLASS[last] >= 6).astype(np.float32), head) / size
    symbol = np.add.reduceat((_CLASS[last] == 14).astype(np.float32), head) / size
    out[kept, :k] = np.sqrt(shares / total)
    out[kept, k:PLAIN] = np.stack([np.minimum(mean, 40) / 10, np.minimum(spread, 40) / 10, np.add.reduceat(same, head) / size, distinct, ended, symbol, size / PASSAGE], 1)
    place = np.cumsum(np.diff(owner, prepend=-1) != 0) - 1
    bag = np.bincount(place * BAG + (hashes >> np.uint64(20)).astype(np.int64) % BAG, minlength=len(head) * BAG)
    out[kept, PLAIN:] = np.sqrt(bag.reshape(-1, BAG) / size[:, None])
    return out, bounds


@dataclass
class Net:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bounds: np.ndarray):
        """Logit of each text from its passages, and what the gradient needs."""
        return self.attended(np.tanh(x @ self.p["w"] + self.p["b"]), bounds)

    def attended(self, h: np.ndarray, bounds: np.ndarray):
        """The same from encoded passages."""
        p, first = self.p, bounds[:-1]
        n = np.diff(bounds)
        v, u = np.tanh(h @ p["v"]), 0.5 + 0.5 * np.tanh(0.5 * (h @ p["u"]))
        e = (v * u) @ p["a"]
        a = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        a /= np.repeat(np.add.reduceat(a, first), n)
        pooled = np.add.reduceat(a[:, None] * h, first, axis=0)
        return pooled @ p["out"] + p["bias"], (h, v, u, a, pooled, n)

    def gradient(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, decay: float = 1e-3) -> dict[str, np.ndarray]:
        p, first = self.p, bounds[:-1]
        logit, (h, v, u, a, pooled, n) = self.forward(x, bounds)
        d_logit = (1 / (1 + np.exp(-logit)) - y) / len(y)
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = np.repeat(d_logit[:, None] * p["out"], n, axis=0)
        d_a = (d_pooled * h).sum(1)
        d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, first), n))
        g["a"] = (v * u).T @ d_e
        d_v, d_u = d_e[:, None] * p["a"] * u * (1 - v * v), d_e[:, None] * p["a"] * v * u * (1 - u)
        g["v"], g["u"] = h.T @ d_v, h.T @ d_u
        d_h = (a[:, None] * d_pooled + d_v @ p["v"].T + d_u @ p["u"].T) * (1 - h * h)
        g["w"], g["b"] = x.T @ d_h, d_h.sum(0)
        return {k: g[k] + decay * p[k] * (k != "bias") for k in p}

    def score(self, texts: pa.Array) -> np.ndarray:
        """In double precision, rounded to nine digits: the order in which products are summed up changes a score by some
        10^-15, so it does not show."""
        x, bounds = passages(texts)
        if len(bounds) == 1:
            return np.zeros(0)
        p, mean = self.exact.p, self.mean.astype(np.float64)
        h = np.concatenate([np.tanh((x[i : i + 8192] - mean) / self.scale @ p["w"] + p["b"]) for i in range(0, len(x), 8192)])
        logit, _ = self.exact.attended(h, bounds)
        return np.round(1 / (1 + np.exp(-np.clip(logit, -500, 500))), 9)

    @functools.cached_property
    def exact(self) -> Net:
        """The same network in double precision."""
        return Net(self.mean, self.scale, {k: v.astype(np.float64) for k, v in self.p.items()})


def fit(sample: list[tuple[str, int]], share: float, seed: int = 5, batch: int = 256, epochs: int = 40, rate: float = 0.01) -> Net | None:
    """share: of good texts among all labels, to which the bias of a sample with even classes is set back."""
    y = np.array([y for _, y in sample], np.float32)
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    each = [passages(pa.array([t for t, _ in sample[i : i + 100]], pa.string())) for i in range(0, len(sample), 100)]
    x, bounds = np.concatenate([own for own, _ in each]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in each]))])
    del each
    mean, scale = x.mean(0), x.std(0) + np.float32(0.02)
    x -= mean
    x /= scale
    g = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"w": g(FEATURES, CODE), "b": np.zeros(CODE, np.float32), "v": g(CODE, ATTENTION), "u": g(CODE, ATTENTION), "a": g(ATTENTION), "out": g(CODE), "bias": np.zeros(1, np.float32)}
    net = Net(mean, scale, p)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    n = step = 0
    for epoch in range(epochs):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            sizes = bounds[some + 1] - bounds[some]
            own = np.concatenate([[0], np.cumsum(sizes)])
            rows = np.arange(own[-1]) - np.repeat(own[:-1], sizes) + np.repeat(bounds[some], sizes)
            step += 1
            slow = rate * (1 - epoch / epochs)
            for k, d in net.gradient(x[rows], own, y[some]).items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                p[k] -= (slow * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    odds = lambda s: np.log(s / (1 - s))
    p["bias"] += np.float32(odds(min(max(share, 0.01), 0.99)) - odds(float(y.mean())))
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[Net | None, float]:
    """The network, and the share of good texts among the labels that may be learnt from."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~fold(4))
    share = known.agg(F.avg("quality")).first()[0]
    share = 0.5 if share is None else float(share)
    net = fit(sample_of_labels(docs.sparkSession, labels, docs, "quality", rows, chars), share)
    hand_back()
    return net, share


def score(docs: DataFrame, net: Net | None, share: float = 0.5, name: str = "quality_score") -> DataFrame:
    """All columns of docs, and the score under a name of the caller's choice."""
    from pyspark.sql import types as T

    docs = docs.select(*[column(c) for c in docs.columns if c != name])
    if net is None:
        return docs.withColumn(name, F.lit(share))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def task(batches):
        for batch in batches:
            for part in batches_of(batch, size=1 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(part.column("text")))], [*part.schema.names, name])

    return docs.mapInArrow(lean(task, drop=True), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def scored_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns outside the held-out fold (crc32 of doc_id mod 4 is 2) and scores every text."""
    net, share = train(docs, labels)
    scored = score(docs.select("doc_id", "text"), net, share)
    return scored.select("doc_id", fold(4).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
