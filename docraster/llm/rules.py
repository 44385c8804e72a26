"""Quality rules: counted rules that fail a text, and a calibrated classifier over hashed n-grams for the others.

The rules count words, symbols, repeated lines and the words of repeated three-word windows; lines and windows are told
apart by their very bytes and word numbers, never by a hash. The classifier is a logistic regression over hashed
n-grams of four kinds (words, pairs of words, three and four bytes); a text is the mean of its grams' weights of each
kind. It is fitted on a bounded sample of rows with a quality label (``ROWS`` of a class; their features are counted
by tasks over the whole texts), and its probability is calibrated by a logistic curve on other labelled rows. Weights
are whole numbers (of 2^-16), so a score is a function of its text alone, in whatever batch or order that comes.

Rows with crc32(doc_id as text) mod 4 = 2 are held out, those with 1 calibrate, the others are learnt from. A text is
kept if no rule fails it and its probability of being good is at least ``KEEP``.

Nulls: a null or empty text has no words, so the rules fail it; a null doc_id is judged, and never learnt from. Of texts
that share an id the first in order is learnt from; repeated rows are judged one by one. Very long texts are counted
whole: their words are numbered and hashed in blocks, and a block's edge splits no window. Without labelled rows of both
classes, or an empty documents table, there is no classifier and the rules decide alone (probability null). Other
columns are ignored as inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docraster.llm.shared import batches_of, column, fold, labelled_sample, lean
from docraster.llm.words import SPACE, Words, blocks_of, mix, words_of

ROWS, KEEP, BUCKETS, KINDS, UNIT = 1_000, 0.5, 1 << 18, 4, 1 << 16
LEAST_WORDS, MOST_REPEATED = 50, 50  # words, and per cent of them
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_SEEDS = np.arange(1, KINDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def numbered_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of byte strings, equal for equal ones: their bytes side by side, through Arrow's dictionary."""
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    body = data if inside.all() else data[inside]
    strings = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
    return np.asarray(pc.dictionary_encode(strings).indices, np.int64)


def numbered(keys: np.ndarray) -> np.ndarray:
    return np.asarray(pc.dictionary_encode(pa.array(keys)).indices, np.int64)


def repeated_words(w: Words, doc: np.ndarray) -> np.ndarray:
    """True for words in a three-word window that its text has twice or more."""
    hit = np.zeros(len(w.starts), bool)
    if len(hit) < 4:
        return hit
    word = numbered_slices(w.data, w.starts, w.ends)
    many = int(word.max()) + 1
    whole = np.flatnonzero(doc[2:] == doc[:-2])
    if not len(whole):
        return hit
    first = doc[whole] * many + word[whole]  # texts, words: numbers below 2^63 in any batch that fits in memory
    pair = numbered(numbered(first) * many + word[whole + 1]) if len(w.per_doc) > 2 else numbered(first * many + word[whole + 1])
    window = numbered(pair * many + word[whole + 2])
    again = whole[np.bincount(window)[window] > 1]
    for k in range(3):
        hit[again + k] = True
    return hit


def counted(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = words_of(texts)
    n = np.diff(w.per_doc)
    out = {k: np.zeros(len(n), np.int64) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    if not len(w.data):
        return {"n_words": n.astype(np.int64), **out}
    doc = np.repeat(np.arange(len(n)), n)
    of = lambda at: np.diff(np.searchsorted(at, w.docs))
    out["word_chars"] = of(np.flatnonzero(((w.data & 0xC0) != 0x80) & ~SPACE[w.data]))
    out["n_symbols"] = of(np.flatnonzero(SYMBOLS[w.data]))
    stops = np.flatnonzero(w.data == 0x0A)
    begins = np.concatenate([[0], stops[:-1] + 1])
    at = np.searchsorted(w.starts, begins)
    worded = at < np.searchsorted(w.starts, stops)
    if worded.any():
        begins, stops = begins[worded], stops[worded]
        line = numbered_slices(w.data, begins, stops)
        owner = np.searchsorted(w.docs, begins, "right") - 1
        key = numbered(owner * (int(line.max()) + 1) + line)
        first = np.zeros(int(key.max()) + 1, np.int64)
        first[key[::-1]] = np.arange(len(key))[::-1]
        out["n_dup_lines"] = np.bincount(owner[first[key] != np.arange(len(key))], minlength=len(n))
    out["n_repeat_words"] = np.bincount(doc[repeated_words(w, doc)], minlength=len(n))
    return {"n_words": n.astype(np.int64), **out}


def rule_failed(n_words, n_repeat_words):
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED * n_words)


def grams(texts: pa.Array, block: int = 4 << 20):
    """For each kind: its number, the bucket of each gram, and where each text's grams begin (and the end)."""
    if len(texts) == 1 and len(raw := (texts[0].as_py() or "").encode("utf-8", "surrogatepass")) > block:
        hashes = np.concatenate([words_of(pa.array([b.decode("utf-8", "surrogatepass")], pa.string())).hashes() for b in blocks_of(raw, 1, block)])
        data, docs, per_doc = np.frombuffer(raw + b"\n", np.uint8), np.array([0, len(raw) + 1]), np.array([0, len(hashes)])
    else:
        w = words_of(texts)
        hashes, data, docs, per_doc = w.hashes(), w.data, w.docs, w.per_doc
    place = lambda x, kind: (mix(x + _SEEDS[kind]) % np.uint64(BUCKETS)).astype(np.int32)
    yield 0, place(hashes, 0), per_doc
    yield 1, *within(place(hashes[:-1] * np.uint64(3) + mix(hashes[1:]), 1) if len(hashes) else np.zeros(0, np.int32), per_doc, 2)
    for kind, size in ((2, 3), (3, 4)):
        parts, at = [], 0
        while at < len(data) - size + 1:
            to = min(at + block, len(data) - size + 1)
            x = np.zeros(to - at, np.uint64)
            for k in range(size):
                x = x << np.uint64(8) | data[at + k : to + k]
            parts.append(place(x, kind))
            at = to
        yield kind, *within(np.concatenate(parts) if parts else np.zeros(0, np.int32), docs, size)


def within(found: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of so many items that lie within one text, and where each text's begin."""
    n = np.maximum(np.diff(bounds) - (size - 1), 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    keep = np.ones(len(found), bool)
    for k in range(1, size):  # windows that begin in the last items of a text reach into the next one
        late = bounds[1:] - k
        late = late[(late >= bounds[:-1]) & (late < len(found)) & (late >= 0)]
        keep[late] = False
    return found[keep], ends


@dataclass
class Rules:
    """Weights of each kind and bucket in whole units, bias, and the calibration."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for kind, found, bounds in grams(texts):
            total = np.concatenate([[0], np.cumsum(self.weights[kind][found], dtype=np.int64)])
            n = np.diff(bounds)
            out += np.diff(total[bounds]) / (np.maximum(n, 1) * float(UNIT))
        return out

    def probability(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -500, 500)))


def features(docs: DataFrame) -> DataFrame:
    """y, doc_id, and the buckets of all kinds with the share of the kind's grams in each, from the whole text."""

    def task(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                place, share = [], []
                for kind, found, _ in grams(row.column("text").cast(pa.string())):
                    own, n = np.unique(found, return_counts=True)
                    place.append(own.astype(np.int32) + kind * BUCKETS)
                    share.append(n / max(1, n.sum()))
                yield pa.RecordBatch.from_arrays([row.column("doc_id"), row.column("y"), pa.array([np.concatenate(place)], pa.list_(pa.int32())), pa.array([np.concatenate(share)], pa.list_(pa.float64()))], ["doc_id", "y", "place", "share"])

    return docs.select("doc_id", "y", "text").mapInArrow(task, "doc_id long, y int, place array<int>, share array<double>")


def fit(place: np.ndarray, share: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.5, decay: float = 1e-6, seed: int = 3) -> tuple[np.ndarray, float]:
    """Logistic regression by steps that shrink with each weight's own gradients."""
    rng = np.random.default_rng(seed)
    w, seen, bias, n = np.zeros(KINDS * BUCKETS), np.full(KINDS * BUCKETS, 1e-8), 0.0, np.diff(bounds)
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            own = np.concatenate([[0], np.cumsum(n[rows])])
            at = np.arange(own[-1]) - np.repeat(own[:-1], n[rows]) + np.repeat(bounds[rows], n[rows])
            p, s = place[at], share[at]
            sums = np.concatenate([[0.0], np.cumsum(w[p] * s)])
            d = (1 / (1 + np.exp(-np.clip(np.diff(sums[own]) + bias, -500, 500))) - y[rows]) / len(rows)
            used, inverse = np.unique(p, return_inverse=True)
            g = np.bincount(inverse, s * np.repeat(d, n[rows])) + decay * w[used]
            seen[used] += g * g
            w[used] -= rate * g / np.sqrt(seen[used])
            bias -= 0.1 * d.sum()
    return w, bias


def calibrated(logit: np.ndarray, y: np.ndarray, offset: float, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of a logistic curve through these rows by Newton's method, with smoothed targets; ``offset`` is
    what their even classes hide of the true odds."""
    if len(set(y.tolist())) < 2:
        return 1.0, offset
    good, bad = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x, ab = np.stack([logit, np.ones(len(y))], 1), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        ab = ab - np.linalg.solve(h, x.T @ (p - t))
    return (float(ab[0]), float(ab[1]) + offset) if np.isfinite(ab).all() and ab[0] > 0 else (1.0, offset)


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> Rules | None:
    """Fitted on at most 3 * rows labelled documents, a part of which calibrates; None without both classes."""
    sample, share = labelled_sample(labels, docs, "quality", rows)
    if sample is None:
        return None
    got = features(sample).toArrow().sort_by("doc_id")
    y, ids = np.asarray(got.column("y"), np.int64), got.column("doc_id").to_pylist()
    if len(set(y.tolist())) < 2:
        return None
    import zlib

    apart = np.array([zlib.crc32(str(i).encode()) % 4 == 1 for i in ids])
    if len(set(y[~apart].tolist())) < 2:
        apart[:] = False
    flat = lambda c, some: np.concatenate([np.asarray(v.values) for v, s in zip(got.column(c), some) if s])
    n = np.array([len(v) for v in got.column("place")])
    bounds = lambda some: np.concatenate([[0], np.cumsum(n[some])])
    w, bias = fit(flat("place", ~apart), flat("share", ~apart), bounds(~apart), y[~apart])
    units = np.clip(np.rint(w * UNIT), -(1 << 30), 1 << 30).astype(np.int32)
    rules = Rules(units.reshape(KINDS, BUCKETS), float(bias))
    other = apart if apart.any() else ~apart
    logit = np.diff(np.concatenate([[0.0], np.cumsum(units[flat("place", other)] / UNIT * flat("share", other))])[bounds(other)]) + bias
    odds = lambda s: np.log(s / (1 - s))
    rules.slope, rules.shift = calibrated(logit, y[other], float(odds(min(max(share, 0.01), 0.99)) - odds(min(max(y[other].mean(), 0.01), 0.99))))
    return rules


VERDICT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"


def judged(docs: DataFrame, rules: Rules | None, name: str = "rules") -> DataFrame:
    """All columns of docs, and a struct under a name of the caller's choice: the five counts, probability, base_failed and kept."""
    docs = docs.select(*[column(c) for c in docs.columns if c != name])
    shared = docs.sparkSession.sparkContext.broadcast(rules)
    inner = T._parse_datatype_string(VERDICT)

    def task(batches):
        for batch in batches:
            for part in batches_of(batch, size=1 << 20):
                texts = part.column("text")
                found = [pa.array(v, pa.int64()) for v in counted(texts).values()]
                found.append(pa.nulls(len(texts), pa.float64()) if shared.value is None else pa.array(shared.value.probability(texts)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(found, [f.name for f in inner.fields])], [*part.schema.names, name])

    out = docs.mapInArrow(lean(task), T.StructType([*docs.schema.fields, T.StructField(name, inner)]))
    own: Column = column(name)
    failed = rule_failed(own["n_words"], own["n_repeat_words"])
    own = own.withField("base_failed", failed).withField("kept", ~failed & F.coalesce(own["probability"] >= KEEP, F.lit(True)))
    return out.select(*[column(c) for c in docs.columns], own.alias(name))


def judged_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, the counts, base_failed, probability and kept of every document."""
    found = judged(docs.select("doc_id", "text"), train(docs, labels))
    return found.select("doc_id", fold(4).alias("held_out"), "rules.*")
