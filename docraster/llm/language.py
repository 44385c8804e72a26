"""Language ID: unigrams over a fixed public vocabulary, marginalised over all segmentations.

The vocabulary is the byte-level one of a public multilingual tokenizer, every piece of it; each language has one
probability per piece. The score of a word is the sum over all ways to cut it into pieces, by the forward algorithm;
a text's score is the sum of its words' logarithms. Sums of long words are scaled as they go, so none of any length
is lost, and only as many bytes as the longest piece has are held of them. Probabilities are fitted by expectation
and maximisation (forward-backward counts) on a bounded sample of labelled rows. Each task runs the forward algorithm
once per distinct word for all languages together, and adds up the words of each text; long texts are read in blocks.

Besides the posterior, a text gets its ``strangeness``: its log probability per byte in the predicted language over
the bound below which next to none of that language's sample texts lie; above 1 it is unlike what was learnt.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with a null lang are only predicted. A null
doc_id is learnt from. Ties go to the language that sorts first. Repeated rows count, and are predicted one by one. If
no row can be learnt from, or the table is empty, every text is ``und``. Of columns that are called like the result's,
the caller's are lost unless other names are asked for.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docraster.llm.shared import batches_of, column, fold, hand_back, kept, lean, scratch, within
from docraster.llm.words import mix

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bounds of the sample: texts of a language, texts in all, and characters in all.
SAMPLE_ROWS, SAMPLE_ALL, SAMPLE_CHARS = 300, 12_000, 60_000_000
#: No piece is less likely than this in any language; sums over words of up to PLAIN bytes then need no scaling.
LEAST, PLAIN, EVERY = 1e-8, 36, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _marks() -> str:
    """All combining marks, as ranges for a character class."""
    codes = [c for c in range(0x300, 0x20000) if unicodedata.category(chr(c))[0] == "M"] + list(range(0xE0100, 0xE01F0))
    first = [c for c, d in zip(codes, [0, *codes]) if c != d + 1]
    last = [c for c, d in zip(codes, [*codes[1:], sys.maxunicode + 9]) if c != d - 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(first, last))


#: Letters, and the marks that combine with them.
_WORD = re.compile(rf"(?:[^\W\d_]+[{_marks()}]*)+")
_BREAK = re.compile(rf"(?:[\d_]|\W)(?<![{_marks()}])")


def words_of(text: str) -> list[str]:
    """Runs of letters (with their marks) of a text in lower case."""
    return _WORD.findall(text.lower())


def blocks_of(text: str, size: int = 2 << 20) -> Iterator[str]:
    """A lower-case text in blocks that end outside words."""
    text, at = text.lower(), 0
    while at < len(text):
        cut = _BREAK.search(text, at + size) if len(text) - at > size else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Pieces:
    """The vocabulary's pieces by number, and a sorted hash array of their beginnings."""

    def __init__(self, path: str):
        self.pieces = [base64.b64decode(line.split()[0]) for line in open(path, "rb")]
        self.longest = max(map(len, self.pieces))
        known = {p[:i]: -1 for p in self.pieces for i in range(1, len(p) + 1)}
        known |= {p: i for i, p in enumerate(self.pieces)}
        hashes = np.zeros(len(known), np.uint64)
        for i, start in enumerate(known):
            h = 0
            for b in start:
                h = (h * int(_STEP) + b + 1) & 0xFFFFFFFFFFFFFFFF
            hashes[i] = h
        order = np.argsort(hashes := mix(hashes))
        self.keys, self.number = hashes[order], np.array(list(known.values()), np.int32)[order]

    def edges(self, words: np.ndarray, lengths: np.ndarray) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
        """words: (n, width) bytes. For each start in turn the pieces there: (end, rows, numbers), all of one end together."""
        for s in range(words.shape[1]):
            out, rows = [], np.flatnonzero(lengths > s)
            h = np.zeros(len(rows), np.uint64)
            for e in range(s + 1, min(words.shape[1], s + self.longest) + 1):
                h = h * _STEP + words[rows, e - 1].astype(np.uint64) + np.uint64(1)
                wanted = mix(h)
                at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                hit = self.keys[at] == wanted
                rows, h, at = rows[hit], h[hit], at[hit]
                number = self.number[at]
                whole = number >= 0
                if whole.any():
                    out.append((e, rows[whole], number[whole]))
                longer = lengths[rows] > e
                rows, h = rows[longer], h[longer]
                if not len(rows):
                    break
            yield out


def by_length(words: list[str], cells: int):
    """Words, each after the space that the vocabulary's pieces carry, as byte matrices of like width: (positions, matrix,
    lengths in order); a matrix has about ``cells`` bytes at most, and a row at least."""
    coded = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
    lengths = np.array([len(w) for w in coded], np.int64)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        width = int(lengths[order[at]])
        limit = max(width + 2, width * 5 // 4)
        to = min(at + max(1, cells // limit), int(np.searchsorted(lengths[order], limit, "right")))
        own = order[at:to]
        width = int(lengths[own[-1]])
        matrix = np.frombuffer(b"".join(coded[i].ljust(width, b"\0") for i in own), np.uint8).reshape(-1, width)
        yield own, matrix, lengths[own]
        at = to


def _scaled(x: np.ndarray, run: np.ndarray) -> None:
    """Divides x by its highest values over the first axis, whose logarithms go to run."""
    most = x.max(0)
    most[most == 0] = 1
    x /= most
    run += np.log(most)


def log_sums(pieces: Pieces, words: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log of the sum over all segmentations of each word in each language: (n, languages). lengths are in order."""
    (n, width), around = words.shape, pieces.longest + 1
    ahead, run, out = np.zeros((around, n, p.shape[1])), np.zeros((n, p.shape[1])), np.zeros((n, p.shape[1]))
    ahead[0] = 1.0
    for s, edges in enumerate(pieces.edges(words, lengths)):
        here = ahead[s % around]
        for e, rows, number in edges:
            ahead[e % around, rows] += here[rows] * p[number]
        here[:] = 0
        if width > PLAIN and s % EVERY == 0:
            _scaled(ahead, run)
        done = slice(*np.searchsorted(lengths, [s + 1, s + 2]))
        if done.start < done.stop:
            out[done] = np.log(ahead[(s + 1) % around, done]) + run[done]
    return out


def expected(pieces: Pieces, edges: list, lengths: np.ndarray, width: int, p: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> None:
    """Adds each piece's expected number in the words (forward-backward) to counts. edges: of each start."""
    n, around = len(lengths), pieces.longest
    forth, back = np.zeros((2, width + 1, n, p.shape[1]))
    scale_f, scale_b = np.zeros((2, width + 1, n, p.shape[1])) if width > PLAIN else (None, None)
    forth[0], back[lengths, np.arange(n)] = 1.0, 1.0
    run = np.zeros((n, p.shape[1]))
    for s in range(width):
        if scale_f is not None:
            scale_f[min(s + around, width)] = run
        for e, rows, number in edges[s]:
            forth[e, rows] += forth[s, rows] * p[number]
        if scale_f is not None and s % EVERY == 0:
            _scaled(forth[s + 1 : s + around + 1], run)
            scale_f[s + 1 : s + around + 1] = run
    total = forth[lengths, np.arange(n)]
    log_total = np.log(total) + (scale_f[lengths, np.arange(n)] if scale_f is not None else 0)
    run = np.zeros((n, p.shape[1]))
    for s in range(width - 1, -1, -1):
        if scale_b is not None:
            scale_b[s] = run
        for e, rows, number in edges[s]:
            share = p[number]
            back[s, rows] += share * back[e, rows]
            if scale_b is None:
                got = forth[s, rows] * back[e, rows] * share / total[rows]
            else:
                got = forth[s, rows] * back[e, rows] * share * np.exp(scale_f[s, rows] + scale_b[e, rows] - log_total[rows])
            for j in range(p.shape[1]):
                counts[:, j] += np.bincount(number, got[:, j] * weight[rows, j], len(counts))
        if scale_b is not None and s % EVERY == 0:
            _scaled(back[s : s + around + 1], run)
            scale_b[s : s + around + 1] = run


@dataclass
class Model:
    path: str
    languages: list[str]
    p: np.ndarray  # (pieces, languages)
    mean: np.ndarray  # of the sample texts' log probability per byte, by language
    low: np.ndarray  # a bound that next to none of them lies below


def likelihoods(counts: np.ndarray) -> np.ndarray:
    p = np.maximum(counts / counts.sum(0), LEAST)
    return p / p.sum(0)


def fit(rows: list[tuple[str, str]], path: str, rounds: int = 4, floor: float = 0.1) -> Model | None:
    """EM over the distinct words of (lang, text) rows; ``floor`` is added to every expected count."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    pieces, place = Pieces(path), {lang: j for j, lang in enumerate(languages)}
    counts: dict[str, np.ndarray] = {}
    for lang, text in rows:
        for w in words_of(text or ""):
            if w not in counts:
                counts[w] = np.zeros(len(languages))
            counts[w][place[lang]] += 1
    weight = np.array(list(counts.values())).reshape(-1, len(languages))
    cells = [(own, list(pieces.edges(matrix, lengths)), lengths, matrix.shape[1]) for own, matrix, lengths in by_length(list(counts), 2_000_000 // len(languages))]
    # all pieces start out alike likely, so that no language is preferred
    p = np.full((len(pieces.pieces), len(languages)), 1.0 / len(pieces.pieces))
    for _ in range(rounds):
        found = np.full(p.shape, floor)
        for own, edges, lengths, width in cells:
            expected(pieces, edges, lengths, width, p, weight[own], found)
        p = likelihoods(found)
    model = Model(path, languages, p, np.zeros(len(languages)), np.full(len(languages), -np.inf))
    total, size = Scorer(model).totals([text for _, text in rows])
    for j, lang in enumerate(languages):
        own = np.array([lang == other for other, _ in rows]) & (size > 0)
        if own.any():
            model.mean[j] = total[own, j].sum() / size[own].sum()
            each = drawn_in(total[own, j], size[own], model.mean[j])
            model.low[j] = model.mean[j] - 8 * max(each.std(), 0.02 * abs(model.mean[j]))
    return model


def drawn_in(total: np.ndarray, size: np.ndarray, mean, bytes_of_prior: int = 64) -> np.ndarray:
    """Log probability per byte, short texts' drawn in to the mean."""
    return (total + mean * bytes_of_prior) / (size + bytes_of_prior)


def train(docs: DataFrame, path: str, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, in_all: int = SAMPLE_ALL) -> Model | None:
    """Fits on about ``rows`` labelled texts of each language, whole ones; on twice ``in_all`` texts and ``chars``
    characters at most (see ``shared.within``)."""
    known = docs.where(~fold(4) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    rows = min(rows, max(1, in_all // max(1, len(sizes))))
    by = F.xxhash64("doc_id", F.lit(5), F.when(F.col("doc_id").isNull(), F.col("text")))  # rows without an id draw by their text
    u = F.pmod(by, F.lit(1 << 30)) / float(1 << 30)
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / n))).otherwise(rate)
    picked = known.where(u < rate).select("lang", "text", u.alias("u"))
    with scratch(docs.sparkSession):
        drawn = kept(picked, "sample")  # about rows a language; the limit holds where one id repeats without end
        drawn = within(drawn.orderBy("u", "lang", "text").limit(2 * in_all), chars).collect()
    model = fit(sorted((r["lang"], r["text"]) for r in drawn), path)
    hand_back()
    return model


class Scorer:
    """Scores words and texts, and remembers the words of a worker's batches, up to ``most`` of them."""

    def __init__(self, model: Model, most: int = 200_000):
        self.m, self.pieces, self.most = model, Pieces(model.path), most
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, len(self.m.languages)))

    def words(self, words: list[str]) -> np.ndarray:
        """Log of each word's probability in each language."""
        if len(self.place) > self.most:
            self.forget()
        new = [w for w in words if w not in self.place]
        if new:
            found = np.zeros((len(new), len(self.m.languages)))
            for own, matrix, lengths in by_length(new, 800_000 // len(self.m.languages)):
                found[own] = log_sums(self.pieces, matrix, lengths, self.m.p)
            self.place |= zip(new, range(len(self.known), len(self.known) + len(new)))
            self.known = np.concatenate([self.known, found])
        return self.known[[self.place[w] for w in words]]

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text in each language, and the bytes of its words (with a space each)."""
        total, size = np.zeros((len(texts), len(self.m.languages))), np.zeros(len(texts), np.int64)
        some, each = [], []
        for i, text in enumerate(texts):
            for block in blocks_of(text) if text else ():
                if found := _WORD.findall(block):
                    some.append(i)
                    each.append(found)
                if len(text) > 2 << 20:  # a block at a time
                    self._add(total, size, some, each)
                    some, each = [], []
        self._add(total, size, some, each)
        return total, size

    def _add(self, total: np.ndarray, size: np.ndarray, some: list[int], each: list[list[str]]) -> None:
        if not some:
            return
        code, words = pd.factorize(np.array([w for own in each for w in own], object))
        n = np.array([len(w) for w in each], np.int64)
        by_word, starts = self.words(words.tolist()), np.cumsum(n) - n
        in_bytes = np.array([len(w.encode("utf-8", "surrogatepass")) + 1 for w in words], np.int64)
        np.add.at(size, some, np.add.reduceat(in_bytes[code], starts))
        for j in range(total.shape[1]):
            np.add.at(total[:, j], some, np.add.reduceat(by_word[code, j], starts))

    def texts(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its posterior among the learnt ones, and strangeness of each text."""
        total, size = self.totals(texts)
        letters = np.array([has_letter(t) for t in texts], bool)
        best = total.argmax(1)
        score = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        own = drawn_in(total[np.arange(len(best)), best], size, self.m.mean[best])
        strange = np.divide(own, self.m.low[best], out=np.zeros(len(best)), where=self.m.low[best] < 0)
        return [self.m.languages[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, score, 0.0), strange


def predict(docs: DataFrame, model: Model | None, names: tuple[str, str, str] = ("lang_pred", "score", "strangeness")) -> DataFrame:
    """All columns of docs with the language, its posterior and the strangeness of each text, under these names."""
    from pyspark.sql import types as T

    docs = docs.select(*[column(c) for c in docs.columns if c not in names])
    if model is None:
        return docs.withColumns(dict(zip(names, (F.lit("und"), F.lit(0.0), F.lit(0.0)))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        scorer = None
        for batch in batches:
            scorer = scorer or Scorer(shared.value)
            for part in batches_of(batch, size=2 << 20):
                lang, score, strange = scorer.texts(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(strange, pa.float64())], [*part.schema.names, *names])

    types = (T.StringType(), T.DoubleType(), T.DoubleType())
    return docs.mapInArrow(lean(task, drop=True), T.StructType([*docs.schema.fields, *map(T.StructField, names, types)]))


def predicted_documents(docs: DataFrame, path: str) -> DataFrame:
    """Learns outside the held-out fold (crc32 of doc_id mod 4 is 2) and predicts every text."""
    model = train(docs, path)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", fold(4).alias("held_out"), "lang_pred", "score")
