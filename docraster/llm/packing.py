"""Best-fit packing of documents into sequences of a fixed number of tokens.

Documents are tokenized in Arrow batches; longer ones are cut into full pieces, of which the first may be shorter.
Best-fit decreasing sees nothing of a piece but its length, and pieces of one length are interchangeable: the
driver gets only the histogram of lengths (as many rows as the sequence has tokens, whatever the input) and packs
runs of like pieces. A segment tree over remaining capacities finds the tightest open bin in logarithmic time. The
result is the plan of best-fit decreasing over *all* pieces, as ranges of each length's ranks; tasks then look up
each piece's range. A piece's rank is its rank within its partition plus the counts of the partitions before it.

Nulls: a null text is empty (one token: the closing id); a null doc_id is kept. Repeated rows are packed one by one,
ties between pieces of one length go by partition and place in it. An empty table gives an empty result.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docraster.llm.shared import batches_of, kept, lean
from docraster.llm.words import SPACE, mix, powers, words_of

LENGTH, CLOSING = 2048, 0
#: Bytes of a text from which on it is tokenized in blocks, and of a block.
LONG, BLOCK = 4 << 20, 1 << 20


# --- tokens ---------------------------------------------------------------------------------------------------


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) | np.uint64(1)


def chunk_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each chunk's bytes; chunks come in order and leave out single bytes at most."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.zeros(len(data), np.int32)
    at[starts] = starts
    at = np.arange(len(data), dtype=np.int32) - np.maximum.accumulate(at)
    terms = _BYTE[data]
    terms *= powers(int(at.max()) + 1)[at]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    terms[np.cumsum(edge, dtype=np.int8)[:-1] == 0] = 0  # bytes between chunks do not count
    return mix(np.add.reduceat(terms, starts) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_TOKENS: dict[str, "Tokens"] = {}


def tokens_for(path: str) -> "Tokens":
    """A worker's own tokenizer with its store of chunks, kept from task to task."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


class Tokens:
    """Token ids of whole batches, by way of their distinct chunks.

    The vocabulary's pre-tokenizer never joins characters across the end of a run of non-space, so a text's ids
    are those of its chunks (white space and the run after it) in turn. Each distinct chunk of a batch is
    tokenized once, many of them joined to one text; the tokens' lengths in bytes tell them apart again. Texts with
    white space beyond ASCII are tokenized whole.
    """

    TOGETHER = 100

    #: White space beyond ASCII (and separators that some engines take as white space).
    ODD = r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

    def __init__(self, path: str):
        import re

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        named = self.tokenizer.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.bytes = np.zeros(max(named.values()) + 1, np.int64)
        for token, i in named.items():  # a character of the vocabulary's alphabet is a byte
            self.bytes[i] = len(token.encode()) if token in added else len(token)
        self.odd = re.compile(self.ODD)
        self.most = 1_000_000
        self.forget()

    def forget(self) -> None:
        """Empties the store of chunks, which is kept from batch to batch up to ``most`` of them."""
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The chunks' ids one after the other, and how many each has."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        body, ends = b"".join(chunks), np.cumsum(size)
        starts, raw = ends - size, np.frombuffer(body, np.uint8)
        space = (raw == 32) | (raw >= 9) & (raw <= 13)
        # a chunk joins the one before if it starts with white space and that one does not end with any
        alone = ~space[starts] | (np.arange(len(chunks)) % self.TOGETHER == 0)
        alone[1:] |= space[starts[1:] - 1]
        for cut in (np.append(starts[alone], len(body)), np.append(starts, len(body))):
            texts = [body[s:e].decode("utf-8") for s, e in zip(cut[:-1].tolist(), cut[1:].tolist())]
            coded = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.concatenate(coded)
            to = np.cumsum(self.bytes[ids])
            last = np.searchsorted(to, ends)
            if len(to) and to[-1] == len(body) and (to[last] == ends).all():
                return ids, np.diff(last, prepend=-1)
        return ids, np.fromiter(map(len, coded), np.int64, len(coded))  # lengths that say nothing: each by itself

    def look_up(self, keys: np.ndarray, chunk) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of each distinct chunk's ids in self.flat; new ones are tokenized. chunk: gives the i-th chunk's bytes."""
        if len(self.keys) > self.most:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            ids, size = self.encode([chunk(i) for i in new.tolist()])
            first = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, ids])
            self.keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(self.keys, kind="stable")
            self.keys = self.keys[order]
            self.first, self.size = np.concatenate([self.first, first])[order], np.concatenate([self.size, size])[order]
            at = np.searchsorted(self.keys, keys)
        return self.first[at], self.size[at]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the closing one after each text, and where each text's ids start (and the end)."""
        whole = {}
        rows = texts.to_pylist()
        for i, text in enumerate(rows):
            if text and self.odd.search(text):
                whole[i] = self.whole(text)
                rows[i] = ""
        if whole:
            texts = pa.array(rows, pa.string())
        w = words_of(texts)
        n = len(rows)
        # a chunk starts where the run before it ends, a text's first one at its start
        own = np.diff(w.per_doc) > 0
        starts = np.empty(len(w.starts), np.int64)
        starts[1:] = w.ends[:-1]
        starts[w.per_doc[:-1][own]] = w.docs[:-1][own]
        # what is left after a text's last run (without the line feed that ends it here)
        tail_from = w.docs[:-1].copy()
        tail_from[own] = w.ends[w.per_doc[1:][own] - 1]
        tails = np.flatnonzero(w.docs[1:] - 1 > tail_from)
        at = np.concatenate([starts, tail_from[tails]])
        to = np.concatenate([w.ends, w.docs[1:][tails] - 1])
        order = np.argsort(at, kind="stable")
        at, to = at[order], to[order]
        doc = np.searchsorted(w.docs, at, "right") - 1
        keys, some, code = np.unique(chunk_hashes(w.data, at, to), return_index=True, return_inverse=True)
        body, begin, end = w.data.tobytes(), at[some].tolist(), to[some].tolist()
        first, size = self.look_up(keys, lambda i: body[begin[i] : end[i]])
        flat = self.flat
        length = size[code]
        per_doc = np.bincount(doc, length, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
        for i, ids in whole.items():
            per_doc[i] = len(ids)
        bounds = np.concatenate([[0], np.cumsum(per_doc + 1)])
        out = np.full(bounds[-1], CLOSING, np.uint32)
        # chunk k goes to its text's start plus the lengths of the text's chunks before it
        before = np.cumsum(length) - length
        first_chunk = np.searchsorted(doc, np.arange(n))
        of_doc = np.append(before, length.sum() if len(length) else 0)[first_chunk]
        target = bounds[doc] + before - of_doc[doc]
        step = np.arange(length.sum()) - np.repeat(before, length)
        out[np.repeat(target, length) + step] = flat[np.repeat(first[code], length) + step]
        for i, ids in whole.items():
            out[bounds[i] : bounds[i] + len(ids)] = ids
        return out, bounds


    def long_ids(self, text: bytes, block: int) -> np.ndarray:
        """The ids of one long text and the closing one. Blocks end between a printing ASCII character and ASCII white space,
        which no chunk spans; where there is no such place a block is as long as it takes."""
        out, at, step = [], 0, block
        while at < len(text):
            raw = np.frombuffer(text, np.uint8, min(step, len(text) - at), at)
            inner = np.flatnonzero((raw[:-1] > 32) & (raw[:-1] < 127) & SPACE[raw[1:]]) if step < len(text) - at else [len(raw) - 1]
            if not len(inner):
                step *= 2
                continue
            to = at + int(inner[-1]) + 1
            out.append(self.ids(pa.array([text[at:to].decode("utf-8")], pa.string()))[0][:-1])
            at, step = to, block
        return np.concatenate([*out, [np.uint32(CLOSING)]]).astype(np.uint32)


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Pieces of each document, with their task's number and their rank among its pieces of the same length."""
    import zlib

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]

    def task(batches):
        tokens, seen, part_no = tokens_for(path), np.zeros(length + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part in batches_of(batch, size=2 << 20):
                text = part.column("text")
                if len(text) == 1 and text[0].is_valid and text[0].as_buffer().size > LONG:
                    ids = tokens.long_ids(text[0].as_py().encode(), BLOCK)
                    bounds = np.array([0, len(ids)])
                else:
                    ids, bounds = tokens.ids(text)
                total = np.diff(bounds)
                n = -(-total // length)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                short = total - (n - 1) * length  # of the first piece
                start = np.where(piece > 0, short[doc] + (piece - 1) * length, 0)
                size = np.where(piece > 0, length, short[doc])
                raw, begin = ids.astype("<u4"), bounds[doc] + start
                crc = [zlib.crc32(raw[s:e]) for s, e in zip(begin.tolist(), (begin + size).tolist())]
                order = np.argsort(size, kind="stable")
                count = np.bincount(size, minlength=length + 1)
                rank = np.empty(len(size), np.int64)
                rank[order] = np.arange(len(size)) - np.repeat(np.cumsum(count) - count, count)
                rank += seen[size]
                seen += count
                ids_of = part.column("doc_id").cast(pa.int64()).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids_of, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(np.full(len(size), part_no, np.int32)), pa.array(rank)], names)

    return docs.select("doc_id", "text").mapInArrow(lean(task), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long")


# --- best-fit decreasing over the histogram -------------------------------------------------------------------


class Tightest:
    """A segment tree over remaining capacities 0..n that knows which of them some open bin has."""

    def __init__(self, n: int):
        self.leaves = 1 << (n + 1 - 1).bit_length()
        self.open = [False] * (2 * self.leaves)

    def set(self, capacity: int, is_open: bool) -> None:
        i = capacity + self.leaves
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] or self.open[2 * i + 1]

    def at_least(self, capacity: int) -> int | None:
        """The smallest open capacity that is not below this one."""
        i = capacity + self.leaves
        if i >= 2 * self.leaves:
            return None
        if self.open[i]:
            return capacity
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return None


@dataclass
class Run:
    """Pieces ``rank .. rank + n - 1`` of one length: ``each`` to a sequence, from sequence ``first`` and place ``offset`` on."""

    length: int
    rank: int
    n: int
    first: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = LENGTH) -> list[Run]:
    """Best-fit decreasing. Bins with the same remaining capacity are kept as ranges of sequences; like pieces fill
    the tightest bin until it is full, then the next, so a whole range takes equally many of them."""
    tree, bins, out, sequences = Tightest(capacity), {}, [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            bins.setdefault(left, []).append((first, n))
            tree.set(left, True)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.at_least(length)
            if left is None:
                left, n = capacity, -(-todo // (capacity // length))
                first, sequences = sequences, sequences + n
            else:
                first, n = bins[left].pop(0)
                if not bins[left]:
                    del bins[left]
                    tree.set(left, False)
            each = left // length
            used, rest = divmod(todo, each) if todo < n * each else (n, 0)
            taken = min(todo, n * each)
            out.append(Run(length, rank, taken, first, each, capacity - left))
            put(left - each * length, first, used)
            if rest:
                put(left - rest * length, first + used, 1)
                used += 1
            put(left, first + used, n - used)
            rank, todo = rank + taken, todo - taken
    return out


def assigned(cut: DataFrame, runs: list[Run]) -> DataFrame:
    """sequence_id and offset of each piece (columns length, rank over all partitions)."""
    table = np.array([(r.length, r.rank, r.n, r.first, r.each, r.offset) for r in sorted(runs, key=lambda r: (r.length, r.rank))], np.int64).reshape(-1, 6)
    shared = cut.sparkSession.sparkContext.broadcast(table)

    def task(batches):
        t = shared.value
        keys = t[:, 0] << 48 | t[:, 1]
        for batch in batches:
            size, rank = (np.asarray(batch.column(c), np.int64) for c in ("length", "rank"))
            run = t[np.searchsorted(keys, size << 48 | rank, "right") - 1]
            place = rank - run[:, 1]
            own = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(run[:, 3] + place // run[:, 4]), pa.array(run[:, 5] + place % run[:, 4] * size)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return cut.mapInArrow(task, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    cut = kept(pieces(docs, path, length), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = kept(counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    ranked = cut.hint("merge").join(counts.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    return assigned(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), plan(histogram, length))
