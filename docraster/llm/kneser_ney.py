"""LM scoring: an interpolated modified Kneser-Ney trigram model.

Every text is its words and one end, after two beginnings. Spark counts the words first, which gives sorted arrays of
hashes and a number for each word, smaller for more frequent ones. Then it counts the trigrams: each task sums those of
some millions of tokens and deals them by their middle word, as columns of these numbers. So a group has all of a
context (u, v) and all that comes before a pair (v, w): it writes sorted hash arrays of its trigrams with their counts,
of its contexts with their totals and of its pairs with the number of words before them. What a group knows of single
words is dealt once more and gives sorted arrays of words. Scoring tasks map these files into memory and look their
batches' distinct words, pairs and trigrams up by binary search.

A context that was seen once has no entry of its own: it is among the pairs, and not among the contexts.

Middle words that hold much of the corpus are dealt by (u, v) instead, and pairs (u, v) that do by the whole trigram, so
no group holds more than its share; what is then known of a pair or context in several groups is summed in a second,
small deal. They are found on a sample of texts, and only the balance depends on that.

Buckets grow with the corpus, rows of the shuffles with nothing else: a block of text or a bucket deals to at most ``FAN``
ranges of buckets, and where there are more buckets, tasks sum what has come to a range, some millions of entries at a
time, and deal it on to finer ranges.

An array keeps of each 64-bit hash the place in a directory and 32 bits more; stored keys that would be taken for each
other stand apart with their whole hash, and an unseen n-gram is taken for a seen one in about one of 10^8 cases.

Nulls: a null text is empty (one token, its end); a null doc_id counts as learnt from. Repeated rows count and are
scored one by one. Long texts are counted and scored in blocks. An empty training table leaves the uniform model over
the one unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docraster.llm.shared import batches_of, fold, kept, lean, mapped, shared_folder, write_file
from docraster.llm.words import blocks_of, mix, words_of

END, BEGIN = np.uint64(0x5EED0000000E0D), np.uint64(0x5EED00000B0E61)
_K = np.uint64(0xA24BAED4963EE407)
#: Bytes of text that a bucket of the model stands for, and tokens that a task counts at once.
BUCKET_BYTES, AT_ONCE = 24 << 20, 2_000_000
#: Ranges of buckets that one block is dealt to; bytes of text whose counts one task deals on; buckets whose first numbers are in a file.
FAN, ON_BYTES, SPAN = 1024, 4 << 30, 4096
#: Numbers of the beginning, and of a word that was never seen.
FIRST, UNSEEN = np.uint64(0), np.uint64(1 << 40)
_ID = np.uint64(21)  # bits of a word's number in a packed trigram
_MASK = np.uint64((1 << 21) - 1)


# --- tokens ---------------------------------------------------------------------------------------------------


def tokens_of(texts: pa.Array, last: tuple = (BEGIN, BEGIN), ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, of each text after two that stand before it: beginnings, or those given; and where each text's
    two start (and the end). A text's tokens are its words, then its end unless it goes on."""
    w = words_of(texts)
    n = len(texts)
    first = w.per_doc + np.arange(n + 1) * (2 + ends)
    tokens = np.empty(first[-1], np.uint64)
    word = np.ones(len(tokens), bool)
    tokens[first[:-1]], tokens[first[:-1] + 1] = last
    word[first[:-1]] = word[first[:-1] + 1] = False
    if ends:
        tokens[first[1:] - 1] = END
        word[first[1:] - 1] = False
    tokens[word] = w.hashes()
    return tokens, first


def in_pieces(part: pa.RecordBatch, block: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """tokens and starts of a batch's texts; of a single long text a block at a time."""
    texts = part.column("text")
    if part.num_rows != 1 or not texts[0].is_valid or texts.get_total_buffer_size() <= block:
        yield tokens_of(texts)
        return
    last, held = (BEGIN, BEGIN), None
    for raw in [*blocks_of(texts[0].as_py().encode("utf-8", "surrogatepass"), size=block), None]:
        if held is not None:
            tokens, first = tokens_of(pa.array([held.decode("utf-8", "surrogatepass")], pa.string()), last, raw is None)
            last = tuple(tokens[-2:])
            yield tokens, first
        held = raw


def coded(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct tokens, in order, and the place of each token's among them."""
    code, words = pd.factorize(tokens)
    order = np.argsort(words)
    place = np.empty(len(words), np.uint64)
    place[order] = np.arange(len(words), dtype=np.uint64)
    return words[order], place[code]


def numbered(words: np.ndarray, code: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' numbers in order, the order, and the places of the tokens' numbers among them."""
    order = np.argsort(numbers, kind="stable")
    place = np.empty(len(words), np.uint64)
    place[order] = np.arange(len(words), dtype=np.uint64)
    return numbers[order], order, place[code]


def counted(first: np.ndarray) -> np.ndarray:
    """Places of the tokens that count: all but two of each text."""
    own = np.ones(first[-1], bool)
    own[first[:-1]] = own[first[:-1] + 1] = False
    return np.flatnonzero(own)


def pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _K + second)


def among(wanted: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of wanted are in the sorted array known."""
    if not len(known):
        return np.zeros(len(wanted), bool)
    return known[np.minimum(np.searchsorted(known, wanted), len(known) - 1)] == wanted


def dealt(by: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(by ^ _K) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def word_bucket(word: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash, so that the buckets' sorted arrays follow each other."""
    return (((word >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)


@dataclass
class Deal:
    """Which bucket n-grams go to."""

    buckets: int
    hot_words: np.ndarray  # sorted numbers of words, and hashes of pairs, that are dealt by more than themselves
    hot_pairs: np.ndarray

    def gram(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        by, hot = v.copy(), np.flatnonzero(among(v, self.hot_words))
        by[hot] = pair(u[hot], v[hot])
        hot = hot[among(by[hot], self.hot_pairs)]
        by[hot] = pair(by[hot], w[hot])
        return dealt(by, self.buckets)


# --- counting -------------------------------------------------------------------------------------------------


def packed(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers, the first of them in order and kept as differences, each in as few bytes as its largest
    needs, byte planes apart, compressed."""
    head, planes = [len(columns)], []
    for c in (np.diff(columns[0], prepend=columns[0][:1] * 0), *columns[1:]):
        width = next(k for k in (1, 2, 4, 8) if k == 8 or not len(c) or int(c.max()) < 1 << 8 * k)
        head += [len(c), width]
        planes.append(c.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array(head, np.int64).tobytes(), *planes]))


def unpacked(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2).tolist(), 8 + 16 * n, []
    for size, width in head:
        planes = np.frombuffer(raw, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += size * width
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where rows of equal values begin in columns that are in order."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def summed(columns: tuple, n: np.ndarray | None, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the columns (numbers below ``words``) in order, and the sum of n (or the number) of each."""
    if words <= 1 << 21:
        key = columns[0].astype(np.uint64)
        for c in columns[1:]:
            key = key << _ID | c
        order = np.argsort(key) if n is not None else None
        key = key[order] if n is not None else np.sort(key)
        at = runs(key)
        out = [(key[at] >> _ID * np.uint64(len(columns) - 1 - i)) & _MASK for i in range(len(columns))]
    else:  # more words than fit into one number
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        at = runs(*columns)
        out = [c[at] for c in columns]
    if n is None:
        return out, np.diff(np.append(at, len(columns[0])))
    return out, np.add.reduceat(n[order], at, dtype=np.int64) if len(at) else n[:0]


def blocks_counted(batches, at_once: int) -> Iterator[tuple[list[np.ndarray], list[np.ndarray]]]:
    """Some millions of tokens at a time, as ``in_pieces`` gives them, with starts (and the end) in all of them."""
    tokens, starts, held = [], [], 0
    for batch in batches:
        for part in batches_of(batch):
            for own, first in in_pieces(part):
                tokens.append(own)
                starts.append(first[:-1] + held)
                held += len(own)
                if held >= at_once:
                    yield np.concatenate(tokens), np.concatenate([*starts, [held]])
                    tokens, starts, held = [], [], 0
    if held:
        yield np.concatenate(tokens), np.concatenate([*starts, [held]])


def body_batch(bucket: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([body], pa.binary())], ["bucket", "body"])


def each_bucket(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs in ``to``, and the places at which it does, in order."""
    if len(to):
        order = np.argsort(to.astype(np.uint16) if int(to.max()) < 1 << 16 else to, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            yield int(to[own[0]]), own


def rows_of(to: np.ndarray, columns: list[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """A row of packed columns for each range of ``width`` buckets; the first column is in order."""
    for b, own in each_bucket(to // width):
        yield body_batch(b, packed(*(c[own] for c in columns)))


def widths(buckets: int, fan: int = FAN) -> list[int]:
    """Buckets in the ranges that counts are dealt to, step by step, each of at most ``fan`` finer ones; 1 at last."""
    out = [-(-buckets // fan)]
    while out[-1] > 1:
        out.append(-(-out[-1] // fan))
    return out


def count_words(buckets: int, at_once: int, width: int = 1):
    """Task: texts in, for each range of buckets a row of packed columns out: hashes of words, and their counts."""

    def task(batches):
        for tokens, first in blocks_counted(batches, at_once):
            words, code = coded(tokens[counted(first)])
            n = np.bincount(code.astype(np.int64), minlength=len(words))
            yield from rows_of(word_bucket(words, buckets), [words, n], width)

    return task


def summed_rows(rows: list[list[np.ndarray]], key: int = 0) -> list[np.ndarray]:
    """Columns of several rows in the order of column ``key``, of which equal values are one; later columns are summed."""
    keys, at = np.unique(np.concatenate([r[key] for r in rows]), return_inverse=True)
    sums = [np.zeros(len(keys), np.int64) for _ in rows[0][key + 1 :]]
    for k, total in enumerate(sums, key + 1):
        np.add.at(total, at, np.concatenate([r[k] for r in rows]).astype(np.int64))
    return [keys, *sums]


def dealt_on(rows: DataFrame, buckets: int, steps: list[int], again, at_once: int, tasks: int) -> DataFrame:
    """rows (bucket, body) of ranges of steps[0] buckets as rows of single buckets. again: what several rows hold in all,
    as the bucket of each entry and the columns. A range's rows may be dealt on by several tasks."""

    def finer(width: int):
        def task(batches):
            held, size, range_now = [], 0, None
            for batch in batches:
                for b, body in zip(batch.column("bucket").to_pylist(), batch.column("body")):
                    if held and (b != range_now or size >= at_once):
                        yield from rows_of(*again(held), width)
                        held, size = [], 0
                    range_now = b
                    held.append(unpacked(body.as_py()))
                    size += len(held[-1][0])
            if held:
                yield from rows_of(*again(held), width)

        return task

    for before, width in zip(steps, steps[1:]):
        share = F.pmod(F.xxhash64("body"), F.lit(max(1, tasks * before // buckets)))
        rows = rows.repartition(tasks, F.col("bucket"), share).sortWithinPartitions("bucket").mapInArrow(lean(finer(width)), "bucket int, body binary")
    return rows


CLASSES = 48


def vocabulary_files(folder: str):
    """Group: all counts of a range of words; writes hashes in order, counts and places in their class, and returns how many words there are of
    each class of counts (by powers of two)."""

    def group(key, table):
        parts = [unpacked(x) for x in table.column("body").to_pylist()]
        words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(words)).astype(np.int64)
        kind = class_of(n)
        place, order = np.empty(len(n), np.uint32), np.argsort(kind, kind="stable")
        place[order] = np.arange(len(n)) - np.searchsorted(kind[order], kind[order])
        write_file(f"{folder}/vocabulary/{key[0].as_py()}", [words.tobytes(), n.tobytes(), place.tobytes()])
        sizes = np.bincount(kind, minlength=CLASSES)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64())), "tokens": pa.array([int(n.sum())], pa.int64())})

    return group


def class_of(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(n.astype(np.float64))[1], CLASSES - 1)


def first_numbers(folder: str, buckets: int, span: int, base: np.ndarray):
    """Group: sizes of a span of buckets; writes the first number of each class in each of them. base: that of the span."""

    def group(key, table):
        k = key[0].as_py()
        sizes = np.zeros((min(span, buckets - k * span), CLASSES), np.int64)
        sizes[np.asarray(table.column("bucket")) - k * span] = table.column("sizes").to_pylist()
        write_file(f"{folder}/first/{k}", [(base[k] + np.cumsum(sizes, axis=0) - sizes).astype(np.uint64).tobytes()])
        return pa.table({"span": pa.array([k], pa.int32())})

    return group


@dataclass
class Vocabulary:
    """Numbers of words: by falling class of counts, then by bucket and hash. The first number of a class in a bucket is
    in a file for ``span`` buckets; the driver sees one row of sums for each of these."""

    folder: str
    buckets: int
    span: int
    size: int
    tokens: int

    @classmethod
    def of(cls, folder: str, buckets: int, about: DataFrame, span: int = SPAN) -> "Vocabulary":
        """about: bucket, sizes (words of each class) and tokens of each bucket that has words; a written table."""
        spanned = about.withColumn("span", F.floor(F.col("bucket") / span).cast("int"))
        by_class = [F.sum(F.get("sizes", F.lit(k))).alias(f"c{k}") for k in range(CLASSES)]
        sizes, tokens = np.zeros((-(-buckets // span), CLASSES), np.int64), 0
        for r in spanned.groupBy("span").agg(F.sum("tokens").alias("tokens"), *by_class).collect():
            sizes[r["span"]], tokens = [r[f"c{k}"] for k in range(CLASSES)], tokens + r["tokens"]
        falling = sizes[:, ::-1].T.ravel()  # by class, most frequent first, then by span
        base = (np.cumsum(falling) - falling + 1).reshape(CLASSES, len(sizes)).T[:, ::-1]  # 0 is the beginning's
        spanned.groupBy("span").applyInArrow(first_numbers(folder, buckets, span, base), "span int").count()
        return cls(folder, buckets, span, int(sizes.sum()), tokens)

    def look_up(self, words: np.ndarray, files: dict) -> tuple[np.ndarray, np.ndarray]:
        """words: hashes in order. Number and count of each."""
        number, n = np.full(len(words), UNSEEN), np.zeros(len(words), np.int64)
        for b, own in each_bucket(word_bucket(words, self.buckets)):
            if b not in files:
                try:
                    raw = mapped(f"{self.folder}/vocabulary/{b}", np.uint8)
                    first = mapped(f"{self.folder}/first/{b // self.span}", np.uint64).reshape(-1, CLASSES)[b % self.span]
                except FileNotFoundError:
                    raw, first = np.zeros(0, np.uint8), None
                size = len(raw) // 20
                files[b] = raw[: 8 * size].view(np.uint64), raw[8 * size : 16 * size].view(np.int64), raw[16 * size :].view(np.uint32), first
            keys, counts, places, first = files[b]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, words[own]), len(keys) - 1)
                hit = keys[at] == words[own]
                n[own[hit]] = counts[at[hit]]
                number[own[hit]] = first[class_of(counts[at[hit]])] + places[at[hit]]
        number[words == BEGIN] = FIRST
        return number, n


def grams_to(words: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray, deal: Deal) -> np.ndarray:
    """The bucket of each trigram of places in words."""
    to = dealt(words, deal.buckets)[v]
    hot = np.flatnonzero(among(words, deal.hot_words)[v])
    to[hot] = deal.gram(words[u[hot]], words[v[hot]], words[w[hot]])
    return to


def count_grams(vocabulary: Vocabulary, deal: Deal, at_once: int, width: int = 1):
    """Task: texts in, for each range of buckets a row of packed columns out: v, u, w and count of each trigram, in order."""

    def task(batches):
        files = {}
        for tokens, first in blocks_counted(batches, at_once):
            words, code = coded(tokens)
            del tokens
            words, _, code = numbered(words, code, vocabulary.look_up(words, files)[0])
            own = counted(first)
            (v, u, w), n = summed((code[own - 1], code[own - 2], code[own]), None, len(words))
            del code, own
            yield from rows_of(grams_to(words, v, u, w, deal), [words[v], words[u], words[w], n], width)

    return task


def counts_of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def spread(n: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each run: the sum of n, and how many of them are 1, 2 and more."""
    if not len(at):
        return np.zeros((0, 4), np.int64)
    return np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n > 2)], 1)


ABOUT = "kind string, bucket int, body binary, sums array<long>"
_ABOUT = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("body", pa.binary()), ("sums", pa.list_(pa.int64()))])


def by_bucket(kind: str, to: np.ndarray, columns: list[np.ndarray], width: int) -> list[tuple]:
    return [(kind, b, packed(*(c[own] for c in columns)), None) for b, own in each_bucket(to // width)]


def rows_out(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _ABOUT)], schema=_ABOUT) if rows else _ABOUT.empty_table()


def word_rows(words: np.ndarray, buckets: int, v: np.ndarray, w: np.ndarray, a: np.ndarray, width: int) -> list[tuple]:
    """What pairs (v, w) after ``a`` different words say of single words: number, words before, and of what follows the sum
    of a and how many are 1, 2 and more."""
    at = runs(v)
    about = np.zeros((len(words), 5), np.int64)
    about[:, 0] = np.bincount(w.astype(np.int64), minlength=len(words))
    about[v[at].astype(np.int64), 1:] = spread(a, at)
    some = np.flatnonzero(about.any(1))
    return by_bucket("word", dealt(words[some], buckets), [words[some], *about[some].T], width)


def numbers_to(words: np.ndarray) -> np.ndarray:
    """A table from a number to its place in words."""
    table = np.empty(int(words[-1]) + 1, np.uint32)
    table[words] = np.arange(len(words))
    return table


def merged(parts: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Numbers of words, places among them as v, u, w of the distinct trigrams of several rows, and their counts."""
    columns = [np.concatenate([p[k].astype(np.uint32 if k else np.uint64) if p[k].itemsize < 8 or not k else p[k] for p in parts]) for k in (0, 1, 2)]
    n = np.concatenate([p[3] for p in parts])
    parts.clear()
    words = np.unique(np.concatenate([np.unique(c).astype(np.uint64) for c in columns]))
    columns = [np.searchsorted(words, c.astype(np.uint64)).astype(np.uint32) if words[-1] > 1 << 27 else numbers_to(words)[c] for c in columns]
    columns, n = summed(tuple(columns), n, len(words))
    return words, columns, n.astype(np.int64)


def gram_files(folder: str, deal: Deal, width: int = 1):
    """Group: all trigrams of a bucket; writes its arrays and hands on what it knows of words, hot pairs and contexts."""

    def group(key, table):
        b = key[0].as_py()
        words, (v, u, w), n = merged([unpacked(body) for body in table.column("body").to_pylist()])
        context = pair(words[u], words[v])
        write_file(f"{folder}/grams/{b}", table_of(pair(context, words[w]), n[:, None]))
        # contexts (u, v)
        at = runs(v, u)
        hashes, stats = context[at], spread(n, at)
        hot = among(words[v[at]], deal.hot_words) & among(hashes, deal.hot_pairs)
        once = (stats[:, 0] == 1) & ((words[u[at]] != FIRST) | (words[v[at]] != FIRST))  # the pairs tell as much
        write_file(f"{folder}/contexts/{b}", table_of(hashes[~hot & ~once], stats[~hot & ~once]))
        out = by_bucket("context", dealt(hashes[hot], deal.buckets), [np.arange(hot.sum()), hashes[hot], *stats[hot].T], width) if hot.any() else []
        of_grams = counts_of_counts(n)
        # pairs (v, w): each trigram is in one group, so its words before are counted once
        (v, w), a = summed((v, w), None, len(words))
        hot = among(words[v], deal.hot_words)
        if hot.any():
            out += by_bucket("pair", dealt(pair(words[v[hot]], words[w[hot]]), deal.buckets), [words[v[hot]], words[w[hot]], a[hot]], width)
            v, w, a = v[~hot], w[~hot], a[~hot]
        write_file(f"{folder}/pairs/{b}", table_of(pair(words[v], words[w]), a[:, None]))
        out += word_rows(words, deal.buckets, v, w, a, width)
        out.append(("grams", None, None, of_grams))
        out.append(("pairs", None, None, counts_of_counts(a)))
        return rows_out(out)

    return group


def pairs_summed(rows: list[list[np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Numbers of words, places among them as v, w of the distinct pairs of several rows, and the sum of each."""
    v, w, a = (np.concatenate(x) for x in zip(*rows))
    words, code = np.unique(np.concatenate([v, w]), return_inverse=True)
    (v, w), a = summed(tuple(code.astype(np.uint64).reshape(2, -1)), a.astype(np.int64), len(words))
    return words, v, w, a


def hot_files(folder: str, deal: Deal, width: int = 1):
    """Group: parts of the pairs that begin with a hot word, and of the hot contexts."""

    def group(key, table):
        b = key[0].as_py()
        kinds, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
        contexts = [unpacked(x) for k, x in zip(kinds, bodies) if k == "context"]
        if contexts:
            own, *total = summed_rows(contexts, 1)
            write_file(f"{folder}/hot-contexts/{b}", table_of(own, np.stack(total, 1)))
        pairs = [unpacked(x) for k, x in zip(kinds, bodies) if k == "pair"]
        if not pairs:
            return _ABOUT.empty_table()
        words, v, w, a = pairs_summed(pairs)
        write_file(f"{folder}/hot-pairs/{b}", table_of(pair(words[v], words[w]), a[:, None]))
        return rows_out([*word_rows(words, deal.buckets, v, w, a, width), ("pairs", None, None, counts_of_counts(a))])

    return group


def word_files(folder: str):
    """Group: all that is known of a bucket's words; writes its array, and returns sums for the driver."""

    def group(key, table):
        words, *about = summed_rows([unpacked(x) for x in table.column("body").to_pylist()])
        write_file(f"{folder}/words/{key[0].as_py()}", [words.tobytes(), np.stack(about, 1).tobytes()])
        return rows_out([("words", None, None, [int(about[0].sum()), *counts_of_counts(about[0])])])

    return group


# --- sorted hash arrays ---------------------------------------------------------------------------------------


def table_of(hashes: np.ndarray, values: np.ndarray) -> list[bytes]:
    """The bytes of a file that ``Table`` reads. Rows of values are single bytes that point into a list of the most
    frequent ones; rarer ones stand apart."""
    order = np.argsort(hashes)
    h, values = hashes[order], np.ascontiguousarray(values[order], np.int64)
    n, k = values.shape
    bits = max(0, n.bit_length() - 5)  # 16 to 32 keys a slot
    slot = h >> np.uint64(64 - bits) if bits else np.zeros(n, np.uint64)
    low = ((h << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
    offsets = np.searchsorted(slot, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.uint32)
    same = np.zeros(n, bool)  # neighbours that these bits do not tell apart
    same[1:] = (slot[1:] == slot[:-1]) & (low[1:] == low[:-1])
    same[:-1] |= same[1:].copy()
    small = (values < 1 << 12).all(1)
    key = (values << 12 * np.arange(k)).sum(1)
    kinds, times = np.unique(key[small], return_counts=True)
    book = np.sort(kinds[np.argsort(-times, kind="stable")[:255]])
    code = np.full(n, 255, np.uint8)
    if len(book):
        at = np.minimum(np.searchsorted(book, key), len(book) - 1)
        code[(book[at] == key) & small] = at[(book[at] == key) & small]
    rare, apart = np.flatnonzero(code == 255), np.flatnonzero(same)
    head = np.array([n, k, bits, len(book), len(rare), len(apart)], np.int64)
    book = (book[:, None] >> 12 * np.arange(k)) & 4095
    return [x.tobytes() for x in (head, book, rare, values[rare], h[apart], values[apart], offsets, low, code)]


class Table:
    """A sorted hash array, mapped into memory."""

    def __init__(self, raw: np.ndarray):
        if not len(raw):
            raw = np.frombuffer(b"".join(table_of(np.zeros(0, np.uint64), np.zeros((0, 1), np.int64))), np.uint8)
        self.n, self.k, self.bits, book, rare, apart = raw[:48].view(np.int64).tolist()
        at = 48

        def take(count: int, dtype, width: int = 0):
            nonlocal at
            size = np.dtype(dtype).itemsize * count * (width or 1)
            x = raw[at : at + size].view(dtype)
            at += size
            return x.reshape(count, width) if width else x

        self.book, self.rare, self.values = take(book, np.int64, self.k), take(rare, np.int64), take(rare, np.int64, self.k)
        self.apart, self.apart_values = take(apart, np.uint64), take(apart, np.int64, self.k)
        self.offsets, self.low, self.code = take((1 << self.bits) + 1, np.uint32), take(self.n, np.uint32), take(self.n, np.uint8)

    def find(self, wanted: np.ndarray, width: int) -> np.ndarray:
        """The values of each hash, zeros if it is not there."""
        out = np.zeros((len(wanted), width), np.int64)
        if not self.n:
            return out
        slot = (wanted >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(wanted), np.uint64)).astype(np.int64)
        low = ((wanted << np.uint64(self.bits)) >> np.uint64(32)).astype(np.uint32)
        left, size = self.offsets[slot].astype(np.int64), None
        right = self.offsets[slot + 1].astype(np.int64)
        size = right - left
        end = right
        for _ in range(int(size.max()).bit_length()):
            middle = (left + right) >> 1
            less = (middle < right) & (self.low[np.minimum(middle, self.n - 1)] < low)
            left, right = np.where(less, middle + 1, left), np.where(less, right, middle)
        hit = np.flatnonzero((left < end) & (self.low[np.minimum(left, self.n - 1)] == low))
        place = left[hit]
        code = self.code[place]
        usual = code < 255
        out[hit[usual]] = self.book[code[usual]]
        if not usual.all():
            out[hit[~usual]] = self.values[np.searchsorted(self.rare, place[~usual])]
        if len(self.apart):
            at = np.minimum(np.searchsorted(self.apart, wanted), len(self.apart) - 1)
            whole = self.apart[at] == wanted
            out[whole] = self.apart_values[at[whole]]
        return out


# --- the model ------------------------------------------------------------------------------------------------


def discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from counts of counts."""
    y = ones / (ones + 2 * twos) if ones else 0.5
    raw = [1 - 2 * y * twos / ones if ones else 0.5, 2 - 3 * y * threes / twos if twos else 1.0, 3 - 4 * y * fours / threes if threes else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw))])


@dataclass
class Model:
    folder: str
    deal: Deal
    words: Vocabulary
    vocabulary: int  # V
    tokens: int  # N
    pairs: int  # distinct pairs
    d_gram: np.ndarray
    d_pair: np.ndarray
    d_word: np.ndarray
    rest: float  # share of the word level that goes to the uniform level


def train(docs: DataFrame, buckets: int | None = None, at_once: int = AT_ONCE, hot_share: float | None = None, fan: int = FAN, span: int = SPAN) -> Model:
    """Counts the texts of docs (column text) and writes the model to the shared folder."""
    spark: SparkSession = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(2 * spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    folder, steps = shared_folder(spark, "kneser-ney"), widths(buckets, fan)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ON_BYTES))
    texts, width = docs.select("text"), steps[0]

    def on(rows: DataFrame, again) -> DataFrame:
        return dealt_on(rows.select("bucket", "body"), buckets, steps, again, at_once, tasks)

    def again_seen(rows):
        words, n = summed_rows(rows)
        return word_bucket(words, buckets), [words, n]

    seen = on(texts.mapInArrow(lean(count_words(buckets, at_once, width)), "bucket int, body binary"), again_seen)
    sizes = seen.groupBy("bucket").applyInArrow(vocabulary_files(folder), "bucket int, sizes array<long>, tokens long")
    vocabulary = Vocabulary.of(folder, buckets, kept(sizes, "sizes"), span)
    share = hot_share or max(0.3 / buckets, 1e-5)
    deal = Deal(buckets, *hot_ones(docs, vocabulary, share))

    def again_grams(rows):
        words, (v, u, w), n = merged(rows)
        return grams_to(words, v, u, w, deal), [words[v], words[u], words[w], n]

    def again_pairs(rows):
        words, v, w, a = pairs_summed(rows)
        return dealt(pair(words[v], words[w]), buckets), [words[v], words[w], a]

    def again_contexts(rows):
        hashes, *stats = summed_rows(rows, 1)
        return dealt(hashes, buckets), [np.arange(len(hashes)), hashes, *stats]

    def again_words(rows):
        words, *known = summed_rows(rows)
        return dealt(words, buckets), [words, *known]

    known = on(texts.mapInArrow(lean(count_grams(vocabulary, deal, at_once, width)), "bucket int, body binary"), again_grams)
    about = kept(known.groupBy("bucket").applyInArrow(gram_files(folder, deal, width), ABOUT), "grams")
    hot = [on(about.where(F.col("kind") == k), again).select(F.lit(k).alias("kind"), "bucket", "body") for k, again in (("pair", again_pairs), ("context", again_contexts))]
    hot = kept(hot[0].union(hot[1]).groupBy("bucket").applyInArrow(hot_files(folder, deal, width), ABOUT), "hot")
    words = on(about.union(hot).where("kind = 'word'"), again_words).groupBy("bucket").applyInArrow(word_files(folder), ABOUT)
    sums = {"grams": np.zeros(4, int), "pairs": np.zeros(4, int), "words": np.zeros(5, int)}
    every = about.union(hot).union(words).where("sums is not null").select("kind", F.posexplode("sums").alias("at", "n"))
    for r in every.groupBy("kind", "at").agg(F.sum("n").alias("n")).collect():
        sums[r["kind"]][r["at"]] = r["n"]
    v, (pairs, *few) = vocabulary.size, map(int, sums["words"])
    d_word = discounts(*few)
    rest = float((d_word[1] * few[0] + d_word[2] * few[1] + d_word[3] * (v - few[0] - few[1])) / pairs) if pairs else 1.0
    return Model(folder, deal, vocabulary, v, vocabulary.tokens, pairs, discounts(*map(int, sums["grams"])), discounts(*map(int, sums["pairs"])), d_word, rest)


def hot_ones(docs: DataFrame, vocabulary: Vocabulary, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of middle words, and hashes of contexts, with over this share of the tokens of one text in 64: at most 1 / share of either."""
    picked = docs.where(F.rand(7) < 1 / 64).select("text")

    def task(batches):
        files = {}
        for batch in batches:
            for part in batches_of(batch):
                for tokens, first in in_pieces(part):
                    own, (words, code) = counted(first), coded(tokens)
                    number = vocabulary.look_up(words, files)[0]
                    u, v = number[code[own - 2]], number[code[own - 1]]
                    for kind, keys in (("word", v), ("pair", pair(u, v))):
                        keys, n = np.unique(keys, return_counts=True)
                        most = n >= share / 8 * n.sum()
                        kinds = [kind] * int(most.sum()) + ["all"] * (kind == "word")
                        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(np.append(keys[most], [np.uint64(0)] * (kind == "word")).astype(np.uint64).view(np.int64)), pa.array(np.append(n[most], [n.sum()] * (kind == "word")).astype(np.int64))], ["kind", "key", "n"])

    sums = kept(picked.mapInArrow(task, "kind string, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")), "hot-ones")
    total = sums.where("kind = 'all'").agg(F.max("n")).first()[0] or 0
    found = sums.where((F.col("kind") != "all") & (F.col("n") >= share * total)).collect()
    return tuple(np.sort(np.array([r["key"] for r in found if r["kind"] == kind], np.int64).view(np.uint64)) for kind in ("word", "pair"))


class Lookup:
    """The model's files, mapped into a worker's memory when first needed."""

    def __init__(self, model: Model):
        self.m, self.files = model, {}

    def table(self, name: str) -> Table:
        if name not in self.files:
            try:
                self.files[name] = Table(mapped(f"{self.m.folder}/{name}", np.uint8))
            except FileNotFoundError:  # nothing fell into this bucket
                self.files[name] = Table(np.zeros(0, np.uint8))
        return self.files[name]

    def words(self, wanted: np.ndarray) -> np.ndarray:
        """wanted: numbers in order. Words before, and of what follows the sum and how many are 1, 2 and more."""
        out = np.zeros((len(wanted), 5), np.int64)
        for b, own in each_bucket(dealt(wanted, self.m.deal.buckets)):
            if ("words", b) not in self.files:
                try:
                    raw = mapped(f"{self.m.folder}/words/{b}", np.uint64)
                except FileNotFoundError:
                    raw = np.zeros(0, np.uint64)
                n = len(raw) // 6
                self.files["words", b] = raw[:n], raw[n:].view(np.int64).reshape(n, 5)
            keys, values = self.files["words", b]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, wanted[own]), len(keys) - 1)
                hit = keys[at] == wanted[own]
                out[own[hit]] = values[at[hit]]
        return out

    def each(self, name: str, to: np.ndarray, hashes: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(hashes), width), np.int64)
        for b, own in each_bucket(to):
            out[own] = self.table(f"{name}/{b}").find(hashes[own], width)
        return out

    def pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Before how many different words' successors each pair stands."""
        hashes, hot = pair(v, w), among(v, self.m.deal.hot_words)
        out = np.zeros(len(v), np.int64)
        out[~hot] = self.each("pairs", dealt(v[~hot], self.m.deal.buckets), hashes[~hot], 1)[:, 0]
        out[hot] = self.each("hot-pairs", dealt(hashes[hot], self.m.deal.buckets), hashes[hot], 1)[:, 0]
        return out

    def contexts(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        hashes, hot_word = pair(u, v), among(v, self.m.deal.hot_words)
        hot = hot_word & among(hashes, self.m.deal.hot_pairs)
        out = np.zeros((len(v), 4), np.int64)
        to = dealt(np.where(hot_word, hashes, v), self.m.deal.buckets)
        out[~hot] = self.each("contexts", to[~hot], hashes[~hot], 4)
        out[hot] = self.each("hot-contexts", to[hot], hashes[hot], 4)
        rest = np.flatnonzero(out[:, 0] == 0)
        out[rest[self.pairs(u[rest], v[rest]) > 0]] = (1, 1, 0, 0)
        return out

    def grams(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.each("grams", self.m.deal.gram(u, v, w), pair(pair(u, v), w), 1)[:, 0]


def level(n: np.ndarray, stats: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Probability by one order's counts n and context statistics (sum; ones, twos, more), over that of the order below."""
    total = np.maximum(stats[:, 0], 1)
    seen = np.maximum(n - d[np.minimum(n, 3)], 0) / total
    return np.where(stats[:, 0] > 0, seen + (stats[:, 1:] @ d[1:]) / total * lower, lower)


def token_scores(look: Lookup, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count of each token, and log10 of its probability after the two before it."""
    m = look.m
    hashes, code = coded(tokens)
    number, n = m.words.look_up(hashes, look.files)
    words, order, code = numbered(hashes, code, number)
    n, known, own = n[order], look.words(words), counted(first)
    (u, v, w), at = distinct(code[own - 2], code[own - 1], code[own], words=len(words))
    b = known[:, 0]
    p1 = np.maximum(b - m.d_word[np.minimum(b, 3)], 0) / max(1, m.pairs) + m.rest / (m.vocabulary + 1)
    p2 = level(look.pairs(words[v], words[w]), known[v, 1:], m.d_pair, p1[w])
    start = runs(u, v)
    stats = look.contexts(words[u[start]], words[v[start]])
    stats = stats[np.repeat(np.arange(len(start)), np.diff(np.append(start, len(u))))]
    p3 = level(look.grams(words[u], words[v], words[w]), stats, m.d_gram, p2)
    return n[code[own]], np.log10(p3)[at]


def distinct(*columns, words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, and which of them each row is."""
    if words <= 1 << 21:
        key = columns[0]
        for c in columns[1:]:
            key = key << _ID | c
        key, at = np.unique(key, return_inverse=True)
        return [(key >> _ID * np.uint64(len(columns) - 1 - i)) & _MASK for i in range(len(columns))], at
    order = np.lexsort(columns[::-1])
    first = runs(*(c[order] for c in columns))
    at = np.empty(len(order), np.int64)
    at[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return [c[order[first]] for c in columns], at


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score and perplexity of each text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())])

    def task(batches):
        look = Lookup(model)
        for batch in batches:
            for part in batches_of(batch, size=3 << 20):
                n = known = total = plain = 0  # one row of each text; a long text's blocks are summed
                for tokens, first in in_pieces(part):
                    count, logp = token_scores(look, tokens, first)
                    base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
                    starts = first[:-1] - 2 * np.arange(len(first) - 1)
                    sums = [np.add.reduceat(x, starts) for x in ((count > 0).astype(np.int64), logp, base)]
                    n, known, total, plain = n + np.diff(first) - 2, known + sums[0], total + sums[1], plain + sums[2]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(plain), pa.array(total), pa.array(10.0 ** np.minimum(-total / n, 300))], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(lean(task), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def scored_documents(docs: DataFrame) -> DataFrame:
    """Learns from the texts outside the held-out fold (crc32 of doc_id mod 7 is 2) and scores every text."""
    model = train(docs.where(~fold(7)))
    return score(docs, model).select("doc_id", fold(7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
