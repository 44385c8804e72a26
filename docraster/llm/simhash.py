"""SimHash near-duplicates, found with Golay-code fuzzy keys.

A fingerprint has 64 bits: segments A and B of 23 bits and C of 18. The perfect binary Golay code of length 23
decodes a segment to its nearest codeword; a segment's *fuzzy keys* are all codewords within distance 4 (about
five), and two segments that differ in at most two bits always share one. Two fingerprints at distance d <= 3
spread their differences (a, b, c) over the segments, and pigeonhole leaves these cases:

- a = 0, b <= 2: exact A and a fuzzy key of B;       b = 0, a <= 2: exact B and a fuzzy key of A
- a = 3, so b = c = 0: exact B and C;                b = 3, so a = c = 0: exact A and C
- a, b >= 1, so c <= 1: fuzzy keys of A and B, and whichever half of C (9 bits) is the same

Every key has at least 32 bits, so groups of equal keys stay small on random fingerprints. Fingerprints are made
distinct first; a group's members are compared in blocks of one sorted run, and a large group by the same pigeonhole
once more: the bits in which its members differ at all are cut into four bands, of which two near members share one.
Each task hands on a spanning forest of the links that it verified (at most one row per fingerprint), never the pairs.
Fingerprints with very many links or copies (hubs) are told by their count and joined by a broadcast of at most 10,000
of them, so that no task gets all rows of one.

Nulls: a null text, or one without words, has fingerprint zero and links like any other; a null doc_id takes part
and is the component's smallest id only if no other is known. Repeated rows stay rows of their own. An empty
table gives an empty result. Very long texts are read a block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docraster.llm.shared import batches_of, filesystem, hub_join, kept, lean, scratch, shared_folder, write_file
from docraster.llm.words import blocks_of

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 256))
SEED, SHINGLE, DISTANCE = 42, 3, 3

# --- fingerprints ---------------------------------------------------------------------------------------------


def shingle_hashes(words: list[bytes], shingle: int) -> list[int]:
    """XXH64 of each run of ``shingle`` words, or of all words if there are no more."""
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return [digest(line, SEED)] if words else []
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    return [digest(line[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :].tolist())]


def bits_of(hashes: list[int]) -> np.ndarray:
    return np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def long_fingerprint(text: str, shingle: int, block: int) -> int:
    """The fingerprint of one text, whose votes are summed over blocks; a block goes on from the last words before it."""
    votes, n, words = np.zeros(64, np.int64), 0, []
    for raw in blocks_of(text.encode("utf-8", "surrogatepass"), size=block):
        words += raw.translate(_LOWER).split()
        if len(words) >= shingle:
            hashes = shingle_hashes(words, shingle)
            votes += bits_of(hashes).sum(0, dtype=np.int64)
            n += len(hashes)
            words = words[len(words) - shingle + 1 :]
    if not n:  # fewer words than a shingle in all
        hashes = shingle_hashes(words, shingle)
        votes, n = votes + bits_of(hashes).sum(0, dtype=np.int64), len(hashes)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE, block: int = 1 << 19) -> np.ndarray:
    """64-bit SimHash of each text: bit i is set if it is set in over half the XXH64 of the word shingles. Texts of over
    two blocks of bytes go a block at a time."""
    all_hashes, counts, longer = [], [], {}
    for i, text in enumerate(texts):
        if text and len(text) > 2 * block:
            longer[i], text = long_fingerprint(text, shingle, block), None
        found = shingle_hashes((text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(), shingle)
        all_hashes += found
        counts.append(len(found))
    n = np.array(counts, np.int64)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        votes = np.add.reduceat(bits_of(all_hashes), np.concatenate([[0], np.cumsum(n[some])[:-1]]), axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * votes > n[some, None], axis=1, bitorder="little").view(np.uint64).ravel()
    for i, fp in longer.items():
        out[i] = fp
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of docs but the text, and fp (its fingerprint as a signed 64-bit integer)."""
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c != "text"]

    def task(batches):
        for batch in batches:
            for part in batches_of(batch, size=1 << 20):
                fp = fingerprints_of(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(fp.view(np.int64))], [*names, "fp"])

    return docs.mapInArrow(lean(task), T.StructType([*(docs.schema[c] for c in names), T.StructField("fp", T.LongType())]))


# --- the Golay code and the keys ------------------------------------------------------------------------------

#: Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the (23, 12, 7) code.
GENERATOR = 0b110001110101


def _remainders(n_bits: int, shift: int) -> np.ndarray:
    x = np.arange(1 << n_bits, dtype=np.int64) << shift
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GENERATOR << (bit - 11), 0)
    return x


class Golay:
    """Nearest codewords by syndrome: each of the 2,048 syndromes has one error of weight 3 at most."""

    def __init__(self):
        self.high, self.low = _remainders(11, 12), _remainders(12, 0)
        self.error = np.zeros(2048, np.int64)
        one = 1 << np.arange(23, dtype=np.int64)
        i, j, k = np.meshgrid(np.arange(23), np.arange(23), np.arange(23), indexing="ij")
        # with i <= j <= k, equal indices cancel or repeat: together all weights up to 3
        errors = np.unique(np.concatenate([[0], one, (one[i] ^ one[j])[(i < j)].ravel(), (one[i] ^ one[j] ^ one[k])[(i < j) & (j < k)].ravel()]))
        self.error[self.syndrome(errors)] = errors

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        return self.high[x >> 12] ^ self.low[x & 4095]

    def index(self, x: np.ndarray) -> np.ndarray:
        """12-bit index of the codeword nearest to each 23-bit word."""
        return (x ^ self.error[self.syndrome(x)]) >> 11

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all codewords within distance 4 of each word, as (row, index): the nearest ones of the word
        and of the words that differ from it in one bit."""
        flips = np.concatenate([[0], 1 << np.arange(23, dtype=np.int64)])
        found = np.sort(self.index(x[:, None] ^ flips), axis=1)
        new = np.concatenate([np.ones((len(x), 1), bool), found[:, 1:] != found[:, :-1]], axis=1)
        return np.nonzero(new)[0], found[new]


def keys_of(fp: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """All keys of each fingerprint, as (row, key); a key's top three bits name its case."""
    fp = fp.astype(np.uint64)
    a, b, c = ((fp >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((0, (1 << 23) - 1), (23, (1 << 23) - 1), (46, (1 << 18) - 1)))
    rows = np.arange(len(fp))
    ra, ka = code.near(a)
    rb, kb = code.near(b)
    na, nb = np.bincount(ra, minlength=len(fp)), np.bincount(rb, minlength=len(fp))
    # each fuzzy key of A with each of B
    first_b = np.concatenate([[0], np.cumsum(nb)[:-1]])
    times = nb[ra]
    within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    rab = np.repeat(ra, times)
    kab = np.repeat(ka, times) << 12 | kb[first_b[rab] + within]
    assert na.sum() == len(ra)
    parts = [
        (rows, b << 18 | c),
        (rows, a << 18 | c),
        (rb, a[rb] << 12 | kb),
        (ra, b[ra] << 12 | ka),
        (rab, kab << 9 | c[rab] >> 9),
        (rab, kab << 9 | c[rab] & 511),
    ]
    return np.concatenate([r for r, _ in parts]), np.concatenate([k | case << 60 for case, (_, k) in enumerate(parts)])


# --- links ----------------------------------------------------------------------------------------------------


class Forest:
    """Components over 0..n-1 that take links in bulk."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (higher := self.up[r]).tobytes() != r.tobytes():
            r = higher
        return r

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            rx, ry = self.roots(x), self.roots(y)
            apart = rx != ry
            x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
            np.minimum.at(self.up, np.maximum(rx, ry), np.minimum(rx, ry))


def near_pairs(key: np.ndarray, fp: np.ndarray, distance: int, most: int = 512):
    """Pairs of rows (arrays i, j) that share a key and differ in few bits, a step at a time; for connectivity alone, so
    members of a run that all differ little are only paired with its first. key is sorted.

    Of runs of up to ``most`` rows, row i is compared with row i + 1, then i + 2, and so on while the key lasts, all
    rows at once. Longer runs go by bands of the bits that vary in them.
    """
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    at, step = np.flatnonzero(np.repeat(size <= most, size)), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]
        if len(near):
            yield near, near + step
        step += 1
    for begin, n in zip(first[size > most].tolist(), size[size > most].tolist()):
        own = fp[begin : begin + n]
        bits = [b for b in range(64) if int(np.bitwise_or.reduce(own ^ own[0])) >> b & 1]
        if len(bits) <= distance:
            yield np.full(n - 1, begin), np.arange(begin + 1, begin + n)
            continue
        for band in np.array_split(bits, distance + 1):
            shared = own & np.uint64(sum(1 << int(b) for b in band))
            order = np.argsort(shared, kind="stable")
            for i, j in near_pairs(shared[order], own[order], distance, most):
                yield begin + order[i], begin + order[j]


def linked(key: np.ndarray, fp: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (x, y) of the fingerprints that share a key and differ in few bits. key is sorted."""
    nodes, node = np.unique(fp, return_inverse=True)
    forest = Forest(len(nodes))
    for i, j in near_pairs(key, fp, distance):
        forest.link(node[i], node[j])
    root = forest.roots(np.arange(len(nodes)))
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Spanning links (x, y) among distinct fingerprints (column fp) at this distance or less, 3 at most."""

    def explode_keys(batches):
        code = Golay()
        for batch in batches:
            fp = np.asarray(batch.column("fp"), np.int64)
            for part in np.array_split(fp, max(1, len(fp) // 5000)):
                rows, keys = keys_of(part.view(np.uint64), code)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["key", "fp"])

    def compare(batches):
        """Whole runs of one key, some hundred thousand rows at a time."""
        key, fp, size = [], [], 0

        def flush(k, f):
            x, y = linked(k, f.view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["x", "y"])

        for batch in batches:
            key.append(np.asarray(batch.column("key")))
            fp.append(np.asarray(batch.column("fp")))
            size += batch.num_rows
            if size >= 400_000:
                k, f = np.concatenate(key), np.concatenate(fp)
                cut = int(np.searchsorted(k, k[-1]))  # the last run may go on
                if cut:
                    yield flush(k[:cut], f[:cut])
                key, fp, size = [k[cut:]], [f[cut:]], len(k) - cut
        if size:
            yield flush(np.concatenate(key), np.concatenate(fp))

    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.select("fp").mapInArrow(lean(explode_keys), "key long, fp long")
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(lean(compare), "x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (x, y): each linked node with the smallest node it reaches (node, root).

    Alternating large-star and small-star steps; each step is written to the shared folder, and the steps end
    when no link changes.
    """

    def signature(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())

    def star(df: DataFrame, both_ways: bool) -> DataFrame:
        """Each node's smallest neighbour (or itself) is linked to its other neighbours: the larger ones if
        both_ways, else the smaller ones and itself."""
        if both_ways:
            seen = df.select(F.col("x").alias("u"), F.col("y").alias("v")).union(df.select("y", "x"))
        else:
            seen = df.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
        low = kept(seen.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "smallest")
        out = hub_join(seen, low, "u")
        if both_ways:
            out = out.where("v > u").select(F.col("v").alias("x"), F.col("m").alias("y"))
        else:
            out = out.select(F.col("v").alias("x"), F.col("m").alias("y")).union(low.select("u", "m"))
        return out.where("x <> y").distinct()

    edges = kept(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "links")
    before = signature(edges)
    while before[0]:
        edges = kept(star(kept(star(edges, True), "large-star"), False), "small-star")
        if (now := signature(edges)) == before:
            break
        before = now
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root"))


def grouped(prints: DataFrame) -> DataFrame:
    """Each distinct fingerprint of prints (fp, and id, which can be put in order): fp, its number of rows n, the
    component's root, and the smallest id in the component as component."""
    classes = kept(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "classes")
    roots = components(links(classes))
    rooted = kept(classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = kept(rooted.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("members")), "components")
    return kept(hub_join(rooted, smallest, "root", count="members").select("fp", "n", "component"), "groups")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of each row."""
    prints = kept(fingerprints(docs.select(F.col("doc_id").cast("long").alias("id"), "text")), "fingerprints")
    named = hub_join(prints, grouped(prints), "fp")
    return named.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


#: Rows that one bitmap tells of.
SPAN = 1 << 20


def located(docs: DataFrame) -> DataFrame:
    """d (the whole row), file (a 64-bit hash of its path) and at (the row's place in it). Rows of Parquet files are known by
    where they lie; other tables are written first."""
    plan, plain = [docs._jdf.queryExecution().analyzed()], True
    while plan:  # a place is a row's own only if nothing multiplies rows
        node = plan.pop()
        plain = plain and node.nodeName().split(" ")[0] in ("Relation", "LogicalRelation", "Project", "Filter", "SubqueryAlias")
        plan += [node.children().apply(i) for i in range(node.children().size())]

    def placed(df: DataFrame) -> DataFrame:
        where = df.metadataColumn("_metadata")
        return df.select(F.struct("*").alias("d"), F.xxhash64(where["file_path"]).alias("file"), where["row_index"].alias("at"))

    try:
        if plain:
            return placed(docs)
    except AnalysisException:  # no files, or none that number their rows
        pass
    return placed(kept(docs, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, whole, of which one of each component stays: that with the smallest doc_id (of several, by two
    hashes of the text; of rows equal in all that, the one whose other columns come first as text).

    A document is known by its file and its place in it, and no text is shuffled: what goes is told by a bitmap for each
    million rows of a file, and documents are read a second time and filtered where they lie.
    """
    spark = docs.sparkSession
    rows = located(docs)
    part = lambda c: F.col("d").getField(c)
    text = F.coalesce(part("text"), F.lit(""))
    name = F.struct(part("doc_id").isNull().alias("none"), F.coalesce(part("doc_id").cast("long"), F.lit(0)).alias("doc"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(17), text).alias("t2")).alias("id")
    others = [part(c) for c in docs.columns if c.lower() not in ("doc_id", "text")]
    other = F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(others)))) if others else F.lit("")
    bitmaps = shared_folder(spark, "gone")
    with scratch(spark):
        prints = kept(fingerprints(rows.select(name, "file", "at", other.alias("other"), part("text").alias("text"))), "fingerprints")
        named = kept(hub_join(prints, grouped(prints), "fp").select("id", "component", "file", "at", "other"), "named")
        first = named.where("id = component")
        row = F.struct("other", "file", "at")
        several = kept(first.groupBy("id").agg(F.min(row).alias("stays"), F.count("*").alias("n")).where("n > 1"), "several")
        extra = hub_join(first, several, "id").where(row != F.col("stays")).select("file", "at")
        gone = named.where("id <> component").select("file", "at").unionByName(extra)

        def marked(key, table):
            file, span = (k.as_py() for k in key)
            bits = np.zeros(SPAN, bool)
            bits[np.asarray(table.column("at"), np.int64) - span * SPAN] = True
            write_file(f"{bitmaps}/{file}/{span}", [np.packbits(bits).tobytes()])
            return pa.table({"file": pa.array([file], pa.int64())})

        gone.withColumn("span", F.floor(F.col("at") / SPAN)).groupBy("file", "span").applyInArrow(marked, "file long").count()

    def stay(batches):
        from pyarrow import fs

        told: dict[tuple[int, int], np.ndarray | None] = {}

        def bitmap(file: int, span: int) -> np.ndarray | None:
            if (file, span) not in told:
                told.clear()  # a task goes through its files one after another
                where, path = filesystem(f"{bitmaps}/{file}/{span}")
                if where.get_file_info(path).type == fs.FileType.NotFound:
                    told[file, span] = None
                else:
                    with where.open_input_stream(path, compression=None) as src:
                        told[file, span] = np.unpackbits(np.frombuffer(src.read(), np.uint8)).astype(bool)
            return told[file, span]

        for batch in batches:
            file, at = (np.asarray(batch.column(c), np.int64) for c in ("file", "at"))
            keep, begin = np.ones(len(at), bool), 0
            turns = np.flatnonzero((np.diff(file) != 0) | (np.diff(at // SPAN) != 0)) + 1
            for end in [*turns.tolist(), len(at)]:
                if end > begin and (bits := bitmap(int(file[begin]), int(at[begin] // SPAN))) is not None:
                    keep[begin:end] = ~bits[at[begin:end] % SPAN]
                begin = end
            whole = batch.column("d") if keep.all() else batch.column("d").filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays(whole.flatten(), [f.name for f in whole.type])

    return rows.mapInArrow(lean(stay), docs.schema)
