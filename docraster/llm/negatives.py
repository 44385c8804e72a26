"""Hard negatives by a norm-bucketed search, exact.

Rows are sorted by the length of their integer vectors, longest first, and dealt to ranges of it (the buckets; equal
lengths are told apart by id, so copies fill no bucket). A score is at most the product of two lengths: a bucket, or a
block of rows in it, is skipped for an anchor's window where that product is below the window's lower limit or below
the score of the k-th best found so far; and rows too short for any anchor are never read, by a filter on the length
that reaches the Parquet scan. Two such searches run: the k nearest of the same label (the positives), bounded from
below by the k-th best of the longest ``HEAD`` rows, and then the k best of other labels in each positive's window.

Anchors go through in blocks of at most ``BLOCK``, each of which is broadcast to the buckets; no bucket is copied or
shuffled again, and each task hands on k rows of a window at most.

Nulls: rows with a null label, a null vector, or null or non-finite components take no part. A null vec_id is no
anchor, is not relabelled and comes last among ties. Rows with an anchor's own vec_id are not its others; a repeated
row is a candidate, and an anchor, as often as it occurs. Shorter vectors are filled up with zeros. A component is held
to +-sqrt(2^62 / dimension), beyond which a score would not fit into a long. No anchor, or an empty table, gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docraster.llm.codes import finite, peak_of, whole, width
from docraster.llm.shared import kept

SCALE, K, ANCHOR_EVERY, RELABEL_EVERY, LABELS = 256, 5, 100, 7, 10
BLOCK, HEAD, PER_BUCKET, CHUNK, GROUP = 16_384, 4_096, 50_000, 1_024, 256
LAST, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def matrix(column: pa.Array, dim: int, exact: type) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim).astype(exact)


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, the last number for null; and which of them are null."""
    return np.asarray(column.fill_null(int(LAST)), np.int64), np.asarray(column.is_null())


class Search:
    """The k best candidates of each window (anchor, slot): scores from lo to hi, of the anchor's label or of others."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, same: bool, k: int):
        self.ids, self.labels, self.v, self.lo, self.hi, self.same, self.k = ids, labels, v, lo, hi, same, k
        x = v.astype(np.float64)
        self.length = np.sqrt((x * x).sum(1)) * (1 + 1e-9)

    def least_length(self) -> float:
        """Rows shorter than this can be in no window."""
        lo = self.lo.astype(np.float64)
        far = np.where(self.hi < self.lo, np.inf, np.where(lo <= 0, 0.0, lo / np.maximum(self.length, 1e-300)[:, None]))
        return float(far.min()) * (1 - 1e-9) if far.size else float("inf")

    def start(self) -> None:
        shape = (*self.lo.shape, self.k)
        self.score, self.id, self.null = np.full(shape, LEAST), np.full(shape, LAST), np.ones(shape, bool)
        self.need = self.lo.copy()  # the lower limit, or the k-th best so far

    def look(self, ids: np.ndarray, null: np.ndarray, labels: np.ndarray, v: np.ndarray, longest: float) -> None:
        """Takes in a block of candidates that are not longer than ``longest``."""
        alive = (self.need <= self.hi) & (self.need.astype(np.float64) <= (self.length * longest)[:, None] + 1e-6)
        for at in range(0, len(self.ids), GROUP):
            rows = at + np.flatnonzero(alive[at : at + GROUP].any(1))
            if not len(rows):
                continue
            s = (self.v[rows] @ v.T).astype(np.int64)
            fits = ((self.labels[rows][:, None] == labels) == self.same) & ((self.ids[rows][:, None] != ids) | null)
            for slot in range(self.lo.shape[1]):
                r, c = np.nonzero(fits & (s >= self.need[rows, slot][:, None]) & (s <= self.hi[rows, slot][:, None]))
                if len(r):
                    self.take(rows[r], slot, s[r, c], ids[c], null[c])

    def take(self, row: np.ndarray, slot: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        worst, last = self.score[row, slot, -1], self.id[row, slot, -1]
        better = (score > worst) | ((score == worst) & (ids <= last))
        row, score, ids, null = row[better], score[better], ids[better], null[better]
        old = np.unique(row)
        row = np.concatenate([np.repeat(old, self.k), row])
        score = np.concatenate([self.score[old, slot].ravel(), score])
        ids = np.concatenate([self.id[old, slot].ravel(), ids])
        null = np.concatenate([self.null[old, slot].ravel(), null])
        order = np.lexsort((null, ids, ~score, row))
        row, score, ids, null = row[order], score[order], ids[order], null[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        stay = place < self.k
        self.score[row[stay], slot, place[stay]] = score[stay]
        self.id[row[stay], slot, place[stay]] = ids[stay]
        self.null[row[stay], slot, place[stay]] = null[stay]
        self.need[old, slot] = np.maximum(self.lo[old, slot], self.score[old, slot, -1])

    def found(self) -> pa.RecordBatch:
        at, slot, place = np.nonzero(self.score > LEAST)
        ids = pa.array(self.id[at, slot, place], mask=self.null[at, slot, place])
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(slot.astype(np.int32)), ids, pa.array(self.score[at, slot, place])], ["at", "slot", "vec_id", "score"])


def searched(buckets: DataFrame, search: Search, dim: int, exact: type) -> DataFrame:
    """at, slot, rank, vec_id and score of the best in each window; only rows long enough for one are read."""
    shared = buckets.sparkSession.sparkContext.broadcast(search)

    def task(batches):
        own = shared.value
        own.start()
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, CHUNK):
                batch = whole_batch.slice(at, CHUNK)
                ids, null = ids_of(batch.column("vec_id"))
                own.look(ids, null, np.asarray(batch.column("label")), matrix(batch.column("x"), dim, exact), float(np.asarray(batch.column("length")).max()))
        yield own.found()

    found = buckets.where(F.col("length") >= search.least_length()).mapInArrow(task, "at int, slot int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("at", "slot").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= search.k)


def hard_negatives(vectors: DataFrame, k: int = K, every: int = ANCHOR_EVERY, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of vectors (vec_id, embedding, label)."""
    spark, result = vectors.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    n7 = F.coalesce(F.col("vec_id") % RELABEL_EVERY == 0, F.lit(False))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("label").isNotNull() & finite(F.col("v")))
    v = v.withColumn("label", F.when(n7, (F.col("label") + 1) % LABELS).otherwise(F.col("label")))
    about = v.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest"), F.count("*").alias("n")).first()
    if not about["n"]:
        return spark.createDataFrame([], result)
    dim, most = about["dim"], math.isqrt((1 << 62) // max(1, about["dim"]))
    x, peak = whole(F.col("v"), SCALE, float(most)), peak_of(about["largest"], SCALE, most)
    exact = np.float64 if dim * peak**2 < 1 << 53 else np.int64
    filled = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v")))
    rows = v.select("vec_id", "label", filled.cast(f"array<{width(peak)}>").alias("x"))
    rows = rows.withColumn("length", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))))
    parts = max(spark.sparkContext.defaultParallelism, -(-about["n"] // PER_BUCKET))
    order = [F.desc("length"), F.asc_nulls_last("vec_id")]
    buckets = kept(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order), "buckets")
    longest = buckets.orderBy(*order).limit(head).select("vec_id", "label", "x").toArrow()
    top = spark.sparkContext.broadcast((*ids_of(longest.column("vec_id").combine_chunks()), np.asarray(longest.column("label")), matrix(longest.column("x").combine_chunks(), dim, exact)))

    def bounded(batches):
        """Adds the k-th best score of an anchor's label among the longest rows: no positive is below it."""
        ids, null, labels, heads = top.value
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, GROUP):
                batch = whole_batch.slice(at, GROUP)
                s = (matrix(batch.column("x"), dim, exact) @ heads.T).astype(np.int64)
                s[(np.asarray(batch.column("label"))[:, None] != labels) | ((np.asarray(batch.column("vec_id"))[:, None] == ids) & ~null)] = LEAST
                low = np.partition(s, -k, 1)[:, -k] if k <= s.shape[1] else np.full(len(s), LEAST)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.maximum(low, LEAST + 1))], [*batch.schema.names, "low"])

    anchors = buckets.where(F.coalesce(F.col("vec_id") % every == 0, F.lit(False)))
    anchors = anchors.groupBy("vec_id", "label", "x").agg(F.count("*").alias("copies"))
    anchors = kept(anchors.mapInArrow(bounded, f"vec_id long, label long, x array<{width(peak)}>, copies long, low long"), "anchors")
    blocks = max(1, -(-anchors.count() // block))
    dealt = F.pmod(F.xxhash64("vec_id", "x", "label"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    out = []
    for b in range(blocks):  # each block is bounded, and nothing is shuffled for it but its best
        some = anchors.where(dealt == b).toArrow().sort_by([("vec_id", "ascending"), ("label", "ascending")]).combine_chunks()
        if not some.num_rows:
            continue
        ids, labels = (np.asarray(some.column(c), np.int64) for c in ("vec_id", "label"))
        own = matrix(some.column("x").combine_chunks(), dim, exact)
        low = np.asarray(some.column("low"), np.int64)[:, None]
        positives = searched(buckets, Search(ids, labels, own, low, np.full_like(low, LAST), True, k), dim, exact).toArrow().sort_by([("at", "ascending"), ("rank", "ascending")])
        if not positives.num_rows:
            continue
        # a window for each of an anchor's different positive scores
        at, score = np.asarray(positives.column("at"), np.int64), np.asarray(positives.column("score"), np.int64)
        fresh = np.cumsum((np.diff(at, prepend=-1) != 0) | (np.diff(score, prepend=0) != 0))
        slot = fresh - fresh[np.searchsorted(at, at)]
        lo, hi = np.full((len(ids), k), LAST), np.full((len(ids), k), LEAST)
        lo[at, slot] = [-(-4 * int(s) // 5) for s in score]
        hi[at, slot] = score
        best = searched(buckets, Search(ids, labels, own, lo, hi, False, k), dim, exact)
        windows = {"at": at.astype(np.int32), "slot": slot.astype(np.int32), "anchor_id": ids[at], "positive_id": positives.column("vec_id"), "positive_score": score, "copies": np.asarray(some.column("copies"), np.int64)[at]}
        windows = spark.createDataFrame(pa.table(windows))
        joined = best.select("at", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")).join(F.broadcast(windows), ["at", "slot"])  # k windows an anchor at most
        each = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        out.append(kept(each.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
    if not out:
        return spark.createDataFrame([], result)
    whole_result = out[0]
    for other in out[1:]:
        whole_result = whole_result.unionByName(other)
    return whole_result
