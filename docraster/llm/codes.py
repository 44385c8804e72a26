"""Compression of vectors to codes: four integer parts each, a codebook for each part position, weighted Lloyd rounds.

Equal integer parts of a position are one row with a weight (a map-side combined count), so what copies cost is
counted once: every round assigns the distinct parts in Arrow batches to the nearest entry and sums them by entry,
and only those sums, of at most ``ENTRIES`` entries, come to the driver. At the end codes and errors are joined back
to the vectors; a part that a large share of the vectors has is a hub, which is broadcast and meets nobody in one
task. Distances are whole numbers, exact in double or long arithmetic, so no result depends on an order.

Nulls: rows with a null vector, or null or non-finite components, are dropped. A null vec_id comes after all others,
a null label is a label of its own. Ties go to the smaller entry; of rows with one vec_id the smaller integer vector
comes first, and each repeated row is returned. Shorter vectors are filled up with zeros to the longest, and all to a
multiple of four. A component is held to +-sqrt(2^61 / dimension), beyond which an error would not fit into a long.
Fewer than ``ENTRIES`` rows make as many entries. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docraster.llm.shared import hub_join, kept

SCALE, PARTS, ENTRIES, ROUNDS, CHUNK = 1024, 4, 256, 4, 4096


def finite(vector: Column) -> Column:
    """True where a vector is there and all of its components are finite numbers."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def whole(vector: Column, scale: int, most: float) -> Column:
    """floor(scale * x) of each component of an array<double>, held to +-most."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x * float(scale)))))


def peak_of(largest: float | None, scale: int, most: int) -> int:
    """No whole component is larger than this."""
    return min(most, math.ceil(min((largest or 0.0) * scale, 2.0**62)) + 1)


def width(peak: int) -> str:
    return "smallint" if peak < 1 << 15 else "int" if peak < 1 << 31 else "bigint"


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray, exact: type) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row, the smaller if tied, and the squared distance to it; in a number type in which
    all of it is exact."""
    code, far = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    c = book.astype(exact)
    half = (c * c).sum(1)
    for at in range(0, len(x), CHUNK):
        part = x[at : at + CHUNK].astype(exact)
        d = half - 2 * (part @ c.T)
        own = d.argmin(1)
        code[at : at + CHUNK] = own
        far[at : at + CHUNK] = d[np.arange(len(part)), own] + (part * part).sum(1)
    return code, far


def by_position(batch: pa.RecordBatch, dim: int):
    """The rows of each part position in a batch, and their parts."""
    pos = np.asarray(batch.column("pos"))
    x = matrix(batch.column("part"), dim)
    for p in range(PARTS):
        at = np.flatnonzero(pos == p)
        if len(at):
            yield p, at, x[at]


def rounds_of(distinct: DataFrame, books: list[np.ndarray], rounds: int, dim: int, exact: type) -> list[np.ndarray]:
    """The codebooks after so many weighted Lloyd rounds over the distinct parts (pos, part, n)."""
    sc = distinct.sparkSession.sparkContext
    for _ in range(rounds):
        shared = sc.broadcast(books)

        def sums(batches):
            total = [np.zeros((len(b), dim), np.int64) for b in shared.value]
            count = [np.zeros(len(b), np.int64) for b in shared.value]
            for batch in batches:
                n = np.asarray(batch.column("n"), np.int64)
                for p, at, x in by_position(batch, dim):
                    code, _ = nearest(x, shared.value[p], exact)
                    np.add.at(total[p], code, x * n[at][:, None])
                    np.add.at(count[p], code, n[at])
            for p in range(PARTS):
                used = np.flatnonzero(count[p])
                if len(used):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[p][used]), pa.array(total[p][used].tolist(), pa.list_(pa.int64()))], ["pos", "code", "n", "total"])

        found = distinct.mapInArrow(sums, "pos int, code int, n long, total array<long>").select("pos", "code", "n", F.posexplode("total").alias("i", "s"))
        of = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
        new = [b.copy() for b in books]
        for r in found.groupBy("pos", "code", "i").agg(of("n"), of("s")).toLocalIterator():  # at most a row per entry and component
            new[r["pos"]][r["code"], r["i"]] = int(r["s"]) // int(r["n"])
        shared.destroy()
        books = new
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for entry in book.tolist() for c in entry).encode()).hexdigest()


def compressed(vectors: DataFrame, scale: int = SCALE, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (two hex digits a part) and error of each row of vectors (vec_id, embedding, label) that
    takes part; and the codebooks. ``entries`` is 256 at most."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    v = v.where(finite(F.col("v")))
    longest, largest = v.agg(F.max(F.size("v")), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if longest is None:
        return v.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), [np.zeros((0, 0), np.int64)] * PARTS
    dim = -(-longest // PARTS)
    most = math.isqrt((1 << 61) // max(1, PARTS * dim))
    x, peak = whole(F.col("v"), scale, float(most)), peak_of(largest, scale, most)
    exact = np.float64 if PARTS * dim * (2 * peak) ** 2 < 1 << 53 else np.int64
    zero = F.array_repeat(F.lit(0).cast("long"), F.lit(PARTS * dim) - F.size("v"))
    whole_rows = v.select("vec_id", "label", F.concat(x, zero).cast(f"array<{width(peak)}>").alias("x"))
    first = whole_rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), PARTS * dim)
    books = [start[:, p * dim : (p + 1) * dim].copy() for p in range(PARTS)]

    cut = F.array(*(F.slice("x", p * dim + 1, dim) for p in range(PARTS)))
    rows = whole_rows.select("vec_id", "label", F.xxhash64("x").alias("h"), F.posexplode(cut).alias("pos", "part"))
    distinct = kept(rows.groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    books = rounds_of(distinct, books, rounds, dim, exact)
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def encode(batches):
        for batch in batches:
            code, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, at, own in by_position(batch, dim):
                code[at], far[at] = nearest(own, shared.value[p], exact)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(far)], [*batch.schema.names, "code", "far"])

    coded = kept(distinct.mapInArrow(encode, f"pos int, part array<{width(peak)}>, n long, code int, far long"), "coded")
    # rows equal in id, label and vector have one result, so they are put together again by these, and counted
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == p, F.col("code"))))), 2, "0") for p in range(PARTS)]
    found = hub_join(rows, coded, ["pos", "part"]).groupBy("vec_id", "label", "h").agg(F.concat(*digits).alias("code"), F.sum("far").alias("all"), F.count_if(F.col("pos") == 0).alias("copies"))
    each = found.select("vec_id", "label", "code", F.expr("all div copies").alias("error"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.drop("copy"), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """vec_id, code, error and label_error: the sum of the errors of all rows with the row's label."""
    of = [F.col("label").isNull().alias("unlabelled"), F.coalesce("label", F.lit(0)).alias("known")]
    rows = kept(coded.select("vec_id", "code", "error", *of), "codes")
    sums = kept(rows.groupBy("unlabelled", "known").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n")), "label-errors")
    return hub_join(rows, sums, ["unlabelled", "known"]).select("vec_id", "code", "error", F.expr("try_cast(total AS bigint)").alias("label_error"))
