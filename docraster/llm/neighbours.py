"""Approximate nearest neighbours by largest inner product: inverted lists scanned dimension by dimension.

With one more component, sqrt(M^2 - |x|^2) for the largest norm M, the largest inner product is the smallest
Euclidean distance. The longer vectors are rotated at random, so that the distance over the first d of D components
estimates the whole: a candidate is abandoned as soon as sqrt(D / d) times its partial distance exceeds
1 + e / sqrt(d) times the query's distance to its k-th best so far (a hypothesis test: of candidates exactly at that
distance about one in 10,000 is abandoned, of nearer ones fewer). A query's nearest list is searched first, and its k-th best there is the first bound in all others.
Vectors are dealt to lists around centroids that are fitted on a bounded sample; a query probes the lists nearest
to it, as many as find ``recall`` of the sample's own nearest on average (half of all lists where vectors have no
structure, a few where they cluster), and on from there until they hold k others, so that no query gets fewer than
there are. What is not abandoned is scored exactly, in double precision on the vectors as given.

Lists have about ``per_list`` vectors up to ``MOST_LISTS`` of them; a list with more vectors or queries than a task
should hold is split into blocks of either, so copies of one vector cannot fill a task. Each block hands on a
query's k best at most, and the last step ranks those.

Nulls: rows with a null id, a null or zero vector, null or non-finite components, or a length other than the most
frequent one (the larger, if tied) take no part. Components of any size do: distances are taken of scaled vectors, and
scores that a double cannot hold are infinite and tie. Ties go to the smaller vec_id; repeated ids are candidates of their
own. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docraster.llm.shared import kept

K, QUERY_EVERY = 20, 20
SAMPLE, PER_LIST, MOST_LISTS, RECALL = 20_000, 1_000, 4_096, 0.96
BLOCK, EPSILON, COLUMNS, CHUNK = 4_000, 2.1, 16, 512
#: Norms are compared as their parts by this, since a norm of finite components may be beyond a double.
TINY = 2.0**64
LEAST = np.finfo(np.float64).min


def matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def usable(vectors: DataFrame) -> tuple[DataFrame, dict]:
    """vec_id and v (array<double>) of the rows that take part; their number, dimension, and largest norm times ``scale``,
    which is 1 but where squares of components would overflow."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    v = v.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0))
    most = F.array_max(F.transform("v", F.abs))
    part = most / TINY * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    sizes = v.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(part).alias("part")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return v, {"dim": 0, "n": 0, "norm": 0.0, "scale": 1.0}
    scale = 1.0 if sizes["part"] < 1e150 / TINY else 2.0 ** -np.ceil(np.log2(sizes["part"])) / TINY
    return v.where(F.size("v") == sizes["dim"]), {"dim": sizes["dim"], "n": sizes["n"], "norm": float(sizes["part"] * (TINY * scale)), "scale": float(scale)}


class Space:
    """The rotated space of dimension dim + 1, and the centroids in it. Vectors come as given and enter times ``scale``."""

    def __init__(self, dim: int, norm: float, sample: np.ndarray, lists: int, seed: int = 7, rounds: int = 8, scale: float = 1.0):
        rng = np.random.default_rng(seed)
        self.norm, self.scale = norm, scale
        self.rotation = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0]
        x = self.vectors(sample).astype(np.float32)
        c = x[rng.permutation(len(x))[:lists]]
        for _ in range(rounds):
            own = self.nearest(x, c, 1)[:, 0]
            n = np.bincount(own, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(c))])
        self.centroids = c

    def probes_for(self, sample: np.ndarray, k: int, recall: float, asked: int = 300) -> int:
        """How many lists to probe, so that this share of the sample's own k nearest is met on average."""
        step = max(1, len(sample) // asked)
        q = sample[::step]
        own = self.nearest(self.vectors(sample).astype(np.float32), self.centroids, 1)[:, 0]
        c = self.centroids
        place = np.argsort(np.argsort((c * c).sum(1) / 2 - self.queries(q).astype(np.float32) @ c.T, 1), 1)
        k = min(k, len(sample) - 1)
        if not k:
            return len(c)
        sample = sample * self.scale
        q = sample[::step]
        best = []
        for rows in np.array_split(np.arange(len(q)), max(1, len(q) // 50)):
            near = -(q[rows] @ sample.T)
            near[np.arange(len(rows)), rows * step] = np.inf  # not itself
            best.append(np.argpartition(near, k - 1, axis=1)[:, :k])
        best = np.concatenate(best)
        needed = np.sort(np.take_along_axis(place, own[best], 1).ravel())
        return min(len(c), int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1)

    def vectors(self, v: np.ndarray) -> np.ndarray:
        v = v * self.scale
        rest = np.sqrt(np.maximum(self.norm**2 - (v * v).sum(1), 0))
        return np.column_stack([v, rest]) @ self.rotation

    def queries(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v * self.scale, np.zeros(len(v))]) @ self.rotation

    @staticmethod
    def nearest(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        """The n nearest centroids of each row, nearest first."""
        out, half = [], (c * c).sum(1) / 2
        for part in np.array_split(x, max(1, len(x) // 2000)):
            far = half - part @ c.T
            out.append(far.argmin(1)[:, None] if n == 1 else np.argsort(far, axis=1)[:, :n])
        return np.concatenate(out)


def scan(ids: np.ndarray, v: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, y: np.ndarray, floor: np.ndarray, k: int, norm: float, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query in one block: (query row, vec_id, score).

    v and q are the vectors as given, x and y the rotated ones; floor is the score of a query's k-th best so far.
    Candidates come a chunk at a time and column block by column block: for all pairs while many are left, then
    for those alone that no test has abandoned.
    """
    dims, y_norms = x.shape[1], (y * y).sum(1)
    scaled = lambda s: np.where(np.isneginf(s), s, np.nan_to_num(s, nan=LEAST, posinf=-LEAST) * scale * scale)
    limit = y_norms + norm**2 - 2 * scaled(floor)  # squared distance = |y|^2 + M^2 - 2 <q, v>
    slack = 1e-9 * (1 + norm**2 + y_norms)
    rows, names, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for at in range(0, len(ids), CHUNK):
        part = slice(at, at + CHUNK)
        c_ids, c = ids[part], x[part]
        far = np.where(q_ids[:, None] == c_ids, np.inf, 0.0)
        pairs = None
        for d in range(0, dims, COLUMNS):
            e = min(d + COLUMNS, dims)
            yb, cb = y[:, d:e], c[:, d:e]
            if pairs is None:
                far += (yb * yb).sum(1)[:, None] + (cb * cb).sum(1) - 2 * yb @ cb.T
            else:
                gap = yb[pairs[0]] - cb[pairs[1]]
                far = far + np.einsum("ij,ij->i", gap, gap)
            test = (1 + EPSILON / np.sqrt(e)) ** 2 * e / dims if e < dims else 1.0
            if pairs is None:
                stay = (far <= (limit * test + slack)[:, None]) & (far < np.inf)
                if np.count_nonzero(stay) * 20 < stay.size or e == dims:
                    pairs = np.nonzero(stay)
                    far = far[pairs]
            else:
                stay = far <= (limit * test + slack)[pairs[0]]
                pairs, far = (pairs[0][stay], pairs[1][stay]), far[stay]
        open_rows = np.flatnonzero(np.isinf(limit))
        if len(open_rows) and len(pairs[0]):  # no bound yet: only what is among the chunk's own k nearest, ties included
            order = np.lexsort((far, pairs[0]))
            qi, far_in_order = pairs[0][order], far[order]
            first = np.searchsorted(qi, np.arange(len(q)))
            last = np.minimum(first + k - 1, np.searchsorted(qi, np.arange(len(q)), "right") - 1)
            bound = np.where(last >= first, far_in_order[np.clip(last, 0, len(qi) - 1)], np.inf)
            keep = far <= np.where(np.isinf(limit), bound + slack, np.inf)[pairs[0]]
            pairs = (pairs[0][keep], pairs[1][keep])
        qi, ci = pairs
        if not len(qi):
            continue
        rows, names = np.concatenate([rows, qi]), np.concatenate([names, c_ids[ci]])
        scores = np.concatenate([scores, (q[qi] * v[part][ci]).sum(1)])
        order = np.lexsort((names, -scores, rows))
        rows, names, scores = rows[order], names[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        stay = place < k
        full = place == k - 1
        limit[rows[full]] = np.minimum(limit[rows[full]], y_norms[rows[full]] + norm**2 - 2 * scaled(scores[full]))
        rows, names, scores = rows[stay], names[stay], scores[stay]
    return rows, names, scores


def neighbours(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, recall: float = RECALL, sample: int = SAMPLE, per_list: int = PER_LIST) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of each row whose vec_id is divisible by ``query_every``."""
    out_schema = "query_id long, vec_id long, score double"
    v, about = usable(vectors)
    if not about["n"]:
        return v.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    u = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(1 << 30)) / float(1 << 30)
    fitted = v.where(u < min(1.0, sample / about["n"])).select("v").limit(2 * sample).toArrow()
    rows = matrix(fitted.column(0).combine_chunks()) if fitted.num_rows else np.zeros((0, about["dim"]))
    if not len(rows):
        rows = np.eye(1, about["dim"])
    lists = max(1, min(MOST_LISTS, about["n"] // per_list, len(rows)))
    fitted_space = Space(about["dim"], about["norm"], rows, lists, scale=about["scale"])
    probes = fitted_space.probes_for(rows, k, recall)
    space = v.sparkSession.sparkContext.broadcast(fitted_space)

    def deal(batches):
        s = space.value
        for batch in batches:
            if batch.num_rows:
                own = s.nearest(s.vectors(matrix(batch.column("v"))).astype(np.float32), s.centroids, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(own.astype(np.int32))], ["vec_id", "v", "list"])

    dealt = kept(v.mapInArrow(deal, "vec_id long, v array<double>, list int"), "lists")
    counts = dealt.groupBy("list").agg(F.count("*").alias("n"))
    held = np.zeros(len(fitted_space.centroids), np.int64)
    for r in counts.collect():  # at most MOST_LISTS
        held[r["list"]] = r["n"]

    def probe(batches):
        s = space.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1_000):
                batch = whole.slice(start, 1_000)
                near = s.nearest(s.queries(matrix(batch.column("v"))).astype(np.float32), s.centroids, len(s.centroids))
                # on to further lists until they hold k others: a query's own id, however often it occurs, is none
                others = np.cumsum(held[near], 1) - np.asarray(batch.column("same"))[:, None]
                wanted = np.maximum(probes, (others < k).sum(1) + 1)
                at, place = (x.astype(np.int32) for x in np.nonzero(np.arange(near.shape[1]) < wanted[:, None]))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(near[at, place].astype(np.int32)), pa.array(place)], ["vec_id", "v", "list", "place"])

    questions = v.where(F.pmod("vec_id", F.lit(query_every)) == 0)
    repeated = questions.groupBy("vec_id").agg(F.count("*").alias("same")).where("same > 1")
    questions = questions.join(repeated, "vec_id", "left").select("vec_id", "v", F.coalesce("same", F.lit(1)).alias("same"))
    asked = kept(questions.mapInArrow(probe, "vec_id long, v array<double>, list int, place int"), "queries")
    keys = ["list", "block", "ask"]

    def search(found, wanted):
        if not found.num_rows or not wanted.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        s = space.value
        ids, q_ids = (np.asarray(t.column("vec_id").combine_chunks(), np.int64) for t in (found, wanted))
        own, q = (matrix(t.column("v").combine_chunks()) for t in (found, wanted))
        floor = np.asarray(wanted.column("floor").combine_chunks(), np.float64)
        qi, best, score = scan(ids, own, s.vectors(own), q_ids, q, s.queries(q), floor, k, s.norm, s.scale)
        return pa.table({"query_id": pa.array(q_ids[qi]), "vec_id": pa.array(best), "score": pa.array(score)})

    def searched(questions: DataFrame) -> DataFrame:
        """The best of each question's list, block by block: at most BLOCK vectors and questions meet in a task."""
        sizes = counts.join(questions.groupBy("list").agg(F.count("*").alias("m")), "list")
        sizes = F.broadcast(kept(sizes.select("list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("m") / BLOCK).cast("int").alias("asks")), "sizes"))
        salt = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = dealt.join(sizes, "list").withColumn("block", salt("blocks", 1)).withColumn("ask", every("asks")).select(*keys, "vec_id", "v")
        right = questions.join(sizes, "list").withColumn("ask", salt("asks", 2)).withColumn("block", every("blocks")).select(*keys, "vec_id", "v", "floor")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, out_schema)

    near = kept(searched(asked.where("place = 0").withColumn("floor", F.lit(float("-inf")))), "near")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    floors = near.withColumn("place", place).where(F.col("place") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    others = asked.where("place > 0").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    ranked = near.union(searched(kept(others, "others"))).withColumn("rank", place)
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
