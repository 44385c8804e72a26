"""Page sessions: an ordered list of pages per session, changed by an operation log.

Single operations are joins and projections on the pages table (session_id, entry_id, pos, name, selected, ...).
A whole log is folded in one pass over rows that Spark deals by session and sorts: later operations depend on the order
that earlier ones left, which no aggregate expresses. Of a session only its live pages are held, never its log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def append(pages: DataFrame, new: DataFrame, key: str = "session_id") -> DataFrame:
    """New pages (with seq, their order) after the last of their session."""
    last = pages.groupBy(key).agg((F.max("pos") + 1).alias("next"))
    rank = F.row_number().over(W.partitionBy(key).orderBy("seq")) - 1
    placed = new.join(last, key, "left").withColumn("pos", F.coalesce("next", F.lit(0)) + rank).drop("next", "seq")
    return pages.unionByName(placed, allowMissingColumns=True)


def move(pages: DataFrame, entry_id: str, distance: int, key: str = "session_id") -> DataFrame:
    """Swaps an entry with that ``distance`` places on; nothing changes if either is not there."""
    at = pages.where(F.col("entry_id") == entry_id).groupBy(key).agg(F.min("pos").alias("_i"))
    there = pages.join(at, key).where(F.col("pos") == F.col("_i") + distance).groupBy(key).agg(F.first("_i").alias("_i"))
    out = pages.join(there, key, "left")
    i, j = F.col("_i"), F.col("_i") + distance
    return out.withColumn("pos", F.when(F.col("pos") == i, j).when(F.col("pos") == j, i).otherwise(F.col("pos"))).drop("_i")


def select_all(pages: DataFrame, selected: bool = True) -> DataFrame:
    return pages.withColumn("selected", F.lit(selected))


def select_positions(pages: DataFrame, positions: list[int]) -> DataFrame:
    return pages.withColumn("selected", F.col("pos").isin(positions) if positions else F.lit(False))


def remove_selected(pages: DataFrame, key: str = "session_id") -> DataFrame:
    """What is left, numbered anew in each session."""
    return renumbered(pages.where(~F.col("selected")), key)


def renumbered(pages: DataFrame, key: str = "session_id") -> DataFrame:
    return pages.withColumn("pos", (F.row_number().over(W.partitionBy(key).orderBy("pos")) - 1).cast("long"))


def in_scope(pages: DataFrame, selected_only: bool) -> DataFrame:
    return pages.where("selected") if selected_only else pages


def replace(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Replaces images of known entries in place; place, id and selection stay.

    changes: entry_id, original, and optionally current (the original by default) and name (kept if blank).
    """
    has = set(changes.columns)
    c = changes.select("entry_id", F.col("original").alias("_original"), (F.coalesce("current", "original") if "current" in has else F.col("original")).alias("_current"), (F.nullif(F.trim("name"), F.lit("")) if "name" in has else F.lit(None).cast("string")).alias("_name"))
    out = pages.join(c, "entry_id", "left")
    return out.withColumns({"original": F.coalesce("_original", "original"), "current": F.coalesce("_current", "current"), "name": F.coalesce("_name", "name")}).drop("_original", "_current", "_name")


def replace_from_file(pages: DataFrame, entry_id: str, path: str) -> DataFrame:
    """Replaces an entry's images by those of a file of any codec, and its name by the file's; a file that cannot be read, or
    an entry that is not there, stops the run."""
    from docraster.sources import files

    spark = pages.sparkSession
    if not pages.where(F.col("entry_id") == entry_id).take(1):
        raise KeyError(f"No such page: {entry_id}")
    listed = files.checked_list(spark, [path])
    new = files.stopping(files.read_pages(spark, listed, [path])).orderBy("page_seq").limit(1)
    return replace(pages, new.select(F.lit(entry_id).alias("entry_id"), F.col("image").alias("original"), "name"))


def export_paths(pages: DataFrame, selected_only: bool = False) -> DataFrame:
    """page_seq and path of the files that an export reads: a projection that touches no pixels."""
    own = in_scope(pages, selected_only)
    return own.select(F.row_number().over(W.partitionBy("session_id").orderBy("pos")).alias("page_seq"), "session_id", "path")


def apply_postprocess(pages: DataFrame, fn: Column) -> DataFrame:
    """current becomes a function of original, for all pages."""
    return pages.withColumn("current", fn)


def reviewed(pages: DataFrame, fn: Column, all_pages: bool = False) -> DataFrame:
    """current becomes a function of original, for all pages or for those selected."""
    return pages.withColumn("current", fn if all_pages else F.when(F.col("selected"), fn).otherwise(F.col("current")))


def before_and_after(pages: DataFrame, fn: Column) -> DataFrame:
    """Both sides of a review: the original, and what the function would make of it."""
    return pages.withColumns({"before": F.col("original"), "after": fn})


def removed_counts(pages: DataFrame, key: str = "session_id") -> DataFrame:
    """How many entries removing the selected ones takes from each session."""
    return pages.groupBy(key).agg(F.count_if(F.col("selected")).alias("removed"))


def cleared(pages: DataFrame, sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """Pages without those of some sessions."""
    return pages.join(sessions.select(key).distinct(), key, "left_anti")


STATE = "session_id long, entry_id string, pos long, name string, selected boolean"


class Fold:
    """The pages of one session, changed by one operation at a time."""

    def __init__(self, session_id: int | None, rows: list[list] | None = None):
        self.session_id, self.rows = session_id, rows or []

    def apply(self, op_seq: int, op: str, arg: int) -> None:
        rows = self.rows
        if op == "add":
            rows.append([f"{self.session_id}-{op_seq}", f"page {op_seq}", False])
        elif not rows:
            return
        elif op == "select":
            rows[arg % len(rows)][2] = not rows[arg % len(rows)][2]
        elif op == "move":
            i = op_seq % len(rows)
            j = i + (arg % 5 - 2)
            if 0 <= j < len(rows):
                rows[i], rows[j] = rows[j], rows[i]
        elif op == "remove_selected":
            self.rows = [r for r in rows if not r[2]]
        elif op == "replace":
            rows[arg % len(rows)][1] = f"page {op_seq}"

    def pages(self) -> list[tuple]:
        return [(self.session_id, e, i, n, s) for i, (e, n, s) in enumerate(self.rows)]


def folded(log: DataFrame) -> DataFrame:
    """The pages that each session's log (session_id, op_seq, op, arg) leaves. Without a session_id operations are a session
    of their own; those with one number are applied by their op and arg."""
    import pyarrow as pa

    fields = ["session_id", "entry_id", "pos", "name", "selected"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], fields)

    def task(batches):
        now, done = None, []
        for b in batches:
            for session, seq, op, arg in zip(*(b.column(c).to_pylist() for c in ("session_id", "op_seq", "op", "arg"))):
                if now is None or now.session_id != session:
                    done += now.pages() if now else []
                    now = Fold(session)
                    if len(done) > 8192:
                        yield batch(done)
                        done = []
                now.apply(seq, op, arg)
        done += now.pages() if now else []
        if done:
            yield batch(done)

    columns = log.select("session_id", "op_seq", "op", "arg")
    return columns.repartition("session_id").sortWithinPartitions("session_id", "op_seq", "op", "arg").mapInArrow(task, STATE)
