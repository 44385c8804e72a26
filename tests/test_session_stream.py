"""Sessions with state: any arrival order ends where the batch fold ends; late operations are counted and told."""

import random

import pytest

from docraster.operators import session
from docraster.streaming.sessions import session_stream

SCHEMA = "session_id long, op_seq long, op string, arg int"


def log_of(sessions=3, n=14):
    rng = random.Random(6)
    return [(s, i, rng.choice(["add", "add", "select", "move", "remove_selected", "replace"]), rng.randrange(9)) for s in range(sessions) for i in range(n)]


def run(spark, tmp_path, batches, name, **options):
    src = str(tmp_path / name)
    for rows, schema in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(batches[0][1]).option("maxFilesPerTrigger", 1).parquet(src)
    q = session_stream(stream, **options).writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None
    q.stop()
    return spark.sql(f"select * from {name}").collect()


def last_of(rows):
    """The pages of each session at its last version."""
    top = {}
    for r in rows:
        top[r["session_id"]] = max(top.get(r["session_id"], -1), r["version"])
    return {(r["session_id"], r["entry_id"], r["pos"], r["name"], r["selected"]) for r in rows if r["entry_id"] is not None and r["version"] == top[r["session_id"]]}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_ends_alike(spark, tmp_path, seed):
    log = log_of()
    mixed = log[:]
    random.Random(seed).shuffle(mixed)
    rows = run(spark, tmp_path, [(mixed[i : i + 15], SCHEMA) for i in range(0, len(mixed), 15)], f"mixed{seed}")
    assert last_of(rows) == {tuple(r) for r in session.folded(spark.createDataFrame(log, SCHEMA)).collect()}
    assert max(r["held"] or 0 for r in rows) > 0 and all(r["late"] == 0 for r in rows)


def test_a_gap_is_given_up_and_what_was_missing_is_late(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    timed = SCHEMA + ", at timestamp"
    batches = [[(1, 0, "add", 0, at(0)), (1, 2, "add", 0, at(0))], [(1, 3, "add", 0, at(1))], [(2, 0, "add", 0, at(30))], [(2, 1, "add", 0, at(31))], [(1, 1, "remove_selected", 0, at(31)), (1, 4, "select", 0, at(32))]]
    rows = run(spark, tmp_path, [(b, timed) for b in batches], "gap", at="at", patience="10 minutes")
    assert [(r["late_op_seq"], r["late"]) for r in rows if r["late_op_seq"] is not None] == [(1, 1)]
    log = [b[:4] for rows_ in batches for b in rows_ if b[:2] != (1, 1)]
    assert last_of(rows) == {tuple(r) for r in session.folded(spark.createDataFrame(log, SCHEMA)).collect()}
    assert [r["held"] for r in rows if r["session_id"] == 1][0] == 1


def test_fold_of_little(spark):
    log = spark.createDataFrame([(None, 1, "add", 0), (None, 0, "add", 0), (5, 3, "select", 2), (5, 4, "add", 1), (5, 4, "add", 1)], SCHEMA)
    got = {(r["session_id"], r["entry_id"], r["pos"]) for r in session.folded(log).collect()}
    assert got == {(None, "None-0", 0), (None, "None-1", 1), (5, "5-4", 0), (5, "5-4", 1)}
    assert session.folded(log.where("false")).collect() == []
