"""Near-duplicates are dropped where documents lie: no text is shuffled, and what was made on the way is deleted."""

import collections
import os

from pyspark.sql import functions as F


def test_no_text_is_shuffled_and_nothing_is_left(spark, tmp_path, monkeypatch):
    from docraster.llm import simhash

    monkeypatch.setattr(simhash, "SPAN", 64)  # several bitmaps a file
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(120))
    rows = [(i, text(i % 300), f"s{i}") for i in range(900)] + [(None, text(1), "z"), (4, text(4), "a"), (4, text(4), "s4")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3, "source").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    out = simhash.one_of_each(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    got = collections.Counter(tuple(r) for r in out.collect())
    assert got == collections.Counter([r for r in rows[:300] if r[0] != 4] + [(4, text(4), "a")])
    left = {d.rpartition("-")[0] for d in set(os.listdir(shared)) - before}
    assert left <= {"gone"}, left
    filtered = simhash.one_of_each(docs.where("doc_id >= 300").select("text", "doc_id", F.lit(1).alias("file")))
    assert {r["doc_id"] for r in filtered.collect()} == set(range(300, 600)) and filtered.columns == ["text", "doc_id", "file"]
    joined = docs.crossJoin(spark.range(2).select("id"))  # a row of the file is no row of this
    assert simhash.one_of_each(joined).count() == 300
