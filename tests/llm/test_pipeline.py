"""The pipeline's stages on null, empty, very long and repeated rows, on empty tables and on clashing columns."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

CLASH = ["score", "lang_pred", "quality_score", "strangeness", "row", "d", "fp", "id", "component", "n", "t1", "t2", "first", "w", "Lang_Score", "a.b", "piece", "n_words"]
GOOD = "The river ran past the old mill, and the children played there in the long summer evenings. "
LONG = " ".join(f"{w} river {i % 977} and the mill" for i, w in enumerate(["old", "long", "summer"] * 30_000))
BENCH = "seven grey ships sailed out of the quiet harbour before the morning bell had rung twice"


def texts():
    out = [(None, GOOD * 2), (900, None), (901, ""), (902, " \n "), (903, LONG), (904, "1234 ..."), (905, BENCH + " today"), (906, "qzxv wkjh zzqx bvnm qwrt plkj hgfd xcvq " * 12)]
    for i in range(160):
        words = (GOOD + f"Chapter {i} tells of number {i * i} and its {i % 7} friends who lived by the water. ") * (1 + i % 3)
        out.append((i, words if i % 4 else words.upper().replace(" ", " ### $$ ")))
    return out + [(5, out[13][1]), (5, out[13][1]), (777, out[14][1])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame([(i, t, "en" if t else None, "s", len(t or "")) for i, t in texts()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumns({c: F.lit("mine") for c in CLASH}).repartition(5).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, BENCH), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_keep_rows_as_they_are(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    whole = collections.Counter(tuple(r) for r in docs.collect())
    gone = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        left = collections.Counter(tuple(r) for r in out.collect())
        assert not left - whole, name  # byte for byte, clashing columns too
        gone[name] = {r[0] for r in whole - left}
        again = collections.Counter(tuple(r) for r in stage(spark, docs.repartition(3, "doc_id"), folder).collect())
        assert again == left, name  # the same rows however they are dealt
        empty = stage(spark, docs.where("false"), folder)
        assert empty.columns == docs.columns and empty.collect() == []
    good = set(range(0, 160)) - set(range(0, 160, 4))
    assert {900, 901, 902, 904, 906} <= gone["language"] and not gone["language"] & good
    assert set(range(0, 160, 4)) <= gone["quality"] and not gone["quality"] & good
    assert gone["decontamination"] == {905}
    assert 5 in gone["near-duplicates"] and 903 not in gone["near-duplicates"]


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    kept = {r["doc_id"] for r in rows}
    assert not kept & {900, 901, 902, 904, 905, 906} and not kept & set(range(0, 160, 4))
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows)
    whole = collections.Counter()
    for r in rows:
        whole[r["sequence_id"]] += r["length"]
    assert rows and max(whole.values()) <= 2048


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
