"""Each operator on null, empty, very long, repeated and tied rows, on empty tables and on clashing extra columns."""

import collections

import pytest
from pyspark.sql import functions as F

from docraster.llm.queries import vocabulary

LONG = " ".join(f"word{i % 977} and" for i in range(40_000))
TEXTS = [(None, None), (1, None), (2, ""), (3, " \t\n "), (4, "Hello hello world again and again"), (5, "Hello hello world again and again"), (5, "Hello hello world again and again"), (None, "a b c d"), (6, LONG), (7, "été Ünïcode — “quotes”  x"), (8, "1234 5678 ..."), (9, "The quick brown fox jumps")]
CLASH = ["score", "predicted", "row", "w", "found", "d", "n_words", "part", "rank", "length", "fp", "component_id", "lang_pred", "quality_score", "bucket", "body", "n", "key"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(d, t, "en" if t and "Hello" in t else None, "s", len(t or "")) for d, t in TEXTS], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, d % 2, (d + 1) % 2) for d in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def ids(rows):
    return collections.Counter(r["doc_id"] for r in rows)


EXPECTED = collections.Counter(d for d, _ in TEXTS)


def test_language_model(docs, empty):
    from docraster.llm.kneser_ney import scored_documents

    rows = scored_documents(docs).collect()
    assert ids(rows) == EXPECTED
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[1]["n_tokens"] == 1
    assert by[6]["n_tokens"] == 80_001
    assert all(r["score"] < 0 for r in rows)
    assert scored_documents(empty).collect() == []


def test_untrained_language_model_is_uniform(docs, empty):
    from docraster.llm.kneser_ney import score, train

    rows = score(docs, train(empty)).collect()
    assert ids(rows) == EXPECTED and all(r["score"] == 0.0 and r["train_tokens"] == 0 for r in rows)


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_classifiers(docs, empty, labels, name):
    import importlib

    op = importlib.import_module(f"docraster.llm.{name}").scored_documents
    for known in (labels, labels.where("false"), labels.where("quality = 1")):
        rows = op(docs, known).collect()
        assert ids(rows) == EXPECTED
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert op(empty, labels).collect() == []


def test_language(docs, empty):
    from docraster.llm.language import VOCABULARY, predicted_documents

    rows = predicted_documents(docs, vocabulary(VOCABULARY)).collect()
    assert ids(rows) == EXPECTED
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows if r["doc_id"]}
    assert said[1] == said[2] == said[3] == said[8] == ("und", 0.0)
    assert said[4][0] == "en" and said[6][0] == "en"
    assert predicted_documents(empty, vocabulary(VOCABULARY)).collect() == []
    nothing = predicted_documents(docs.withColumn("lang", F.lit(None).cast("string")), vocabulary(VOCABULARY)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_near_duplicates(docs, empty):
    from docraster.llm.simhash import near_duplicates, one_of_each

    rows = near_duplicates(docs).collect()
    assert ids(rows) == EXPECTED
    by = {r["doc_id"]: r for r in rows if r["doc_id"]}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 16
    assert by[3]["component_id"] == 1 and by[5]["component_id"] == 4
    assert near_duplicates(empty).collect() == []
    left = one_of_each(docs)
    assert left.columns == docs.columns
    assert ids(left.collect()) == collections.Counter([1, 4, None, 6, 7, 8, 9])
    assert one_of_each(empty).collect() == []


def test_packing(docs, empty):
    from docraster.llm.packing import packed_pieces

    rows = packed_pieces(docs, vocabulary("byte_bpe_50k.json")).collect()
    assert set(ids(rows)) == set(EXPECTED)
    whole = collections.defaultdict(list)
    for r in rows:
        whole[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in whole.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert [r["length"] for r in rows if r["doc_id"] == 2] == [1]
    assert packed_pieces(empty, vocabulary("byte_bpe_50k.json")).collect() == []


def test_decontamination(spark, docs, empty):
    from docraster.llm.decontaminate import contamination, without_contaminated

    items = spark.createDataFrame([(1, "hello HELLO world"), (2, None), (None, "quick brown"), (3, "  "), (2, "hello hello world")], "item_id long, text string")
    for at_once in (100, 1):  # in one pass, and in several
        rows = contamination(docs, items, at_once=at_once).collect()
        assert ids(rows) == EXPECTED
        by = {r["doc_id"]: r for r in rows if r["doc_id"]}
        assert (by[4]["n_words"], by[4]["n_hit"], by[4]["n_items"], by[4]["contaminated"]) == (6, 3, 2, True)
        assert by[4]["items"] == ["1", "2"] and [tuple(s) for s in by[4]["spans"]] == [(0, 3)]
        assert (by[9]["n_hit"], by[9]["n_items"], by[9]["contaminated"]) == (2, 0, True)
        assert by[2]["n_words"] == 0 and not by[2]["contaminated"]
        left = without_contaminated(docs, items, at_once=at_once)
        assert left.columns == docs.columns
        assert ids(left.collect()) == EXPECTED - collections.Counter([4, 5, 5, 9])
    assert contamination(empty, items).collect() == []
    assert not any(r["contaminated"] for r in contamination(docs, items.where("false")).collect())


def test_archives(spark):
    from docraster.llm.warc import round_trip

    rows = [(None, None, None), (1, None, None), (2, "http://a/\r\nX: y", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (4, "http://c", ""), (5, "http://d", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit(1), "keeper": F.lit(1), "n": F.lit(1)})
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in round_trip(pages).collect()}
    assert got == {(None, "revisit", 4, 0), (1, "revisit", 4, 0), (4, "response", None, 0), (2, "revisit", 3, 9), (3, "response", None, 9), (5, "response", None, 3_000_000)}
    assert round_trip(pages).count() == len(rows)
    assert {r["record_type"] for r in round_trip(pages, at_least=10**9).collect()} == {"response"}
    assert round_trip(pages.where("false")).collect() == []


def test_reputation(spark):
    from docraster.llm.queries import URL_RULES
    from docraster.llm.reputation import judged

    pages = spark.createDataFrame([(None, None), (1, "no scheme"), (2, "http://X.Example.COM/en/700?q"), (3, "http://example.com/en/8"), (3, "http://example.com/en/8"), (4, "http://a.example.net/de/88#f"), (5, "http://a.example.net/de/9"), (6, "http://?x://y/"), (7, "ftp://org/es/")], "page_id long, url string")
    outcomes = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "page_id long, bad int")
    for known in (outcomes, outcomes.where("false")):
        rows = judged(pages.withColumns({c: F.lit("x") for c in ("host", "n", "bad", "rate", "verdict")}), known, URL_RULES).collect()
        assert len(rows) == 9
        by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in rows}
        assert by[None][:3] == ("", "", None) and by[1][:3] == ("", "", None) and by[6][:3] == ("", "", None)
        assert by[2] == ("x.example.com", "/en/700", "example.com/en/7", "allow")
        assert by[3][2:] == ("com/en/", "block") and by[4][2:] == ("example.net/de/8", "block")
        assert by[5][2:] == ("net/de/", "allow") and by[7][2:] == ("org/es/", "block")
    assert judged(pages.where("false"), outcomes, URL_RULES).collect() == []


def test_neighbours(spark):
    from docraster.llm.neighbours import neighbours

    v = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, []), (9, [float("inf"), 0.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("list", "rank", "v", "place", "floor")})
    rows = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours(df).collect())
    assert rows == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert neighbours(df.where("false")).collect() == []
