"""From raw documents to packed training sequences.

Language ID, quality, near-duplicates, decontamination and packing, in this order. Each stage reads what its
predecessor kept (written as Parquet), learns what it must from that and from the tables beside it, and returns
whole documents; the last one returns the pieces of the packed sequences. Columns pass the scores by as one
struct, so every column, whatever it is called, comes out as it went in.

Nulls and empty texts have no letter, so the language stage rejects them, as it does texts of junk or of no learnt
language. A null lang, source or doc_id decides nothing; of repeated rows one stays. Very long texts are judged and
packed whole. An empty table gives no rows, and without labels the quality stage keeps all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docraster.llm import decontaminate, language, packing, quality, simhash
from docraster.llm.queries import table, vocabulary
from docraster.llm.shared import column, kept, removed, shared_folder

#: A language is accepted from this posterior on, and up to this strangeness.
SURE, STRANGE = 0.5, 1.25


def carried(docs: DataFrame) -> DataFrame:
    """text, and all other columns as one, so that none of them meets a name that a stage uses."""
    return docs.select("text", F.struct(*(column(c) for c in docs.columns if c != "text")).alias("others"))


def as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("text") if c == "text" else F.col("others").getField(c).alias(c) for c in docs.columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter, those whose language is not clear among the learnt ones, and those unlike
    anything learnt in it."""
    model = language.train(docs, vocabulary(language.VOCABULARY))
    found = language.predict(carried(docs), model)
    return as_before(found.where((F.col("lang_pred") != "und") & (F.col("score") >= SURE) & (F.col("strangeness") <= STRANGE)), docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the quality classifier does not call good."""
    net, share = quality.train(docs, table(spark, sf_dir, "labels"))
    if net is None:  # nothing to learn a rejection from
        return docs
    return as_before(quality.score(carried(docs), net, share).where(F.col("quality_score") >= quality.THRESHOLD), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold too much of the benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.packed_pieces(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near-duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Learnt models, fingerprints and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage kept is deleted once its successor has been written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_folder(spark, name)
        docs = kept(stage(spark, docs, sf_dir), name, path)
        if last:
            removed(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
