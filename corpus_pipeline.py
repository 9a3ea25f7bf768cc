"""Corpus pipeline: toxicity, language ID, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import decontaminate, langid, packing, simhash, toxicity
from tabulon.llm.common import by_position, scratch_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5; learned from the labels of the documents at hand.

    All stay where no term was learned, for then every text has one score. Null and empty texts
    score as texts without a hit; null ids have no label; repeated rows stay or go alike. An
    empty table stays empty; columns keep their names and order, clashing ones too.
    """
    model = toxicity.train(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    if not model.lexicon:
        return docs
    score = toxicity.scorer(docs, model)
    plain, at, names = by_position(docs)
    return plain.where(score(F.col(at["text"])) < 0.5).toDF(*names)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: with a letter, and enough windows that a learned language knows.

    All stay where nothing was learned. Null, empty and letterless texts go; long texts are
    judged whole; repeated rows stay or go alike; ids play no part but in what is learned from.
    An empty table stays empty; columns keep their names and order, clashing ones too.
    """
    told = langid.teller(docs, langid.train(langid.training_rows(docs)))
    plain, at, names = by_position(docs)
    return plain.where(told(F.col(at["text"]))).toDF(*names)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more): the smallest doc_id.

    Of equal ids one row of the group stays; rows are judged by their own text, so null and
    repeated ids with other texts stay. Null and empty texts are handled by ``simhash.keep_one``.
    An empty table stays empty; columns keep their names and order, clashing ones too.
    """
    return simhash.keep_one(docs, width=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay; rows are judged by their own text, whatever their
    id; repeated rows stay or go alike. An empty table, of documents or items, changes nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; a null text is empty (its end token alone), repeated rows are packed each."""
    return packing.pack(docs, size=1024)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("simhash_dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: No stage is expressible in SQL; each is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs
