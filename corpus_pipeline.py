"""The corpus pipeline: documents to piece ids, in stages that are each written and read again.

It belongs to granary.llm and needs it. Every stage works on all rows that the one before it kept; all but the last return the
columns of documents, extra ones too. In every stage but the near duplicates rows of equal ids and texts stay or go together, other columns play no part, texts are
read whole however long they are, and a table without rows gives one without rows. What each does with nulls is said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.llm import decontaminate, near_dedup, quality_model, spiece, toxicity
from granary.llm.common import discard, mark, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those that the compression-distance classifier, fitted on the labelled rows among docs, calls toxic.

    Null and empty texts have no toxic window and stay; a score of just the threshold is toxic. Without labels of both kinds all score alike.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those that the weakly supervised quality classifier rejects.

    Null texts and those without a word score 0 and go; a score of just the threshold is kept. Where the labellers tell no two kinds apart, the
    other texts all stay.
    """
    return quality_model.without_poor(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row, that of the least doc_id, of each class of near duplicates; a null id comes last.

    Classes are of texts: an id that repeats is only a label, so each of its texts stays or goes by itself, and of rows that are all the same one
    stays. Null texts and those without a word are in no class and stay.
    """
    return near_dedup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less those that hold a passage of a benchmark item, also with other numbers, names or units.

    Null and empty texts stay; a null id doesn't matter. Without items all stay.
    """
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the piece ids of each text that is left; null for a null text, none for an empty one."""
    return spiece.encode(docs, spiece.default_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("piece encoding", encode_pieces),
]

#: Three stages score by models that are fitted, which SQL can't express, so there is none for the rows of run(). Near copies and piece ids
#: have exact counterparts (SQL, and the vocabulary's own library); the tests hold each stage against a plain version of its decision.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again.

    What a stage wrote on its way, and what the stage before it gave, is removed when the stage has been written.
    """
    docs = table(spark, sf_dir, "documents")
    before = mark()
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(spark, before, keep=(docs,))
    return docs
