"""The corpus pipeline: each stage takes (spark, docs, sf_dir); its result is written and read again as the next one's docs.

Stages, in order: documents predicted to be toxic go; later repeats of runs of lines go from
texts; of each group of near duplicates the document with the smallest id stays; long
repeated passages, counted in words, go from texts; what is left is packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import table, written
from tidewatch.llm.jaccard_join import one_of_each
from tidewatch.llm.line_dedup import drop_repeated_runs
from tidewatch.llm.queries import packed
from tidewatch.llm.suffix_dedup import remove_repeats
from tidewatch.llm.toxicity import drop_toxic


#: Words of a passage from which on it counts as a repeat: more than fifty.
PASSAGE_WORDS = 51


def with_text(found: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of docs with another text and its length; the others come from the rest that the operator carried."""
    changed = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.char_length(text).cast("long")}
    return found.select(*(changed.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_text(drop_repeated_runs(docs), docs, F.col("text"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over fifty words that occur more than once go wherever they occur, however long they are in bytes; shorter repeats stay."""
    return with_text(remove_repeats(docs, PASSAGE_WORDS, PASSAGE_WORDS // 3, words=True), docs, F.col("kept").cast("string"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_dedup),
    ("packing", packing),
]

#: SQL can express neither the trained model nor the vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
