"""The corpus pipeline: language, quality rules, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last give the columns of documents, whole texts included, whatever further columns
documents has: those with the name of a statistic that a stage adds are kept as they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propgraph.llm import jaccard, langid, mixing, packing, quality
from propgraph.llm.common import BROADCAST_ROWS, held, release, table, written

#: The last stages give samples of copies and token checksums, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str], str]:
    """``docs`` with columns by number, so that none has the name of one that an operator adds; theirs; that of the text."""
    names = [f"in{k}_" for k in range(len(docs.columns))]
    return docs.toDF(*names), names, names[docs.columns.index("text")]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; dictionaries are made of the documents' own labelled texts.

    Null texts, texts without a letter and those with a narrow margin go; without any labelled text all go. Repeated
    rows stay or go together; an empty table stays empty.
    """
    release(spark)  # what the stage before held: its result is written
    inner, own, text = _apart(docs)
    found = langid.identify(inner, langid.fit(docs), text)
    return found.filter(~F.col("rejected")).select(*own).toDF(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base conditions nor the learned rules reject.

    Null and empty texts go (fewer than ten words). Without labels of both kinds only the base conditions reject.
    Repeated rows stay or go together; an empty table stays empty.
    """
    release(spark)  # what the stage before held: its result is written
    inner, own, text = _apart(docs)
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(inner, rules, text).filter("kept").select(*own).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Rows are told apart by their ids; if ids are null or repeat, the rows are written with a number of their own first,
    and of a group the first row stays. Texts without words are in no group: all of them stay.
    """
    release(spark)
    names, key = docs.columns, "doc_id"
    ids = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    if ids[0] != ids[1] or not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        key = "__row"
        docs = written(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows")
    found = jaccard.near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"))
    gone = held(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(key)))
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, key, "left_anti").select(*names)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them.

    Null sources are one source, the last; sources without words give nothing; an empty table stays empty.
    """
    release(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences; a null or empty text is a piece of the end token alone."""
    release(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("mixture", mixture), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
