"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again. All stages but the last
return the columns of ``documents``, with ``n_chars`` following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nephrolake.llm import language_id, line_dedup, ngram_join, packing, pii
from nephrolake.llm.common import read_table, row_key, stash


def _like(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the length of the new text."""
    return changed.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told go; where no row has a label
    to learn from, those without a letter."""
    net = language_id.fit_on_documents(docs)
    if net is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language_id.predict(docs, net).filter(F.col("lang_pred") != "und").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    return _like(line_dedup.drop_repeated_lines(docs), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays;
    a document without an id is in no group, nor is one without words. Texts
    under one id that are not linked are groups of their own."""
    joined = ngram_join.join_components(docs)
    first = joined.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.coalesce("root", "rid").alias("root"), F.col("root").isNull()).agg(F.min("rid").alias("rid"))
    keyed = docs.withColumn("rid", row_key())
    kept = keyed.filter(F.col("doc_id").isNotNull()).join(first.select("rid"), "rid", "left_semi").dropDuplicates(["rid"])
    return kept.unionByName(keyed.filter(F.col("doc_id").isNull())).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _like(pii.redact(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become sequences of tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact),
    ("packing", pack),
]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
