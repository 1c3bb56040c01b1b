"""A corpus pipeline: toxicity, language ID, near-duplicates, packing. Each stage is written as Parquet and read again by the next."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurospan.llm import langid, neardup, packing, toxicity
from neurospan.llm.common import discard, materialize, table
from neurospan.llm.queries import tokenizer

#: Documents are kept below this toxicity, and from this confidence in a language on.
TOXIC, SURE = 0.5, 0.5


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose doc_id isn't among the written ids gone; rows without an id stay. Spark sends gone around only if its files are small."""
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones doesn't call toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, TOXIC)


def drop_unsure_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words whose language is told with some confidence; the source stands for the host."""
    got = langid.identify(docs, langid.fit(docs), "doc_id", "text", host=F.col("source"), declared=F.col("lang"))
    gone = got.where((F.col("n") == 0) | (F.col("confidence") < SURE)).where("doc_id IS NOT NULL").select("doc_id").distinct()
    return _without(docs, materialize(gone))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near-duplicates."""
    gone = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return _without(docs, materialize(gone))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("language", drop_unsure_language), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: The stages fit models, sketch and pack, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)  # does nothing to the table that it all began with
    return docs
