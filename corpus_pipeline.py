"""The corpus pipeline: five stages, each over all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.bpe import encoded
from tilewright.llm.common import stored, table
from tilewright.llm.crf import toxicity
from tilewright.llm.jaccard import jaccard_components
from tilewright.llm.mixture import mixture
from tilewright.llm.quality import weighed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return weighed(docs, table(spark, sf_dir, "labels"), keep=True).where("kept").select("row.*")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity(docs, table(spark, sf_dir, "labels"), keep=True).where("predicted = 0").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates; documents without words stay."""
    others = jaccard_components(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of the curriculum."""
    return mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of what they decode to."""
    return encoded(docs)


STAGES = [("quality", quality), ("toxicity", without_toxic), ("near_duplicates", one_of_each), ("mixture", mix), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs


#: A trained classifier and the tokens of a vocabulary aren't expressible in SQL; tests hold stages against brute force.
ORACLE_SQL = None
