"""Documents to a training mixture: quality rules, near and substring dedup, decontamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexstrata.llm.decontaminate import drop_contaminated
from lexstrata.llm.mixing import with_rates
from lexstrata.llm.near_dedup import keep_one
from lexstrata.llm.quality_rules import keep_good
from lexstrata.llm.storage import materialize, shared_dir
from lexstrata.llm.substring_dedup import cut_repeats


#: Target share of words; the other domains keep their proportions, as the first stage has already taken low-quality texts out.
MIXTURE = {"toxic": 0.03}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, by labels; null and empty texts go, the rest is unchanged."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each near-duplicate group; rows without an id stay."""
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of repeated 35-word windows; texts left empty go, null texts stay."""
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item."""
    return drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with mix_rate, the expected uses of each in the target mixture; rows of rate 0 go."""
    return with_rates(docs, _table(spark, sf_dir, "labels"), targets=MIXTURE)


STAGES = [
    ("quality rules", quality),
    ("minhash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("source mixing", mixing),
]

#: The hashed classifiers and the signatures have no SQL form; tests hold every stage to a brute-force version on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written as Parquet and read again."""
    docs, folder = _table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{k}", folder)
    return docs
