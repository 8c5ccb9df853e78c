"""The corpus pipeline: toxic documents go, near-duplicate groups leave one, benchmark leaks go, sources are mixed to
target weights, and the mix is shuffled into shards. Each stage takes (spark, docs, sf_dir); its result is written to the
shared folder and read back as the next one's documents. All but the last keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptledger.llm import decontam, mixing, neardup, shard, toxicity
from promptledger.llm.common import columns_of, documents, freeze


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. The network learns from the labelled rows outside the held-out third. Null
    and empty texts score as an empty window; columns of any name pass through; no rows give no rows."""
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"))
    return toxicity.below(docs, model, toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; see there for nulls, ties, repeated rows and names."""
    return neardup.drop_near_duplicates(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows go or stay together; columns of
    any name pass through; no rows give no rows."""
    return decontam.without_items(docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: texts without words (null ones too) never, ties by doc_id; a null source is a
    source; columns of any name pass through; no rows give no rows."""
    return mixing.mixed_documents(docs)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their slot in it. Every row is dealt, whatever it holds; columns named shard and
    slot are replaced, all others pass through; no rows give no rows."""
    return shard.shuffle_to_shards(docs, frozen=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", deal_shards),
]

#: No SQL expresses the trained network, the verified near-duplicate groups or the random shuffle.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = freeze(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
