"""From raw documents to training sequences: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents, and any others that docs has.  Models are learned from the labels table of
sf_dir; everything else depends on the stage's own input alone.  Models are fitted, and what
several steps read is written, when a stage is called; the rest runs when its result is read.

Edge cases: a null text counts as the empty one, which is clean, fails the base quality rule, is a
group of its own and packs as its closing id; rows are told apart by id and text, so repeated and null ids are
no harm (near copies leave the row with the least id, null ids last, and one of rows alike
in both); without labels nothing is toxic and the base rule alone judges quality; an empty table gives
an empty result; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zipstrata.llm import packing, quality, similar, substrings, toxicity
from zipstrata.llm.common import cut_lineage, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 for toxicity."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learn=toxicity.learnable())
    return toxicity.drop_toxic(docs, model)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the learned decision list."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group linked by 0.8 or more of common five-word shingles."""
    return similar.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier; n_chars is that of the text left."""
    return substrings.remove_repeats(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_dedup", drop_near_copies), ("substring_dedup", cut_repeats), ("packing", pack)]

#: Learned rules, XXH64 fingerprints and token ids can't be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each one's result is written to the checkpoint folder once."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
