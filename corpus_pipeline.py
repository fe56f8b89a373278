"""Corpus preparation: from raw ``documents`` to packed training sequences.

Each stage reads what its predecessor kept, as Parquet, and its decisions take
effect: rejected, near-duplicate and contaminated documents go, repeated strings
are cut out of the texts (``n_chars`` follows), and the rest is packed.  Texts
that lose everything stay as empty documents.

Edge cases: a null text is scored, compared and packed as an empty one and stays
null in between; rows without a label only take no part in training, and without
labels of both kinds every document stays; rows with a null id are kept and judged
like any other, rows that repeat id and text are near copies of each other and one
stays; an empty table gives an empty result, an empty benchmark leaves every
document; extra columns of any name pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import decontaminate, packing, quality, simhash, substrings
from skyloom.llm.scratch import Scratch


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that score below 0.3 go."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies (Jaccard similarity of 0.8 or more of five-word shingles): of each group the smallest id stays."""
    return simhash.drop_near_duplicates(spark, docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix arrays: strings of 200 bytes or more that occur twice are cut out."""
    cut = substrings.remove_repeats(spark, docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: contaminated documents go."""
    return decontaminate.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens."""
    return packing.pack(spark, docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", keep_distinct),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", keep_clean),
    ("best_fit_packing", pack_sequences),
]

#: SQL can express neither the classifier nor the fingerprints; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last:
            scratch.drop(last)
        last = name
    return docs
