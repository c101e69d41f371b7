"""A corpus pipeline over the table ``documents``: five stages, each an operator
of ``callsheet.llm`` applied to all that its predecessor kept.

1. quality: documents that the Kneser-Ney classifier rejects go;
2. near duplicates: of each group of similar documents one stays;
3. decontamination: documents that hold a benchmark passage go;
4. mixing: documents are taken none, one or two times, to the sources' targets;
5. sharding: the mix in uniformly random order, in 16 shards of equal counts.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but
the last return the columns of ``documents``. Empty and null texts go with the
first stage. Repeated rows are one document to the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callsheet.llm import decontam, frames, jaccard, mixing, ngram_lm, sharding

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: near duplicates: five-word shingles, Jaccard similarity 0.8 or more
SHINGLE, PERCENT = 5, 80
SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return ngram_lm.keep_good(docs, labels).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs, n=SHINGLE, percent=PERCENT).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.decontaminate(docs, benchmark, remove="documents").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(mixing.mix(docs), COLUMNS)


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]

#: Perplexities and similarity groups are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out = frames.stored(out, name)
        if k:
            frames.drop_stored(docs)
        docs = out
    return docs
