"""From raw documents to packed training sequences, each stage on all that the one before it kept.

1. quality: documents that the classifier rejects go.
2. near_duplicates: one document of each group of near copies stays, the first row.
3. substring_dedup: passages that occur in an earlier document are cut out; ``n_chars`` follows the text. A text that is
   all repeated stays as an empty document.
4. decontamination: documents that hold a benchmark item go.
5. packing: what is left is cut and packed into sequences of 4,096 tokens.

All stages but the last return the columns of their input. Each stage's rows for nulls, empty texts, repeated rows and
empty tables are those its operator names; a row with a null id is a document like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import decontamination, jaccard_join, packing, quality, spans
from lorekeep.llm.common import fresh, stored
from lorekeep.session import ship

#: SQL cannot express the classifier, the fingerprints or the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None
BROADCAST_BYTES = 64 * 1024 * 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    return _table(ship(spark), sf_dir, "documents") if docs is None else docs


def keep_good(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    docs = _documents(ship(spark), docs, sf_dir)
    return quality.judge(docs, _table(spark, sf_dir, "labels")).filter("keep").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    """Rows are numbered by their place in the input files, so that repeated and null ids are told apart.

    The numbers are written once: another scan may cut the files differently and would number the rows anew.
    """
    docs = _documents(ship(spark), docs, sf_dir)
    row, copy = fresh(docs, "_row", "_copy")
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    groups = jaccard_join.join_near(numbered, id_col=row)
    copies = stored(groups.filter(F.col(row) != F.col("component_id")).select(F.col(row).alias(copy)), "near-copies")
    few = copies.count() * 16 <= BROADCAST_BYTES
    return numbered.join(F.broadcast(copies) if few else copies, F.col(row) == F.col(copy), "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    docs = _documents(ship(spark), docs, sf_dir)
    cut = spans.remove_repeats(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    docs = _documents(ship(spark), docs, sf_dir)
    return decontamination.remove_leaks(docs, _table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(ship(spark), docs, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents of ``sf_dir``; what each stage keeps is written to the shared folder."""
    docs = _documents(ship(spark), None, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
