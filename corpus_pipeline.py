"""A corpus pipeline: toxic documents go, later repeated lines go, one of each group of near-duplicates stays, benchmark
passages go, and what is left is tokenized.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the shared folder and
hands the reread table to the next stage. All but the last return the columns of ``documents``.

Defined results: nulls, empty and long texts, ties, repeated rows, empty tables and further columns are treated as the
operators' modules say; further columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeplane.llm import bpe, common, decontaminate, lines, simhash, toxicity
from citeplane.session import ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, common.table(ship(spark), sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents may end up with an empty text; n_chars follows the text."""
    ship(spark)
    names = docs.columns
    found = lines.dedup_lines(docs, long=lines.LONG).toDF(*(f"c{i}" for i in range(len(names))), "n_lines", "n_deleted")
    if "n_chars" in names:
        n, t = (f"c{names.index(x)}" for x in ("n_chars", "text"))
        found = found.withColumn(n, F.when(F.col("n_deleted") > 0, F.length(t).cast(docs.schema[names.index("n_chars")].dataType)).otherwise(F.col(n)))
    return found.drop("n_lines", "n_deleted").toDF(*names)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark passage goes, however small a part of it that is."""
    return decontaminate.without_affected(docs, common.table(ship(spark), sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and digests of the ids and of their decoding."""
    ship(spark)
    return bpe.encode(docs, ["doc_id"], outputs=("n_tokens", "token_ids", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", keep_one_of_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("bpe encoding and decoding", tokenize),
]

#: SQL has neither the classifier nor XXH64 nor BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = common.materialize(stage(spark, docs, sf_dir))
    return docs
