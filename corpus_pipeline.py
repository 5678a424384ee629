"""Corpus pipeline: toxic documents out, one of each near-duplicate group, benchmark leaks out, secrets masked, packed.

Each stage takes what its predecessor kept, all of it, and all but the last return the columns that they got, others than
those of ``documents`` included, whatever their names. The classifier of the first stage is fitted on ``labels`` and the
forest of the fourth on made findings; the test items of the third are ``benchmark``. Empty tables give empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import decontamination, labelled, packing, partenum, secrets_forest, toxicity_fm
from quillon.llm.workspace import settled, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity of 0.5 or more. Fitted on the labelled rows that op9 learns from.

    Null and empty texts have the score of the bias alone, which is low unless most labels are toxic; without labels all
    score 0.5 and nothing can be told, so all stay. Repeated rows fare alike; rows without an id are scored, too.
    """
    held_out = labelled.bucket_of(5) == 0
    machine = toxicity_fm.train(docs, table(spark, sf_dir, "labels"), held_out)
    return toxicity_fm.kept(docs, machine) if len(machine.buckets) or machine.bias else docs


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component the row whose doc_id names it, the smallest.

    Rows of one doc_id are one document: one row of it stays, the one with the smallest text, null before all. Null and
    empty texts are in no group but that of their id; rows without an id can't be named and stay, repeated or not.
    """
    named = partenum.joined(docs).where("doc_id = component_id").select(F.col("doc_id").alias("name")).distinct()
    rows = docs.where("doc_id IS NOT NULL").select(F.struct(*docs.columns).alias("row"))
    rows = rows.join(named, F.col("row.doc_id").cast("long") == F.col("name"))
    first = Window.partitionBy("name").orderBy("row.text", F.xxhash64("row"))
    return rows.withColumn("turn", F.row_number().over(first)).where("turn = 1").select("row.*").unionByName(docs.where("doc_id IS NULL"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a passage of a benchmark item.

    Rows are told apart by id and text, so a row without an id that leaks goes, and a clean row that shares its id with a
    leaking one stays. Null and empty texts stay; repeated rows fare alike.
    """
    key = F.xxhash64("doc_id", "text")
    leaks = decontamination.contaminated(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = settled(leaks.select(F.col("doc_id").alias("leak")).distinct(), "leaks")
    if leaks.count() <= FEW:
        leaks = F.broadcast(leaks)
    return docs.select(F.struct(*docs.columns).alias("row"), key.alias("leak")).join(leaks, "leak", "left_anti").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts; all rows stay, those without secrets, or without a text, as they are."""
    return secrets_forest.redact(docs, secrets_forest.train(secrets_forest.findings(spark)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left and their places in sequences; a null or empty text is its end id alone."""
    return packing.packed(docs, str(public_tokenizers.path("word_bpe_49k.json")))


#: Keys of leaking rows are broadcast up to this many (8 bytes each), joined by shuffle beyond.
FEW = 20_000

STAGES = [("toxicity", toxicity), ("near duplicates", near_duplicates), ("benchmark leaks", benchmark_leaks), ("secrets", secrets), ("packing", packed)]

#: Learned scores decide which rows go; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
