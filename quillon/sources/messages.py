"""Sources of messages: files of lines, and files that are one JSON array of strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOT_A_LIST = "a batch must be a JSON array of strings"


def lines_of(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep``, line (its number from 0) and text of each line of a text column that is not blank."""
    lines = rows.select(*keep, F.posexplode(F.split(F.col(text), "\\r\\n|\\n|\\r")).alias("line", "text"))
    return lines.where(F.col("text").rlike(r"\S"))


def line_messages(spark: SparkSession, path: str) -> DataFrame:
    """text of each line that is not blank; files are split, so they may be of any size."""
    return spark.read.text(path).select(F.col("value").alias("text")).where(F.col("text").rlike(r"\S"))


def array_of(document: Column) -> Column:
    """The strings of a JSON array; raises if it is something else."""
    parsed = F.from_json(document, "array<string>")
    return F.when(parsed.isNull() | ~document.rlike(r"\A\s*\["), F.raise_error(F.lit(NOT_A_LIST)).cast("array<string>")).otherwise(parsed)


def json_messages(spark: SparkSession, path: str) -> DataFrame:
    """pos, text of each string of JSON array files, read whole."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(array_of(F.col("value"))).alias("pos", "text"))
