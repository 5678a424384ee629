"""Which language a message is in, or why that can't be said; row-local, so also for streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import textnorm as T
from ..settings import Settings
from ..sources import shipped


def script_counts(text: Column) -> dict[str, Column]:
    """Letters of each script, and all letters. ASCII's are counted apart: few texts have many others."""
    ascii_letters = F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]+", ""))
    others = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    counts = {script: T.letters_of(others, body) for script, body in sorted(T.script_classes().items())}
    return counts | {"Latin": counts["Latin"] + ascii_letters, "letters": T.letters_of(others, r"\p{L}") + ascii_letters}


def candidates(words: Column, languages: tuple[str, ...], ratio: float, markers: dict[str, list[str]] = shipped.EXCLUSIVE) -> Column:
    """Languages by descending share of the words that speak for any, with these words in order and repeats.

    Each word is looked up once in a hash set of all markers; only those that are in it are dealt to languages.
    """
    either = sorted({w for lang in languages for w in markers[lang]})

    def own(words: Column, lang: str) -> Column:
        return F.filter(words, lambda w: w.isin(markers[lang]))

    shares = F.transform(
        F.array(F.filter(words, lambda w: w.isin(either))),
        lambda deciding: F.array(*(F.struct(F.lit(lang).alias("language"), own(deciding, lang).alias("markers"), F.size(deciding).alias("n")) for lang in languages)),
    )[0]
    shares = F.transform(shares, lambda c: F.struct((-F.try_divide(F.size(c["markers"]), c["n"])).alias("less"), c["language"].alias("language"), c["markers"].alias("markers")))
    kept = F.array_sort(F.filter(shares, lambda c: c["less"].isNotNull() & (-c["less"] >= ratio)))
    return F.transform(kept, lambda c: F.struct(c["language"].alias("language"), (-c["less"]).alias("share"), c["markers"].alias("markers")))


def identified(messages: DataFrame, settings: Settings = Settings(), text: str = "text", markers: dict[str, list[str]] = shipped.EXCLUSIVE) -> DataFrame:
    """``messages`` with normalised and lang: language, supported, reason, script, share, margin, candidates."""
    df = messages.withColumn("normalised", T.normalise(F.coalesce(F.col(text), F.lit(""))))
    counts = script_counts(F.col("normalised"))
    df = df.withColumn("_scripts", F.struct(*(c.alias(k) for k, c in counts.items())))
    df = df.withColumn("_candidates", candidates(T.letter_words(F.col("normalised")), settings.languages, settings.mixed_language_ratio, markers))
    n = F.col("_scripts.letters")
    named = [k for k in counts if k != "letters"]
    known = sum((F.col(f"_scripts.{k}") for k in named), F.lit(0))
    every = F.array(*(F.struct((-F.col(f"_scripts.{k}")).alias("n"), F.lit(k).alias("script")) for k in named), F.struct((known - n).alias("n"), F.lit("Unknown").alias("script")))
    script = F.array_min(every)["script"]
    top, second = F.get("_candidates", F.lit(0))["share"], F.coalesce(F.get("_candidates", F.lit(1))["share"], F.lit(0.0))
    reason = (
        F.when(~T.has_letter(F.col("normalised")), "empty_text")
        .when(F.try_divide(F.col("_scripts.Latin"), n) < settings.min_script_share, "unsupported_script")
        .when(top.isNull() | (top < settings.min_language_share), "insufficient_signal")
        .when(top - second < settings.min_language_margin, "ambiguous_language")
        .otherwise("ok")
    )
    df = df.withColumn("_reason", reason)
    read = F.col("_reason").isin("ok", "insufficient_signal", "ambiguous_language")
    lang = F.struct(
        F.when(F.col("_reason") == "ok", F.get("_candidates", F.lit(0))["language"]).alias("language"),
        (F.col("_reason") == "ok").alias("supported"),
        F.col("_reason").alias("reason"),
        F.when(F.col("_reason") != "empty_text", script).alias("script"),
        F.when(F.col("_reason").isin("insufficient_signal", "ambiguous_language"), F.lit(settings.min_language_share)).alias("min_share"),
        F.when(F.col("_reason").isin("insufficient_signal", "ambiguous_language"), F.lit(settings.min_language_margin)).alias("margin"),
        F.when(read, F.col("_candidates")).otherwise(F.filter("_candidates", lambda c: F.lit(False))).alias("candidates"),
    )
    return df.withColumn("lang", lang).drop("_scripts", "_candidates", "_reason")
