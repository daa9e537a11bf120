"""Semantic types of columns: from a table that the user gives, or read off headers."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from joinscout.functions import portable

#: An encoder maps a column of strings to a column of vectors. The default counts hashed 3-grams.
Encoder = Callable[[Column], Column]


def header_label(col: Column) -> Column:
    """A header in words: without a short table prefix, cut at underscores and capitals, lower-cased."""
    plain = F.regexp_replace(col, "^[a-z]{1,2}_", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(plain, "([a-z0-9])([A-Z])", "$1 $2"), "[_\\s]+", " ")))


def header_labels(columns: DataFrame) -> DataFrame:
    return columns.select("tbl", "col", header_label(F.col("col")).alias("semantic_type"))


def given_labels(columns: DataFrame, given: DataFrame) -> DataFrame:
    """Labels of a user's table (tbl, col, semantic_type), headers' where it has none."""
    own = given.select("tbl", "col", F.col("semantic_type").alias("given"))
    return header_labels(columns).join(own, ["tbl", "col"], "left").select("tbl", "col", F.coalesce("given", "semantic_type").alias("semantic_type"))


def encoded(labels: DataFrame, encoder: Encoder = portable.gram_counts) -> DataFrame:
    return labels.withColumn("vec", encoder(F.col("semantic_type")))


def fuzzy_best(word: str, words: Iterable[str]) -> str | None:
    """The word that is most like `word`, the first of equals; None if all are wholly unlike it."""
    best, top = None, 0.0
    for w in words:
        if (ratio := difflib.SequenceMatcher(None, word, w).ratio()) > top:
            best, top = w, ratio
    return best


def repaired(columns: Iterable[str], returned: dict[str, str]) -> dict[str, str | None]:
    """Labels by column, where a labeller returned ids that are only about right: each column takes the likest id's."""
    return {c: returned.get(best) if (best := fuzzy_best(c, returned)) is not None else None for c in columns}


def value_embeddings(counts: DataFrame, encoder: Encoder = portable.gram_counts) -> DataFrame:
    """(tbl, col, value, vec): vectors of a lake's distinct values (value counts), each value of a column once; prepared for semantic joins."""
    return counts.where("value IS NOT NULL").select("tbl", "col", "value", encoder(F.col("value")).alias("vec"))
