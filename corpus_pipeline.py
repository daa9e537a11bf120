"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinscout.llm import alike, langid, packing, secrets, substrings
from joinscout.llm.common import Scratch, table, unused
from joinscout.shipping import ship

#: Least posterior probability of a document's language, and most deviations that it may fall short of the language's usual fluency.
#: On invented prose all documents of the given tables stay under 14; short gibberish and other scripts score 28 to 74.
LEAST_SCORE, MOST_ODD = 0.5, 22.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no learned language: without a letter, undecided under LEAST_SCORE, or odder than MOST_ODD (gibberish, other languages)."""
    ship(spark)
    lang, score, odd = unused(docs.columns, "lang_pred", "score", "odd")
    judged = langid.classify(docs, langid.fit_fluency(docs, langid.fit(docs)), (lang, score, odd))
    return judged.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE) & (F.col(odd) <= MOST_ODD)).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near copies: sets of five-word shingles of similarity 0.8 or more.

    Candidates come from SimHash's pigeonhole and, as fingerprints within its 4 bits don't reach that similarity, from MinHash bands;
    all are compared exactly, so clean documents stay. A null doc_id is kept like any other.
    """
    ship(spark)
    return alike.first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words of repeated passages out of texts; untouched texts stay as they are, texts of which nothing is left go."""
    ship(spark)
    words, removed, kept = unused(docs.columns, "n_words", "n_removed", "kept")
    found = substrings.deduplicate(docs, (words, removed, kept)).where((F.col(removed) == 0) | (F.col(removed) < F.col(words)))
    cut = F.col(removed) > 0
    changed = {"text": F.when(cut, F.col(kept)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length(kept).cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns(changed).select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in place of each credential."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and the sequences that they lie in."""
    ship(spark)
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scans", secret_scans),
    ("packing", pack),
]

#: Fingerprints, a learned model and tokens aren't in SQL's reach; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    scratch = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, before = scratch.keep(stage(spark, docs, sf_dir)), docs
        scratch.drop(before)
    return docs
