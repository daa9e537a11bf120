"""Quality rules (2): a ledger of failure bits and measurements, filled once, then judged by versioned policies.

`ledger` measures each document once and stores one bit per failed rule. A `Policy` is a mask over these bits, so
that new policies and ablations are bitwise operations over the ledger and never read a text again.

Defined cases: a null or empty text has no words, all measurements 0 and fails `few_words`. Repeated rows are
measured each by itself. Other columns of the input stay out of the result unless asked for by `carry`; a carried column with the name
of a measurement gives way to that. An empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinscout.llm.common import slices

SYMBOLS = b"#*$%&|<>"
#: Measurements in ledger order, all long.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_bullet_lines", "n_ellipsis_lines")

#: (name, SQL predicate over the measurements that is true if the rule fails). A rule's bit is its place here; only append.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    ("short_or_long_words", "word_chars < 3 * n_words OR word_chars > 12 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("few_letter_words", "10 * n_letter_words < 7 * n_words"),
    ("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
    ("ellipsis_lines", "10 * n_ellipsis_lines > 3 * n_lines"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_trigrams"]


@dataclass(frozen=True)
class Policy:
    """Documents that fail any rule of `mask`, or more than `spare` rules of `soft`, are not kept."""

    version: str
    mask: int
    soft: int = 0
    spare: int = 0

    def verdict(self, bits: str = "failed_bits") -> F.Column:
        soft = F.bit_count(F.col(bits).bitwiseAND(F.lit(self.soft))) <= self.spare
        return (F.col(bits).bitwiseAND(F.lit(self.mask)) == 0) & soft


POLICIES = {
    "base-1": Policy("base-1", BASE_MASK),
    "strict-1": Policy("strict-1", sum(BIT.values())),
}
PRODUCTION = POLICIES["strict-1"]

_BULLETS = (b"-", b"*", "•".encode(), "‣".encode(), "▪".encode())


def repeated_positions(ids: np.ndarray, width: int = 3) -> int:
    """How many places lie in a window of `width` ids that is found twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key = ids[:n].astype(np.int64)
    for k in range(1, width):
        if key.max(initial=0) >= 1 << 31:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = (key << 31) | ids[k : n + k]  # ids stay under 2**31: a text has fewer words than bytes
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    often = np.zeros(len(ids), bool)
    starts = np.concatenate((order[1:][same], order[:-1][same]))
    for k in range(width):
        often[starts + k] = True
    return int(often.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found = raw.split()
    joined = b"".join(found)
    ids: dict[bytes, int] = {}
    coded = np.fromiter((ids.setdefault(w, len(ids)) for w in found), np.int64, len(found))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    heads = [x.strip() for x in lines]
    return (
        len(found),
        len(text or "") - (len(raw) - len(joined)),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_positions(coded),
        len(lines),
        sum(1 for w in found if w.strip(b"0123456789.,;:!?()[]{}<>|#*$%&/\\\"'+-=_~^@`")),
        sum(1 for x in heads if x.startswith(_BULLETS)),
        sum(1 for x in heads if x.endswith((b"...", "…".encode()))),
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, texts in slices(batches):
        found = np.array([measure(x) for x in texts], np.int64).reshape(-1, len(MEASURES))
        rest = [part.column(i) for i, name in enumerate(part.schema.names) if name != "text"]
        names = [name for name in part.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(found[:, i]) for i in range(len(MEASURES)))], names=[*names, *MEASURES])


def ledger(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`carry`, the measurements and failed_bits, one row per row of `docs`; narrow, without a shuffle."""
    carry = tuple(c for c in dict.fromkeys(carry) if c not in (*MEASURES, "failed_bits", "text"))
    source = docs.select(*carry, F.col("text").cast("string").alias("text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text"), *(f"{m} bigint" for m in MEASURES)])
    measured = source.mapInArrow(_measured, schema)
    bits = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)), F.lit(0))
    return measured.withColumn("failed_bits", bits.cast("long"))


def apply_policy(book: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """Adds base_failed, kept and the policy's version."""
    base = F.col("failed_bits").bitwiseAND(F.lit(BASE_MASK)) != 0
    return book.withColumns({"base_failed": base, "kept": ~base & policy.verdict(), "policy": F.lit(policy.version)})


def ablation(book: DataFrame, policy: Policy = PRODUCTION) -> DataFrame:
    """For each rule of the policy: how many documents fail it, fail it alone, and would be kept without it.

    Documents are first counted by their bits (at most 2**len(RULES) groups), then unfolded by rule.
    """
    groups = book.groupBy("failed_bits").agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BIT.items() if bit & (policy.mask | policy.soft)))).alias("r")
    one = groups.select("failed_bits", "n", rules).select("failed_bits", "n", "r.rule", "r.bit")
    has = F.col("failed_bits").bitwiseAND(F.col("bit")) != 0
    without = F.col("failed_bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    kept = (without.bitwiseAND(F.lit(policy.mask)) == 0) & (F.bit_count(without.bitwiseAND(F.lit(policy.soft))) <= policy.spare)
    return one.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(has & (without.bitwiseAND(F.lit(policy.mask)) == 0), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
