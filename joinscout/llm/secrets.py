"""Secret scans (4): multipart credential linking with DataFrame functions only.

Strong kinds (assign, access, hex) are reported wherever they are found. Weak candidates (an account name, a bare key, an
endpoint) mean nothing alone: an interval join within each document finds, for each candidate, the
nearest part that complements it on either side, and the candidate is reported only if that lies within SCOPE code
points. The join is a sweep over the document's parts in both directions, so a document's work is linear in its parts
(after a sort) and no pairs are made.

Positions come from the gaps between matches (split) and the matches themselves, summed along the document; they are
code points. Texts are scanned whole, where they lie; only parts are shuffled, by row.

Defined cases: a null text is empty and has no spans. Repeated rows are scanned each by itself. Equal starts are ordered
by kind as listed. Extra columns stay out of the result of `scan` and unchanged in that of `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from joinscout.llm.common import unused

#: Base patterns, fixed by the contract, then the weak ones. Order of kinds is the order of ties.
PATTERNS: dict[str, str] = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "account": r"""(?i)(user|username|login|client_?id|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""",
    "key": r"[A-Za-z0-9/+=]{40,}",
    "endpoint": r"""(?i)(https?|postgres|mysql|mongodb|redis|amqp|ftp|ssh)://[^\x20\x09-\x0D"'<>]+""",
}
KINDS = tuple(PATTERNS)
BASE = KINDS[:3]
#: Group and least length of what must be long enough; failing matches are dropped after matching.
LEAST = {"assign": (2, 6), "account": (2, 3)}
#: Exact length of a bare key in the queries' SQL.
KEY_CHARS = 40
_RUN = "[A-Za-z0-9+/]"
#: What is scanned: as PATTERNS, which the queries' SQL is made of, but a bare key ends at '=' unless that is padding, so a name before
#: it is no part of it; it has 40 characters with its padding, or 32 to 128 with small and capital letters and digits among them.
SCANNED = PATTERNS | {
    "key": rf"(?<!{_RUN})(?:(?:{_RUN}{{40}}|{_RUN}{{39}}=|{_RUN}{{38}}==)(?![A-Za-z0-9+/=])|(?={_RUN}*[a-z])(?={_RUN}*[A-Z])(?={_RUN}*[0-9]){_RUN}{{32,128}}(?!{_RUN})={{0,2}}|{_RUN}{{40}}(?!{_RUN}))",
}
#: What each kind of part is: an identifier, a secret or an endpoint.
IDENTIFIERS, SECRETS, ENDPOINTS = ("access", "account"), ("assign", "hex", "key"), ("endpoint",)
#: Code points between a weak candidate and the part that complements it, at most.
SCOPE = 200


def _part(no: int, least: int):
    def part(x: Column, k: Column) -> Column:
        return F.struct(F.lit(no).alias("kind"), k.alias("k"), x["gap"].alias("gap"), x["chars"].alias("chars"), (x["value"] >= least).alias("counts"))

    return part


def _parts(text: Column) -> Column:
    """All matches of all kinds: (kind, k, gap before, chars, whether it counts); texts without a match cost one search."""
    found = []
    for no, (kind, rx) in enumerate(SCANNED.items()):
        group, least = LEAST.get(kind, (0, 0))
        gaps = F.transform(F.split(text, rx, -1), F.length)
        whole = F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), F.length)
        value = F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(group)), F.length) if group else whole
        rows = F.transform(F.arrays_zip(gaps.alias("gap"), whole.alias("chars"), value.alias("value")), _part(no, least))
        found.append(F.when(text.rlike(rx), F.filter(rows, lambda x: x["chars"].isNotNull())))
    return F.array_compact(F.flatten(F.array_compact(F.array(*found))))


def spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows (row, doc_id, text_hash, kind, start, end): all reported spans, and rows without a kind, so that each row of `docs` has one at least."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(text).alias("text_hash"), _parts(text).alias("parts"))
    parts = read.select("row", "doc_id", "text_hash", F.explode_outer("parts").alias("p")).select("row", "doc_id", "text_hash", "p.*").repartition("row")
    along = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap").cast("long") + F.col("chars")).over(along)
    placed = parts.withColumn("end", end).withColumn("start", F.col("end") - F.col("chars")).withColumn("kind", F.when(F.col("counts"), F.col("kind")))
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    numbers = {"i": IDENTIFIERS, "s": SECRETS, "e": ENDPOINTS, "base": BASE}
    is_a = {k: F.col("kind").isin([KINDS.index(x) for x in v]) for k, v in numbers.items()}
    near, columns = {}, {}
    for k, own in is_a.items():
        columns[f"{k}_before"] = F.max(F.when(own, F.col("end"))).over(before)
        columns[f"{k}_after"] = F.min(F.when(own, F.col("start"))).over(after)
        near[k] = F.coalesce(F.col("start") - F.col(f"{k}_before") <= scope, F.lit(False)) | F.coalesce(F.col(f"{k}_after") - F.col("end") <= scope, F.lit(False))
    overlaps = F.coalesce(F.col("base_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("base_after") < F.col("end"), F.lit(False))
    linked = (is_a["i"] & near["s"]) | (is_a["s"] & (near["i"] | near["e"])) | (is_a["e"] & near["s"])
    reported = is_a["base"] | (linked & ~overlaps)
    return placed.withColumns(columns).select("row", "doc_id", "text_hash", F.when(reported, F.col("kind")).alias("kind"), "start", "end")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash and its spans, an array of (start, kind, end) in order."""
    found = spans(docs, scope)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end"))
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_hash").alias("text_hash"), F.array_sort(F.collect_list(span)).alias("spans")).drop("row")


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, scope: int = SCOPE, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with each run of overlapping spans replaced by `mark`, and n_chars, if there, counted anew."""
    keys = ["doc_id", "text_hash"]
    found = scan(docs, scope).where(F.size("spans") > 0).dropDuplicates(keys)
    merged = F.aggregate(
        "spans",
        F.array().cast("array<struct<a:bigint,z:bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["z"] > x["start"]),
            F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(F.get(done, F.size(done) - 1)["a"].alias("a"), F.greatest(F.get(done, F.size(done) - 1)["z"], x["end"]).alias("z")))),
        ).otherwise(F.concat(done, F.array(F.struct(x["start"].alias("a"), x["end"].alias("z"))))),
    )
    doc, own_hash, text_hash, held = unused(docs.columns, "doc", "own_hash", "text_hash", "cuts")
    cuts = found.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(own_hash), merged.alias(held))
    both = docs.withColumn(text_hash, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    joined = both.join(cuts, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(text_hash) == F.col(own_hash)), "left")
    kept = F.transform(
        F.sequence(F.lit(0), F.size(held)),
        lambda i: F.substring(
            F.col("text"),
            (F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(held), i - 1)["z"]) + 1).cast("int"),
            F.when(i == F.size(held), F.length("text")).otherwise(F.get(F.col(held), i)["a"] - F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(held), i - 1)["z"])).cast("int"),
        ),
    )
    text = F.when(F.col(held).isNull(), F.col("text")).otherwise(F.array_join(kept, mark))
    out = joined.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(held).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long"))
    return out.select(*docs.columns)
