"""The opN_ queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinscout.llm import bpe, chat, html_text, langid, neighbours, packing, quality, secrets, simhash, substrings
from joinscout.llm.common import crc_of_id, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(table(spark, sf_dir, "documents"))
    return quality.apply_policy(book).select("doc_id", *quality.MEASURES[:5], "base_failed", "kept", "failed_bits")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _is_kind(i: int):
    return lambda x: x["kind"] == i


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = {kind: F.size(F.filter("spans", _is_kind(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(secrets.KINDS)}
    base = F.filter("spans", lambda x: x["kind"] < len(secrets.BASE))
    return found.select("doc_id", *(n[k] for k in secrets.BASE), F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = "<|im_end|><|im_start|>assistant ok"
    added = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_segments(turns.unionByName(added)))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_of_id("doc_id") % 3 == 1, F.lit(False))  # a null doc_id has no remainder, so its row is not held out
    model = langid.fit(docs.where(~held_out))
    return langid.classify(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_packing, op2_quality_rules, op3_html_extraction, op4_secret_scans, op5_chat_formatting, op6_substring_dedup, op7_byte_bpe, op8_language_id, op9_simhash_near_dedup, op10_nearest_neighbours)}

def _secrets_sql() -> str:
    """The same patterns and links in DuckDB's SQL; kinds are numbered as in secrets.KINDS."""
    kinds = []
    for no, (kind, rx) in enumerate(secrets.PATTERNS.items()):
        group, least = secrets.LEAST.get(kind, (0, 0))
        quoted = rx.replace("'", "''")
        counts = f"length(v) = {secrets.KEY_CHARS}" if kind == "key" else f"length(v) >= {least}"
        kinds.append(f"""SELECT r, {no} AS kind, k, length(g) AS gap, length(m) AS chars, {counts} AS counts FROM (
  SELECT r, unnest(range(1, len(ms) + 1)) AS k, unnest(gaps[1:len(ms)]) AS g, unnest(ms) AS m, unnest(vs) AS v FROM (
    SELECT r, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}', 0) AS ms, regexp_extract_all(t, '{quoted}', {group}) AS vs FROM d) WHERE len(ms) > 0)""")
    isin = {k: "kind IN (" + ", ".join(str(secrets.KINDS.index(x)) for x in v) + ")" for k, v in {"i": secrets.IDENTIFIERS, "s": secrets.SECRETS, "e": secrets.ENDPOINTS, "b": secrets.BASE}.items()}
    near = {k: f"(coalesce(s - {k}_before <= {secrets.SCOPE}, false) OR coalesce({k}_after - e <= {secrets.SCOPE}, false))" for k in "ise"}
    windows = ", ".join(f"max(e) FILTER (WHERE {c}) OVER w AS {k}_before, min(s) FILTER (WHERE {c}) OVER x AS {k}_after" for k, c in isin.items())
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(secrets.KINDS)) + " END"
    one = f"{name} || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS ({" UNION ALL ".join(kinds)}),
a AS (SELECT *, sum(gap + chars) OVER (PARTITION BY r, kind ORDER BY k) AS e FROM p),
b AS (SELECT r, kind, (e - chars)::BIGINT AS s, e::BIGINT AS e FROM a WHERE counts),
c AS (SELECT *, {windows} FROM b WINDOW w AS (PARTITION BY r ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      x AS (PARTITION BY r ORDER BY s, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
f AS (SELECT * FROM c WHERE {isin["b"]} OR (NOT coalesce(b_before > s, false) AND NOT coalesce(b_after < e, false)
      AND ({isin["i"]} AND {near["s"]} OR {isin["s"]} AND ({near["i"]} OR {near["e"]}) OR {isin["e"]} AND {near["s"]})))
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
       sha256(coalesce(string_agg({one}, ',' ORDER BY s, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
       coalesce(string_agg({one}, ',' ORDER BY s, kind) FILTER (WHERE kind IS NOT NULL), '') AS spans
FROM d LEFT JOIN f USING (r) GROUP BY d.r, doc_id"""


ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
c AS (SELECT doc_id, unnest([i, i + 1, i + 2]) AS i FROM g WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT i) AS n_repeat_words FROM c GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines,
             len(list_filter(ws, lambda x: trim(x, '0123456789.,;:!?()[]{}<>|#*$%&/\"''+-=_~^@`') <> ''))::BIGINT AS n_letter_words,
             len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*(-|\*|•|‣|▪)')))::BIGINT AS n_bullet_lines,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines
      FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, """
    + " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, (_, rule) in enumerate(quality.RULES))
    + f""" AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & {quality.BASE_MASK}) <> 0 AS base_failed,
       bits & {quality.BASE_MASK | quality.PRODUCTION.mask} = 0 AS kept, bits::BIGINT AS failed_bits FROM b""",
    "op4_secret_scans": _secrets_sql(),
    "op5_chat_formatting": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o AS (SELECT *, coalesce(lag(role) OVER w, '') AS before, lead(role) OVER w IS NULL AS last FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
a AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
             coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
             sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
             sum(24 + length(role) + length(text) + (length(text) - length(replace(text, '<|', ''))) // 2)::BIGINT AS formatted_chars,
             bool_and((before = '' AND role IN ('system', 'user') OR before = 'system' AND role = 'user' OR before = 'user' AND role = 'assistant' OR before = 'assistant' AND role = 'user')
                      AND (NOT last OR role IN ('user', 'assistant'))) AS valid
      FROM o GROUP BY conv_id)
SELECT * FROM a""",
    "op6_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, ws FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM p),
g AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM g WHERE n > 1),
r AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM c GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(list_filter(ws, lambda x, i: NOT coalesce(list_contains(gone, i), false)), ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)""",
}
