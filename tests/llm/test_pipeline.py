"""The pipeline against a plain version of each stage, run in order on a small table."""

import random
import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from joinscout.llm import langid, packing

from test_operators import components_by_search, fingerprint_by_definition, removed_by_search  # isort: skip

SECRET = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)|[0-9a-f]{24,}""", re.I | re.A)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    alphabets = {"aa": "abcdefgh", "bb": "ghijklmn"}

    def words(lang, n):
        return " ".join("".join(rng.choice(alphabets[lang]) for _ in range(6)) for _ in range(n))

    shared = words("aa", 60)
    rows = []
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        text = words(lang, rng.randrange(30, 200)) + ". "
        if i % 7 == 0:
            text += shared + " " + words(lang, 30)
        if i % 9 == 0:
            text += ' token = "qwertyuiop12345" ' + words(lang, 5)
        rows.append((i, text, lang, "s", len(text)))
    rows += [(100, rows[3][1], "bb", "s", 1), (101, rows[4][1].upper(), "aa", "s", 1), (102, "12 34 !!", "aa", "s", 8), (103, None, None, "s", 0), (104, shared, "aa", "s", len(shared)), rows[6]]
    rows += [(105, " ".join("".join(rng.choice("uvwxyz") for _ in range(6)) for _ in range(80)), None, "s", 5)]  # in no language
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(at / "documents.parquet"))
    return str(at), rows


def test_pipeline_matches_plain_version(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = langid.fit_fluency(docs, langid.fit(docs))
    names, score = model.predict([r[1] for r in rows])
    odd = model.oddness([r[1] for r in rows], names)
    kept = {r[0]: r[1] for r, n, s, o in zip(rows, names, score, odd, strict=True) if n != "und" and s >= 0.5 and o <= corpus_pipeline.MOST_ODD}
    assert set(kept) == {r[0] for r in rows} - {102, 103, 105}
    groups = components_by_search([fingerprint_by_definition(t) for t in kept.values()], list(kept))
    kept = {i: t for i, t in kept.items() if groups[i] == i}
    assert 100 not in kept and 101 not in kept
    left = removed_by_search(list(kept.items()))
    cut = {i: t if len(left[i]) == len(t.split()) else b" ".join(left[i]).decode() for i, t in kept.items() if left[i]}
    assert 104 not in cut
    clean = {i: SECRET.sub("[SECRET]", t) for i, t in cut.items()}
    pieces = corpus_pipeline.run(spark, at).toPandas()
    coder = packing.tokens(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(coder.encode(t)) + 1 for i, t in clean.items()}
    assert pieces.groupby("doc_id").doc_tokens.first().to_dict() == tokens
    assert pieces.groupby("doc_id").length.sum().to_dict() == tokens

    import zlib

    for r in pieces.itertuples():
        ids = np.append(coder.encode(clean[r.doc_id]), 1).astype("<u4")[r.start : r.start + r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "secret_scans", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), at)
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_stages_keep_rows_without_id_and_columns_of_any_name(spark):
    words = [" ".join(f"{k}word{i}" for i in range(60)) for k in "abcd"]
    rows = [(None, words[0], "aa", 3, "v1"), (None, words[1], "aa", 3, "v2"), (1, words[2], "aa", 3, "v3"), (2, words[2], "aa", 3, "v4"), (7, words[3] + ' token="abcdefg1"', "aa", 3, "v5"), (8, None, None, 3, "v6")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string").withColumnsRenamed({"score": "nth", "lang_pred": "key"})
    wide = docs.selectExpr("*", "1 AS text_hash", "2 AS ranges", "3 AS doc", "4 AS cuts", "5 AS odd", "6 AS score", "7 AS kept", "8 AS n_words")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, "")
        assert out.columns == wide.columns
        seen[name] = out.collect()
        assert all([r[c] for c in ("text_hash", "ranges", "doc", "cuts", "odd", "score", "kept", "n_words", "nth")] == [1, 2, 3, 4, 5, 6, 7, 8, 3] for r in seen[name])
    assert sorted(r["key"] for r in seen["language_id"]) == ["v1", "v2", "v3", "v4", "v5"]
    assert sorted(r["key"] for r in seen["simhash_near_dedup"]) == ["v1", "v2", "v3", "v5", "v6"]
    assert sorted(r["key"] for r in seen["substring_dedup"]) == ["v1", "v2", "v3", "v5", "v6"]
    assert sum("[SECRET]" in (r["text"] or "") for r in seen["secret_scans"]) == 1


def test_near_copies_of_similarity_08_go(spark, monkeypatch):
    from joinscout.llm import alike

    monkeypatch.setattr(alike, "CELL", 8)
    rng = random.Random(11)

    def grams(ws):
        return {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}

    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 400))]
        for _ in range(8):
            ws = list(base)
            for k in rng.sample(range(len(ws)), rng.randrange(1, max(2, len(ws) // 25))):
                ws[k] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(ws)))
    sets = [grams(t.split()) for _, t in rows]
    root = list(range(len(rows)))
    for i in root:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(root)) and 12 < len(set(root)) < len(rows)
