"""Language ID (8): multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1- to 3-grams are summed by Spark into a matrix of log-probabilities with one column per language.
Every language found is learned. The matrix is bounded by BUCKETS x languages floats, whatever the corpus, so it goes to all tasks;
more than MOST_LANGUAGES raise an error. Batches are scored as one sparse lookup over all places of all texts in numpy.

Fitting uses at most about `sample` labelled documents a language (a documented bound), picked by a hash of id and text.
Prediction reads whole texts and nothing but texts.

A posterior says which learned language is likelier, not whether a text is in any of them. `fit_fluency` therefore learns how the
log-probability of a place is spread over each language's own documents, and `oddness` tells by how many deviations a text's mean
falls short of that: gibberish and languages that were never learned stand out at any length.

Defined cases: a text that is null or has no letter gets `und` with score 0, and so does every text if nothing could be
learned. Ties go to the language that sorts first. Repeated rows get equal answers. Rows whose lang is null are never
learned from; a row with a null doc_id is learned from like any other. Other columns of the input are kept as they are; the
result's columns replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joinscout.llm.common import slices

ORDERS = 3
LOG_BUCKETS = 15
#: Rows of the matrix: the buckets of each order of n-gram.
BUCKETS = ORDERS << LOG_BUCKETS
#: Labelled documents to learn from, for each language, in expectation.
SAMPLE = 6000
#: More languages than this make fitting fail, as the matrix (0.4 MB a language) would no longer fit a worker.
MOST_LANGUAGES = 2048
#: Languages that a counting task holds at once, and documents a language from which fluency is learned.
HELD, FLUENCY_SAMPLE = 64, 1000
#: Bytes of text scored at once; a place takes about 100 bytes of arrays.
AT_ONCE = 2 << 20
UNKNOWN = "und"
_STEP = np.uint32(0x9E3779B1)
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order, the bucket of the n-gram at each place of all texts, laid end to end; where each text begins and ends.

    Letters are lower-cased; all else becomes a space, and texts are set apart by two spaces, so that no text's
    n-grams depend on its neighbours.
    """
    joined = "  ".join(["", *(t.lower() for t in texts), ""])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_is_letter()[code], code, np.uint32(32))
    sizes = np.fromiter((len(t.lower()) for t in texts), np.int64, len(texts))
    begins = np.cumsum(sizes + 2) - sizes
    out, key = [], np.zeros(len(code), np.uint32)
    for order in range(ORDERS):
        key = key * _STEP
        key[: len(code) - order] += code[order:] + np.uint32(1)
        mixed = key ^ (key >> np.uint32(15))
        mixed = (mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - LOG_BUCKETS)
        out.append(mixed + np.uint32(order << LOG_BUCKETS))
    return out, begins, begins + sizes


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) of a task's rows; as many rows as languages x BUCKETS at most."""
    sums: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for part, texts in slices(batches, limit=AT_ONCE):
        langs = part.column(part.schema.get_field_index("lang")).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang and t]
            docs[lang] = docs.get(lang, 0) + len(own)
            if own:
                buckets, begins, ends = grams(own)
                inside = np.zeros(len(buckets[0]) + 1, np.int8)
                np.add.at(inside, begins, 1)
                np.add.at(inside, ends, -1)
                place = np.cumsum(inside[:-1]).astype(bool)
                have = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for b in buckets:
                    have += np.bincount(b[place], minlength=BUCKETS)
            if len(sums) > HELD:
                yield from map(_summed, sums, sums.values(), map(docs.pop, list(sums)))
                sums.clear()
    yield from map(_summed, sums, sums.values(), map(docs.get, list(sums)))


def _summed(lang: str, have: np.ndarray, docs: int) -> pa.RecordBatch:
    """Counts of a language's buckets, and of its documents as bucket -1."""
    at = np.flatnonzero(have)
    return pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(have[at], docs))], names=["lang", "bucket", "n"])


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    weights: np.ndarray  # BUCKETS x languages, log-probabilities
    prior: np.ndarray
    counts: tuple[int, ...] = ()  # labelled documents of each language
    fluency: np.ndarray | None = None  # languages x (mean, variance between documents, variance within), of a place's log-probability

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its probability."""
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        letters = _is_letter()
        known = [i for i, t in enumerate(texts) if t and not t.isspace()]
        if not self.langs or not known:
            return names, score
        buckets, begins, ends = grams([texts[i] for i in known])
        ends = np.maximum(ends, begins)
        cuts = np.stack((begins, ends), 1).ravel()
        total = np.tile(self.prior, (len(known), 1))
        for b in buckets:
            for k in range(len(self.langs)):
                total[:, k] += np.add.reduceat(self.weights[b, k], cuts, dtype=np.float64)[::2]
        best = total.argmax(1)
        odds = np.exp(total - total.max(1, keepdims=True))
        odds /= odds.sum(1, keepdims=True)
        for row, i in enumerate(known):
            code = np.frombuffer(texts[i].encode("utf-32-le", "surrogatepass"), np.uint32)
            if letters[code].any():
                names[i], score[i] = self.langs[best[row]], odds[row, best[row]]
        return names, score

    def places(self, text: str, lang: str) -> np.ndarray:
        """The log-probability of each place of a text that holds a letter, over all orders, in a language."""
        buckets, begins, ends = grams([text])
        own = slice(int(begins[0]), int(ends[0]))
        held = buckets[0][own] != grams([" "])[0][0][2]
        return sum(self.weights[b[own][held], self.langs.index(lang)].astype(np.float64) for b in buckets)

    def oddness(self, texts: list[str | None], langs: list[str]) -> np.ndarray:
        """How many deviations the mean log-probability of each text's places lies below what its language is used to; 0 for `und`."""
        out = np.zeros(len(texts))
        for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
            if lang != UNKNOWN and self.fluency is not None:
                mean, between, within = self.fluency[self.langs.index(lang)]
                own = self.places(text, lang)
                out[i] = (mean - own.mean()) / np.sqrt(between + within / len(own))
        return out


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from the rows of `docs` (doc_id, text, lang) that have a lang, at most about `sample` for each."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages can't be learned")
    sizes = {r["lang"]: r["count"] for r in known}
    counts = _picked(docs, sizes, sample).mapInArrow(_counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow().to_pandas()  # at most (BUCKETS + 1) x languages rows
    langs = tuple(sorted(found.lang.unique()))
    table = np.full((BUCKETS, len(langs)), 0.5)
    prior = np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = found[found.lang == lang]
        seen = own[own.bucket >= 0]
        table[seen.bucket.to_numpy(), k] += seen.n.to_numpy()
        prior[k] = max(1, own[own.bucket < 0].n.sum())
    for order in range(ORDERS):
        part = table[order << LOG_BUCKETS : (order + 1) << LOG_BUCKETS]
        part /= part.sum(0)
    return Model(langs, np.asfortranarray(np.log(table).astype(np.float32)), np.log(prior / prior.sum()) if len(langs) else prior, tuple(sizes[x] for x in langs))


def _picked(docs: DataFrame, sizes: dict[str, int], sample: int) -> DataFrame:
    """(text, lang) of about `sample` labelled rows a language, the same on every run; `sizes` are at most MOST_LANGUAGES."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    rates = F.broadcast(docs.sparkSession.createDataFrame([(k, min(1.0, sample / n)) for k, n in sizes.items()], "lang string, rate double"))
    chance = F.xxhash64(F.col("doc_id").cast("string"), "text").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    return labelled.join(rates, "lang").where(chance < F.col("rate")).select("text", "lang")


def fit_fluency(docs: DataFrame, model: Model, sample: int = FLUENCY_SAMPLE) -> Model:
    """The model with the fluency of its languages, from about `sample` documents each that are predicted as labelled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(shared.value.langs), 4))
        for part, texts in slices(batches, limit=AT_ONCE):
            known = part.column(part.schema.get_field_index("lang")).to_pylist()
            for text, lang, found in zip(texts, known, shared.value.predict(texts)[0], strict=True):
                if lang == found:
                    own = shared.value.places(text, lang)
                    m, v = own.mean(), own.var()
                    sums[shared.value.langs.index(lang)] += (1, m, m * m, v)
        yield pa.RecordBatch.from_arrays([pa.array(shared.value.langs, pa.string()), *(pa.array(c) for c in sums.T)], names=["lang", *_SUMS])

    sizes = dict(zip(model.langs, model.counts, strict=True))
    found = _picked(docs, sizes, sample).mapInArrow(spread, "lang string, " + ", ".join(f"{c} double" for c in _SUMS)).groupBy("lang").agg(*(F.sum(c).alias(c) for c in _SUMS)).collect()
    fluency = np.tile((0.0, np.inf, np.inf), (len(model.langs), 1))  # a language without such documents finds nothing odd
    for r in found:
        if r["n"]:
            mean, within = r["m"] / r["n"], r["v"] / r["n"]
            fluency[model.langs.index(r["lang"])] = mean, max(r["mm"] / r["n"] - mean * mean, 0.0), within + 1e-9
    return Model(model.langs, model.weights, model.prior, model.counts, fluency)


_SUMS = ("n", "m", "mm", "v")


def classify(docs: DataFrame, model: Model, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and its probability to each row, named by `names`, and a third name's oddness; narrow, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, limit=AT_ONCE):
            langs, score = shared.value.predict(texts)
            odd = [pa.array(shared.value.oddness(texts, langs))] if len(names) > 2 else []
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), *odd], names=[*part.schema.names, *names])

    source = docs.drop(*names)
    schema = T.StructType([*source.schema.fields, T.StructField(names[0], T.StringType()), *(T.StructField(n, T.DoubleType()) for n in names[1:])])
    return source.mapInArrow(scored, schema)
