"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1 that follows from its code point alone. A trigram's vector is the product
of its letters' vectors, the first rotated twice and the second once (what is not a letter, and the ends of a text,
count as one blank); a text's vector is the sum over its trigrams, a language's prototype the sum over its training
texts. A text takes the language of the prototype with the greatest cosine. Sums are integers, so prototypes do not
depend on the order in which tasks end.

Null texts and texts without letters are ``und`` with score 0, as is every text where nothing was learned. Ties go to
the language that sorts first. Training rows without a language teach nothing. Texts are read whole, in Arrow batches
that are cut into blocks; the driver gets languages x DIMENSIONS numbers (more than MAX_LANGUAGES is an error).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from meritgraph.llm.common import appended, quoted, table

DIMENSIONS = 1024
SEED = 20_011
MAX_LANGUAGES = 1_000
BLOCK_CHARS = 1 << 19
BLOCK_TRIGRAMS = 1 << 13
SCORE_BINS = 1_000
MIN_DOCS = 30
SPREAD = 6
#: Cosines of independent vectors have a standard deviation of 1 / sqrt(DIMENSIONS); no limit is within five of them.
NOISE = 5 / DIMENSIONS**0.5


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=50_000)
def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng(SEED + code).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of a text (three code points of 21 bits each) and their counts."""
    codes = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes[~_letters()[codes]] = 0
    codes = codes[(codes > 0) | np.concatenate([[True], codes[:-1] > 0])]
    if not codes.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if codes[-1]:
        codes = np.append(codes, 0)
    return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)


def trigram_vectors(keys: np.ndarray) -> np.ndarray:
    parts = [(keys >> 42) & 0x1FFFFF, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF]
    out = np.ones((len(keys), DIMENSIONS), dtype=np.int8)
    for shift, part in zip((2, 1, 0), parts, strict=True):
        codes, at = np.unique(part, return_inverse=True)
        out *= np.stack([np.roll(letter_vector(int(c)), shift) for c in codes])[at]
    return out


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of texts of about BLOCK_CHARS characters in all: the first one's place, and their trigrams."""
    first, block, size = 0, [], 0
    for i, text in enumerate(texts):
        block.append(trigrams(text))
        size += len(text or "")
        if size >= BLOCK_CHARS:
            yield first, block
            first, block, size = i + 1, [], 0
    if block:
        yield first, block


def text_vectors(block: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A vector for each text of a block; a range of trigrams at a time, so memory is bounded."""
    out = np.zeros((len(block), DIMENSIONS), dtype=np.float32)
    known = np.unique(np.concatenate([np.empty(0, np.int64), *(k for k, _ in block)]))
    for at in range(0, len(known), BLOCK_TRIGRAMS):
        own = known[at : at + BLOCK_TRIGRAMS]
        vectors = trigram_vectors(own).astype(np.float32)
        for i, (keys, counts) in enumerate(block):
            a, b = np.searchsorted(keys, [own[0], own[-1] + 1])
            if b > a:
                out[i] += counts[a:b].astype(np.float32) @ vectors[np.searchsorted(own, keys[a:b])]
    return out


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes by language, from the columns text and lang of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = (batch.column(i).to_pylist() for i in (0, 1))
            for first, block in _blocks(texts):
                by: dict[str, list] = {}
                for (keys, counts), lang in zip(block, langs[first : first + len(block)], strict=True):
                    by.setdefault(lang, []).append((keys, counts))
                for lang, own in by.items():
                    keys, at = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True)
                    counts = np.bincount(at, weights=np.concatenate([c for _, c in own]), minlength=len(keys))
                    total = sums.setdefault(lang, np.zeros(DIMENSIONS, dtype=np.int64))
                    for a in range(0, len(keys), BLOCK_TRIGRAMS):  # products of integers below 2^53 are exact
                        total += np.rint(counts[a : a + BLOCK_TRIGRAMS] @ trigram_vectors(keys[a : a + BLOCK_TRIGRAMS]).astype(np.float64)).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], names=["lang", "vector"])

    known = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    parts = known.mapInArrow(run, "lang string, vector array<bigint>")
    summed = parts.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("x"))
    rows = summed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v")).limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return {r.lang: np.array([x.x for x in r.v], dtype=np.float64) for r in sorted(rows)}


def _matrix(prototypes: dict[str, np.ndarray]) -> np.ndarray:
    """Prototypes of length one, in columns."""
    return np.stack([v / max(np.linalg.norm(v), 1.0) for v in prototypes.values()]).astype(np.float32).T


def _cosines(block: list[tuple[np.ndarray, np.ndarray]], matrix: np.ndarray) -> np.ndarray:
    vectors = text_vectors(block)
    return vectors @ matrix / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def least_scores(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> dict[str, float]:
    """For each language the least score of a text in it, from the scores of all documents with that label: half the
    lower quartile, or less where the scores are spread wider (SPREAD interquartile ranges below it), but over NOISE.
    Scores are counted by bin; languages of under MIN_DOCS documents take the limit of all documents together."""
    if not prototypes:
        return {}
    places, matrix = {l: i for i, l in enumerate(prototypes)}, _matrix(prototypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            texts, langs = (batch.column(i).to_pylist() for i in (0, 1))
            for first, block in _blocks(texts):
                for (keys, _), lang, row in zip(block, langs[first : first + len(block)], _cosines(block, matrix), strict=True):
                    if len(keys) and lang in places:
                        counts[lang, int(max(0.0, float(row[places[lang]])) * SCORE_BINS)] += 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["lang", "bin", "n"])

    known = docs.where(F.col("lang").isNotNull()).select("text", "lang")
    summed = known.mapInArrow(run, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    quartiles = F.percentile("bin", F.array(F.lit(0.25), F.lit(0.75)), F.col("n"))
    rows = summed.rollup("lang").agg(F.sum("n").alias("n"), quartiles.alias("q")).where(F.col("n") > 0).collect()
    limits = {}
    for r in rows:
        q1, q3 = (x / SCORE_BINS for x in r.q)
        if r.lang is None or r.n >= MIN_DOCS:
            limits[r.lang] = max(NOISE, min(q1 / 2, q1 - SPREAD * (q3 - q1)))
    return {lang: limits.get(lang, limits.get(None, NOISE)) for lang in prototypes}


def classify(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: list[str], pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and lang_score."""
    if clash := {pred.lower(), score.lower()} & {c.lower() for c in keep}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    names = list(prototypes)
    matrix = _matrix(prototypes) if names else None

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        found, scores = [], []
        for _, block in _blocks(batch.column(batch.num_columns - 1).to_pylist()):
            cosines = _cosines(block, matrix) if names else np.zeros((len(block), 1))
            for (keys, _), row in zip(block, cosines, strict=True):
                fits = names and len(keys)
                found.append(names[int(np.argmax(row))] if fits else "und")
                scores.append(min(1.0, max(0.0, float(row.max()))) if fits else 0.0)
        return [pa.array(found, pa.string()), pa.array(scores, pa.float64())]

    read = docs.select(*quoted(keep), F.col("text").alias("_"))  # the text once more, last
    return appended(read, len(keep), [StructField(pred, StringType()), StructField(score, DoubleType())], make)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    prototypes = learn(docs.where(~held_out))
    return classify(docs, prototypes, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
