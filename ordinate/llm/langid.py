"""Language identification by rank-order n-gram profiles and out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ordinate.llm.common import SAMPLE_TASKS, held_out, map_column, table
from ordinate.llm.hashing import letters, spaced

SIZES = (1, 2, 3)
#: Most frequent n-grams of a language's and of a document's profile.
LANGUAGE_RANKS, DOCUMENT_RANKS = 1000, 300
#: A language's profile comes from so many labelled documents at most, the first by hash of the id.
TRAIN_ROWS_PER_LANGUAGE = 1000


def counts(text: str, is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams (21 bits a character, exact) and how often each occurs; a lone space is none."""
    a = spaced(text, is_letter).astype(np.uint64)
    codes = [a[a != 32]]
    for size in SIZES[1:]:
        if len(a) >= size:
            code = a[: len(a) - size + 1]
            for k in range(1, size):
                code = (code << np.uint64(21)) | a[k : len(a) - size + 1 + k]
            codes.append(code)
    return np.unique(np.concatenate(codes), return_counts=True)


def profile(code: np.ndarray, count: np.ndarray, ranks: int) -> np.ndarray:
    """Codes of the most frequent n-grams, first first; ties by code."""
    if len(code) > ranks:  # only what may be among them needs sorting
        least = np.partition(count, len(count) - ranks)[len(count) - ranks]
        keep = count >= least
        code, count = code[keep], count[keep]
    return code[np.lexsort((code, -count))][:ranks]


def distances(doc: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Out-of-place distance to each language.  rank[i, l]: place of known[i] in profile l; a missing n-gram is LANGUAGE_RANKS out of place."""
    place = np.arange(len(doc))
    at = np.searchsorted(known, doc)
    at[at == len(known)] = 0
    hit = known[at] == doc
    out = np.full((len(doc), rank.shape[1]), LANGUAGE_RANKS, np.int64)
    r = rank[at[hit]].astype(np.int64)
    out[hit] = np.where(r >= 0, np.abs(r - place[hit, None]), LANGUAGE_RANKS)
    return out.sum(axis=0)


def language_profiles(docs: DataFrame, rows: int = TRAIN_ROWS_PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Profiles from text and non-null lang of documents that aren't held out.

    N-grams are counted where the sampled texts are, added up by key, and only
    the most frequent of each language come to the driver.  Of rows that repeat
    an id and language the least text counts.
    """
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    # ids only: the window keeps the first rows of each partition before it shuffles
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows).select("doc_id", "lang")
    sample = usable.join(F.broadcast(chosen) if chosen.limit(200_001).count() <= 200_000 else chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letters()
        for batch in batches:
            by: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(counts(text, is_letter))
            for lang, made in by.items():
                code, where = np.unique(np.concatenate([c for c, _ in made]), return_inverse=True)
                n = np.bincount(where, np.concatenate([n for _, n in made]), len(code)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    added = sample.select("text", "lang").repartition(SAMPLE_TASKS, "text").mapInArrow(summed, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = added.withColumn("r", F.row_number().over(first)).where(F.col("r") <= LANGUAGE_RANKS).select("lang", "code", "r").collect()
    found: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["r"])):
        found.setdefault(r["lang"], []).append(r["code"])
    return {lang: np.array(code, np.uint64) for lang, code in found.items()}


def predictor(profiles: dict[str, np.ndarray]):
    """A function from a text to (language, score).

    The score is how much nearer the nearest language is than the next, from 0
    (a tie, which goes to the first name) to 1; with one language it is 1 less
    the distance's share of the largest possible.
    """
    is_letter, names = letters(), list(profiles)
    known = np.unique(np.concatenate([*profiles.values(), np.zeros(0, np.uint64)])) if names else np.zeros(0, np.uint64)
    rank = np.full((len(known), len(names)), -1, np.int16)
    for k, p in enumerate(profiles.values()):
        rank[np.searchsorted(known, p), k] = np.arange(len(p))

    def predict(text: str | None) -> tuple[str, float]:
        if text is None or not names:
            return "und", 0.0
        code, count = counts(text, is_letter)
        if not len(code) or code[-1] == 32:
            return "und", 0.0
        doc = profile(code, count, DOCUMENT_RANKS)
        d = distances(doc, known, rank)
        best = int(d.argmin())
        if len(d) == 1:
            return names[0], float(1 - d[0] / (LANGUAGE_RANKS * len(doc)))
        second = int(np.partition(d, 1)[1])
        return names[best], float(1 - d[best] / second) if second else 0.0

    return predict


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score.

    Texts that are null or have no letter are ``und`` with score 0, and so are
    all where nothing could be learned.  Of equally near languages the first
    name wins.  Very long texts are judged whole, repeated rows alike; columns
    other than doc_id and text aren't read.  An empty table gives no rows.
    """

    def make():
        predict = predictor(profiles)

        def run(texts):
            found = [predict(t) for t in texts]
            return [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]

        return run

    judged = map_column(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", "lang_pred string, score double", make, drop=True)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, language_profiles(docs))
