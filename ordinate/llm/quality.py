"""Quality classifier from weak labels: EM over overlapping heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

import math
import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm.common import SAMPLE_TASKS, hash_sample, map_column, table
from ordinate.llm.hashing import fit_logistic, ngrams

SIZES, BITS = (1, 2, 3), 14
#: The linear scorer is fitted on so many distinct documents at most, the first by hash of the text; EM counts all documents.
TRAIN_ROWS = 2000
LABELLERS = ("length", "symbols", "capitals", "repeated_lines", "repeated_words", "lone_signs", "repeated_triples", "sign_runs", "word_length", "line_ends", "digits", "boilerplate")
BOILERPLATE = ("lorem ipsum", "click here", "all rights reserved", "enable javascript", "cookie policy", "terms of service", "subscribe now", "buy now")
BAD, ABSTAIN, GOOD = 0, 1, 2
SYMBOLS = [ord(c) for c in "!#$%&*<=>@\\^_{|}~"]
#: Bytes of ASCII signs, and a word of signs only, without letters and digits.
SIGNS = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
SIGNS_ONLY = re.compile(r"(?<!\S)(?:[^\w\s]|_)++(?!\S)")
#: Full steps of the scorer's fit.
STEPS = 120
#: A figure's weight in the scorer beside the text's n-grams, which have unit length.
FIGURE = 0.25


def _side(value: float, good: float, bad: float) -> int:
    """A vote by two thresholds; what lies between abstains, and so does NaN."""
    if value != value:
        return ABSTAIN
    if good <= bad:
        return GOOD if value <= good else BAD if value >= bad else ABSTAIN
    return GOOD if value >= good else BAD if value <= bad else ABSTAIN


def statistics(text: str) -> tuple[float, ...]:
    """Each labeller's figure for the whole text; NaN where the text is too short for it."""
    words = text.split()
    n, nothing = len(words), float("nan")
    if not n:
        return (0.0,) + (nothing,) * (len(LABELLERS) - 1)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    kind = np.bincount(raw, minlength=256)
    upper, lower, digits = int(kind[65:91].sum()), int(kind[97:123].sum()), int(kind[48:58].sum())
    symbols = int(kind[SYMBOLS].sum())
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    low = text.lower()
    h = np.fromiter(map(hash, words), np.int64, n)
    triples = (h[:-2] * 31 + h[1:-1]) * 31 + h[2:] if n > 2 else h[:0]
    sign = SIGNS[raw]
    # a word of signs only starts with one, or with a byte of another script's sign; most texts have no such place
    starts = (raw[1:] > 32) & (raw[:-1] <= 32) & (sign[1:] | (raw[1:] > 127))
    maybe = bool(sign[0] or raw[0] > 127 or starts.any())
    return (
        float(n),
        symbols / n,
        upper / max(upper + lower, 1),
        nothing if len(lines) < 3 else 1 - len(set(lines)) / len(lines),
        nothing if n < 5 else float(np.count_nonzero(h[1:] == h[:-1])) / n,
        len(SIGNS_ONLY.findall(text)) / n if maybe else 0.0,
        nothing if n < 12 else 1 - len(np.unique(triples)) / len(triples),
        float(np.count_nonzero(sign[1:] & sign[:-1])) / n,
        abs(len(text) / n - 6.5),
        sum(x[-1] in '.!?"”…:;' for x in lines) / len(lines),
        digits / len(text),
        float(any(b in low for b in BOILERPLATE)),
    )


def votes(figures: tuple[float, ...]) -> tuple[int, ...]:
    """Each labeller's vote on a text's figures."""
    n, symbols, capitals, lines, words, lone, triples, runs, length, ends, digits, boilerplate = figures
    return (
        _side(n, 40, 3),
        _side(symbols, 0.03, 0.1),
        _side(capitals, 0.15, 0.4),
        _side(lines, 0.1, 0.3),
        _side(words, 0.05, 0.15),
        _side(lone, 0.03, 0.1),
        _side(triples, 0.05, 0.25),
        _side(runs, 0.02, 0.1),
        _side(length, 3.0, 6.0),
        _side(ends, 0.5, 0.05),
        _side(digits, 0.08, 0.25),
        BAD if boilerplate > 0 else ABSTAIN,
    )


def pattern(text: str | None, figures: tuple[float, ...] | None = None) -> int:
    """All votes as one number."""
    out = 0
    for v in votes(figures or statistics(text or "")):
        out = 3 * out + v
    return out


def expand(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))], 1)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of good for each pattern, accuracy of each labeller where it votes).

    Labellers are independent given the class; each has its own chance of
    BAD, where it votes, for either class, and says nothing where it abstains.
    Starts from the labellers' purpose, which is to find faults: each BAD vote makes bad likelier.
    """
    if not len(patterns):
        return np.zeros(0), np.full(len(LABELLERS), 0.5)
    v = expand(patterns)
    voted = np.stack([v == BAD, v == GOOD], 2).astype(float)
    p = 0.9 * np.exp(-1.5 * voted[:, :, 0].sum(1))
    for _ in range(steps):
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        seen = np.einsum("cn,nkv->ckv", weight, voted) + 0.5
        chance = seen / seen.sum(2, keepdims=True)
        log = np.log(prior) + np.einsum("nkv,ckv->nc", voted, np.log(chance))
        p = 1 / (1 + np.exp(-np.clip(log[:, 1] - log[:, 0], -30, 30)))
    right = prior[0] * chance[0, :, 0] + prior[1] * chance[1, :, 1]
    return p, right


def features(text: str, figures: tuple[float, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: n-grams of the raw text, case and signs included, with damped counts of unit length, and hashed (figure, size class) pairs."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    count = np.bincount(ngrams(a, SIZES, BITS), minlength=1 << BITS)
    index = np.flatnonzero(count)
    value = np.log1p(count[index])
    value = value / max(float(np.sqrt((value * value).sum())), 1e-9)
    classes = [(k, round(2 * math.log2(x + 0.01))) for k, x in enumerate(figures or statistics(text)) if x == x and k]  # but for the length
    extra = np.array([((k * 1009 + c + 64) * 0x9E3779B97F4A7C15 >> (64 - BITS)) & ((1 << BITS) - 1) for k, c in classes], np.int64)
    return np.concatenate([index, extra]), np.concatenate([value, np.full(len(extra), FIGURE)])


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> dict:
    """The model: posterior by vote pattern (counts over all documents) and the scorer's weights.

    The scorer's features are made where the sampled texts are; only they, at
    most 2^BITS a text, go to the one task that fits.
    """
    docs = docs.select(F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    make = lambda: lambda texts: [pa.array([pattern(t) for t in texts], pa.int32())]
    # a text has one pattern, so distinct texts add up over the patterns, 3^12 at most
    counted = map_column(docs, "text", "pattern int", make, drop=True).groupBy("pattern").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).collect()
    if not counted:
        return {"posterior": {}, "accuracy": np.full(len(LABELLERS), 0.5), "weight": np.zeros(1 << BITS), "bias": 0.0}
    counted = sorted((r["pattern"], r["n"], r["texts"]) for r in counted)
    patterns, counts = np.array([p for p, *_ in counted], np.int64), np.array([n for _, n, _ in counted], float)
    posterior, accuracy = expectation_maximisation(patterns, counts)
    by_pattern = dict(zip(patterns.tolist(), posterior.tolist()))

    def extract():
        def run(texts):
            made = [features(t or "") for t in texts]
            return [
                pa.array([by_pattern.get(pattern(t), 0.5) for t in texts], pa.float64()), pa.array([i.astype(np.int32) for i, _ in made], pa.list_(pa.int32())),
                pa.array([x.astype(np.float32) for _, x in made], pa.list_(pa.float32())),
            ]

        return run

    def train(batches):
        rows_ = sorted(((h, y, i.values.to_numpy(), x.values.to_numpy()) for b in batches for h, y, i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3))), key=lambda r: r[0])[:rows]
        w, b = fit_logistic([i for _, _, i, _ in rows_], np.array([y for _, y, _, _ in rows_]), np.ones(len(rows_)), np.full(1 << BITS, 4.0), [x for *_, x in rows_], l2=1e-2, steps=STEPS, rate=0.1)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((w * 4.0, b))], pa.binary())], names=["model"])

    # distinct texts: a hot text would otherwise fill the sample
    least = hash_sample(docs, ["text"], rows, sum(t for *_, t in counted)).groupBy("h").agg(F.min("text").alias("text"))
    sample = map_column(least.select("h", "text").repartition(SAMPLE_TASKS, "h"), "text", "y double, index array<int>, value array<float>", extract, drop=True)
    weight, bias = pickle.loads(sample.repartition(1).mapInArrow(train, "model binary").first()["model"])
    return {"posterior": by_pattern, "accuracy": accuracy, "weight": weight, "bias": bias}


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """One row for each document: doc_id, votes, weak_label, score, predicted (1: good).

    A null or empty text is judged as an empty one, and scores 0; a very long
    one is judged whole.  Scores of 0.5 count as good.  Repeated rows are judged
    alike and are one text to the scorer's sample.  Other columns aren't read,
    whatever their names.  An empty table gives no rows.
    """

    def make():
        weight, bias, posterior = model["weight"], model["bias"], model["posterior"]

        def score(text, figures):
            if not (text and text.strip()):
                return 0.0
            i, x = features(text, figures)
            return float(1 / (1 + np.exp(-np.clip(bias + weight[i] @ x, -30, 30))))

        def run(texts):
            figures = [statistics(t or "") for t in texts]
            p = [pattern(t, f) for t, f in zip(texts, figures)]
            voted = ["".join("-0+"[v] for v in row) for row in expand(np.array(p, np.int64)).tolist()] if p else []
            return [pa.array(voted, pa.string()), pa.array([posterior.get(x, 0.5) for x in p], pa.float64()), pa.array([score(t, f) for t, f in zip(texts, figures)], pa.float64())]

        return run

    scored = map_column(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", "votes string, weak_label double, score double", make, drop=True)
    return scored.select("doc_id", "votes", "weak_label", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs))
