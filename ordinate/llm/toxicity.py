"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ordinate.llm.common import SAMPLE_TASKS, bound_batches, checkpoint, hash_sample, held_out, map_column, rewrite_texts, table
from ordinate.llm.hashing import fit_logistic, letters, ngrams, spaced

SIZES, BITS = (4, 5, 6), 20
#: The model is fitted on so many labelled rows of each class at most, the first by hash of the id.
TRAIN_ROWS_PER_CLASS = 3000
#: Features that enter the linear model: by significance of the ratio, at least LEAST and at most MOST.
LEAST, MOST, SIGNIFICANT = 64, 4096, 4.5


def features(text: str, is_letter: np.ndarray) -> np.ndarray:
    """Buckets of the text's n-grams, each once."""
    return np.unique(ngrams(spaced(text, is_letter), SIZES, BITS))


def choose(count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, log-count ratios) of the features to use.  count[c, bucket]: texts of class c that hold it; total[c]: texts."""
    # the ratio of document frequencies, smoothed by the overall frequency
    overall = count.sum(0) / total.sum()
    rate = [(count[c] + 0.5 * (overall + 0.5)) / (total[c] + 1) for c in (0, 1)]
    ratio = np.log(rate[1] / rate[0])
    z = ratio / np.sqrt(1 / (count[1] + 0.5) + 1 / (count[0] + 0.5))
    # an expected difference of proportions keeps rare buckets from passing by smoothing alone
    spread = np.sqrt(np.maximum(overall * (1 - overall), 1e-9) * (1 / total[0] + 1 / total[1]))
    z = np.sign(ratio) * np.minimum(np.abs(count[1] / total[1] - count[0] / total[0]) / spread, np.abs(z) * 2)
    order = np.lexsort((np.arange(len(z)), -np.abs(z)))
    size = min(MOST, max(LEAST, int((np.abs(z) >= SIGNIFICANT).sum())))
    chosen = np.sort(order[:size])
    return chosen, ratio[chosen]


def weigh(rows: list[np.ndarray], y: np.ndarray, chosen: np.ndarray, ratio: np.ndarray) -> dict:
    """The model over rows of slots into ``chosen``; the rarer class counts for more."""
    total = [float((y == c).sum()) for c in (0, 1)]
    weight = np.where(y == 1, len(y) / total[1] / 2, len(y) / total[0] / 2) ** 0.5
    w, bias = fit_logistic(rows, y, weight, ratio)
    return {"bucket": chosen, "weight": w * ratio, "bias": bias}


def constant(share: float) -> dict:
    """A model without features, for rows of one class or none."""
    return {"bucket": np.zeros(0, np.int64), "weight": np.zeros(0), "bias": 30.0 if share else -30.0}


def slots(chosen: np.ndarray) -> np.ndarray:
    slot = np.full(1 << BITS, -1, np.int64)
    slot[chosen] = np.arange(len(chosen))
    return slot


def fit(texts: list[str], labels: list[int]) -> dict:
    """The model of a few texts in one place.  Without rows of both classes every text scores as the one class (0 if no rows)."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return constant(float(y[0]) if len(y) else 0.0)
    is_letter, count = letters(), np.zeros((2, 1 << BITS))
    for text, label in zip(texts, labels):
        count[label][features(text, is_letter)] += 1
    chosen, ratio = choose(count, np.array([float((y == c).sum()) for c in (0, 1)]))
    slot = slots(chosen)
    return weigh([s[s >= 0] for s in (slot[features(t, is_letter)] for t in texts)], y, chosen, ratio)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = TRAIN_ROWS_PER_CLASS) -> DataFrame:
    """(doc_id, text, label) of the bounded training sample: the first rows of each class by hash of the id, none held out.

    Of several labels for one id the largest counts, of several texts the least;
    null ids, labels and texts are left out.  As labels may lack their document,
    twice as many are looked up.
    """
    usable = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("label").alias("label"))
    size = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    first = [hash_sample(usable.where(F.col("label") == c), ["doc_id"], 2 * per_class, size.get(c, 0)).orderBy(*order).limit(2 * per_class) for c in (0, 1)]
    # bounded by four times per_class, so it can be broadcast
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(first[0].union(first[1])), "doc_id").where("text is not null")
    one = checkpoint(joined.groupBy("doc_id", "label").agg(F.min("text").alias("text")).repartition(SAMPLE_TASKS, "doc_id"))
    # ids only are ranked; texts stay where they are
    ranked = one.select("doc_id", "label").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(*order)))
    return one.join(F.broadcast(ranked.where(F.col("r") <= per_class).select("doc_id")), "doc_id").select("doc_id", "text", "label")


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = TRAIN_ROWS_PER_CLASS) -> dict:
    """Fit over the bounded sample.

    Its texts are read once and stay spread over tasks: they count their
    features in parallel, and then send those of the chosen ones, MOST a text at most.
    """
    sample = labelled_sample(docs, labels, label, per_class)
    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return constant(float(max(total, default=0)))

    def tally(batches):
        is_letter, count = letters(), np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                count[y][features(text, is_letter)] += 1
        at = np.flatnonzero(count.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[0, at]), pa.array(count[1, at])], names=["bucket", "n0", "n1"])

    bound_batches(sample)
    counted = sample.select("text", "label").mapInArrow(tally, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    found = counted.where(F.col("n0") + F.col("n1") > 1).toArrow()  # 2^BITS rows at most
    count = np.zeros((2, 1 << BITS))
    for c in (0, 1):
        count[c, found.column(0).to_numpy()] = found.column(1 + c).to_numpy()
    chosen, ratio = choose(count, np.array([float(total[0]), float(total[1])]))

    def pick():
        is_letter, slot = letters(), slots(chosen)
        return lambda texts: [pa.array([s[s >= 0].astype(np.int32) for s in (slot[features(t, is_letter)] for t in texts)], pa.list_(pa.int32()))]

    rows = sorted(map_column(sample.select("doc_id", "label", "text"), "text", "slots array<int>", pick, drop=True).collect(), key=lambda r: r["doc_id"])
    return weigh([np.array(r["slots"], np.int64) for r in rows], np.array([float(r["label"]) for r in rows]), chosen, ratio)


def scorer(model: dict):
    """A function from a text (None: empty) to its score."""
    is_letter = letters()
    weight = np.zeros(1 << BITS, np.float64)
    weight[model["bucket"]] = model["weight"]
    used = np.zeros(1 << BITS, bool)
    used[model["bucket"]] = True
    bias = model["bias"]

    def score(text: str | None) -> float:
        h = ngrams(spaced(text or "", is_letter), SIZES, BITS)
        z = bias + weight[np.unique(h[used[h]])].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return score


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted.

    Null and empty texts score by the bias alone, very long ones whole.  A score
    of 0.5 counts as toxic.  Repeated rows score alike; a null id counts as the
    text "".  Other columns aren't read, whatever their names.  An empty table
    gives no rows; without labels of both classes all rows score alike.
    """

    def make():
        score = scorer(model)
        return lambda texts: [pa.array([score(t) for t in texts], pa.float64())]

    scored = map_column(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", "score double", make, drop=True)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: dict) -> DataFrame:
    """The documents whose score is under 0.5, as they are."""

    def make():
        score = scorer(model)
        return lambda texts: (texts, [score(t) < 0.5 for t in texts])

    return rewrite_texts(docs, make)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
