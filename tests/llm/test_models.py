"""Language, quality and toxicity: edge cases, and accuracy on held-out rows."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordinate.llm import hashing, langid, quality, toxicity

SF = Path("/root/testdata/sf0.01")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and clashing names."""
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (3, "12 34 !?", "en", "s", 8), (None, "the cat sat", "en", "s", 11), (4, "x" * 300_000, "de", "s", 300_000), (5, "das ist gut", "de", "s", 11), (5, "das ist gut", "de", "s", 11), (6, "the dog ran", "en", "s", 11)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("mine")).withColumn("label", F.lit(9))


def test_spaced_and_ngrams():
    is_letter = hashing.letters()
    assert "".join(map(chr, hashing.spaced("Ab, 12\nÉc!", is_letter))) == " ab éc "
    a = hashing.spaced("abc", is_letter)
    assert len(hashing.ngrams(a, (2, 3), 20)) == 4 + 3 and len(hashing.ngrams(a, (9,), 20)) == 0
    assert (hashing.ngrams(a, (2,), 20) < 1 << 20).all()


def test_language_edges(spark, odd):
    found = langid.identify(odd, langid.language_profiles(odd)).collect()
    assert len(found) == 8
    by = {r["doc_id"]: r for r in found}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[3]["lang_pred"] == "und"
    assert all(r["held_out"] == out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in found)
    nothing = odd.where("doc_id < 0")
    assert langid.language_profiles(nothing) == {} and langid.identify(nothing, {}).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}


def test_language_distance_against_plain():
    is_letter = hashing.letters()
    text = "the quick brown fox the lazy dog the end"
    code, count = langid.counts(text, is_letter)
    padded, plain = f" {text} ", {}
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            g = padded[i : i + n]
            if g != " ":
                plain[g] = plain.get(g, 0) + 1
    assert dict(zip(("".join(chr(int(c) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(c) >> s & 0x1FFFFF) for c in code), count.tolist())) == plain
    doc = langid.profile(code, count, 5)
    rank = np.array([[0], [3]])
    known = np.sort(doc[[0, 2]])
    places = {int(c): k for k, c in enumerate(doc)}
    expected = sum(abs(int(rank[list(known).index(c)][0]) - places[int(c)]) if c in known else langid.LANGUAGE_RANKS for c in doc)
    assert langid.distances(doc, known, rank).tolist() == [expected]


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    row = langid.op4_language_id(spark, str(SF)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert row[0] > 0.95


def test_toxicity_edges(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, None), (4, 0), (5, 1), (5, 0), (None, 1), (6, 7), (77, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    found = toxicity.score_documents(odd, model).collect()
    assert len(found) == 8 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == out(r["doc_id"]) for r in found)
    assert toxicity.train(odd, labels.where("doc_id < 0"))["bias"] == -30.0
    kept = toxicity.reject_toxic(odd, {"bucket": np.zeros(0, np.int64), "weight": np.zeros(0), "bias": -30.0})
    assert kept.columns == odd.columns and sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))
    assert toxicity.reject_toxic(odd.where("doc_id < 0"), model).count() == 0


def test_toxicity_learns_ngrams():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("aeioustrn"), 6))
    texts, labels = [], []
    for k in range(200):
        words = [word() for _ in range(50)]
        if k % 4 == 0:
            words[rng.integers(50)] = "blork" + word()
        texts.append(" ".join(words))
        labels.append(int(k % 4 == 0))
    score = toxicity.scorer(toxicity.fit(texts, labels))
    for _ in range(20):
        clean = [word() for _ in range(60)]
        assert score(" ".join(clean)) < 0.5 <= score(" ".join([*clean, "blorkxyz"]))


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.9, 0.7, 0.6, 0.8, 0.85, 0.9, 0.75])
    right = rng.random((len(truth), 12)) < accuracy
    votes = np.where(right == truth[:, None], quality.GOOD, quality.BAD)
    votes[rng.random(votes.shape) < 0.3] = quality.ABSTAIN
    patterns = (votes * 3 ** np.arange(11, -1, -1)).sum(1)
    each, counts = np.unique(patterns, return_counts=True)
    posterior, found = quality.expectation_maximisation(each, counts.astype(float))
    assert np.abs(found - accuracy).max() < 0.03
    by = dict(zip(each.tolist(), posterior))
    assert np.mean([(by[p] > 0.5) == t for p, t in zip(patterns.tolist(), truth)]) > 0.95


def test_quality_edges(spark, odd):
    model = quality.fit(odd)
    found = quality.score_documents(odd, model).collect()
    assert len(found) == 8 and all(len(r["votes"]) == 12 and 0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in found if r["doc_id"] in (1, 2)} == {0.0}
    none = quality.fit(odd.where("doc_id < 0"))
    assert quality.score_documents(odd.where("doc_id < 0"), none).count() == 0


def test_votes_and_sample():
    """Whole texts, and repeated texts are one text to the scorer."""
    by = lambda text: dict(zip(quality.LABELLERS, quality.votes(quality.statistics(text))))
    rng = np.random.default_rng(5)
    fresh = " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000))
    again = " ".join([fresh] * 3)
    assert by(fresh)["repeated_triples"] == quality.GOOD and by(again)["repeated_triples"] == quality.BAD
    assert by("buy buy buy buy now now now now")["repeated_words"] == quality.BAD and by("menu | home | about | login")["lone_signs"] == quality.BAD
    assert by("good*** words%%% here### and$$$ there")["sign_runs"] == quality.BAD and by("THIS IS ALL LOUD")["capitals"] == quality.BAD
    assert quality.votes(quality.statistics(""))[1:] == (quality.ABSTAIN,) * 11


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_quality_finds_the_bad(spark):
    """A constant has a balanced accuracy of one half; labels aren't used in training."""
    sf = "/root/testdata/sf0.1"
    found = quality.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "predicted").collect()
    good, bad = ([r["predicted"] for r in found if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.95 and 1 - sum(bad) / len(bad) > 0.8


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_toxicity_finds_the_toxic(spark):
    """Recall and precision on held-out rows; a constant fails."""
    sf = "/root/testdata/sf0.1"
    found = toxicity.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 == r["toxic"] for r in found)
    assert hit / sum(r["toxic"] for r in found) > 0.85 and hit / sum(r["predicted"] for r in found) > 0.85


def test_training_of_repeated_ids_is_definite(spark):
    """Of several texts for an id the least counts; labels without a document don't use up the sample."""
    texts = [(k, f"{'vile' if k % 2 else 'fine'} word{k} more of it", "en") for k in range(60)]
    docs = spark.createDataFrame([*texts, *[(1, f"zzz {k}", "en") for k in range(20)]], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1000 + k, 1) for k in range(20)], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs, labels, "toxic", 20).collect()
    assert sum(r["label"] for r in sample) == 20 and len(sample) == 40 and all(not r["text"].startswith("zzz") for r in sample)
    once, again = toxicity.train(docs, labels), toxicity.train(docs.orderBy(F.desc("text")), labels)
    assert np.array_equal(once["bucket"], again["bucket"]) and np.allclose(once["weight"], again["weight"])
    a, b = langid.language_profiles(docs), langid.language_profiles(docs.orderBy(F.desc("text")))
    assert a.keys() == b.keys() and all(np.array_equal(a[k], b[k]) for k in a)


def test_ties(spark):
    """Of equally near languages the first name wins with score 0; a score of one half counts as good, and as toxic."""
    docs = spark.createDataFrame([(1, "the cat sat"), (2, None), (3, "x" * 200_000)], "doc_id long, text string")
    same = langid.profile(*langid.counts("the dog ran", hashing.letters()), 100)
    found = {r["doc_id"]: r for r in langid.identify(docs, {"a": same, "b": same}).collect()}
    assert (found[1]["lang_pred"], found[1]["score"]) == ("a", 0.0) and found[2]["lang_pred"] == "und" and found[3]["lang_pred"] == "a"
    even = {"posterior": {}, "accuracy": None, "weight": np.zeros(1 << quality.BITS), "bias": 0.0}
    assert {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score_documents(docs, even).collect()} == {1: (0.5, 1), 2: (0.0, 0), 3: (0.5, 1)}
    half = {"bucket": np.zeros(0, np.int64), "weight": np.zeros(0), "bias": 0.0}
    assert all((r["score"], r["predicted"]) == (0.5, 1) for r in toxicity.score_documents(docs, half).collect())
