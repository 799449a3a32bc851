"""Nearest neighbours, near-duplicates and the pipeline against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from ordinate.llm import ann, common, decontam, mixing, secrets, simhash, toxicity

SF = Path("/root/testdata/sf0.001")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_near(prints):
    """(links, component as least index) by comparing all pairs."""
    n = len(prints)
    near = [[j for j in range(n) if j != i and (prints[i] ^ prints[j]).bit_count() <= 3] for i in range(n)]
    root = list(range(n))
    for i in range(n):
        if root[i] == i:
            todo = [i]
            while todo:
                for j in near[todo.pop()]:
                    if root[j] > i:
                        root[j] = i
                        todo.append(j)
    return [len(x) for x in near], root


def test_fingerprints_and_links(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(300)) for _ in range(12)]
    texts = [None, "", " \t", "one", "one two", "ONE two three", "x\x0by\x0cz", "é ü ß"]
    for t in base:
        for _ in range(4):
            w = t.split()
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        texts += [t, t]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], SCHEMA).withColumn("fp", F.lit("x"))
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [found[k]["fingerprint"] for k in range(len(texts))] == [f"{p:016x}" for p in prints]
    links, roots = plain_near(prints)
    assert [found[k]["n_near"] for k in range(len(texts))] == links and [found[k]["component_id"] for k in range(len(texts))] == roots
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots))
    assert simhash.near_duplicates(docs.where("doc_id < 0")).count() == 0 and simhash.keep_one_of_each(docs.where("doc_id < 0")).count() == 0


@pytest.mark.parametrize("most", [simhash.BROADCAST_BYTES, -1])
def test_repeated_and_null_ids(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "BROADCAST_BYTES", most)
    rows = [(1, "a b c d", None, None, 7)] * 3 + [(None, "a b c d", None, None, 7), (2, "q w e r t", "l", None, 9), (2, "something else entirely here", "l", "s", 1)]
    kept = simhash.keep_one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "a b c d"), (2, "q w e r t"), (2, "something else entirely here")]
    repeated = simhash.keep_one_of_each(spark.createDataFrame(rows[:3], SCHEMA)).collect()
    assert [(r["doc_id"], r["text"]) for r in repeated] == [(1, "a b c d")]


def test_fingerprint_of_a_long_text(monkeypatch):
    rng = random.Random(8)
    text = " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(3000))
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text.encode()) == whole and whole & (1 << 64) - 1 == plain_fingerprint(text)


@pytest.mark.parametrize("hot", [False, True])
def test_no_pair_is_lost(spark, monkeypatch, hot):
    """Also where all anchors and classes are hot."""
    if hot:
        monkeypatch.setattr(simhash, "LEAST_HOT", 1)
        docs = spark.createDataFrame([(k, "same text here" if k % 3 else f"other {k} text {k} of {k}") for k in range(60)], "doc_id long, text string")
        found = {r["doc_id"]: r["n_near"] for r in simhash.near_duplicates(docs).collect()}
        links, _ = plain_near([plain_fingerprint(r["text"]) for r in docs.orderBy("doc_id").collect()])
        assert [found[k] for k in range(60)] == links
    rng = random.Random(9)
    values = set()
    for _ in range(150):
        x = rng.getrandbits(64)
        values.add(x)
        for _ in range(4):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            values.add(y)
    values |= {0, 1, 3, 7, 15, 1 << 63, 1 << 31, (1 << 64) - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = {(r["a"], r["b"]) for r in simhash.linked_pairs(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    expected = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert found == expected


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (101, 102)], "a long, b long")
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 102: 100}
    assert simhash.components(edges.where("a < 0")).count() == 0


def brute(ids, x, k=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % 20 == 0:
            score = x @ x[i]
            score[i] = -np.inf
            best = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
            out[int(ids[i])] = [(int(ids[j]), score[j]) for j in best]
    return out


@pytest.mark.parametrize("n, unit", [(3000, True), (900, False)])
def test_nearest(spark, n, unit):
    rng = np.random.default_rng(n)
    centre = rng.standard_normal((8, 24))
    x = (centre[rng.integers(8, size=n)] + rng.standard_normal((n, 24))).astype(np.float32)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.random((n, 1)).astype(np.float32)
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(k, [float(v) for v in row]) for k, row in enumerate(x)], "vec_id long, embedding array<float>")
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    truth = brute(np.arange(n), x)
    assert found.keys() == truth.keys() and all(len(v) == 20 for v in found.values())
    hit = sum(len({a for a, _ in found[q]} & {a for a, _ in truth[q]}) for q in truth)
    assert hit / (20 * len(truth)) >= 0.9
    for q, rows in found.items():
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0])) and all(abs(s - x[q] @ x[v]) < 1e-9 and v != q for v, s in rows)


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, []), (20, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    found = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").select("query_id", "rank", "vec_id", "score").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert ann.nearest(df.where("vec_id < 0"), df).count() == 0


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_nearest_on_tables(spark):
    sf = Path("/root/testdata/sf0.1")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    truth = brute(rows.vec_id.to_numpy(), np.stack(rows.embedding.to_numpy()).astype(np.float64))
    found = {}
    for r in ann.op1_ann(spark, str(sf)).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["rank"]
    assert found.keys() == truth.keys() and all(sorted(v.values()) == list(range(1, 21)) for v in found.values())
    assert sum(len(found[q].keys() & {a for a, _ in truth[q]}) for q in truth) / (20 * len(truth)) >= 0.9


def test_nearest_of_hot_copies_and_many_lists(spark, monkeypatch):
    """A third of all rows is one vector, one id repeats often, and shards are many; every query has its k rows."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    monkeypatch.setattr(ann, "LEAST_SHARD_ROWS", 100)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 600)
    monkeypatch.setattr(ann, "SEEDS", 50)
    rng = np.random.default_rng(3)
    n = 1500
    x = rng.standard_normal((n, 24)).astype(np.float32).astype(np.float64)
    x[: n // 3] = x[0]
    rows = [(k, [float(v) for v in row]) for k, row in enumerate(x)] + [(n - 1, [float(v) for v in rng.standard_normal(24)]) for _ in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    truth = brute(np.arange(n), x)
    assert found.keys() == truth.keys() and all(len(v) == 20 == len({a for a, _ in v}) for v in found.values())
    for q in range(0, n // 3, 20):
        assert [a for a, _ in found[q]] == [a for a, _ in truth[q]]
    others = [q for q in truth if q >= n // 3]
    assert sum(len({a for a, _ in found[q]} & {a for a, _ in truth[q]}) for q in others) / (20 * len(others)) >= 0.85


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_pipeline(spark):
    """Each stage against plain code on what its predecessor kept."""
    docs = common.table(spark, str(SF), "documents")
    model = toxicity.train(docs, common.table(spark, str(SF), "labels"))
    score = toxicity.scorer(model)
    rows = [r for r in docs.collect() if score(r["text"]) < 0.5]
    prints = [plain_fingerprint(r["text"]) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: rows[i]["doc_id"])
    _, roots = plain_near([prints[i] for i in order])
    rows = [rows[order[k]] for k in sorted(set(roots))]
    matcher = decontam.Matcher([(str(r["item_id"]), r["text"].encode()) for r in common.table(spark, str(SF), "benchmark").collect()])
    done = [(r, *decontam.strip(r["text"], matcher)) for r in rows]
    kept = spark.createDataFrame([(r["doc_id"], t, r["lang"], r["source"], len(t) if t is not r["text"] else r["n_chars"]) for r, t, bad in done if not bad], SCHEMA)
    expected = mixing.mix(secrets.redact(kept)).collect()
    found = corpus_pipeline.run(spark, str(SF)).collect()
    assert sorted(map(str, found)) == sorted(map(str, expected)) and found
    assert all(not secrets.base_spans(r["text"]) for r in found)


@pytest.mark.skipif(not SF.exists(), reason="no test data")
def test_stages_on_odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names, and an empty table."""
    long = " ".join(f"word{k}" for k in range(200_000))
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, "the cat sat on the mat by the door", "en", "s", 34), (4, long, "de", "s", len(long)), (5, "das ist gut so wie es ist", "de", "s", 25), (5, "das ist gut so wie es ist", "de", "s", 25), (6, 'token = "abcdefgh12345"', None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("fp", "copy", "text_hash", "score", "Doc_Key", "keep")})
    for odd, left in ((docs, {None, 4, 5, 6}), (docs.where("doc_id < 0"), set())):
        now = odd
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            now = stage(spark, now, str(SF))
            assert now.columns == docs.columns
        kept = now.collect()
        assert {r["doc_id"] for r in kept} - {1, 2} == left and len({r["doc_id"] for r in kept}) == len(kept) == len(left) + bool(left)  # of the empty texts one stays
        assert all(r["copy"] == "mine" and (r["doc_id"] != 6 or r["text"] == "[REDACTED]" or "abcdefgh12345" not in r["text"]) for r in kept) and all(r["text"] == long for r in kept if r["doc_id"] == 4)
        mixed = corpus_pipeline.STAGES[-1][1](spark, now, str(SF))
        assert mixed.columns[: len(docs.columns)] == docs.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in kept}


def test_registered():
    names = list(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES][1].startswith("simhash")
