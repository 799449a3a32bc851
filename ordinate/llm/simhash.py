"""SimHash near-duplicates by anchor-point covering.

The 64 fingerprint bits are two halves of 32.  Fingerprints that differ in at
most 3 bits differ in at most 1 bit of one half, so each half is joined with
threshold 1.  In a half, 31 bits are covered by the perfect Hamming code [31, 26]
(covering radius 1) and one bit stands for itself; its code words are the anchors.
A fingerprint's home is its one anchor within the covering radius.  It is also
replicated to every anchor within the radius plus the threshold, which are 2
or 17 of 2^27.  Per anchor, homes are compared with replicas.  No pair within
the threshold is lost, and no anchor is reached by more than near fingerprints.

Equal fingerprints are one class with a count, so copies never form pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm.common import checkpoint, fresh, map_column, table

THRESHOLD = 3
#: (id, text hash) pairs are broadcast up to so many bytes.
BROADCAST_BYTES = 32_000_000
#: A key is hot with more than LEAST_HOT rows and more than a HOT_SHARE-th of all, so that at most HOT_SHARE are; hot anchors are spread over SALTS.
HOT_SHARE, LEAST_HOT, SALTS = 1000, 10_000, 64
#: Shingles of a text whose bits are in memory at a time.
BLOCK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash of the 3-word shingles; 0 for a text without words, null included."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    digest = xxhash.xxh64_digest
    if n < 3:
        return int.from_bytes(digest(b" ".join(words), 42), "big", signed=True)
    joined = b" ".join(words)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    first, last = starts[: n - 2].tolist(), (starts[3:] - 1).tolist()
    total = np.zeros(64, np.int64)
    for k in range(0, n - 2, BLOCK):
        hashes = b"".join([digest(joined[s:e], 42) for s, e in zip(first[k : k + BLOCK], last[k : k + BLOCK])])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n - 2).tobytes(), "big", signed=True)


def _make():
    return lambda texts: [pa.array([fingerprint(t) for t in texts], pa.int64())]


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    return map_column(docs, text, f"`{name}` long", _make, binary=True, drop=True)


def _anchors(fp: Column, half: int) -> tuple[Column, Column]:
    """The home anchor and all anchors in reach, as longs with the half in bit 32."""
    v = F.shiftrightunsigned(fp, 32) if half else fp.bitwiseAND(F.lit(0xFFFFFFFF))
    syndrome = F.lit(0)
    for j in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)
        syndrome = syndrome + F.shiftleft(F.bit_count(v.bitwiseAND(F.lit(mask))).cast("int").bitwiseAND(F.lit(1)), j)
    bit = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(31)])
    home = v.bitwiseXOR(bit[syndrome]).bitwiseOR(F.lit(half << 32))
    # code words at distance 2: flip i and i xor syndrome, each pair once
    numbers = F.array(*[F.lit(i) for i in range(1, 32)])
    two = F.transform(F.filter(numbers, lambda i: i < i.bitwiseXOR(syndrome)), lambda i: v.bitwiseXOR(bit[i]).bitwiseXOR(bit[i.bitwiseXOR(syndrome)]).bitwiseOR(F.lit(half << 32)))
    near = F.array(home, home.bitwiseXOR(F.lit(1 << 31)))
    return home, F.when(syndrome == 0, near).otherwise(F.concat(near, two))


def linked_pairs(classes: DataFrame, fp: str = "fp") -> DataFrame:
    """All pairs a < b of distinct fingerprints that differ in 1 to 3 bits, each once."""
    both = [_anchors(F.col(fp), half) for half in (0, 1)]
    homes = classes.select(F.explode(F.array(*[h for h, _ in both])).alias("anchor"), F.col(fp).alias("a"))
    reach = classes.select(F.explode(F.concat(*[r for _, r in both])).alias("anchor"), F.col(fp).alias("b"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= THRESHOLD)
    hot = hot_keys(homes.groupBy("anchor").agg(F.count("*").alias("n")), "anchor")
    if not hot:
        return homes.join(reach, "anchor").where(near).select("a", "b").distinct()
    at = F.col("anchor").isin(hot)
    salted = homes.where(at).withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
    spread = reach.where(at).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = homes.where(~at).join(reach.where(~at), "anchor").select("a", "b").unionByName(salted.join(spread, ["anchor", "salt"]).select("a", "b"))
    return found.where(near).distinct()


def hot_keys(counted: DataFrame, key: str, n: str = "n") -> list:
    """The keys that hold more than their share of the rows; ``counted`` has one row for each key.  At most HOT_SHARE, by definition."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    if total <= LEAST_HOT:
        return []
    return [r[0] for r in counted.where((F.col(n) > LEAST_HOT) & (F.col(n) * HOT_SHARE > total)).select(key).collect()]


def join_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with what their class (fp, n, ...) has; the rows of hot classes don't move, as those classes are broadcast."""
    hot = hot_keys(classes, "fp")
    if not hot:
        return rows.join(classes, "fp")
    at = F.col("fp").isin(hot)
    return rows.where(~at).join(classes.where(~at), "fp").unionByName(rows.where(at).join(F.broadcast(classes.where(at)), "fp"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of edges (a, b), by alternating large-star and small-star steps.

    The root is a component's least node.  Every step is an aggregation with a
    join; a step's edges are checkpointed, so a lost executor costs one step.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi > lo").distinct())
    sign = None
    while True:
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo")
        edges = checkpoint(small.union(low.select("hi", "m")).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    return edges.union(edges.select("lo", "lo").distinct()).toDF("node", "root")


def near_classes(keys: DataFrame) -> DataFrame:
    """(fp, n, n_near, component_id, best) for each fingerprint among ``keys`` (doc_id, mark, fp).

    n: its rows.  n_near counts a row's links: other rows of its class, and rows
    of linked classes.  best: the least (doc_id, mark) of its component.
    """
    classes = checkpoint(keys.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "mark")).alias("first")))
    pairs = checkpoint(linked_pairs(classes))
    both = pairs.union(pairs.select("b", "a")).toDF("fp", "other")
    linked = both.join(classes.select(F.col("fp").alias("other"), "n"), "other").groupBy("fp").agg(F.sum("n").alias("linked"))
    roots = components(pairs).select(F.col("node").alias("fp"), "root")
    whole = checkpoint(classes.join(linked, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    named = whole.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("best"))
    return checkpoint(whole.join(named, "root").select("fp", "n", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_near"), "component_id", "best"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, fingerprint, n_near, component_id.

    Null and empty texts have fingerprint zero and link like any other.  Rows
    are documents, so rows that repeat an id link to each other.  A null id is
    kept and never names a component unless all its ids are null.  Very long
    texts are hashed whole, in blocks of shingles; a bit set in exactly half the
    hashes is 0.  Other columns of ``docs`` aren't read, whatever their names.
    An empty table gives no rows.
    """
    keys = checkpoint(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), "text", "fp").select("doc_id", F.lit(0).alias("mark"), "fp"))
    return join_classes(keys, near_classes(keys)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "n_near", "component_id")


def keep_one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents without near-duplicates: of each component the row with the least (id, text hash) stays.

    A null id is less than any other.  Rows that repeat both id and text are one
    document, of which one row stays.  Columns stay as they are.  What goes is
    broadcast if it is small (BROADCAST_BYTES) and joined by shuffle otherwise.
    An empty table gives no rows.
    """
    (mark,) = fresh(docs, "text_hash")
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    keys = checkpoint(with_fingerprint(narrow, "text", "fp").select("doc_id", "mark", "fp"))
    judged = join_classes(keys, near_classes(keys).select("fp", "n", "best")).select("doc_id", "mark", (F.struct("doc_id", "mark") == F.col("best")).alias("stays"))
    judged = checkpoint(judged.groupBy("doc_id", "mark", "stays").agg(F.count("*").alias("n")))
    gone = judged.where(~F.col("stays")).select("doc_id", "mark")
    repeated = judged.where("stays and n > 1").select("doc_id", "mark")

    def pick(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        small = right.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("doc_id").cast("string")), F.lit(0)) + 16), F.lit(0))).first()[0] <= BROADCAST_BYTES
        other = F.broadcast(right) if small else right
        return left.join(other, left[doc_id].eqNullSafe(other["doc_id"]) & (left[mark] == other["mark"]), how)

    marked = docs.withColumn(mark, F.xxhash64(F.col(text).cast("string")))
    kept = pick(marked, gone, "left_anti")
    if not repeated.isEmpty():
        again = pick(kept, repeated, "left_semi").dropDuplicates([doc_id, mark])
        kept = pick(kept, repeated, "left_anti").unionByName(again)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
