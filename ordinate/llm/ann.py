"""Approximate nearest neighbours by adaptive dimension scan over an inverted list index.

Largest inner product is turned into least distance by one more coordinate, so
that all vectors have one length.  The vectors are rotated at random and kept
in blocks of columns.  A query visits its nearest lists, the nearest of a shard
first; in each, candidates whose distance over the columns seen so far fails a
hypothesis test against the k-th best known are abandoned.  What is left is
measured exactly on the original vectors and tightens the bound for the next list.

Equal queries are searched once, and of vectors with many copies only those
with the least ids can be among the nearest, so no group of copies is hot.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ordinate.llm.common import hash_sample, table

K = 20
#: The index is fitted on so many vectors at least (all, if fewer), and on FIT_PER_LIST a list, up to MOST_SAMPLE; every vector is indexed.
SAMPLE_ROWS, FIT_PER_LIST, MOST_SAMPLE = 16_384, 8, 262_144
#: Lists are this multiple of the square root of the number of vectors (and need FIT_PER_LIST sample vectors each).
LISTS = 2.0
#: Sample queries and the recall that the probed lists must reach on them.
PROBE_QUERIES, PROBE_RECALL = 512, 0.95
#: The nearest of so many sample vectors give a query's first bound, and are results if nothing better is found.
SEEDS = 1024
#: A shard holds about so many vectors at most: small lists share one, a large list is spread over several.
SHARD_ROWS, LEAST_SHARD_ROWS = 65_536, 4096
#: Queries that are compared with a list at a time, and pairs at most.
QUERY_ROWS, PAIRS = 4096, 1_000_000
COLUMNS = 16
#: Larger: safer and slower.  The test is (D / d) * partial > (1 + EPSILON / sqrt(d))^2 * bound.
EPSILON = 1.5
#: Copies of one vector in the sample from which it counts as hot.
HOT = 8
SEED = 11


def usable(vector: Column, size: int | None = None) -> Column:
    """Not null, without null or non-finite components, not zero."""
    ok = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok if size is None else ok & (F.size(vector) == size), F.lit(False))


def rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def lifted(x: np.ndarray, longest: float, query: bool = False) -> np.ndarray:
    """One more coordinate: vectors become unit after division by the longest, queries by their own length."""
    if query:
        return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], 1)
    x = x / longest
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], 1)


def _closeness(y: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return y.astype(np.float32) @ centroids.T - 0.5 * (centroids * centroids).sum(1)


def _nearest_list(y: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmax(_closeness(y[i : i + 4096], centroids), axis=1) for i in range(0, len(y), 4096)] or [np.zeros(0, np.int64)])


def nearest_lists(y: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """Numbers of the nearest lists, nearest first."""
    near = -_closeness(y, centroids)
    if probes < near.shape[1]:
        part = np.argpartition(near, probes - 1, axis=1)[:, :probes]
        return np.take_along_axis(part, np.argsort(np.take_along_axis(near, part, 1), axis=1, kind="stable"), 1)
    return np.argsort(near, axis=1, kind="stable")


def sample_rows(rows: int) -> int:
    return min(MOST_SAMPLE, max(SAMPLE_ROWS, int(FIT_PER_LIST * LISTS * math.sqrt(rows))))


def fit(sample: np.ndarray, rows: int, longest: float, parallel: int = 1) -> dict:
    """Centroids, the number of lists to probe, and where each list's vectors go; from the bounded sample."""
    y = lifted(sample, longest).astype(np.float32)
    lists = int(max(1, min(LISTS * math.sqrt(rows), len(y) // FIT_PER_LIST)))
    rng = np.random.default_rng(SEED)
    centroids = y[rng.choice(len(y), lists, replace=False)]
    for _ in range(6):
        at = _nearest_list(y, centroids)
        by = np.argsort(at, kind="stable")
        n = np.bincount(at, minlength=lists)
        full = np.flatnonzero(n)
        total = np.add.reduceat(y[by], np.concatenate([[0], np.cumsum(n[full])[:-1]]), axis=0)
        centroids = centroids.copy()
        centroids[full] = total / n[full, None]
    at = _nearest_list(y, centroids)
    queries = np.arange(0, len(y), max(1, len(y) // PROBE_QUERIES))
    order = nearest_lists(lifted(sample[queries], longest, True), centroids, lists)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None].repeat(len(queries), 0), 1)
    k, probes = min(K, len(y) - 1), lists
    if k > 0:
        needed = []
        for i in range(0, len(queries), 64):
            some = queries[i : i + 64]
            near = sample[some].astype(np.float32) @ sample.T.astype(np.float32)
            near[np.arange(len(some)), some] = -np.inf
            best = np.argpartition(-near, k - 1, axis=1)[:, :k]
            needed.append(np.take_along_axis(place[i : i + 64], at[best], 1).ravel())
        needed = np.sort(np.concatenate(needed))
        probes = int(needed[min(len(needed) - 1, math.ceil(PROBE_RECALL * len(needed)))]) + 1
    share = (np.bincount(at, minlength=lists) + 0.5) / (len(y) + 0.5 * lists)
    most = min(SHARD_ROWS, max(LEAST_SHARD_ROWS, math.ceil(rows / (2 * parallel))))
    shard, blocks, used, now = [], [], 0.0, 0
    for size in (share * rows).tolist():
        n = math.ceil(size / most)
        if n > 1 or used + size > most:
            now, used = now + (used > 0), 0.0
        shard.append(now)
        blocks.append(n)
        now, used = (now + n, 0.0) if n > 1 else (now, used + size)
    return {"centroids": centroids, "probes": probes, "shard": np.array(shard), "blocks": np.array(blocks), "shards": max(s + b for s, b in zip(shard, blocks)), "longest": longest}


class Shard:
    """The vectors of some lists, rotated and cut into column blocks, with an exact copy for the final scores."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, x: np.ndarray, longest: float, turn: np.ndarray, keep: int):
        # of equal vectors in a list only the least ids can be among the nearest
        order = np.lexsort((ids, at))
        ids, at, x = ids[order], at[order], np.ascontiguousarray(x[order])
        raw = x.view(np.dtype((np.void, x.shape[1] * 8))).ravel()
        _, group = np.unique(raw, return_inverse=True)
        by = np.lexsort((ids, group))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (group[by][1:] != group[by][:-1]) | (ids[by][1:] != ids[by][:-1])
        by = by[fresh]  # without rows that repeat id and vector
        rank = np.arange(len(by)) - np.searchsorted(group[by], group[by])
        stay = np.sort(by[rank < keep])
        self.ids, self.x, at = ids[stay], x[stay], at[stay]
        self.repeats = len(np.unique(self.ids)) < len(self.ids)
        y = (lifted(self.x, longest) @ turn).astype(np.float32)
        size = y.shape[1]
        self.edges = [*range(0, size, COLUMNS), size]
        if len(self.edges) > 2 and self.edges[-1] - self.edges[-2] < COLUMNS // 2:
            del self.edges[-2]
        self.cols = self.blocks(y)
        self.squares = [np.einsum("ij,ij->i", c, c) for c in self.cols]
        self.lists = {int(n): tuple(np.searchsorted(at, [n, n + 1])) for n in np.unique(at)}

    def blocks(self, y: np.ndarray) -> list[np.ndarray]:
        return [np.ascontiguousarray(y[:, s:e]) for s, e in zip(self.edges, self.edges[1:])]

    def scan_list(self, number: int, cols: list[np.ndarray], squares: list[np.ndarray], limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, row number) of the candidates of a list that no test abandons; limit: each query's bound on distances."""
        a, b = self.lists[number]
        size, seen, sums, alive = self.edges[-1], 0, None, None
        for k, (q, c) in enumerate(zip(cols, self.cols)):
            if alive is None:
                part = q @ c[a:b].T
                part *= -2
                part += squares[k][:, None]
                part += self.squares[k][a:b]
                sums = part if sums is None else np.add(sums, part, out=sums)
            else:
                d = q[alive[0]] - c[alive[1]]
                sums = sums + np.einsum("ij,ij->i", d, d)
            seen += c.shape[1]
            test = limit if seen == size else limit * np.float32((1 + EPSILON / math.sqrt(seen)) ** 2 * seen / size)
            if alive is None:
                keep = sums <= test[:, None]
                if seen == size or np.count_nonzero(keep) < 0.3 * keep.size:
                    qi, xi = np.nonzero(keep)
                    sums, alive = sums[keep], (qi, xi + a)
            else:
                keep = sums <= test[alive[0]]
                alive, sums = (alive[0][keep], alive[1][keep]), sums[keep]
        return alive


class Best:
    """The k best distinct ids of each query so far."""

    def __init__(self, n: int, k: int, bound: np.ndarray, repeats: bool):
        self.k, self.bound, self.repeats = k, bound, repeats
        self.q, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.new: list[tuple] = []
        self.waiting, self.enough = 0, 8 * n

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.bound[q]
        self.new.append((q[keep], ids[keep], score[keep]))
        self.waiting += int(keep.sum())
        if self.waiting > self.enough:
            self.merge()

    def merge(self) -> None:
        q, ids, score = (np.concatenate(c) for c in zip((self.q, self.id, self.score), *self.new))
        if self.repeats:
            order = np.lexsort((-score, ids, q))
            q, ids, score = q[order], ids[order], score[order]
            first = np.ones(len(q), bool)
            first[1:] = (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])
            q, ids, score = q[first], ids[first], score[first]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.bound = self.bound.copy()
        self.bound[q[last]] = np.maximum(self.bound[q[last]], score[last])
        keep = rank < self.k
        self.q, self.id, self.score, self.new, self.waiting = q[keep], ids[keep], score[keep], [], 0


def search_shard(shard: Shard, q: np.ndarray, lists: list[np.ndarray], bound: np.ndarray, longest: float, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, exact score) of the k best found of the lists that each query visits, nearest lists first."""
    length = np.linalg.norm(q, axis=1)
    z = (lifted(q, 1.0, True) @ turn).astype(np.float32)
    cols = shard.blocks(z)
    squares = [np.einsum("ij,ij->i", c, c) for c in cols]
    best = Best(len(q), k, bound, shard.repeats)
    who = np.repeat(np.arange(len(q)), [len(x) for x in lists])
    what = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
    later = np.ones(len(who), bool)
    later[np.flatnonzero(np.diff(who, prepend=-1))] = False
    for part in (~later, later):
        numbers, asks = what[part], who[part]
        by = np.argsort(numbers, kind="stable")
        numbers, asks = numbers[by], asks[by]
        for number in np.unique(numbers).tolist():
            if number not in shard.lists:
                continue
            mine = asks[slice(*np.searchsorted(numbers, [number, number + 1]))]
            a, b = shard.lists[number]
            step = max(1, PAIRS // (b - a))
            for i in range(0, len(mine), step):
                m = mine[i : i + step]
                # inner products by which distances are 2 - 2 s / (length * longest); float32 sums need some room
                limit = np.minimum(2 - 2 * best.bound[m] / (length[m] * longest) + 1e-4, 4.5).astype(np.float32)
                qi, xi = shard.scan_list(number, [c[m] for c in cols], [s[m] for s in squares], limit)
                if len(qi):
                    best.add(m[qi], shard.ids[xi], (q[m[qi]] * shard.x[xi]).sum(1))
        best.merge()
    return best.q, best.id, best.score


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def seed_scores(q: np.ndarray, seeds: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, exact scores) of the k nearest seeds of each query; ties to smaller ids (seeds come in their order)."""
    near = q @ seeds.T
    k = min(k, len(seeds))
    best = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
    return best, (q[:, None, :] * seeds[best]).sum(2)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k vectors with the largest inner products found.

    Both have ``vec_id`` and ``embedding``; a query's own id is no candidate.
    Vectors that are null, zero, or hold a null or non-finite component take no
    part, nor do null ids and vectors of another length than the most frequent
    one (of several, the longest).  Ties go to the smaller id.  Of rows that
    repeat an id as query the least vector counts, as candidates the best
    score.  Every query gets k rows, or all candidates if they are fewer.  Long
    vectors cost as their length; other columns aren't read, whatever their
    names.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    result = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("longest"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], result)
    size, count, longest = most["d"], most["n"], math.sqrt(most["longest"])
    rows = rows.where(F.size("embedding") == size)
    # distinct (id, vector) pairs, so that no repeated row fills the sample
    picked = hash_sample(rows, ["vec_id"], sample_rows(count), count).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows(count)).toArrow()
    sample_ids, sample = picked.column(0).to_numpy(), _matrix(picked.column(1), size)
    if not len(sample):
        raise AssertionError("the sample of a table with rows is empty")
    index = fit(sample, count, longest, spark.sparkContext.defaultParallelism)
    keep = k + 1  # a query's own id may be among them
    first = np.argsort(sample_ids[:SEEDS])
    seed_ids, seeds = sample_ids[:SEEDS][first], sample[:SEEDS][first]
    turn = rotation(size + 1)
    vector_type = vectors.schema["embedding"].dataType.simpleString()
    shape = f"shard int, kind int, lists array<int>, id long, mark int, bound double, embedding {vector_type}"

    seen, copies = np.unique(sample, axis=0, return_counts=True)
    hot = seen[copies >= HOT].tolist()
    if hot:
        key = F.xxhash64("embedding")
        marks = spark.createDataFrame([(v,) for v in hot], "embedding array<double>").select(F.xxhash64(F.col("embedding").cast(vector_type)).alias("__h")).distinct()  # at most MOST_SAMPLE / HOT rows
        marked = rows.join(F.broadcast(marks), key == F.col("__h"), "left")
        order = Window.partitionBy("embedding").orderBy("vec_id")
        least = marked.where(F.col("__h").isNotNull()).distinct().withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= keep)
        rows = marked.where(F.col("__h").isNull()).select("vec_id", "embedding").unionByName(least.select("vec_id", "embedding"))

    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding"), size)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.withColumns({"h1": F.xxhash64("embedding"), "h2": F.hash("embedding")})
    searched = asked.groupBy("h1", "h2").agg(F.min("embedding").alias("embedding"))

    def assign(batches):
        for batch in batches:
            ids, x = batch.column(0), _matrix(batch.column(1), size)
            at = _nearest_list(lifted(x, index["longest"]), index["centroids"])
            block = np.array([hash((int(v), 7)) for v in ids.to_pylist()], np.int64) % index["blocks"][at]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), pa.array(at, pa.int32()))
            none = np.zeros(len(at))
            yield pa.RecordBatch.from_arrays([pa.array(index["shard"][at] + block, pa.int32()), pa.array(none, pa.int32()), lists, ids, pa.array(none, pa.int32()), pa.array(none, pa.float64()), batch.column(1)], names=["shard", "kind", "lists", "id", "mark", "bound", "embedding"])

    def visit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(2), size)
            lists = nearest_lists(lifted(x, 1.0, True), index["centroids"], index["probes"])
            _, score = seed_scores(x, seeds, seed_ids, keep)
            # keep seeds are as good as this, the query's own vector perhaps among them
            bound = score.min(1) if len(seeds) >= keep else np.full(len(x), -np.inf)
            who, what = np.repeat(np.arange(len(x)), lists.shape[1]), lists.ravel()
            n = index["blocks"][what]
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, what = np.repeat(who, n), np.repeat(what, n)
            shard = index["shard"][what] + offset
            order = np.lexsort((np.arange(len(who)), shard, who))  # nearest first in each shard
            who, what, shard = who[order], what[order], shard[order]
            start = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(shard, prepend=-1) != 0))
            take = pa.array(who[start])
            columns = [pa.array(shard[start], pa.int32()), pa.array(np.ones(len(start)), pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(start, len(what)), pa.int32()), pa.array(what, pa.int32())), batch.column(0).take(take), batch.column(1).take(take), pa.array(bound[who[start]]), batch.column(2).take(take)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "kind", "lists", "id", "mark", "bound", "embedding"])

    def seeded(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            best, score = seed_scores(_matrix(batch.column(2), size), seeds, seed_ids, keep)
            take = pa.array(np.repeat(np.arange(batch.num_rows), best.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(seed_ids[best.ravel()]), pa.array(score.ravel())], names=["h1", "h2", "vec_id", "score"])

    def scan(batches):
        """Rows come shard by shard, its vectors first, then its queries in portions of any number."""
        now, parts, shard, asks, waiting = None, [], None, [], 0

        def answer():
            rows_ = pa.Table.from_batches(asks)
            q, bound = _matrix(rows_.column("embedding"), size), rows_.column("bound").to_numpy()
            lists = [np.array(v, np.int64) for v in rows_.column("lists").to_pylist()]
            qi, ids, score = search_shard(shard, q, lists, bound, index["longest"], turn, keep)
            take = pa.array(qi)
            return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows_.column("id").take(take), rows_.column("mark").take(take), pa.array(ids), pa.array(score))], names=["h1", "h2", "vec_id", "score"])

        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                if s == e:
                    continue
                number, kind = divmod(int(key[s]), 2)
                if number != now:
                    if asks:
                        yield answer()
                    now, parts, shard, asks, waiting = number, [], None, [], 0
                part = batch.slice(s, e - s)
                if not kind:
                    parts.append((part.column(3).to_numpy(), part.column(2).flatten().to_numpy().astype(np.int64), _matrix(part.column(6), size)))
                elif parts or shard:
                    if shard is None:
                        shard, parts = Shard(*(np.concatenate(c) for c in zip(*parts)), index["longest"], turn, keep), []
                    asks.append(part)
                    waiting += part.num_rows
                    if waiting >= QUERY_ROWS:
                        yield answer()
                        asks, waiting = [], 0
        if asks:
            yield answer()

    shards = rows.mapInArrow(assign, shape).unionByName(searched.mapInArrow(visit, shape))
    placed = shards.repartitionById(index["shards"], F.col("shard")).sortWithinPartitions("shard", "kind")
    found = placed.mapInArrow(scan, "h1 long, h2 int, vec_id long, score double").unionByName(searched.mapInArrow(seeded, "h1 long, h2 int, vec_id long, score double"))
    # one shuffle serves the repeated candidates, the ranks and the arrays
    once = found.repartition("h1", "h2").groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep)
    lists = ranked.groupBy("h1", "h2").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("all"))
    own = asked.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(lists, ["h1", "h2"])
    told = own.select("query_id", F.posexplode(F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("pos", "x"))
    return told.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
