"""Benchmark decontamination: a hash set of normalised test n-grams against the windows of training texts.

The benchmark's windows go to every task as one structure: sorted hashes with
their places in the benchmark's text, behind a bit filter, so that a hit is
verified word by word.  Where it would exceed BROADCAST_BYTES, a Bloom filter
of fixed size and a join of distinct windows first find the benchmark's windows
that occur in the texts at all; these then go out in as many portions as they need.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm.common import bound_batches, checkpoint, fresh, map_column, rewrite_texts, slices, table

WINDOW = 13
#: Most bytes of one structure that is sent to all tasks; a window takes ROW_BYTES beside its text.
BROADCAST_BYTES, ROW_BYTES = 64_000_000, 24
BLOOM_BITS = 27
#: A text is hashed so many bytes at a time.
SEGMENT = 1 << 20
#: Every byte that is no word character becomes a space; A-Z become a-z.
CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: A byte string's hash is a polynomial modulo 2^64; powers of the base and of its inverse make every substring's hash one subtraction.
BASE = 0xD6E8FEB86659FD93
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Kept(list):
    """A list of its process; functions that use it are sent without its content."""

    def __reduce__(self):
        return Kept, ()


_powers = Kept()


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of BASE and of its inverse; kept in the process."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        made = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            made.append(np.cumprod(a, dtype=np.uint64))
        _powers[:] = made
    return _powers


def normal(text: bytes | None) -> bytes:
    """The words, one space apart."""
    return b" ".join((text or b"").translate(CLEAN).split())


def word_edges(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends in a normal text."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    return np.concatenate([[0], at + 1]), np.concatenate([at, [len(words)]])


def substring_hashes(words: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of substrings, whose starts ascend."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + SEGMENT)))
        a, b = int(starts[lo]), int(ends[lo:hi].max())
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(np.frombuffer(words, np.uint8, b - a, a) * up[: b - a], out=sums[1:])
        h = (sums[ends[lo:hi] - a] - sums[starts[lo:hi] - a]) * down[starts[lo:hi] - a]
        h ^= h >> np.uint64(32)
        h *= FACTOR
        out[lo:hi] = h ^ (h >> np.uint64(29))
        lo = hi
    return out


class Known:
    """The benchmark's windows of one size: sorted hashes, where each lies in the text, its item, and a bit filter."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        self.hashes, self.items = hashes[order], items[order].astype(np.int32)
        self.starts, self.sizes = starts[order], (ends - starts)[order].astype(np.int32)
        self.shift = np.uint64(64 - max(10, (16 * len(hashes) - 1).bit_length()))
        at = self.hashes >> self.shift
        self.bits = np.zeros(1 << (64 - int(self.shift) - 3), np.uint8)
        np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))

    def possible(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that are among the known ones."""
        at = h >> self.shift
        some = np.flatnonzero(self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1))
        place = np.searchsorted(self.hashes, h[some])
        place[place == len(self.hashes)] = 0
        return some[self.hashes[place] == h[some]]


class Matcher:
    """Finds the benchmark's windows in texts; items are (item_id as text, text as bytes).  Made once, on the driver."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.names: list[str] = []
        parts, at = [], 0
        found: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for name, text in items:
            words = normal(text)
            starts, ends = word_edges(words)
            size = min(WINDOW, len(starts))
            if size:
                n = len(starts) - size + 1
                a, b = starts[:n], ends[size - 1 :]
                found.setdefault(size, []).append((substring_hashes(words, a, b), a + at, b + at, np.full(n, len(self.names))))
                self.names.append(name)
                parts.append(words)
                at += len(words)
        self.text = b"".join(parts)
        self.known = {size: Known(*(np.concatenate(c) for c in zip(*rows))) for size, rows in sorted(found.items())}
        self.seen: dict[tuple[int, int], dict[bytes, set[str]]] = {}

    def holders(self, size: int, h: int) -> dict[bytes, set[str]]:
        """Windows with a hash, and the items that hold each."""
        if (size, h) not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            k, made = self.known[size], {}
            for i in range(int(np.searchsorted(k.hashes, np.uint64(h))), int(np.searchsorted(k.hashes, np.uint64(h), "right"))):
                made.setdefault(self.text[k.starts[i] : k.starts[i] + k.sizes[i]], set()).add(self.names[k.items[i]])
            self.seen[size, h] = made
        return self.seen[size, h]

    def find(self, text: bytes | None) -> tuple[int, np.ndarray | None, set[str]]:
        """The number of words, which are hit (None: none), and the ids of the items with occurring windows."""
        words = normal(text)
        starts, ends = word_edges(words)
        hit, items = None, set()
        for size, known in self.known.items():
            n = len(starts) - size + 1
            if n <= 0:
                continue
            h = substring_hashes(words, starts[:n], ends[size - 1 :])
            told: set[bytes] = set()
            for i in known.possible(h).tolist():
                window = words[starts[i] : ends[i + size - 1]]
                if window not in told:
                    holders = self.holders(size, int(h[i])).get(window)
                    if not holders:
                        continue
                    told.add(window)
                    items |= holders
                hit = np.zeros(len(starts), bool) if hit is None else hit
                hit[i : i + size] = True
        return len(starts), hit, items


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def intervals(hit: np.ndarray) -> list[list[int]]:
    """[start, end) of the runs of hit words."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2).tolist()


def without(raw: bytes, runs: list[list[int]]) -> str:
    """The text without these runs of words; a run goes with what is between its words and leaves a space."""
    spans = [m.span() for m in WORD.finditer(raw)]
    parts, at = [], 0
    for i, j in runs:
        parts.append(raw[at : spans[i][0]])
        at = spans[j - 1][1]
    return b" ".join([*parts, raw[at:]]).decode()


def strip(text: str, matcher: Matcher) -> tuple[str, bool]:
    """The text without its hit words, and whether it was contaminated as it came.

    Words that come together by that are looked at again, until none is hit.
    """
    bad, first = False, True
    while True:
        raw = text.encode()
        n, hit, _ = matcher.find(raw)
        if hit is None:
            return text, bad
        if first:
            bad, first = contaminated(int(hit.sum()), n), False
        text = without(raw, intervals(hit))


def _usable(benchmark: DataFrame) -> DataFrame:
    return benchmark.where("text is not null and item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))


def _items(benchmark: DataFrame) -> list[tuple[str, bytes]]:
    rows = _usable(benchmark).select("item_id", F.col("text").cast("binary").alias("text")).toArrow()
    return list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))


def structure_bytes(benchmark: DataFrame) -> int:
    """What the structure of a benchmark takes: its text, and ROW_BYTES a word."""
    words = F.regexp_count(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    return int(_usable(benchmark).agg(F.sum(F.octet_length("text") + ROW_BYTES * words)).first()[0] or 0)


def _digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _contaminated():
    return ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")


def scan(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words.  Null item texts and ids take no part;
    repeated items count once for each id.  Repeated documents are judged alike,
    very long texts whole.  Other columns aren't read, whatever their names.  An
    empty table gives no rows, an empty benchmark no hits.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    if structure_bytes(benchmark) > most:
        return _scan_in_portions(docs, benchmark, most)
    matcher = Matcher(_items(benchmark))

    def make():
        def run(texts):
            rows = []
            for t in texts:
                n, hit, found = matcher.find(t)
                rows.append((n, 0 if hit is None else int(hit.sum()), len(found), _digest(found)))
            a, b, c, d = zip(*rows) if rows else ((), (), (), ())
            return [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())]

        return run

    found = map_column(docs, "text", "n_words long, n_hit long, n_items long, items_sha256 string", make, binary=True, drop=True)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", _contaminated())


def _windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, text): each window of each item, one row each; an item of at most WINDOW words is its own window."""

    def run(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = normal(text).split()
                size = min(WINDOW, len(words))
                out += [(item, b" ".join(words[i : i + size]).decode()) for i in range(len(words) - size + 1 if size else 0)]
            items, texts = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.string())], names=["item_id", "text"])

    return _usable(benchmark).mapInArrow(run, "item_id string, text string")


def _hash_of(words: bytes) -> int:
    return int(substring_hashes(words, np.array([0]), np.array([len(words)]))[0])


def occurring(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(item_id, text): the benchmark's windows that occur in the documents, as items of their own."""
    windows = checkpoint(_windows(benchmark))

    def bits(batches):
        mark = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            for window in batch.column(0).to_pylist():
                mark[_hash_of(window.encode()) >> (64 - BLOOM_BITS)] = True
        packed = np.packbits(mark).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(packed[at], pa.int64())], names=["word", "bits"])

    words = windows.select("text").distinct().mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = words.toArrow()  # 2^(BLOOM_BITS - 6) rows at most
    packed = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    packed[found.column(0).to_numpy()] = found.column(1).to_numpy()
    sizes = sorted(r["n"] for r in windows.select((F.length(F.regexp_replace("text", "[^ ]", "")) + 1).alias("n")).distinct().collect())  # WINDOW rows at most

    def look(batches):
        flat = packed.view(np.uint8)
        for batch in slices(batches, 0):
            out: set[bytes] = set()  # each once in a slice
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                words_ = normal(text)
                starts, ends = word_edges(words_)
                for size in sizes:
                    n = len(starts) - size + 1
                    if n > 0:
                        at = substring_hashes(words_, starts[:n], ends[size - 1 :]) >> np.uint64(64 - BLOOM_BITS)
                        some = np.flatnonzero(flat[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1))
                        out.update(words_[s:e] for s, e in zip(starts[some].tolist(), ends[some + size - 1].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()).cast(pa.string())], names=["text"])

    bound_batches(docs)
    present = docs.where("text is not null").select("text").mapInArrow(look, "text string").distinct()
    return windows.join(present, "text", "left_semi").select("item_id", "text").distinct()


def _hits(keyed: DataFrame, benchmark: DataFrame, most: int) -> DataFrame:
    """(key, runs, items) of the documents with hits: runs of hit words from all portions of the benchmark, perhaps overlapping."""
    found = checkpoint(occurring(keyed, benchmark))
    portions = max(1, math.ceil(structure_bytes(found) * 1.5 / most))
    rows = None
    for k in range(portions):
        matcher = Matcher(_items(found.where(F.pmod(F.xxhash64("text"), F.lit(portions)) == k)))

        def make(matcher=matcher):
            def run(texts):
                runs, items = [], []
                for t in texts:
                    _, hit, held = matcher.find(t)
                    runs.append(None if hit is None else intervals(hit))
                    items.append(None if hit is None else sorted(held))
                return [pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]

            return run

        made = map_column(keyed.select("key", "text"), "text", "runs array<array<bigint>>, items array<string>", make, binary=True, drop=True).where("runs is not null")
        # rows with one key have one text; written at once, so that the driver holds one portion at a time
        made = checkpoint(made.groupBy("key").agg(F.min("runs").alias("runs"), F.min("items").alias("items")))
        rows = made if rows is None else rows.unionByName(made)
    return rows.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def _merged(runs):
    """Sorted runs without overlaps, as [start, end) pairs."""
    start = F.array().cast("array<array<bigint>>")
    return F.aggregate(
        runs, start,
        lambda a, r: F.when((F.size(a) > 0) & (F.element_at(F.element_at(a, -1), 2) >= r[0]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.array(F.element_at(F.element_at(a, -1), 1), F.greatest(F.element_at(F.element_at(a, -1), 2), r[1]))))).otherwise(F.concat(a, F.array(r))),
    )


def _with_key(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows with the same id and text are judged alike, so a hash pair may stand for them."""
    t = F.col(text).cast("string")
    return docs.withColumn(key, F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.xxhash64(t).cast("string"), F.hash(t).cast("string"), F.coalesce(F.length(t), F.lit(-1)).cast("string")))


def _scan_in_portions(docs: DataFrame, benchmark: DataFrame, most: int) -> DataFrame:
    keyed = _with_key(docs, "key")
    hits = _hits(keyed, benchmark, most)
    told = hits.select(
        "key", F.aggregate(_merged("runs"), F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0]).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    )
    lengths = lambda: lambda texts: [pa.array([len(normal(t).split()) for t in texts], pa.int64())]
    whole = map_column(keyed.select("doc_id", "key", "text"), "text", "n_words long", lengths, binary=True, drop=True).join(told, "key", "left")
    return whole.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("items_sha256", F.lit(_digest([]))).alias("items_sha256")).withColumn("contaminated", _contaminated())


def decontaminate(docs: DataFrame, benchmark: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Contaminated documents go; other documents lose the hit words, so that no window of the benchmark is left.

    Documents without a hit, nulls and empty texts stay as they are, and so do
    all other columns, but for an integer n_chars of a changed text.
    """
    if structure_bytes(benchmark) > most:
        return _decontaminate_in_portions(docs, benchmark, most)
    matcher = Matcher(_items(benchmark))

    def make():
        def run(texts):
            done = [(t, False) if t is None else strip(t, matcher) for t in texts]
            return [t for t, _ in done], [not bad for _, bad in done]

        return run

    return rewrite_texts(docs, make)


def _decontaminate_in_portions(docs: DataFrame, benchmark: DataFrame, most: int) -> DataFrame:
    """The same result by rounds: all portions' hits of a round are cut at once, and what changed is looked at again."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    key, runs, spoilt = fresh(docs, "hit_key", "hit_runs", "hit_spoilt")
    todo, first = docs, True
    done = None
    while True:
        keyed = _with_key(todo, key)
        hits = _hits(keyed.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")), benchmark, most).select(F.col("key").alias(key), _merged("runs").alias(runs))
        joined = checkpoint(keyed.join(hits, key, "left"))
        clean = joined.where(F.col(runs).isNull()).select(*names)
        done = clean if done is None else done.unionByName(clean)
        hit = joined.where(F.col(runs).isNotNull())
        if hit.isEmpty():
            return done
        if first:
            words = map_column(hit, "text", f"`{spoilt}` long", lambda: lambda texts: [pa.array([len(normal(t).split()) for t in texts], pa.int64())], binary=True)
            n_hit = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0])
            hit, first = words.where(20 * n_hit < F.col(spoilt)).drop(spoilt), False
        at, at_text = hit.columns.index(runs), hit.columns.index("text")
        size = hit.columns.index("n_chars") if "n_chars" in hit.columns and hit.schema["n_chars"].dataType.typeName() in ("long", "integer") else None

        def cut(batches, at=at, at_text=at_text, size=size):
            for batch in slices(batches, at_text):
                new = [without(t.encode(), r) for t, r in zip(batch.column(at_text).to_pylist(), batch.column(at).to_pylist())]
                columns = list(batch.columns)
                columns[at_text] = pa.array(new, columns[at_text].type)
                if size is not None:
                    columns[size] = pa.array([len(t) for t in new], columns[size].type)
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        todo = checkpoint(hit.mapInArrow(cut, hit.schema).select(*names))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
items AS (
  SELECT DISTINCT item, size, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT item, w, least({WINDOW}, len(w)) AS size, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
windows AS (
  SELECT row, size, i, array_to_string(w[i : i + size - 1], ' ') AS words
  FROM (SELECT row, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM items) WHERE len(w) >= size)
),
found AS (SELECT DISTINCT row, i, size, item FROM windows JOIN items USING (size, words)),
hit AS (SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + size)) AS place FROM found) GROUP BY row),
held AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN held USING (row)
"""
