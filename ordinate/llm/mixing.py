"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordinate.llm.common import at_most, fresh, table

SEED = 17
#: Without stated weights a source's weight is its number of documents to this power.
TEMPERATURE = 0.5
#: More sources than these aren't broadcast; a row has a few hundred bytes.
BROADCAST_SOURCES = 10_000
SALTS = 64


def unit(*parts: Column | str) -> Column:
    """Uniform in [0, 1) from the seed and these values, 52 bits of an MD5."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _cumulative(rate: Column) -> Column:
    """P(X <= k) of a Poisson distribution for k = 0, 1, ... until the rest is negligible."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("sums"))

    def add(s: Column, k: Column) -> Column:
        log = s["log"] + F.log(rate / k)
        return F.struct(log.alias("log"), F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + F.exp(log))).alias("sums"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, add, lambda s: s["sums"])).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, size: float | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """(source, n, rate): the mean number of copies by which each source reaches its share of ``size`` documents (default: as many as there are).

    ``weights`` are relative; a source without one gets none.  Null is a source.
    """
    counted = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighed = counted.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]) if weights else F.create_map()
        weighed = counted.withColumn("w", F.coalesce(given[F.coalesce("source", F.lit(""))], F.lit(0.0)))
    total = weighed.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    whole = weighed.crossJoin(F.broadcast(total))  # one row
    wanted = F.col("all_n").cast("double") if size is None else F.lit(float(size))
    return whole.select("source", "n", F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w") * wanted / F.col("n")).otherwise(0.0).alias("rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, size: float | None = None, seed: int = SEED, temperature: float = TEMPERATURE) -> DataFrame:
    """The documents, each as often as its draw says, in a global pseudo-random order.

    Adds ``copy`` (1, 2, ...) and ``mix_key`` (the order; range partitions are
    in order and sorted).  The draw inverts the Poisson distribution with the
    source's rate at a uniform number hashed from seed and id, so it depends on
    nothing else: repeated rows are drawn alike, and a null id counts as "".
    Names that ``docs`` has already get an underscore.  Texts move once, by key.
    """
    spark = docs.sparkSession
    copy, key, rate_c, source_c, sums = fresh(docs, "copy", "mix_key", "mix_rate", "mix_source", "mix_sums")
    table_ = rates(docs, weights, size, temperature).select(F.col("source").alias(source_c), _cumulative(F.col("rate")).alias(sums))
    left = docs.withColumn(rate_c, unit(f"{seed}", F.col("doc_id")))
    same = F.col("source").cast("string").eqNullSafe(F.col(source_c))
    if at_most(table_, BROADCAST_SOURCES):
        joined = left.join(F.broadcast(table_), same)
    else:  # spread each source over some partitions
        (salt,) = fresh(left, "mix_salt")
        salted = table_.withColumn(salt + "r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = left.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(salted, same & (F.col(salt) == F.col(salt + "r")))
    draws = F.size(F.filter(F.col(sums), lambda c: c < F.col(rate_c)))
    copies = joined.withColumn(copy, F.explode(F.when(draws > 0, F.sequence(F.lit(1), draws)).otherwise(F.array().cast("array<int>"))))
    placed = copies.withColumn(key, unit(f"{seed}:copy", F.col("doc_id"), F.col(copy))).select(*[F.col(f"`{c}`") for c in docs.columns], copy, key)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # keys are uniform, so equal ranges need no sampling pass
    return placed.repartitionById(parts, F.least(F.floor(F.col(key) * parts), F.lit(parts - 1)).cast("int")).sortWithinPartitions(key, "doc_id", copy)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


OP5_SQL = f"""
WITH counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, sqrt(n) / sum(sqrt(n)) OVER () * (sum(n) OVER ())::DOUBLE / n AS rate FROM counted),
terms AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below
  FROM (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 20)::BIGINT + 1)) AS k FROM rates)
),
sums AS (SELECT source, list(below ORDER BY k) AS below FROM terms GROUP BY source),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u, s.below
  FROM documents d JOIN sums s ON d.source IS NOT DISTINCT FROM s.source
),
copies AS (
  SELECT doc_id, text, lang, source, n_chars, unnest(range(1, len(list_filter(below, lambda b: b < u)) + 1)) AS copy FROM drawn
)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
  ('0x' || substr(md5('{SEED}:copy:' || doc_id || ':' || copy), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS mix_key
FROM copies
"""
