"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture. A document of a source with `n` documents is wanted
rate = share * size / n times on average; its own count is drawn from a Poisson distribution with that
mean by inverting the distribution at a uniform hashed from the seed and the document (its id and a
hash of its text), so every run, retry and partitioning draws the same counts. Documents are exploded
by their count and shuffled globally: a second hash of document, copy and seed deals each copy to a
partition and orders it there. A hot source is only counted (partial aggregates) and never gathered.

`weights` maps a source to its weight; sources not in it get `other`. Weights are scaled to sum to 1
over the sources there are. By default every source weighs as much as the square root of its size.

Edge cases: a null source is a source of its own (looked up under None); a weight of 0 removes a
source; negative weights are refused; null and empty texts are documents like others; repeated equal
rows draw equal counts; an empty table gives no rows; the added columns (`copy`, `copies`, `rate`,
`shuffle_key`) replace input columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table

SEED = "mix-1"
#: Means above this are split into parts drawn apart: a sum of Poisson counts is a Poisson count.
PART = 64.0
SOURCES_TO_BROADCAST = 100_000


def uniform(*parts) -> Column:
    """(0, 1) from 52 bits of the md5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson(rate: Column, u: Column) -> Column:
    """The least k with P(X <= k) >= u for a Poisson X of mean rate (at most PART)."""
    # The terms up to this k hold all but less than 2**-54 of the distribution.
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("total"), F.when(u > F.exp(-rate), 1).otherwise(0).alias("k"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        total = acc["total"] + p
        return F.struct(p.alias("p"), total.alias("total"), (acc["k"] + F.when(u > total, 1).otherwise(0)).alias("k"))

    return F.aggregate(steps, start, step, lambda acc: acc["k"])


def copies_of(rate: Column, *who) -> Column:
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(1), parts), lambda i: poisson(rate / parts, uniform(*who, i)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def mix(docs: DataFrame, weights: dict | None = None, other: float = 0.0, size: float = 1.0, seed: str = SEED, temperature: float = 0.5) -> DataFrame:
    """docs repeated by drawn counts, about size times as many rows, in a global random order."""
    added = ("copy", "copies", "rate", "shuffle_key")
    base = docs.select(*[c for c in docs.columns if c not in added])
    if weights is not None and min([other, *weights.values()]) < 0:
        raise ValueError("weights must not be negative")
    counts = base.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        named = [F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))) for k, v in weights.items()]
        counts = counts.withColumn("w", F.coalesce(*named, F.lit(float(other))))
    # Three numbers come to the driver: the sums of weights and rows, and how many sources there are.
    sum_w, sum_n, sources = counts.agg(F.sum("w"), F.sum("n"), F.count("*")).first()
    rate = F.coalesce(F.try_divide(F.col("w") * F.lit(sum_n or 0) * F.lit(float(size)), F.lit(float(sum_w or 0)) * F.col("n")), F.lit(0.0))
    rates = counts.select(F.col("source").alias("_s"), rate.alias("rate"))
    # One row a source: broadcast where the sources are counted to be few, else shuffled.
    rates = F.broadcast(rates) if sources <= SOURCES_TO_BROADCAST else rates
    rows = base.join(rates, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    who = (F.lit(seed), F.col("doc_id"), F.md5(F.coalesce("text", F.lit(""))))
    # The count is drawn once a row: as the list, maybe empty, of copies that the row is exploded by.
    drawn = let(copies_of(F.col("rate"), *who), lambda n: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.alias("copy"), n.alias("copies")))))
    rows = rows.withColumn("_drawn", F.explode(drawn)).select(*rows.columns, "_drawn.*")
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N")), F.md5(F.coalesce("text", F.lit(""))), F.col("copy").cast("string"))))
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def op6_mix(spark, sf_dir):
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "copies", F.round("rate", 9).alias("rate"), "text", "shuffle_key")


OP6_SQL = """
WITH counts AS (SELECT source, count(*) AS n, sqrt(count(*)::DOUBLE) AS w FROM documents GROUP BY source),
total AS (SELECT sum(w) AS sum_w, sum(n)::BIGINT AS sum_n FROM counts),
rates AS (SELECT source, w * sum_n / (sum_w * n) AS rate FROM counts, total),
cdf AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS total
  FROM (SELECT source, rate, unnest(range(0, 200)) AS k FROM rates)
),
docs AS (
  SELECT d.*, r.rate, md5(coalesce(text, '')) AS digest,
    (('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, '\\N') || '|' || md5(coalesce(text, '')) || '|1'), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
),
drawn AS (
  SELECT doc_id, source, text, rate, digest, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM docs.source AND docs.u > c.total)::INT AS copies FROM docs
)
SELECT doc_id, source, copy::INT AS copy, copies, round(rate, 9) AS rate, text,
  md5('mix-1|' || coalesce(doc_id::VARCHAR, '\\N') || '|' || digest || '|' || copy::VARCHAR) AS shuffle_key
FROM (SELECT *, unnest(range(1, copies + 1)) AS copy FROM drawn WHERE copies > 0)
"""
