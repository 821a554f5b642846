"""Per-key results where a few keys hold most rows (problem 5).

Everything is exact and built from counts that merge, so a hot key is never gathered: each task reduces its rows to
counters before anything moves.

* Heavy keys: a histogram of key hashes is refined. Its first round counts rows by hash bucket; only buckets that reach
  the wanted share can hold a heavy key, at most 1/share of them, and the next round counts single keys in those alone.
* Quantiles: the histogram of each key's values is refined between the bounds that hold the wanted rank, until one value
  is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import cut_lineage

#: Hash buckets of the first round: counters that a task sends at most.
KEY_BUCKETS = 1 << 14
#: Share of the rows from which a key is joined apart.
HEAVY_SHARE = 0.002
#: Value bins of a key in each round.
VALUE_BINS = 64
#: Distinct values up to which a key is ranked in one pass.
FEW_VALUES = 256
#: Counted rows up to which a table of keys is broadcast, and parts of a key beyond.
BROADCAST_ROWS, SALTS = 20_000, 16


def heavy_keys(df: DataFrame, keys: Sequence[str], least_share: float, buckets: int = KEY_BUCKETS) -> DataFrame:
    """Keys that hold at least least_share of the rows of df: (*keys, rows bigint). Null is a key like any other.

    least_share is above 0. Two passes over the key columns; each moves at most buckets counters, or the keys of
    1/least_share buckets, from a task. Repeated rows count each time; an empty table gives no rows; further columns are
    not read.
    """
    if not 0 < least_share <= 1:
        raise ValueError("least_share must be above 0 and at most 1")
    rows = df.select(*keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    counts = rows.groupBy(bucket.alias("bucket")).count().collect()  # at most `buckets` rows
    total = sum(r["count"] for r in counts)
    least = -int(-(total * least_share) // 1)
    while least > 0 and (least - 1) / total >= least_share:
        least -= 1
    wanted = [r["bucket"] for r in counts if r["count"] >= least]  # at most 1 / least_share
    if not total or not wanted:
        return rows.limit(0).groupBy(*keys).agg(F.count("*").alias("rows"))
    return rows.filter(bucket.isin(wanted)).groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") >= least)


def join_heavy(df: DataFrame, other: DataFrame, key: str, how: str = "inner", least_share: float = HEAVY_SHARE) -> DataFrame:
    """df joined (inner or left) with other, which has few rows a key, without gathering the rows of a key that holds much of df.

    The rows of other whose keys hold at least least_share of df, at most 1/least_share keys, are broadcast to where those
    rows of df are; all else is joined as usual.
    """
    heavy = [r[0] for r in heavy_keys(df, [key], least_share).select(key).collect() if r[0] is not None]  # at most 1 / least_share
    if not heavy:
        return df.join(other, key, how)
    names = df.sparkSession.createDataFrame([(k,) for k in heavy], T.StructType([T.StructField(key, df.schema[key].dataType)]))
    hot = df.join(F.broadcast(names), key, "left_semi").join(F.broadcast(other.join(F.broadcast(names), key, "left_semi")), key, how)
    return df.join(F.broadcast(names), key, "left_anti").join(other, key, how).unionByName(hot)


def distinct_counts(df: DataFrame, keys: Sequence[str], value: str, alias: str = "distinct_values") -> DataFrame:
    """Exact number of distinct non-null values of each key: (*keys, alias). Rows of a hot key spread over its values."""
    pairs = df.select(*keys, value).distinct()
    return pairs.groupBy(*keys).agg(F.count(value).alias(alias))


def key_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], bins: int = VALUE_BINS, few: int = FEW_VALUES) -> DataFrame:
    """Exact quantiles of value of each key: (*keys, n bigint, q_<percent> double, ...), n counting usable values.

    A quantile is the value of rank ceil(p * n), at least 1, in ascending order. Keys may be null; null and NaN values do
    not count, and keys without a value are left out. An empty table gives no rows; further columns are not read.

    Rows are first reduced to counts of (key, value), which spreads a hot key over its values. A key of at most `few`
    values is ranked in one ordered pass over its counts. For every other key a round counts the values between the
    current bounds of each wanted rank in `bins` bins, and keeps the least and greatest value of the bin that holds the
    rank; each round cuts the width to 1/bins or ends. The table of open ranks is broadcast up to BROADCAST_ROWS rows and
    joined on salted keys beyond.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    cells = cut_lineage(rows.groupBy(*names, "x").agg(F.count("*").alias("c")))
    many = cells.groupBy(*names).agg(F.sum("c").alias("n"), F.count("*").alias("m"), F.min("x").alias("low"), F.max("x").alias("high")).filter(F.col("m") > few)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)]))
    rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("w.p") * F.col("n")))
    still = cut_lineage(many.select(*names, "n", "low", "high", wanted.alias("w")).select(*names, "n", "low", "high", "w.i", rank.alias("rank")))

    hot = still.select(*names).distinct()
    inside = W.partitionBy(*names).orderBy("x")
    total = F.sum("c").over(W.partitionBy(*names))
    cold = _beside(cells, hot, names, "left_anti").select(*names, "x", "c", F.sum("c").over(inside.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), total.alias("n"))
    first = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(float(p)) * F.col("n"))), F.col("x"))).alias(f"q{i}") for i, p in enumerate(probabilities)]
    result = cold.groupBy(*names).agg(F.max("n").alias("n"), *first)

    solved = None
    while not still.isEmpty():
        near = _beside(cells, still, names, "inner").filter("x >= low AND x <= high")
        slot = F.when(F.col("x") >= F.col("high"), bins - 1).when(F.col("x") <= F.col("low"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bins).cast("int")))
        counted = near.groupBy(*names, "n", "i", "rank", slot.alias("slot")).agg(F.sum("c").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        order = W.partitionBy(*names, "i").orderBy("slot").rowsBetween(W.unboundedPreceding, 0)  # at most `bins` rows
        picked = counted.withColumn("upto", F.sum("c").over(order)).filter("upto >= rank AND upto - c < rank")
        picked = cut_lineage(picked.select(*names, "n", "low", "high", "i", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank")))
        done = picked.filter("low = high")
        solved = done if solved is None else solved.unionAll(done)
        still = picked.filter("low < high")
    if solved is not None:
        result = result.unionAll(solved.groupBy(*names).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("i") == i, F.col("low"))).alias(f"q{i}") for i in range(len(probabilities))]))
    return result.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n", *[F.col(f"q{i}").alias(f"q_{round(p * 100)}") for i, p in enumerate(probabilities)])


def _beside(cells: DataFrame, other: DataFrame, names: list[str], how: str) -> DataFrame:
    """cells joined with a table of keys: broadcast if its counted rows are few, else on keys salted by value."""
    other = other.select(*[F.col(n).alias(f"o_{n}") for n in names], *[c for c in other.columns if c not in names])
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"o_{n}")) for n in names])
    if other.count() <= BROADCAST_ROWS:
        joined = cells.join(F.broadcast(other), same, how)
    else:
        other = other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = cells.withColumn("own_salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(other, same & (F.col("own_salt") == F.col("salt")), how).drop("own_salt", "salt")
    return joined.drop(*[f"o_{n}" for n in names])
