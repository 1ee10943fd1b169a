"""Exact, repeatable sampling: stratified test split and capped sample.

Rows are ordered by md5(key_seed), so a choice depends on the key and the seed
only, not on partitioning. Taking the k first rows of a class by a window would
send each class, which may be nearly the whole table, to one task. Instead the
k-th smallest hash is found by counting: a histogram over hash prefixes gives the
prefix that holds it, and only the rows under that prefix are ranked. The choice
itself is then a filter on the scan; wide rows are never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import MAX_SAMPLES, RANDOM_STATE, TEST_SIZE

# Hex digits per refinement: 16^3 prefixes per class and level.
DIGITS = 3


def hash_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"_{seed}")))


def test_quotas(counts: DataFrame, test_size: float = TEST_SIZE) -> DataFrame:
    """Test rows per class (``stratum, c`` to ``stratum, k``, with ``c`` and ``total``, the rows of all classes).

    The test set has ceil(test_size * N) rows. The train side gets floor plus
    largest remainder, ties to the smaller label; test is what is left. One row per
    class goes in and is compared with the last of those that get one more, so classes
    may be as many as rows.
    """
    whole = counts.agg(F.struct(F.sum("c").alias("total"), F.count(F.lit(1)).alias("classes"))).scalar()
    train = F.col("_all.total") - F.ceil(F.lit(float(test_size)) * F.col("_all.total")).cast("long")
    shared = counts.withColumn("_all", whole).withColumn("_train", train).withColumn(
        "_base", F.expr("(c * _train) div _all.total")).withColumn(
        "_order", F.struct((-F.expr("(c * _train) % _all.total")).alias("rem"), "stratum"))
    short = shared.agg(F.max("_train") - F.sum("_base")).scalar()
    last = _nth(shared, "_order", F.col("_all.classes"), short).scalar()
    taken = F.col("_base") + F.when(F.col("_order") <= last, 1).otherwise(0)
    return shared.select("stratum", (F.col("c") - taken).alias("k"), "c", F.col("_all.total").alias("total"))


# About so many bounds cut the classes into ranges.
BOUNDS = 256


def _nth(rows: DataFrame, order: str, size: Column, n: Column) -> DataFrame:
    """The ``n``-th smallest ``order``, a struct that no two rows share; nothing if ``n`` is none of their places.

    A sample by hash, about ``BOUNDS`` of the ``size`` rows, cuts them into ranges. These are counted,
    and only the rows of the one that holds the place are ranked. The sample evens out the ranges
    and decides nothing else.
    """
    steps = [1 << bit for bit in reversed(range(BOUNDS.bit_length() + 1))]
    chosen = F.pmod(F.xxhash64(order), F.greatest(F.lit(1), F.ceil(size / BOUNDS)).cast("long")) == 0
    # no more bounds than the steps reach
    bounds = rows.where(chosen).agg(F.slice(F.sort_array(F.collect_list(order)), 1, sum(steps))).scalar()

    def halve(at: Column, step: Column) -> Column:
        return F.when(F.get("_bounds", at + step - 1) <= F.col(order), at + step).otherwise(at)

    # how many bounds are no larger than a row
    ranged = rows.select(order, bounds.alias("_bounds")).select(
        F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), halve).alias("_range"))
    # one row for each range
    ends = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_left", n - F.sum("_n").over(Window.orderBy("_range")) + F.col("_n"))
    place = ends.where((F.col("_left") > 0) & (F.col("_left") <= F.col("_n"))).select(
        "_left", bounds.alias("_bounds"), "_range").select(
        F.struct("_left", F.get("_bounds", F.col("_range") - 1).alias("low"), F.get("_bounds", "_range").alias("high")))
    inside = rows.select(order, place.scalar().alias("_place")).where(
        F.col("_place._left").isNotNull()
        & F.coalesce(F.col(order) >= F.col("_place.low"), F.lit(True))
        & F.coalesce(F.col(order) < F.col("_place.high"), F.lit(True)))
    return inside.withColumn("_inside", F.row_number().over(Window.orderBy(order))).where(
        F.col("_inside") == F.col("_place._left")).select(order)


# Classes with one in so many rows, or more, are large: there can be no more of them than this.
LARGE_CLASSES = 100_000


def _crossing(rows: DataFrame, *groups: str) -> DataFrame:
    """(stratum, h, key) of the row in each group at which the count by (h, key) reaches ``k``."""
    # copies of a key are counted first, so that many of them are one row to rank
    counted = rows.groupBy(*groups, "h", "key", "k").agg(F.count(F.lit(1)).alias("n"))
    by_hash = Window.partitionBy(*groups).orderBy("h", "key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return counted.withColumn("_end", F.sum("n").over(by_hash)).where(
        (F.col("_end") >= F.col("k")) & (F.col("_end") - F.col("n") < F.col("k"))).select("stratum", "h", "key")


def _last_taken(hashed: DataFrame, histogram: DataFrame, quotas: DataFrame, levels: int) -> DataFrame:
    """(stratum, h, key) of the last row taken per class: the k-th by (h, key). For classes whose
    number is bounded: their cut points are broadcast."""
    need, cut = quotas.select("stratum", "k"), None
    for level in range(1, levels + 1):
        if cut is not None:
            inside = hashed.withColumn("prefix", F.left("h", F.lit(DIGITS * (level - 1))))
            histogram = _histogram(inside.join(cut, ["stratum", "prefix"], "left_semi"), DIGITS * level)
        running = Window.partitionBy("stratum").orderBy("prefix").rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        cut = F.broadcast(
            histogram.join(F.broadcast(need), "stratum").withColumn("_end", F.sum("n").over(running))
            .where((F.col("_end") >= F.col("k")) & (F.col("_end") - F.col("n") < F.col("k")))
            .select("stratum", "prefix", (F.col("k") - F.col("_end") + F.col("n")).alias("k"))
        )
        need = cut.select("stratum", "k")
    edge = hashed.withColumn("prefix", F.left("h", F.lit(DIGITS * levels))).join(cut, ["stratum", "prefix"])
    return _crossing(edge, "stratum", "prefix")


def _histogram(hashed: DataFrame, digits: int) -> DataFrame:
    return hashed.groupBy("stratum", F.left("h", F.lit(digits)).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"))


def stratified_test_split(
    samples: DataFrame,
    stratum: str = "ground_truth",
    key: str = "record_id",
    test_size: float = TEST_SIZE,
    seed: int = RANDOM_STATE,
    classes: Sequence[str] | None = None,
    levels: int = 2,
) -> DataFrame:
    """The test rows of an exact stratified split.

    ``key`` is unique; should it not be, copies of a key stay together, and the last
    key taken may exceed the size by its copies. Rows without a stratum are left out, all
    other labels are strata; ``classes`` leaves only those named, which are then few.

    Of undeclared classes those with one in ``LARGE_CLASSES`` rows or more can be no more than
    that, so their cut points are broadcast and their rows, hot ones among them, are not
    shuffled. The rows of all other classes are read a second time and go to their class, which is a
    small part of the table. Nothing is counted before the result is asked for. Each of the ``levels`` is a narrow
    scan that cuts the ranked rest by 4096; two are enough up to some 10^12 rows per class.
    """
    rows = samples.where(F.col(stratum).isNotNull())
    if classes is not None:
        rows = rows.where(F.col(stratum).isin(*classes))
    hashed = rows.select(F.col(stratum).alias("stratum"), hash_key(key, seed).alias("h"),
                         F.col(key).alias("key"))
    histogram = _histogram(hashed, DIGITS)
    quotas = test_quotas(histogram.groupBy("stratum").agg(F.sum("n").alias("c")), test_size)
    taken = F.struct(hash_key(key, seed), F.col(key)) <= F.struct("_h", "_key")
    within = (F.col(stratum) == F.col("_stratum")) & taken

    def until(last: DataFrame) -> DataFrame:
        return last.toDF("_stratum", "_h", "_key")

    if classes is not None:
        return rows.join(F.broadcast(until(_last_taken(hashed, histogram, quotas, levels))), within, "left_semi")
    is_large = F.col("c") * LARGE_CLASSES >= F.col("total")
    large = quotas.where(is_large)
    of_large = rows.join(F.broadcast(until(_last_taken(hashed, histogram, large, levels))), within, "left_semi")
    names = F.broadcast(large.select(F.col("stratum").alias("_large")))
    small = hashed.join(names, F.col("stratum") == F.col("_large"), "left_anti").join(
        quotas.where(~is_large).select("stratum", "k"), "stratum")
    of_small = rows.join(names, F.col(stratum) == F.col("_large"), "left_anti").join(
        until(_crossing(small, "stratum")), within, "left_semi")
    return of_large.unionAll(of_small)


def capped_sample(
    df: DataFrame, n: int = MAX_SAMPLES, key: str = "record_id", seed: int = RANDOM_STATE,
    levels: int = 2,
) -> DataFrame:
    """Exactly n rows by hash order, or all rows where there are no more than n."""
    # one stratum; an empty prefix rather than a literal, so that joins on it stay equi-joins
    hashed = df.select(hash_key(key, seed).alias("h"), F.col(key).alias("key")).withColumn(
        "stratum", F.left("h", F.lit(0)))
    histogram = _histogram(hashed, DIGITS)
    quotas = histogram.groupBy("stratum").agg(F.lit(n).cast("long").alias("k"))
    last = _last_taken(hashed, histogram, quotas, levels).select(F.struct("h", "key"))
    inside = F.struct(hash_key(key, seed), F.col(key)) <= last.scalar()
    return df.where(F.coalesce(inside, F.lit(True)))
