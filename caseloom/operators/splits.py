"""Exact stratified splits, samples and folds.

All of them answer one question: which rows of a class are among its first ``n`` in a
seeded random order? Ranking a class in one window would send a class holding a third
of the table to one task. Instead rows are counted per (class, hash bucket); running
sums tell which bucket each cut falls into; only that bucket, 1/4096 of the class, is
ranked to find the exact cut value. Every row is then compared with the few cut values
of its class, which are broadcast. Texts are never shuffled, and quotas are exact.

The input is read several times, so pass a written table rather than a long plan.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom import config
from caseloom.operators.lookup import fits_broadcast, lookup
from caseloom.session import settle

BUCKET_HEX = 3


def random_order(key: str, seed: int = config.SEED) -> Column:
    """A seeded order of rows that any engine can reproduce from the key."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def proportional_quota(sizes: DataFrame, n: str, draws: str, out: str, label: str) -> DataFrame:
    """Share out ``draws`` rows over classes in proportion to ``n``, exactly.

    Each class gets the whole part of its share; rows left over go to the largest
    fractions, equal ones by label. ``sizes`` has one row per class.
    """
    everything = Window.partitionBy(F.lit(0))
    share = F.col(n) / F.sum(n).over(everything) * F.col(draws)
    split = (
        sizes.withColumn("_share", share)
        .withColumn("_whole", F.floor("_share"))
        .withColumn("_left", F.col(draws) - F.sum("_whole").over(everything))
    )
    by_fraction = everything.orderBy(F.desc(F.col("_share") - F.col("_whole")), label)
    extra = (F.row_number().over(by_fraction) <= F.col("_left")).cast("long")
    return split.withColumn(out, F.col("_whole") + extra).drop("_share", "_whole", "_left")


def cut_values(df: DataFrame, label: str, key: str, cuts: DataFrame, order: Column) -> DataFrame:
    """``(label, cut_no, at)``: the (order, key) of the ``upto``-th row of each class."""
    keyed = df.select(label, F.col(key).alias("_k"), order.alias("_o")).withColumn("_b", F.substring("_o", 1, BUCKET_HEX))
    counts = keyed.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    ends = counts.withColumn("_end", F.sum("_n").over(Window.partitionBy(label).orderBy("_b")))
    edges = (
        ends.join(cuts, label)
        .filter((F.col("upto") <= F.col("_end")) & (F.col("upto") > F.col("_end") - F.col("_n")))
        .select(label, "_b", "cut_no", (F.col("upto") - F.col("_end") + F.col("_n")).alias("_need"))
    )
    rank = F.row_number().over(Window.partitionBy(label, "_b", "cut_no").orderBy("_o", "_k"))
    edges = settle(edges, "edges")  # a row or two per class
    found = keyed.join(F.broadcast(edges), [label, "_b"]) if fits_broadcast(edges) else keyed.join(edges, [label, "_b"])
    return (
        found.withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_need"))
        .select(label, "cut_no", F.struct("_o", "_k").alias("at"))
    )


def assign_parts(df: DataFrame, label: str, key: str, cuts: DataFrame, seed: int = config.SEED, out: str = "part") -> DataFrame:
    """Add ``out``: how many cuts of its class lie before the row.

    ``cuts`` is ``(label, cut_no, upto)``, ``upto`` being the number of rows in parts up
    to and including ``cut_no``; it is written once. Joins are broadcasts where a count of rows and bytes allows it.
    """
    order = random_order(key, seed)
    cuts = settle(cuts, "cuts")
    at = cut_values(df, label, key, cuts, order)
    per_class = cuts.join(at, [label, "cut_no"], "left").groupBy(label).agg(F.collect_list(F.struct("cut_no", "at")).alias("_cuts"))
    passed = F.filter("_cuts", lambda c: c["at"].isNull() | (c["at"] < F.col("_row")))
    return (
        lookup(df.withColumn("_row", F.struct(order.alias("_o"), F.col(key).alias("_k"))), per_class, [label])
        .withColumn(out, F.size(passed))
        .drop("_row", "_cuts")
    )


def split_quotas(
    sizes: DataFrame, label: str, test_share: float = config.TEST_SHARE, val_share: float = config.VAL_SHARE
) -> DataFrame:
    """Per class how many rows go to test, val and train.

    Test is taken first, rounded up, from all rows; val is then ``val/(1-test)`` of the
    rest, rounded up. Each total is shared out over the classes in proportion.
    """
    everything = Window.partitionBy(F.lit(0))
    rest_share = val_share / (1 - test_share)
    first = sizes.withColumn("_all", F.sum("n").over(everything)).withColumn(
        "_rest", F.col("_all") - F.ceil(F.lit(float(test_share)) * F.col("_all"))
    )
    rest = proportional_quota(first, "n", "_rest", "n_rest", label).withColumn(
        "_train", F.col("_rest") - F.ceil(F.lit(float(rest_share)) * F.col("_rest"))
    )
    done = proportional_quota(rest, "n_rest", "_train", "n_train", label)
    return done.select(
        label, "n", (F.col("n") - F.col("n_rest")).alias("n_test"), (F.col("n_rest") - F.col("n_train")).alias("n_val"), "n_train"
    )


def _cut_rows(quotas: DataFrame, label: str, *uptos: Column) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(i).alias("cut_no"), u.cast("long").alias("upto")) for i, u in enumerate(uptos)])
    return quotas.select(label, F.inline(steps))


def assert_splittable(df: DataFrame, label: str = config.LABEL, test_share: float = config.TEST_SHARE) -> None:
    """Raise where a stratified split is undefined: a class of one row, or too few rows."""
    found = class_sizes(df, label).agg(F.min("n").alias("low"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes")).first()
    if not found["total"]:
        raise ValueError("cannot split a table without rows")
    if found["low"] < 2:
        raise ValueError("the least populated class has only 1 row; a stratified split needs 2")
    if math.ceil(test_share * found["total"]) < found["classes"]:
        raise ValueError("the test split would have fewer rows than there are classes")


def stratified_split(
    df: DataFrame,
    label: str = config.LABEL,
    key: str = config.KEY,
    test_share: float = config.TEST_SHARE,
    val_share: float = config.VAL_SHARE,
    seed: int = config.SEED,
) -> DataFrame:
    """Add ``split``: test, val or train, with exact quotas in every class."""
    quotas = split_quotas(class_sizes(df, label), label, test_share, val_share)
    cuts = _cut_rows(quotas, label, F.col("n_test"), F.col("n_test") + F.col("n_val"))
    names = F.array(F.lit("test"), F.lit("val"), F.lit("train"))
    return assign_parts(df, label, key, cuts, seed).withColumn("split", F.element_at(names, F.col("part") + 1)).drop("part")


def holdout_split(df: DataFrame, label: str, key: str, test_share: float = 0.2, seed: int = config.SEED) -> DataFrame:
    """Add ``split``: test or train, stratified."""
    return stratified_split(df, label, key, test_share, 0.0, seed)


def random_holdout(df: DataFrame, key: str, test_share: float = 0.2, seed: int = config.SEED) -> DataFrame:
    """Add ``split`` without stratification: exactly ``ceil(share * rows)`` test rows."""
    one = df.withColumn("_all", F.lit(0))
    cuts = _cut_rows(class_sizes(one, "_all"), "_all", F.ceil(F.lit(float(test_share)) * F.col("n")))
    part = assign_parts(one, "_all", key, cuts, seed)
    return part.withColumn("split", F.when(F.col("part") == 0, "test").otherwise("train")).drop("part", "_all")


def time_split(df: DataFrame, date: str = config.FILED, max_year: int = config.TIME_TRAIN_MAX_YEAR) -> DataFrame:
    """Add ``time_split``: train up to ``max_year``, test after; null dates get neither."""
    return df.withColumn("time_split", F.when(F.year(date) <= max_year, "train").when(F.year(date) > max_year, "test"))


def stratified_subsample(df: DataFrame, n: int | None, label: str, key: str, seed: int = config.SEED) -> DataFrame:
    """Exactly ``n`` rows with class shares kept; all rows if ``n`` is None or not smaller."""
    if n is None:
        return df
    sizes = class_sizes(df, label)
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    quotas = proportional_quota(sizes.withColumn("_draws", F.least(total, F.lit(n))), "n", "_draws", "take", label)
    return assign_parts(df, label, key, _cut_rows(quotas, label, F.col("take")), seed).filter("part = 0").drop("part")


def seeded_sample(df: DataFrame, n: int, key: str = config.KEY, seed: int = config.SEED) -> DataFrame:
    """The first ``min(n, rows)`` rows in seeded order (a bounded top-n, not a full sort)."""
    return df.orderBy(random_order(key, seed), key).limit(n)


def downsample_majority(df: DataFrame, label: str, key: str, seed: int = config.SEED) -> DataFrame:
    """Cut the largest class to the size of the smallest; other classes stay whole.

    Equal sizes: the alphabetically first class counts as largest and as smallest.
    """
    everything = Window.partitionBy(F.lit(0))
    sizes = class_sizes(df, label).withColumn("_low", F.min("n").over(everything))
    largest = F.row_number().over(everything.orderBy(F.desc("n"), label)) == 1
    quotas = sizes.withColumn("take", F.when(largest, F.col("_low")).otherwise(F.col("n")))
    return assign_parts(df, label, key, _cut_rows(quotas, label, F.col("take")), seed).filter("part = 0").drop("part")


COPY_BLOCK = 1024


def upsample_classes(df: DataFrame, label: str, key: str, seed: int = config.SEED) -> DataFrame:
    """Repeat rows until every class is as large as the largest; adds ``copy`` from 1.

    Rows are repeated evenly: each gets ``floor(max/n)`` copies, and the first ``max mod n``
    in seeded order one more. Use it on a train split only. A rare class may need very many
    copies of a row, so copies are made block by block, and blocks are spread over tasks.
    """
    everything = Window.partitionBy(F.lit(0))
    sizes = class_sizes(df, label).withColumn("_max", F.max("n").over(everything))
    quotas = sizes.withColumn("extra", F.col("_max") % F.col("n")).withColumn("_base", F.floor(F.col("_max") / F.col("n")))
    part = assign_parts(df, label, key, _cut_rows(quotas, label, F.col("extra")), seed)
    counted = lookup(part, quotas.select(label, "_base"), [label]).withColumn(
        "_copies", F.col("_base") + F.when(F.col("part") == 0, 1).otherwise(0)
    ).drop("part", "_base")
    few = counted.filter(F.col("_copies") <= COPY_BLOCK)
    many = counted.filter(F.col("_copies") > COPY_BLOCK)
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / COPY_BLOCK))
    first = F.col("_block") * COPY_BLOCK + 1
    spread = many.withColumn("_block", F.explode(blocks)).repartition(F.col(key), F.col("_block"))
    made = [
        few.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))),
        spread.withColumn(
            "copy", F.explode(F.sequence(first, F.least(first + (COPY_BLOCK - 1), F.col("_copies"))))
        ).drop("_block"),
    ]
    return reduce(DataFrame.unionByName, made).drop("_copies")


def shuffled(df: DataFrame, key: str, seed: int = config.SEED) -> DataFrame:
    """All rows in seeded random order (a range-partitioned sort)."""
    return df.orderBy(random_order(key, seed), key)


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 3, seed: int = config.SEED) -> DataFrame:
    """Add ``fold`` 0..k-1; fold sizes within a class differ by at most one."""
    sizes = class_sizes(df, label)
    steps = [F.floor(F.col("n") * i / k) for i in range(1, k)]
    return assign_parts(df, label, key, _cut_rows(sizes, label, *steps), seed, "fold")
