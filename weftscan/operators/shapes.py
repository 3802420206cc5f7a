"""Rule-shaped operators with parameters, for any table: shares of groups, pivots against a baseline, statistics against bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftscan.sources.shared import landed


def share_of_group(rows: DataFrame, by: list[str], hit: Column, least_hits: int = 2, least_share: float = 0.5) -> DataFrame:
    """by, members, hits, fires: whether at least so many and at least such a share of a group hit. One partial aggregation."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), F.count_if(hit).alias("hits"))
    return counts.withColumn("fires", (F.col("hits") >= least_hits) & (F.col("hits") >= least_share * F.col("members")))


def roll_up(shares: DataFrame, group: str, part: str, total: Column, least_parts: int = 2, least_share: float = 0.5) -> DataFrame:
    """Fired parts of each group as one row if several fire over enough of ``total``, else a row for each part."""
    fired = shares.where("fires")
    merged = fired.groupBy(group).agg(((F.count(F.lit(1)) >= least_parts) & (F.sum("hits") >= least_share * F.max(total))).alias("merged"))
    keyed = fired.join(merged, group).withColumn("part", F.when(F.col("merged"), F.lit("*")).otherwise(F.col(part).cast("string")))
    return keyed.groupBy(group, "part").agg(F.count(F.lit(1)).alias("parts"), F.sum("hits").alias("hits"), F.sum("members").alias("members"))


def pivot_compare(rows: DataFrame, keys: list[str], label: str, value: str, baseline: str, others: list[str]) -> DataFrame:
    """keys, baseline and one column for each of ``others``: the largest value under each label; keys without the baseline go."""
    wide = rows.where(F.col(label).isin([baseline, *others])).groupBy(*keys).pivot(label, [baseline, *others]).agg(F.max(value))
    return wide.where(F.col(baseline).isNotNull())


def met(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right`` on equal or equally null ``by``, which right's other columns stand beside."""
    named = right.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], *[c for c in right.columns if c not in by])
    return left.join(named, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_by{k}")) for k, c in enumerate(by)]), how).drop(*[f"_by{k}" for k in range(len(by))])


def exact_median(rows: DataFrame, by: list[str], value: Column, held: int = 50_000, buckets: int = 512) -> DataFrame:
    """by, median: the exact median of the values (numbers) of each group that are not null, null for a group without any.

    A group of at most ``held`` values is put in order as it is. Of a larger one, values are counted by bucket between the least
    and the greatest, and only the bucket that holds the middle is looked at again, until it has few distinct values or one; a
    middle that lies between two buckets is the last value of one and the first of the next. No task holds more than a group's
    buckets, or ``held`` of its distinct values. A few rounds are enough for any values, as a range of many powers of two is cut by powers first. NaN is the greatest value.
    """
    given = rows.select(*by, value.cast("double").alias("_v"))
    large = landed(given.groupBy(*by).agg(F.count("_v").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where(F.col("_all") > held))
    if large.isEmpty():
        return given.groupBy(*by).agg(F.median("_v").alias("median"))
    small = met(given, large.select(*by), by, "left_anti").groupBy(*by).agg(F.median("_v").alias("median"))
    cells = landed(met(given, large.select(*by), by, "left_semi").where("_v is not null").groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    holds = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    v, lo, hi, last = F.col("_v"), F.col("_lo"), F.col("_hi"), F.lit(buckets - 1)
    even = F.least(F.floor((v - lo) / (hi - lo) * buckets), last)
    # a range of one sign over several powers of two is cut evenly by powers
    by_power = F.least(F.floor((F.log(F.abs(v)) - F.log(F.abs(lo))) / (F.log(F.abs(hi)) - F.log(F.abs(lo))) * buckets), last)
    one_sign = ((lo > 0) | (hi < 0)) & (hi < float("inf")) & (lo > float("-inf"))
    close = F.when(lo > 0, hi <= 2 * lo).otherwise(lo >= 2 * hi)
    # any other range is cut between infinite, negative, no, positive and undefined values
    kinds = F.when(F.isnan(v), 5).when(v == float("inf"), 4).when(v == float("-inf"), 0).when(v < 0, 1).when(v == 0, 2).otherwise(3)
    bucket = F.when(hi == lo, 0).when(one_sign & close, even).when(one_sign, by_power).otherwise(kinds)
    # of a group: its values from _lo to _hi are looked at, _below of its values lie before them
    looked_at, done = large.withColumn("_below", F.lit(0).cast("long")), [small]
    while True:
        inside = met(cells, looked_at, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counted = inside.groupBy(*by, "_all", "_below", bucket.alias("_b")).agg(F.sum("_n").alias("_n"), F.count(F.lit(1)).alias("_values"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        placed = counted.withColumn("_before", F.col("_below") + F.sum("_n").over(Window.partitionBy(*by).orderBy("_b")) - F.col("_n"))
        picked = landed(placed.where(holds(low) | holds(high)).withColumns({"_low": holds(low), "_high": holds(high)}))
        done.append(picked.where("_low <> _high").groupBy(*by).agg(((F.max(F.when(F.col("_low"), F.col("_hi"))) + F.max(F.when(F.col("_high"), F.col("_lo")))) / 2).alias("median")))
        both = picked.where("_low and _high").select(*by, "_all", "_lo", "_hi", "_values", F.col("_before").alias("_below"))
        done.append(both.where("_values = 1").select(*by, F.col("_lo").alias("median")))
        few = met(cells, both.where(F.col("_values").between(2, held)), by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        few = few.withColumn("_before", F.col("_below") + F.sum("_n").over(Window.partitionBy(*by).orderBy("_v")) - F.col("_n"))
        done.append(few.groupBy(*by).agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias("median")))
        looked_at = landed(both.where(F.col("_values") > held).drop("_values"))
        if looked_at.isEmpty():
            return reduce(DataFrame.unionByName, done)


def median_against(rows: DataFrame, by: list[str], value: Column, bound: float, least_rows: int = 5, held: int = 50_000) -> DataFrame:
    """by, n, median, over (values above the bound), verdict: not_assessed with too few rows, else above or within.

    The median is exact for groups of any size (see ``exact_median``).
    """
    counts = rows.groupBy(*by).agg(F.count(value).alias("n"), F.count_if(value > bound).alias("over"))
    joined = met(counts, exact_median(rows, by, value, held), by, "left").select(*by, "n", "median", "over")
    return joined.withColumn("verdict", F.when(F.col("n") < least_rows, "not_assessed").when(F.col("median") > bound, "above").otherwise("within"))


def approximate_median_against(rows: DataFrame, by: list[str], value: Column, bound: float, least_rows: int = 5, accuracy: int = 10_000) -> DataFrame:
    """As ``median_against`` for groups of any size: a sketch that is merged from partial ones."""
    out = rows.groupBy(*by).agg(F.count(value).alias("n"), F.percentile_approx(value, 0.5, accuracy).alias("median"), F.count_if(value > bound).alias("over"))
    return out.withColumn("verdict", F.when(F.col("n") < least_rows, "not_assessed").when(F.col("median") > bound, "above").otherwise("within"))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key with copies, the number of rows it stands for.

    An aggregation and not a window: copies are combined before the shuffle, so a key with a third of all rows is no burden.
    """
    rest = [c for c in rows.columns if c not in key and c not in order]
    first = F.min_by(F.struct(*[F.col(c) for c in (*order, *rest)]), F.struct(*order)).alias("f")
    return rows.groupBy(*key).agg(first, F.count(F.lit(1)).alias("copies")).select(*key, "f.*", "copies")


def top_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their rank; Spark cuts groups to n rows before it shuffles them."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def strata(discovered: DataFrame, sampled: DataFrame, by: list[str]) -> DataFrame:
    """by, discovered, sampled: counts of two tables side by side, without groups that are in neither."""
    both = discovered.select(*by, F.lit(1).alias("d"), F.lit(0).alias("s")).unionByName(sampled.select(*by, F.lit(0).alias("d"), F.lit(1).alias("s")))
    return both.groupBy(*by).agg(F.sum("d").alias("discovered"), F.sum("s").alias("sampled"))
