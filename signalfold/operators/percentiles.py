"""Exact, linearly interpolated percentiles per group, by radix selection.

Spark's own `percentile` keeps every distinct value of a group in one task.  Here a value becomes a
64-bit key of the same order.  One pass counts the leading digits of the keys per group, which tells
the range that holds each wanted rank.  Ranges are narrowed by further digits, round by round, until
the largest holds few enough rows to be sorted; only rows of those ranges are read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalfold.scale import broadcast_if_small, null_safe_join, work_dir

# Bits of a key that a round leaves out.  The first digit has 256 ranges for each power of two.
SHIFTS = (44, 28, 12, 0)
# Rows of a range that one task may sort.
SMALL = 1 << 18


def order_key(value: Column) -> Column:
    """A long that is ordered as the values are: the bits of a double, with a sign.

    Zeros are equal, infinities the outermost but for NaN, which counts as the largest value.
    """
    v = value.cast("double")
    a = F.abs(v)
    # Logarithms near a power of two may round to it; the exact quotient tells.
    near = F.least(F.greatest(F.floor(F.log2(a)), F.lit(-1022)), F.lit(1023))
    part = a / F.pow(F.lit(2.0), near)
    power = F.when(part >= 2, near + 1).when(part < 1, near - 1).otherwise(near)
    fraction = F.when(part >= 2, part / 2).when(part < 1, part * 2).otherwise(part) - 1
    bits = F.shiftleft((power + 1023).cast("long"), 52) + (fraction * float(1 << 52)).cast("long")
    # Doubles below the least normal one are multiples of 2 ** -1074.
    small = (a * 2.0**537 * 2.0**537).cast("long")
    size = F.when(a < 2.0**-1022, small).when(a == float("inf"), F.lit(2047 << 52)).otherwise(bits)
    return F.when(F.isnan(v), F.lit((2047 << 52) + 1)).when(v < 0, -size).otherwise(size)


def _kept(df: DataFrame, label: str) -> DataFrame:
    """Written to the shared work folder and read back: the passes behind it read a table of known size."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ranges(counts: DataFrame, keys: Sequence[str], probs: Sequence[float], within: DataFrame | None) -> DataFrame:
    """Ranges (keys, _b) that hold wanted ranks, with the ranks, the rows before them and their own rows.

    `counts` has (keys, _b, _n), or (keys, _in, _b, _n) inside the ranges `within` of the round before.
    """
    region = [*keys] if within is None else [*keys, "_in"]
    order = Window.partitionBy(*region).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumn("_upto", F.sum("_n").over(order))
    if within is None:
        rows = rows.withColumn("_total", F.sum("_n").over(Window.partitionBy(*region)))
        places = F.array(*[F.lit(float(p)) * (F.col("_total") - 1) for p in probs])
        ranks = F.array_distinct(F.concat(F.transform(places, lambda p: F.floor(p)), F.transform(places, lambda p: F.ceil(p))))
        rows = rows.withColumns({"_all": ranks, "_shift": F.lit(0).cast("long")})
    else:
        before = within.select(*keys, F.col("_b").alias("_in"), F.col("_before").alias("_shift"), F.col("_ranks").alias("_all"), "_total")
        rows = null_safe_join(rows, broadcast_if_small(before), region)
    first = F.col("_shift") + F.col("_upto") - F.col("_n")
    here = F.filter("_all", lambda r: (r >= first) & (r < F.col("_shift") + F.col("_upto")))
    found = rows.select(*keys, "_b", "_n", first.alias("_before"), here.alias("_ranks"), "_total")
    return found.filter(F.size("_ranks") > 0)


def _select(rows: DataFrame, counts: DataFrame, keys: Sequence[str], probs: Sequence[float], name: str, small: int) -> DataFrame:
    """Percentiles from `rows` (keys, _v, _key) and the counts of their first digits."""
    wanted, level = _kept(_ranges(counts, keys, probs, None), "ranks"), 0
    while level + 1 < len(SHIFTS) and (wanted.agg(F.max("_n")).first()[0] or 0) > small:
        inside = null_safe_join(
            rows.withColumn("_b", F.shiftright("_key", SHIFTS[level])), broadcast_if_small(wanted.select(*keys, "_b")), [*keys, "_b"], "left_semi"
        )
        level += 1
        finer = inside.groupBy(*keys, F.col("_b").alias("_in"), F.shiftright("_key", SHIFTS[level]).alias("_b2")).agg(F.count("*").alias("_n"))
        wanted = _kept(_ranges(finer.withColumnRenamed("_b2", "_b"), keys, probs, wanted), "ranks")
    inner = null_safe_join(
        rows.withColumn("_b", F.shiftright("_key", SHIFTS[level])), broadcast_if_small(wanted.select(*keys, "_b")), [*keys, "_b"], "left_semi"
    )
    values = inner.groupBy(*keys, "_b", "_key").agg(F.count("*").alias("_c"), F.min("_v").alias("_v"))
    hits = null_safe_join(values, broadcast_if_small(wanted), [*keys, "_b"])
    order = Window.partitionBy(*keys, "_b").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = hits.withColumn("_upto", F.col("_before") + F.sum("_c").over(order))
    rank = F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_c")) & (r < F.col("_upto")))
    found = hits.select(*keys, "_total", F.col("_v").cast("double").alias("_v"), F.explode(rank).alias("_r"))
    # At most two rows per wanted percentile and group arrive here.
    lookup = found.groupBy(*keys).agg(
        F.max("_total").alias("_total"),
        F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m"),
    )

    def interpolate(p: float) -> Column:
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        low, high = F.floor(pos), F.ceil(pos)
        below, above = F.element_at("_m", low), F.element_at("_m", high)
        return F.when(low == high, below).otherwise((high - pos) * below + (pos - low) * above)

    return lookup.select(*keys, F.array(*[interpolate(p) for p in probs]).alias(name))


def _keyed(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).withColumns({"_v": F.col(value), "_key": order_key(F.col(value))})


def rank_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "q", small: int = SMALL
) -> DataFrame:
    """Exact percentiles per group; no task sorts more than some `small` rows of a range, however large a group is."""
    keys = list(keys)
    rows = _keyed(df.select(*keys, value), value).select(*keys, "_v", "_key")
    counts = rows.groupBy(*keys, F.shiftright("_key", SHIFTS[0]).alias("_b")).agg(F.count("*").alias("_n"))
    return _select(rows, counts, keys, probs, name, small)


def aggregate_with_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    sums: Mapping[str, Column],
    labels: Sequence[str] = (),
    name: str = "q",
    small: int = SMALL,
) -> DataFrame:
    """Per group: aggregates that add up, one value of each label, exact percentiles of `value`.

    One scan gives the sums and the first digits of the values.  A label (text that is the same
    for a whole group, or any of its values) cannot live in the buffer of a hash aggregate; it
    is a grouping column there, which keeps the pass over the rows free of sorting.
    """
    keys = list(keys)
    digit = F.shiftright(order_key(F.col(value)), SHIFTS[0]).alias("_b")
    totals = [expr.alias(column) for column, expr in sums.items()]
    first = _kept(df.groupBy(*keys, *labels, digit).agg(F.count(value).alias("_n"), *totals), "digits")
    base = first.groupBy(*keys).agg(*[F.min(c).alias(c) for c in labels], *[F.sum(c).alias(c) for c in sums])
    counts = first.filter("_b IS NOT NULL").groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    rows = _keyed(df.select(*keys, value), value).select(*keys, "_v", "_key")
    found = _select(rows, counts, keys, probs, name, small)
    return null_safe_join(base, broadcast_if_small(found), keys, "left")
