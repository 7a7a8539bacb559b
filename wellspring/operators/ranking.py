"""Ranks, quantiles and prefix sums without gathering a group in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wellspring.functions.values import col

MARGIN = 0.002  # share of the values kept on each side of the wanted rank per narrowing round
ACCURACY = 1_000  # of the approximate quantiles that bound the next range: within 1/1000 of the rank
LARGEST_GROUP = 100_000  # values of a column that the last round may rank in one window
VALUE_RANGES = 1_000


def hashed_rank(entities: DataFrame, group: Sequence[str], name: str, salt: str) -> DataFrame:
    """Rank the entities of each group by the md5 of their name: repeatable and well mixed.

    The first three hex digits cut each group into 4096 ranges; the rank is the
    number of entities in the lower ranges plus the row number in the own range, so
    even a group with most of the entities is spread over many tasks.
    """
    hashed = entities.withColumn("hash", F.md5(F.concat(col(name), F.lit(salt))))
    ranged = hashed.withColumn("hash_range", F.substring("hash", 1, 3))
    keys = [*group, "hash_range"]
    in_range = Window.partitionBy(*keys).orderBy("hash", name)
    placed = ranged.withColumn("place", F.row_number().over(in_range))
    sizes = entities.select(
        *group, F.substring(F.md5(F.concat(col(name), F.lit(salt))), 1, 3).alias("hash_range")
    ).groupBy(*keys).agg(F.count("*").alias("entities"))
    of_group = Window.partitionBy(*group)
    lower = of_group.orderBy("hash_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        F.coalesce(F.sum("entities").over(lower), F.lit(0)).alias("lower_entities"),
        F.sum("entities").over(of_group).alias("group_size"),
    )
    return placed.join(offsets, keys).select(
        *entities.columns, (F.col("lower_entities") + F.col("place")).alias("rank"), "group_size"
    )


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    fraction: float = 0.5,
    largest_group: int = LARGEST_GROUP,
) -> dict[str, float | None]:
    """Exact quantile (linear interpolation) of every column, in a few passes over ``df``.

    Each round takes two approximate quantiles closely around the wanted rank and
    counts the values below and between them, which shows whether the rank lies
    inside. Once the ranges hold at most ``largest_group`` values (or one distinct
    value) these are counted by value and ranked, one window per column; only the two
    values around the rank of each column come back. All columns share each pass;
    NULLs are skipped; an empty column gives None.
    """
    sizes = df.agg(*[F.struct(F.count(col(c)), F.min(col(c)), F.max(col(c))).alias(c) for c in columns]).first()
    found: dict[str, float | None] = {}
    ranges: dict[str, tuple[float, float, int, int]] = {}
    ranks: dict[str, tuple[int, int, float]] = {}
    for c in columns:
        count, low, high = sizes[c]
        if count == 0:
            found[c] = None
            continue
        place = (count - 1) * fraction
        ranks[c] = (math.floor(place), math.ceil(place), place - math.floor(place))
        ranges[c] = (float(low), float(high), 0, count)  # low, high, values below, values inside

    while wide := [c for c, (low, high, _, inside) in ranges.items() if inside > largest_group and low < high]:
        candidates = _closer(df, {c: (*ranges[c], *ranks[c][:2]) for c in wide})
        counted = _counts(df, candidates)
        for c in wide:
            below, inside = counted[c]
            holds = below <= ranks[c][0] and ranks[c][1] < below + inside
            if holds and inside < ranges[c][3]:
                ranges[c] = (*candidates[c], below, inside)
            else:  # many copies near the rank: cut the range in two instead
                ranges[c] = _halve(df, c, ranges[c], ranks[c], largest_group)

    found |= {c: low for c, (low, high, _, _) in ranges.items() if low == high}
    open_ranges = {c: r for c, r in ranges.items() if r[0] < r[1]}
    for c, values in _ranked(df, open_ranges, ranks).items():
        found[c] = values[0] + (values[-1] - values[0]) * ranks[c][2]
    return found


def _ranked(df: DataFrame, ranges: dict[str, tuple], ranks: dict[str, tuple]) -> dict[str, list[float]]:
    """The values that stand on the first and last rank of each column, in order."""
    if not ranges:
        return {}
    names = list(ranges)
    cells = [
        F.struct(F.lit(i).alias("column"), _inside(c, *ranges[c][:2]).alias("value")) for i, c in enumerate(names)
    ]
    values = df.select(F.explode_outer(F.array(*cells)).alias("cell")).select("cell.*").filter("value IS NOT NULL")
    counted = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("column").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum("n").over(upto)
    wanted = [(i, ranks[c][0] - ranges[c][2], ranks[c][1] - ranges[c][2]) for i, c in enumerate(names)]
    wanted = df.sparkSession.createDataFrame(wanted, "column int, first long, last long")
    placed = counted.withColumn("end", ends).join(F.broadcast(wanted), "column")  # one row a column
    hit = "(first >= end - n AND first < end) OR (last >= end - n AND last < end)"
    out: dict[str, list[float]] = {}
    for row in placed.filter(hit).orderBy("column", "value").collect():
        out.setdefault(names[row["column"]], []).append(float(row["value"]))
    return out


def _inside(c: str, low: float, high: float):
    return F.when(col(c).between(low, high), col(c).cast("double"))


def _closer(df: DataFrame, ranges: dict[str, tuple]) -> dict[str, tuple[float, float]]:
    """Approximate quantiles of each range just below and just above its ranks."""
    asked = []
    for c, (low, high, below, inside, first, last) in ranges.items():
        steps = [max(0.0, (first - below) / inside - MARGIN), min(1.0, (last - below) / inside + MARGIN)]
        asked.append(F.percentile_approx(_inside(c, low, high), steps, ACCURACY).alias(c))
    row = df.agg(*asked).first()
    return {c: tuple(row[c]) for c in ranges}


def _counts(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> dict[str, tuple[int, int]]:
    row = df.agg(
        *[
            F.struct(F.count_if(col(c) < low), F.count_if(col(c).between(low, high))).alias(c)
            for c, (low, high) in ranges.items()
        ]
    ).first()
    return {c: tuple(row[c]) for c in ranges}


def _halve(df, c, current, rank, largest_group):
    """The half of a range that holds the rank; the two middle neighbours when both do."""
    low, high, below, inside = current
    middle = low + (high - low) / 2
    row = df.agg(
        F.count_if(col(c).between(low, middle)),
        F.max(F.when(col(c).between(low, middle), col(c))),
        F.min(F.when((col(c) > middle) & (col(c) <= high), col(c))),
    ).first()
    lower, last_lower, first_upper = row
    if rank[1] < below + lower:
        return low, float(last_lower), below, lower
    if rank[0] >= below + lower:
        return float(first_upper), high, below + lower, inside - lower
    edge = df.agg(
        F.count_if(col(c) < last_lower), F.count_if(col(c).between(last_lower, first_upper))
    ).first()
    if edge[1] > largest_group:  # two values with many copies: read both off directly
        return _pair(rank, float(last_lower), float(first_upper), edge[0])
    return float(last_lower), float(first_upper), edge[0], edge[1]


def _pair(rank, a, b, below):
    value = a + (b - a) * rank[2]
    return value, value, below, 1


def by_quantile(df: DataFrame, value: str, ranges: int = VALUE_RANGES) -> DataFrame:
    """Add ``value_range``: ordered ranges of ``value`` with about equally many rows each."""
    steps = [i / ranges for i in range(1, ranges)]
    cuts = df.agg(F.percentile_approx(value, steps, 10 * ranges)).first()[0] or []
    splits = [-math.inf, *sorted({float(c) for c in cuts}), math.inf]
    return Bucketizer(splits=splits, inputCol=value, outputCol="value_range").transform(df)
