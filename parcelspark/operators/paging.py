"""Deep pages of a sorted table by order statistics: only the range of rows that holds the page is sorted."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges into which rows are counted; a page sorts about one of them.
RANGES = 256


def deep_page(df: DataFrame, column: str, descending: bool, number: int, size: int, tie: str = "id", ranges: int = RANGES) -> DataFrame:
    """Page `number` (from 1) of df sorted by a numeric or time column, ties by `tie`, nulls last; exact.

    One pass finds bounds of ranges of about equal size (approximate percentiles), one counts the rows of each, and only
    the ranges that hold the page are read and sorted, by a filter on the column that reaches the scan. Where one value
    fills several ranges, its rows are cut again by `tie` if that is a number. Past the end there are no rows.
    """
    return _rows(df, column, descending, (number - 1) * size, size, tie, ranges)


def _rows(df: DataFrame, column: str, descending: bool, skip: int, size: int, tie: str, ranges: int) -> DataFrame:
    c = F.col(column)
    some, nulls = df.where(c.isNotNull()), df.where(c.isNull())
    bounds = sorted({*(some.agg(F.percentile_approx(column, [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or [])})
    # range i holds bounds[i - 1] < value <= bounds[i]
    place = F.size(F.filter(F.lit(bounds), lambda b: b < c)) if bounds else F.lit(0)
    counts = dict(some.groupBy(place.alias("range")).count().collect())  # `ranges` rows at most
    walk = sorted(counts, reverse=descending)
    ends = [0, *accumulate(counts[i] for i in walk)]
    first, last = bisect_right(ends, skip) - 1, bisect_right(ends, skip + size - 1) - 1
    if first == len(walk):
        return nulls.orderBy(tie).offset(skip - ends[-1]).limit(size)
    low, high = sorted((walk[first], walk[min(last, len(walk) - 1)]))
    part = some
    if low > 0:
        part = part.where(c > F.lit(bounds[low - 1]))
    if high < len(bounds):
        part = part.where(c <= F.lit(bounds[high]))
    if low == high < len(bounds) and counts[low] * ranges > 4 * ends[-1] and column != tie and dict(df.dtypes)[tie] in ("int", "bigint"):
        equal = part.where(c == F.lit(bounds[low]))
        n = equal.count()
        at = ends[first] + (0 if descending else counts[low] - n)  # the frequent value is the highest of its range
        if at <= skip and skip + size <= at + n:
            return _rows(equal, tie, False, skip - at, size, tie, ranges)
    if last == len(walk):
        part = part.unionByName(nulls)
    return part.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), tie).offset(skip - ends[first]).limit(size)
