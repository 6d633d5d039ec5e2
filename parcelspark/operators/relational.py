"""Filtering, sorting, paging, latest rows and grouped counts."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def escaped_contains(c: Column, value: str) -> Column:
    """Case-insensitive containment of a literal: backslash, % and _ in it stand for themselves."""
    pattern = value.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.ilike(f"%{pattern}%")


def optional_filters(df: DataFrame, **criteria) -> DataFrame:
    """A conjunction of the criteria that are given (None adds nothing).

    name=value is equality, name__in membership, name__min and name__max inclusive bounds, name__like escaped
    containment. is_active=False means no filter, as only active rows can be asked for.
    """
    found: list[Column] = []
    for key, value in criteria.items():
        name, _, kind = key.partition("__")
        c = F.col(name)
        if value is None or (key == "is_active" and value is False):
            continue
        if kind == "in":
            found.append(c.isin(list(value)))
        elif kind == "min":
            found.append(c >= value)
        elif kind == "max":
            found.append(c <= value)
        elif kind == "like":
            found.append(escaped_contains(c, value))
        elif key == "is_active":
            found.append(c)
        else:
            found.append(c == value)
    return df.where(reduce(and_, found)) if found else df


def sorted_by(df: DataFrame, column: str, descending: bool = True, default: str = "created_us", tie: str = "id") -> DataFrame:
    """Rows by a column, or by `default` where the table hasn't got it; ties by `tie`."""
    c = F.col(column if column in df.columns else default)
    return df.orderBy(c.desc() if descending else c.asc(), F.col(tie))


def page(df: DataFrame, number: int, size: int, most: int = 100) -> DataFrame:
    """Rows of a page of a sorted table; pages count from 1 and have `most` rows at most."""
    size = min(size, most)
    return df.offset((number - 1) * size).limit(size)


#: Sizes that the table of a list page offers.
PAGE_SIZES = (10, 20, 50, 100)


def table_page(df: DataFrame, column: str | None, descending: bool, number: int, size: int, tie: str = "id") -> DataFrame:
    """A page of a table sorted by any of its columns (None: by `tie` alone), ties by `tie`; nulls come last.

    Sizes other than PAGE_SIZES and columns that the table hasn't got raise.
    """
    if size not in PAGE_SIZES:
        raise ValueError(f"a page has one of {PAGE_SIZES} rows, not {size}")
    if column is not None and column not in df.columns:
        raise ValueError(f"no column {column}")
    order = [] if column is None else [F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()]
    return page(df.orderBy(*order, F.col(tie)), number, size)


def page_metadata(df: DataFrame, number: int, size: int, least_pages: int = 0) -> DataFrame:
    """One row: total, pages, has_next, has_prev. least_pages=1 is the board's variant."""
    total = df.agg(F.count("*").alias("total"))
    pages = F.greatest(F.ceil(F.col("total") / size), F.lit(least_pages)).cast("long")
    return total.select("total", pages.alias("pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order: one shuffle on the keys, and no self-join."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


#: Values of a key that stand in one array, and tasks that the keys are dealt to.
PAIR_BLOCK, PAIR_TASKS = 256, 200


def _blocks(df: DataFrame, key: str, value: str) -> DataFrame:
    """key and arrays of PAIR_BLOCK of its distinct values at most; one shuffle, on the key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1
    placed = df.dropna().repartition(PAIR_TASKS, key).distinct().withColumn("_block", F.floor(place / PAIR_BLOCK))
    return placed.groupBy(key, "_block").agg(F.collect_list(value).alias("_" + value)).drop("_block")


def pairs_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The distinct pairs of a left and a right value of equal key, for keys that are frequent on both sides.

    left and right have the key and one more column. Arrays of values are joined, not values, and a task holds a pair of
    arrays. In the rows that come out a right value stands still while the values of one left array pass, again and again:
    a Parquet file holds that in a fraction of a byte a pair. The number of tasks is given, as Spark would join shuffled
    parts by their bytes, which are few beside the pairs.
    """
    (a,), (b,) = ([c for c in df.columns if c != key] for df in (left, right))
    met = _blocks(left, key, a).join(_blocks(right, key, b).hint("merge"), key)
    by_one = met.select(F.inline(F.transform("_" + b, lambda x: F.struct(x.alias(b), F.col("_" + a)))))
    return by_one.select(F.explode("_" + a).alias(a), b)


def counts_over(df: DataFrame, column: str, values: tuple[str, ...], name: str = "n") -> DataFrame:
    """Rows of each value of a fixed domain, 0 where there are none."""
    domain = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counted = df.groupBy(column).agg(F.count("*").alias("_n"))
    return domain.join(counted, column, "left").select(column, F.coalesce("_n", F.lit(0)).cast("long").alias(name))


def falsy_chain(*columns: Column) -> Column:
    """The first column that is neither null, nor empty text."""
    return F.coalesce(*(F.when(c.cast("string") != "", c) for c in columns))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: a row for each rule that a row breaks. Rules are predicates that must hold; null counts as held."""
    broken = F.array(*(F.when(~c, F.lit(name)) for name, c in rules.items()))
    return df.select(key, F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("rule"))
