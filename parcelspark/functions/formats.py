"""Text made for people and paths: slugs, prices, lists, templates, masks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """ASCII letters of a text under compatibility decomposition; Spark has no expression for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii"))


def slug(text: Column, most: int = 60) -> Column:
    """Lower-case words joined by hyphens, cut at a hyphen in the second half of `most` characters. ASCII in, see folded()."""
    s = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", "-"), F.lit("-"))
    cut = F.left(s, F.lit(most))
    last = F.length(cut) - F.instr(F.reverse(cut), "-")  # place of the last hyphen, from 0
    return F.when(F.length(s) <= most, s).when((F.instr(cut, "-") > 0) & (last > most // 2), F.left(cut, last)).otherwise(cut)


def _one_decimal(x: Column) -> Column:
    """A number of at least 1 with one decimal, its exact binary value rounded half to even.

    Formatters of the JVM round the shortest decimal text of a double instead, and half up: 1.15 and 1.25 would differ.
    """
    whole, unit = F.floor(x).cast("long"), 1 << 52
    tenths = ((x - F.floor(x)) * float(unit)).cast("long") * 10  # exact: a double of at least 1 has 52 bits after the point at most
    digit, rest = F.floor(tenths / unit).cast("long"), tenths % unit
    up = (rest > unit // 2) | ((rest == unit // 2) & (digit % 2 == 1))
    digit = digit + up.cast("long")
    return F.concat((whole + F.when(digit == 10, 1).otherwise(0)).cast("string"), F.lit("."), (digit % 10).cast("string"))


def price_text(price: Column) -> Column:
    """AED 1.2M, AED 850K, AED 900; null: on request."""
    p = price.cast("double")
    return (
        F.when(p.isNull(), "Price on request")
        .when(p >= 1_000_000, F.concat(F.lit("AED "), _one_decimal(p / 1_000_000), F.lit("M")))
        .when(p >= 1_000, F.concat(F.lit("AED "), F.bround(p / 1_000).cast("long"), F.lit("K")))
        .otherwise(F.concat(F.lit("AED "), F.format_number(p, 0)))
    )


def price_range_text(low: Column, high: Column) -> Column:
    """Nulls and zeros are absent."""
    a, b = F.nullif(low, F.lit(0).cast("double")), F.nullif(high, F.lit(0).cast("double"))
    return (
        F.when(a.isNotNull() & b.isNotNull(), F.concat(price_text(a), F.lit(" - "), price_text(b)))
        .when(a.isNotNull(), F.concat(F.lit("From "), price_text(a)))
        .when(b.isNotNull(), F.concat(F.lit("Up to "), price_text(b)))
        .otherwise("Price on request")
    )


def list_text(items: Column) -> Column:
    """Up to three items, then how many more."""
    n = F.coalesce(F.size(items), F.lit(0))
    first = F.array_join(F.slice(items, 1, 3), ", ")
    return F.when(n <= 0, "Not specified").when(n <= 3, first).otherwise(F.concat(first, F.lit(", and "), (n - 3).cast("string"), F.lit(" more")))


def plan_text(plan: Column) -> Column:
    """A map of payment parts as text: "20% Down Payment, ..."."""
    parts = F.transform(F.map_entries(plan), lambda e: F.concat(e["value"], F.lit(" "), F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" ")))))
    return F.coalesce(F.nullif(F.array_join(parts, ", "), F.lit("")), F.lit("Available on request"))


def filled_template(template: Column, values: Column) -> Column:
    """{name} places filled from a map in one pass, unknown names by N/A; filled-in text is never filled again."""
    parts = F.split(F.regexp_replace(template, r"\{(\w+)\}", "\u0001$1\u0002"), "\u0001")

    def part(p: Column) -> Column:
        name = F.substring_index(p, "\u0002", 1)
        rest = F.substr(p, F.length(name) + 2)
        return F.when(F.contains(p, F.lit("\u0002")), F.concat(F.coalesce(F.try_element_at(values, name), F.lit("N/A")), rest)).otherwise(p)

    return F.array_join(F.transform(parts, part), "")


def title_of_snake(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def snake_of_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(title)), "[^a-z0-9]+", "_"), F.lit("_"))


def without_fences(text: Column) -> Column:
    """A text without the lines that open or close a code block."""
    return F.regexp_replace(F.regexp_replace(text, r"(?m)^```.*$\n?", ""), r"^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float = 3.0, price_out: float = 15.0) -> Column:
    """Prices are for a million tokens; exact in decimals."""
    d = lambda c: c.cast("decimal(20,0)")
    return (d(tokens_in) * F.lit(price_in).cast("decimal(10,4)") + d(tokens_out) * F.lit(price_out).cast("decimal(10,4)")) / 1_000_000


def masked_email(email: Column) -> Column:
    return F.regexp_replace(email, r"^(.).*?(@.*)$", "$1***$2")


def in_domain(email: Column, domain: str) -> Column:
    return F.endswith(F.lower(email), F.lit(f"@{domain}"))


def name_of_alt(alt: Column) -> Column:
    """A project's name from the alt text of its logo or plan: "Logo X", "X logo", "Site plan of X"."""
    found = lambda p: F.nullif(F.trim(F.regexp_extract(alt, p, 1)), F.lit(""))
    return F.coalesce(found(r"(?i)^logo\s+(?:of\s+|for\s+)?(.+)$"), found(r"(?i)^(.+?)\s+logo"), found(r"(?i)(?:master|site) plan (?:of|for)\s+(.+)$"))
