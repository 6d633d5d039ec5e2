"""Full-text search: terms of lower-cased text, a small stop list, stems; rank is the number of hits.

An approximation of a database's English text search, in built-in expressions only: stems are those of steps 1a to 1c of
the public Porter2 algorithm (plurals, -ed and -ing, final y), without its later steps (-ation, -ness, ...).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with")


def _let(value: Column, use) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def stem(t: Column) -> Column:
    """Words of up to two letters stay as they are."""
    without = lambda c, n: F.left(c, F.length(c) - n)

    def plural(w: Column) -> Column:
        return (
            F.when(F.endswith(w, F.lit("sses")), without(w, 2)).when(w.rlike("^.(ies|ied)$"), without(w, 1)).when(w.rlike("(ies|ied)$"), without(w, 2))
            .when(w.rlike("[aeiouy].+s$") & ~w.rlike("(us|ss)$"), without(w, 1)).otherwise(w)
        )

    def mended(w: Column) -> Column:
        """What is left of a word after -ed or -ing."""
        short = "^[^aeiouy]*[aeiouy][^aeiouywx]$"
        return F.when(w.rlike("(at|bl|iz)$"), F.concat(w, F.lit("e"))).when(w.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), without(w, 1)).when(w.rlike(short), F.concat(w, F.lit("e"))).otherwise(w)

    def verb(w: Column) -> Column:
        return (
            F.when(w.rlike("eed(ly)?$"), F.when(w.rlike("[aeiouy][^aeiouy].*eed(ly)?$"), F.regexp_replace(w, "eed(ly)?$", "ee")).otherwise(w))
            .when(w.rlike("[aeiouy].*(ed|edly|ing|ingly)$"), _let(F.regexp_replace(w, "(ed|edly|ing|ingly)$", ""), mended)).otherwise(w)
        )

    final = lambda w: F.when(w.rlike("^.+[^aeiouy]y$"), F.concat(without(w, 1), F.lit("i"))).otherwise(w)
    return F.when(F.length(t) <= 2, t).otherwise(_let(_let(plural(t), verb), final))


def search_words(text: Column) -> Column:
    """The words of a text that count, in order, with repeats."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(*STOP))


def search_terms(text: Column) -> Column:
    """The stemmed terms of a text, in order, with repeats."""
    return F.transform(search_words(text), stem)


def text_search(df: DataFrame, columns: list[str], asked: str, limit: int | None = None) -> DataFrame:
    """Rows that hold every term of `asked` in the given columns, with rank; with a limit the best, ties by id."""
    terms = search_terms(F.concat_ws(" ", *columns))
    wanted = F.array_distinct(search_terms(F.lit(asked)))
    found = df.withColumn("_terms", terms).withColumn("_asked", wanted)
    found = found.where(F.size(F.array_except("_asked", "_terms")) == 0)
    found = found.withColumn("rank", F.size(F.filter("_terms", lambda t: F.array_contains(F.col("_asked"), t))).cast("long")).drop("_terms", "_asked")
    return found if limit is None else found.orderBy(F.desc("rank"), "id").limit(limit)
