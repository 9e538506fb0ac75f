"""Column helpers on arrays that stay inside one row (no shuffle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable.

    A projection may be merged into the lambda that reads it, which would evaluate an expensive
    column once per element; a bound variable cannot.
    """
    return F.transform(F.array(value), body).getItem(0)


def occurrence_counts(tokens: Column) -> Column:
    """``array<struct<term, n, first>>``: one entry per distinct token of the row.

    Sort, mark the start of each run, and take differences of run starts: O(n log n) per row,
    against O(n * distinct) for counting each token on its own.
    """
    tagged = F.sort_array(
        F.transform(tokens, lambda t, i: F.struct(t.alias("term"), i.alias("first")))
    )

    def runs(ordered: Column) -> Column:
        starts = F.filter(
            F.transform(
                ordered,
                lambda t, i: F.struct(
                    t["term"].alias("term"), t["first"].alias("first"), i.alias("at"),
                    F.coalesce(F.get(ordered, i - 1)["term"] != t["term"], F.lit(True)).alias("new"),
                ),
            ),
            lambda t: t["new"],
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda t, j: F.struct(
                    t["term"].alias("term"),
                    (F.coalesce(F.get(s, j + 1)["at"], F.size(ordered)) - t["at"]).alias("n"),
                    t["first"].alias("first"),
                ),
            ),
        )

    return let(tagged, runs)


def most_common(tokens: Column, k: int) -> Column:
    """The ``k`` most frequent tokens of the row, earliest first occurrence first on ties."""
    ranked = F.sort_array(
        F.transform(
            occurrence_counts(tokens),
            lambda c: F.struct((-c["n"]).alias("neg"), c["first"].alias("first"), c["term"].alias("term")),
        )
    )
    return F.transform(F.slice(ranked, 1, k), lambda c: c["term"])


def adjacent_pairs(tokens: Column) -> Column:
    """``array<struct<a, b>>`` of neighbouring tokens."""
    def pairs(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(
            F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n),
            lambda a, b: F.struct(a.alias("a"), b.alias("b")),
        )
    return let(tokens, pairs)


def exploded(df: DataFrame, array: Column | str, name: str, *others: Column | str, position: str | None = None) -> DataFrame:
    """One row per array element, next to the ``others``; empty and null arrays give no row.

    A plain explode makes the optimizer add a "size > 0" filter below it, which computes the whole
    array expression a second time. The outer explode plus a filter on its result does not.
    """
    if position is None:
        return df.select(*others, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
    return df.select(*others, F.posexplode_outer(array).alias(position, name)).filter(F.col(position).isNotNull())
