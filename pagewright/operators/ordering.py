"""Order within a group when one group may hold a large share of all rows.

A window over the whole group would sort that group in one task. Instead the sort
key's leading columns act as *bands*: rows are counted per band (a map-side combined
aggregate), the running count over bands gives each band's offset, and rows are ranked
only inside their band. Results equal the plain window's.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def _offsets(df: DataFrame, group: Sequence[str], bands: Sequence[str], measure) -> DataFrame:
    before = (W.partitionBy(*group).orderBy(*bands)
              .rowsBetween(W.unboundedPreceding, -1))
    return (df.groupBy(*group, *bands).agg(measure.alias("_m"))
            .select(*group, *bands, F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_offset")))


def ranked(df: DataFrame, group: Sequence[str], bands: Sequence[str], order: Sequence[str],
           name: str, together: bool = False) -> DataFrame:
    """Add the 1-based rank of each row in ``group``, sorted by ``bands`` then ``order``.

    ``bands`` are columns that lead the sort order. A row with a null group or band key has
    no place in an order: it is kept, with a null rank. ``together``: a group's rows lie in one part already, as
    ``fixtures.dealt`` leaves them, so nothing is won by bands and one sort ranks them in place.
    """
    group, bands = list(group), list(bands)
    if together:
        known = reduce(and_, (F.col(c).isNotNull() for c in group + bands))
        whole = W.partitionBy(*group).orderBy(*bands, *order)
        return df.withColumn(name, F.when(known, F.row_number().over(whole)).cast("long"))
    inside = W.partitionBy(*group, *bands).orderBy(*order)
    return (df.join(_offsets(df, group, bands, F.count("*")), group + bands, "left")
            .withColumn(name, F.row_number().over(inside) + F.col("_offset"))
            .drop("_offset"))


def running_sum(df: DataFrame, group: Sequence[str], bands: Sequence[str], order: Sequence[str],
                value: str, name: str) -> DataFrame:
    """Add the running sum of ``value`` in ``group``, in ``bands`` then ``order``; see ``ranked``."""
    group, bands = list(group), list(bands)
    inside = (W.partitionBy(*group, *bands).orderBy(*order)
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    return (df.join(_offsets(df, group, bands, F.sum(value)), group + bands, "left")
            .withColumn(name, F.sum(value).over(inside) + F.col("_offset"))
            .drop("_offset"))


def joined_in_order(df: DataFrame, group: Sequence[str], bands: Sequence[str],
                    order: Sequence[str], text: str, separator: str, name: str) -> DataFrame:
    """One string per group: ``text`` joined in ``bands`` then ``order``.

    The pieces of a band are joined first, so the last step sees one string per band.
    """
    pieces = df.groupBy(*group, *bands).agg(
        sorted_join(order, text, separator).alias("_piece"))
    return pieces.groupBy(*group).agg(sorted_join(bands, "_piece", separator).alias(name))


def sorted_join(order: Sequence[str], text: str, separator: str) -> Column:
    """Aggregate: the group's strings joined in order. For groups of bounded size."""
    rows = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_text"))))
    return F.array_join(rows["_text"], separator)
