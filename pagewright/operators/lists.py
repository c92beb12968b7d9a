"""Allow and deny lists as tables, of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Most entries of a list that is sent to every task; a longer one is shuffled.
BROADCAST_ENTRIES = 50_000


def by_list(rows: DataFrame, key: Column | str, listed: DataFrame, keep: bool = True, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """``rows`` whose ``key`` is in the first column of ``listed`` (``keep``), or is not.

    Null is never in a list: a null entry says nothing and a row with a null key is kept only where listed rows are dropped. Repeated
    entries count once. A list is broadcast when it has at most ``most`` entries, which is counted, and else joined by a shuffle
    that splits a frequent key.
    """
    name = "_listed"
    while name in rows.columns:
        name += "_"
    entries = listed.select(F.col(listed.columns[0]).alias(name)).filter(F.col(name).isNotNull()).distinct()
    small = entries.limit(most + 1).count() <= most
    entries = F.broadcast(entries) if small else entries.hint("merge")
    key = F.col(key) if isinstance(key, str) else key
    return rows.join(entries, key == F.col(name), "left_semi" if keep else "left_anti")
