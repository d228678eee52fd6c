"""Joins whose big side may hold a large part of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import cut_lineage

HOT_SHARE = 0.001
HOT_ROWS = 100_000


def left_join_weighted(big: DataFrame, small: DataFrame, key: str, weight: str, share: float = HOT_SHARE,
                       floor: int = HOT_ROWS) -> DataFrame:
    """`big` left join `small`, where `small[weight]` says how many rows of `big` have the key.

    A key is hot above `share` of all counted rows, so there are at most 1/share hot keys: these are
    broadcast and their rows stay where they are. Only rows with other keys are shuffled by key.
    """
    small = cut_lineage(small)  # read four times
    total = small.agg(F.sum(weight)).first()[0] or 0
    limit = max(floor, int(total * share))
    hot = small.filter(F.col(weight) > limit).drop(weight)
    rest = small.filter(F.col(weight) <= limit).drop(weight)
    if total <= limit or hot.isEmpty():
        return big.join(rest, key, "left")
    return big.join(F.broadcast(hot), key).unionByName(
        big.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key, "left"))
